"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed for all documents in the tasks. Trees are fitted in numpy on the driver, on at
most about ``TRAIN_ROWS`` labelled rows of statistics chosen by a hash of the id, and flattened into
arrays that all rows walk through at once.

Labels come only from documents outside the held-out fold. Null texts count as empty and are scored
like any text. Without labels every score is 0.5; with labels of one kind it is close to that kind. Labels
that are null are left out; a document with several labels counts once for each. A null id has no label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import textbytes as tb
from loomwork.llm.language_id import held_out
from loomwork.session import materialize

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 80, 4, 64, 0.15, 1.0, 1.0
CUTOFF = 0.7

_SPACE = tb.word_table([0x20, *range(0x09, 0x0E)])
_WORD = ~_SPACE
_LINE = tb.word_table(set(range(256)) - {0x0A, 0x0D})
_UPPER, _LOWER_CASE = tb.word_table(range(65, 91)), tb.word_table(range(97, 123))
_DIGIT, _WIDE = tb.word_table(range(48, 58)), tb.word_table(range(128, 256))
_STOP, _MARK = tb.word_table(b".,;:"), tb.word_table(b"!?")
_SIGN = tb.word_table(set(range(33, 127)) - set(range(48, 58)) - set(range(65, 91)) - set(range(97, 123)) - set(b".,;:!?'\"-()"))
SHARES = (_SPACE, _UPPER, _LOWER_CASE, _DIGIT, _WIDE, _STOP, _MARK, _SIGN, ~_LINE)
FEATURES = len(SHARES) + 13


def _distinct(digests: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Share of distinct entries in each text's run."""
    out = np.ones(len(before) - 1)
    for i, (a, b) in enumerate(zip(before[:-1], before[1:])):
        if b - a > 1:
            run = np.sort(digests[a:b])
            out[i] = (1 + np.count_nonzero(run[1:] != run[:-1])) / (b - a)
    return out


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text; zeros for empty ones."""
    texts, size = len(offs) - 1, np.diff(offs)
    out = np.zeros((texts, FEATURES))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    for k, table in enumerate(SHARES):
        out[full, k] = np.add.reduceat(table[data].astype(np.int64), offs[:-1][full]) / size[full]
    lowered = tb.LOWER[data]
    starts, ends, before = tb.words(data, offs, _WORD)
    digests = tb.range_digests(lowered, starts, ends)
    words, length = np.diff(before), ends - starts
    text = np.repeat(np.arange(texts), words)
    some = np.maximum(words, 1)
    same = np.concatenate([[False], (digests[1:] == digests[:-1]) & (text[1:] == text[:-1])])
    last_sign = (_SIGN | _MARK)[data[ends - 1]] if len(ends) else np.empty(0, np.bool_)
    upper = _UPPER[data[starts]] if len(starts) else np.empty(0, np.bool_)
    k = len(SHARES)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, values, texts) / some

    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(words)
    out[:, k + 2] = mean(length)
    out[:, k + 3] = np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - out[:, k + 2] ** 2))
    out[:, k + 4] = mean(length <= 3)
    out[:, k + 5] = mean(length >= 12)
    out[:, k + 6] = mean(same)
    out[:, k + 7] = mean(last_sign)
    out[:, k + 8] = mean(upper)
    out[:, k + 9] = _distinct(digests, before)
    grams = tb.gram_digests(digests, 3)
    inner = np.minimum(before, len(grams))
    out[:, k + 10] = _distinct(grams, inner)
    starts, ends, before = tb.words(data, offs, _LINE)
    lines = np.diff(before)
    out[:, k + 11] = _distinct(tb.range_digests(lowered, starts, ends), before)
    out[:, k + 12] = np.bincount(np.repeat(np.arange(texts), lines), ends - starts, texts) / np.maximum(lines, 1)
    out[size == 0] = 0
    return out


@dataclass
class Forest:
    """Trees as arrays: node i has children 2i+1 and 2i+2; a leaf's value stands in the last level."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        total = self.start + self.leaf[tree, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees of fixed depth on the logistic loss, from histograms of binned statistics."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin <= b means x <= edge b
    rate = (y.sum() + 1) / (n + 2)
    start = float(np.log(rate / (1 - rate)))
    total = np.full(n, start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature = np.zeros((TREES, inner), np.int64)
    threshold = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, leaves))
    column = np.arange(width)[None, :] * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            nodes = 2**level
            local = node - (nodes - 1)
            cell = (local[:, None] * (width * BINS) + column + binned).ravel()
            g = np.bincount(cell, np.repeat(gradient, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2)
            h = np.bincount(cell, np.repeat(weight, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = best // BINS, best % BINS
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            at = np.arange(nodes) + nodes - 1
            for i in np.flatnonzero(split):
                if b[i] < len(edges[f[i]]):
                    feature[t, at[i]], threshold[t, at[i]] = f[i], edges[f[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        place = node - inner
        g, h = np.bincount(place, gradient, leaves), np.bincount(place, weight, leaves)
        leaf[t] = -RATE * g / (h + RIDGE)
        total += leaf[t, place]
    return Forest(feature, threshold, leaf, start)


def _measure(batches):
    for batch in batches:
        for part, data, offs in tb.slices(batch, "text"):
            rows = statistics(data, offs)
            values = tb.runs_to_list(pa.array(rows.ravel()), np.full(len(rows), FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), values], names=["doc_id", "statistics"])


def train(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Forest | None:
    """Trees from labelled statistics outside the held-out fold; None without labels."""
    known = labels.select(F.col(key).alias("label_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    rows = measured.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("label_id"))
    count = rows.count()
    if not count:
        return None
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < F.lit(TRAIN_ROWS * 1_000_000 // count + 1)
    sample = rows.where(chosen).select("doc_id", "statistics", "label").orderBy("doc_id", "label").limit(2 * TRAIN_ROWS).toArrow()
    if not sample.num_rows:
        return None
    x = sample.column("statistics").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    return fit(x, sample.column("label").to_numpy().astype(np.float64))


def _score(forest: Forest | None):
    def step(batches):
        for batch in batches:
            scores = []
            for a in range(0, batch.num_rows, 2000):
                values = batch.column(batch.schema.get_field_index("statistics")).slice(a, 2000).flatten().to_numpy().reshape(-1, FEATURES)
                scores.append(forest.score(values) if forest else np.full(len(values), 0.5))
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(scores)], names=["doc_id", "score"])

    return step


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    measured = materialize(rows.mapInArrow(_measure, f"doc_id {kind}, statistics array<double>"), "statistics")
    scored = measured.mapInArrow(_score(train(measured, labels)), f"doc_id {kind}, score double")
    return scored.select(
        F.col("doc_id").alias(key), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted")
    )
