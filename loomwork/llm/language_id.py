"""Language identification with a convolutional network over bytes.

A text is cut into windows of fixed length, all of them read. Filters of several widths slide over the
embedded bytes of a window; the maximum of each filter goes to a softmax over the languages seen in
training. A text's probabilities are the mean over its windows, weighted by their bytes.

The network is trained in numpy on the driver, on about ``TRAIN_DOCS`` distinct labelled texts at most
and ``TRAIN_WINDOWS`` windows of each, chosen by a hash of the text and so the same on every run.
Only text and non-null labels of documents outside the held-out fold are learned from.

Null texts and texts without a letter are ``und`` with score 0; without anything to learn from all
texts are. A null id is outside the held-out fold. Rows may repeat; other columns are not read.

``identified`` also asks whether a text reads like its language: the mean logarithm of the chance of each
letter after the one before, learned from the same windows, has to lie nearer to what is typical of them
than to letters at random.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import textbytes as tb

WINDOW = 512
WIDTHS, FILTERS, DIMS = (2, 3, 4), 8, 8
TAPS = max(WIDTHS)
TRAIN_DOCS, TRAIN_WINDOWS = 2000, 4
STEPS, BATCH, RATE = 700, 64, 0.01
#: A window tells its language with a probability of this many times chance; a text does if half of its bytes are in such windows.
TELLING = 1.2
#: Standard deviations by which a short text may fall behind prose, and pairs of letters below which it is not judged.
ALLOWANCE, LEAST_PAIRS = 3.0, 32
_LETTER = tb.word_table([*range(65, 91), *range(97, 123), *range(128, 256)])
_WRITTEN = _LETTER | tb.word_table([0x20])
#: Windows computed at a time.
BLOCK = 128


def held_out(key: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Prose:
    """How likely each letter is after the one before, in each language; and what is typical of texts.

    Pairs of bytes count where both are letters, or one is and the other is a space; A-Z count as a-z, and bytes
    beyond ASCII as letters. So numbers, keys and punctuation in a text say nothing for or against it.
    """

    chances: np.ndarray  # languages x 65536, natural logarithms
    cut: float  # half way between training windows and letters at random
    spread: float  # standard deviation of a single pair

    @staticmethod
    def pairs(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each pair of bytes, and whether it counts."""
        counts = (_LETTER[before] & _WRITTEN[after]) | (_WRITTEN[before] & _LETTER[after])
        return tb.LOWER[before].astype(np.int64) << 8 | tb.LOWER[after], counts

    @classmethod
    def of(cls, windows: np.ndarray, labels: np.ndarray, languages: int) -> Prose:
        counts = np.full((languages, 256, 256), 0.1)
        pair, real = cls.pairs(windows[:, :-1], windows[:, 1:])
        for k in range(languages):
            own = labels == k
            counts[k] += np.bincount(pair[own][real[own]], minlength=65536).reshape(256, 256)
        chances = np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32)
        found = chances.reshape(languages, -1)[labels[:, None], pair]
        some = real.sum(1) > 0
        typical = np.median((found * real).sum(1)[some] / real.sum(1)[some]) if some.any() else 0.0
        random = chances[:, 97:123, 97:123].mean()
        return cls(chances.reshape(languages, -1), float(typical + random) / 2, float(found[real].std()) if some.any() else 0.0)

    def reads(self, data: np.ndarray, offs: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Whether each text is nearer to prose of its language than to letters at random; short ones have an allowance, and below ``LEAST_PAIRS`` stay."""
        text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        pair, real = self.pairs(data[:-1], data[1:])
        real &= text[1:] == text[:-1]
        owner = text[1:][real]
        n = np.bincount(owner, minlength=len(offs) - 1)
        total = np.bincount(owner, weights=self.chances.ravel()[language[owner] << 16 | pair[real]], minlength=len(n))
        steps = np.maximum(n, 1)
        return (n < LEAST_PAIRS) | (total / steps >= self.cut - ALLOWANCE * self.spread / np.sqrt(steps))


@dataclass
class Network:
    """Parameters: byte embeddings, filters over embedded taps, output weights; and the languages."""

    embedding: np.ndarray  # 256 x dims
    filters: np.ndarray  # filters x (taps * dims); narrow filters hold zeros behind their width
    bias: np.ndarray
    weights: np.ndarray  # filters x languages
    shift: np.ndarray
    languages: list[str]
    prose: Prose | None = None

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximum of each filter, where it is, and the embedded taps, for windows padded by ``TAPS - 1`` zeros."""
        rows, length = windows.shape
        flat = np.concatenate([windows.ravel(), np.zeros(TAPS - 1, np.uint8)])
        embedded = np.ascontiguousarray(self.embedding.T).take(flat, axis=1)
        n = rows * length
        taps = np.concatenate([embedded[:, t : t + n] for t in range(TAPS)])
        response = (self.filters @ taps).reshape(len(self.filters), rows, length)[:, :, : length - TAPS + 1]
        return response.max(2).T, response, taps

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        best, _, _ = self.pooled(windows)
        return softmax(np.maximum(best + self.bias, 0) @ self.weights + self.shift)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, padded with zeros; the text and the number of bytes of each."""
    counts = -(-np.diff(offs) // WINDOW)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offs[text] + within * WINDOW
    size = np.minimum(offs[text + 1] - start, WINDOW)
    out = np.zeros((len(text), WINDOW + TAPS - 1), np.uint8)
    inside = np.arange(WINDOW)[None, :] < size[:, None]
    out[:, :WINDOW][inside] = data  # windows cover every byte once, in order
    return out, text, size


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy; some windows are shortened, so that short texts are known as well."""
    rng = np.random.default_rng(seed)
    f = len(WIDTHS) * FILTERS
    live = np.repeat([[t < w for t in range(TAPS) for _ in range(DIMS)] for w in WIDTHS], FILTERS, axis=0)
    net = Network(
        rng.normal(0, 0.5, (256, DIMS)).astype(np.float32), (rng.normal(0, 0.3, (f, TAPS * DIMS)) * live).astype(np.float32),
        np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), languages,
    )
    names = ("embedding", "filters", "bias", "weights", "shift")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    groups = [np.flatnonzero(labels == k) for k in range(len(languages))]
    groups = [g for g in groups if len(g)]
    for step in range(1, STEPS + 1):
        # Languages are drawn alike, so that a common one does not win unclear windows.
        pick = np.array([rng.choice(groups[i % len(groups)]) for i in range(BATCH)])
        batch, wanted = windows[pick].copy(), labels[pick]
        for i in np.flatnonzero(rng.random(BATCH) < 0.5):
            batch[i, rng.integers(16, WINDOW) :] = 0
        best, response, taps = net.pooled(batch)
        hidden = np.maximum(best + net.bias, 0)
        error = softmax(hidden @ net.weights + net.shift)
        error[np.arange(BATCH), wanted] -= 1
        error /= BATCH
        back = (error @ net.weights.T) * (hidden > 0)
        where = response.argmax(2).T + np.arange(BATCH)[:, None] * batch.shape[1]  # batch x filters
        seen = taps[:, where.ravel()]
        scaled = seen * back.ravel()
        grad = {
            "weights": hidden.T @ error, "shift": error.sum(0), "bias": back.sum(0),
            "filters": scaled.reshape(len(taps), BATCH, f).sum(1).T * live, "embedding": np.zeros_like(net.embedding),
        }
        through = (net.filters[np.tile(np.arange(f), BATCH)] * back.ravel()[:, None]).reshape(-1, TAPS, DIMS)
        flat = np.concatenate([batch.ravel(), np.zeros(TAPS, np.uint8)])
        for t in range(TAPS):
            np.add.at(grad["embedding"], flat[where.ravel() + t], through[:, t])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for n in names:
            first[n] += 0.1 * (grad[n] - first[n])
            second[n] += 0.01 * (grad[n] ** 2 - second[n])
            move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-7)
            setattr(net, n, (getattr(net, n) - rate * move).astype(np.float32))
    return net


def _some_windows(batches):
    """Up to ``TRAIN_WINDOWS`` windows of each document, spread over it."""
    for batch in batches:
        for part, data, offs in tb.slices(batch, "text"):
            windows, text, size = windows_of(data, offs)
            keep = []
            for t in range(part.num_rows):
                own = np.flatnonzero(text == t)
                keep.extend(own[np.unique(np.linspace(0, len(own) - 1, min(TRAIN_WINDOWS, len(own))).astype(int))] if len(own) else [])
            lang = part.column(part.schema.get_field_index("lang")).take(pa.array(text[keep]))
            yield pa.RecordBatch.from_arrays([lang, pa.array([windows[k].tobytes() for k in keep], pa.binary())], names=["lang", "window"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from the labelled documents outside the held-out fold; None if there are none."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    rows = rows.withColumn("tag", F.xxhash64("text"))  # copies of a text are taken together, and once
    texts = rows.select("lang", "tag").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["lang"]: r["n"] for r in texts.collect()}  # one row per language
    if not counts:
        return None
    per = max(1, TRAIN_DOCS // len(counts))
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, per * 1_000_000 // n + 1))])
    chosen = rows.where(F.pmod(F.xxhash64("tag", F.lit("train")), F.lit(1_000_000)) < rates[F.col("lang")])
    found = chosen.mapInArrow(_some_windows, "lang string, window binary").distinct()
    # In the order of a hash, so that a cut takes windows of all languages alike.
    found = found.orderBy(F.xxhash64("window"), "lang", "window").limit(2 * TRAIN_DOCS * TRAIN_WINDOWS).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if not languages:
        return None
    labels = np.array([languages.index(x) for x in found.column("lang").to_pylist()])
    windows = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(len(labels), -1)
    net = fit(windows, labels, languages)
    net.prose = Prose.of(windows, labels, len(languages))
    return net


def _predict(net: Network | None, names: list[str]):
    def step(batches):
        for batch in batches:
            for part, data, offs in tb.slices(batch, "text__read"):
                languages, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if net is not None:
                    windows, text, size = windows_of(data, offs)
                    total = np.zeros((part.num_rows, len(net.languages)))
                    for a in range(0, len(windows), BLOCK):
                        b = slice(a, a + BLOCK)
                        np.add.at(total, text[b], net.probabilities(windows[b]) * size[b, None])
                    some = total.sum(1) > 0
                    total[some] /= total[some].sum(1, keepdims=True)
                    scores = np.clip(total.max(1), 0, 1)
                    languages = [net.languages[k] if s else "und" for k, s in zip(total.argmax(1), some)]
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(languages, pa.string()), pa.array(scores)], names=[*names, "lang__pred", "lang__score"])

    return step


def predict(docs: DataFrame, net: Network | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default), ``lang__pred`` and ``lang__score`` for each row of ``docs``."""
    keep = docs.columns if keep is None else keep
    read = F.when(F.rlike(F.col(text), F.lit(r"\p{L}")), F.col(text))  # others stay without windows
    rows = docs.select(*keep, read.alias("text__read"))
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("lang__pred", T.StringType()), T.StructField("lang__score", T.DoubleType())])
    return rows.mapInArrow(_predict(net, keep), schema)


def _kept(net: Network, column: str):
    """Map step: rows whose windows tell a language and whose bytes follow one another as in its prose."""

    def step(batches):
        for batch in batches:
            for part, data, offs in tb.slices(batch, column):
                windows, text, size = windows_of(data, offs)
                total = np.zeros((part.num_rows, len(net.languages)))
                told = np.zeros(part.num_rows)
                for a in range(0, len(windows), BLOCK):
                    b = slice(a, a + BLOCK)
                    chance = net.probabilities(windows[b])
                    np.add.at(total, text[b], chance * size[b, None])
                    np.add.at(told, text[b], size[b] * (chance.max(1) * len(net.languages) >= TELLING))
                known = (2 * told >= total.sum(1)) | (len(net.languages) == 1)
                yield part.filter(pa.array(known & net.prose.reads(data, offs, total.argmax(1))))

    return step


def identified(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows in a recognisable language, with their own columns.

    Out go texts without a letter, texts most of whose windows tell no language, and texts whose bytes do
    not follow one another as in any language that was learned (scripts and gibberish that were never
    seen). Windows are judged one by one, so a text that mixes languages stays. Without anything to
    learn from all rows go.
    """
    net, text = train(docs, **columns), columns.get("text", "text")
    readable = docs.where(F.rlike(F.col(text), F.lit(r"\p{L}")))
    if net is None:
        return readable.limit(0)
    return readable.mapInArrow(_kept(net, text), docs.schema)
