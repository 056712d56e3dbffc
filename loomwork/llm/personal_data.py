r"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. A random field then labels the tokens that hold a digit or ``@``; all
other tokens are outside by definition and only end the chains. Neighbouring tokens are linked, and so
are distant ones that repeat each other or have the same digits. Sum-product messages run over these
links until the labels of a document agree; a token that is labelled with certainty but has no base
span is an added one, for example the second mention of a number without its prefix.

The field is trained by pseudo-likelihood in numpy on the driver, on the base labels of about
``TRAIN_DOCS`` documents chosen by a hash of their text, those with more than ``TRAIN_TOKENS`` such
tokens left out of training. Every text is searched whole.

Places are counted in code points, the end is exclusive. Null texts are empty. Rows are judged one by one,
so ids may repeat or be null; other columns are carried only where they are asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import textbytes as tb

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
TRAIN_DOCS, TRAIN_TOKENS = 2000, 1000
STEPS, RATE = 300, 0.05
ROUNDS, SETTLED, DAMPING = 20, 1e-3, 0.3
#: Probability from which a token without base span is added.
CERTAIN = 0.95
#: What training draws the weight of equal labels at both ends of a skip link towards.
SKIP_PRIOR = 1.5

# The base patterns. Each begins where a run of its first characters does, as a later start in
# the same run would end alike.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN, _HINT, _DIGITS = re.compile(r"\S+"), re.compile(r"[0-9@]"), re.compile(r"[^0-9]+")
_EDGE = ".,;:!?\"'()[]{}<>"
_JOINTS = frozenset(" ().-")


def luhn(digits: str) -> bool:
    """Whether the weighted digit sum is a multiple of ten."""
    total = sum(int(d) for d in digits[-1::-2]) + sum((2 * int(d)) // 10 + (2 * int(d)) % 10 for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start."""
    out = []
    edge, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > edge and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            edge = domain.end()
            out.append((0, start, edge))
        at = text.find("@", max(at + 1, edge))
    if not re.search("[0-9]", text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _features(core: str, digits: str) -> list[bool]:
    n = len(digits)
    letters = any(c.isalpha() for c in core)
    return [
        True, "@" in core, "@" in core and "." in core.partition("@")[2], n == 0, n == 1, n == 2, n == 3, n == 4, 5 <= n <= 6, 7 <= n <= 8,
        9 <= n <= 12, 13 <= n <= 19 and luhn(digits), 13 <= n <= 19 and not luhn(digits), n > 19, letters, letters and n > 0,
        core.count(".") == 3 and not letters, core.count(".") in (1, 2), "-" in core, core.startswith("+"), "(" in core or ")" in core,
        "=" in core or ":" in core or "/" in core, len(core) > 30,
    ]


FEATURES = len(_features("a", ""))


@dataclass
class Graph:
    """Tokens of some documents with their features, links (chain or skip) and base labels."""

    document: np.ndarray
    span: np.ndarray  # tokens x (start, end), without outer punctuation
    features: np.ndarray
    links: np.ndarray  # links x (token, token, 1 if skip)
    label: np.ndarray


def graph(texts: list[str], found: list[list[tuple[int, int, int]]]) -> Graph:
    """The graph of the tokens that hold a digit or ``@``. A repeated token links to the one before it and to its first mention."""
    document, span, features, links, label = [], [], [], [], []
    for d, text in enumerate(texts):
        if not _HINT.search(text):
            continue
        mentions: dict[str, list[int]] = {}
        before = -2
        base = sorted((s, e, k) for k, s, e in found[d])
        b = 0
        for number, m in enumerate(_TOKEN.finditer(text)):
            token = m.group()
            if not _HINT.search(token):
                continue
            core = token.strip(_EDGE)
            start = m.start() + token.index(core) if core else m.start()
            end = start + len(core)
            digits = _DIGITS.sub("", core)
            node = len(document)
            while b < len(base) and base[b][1] <= m.start():
                b += 1
            kind = next((k + 1 for s, e, k in base[b : b + 4] if s < end and e > start), 0)
            document.append(d)
            span.append((start, end))
            features.append(_features(token.rstrip(_EDGE), digits))
            label.append(kind)
            if before == number - 1:
                links.append((node - 1, node, 0))
            before = number
            for key in {core.lower(), f"#{digits}" if len(digits) >= 7 else core.lower()}:
                seen = mentions.setdefault(key, [])
                for other in dict.fromkeys(seen):
                    links.append((other, node, 1))
                mentions[key] = [*seen[:1], node]
    return Graph(
        np.array(document, np.int64), np.array(span, np.int64).reshape(-1, 2), np.array(features, np.float64).reshape(-1, FEATURES),
        np.array(links, np.int64).reshape(-1, 3), np.array(label, np.int64),
    )


@dataclass
class Field:
    """Weights of token features, and of the labels at both ends of chain and skip links."""

    token: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit(g: Graph) -> Field:
    """Adam on the pseudo-likelihood: each token given the labels of the tokens it is linked to."""
    k = len(LABELS)
    onehot = np.eye(k)[g.label]
    around = []
    for skip in (0, 1):
        links = g.links[g.links[:, 2] == skip]
        total = np.zeros((2, len(g.label), k))  # labels before and after each token
        np.add.at(total[0], links[:, 1], onehot[links[:, 0]])
        np.add.at(total[1], links[:, 0], onehot[links[:, 1]])
        around.append(total)
    prior = SKIP_PRIOR * np.eye(k)
    params = [np.zeros((FEATURES, k)), np.zeros((k, k)), prior]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        w, chain, skip = params
        logits = g.features @ w + around[0][0] @ chain + around[0][1] @ chain.T + around[1].sum(0) @ skip
        p = np.exp(logits - logits.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - onehot) / len(onehot)
        grads = [
            g.features.T @ error + 1e-4 * w, around[0][0].T @ error + (around[0][1].T @ error).T + 1e-4 * chain,
            around[1].sum(0).T @ error + 1e-2 * (skip - prior),
        ]
        grads[2] = (grads[2] + grads[2].T) / 2
        for i, grad in enumerate(grads):
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.01 * (grad**2 - second[i])
            params[i] = params[i] - RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*params)


def marginals(g: Graph, field: Field) -> np.ndarray:
    """Label probabilities of each token by damped loopy message passing."""

    def normal(x: np.ndarray) -> np.ndarray:
        top = x.max(1, keepdims=True)
        return x - top - np.log(np.exp(x - top).sum(1, keepdims=True))

    score = g.features @ field.token
    if not len(g.links):
        return np.exp(normal(score))
    weights = np.where(g.links[:, 2, None, None] == 1, field.skip[None], field.chain[None])  # label before x label after
    source = np.concatenate([g.links[:, 0], g.links[:, 1]])
    target = np.concatenate([g.links[:, 1], g.links[:, 0]])
    weights = np.concatenate([weights, weights.transpose(0, 2, 1)])
    half = len(g.links)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    message = np.zeros((2 * half, len(LABELS)))
    for _ in range(ROUNDS):
        belief = score.copy()
        np.add.at(belief, target, message)
        rest = belief[source] - message[back]
        joint = rest[:, :, None] + weights
        top = joint.max(1)
        new = normal(top + np.log(np.exp(joint - top[:, None, :]).sum(1)))
        change = np.abs(np.exp(new) - np.exp(message)).max(initial=0)
        message = DAMPING * message + (1 - DAMPING) * new
        if change < SETTLED:
            break
    belief = score.copy()
    np.add.at(belief, target, message)
    return np.exp(normal(belief))


def added_spans(text: str, base: list[tuple[int, int, int]], spans: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of tokens of one kind without base span, of which one at least is certain.

    A run goes on over brackets, dots, hyphens and spaces, as the parts of a number do.
    """
    taken = sorted((s, e) for _, s, e in base)
    runs: list[list] = []  # kind, start, end, highest probability
    b = 0
    for (start, end), row in zip(spans.tolist(), p):
        kind = int(row.argmax())
        while b < len(taken) and taken[b][1] <= start:
            b += 1
        if not kind or end <= start or (b < len(taken) and taken[b][0] < end):
            continue
        last = runs[-1] if runs else None
        if last and last[0] == kind - 1 and set(text[last[2] : start]) <= _JOINTS and not any(last[2] <= s < start for s, _ in taken[max(0, b - 1) : b]):
            last[2], last[3] = end, max(last[3], row[kind])
        else:
            runs.append([kind - 1, start, end, row[kind]])
    return [(k, s, e) for k, s, e, top in runs if top >= CERTAIN]


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
SPANS_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()),
]))


def _search(field: Field | None, names: list[str], out: str, column: str, masked: bool):
    def step(batches):
        for batch in batches:
            for part, _, _ in tb.slices(batch, column):
                texts = [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
                base = [base_spans(t) for t in texts]
                more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                if field is not None:
                    g = graph(texts, base)
                    if len(g.label):
                        p = marginals(g, field)
                        first = np.searchsorted(g.document, np.arange(len(texts) + 1))
                        for d in np.unique(g.document):
                            own = slice(first[d], first[d + 1])
                            more[d] = added_spans(texts[d], base[d], g.span[own], p[own])
                found = [
                    [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in sorted([(*x, True) for x in y] + [(*x, False) for x in z])]
                    for y, z in zip(base, more)
                ]
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                if masked:
                    at = names.index(column)
                    whole = columns[at].to_pylist()
                    columns[at] = pa.array([w if w is None else mask(w, f) for w, f in zip(whole, found)], columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, SPANS)], names=[*names, out])

    return step


def mask(text: str, found: list[dict]) -> str:
    """The text with its spans replaced by their kinds; overlapping spans are one, named by the first."""
    parts, at = [], 0
    for f in sorted(found, key=lambda f: (f["start"], -f["end"])):
        if f["start"] >= at:
            parts += [text[at : f["start"]], f"[{KINDS[f['kind']].upper()}]"]
        at = max(at, f["end"])
    return "".join(parts) + text[at:]


def _train_graphs(batches):
    for batch in batches:
        for part, _, _ in tb.slices(batch, "text"):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            g = graph(texts, [base_spans(t) for t in texts])
            first = np.searchsorted(g.document, np.arange(len(texts) + 1))
            link_document = g.document[g.links[:, 0]] if len(g.links) else np.empty(0, np.int64)
            keep = [d for d in range(len(texts)) if 0 < first[d + 1] - first[d] <= TRAIN_TOKENS]
            rows = [
                (
                    g.features[first[d] : first[d + 1]].astype(np.uint8).tobytes(), g.label[first[d] : first[d + 1]].astype(np.uint8).tobytes(),
                    (g.links[link_document == d] - [first[d], first[d], 0]).astype(np.int32).tobytes(),
                )
                for d in keep
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(3)], names=["features", "labels", "links"])


def train(docs: DataFrame, text: str = "text") -> Field | None:
    """A field fitted on base labels; None if no text holds a digit or ``@``."""
    rows = docs.select(F.col(text).alias("text")).where(F.rlike("text", F.lit("[0-9@]")))
    count = rows.count()
    if not count:
        return None
    chosen = F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1_000_000)) < F.lit(TRAIN_DOCS * 1_000_000 // count + 1)
    sample = rows.where(chosen).dropDuplicates(["text"]).mapInArrow(_train_graphs, "features binary, labels binary, links binary")
    found = sample.orderBy("features", "labels", "links").limit(2 * TRAIN_DOCS).collect()
    features, labels, links, at = [], [], [], 0
    for r in found:
        features.append(np.frombuffer(r["features"], np.uint8).reshape(-1, FEATURES))
        labels.append(np.frombuffer(r["labels"], np.uint8))
        links.append(np.frombuffer(r["links"], np.int32).reshape(-1, 3) + [at, at, 0])
        at += len(labels[-1])
    if not at:
        return None
    empty = np.empty(0, np.int64)
    return fit(Graph(empty, empty, np.concatenate(features).astype(np.float64), np.concatenate(links).astype(np.int64), np.concatenate(labels).astype(np.int64)))


def find(docs: DataFrame, field: Field | None, keep: list[str] | None = None, out: str = "personal", text: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) and the spans ``out`` for each row of ``docs``."""
    keep = [c for c in docs.columns if c != out] if keep is None else keep
    carried = list(dict.fromkeys([*keep, text]))
    return docs.select(*carried).mapInArrow(_search(field, keep, out, text, False), T.StructType([*docs.select(*keep).schema, T.StructField(out, SPANS_TYPE)]))


def masked(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data replaced by its kind."""
    out = "personal"
    while out in docs.columns:
        out += "_"
    return docs.mapInArrow(_search(field, docs.columns, out, text, True), T.StructType([*docs.schema, T.StructField(out, SPANS_TYPE)])).drop(out)


def digest(found: DataFrame, key: str = "doc_id", out: str = "personal") -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text."""
    kind = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")

    base = F.filter(out, lambda s: s["base"])

    def count(number: int) -> Column:
        return F.size(F.filter(out, lambda s: s["base"] & (s["kind"] == number))).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(out)).alias("spans"))
