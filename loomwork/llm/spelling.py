r"""Spelling variants: words that differ by one code point, and the frequent form that each leads to.

``count_words`` takes maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z in lower case;
``variants`` compares the words.

Comparison is a composition of finite-state machines: the minimised acceptor of the vocabulary, a
transducer that makes one edit, and the acceptor again. It is cut by the states the composition
starts from. Of two words one edit apart, at least half of the shorter one stands before or after the
edit. So a word goes to four partitions: for both lengths its partner may have on the longer side, the
words with the same first half, and those with the same second half. A partition is the part of the
composition that starts in the state which the shared half leads to; what it accepts is
enumerated from the remainders alone. The edit is always read at the first code point that differs, and
partitions with a shared end do not accept it where that end begins, so each pair is found once.

A partition above ``GROUP`` words is cut again in the same way, the shared part growing by half of what is
left. When one code point is left, the alphabet bounds it at some 8,000 words. So no partition grows
with the vocabulary, whatever words share.

Null texts and texts without letters have no words; a null key counts as an empty one; rows that
repeat count as often as they occur; very long runs are words like others; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import textbytes as tb
from loomwork.session import materialize

#: Least length of a word and least number of occurrences.
LENGTH, OCCURRENCES = 7, 2
#: How many times as frequent a form must be.
RATIO = 10
#: Words that one partition holds before it is cut again, and different words a task counts before it passes them on.
GROUP, COUNTED = 20_000, 200_000

_KEY = ["m", "pre", "suf", "head", "tail"]
_LETTERS = tb.word_table([*range(65, 91), *range(97, 123), 0xC3])
_ONE = tb.word_table([1])


# ---- words


def _runs(least: int, drop: int | None):
    """Map step: words of at least ``least`` code points and their numbers in a part of the texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for rows, data, offs in tb.slices(batch, "text"):
                low = tb.LOWER[data]
                lead = data == 0xC3  # opens U+00C0 to U+00FF, each two bytes
                inside = _LETTERS[data]
                inside[1:] |= lead[:-1]
                starts, ends, before = tb.words(inside.astype(np.uint8), offs, _ONE)
                leads = np.concatenate([[0], np.cumsum(lead)])
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(before))
                long = ends - starts - (leads[ends] - leads[starts]) >= least
                starts, ends, doc = starts[long], ends[long], doc[long]
                digest = tb.range_digests(low, starts, ends)
                own = tb.mix(digest ^ tb.mix((doc + 1).astype(np.uint64))) if drop else digest
                _, sample, n = np.unique(own, return_index=True, return_counts=True)
                raw, n = low.tobytes(), n.tolist()
                found = [raw[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
                if not drop:
                    for said, k in zip(found, n):
                        total[said.decode()] += k
                else:
                    opened = [zlib.crc32(f"{key or ''}:".encode()) for key in rows.column(0).to_pylist()]
                    for said, k, d in zip(found, n, doc[sample].tolist()):
                        h, word = zlib.crc32(said, opened[d]), said.decode()
                        if h % drop == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += k
                if len(total) > COUNTED:
                    yield passed()
                    total.clear()
        yield passed()

    return step


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LENGTH, occurrences: int = OCCURRENCES, drop: int | None = None) -> DataFrame:
    """word and n, for words of ``least`` code points and ``occurrences``.

    With ``drop``, one run in ``drop`` of them loses a code point: where the crc32 h of ``<key>:<run>`` is a
    multiple of it, number h modulo the run's length.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    parts = rows.mapInArrow(_runs(least, drop), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# ---- composition


class Acceptors:
    """Minimised acceptors of sets of words of one length each; states with equal right languages are one state."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]  # state 0 accepts
        self.known: dict[tuple, int] = {(): 0}

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())  # words come in order, so do the arcs
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return found

    def build(self, words: list[str]) -> int | None:
        """The initial state for sorted distinct words of one length; None without words."""
        if not words:
            return None
        open_: list[dict[str, int]] = [{} for _ in range(len(words[0]) + 1)]
        last = words[0]
        for word in [*words[1:], None]:
            same = 0
            if word is not None:
                while word[same] == last[same]:
                    same += 1
            for depth in range(len(last), same if word is not None else 0, -1):
                open_[depth - 1][last[depth - 1]] = self._state(open_[depth])
                open_[depth] = {}
            last = word
        return self._state(open_[0])

    def common(self, p: int, q: int) -> list[str]:
        """What is accepted from both states."""
        out, stack = [], [(p, q, None)]
        while stack:
            p, q, said = stack.pop()
            if p == q == 0:
                out.append(_spelled(said))
                continue
            mine, other = self.arcs[p], self.arcs[q]
            for label in mine if p == q else mine.keys() & other.keys():
                stack.append((mine[label], other[label], (said, label)))
        return out


def _spelled(said: tuple | None) -> str:
    out = []
    while said is not None:
        said, label = said
        out.append(label)
    return "".join(reversed(out))


def _compose(machine: Acceptors, p: int, q: int, replace: bool, at_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs that acceptor ``p``, one edit and acceptor ``q`` accept; an insertion behind all of ``p`` only ``at_end``.

    Before the edit both read the same labels. A replacement reads different ones (``p`` is ``q``, each pair
    once); an insertion reads one more label in ``q``, other than the next of ``p``.
    """
    edits: dict[tuple[int, int], list[tuple[str, str, str]]] = {}

    def edited(p: int, q: int) -> list[tuple[str, str, str]]:
        if (p, q) not in edits:
            mine, other, found = machine.arcs[p], machine.arcs[q], []
            if replace:
                labels = list(mine)
                for i, x in enumerate(labels):
                    for y in labels[i + 1 :]:
                        found += [(x, y, tail) for tail in machine.common(mine[x], mine[y])]
            else:
                for y, after in other.items():
                    found += [("", y, tail) for tail in machine.common(p, after) if not tail.startswith(y)]
            edits[p, q] = found
        return edits[p, q]

    stack: list[tuple[int, int, tuple | None]] = [(p, q, None)]
    while stack:
        p, q, said = stack.pop()
        if p == 0 and not at_end:
            continue
        found = edited(p, q)
        if found:
            head = _spelled(said)
            for x, y, tail in found:
                yield head + x + tail, head + y + tail
        mine, other = machine.arcs[p], machine.arcs[q]
        for label in mine if p == q else mine.keys() & other.keys():
            stack.append((mine[label], other[label], (said, label)))


def pairs_of(words: list[str], m: int, pre: int = 0, suf: int = 0) -> list[tuple[str, str]]:
    """Pairs one edit apart among words of ``m`` and ``m + 1`` code points, the shorter first or both of ``m``.

    All words share their first ``pre`` and last ``suf`` code points; with a shared end, the first difference is before it.
    """
    middles: dict[int, list[str]] = {m: [], m + 1: []}
    for word in words:
        middles[len(word)].append(word[pre : len(word) - suf])
    machine = Acceptors()
    short, long = (machine.build(sorted(middles[k])) for k in (m, m + 1))
    head, tail = words[0][:pre], words[0][len(words[0]) - suf :]
    found: list[tuple[str, str]] = []
    for first, second, replace in ((short, short, True), (short, long, False)):
        if first is not None and second is not None:
            found += [(head + a + tail, head + b + tail) for a, b in _compose(machine, first, second, replace, suf == 0)]
    return found


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map step on rows sorted by partition: both directions of the pairs of each; holds one partition at a time."""
    near: list[list] = [[], [], []]

    def passed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(near, (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])
        for column in near:
            column.clear()
        return out

    def compare(key: tuple, count: dict[str, int]) -> None:
        for a, b in pairs_of(list(count), *key[:3]):
            near[0].extend((a, b))
            near[1].extend((b, a))
            near[2].extend((count[b], count[a]))

    key: tuple = ()
    held: dict[str, int] = {}
    for batch in batches:
        for word, n, *own in zip(*(c.to_pylist() for c in batch.columns)):
            own = (*own, word[: own[1]], word[len(word) - own[2] :])
            if own != key:
                if len(held) > 1:
                    compare(key, held)
                key, held = own, {}
            held[word] = n
            if len(near[0]) > COUNTED:
                yield passed()
    if len(held) > 1:
        compare(key, held)
    yield passed()


def _cut(rows: DataFrame) -> DataFrame:
    """Each row of a partition in the two partitions it is cut into: half of what is not shared yet becomes shared, in front or behind."""
    rest = F.col("m") - F.col("pre") - F.col("suf")
    half = F.floor(rest / 2).cast("int")
    front = F.struct((F.col("pre") + half).alias("pre"), F.col("suf").alias("suf"))
    behind = F.struct(F.col("pre").alias("pre"), (F.col("suf") + rest - half).alias("suf"))
    parts = rows.withColumn("part", F.explode(F.array(front, behind))).select("word", "n", "m", "part.*")
    head = F.substring("word", F.lit(1), F.col("pre"))
    return parts.select("word", "n", "m", "pre", "suf", head.alias("head"), F.right("word", F.col("suf")).alias("tail"))


def _partitions(vocabulary: DataFrame, group: int) -> DataFrame:
    """The words of a stored table in their partitions, none of which holds more than ``group`` unless the alphabet bounds it."""
    size = F.length("word")
    whole = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"), F.lit(0).alias("pre"), F.lit(0).alias("suf"))
    rows, done = materialize(_cut(whole.where("m > 0")), "spelling-parts"), []
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("held"))
        large = materialize(sizes.where((F.col("held") > group) & (F.col("m") - F.col("pre") - F.col("suf") > 1)).drop("held"), "spelling-large")
        if not large.limit(1).count():
            done.append(rows)
            break
        done.append(rows.join(large, _KEY, "left_anti"))
        rows = materialize(_cut(rows.join(large, _KEY, "left_semi")), "spelling-parts")
    kept = done[0]
    for more in done[1:]:
        kept = kept.unionByName(more)
    return kept


def near_pairs(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """word, near and near_n: all pairs of words one edit apart, in both directions, from a stored table of word and n."""
    dealt = _partitions(vocabulary, group).repartition(*_KEY).sortWithinPartitions(*_KEY).select("word", "n", "m", "pre", "suf")
    return dealt.mapInArrow(_pairs, "word string, near string, near_n long")


# ---- forms


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that forms (word, form) lead to. A form is more frequent by a factor, so chains are short."""
    jump = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(jump.join(onward, "root", "left").select("word", "root", "next"), "spelling-roots")
        jump = moved.select("word", F.coalesce("next", "root").alias("root"))
        if not moved.where("next is not null").limit(1).count():
            return jump


def variants(vocabulary: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table of distinct words and their numbers (word, n).

    A word's form is its most frequent near word (ties: least in code-point order), if that is at least
    ``ratio`` times as frequent; its root is where forms end.
    """
    words = materialize(vocabulary.select("word", "n"), "spelling-words")
    best = near_pairs(words, group).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    formed = -F.col("best.less") >= ratio * F.col("n")
    told = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    told = materialize(told, "spelling-forms")
    roots = _roots(told.where("form is not null"))
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
