r"""Benchmark decontamination with suffix arrays over the training texts.

Each task cuts its rows into shards of bounded size and builds one suffix array over the words of a
shard. Every suffix of a benchmark text is searched in it by bisection, which gives all places that
begin with its first words; each place is then followed word by word to the longest verbatim match.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, so a word is a run of digits,
letters a-z and bytes above 127. Words are compared by 64-bit digests. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window. A word inside any
occurrence of a window is hit.

The job has no shuffle: rows go through one map step for each block of the benchmark, which is
cut into blocks of bounded bytes because its suffixes are sent to all tasks. Null texts and items
have no words; items without id mark words but are not listed; items that share an id are one item;
an empty benchmark marks nothing; a text is never split, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import textbytes as tb

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text whose suffixes one map step carries; an item is not split.
BLOCK_BYTES = 8 << 20

WORD = tb.word_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass
class Block:
    """The suffixes of some items, ready to be searched for."""

    vocabulary: np.ndarray  # sorted digests of all words
    words: np.ndarray  # numbers of the words, item after item, each followed by the number of no word
    suffix: np.ndarray  # where each suffix begins in words
    need: np.ndarray  # how many words it must match
    item: np.ndarray  # row of ids for each suffix
    ids: list


def word_numbers(data: np.ndarray, offs: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers text after text, each text followed by the number of no word; places; words before each text; vocabulary."""
    data = tb.LOWER[data]
    starts, ends, before = tb.words(data, offs, WORD)
    digests = tb.range_digests(data, starts, ends)
    if vocabulary is None:
        vocabulary = np.unique(digests)
    none = len(vocabulary)
    number = np.searchsorted(vocabulary, digests)
    if none:
        number[vocabulary[np.minimum(number, none - 1)] != digests] = none
    texts = len(offs) - 1
    place = np.arange(len(digests)) + np.repeat(np.arange(texts), np.diff(before))
    out = np.full(len(digests) + texts, none, np.int64)
    out[place] = number
    return out, place, before, vocabulary


def prepare(rows: list[tuple], window: int = WINDOW) -> Block | None:
    """The block of (item id, text) rows; None if they have no word."""
    data, offs = tb.text_bytes(pa.array([text for _, text in rows], pa.string()))
    words, _, before, vocabulary = word_numbers(data, offs, None)
    counts = np.diff(before)
    if not counts.sum():
        return None
    need = np.minimum(counts, window)
    per = np.where(counts > 0, counts - need + 1, 0)
    item = np.repeat(np.arange(len(rows)), per)
    first = before[:-1] + np.arange(len(rows))
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return Block(vocabulary, words, first[item] + within, need[item], item, [i for i, _ in rows])


class SuffixArray:
    """The suffixes of a shard whose first word is in the vocabulary, in the order of their first words.

    Several words are packed into one number, so the order by ``depth`` words needs few keys.
    """

    def __init__(self, words: np.ndarray, none: int, depth: int):
        self.words, self.none = words, none
        self.bits = max(1, int(none).bit_length())
        self.per = max(1, 62 // self.bits)
        self.levels = -(-depth // self.per)
        padded = np.concatenate([words, np.full(self.levels * self.per, none, np.int64)])
        n = len(words) + (self.levels - 1) * self.per
        self.key = np.zeros(n, np.int64)
        for i in range(self.per):
            self.key = self.key << self.bits | padded[i : i + n]
        self.order = np.flatnonzero(words != none)
        head = self.key[self.order]
        turn = np.argsort(head)
        self.order, self.head = self.order[turn], head[turn]
        if self.levels > 1 and len(self.order) > 1:
            same = self.head[1:] == self.head[:-1]
            tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
            at = self.order[tied]
            later = [self.key[at + k * self.per] for k in range(self.levels - 1, 0, -1)]
            self.order[tied] = at[np.lexsort([*later, self.head[tied]])]

    def bounds(self, keys: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the order, by bisection, of the suffixes between two keys on each level."""
        low, high = keys[0]
        lo, hi = np.searchsorted(self.head, low, "left"), np.searchsorted(self.head, high, "right")
        for level in range(1, self.levels):
            low, high = keys[level]
            for is_high, wanted in ((False, low), (True, high)):
                a, b = lo.copy(), hi.copy()
                active = np.flatnonzero(a < b)
                while len(active):
                    mid = (a[active] + b[active]) >> 1
                    found = self.key[self.order[mid] + level * self.per]
                    right = found <= wanted[active] if is_high else found < wanted[active]
                    a[active[right]] = mid[right] + 1
                    b[active[~right]] = mid[~right]
                    active = active[a[active] < b[active]]
                if is_high:
                    hi = a
                else:
                    start = a
            lo = np.minimum(start, hi)
        return lo, hi


def windows_of(block: Block, array: SuffixArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each suffix the least and the greatest keys that its needed words allow, level by level."""
    out = []
    for level in range(array.levels):
        low = np.zeros(len(block.suffix), np.int64)
        high = low.copy()
        for i in range(level * array.per, (level + 1) * array.per):
            inside = i < block.need
            word = block.words[np.minimum(block.suffix + i, len(block.words) - 1)]
            low = low << array.bits | np.where(inside, word, 0)
            high = high << array.bits | np.where(inside, word, (1 << array.bits) - 1)
        out.append((low, high))
    return out


def longest(block: Block, words: np.ndarray, suffix: np.ndarray, place: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many words match from each place on, at least ``least``."""
    none, length, active = len(block.vocabulary), least.copy(), np.arange(len(place))
    while len(active):
        a, b = suffix[active] + length[active], place[active] + length[active]
        ok = (a < len(block.words)) & (b < len(words))
        active, a, b = active[ok], a[ok], b[ok]
        same = (block.words[a] == words[b]) & (words[b] != none)
        active = active[same]
        length[active] += 1
    return length


OUT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("longest", T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("item_id", T.LongType()),
        T.StructField("item_word", T.LongType()), T.StructField("word", T.LongType()),
    ])),
])


def search(block: Block, data: np.ndarray, offs: np.ndarray, earlier: list[dict]) -> list[dict]:
    """What a shard's texts share with the block, added to what earlier blocks found."""
    words, place, before, _ = word_numbers(data, offs, block.vocabulary)
    texts = len(offs) - 1
    counts = np.diff(before)
    first = before[:-1] + np.arange(texts)
    array = SuffixArray(words, len(block.vocabulary), int(block.need.max()))
    lo, hi = array.bounds(windows_of(block, array))
    found = np.flatnonzero(lo < hi)
    number = (hi - lo)[found]
    which = np.repeat(found, number)
    spot = array.order[np.repeat(lo[found], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)]
    text = np.searchsorted(first, spot, "right") - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, spot, 1)
    np.add.at(change, spot + block.need[which], -1)
    for t, old in enumerate(earlier):
        for a, b in zip(old["hits"][::2], old["hits"][1::2]):
            change[first[t] + a] += 1
            change[first[t] + b] -= 1
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    begins, ends = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    run_text = np.searchsorted(first, begins, "right") - 1
    runs = np.stack([begins - first[run_text], ends - first[run_text]], 1) if len(begins) else np.empty((0, 2), np.int64)
    run_at = np.searchsorted(run_text, np.arange(texts + 1))
    pairs = np.unique(np.stack([text, block.item[which]], 1), axis=0) if len(text) else np.empty((0, 2), np.int64)
    pair_at = np.searchsorted(pairs[:, 0], np.arange(texts + 1))
    length = longest(block, words, block.suffix[which], spot, block.need[which])
    best: dict[int, int] = {}
    for k in np.lexsort((block.item[which], spot, -length, text)):
        best.setdefault(int(text[k]), int(k))
    item_first = np.flatnonzero(np.concatenate([[True], block.words[:-1] == len(block.vocabulary)]))
    out = []
    for t, old in enumerate(earlier):
        items = [block.ids[i] for i in pairs[pair_at[t] : pair_at[t + 1], 1]]
        top = old["longest"]
        if (k := best.get(t)) is not None and (top is None or length[k] > top["n_words"]):
            start = int(block.suffix[which[k]])
            top = {
                "n_words": int(length[k]), "item_id": block.ids[block.item[which[k]]],
                "item_word": start - int(item_first[block.item[which[k]]]), "word": int(spot[k] - first[t]),
            }
        out.append({
            "n_words": int(counts[t]), "hits": runs[run_at[t] : run_at[t + 1]].ravel().tolist(),
            "items": sorted({*old["items"], *(i for i in items if i is not None)}), "longest": top,
        })
    return out


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark as blocks of about ``block_bytes``, one after the other; only one is on the driver."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    number = max(1, -(-size // block_bytes))
    rows = benchmark.select(F.col(item).cast("long"), F.col(text)).where(F.col(text).isNotNull())
    for i in range(number):
        part = rows.where(F.pmod(F.xxhash64(item, text), F.lit(number)) == i) if number > 1 else rows
        block = prepare([tuple(r) for r in part.collect()], window)
        if block is not None:
            yield block


def mark(
    docs: DataFrame, benchmark: DataFrame, out: str = "contamination", keep: list[str] | None = None, text: str = "text",
    item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` (all by default) and a struct ``out`` for each row of ``docs``.

    ``n_words``: words of the text; ``hits``: first and last-plus-one word of each maximal run of hit
    words, one after the other; ``items``: ids of items with a window in the text; ``longest``: the
    longest verbatim match with an item (null without one) and where it stands in both.
    """
    keep = [c for c in docs.columns if c != out] if keep is None else keep
    carried = list(dict.fromkeys([*keep, text]))
    frame = docs.select(*carried)
    types = {f.name: f for f in frame.schema.fields}
    steps = list(blocks_of(benchmark, item, item_text, window, block_bytes)) or [None]
    for number, block in enumerate(steps):
        last = number == len(steps) - 1
        names = keep if last else carried
        schema = T.StructType([*(types[c] for c in names), T.StructField(out, OUT)])

        def step(batches, block=block, first=number == 0, names=names):
            for batch in batches:
                for part, data, offs in tb.slices(batch, text, SHARD_BYTES):
                    if first:
                        earlier = [{"n_words": 0, "hits": [], "items": [], "longest": None}] * part.num_rows
                    else:
                        earlier = part.column(part.schema.get_field_index(out)).to_pylist()
                    if block is None:
                        _, _, before = tb.words(tb.LOWER[data], offs, WORD)
                        found = [{**e, "n_words": int(n)} for e, n in zip(earlier, np.diff(before))]
                    else:
                        found = search(block, data, offs, earlier)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(found, ARROW_OUT)], names=[*names, out]
                    )

        frame = frame.mapInArrow(step, schema)
    return frame


ARROW_OUT = pa.struct([
    ("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.int64())),
    ("longest", pa.struct([(n, pa.int64()) for n in ("n_words", "item_id", "item_word", "word")])),
])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any hit word, with their own columns."""
    out = "contamination"
    while out in docs.columns:
        out += "_"
    marked = mark(docs, benchmark, out, text=text, **options)
    return marked.where(F.size(F.col(out)["hits"]) == 0).drop(out)


def digest(marked: DataFrame, key: str = "doc_id", out: str = "contamination") -> DataFrame:
    """Counts of words, hit words and items, and a digest of the items."""
    c = F.col(out)
    hit = F.aggregate(c["hits"], F.struct(F.lit(-1).cast("long").alias("sign"), F.lit(0).cast("long").alias("sum")), lambda s, x: F.struct((-s["sign"]).alias("sign"), (s["sum"] + s["sign"] * x).alias("sum")), lambda s: s["sum"])
    names = F.array_sort(F.transform(c["items"], lambda i: i.cast("string")))
    return marked.select(
        key, c["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
