r"""Best-fit packing of tokenized documents with large-item matching.

A document is its token ids and an end id. One longer than a sequence is cut into whole sequences, the
rest standing first; every other piece stays whole. Lengths are few, so the plan is made from the
number of pieces of each length:

1. Pieces above a third of the capacity fit at most twice into a sequence. From the longest down, each
   is matched with the longest piece that still fits.
2. Smaller pieces, from the longest down, go to the tightest gap that takes them.

Sequences with equal gaps are ranges of numbers, so a plan row places a range of pieces of one length
in a range of sequences. The size of the plan depends on the capacity, not on the number of documents;
it is made on the driver and sent to the tasks. Pieces find their place by their length
and their number among the pieces of that length; numbers are dealt in blocks, so a length that most
pieces have is not one task's work.

Null texts count as empty: one piece holding the end id. Rows with equal ids or texts are packed one by
one; other columns are not read; an empty table gives no rows. Very long texts are encoded whole. An
added token's content in a text gets the token's id, as in ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import textbytes as tb
from loomwork.llm.places import numbered
from loomwork.session import materialize

CAPACITY = 1024
END_ID = 2
#: About as many pieces as one task numbers.
PIECES_PER_BLOCK = 20_000
#: Words whose ids a worker keeps, and bytes of text it encodes at a time.
KNOWN_WORDS, SLICE = 600_000, 2 << 20

_SPACES = tb.word_table([0x20, *range(0x09, 0x0E)])
_WORD = ~tb.word_table([0x20])

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts, for byte-level vocabularies that start a token at a space before a word.

    A text is then the join of its words, each with the space before it. Words are told apart by
    64-bit digests; the ids of words seen before are kept, up to ``KNOWN_WORDS`` of them. Texts in
    which a space stands before white space or at the end are encoded whole, as the tokenizer may
    join it with what is around it; so are texts that hold the content of an added token, such as
    ``<|endoftext|>``, which gets its own id wherever it stands, as in the library's plain ``encode``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how the space is written
        # Digests of known words in order, and where each word's ids are in the pool.
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pool, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder, which lives on from task to task."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words with the space before each; many are encoded as one text and parted where a token opens with the space."""
        out: list[np.ndarray] = []
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            if all(w and not w[0].isspace() for w in part):
                text = " " + " ".join(part)
                ids = self.whole([text])[0]
                cuts = np.flatnonzero(self.opens[ids])
                if len(cuts) == len(part) and cuts[0] == 0 and not any(t in text for t in self.added):
                    out += np.split(ids, cuts[1:])
                    continue
            out += self.whole([" " + w for w in part])
        return out

    def _joined(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts with a space before white space or at their end."""
        space = np.flatnonzero(data == 0x20)
        padded = np.concatenate([data, np.full(3, 0x20, np.uint8)])
        one, two, three = (padded[space + i] for i in (1, 2, 3))
        wide = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) | (one == 0xE3) & (two == 0x80)
        wide |= (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three >= 0xA8) & (three <= 0xAF)) | (two == 0x81) & (three == 0x9F))
        at_end = np.zeros(len(data) + 1, np.bool_)
        at_end[offs[1:]] = True
        bad = space[_SPACES[one] | wide | at_end[space + 1]]
        return np.unique(np.searchsorted(offs, bad, "right") - 1)

    def _holding_added(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        """Texts with the content of an added token; one that runs on into the next text does no harm."""
        found = []
        for token in self.added:
            at = raw.find(token.encode())
            while at >= 0:
                found.append(at)
                at = raw.find(token.encode(), at + 1)
        return np.unique(np.searchsorted(offs, np.array(found, np.int64), "right") - 1)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Token ids of each text."""
        starts, ends, before = tb.words(data, offs, _WORD)
        spaced = np.ones(len(starts), np.bool_)
        spaced[before[:-1][np.diff(before) > 0]] = False
        heads = starts[~spaced]
        spaced[~spaced] = heads > offs[np.searchsorted(offs, heads, "right") - 1]
        digest = tb.range_digests(data, starts, ends)
        unique, sample, word = np.unique(np.where(spaced, digest, ~digest), return_index=True, return_inverse=True)
        slot = np.full(len(unique), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            known = self.keys[at] == unique
            slot[known] = self.slots[at[known]]
        missing = np.flatnonzero(slot < 0)
        raw = data.tobytes()
        missing = np.concatenate([missing[~spaced[sample[missing]]], missing[spaced[sample[missing]]]])
        texts = [raw[starts[i] : ends[i]].decode() for i in sample[missing]]
        first_words = int((~spaced[sample[missing]]).sum())
        fresh = self.whole(texts[:first_words]) + self.words(texts[first_words:])
        sizes = np.array([len(x) for x in fresh], np.int64)
        pool = np.concatenate([self.pool, *fresh])
        first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
        size = np.concatenate([self.size, sizes])
        slot[missing] = len(self.size) + np.arange(len(missing))
        if len(size) <= KNOWN_WORDS:
            keys = np.concatenate([self.keys, unique[missing]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], np.concatenate([self.slots, slot[missing]])[order]
            self.pool, self.first, self.size = pool, first, size
        slot = slot[word]
        length = size[slot]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = pool[np.repeat(first[slot] - upto[:-1], length) + np.arange(upto[-1])]
        out = [ids[a:b] for a, b in zip(upto[before[:-1]], upto[before[1:]])]
        rest = np.union1d(self._joined(data, offs), self._holding_added(raw, offs))
        for t, found in zip(rest, self.whole([raw[offs[t] : offs[t + 1]].decode() for t in rest])):
            out[t] = found
        return out


def _pieces(path: str, capacity: int):
    def step(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            for part, data, offs in tb.slices(batch, "text", SLICE):
                row, piece, start, length, crc = [], [], [], [], []
                for r, ids in enumerate(encoder.encode(data, offs)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                    total = len(ids)
                    cuts = [0, *range(total % capacity or capacity, total + 1, capacity)] if total > capacity else [0, total]
                    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        row.append(r)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b]))
                keys = part.column(part.schema.get_field_index("doc_id")).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return step


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first piece, last piece plus one, first sequence, pieces per sequence, offset), sorted."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    total = list(left)
    rows: list[tuple[int, ...]] = []
    gaps: list[tuple[int, int, int]] = []  # gap, first sequence, sequences
    used = 0

    def put(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        first = total[length] - left[length]
        rows.append((length, first, first + n, sequence, per, offset))
        left[length] -= n

    def free(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            insort(gaps, (gap, sequence, n))

    large = capacity // 3 + 1
    for a in range(capacity, large - 1, -1):
        while left[a]:
            fits = (b for b in range(min(a, capacity - a), large - 1, -1) if left[b] > (b == a))
            b = next(fits, None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, used, 1, 0)
            if b is not None:
                put(b, n, used, 1, a)
            free(capacity - a - (b or 0), used, n)
            used += n
    for s in range(min(large - 1, capacity), 0, -1):
        while left[s]:
            at = bisect_left(gaps, (s, -1, -1))
            if at < len(gaps):
                gap, sequence, n = gaps.pop(at)
            else:
                gap, sequence, n = capacity, used, -(-left[s] // (capacity // s))
                used += n
            per = gap // s
            full = min(n, left[s] // per)
            if full:
                put(s, full * per, sequence, per, capacity - gap)
                free(gap - per * s, sequence, full)
            rest = left[s] if full < n and left[s] < per else 0
            if rest:
                put(s, rest, sequence + full, rest, capacity - gap)
                free(gap - rest * s, sequence + full, 1)
            free(gap, sequence + full + bool(rest), n - full - bool(rest))
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _place(rows: np.ndarray):
    """Map step: each piece's sequence and its offset there."""
    keys = rows[:, 0] << 48 | rows[:, 1]

    def step(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number = batch.column(batch.schema.get_field_index("number")).to_numpy()
            row = rows[np.searchsorted(keys, length << 48 | number, "right") - 1]
            within = number - row[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            sequence, offset = row[:, 3] + within // row[:, 4], row[:, 5] + within % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return step


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity), schema).withColumn("turn", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    blocks = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // PIECES_PER_BLOCK))) for n in range(1, capacity + 1)])
    known = numbered(pieces, "length", "turn", F.element_at(blocks, F.col("length").cast("int")), "number")
    if not counts:
        return known.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.col("number").alias("offset"))
    return known.mapInArrow(_place(plan(counts, capacity)), f"{schema}, sequence_id long, offset long").withColumnRenamed("doc_id", key)
