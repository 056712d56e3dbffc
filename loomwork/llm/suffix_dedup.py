"""Removal of repeated passages with a sparse enhanced suffix array and its interval tree.

Every byte covered by a string of ``least`` bytes that also starts in a document with a smaller id is
found, over all documents.

1. Each string of ``least`` bytes is anchored at one of its 16-byte grams: the one with the least
   digest, the leftmost of equals. Equal strings have equal anchors, and about one position in 18
   is an anchor. Anchors that occur in one document only cannot lie in a repeat.
2. The suffixes that begin at the other anchors are dealt to buckets by the anchor. A suffix carries
   the bytes right of the anchor that a string with this anchor can hold, and those left of it.
   An anchor with more than ``HEAVY`` occurrences sends no suffixes: the complete strings that hold it
   are dealt by their own digests, so only equal strings meet.
3. A bucket is sorted to a suffix array. Its common-prefix lengths are scanned with a stack, which
   lists all intervals (the nodes of the interval tree) with all their occurrences, the least
   document among them and their common left extension. Where an interval is deep enough to make
   up a string together with the left extension its members share, it is a repeat of all its
   occurrences; where its left extensions differ, its members are parted by them.

The texts are stored once, as compressed slices of some megabytes; only slices are joined with what was
found for them. Buckets hold packed arrays. Equal entries are combined within a slice before any
shuffle: an anchor, or a suffix with all its bytes, that thousands of documents share is sent once a
slice, for the first of its documents, as that answers the others.

Null texts are empty; rows with a null id neither lose bytes nor count as earlier ones; rows with the
same id have no order among them and lose nothing to each other; texts shorter than ``least`` stay
whole; an empty table gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import textbytes as tb
from loomwork.llm.groups import grouped
from loomwork.session import materialize

LEAST = 50
GRAM = 16
SLICE = 4 << 20
PART = 1 << 20
#: About as many anchors as a bucket of anchors holds, and as a bucket of suffixes would hold if all were shared.
ANCHORS_PER_BUCKET = 1_000_000
ANCHORS_PER_SUFFIX_BUCKET = 250_000
#: Occurrences above which an anchor is dealt by strings, and parts in which a bucket's strings are compared.
HEAVY = 100_000
PARTS = 8
#: A run of starts of one string within a text: two digests of the string, the document, the row, the first and the last byte plus one.
STRING = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("first", "<i4"), ("end", "<i4")])

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def parts_of(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``PART`` bytes, so that what is computed per byte stays small."""
    row = 0
    while row < len(offs) - 1:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + PART, "right")) - 1)
        yield row, end
        row = end


def anchors(data: np.ndarray, offs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, digests and texts of the anchors of all strings of ``least`` bytes within one text."""
    found = [_anchors(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], least) for a, b in parts_of(offs)]
    if not found:
        return _anchors(data, offs, least)
    shift = [(offs[a], a) for a, _ in parts_of(offs)]
    return (
        np.concatenate([p + at for (p, _, _), (at, _) in zip(found, shift)]), np.concatenate([d for _, d, _ in found]),
        np.concatenate([t + row for (_, _, t), (_, row) in zip(found, shift)]),
    )


def _anchors(data: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, window = len(data), least - GRAM + 1
    lengths = np.diff(offs)
    if n < least or lengths.max(initial=0) < least:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = data.astype(np.uint64)
    for size in (1, 2, 4):
        word = word[:-size] | word[size:] << np.uint64(8 * size)
    digest = tb.mix(word[: n - GRAM + 1] * _C1 + word[8 : 8 + n - GRAM + 1] * _C2)
    low = np.uint64((1 << int(n).bit_length()) - 1)
    best = digest & ~low | np.arange(len(digest), dtype=np.uint64)
    step = 1
    while step * 2 <= window:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < window:
        best = np.minimum(best[: len(best) - (window - step)], best[window - step :])
    inside = np.ones(len(best), np.bool_)
    for end in offs[1:-1]:
        inside[max(0, end - least + 1) : end] = False
    mark = np.zeros(n, np.bool_)
    mark[(best[inside] & low).astype(np.int64)] = True
    place = np.flatnonzero(mark)
    return place, digest[place], np.searchsorted(offs, place, "right") - 1


def gram_digest(around: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The digest of the anchor that stands amid the bytes around each suffix."""
    side = least - GRAM
    gram = np.ascontiguousarray(around[:, side : side + GRAM]).view("<u8").astype(np.uint64)
    return tb.mix(gram[:, 0] * _C1 + gram[:, 1] * _C2)


def _packed(bucket: np.ndarray, slice_: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket with the slice and its entries as compressed arrays."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    arrays = [pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array(np.full(len(cuts) - 1, slice_, np.int64))]
    for values in columns.values():
        values = values[order]
        arrays.append(pa.array([_shrink(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "slice", *columns])


def _shrink(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _grow(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def _unpacked(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([_grow(v, dtype) for v in table.column(name).to_pylist()])


def _store(batches):
    """Map step: slices with the ids, whether they are known, the offsets and the bytes of their texts."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part, data, offs in tb.slices(batch, "text", SLICE):
            ids = part.column(part.schema.get_field_index("doc_id"))
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            row = [number, _shrink(ids), _shrink(known), _shrink(offs), zstandard.ZstdCompressor(level=6).compress(data.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["slice", "ids", "known", "offs", "text"])
            number += 1


def _slices(batches):
    """(slice, ids, known, offs, bytes, the row's further columns) one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            yield row["slice"], _grow(row["ids"], np.int64), _grow(row["known"], np.bool_), _grow(row["offs"], np.int64), _grow(row["text"], np.uint8), row


@dataclass(frozen=True)
class Short:
    """Digests cut to what tells anchors apart at this size; a rare clash only keeps an anchor that could go."""

    buckets: int
    bits: int

    def of(self, digest: np.ndarray) -> np.ndarray:
        return digest % np.uint64(min(self.buckets << self.bits, (1 << 64) - 1))

    def bytes(self) -> str:
        return "<u4" if self.bits <= 32 else "<u8"


def _slice_anchors(data, offs, known, ids, least):
    """Anchors of texts with known ids, and which of them at least two documents of the slice have."""
    place, digest, text = anchors(data, offs, least)
    keep = known[text]
    place, digest, text = place[keep], digest[keep], text[keep]
    unique, number = np.unique(digest, return_inverse=True)
    low, high = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
    np.minimum.at(low, number, ids[text])
    np.maximum.at(high, number, ids[text])
    return place, digest, text, unique, low != high, number


def _send_anchors(short: Short, least: int):
    """Map step: the distinct anchors of a slice, with a flag for those that it knows to be shared.

    Above the flag's bit stands the power of two that their occurrences in the slice do not exceed.
    """

    def step(batches):
        for slice_, ids, known, offs, data, _ in _slices(batches):
            _, _, _, unique, shared, number = _slice_anchors(data, offs, known, ids, least)
            if len(unique):
                key = short.of(unique)
                bucket = key % np.uint64(short.buckets)
                power = np.ceil(np.log2(np.bincount(number))).astype(np.uint8)
                yield _packed(bucket, slice_, {"keys": (key // np.uint64(short.buckets)).astype(short.bytes()), "flags": shared | power << 1})

    return step


def _shared_anchors(short: Short, heavy: int):
    """Reduce step: for each slice, its anchors that other slices have as well, and its heavy ones."""

    def step(batches):
        for table in grouped(batches, ["bucket"]):
            keys = [_grow(v, short.bytes()) for v in table.column("keys").to_pylist()]
            flag = _unpacked(table, "flags", np.uint8)
            most, flag = np.exp2((flag >> 1).astype(np.float64)), flag & 1
            _, number = np.unique(np.concatenate(keys), return_inverse=True)
            among = (np.bincount(number) > 1) | (np.bincount(number, flag) > 0)
            split = (among & (np.bincount(number, most) > heavy))[number]
            shared = among[number] & (flag == 0)
            bucket, at = np.uint64(table.column("bucket")[0].as_py()), 0
            slices_, found, hot = [], [], []
            for slice_, key in zip(table.column("slice").to_pylist(), keys):
                pick, much = (key[x[at : at + len(key)]].astype(np.uint64) * np.uint64(short.buckets) + bucket for x in (shared, split))
                at += len(key)
                if len(pick) or len(much):
                    slices_.append(slice_)
                    found.append(pick.tobytes())
                    hot.append(much.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slices_, pa.int64()), pa.array(found, pa.binary()), pa.array(hot, pa.binary())], names=["slice", "anchors", "heavy"]
            )

    return step


def _strings(data: np.ndarray, offs: np.ndarray, ids: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings at the given places that no earlier document of the slice has, and the spans of the others."""
    if not len(start):
        return np.empty(0, STRING), np.empty((0, 3), np.int32)
    text = np.searchsorted(offs, start, "right") - 1
    out, first = np.empty(len(start), STRING), np.searchsorted(text, np.arange(len(offs)))
    for a, b in parts_of(offs):
        s, at = slice(first[a], first[b]), start[first[a] : first[b]] - offs[a]
        part = data[offs[a] : offs[b]]
        out["one"][s] = tb.range_digests(part, at, at + least)
        out["two"][s] = tb.range_digests(part, at, at + GRAM) * _C2 + tb.range_digests(part, at + GRAM, at + least)
    out["doc"], out["row"], out["first"] = ids[text], text, start - offs[text]
    out["end"] = out["first"] + least
    out = out[np.lexsort((out["first"], out["row"], out["doc"], out["two"], out["one"]))]
    same = (out["one"][1:] == out["one"][:-1]) & (out["two"][1:] == out["two"][:-1])
    new = np.concatenate([[True], ~same])
    later = out["doc"] > out["doc"][np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))]
    spans = np.stack([out["row"], out["first"], out["end"]], 1)[later]
    run = np.concatenate([[True], ~(same & (out["row"][1:] == out["row"][:-1]) & (out["first"][1:] <= out["end"][:-1]))])
    end = out["end"][np.append(np.flatnonzero(run)[1:], len(out)) - 1]
    later, out = later[run], out[run]
    out["end"] = end
    return out[~later], spans


def _repeated(strings: np.ndarray) -> np.ndarray:
    """Which strings an earlier document has."""
    order = np.lexsort((strings["doc"], strings["two"], strings["one"]))
    one, two, doc = (strings[n][order] for n in ("one", "two", "doc"))
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    hit = np.empty(len(strings), np.bool_)
    hit[order] = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    return hit


def _send_suffixes(short: Short, buckets: int, least: int):
    """Map step: the suffixes at shared anchors with the bytes around them; of equal ones the first document's.

    For heavy anchors, the complete strings that hold them; ``part`` is 0 for suffixes and found spans.
    """
    side = least - GRAM
    names = ["bucket", "slice", "docs", "rows", "places", "lefts", "rights", "around", "spans", "strings", "part"]

    def step(batches):
        for slice_, ids, known, offs, data, row in _slices(batches):
            place, digest, text, unique, shared, number = _slice_anchors(data, offs, known, ids, least)
            if not len(place):
                continue
            told = np.frombuffer(b"".join(row["anchors"] or []), np.uint64)
            pick = (shared | np.isin(short.of(unique), told))[number]
            hot = np.isin(short.of(unique), np.frombuffer(b"".join(row["heavy"] or []), np.uint64))[number][pick]
            place, digest, text = place[pick], digest[pick], text[pick]
            left, right = np.minimum(place - offs[text], side), np.minimum(offs[text + 1] - place, least)
            first = np.searchsorted(text, np.arange(len(offs)))
            around = np.concatenate([
                tb.range_digests(data[offs[a] : offs[b]], (place - left)[s] - offs[a], (place + right)[s] - offs[a])
                for a, b in parts_of(offs) for s in (slice(first[a], first[b]),)
            ]) + left.astype(np.uint64)
            order = np.lexsort((ids[text], around, digest))
            new = np.concatenate([[True], (around[order[1:]] != around[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]])])[: len(order)]
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            later = np.zeros(len(order), np.bool_)
            later[order] = ids[text[lead]] < ids[text[order]]
            done = later & (left + right >= least)
            spans = np.stack([text, place - left - offs[text], place + right - offs[text]], 1)[done].astype(np.int32)
            send, hot = np.flatnonzero(~later & ~hot), np.flatnonzero(~later & hot)
            for a in range(0, len(send), 20_000):
                s = send[a : a + 20_000]
                p, t, x, y = place[s], text[s], left[s], right[s]
                at = p[:, None] + np.arange(-side, least)
                bytes_ = data[np.clip(at, 0, len(data) - 1)]
                bytes_[(at < (p - x)[:, None]) | (at >= (p + y)[:, None])] = 0
                found = _packed(digest[s] % np.uint64(buckets), slice_, {
                    "docs": ids[t], "rows": t.astype(np.int32), "places": (p - offs[t]).astype(np.int32),
                    "lefts": x.astype(np.uint8), "rights": y.astype(np.uint8), "around": bytes_,
                })
                none = pa.nulls(found.num_rows, pa.binary())
                yield tb.replace_column(found, ["spans", "strings", "part"], [none, none, pa.array(np.zeros(found.num_rows, np.int32))])
            if len(hot):
                mark = np.zeros(len(data), np.bool_)
                for o in range(side + 1):
                    mark[place[hot[(left[hot] >= o) & (right[hot] >= least - o)]] - o] = True
                strings, more = _strings(data, offs, ids, np.flatnonzero(mark), least)
                spans = np.concatenate([spans, more])
                at = strings["one"] % np.uint64(buckets * PARTS)
                found = _packed(at, slice_, {"strings": strings})
                at = found.column(0).to_numpy()
                empty = pa.array([b""] * found.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at % buckets), found.column(1), *[empty] * 6, pa.nulls(found.num_rows, pa.binary()), found.column(2), pa.array((at // buckets + 1).astype(np.int32))],
                    names=names,
                )
            if len(spans):
                empty = [pa.array([b""], pa.binary())] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slice_ % buckets]), pa.array([slice_]), *empty, pa.array([_shrink(spans)], pa.binary()), pa.nulls(1, pa.binary()), pa.array([0], pa.int32())],
                    names=names,
                )

    return step


def intervals(lcp: list[int], lcs: list[int], doc: list[int]) -> tuple[np.ndarray, ...]:
    """The interval tree of a suffix array, by a scan with a stack.

    ``lcp[i]`` and ``lcs[i]`` are the common bytes right and left of entries i-1 and i. For each
    interval: depth, depth of its parent, first and last entry, least document, common left extension.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    stack: list[list[int]] = []
    n = len(doc)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        first, least, left = i - 1, doc[i - 1], 1 << 30
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            first = top[1]
            least, left = min(least, top[2]), min(left, top[3])
            out.append((top[0], max(depth, stack[-1][0] if stack else 0), first, i - 1, least, left))
        if not depth:
            continue
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            top[2], top[3] = min(top[2], least), min(top[3], left, lcs[i])
        else:
            stack.append([depth, first, least, min(left, lcs[i])])
    return tuple(np.array(out, np.int64).reshape(-1, 6).T)


def _members(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the given ranges, and the number of the range of each."""
    size = last - first + 1
    which = np.repeat(np.arange(len(first)), size)
    return first[which] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), which


def covered(digest: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the least and the greatest number of bytes left of it at which a repeated string starts.

    A string starting ``o`` bytes left of the suffix is repeated if it also starts in an earlier
    document; ``least`` and -1 stand for none.
    """
    side, n = least - GRAM, len(digest)
    tail, head = around[:, least:], around[:, :side][:, ::-1]
    padded = np.zeros((n, -(-side // 8) * 8), np.uint8)
    padded[:, :side] = tail
    words = padded.view(">u8").astype(np.uint64)
    heads = np.zeros((n, side + 1), np.uint64)
    for o in range(side):
        heads[:, o + 1] = tb.mix(heads[:, o] + tb.BYTE_VALUES[head[:, o]] + np.uint64(o))
    full = heads[:, side] + left.astype(np.uint64)
    order = np.lexsort((full, right, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), digest))
    same = (digest[order[1:]] == digest[order[:-1]]) & (full[order[1:]] == full[order[:-1]]) & (right[order[1:]] == right[order[:-1]])
    same &= (words[order[1:]] == words[order[:-1]]).all(1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    entry = np.empty(n, np.int64)
    entry[order] = np.cumsum(np.concatenate([[0], ~same]))
    e = order[first]
    least_doc = np.minimum.reduceat(doc[order], first)
    tail, head, heads = tail[e], head[e], heads[e]
    e_left, e_right = left[e].astype(np.int64), right[e].astype(np.int64)

    def common(bytes_: np.ndarray, most: np.ndarray) -> np.ndarray:
        differ = bytes_[1:] != bytes_[:-1]
        run = np.where(differ.any(1), differ.argmax(1), side)
        return np.minimum(run, np.minimum(most[1:], most[:-1]))

    lcp = np.where(digest[e][1:] == digest[e][:-1], GRAM + common(tail, e_right - GRAM), 0)
    lcs = common(head, e_left)
    depth, parent, lo, hi, low_doc, shared_left = intervals([0, *lcp.tolist()], [0, *lcs.tolist()], least_doc.tolist())

    near, far = np.full(len(e), least, np.int64), np.full(len(e), -1, np.int64)
    from_o, to_o = least - depth, np.minimum(least - parent - 1, side)
    whole = np.flatnonzero(shared_left >= from_o)
    member, which = _members(lo[whole], hi[whole])
    earlier = low_doc[whole][which] < least_doc[member]
    member, node = member[earlier], whole[which[earlier]]
    np.minimum.at(near, member, from_o[node])
    np.maximum.at(far, member, np.minimum(to_o, shared_left)[node])
    for o in range(side + 1):
        node = np.flatnonzero((from_o <= o) & (o <= to_o) & (shared_left < o))
        if not len(node):
            continue
        member, which = _members(lo[node], hi[node])
        long = e_left[member] >= o
        member, which = member[long], which[long]
        if not len(member):
            continue
        turn = np.lexsort((heads[member, o], which))
        member, which = member[turn], which[turn]
        kind = heads[member, o]
        start = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (which[1:] != which[:-1])]))
        low = np.repeat(np.minimum.reduceat(least_doc[member], start), np.diff(np.append(start, len(member))))
        hit = member[low < least_doc[member]]
        near[hit], far[hit] = np.minimum(near[hit], o), np.maximum(far[hit], o)
    near, far = near[entry], far[entry]
    later = (doc > least_doc[entry]) & (least - right.astype(np.int64) <= left)
    near[later], far[later] = least - right[later].astype(np.int64), left[later]
    return near, far


def _spans(least: int):
    """Reduce step: for each slice, covered ranges (row, first byte, last byte plus one)."""

    def step(batches):
        for table in grouped(batches, ["bucket", "part"]):
            if table.column("part")[0].as_py():
                per = [_grow(v, STRING) for v in table.column("strings").to_pylist()]
                hits, owner = _repeated(strings := np.concatenate(per)), np.repeat(table.column("slice").to_numpy(), [len(x) for x in per])
                strings, owner = strings[hits], owner[hits]
                order = np.argsort(owner, kind="stable")
                spans = np.stack([strings["row"], strings["first"], strings["end"]], 1)[order]
                slices_, begin = np.unique(owner[order], return_index=True)
                found = [_shrink(x) for x in np.split(spans, begin[1:])][: len(slices_)]
                yield pa.RecordBatch.from_arrays([pa.array(slices_, pa.int64()), pa.array(found, pa.binary())], names=["slice", "spans"])
                continue
            done = table.filter(table.column("spans").is_valid())
            table = table.filter(table.column("spans").is_null())
            slices_, found = done.column("slice").to_pylist(), done.column("spans").to_pylist()
            if table.num_rows:
                counts = [len(_grow(v, np.uint8)) for v in table.column("lefts").to_pylist()]
                place = _unpacked(table, "places", np.int32)
                around = _unpacked(table, "around", np.uint8).reshape(len(place), -1)
                near, far = covered(
                    gram_digest(around, least), _unpacked(table, "docs", np.int64), _unpacked(table, "lefts", np.uint8),
                    _unpacked(table, "rights", np.uint8), around, least,
                )
                spans = np.stack([_unpacked(table, "rows", np.int32), place - far, place - near + least], 1).astype(np.int32)
                at = 0
                for slice_, n in zip(table.column("slice").to_pylist(), counts):
                    hit = spans[at : at + n][far[at : at + n] >= 0]
                    at += n
                    if len(hit):
                        slices_.append(slice_)
                        found.append(_shrink(hit))
            yield pa.RecordBatch.from_arrays([pa.array(slices_, pa.int64()), pa.array(found, pa.binary())], names=["slice", "spans"])

    return step


def _cut(batches):
    """Map step: each text without its covered ranges."""
    for _, ids, known, offs, data, row in _slices(batches):
        spans = [_grow(x, np.int32).reshape(-1, 3) for x in row["spans"] or []]
        spans = np.concatenate(spans).astype(np.int64) if spans else np.empty((0, 3), np.int64)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, offs[spans[:, 0]] + spans[:, 1], 1)
        np.add.at(edge, offs[spans[:, 0]] + spans[:, 2], -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        begin = gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]
        heads = offs[:-1][offs[:-1] < len(data)]
        begin[heads] = gone[heads]
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offs])
        runs = np.diff(np.concatenate([[0], np.cumsum(begin)])[offs])
        size = np.diff(offs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=~known), pa.array(size), pa.array(removed.astype(np.int64)), pa.array(runs.astype(np.int64)),
                tb.binary_column(data[~gone], size - removed),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions(*[c for c in ("bucket", "part") if c in rows.columns])


def _sent(stored: DataFrame, count: int, least: int, heavy: int) -> DataFrame:
    """What the slices send to the buckets of suffixes, dealt; ``count`` is about the number of anchors."""
    buckets = max(1, -(-count // ANCHORS_PER_BUCKET))
    short = Short(buckets, max(16, min(63, int(count).bit_length() + 12 - int(buckets).bit_length())))
    sent = stored.mapInArrow(_send_anchors(short, least), "bucket long, slice long, keys binary, flags binary")
    shared = _dealt(sent, buckets).mapInArrow(_shared_anchors(short, heavy), "slice long, anchors binary, heavy binary")
    shared = shared.groupBy("slice").agg(F.collect_list("anchors").alias("anchors"), F.collect_list("heavy").alias("heavy"))
    buckets = max(1, -(-count // ANCHORS_PER_SUFFIX_BUCKET))
    sent = stored.join(shared, "slice", "left").mapInArrow(
        _send_suffixes(short, buckets, least),
        "bucket long, slice long, docs binary, rows binary, places binary, lefts binary, rights binary, around binary, spans binary, strings binary, part int",
    )
    return _dealt(sent, buckets)


def remove_repeats(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes, one row per row of ``docs``."""
    if least < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes or more can be searched")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stored = materialize(rows.mapInArrow(_store, "slice long, ids binary, known binary, offs binary, text binary"), "slices")
    count = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 2 // (least - GRAM + 1)  # anchors, about
    spans = _sent(stored, count, least, heavy).mapInArrow(_spans(least), "slice long, spans binary")
    spans = spans.groupBy("slice").agg(F.collect_list("spans").alias("spans"))
    return stored.join(spans, "slice", "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes, removed bytes and runs, and a digest of what is kept, one row per row of ``docs``."""
    found = remove_repeats(docs, least, key, text)
    return found.select(F.col("doc_id").alias(key), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
