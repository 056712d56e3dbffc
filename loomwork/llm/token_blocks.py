r"""Token ids of documents in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, in blocks of 128. A block is stored as its minimum and
the differences to it, packed at the width that a share ``FIT`` of them fits in. Differences that do not
fit leave zeros in the block; their places and values stand in the file's exception lists. The block index
names the minimum, the width, the first packed word and the first exception of every block, so any
range of ids is read from its own blocks alone. Layout, all little-endian::

    packed words u32 | exception places u8 | exception values u32 | block index | documents | footer

``documents`` is an Arrow stream (key, n_tokens); the footer has the counts and the section lengths.

Files are written by the tasks of a range partitioning by (key, row), so ids stand in ascending key order
over all files and a key that very many rows share spans several. A file is named anew by every attempt of a
task; the table of files, which is itself written by Spark, names those that count, and what lost
attempts left is never read.

Null texts count as empty: one end id. Null keys come first; rows with equal keys are kept one by one,
in any order among themselves; other columns are not read; an empty table gives no files and no rows.
Very long texts are encoded whole and lie in one file. Paths are local ones or URIs that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm import textbytes as tb
from loomwork.session import materialize, scratch_path

END_ID = 1
#: Ids in a block, and the share of them that must fit the packed width.
BLOCK, FIT = 128, 0.98
#: Ids after which a writer starts the next file, bytes of text that one task sorts, and the most tasks of a write.
FILE_IDS, TASK_BYTES, MAX_TASKS = 8 << 20, 32 << 20, 20_000
#: Pieces whose ids a worker keeps, and bytes of text it encodes at a time.
KNOWN_PIECES, SLICE = 600_000, 1 << 20

_CUT = int(np.ceil(FIT * BLOCK)) - 1
_MAGIC = b"PFORIDS1"
_FOOTER = struct.Struct("<8s5Q3Q")
INDEX = np.dtype([("word", "<u8"), ("exception", "<u8"), ("low", "<u4"), ("width", "u1")])


# ---- blocks


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed words, exception places, exception values and index of whole blocks of ids."""
    values = ids.astype(np.uint64).reshape(-1, BLOCK)
    low = values.min(1)
    rest = values - low[:, None]
    fits = np.partition(rest, _CUT, axis=1)[:, _CUT]
    width = np.zeros(len(rest), np.uint64)
    for bit in range(32):
        width[fits >> np.uint64(bit) > 0] = bit + 1
    over = rest >> width[:, None] > 0
    row, place = np.nonzero(over)
    kept = np.where(over, 0, rest)
    sizes = width.astype(np.int64) * BLOCK // 32
    first = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        columns = np.ascontiguousarray(kept[rows].T)
        out = np.zeros((w * BLOCK // 32 + 1, len(rows)), np.uint64)
        for i in range(BLOCK):
            at, shift = divmod(i * w, 32)
            wide = columns[i] << np.uint64(shift)
            out[at] |= wide & np.uint64(0xFFFFFFFF)
            out[at + 1] |= wide >> np.uint64(32)
        words[first[rows][:, None] + np.arange(len(out) - 1)] = out[:-1].T
    index = np.zeros(len(rest), INDEX)
    index["word"], index["low"], index["width"] = first, low, width
    index["exception"] = np.searchsorted(row, np.arange(len(rest)))
    return words, place.astype(np.uint8), rest[over].astype(np.uint32), index


def unpack(words: np.ndarray, places: np.ndarray, values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The ids of whole blocks; ``index`` counts from the first word and exception given."""
    out = np.zeros((len(index), BLOCK), np.uint64)
    width = index["width"].astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        n = w * BLOCK // 32
        packed = np.zeros((n + 1, len(rows)), np.uint64)
        packed[:n] = words[index["word"][rows].astype(np.int64)[:, None] + np.arange(n)].T
        mask = np.uint64((1 << w) - 1)
        for i in range(BLOCK):
            at, shift = divmod(i * w, 32)
            out[rows, i] = (packed[at] | packed[at + 1] << np.uint64(32)) >> np.uint64(shift) & mask
    row = np.searchsorted(index["exception"], np.arange(len(places)), "right") - 1
    out[row, places] = values
    return (out + index["low"].astype(np.uint64)[:, None]).ravel().astype(np.uint32)


# ---- files


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


class Writer:
    """Collects documents and writes them as one file; holds packed blocks, not ids."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = [[], [], [], []]
        self.words = self.exceptions = self.n_ids = 0
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.keys: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []

    def add(self, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys.take(pa.array(np.arange(len(keys)))))  # a copy, so that the batch can go
        self.lengths.append(lengths.copy())
        self.open.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= 512 * BLOCK:
            self._pack(self.waiting // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.concatenate(self.open)
        words, places, values, index = pack(ids[:n])
        index["word"] += self.words
        index["exception"] += self.exceptions
        self.words += len(words)
        self.exceptions += len(places)
        for part, found in zip(self.parts, (words, places, values, index)):
            part.append(found)
        self.open, self.waiting = [ids[n:]], len(ids) - n

    def write(self, path: str) -> None:
        if self.waiting:
            ids = np.concatenate(self.open)
            fill = -len(ids) % BLOCK
            self.open = [ids, np.full(fill, ids.min(), ids.dtype)]
            self.waiting += fill
            self._pack(self.waiting)
        kinds = (np.dtype("<u4"), np.dtype("u1"), np.dtype("<u4"), INDEX)
        sections = [np.concatenate([np.empty(0, k), *p]).astype(k, copy=False).tobytes() for k, p in zip(kinds, self.parts)]
        lengths = np.concatenate(self.lengths)
        table = pa.record_batch([pa.chunked_array(self.keys).combine_chunks(), pa.array(lengths, pa.int64())], names=["key", "n_tokens"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_batch(table)
        sections.append(sink.getvalue().to_pybytes())
        blocks = sum(len(x) for x in self.parts[3])
        footer = _FOOTER.pack(_MAGIC, *map(len, sections), self.n_ids, blocks, len(lengths))
        files, place = _filesystem(path)
        with files.open_output_stream(place) as out:
            for section in sections:
                out.write(section)
            out.write(footer)


class Reader:
    """A token file; reads the footer and the index, then only what is asked for."""

    def __init__(self, path: str):
        files, place = _filesystem(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        magic, *rest = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.at = np.concatenate([[0], np.cumsum(rest[:5])]).astype(np.int64)
        self.n_ids, self.n_blocks, self.n_docs = rest[5:]
        self.index = np.frombuffer(self._section(3), INDEX)

    def _section(self, no: int, first: int = 0, last: int | None = None) -> bytes:
        start = int(self.at[no]) + first
        end = int(self.at[no + 1]) if last is None else int(self.at[no]) + last
        return self.file.read_at(end - start, start)

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """Keys and numbers of tokens of the file's documents, in order."""
        table = pa.ipc.open_stream(self._section(4)).read_next_batch()
        return table.column("key"), table.column("n_tokens").to_numpy()

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids number ``first`` up to ``last``, from the blocks that hold them."""
        last = self.n_ids if last is None else last
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        index = self.index[a:b].copy()
        whole = b == self.n_blocks
        words = np.array([index["word"][0], self.at[1] // 4 if whole else self.index["word"][b]], np.int64)
        outliers = np.array([index["exception"][0], self.at[2] - self.at[1] if whole else self.index["exception"][b]], np.int64)
        index["word"] -= index["word"][0]
        index["exception"] -= index["exception"][0]
        found = unpack(
            np.frombuffer(self._section(0, *(words * 4).tolist()), "<u4"),
            np.frombuffer(self._section(1, *outliers.tolist()), "u1"),
            np.frombuffer(self._section(2, *(outliers * 4).tolist()), "<u4"),
            index,
        )
        return found[first - a * BLOCK : last - a * BLOCK]

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


# ---- texts to ids

_SPACE, _LETTER, _DIGIT, _OTHER, _WIDE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[128:] = _WIDE
_APOSTROPHE = 39


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of pieces that encode alike wherever they stand, and the number of pieces before each text.

    Pieces end at ASCII white space, between ASCII letters, digits and others, and between digits: the
    tokenizer never joins across these. An apostrophe stays with the letters after it (``'s``), and
    other characters stay with what touches them, as they may be letters, spaces or marks.
    """
    kind = _KIND[data]
    before = np.concatenate([[np.uint8(_SPACE)], kind[:-1]])
    cut = (before != kind) | (kind == _DIGIT)
    cut &= (before != _WIDE) & (kind != _WIDE)
    cut[1:] &= ~((kind[1:] == _LETTER) & (data[:-1] == _APOSTROPHE))
    cut |= before == _SPACE
    cut[offs[:-1][offs[:-1] < len(data)]] = True
    solid = kind != _SPACE
    starts = np.flatnonzero(cut & solid)
    stop = np.concatenate([cut[1:] | ~solid[1:], [True]])
    return starts, np.flatnonzero(stop & solid) + 1, np.searchsorted(starts, offs)


_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts for vocabularies that lower-case, drop white space and never join across pieces.

    Pieces are told apart by 64-bit digests; the ids of pieces seen before are kept, up to
    ``KNOWN_PIECES``. Texts that hold the content of an added token are encoded whole, as in the
    library's plain ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pool, self.first, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder, which lives on from task to task."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _holding_added(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        found = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        return np.unique(np.searchsorted(offs, np.array(found, np.int64), "right") - 1)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins (one more entry at the end)."""
        starts, ends, before = pieces(data, offs)
        wide = np.concatenate([[0], np.cumsum(data >= 128)])
        plain = wide[ends] == wide[starts]
        # Capitals are alike where no mark can join them.
        own = data[_inside(starts, ends)]
        folded = np.where(np.repeat(plain, ends - starts), tb.LOWER[own], own)
        own = np.cumsum(ends - starts)
        digest = tb.range_digests(folded, own - (ends - starts), own)
        unique, sample, word = np.unique(digest, return_index=True, return_inverse=True)
        slot = np.full(len(unique), -1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
            known = self.keys[at] == unique
            slot[known] = self.slots[at[known]]
        missing = np.flatnonzero(slot < 0)
        raw = data.tobytes()
        fresh, sizes = self._flat([raw[starts[i] : ends[i]].decode() for i in sample[missing]])
        pool = np.concatenate([self.pool, fresh])
        first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
        size = np.concatenate([self.size, sizes])
        slot[missing] = len(self.size) + np.arange(len(missing))
        if len(size) <= KNOWN_PIECES:
            at = np.searchsorted(self.keys, unique[missing])  # both are in order
            self.keys, self.slots = np.insert(self.keys, at, unique[missing]), np.insert(self.slots, at, slot[missing])
            self.pool, self.first, self.size = pool, first, size
        slot = slot[word]
        length = size[slot]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = pool[np.repeat(first[slot] - upto[:-1], length) + np.arange(upto[-1])]
        cuts = upto[before]
        special = self._holding_added(raw, offs)
        if not len(special):
            return ids, cuts
        texts = np.split(ids, cuts[1:-1])
        for t in special:
            texts[t], _ = self._flat([raw[offs[t] : offs[t + 1]].decode()])
        return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])


def _inside(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places inside the ranges, in order."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _write(folder: str, tokenizer: str, end_id: int, file_ids: int):
    """Map step: the files of a sorted partition of (key, text), and a row for each."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        attempt = uuid.uuid4().hex
        encoder, writer = Encoder.of(tokenizer), Writer()

        def close() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{no:06d}-{attempt}.pfor"
            writer.write(path)
            row = [[part], [no], [path], [sum(map(len, writer.keys))], [writer.n_ids]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "no", "path", "n_docs", "n_ids"])

        for batch in batches:
            for rows, data, offs in tb.slices(batch, "text", SLICE):
                ids, cuts = encoder.encode(data, offs)
                writer.add(rows.column(0), np.diff(cuts) + 1, np.insert(ids, cuts[1:], end_id))
                if writer.n_ids >= file_ids:
                    yield close()
                    writer, no = Writer(), no + 1
        if writer.keys:
            yield close()

    return step


def write(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """Write the ids of all documents below ``folder``; returns the table of files: start, path, n_docs, n_ids.

    ``start`` is the number of ids in all files before. Texts are dealt, not ids, as they take less room;
    each is encoded once, by the task that writes it.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(max(1, -(-total // task_bytes)), MAX_TASKS)
    files, place = _filesystem(folder)
    files.create_dir(place, recursive=True)
    dealt = rows.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(tasks, "key", "turn")
    dealt = dealt.sortWithinPartitions("key", "turn").select("key", "text")
    made = dealt.mapInArrow(_write(folder, tokenizer, end_id, file_ids), "part long, no long, path string, n_docs long, n_ids long")
    made = materialize(made, "token-files")
    # Totals run within groups of tasks, after the totals of earlier groups.
    grouped = made.withColumn("group", F.floor(F.col("part") / 1000))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("group").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    before = grouped.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = grouped.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(before, "group")
    return placed.select((F.col("before") + F.col("inside")).alias("start"), "path", "n_docs", "n_ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map step: the documents of each file, their ids read block range by block range."""
    for batch in batches:
        for row in batch.to_pylist():
            with Reader(row["path"]) as file:
                keys, lengths = file.documents()
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                doc = 0
                while doc < len(lengths):
                    end = max(int(np.searchsorted(cuts, cuts[doc] + SLICE // 4, "right")) - 1, doc + 1)
                    ids = file.ids(int(cuts[doc]), int(cuts[end]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.slice(doc, end - doc),
                            pa.array(cuts[doc:end] + row["start"], pa.int64()),
                            pa.array(lengths[doc:end], pa.int64()),
                            tb.binary_column(ids.astype("<u4", copy=False), lengths[doc:end]).cast(pa.binary()),
                        ],
                        names=["key", "start", "n_tokens", "ids"],
                    )
                    doc = end


def read(files: DataFrame, kind: str = "long", key: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """Documents of a table of files: key, start, n_tokens and ids (little-endian unsigned 32-bit numbers)."""
    dealt = files.select("start", "path").repartition(tasks or max(1, files.count()))
    return dealt.mapInArrow(_read, f"key {kind}, start long, n_tokens long, ids binary").withColumnRenamed("key", key)


def digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of documents whose ids were written to files and read back."""
    files = write(docs, tokenizer, scratch_path(docs.sparkSession, "token-blocks"), end_id, key, text, **sizes)
    back = read(files, docs.select(key).schema[0].dataType.simpleString(), key)
    return back.select(key, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

