r"""Near-duplicates by SuperMinHash signatures, banding, exact verification and connected components.

* Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a text's set holds its distinct runs of five
  words, or the whole sequence if it has fewer. Documents link where the sets' Jaccard similarity
  reaches the threshold, decided on the full sets (as 64-bit digests).
* Texts with equal sets are one class; only classes are compared.
* SuperMinHash: each shingle walks a random permutation of the slots, and its value in the j-th slot
  of the walk is j plus a fraction. Slots that the first steps fill stay; only texts with empty slots
  walk on, so most texts end after one step. Signatures are cut into bands; classes that agree in a
  band meet in a bucket. With 20 bands of 4 slots, two sets of similarity 0.85 meet nowhere once in 2.7 million.
* Members of a bucket whose signatures agree in half of the slots or more form families. Within a
  family every pair is compared on its full sets, in tiles of bounded size, and each tile returns a
  spanning forest of its links, never its pairs.

Ids are whole numbers (a string that is none is an error). Null and empty texts have no set and link with
nothing. Rows that share an id count as one document where that id is the least of its class. Null ids
are greater than all others; a component without any id has none, and all its rows stay in the query,
one in ``dedupe`` (that of the least text digest). A class is compared through one of its rows, named by id
and text digest, so rows without an id do not meet each other. Very long texts are read whole. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm import textbytes as tb
from loomwork.llm.components import connected_components, dense_roots, tiled
from loomwork.llm.groups import grouped
from loomwork.session import materialize

SHINGLE = 5
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
#: Similarity in hundredths, and the least one that bands and agreement are made for.
THRESHOLD, LEAST_THRESHOLD = 85, 80
#: Slots of two signatures that agree, below which they are not compared further.
AGREE = SLOTS // 2
BUCKET_TILE, FAMILY_TILE = 2048, 1024
#: Rows of a table of pairs that are computed at a time.
BLOCK = 256

WORD = ~tb.word_table([0x20, *range(0x09, 0x0E)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64((1 << 64) - 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle digests, text after text, and how many each text has."""
    data = tb.LOWER[data]
    starts, ends, before = tb.words(data, offs, WORD)
    digests = tb.range_digests(data, starts, ends)
    runs = tb.gram_digests(digests, size)
    sets = []
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= size:
            grams = np.sort(runs[a : b - size + 1])
            sets.append(grams[np.concatenate([[True], grams[1:] != grams[:-1]])])
        elif b > a:
            sets.append(tb.gram_digests(digests[a:b], int(b - a)) + np.uint64(b - a))
        else:
            sets.append(np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def signatures(grams: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values, a row of ``slots`` for each set; rows of empty sets hold no value."""
    best = np.full(len(counts) * slots, _EMPTY)
    text = np.repeat(np.arange(len(counts)), counts)
    fraction = np.uint64((1 << 40) - 1)
    order = None
    for j in range(slots):
        draw = tb.mix(grams + np.uint64((j + 1) * int(_STEP) & (1 << 64) - 1))
        pick = j + ((draw >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        slot = pick
        if order is not None:
            row = np.arange(len(grams))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, j]
            order[row, j] = slot
        np.minimum.at(best, text * slots + slot, np.uint64(j) << np.uint64(40) | draw & fraction)
        walking = (best.reshape(-1, slots) == _EMPTY).any(1)[text]
        if not walking.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(walking.sum()), 1))
            first = pick[walking]
            row = np.arange(len(first))
            order[row, first] = 0
            order[:, 0] = first
        elif not walking.all():
            order = order[walking]
        grams, text = grams[walking], text[walking]
    return best.reshape(-1, slots)


def _set_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two independent 64-bit sums of each set; zeros for empty ones."""
    out = np.zeros((len(counts), 2), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        out[full, 0] = np.add.reduceat(tb.mix(grams + _STEP), first)
        out[full, 1] = np.add.reduceat(tb.mix(grams ^ np.uint64(0xD6E8FEB86659FD93)), first)
    return out


def _keys_column(keys: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw = keys.tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(counts)], pa.binary())


def _sign(batches):
    for batch in batches:
        for part, data, offs in tb.slices(batch, "text"):
            grams, counts = shingle_sets(data, offs)
            values = signatures(grams, counts)
            bands = np.zeros((len(counts), BANDS), np.uint64)
            for r in range(ROWS):
                bands = tb.mix(bands + values[:, r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
            bands = bands[counts > 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("tag")), pa.array(counts),
                    _keys_column(_set_keys(grams, counts), counts),
                    tb.runs_to_list(pa.array(bands.ravel()), np.where(counts > 0, BANDS, 0)),
                    tb.binary_column((tb.mix(values) & np.uint64(0xFFFF)).astype(np.uint16).ravel(), np.full(len(counts), SLOTS)),
                ],
                names=["doc_id", "tag", "n_shingles", "key", "bands", "signature"],
            )


def _forest(vertex: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = dense_roots(linked)
    child = np.flatnonzero(root != np.arange(len(root)))
    return vertex[root[child]], vertex[child]


def _links(u: list, v: list) -> pa.RecordBatch:
    empty = [np.empty(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or empty)), pa.array(np.concatenate(v or empty))], names=["u", "v"])


def _families(threshold: int):
    """Reduce step: links between members of a bucket's tiles whose signatures and sizes agree."""

    def step(batches):
        u, v = [], []
        for table in grouped(batches, ["bucket", "ti", "tj"]):
            n = table.num_rows
            if n < 2:
                continue
            vertex, size = table.column("vertex").to_numpy(), table.column("n").to_numpy()
            sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(n, SLOTS)
            linked = np.zeros((n, n), np.bool_)
            for a in range(0, n, 256):
                same = np.zeros((min(256, n - a), n), np.uint8)
                for s in range(SLOTS):
                    same += sign[a : a + 256, s, None] == sign[None, :, s]
                near = 100 * np.minimum(size[a : a + 256, None], size) >= threshold * np.maximum(size[a : a + 256, None], size)
                linked[a : a + 256] = (same >= AGREE) & near
            a, b = _forest(vertex, linked)
            u.append(a)
            v.append(b)
            if len(u) >= 4096:
                yield _links(u, v)
                u, v = [], []
        yield _links(u, v)

    return step


def _send_sets(batches):
    """The sets of texts that stand for a class in a family."""
    for batch in batches:
        for part, data, offs in tb.slices(batch, "text"):
            grams, counts = shingle_sets(data, offs)
            columns = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            wanted = pa.compute.equal(columns["key"], _keys_column(_set_keys(grams, counts), counts))
            out = pa.RecordBatch.from_arrays(
                [columns["family"], columns["family_size"], columns["vertex"], tb.binary_column(grams, counts)],
                names=["family", "family_size", "vertex", "shingles"],
            )
            yield out.filter(wanted)


def linked_sets(sets: list[np.ndarray], threshold: int = THRESHOLD) -> np.ndarray:
    """Which sets reach the similarity, as a symmetric table of flags."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    del order
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    del grams
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], number[shared]
    number = np.cumsum(np.concatenate([[False], number[1:] != number[:-1]])) if len(number) else number
    # Rows are counted and judged in blocks; the tables of a pair of tiles take a few times its flags.
    both = np.zeros((n, n), np.int32)
    width = max(256, (4 << 20) // max(n, 1))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [a, a + width])
        holds = np.zeros((n, min(width, int(number[-1]) + 1 - a)), np.float32)
        holds[owner[lo:hi], number[lo:hi] - a] = 1
        for r in range(0, n, BLOCK):
            both[r : r + BLOCK] += (holds[r : r + BLOCK] @ holds.T).astype(np.int32)
    linked = np.zeros((n, n), np.bool_)
    for r in range(0, n, BLOCK):
        inner = both[r : r + BLOCK].astype(np.int64)
        linked[r : r + BLOCK] = 100 * inner >= threshold * (size[r : r + BLOCK, None] + size - inner)
    return linked


def _verify(threshold: int):
    """Reduce step: a spanning forest of the links among the sets of a pair of tiles."""

    def step(batches):
        u, v = [], []
        for table in grouped(batches, ["family", "ti", "tj"]):
            if table.num_rows < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            a, b = _forest(table.column("vertex").to_numpy(), linked_sets(sets, threshold))
            u.append(a)
            v.append(b)
            if len(u) >= 4096:
                yield _links(u, v)
                u, v = [], []
        yield _links(u, v)

    return step


def _sets_of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """family, family_size, vertex and shingles of the classes in ``chosen``, one row each, from the text that stands for the class."""
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tag") == F.col("rep_tag"))
    sets = rows.join(chosen, same).select("text", "key", "family", "family_size", "vertex")
    sent = sets.mapInArrow(_send_sets, "family long, family_size long, vertex long, shingles binary")
    return sent.dropDuplicates(["vertex"])  # rows that repeat an id and a text


def _components(docs: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """doc_id, tag, n_shingles, component_id and lead_tag: in a component without ids, the tag of the row that leads it."""
    if not LEAST_THRESHOLD <= threshold <= 100:
        raise ValueError(f"the bands are made for a similarity of {LEAST_THRESHOLD} to 100 hundredths")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text"))
    signed = materialize(
        rows.mapInArrow(_sign, "doc_id long, tag long, n_shingles long, key binary, bands array<long>, signature binary"), "signatures"
    )
    classes = signed.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    classes = classes.select("key", F.col("least.doc_id").alias("rep"), F.col("least.tag").alias("rep_tag"), "n", "bands", "signature")
    own = F.coalesce("rep", -1 - F.pmod(F.xxhash64("key"), F.lit(1 << 62)))
    classes = materialize(classes.withColumn("vertex", own), "classes")

    met = classes.select("vertex", F.explode("bands").alias("bucket"))
    crowded = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = met.join(crowded, "bucket").join(classes.select("vertex", "n", "signature"), "vertex")
    dealt = tiled(members, "bucket", "members", "vertex", BUCKET_TILE).repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj")
    family = connected_components(dealt.mapInArrow(_families(threshold), "u long, v long"))
    family = family.withColumnRenamed("component", "family")

    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("family_size"))
    chosen = family.join(sizes, "family").join(classes.select("vertex", "rep", "rep_tag", "key"), "vertex")
    sets = _sets_of(rows, chosen)
    dealt = tiled(sets, "family", "family_size", "vertex", FAMILY_TILE).repartition("family", "ti", "tj").sortWithinPartitions("family", "ti", "tj")
    component = connected_components(dealt.mapInArrow(_verify(threshold), "u long, v long"))

    whole = classes.select("key", "rep", "rep_tag", "vertex").join(component, "vertex", "left").withColumn("root", F.coalesce("component", "vertex"))
    # Written, so that the join sees two plain shuffles and a component of most classes can be split.
    whole = materialize(whole, "roots")
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_tag")).alias("least")
    least = materialize(whole.groupBy("root").agg(least).select("root", F.col("least.rep").alias("component_id"), F.col("least.rep_tag").alias("lead_tag")), "least")
    found = whole.join(least, "root").select(F.col("key").alias("class_key"), "component_id", "lead_tag")
    out = signed.join(found, F.col("key") == F.col("class_key"), "left")
    component_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tag", "n_shingles", component_id.alias("component_id"), "lead_tag")


def _kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, tag (of the text), n_shingles, component_id and kept, one row per row of ``docs``."""
    found = _components(docs, key, text, threshold)
    return found.select("doc_id", "tag", "n_shingles", "component_id", _kept().alias("kept"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, with its own columns; rows equal in id and text count once."""
    found = _components(docs, key, text, threshold).where(_kept())
    # Without an id one row leads; a row without a set is a component of its own.
    lead = F.col("doc_id").isNotNull() | F.coalesce(F.col("tag") == F.col("lead_tag"), F.lit(True))
    kept = found.where(lead).select(F.col("doc_id").alias("kept__id"), F.col("tag").alias("kept__tag")).distinct()
    own = "row__tag"
    while own in docs.columns:
        own += "_"
    tagged = docs.withColumn(own, F.xxhash64(F.col(text)))
    same = F.col(key).cast("long").eqNullSafe(F.col("kept__id")) & (F.col(own) == F.col("kept__tag"))
    return tagged.join(kept, same, "left_semi").dropDuplicates([key, own]).drop(own)
