"""Embedding of new artifacts, exact cosine search, and context for grounded answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.functions import text
from loomwork.schemas import VECTORS, conform
from loomwork.session import materialize

# Size of a vector, texts per encoder call, hits per search and per context.
DIM = 384
ENCODE_BATCH = 64
TOP_K, CONTEXT_K = 10, 6
# About as many queries as a tile answers at a time, rows as a tile has, and queries as are scored together.
MAX_QUERIES, TILE_ROWS, SCORED = 1024, 16_384, 128

Encoder = Callable[[Sequence[str]], np.ndarray]


# --- V0: embedding ---


def hashing_vectors(df: DataFrame, text_col: str, dim: int = DIM) -> DataFrame:
    """Adds ``vector``: hashed word counts, scaled to unit length.

    Stateless, so vectors made at different times can be compared, and it stays in the JVM.
    """
    words = df.withColumn("_words", F.regexp_extract_all(F.lower(text_col), F.lit(text.TOKEN_PATTERN), F.lit(0)))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn("vector", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


def encoded_vectors(df: DataFrame, text_col: str, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """Adds ``vector`` from a model: built once per task, called on batches, unit length."""
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            parts = [
                encode(frame[text_col].iloc[i : i + ENCODE_BATCH].tolist())
                for i in range(0, len(frame), ENCODE_BATCH)
            ]
            if not parts:
                continue
            raw = np.vstack(parts).astype(np.float32)
            norm = np.linalg.norm(raw, axis=1, keepdims=True)
            unit = np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)
            yield frame.assign(vector=list(unit))

    return df.mapInPandas(run, schema)


def to_embed(artifacts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Artifacts without a vector, with the text to encode as ``said``: text, else title."""
    said = F.coalesce(text.blank_to_null(F.col("text")), F.col("title"), F.lit(""))
    return artifacts.join(vectors.select("id"), "id", "left_anti").withColumn("said", said)


def embed_new(
    artifacts: DataFrame,
    vectors: DataFrame,
    make_encoder: Callable[[], Encoder] | None = None,
    dim: int = DIM,
) -> DataFrame:
    """Vector rows of the artifacts that have none yet."""
    todo = to_embed(artifacts, vectors).select(
        "id", "kind", "source",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("repo", "actor", "object_uri")],
        text.clip(F.coalesce("title", F.lit("")), text.VECTOR_TITLE).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(text.iso_utc(F.col("created_at")), F.lit("")).alias("created_at"),
        "said",
    )
    done = (
        hashing_vectors(todo, "said", dim) if make_encoder is None
        else encoded_vectors(todo, "said", make_encoder)
    )
    return conform(done, VECTORS)


# --- V2, V3: search ---

HIT_COLUMNS = ("kind", "source", "repo", "actor", "title", "snippet", "object_uri")


def _candidates(vectors: DataFrame, kind: str | None, repo: str | None) -> DataFrame:
    """Id, vector and shown columns of the rows a search may return; filters reach the scan."""
    rows = vectors.filter(F.col("vector").isNotNull())
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if repo:
        rows = rows.filter(F.col("repo") == repo)
    shown = {
        "snippet": F.coalesce("text", F.lit("")),
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HIT_COLUMNS if c != "snippet"},
    }
    return rows.select("id", "vector", *[shown[c].alias(c) for c in HIT_COLUMNS])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), dim)


def _best(scores: np.ndarray, ids: list, k: int) -> np.ndarray:
    """Positions of the k best by (rank score desc, id)."""
    rank = np.round(scores, RANK_DECIMALS)
    if len(rank) > k:
        bound = np.partition(rank, len(rank) - k)[len(rank) - k]
        keep = np.flatnonzero(rank >= bound)
    else:
        keep = np.arange(len(rank))
    order = sorted(keep.tolist(), key=lambda i: (-rank[i], ids[i]))
    return np.asarray(order[:k], dtype=np.int64)


def _local_hits(query_ids: list, queries: np.ndarray, k: int, schema: pa.Schema):
    """Scan function of one task: per query keeps the ``k`` best rows seen, and emits those."""
    queries = _unit(queries)
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * len(query_ids)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            ids = rows.column("id").to_pylist()
            vectors = rows.column("vector").combine_chunks()
            scores = _unit(_matrix(vectors, dim)) @ queries.T
            plain = rows.drop_columns(["vector"])
            for q in range(len(query_ids)):
                pick = _best(scores[:, q], ids, k)
                found = plain.take(pa.array(pick)).append_column("raw", pa.array(scores[pick, q]))
                if held[q] is not None:
                    found = pa.concat_tables([held[q], found])
                    again = _best(found.column("raw").to_numpy(), found.column("id").to_pylist(), k)
                    found = found.take(pa.array(again))
                held[q] = found
        for q, found in enumerate(held):
            if found is None:
                continue
            owner = pa.array([query_ids[q]] * found.num_rows, schema.field("query_id").type)
            table = found.append_column("query_id", owner).select(schema.names).cast(schema)
            yield from table.combine_chunks().to_batches()

    return run


# Scores that agree to this many decimals (about single precision) rank as equal.
RANK_DECIMALS = 6


def _answer(candidates: DataFrame, query_ids: list, matrix: np.ndarray, k: int, id_type: T.DataType) -> DataFrame:
    fields = [
        T.StructField("query_id", id_type),
        candidates.schema["id"],
        *[candidates.schema[c] for c in HIT_COLUMNS],
        T.StructField("raw", T.DoubleType()),
    ]
    schema = T.StructType(fields)
    local = candidates.mapInArrow(_local_hits(query_ids, matrix, k, to_arrow_schema(schema)), schema)
    best = Window.partitionBy("query_id").orderBy(F.round("raw", RANK_DECIMALS).desc(), "id")
    return (
        local.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .withColumn("score", F.round(F.greatest("raw", F.lit(0.0)), 4))
        .select("query_id", "rank", "id", "score", *HIT_COLUMNS)
    )


def search(
    vectors: DataFrame,
    query_vector: Sequence[float],
    k: int = TOP_K,
    kind: str | None = None,
    repo: str | None = None,
) -> DataFrame:
    """The ``k`` nearest rows by cosine; filters apply before ranking. No query, no hits."""
    rows = _candidates(vectors, kind, repo)
    if len(query_vector) == 0:
        rows, query_vector = rows.limit(0), [0.0]
    matrix = np.asarray([list(query_vector)], dtype=np.float64)
    return _answer(rows, [0], matrix, k, T.LongType()).drop("query_id")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(tile, part, rows) of batches sorted by tile and part; memory holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    key = (-1, -1)
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, part = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("tile", "part"))
        cuts = [0, *(np.flatnonzero(np.diff(tile) | np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and key != (tile[a], part[a]):
                yield *key, pa.Table.from_batches(held)
                held = []
            key = (int(tile[a]), int(part[a]))
            held.append(batch.slice(a, b - a))
    if held:
        yield *key, pa.Table.from_batches(held)


def _tile_hits(k: int, schema: pa.Schema):
    """Reduce step: the ``k`` best rows of a tile for each query; the tile's rows come before the blocks of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = rows = ids = matrix = None
        for here, part, table in _groups(batches):
            if part == 0:
                tile, rows, ids = here, table.column("row"), table.column("id").to_pylist()
                flat = table.column("vector").combine_chunks()
                matrix = _unit(_matrix(flat, len(flat[0])))
                continue
            if here != tile:
                continue
            for a in range(0, table.num_rows, SCORED):
                asked = table.slice(a, SCORED)
                flat = asked.column("query_vector").combine_chunks()
                scores = matrix @ _unit(_matrix(flat, matrix.shape[1])).T
                picks = [_best(scores[:, q], ids, k) for q in range(asked.num_rows)]
                owner = pa.array(np.repeat(np.arange(asked.num_rows), [len(p) for p in picks]))
                pick = np.concatenate(picks)
                found = [
                    asked.column("query_id").take(owner), rows.take(pa.array(pick)), pa.array([ids[i] for i in pick]),
                    pa.array(scores[pick, owner.to_numpy()]),
                ]
                yield from pa.table(found, names=schema.names).cast(schema).combine_chunks().to_batches()

    return run


def search_many(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    kind: str | None = None,
    repo: str | None = None,
    max_queries: int = MAX_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Nearest rows of every query. ``queries``: query_id, query_vector.

    The searched rows are written once with a number each. Their vectors are dealt to tiles of about
    ``tile_rows``; the queries are sent to every tile, and a tile answers them in blocks of about
    ``max_queries`` with its ``k`` best rows per query. Only those are ranked, and only the rows that
    remain get their shown columns. No pair of a query and a row is materialised and no query passes
    through the driver.
    """
    rows = materialize(_candidates(vectors, kind, repo).withColumn("row", F.monotonically_increasing_id()), "searched")
    usable = queries.select("query_id", "query_vector").filter(F.size("query_vector") > 0)
    tiles, blocks = max(1, -(-rows.count() // tile_rows)), max(1, -(-usable.count() // max_queries))
    none = {n: F.lit(None).cast(t) for n, t in [*rows.select("row", "id", "vector").dtypes, *usable.dtypes]}
    of_rows = rows.select(
        F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("part"),
        "row", "id", "vector", *[none[c].alias(c) for c in ("query_id", "query_vector")],
    )
    of_queries = usable.select(
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"),
        (F.pmod(F.xxhash64("query_id", "query_vector"), F.lit(blocks)) + 1).cast("int").alias("part"),
        *[none[c].alias(c) for c in ("row", "id", "vector")], "query_id", "query_vector",
    )
    dealt = of_rows.unionByName(of_queries).repartition(tiles, "tile").sortWithinPartitions("tile", "part")
    fields = [queries.schema["query_id"], T.StructField("row", T.LongType()), rows.schema["id"], T.StructField("raw", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    best = Window.partitionBy("query_id").orderBy(F.round("raw", RANK_DECIMALS).desc(), "id", "row")
    return (
        dealt.mapInArrow(_tile_hits(k, to_arrow_schema(schema)), schema)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .join(rows.select("row", *HIT_COLUMNS), "row")
        .withColumn("score", F.round(F.greatest("raw", F.lit(0.0)), 4))
        .select("query_id", "rank", "id", "score", *HIT_COLUMNS)
    )


def encode_questions(
    questions: DataFrame, make_encoder: Callable[[], Encoder] | None = None, dim: int = DIM
) -> DataFrame:
    """query_id, query_vector of (query_id, question), by the encoder that made the stored vectors."""
    rows = questions.select("query_id", F.coalesce("question", F.lit("")).alias("question"))
    made = (
        hashing_vectors(rows, "question", dim) if make_encoder is None
        else encoded_vectors(rows, "question", make_encoder)
    )
    return made.select("query_id", F.col("vector").alias("query_vector"))


def search_text(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    kind: str | None = None,
    repo: str | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    dim: int = DIM,
) -> DataFrame:
    """The nearest rows of every question, asked as text."""
    return search_many(vectors, encode_questions(questions, make_encoder, dim), k, kind, repo)


# --- V4: context for a grounded answer ---

# Fixed value: what an answer says when nothing was found.
NO_HITS = "No matching artifacts were found, so there is nothing to ground an answer in."


def context(hits: DataFrame, queries: DataFrame, k: int = CONTEXT_K, chars: int | None = None) -> DataFrame:
    """Numbered context text per question: query_id, n_hits, context, note. ``chars`` bounds each text."""
    uri = F.when(F.col("object_uri") != "", F.concat(F.lit(" object_uri="), "object_uri")).otherwise("")
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] id="), F.col("id").cast("string"),
        F.lit(" kind="), "kind", F.lit(" source="), "source", uri,
        F.lit("\n    title: "), "title", F.lit("\n    text: "), text.clip(F.col("snippet"), chars),
    )
    blocks = (
        hits.filter(F.col("rank") <= k)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
        .select(
            "query_id",
            F.size("l").cast("long").alias("n_hits"),
            F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("context"),
        )
    )
    return (
        queries.select("query_id").join(blocks, "query_id", "left")
        .withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
        .withColumn("note", F.when(F.col("n_hits") == 0, NO_HITS))
    )
