"""Approximate cosine search over an index of inverted lists, stored as a table partitioned by list.

The centres of the lists are fitted on a bounded sample; every row is then put into the list of its nearest
centre. A query reads the lists of its ``probes`` nearest centres only: other partitions of the
table are not opened. A list with very many rows (copies of one vector) is searched as several tiles.

How many lists have to be probed depends on the vectors. ``calibrate`` finds the least number that reaches a
wanted recall, by exact answers for a bounded sample of rows; ``touched`` says what share of the rows each
query meets, ``recall`` compares answers with exact ones. Probing all lists is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.operators import vectors
from loomwork.operators.vectors import HIT_COLUMNS, MAX_QUERIES, RANK_DECIMALS, TILE_ROWS, TOP_K
from loomwork.session import materialize

# Rows that centres are fitted on, rows that recall is calibrated on, and the most lists.
FIT_ROWS, CALIBRATION_ROWS, MAX_LISTS = 65_536, 256, 4096
TARGET_RECALL = 0.97


def _sample(rows: DataFrame, n: int, salt: int) -> DataFrame:
    """``n`` rows by the hash of their id: the same ones in every run, spread over all of them."""
    return rows.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n)


def _length(column: str):
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _fit(rows: DataFrame, lists: int) -> np.ndarray:
    """Unit centres, one for each list; at most ``lists``."""
    usable = _sample(rows.filter(_length("vector") > 0), FIT_ROWS, 1).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    usable = materialize(usable, "index-sample")
    if usable.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=lists, maxIter=10, seed=7, distanceMeasure="cosine").fit(usable) if lists > 1 else None
    found = np.array(model.clusterCenters()) if model else usable.first()["features"].toArray()[None, :]
    return vectors._unit(found)


def _with_lists(column: str, centres: np.ndarray, probes: int):
    """Map step: adds ``lists``, those of the nearest centres, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index(column))
            near = np.zeros((len(values), 1))  # without a vector to fit on there is one list
            if centres.any():
                near = vectors._unit(vectors._matrix(values, centres.shape[1])) @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            offsets = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    return run


def _assigned(rows: DataFrame, column: str, centres: np.ndarray, probes: int) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_with_lists(column, centres, probes), schema)


class VectorIndex:
    """A stored index: ``rows`` (row, id, vector, shown columns, list) and ``lists`` (list, centre, n)."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | None = None) -> None:
        """``schema`` is that of the rows without ``list``; a folder without rows has none of its own."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T.StructType([*schema.fields, T.StructField("list", T.IntegerType())]) if schema else None

    @property
    def rows(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(f"{self.folder}/rows")

    @property
    def lists(self) -> DataFrame:
        """At most ``MAX_LISTS`` rows."""
        return self.spark.read.parquet(f"{self.folder}/lists")

    def centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self.lists.select("list", "centre").orderBy("list").collect()])


def build(rows: DataFrame, folder: str, lists: int | None = None) -> VectorIndex:
    """Index all rows that have a vector. By default there are as many lists as the root of the number of rows."""
    spark = rows.sparkSession
    stored = materialize(vectors._candidates(rows, None, None).withColumn("row", F.monotonically_increasing_id()), "indexed")
    if lists is None:
        lists = int(np.sqrt(stored.count()))
    centres = _fit(stored, min(max(lists, 1), MAX_LISTS))
    placed = _assigned(stored, "vector", centres, 1).withColumn("list", F.col("lists")[0]).drop("lists")
    placed = materialize(placed, "indexed")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    writer = placed.hint("rebalance", "list").write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("list").parquet(f"{folder}/rows")
    shown = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    counted = shown.join(sizes, "list", "left").select("list", "centre", F.coalesce("n", F.lit(0)).alias("n"))
    counted.write.parquet(f"{folder}/lists", mode="overwrite")
    return VectorIndex(spark, folder, stored.schema)


def probed(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, query_vector, place and list: the lists that each query reads, the nearest first (place 1)."""
    usable = queries.select("query_id", "query_vector").filter(F.size("query_vector") > 0)
    found = _assigned(usable, "query_vector", index.centres(), probes)
    return found.select("query_id", "query_vector", F.posexplode("lists").alias("at", "list")).withColumn("place", F.col("at") + 1).drop("at")


def touched(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, rows and share: how many rows of the index each query meets."""
    total = index.lists.agg(F.sum("n")).first()[0]
    met = probed(index, queries, probes).join(F.broadcast(index.lists.select("list", "n")), "list")
    return met.groupBy("query_id").agg(F.sum("n").alias("rows")).withColumn("share", F.col("rows") / F.lit(max(total, 1)))


def search(
    index: VectorIndex,
    queries: DataFrame,
    probes: int,
    k: int = TOP_K,
    kind: str | None = None,
    repo: str | None = None,
    max_queries: int = MAX_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Near rows of every query (query_id, query_vector), like ``vectors.search_many``, from the probed lists."""
    asked = materialize(probed(index, queries, probes), "index-queries")
    tiles = F.greatest(F.ceil(F.col("n") / tile_rows), F.lit(1)).cast("int")
    before = Window.orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    cut = index.lists.select("list", "n", tiles.alias("tiles")).withColumn("first", F.coalesce(F.sum("tiles").over(before), F.lit(0)))
    cut = materialize(cut, "index-lists")  # at most MAX_LISTS rows, hence the broadcasts
    rows = index.rows
    for name, value in (("kind", kind), ("repo", repo)):
        if value:
            rows = rows.filter(F.col(name) == value)
    wanted = F.broadcast(asked.select("list").distinct())
    none = {n: F.lit(None).cast(t) for n, t in [*rows.select("row", "id", "vector").dtypes, *asked.select("query_id", "query_vector").dtypes]}
    of_rows = rows.select("list", "row", "id", "vector").join(wanted, "list", "left_semi").join(F.broadcast(cut), "list").select(
        (F.col("first") + F.pmod(F.xxhash64("row"), F.col("tiles"))).cast("int").alias("tile"), F.lit(0).alias("part"),
        "row", "id", "vector", *[none[c].alias(c) for c in ("query_id", "query_vector")],
    )
    blocks = max(1, -(-asked.count() // max(max_queries, 1) // max(cut.count(), 1)))
    of_queries = asked.join(F.broadcast(cut), "list").select(
        F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("tiles") - 1).cast("int"))).alias("tile"),
        (F.pmod(F.xxhash64("query_id", "query_vector"), F.lit(blocks)) + 1).cast("int").alias("part"),
        *[none[c].alias(c) for c in ("row", "id", "vector")], "query_id", "query_vector",
    )
    dealt = of_rows.unionByName(of_queries).repartition("tile").sortWithinPartitions("tile", "part")
    fields = [asked.schema["query_id"], T.StructField("row", T.LongType()), rows.schema["id"], T.StructField("raw", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    best = Window.partitionBy("query_id").orderBy(F.round("raw", RANK_DECIMALS).desc(), "id", "row")
    return (
        dealt.mapInArrow(vectors._tile_hits(k, to_arrow_schema(schema)), schema)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .join(index.rows.select("row", *HIT_COLUMNS), "row")
        .withColumn("score", F.round(F.greatest("raw", F.lit(0.0)), 4))
        .select("query_id", "rank", "id", "score", *HIT_COLUMNS)
    )


def calibrate(index: VectorIndex, k: int = TOP_K, target: float = TARGET_RECALL, rows: int = CALIBRATION_ROWS) -> int:
    """The least number of probes with which a sample of ``rows`` stored vectors finds ``target`` of its exact hits."""
    lists = index.lists.count()
    sample = materialize(_sample(index.rows.select("id", "vector"), rows, 2).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "calibration")
    exact = vectors.search_many(index.rows.withColumnRenamed("snippet", "text"), sample, k).select("query_id", "id")
    at = index.rows.select("id", "list").join(exact, "id")
    places = probed(index, sample, lists).select("query_id", "list", "place")
    found = at.join(places, ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # one row per list
    total, seen = sum(r["n"] for r in found), 0
    for row in found:
        seen += row["n"]
        if seen >= target * total:
            return row["place"]
    return lists


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, hits and found: how many exact hits each query has and how many of them were found."""
    same = found.select("query_id", "id").withColumn("same", F.lit(1))
    both = exact.select("query_id", "id").join(same, ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.count("same").alias("found"))
