"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import materialize


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low"))


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of the links (u, v), the component being its least vertex.

    Alternates two steps until nothing changes: every vertex points its larger neighbours at its least
    one, then its smaller ones. The links shrink to stars in a number of rounds that grows with the
    logarithm of the vertices. Neighbours are never collected: a vertex with very many is one value
    of an aggregate that is combined before the shuffle. The least neighbours are written before they are
    joined, so that the engine sees two plain shuffles and can split a vertex that most links have.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(_least(both).withColumn("low", F.least("u", "low")), "least")
        links = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        links = materialize(links, "links")
        own = materialize(_least(links), "least")
        links = links.join(own, "u").select(F.explode(F.array(F.struct("u", "low"), F.struct(F.col("v").alias("u"), "low"))).alias("s"))
        links = links.select("s.u", F.col("s.low").alias("v")).where("u <> v").distinct()
        links = materialize(links, "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)


def dense_roots(linked: np.ndarray) -> np.ndarray:
    """The first member of the component of each member, from a symmetric table of flags."""
    root = np.full(len(linked), -1, np.int64)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        root[start] = start
        edge = np.array([start])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(0) & (root < 0))
            root[edge] = start
    return root


def tiled(rows: DataFrame, group: str, size: str, member: str, tile_rows: int) -> DataFrame:
    """Rows of groups of known ``size``, dealt to pairs of tiles (ti, tj), ti <= tj, so that any two rows of a group meet.

    A group of up to ``tile_rows`` is one tile; a row of a larger one goes to one pair for each tile of its group.
    """
    tiles = F.ceil(F.col(size) / tile_rows).cast("int")
    rows = rows.withColumn("tile", F.when(tiles > 1, F.pmod(F.xxhash64(member), tiles).cast("int")).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return rows.withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other")).drop("other", size)
