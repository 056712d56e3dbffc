"""Joins on a range of time: rows of the same key that lie within some seconds of each other.

Time is cut into bins as wide as the range, so a row looks for its partners in few bins and both
sides meet by an equi-join on (key, bin). Where a bin of a key holds very many rows, as one of a busy
person does, its rows are tiled on both sides and each pair of tiles meets on its own, so no key and
no moment is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import materialize

# Rows of one side that a tile of a bin holds, about.
CELL = 4096


def _tiles(rows: DataFrame, key: Sequence[str], n: str, cell: int) -> DataFrame:
    """How many tiles each crowded (key, bin) has; those with one are left out."""
    counted = rows.groupBy(*key, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    return counted.filter(F.col("_rows") > cell).select(*key, "_bin", F.ceil(F.col("_rows") / cell).cast("int").alias(n))


def within(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    left_at: str,
    right_at: str,
    before: float,
    after: float,
    cell: int = CELL,
) -> DataFrame:
    """All pairs of rows with equal ``key`` whose right time is from ``before`` seconds before the left one to ``after`` seconds after it.

    Gives the columns of ``left`` and those of ``right`` besides the key, which must have names of their own.
    Null keys or times pair with nothing; ``before`` or ``after`` may be negative.
    """
    if before + after < 0:
        raise ValueError("the range is empty")
    start, end = -round(before * 1e6), round(after * 1e6)
    width = max(end - start, 1)
    keys = list(key)

    def bin_of(micros: Column) -> Column:
        return (micros - F.pmod(micros, F.lit(width))).cast("long")

    here, there = F.unix_micros(left_at), F.unix_micros(right_at)
    usable = F.lit(True)
    for c in keys:
        usable = usable & F.col(c).isNotNull()
    lefts = left.filter(usable & F.col(left_at).isNotNull())
    lefts = lefts.withColumn("_bin", F.explode(F.sequence(bin_of(here + start), bin_of(here + end), F.lit(width).cast("long"))))
    rights = right.filter(usable & F.col(right_at).isNotNull()).withColumn("_bin", bin_of(there))
    # Rows are numbered as they are written, so that equal rows are dealt apart and a repeated task deals alike.
    lefts = materialize(lefts.withColumn("_row", F.monotonically_increasing_id()), "range-left")
    rights = materialize(rights.withColumn("_row", F.monotonically_increasing_id()), "range-right")
    of_left, of_right = _tiles(lefts, keys, "_tl", cell), _tiles(rights, keys, "_tr", cell)
    tiles = of_left.join(of_right, [*keys, "_bin"], "full").fillna(1, ["_tl", "_tr"])
    tiles = materialize(tiles, "range-tiles")

    def dealt(rows: DataFrame, own: str, other: str, mine: str, yours: str) -> DataFrame:
        spread = rows.join(tiles, [*keys, "_bin"], "left").fillna(1, ["_tl", "_tr"])
        spread = spread.withColumn(mine, F.pmod(F.xxhash64("_row"), F.col(own)).cast("int"))
        return spread.withColumn(yours, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_tl", "_tr", "_row")

    a, b = dealt(lefts, "_tl", "_tr", "_i", "_j"), dealt(rights, "_tr", "_tl", "_j", "_i")
    pairs = a.join(b, [*keys, "_bin", "_i", "_j"]).filter((there >= here + start) & (there <= here + end))
    return pairs.select(*left.columns, *[c for c in right.columns if c not in keys])
