"""Numbers without gaps within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: str, turn: str, buckets: Column, slot: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    ``rows`` is a stored table and ``turn`` different for each of its rows. Rows of a group are dealt to
    ``buckets`` by their turn; a row's number is the number of rows in earlier buckets plus its place
    in its own, so no group is sorted in one task.
    """
    bucket = f"{slot}__bucket"
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(turn), buckets))
    sizes = dealt.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{slot}__before"))
    own = Window.partitionBy(group, bucket).orderBy(turn)
    return (
        dealt.withColumn(slot, F.row_number().over(own).cast("long") - 1)
        .join(sizes, [group, bucket])
        .withColumn(slot, F.col(slot) + F.col(f"{slot}__before"))
        .select(*rows.columns, slot)
    )
