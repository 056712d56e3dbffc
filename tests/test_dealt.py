"""How often rows are dealt, and what is left on disk when a write has ended."""

import time

import pytest
from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork import schemas
from loomwork.functions import ids
from loomwork.operators import incremental, maintained, silver
from loomwork.session import materialize
from loomwork.sources.lake import VERSION, Lake


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_write_leaves_no_files_of_its_shuffles(spark, tmp_path):
    before = shuffle_files(spark)
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count()
    table = materialize(kept, "t")
    Lake(spark, str(tmp_path / "lake")).append_edges(table.select(F.col("x").cast("string").alias("src_id"), F.lit("b").alias("dst_id"), F.lit("authored").alias("relation")), "0")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 7
    # A frame that was written may be read again.
    assert kept.count() == 7 and materialize(kept, "t").count() == 7


def test_packed_columns_cannot_be_null_and_come_back(spark):
    names = [f"file:{'0123456789' * 4}", f"person:{'ab' * 20}", "x" * 39, "", "topic:red", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("id", F.col("n"))
    packed = ids.pack(df, "id")
    assert not packed.schema["id"].nullable
    back = ids.unpack(packed, "id").collect()
    assert [r["id"] for r in back] == [r["n"] for r in back] == names
    # No filter is pushed below a join on such a column.
    plan = packed.join(packed.select("id"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull" not in plan


EDGES = "src_id string, dst_id string, relation string, weight double, created_at timestamp"


def log_rows(spark, given):
    """Edges of several appends: (src, dst, weight, day, append)."""
    data = [(a, b, "co_edited", w, d and naive(2024, 1, d), naive(2024, 2, n), str(n)) for a, b, w, d, n in given]
    return spark.createDataFrame(data, f"{EDGES}, appended_at timestamp, batch_id string")


def packed(edges):
    return ids.pack(edges, "src_id", "dst_id").withColumn("relation", F.coalesce("relation", F.lit("")))


def test_a_batch_meets_the_log_as_it_meets_the_newest_edges(spark):
    log = log_rows(spark, [("a", "b", 1.0, 1, 1), ("a", "b", 2.0, 2, 2), ("a", "c", None, None, 1), ("a", "d", 3.0, 1, 1), (None, "d", 1.0, 1, 1)])
    sent = [("a", "b", 2.0, 2), ("a", "b", 1.0, 1), ("a", "c", None, None), ("a", "d", 3.0, 2), ("a", "e", 1.0, None), (None, "d", 1.0, 1)]
    batch = spark.createDataFrame([(a, b, "co_edited", w, d and naive(2024, 1, d)) for a, b, w, d in sent], EDGES)
    got = incremental.edges_to_append(packed(log), packed(batch), F.struct(*VERSION))
    assert rows(ids.unpack(got, "src_id", "dst_id"), "dst_id", "weight") == [("d", 3.0), ("e", 1.0)]
    keys, batch_keys = (e.filter("src_id IS NOT NULL") for e in (log, batch))
    old = incremental.changed_edges(incremental.current_edges(keys, F.struct(*VERSION)), batch_keys)
    assert rows(old) == rows(ids.unpack(got, "src_id", "dst_id"))


def exchanges(df):
    """Shuffles that a finished plan ran, and those it read again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("== Initial Plan ==")]
    return plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange"), plan.count("ReusedExchange")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_append_deals_its_batch_and_the_log_once(spark, tmp_path, no_broadcast):
    log = materialize(log_rows(spark, [(str(n), "b", 1.0, 1, 1) for n in range(50)]), "log")
    batch = materialize(spark.createDataFrame([(str(n), "b", "co_edited", 1.0, naive(2024, 1, 1)) for n in range(60)], EDGES), "batch")
    got = incremental.edges_to_append(packed(log), packed(batch), F.struct(*VERSION))
    assert exchanges(got) == (2, 1) and len(got.collect()) == 10


def test_new_touches_deal_each_table_once(spark, no_broadcast):
    schema = "commit_id string, file_id string, created_at timestamp"
    known = materialize(spark.createDataFrame([("c", str(n), naive(2024, 1, 1)) for n in range(20)] + [(None, "x", None)], schema), "known")
    more = [("c", str(n), naive(2024, 1, 2) if n % 2 else None) for n in range(30)] + [(None, "x", None)]
    got = maintained.new_touches(known, materialize(spark.createDataFrame(more, schema), "present"))
    assert exchanges(got) == (2, 1)
    assert rows(got, "commit_id", "file_id") == sorted(("c", str(n)) for n in range(20, 30))


def test_pairs_of_ids_that_differ_in_kind_keep_the_order_of_their_names(spark):
    """Ends are compared as bytes on the way, where a digest and another name stand in another order."""
    digest = "z:" + "0" * 40
    schema = "commit_id string, file_id string, created_at timestamp"
    fresh = spark.createDataFrame([("c", f, naive(2024, 1, 1)) for f in (digest, "a")], schema)
    none = schemas.empty(spark, schemas.FACTS["touches"])
    stored = spark.createDataFrame([("a", digest, "co_edited", 4.0, naive(2023, 1, 1))], schemas.EDGES)
    got = maintained.co_edit_changes(none, fresh, stored)
    assert rows(got, "src_id", "dst_id", "weight") == [("a", digest, 5.0)]
    assert rows(silver.co_edited(fresh), "src_id", "dst_id") == [("a", digest)]
