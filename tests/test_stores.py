"""Lake, console, quality and history."""

import pytest
from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork import schemas
from loomwork.operators import blobs, console, history, quality
from loomwork.plans import pipeline
from loomwork.sources import registry
from loomwork.sources.lake import Lake, detail, lookup


def arts(spark, *ids, text="x", day=1, kind="file"):
    data = [(i, kind, "git", "r", None, naive(2024, day, 1), i, text, text, None, "{}") for i in ids]
    return spark.createDataFrame(data, schemas.ARTIFACTS)


def edges(spark, *rows_):
    return spark.createDataFrame([(*r, None) for r in rows_], schemas.EDGES)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def test_nothing_stored_yet(lake):
    assert lake.artifacts().count() == 0 and lake.artifacts().schema.names == schemas.ARTIFACTS.names
    assert lake.edges().count() == 0 and lake.new_batch() != lake.new_batch()
    for name, schema in schemas.GOLD.items():
        assert lake.gold(name).schema.names == schema.names and lake.gold(name).count() == 0
    panels = pipeline.dashboard(lake)
    assert panels["top_authors"].count() == 0 and panels["edges_total"].first()["n"] == 0
    assert panels["cross_silo"].count() == 0 and panels["hotspots"].count() == 0


def test_append_is_idempotent(spark, lake):
    assert lake.append_artifacts(arts(spark, "a", "b"), "0") == 2
    assert lake.append_artifacts(arts(spark, "b", "c", text="new"), "1") == 1
    assert lake.append_artifacts(arts(spark, "a", "b", "c"), "2") == 0
    # A repeated batch adds nothing.
    assert lake.append_artifacts(arts(spark, "b", "c", text="again"), "1") == 0
    assert {r["id"]: r["text"] for r in lake.artifacts().collect()} == {"a": "x", "b": "x", "c": "new"}
    got = [(r["snapshot_id"], r["added_records"], r["total_records"]) for r in lake.snapshots().orderBy("total_records").collect()]
    assert got == [("0", 2, 2), ("1", 1, 3)]


def test_writers_that_interleave_lose_nothing(spark, lake):
    """A stream's epochs and syncs between them; batches have names of their own."""
    lake.append_artifacts(arts(spark, "s0"), "stream-0")
    lake.append_artifacts(arts(spark, "sync1", "sync2"), lake.new_batch())
    lake.append_artifacts(arts(spark, "s1"), "stream-1")
    lake.append_artifacts(arts(spark, "s1", "s2"), "stream-1")  # the epoch is tried again with one row more
    assert [r[0] for r in rows(lake.artifacts(), "id")] == ["s0", "s1", "s2", "sync1", "sync2"]


def test_writers_that_add_one_id_at_the_same_time(spark, lake, monkeypatch):
    """Neither sees the other's rows while it decides what is new; readers show the first."""
    from datetime import datetime, timezone

    from loomwork.operators import incremental

    plain = incremental.new_artifacts
    monkeypatch.setattr(incremental, "new_artifacts", lambda batch, existing, mode: plain(batch, existing.limit(0), mode))
    late, early = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (2, 1))
    assert lake.append_artifacts(arts(spark, "a", "b", text="late"), "x", at=late) == 2
    assert lake.append_artifacts(arts(spark, "a", "c", text="early"), "y", at=early) == 2 - 1
    assert {r["id"]: r["text"] for r in lake.artifacts().collect()} == {"a": "early", "b": "late", "c": "early"}
    assert lake.existing_ids().count() == lake.artifacts().count() == 3


def test_a_failed_append_leaves_nothing(spark, lake):
    lake.append_artifacts(arts(spark, "a"), "0")
    broken = arts(spark, "z").withColumn("title", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        lake.append_artifacts(broken, "1")
    lake.append_artifacts(arts(spark, "b", day=2), "1")
    assert rows(lake.artifacts(), "id") == [("a",), ("b",)]


def test_latest_mode_and_as_of(spark, lake):
    lake.append_artifacts(arts(spark, "a", text="v1"), "0")
    cut = lake.log("artifacts").first()["committed_at"]
    lake.append_artifacts(arts(spark, "a", text="v2"), "1", mode="latest")
    assert lake.artifacts(mode="latest").first()["text"] == "v2"
    assert rows(lake.artifacts(as_of=str(cut)), "text") == [("v1",)]


def test_months_are_partitions(spark, lake):
    lake.append_artifacts(arts(spark, "a", day=1).unionByName(arts(spark, "b", day=2)), "0")
    old = arts(spark, "old").withColumn("created_at", F.lit("2023-05-01").cast("timestamp"))
    lake.append_artifacts(old, "1")
    recent = lake.artifacts(since="2024-01-01")
    assert rows(recent, "id") == [("a",), ("b",)]
    assert "PartitionFilters: [isnotnull(created_month" in recent._jdf.queryExecution().toString()
    assert lake.get_artifact("a").count() == 1 and lookup(lake.artifacts(), []).count() == 0


def test_edges_keep_one_row_per_key(spark, lake):
    assert lake.append_edges(edges(spark, ("a", "b", "co_edited", 1.0), ("a", "b", "co_edited", 1.0)), "0") == 1
    assert lake.append_edges(edges(spark, ("a", "b", "co_edited", 1.0)), "1") == 0
    assert lake.append_edges(edges(spark, ("a", "b", "co_edited", 4.0)), "2") == 1
    assert rows(lake.edges(), "src_id", "weight") == [("a", 4.0)]
    # Any relation may be sent again, with another weight or with none.
    assert lake.append_edges(edges(spark, ("p", "q", "authored", 1.0), ("r", "s", "authored", None)), "3") == 2
    assert lake.append_edges(edges(spark, ("p", "q", "authored", 2.0), ("r", "s", "authored", None)), "4") == 1
    assert rows(lake.edges(), "src_id", "weight") == [("a", 4.0), ("p", 2.0), ("r", None)]


def test_gold_is_overwritten(spark, lake):
    name = "gold_daily_activity"
    for n in (1, 2):
        df = spark.createDataFrame([("d", "git", "file", n)] * n, schemas.GOLD[name])
        assert lake.overwrite_gold(name, df).count() == n


def test_blobs(spark):
    files = spark.createDataFrame(
        [(bytearray(b"x"), "b é.txt"), (bytearray(b"x"), "a/1*~.txt"), (bytearray(b"y"), "y")], "bytes binary, filename string"
    )
    none = spark.createDataFrame([], "content_hash string")
    put = blobs.put(files, none, "work")
    assert sorted(r["filename"] for r in put.collect()) == ["a/1%2A~.txt", "y"]
    assert blobs.put(files, put.select("content_hash"), "work").count() == 0
    uri = put.filter("filename = 'y'").first()["object_uri"]
    assert bytes(blobs.fetch(put, uri).first()["bytes"]) == b"y" and blobs.exists(put, uri)
    for bad in ("http://x/y", "s3://", "s3://bucket", "s3:///key"):
        with pytest.raises(ValueError):
            blobs.fetch(put, bad)
    behind = arts(spark, "a").withColumn("object_uri", F.lit(uri))
    assert rows(blobs.resolve(behind, put), "id", "size") == [("a", 1)]
    plan = blobs.resolve(behind, put.select("object_uri", "size"))
    assert plan.count() == 1


def test_detail(spark):
    a = arts(spark, "a").withColumn("object_uri", F.lit("s3://w/blobs/h")).unionByName(arts(spark, "b"))
    got = {r["id"]: r for r in detail(a).collect()}
    assert got["a"]["raw_url"] == "/artifact/a/raw" and got["a"]["created_at"] == "2024-01-01T00:00:00+00:00"
    assert got["b"]["raw_url"] is None and not got["b"]["has_blob"]


def test_registry(spark, tmp_path):
    at = str(tmp_path / "sources")
    assert registry.load(spark, at).count() == 0
    registry.add(spark, at, "/a/../b", "folder")
    registry.add(spark, at, "/c", "repo")
    assert rows(registry.add(spark, at, "/b", "repo")) == [("/b", "folder"), ("/c", "repo")]
    assert rows(registry.remove(spark, at, "/b")) == [("/c", "repo")]
    bad = tmp_path / "bad"
    bad.write_text("{oops")
    assert registry.load(spark, str(bad)).count() == 0


# --- console ---


def test_console(spark):
    console.register({"artifacts": spark.range(20).selectExpr("id", "date'2024-01-01' AS d", "array(id) AS l")})
    page = console.run_sql(spark, "  SELECT id, d, l FROM artifacts ORDER BY id DESC ; ", limit=2)
    assert page["columns"] == ["id", "d", "l"] and page["row_count"] == 2
    assert page["rows"] == [[19, "2024-01-01", "[19]"], [18, "2024-01-01", "[18]"]]
    assert console.run_sql(spark, "WITH x AS (SELECT 1 AS one) SELECT one FROM x")["rows"] == [[1]]
    assert "artifacts" in console.tables(spark)


@pytest.mark.parametrize("sql", ["", None, "DROP TABLE artifacts", "insert into artifacts select 1", "SELEC 1",
                                 "WITH x AS (SELECT 1) INSERT INTO artifacts SELECT * FROM x", "SELECT nope FROM artifacts",
                                 "SELECT TRANSFORM(id) USING 'echo x' AS (x) FROM artifacts", "SELECT * FROM parquet.`/tmp`",
                                 "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT * FROM other",
                                 "SELECT java_method('java.lang.System', 'nanoTime')",
                                 "SELECT 1 WHERE EXISTS (SELECT * FROM text.`/etc/hosts`)"])
def test_console_refuses(spark, sql):
    console.register({"artifacts": spark.range(1)})
    with pytest.raises(ValueError):
        console.run_sql(spark, sql)


def test_console_top_rows_are_planned_as_top_k(spark):
    console.register({"artifacts": spark.range(100)})
    plan = console.query(spark, "SELECT id FROM artifacts ORDER BY id DESC", 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


# --- quality, history ---


def test_quality(spark):
    a = arts(spark, "a", "", kind="file").unionByName(arts(spark, "m", kind="memo"))
    e = edges(spark, ("a", "m", "modified", 1.0), ("person:x", "gone", "authored", 1.0), ("lost", "gone", "likes", 1.0),
              ("topic:t", "a", "about", 1.0))
    assert tuple(quality.well_formed(a).first()) == (1, 1, 3)
    assert rows(quality.enum_violations(a, e)) == [("kind", "memo", 1), ("relation", "about", 1), ("relation", "likes", 1)]
    assert tuple(quality.enum_counts(a, e).first()) == (1, 0, 2)
    assert tuple(quality.referential_integrity(a, e).first()) == (2, 4)
    with pytest.raises(quality.QualityError, match="memo"):
        quality.require_enums(a, e)
    good = arts(spark, "a"), edges(spark, ("a", "a", "modified", 1.0))
    quality.require_enums(*good)
    got = quality.embedding_coverage(a, arts(spark, "a")).first()
    assert (got["artifacts"], got["embedded"], got["passed"]) == (3, 1, False)


def test_history(spark):
    log = spark.createDataFrame(
        [(i, naive(2024, 1, 1 + i), i + 1) for i in range(10)], "batch_id long, committed_at timestamp, added long"
    )
    got = history.recent(history.snapshots(log)).collect()
    assert [r["snapshot_id"] for r in got] == [9, 8, 7, 6, 5, 4, 3, 2]
    assert got[0]["total_records"] == 55 and got[-1]["total_records"] == 6
    assert history.as_of(log, F.col("committed_at"), "2024-01-03").count() == 3


def test_bad_rows_are_set_apart_and_the_load_goes_on(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    data = [("a", "file", "git", naive(2024, 1, 1)), (None, "file", "git", naive(2024, 1, 1)), ("b", "image", "git", None),
            ("c", "commit", None, naive(2024, 1, 1)), ("d", "commit", "git", naive(2024, 2, 1))]
    batch = spark.createDataFrame(data, "id string, kind string, source string, created_at timestamp")
    assert lake.append_checked(batch, "one") == 2 and rows(lake.artifacts().select("id")) == [("a",), ("d",)]
    reasons = rows(lake.quarantine().select("id", "reason"))
    assert reasons == sorted([(None, "no id"), ("b", "kind image; no time"), ("c", "source missing")], key=repr)
    assert lake.append_checked(batch.filter("id = 'd'"), "two") == 0 and lake.quarantine().count() == 3


def test_appends_count_what_they_write(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    edges = spark.createDataFrame([("a", str(i), "modified" if i % 3 else "authored", 1.0, None) for i in range(9)], schemas.EDGES)
    assert lake.append_edges(edges, "one") == 9 and lake.append_edges(edges, "two") == 0
    assert lake.note_metrics() == 12 and lake.note_metrics() == 0
    found = {(r["batch_id"], r["metric"]): r["value"] for r in lake.run_metrics().collect()}
    assert found["one", "rows"] == 9 and found["one", "relation:modified"] == 6 and found["one", "relation:co_edited"] == 0
    assert found["two", "rows"] == 0


def test_a_lookup_by_id_skips_row_groups(spark, tmp_path):
    """Ids are digests, so only order within files and Bloom filters tell row groups apart."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    lake, n = Lake(spark, str(tmp_path / "lake")), 40_000
    data = spark.range(n).selectExpr("sha2(CAST(id AS STRING), 256) AS id", "'file' AS kind", "'git' AS source", "TIMESTAMP'2024-01-01' AS created_at")
    conf.set("parquet.block.size", str(128 * 1024))
    try:
        lake.append_artifacts(data, "one")
    finally:
        conf.unset("parquet.block.size")
    wanted = data.first()["id"]
    found = spark.read.parquet(f"{lake.root}/artifacts").filter(F.col("id") == wanted)
    assert found.count() == 1

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return (leaf.executedPlan().collectLeaves().head() if "AdaptiveSparkPlan" in leaf.nodeName() else leaf).metrics().apply("numOutputRows").value()

    assert scanned(found.select("title")) < n / 4
    absent = spark.read.parquet(f"{lake.root}/artifacts").filter(F.col("id") == wanted[:-1] + "x")
    assert scanned(absent.select("title")) == 0
