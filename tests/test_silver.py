from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork.operators import incremental, silver
from loomwork.schemas import ARTIFACTS, EDGES

COMMITS = "repo string, sha string, actor string, authored_at timestamp, message string, branch string, changed array<string>"


@pytest.fixture(scope="module")
def log(spark):
    wide = [f"w{i}.py" for i in range(26)]
    edge = [f"e{i}.py" for i in range(25)]
    data = [
        ("r", "c1", "Ann <a@x>", naive(2024, 1, 1), "add parser\n\nbody", "main", ["a.py", "b.py", "gone.py"]),
        ("r", "c2", "Bob <b@x>", naive(2024, 1, 3), "  ", "main", ["a.py", "b.py"]),
        ("r", "c3", None, naive(2024, 1, 2), "wide", "main", wide),
        ("r", "c4", "Ann <A@X>", naive(2024, 1, 4), "edge", "main", edge),
        ("s", "c1", "Ann <a@x>", naive(2024, 1, 5), "other repo", "main", ["a.py"]),
        ("r", "c5", "Bob <b@x>", naive(2024, 1, 6), "empty", "main", []),
    ]
    commits = spark.createDataFrame(data, COMMITS)
    paths = [("r", p) for p in ["a.py", "b.py", "new.py", *wide, *edge]] + [("s", "a.py")]
    tree = spark.createDataFrame(paths, "repo string, path string").withColumn(
        "head_at", F.lit("2024-02-01").cast("timestamp")
    )
    return commits, tree


def fid(spark, repo, path):
    return spark.range(1).select(silver.ids.file_id(F.lit(repo), F.lit(path))).first()[0]


def test_commit_artifacts(log):
    df = silver.commit_artifacts(log[0])
    assert df.schema.names == ARTIFACTS.names
    got = {(r["repo"], r["content_hash"]): r for r in df.collect()}
    assert got["r", "c1"]["title"] == "add parser" and got["r", "c1"]["text"] == "add parser\n\nbody"
    # A blank message falls back to the short sha, as title and as text.
    assert got["r", "c2"]["title"] == got["r", "c2"]["text"] == "c2"
    assert len({r["id"] for r in got.values()}) == 6


def test_latest_commits(log):
    assert rows(silver.latest_commits(log[0], 2), "repo", "sha") == [("r", "c4"), ("r", "c5"), ("s", "c1")]


def test_authored_needs_an_author(log):
    df = silver.authored_commits(log[0])
    assert df.count() == 5 and df.select("src_id").distinct().count() == 2


def test_edges_only_reach_current_files(spark, log):
    present = silver.present_touches(silver.touches_of(log[0]), log[1])
    assert present.count() == 2 + 2 + 26 + 25 + 1
    assert present.filter(F.col("file_id") == fid(spark, "r", "gone.py")).count() == 0
    assert silver.modified(present).schema.names == EDGES.names


def test_co_edits_and_the_fan_out_bound(spark, log):
    present = silver.present_touches(silver.touches_of(log[0]), log[1])
    pairs = silver.co_edited(present).collect()
    a, b = sorted((fid(spark, "r", "a.py"), fid(spark, "r", "b.py")))
    by_pair = {(p["src_id"], p["dst_id"]): p for p in pairs}
    assert by_pair[a, b]["weight"] == 2.0 and by_pair[a, b]["created_at"] == naive(2024, 1, 3)
    edge = sorted(fid(spark, "r", f"e{i}.py") for i in range(25))
    assert set(by_pair) == {(a, b), *combinations(edge, 2)}
    assert silver.co_edit_skipped(present).first()["skipped"] == 1


def test_last_touch_defaults_to_head(log):
    got = {r["path"]: r["last_touch"] for r in silver.last_touch(silver.touches_of(log[0]), log[1]).filter("repo = 'r'").collect()}
    assert got["a.py"] == naive(2024, 1, 3) and got["new.py"] == naive(2024, 2, 1)


def test_distinct_titles_newest_first(spark):
    data = [("r", f"c{i}", "x", naive(2024, 1, 1 + i), f"title {i % 13}", "m", ["f"]) for i in range(26)]
    commits = spark.createDataFrame(data, COMMITS)
    tree = spark.createDataFrame([("r", "f")], "repo string, path string")
    present = silver.present_touches(silver.touches_of(commits), tree)
    got = silver.recent_titles(present, commits).first()["titles"]
    assert got == [f"title {i % 13}" for i in range(25, 12, -1)]
    assert silver.recent_titles(present, commits, 10).first()["titles"] == got[:10]


def test_file_text_lists_commits(spark):
    files = spark.createDataFrame(
        [("r", "f", naive(2024, 1, 1), "says", "h", None, "{}")],
        "repo string, path string, created_at timestamp, said string, content_hash string, object_uri string, extra string",
    )
    titles = spark.createDataFrame([(fid(spark, "r", "f"), ["t1", "t2"])], "file_id string, titles array<string>")
    assert silver.file_artifacts(files, titles).first()["text"] == (
        "f\n\nsays\n\nCommits that touched this file:\n- t1\n- t2"
    )
    assert silver.file_artifacts(files).first()["text"] == "f\n\nsays"


def test_first_version_wins(spark, log):
    arts = silver.commit_artifacts(log[0])
    assert incremental.new_artifacts(arts, arts).count() == 0
    edited = arts.withColumn("content_hash", F.lit("other"))
    assert incremental.new_artifacts(edited, arts).count() == 0
    assert incremental.new_artifacts(edited, arts, mode="latest").count() == 6
    assert incremental.new_artifacts(arts.unionByName(edited), arts.limit(0)).count() == 6


def test_many_copies_of_one_id(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.timestamp_seconds(F.col("id")).alias("created_at"), F.col("id").cast("string").alias("content_hash"),
    )
    got = incremental.new_artifacts(df, df.limit(0))
    assert got.count() == 5000 - 1667 + 1
    assert got.filter("id = 'hot'").first()["content_hash"] == "0"


def test_edge_upsert_takes_the_new_weight(spark):
    old = spark.createDataFrame([("a", "b", "co_edited", 1.0, None), ("a", "c", "co_edited", 3.0, None)], EDGES)
    new = spark.createDataFrame([("a", "b", "co_edited", 2.0, naive(2024, 1, 1)), ("x", "y", "modified", 1.0, None)], EDGES)
    got = rows(incremental.upsert_edges(old, new), "src_id", "dst_id", "weight")
    assert got == [("a", "b", 2.0), ("a", "c", 3.0), ("x", "y", 1.0)]
    assert rows(incremental.changed_edges(old, old)) == []
