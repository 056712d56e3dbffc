"""What a query leaves out of its plan, and counts that do not form what they count."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomwork.functions import ids
from loomwork.operators import graph, incremental, marts, quality, silver, topics
from loomwork.plans import bindings
from loomwork.plans.bindings import Tables
from loomwork.session import tune

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_readers_of_one_relation_pair_no_files(spark):
    t = Tables(tune(spark), SF)
    assert "Generate posexplode" in plan(t.edges)
    assert "Generate posexplode" not in plan(t.edges.filter("relation = 'authored'"))
    commits = plan(t.artifacts.filter("kind = 'commit'").select("id"))
    assert "collect_list" not in commits and "input_tree" not in commits


def test_touches_are_kept_by_their_keys(spark):
    t = Tables(tune(spark), SF)
    assert set(t.present_keys.columns) == {"repo", "sha", "path", "created_at"}
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "zstd"


def test_pairs_by_key_are_the_pairs_by_id(spark):
    rng = random.Random(3)
    rows = {(rng.choice("rs"), f"c{rng.randrange(30)}", f"f{rng.randrange(12)}", i % 5) for i in range(300)}
    keys = spark.createDataFrame(sorted(rows), "repo string, sha string, path string, n int").groupBy("repo", "sha", "path").agg(
        F.timestamp_seconds(F.max("n")).alias("created_at")
    )
    for bound in (25, 4):
        by_id = silver.co_edited(silver.touch_ids(keys), bound)
        by_key = silver.key_pair_edges(silver.co_edit_key_counts(keys, bound))
        assert by_id.count() > 0
        assert sorted(map(tuple, by_id.collect())) == sorted(map(tuple, by_key.collect()))


def test_pairs_of_people_are_counted_without_pairs_of_sets(spark):
    rng = random.Random(5)
    for bits in (1, 2, 9, 24):
        masks = [rng.getrandbits(bits) & rng.getrandbits(bits) for _ in range(60)] * 2
        people = spark.createDataFrame([(f"p{i}", m) for i, m in enumerate(masks)], "node string, mask long").filter("mask <> 0")
        sizes = marts.set_sizes(people)
        for shared in (1, 2, 3):
            want = sum(
                (a & b).bit_count() >= shared for i, a in enumerate(masks) for b in masks[:i]
            )
            got = marts.cross_silo_size(sizes, shared, bits=bits) if shared <= bits else None
            assert got is None or got.first()["rows"] == want
    assert "Join" not in plan(marts.shared_powers(sizes, 24))
    many = spark.createDataFrame([(3, 3_000_000_000), (1, 7)], "mask long, n long")
    assert marts.cross_silo_size(many, 2, bits=2).first()["rows"] == 3_000_000_000 * 2_999_999_999 // 2


def test_dangling_edges_are_looked_up_unexploded(spark):
    artifacts = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    edges = spark.createDataFrame(
        [("a", "b", "r"), ("a", "x", "r"), ("a", "x", "r"), ("y", "x", "r"), ("person:1", "b", "r"), ("person:1", "z", "r"), (None, "b", "r"), ("b", None, "q")],
        "src_id string, dst_id string, relation string",
    )
    got = quality.dangling_edges(artifacts, edges)
    assert sorted(map(tuple, got.collect())) == [("a", "x", "r"), ("person:1", "z", "r"), ("y", "x", "r")]
    assert "Generate" not in plan(got)


def test_changed_edges_meet_the_stored_ones_once(spark):
    at = F.timestamp_seconds(F.lit(0)).alias("created_at")
    old = spark.createDataFrame([("a", "b", "r", 1.0), ("a", "c", "r", None)], "src_id string, dst_id string, relation string, weight double").select("*", at)
    new = spark.createDataFrame([("a", "b", "r", 2.0), ("a", "c", "r", None), ("d", "e", "r", None)], "src_id string, dst_id string, relation string, weight double").select("*", at)
    got = incremental.changed_edges(old, new)
    assert sorted((r.src_id, r.weight) for r in got.collect()) == [("a", 2.0), ("d", None)]
    assert plan(got).count("Join ") == 1


def test_a_pair_of_tiles_is_compared_in_little_memory():
    import tracemalloc

    import numpy as np

    from loomwork.llm import minhash_dedup

    rng = np.random.default_rng(1)
    n = 2 * minhash_dedup.FAMILY_TILE
    common = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 60, i % 12).astype(np.uint64)])) for i in range(n)]
    tracemalloc.start()
    linked = minhash_dedup.linked_sets(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i, j in rng.integers(0, n, (200, 2)):
        inner = len(np.intersect1d(sets[i], sets[j]))
        assert linked[i, j] == (100 * inner >= 85 * (len(sets[i]) + len(sets[j]) - inner))
    assert peak < 64 << 20


def test_names_by_key_become_the_ids(spark):
    df = spark.createDataFrame([("r", "a:b|c"), ("", "x"), (None, "y")], "repo string, name string")
    repo, name = F.col("repo"), F.col("name")
    pairs = [
        (ids.commit_key(repo, name), ids.commit_id(repo, name)), (ids.file_key(repo, name), ids.file_id(repo, name)),
        (ids.session_key(name), ids.session_id(name)), (ids.message_key(repo, name), ids.message_id(repo, name)),
        (F.concat(F.lit("topic:"), name), F.concat(F.lit("topic:"), name)), (ids.person_id(name), ids.person_id(name)),
    ]
    for row in df.select(*[ids.id_of(key).eqNullSafe(made) for key, made in pairs]).collect():
        assert all(row)


def test_silver_by_keys_is_silver_by_ids(spark):
    t = Tables(tune(spark), SF)
    by_id = t.artifacts.select("id", "kind", "title").collect()
    assert sorted(map(tuple, by_id)) == sorted(map(tuple, ids.with_ids(t.keyed.artifacts, "id").select("id", "kind", "title").collect()))
    ends = ["relation", "src_id", "dst_id", "weight"]
    turned = ids.with_ids(t.keyed.edges, "src_id", "dst_id").withColumns(
        {c: F.when(F.col("relation") != "co_edited", F.col(c)).otherwise(f("src_id", "dst_id")) for c, f in (("src_id", F.least), ("dst_id", F.greatest))}
    )
    assert sorted(map(tuple, t.edges.select(ends).collect())) == sorted(map(tuple, turned.select(ends).collect()))
    assert "sha2" not in plan(t.keyed.edges.filter("relation = 'modified'").select("src_id", "dst_id"))


def test_marts_without_topics_find_none(spark, monkeypatch):
    def none(*args):
        raise AssertionError("topics are not read")

    monkeypatch.setattr(topics, "topic_terms", none)
    monkeypatch.setattr(bindings, "_WRITTEN", {k: v for k, v in bindings._WRITTEN.items() if not k[2].startswith("topic_")})
    for name in ("gold_daily_activity", "gold_file_hotspots", "gold_author_activity"):
        assert Tables(tune(spark), SF).fresh_gold(name).columns


def test_ends_are_looked_up_before_rows_multiply(spark):
    m = topics.TopicMembers(["x", "y"], *[spark.createDataFrame(r, "node string, mask long") for r in ([], [("p", 3), ("q", 1)], [], [("f", 2)])])
    known = spark.createDataFrame([("p",), ("f",), ("topic:x",), ("topic:y",)], "id string")
    got = graph.about(m, known)
    assert sorted((r.source, r.target) for r in got.collect()) == [("topic:x", "p"), ("topic:y", "f"), ("topic:y", "p")]
    text = plan(got)
    assert text.index("Generate") < text.index("Join LeftSemi")
    artifacts = spark.createDataFrame([("commit:c", "commit", "Ann <a@b.c>")], "id string, kind string, actor string")
    edges = spark.createDataFrame([("commit:c", f, "modified") for f in ("f", "gone")], "src_id string, dst_id string, relation string")
    ann = artifacts.select(ids.known_person_id(F.col("actor")).alias("id"))
    assert [r.target for r in graph.person_file(artifacts, edges, known.unionByName(ann)).collect()] == ["f"]
    assert graph.person_file(artifacts, edges, known).isEmpty()
