"""What is dealt once, by short keys, or one step after the other, so that the disk holds less at a time."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomwork.operators import graph, marts, silver
from loomwork.plans import bindings, queries
from loomwork.plans.bindings import Tables
from loomwork.session import materialize, tune

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.fixture
def written(monkeypatch):
    made = {}
    monkeypatch.setattr(bindings, "_WRITTEN", made)
    return lambda: {key[2] for key in made}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_of_people_is_dealt(spark):
    people = spark.createDataFrame([(f"person:{i}", 1 + i % 3) for i in range(9)], "node string, mask long")
    names = spark.createDataFrame([("person:1", "Ann")], "person string, name string")
    pairs = marts.cross_silo(people, names, ["t0", "t1"])
    assert "Exchange" not in plan(pairs).split("SortMergeJoin [bit#")[0]
    assert pairs.count() == sum(bool((1 + i % 3) & (1 + j % 3)) for i in range(9) for j in range(i))


def test_a_scope_makes_its_edges_once(spark):
    artifacts = materialize(spark.sql("SELECT * FROM VALUES ('f', 'file', 'r'), ('f', 'file', 'r'), ('c', 'commit', 'r'), ('g', 'file', 'other') AS t(id, kind, repo)"), "artifacts")
    edges = materialize(spark.sql("SELECT *, 1.0D AS weight FROM VALUES ('c', 'f', 'modified'), ('c', 'g', 'modified'), ('person:1', 'c', 'authored'), (NULL, 'f', 'modified') AS t(src_id, dst_id, relation)"), "edges")
    _, kept = graph.scope_to_repo(artifacts, edges, "r")
    assert rows(kept, "src_id", "dst_id") == [("c", "f"), ("person:1", "c")]
    assert plan(kept).count("weight:double>") == 1  # scans of the edges themselves


@needs_tables
def test_pairs_of_files_are_dealt_by_their_keys(spark, monkeypatch):
    want = rows(silver.co_edited(Tables(tune(spark), SF).present), "src_id", "dst_id", "weight")
    monkeypatch.setattr(silver, "touch_ids", lambda keys: 1 / 0)  # no touch gets ids before it is paired
    assert rows(queries.REGISTRY["edges_co_edited"](spark, SF), "src_id", "dst_id", "weight") == want


@needs_tables
def test_scopes_of_dangling_edges_are_stored_one_after_the_other(spark, written):
    got = queries.REGISTRY["dq_dangling_edges"](spark, SF)
    assert {"dangling_all", "dangling_no_files", "co_edits"} <= written() and "input_commits" not in written()
    found = {r["scope"]: r for r in got.collect()}
    assert found["all"]["dangling_edges"] == 0 < found["no_files"]["dangling_edges"] < found["all"]["edges"]


@needs_tables
def test_edges_of_the_graph_are_stored_by_relation(spark, written):
    t = Tables(tune(spark), SF)
    stored = t.keyed.linked_graph.edges
    assert {"co_edits", "graph_edges"} <= written() and "graph_nodes" not in written()
    whole = graph.full_edges(t.keyed.artifacts, t.keyed.edges, t.keyed.members, t.keyed.node_ids)
    assert stored.exceptAll(whole).isEmpty() and whole.exceptAll(stored).isEmpty()
    assert stored.select("relation").distinct().count() == 5
