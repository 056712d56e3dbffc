"""The registered queries against their SQL, on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from loomwork.plans import oracle
from loomwork.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")

# One query per area; check.py runs all of them.
SAMPLE = [
    "file_filter", "commit_artifacts", "file_artifacts", "incremental_append", "content_addressed_blobs",
    "edges_co_edited", "session_messages", "graph_nodes", "graph_edges", "gold_file_hotspots", "gold_author_activity",
    "gold_topic_summary", "gold_cross_silo", "an_cross_silo", "console_asof", "console_window_rank",
    "vector_topk_batch", "rag_context", "cdc_changes", "stream_daily",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(oracle.sql()) == set(REGISTRY)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and check.normal(got) == check.normal(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(entry.queries()["scan_kind"](spark, SF))
    assert "EqualTo(kind,ai_message)" in plan
    plan = _plan(entry.queries()["gold_daily_activity"](spark, SF))
    assert "ReadSchema: struct<kind:string,source:string,created_at:timestamp>" in plan


def test_limits_per_key_apply_before_the_shuffle(spark):
    for name in ("commits_newest", "console_window_topn"):
        plan = _plan(entry.queries()[name](spark, SF))
        assert "Partial" in plan[plan.index("WindowGroupLimit"):], name


def test_graph_queries_read_few_tables(spark):
    """Topic members and node ids are read from tables; no branch derives them again."""
    for name, most in (("graph_edges", 40), ("graph_nodes", 8), ("gold_topic_summary", 10), ("dq_dangling_edges", 8)):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, (name, plan.count("FileScan"))


def test_no_query_plans_a_cross_join(spark):
    for name in ("gold_cross_silo", "vector_topk_batch", "graph_edges", "edges_co_edited"):
        plan = _plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["vector_topk_rows", "rag_context_rows"])
def test_searches_of_every_50th_row_equal_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    ids = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert got["query_id"].nunique() == ids > 0 and check.normal(got) == check.normal(want)
