"""What queries leave unwritten and unshuffled: tables of other relations, texts nobody reads, digits of ids."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from loomwork import schemas
from loomwork.functions import ids
from loomwork.operators import incremental, silver
from loomwork.plans import bindings, queries
from loomwork.plans.bindings import Tables
from loomwork.session import tune
from loomwork.sources.lake import Lake

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.fixture
def written(monkeypatch):
    """The tables a query writes, by name."""
    made = {}
    monkeypatch.setattr(bindings, "_WRITTEN", made)
    return lambda: {key[2] for key in made}


@needs_tables
@pytest.mark.parametrize("name, tables", [
    ("console_setops", {"input_records"}),
    ("console_theta", {"input_records"}),
    ("scan_relation", {"input_records", "input_touches", "input_tree"}),
    ("console_join_left", {"input_records", "input_touches", "input_tree", "present"}),
    ("partition_counts", {"input_records", "input_touches", "input_tree"}),
    ("gold_author_activity", {"input_records", "input_touches", "input_tree", "present"}),
    ("gold_file_hotspots", {"input_records", "input_touches", "input_tree", "present"}),
    ("an_edges_total", {"input_records", "input_touches", "input_tree", "present"}),
])
def test_queries_write_no_table_that_they_do_not_read(spark, written, name, tables):
    queries.REGISTRY[name](spark, SF)
    assert written() <= tables


@needs_tables
def test_artifacts_of_readers_without_texts_differ_in_texts_alone(spark):
    t = Tables(tune(spark), SF)
    columns = ["id", "kind", "source", "repo", "actor", "created_at", "content_hash", "object_uri"]
    told, untold = (a.select(*columns) for a in (t.artifacts, t.untold.artifacts))
    assert told.count() > 0 and told.exceptAll(untold).isEmpty() and untold.exceptAll(told).isEmpty()
    with pytest.raises(ValueError, match="texts"):
        t.keyed.untold.tokens


@needs_tables
def test_files_by_key_hold_the_titles_of_their_commits(spark):
    t = Tables(tune(spark), SF)
    texts = [{r["text"] for r in files.select("text").collect()} for files in (t.files, t.keyed.files)]
    assert texts[0] == texts[1] and all("Commits that touched this file:" in x for x in texts[0])
    by_id = silver.recent_titles(t.present, t.commits)
    assert ids.with_ids(t.keyed.titles, "file_id").exceptAll(by_id).isEmpty()


def test_packed_ids_are_short_and_come_back(spark):
    digest = "0123456789abcdef" * 2 + "01234567"
    names = [f"file:{digest}", f"é\n{digest}", digest, digest.upper(), f"file:{digest}\n", "file:a", "", "\x01" + digest, "topic:red", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.packed(F.col("n")).alias("p"))
    got = df.select("n", "p", ids.unpacked(F.col("p")).alias("back")).collect()
    assert all(r["n"] == r["back"] for r in got)
    assert len(got[0]["p"]) == 26 and len({r["p"] and bytes(r["p"]) for r in got}) == len(names)


def test_an_append_of_edges_shuffles_once_by_key(spark, tmp_path):
    edges = spark.range(2000).select(
        F.concat(F.lit("commit:"), F.col("id")).alias("src_id"), F.lit("file:x").alias("dst_id"),
        F.lit("modified").alias("relation"), F.lit(1.0).alias("weight"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    plans, append = [], Lake._append

    class Seen(Lake):
        def _append(self, table, rows, batch_id, by, at=None, dealt=False):
            plans.append(dealt)
            return append(self, table, rows, batch_id, by, at, dealt)

    lake = Seen(spark, str(tmp_path / "lake"))
    assert [lake.append_edges(edges, str(n)) for n in range(2)] == [2000, 0] and plans == [True, True]
    assert lake.edges().count() == 2000


@needs_tables
def test_a_focus_writes_no_members_and_no_ids_of_edges(spark, written):
    t = Tables(tune(spark), SF)
    assert t.keyed.graph.edges.columns[0] == "id" and t.keyed.graph.edges.filter("id IS NULL").isEmpty()
    assert "graph_members" not in written() and "graph_edges" in written()
    stored = next(path for key, path in bindings._WRITTEN.items() if key[2] == "graph_edges")
    assert "id" not in spark.read.parquet(stored).columns


def test_a_load_that_is_sent_again_deals_its_ids_and_the_months_of_new_ones(spark, monkeypatch):
    def batch(*given):
        text = ", ".join(f"({n}, {m})" for n, m in given)
        rows = spark.sql(f"SELECT * FROM VALUES {text} AS t(n, month)")
        at = F.make_date(F.lit(2024), F.col("month"), F.lit(5)).cast("timestamp")
        name = F.concat(F.lit("commit:"), F.substring(F.sha2(F.col("n").cast("string"), 256), 1, 40))
        return schemas.conform(rows.select(name.alias("id"), at.alias("created_at"), F.col("month").cast("string").alias("content_hash")), schemas.ARTIFACTS)

    made, write = [], incremental.materialize
    monkeypatch.setattr(incremental, "materialize", lambda df, label: made.append(write(df, label)) or made[-1])
    stored = batch(*[(n, n % 4 + 1) for n in range(100)])
    # Sent again, with ids that come several times, one of them without a time, and one that has no id.
    more = batch((200, 9), (200, 3), (200, 7), (201, 8), (202, 6), (202, "CAST(NULL AS INT)"), (203, 5), ("CAST(NULL AS INT)", 2))
    got = incremental.new_artifacts(stored.unionByName(more), stored)
    assert [(r["id"] is None, r["content_hash"]) for r in got.orderBy("content_hash").collect()] == [
        (False, None), (True, "2"), (False, "3"), (False, "5"), (False, "8")
    ]
    assert made[0].columns == ["id", "month"] and made[0].count() == 5
    assert got.schema.names == schemas.ARTIFACTS.names


def test_reading_without_notes_of_later_rows_joins_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    row = spark.sql("SELECT 'a' AS id, 'file' AS kind, 'git' AS source, TIMESTAMP '2024-01-01' AS created_at")
    assert lake.append_artifacts(row, "0") == 1
    assert "Join" not in lake.artifacts()._jdf.queryExecution().optimizedPlan().toString()
    assert lake.artifacts().count() == 1
