import json

import pytest
from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork.operators import sessions
from loomwork.sources import transcripts


def line(kind, text=None, **more):
    rec = {"type": kind, **more}
    if text is not None:
        rec["message"] = {"role": kind, "content": text}
    return json.dumps(rec)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    project = base / "-work-app"
    project.mkdir()
    (project / "aaaa1111-x.jsonl").write_text("\n".join([
        line("summary"),
        "not json",
        "[1, 2]",
        "",
        line("user", "<command-name>/clear", sessionId="", timestamp="2024-01-01T00:00:05Z", cwd="/work/app"),
        line("user", "  Fix the parser \n", sessionId="S1", timestamp="2024-01-01T00:00:01Z", uuid="u1", gitBranch="dev"),
        line("assistant", [{"type": "thinking", "text": "hm"}, {"type": "tool_use", "input": {"file_path": "/work/app/src/a.py"}}],
             timestamp="2024-01-01T00:00:02Z"),
        line("assistant", [{"type": "text", "text": "Done"}, {"type": "tool_use", "input": {"path": "src/../src/a.py"}}],
             timestamp="2024-01-01T00:00:03Z"),
        line("user", "tool output", toolUseResult={"ok": True}, timestamp="bad"),
        line("user", "[1,2] more", sessionId="S2", uuid=""),
        line("ai-title", aiTitle=""),
        line("ai-title", aiTitle="Parser work"),
    ]))
    (project / "bbbb2222-y.jsonl").write_text(
        line("user", [{"type": "text", "text": "p" * 150}], timestamp="2024-01-02T00:00:00Z", cwd="/work/app/", uuid="v1")
    )
    (base / "cccc.jsonl").write_text(line("user", "no time"))
    (base / "dddd4444-long-name.jsonl").write_text(line("system", "x", timestamp="2024-01-03T00:00:00Z"))
    for nested in ("subagents", "Workflows"):
        (base / nested).mkdir()
        (base / nested / "z.jsonl").write_text(line("user", "nested", timestamp="2024-01-01T00:00:00Z"))
    deep = base / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "deep.jsonl").write_text(line("user", "deep", timestamp="2024-01-01T00:00:00Z"))
    return str(base)


@pytest.fixture(scope="module")
def records(spark, root):
    return transcripts.records(spark, root).cache()


@pytest.fixture(scope="module")
def built(spark, records):
    index = spark.createDataFrame([("/work/app/src/a.py", "file:a")], "abspath string, file_id string")
    return sessions.build(records, index, "me (local)")


def test_only_near_transcripts_are_read(records):
    names = sorted(r[0].rsplit("/", 1)[-1] for r in records.select("file").distinct().collect())
    assert names == ["aaaa1111-x.jsonl", "bbbb2222-y.jsonl", "cccc.jsonl", "dddd4444-long-name.jsonl"]


def test_a_single_file_and_a_bound(spark, root):
    one = transcripts.records(spark, f"{root}/cccc.jsonl")
    assert one.count() == 1
    assert transcripts.records(spark, root, max_sessions=2).select("file").distinct().count() == 2
    assert transcripts.records(spark, f"{root}/nothing").count() == 0


def test_headers(records):
    heads = {r["session_id"]: r for r in sessions.headers(records).collect()}
    assert set(heads) == {"S1", "bbbb2222-y", "dddd4444-long-name"}
    s1 = heads["S1"]
    assert (s1["cwd"], s1["branch"], s1["ai_title"]) == ("/work/app", "dev", "Parser work")
    assert (s1["created_at"], s1["ended_at"]) == (naive(2024, 1, 1, 0, 0, 1), naive(2024, 1, 1, 0, 0, 5))
    assert sessions.unusable(records).first()["skipped_files"] == 1


def test_messages(built):
    msgs = built.artifacts.filter("kind = 'ai_message'").collect()
    by_text = {m["text"]: m for m in msgs}
    assert set(by_text) == {"Fix the parser", "Done", "[1,2] more", "p" * 150}
    extra = {t: json.loads(m["extra"]) for t, m in by_text.items()}
    assert extra["Fix the parser"]["uuid"] == "u1"
    # Without a uuid the key is the position among the kept messages.
    assert extra["Done"]["uuid"] == "S1:1" and extra["[1,2] more"]["uuid"] == "S1:2"
    assert by_text["Done"]["actor"] == "assistant" and by_text["Fix the parser"]["actor"] == "me (local)"
    assert by_text["[1,2] more"]["created_at"] == naive(2024, 1, 1, 0, 0, 1)
    assert by_text["p" * 150]["title"] == "p" * 120


def test_session_rows(built):
    rows_ = {json.loads(r["extra"])["session_id"]: r for r in built.artifacts.filter("kind = 'ai_session'").collect()}
    assert rows_["S1"]["title"] == "Parser work" and rows_["S1"]["text"] == "Parser work\n\nFix the parser"
    assert rows_["S1"]["repo"] == rows_["bbbb2222-y"]["repo"] == "app"
    assert json.loads(rows_["S1"]["extra"])["messages"] == 3
    assert json.loads(rows_["S1"]["extra"])["ended_at"] == "2024-01-01T00:00:05+00:00"
    assert rows_["bbbb2222-y"]["title"] == "p" * 120
    assert rows_["dddd4444-long-name"]["title"] == "session dddd4444" and rows_["dddd4444-long-name"]["repo"] is None


def test_edges(built):
    by = {r["relation"]: r["count"] for r in built.edges.groupBy("relation").count().collect()}
    assert by == {"message_of_session": 4, "authored": 3, "ai_touched_file": 1}
    touched = built.edges.filter("relation = 'ai_touched_file'").first()
    assert (touched["dst_id"], touched["weight"]) == ("file:a", 2.0)
