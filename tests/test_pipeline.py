import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork.operators import quality
from loomwork.plans import pipeline
from loomwork.session import shared_dir
from loomwork.sources import folder, registry
from loomwork.sources.lake import Lake
from loomwork.streaming import changes  # noqa: F401  (imports must not need a session)


@pytest.fixture(scope="module")
def work(tmp_path_factory):
    base = tmp_path_factory.mktemp("w") / "app"
    for path, content in {
        "src/a.py": b"def parse(): pass", "src/__init__.py": b"# package", ".env": b"KEY=1", "src/copy.py": b"def parse(): pass",
        "node_modules/x.js": b"ignored", ".git/config": b"ignored", "src/build/y.py": b"ignored", "z.lock": b"ignored",
        "empty.txt": b"", "logo.png": b"\x89PNG", "deep/er/and/er/n.txt": b"note",
    }.items():
        file = base / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    (base / "big.dat").write_bytes(b"x" * (6 * 1024 * 1024 + 1))
    return base


KEPT = [".env", "big.dat", "deep/er/and/er/n.txt", "logo.png", "src/__init__.py", "src/a.py", "src/copy.py"]


def test_folder_scan(spark, work):
    listed = folder.list_files(spark, str(work))
    assert [r[0] for r in rows(folder.accepted(listed), "rel")] == KEPT
    assert folder.skipped(listed).first()["skipped_ignored"] == 2
    with pytest.raises(folder.FolderError):
        folder.list_files(spark, str(work / "src/a.py"))


def test_folder_ingest(spark, work, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    stats, index = pipeline.ingest_folder(lake, str(work), max_files=2)
    assert stats["files"] == 2 and rows(lake.artifacts(), "title") == [(".env",), ("big.dat",)]
    stats, index = pipeline.ingest_folder(lake, str(work))
    assert stats == {"folder": "app", "files": 5, "blobs_uploaded": 4, "skipped_existing": 2, "skipped_ignored": 2}
    got = {r["title"]: r for r in lake.artifacts().collect()}
    assert got["src/a.py"]["text"] == "src/a.py\n\ndef parse(): pass"
    assert got["logo.png"]["text"] == "logo.png\n\n[image file png]"
    assert got["src/a.py"]["object_uri"] == got["src/copy.py"]["object_uri"]
    assert got["src/a.py"]["actor"] is None and json.loads(got["src/a.py"]["extra"])["modality"] == "code"
    assert index.count() == 7 and lake.blobs().count() == 6
    # An edited file keeps its first version.
    (work / ".env").write_bytes(b"KEY=2")
    assert pipeline.ingest_folder(lake, str(work))[0]["files"] == 0
    (work / ".env").write_bytes(b"KEY=1")


@pytest.fixture(scope="module")
def commit_log(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("repo"))
    spark.createDataFrame(
        [("app", "c1", "Ann <a@x>", naive(2024, 1, 1), "parser work", ["lib/p.py", "lib/q.py"]),
         ("app", "c2", "Bob <b@x>", naive(2024, 1, 2), "parser repair", ["lib/p.py", "lib/q.py", "old.py"])],
        "repo string, sha string, actor string, authored_at timestamp, message string, changed array<string>",
    ).write.parquet(f"{at}/commits")
    spark.createDataFrame(
        [("app", "/work/app", p, naive(2024, 1, 2), 10, "says", "code", "hash") for p in ("lib/p.py", "lib/q.py")],
        "repo string, root string, path string, head_at timestamp, size long, said string, modality string, content_hash string",
    ).write.parquet(f"{at}/tree")
    return at


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    (base / "s.jsonl").write_text("\n".join(json.dumps(r) for r in [
        {"type": "user", "sessionId": "S", "cwd": "/work/app", "timestamp": "2024-01-03T00:00:00Z", "uuid": "1",
         "message": {"role": "user", "content": "parser question"}},
        {"type": "assistant", "timestamp": "2024-01-03T00:00:01Z", "uuid": "2", "message": {"role": "assistant", "content": [
            {"type": "text", "text": "parser answer"}, {"type": "tool_use", "input": {"file_path": "lib/p.py"}}]}},
    ]))
    return str(base)


def test_a_second_sync_changes_nothing(spark, work, commit_log, logs, tmp_path):
    at, lake = str(tmp_path / "sources"), Lake(spark, str(tmp_path / "lake"))
    registry.add(spark, at, str(work), "folder")
    registry.add(spark, at, commit_log, "repo")
    registry.add(spark, at, "/not/there", "folder")
    scratch = os.path.join(shared_dir(spark), "loomwork")
    kept = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    steps = pipeline.sync_once(lake, at, logs, "me")
    assert set(os.listdir(scratch)) <= kept  # intermediate tables are gone
    out = {(r["kind"], r["status"]): r for r in steps.collect()}
    assert out["repo", "done"]["added"] == 4 and out["transcripts", "done"]["added"] == 1
    assert "/not/there" in out["folder", "failed"]["error"] and out["folder", "done"]["error"] is None
    totals = {(r["kind"], r["status"]): (r["steps"], r["added"]) for r in pipeline.sync_totals(steps).collect()}
    assert totals["folder", "failed"] == (1, 0) and totals["marts", "done"][0] == 1
    by_kind = {r["kind"]: r["count"] for r in lake.artifacts().groupBy("kind").count().collect()}
    assert by_kind == {"file": 9, "commit": 2, "ai_session": 1, "ai_message": 2} and out["embedding", "done"]["added"] == 14
    by_rel = {r["relation"]: r["count"] for r in lake.edges().groupBy("relation").count().collect()}
    assert by_rel == {"authored": 3, "modified": 4, "co_edited": 1, "message_of_session": 2, "ai_touched_file": 1}
    # The marts report what they wrote; pairs of people are answered from one row per person.
    written = pipeline.build_marts(lake)
    assert written["gold_author_activity"] == 3 and written["topic_people"] == 3 and "gold_cross_silo" not in written
    assert all(lake.gold(n).count() == c for n, c in written.items() if n.startswith("gold_"))
    pairs = pipeline.cross_silo(lake)
    assert pairs.count() == 3
    top = pairs.orderBy(F.desc("shared_topics"), "person_a", "person_b").limit(2)
    assert rows(pipeline.cross_silo(lake, top=2)) == rows(top)
    assert pipeline.dashboard(lake)["cross_silo"].count() == 3
    assert pipeline.console_tables(lake)["gold_cross_silo"].count() == 3
    me = pairs.first()["person_a"]
    assert pipeline.cross_silo(lake, person=me).count() == 2
    spots = {r["path"]: r for r in lake.gold("gold_file_hotspots").collect()}
    assert (spots["lib/p.py"]["times_modified"], spots["lib/p.py"]["ai_touches"], spots["lib/p.py"]["coedit_degree"]) == (2, 1, 1)
    # Invariants of the stored tables.
    assert quality.referential_integrity(lake.artifacts(), lake.edges()).first()["dangling_edges"] == 0
    quality.require_enums(lake.artifacts(), lake.edges())
    assert quality.embedding_coverage(lake.artifacts(), lake.vectors()).first()["passed"]

    # Questions are asked as text and encoded like the stored vectors.
    asked = spark.createDataFrame([(1, "parser question"), (2, "def parse"), (3, None)], "query_id int, question string")
    hits = {r["query_id"]: r["title"] for r in pipeline.search(lake, asked, k=1).filter("score > 0").collect()}
    assert hits[1] == "parser question" and hits[2].endswith((".py",)) and 3 not in hits
    told = {r["query_id"]: r for r in pipeline.context_for(lake, asked, k=2).collect()}
    assert told[1]["n_hits"] == 2 and "title: parser question" in told[1]["context"]

    before = rows(lake.artifacts()), rows(lake.edges())
    again = {r["kind"]: r["added"] for r in pipeline.sync_once(lake, at, logs, "me").collect()}
    assert again["embedding"] == 0 and "marts" not in again
    assert (rows(lake.artifacts()), rows(lake.edges())) == before


def test_commit_stats(spark, commit_log, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    commits, tree = (spark.read.parquet(f"{commit_log}/{n}") for n in ("commits", "tree"))
    stats, index = pipeline.ingest_commits(lake, commits, tree, max_commits=1)
    assert stats == {"commits": 1, "files": 2, "edges": 4, "coedit_skipped": 0}
    # A bound on commits does not lower the weights of pairs.
    assert lake.edges().filter("relation = 'co_edited'").first()["weight"] == 2.0
    assert lake.artifacts().filter("object_uri IS NOT NULL").count() == 0 and lake.blobs().count() == 0
    assert rows(index, "abspath") == [("/work/app/lib/p.py",), ("/work/app/lib/q.py",)]
    stats, _ = pipeline.ingest_commits(lake, commits, tree)
    assert stats["commits"] == 1 and stats["files"] == 0
    assert lake.edges().filter("relation = 'co_edited'").first()["weight"] == 2.0


def test_scheduled_sync(spark, tmp_path):
    import time

    calls = []
    query = pipeline.keep_synced(spark, str(tmp_path / "q"), lambda: calls.append(1), interval=1)
    end = time.time() + 60
    while not calls and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert calls
