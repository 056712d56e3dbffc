import json

from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork.operators import marts, silver
from loomwork.schemas import VECTORS
from loomwork.sources.lake import Lake
from loomwork.streaming import changes, daily, ingest

OBS = "path string, at timestamp, version string"


def observed(spark):
    data = [
        ("a", naive(2024, 1, 1, 1), "1"), ("a", naive(2024, 1, 1, 2), "1"), ("a", naive(2024, 1, 2, 1), "2"),
        ("b", naive(2024, 1, 1, 1), "1"), ("a", naive(2024, 1, 5, 1), "2"), ("a", naive(2024, 1, 5, 2), "1"),
        ("c", naive(2024, 1, 5, 1), "9"), ("b", naive(2024, 1, 6, 1), "1"),
    ]
    return spark.createDataFrame(data, OBS)


def day():
    return F.date_trunc("day", F.col("at"))


def test_changes_batch(spark):
    got = changes.changes(observed(spark), ["path"], "at", "version", day())
    assert rows(got.select("path", F.dayofmonth("at"), "version")) == [
        ("a", 1, "1"), ("a", 2, "2"), ("a", 5, "1"), ("b", 1, "1"), ("c", 5, "9")]
    primed = spark.createDataFrame([("a", "1"), ("b", "0")], "path string, version string")
    got = changes.changes(observed(spark), ["path"], "at", "version", day(), primed)
    assert rows(got.select("path", F.dayofmonth("at"), "version")) == [
        ("a", 2, "2"), ("a", 5, "1"), ("b", 1, "1"), ("c", 5, "9")]


def stream_of(spark, tmp_path, frames, schema):
    """A file stream that delivers one frame per micro-batch."""
    src = tmp_path / "in"
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{src}/f{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")


def test_changes_stream_equals_batch(spark, tmp_path):
    rows_ = observed(spark).orderBy("at", "path").collect()
    frames = [spark.createDataFrame(rows_[i : i + 3], OBS) for i in range(0, len(rows_), 3)]
    out = str(tmp_path / "out")

    def sink(batch, epoch):
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/epoch={epoch}")

    primed = spark.createDataFrame([("a", "1")], "path string, version string")
    changes.start(stream_of(spark, tmp_path, frames, OBS), ["path"], "at", "version", day(), sink,
                  str(tmp_path / "q"), primed=primed, availableNow=True).awaitTermination()
    got = rows(spark.read.parquet(out), "path", "at", "version")
    want = rows(changes.changes(observed(spark), ["path"], "at", "version", day(), primed), "path", "at", "version")
    assert got == want


def test_change_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Each start brings one more file; a busy key is cut into slices, and only observed keys are in the state."""
    found = []

    def sink(batch, epoch):
        found.extend(tuple(r) for r in batch.collect())

    hours = [(naive(2024, 1, d, h), h) for d in range(1, 5) for h in range(24)]
    parts = [[("hot", at, str(h // 5)) for at, h in hours if at.day == d] + [(f"k{d % 2}", naive(2024, 1, d), str(d // 3))] for d in range(1, 5)]
    for i, part in enumerate(parts):
        stream = stream_of(spark, tmp_path / "s", [spark.createDataFrame(part, OBS)] if i == 0 else [], OBS) if i == 0 else stream
        if i:
            spark.createDataFrame(part, OBS).coalesce(1).write.parquet(f"{tmp_path}/s/in/g{i}")
        hour = F.date_trunc("hour", F.col("at"))
        changes.start(stream, ["path"], "at", "version", hour, sink, str(tmp_path / "q"), availableNow=True).awaitTermination()
    whole = spark.createDataFrame([r for part in parts for r in part], OBS)
    assert sorted(found, key=repr) == rows(changes.changes(whole, ["path"], "at", "version", day()), "path", "at", "version")
    assert rows(changes.state(spark, str(tmp_path / "q")), "path", "version") == [("hot", "4"), ("k0", "1"), ("k1", "1")]


def test_state_expires(spark, tmp_path):
    rows_ = observed(spark).orderBy("at", "path").collect()
    frames = [rows_[:4], [("a", naive(2024, 2, 1), "2")], [("z", naive(2024, 2, 20), "1")], [("b", naive(2024, 2, 20), "1"), ("a", naive(2024, 2, 21), "2")]]
    found = []
    stream = stream_of(spark, tmp_path, [spark.createDataFrame(f, OBS) for f in frames], OBS)
    changes.start(stream, ["path"], "at", "version", day(), lambda b, e: found.extend((r["path"], r["at"].month, r["at"].day) for r in b.collect()),
                  str(tmp_path / "q"), ttl="30 days", availableNow=True).awaitTermination()
    # b was not seen for 30 days and is new again; a was renewed in between.
    assert sorted(x for x in found if x[1] == 2) == [("b", 2, 20), ("z", 2, 20)]
    assert {r["path"] for r in changes.state(spark, str(tmp_path / "q")).collect()} == {"a", "b", "z"}


def test_file_events(spark, tmp_path):
    work = tmp_path / "work"
    work.mkdir()
    (work / "a.py").write_text("print(1)")
    (work / "empty.py").write_text("")
    (work / "big.bin").write_bytes(b"x" * (6 * 1024 * 1024 + 1))
    (work / "__init__.py").write_text("# package")

    def event(name, **more):
        return json.dumps({"repo": "app", "abspath": str(work / name), "rel": name, "ts": "2024-01-01T00:00:00+00:00", **more})

    batches = [
        [event("a.py"), event("a.py"), "not json", json.dumps({"rel": "x"}), event("gone.py")],
        [event("a.py", ts="2024-01-02T00:00:00+00:00"), event("empty.py"), event("big.bin"), event("__init__.py", rel=None)],
    ]
    src = tmp_path / "events"
    src.mkdir()
    for i, lines in enumerate(batches):
        (src / f"e{i}.json").write_text("\n".join(lines))
    lake = Lake(spark, str(tmp_path / "lake"))
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
    for _ in range(2):  # a restart continues from its checkpoint
        ingest.start(raw, lake, str(tmp_path / "q"), availableNow=True).awaitTermination()
        (work / "a.py").write_text("print(2)")
    got = {r["title"]: r for r in lake.artifacts().collect()}
    assert set(got) == {"a.py", "__init__.py", "big.bin"}
    stored = {r["object_uri"] for r in lake.blobs().select("object_uri").collect()}
    assert stored == {r["object_uri"] for r in got.values()}
    assert got["a.py"]["text"] == "a.py\n\nprint(1)" and json.loads(got["a.py"]["extra"])["streamed"] is True
    assert lake.vectors().count() == 3 and lake.vectors().schema.names == VECTORS.names
    poison = spark.read.text(f"{tmp_path}/q/poison").select("value")
    assert rows(poison) == [("not json",), ('{"rel": "x"}',)]


def test_repeats_within_the_horizon_never_reach_the_stored_ids(spark, tmp_path):
    """Repeats inside a micro-batch and of the one before are dropped by the stream; those that come after the
    state has forgotten them are caught by the stored ids."""
    src = tmp_path / "events"
    src.mkdir()

    def event(rel, ts):
        return json.dumps({"repo": "app", "abspath": f"/w/{rel}", "rel": rel, "ts": f"2024-01-0{ts}T00:00:00Z"})

    batches = [[event("a", 2), event("a", 1), event("b", 1), "poison", "poison"], [event("a", 3), event("c", 1)], [event("b", 4), event("d", 1), "poison"]]
    lake, seen = Lake(spark, str(tmp_path / "lake")), []

    def described(batch):
        seen.append(sorted(r["rel"] for r in batch.collect()))
        return silver.file_artifacts(batch.select("repo", F.col("rel").alias("path"), F.col("ts").alias("created_at"), F.lit("").alias("said")))

    def run(horizon, folder):
        raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
        ingest.start(raw, lake, folder, described, embed=False, horizon=horizon, availableNow=True).awaitTermination()

    for i, lines in enumerate(batches):
        (src / f"e{i}.json").write_text("\n".join(lines))
        run("1 hour", str(tmp_path / "q"))
    assert [s for s in seen if s] == [["a", "b"], ["c"], ["d"]]
    assert rows(lake.artifacts().select("title", F.dayofmonth("created_at"))) == [("a", 1), ("b", 1), ("c", 1), ("d", 1)]
    assert rows(spark.read.text(f"{tmp_path}/q/poison").select("value")) == [("poison",)]
    state = spark.read.format("statestore").load(f"{tmp_path}/q/checkpoint")
    assert state.count() == 5
    run("1 hour", str(tmp_path / "another"))  # a stream without memory: the stored ids decide
    assert [s for s in seen if s][3:] == [] and lake.artifacts().count() == 4


def test_event_state_is_bounded_by_the_horizon(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    out = []
    for i in range(3):
        (src / f"e{i}.json").write_text("\n".join(json.dumps({"repo": "r", "abspath": f"/{i}{k}"}) for k in range(4)))
        kept = ingest.without_repeats(ingest.decode(spark.readStream.text(str(src))), "0 seconds")
        kept.writeStream.foreachBatch(lambda b, e: out.append(b.count())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sum(out) == 12 and spark.read.format("statestore").load(f"{tmp_path}/cp").count() <= 4


def daily_frames(spark, days_of):
    schema = "created_at timestamp, source string, kind string"
    return [
        spark.createDataFrame([(naive(2024, 1, d, h), "git", k) for d in days for h in range(3) for k in ("file", None)], schema)
        for days in days_of
    ]


def test_daily_stream_equals_the_batch_with_late_rows_aside(spark, tmp_path):
    """Day 2 comes while it is open and again after it has left."""
    frames = daily_frames(spark, ([2, 3], [2, 9], [9, 10], [2, 8, 10]))
    frames[3] = frames[3].unionByName(spark.createDataFrame([(None, "git", "file")], frames[3].schema))
    stream = stream_of(spark, tmp_path, frames, frames[0].schema)
    for _ in range(2):
        daily.start(stream, str(tmp_path / "q"), availableNow=True).awaitTermination()
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    folder = str(tmp_path / "q")
    assert rows(daily.read(spark, folder)) == rows(marts.daily_activity(whole))
    aside = rows(daily.late(spark, folder).select("day", "kind", "count"))
    assert aside == sorted([(None, "file", 1), ("2024-01-02", "file", 3), ("2024-01-02", None, 3)], key=repr)
    assert {r["day"] for r in daily.state(spark, folder).collect()} == {"2024-01-08", "2024-01-09", "2024-01-10"}
    on_time = rows(daily.read(spark, folder, with_late=False).filter("day = '2024-01-02' AND kind = 'file'").select("count"))
    assert on_time == [(6,)]


def test_daily_stream_rewrites_only_the_days_it_changed(spark, tmp_path):
    frames = daily_frames(spark, ([1, 2], [2, 3]))
    stream, folder, seen = stream_of(spark, tmp_path, frames[:1], frames[0].schema), str(tmp_path / "q"), []
    for i in range(2):
        if i:
            frames[1].coalesce(1).write.parquet(f"{tmp_path}/in/g1")
        daily.start(stream, folder, availableNow=True).awaitTermination()
        seen.append({p.parent.name: p.name for p in (tmp_path / "q/counts").rglob("*.parquet")})
    assert seen[0]["day=2024-01-01"] == seen[1]["day=2024-01-01"] and seen[0]["day=2024-01-02"] != seen[1]["day=2024-01-02"]
