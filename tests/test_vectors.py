import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import naive, rows
from loomwork import schemas
from loomwork.operators import vector_index, vectors


@pytest.fixture(scope="module")
def table(spark):
    """300 vectors; a third of them are copies of one, so ties must go by id."""
    rng = np.random.default_rng(1)
    data = []
    hot = rng.normal(size=8)
    for i in range(300):
        v = hot if i % 3 == 0 else rng.normal(size=8)
        data.append((f"v{i:03}", [float(x) for x in v], ["file", "commit"][i % 2], "git", "rs"[i % 5 == 0], None, f"t{i}", "x" * 500, "", ""))
    return data, spark.createDataFrame(data, schemas.VECTORS).repartition(7).cache()


def brute(data, q, k, keep=lambda d: True):
    q = np.asarray(q, dtype=np.float64)

    def score(v):
        v = np.asarray(v, dtype=np.float32).astype(np.float64)
        return float(v @ q / np.linalg.norm(v) / np.linalg.norm(q))

    scored = [(round(score(d[1]), 6), d[0]) for d in data if keep(d)]
    return [i for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_search_is_exact(table):
    data, df = table
    for q in (data[0][1], data[1][1], data[17][1]):
        assert ids(vectors.search(df, q, 12)) == brute(data, q, 12)


def test_filters_apply_before_ranking(table):
    data, df = table
    got = vectors.search(df, data[1][1], 10, kind="commit", repo="s")
    assert ids(got) == brute(data, data[1][1], 10, lambda d: d[2] == "commit" and d[4] == "s")
    hit = got.first()
    assert len(hit["snippet"]) == 500 and 0 <= hit["score"] <= 1 and hit["actor"] == ""


def test_nothing_to_search(table):
    data, df = table
    assert vectors.search(df, []).count() == 0
    assert vectors.search(df.limit(0), data[0][1]).count() == 0
    assert vectors.search(df, data[0][1], kind="none").count() == 0


def test_many_queries_take_several_passes(spark, table):
    data, df = table
    queries = spark.createDataFrame([(i, data[i][1]) for i in range(7)] + [(99, [])], "query_id long, query_vector array<double>")
    got = vectors.search_many(df, queries, 5, max_queries=3)
    for i in range(7):
        assert ids(got.filter(F.col("query_id") == i)) == brute(data, data[i][1], 5)
    assert got.filter("query_id = 99").count() == 0
    assert vectors.search_many(df, queries.limit(0), 5).count() == 0


def test_queries_meet_tiles_by_a_shuffle(spark, table, monkeypatch):
    data, df = table
    queries = spark.createDataFrame([(i, data[i][1]) for i in range(0, 300, 7)], "query_id long, query_vector array<double>")

    def collect(self):
        raise AssertionError("rows were brought to the driver")

    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", collect)
        got = vectors.search_many(df, queries, 5, max_queries=4, tile_rows=40)
        twice = vectors.search_many(df.unionByName(df), queries, 4, tile_rows=90)
    hits = rows(got, "query_id", "rank", "id")
    assert sorted(hits) == [(i, r + 1, h) for i in range(0, 300, 7) for r, h in enumerate(brute(data, data[i][1], 5))]
    assert sorted(rows(twice, "query_id", "rank", "id")) == [
        (i, 2 * r + c, h) for i in range(0, 300, 7) for r, h in enumerate(brute(data, data[i][1], 2)) for c in (1, 2)
    ]


def test_context(spark, table):
    data, df = table
    queries = spark.createDataFrame([(1, data[0][1]), (2, [])], "query_id long, query_vector array<double>")
    got = {r["query_id"]: r for r in vectors.context(vectors.search_many(df, queries, 2), queries).collect()}
    blocks = got[1]["context"].split("\n\n")
    assert got[1]["n_hits"] == 2 and blocks[0].startswith("[1] id=v000 kind=file source=git\n    title: t0\n    text: xxx")
    assert got[2]["n_hits"] == 0 and got[2]["note"] == vectors.NO_HITS and got[2]["context"] is None


def arts(spark, *texts):
    data = [(f"a{i}", "file", "git", None, None, naive(2024, 1, 1), "title words", t, None, None, "{}") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, schemas.ARTIFACTS)


def test_embedding_is_incremental(spark):
    a = arts(spark, "parser code", "", None)
    none = schemas.empty(spark, schemas.VECTORS)
    made = vectors.embed_new(a, none).cache()
    assert made.schema.names == schemas.VECTORS.names and made.count() == 3
    got = {r["id"]: np.asarray(r["vector"]) for r in made.collect()}
    assert all(len(v) == vectors.DIM and abs(np.linalg.norm(v) - 1) < 1e-5 for v in got.values())
    # Without a text the title speaks.
    assert np.allclose(got["a1"], got["a2"]) and not np.allclose(got["a0"], got["a1"])
    assert vectors.embed_new(a, made).count() == 0
    assert vectors.embed_new(arts(spark, "parser code", "", None, "new"), made).first()["id"] == "a3"


def test_a_model_can_be_plugged_in(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = vectors.embed_new(arts(spark, "abc", "defgh"), schemas.empty(spark, schemas.VECTORS), make)
    assert {r["id"]: [round(x, 4) for x in r["vector"]] for r in got.collect()} == {"a0": [0.9487, 0.3162], "a1": [0.9806, 0.1961]}


def test_a_known_phrase_finds_its_artifact(spark):
    a = arts(spark, "Content-addressed blob storage with digests", "Streaming of file events", "Topic marts for people")
    made = vectors.embed_new(a, schemas.empty(spark, schemas.VECTORS)).cache()
    query = vectors.hashing_vectors(spark.createDataFrame([("blob storage",)], "t string"), "t").first()["vector"]
    hit = vectors.search(made, query, 1).first()
    assert a.filter(F.col("id") == hit["id"]).first()["text"].startswith("Content-addressed")


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """600 vectors around 12 centres; a third are copies of one; some have no vector or no length."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    data = []
    for i in range(600):
        v = centres[0] if i % 3 == 0 else centres[i % 12] + rng.normal(size=16)
        v = None if i == 7 else [0.0] * 16 if i == 8 else [float(x) for x in v]
        data.append((f"v{i:03}", v, ["file", "commit"][i % 2], "git", "rs"[i % 5 == 0], None, f"t{i}", "x", "", ""))
    df = spark.createDataFrame(data, schemas.VECTORS).repartition(5)
    return data, df, vector_index.build(df, str(tmp_path_factory.mktemp("index")), lists=12)


def asked(spark, data, ids=range(1, 600, 50)):
    return spark.createDataFrame([(i, data[i][1]) for i in ids if data[i][1]] + [(999, [])], "query_id long, query_vector array<double>")


def hits_of(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_index_holds_every_row_that_has_a_vector(clustered):
    data, df, index = clustered
    assert index.rows.count() == 599 and index.lists.agg(F.sum("n")).first()[0] == 599
    assert index.lists.count() <= 12 and index.rows.select("list").distinct().count() > 6


def test_all_lists_give_the_exact_hits(spark, clustered):
    data, df, index = clustered
    queries = asked(spark, data)
    for options in ({}, {"kind": "commit", "repo": "s"}):
        exact = hits_of(vectors.search_many(df, queries, 7, **options))
        assert hits_of(vector_index.search(index, queries, 12, 7, tile_rows=40, max_queries=3, **options)) == exact


def test_calibrated_probes_reach_the_recall_and_skip_lists(spark, clustered):
    data, df, index = clustered
    queries = asked(spark, data, range(5, 600, 7))
    probes = vector_index.calibrate(index, 10, 0.95)
    assert probes < 6
    found = vector_index.recall(vectors.search_many(df, queries, 10), vector_index.search(index, queries, probes, 10))
    hits, same, queries_seen = found.agg(F.sum("hits"), F.sum("found"), F.count("*")).first()
    assert hits == 10 * queries_seen and same >= 0.9 * hits
    shares = [r["share"] for r in vector_index.touched(index, queries, probes).collect()]
    assert 0 < np.mean(shares) < 0.7 and max(r["rows"] for r in vector_index.touched(index, queries, 12).collect()) == 599


def test_only_probed_lists_are_read(spark, clustered, tmp_path):
    data, df, index = clustered
    queries = asked(spark, data, [5])
    (probe,) = {r["list"] for r in vector_index.probed(index, queries, 1).collect()}
    other = vector_index.VectorIndex(spark, str(tmp_path / "copy"), df.limit(0).withColumn("row", F.lit(0)).schema)
    index.rows.filter(F.col("list") == probe).write.partitionBy("list").parquet(f"{other.folder}/rows")
    index.lists.write.parquet(f"{other.folder}/lists")
    whole = hits_of(vector_index.search(index, queries, 1, 5))
    partial = vector_index.VectorIndex(spark, other.folder)
    assert hits_of(vector_index.search(partial, queries, 1, 5)) == whole and len(whole) == 5


def test_index_of_nothing(spark, clustered, tmp_path):
    data, df, _ = clustered
    index = vector_index.build(df.limit(0), str(tmp_path / "none"))
    assert vector_index.search(index, asked(spark, data), 3).count() == 0 and vector_index.calibrate(index) >= 1
    one = vector_index.build(df.filter("id = 'v010'"), str(tmp_path / "one"))
    assert [r["id"] for r in vector_index.search(one, asked(spark, data, [1]), 3).collect()] == ["v010"]
