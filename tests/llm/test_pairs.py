"""Near-duplicates of documents and vectors against brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from odd_documents import frame, rows
from pyspark.sql import functions as F

from loomwork.llm import embedding_dedup, minhash_dedup
from loomwork.llm.components import connected_components, dense_roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(ids, linked):
    """Least id reachable from each id."""
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def documents_by_hand(pairs):
    sets = {}
    for i, t in pairs:
        sets.setdefault(i, shingles(t))
    linked = []
    for a, b in combinations([i for i in sets if sets[i]], 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            linked.append((a, b))
    least = components(sets, linked)
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def test_documents_equal_brute_force(spark):
    pairs = [p for p in rows() if p[0] is not None]
    got = minhash_dedup.near_duplicates(frame(spark, pairs)).collect()
    want = documents_by_hand(pairs)
    assert len(got) == len(pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert sum(not w[2] for w in want.values()) > 10


def test_documents_without_id_link_but_name_no_component(spark):
    got = minhash_dedup.near_duplicates(frame(spark)).collect()
    assert len(got) == len(rows())
    by_text = [r for r in got if r.doc_id is None]
    assert sorted((r.n_shingles, r.component_id is None) for r in by_text)[0] == (0, True)
    assert any(r.component_id is not None and not r.kept for r in by_text)


def test_dedupe_keeps_one_row_of_each_component_with_its_columns(spark):
    docs = frame(spark)
    kept = minhash_dedup.dedupe(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    want = {i for i, w in documents_by_hand([p for p in rows() if p[0] is not None]).items() if w[2]}
    assert sorted(ids) == sorted(want)
    assert minhash_dedup.dedupe(docs.limit(0)).count() == 0


def test_large_groups_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BUCKET_TILE", 4)
    monkeypatch.setattr(minhash_dedup, "FAMILY_TILE", 3)
    base = [f"w{i}" for i in range(60)]
    pairs = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        words[i] = f"v{i}"
        if i % 3 == 0:
            words[(i * 7) % 60] = f"u{i}"
        pairs.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(frame(spark, pairs)).collect()}
    assert got == documents_by_hand(pairs)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(40):
        both, one, two = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
        values = minhash_dedup.signatures(np.concatenate([both, one, both, two]), np.array([80, 80]))
        agree.append((values[0] == values[1]).mean())
    assert abs(np.mean(agree) - 0.6) < 0.03
    short = minhash_dedup.signatures(both[:2], np.array([1, 1]))
    assert (short != minhash_dedup._EMPTY).all()


def vectors_by_hand(pairs):
    usable = {i: v for i, v in pairs if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max(len(v) for v in usable.values())
    unit = {i: np.pad(np.array(v, float), (0, width - len(v))) for i, v in usable.items()}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in unit.items()}
    linked = [(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= 0.9]
    least = components([i for i, _ in pairs], linked)
    count = {i: sum(i in p for p in linked) for i, _ in pairs}
    return {i: (count[i], least[i], least[i] == i) for i, _ in pairs}


@pytest.mark.parametrize("tile", [7, 4096])
def test_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    pairs = [(i, (centres[i % 12] * rng.uniform(0.5, 2) + rng.normal(scale=0.35, size=16)).tolist()) for i in range(150)]
    pairs += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None, 1.0]), (205, [float("inf"), 1.0])]
    pairs += [(206, [1e-300] + [0.0] * 15), (207, [1e300]), (208, pairs[5][1]), (209, pairs[5][1]), (210, [-0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in pairs], "vec_id long, embedding array<double>, vertex int, n double").repartition(3)
    got = embedding_dedup.near_duplicates(df, tile_rows=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == vectors_by_hand(pairs)


def test_vectors_of_empty_tables_and_without_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (4, None, 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got)[-1] == (4, 0, 4, True)
    assert [r.n_links for r in got if r.vec_id is None] == [1, 1]


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24)) * np.linspace(3, 0.2, 24)
    x = np.concatenate([x, x[:80] + rng.normal(scale=0.1, size=(80, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = embedding_dedup.fit_rotation(x)
    assert np.array_equal(embedding_dedup.tile_links(x, x, x @ axes, x @ axes, 0.9), x @ x.T >= 0.9)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    flags = np.zeros((4, 4), bool)
    flags[0, 2] = flags[2, 0] = True
    assert dense_roots(flags).tolist() == [0, 1, 0, 3]


def test_rows_without_ids_do_not_meet_each_other(spark):
    """1000 rows without ids, in 100 groups of near copies: a class is compared through one row, and one row of each group stays."""
    rng = random.Random(8)
    pairs = []
    for g in range(100):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        for c in range(10):
            pairs.append((None, " ".join([*base[: 60 - (c > 4)], *(["end"] if c > 4 else [])])))
    docs = frame(spark, pairs).withColumn("row__tag", F.lit("own"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    keys = rows.mapInArrow(minhash_dedup._sign, "doc_id long, tag long, n_shingles long, key binary, bands array<long>, signature binary")
    chosen = keys.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("tag").alias("rep_tag"))
    chosen = chosen.select("*", F.xxhash64("key").alias("vertex"), F.lit(1).cast("long").alias("family"), F.lit(200).cast("long").alias("family_size"))
    assert minhash_dedup._sets_of(rows, chosen).count() == 200
    kept = minhash_dedup.dedupe(docs)
    assert kept.count() == 100 and set(kept.columns) == set(docs.columns) and kept.select("row__tag").distinct().count() == 1
    found = minhash_dedup.near_duplicates(docs)
    assert found.count() == 1000 and found.where("component_id is null and kept").count() == 1000


def test_threshold_is_an_argument(spark):
    words = [f"w{i}" for i in range(104)]
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:]]))])  # 95 of 105 shared: 0.905
    ids = {t: {r.doc_id for r in minhash_dedup.dedupe(docs, threshold=t).collect()} for t in (80, 90, 91)}
    assert ids == {80: {1}, 90: {1}, 91: {1, 2}}
    with pytest.raises(ValueError):
        minhash_dedup.dedupe(docs, threshold=50)
