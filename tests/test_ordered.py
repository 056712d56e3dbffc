import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key; some keys have gaps between buckets."""
    rng = random.Random(7)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(20)}"
        data.append((i, key, rng.randrange(400), rng.choice("abc")))
    df = spark.createDataFrame(data, "i long, key string, at long, v string").withColumn("b", F.floor(F.col("at") / 25))
    return data, df


def test_row_number_over_buckets(skewed):
    data, df = skewed
    got = {r["i"]: r["n"] for r in ordered.row_number(df, ["key"], "b", ["at", "i"], "n").collect()}
    want, seen = {}, {}
    for i, key, at, _ in sorted(data, key=lambda d: (d[1], d[2], d[0])):
        want[i] = seen.get(key, 0)
        seen[key] = want[i] + 1
    assert got == want


def test_previous_over_buckets(skewed):
    data, df = skewed
    got = {r["i"]: r["p"] for r in ordered.previous(df, ["key"], "b", ["at", "i"], "v", "p").collect()}
    want, last = {}, {}
    for i, key, at, v in sorted(data, key=lambda d: (d[1], d[2], d[0])):
        want[i] = last.get(key)
        last[key] = v
    assert got == want


def test_last_before(skewed):
    data, df = skewed
    facts = df.filter("i % 2 = 0").select("key", "at", F.col("i").alias("fact"))
    probes = df.filter("i % 2 = 1").select("key", "at", "i")
    found = ordered.last_before(probes, facts, ["key"], "at", F.floor(F.col("at") / 25), "fact", "hit")
    got = {r["i"]: r["hit"] for r in found.collect()}
    for i, key, at, _ in data:
        if i % 2:
            older = [(a, j) for j, k, a, _ in data if j % 2 == 0 and k == key and a <= at]
            assert got[i] == (max(older)[1] if older else None)
