"""Range joins against plain comparison."""

import random
from collections import Counter
from datetime import timedelta

import pytest

from conftest import naive
from loomwork.operators import ranges


def tables(spark):
    """One person has most rows, a third of them at the same moment."""
    rng, start = random.Random(6), naive(2024, 1, 1)

    def at():
        return start if rng.random() < 0.3 else start + timedelta(microseconds=rng.randrange(4 * 3600 * 10**6))

    left = [(rng.choice(["hot"] * 8 + ["a", "b", None]), at() if rng.random() < 0.97 else None, i) for i in range(220)]
    right = [(rng.choice(["hot"] * 8 + ["a", "c", None]), at() if rng.random() < 0.97 else None, i % 150) for i in range(240)]
    return left, right, spark.createDataFrame(left, "person string, at timestamp, l int"), spark.createDataFrame(right, "person string, seen timestamp, r int")


@pytest.mark.parametrize("before,after,cell", [(600, 0, 4096), (0.5, 3600, 20), (0, 0, 7), (-60, 900, 10), (10**6, 10**6, 50)])
def test_pairs_equal_brute_force(spark, before, after, cell):
    left, right, a, b = tables(spark)
    lo, hi = timedelta(seconds=before), timedelta(seconds=after)
    want = Counter((p, x, i, y, j) for p, x, i in left for q, y, j in right if p and p == q and x and y and x - lo <= y <= x + hi)
    got = ranges.within(a, b, ["person"], "at", "seen", before, after, cell)
    assert got.columns == ["person", "at", "l", "seen", "r"]
    assert Counter(tuple(r) for r in got.collect()) == want and want


def test_no_moment_of_a_busy_person_is_one_task(spark):
    left, right, a, b = tables(spark)
    assert ranges._tiles(b.filter("person = 'hot'").selectExpr("person", "CAST(0 AS LONG) AS _bin"), ["person"], "n", 20).first()["n"] >= 8
    with pytest.raises(ValueError):
        ranges.within(a, b, ["person"], "at", "seen", 5, -6)
    assert ranges.within(a.limit(0), b, ["person"], "at", "seen", 5, 5).count() == 0
