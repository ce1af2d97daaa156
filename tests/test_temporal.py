import datetime as dt
import random

import pytest

from paperloom.operators import temporal


def rows(seed, n, keys=("a", "b", None)):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.choice([None, *range(60)]), i) for i in range(n)]


def asof(left, right, within=None):
    out = []
    for k, t, i in left:
        fits = [(u, (x, u, j)) for x, u, j in right if None not in (k, t, u) and x == k and u <= t]
        best = max(fits, default=None)
        out.append((i, best[1][2] if best and (within is None or t - best[0] <= within) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bins,within", [(1000.0, None), (7.0, None), (1.0, 5)])
def test_asof_against_plain_search(spark, bins, within):
    left, right = rows(1, 120) + [("c", 5, 998), ("a", 30, 999)], rows(2, 60) + [("a", 30, 1), ("a", 30, 7)]
    df = lambda r: spark.createDataFrame(r, "k string, t int, id long")
    got = temporal.asof_join(df(left), df(right), ["k"], "t", bins, within)
    assert got.columns == ["k", "t", "id", "r_k", "r_t", "r_id"]
    assert sorted(((r.id, r.r_id) for r in got.collect()), key=str) == asof(left, right, within)
    assert temporal.asof_join(df([]), df(right), ["k"], "t").count() == 0
    assert {r.r_id for r in temporal.asof_join(df(left), df([]), ["k"], "t").collect()} == {None}


def test_asof_of_times(spark):
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([("a", at(100), 1), ("a", at(5), 2), ("b", at(1), 3)], "k string, ts timestamp, id long")
    right = spark.createDataFrame([("a", at(4), 10), ("a", at(6), 11), ("b", at(2), 12)], "k string, ts timestamp, id long")
    got = {r.id: r.r_id for r in temporal.asof_join(left, right, ["k"], "ts").collect()}
    assert got == {1: 11, 2: 10, 3: None}
    plan = temporal.asof_join(left, right, ["k"], "ts")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_intervals_against_plain_search(spark, width):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.choice([None, *[x / 4 for x in range(-80, 400)]]), i) for i in range(150)]
    spans = []
    for i in range(80):
        a = rng.randint(-20, 90)
        spans.append((rng.choice(["a", "b", None]), float(a), rng.choice([None, a + 0.0, a - 1.0, a + 0.25, a + 3.0, a + 40.0]), i))
    p = spark.createDataFrame(points, "k string, x double, id long")
    s = spark.createDataFrame(spans, "k string, lo double, hi double, id long")
    got = sorted((r.id, r.r_id) for r in temporal.interval_join(p, s, ["k"], "x", "lo", "hi", width).collect())
    assert got == sorted((i, j) for k, x, i in points for q, lo, hi, j in spans if k == q and None not in (x, hi) and lo <= x < hi)
    assert temporal.interval_join(p, s.limit(0), ["k"], "x", "lo", "hi").count() == 0
