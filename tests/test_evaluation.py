"""Judging replays: equal actions, survival, frontiers, fits and concurrency against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import evaluation as e

from .test_scans import ranges  # noqa: F401


def test_equal_actions(spark):
    pairs = [
        ({"a": 1, "b": {"c": [1, 2], "d": 1.50}}, {"b": {"d": 1.5, "c": [1, 2]}, "a": 1.0}, True), ({"a": [1, 2]}, {"a": [2, 1]}, False), ("Hello  World ", "hello world", True), ("a", "b", False),
        ({"a": None}, {}, False), ({"a": "xé"}, {"a": "xé"}, True), (1, "1", False), ({"a": "A"}, {"a": "a"}, False),
    ]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    got = {r["i"]: r["s"] for r in df.select("i", e.same_action(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {i: p[2] for i, p in enumerate(pairs)}
    null = df.limit(1).select(e.same_action(F.lit(None).cast("variant"), F.lit(None).cast("variant")), e.same_action(F.col("a"), F.lit(None).cast("variant"))).first()
    assert tuple(null) == (True, False)


def test_survival(spark):
    rng = random.Random(0)
    rows = [(s, k, rng.random() > 0.1 if rng.random() > 0.02 else None) for s in range(200) for k in range(1, rng.randint(2, 12))]
    h = e.horizons(spark.createDataFrame(rows, "s int, k int, ok boolean"), "s", "k", F.col("ok")).cache()
    ends = {}
    for s, k, ok in rows:
        if ends.get(s, (0, False))[1] is False:
            ends[s] = (k, not ok)
    assert {r["s"]: (r["horizon"], r["diverged"]) for r in h.collect()} == ends
    alive, got = 1.0, {r["step"]: r for r in e.survival(h).collect()}
    for step in sorted({k for k, _ in ends.values()}):
        risk, gone = sum(k >= step for k, _ in ends.values()), sum(k == step and d for k, d in ends.values())
        alive *= 1 - gone / risk
        assert (got[step]["at_risk"], got[step]["n_diverged"]) == (risk, gone) and got[step]["survival"] == pytest.approx(alive)
    all_gone = spark.createDataFrame([(1, 3, True), (2, 3, True)], "s int, horizon int, diverged boolean")
    assert e.survival(all_gone).first()["survival"] == 0.0


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, None], [1.0, 1.0]), (None, [1.0]), ([-2.0, -2.0], [1.0, 1.0]), ([], [])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(e.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2**-0.5), None, None, None, None, pytest.approx(-1.0), None]


def test_pareto(ranges):  # noqa: F811
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "hot", "hot", None]), None if i % 50 == 0 else rng.randrange(60), rng.randrange(60)) for i in range(900)]
    got = {r["i"] for r in e.pareto(ranges.createDataFrame(rows, "i int, g string, x int, y int"), "g", "x", "y").collect()}
    some = [r for r in rows if r[2] is not None]
    assert got == {i for i, g, x, y in some if not any(h == g and p <= x and q <= y and (p, q) != (x, y) for _, h, p, q in some)}


def test_fits(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(x), float(3 * x + 1 if x < 5 else 16 + rng.normal() * 0.1), bool(i % 3)) for g in ("a", None) for i, x in enumerate(rng.integers(0, 12, 200))] + [("b", None, 1.0, True), ("b", 1.0, 2.0, False)]
    df = spark.createDataFrame(rows, "g string, x double, y double, train boolean")
    got = {r["g"]: r for r in e.fitted(df, "g", "x", "y", F.col("train")).collect()}
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        slope, intercept = np.polyfit([r[1] for r in own if r[3]], [r[2] for r in own if r[3]], 1)
        off = [r[2] - slope * r[1] - intercept for r in own if not r[3]]
        assert (got[g]["slope"], got[g]["intercept"]) == pytest.approx((slope, intercept))
        assert (got[g]["holdout_mae"], got[g]["holdout_rmse"]) == pytest.approx((np.mean(np.abs(off)), np.sqrt(np.mean(np.square(off)))))
    assert got["b"]["slope"] is None and got["b"]["holdout_mae"] is None
    two = {r["g"]: r for r in e.fitted_in_two(df, "g", "x", "y", F.col("train")).collect()}
    assert two["a"]["break_x"] in (4.0, 5.0) and two["a"]["sse_two"] < 0.1 * two["a"]["sse_one"]


def test_concurrency(ranges):  # noqa: F811
    rng = random.Random(7)
    calls = []
    for i in range(400):
        b = float(rng.randrange(100))
        calls.append((i, b, None if i % 40 == 0 else b + rng.randrange(0, 9)))
    calls.append((1000, 5.0, 4.0))
    df = ranges.createDataFrame(calls, "i int, b double, f double")
    points = e.in_flight(df, "i", "b", "f").cache()
    order, level, want, spans, was = [], 0, {}, {}, None
    for i, b, f in calls:
        if f is not None and f >= b:
            order += [(b, 1, i, 1), (f, 2 if f == b else 0, i, -1)]
    for time, kind, i, change in sorted(order):
        if was is not None:
            s, n = spans.get(level, (0.0, 0))
            spans[level] = (s + time - was, n + (change < 0))
        level, was = level + change, time
        want[i, kind] = level
    assert {(r["i"], r["kind"]): r["level"] for r in points.collect()} == want and level == 0
    curve = e.throughput(points, "i").cache()
    assert {r["level"]: (r["seconds"], r["n_ended"]) for r in curve.collect()} == {k: pytest.approx(v) for k, v in spans.items()}
    bends = e.knee(curve, "level", "per_second").collect()
    assert sum(r["is_knee"] for r in bends) == 1 and max(bends, key=lambda r: (r["bend"], -r["level"]))["is_knee"]
    line = ranges.createDataFrame([(1, 1.0), (2, 1.9), (3, 2.0), (4, 2.1)], "x int, y double")
    assert [r["x"] for r in e.knee(line, "x", "y").where("is_knee").collect()] == [2]
