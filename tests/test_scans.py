"""Running values over keys of any size: many small ranges, hot keys, nulls, ties."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import scans, windows
from skein.tables import in_ranges


@pytest.fixture
def ranges(spark):
    """Sixteen ranges, however small the table."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def samples(n, seed=0):
    """A key with a third of the rows, some small ones, rows without a key, samples that are null or NaN."""
    rng = random.Random(seed)
    return [
        (i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{rng.randrange(40)}", float(rng.randrange(n // 2)), None if rng.random() < 0.1 else float("nan") if rng.random() < 0.02 else rng.uniform(0, 500), 2**53 + 1 + i)
        for i in range(n)
    ]


def estimates(rows, alpha):
    out, state = {}, {}
    for i, k, ts, x, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        m, j, n, at = state.get(k, (None, None, 0, None))
        if x is not None and x == x:
            m, j = (x, 0.0) if m is None else (m + alpha * (x - m), j + alpha * (abs(x - m) - j))
            n, at = n + 1, ts
        state[k] = m, j, n, at
        out[i] = m, j, n, None if at is None else ts - at
    return out


@pytest.mark.parametrize("alpha", [0.2, 0.99, 1e-4])
def test_running_estimates_in_many_ranges(ranges, monkeypatch, alpha):
    monkeypatch.setattr(scans, "LONGEST", 7)  # several sections in each range
    rows = samples(1500)
    df = ranges.createDataFrame(rows, "id long, k string, ts double, x double, big long")
    want = estimates(rows, alpha)
    got = windows.running_ewma(df, "k", "ts", "x", alpha, ["id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        for have, need in zip((r["rtt_ewma"], r["jitter_ewma"], r["n_samples"], r["staleness_s"]), want[r["id"]]):
            assert have == pytest.approx(need, rel=1e-9, abs=1e-9) if need is not None else have is None, (r, want[r["id"]])
        assert r["big"] == 2**53 + 1 + r["id"]  # carried columns stay as they are


def test_ranges_are_balanced_and_a_hot_key_spans_several(ranges):
    df = ranges.createDataFrame(samples(4000), "id long, k string, ts double, x double, big long")
    t = in_ranges(df, "k", "ts", "id")
    n = [r["count"] for r in t.groupBy("_block").count().collect()]
    assert len(n) == 16 and max(n) < 3 * 4000 / 16
    assert t.where("k = 'hot'").select("_block").distinct().count() >= 4
    plan = windows.running_ewma(df, "k", "ts", "x", order=["id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_gaps_in_many_ranges(ranges):
    rows = samples(1500, 3)
    df = ranges.createDataFrame([(i, "" if k == "k1" else k, None if i % 50 == 0 else ts + 0.04, b) for i, k, ts, _, b in rows], "id long, k string, ts double, gap_s long")
    last, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["ts"] or 0, r["id"])):
        if r["k"] and r["ts"] is not None:
            want[r["id"]] = round(r["ts"] - last[r["k"]], 1) if r["k"] in last else None
            last[r["k"]] = r["ts"]
    got = {r["id"]: r["gap_s"] for r in windows.session_gaps(df, "k", "ts", ["id"]).collect()}
    assert got == {i: want.get(i) for i in range(len(rows))}


def test_gap_is_rounded_before_it_meets_a_lifetime(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 300.04), (3, "a", 600.2)], "id long, s string, ts double")
    gap = windows.session_gaps(df, "s", "ts", ["id"])
    got = {r["id"]: r["t"] for r in gap.select("id", windows.cache_temperature(F.col("gap_s"), F.lit(300.0)).alias("t")).collect()}
    assert got == {1: "first", 2: "warm", 3: "cold"}


def test_latest_sample_in_a_busy_hour(ranges):
    rng = random.Random(5)
    times = [float(rng.randrange(200)) for _ in range(1000)]
    recs = [(i, None if i % 40 == 0 else t, "x") for i, t in enumerate(times)]
    obs = [(i, None if i % 30 == 0 else float(rng.randrange(5, 200)), rng.random()) for i in range(300)]
    r = ranges.createDataFrame(recs, "id long, ts double, sample string")
    s = ranges.createDataFrame(obs, "seq long, ts double, v double")
    got = {x["id"]: (x["sample"], x["age_s"]) for x in windows.latest_sample(r, s, "ts", "v", ["seq"]).collect()}
    for i, t, _ in recs:
        known = [o for o in obs if t is not None and o[1] is not None and o[1] <= t]
        best = max(known, key=lambda o: (o[1], o[0]), default=None)
        assert got[i] == ((best[2], t - best[1]) if best else (None, None))


def test_totals_and_least(ranges):
    rows = samples(800, 9)
    df = ranges.createDataFrame(rows, "id long, k string, ts double, x double, big long")
    t = in_ranges(df, "ts", "id")
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        total += r[0]
        want[r[0]] = total
    assert {r["id"]: r["s"] for r in scans.running_total(t, F.col("id"), ["ts", "id"], "s").collect()} == want
    t = in_ranges(df.where("x IS NOT NULL AND NOT isnan(x)"), "k", "ts", "id")
    least, want = {}, {}
    for r in sorted((r for r in rows if r[3] is not None and r[3] == r[3]), key=lambda r: (r[2], r[0])):
        want[r[0]] = least.get(r[1])
        least[r[1]] = min(least.get(r[1], r[3]), r[3])
    assert {r["id"]: r["m"] for r in scans.running_least(t, "k", F.col("x"), ["ts", "id"], "m").collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "id long, k string, ts double, x double")
    assert windows.running_ewma(df, "k", "ts", "x", order=["id"]).collect() == []
    assert windows.session_gaps(df, "k", "ts", ["id"]).collect() == []
    assert windows.latest_sample(df, df.select("ts", F.col("x").alias("v")), "ts", "v").collect() == []
