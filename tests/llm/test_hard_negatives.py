import math
import random

from pyspark.sql import functions as F

from skein.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, at string, score int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def brute(spark, rows, every=100):
    """Over rows; floats as Spark has them."""
    rows = [tuple(r)[:3] for r in table(spark, rows).collect()]
    able = [(i, [math.floor(256 * x) for x in v], (n + 1) % 10 if i is not None and i % 7 == 0 else n) for i, v, n in rows if n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, v, n) in enumerate(able):
        if i is None or i % every:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), j, m == n) for b, (j, w, m) in enumerate(able) if b != a]
        for p, j, _ in sorted((s for s in score if s[2]), key=key)[:5]:
            fits = sorted((s for s in score if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=key)[:10]
            out += [(i, j, k, s[1], p, s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(df):
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    got = h.mine(df, vec_id % 100 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(rng, n, dims, size=1.0):
    return [(i, [rng.gauss(0.4, 1) * size for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def test_brute_force_in_several_blocks_and_steps(spark, monkeypatch):
    rng = random.Random(0)
    rows = vectors(rng, 700, 8)
    rows += [(1000 + i, rows[100][1], i % 4) for i in range(300)]  # a hot vector: ties go by id
    nan, inf = float("nan"), float("inf")
    rows += [(2000, [nan] * 8, 1), (2100, [inf] + [0.0] * 7, 1), (2200, None, 1), (2300, [1.0] * 8, None), (2400, [None, 1.0], 1), (None, [1.0] * 8, 1), (None, [1.0] * 8, 2), (2500, [], 1), (2600, [0.5, 0.5], 0), (-100, [0.3] * 8, 1), (-101, [0.3] * 8, 2)]
    want = brute(spark, rows)
    assert want and mined(table(spark, rows)) == want
    monkeypatch.setattr(h, "BLOCK_BYTES", 8 * 8 * 2)  # two anchors
    monkeypatch.setattr(h, "STEP_BYTES", 8 * 64)
    assert mined(table(spark, rows)) == want


def test_repeated_rows_are_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.5, 0.0], 2), (2, [0.5, 0.1], 2), (2, [0.5, 0.1], 2)]
    assert mined(table(spark, rows)) == brute(spark, rows) != []


def test_large_components_are_exact(spark):
    rows = vectors(random.Random(1), 300, 16, 1e5)  # products beyond 2^53
    assert mined(table(spark, rows)) == brute(spark, rows) != []
    huge = [(0, [1e38, 1.0], 1), (100, [1e38, 2.0], 1), (3, [1.0, 2.0], 2)]
    mined(table(spark, huge))  # held within 64 bits


def test_windows_round_towards_the_inside():
    low, high = h._bounds([7, -7, 0, 2**60], 30, 90)
    assert low.tolist() == [3, -2, 0, -(-(2**60) * 30 // 100)] and high.tolist() == [6, -7, 0, 2**60 * 90 // 100]


def test_nothing_to_mine(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 1)])) == []
    assert mined(table(spark, [(0, [1.0], 1), (1, [1.0], 2)])) == []
