"""Percentiles, shares, running means and common prefixes as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truthy(x: Column) -> Column:
    """Neither null nor zero."""
    return x.isNotNull() & (x != 0)


#: Buckets of values: so many to each doubling.
STEPS = 64


def _bucket(v: Column) -> Column:
    """A number that grows with the value, the same for values within about a hundredth of each other."""
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    size = F.floor(STEPS * F.log2(F.when(finite, F.abs(v)))) + 2048 * STEPS
    end = F.lit(4096 * STEPS).cast("long")
    return F.when(F.isnan(v), end + 1).when(v == float("inf"), end).when(v == float("-inf"), -end).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def grouped_alike(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the keys are a's."""
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    joined = a.join(b, on, how)
    for k in keys:
        joined = joined.drop(b[k])
    return joined


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], nearest: bool = False) -> DataFrame:
    """Exact percentiles: one row per group, a column per name of wanted, each (value column, q).

    With linear interpolation at q * (n - 1), or, if nearest, sorted[min(int(q *
    n), n - 1)]. Nulls are left out; a group without values has nulls (nearest:
    0.0). Infinities are the least and greatest values, NaN comes after them; a
    rank between two equal values, infinite ones too, is that value.

    The frame is read once, into counts of distinct values. No task holds a
    group: the counts are summed by bucket, a bounded table; the buckets that
    hold the wanted ranks follow from its running sums, and only their distinct
    values are put in order. So a hot group costs what its counts cost, unless
    nearly all its distinct values lie within a hundredth of each other.
    """
    names = list(wanted)
    columns = sorted({c for c, _ in wanted.values()})
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_x"))
    every = long.select(*keys, "_x._c", "_x._v").groupBy(*keys, "_c", "_v").agg(F.count("*").alias("_n"))
    counts = every.where("_v IS NOT NULL").withColumn("_b", _bucket(F.col("_v")))
    by_bucket = counts.groupBy(*keys, "_c", "_b").agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*keys, "_c")
    by_bucket = by_bucket.withColumns({"_total": F.sum("_m").over(group), "_upto": F.sum("_m").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))})
    total, before = F.col("_total"), F.col("_upto") - F.col("_m")
    asked = []
    for i, name in enumerate(names):
        c, q = columns.index(wanted[name][0]), F.lit(wanted[name][1])
        at = F.least(F.floor(q * total), total - 1).cast("double") if nearest else q * (total - 1)
        for side, rank in ((0, F.floor(at)), (1, F.ceil(at))):
            asked.append(F.when(F.col("_c") == c, F.struct(F.lit(2 * i + side).alias("id"), rank.cast("long").alias("rank"), (at - F.floor(at)).alias("part"))))
    here = F.filter(F.array_compact(F.array(*asked)), lambda r: (r["rank"] >= before) & (r["rank"] < F.col("_upto")))
    some = by_bucket.select(*keys, "_c", "_b", before.alias("_before"), here.alias("_here")).where(F.size("_here") > 0)
    inside = Window.partitionBy(*keys, "_c", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = grouped_alike(counts, some, [*keys, "_c", "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    hit = F.filter("_here", lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_n")))
    found = placed.select(*keys, "_v", F.explode(hit).alias("_r"))
    value = lambda i: F.max(F.when(F.col("_r.id") == i, F.col("_v")))
    part = lambda i: F.max(F.when(F.col("_r.id") == 2 * i, F.col("_r.part")))
    between = lambda i: F.when(value(2 * i) == value(2 * i + 1), value(2 * i)).otherwise(value(2 * i) + (value(2 * i + 1) - value(2 * i)) * part(i))
    out = found.groupBy(*keys).agg(*[between(i).alias(n) for i, n in enumerate(names)])
    if not keys:
        return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names}) if nearest else out
    out = grouped_alike(every.select(*keys).distinct(), out, keys, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names}) if nearest else out


def nearest_rank(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """sorted[min(int(q * n), n - 1)] per group, 0.0 for a group without values."""
    return quantiles(df, keys, {name: (value, q) for name, q in qs.items()}, nearest=True)


def share(n: Column, *keys: str) -> Column:
    """A count's share of the total, over all rows or within keys."""
    return n / F.sum(n).over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(1)]))


def ewma_step(state: Column, x: Column, alpha: float) -> Column:
    """(rtt, jitter, n): jitter moves towards the distance from the mean before this sample; null is skipped."""
    first = F.struct(x.alias("rtt"), F.lit(0.0).alias("jitter"), F.lit(1).cast("long").alias("n"))
    # mean + alpha * (x - mean), as written, so that results agree to the last bit.
    moved = F.struct(
        (state["rtt"] + alpha * (x - state["rtt"])).alias("rtt"),
        (state["jitter"] + alpha * (F.abs(x - state["rtt"]) - state["jitter"])).alias("jitter"),
        (state["n"] + 1).alias("n"),
    )
    return F.when(x.isNull(), state).when(state["rtt"].isNull(), first).otherwise(moved)


EWMA = "struct<rtt:double,jitter:double,n:bigint>"


def ewma(samples: Column, alpha: float = 0.2) -> Column:
    """Fold an ordered array of samples into (rtt, jitter, n)."""
    zero = F.struct(F.lit(None).cast("double").alias("rtt"), F.lit(None).cast("double").alias("jitter"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(samples, zero.cast(EWMA), lambda s, x: ewma_step(s, x, alpha).cast(EWMA))


def common_prefix(text: Column) -> Column:
    """Longest common prefix of a group's texts: that of its least and greatest."""
    low, high = F.split(F.min(text), ""), F.split(F.max(text), "")
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.min(text)).otherwise(F.left(F.min(text), (first - 1).cast("int")))
