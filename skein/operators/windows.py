"""Lags, running estimates and latest samples over ordered records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.scans import decaying, last_before, of_first_key, sizes
from skein.tables import BLOCK, in_ranges


def session_gaps(df: DataFrame, session: str, ts: str, order: list[str], out: str = "gap_s", places: int | None = 1) -> DataFrame:
    """Seconds since the session's last record, to one decimal; null for a first record and where session or time is missing.

    Records without a time or with a null or empty session neither get a gap nor
    count as a last record. Sessions may be of any size: rows lie in ranges, and
    a session's last time is carried from range to range. places None leaves gaps
    unrounded.
    """
    some = F.coalesce((F.col(session).cast("string") != "") & F.col(ts).isNotNull(), F.lit(False))
    columns = [c for c in df.columns if c != out]
    gap = F.col(ts) - F.col("_last")
    t = last_before(in_ranges(df.where(some).select(*columns), session, ts, *order), session, F.col(ts), [ts, *order], "_last")
    with_gap = t.select(*columns, (gap if places is None else F.bround(gap, places)).alias(out))
    return with_gap.unionByName(df.where(~some).select(*columns, F.lit(None).cast(with_gap.schema[out].dataType).alias(out)))


def cache_temperature(gap: Column, ttl: Column) -> Column:
    """uncached without a lifetime, first without a gap, else warm within the lifetime and cold beyond."""
    return F.when(ttl.isNull(), "uncached").when(gap.isNull(), "first").when(gap <= ttl, "warm").otherwise("cold")


def running_ewma(df: DataFrame, key: str, ts: str, value: str, alpha: float = 0.2, order: Sequence[str] = ()) -> DataFrame:
    """Each row with the estimate after it: rtt, jitter, n and seconds since the last sample.

    The mean starts with a key's first sample, the jitter with 0; jitter moves
    towards the distance from the mean before the sample. Null and NaN samples
    are skipped. Rows of equal time are taken by the columns of order. Rows
    without a key are a key of their own. alpha lies between 0 and 1. Columns
    that have the names of the results are replaced, all others stay as they are.

    Both estimates are prefix scans (see scans): first the mean, then, once the
    means are known, the jitter. Keys may be of any size.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    columns = [c for c in df.columns if c not in ("rtt_ewma", "jitter_ewma", "n_samples", "staleness_s")]
    by = list(dict.fromkeys([ts, *order]))
    x = F.col(value).cast("double")
    t = in_ranges(df.select(*columns, F.when(~F.isnan(x), x).alias("_x")), key, *by)
    size = sizes(t)
    upto = Window.partitionBy(key, BLOCK).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    mean = decaying(t, key, by, "_x", 1 - alpha, size, "rtt_ewma", True, "_prev")
    sampled = F.when(F.col("_x").isNotNull(), F.col(ts))
    counted = mean.withColumns({"_n": F.count("_x").over(upto), "_at": F.last(sampled, ignorenulls=True).over(upto)})
    ends = t.groupBy(key, BLOCK).agg(F.count("_x").alias("_n"), F.max(sampled).alias("_at"))
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = of_first_key(ends.withColumns({"_n0": F.sum("_n").over(before), "_at0": F.max("_at").over(before)}), key, "_n0", "_at0")
    both = counted.join(F.broadcast(carry), BLOCK)
    same = F.col(key).eqNullSafe(F.col("_of"))
    both = both.withColumns({"n_samples": F.col("_n") + F.coalesce(F.when(same, F.col("_n0")), F.lit(0)), "_at": F.coalesce("_at", F.when(same, F.col("_at0")))})
    # A sample's distance from the mean before it; a key's first sample has none.
    both = both.withColumn("_d", F.when(F.col("_x").isNotNull(), F.coalesce(F.abs(F.col("_x") - F.col("_prev")), F.lit(0.0))))
    out = decaying(both.select(*t.columns, "rtt_ewma", "n_samples", "_at", "_d"), key, by, "_d", 1 - alpha, size, "jitter_ewma", False)
    return out.select(*columns, "rtt_ewma", "jitter_ewma", "n_samples", (F.col(ts) - F.col("_at")).alias("staleness_s"))


def latest_sample(records: DataFrame, samples: DataFrame, ts: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """As-of attach: the last sample at or before each record, and its age; of samples of one time the later by order.

    There is one sample stream for all records. Both lie together in ranges of
    time of about equal numbers of rows, so a busy hour is many ranges; the last
    sample before a range is its carry. Records without a time get nulls, samples
    without a time are left out. Columns named sample and age_s are replaced.
    """
    columns = [c for c in records.columns if c not in ("sample", "age_s")]
    timed = F.col(ts).isNotNull()
    # Samples of a time come before its records; equal records may be dealt anywhere.
    s = samples.where(timed).select(F.col(ts).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.lit(None).cast("long").alias("deal"), *order).alias("_order"), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_s"))
    fields = s.schema["_order"].dataType
    deal = F.struct(F.xxhash64(*[F.col(c).cast("string") for c in columns]).alias("deal"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields[1:]])
    r = records.where(timed).select(F.col(ts).alias("_t"), F.lit(1).alias("_kind"), deal.alias("_order"), F.struct(*columns).alias("_r"))
    t = in_ranges(r.unionByName(s, allowMissingColumns=True), "_t", "_kind", "_order")
    here = Window.partitionBy(BLOCK).orderBy("_t", "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    ends = t.groupBy(BLOCK).agg(F.max_by("_s", F.when(F.col("_kind") == 0, F.struct("_t", "_order"))).alias("_end"))
    # One row a range.
    carry = ends.select(BLOCK, F.last("_end", ignorenulls=True).over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    seen = t.withColumn("_hit", F.last("_s", ignorenulls=True).over(here)).where("_kind = 1").join(F.broadcast(carry), BLOCK)
    hit = F.coalesce("_hit", "_carry")
    out = seen.select(*[F.col("_r")[c].alias(c) for c in columns], hit["v"].alias("sample"), (F.col("_t") - hit["t"]).alias("age_s"))
    untimed = records.where(~timed).select(*columns, *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("sample", "age_s")])
    return out.unionByName(untimed)
