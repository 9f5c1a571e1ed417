"""Summary of a trace as separate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.stats import common_prefix, nearest_rank, quantiles, truthy
from skein.operators.features import system_text


def counts(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows per value, most first; ties in the order first seen."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def status_counts(df: DataFrame, order: str) -> DataFrame:
    """Counts by status, only if some status is not 200 (a missing one is not)."""
    n = counts(df, "status", order)
    bad = df.select(F.count_if(~F.col("status").eqNullSafe(200)).alias("bad"))
    return n.join(F.broadcast(bad.where("bad > 0")), F.lit(True), "left_semi").orderBy(F.desc("n"), "first_seen")


def call_classes(df: DataFrame) -> DataFrame:
    tools = F.coalesce(F.size(F.try_variant_get("request", "$.tools", "array<variant>")), F.lit(0)) > 0
    return df.groupBy(F.when(tools, "with tools").otherwise("without tools").alias("class")).agg(F.count("*").alias("n"))


def token_summary(df: DataFrame) -> DataFrame:
    """Sums and medians; failed calls count as 0. Reuse leaves out cache creation, and is null if nothing was read."""
    use = lambda n: F.coalesce(F.try_variant_get("usage", f"$.{n}", "bigint"), F.lit(0))
    own = df.select(*[use(f"{n}_tokens" if "put" in n else f"{n}_input_tokens").alias(n) for n in ("input", "output", "cache_read", "cache_creation")])
    read = F.sum("cache_read")
    sums = own.agg(*[F.sum(c).alias(f"sum_{c}") for c in own.columns], F.try_divide(read, F.sum("input") + read).alias("prefix_reuse"))
    middle = quantiles(own, [], {"median_input": ("input", 0.5), "median_output": ("output", 0.5)})
    return sums.crossJoin(F.broadcast(middle))  # one row each


def latency(df: DataFrame) -> DataFrame:
    """Nearest-rank latencies; 0 and null are left out."""
    out = None
    for m in ("ttft_ms", "total_ms"):
        x = df.select(F.lit(m).alias("metric"), F.try_variant_get("timing", f"$.{m}", "double").alias("ms"))
        one = nearest_rank(x.where(truthy(F.col("ms"))), ["metric"], "ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
        out = one if out is None else out.unionByName(one)
    return out


def system_prefix(df: DataFrame) -> DataFrame:
    """The longest common beginning of all system prompts, and its estimated tokens."""
    p = df.select(system_text(F.col("request")).alias("t")).where("t <> ''").agg(common_prefix(F.col("t")).alias("prefix"))
    return p.withColumn("est_tokens", F.floor(F.length("prefix") / 4))


def tool_uses(df: DataFrame, top: int = 15, order: str = "line") -> DataFrame:
    """Tool calls by name, most first."""
    used = df.select(F.explode(F.try_variant_get("response", "$.content", "array<struct<type:string,name:string>>")).alias("b"), order)
    return counts(used.where("b.type = 'tool_use'").select(F.col("b.name").alias("tool"), order), "tool", order).limit(top)
