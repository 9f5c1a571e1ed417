"""Replay policies over recorded calls: features, decisions, reports, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.stats import share
from skein.operators import policies
from skein.operators.experiments import grid
from skein.operators.features import extract
from skein.operators.windows import cache_temperature, session_gaps
from skein.sources.traces import calls, session_id


def prepare(records: DataFrame, use_recorded: bool = False) -> DataFrame:
    """Calls with session gaps and features. Recorded features are those before any rewrite of a local call."""
    own = calls(records).withColumn("session", session_id(F.col("headers")))
    gaps = session_gaps(own, "session", "ts", ["file", "line"])
    recorded = F.col("features") if "features" in own.columns else None
    out = extract(gaps.withColumnRenamed("features", "_recorded") if recorded is not None else gaps, "request", "gap_s")
    if use_recorded and recorded is not None:
        kind = out.schema["features"].dataType
        known = F.try_variant_get("_recorded", "$", kind.simpleString())
        out = out.withColumn("features", F.coalesce(known, F.col("features")))
    return out.drop("_recorded")


def decide(df: DataFrame, policy, features: Column | None = None) -> DataFrame:
    """Add placement, reason and detail of one policy."""
    d = policy.decide(F.col("features") if features is None else features)
    return df.withColumn("_d", d).select(*df.columns, *[F.col(f"_d.{c}").alias(f"decided_{c}" if c in df.columns else c) for c in ("placement", "reason", "detail")])


def report(decided: DataFrame, *keys: str) -> DataFrame:
    """Count and share by placement and reason."""
    n = decided.groupBy(*keys, "placement", "reason").agg(F.count("*").alias("n"))
    return n.withColumn("share", share(F.col("n"), *keys))


def confusion(df: DataFrame, recorded: str, decided: str) -> DataFrame:
    """Pairs of recorded and decided placement; calls without a recorded one are left out."""
    return df.where(F.col(recorded).isNotNull()).groupBy(F.col(recorded).alias("recorded"), F.col(decided).alias("decided")).agg(F.count("*").alias("n")).orderBy("recorded", "decided")


def sweep(
    spark: SparkSession, df: DataFrame, caps: list[int] = [32_000, 65_536, 131_072], clamps: list[int | None] = [None, 4096],  # noqa: B006
    tools: list[bool] = [False, True], margin: float = 0.9,  # noqa: B006
) -> DataFrame:
    """Local calls per static configuration. Calls are first counted per distinct feature combination
    that a placement reads, so the grid multiplies groups and not calls."""
    f = F.col("features")
    groups = df.groupBy(f["est_prompt_tokens"].alias("est"), f["max_tokens"].alias("asked"), f["has_tools"].alias("has_tools"), f["has_server_tools"].alias("server")).agg(F.count("*").alias("n"))
    axes = grid(spark, cap=caps, tools=tools).crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in clamps], "clamp int")))
    budget = F.floor(F.col("cap") * F.lit(margin))
    room = F.greatest(F.lit(0), budget - F.col("est"))
    asked = F.when(F.col("clamp").isNull(), F.col("asked")).otherwise(F.greatest(F.lit(1), F.least(F.col("asked"), F.col("clamp"), room)))
    local = ~F.col("server") & (F.col("est") + asked <= budget) & (F.col("tools") | ~F.col("has_tools"))
    return groups.crossJoin(F.broadcast(axes)).groupBy("cap", "clamp", "tools").agg(
        F.coalesce(F.sum(F.when(local, F.col("n"))), F.lit(0)).alias("n_local"), F.sum("n").alias("n_calls")
    )


def temperatures(df: DataFrame) -> DataFrame:
    f = F.col("features")
    return df.groupBy(cache_temperature(f["seconds_since_last_call"], f["cloud_cache_ttl_s"]).alias("temperature")).agg(F.count("*").alias("n"))


def ttl_histogram(df: DataFrame) -> DataFrame:
    ttl = F.col("features.cloud_cache_ttl_s")
    return df.where(ttl.isNotNull()).groupBy(ttl.alias("ttl_s")).agg(F.count("*").alias("n")).orderBy("ttl_s")


def policy(name: str, cap: int = 65_536, clamp: int | None = 4096, tools: bool = True):
    return policies.Static(cap=cap, clamp=clamp, local_tools=tools) if name == "static" else policies.build(name)


def export(df: DataFrame, path: str) -> None:
    """Decisions as JSON lines, nulls written."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
