"""Summaries of the link and prefix-cache experiments, and their grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.stats import grouped_alike, quantiles
from skein.functions.timing import tracks

#: Link presets as (delay ms, jitter ms, megabits a second; 0 is unlimited).
PRESETS = {
    "none": (0.0, 0.0, 0.0),
    "colo": (5.0, 1.0, 200.0),
    "branch-office": (20.0, 5.0, 50.0),
    "home-broadband": (30.0, 10.0, 5.0),
    "cellular": (80.0, 40.0, 5.0),
}


def link_valid(status: Column, placement: Column, ttft: Column) -> Column:
    return (status == 200) & (placement == "cloud") & ttft.isNotNull()


def link_summary(rows: DataFrame, tolerance_ms: float = 5.0) -> DataFrame:
    """Per configured delay: medians over valid rows, and their distance to delay 0 (null without one)."""
    metrics = ["shaped_ms", "ttft_ms", "total_ms", "transport_network_ms", "effective_network_ms", "raw_server_ttft_ms", "corrected_server_ttft_ms", "response_headers_ms"]
    key = ["configured_delay_ms"]
    valid = rows.where("valid")
    wanted = {f"median_{m}": (m, 0.5) for m in metrics} | {"p10_ttft_ms": ("ttft_ms", 0.1), "p90_ttft_ms": ("ttft_ms", 0.9)}
    n = rows.groupBy(*key).agg(F.count_if(F.col("valid")).alias("valid_samples"), F.count("*").alias("total_samples")).where("valid_samples > 0")
    groups = grouped_alike(n, quantiles(valid, key, wanted), key, "left")
    base = groups.where("configured_delay_ms = 0").select(*[F.col(f"median_{m}").alias(f"b_{m}") for m in ("ttft_ms", "raw_server_ttft_ms", "corrected_server_ttft_ms")])
    joined = groups.join(F.broadcast(base), F.lit(True), "left")  # one row
    for short, m in (("ttft", "ttft_ms"), ("raw_server", "raw_server_ttft_ms"), ("corrected_server", "corrected_server_ttft_ms")):
        joined = joined.withColumn(f"delta_{short}_vs_zero_ms", F.col(f"median_{m}") - F.col(f"b_{m}"))
    return joined.withColumns(
        {
            "ttft_tracks_shaping": tracks(F.col("delta_ttft_vs_zero_ms"), F.col("median_shaped_ms"), tolerance_ms),
            "corrected_server_stable": tracks(F.col("delta_corrected_server_vs_zero_ms"), F.lit(0.0), tolerance_ms),
        }
    ).drop("b_ttft_ms", "b_raw_server_ttft_ms", "b_corrected_server_ttft_ms")


def prefix_summary(rows: DataFrame) -> DataFrame:
    """Per (total, cached): spread of valid rows and the time saved against the cold group of that total."""
    key = ["total_tokens", "intended_cached_tokens"]
    wanted = {"median_ttft_ms": ("ttft_ms", 0.5), "p10_ttft_ms": ("ttft_ms", 0.1), "p90_ttft_ms": ("ttft_ms", 0.9)}
    n = rows.groupBy(*key).agg(F.count_if(F.col("valid_hit")).alias("valid_samples"), F.count("*").alias("total_samples")).where("valid_samples > 0")
    groups = grouped_alike(n, quantiles(rows.where("valid_hit"), key, wanted), key, "left")
    cold = groups.where("intended_cached_tokens = 0").select("total_tokens", F.col("median_ttft_ms").alias("_cold"))
    return groups.join(cold, "total_tokens", "left").select(
        "total_tokens", "intended_cached_tokens", (F.col("intended_cached_tokens") / F.col("total_tokens")).alias("cached_fraction"),
        "median_ttft_ms", "p10_ttft_ms", "p90_ttft_ms", (F.col("_cold") - F.col("median_ttft_ms")).alias("saved_vs_cold_ms"), "valid_samples", "total_samples",
    )


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of a few parameter lists."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def hit_valid(actual: Column, intended: Column, unit: Column) -> Column:
    return F.abs(actual - intended) <= unit


def floor_to_unit(n: Column, fraction: Column, unit: Column) -> Column:
    return (F.floor(n * fraction / unit) * unit).cast("int")


def counter_delta(phase: Column, value: Column) -> Column:
    """After minus before, within a group."""
    return F.max(F.when(phase == "after", value)) - F.max(F.when(phase == "before", value))
