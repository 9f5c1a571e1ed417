"""Metric exposition text, memory text and experiment CSV as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import metric
from skein.sources.endpoint import MetricSource


def parse_lines(lines: DataFrame, line: str = "value", strict: bool = False) -> DataFrame:
    """name, labels, value of each metric line; the frame's other columns stay."""
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, metric(F.col(line), strict).alias("_m")).where("_m IS NOT NULL").select(*rest, "_m.name", "_m.labels", "_m.value")


def totals(metrics: DataFrame, *keys: str) -> DataFrame:
    """Each metric's sum over label sets."""
    return metrics.groupBy("name", *keys).agg(F.sum("value").alias("total"))


def counter_total(metrics: DataFrame, name: str, *keys: str) -> DataFrame:
    """The sum of one metric over label sets."""
    return totals(metrics.where(F.col("name") == name), *keys).drop("name")


def required_total(metrics: DataFrame, name: str) -> DataFrame:
    """The same over everything; an error if the metric is missing."""
    total = metrics.where(F.col("name") == name).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return total.select(F.when(F.col("n") > 0, F.col("total")).otherwise(F.raise_error(F.lit(f"missing metric {name}")).cast("double")).alias("total"))


def gauge_last(metrics: DataFrame, name: str, order: str, *keys: str) -> DataFrame:
    """The last line wins across label sets."""
    return metrics.where(F.col("name") == name).groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def meminfo(text: Column) -> Column:
    """Total and used GiB and percent from memory text."""
    gib = F.lit(1024.0**2)
    total = F.regexp_extract(text, r"MemTotal:?\s+(\d+)", 1).try_cast("double")
    free = F.regexp_extract(text, r"MemAvailable:?\s+(\d+)", 1).try_cast("double")
    return F.struct((total / gib).alias("total_gib"), ((total - free) / gib).alias("used_gib"), (100 * (total - free) / total).alias("used_pct"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Experiment rows with a declared schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def _parsed(lines: DataFrame) -> DataFrame:
    """Metrics of scraped lines; a failed scrape stays as a row with its error alone."""
    m = metric(F.col("value"))
    return lines.withColumn("_m", m).where("_m IS NOT NULL OR error IS NOT NULL").select("scrape", "time", "line", "_m.name", "_m.labels", "_m.value", "error")


def scrapes(spark: SparkSession, **options: str) -> DataFrame:
    """scrape, time, line, name, labels, value and error of an endpoint's text now, or of a folder of kept scrapes (see endpoint)."""
    spark.dataSource.register(MetricSource)
    return _parsed(spark.read.format("metric_text").options(**options).load())


def scrape_stream(spark: SparkSession, log: str, **options: str) -> DataFrame:
    """The same as a stream that asks the endpoint again and again, each scrape exactly once."""
    spark.dataSource.register(MetricSource)
    return _parsed(spark.readStream.format("metric_text").options(log=log, **options).load())
