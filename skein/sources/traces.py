"""Trace records: JSONL in, daily JSONL out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import CREDENTIALS, redact
from skein.operators.scans import numbered

_FIELDS = {
    "id": "string", "ts": "double", "path": "string", "method": "string", "stream": "boolean", "placement": "string", "reason": "string",
    "reason_detail": "string", "policy": "string", "status": "int", "error": "string", "response_bytes": "bigint", "headers": "map<string,string>",
    "features": "variant", "request": "variant", "response": "variant", "usage": "variant", "timing": "variant", "link": "variant",
}


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths (or globs) that match something; an error if none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            found.append(p)
    if not found:
        raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")
    return found


def read_jsonl(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """Records with their file and line order. Blank lines are skipped; lines that are no JSON are
    dropped, or with strict an error."""
    lines = spark.read.text(existing(spark, paths)).where(F.trim("value") != "")
    parse = F.parse_json("value") if strict else F.try_parse_json("value")
    record = lines.select(parse.alias("record"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    record = record if strict else record.where(F.schema_of_variant("record").startswith("OBJECT"))
    return record.select(*[F.try_variant_get("record", f"$.{n}", t).alias(n) for n, t in _FIELDS.items()], "file", "line")


def calls(records: DataFrame) -> DataFrame:
    """Message calls whose request is an object."""
    return records.where((F.col("path") == "/v1/messages") & F.schema_of_variant("request").startswith("OBJECT"))


def routable(path: Column, request: Column) -> Column:
    """Looser than calls: slashes around the path do not matter. The request must be an object."""
    same = F.regexp_replace(path, "^/+|/+$", "") == "v1/messages"
    return F.coalesce(same & F.schema_of_variant(request).startswith("OBJECT"), F.lit(False))


def in_order(records: DataFrame, ts: str = "ts", place: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Records by time, a missing one counting as 0, and equal times as they were read."""
    return records.orderBy(F.coalesce(F.col(ts), F.lit(0.0)), *place)


def placed(records: DataFrame, ts: str = "ts", place: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Records with their place in the order of in_order(), from 0."""
    return numbered(records, F.coalesce(F.col(ts), F.lit(0.0)), *place, out="place")


def shuffled(records: DataFrame, seed: int, *place: str) -> DataFrame:
    """Records in an order that a seed gives: by a hash of their place, so a rerun gives it again."""
    return records.orderBy(F.xxhash64(F.lit(seed), *place), *place)


def session_id(headers):
    return F.try_element_at(headers, F.lit("x-claude-code-session-id"))


def write_daily(records: DataFrame, path: str, ts: str = "ts") -> None:
    """Append JSON lines below one folder per UTC day, credentials removed."""
    day = F.to_date(F.timestamp_seconds(F.coalesce(F.col(ts), F.lit(0.0))))
    out = records.withColumn("day", day)
    if "headers" in records.columns:
        out = out.withColumn("headers", redact(F.col("headers"), CREDENTIALS))
    out.write.mode("append").option("ignoreNullFields", "false").partitionBy("day").json(path)


def write_once(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write results to a new place; an existing one or an empty frame is an error."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    writer = df.write.mode("errorifexists")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.option("ignoreNullFields", "false").json(path)
