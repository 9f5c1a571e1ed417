"""Online forms: last-seen gaps and running link estimates as keyed state, and daily sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP = "session string, ts double, gap_s double"
ESTIMATE = "link string, ts double, network_ms double, rtt_ewma double, jitter_ewma double, n_samples long"


def online_gaps(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Gap to the session's last call to one decimal, in arrival order by time within a batch.

    stream has session and ts. State never expires unless ttl_ms is given.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        ts = pd.concat([pdf["ts"] for pdf in frames]).sort_values()  # a batch may come in several frames
        if len(ts):
            before = [last, *ts.iloc[:-1].tolist()]
            last = float(ts.iloc[-1])
            gaps = [None if b is None else round(t - b, 1) for t, b in zip(ts.tolist(), before)]
            yield pd.DataFrame({"session": key[0], "ts": ts.tolist(), "gap_s": pd.array(gaps, dtype="Float64")})
        if last is not None:
            state.update((last,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    rows = stream.where("session IS NOT NULL AND ts IS NOT NULL").select("session", F.col("ts").cast("double").alias("ts"))
    return rows.groupBy("session").applyInPandasWithState(step, GAP, "last double", "append", kind)


def online_link(stream: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Running round-trip and jitter estimate per link; samples without a value are left out."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rtt, jitter, n = state.get if state.exists else (None, None, 0)
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for x in pdf["network_ms"]:
            if n == 0:
                rtt, jitter = x, 0.0
            else:
                rtt, jitter = rtt + alpha * (x - rtt), jitter + alpha * (abs(x - rtt) - jitter)
            n += 1
            out.append((rtt, jitter, n))
        est = pd.DataFrame(out, columns=["rtt_ewma", "jitter_ewma", "n_samples"], index=pdf.index)
        yield pd.concat([pdf[["link", "ts", "network_ms"]], est], axis=1)
        if n:
            state.update((rtt, jitter, n))

    rows = stream.where("network_ms IS NOT NULL").select("link", F.col("ts").cast("double").alias("ts"), F.col("network_ms").cast("double").alias("network_ms"))
    return rows.groupBy("link").applyInPandasWithState(step, ESTIMATE, "rtt double, jitter double, n long", "append", GroupStateTimeout.NoTimeout)


def write_daily_stream(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """JSON lines below one folder per UTC day, exactly once."""
    day = F.to_date(F.timestamp_seconds(F.coalesce(F.col(ts), F.lit(0.0))))
    return stream.withColumn("day", day).writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false")


def tail_records(spark, path: str, schema: str) -> DataFrame:
    """New records of a folder of JSON lines as they appear."""
    return spark.readStream.schema(schema).json(path)


def latest_values(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The newest value of each key, updated as it comes: what a sampler would read at any time."""
    return stream.groupBy(key).agg(F.max_by(F.struct(F.col(ts), F.col(value)), ts).alias("_v")).select(key, F.col(f"_v.{ts}").alias(ts), F.col(f"_v.{value}").alias(value))


def append_csv_stream(stream: DataFrame, path: str, checkpoint: str):
    """Rows appended to a folder of CSV as they come, exactly once; a batch is on disk before the next begins."""
    return stream.writeStream.format("csv").option("header", "true").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
