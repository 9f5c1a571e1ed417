"""Keyed online state by transformWithState: gaps, link estimates and latest metrics.

State is typed, may expire, and may begin with a batch's result, so a stream
takes over where a table ends. It survives a restart from the checkpoint. The
session needs the RocksDB state store (session.SETTINGS has it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP = "session string, ts double, gap_s double, closed boolean"
ESTIMATE = "link string, ts double, network_ms double, rtt_ewma double, jitter_ewma double, n_samples long"
LATEST = "source string, name string, ts double, value double, changed_by double"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [f.strip().split()[0] for f in schema.split(",")]
    return pd.DataFrame(rows, columns=names, dtype=object)


def _in_time(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A batch's rows of one key; they may come in several frames."""
    return pd.concat(list(frames)).sort_values("ts", kind="stable")


class Gaps(StatefulProcessor):
    """Gap to the session's last call. State: its time, which may expire; a timer closes an idle session."""

    def __init__(self, ttl_ms: int | None, idle_ms: int | None) -> None:
        self.ttl_ms, self.idle_ms = ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts double", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((float(initialState["ts"].max()),))
        self._wait(timerValues)

    def _wait(self, timers) -> None:
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in _in_time(rows)["ts"].tolist():
            out.append((key[0], t, None if last is None else round(t - last, 1), False))
            last = t
        self.last.update((last,))
        self._wait(timerValues)
        yield _frame(out, GAP)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        self.last.clear()
        yield _frame([(key[0], last, None, True)], GAP)


class Estimates(StatefulProcessor):
    """Running round-trip and jitter estimate of a link. State: both, the number of samples and the last time."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("estimate", "rtt double, jitter double, n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((float(r["rtt_ewma"]), float(r["jitter_ewma"]), int(r["n_samples"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rtt, jitter, n = self.state.get() if self.state.exists() else (None, 0.0, 0)
        out = []
        for r in _in_time(rows).itertuples():
            x = r.network_ms
            rtt, jitter = (x, 0.0) if n == 0 else (rtt + self.alpha * (x - rtt), jitter + self.alpha * (abs(x - rtt) - jitter))
            n += 1
            out.append((key[0], r.ts, x, rtt, jitter, n))
        self.state.update((rtt, jitter, n))
        yield _frame(out, ESTIMATE)


class Latest(StatefulProcessor):
    """The newest value of each metric of a source, and how much it moved. State: a map from name to time and value, which may expire."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("latest", "name string", "ts double, value double", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.sort_values("ts", kind="stable").itertuples():
            self.known.updateValue((r.name,), (r.ts, r.value))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        newest = _in_time(rows).drop_duplicates("name", keep="last")
        for name, ts, value in zip(newest["name"], newest["ts"], newest["value"]):
            was = self.known.getValue((name,)) if self.known.containsKey((name,)) else None
            if was is None or ts >= was[0]:
                self.known.updateValue((name,), (ts, value))
                out.append((key[0], name, ts, value, None if was is None else value - was[1]))
        yield _frame(out, LATEST)


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, timed: bool, initial: DataFrame | None) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if timed else "None", initialState=None if initial is None else initial.groupBy(key))


def gaps(stream: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Gap to the session's last call, one decimal, by time within a micro-batch; a late call may have a negative gap.

    stream has session and ts; calls without a time or with a null or empty session
    are left out. A session's time expires after ttl_ms. With idle_ms, a session
    without a call for so long gives a row that says closed, with its last time.
    initial has session and ts: the last calls of a batch.
    """
    some = lambda df: df.where("session <> '' AND ts IS NOT NULL").select("session", F.col("ts").cast("double").alias("ts"))
    return _run(some(stream), "session", Gaps(ttl_ms, idle_ms), GAP, bool(ttl_ms or idle_ms), None if initial is None else some(initial).groupBy("session").agg(F.max("ts").alias("ts")))


def link_estimates(stream: DataFrame, alpha: float = 0.2, initial: DataFrame | None = None) -> DataFrame:
    """Running estimates per link; null and NaN samples are left out.

    initial has link, rtt_ewma, jitter_ewma and n_samples: the last estimates of a
    batch, a row a link.
    """
    x = F.col("network_ms").cast("double")
    rows = stream.where(x.isNotNull() & ~F.isnan(x)).select("link", F.col("ts").cast("double").alias("ts"), x.alias("network_ms"))
    return _run(rows, "link", Estimates(alpha), ESTIMATE, False, None if initial is None else initial.where("n_samples > 0").select("link", "rtt_ewma", "jitter_ewma", "n_samples"))


def latest_metrics(stream: DataFrame, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Each source's metrics as they move: the newest value and its change; older rows than what is known say nothing.

    stream and initial have source, name, ts and value.
    """
    some = lambda df: df.where("name IS NOT NULL AND ts IS NOT NULL").select("source", "name", F.col("ts").cast("double").alias("ts"), F.col("value").cast("double").alias("value"))
    return _run(some(stream), "source", Latest(ttl_ms), LATEST, bool(ttl_ms), None if initial is None else some(initial))
