"""The metrics endpoint as a source, and keyed state across restarts."""

import itertools
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.operators import windows
from skein.sources import endpoint, metrics
from skein.streaming import processors

TEXT = '# HELP x y\nup{job="a",path="C:\\\\x"} 1\nhits 5 1700000000\n\nnone nothing\n'


def test_batch_of_now_and_of_a_folder(spark, tmp_path):
    now = tmp_path / "now.prom"
    now.write_text(TEXT)
    got = metrics.scrapes(spark, path=str(now)).collect()
    assert [(r["scrape"], r["name"], r["labels"], r["value"]) for r in got] == [(0, "up", {"job": "a", "path": "C:\\x"}, 1.0), (0, "hits", {}, 5.0)]
    assert all(abs(r["time"].timestamp() - time.time()) < 600 and r["error"] is None for r in got)
    kept = tmp_path / "kept"
    kept.mkdir()
    for n in range(3):
        (kept / f"{n}.prom").write_text(f"hits {n}\n")
    (kept / "_SUCCESS").write_text("")
    df = metrics.scrapes(spark, path=f"file://{kept}")
    assert sorted((r["scrape"], r["value"]) for r in df.collect()) == [(0, 0.0), (1, 1.0), (2, 2.0)] and df.rdd.getNumPartitions() == 3


def test_an_endpoint_that_does_not_answer_is_a_row(spark, tmp_path):
    (r,) = metrics.scrapes(spark, path=str(tmp_path / "absent")).collect()
    assert r["name"] is None and "FileNotFound" in r["error"]
    (r,) = metrics.scrapes(spark, url="http://127.0.0.1:9/metrics").collect()
    assert r["value"] is None and "rror" in r["error"]


def test_url_and_call(spark, tmp_path, monkeypatch):
    (tmp_path / "m.prom").write_text("a 1\n")
    assert "ok\na 1" in endpoint.scrape({"url": f"file://{tmp_path}/m.prom"})
    (tmp_path / "given_metrics.py").write_text("def text():\n    return 'b 2\\n'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert "ok\nb 2" in endpoint.scrape({"call": "given_metrics:text"})


def test_stream_survives_a_restart(spark, tmp_path):
    """No scrape is lost or repeated, whatever was under way when a query stopped."""
    now, log, out = tmp_path / "now.prom", str(tmp_path / "log"), str(tmp_path / "out")

    def run(values):
        stream = metrics.scrape_stream(spark, log, path=str(now), every="0")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds")
        for v in values:
            now.write_text(f"hits {v}\n")
            running, until = q.start(), time.time() + 60
            while not any(f"hits {v}\n" in f.read_text() for f in Path(log).glob("*.prom")) and time.time() < until:
                time.sleep(0.2)
            running.stop()  # perhaps before the batch of the last scrape is through

    run([1, 2])
    # A scrape that was kept but that no batch has read yet.
    with_more = endpoint.Stream({"log": log, "path": str(now)})
    n = with_more.count
    now.write_text("hits 77\n")
    assert with_more.latestOffset() == {"scrapes": n + 1}
    run([3])
    now.write_text("hits 4\n")
    last = metrics.scrape_stream(spark, log, path=str(now), every="0").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
    last.trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((r["scrape"], r["value"]) for r in spark.read.parquet(out).collect())
    numbers = [s for s, _ in got]
    assert numbers == list(range(len(numbers))) and len(numbers) >= n + 1
    assert dict(got)[n] == 77.0 and {1.0, 2.0, 3.0, 77.0} <= {v for _, v in got}
    kept = metrics.scrapes(spark, log=log)
    assert {(r["scrape"], r["value"]) for r in kept.collect()} >= set(got)


def begun(df, tmp_path, name):
    return df.writeStream.format("json").option("path", str(tmp_path / f"out-{name}")).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append").trigger(processingTime="1 second").start()


def run(df, tmp_path, name):
    q = begun(df, tmp_path, name)
    q.processAllAvailable()
    q.stop()


def run_until(spark, df, tmp_path, name, schema, n, where="true"):
    """A stream with timers or a lifetime runs a batch at each trigger and never ends by itself: until n rows are out."""
    q, until, found, out = begun(df, tmp_path, name), time.time() + 90, [], tmp_path / f"out-{name}"
    while len(found) < n and time.time() < until:
        time.sleep(1)
        found = spark.read.schema(schema).json(str(out)).where(where).collect() if (out / "_spark_metadata").exists() else []
    q.stop()
    return found


def feed(spark, rows, schema, path, n=itertools.count()):  # noqa: B008
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(path / str(next(n))))


def test_gaps_go_on_after_a_table_and_a_restart(spark, tmp_path):
    schema = "session string, ts double"
    before = [("a", 1.0), ("b", 2.0), ("a", 5.04)]
    batches = [[("a", 305.1), ("c", 7.0), (None, 1.0), ("", 2.0)], [("b", 9.26), ("c", 8.0), ("a", 306.0), ("c", 8.5)]]
    initial = spark.createDataFrame(before, schema)
    for rows in batches:  # each run is a restart
        feed(spark, rows, schema, tmp_path / "in")
        source = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        run(processors.gaps(source, initial=initial), tmp_path, "gaps")
    got = {(r["session"], r["ts"]): r["gap_s"] for r in spark.read.schema(processors.GAP).json(str(tmp_path / "out-gaps")).collect()}
    every = spark.createDataFrame([r for rows in [before, *batches] for r in rows], schema)
    want = {(r["session"], r["ts"]): r["gap_s"] for r in windows.session_gaps(every, "session", "ts", []).collect() if r["session"] and (r["session"], r["ts"]) not in before}
    assert got == want and got["a", 305.1] == 300.1


def test_estimates_go_on_after_a_table_and_a_restart(spark, tmp_path):
    schema = "link string, ts double, network_ms double"
    rows = [(f"l{i % 3}", float(i), None if i % 7 == 0 else float(i * 37 % 101)) for i in range(90)]
    table = windows.running_ewma(spark.createDataFrame(rows[:30], schema), "link", "ts", "network_ms")
    last = F.max_by(F.struct("rtt_ewma", "jitter_ewma", "n_samples"), "ts")
    initial = table.groupBy("link").agg(last.alias("e")).select("link", "e.*")
    for part in (rows[30:60], rows[60:]):
        feed(spark, part, schema, tmp_path / "in")
        source = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        run(processors.link_estimates(source, initial=initial), tmp_path, "link")
    got = {(r["link"], r["ts"]): (r["rtt_ewma"], r["jitter_ewma"], r["n_samples"]) for r in spark.read.schema(processors.ESTIMATE).json(str(tmp_path / "out-link")).collect()}
    every = windows.running_ewma(spark.createDataFrame(rows, schema), "link", "ts", "network_ms").where("ts >= 30 AND network_ms IS NOT NULL").collect()
    assert len(got) == len(every)
    for r in every:
        assert got[r["link"], r["ts"]] == pytest.approx((r["rtt_ewma"], r["jitter_ewma"], r["n_samples"]))


def test_latest_metrics_and_idle_sessions(spark, tmp_path):
    schema = "source string, name string, ts double, value double"
    initial = spark.createDataFrame([("s", "a", 1.0, 5.0)], schema)
    for n, rows in ((3, [("s", "a", 2.0, 7.0), ("s", "b", 1.0, 1.0), ("t", "a", 1.0, 0.0)]), (4, [("s", "a", 1.5, 99.0), ("s", "b", 3.0, 4.0)])):
        feed(spark, rows, schema, tmp_path / "in")
        source = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        found = run_until(spark, processors.latest_metrics(source, ttl_ms=3_600_000, initial=initial), tmp_path, "latest", processors.LATEST, n)
    got = {(r["source"], r["name"], r["ts"]): (r["value"], r["changed_by"]) for r in found}
    assert got == {("s", "a", 2.0): (7.0, 2.0), ("s", "b", 1.0): (1.0, None), ("t", "a", 1.0): (0.0, None), ("s", "b", 3.0): (4.0, 3.0)}
    feed(spark, [("x", 1.0), ("x", 4.0)], "session string, ts double", tmp_path / "idle")
    source = spark.readStream.schema("session string, ts double").json(str(tmp_path / "idle" / "*"))
    closed = run_until(spark, processors.gaps(source, idle_ms=500), tmp_path, "idle", processors.GAP, 1, "closed")
    assert [tuple(r) for r in closed] == [("x", 4.0, None, True)]


def test_messages_keep_every_field(spark):
    from skein.operators import sse

    events = [
        '{"type":"message_start","message":{"id":"m","role":"assistant","content":[],"usage":{"input_tokens":3,"server_tool_use":{"web":1},"tier":"std"}}}',
        '{"type":"content_block_start","index":0,"content_block":{"type":"text","text":""}}', '{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"x"}}',
        '{"type":"message_delta","delta":{"stop_reason":"stop_sequence","stop_sequence":"END"},"usage":{"output_tokens":5,"tier":"fast"}}', '{"type":"message_delta","delta":{"stop_sequence":null}}',
    ]
    raw = spark.createDataFrame([("k", "\n".join(f"data: {e}" for e in events)), ("none", "data: {}")], "id string, raw string")
    blocks, messages = sse.reassemble(sse.events(raw, "id", "raw"), "id")
    (m,) = messages.collect()
    assert m["fields"] == {"id": '"m"', "role": '"assistant"', "usage": '{"input_tokens":3,"server_tool_use":{"web":1},"tier":"std"}', "stop_reason": '"stop_sequence"', "stop_sequence": "null"}
    assert m["usage"] == {"input_tokens": "3", "server_tool_use": '{"web":1}', "output_tokens": "5", "tier": '"fast"'}
    assert (m["message_id"], m["stop_reason"], m["input_tokens"], m["output_tokens"]) == ("m", "stop_sequence", 3, 5) and blocks.count() == 1
