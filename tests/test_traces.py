"""Trace records end to end: scan, features, policies, replay, event streams, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from skein.operators import policies, sse
from skein.plans import inspect, replay
from skein.sources import traces
from skein.streaming import state


def record(i, **more):
    request = {
        "model": "m", "max_tokens": 64000, "stream": True, "system": [{"type": "text", "text": "x" * 40, "cache_control": {"type": "ephemeral"}}],
        "messages": [{"role": "user", "content": "hello there"}, {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "abcd"}]}]}],
        "tools": [{"name": "t", "input_schema": {"type": "object"}}],
    }
    base = {"id": str(i), "ts": 100.0 * i, "path": "/v1/messages", "status": 200, "placement": "local", "headers": {"x-claude-code-session-id": "s", "Authorization": "secret"}, "request": request}
    return base | {"usage": {"input_tokens": 10 * i, "output_tokens": i, "cache_read_input_tokens": 5}, "timing": {"ttft_ms": float(i), "total_ms": 0.0}} | more


@pytest.fixture(scope="module")
def trace(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trace") / "day.jsonl"
    big = record(3)
    big["request"] = big["request"] | {"tools": [{"type": "web_search", "name": "w"}]}
    lines = [record(1), record(2, placement="cloud"), big, record(4, path="/v1/messages/count_tokens"), record(5, headers={}), record(6, ts=None), record(7, status=502, usage=None, request="text")]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    return traces.read_jsonl(spark, [str(path), str(path) + ".absent"])


def test_scan_and_filters(spark, trace):
    assert trace.count() == 7
    assert {r["id"] for r in traces.calls(trace).collect()} == {"1", "2", "3", "5", "6"}
    with pytest.raises(FileNotFoundError):
        traces.existing(spark, ["/nowhere/x.jsonl"])


def test_replay(spark, trace):
    ready = replay.prepare(trace).cache()
    f = {r["id"]: r["features"] for r in ready.collect()}
    one = f["1"]
    assert one["n_messages"] == 2 and one["n_tools"] == 1 and one["is_tool_continuation"] and not one["has_server_tools"] and f["3"]["has_server_tools"]
    tool = len('{"name": "t", "input_schema": {"type": "object"}}')
    assert one["est_prompt_tokens"] == (40 + 15 + tool) // 4 and one["est_system_tokens"] == (40 + tool) // 4
    assert one["cloud_cache_ttl_s"] == 300.0 and one["n_cache_breakpoints"] == 1
    assert [f[i]["seconds_since_last_call"] for i in ("1", "2", "3", "5", "6")] == [None, 100.0, 100.0, None, None]
    assert {r["temperature"]: r["n"] for r in replay.temperatures(ready).collect()} == {"first": 3, "warm": 2}
    decided = replay.decide(ready, policies.build("static"))
    got = {r["id"]: (r["decided_placement"], r["decided_reason"]) for r in decided.collect()}
    assert got["1"] == ("local", "fits") and got["3"] == ("cloud", "server-side-tool")
    pairs = {(r["recorded"], r["decided"]): r["n"] for r in replay.confusion(decided, "placement", "decided_placement").collect()}
    assert pairs == {("local", "local"): 3, ("local", "cloud"): 1, ("cloud", "local"): 1}
    swept = {(r["cap"], r["clamp"], r["tools"]): r["n_local"] for r in replay.sweep(spark, ready).collect()}
    assert len(swept) == 12 and swept[32000, None, True] == 0 and swept[32000, 4096, True] == 4 and swept[131072, None, False] == 0
    for (cap, clamp, tools), n in swept.items():
        p = policies.Static(cap=cap, clamp=clamp, local_tools=tools)
        assert replay.decide(ready, p).where("decided_placement = 'local'").count() == n


def test_clamp_value_never_moves_placement(spark, trace):
    ready = replay.prepare(trace)
    a, b = (replay.sweep(spark, ready, clamps=[c]).groupBy().agg(F.sum("n_local")).first()[0] for c in (1, 9000))
    assert a == b
    with pytest.raises(ValueError):
        policies.Static(clamp=0)
    with pytest.raises(ValueError):
        policies.build("nope")


def test_inspect(trace):
    own = trace.where("path = '/v1/messages'")
    assert [r["n"] for r in inspect.status_counts(own, "line").collect()] == [5, 1]
    assert inspect.status_counts(own.where("status = 200"), "line").count() == 0
    t = inspect.token_summary(own).first()
    assert t["sum_input"] == 170 and t["median_input"] == 25.0 and t["prefix_reuse"] == 25 / 195
    lat = {r["metric"]: r["p50"] for r in inspect.latency(own).collect()}
    assert lat["ttft_ms"] == 5.0 and "total_ms" not in lat
    assert inspect.system_prefix(own).first()["prefix"] == "x" * 40


def stream(*events):
    return "".join(f"event: {e['type']}\ndata: {json.dumps(e)}\n\n" for e in events)


def test_event_streams(spark):
    pong = stream(
        {"type": "message_start", "message": {"id": "m1", "model": "x", "usage": {"input_tokens": 8, "output_tokens": 0}}},
        {"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}, {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "name": "f", "id": "t"}},
        {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "PO"}}, {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": '{"a":'}},
        {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "NG"}}, {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "1}"}},
        {"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 1}},
    ) + "data: [DONE]\n\ndata: {broken\n"
    bad = stream({"type": "content_block_start", "index": 0, "content_block": {"type": "tool_use", "name": "g"}}, {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "name": "h"}},
                 {"type": "content_block_delta", "index": 0, "delta": {"partial_json": "{oops"}})
    blocks, messages = sse.reassemble(sse.events(spark.createDataFrame([("p", pong), ("q", bad)], "id string, raw string"), "id", "raw"), "id")
    got = {(r[0], r["index"]): r for r in blocks.collect()}
    assert got["p", 0]["text"] == "PONG" and json.loads(got["p", 1]["input"]) == {"a": 1}
    assert json.loads(got["q", 0]["input"]) == {"_unparsed": "{oops"} and got["q", 1]["input"] is None
    m = {r["id"]: r for r in messages.collect()}["p"]
    assert (m["stop_reason"], m["input_tokens"], m["output_tokens"]) == ("end_turn", 8, 1)


def test_sinks(spark, trace, tmp_path):
    traces.write_daily(trace.select("id", "ts", "headers"), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 7 and "day" in back.columns and "authorization" not in str(back.schema)
    traces.write_once(trace.select("id"), str(tmp_path / "once"))
    with pytest.raises(Exception, match="exists"):
        traces.write_once(trace.select("id"), str(tmp_path / "once"))
    with pytest.raises(ValueError):
        traces.write_once(trace.select("id").where("false"), str(tmp_path / "none"))


def test_online_state_matches_batch(spark, tmp_path):
    src = tmp_path / "src"
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.0), (None, 3.0), ("a", 9.0)], "session string, ts double")
    rows.where("ts < 5").coalesce(1).write.json(str(src / "1"))
    rows.where("ts > 5").coalesce(1).write.json(str(src / "2"))
    s = spark.readStream.schema("session string, ts double").option("maxFilesPerTrigger", 1).json(str(src / "*"))
    q = state.online_gaps(s).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["session"], r["ts"]): r["gap_s"] for r in spark.sql("SELECT session, ts, gap_s FROM gaps").collect()}
    assert got == {("a", 1.0): None, ("a", 4.0): 3.0, ("b", 2.0): None, ("a", 9.0): 5.0}


def test_online_link(spark, tmp_path):
    spark.createDataFrame([("l", 1.0, 10.0), ("l", 2.0, 20.0), ("l", 3.0, None)], "link string, ts double, network_ms double").coalesce(1).write.json(str(tmp_path / "s"))
    s = spark.readStream.schema("link string, ts double, network_ms double").json(str(tmp_path / "s"))
    q = state.online_link(s).writeStream.format("memory").queryName("link").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT rtt_ewma, jitter_ewma, n_samples FROM link ORDER BY ts").collect()] == [(10.0, 0.0, 1), (12.0, 2.0, 2)]


def test_local_rewrite(spark):
    from skein.operators import requests

    rows = [
        ("local", {"model": "big", "max_tokens": 64000, "temperature": 0.7, "tools": [{"name": "a", "input_schema": {"type": "object"}}, {"name": "b", "input_schema": {}, "strict": True}, {"name": "c", "type": "web"}]}),
        ("cloud", {"model": "big", "max_tokens": 5, "tools": [{"name": "a", "input_schema": {}}]}), ("local", {"model": "small", "max_tokens": 100}),
    ]
    df = spark.createDataFrame([(i, p, json.dumps(r)) for i, (p, r) in enumerate(rows)], "id int, placement string, r string")
    df = df.select("id", "placement", F.parse_json("r").alias("request"), F.struct(F.lit(10).alias("est_prompt_tokens"), F.try_variant_get(F.parse_json("r"), "$.max_tokens", "bigint").alias("max_tokens")).alias("features"))
    a, b, c = requests.rewrite_local(df, policies.build("static"), "small").orderBy("id").collect()
    assert (a["local_temperature"], a["original_temperature"], a["strict_tools_added"], a["original_model"], a["local_max_tokens"], a["clamped_max_tokens"]) == (0, 0.7, 1, "big", 4096, 4096)
    assert [json.loads(t).get("strict") for t in a["local_tools"]] == [True, True, None] and json.loads(a["local_tools"][0])["input_schema"] == {"type": "object"}
    assert b["local_temperature"] is None and b["strict_tools_added"] is None
    assert (c["original_model"], c["clamped_max_tokens"], c["local_max_tokens"]) == (None, None, 100)
    u = spark.createDataFrame([('{"usage":{"a":1}}',), ('{"usage":3}',), ("[]",)], "t string").select(F.to_json(requests.usage_of(F.parse_json("t"))), requests.request_bytes(F.parse_json("t"))).collect()
    assert [tuple(r) for r in u] == [('{"a":1}', 17), ("{}", 11), ("{}", 2)]


def test_small_request_facts(spark):
    from skein.operators import requests
    from skein.operators.experiments import PRESETS

    r = spark.createDataFrame([("cellular", None, 0.0, None), ("none", 7.0, None, None)], "p string, d double, j double, m double")
    got = [tuple(x[0]) for x in r.select(requests.resolve_link(F.col("p"), PRESETS, F.col("d"), F.col("j"), F.col("m"))).collect()]
    assert got == [(80.0, 0.0, 5.0), (7.0, 0.0, 0.0)]
    lines = [("a", 1.0, 1.1, ": ping"), ("a", 1.0, 1.2, 'data: {"choices":[{"text":""}]}'), ("a", 1.0, 1.5, 'data: {"choices":[{"text":"","token_ids":[4]}]}'), ("a", 1.0, 1.7, 'data: {"choices":[{"text":"x"}]}'), ("b", 1.0, 2.0, "data: [DONE]")]
    t = {x["call"]: x["ttft_ms"] for x in requests.first_token_ms(spark.createDataFrame(lines, "call string, t0 double, ts double, line string"), "call", "t0", "ts", "line").collect()}
    assert t["a"] == 500.0 and t["b"] is None
    s = requests.token_streams(spark, 3, 200, 1).collect()
    assert all(x["target"] != x["warm"] and 0 <= x[c] < 3 for x in s for c in ("prefix", "warm", "target", "unrelated")) and s[0]["unrelated"] != s[0]["target"]
    lines = ["zz", "timestamp    20260101T000000Z", "model        m", "max_model_len 32768  gpu_mem_util 0.90  kv_dtype auto", "GPU KV cache size: 115,872 tokens", "model        later"]
    text = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    assert tuple(requests.provenance(text).first()) == ("20260101T000000Z", "m", 32768, 0.9, "auto", 115872)


def test_daily_stream(spark, tmp_path):
    schema = "id string, ts double"
    spark.createDataFrame([("a", 0.0), ("b", 86400.0), ("c", None)], schema).write.json(str(tmp_path / "in"))
    q = state.write_daily_stream(state.tail_records(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    days = {(str(r["day"]), r["id"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert days == {("1970-01-01", "a"), ("1970-01-02", "b"), ("1970-01-01", "c")}


def test_routable(spark):
    """Slashes around the path do not matter; the request must be an object."""
    rows = [("/v1/messages", "{}"), ("v1/messages/", "{}"), ("//v1/messages//", "{}"), ("/v1/messages", "[]"), ("/v1/messages", None), ("/v1/messages/count", "{}"), ("/v2/messages", "{}"), (None, "{}")]
    df = spark.createDataFrame(rows, "p string, r string").select(traces.routable(F.col("p"), F.try_parse_json("r")).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, True, True, False, False, False, False, False]


def test_order_of_records(spark):
    rows = [("a", 1, 5.0), ("a", 2, None), ("a", 3, 0.0), ("b", 1, 5.0), ("b", 2, -1.0)]
    df = spark.createDataFrame(rows, "file string, line int, ts double")
    assert [(r["file"], r["line"]) for r in traces.in_order(df).collect()] == [("b", 2), ("a", 2), ("a", 3), ("a", 1), ("b", 1)]
    one, two = ([(r["file"], r["line"]) for r in traces.shuffled(df.repartition(n), 3, "file", "line").collect()] for n in (1, 4))
    assert one == two and sorted(one) == sorted(r[:2] for r in rows)


def naive_length(content):
    if isinstance(content, str):
        return len(content)
    total = 0
    for b in content if isinstance(content, list) else []:
        if isinstance(b, dict):
            total += sum(len(b[k]) for k in ("text", "thinking", "partial_json") if isinstance(b.get(k), str))
            total += naive_length(b.get("content")) + (len(str(b["input"])) if isinstance(b.get("input"), dict) else 0)
    return total


def naive_ttls(x):
    out = []
    if isinstance(x, dict):
        c = x.get("cache_control")
        if isinstance(c, dict) and c.get("type") == "ephemeral":
            out.append({"5m": 300.0, "1h": 3600.0}.get(c.get("ttl"), 300.0))
        x = list(x.values())
    return out + [t for v in x if isinstance(v, (dict, list)) for t in naive_ttls(v)] if isinstance(x, list) else out


def test_content_of_any_depth(spark):
    """Lengths and breakpoints agree with a plain recursion, at every depth; quotes within inputs count as printed."""
    from skein.operators import features

    mark = {"type": "ephemeral"}
    nested = "deep text"
    for k in range(6):
        nested = [{"type": "tool_result", "content": nested, "text": "x" * k, "input": {"a": 1}}, "not a block"]
        if k % 2:
            nested[0]["cache_control"] = mark | ({"ttl": "1h"} if k == 3 else {})
    requests = [
        {"messages": [{"role": "user", "content": nested}], "system": "s"},
        {"messages": [{"role": "user", "content": "hi"}], "system": [{"type": "text", "text": "abc", "content": nested}], "tools": [{"name": "t", "input_schema": {"type": "object", "cache_control": mark}}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a", "cache_control": {"type": "other"}}, {"type": "tool_use", "input": {"q": 'say "hi"', "p": "it's \"x\"", "b": "c\\d"}}]}], "cache_control": mark},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": 'the word "cache_control": here'}]}]},
        {"messages": []}, {},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(requests)], "id int, r string").select("id", F.parse_json("r").alias("request"))
    for got in features.extract(df).collect():
        r, f = requests[got["id"]], got["features"]
        tools = len(str(r["tools"])) if r.get("tools") else 0
        system, body = naive_length(r.get("system")), sum(naive_length(m["content"]) for m in r.get("messages", []))
        tools = len(str(r["tools"][0])) if tools else 0  # a list's own brackets are left out
        assert (f["est_prompt_tokens"], f["est_system_tokens"]) == ((system + body + tools) // 4, (system + tools) // 4), got["id"]
        ttls = naive_ttls({k: r.get(k) for k in ("tools", "system", "messages", "cache_control")})
        assert f["n_cache_breakpoints"] == len(ttls) and f["cloud_cache_ttl_s"] == max(ttls, default=None), got["id"]


def test_contents_in_order(spark):
    raw = stream(*[{"type": "content_block_start", "index": i, "content_block": {"type": "text"}} for i in (2, 0, 1)], *[{"type": "content_block_delta", "index": i, "delta": {"text": f"t{i}"}} for i in (1, 2, 0, 1)])
    blocks, _ = sse.reassemble(sse.events(spark.createDataFrame([("p", raw)], "id string, raw string"), "id", "raw"), "id")
    assert [b["text"] for b in sse.contents(blocks, "id").first()["content"]] == ["t0", "t1t1", "t2"]


def test_streams_of_values_and_csv(spark, tmp_path):
    schema = "k string, ts double, v double"
    spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 6.0), ("b", 2.0, 7.0)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = state.latest_values(source, "k", "ts", "v").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("latest").collect()} == {("a", 3.0, 6.0), ("b", 2.0, 7.0)}
    q = state.append_csv_stream(source, str(tmp_path / "csv"), str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.schema(schema).option("header", "true").csv(str(tmp_path / "csv")).count() == 3


def test_strict_read_and_exports(spark, trace, tmp_path):
    """A broken line is an error when strict; decisions and summaries are written once, nulls included."""
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps(record(1)) + "\n{broken\n")
    assert traces.read_jsonl(spark, [str(bad)]).count() == 1
    with pytest.raises(Exception, match="MALFORMED|broken|JSON"):
        traces.read_jsonl(spark, [str(bad)], strict=True).collect()
    decided = replay.decide(replay.prepare(trace), policies.build("cloud-only")).select("id", "decided_placement", "detail")
    replay.export(decided, str(tmp_path / "d"))
    assert all("detail" in json.loads(line["value"]) for line in spark.read.text(str(tmp_path / "d")).collect())


def test_recorded_features_win(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    recorded = {"model": "old", "has_tools": False, "n_tools": 0, "has_server_tools": False, "n_messages": 9, "est_prompt_tokens": 7, "est_system_tokens": 1, "max_tokens": 5, "stream": False, "is_tool_continuation": False, "n_cache_breakpoints": 0}
    path.write_text("\n".join(json.dumps(r) for r in (record(1, features=recorded), record(2))) + "\n")
    ready = {r["id"]: r["features"] for r in replay.prepare(traces.read_jsonl(spark, [str(path)]), use_recorded=True).collect()}
    assert ready["1"]["n_messages"] == 9 and ready["1"]["est_prompt_tokens"] == 7 and ready["2"]["n_messages"] == 2
