"""Queries of the call-trace side over the driver's tables, and the same in SQL.

Requests, responses, headers and event streams are built as JSON from
`documents`, `conversations`, `events` and `orders`, and go through the library's
own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text, timing
from skein.operators import experiments, features, policies, prefixes, requests, scans, sse
from skein.plans import inspect, replay
from skein.plans.catalogue import _E, _STATUS_SQL, _events, _lines, _status, _t, query
from skein.sources import metrics, traces
from skein.tables import in_ranges, shared_folder

def _if(cond: Column, value) -> Column:
    return F.when(cond, value)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Documents as requests: strings, blocks, tools, cache breakpoints and content four levels deep."""
    i = F.col("doc_id")
    control = F.struct(F.lit("ephemeral").alias("type"), _if(i % 8 == 0, F.lit("1h")).alias("ttl"))
    system = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("lang", F.lit("")).alias("text"), _if(i % 4 == 0, control).alias("cache_control")))
    deep = F.array(F.struct(F.lit("text").alias("type"), F.lit("deep").alias("text"), _if(i % 6 == 0, F.struct(F.lit("ephemeral").alias("type"))).alias("cache_control")))
    inner = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("source", F.lit("")).alias("text"), _if(i % 2 == 0, deep).alias("content")))
    block = F.struct(F.when(i % 5 == 0, "tool_result").otherwise("text").alias("type"), F.lit("ab").alias("text"), inner.alias("content"))
    said = F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    messages = F.concat(F.lit("["), F.to_json(said), F.lit(","), F.to_json(F.struct(F.lit("user").alias("role"), F.array(block).alias("content"))), F.lit("]"))
    client, server = F.lit('{"name":"t","input_schema":{"type":"object"}}'), F.lit('{"type":"web","name":"w"}')
    tools = F.concat(F.lit("["), F.concat_ws(",", _if(i % 3 == 0, client), _if(i % 7 == 0, server)), F.lit("]"))
    body = F.concat(
        F.lit('{"model":"m'), (i % 3).cast("string"), F.lit('","max_tokens":'), (1000 + i % 5).cast("string"), F.lit(',"stream":'), (i % 2 == 0).cast("string"),
        F.lit(',"system":'), F.to_json(system), F.lit(',"messages":'), messages, F.lit(',"tools":'), tools, F.lit("}"),
    )
    return _t(spark, d, "documents").select("doc_id", "lang", "source", F.parse_json(body).alias("request"))


_CLIENT, _SERVER = len("{'name': 't', 'input_schema': {'type': 'object'}}"), len("{'type': 'web', 'name': 'w'}")
_REQ = f"""q AS (SELECT doc_id, length(coalesce(lang, '')) AS sys, length(coalesce(text, '')) + 2 + length(coalesce(source, '')) + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END AS body,
  CASE WHEN doc_id % 3 = 0 THEN {_CLIENT} ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN {_SERVER} ELSE 0 END AS tool,
  CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS marks FROM documents)"""


@query(
    f"""WITH {_REQ} SELECT doc_id, 'm' || (doc_id % 3) AS model, doc_id % 3 = 0 OR doc_id % 7 = 0 AS has_tools, CAST((doc_id % 3 = 0)::INT + (doc_id % 7 = 0)::INT AS INTEGER) AS n_tools,
  doc_id % 7 = 0 AS has_server_tools, CAST(2 AS INTEGER) AS n_messages, CAST((sys + body + tool) // 4 AS BIGINT) AS est_prompt_tokens, CAST((sys + tool) // 4 AS BIGINT) AS est_system_tokens,
  CAST(1000 + doc_id % 5 AS BIGINT) AS max_tokens, doc_id % 2 = 0 AS stream, doc_id % 5 = 0 AS is_tool_continuation,
  CASE WHEN doc_id % 8 = 0 THEN 3600.0::DOUBLE WHEN marks > 0 THEN 300.0 END AS cloud_cache_ttl_s, CAST(marks AS INTEGER) AS n_cache_breakpoints FROM q"""
)
def request_features(spark: SparkSession, d: str) -> DataFrame:
    got = features.extract(_requests(spark, d)).select("doc_id", "features.*")
    return got.drop("seconds_since_last_call")


@query("SELECT doc_id, coalesce(lang, '') AS system_text FROM documents")
def request_system_text(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("doc_id", features.system_text(F.col("request")).alias("system_text"))


@query("SELECT CASE WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN 'with tools' ELSE 'without tools' END AS class, count(*) AS n FROM documents GROUP BY 1")
def inspect_call_classes(spark: SparkSession, d: str) -> DataFrame:
    return inspect.call_classes(_requests(spark, d))


@query("WITH m AS (SELECT min(lang) AS a, max(lang) AS b FROM documents WHERE lang <> ''), p AS (SELECT coalesce((SELECT left(a, max(i)) FROM range(1, length(a) + 1) AS r(i) WHERE left(a, i) = left(b, i)), '') AS prefix FROM m) SELECT prefix, CAST(length(prefix) // 4 AS BIGINT) AS est_tokens FROM p")
def inspect_system_prefix(spark: SparkSession, d: str) -> DataFrame:
    return inspect.system_prefix(_requests(spark, d))


def _rewritten(spark: SparkSession, d: str) -> DataFrame:
    placed = features.extract(_requests(spark, d)).withColumn("placement", F.when(F.col("doc_id") % 2 == 0, "local").otherwise("cloud"))
    return requests.rewrite_local(placed, policies.build("static", cap=4096, clamp=128), "m0")


@query(
    f"""WITH {_REQ}, e AS (SELECT doc_id, doc_id % 2 = 0 AS local, greatest(1, least(1000 + doc_id % 5, 128, greatest(0, 3686 - (sys + body + tool) // 4))) AS want FROM q)
SELECT doc_id, CAST(CASE WHEN local THEN 0 END AS INTEGER) AS local_temperature, CAST(CASE WHEN local THEN (doc_id % 3 = 0)::INT END AS INTEGER) AS strict_tools_added,
  CAST(CASE WHEN local THEN (doc_id % 3 = 0)::INT + (doc_id % 7 = 0)::INT END AS INTEGER) AS n_local_tools, CASE WHEN local AND doc_id % 3 = 0 THEN true WHEN local THEN false END AS is_strict,
  CASE WHEN local THEN 'm0' END AS local_model, CASE WHEN local AND doc_id % 3 <> 0 THEN 'm' || (doc_id % 3) END AS original_model,
  CAST(CASE WHEN local THEN want END AS BIGINT) AS local_max_tokens, CAST(CASE WHEN local THEN want END AS BIGINT) AS clamped_max_tokens FROM e"""
)
def local_rewrite(spark: SparkSession, d: str) -> DataFrame:
    strict = F.exists("local_tools", lambda t: F.contains(t, F.lit('"strict":true'))).alias("is_strict")
    return _rewritten(spark, d).select(
        "doc_id", "local_temperature", "strict_tools_added", F.size("local_tools").alias("_n"), strict, "local_model", "original_model", "local_max_tokens", "clamped_max_tokens", "placement"
    ).withColumn("n_local_tools", F.when(F.col("placement") == "local", F.col("_n"))).drop("_n", "placement")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events as trace records: path, status, headers, usage, timing, request and response."""
    k, i = F.col("k"), F.col("event_id")
    path = F.when(k % 4 == 0, "/v1/messages").when(k % 4 == 1, "v1/messages/").when(k % 4 == 2, "/v1/messages/count_tokens").otherwise("/v1/messages")
    request = F.when(k % 5 == 0, F.lit('"text"')).when(k % 5 == 1, F.lit("[1]")).otherwise(F.concat(F.lit('{"messages":[{"role":"user","content":"'), F.repeat(F.lit("x"), k + 1), F.lit('"}],"max_tokens":'), k.cast("string"), F.lit("}")))
    usage = F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.format_string('{"input_tokens":%d,"output_tokens":%d,"cache_read_input_tokens":%d}', k, k % 7, k * 2))
    timed = F.concat(F.lit('{"ttft_ms":'), F.when(k % 9 == 0, F.lit("0")).otherwise(k.cast("string")), F.lit(',"total_ms":'), (k * 3).cast("string"), F.lit("}"))
    tool = F.concat(F.lit('{"content":[{"type":"text","text":"a"},{"type":"tool_use","name":"t'), (k % 20).cast("string"), F.lit('"},{"type":"tool_use","name":"u'), (k % 3).cast("string"), F.lit('"}]}'))
    session = F.when(k % 11 != 0, F.concat(F.lit("s"), F.col("user_id").cast("string")))
    headers = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("host").alias("key"), F.lit("h").alias("value")), F.when(session.isNotNull(), F.struct(F.lit("x-claude-code-session-id").alias("key"), session.alias("value"))),
    )))
    recorded = F.when(k % 10 == 0, F.format_string('{"model":"old","has_tools":false,"n_tools":0,"has_server_tools":false,"n_messages":9,"est_prompt_tokens":%d,"est_system_tokens":1,"max_tokens":5,"stream":false,"is_tool_continuation":false,"n_cache_breakpoints":0}', k + 1000))
    return _events(spark, d).select(
        F.lit("f").alias("file"), i.alias("line"), F.col("s").alias("ts"), path.alias("path"), _status().alias("status"), headers.alias("headers"), F.parse_json(request).alias("request"),
        F.parse_json(usage).alias("usage"), F.parse_json(timed).alias("timing"), F.parse_json(tool).alias("response"), F.parse_json(recorded).alias("features"), "k", "user_id",
    )


@query(f"WITH {_E} SELECT event_id AS line FROM e WHERE k % 4 IN (0, 3) AND k % 5 NOT IN (0, 1)")
def trace_calls(spark: SparkSession, d: str) -> DataFrame:
    return traces.calls(_records(spark, d)).select("line")


@query(f"WITH {_E} SELECT event_id AS line, k % 4 <> 2 AND k % 5 NOT IN (0, 1) AS routable FROM e")
def trace_routable(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return r.select("line", traces.routable(F.col("path"), F.col("request")).alias("routable"))


@query(f"WITH {_E} SELECT CASE WHEN k % 4 = 1 THEN 'v1/messages/' WHEN k % 4 = 2 THEN '/v1/messages/count_tokens' ELSE '/v1/messages' END AS path, count(*) AS n, min(event_id) AS first_seen FROM e GROUP BY 1")
def inspect_paths(spark: SparkSession, d: str) -> DataFrame:
    return inspect.counts(_records(spark, d), "path", "line")


@query(f"WITH {_E}, m AS (SELECT {_STATUS_SQL} AS status, event_id FROM e WHERE k % 4 IN (0, 3)) SELECT status, count(*) AS n, min(event_id) AS first_seen FROM m WHERE EXISTS (SELECT 1 FROM m WHERE status <> 200) GROUP BY 1")
def inspect_statuses(spark: SparkSession, d: str) -> DataFrame:
    return inspect.status_counts(_records(spark, d).where("path = '/v1/messages'"), "line")


@query(
    f"""WITH {_E}, u AS (SELECT CASE WHEN k % 6 = 0 THEN 0 ELSE k END AS i, CASE WHEN k % 6 = 0 THEN 0 ELSE k % 7 END AS o, CASE WHEN k % 6 = 0 THEN 0 ELSE 2 * k END AS r FROM e)
SELECT CAST(sum(i) AS BIGINT) AS sum_input, CAST(sum(o) AS BIGINT) AS sum_output, CAST(sum(r) AS BIGINT) AS sum_cache_read, CAST(0 AS BIGINT) AS sum_cache_creation,
  median(i) AS median_input, median(o) AS median_output, sum(r) / nullif(sum(i) + sum(r), 0) AS prefix_reuse FROM u"""
)
def inspect_tokens(spark: SparkSession, d: str) -> DataFrame:
    return inspect.token_summary(_records(spark, d))


@query(
    f"""WITH {_E}, t AS (SELECT 'ttft_ms' AS metric, CASE WHEN k % 9 = 0 THEN 0 ELSE k END * 1.0::DOUBLE AS ms FROM e UNION ALL SELECT 'total_ms', k * 3.0::DOUBLE FROM e),
v AS (SELECT metric, list_sort(list(ms)) AS x FROM t WHERE ms <> 0 GROUP BY 1)
SELECT metric, x[least(CAST(floor(CAST('0.5' AS DOUBLE) * len(x)) AS BIGINT), len(x) - 1) + 1] AS p50, x[least(CAST(floor(CAST('0.9' AS DOUBLE) * len(x)) AS BIGINT), len(x) - 1) + 1] AS p90,
  x[least(CAST(floor(CAST('0.99' AS DOUBLE) * len(x)) AS BIGINT), len(x) - 1) + 1] AS p99 FROM v"""
)
def inspect_latency(spark: SparkSession, d: str) -> DataFrame:
    return inspect.latency(_records(spark, d))


@query(
    f"""WITH {_E}, u AS (SELECT 't' || (k % 20) AS tool, event_id FROM e UNION ALL SELECT 'u' || (k % 3), event_id FROM e)
SELECT tool, count(*) AS n, min(event_id) AS first_seen FROM u GROUP BY 1 ORDER BY n DESC, first_seen, tool LIMIT 15"""
)
def inspect_tool_uses(spark: SparkSession, d: str) -> DataFrame:
    return inspect.tool_uses(_records(spark, d), top=15)


_CALLS = f"""{_E}, c AS (SELECT event_id AS line, s, k, CASE WHEN k % 11 <> 0 THEN 's' || user_id END AS session FROM e WHERE k % 4 IN (0, 3) AND k % 5 NOT IN (0, 1)),
g AS (SELECT *, CASE WHEN session IS NOT NULL THEN round_even(s - lag(s) OVER (PARTITION BY session ORDER BY s, line), 1) END AS gap FROM c)"""


@query(f"WITH {_CALLS} SELECT line, session, gap AS gap_s, CAST((k + 1) // 4 AS BIGINT) AS est_prompt_tokens FROM g")
def replay_prepare(spark: SparkSession, d: str) -> DataFrame:
    return replay.prepare(_records(spark, d)).select("line", "session", "gap_s", "features.est_prompt_tokens")


@query(f"WITH {_CALLS} SELECT line, CAST(CASE WHEN k % 10 = 0 THEN k + 1000 ELSE (k + 1) // 4 END AS BIGINT) AS est_prompt_tokens, CAST(CASE WHEN k % 10 = 0 THEN 9 ELSE 1 END AS INTEGER) AS n_messages FROM g")
def replay_recorded(spark: SparkSession, d: str) -> DataFrame:
    return replay.prepare(_records(spark, d), use_recorded=True).select("line", "features.est_prompt_tokens", "features.n_messages")


@query(f"WITH {_CALLS} SELECT CASE WHEN (k + 1) // 4 + greatest(1, least(k, 16, greatest(0, 28 - (k + 1) // 4))) <= 28 THEN 'local' ELSE 'cloud' END AS placement, count(*) AS n FROM g GROUP BY 1")
def replay_static(spark: SparkSession, d: str) -> DataFrame:
    ready = replay.prepare(_records(spark, d))
    return replay.decide(ready, policies.build("static", cap=32, clamp=16)).groupBy("placement").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT event_id AS line, row_number() OVER (ORDER BY CASE WHEN k % 7 = 0 THEN 0 ELSE s END, event_id) - 1 AS place FROM e")
def record_order(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("ts", F.when(F.col("k") % 7 != 0, F.col("ts")))
    return traces.placed(r.select("ts", "file", "line")).select("line", "place")


@query(
    """SELECT conv_id, turn, 'Hello ' || text AS said, CASE turn % 3 WHEN 0 THEN '{"a":' || turn || '}' WHEN 1 THEN '{"b":' || turn || '}' ELSE '{"_unparsed":"{broken"}' END AS input,
  CASE WHEN turn % 2 = 0 THEN 'sig' || turn END AS loose FROM conversations WHERE text <> ''"""
)
def sse_initial_content(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that start with content of their own, blocks without a start, and tool input with and without deltas."""
    c = _t(spark, d, "conversations").where("text <> ''").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    turn = F.col("turn").cast("string")
    event = lambda kind, i, **rest: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(i).alias("index"), *[v.alias(k) for k, v in rest.items()])))
    block = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in f.items()])
    deltas = F.when(F.col("turn") % 3 == 1, F.concat(F.lit('{"b":'), turn, F.lit("}"))).when(F.col("turn") % 3 == 2, F.lit("{broken"))
    raw = F.concat_ws(
        "\n\n", event("content_block_start", 0, content_block=block("text", text=F.lit("Hello "))), event("content_block_start", 1, content_block=block("tool_use", input=F.struct(F.col("turn").alias("a")))),
        event("content_block_delta", 0, delta=F.struct(F.substring("text", 1, 9).alias("text"))), event("content_block_delta", 0, delta=F.struct(F.substring("text", 10, 1 << 30).alias("text"))),
        F.when(deltas.isNotNull(), event("content_block_delta", 1, delta=F.struct(deltas.alias("partial_json")))), F.when(F.col("turn") % 2 == 0, event("content_block_delta", 2, delta=F.struct(F.concat(F.lit("sig"), turn).alias("signature")))),
        event("content_block_stop", 0), event("content_block_stop", 1),
    )
    blocks, _ = sse.reassemble(sse.events(c.select("id", raw.alias("raw")), "id", "raw"), "id")
    x, part = F.col("content"), F.split("id", "/")
    return sse.contents(blocks, "id").select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), x[0]["text"].alias("said"), x[1]["input"].alias("input"), F.get(x, F.lit(2))["signature"].alias("loose"))


@query(f"WITH {_E} SELECT event_id AS line, CAST(CASE WHEN k % 6 = 0 THEN 2 ELSE length('{{\"cache_read_input_tokens\":' || (k * 2) || ',\"input_tokens\":' || k || ',\"output_tokens\":' || (k % 7) || '}}') END AS INTEGER) AS usage_chars FROM e")
def usage_objects(spark: SparkSession, d: str) -> DataFrame:
    payload = F.parse_json(F.concat(F.lit('{"usage":'), F.coalesce(F.to_json("usage"), F.lit("[1]")), F.lit("}")))
    return _records(spark, d).select("line", F.length(F.to_json(requests.usage_of(payload))).alias("usage_chars"))


@query(f"WITH {_E} SELECT event_id AS line, CAST(CASE WHEN k % 5 = 0 THEN 6 WHEN k % 5 = 1 THEN 3 ELSE length('{{\"max_tokens\":' || k || ',\"messages\":[{{\"content\":\"\",\"role\":\"user\"}}]}}') + k + 1 END AS INTEGER) AS n_bytes FROM e")
def request_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("line", requests.request_bytes(F.col("request")).alias("n_bytes"))


@query(
    f"""WITH {_E}, p(i, preset, delay, jitter, mbps) AS (VALUES (0, 'none', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 'colo', 5.0, 1.0, 200.0), (2, 'cellular', 80.0, 40.0, 5.0))
SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN k * 1.0::DOUBLE END, delay) AS delay_ms, jitter AS jitter_ms, coalesce(CASE WHEN k % 5 = 0 THEN 0.0::DOUBLE END, mbps) AS bandwidth_mbps FROM e JOIN p ON k % 3 = i"""
)
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    preset = F.when(k % 3 == 0, "none").when(k % 3 == 1, "colo").otherwise("cellular")
    link = requests.resolve_link(preset, experiments.PRESETS, F.when(k % 2 == 0, k.cast("double")), F.lit(None).cast("double"), F.when(k % 5 == 0, F.lit(0.0)))
    return _events(spark, d).select("event_id", link.alias("x")).select("event_id", "x.*")


@query(f"WITH {_E} SELECT user_id, 1000 * min(s - 10) FILTER (WHERE k % 4 > 1) AS ttft_ms FROM e GROUP BY 1")
def first_token(spark: SparkSession, d: str) -> DataFrame:
    """Streamed lines of a user's call: pings, empty choices, texts and token ids."""
    k = F.col("k") % 4
    line = F.when(k == 0, ": ping").when(k == 1, 'data: {"choices":[{"text":""}]}').when(k == 2, 'data: {"choices":[{"text":"","token_ids":[4]}]}').otherwise('data: {"choices":[{"text":"x"}]}')
    lines = _events(spark, d).select("user_id", F.lit(10.0).alias("t0"), "s", line.alias("line"))
    return requests.first_token_ms(lines, "user_id", "t0", "s", "line")


@query(
    """WITH c AS (SELECT DISTINCT o_orderkey % 3 AS a, o_orderkey % 2 AS b, o_orderkey % 5 AS x FROM orders)
SELECT a, b, x, CASE WHEN x = 0 THEN 'cloud-only' ELSE 'static cap=' || (32 * (a + 1)) || 'K clamp=' || CASE WHEN b = 0 THEN 'off' ELSE '4096' END || ' tools=' || CASE WHEN x > 2 THEN 'on' ELSE 'off' END END AS label FROM c"""
)
def policy_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = _t(spark, d, "orders").select((k % 3).alias("a"), (k % 2).alias("b"), (k % 5).alias("x")).distinct()
    name = F.when(F.col("x") == 0, "cloud-only").otherwise("static")
    return c.withColumn("label", policies.label(name, 32000 * (F.col("a") + 1) + 500, F.when(F.col("b") != 0, F.lit(4096)), F.col("x") > 2))


@query(f"WITH {_E} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'content-encoding,x-k' ELSE 'x-k' END AS sent, 'host,x-k' AS given FROM e")
def header_strips(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    h = F.create_map(F.lit("Host"), F.lit("h"), F.lit("X-K"), k.cast("string"), F.when(k % 2 == 0, "Content-Encoding").otherwise("Connection"), F.lit("v"))
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return _events(spark, d).select("event_id", names(text.forwarded(h)).alias("sent"), names(text.returned(h)).alias("given"))


@query(
    f"""WITH {_E} SELECT event_id, CASE k % 4 WHEN 0 THEN 'C:' || chr(92) || 'new' WHEN 1 THEN 'a' || chr(10) || k WHEN 2 THEN 'say "' || k || '"' ELSE 'é' || chr(9) END AS path, k % 3 = 0 AS strict_fits FROM e"""
)
def metric_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with escaped quotes, backslashes, line feeds and code points; the strict form takes no time."""
    k = F.col("k")
    value = F.when(k % 4 == 0, r"C:\\new").when(k % 4 == 1, F.concat(F.lit(r"a\n"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit(r"say \""), k.cast("string"), F.lit(r"\""))).otherwise(r"\u00e9\t")
    line = F.concat(F.lit('m{path="'), value, F.lit('",z="1"} 2'), F.when(k % 3 != 0, " 17").otherwise(""))
    got = _events(spark, d).select("event_id", line.alias("v")).select("event_id", text.metric(F.col("v")).alias("m"), text.metric(F.col("v"), strict=True).isNotNull().alias("strict_fits"))
    return got.select("event_id", F.col("m.labels.path").alias("path"), "strict_fits")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS whole, CASE WHEN o_orderkey % 5 = 0 AND o_custkey > 0 THEN CAST(o_custkey AS BIGINT) ELSE CAST(16 AS BIGINT) END AS unit,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || '.5' END AS shown, round(o_orderkey * 1048576.0 / 1073741824, 3) AS gib,
  CAST(floor(o_orderkey * CAST('0.5' AS DOUBLE) / 16) * 16 AS INTEGER) AS aligned, CAST(2 * o_orderkey * 8 * 128 * 2 AS BIGINT) AS kv_bytes FROM orders"""
)
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(
        "o_orderkey", text.safe_int(F.when(k % 3 == 0, "None").otherwise(k.cast("string"))).alias("whole"),
        text.first_positive(F.when(k % 5 == 0, F.col("o_custkey").cast("string")).otherwise("None"), F.lit("16")).alias("unit"),
        text.integral(F.when(k % 2 == 0, k.cast("double")).otherwise(k + F.lit(0.5))).alias("shown"), text.gib(k * F.lit(1048576.0)).alias("gib"),
        experiments.floor_to_unit(k, F.lit(0.5), F.lit(16)).alias("aligned"), timing.kv_bytes_per_token(k, F.lit(8), F.lit(128), F.lit(2)).cast("long").alias("kv_bytes"),
    )


@query("SELECT o_orderkey, (o_orderkey + 1048576) / 1048576.0::DOUBLE AS total_gib, o_orderkey / 1048576.0::DOUBLE AS used_gib, 100 * o_orderkey / (o_orderkey + 1048576)::DOUBLE AS used_pct FROM orders")
def memory_used(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.concat(F.lit("MemTotal:       "), (k + 1048576).cast("string"), F.lit(" kB\nMemFree: 1 kB\nMemAvailable:   1048576 kB\n"))
    return _t(spark, d, "orders").select("o_orderkey", metrics.meminfo(said).alias("m")).select("o_orderkey", "m.*")


@query(f"WITH {_E} SELECT event_type, count(*) FILTER (WHERE {_STATUS_SQL} = 200 AND k % 2 = 0 AND k % 3 <> 0) AS n_valid FROM e GROUP BY 1")
def link_validity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    ok = experiments.link_valid(_status(), F.when(k % 2 == 0, "cloud").otherwise("local"), F.when(k % 3 != 0, F.col("value")))
    return _events(spark, d).groupBy("event_type").agg(F.count_if(ok).alias("n_valid"))


@query(
    """WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 9 AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, o_orderkey % 4 AS m FROM orders)
SELECT o_orderkey, CAST(CASE m WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n, CASE m WHEN 0 THEN 2 * CAST(a AS DOUBLE) + CAST(b AS DOUBLE) WHEN 1 THEN CAST(a AS DOUBLE) + CAST(b AS DOUBLE) END AS total,
  m = 1 AND CAST(a AS DOUBLE) <> CAST(b AS DOUBLE) AS all_distinct FROM r"""
)
def comma_list_parse(spark: SparkSession, d: str) -> DataFrame:
    k, a, b = F.col("o_orderkey"), (F.col("o_orderkey") % 9).cast("string"), F.col("o_custkey").cast("string")
    raw = F.when(k % 4 == 0, F.concat_ws(",", a, b, a)).when(k % 4 == 1, F.concat(a, F.lit(", "), b)).when(k % 4 == 2, F.concat(a, F.lit(",x"))).otherwise("")
    rows = _t(spark, d, "orders").select("o_orderkey", text.comma_numbers(raw).alias("x"))
    n = F.when(F.col("x").isNotNull(), F.size("x")).otherwise(0)
    return rows.select("o_orderkey", n.alias("n"), F.aggregate("x", F.lit(0.0), lambda p, q: p + q).alias("total"), F.coalesce(text.all_distinct(F.col("x")), F.lit(False)).alias("all_distinct"))


@query("SELECT o_orderpriority, round_even(avg(o_totalprice), 1) AS mean_price FROM orders GROUP BY 1")
def rounded_report(spark: SparkSession, d: str) -> DataFrame:
    means = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean_price"))
    return text.rounded(means, 1, "mean_price")


@query(
    """SELECT 'N' || min(n_nationkey) AS stamp, 'm' || max(n_nationkey) AS model, CAST(1024 * (max(n_nationkey) + 1) AS INTEGER) AS max_model_len, CAST('0.' || (50 + max(n_nationkey)) AS DOUBLE) AS gpu_mem_util,
  'd' || max(n_nationkey) AS kv_dtype, CAST(1000 * (100 + min(n_nationkey)) + 872 AS BIGINT) AS kv_cache_tokens FROM nation"""
)
def provenance_facts(spark: SparkSession, d: str) -> DataFrame:
    """A run's text with lines of every kind from each row of a table: of each fact the first by place counts."""
    k = F.col("n_nationkey")
    n, key = _t(spark, d, "nation"), k.cast("string")
    at = lambda order, *parts: n.select(order.cast("long").alias("line"), F.concat(*parts).alias("value"))
    stamps, models = at(k, F.lit("timestamp  N"), key), at(-k, F.lit("model  m"), key)
    limits = at(-k, F.lit("max_model_len "), (1024 * (k + 1)).cast("string"), F.lit("  gpu_mem_util 0."), (50 + k).cast("string"), F.lit("  kv_dtype d"), key)
    other = at(k, F.lit("GPU KV cache size: "), (100 + k).cast("string"), F.lit(",872 tokens")).unionByName(limits)
    return requests.provenance(stamps.unionByName(models).unionByName(other))


@query("SELECT conv_id, turn, 'thinking,text,tool_use' AS kinds, text AS said, '{\"q\":' || turn || '}' AS input, CAST(length(text) AS BIGINT) AS output_tokens FROM conversations WHERE text <> ''")
def message_contents(spark: SparkSession, d: str) -> DataFrame:
    """Each turn streamed as three blocks out of order, with a tool's input in two pieces, and gathered by index."""
    c = _t(spark, d, "conversations").where("text <> ''").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    start = lambda i, kind: F.lit(f'data: {{"type":"content_block_start","index":{i},"content_block":{{"type":"{kind}","name":"n","id":"b{i}"}}}}')
    delta = lambda i, key, v: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(i).alias("index"), F.struct(v.alias(key)).alias("delta"))))
    raw = F.concat_ws(
        "\n\n", start(2, "tool_use"), start(0, "thinking"), start(1, "text"), delta(2, "partial_json", F.lit('{"q":')), delta(1, "text", F.substring("text", 1, 5)),
        delta(2, "partial_json", F.concat(F.col("turn").cast("string"), F.lit("}"))), delta(1, "text", F.substring("text", 6, 1 << 30)), delta(0, "thinking", F.lit("hm")),
        F.concat(F.lit('data: {"type":"message_delta","usage":{"output_tokens":'), F.length("text").cast("string"), F.lit("}}")),
    )
    blocks, messages = sse.reassemble(sse.events(c.select("id", raw.alias("raw")), "id", "raw"), "id")
    x, part = F.col("content"), F.split("id", "/")
    return sse.contents(blocks, "id").join(messages, "id").select(
        part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), F.array_join(F.transform(x, lambda b: b["type"]), ",").alias("kinds"),
        x[1]["text"].alias("said"), x[2]["input"].alias("input"), "output_tokens",
    )


@query(f"WITH {_E} SELECT 'app:' || event_type AS name, CAST(count(*) AS BIGINT) AS n, sum(CAST(k AS DOUBLE)) AS total, count(DISTINCT user_id) AS n_users FROM e WHERE k NOT IN (3, 7) GROUP BY 1")
def metric_endpoint(spark: SparkSession, d: str) -> DataFrame:
    """Events written as kept scrapes in the shared folder and read back through the metrics data source."""
    folder = shared_folder(spark) + "/scrapes"
    _lines(spark, d).select("value").write.text(folder)
    m = metrics.scrapes(spark, path=folder).where("error IS NULL")
    return m.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_distinct(F.col("labels.user")).alias("n_users"))


_CHAIN = """b AS (SELECT conv_id, turn, 'message ' || role || ' {"text":"' || replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '","type":"text"}' AS block FROM conversations
  UNION ALL SELECT conv_id, -1, 'system {"text":"policy ' || conv_id % 7 || '","type":"text"}' FROM conversations WHERE turn = 0
  UNION ALL SELECT conv_id, -2, 'tool {"name":"t' || conv_id % 3 || '","strict":true}' FROM conversations WHERE turn = 0),
h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, sha256(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 || ':' || block) AS h FROM b),
p AS (SELECT conv_id, CAST(place AS INTEGER) AS place, """ + " || ".join(
    f"printf('%08x', CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY place) % 4294967296 AS BIGINT))" for i in range(8)
) + " AS prefix_key FROM h)"


def _turn_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a message of a request, the first one with tools and a system text that conversations share, by place in the conversation.

    Keys of the JSON come in either order.
    """
    c, turned = _t(spark, d, "conversations"), F.col("turn") % 2 == 1
    said, i = F.coalesce("text", F.lit("")), F.col("conv_id")
    block = F.when(turned, F.to_json(F.struct(said.alias("text"), F.lit("text").alias("type")))).otherwise(F.to_json(F.struct(F.lit("text").alias("type"), said.alias("text"))))
    tool = F.when(i % 2 == 0, F.concat(F.lit('{"strict":true,"name":"t'), (i % 3).cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"name":"t'), (i % 3).cast("string"), F.lit('","strict":true}')))
    head = F.when(F.col("turn") == 0, F.concat(F.lit('"system":"policy '), (i % 7).cast("string"), F.lit('","tools":['), tool, F.lit("],"))).otherwise("")
    request = F.concat(F.lit("{"), head, F.lit('"messages":[{"content":['), block, F.lit('],"role":"'), F.col("role"), F.lit('"}]}'))
    asked = c.select(F.struct("conv_id", "turn").alias("call"), F.parse_json(request).alias("request"))
    blocks = prefixes.content_blocks(asked, "call", "request").select(F.col("call.conv_id").alias("conv_id"), F.col("call.turn").alias("turn"), F.col("place").alias("inner"), "block")
    t = in_ranges(blocks, "conv_id", "turn", "inner")
    return scans.running_sums(t, "conv_id", {"n": F.lit(1).cast("long")}, ["turn", "inner"]).select("conv_id", (F.col("n") - 1).cast("int").alias("place"), "block")


@query(f"WITH {_CHAIN} SELECT * FROM p")
def prefix_keys(spark: SparkSession, d: str) -> DataFrame:
    return prefixes.prefix_keys(_turn_blocks(spark, d), "conv_id", "place", "block")


@query(
    f"""WITH {_CHAIN}, a AS (SELECT *, row_number() OVER (ORDER BY place, conv_id) AS pos FROM p),
l AS (SELECT *, lag(pos) OVER (PARTITION BY prefix_key ORDER BY pos) AS was FROM a),
d AS (SELECT l.conv_id, l.place, CASE WHEN was IS NOT NULL THEN (SELECT count(DISTINCT m.prefix_key) FROM a AS m WHERE m.pos > l.was AND m.pos < l.pos) END AS distance FROM l)
SELECT conv_id, count(*) AS n_blocks, CAST(coalesce(min(place) FILTER (WHERE distance IS NULL OR distance >= 50), count(*)) AS BIGINT) AS resident FROM d GROUP BY 1"""
)
def resident_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations side by side, a turn of each in turn: how much of each a list of the 50 keys used last still holds."""
    keys = prefixes.prefix_keys(_turn_blocks(spark, d), "conv_id", "place", "block")
    return prefixes.resident_prefix(prefixes.reuse_distances(keys, "prefix_key", "place", "conv_id"), "conv_id", "place", 50)
