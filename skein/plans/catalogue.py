"""Queries over the driver's tables, and the same in SQL.

Call records are `events` (user = session, event type = path, value = latency),
prompts are `documents` and `conversations`, experiment rows `lineitem`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import stats, text, timing
from skein.operators import experiments, policies, sse, windows
from skein.plans import inspect, replay
from skein.sources import metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _seconds(c: str = "ts") -> Column:
    """Epoch seconds of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})") / F.lit(1e6)


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.withColumns({"s": _seconds(), "k": F.get_json_object("props", "$.k").cast("int")})


_E = "e AS (SELECT *, epoch_us(ts) / 1e6 AS s, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
_GAP = f"{_E}, g AS (SELECT *, round_even(s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id), 1) AS gap_s FROM e)"
#: The lifetime of each event type's cache; others have none.
_TTL = {"view": 300.0, "click": 300.0, "purchase": 3600.0, "signup": 3600.0}
_TTL_SQL = "CASE WHEN event_type IN ('view', 'click') THEN 300.0 WHEN event_type IN ('purchase', 'signup') THEN 3600.0 END"
_STATUS_SQL = "CASE WHEN k < 90 THEN 200 WHEN k < 97 THEN 429 ELSE 502 END"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return windows.session_gaps(_events(spark, d), "user_id", "s", ["event_id"])


def _ttl() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in _TTL.items() for x in kv]), F.col("event_type"))


def _status() -> Column:
    return F.when(F.col("k") < 90, 200).when(F.col("k") < 97, 429).otherwise(502)


@query(f"WITH {_GAP} SELECT event_id, gap_s FROM g")
def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).select("event_id", "gap_s")


@query(
    f"""WITH {_GAP}, t AS (SELECT gap_s, {_TTL_SQL} AS ttl FROM g)
SELECT CASE WHEN ttl IS NULL THEN 'uncached' WHEN gap_s IS NULL THEN 'first' WHEN gap_s <= ttl THEN 'warm' ELSE 'cold' END AS temperature, count(*) AS n FROM t GROUP BY 1"""
)
def cache_temperature(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).groupBy(windows.cache_temperature(F.col("gap_s"), _ttl()).alias("temperature")).agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT CAST({_TTL_SQL} AS DOUBLE) AS ttl_s, count(*) AS n FROM e WHERE {_TTL_SQL} IS NOT NULL GROUP BY 1")
def ttl_histogram(spark: SparkSession, d: str) -> DataFrame:
    return replay.ttl_histogram(_events(spark, d).select(F.struct(_ttl().alias("cloud_cache_ttl_s")).alias("features")))


@query("SELECT event_type AS path, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1")
def path_counts(spark: SparkSession, d: str) -> DataFrame:
    return inspect.counts(_t(spark, d, "events").withColumnRenamed("event_type", "path"), "path", "event_id")


@query(f"WITH {_E}, t AS (SELECT {_STATUS_SQL} AS status FROM e) SELECT status, count(*) AS n FROM t WHERE EXISTS (SELECT 1 FROM t WHERE status IS DISTINCT FROM 200) GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return inspect.status_counts(_events(spark, d).withColumn("status", _status()), "event_id").drop("first_seen")


@query(f"WITH {_E} SELECT k AS tool, count(*) AS n, min(event_id) AS first_seen FROM e GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 15")
def tool_topk(spark: SparkSession, d: str) -> DataFrame:
    return inspect.counts(_events(spark, d).withColumnRenamed("k", "tool"), "tool", "event_id").limit(15)


_CONV = """c AS (SELECT conv_id, turn, role, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations),
a AS (SELECT conv_id, turn, CAST(before // 4 AS BIGINT) AS est_prompt_tokens, CAST(n // 4 AS BIGINT) AS output_tokens,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS earlier_calls FROM c WHERE role = 'assistant')"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as calls: the prompt is all that came before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, d, "conversations").withColumn("n", F.length("text"))
    c = c.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return c.where("role = 'assistant'").select(
        "conv_id", "turn", F.floor(F.col("before") / 4).alias("est_prompt_tokens"), F.floor(F.col("n") / 4).cast("long").alias("output_tokens"),
        (F.row_number().over(w) - 1).cast("long").alias("earlier_calls"),
    )


@query(f"WITH {_CONV} SELECT * FROM a")
def prompt_growth_features(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d)


@query(
    f"""WITH {_CONV}, r AS (SELECT *, CASE WHEN earlier_calls > 0 THEN est_prompt_tokens // 2 ELSE 0 END AS cache_read FROM a)
SELECT CAST(sum(est_prompt_tokens) AS BIGINT) AS sum_input, CAST(sum(output_tokens) AS BIGINT) AS sum_output, CAST(sum(cache_read) AS BIGINT) AS sum_cache_read,
  median(est_prompt_tokens) AS median_input, median(output_tokens) AS median_output, sum(cache_read) / nullif(sum(est_prompt_tokens) + sum(cache_read), 0) AS prefix_reuse FROM r"""
)
def token_summary(spark: SparkSession, d: str) -> DataFrame:
    read = F.when(F.col("earlier_calls") > 0, F.floor(F.col("est_prompt_tokens") / 2)).otherwise(0)
    usage = F.struct(F.col("est_prompt_tokens").alias("input_tokens"), F.col("output_tokens"), read.alias("cache_read_input_tokens"))
    return inspect.token_summary(_calls(spark, d).select(F.to_variant_object(usage).alias("usage"))).drop("sum_cache_creation")


@query(
    """WITH v AS (SELECT event_type, list_sort(list(value)) AS x FROM events WHERE value IS NOT NULL AND value <> 0 GROUP BY 1)
SELECT event_type, x[least(CAST(floor(CAST('0.5' AS DOUBLE) * len(x)) AS BIGINT), len(x) - 1) + 1] AS p50, x[least(CAST(floor(CAST('0.9' AS DOUBLE) * len(x)) AS BIGINT), len(x) - 1) + 1] AS p90,
  x[least(CAST(floor(CAST('0.99' AS DOUBLE) * len(x)) AS BIGINT), len(x) - 1) + 1] AS p99 FROM v"""
)
def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").where(stats.truthy(F.col("value")))
    return stats.nearest_rank(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, count(value) AS n FROM events GROUP BY 1")
def latency_linear_pct(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    n = e.groupBy("event_type").agg(F.count("value").alias("n"))
    return stats.grouped_alike(n, stats.quantiles(e, ["event_type"], {"p50": ("value", 0.5), "p10": ("value", 0.1), "p90": ("value", 0.9)}), ["event_type"])


@query(
    "SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.5) AS median_quantity, quantile_cont(l_extendedprice, 0.1) AS p10_price, quantile_cont(l_extendedprice, 0.9) AS p90_price FROM lineitem GROUP BY 1, 2"
)
def lineitem_linear_pct(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"median_quantity": ("l_quantity", 0.5), "p10_price": ("l_extendedprice", 0.1), "p90_price": ("l_extendedprice", 0.9)}
    return stats.quantiles(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], wanted)


@query(
    """WITH m AS (SELECT role, min(text) AS a, max(text) AS b FROM conversations GROUP BY 1)
SELECT role, coalesce((SELECT left(a, max(i)) FROM range(1, length(a) + 1) AS r(i) WHERE left(a, i) = left(b, i)), '') AS prefix FROM m"""
)
def common_prefix_by_role(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").groupBy("role").agg(stats.common_prefix(F.col("text")).alias("prefix"))


_SETTLED = "floor({} * CAST('1000000' AS DOUBLE) + CAST('0.50137' AS DOUBLE)) / CAST('1000000' AS DOUBLE)"
_EWMA = f"""RECURSIVE o AS (WITH {_E} SELECT event_id, user_id, s, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i FROM e),
r AS (SELECT event_id, user_id, i, x AS rtt, CAST(0 AS DOUBLE) AS jitter FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.i, r.rtt + CAST('0.2' AS DOUBLE) * (o.x - r.rtt), r.jitter + CAST('0.2' AS DOUBLE) * (abs(o.x - r.rtt) - r.jitter) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)"""


@query(f"WITH {_EWMA} SELECT user_id, {_SETTLED.format('max_by(rtt, i)')} AS rtt_ewma, {_SETTLED.format('max_by(jitter, i)')} AS jitter_ewma, count(*) AS n_samples FROM r GROUP BY 1")
def link_ewma(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "s", "event_id", "value")
    run = windows.running_ewma(e, "user_id", "s", "value", order=["event_id"])
    last = F.max_by(F.struct("rtt_ewma", "jitter_ewma", "n_samples"), F.struct("s", "event_id"))
    return text.settled(run.groupBy("user_id").agg(last.alias("e")).select("user_id", "e.rtt_ewma", "e.jitter_ewma", "e.n_samples"), 6, "rtt_ewma", "jitter_ewma")


@query(f"WITH {_EWMA} SELECT event_id, {_SETTLED.format('rtt')} AS rtt_ewma, {_SETTLED.format('jitter')} AS jitter_ewma, CAST(i AS BIGINT) AS n_samples FROM r")
def link_ewma_running(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "user_id", "s", "value")
    run = windows.running_ewma(e, "user_id", "s", "value", order=["event_id"]).select("event_id", "rtt_ewma", "jitter_ewma", "n_samples")
    return text.settled(run, 6, "rtt_ewma", "jitter_ewma")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as calls: the text is the prompt, some carry tools or server tools."""
    i = F.col("doc_id")
    f = F.struct(
        F.floor(F.length("text") / 4).alias("est_prompt_tokens"), F.lit(2048).cast("long").alias("max_tokens"),
        (i % 3 == 0).alias("has_tools"), (i % 17 == 0).alias("has_server_tools"),
    )
    return _t(spark, d, "documents").select("doc_id", f.alias("features"))


_DOC = "f AS (SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS est, doc_id % 3 = 0 AS has_tools, doc_id % 17 = 0 AS server FROM documents)"


def _static_sql(cap: int, clamp: int | None, tools: bool = True) -> str:
    budget = int(cap * 0.9)
    asked = "2048" if clamp is None else f"greatest(1, least(2048, {clamp}, greatest(0, {budget} - est)))"
    return f"CASE WHEN server THEN 'server-side-tool' WHEN est + {asked} > {budget} THEN 'too-large' WHEN has_tools AND {'false' if tools else 'true'} THEN 'tools-unsupported' ELSE 'fits' END"


@query("SELECT doc_id, 'cloud' AS placement, 'policy' AS reason FROM documents")
def policy_cloud_only(spark: SparkSession, d: str) -> DataFrame:
    return replay.decide(_documents(spark, d), policies.build("cloud-only")).select("doc_id", "placement", "reason")


@query("SELECT doc_id, 'local' AS placement, 'policy' AS reason FROM documents")
def policy_local_only(spark: SparkSession, d: str) -> DataFrame:
    return replay.decide(_documents(spark, d), policies.build("local-only")).select("doc_id", "placement", "reason")


@query(
    f"""WITH {_DOC}, r AS (SELECT doc_id, est, {_static_sql(4096, 128, False)} AS reason, CAST(greatest(1, least(2048, 128, greatest(0, 3686 - est))) AS BIGINT) AS effective_max_tokens FROM f)
SELECT doc_id, CASE WHEN reason = 'fits' THEN 'local' ELSE 'cloud' END AS placement, reason, CASE WHEN reason = 'too-large' THEN concat(est + effective_max_tokens, ' > 3686 tokens') END AS detail, effective_max_tokens FROM r"""
)
def policy_static(spark: SparkSession, d: str) -> DataFrame:
    p = policies.build("static", cap=4096, clamp=128, local_tools=False)
    out = replay.decide(_documents(spark, d), p)
    return out.select("doc_id", "placement", "reason", "detail", p.effective_max_tokens(F.col("features")).alias("effective_max_tokens"))


@query(
    f"""WITH {_DOC}, r AS (SELECT {_static_sql(1024, None)} AS reason FROM f)
SELECT CASE WHEN reason = 'fits' THEN 'local' ELSE 'cloud' END AS placement, reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM r GROUP BY 1, 2"""
)
def policy_report(spark: SparkSession, d: str) -> DataFrame:
    return replay.report(replay.decide(_documents(spark, d), policies.build("static", cap=1024, clamp=None)))


@query(
    f"""WITH {_DOC}, c AS (SELECT * FROM (VALUES (1024), (4096), (16384)) AS a(cap), (VALUES (NULL), (128)) AS b(clamp), (VALUES (false), (true)) AS t(tools)),
x AS (SELECT c.*, f.*, CAST(floor(cap * CAST('0.9' AS DOUBLE)) AS BIGINT) AS budget FROM c, f)
SELECT cap, coalesce(CAST(clamp AS VARCHAR), 'off') AS clamp, tools, CAST(count(*) FILTER (WHERE NOT server AND est + CASE WHEN clamp IS NULL THEN 2048 ELSE greatest(1, least(2048, clamp, greatest(0, budget - est))) END <= budget AND (tools OR NOT has_tools)) AS BIGINT) AS n_local,
  count(*) AS n_calls FROM x GROUP BY 1, 2, 3"""
)
def policy_sweep(spark: SparkSession, d: str) -> DataFrame:
    return replay.sweep(spark, _documents(spark, d), [1024, 4096, 16384], [None, 128]).withColumns({"cap": F.col("cap").cast("int"), "clamp": F.coalesce(F.col("clamp").cast("string"), F.lit("off"))})


@query(
    f"""WITH {_DOC}, r AS (SELECT CASE WHEN {_static_sql(4096, 128)} = 'fits' THEN 'local' ELSE 'cloud' END AS recorded, CASE WHEN {_static_sql(1024, 128)} = 'fits' THEN 'local' ELSE 'cloud' END AS decided FROM f)
SELECT recorded, decided, count(*) AS n FROM r GROUP BY 1, 2"""
)
def policy_confusion(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("features")
    both = _documents(spark, d).select(
        policies.build("static", cap=4096, clamp=128).decide(f)["placement"].alias("recorded"), policies.build("static", cap=1024, clamp=128).decide(f)["placement"].alias("decided")
    )
    return replay.confusion(both, "recorded", "decided")


_LINK = """l AS (SELECT CAST((l_linenumber - 1) * 10 AS DOUBLE) AS delay, l_discount < CAST('0.08' AS DOUBLE) AS valid, (l_linenumber - 1) * 10 + l_quantity AS ttft, l_quantity AS corrected FROM lineitem)"""


@query(
    f"""WITH {_LINK}, g AS (SELECT delay, count(*) FILTER (WHERE valid) AS valid_samples, count(*) AS total_samples, quantile_cont(ttft, 0.5) FILTER (WHERE valid) AS median_ttft_ms,
  quantile_cont(ttft, 0.1) FILTER (WHERE valid) AS p10_ttft_ms, quantile_cont(ttft, 0.9) FILTER (WHERE valid) AS p90_ttft_ms, quantile_cont(corrected, 0.5) FILTER (WHERE valid) AS corrected FROM l GROUP BY 1),
b AS (SELECT median_ttft_ms AS bt, corrected AS bc FROM g WHERE delay = 0)
SELECT delay AS configured_delay_ms, valid_samples, total_samples, median_ttft_ms, p10_ttft_ms, p90_ttft_ms, median_ttft_ms - bt AS delta_ttft_vs_zero_ms,
  abs(median_ttft_ms - bt - delay) <= 5 AS ttft_tracks_shaping, abs(corrected - bc) <= 5 AS corrected_server_stable FROM g LEFT JOIN b ON true WHERE valid_samples > 0"""
)
def tolerance_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    delay = ((F.col("l_linenumber") - 1) * 10).cast("double")
    zero = F.lit(0.0)
    rows = _t(spark, d, "lineitem").select(
        delay.alias("configured_delay_ms"), (F.col("l_discount") < F.lit(0.08)).alias("valid"), delay.alias("shaped_ms"), (delay + F.col("l_quantity")).alias("ttft_ms"),
        zero.alias("total_ms"), zero.alias("transport_network_ms"), delay.alias("effective_network_ms"), (delay + F.col("l_quantity")).alias("raw_server_ttft_ms"),
        F.col("l_quantity").alias("corrected_server_ttft_ms"), zero.alias("response_headers_ms"),
    )
    return experiments.link_summary(rows).select(
        "configured_delay_ms", "valid_samples", "total_samples", "median_ttft_ms", "p10_ttft_ms", "p90_ttft_ms", "delta_ttft_vs_zero_ms", "ttft_tracks_shaping", "corrected_server_stable"
    )


@query(
    """WITH p AS (SELECT CAST(1024 * (1 + l_partkey % 3) AS INTEGER) AS total, CAST(256 * (l_linenumber - 1) AS INTEGER) AS cached, l_extendedprice AS ttft, l_tax < CAST('0.07' AS DOUBLE) AS ok FROM lineitem),
g AS (SELECT total, cached, quantile_cont(ttft, 0.5) FILTER (WHERE ok) AS m, quantile_cont(ttft, 0.1) FILTER (WHERE ok) AS p10, quantile_cont(ttft, 0.9) FILTER (WHERE ok) AS p90, count(*) FILTER (WHERE ok) AS v, count(*) AS n FROM p GROUP BY 1, 2)
SELECT g.total AS total_tokens, g.cached AS intended_cached_tokens, g.cached / g.total AS cached_fraction, g.m AS median_ttft_ms, g.p10 AS p10_ttft_ms, g.p90 AS p90_ttft_ms, c.m - g.m AS saved_vs_cold_ms, g.v AS valid_samples, g.n AS total_samples
FROM g LEFT JOIN g AS c ON c.total = g.total AND c.cached = 0 AND c.v > 0 WHERE g.v > 0"""
)
def cold_baseline_saving(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(
        (1024 * (1 + F.col("l_partkey") % 3)).cast("int").alias("total_tokens"), (256 * (F.col("l_linenumber") - 1)).cast("int").alias("intended_cached_tokens"),
        F.col("l_extendedprice").alias("ttft_ms"), (F.col("l_tax") < F.lit(0.07)).alias("valid_hit"),
    )
    return experiments.prefix_summary(rows)


@query(
    f"""WITH {_E}, v AS (SELECT event_type, {_STATUS_SQL} = 200 AND abs(k - 50) <= 45 AS ok FROM e)
SELECT event_type, count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE NOT ok) AS n_invalid, bool_and(ok) AS all_valid FROM v GROUP BY 1"""
)
def validity_ratio(spark: SparkSession, d: str) -> DataFrame:
    ok = (_status() == 200) & experiments.hit_valid(F.col("k"), F.lit(50), F.lit(45))
    v = _events(spark, d).select("event_type", ok.alias("ok"))
    return v.groupBy("event_type").agg(F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_invalid"), F.bool_and("ok").alias("all_valid"))


@query(
    f"""WITH {_E}, p AS (SELECT event_id, value AS ttft, CASE WHEN k % 2 = 0 THEN k * 1.0::DOUBLE END AS a, CASE WHEN k % 3 = 0 THEN 0.5::DOUBLE END AS b, CASE WHEN k % 5 = 0 THEN 0.25::DOUBLE END AS c FROM e),
n AS (SELECT *, CASE WHEN coalesce(a, b, c) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END AS network_ms FROM p)
SELECT event_id, network_ms, network_ms + coalesce(b, 0) AS effective_network_ms, ttft - network_ms AS raw_server_ttft_ms, ttft - (network_ms + coalesce(b, 0)) AS corrected_server_ttft_ms FROM n"""
)
def nullsafe_network_sum(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    a, b, c = F.when(k % 2 == 0, k.cast("double")), F.when(k % 3 == 0, F.lit(0.5)), F.when(k % 5 == 0, F.lit(0.25))
    n = _events(spark, d).withColumn("b", b).withColumn("network_ms", timing.skip_null_sum(a, F.col("b"), c))
    net = F.col("network_ms")
    return n.select(
        "event_id", "network_ms", timing.effective_network(net, F.col("b")).alias("effective_network_ms"), (F.col("value") - net).alias("raw_server_ttft_ms"),
        timing.corrected_server_ttft(F.col("value"), net, F.col("b")).alias("corrected_server_ttft_ms"),
    )


@query(
    f"""WITH {_E} SELECT user_id, min(s) FILTER (WHERE event_type = 'click') - min(s) FILTER (WHERE event_type = 'view') AS connect_s,
  min(s) FILTER (WHERE event_type = 'purchase') - min(s) FILTER (WHERE event_type = 'click') AS send_s, min(s) FILTER (WHERE event_type = 'absent') - min(s) FILTER (WHERE event_type = 'click') AS tls_s FROM e GROUP BY 1"""
)
def phase_durations(spark: SparkSession, d: str) -> DataFrame:
    e, s = F.col("event_type"), F.col("s")
    return _events(spark, d).groupBy("user_id").agg(
        timing.phase(e, s, "view", "click").alias("connect_s"), timing.phase(e, s, "click", "purchase").alias("send_s"), timing.phase(e, s, "click", "absent").alias("tls_s")
    )


@query(
    f"""WITH {_E} SELECT r.event_id, v.value AS sample, r.s - v.s AS age_s FROM e AS r ASOF LEFT JOIN (SELECT s, max_by(value, event_id) AS value FROM e WHERE event_type = 'view' GROUP BY 1) AS v ON r.s >= v.s"""
)
def asof_latest_sample(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    samples = e.where("event_type = 'view'").select("s", "value", "event_id")
    return windows.latest_sample(e.select("event_id", "s"), samples, "s", "value", ["event_id"]).select("event_id", "sample", "age_s")


@query(
    f"""WITH {_E}, p AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'before' WHEN event_type = 'click' THEN 'after' END AS phase, value FROM e)
SELECT user_id, max(value) FILTER (WHERE phase = 'after') - max(value) FILTER (WHERE phase = 'before') AS delta FROM p GROUP BY 1"""
)
def counter_delta(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    p = _t(spark, d, "events").withColumn("phase", F.when(e == "view", "before").when(e == "click", "after"))
    return p.groupBy("user_id").agg(experiments.counter_delta(F.col("phase"), F.col("value")).alias("delta"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as metric lines, with comments and lines without a number."""
    line = F.concat(
        F.lit("app:"), "event_type", F.lit('{user="'), F.col("user_id").cast("string"), F.lit('",k="'), F.col("k").cast("string"), F.lit('"} '),
        F.when(F.col("k") == 7, "none").otherwise(F.col("k").cast("string")), F.when(F.col("k") % 2 == 0, " 1700000000").otherwise(""),
    )
    return _events(spark, d).select("event_id", F.when(F.col("k") == 3, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))


@query(f"WITH {_E} SELECT event_id, 'app:' || event_type AS name, CAST(user_id AS VARCHAR) AS user_label, CAST(k AS VARCHAR) AS k_label, CAST(k AS DOUBLE) AS value FROM e WHERE k NOT IN (3, 7)")
def prometheus_parse(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.parse_lines(_lines(spark, d))
    return m.select("event_id", "name", F.col("labels.user").alias("user_label"), F.col("labels.k").alias("k_label"), "value")


@query(f"WITH {_E} SELECT 'app:' || event_type AS name, sum(CAST(k AS DOUBLE)) AS total FROM e WHERE k NOT IN (3, 7) GROUP BY 1")
def counter_total(spark: SparkSession, d: str) -> DataFrame:
    return metrics.totals(metrics.parse_lines(_lines(spark, d)))


@query(f"WITH {_E} SELECT user_id, max_by(value, event_id) AS value FROM e WHERE event_type = 'view' GROUP BY 1")
def gauge_last(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("name"), "value")
    return metrics.gauge_last(m, "view", "event_id", "user_id")


@query(
    """WITH p(preset, delay, mbps) AS (VALUES ('none', 0.0::DOUBLE, 0.0::DOUBLE), ('colo', 5.0, 200.0), ('branch-office', 20.0, 50.0), ('home-broadband', 30.0, 5.0), ('cellular', 80.0, 5.0)),
b AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents), x AS (SELECT *, CASE WHEN mbps > 0 THEN n_bytes * 8 / (mbps * 1e6) * 1000 ELSE 0 END AS transmission_ms FROM b, p)
SELECT doc_id, preset, transmission_ms, CASE WHEN delay > 0 OR mbps > 0 THEN greatest(0, delay + transmission_ms) ELSE 0 END AS wait_ms FROM x"""
)
def link_transmission_presets(spark: SparkSession, d: str) -> DataFrame:
    presets = spark.createDataFrame([(n, *v) for n, v in experiments.PRESETS.items()], "preset string, delay double, jitter double, mbps double")
    n = F.octet_length("text").cast("long")
    x = _t(spark, d, "documents").select("doc_id", n.alias("n_bytes")).crossJoin(F.broadcast(presets))
    b, m = F.col("n_bytes"), F.col("mbps")
    return x.select("doc_id", "preset", timing.transmission_ms(b, m).alias("transmission_ms"), timing.shaped_wait_ms(b, F.col("delay"), F.col("jitter"), m).alias("wait_ms"))


@query(
    f"""WITH {_E} SELECT event_id, k / 100.0::DOUBLE * 100 AS used_pct, CAST(floor(k / 100.0::DOUBLE * 131072) AS BIGINT) AS used_tokens,
  coalesce(CASE WHEN k % 2 = 0 THEN 1073741824.0::DOUBLE * k END, 131072 * 57344.0::DOUBLE) / 1073741824 AS pool_gib FROM e"""
)
def kv_estimate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    pool = F.when(k % 2 == 0, F.lit(1073741824.0) * k)
    est = timing.kv_estimates(k / F.lit(100.0), F.lit(131072), pool, F.lit(57344.0))
    return _events(spark, d).select("event_id", est.alias("x")).select("event_id", "x.used_pct", "x.used_tokens", "x.pool_gib")


@query("SELECT conv_id, turn, text, CAST(length(text) AS BIGINT) AS output_tokens, 'end_turn' AS stop_reason FROM conversations WHERE text <> ''")
def sse_reassemble(spark: SparkSession, d: str) -> DataFrame:
    """Each turn is cut into chunks of seven characters, written as an event stream, and folded back."""
    c = _t(spark, d, "conversations").where("text <> ''").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    n = F.ceil(F.length("text") / 7).cast("int")
    chunk = lambda i: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), F.substring("text", i * 7 + 1, F.lit(7)).alias("text")).alias("delta")))
    start = F.lit('data: {"type":"content_block_start","index":0,"content_block":{"type":"text","text":""}}')
    end = F.concat(F.lit('data: {"type":"message_delta","delta":{"stop_reason":"end_turn"},"usage":{"output_tokens":'), F.length("text").cast("string"), F.lit("}}"))
    deltas = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("event: content_block_delta\ndata: "), chunk(i)))
    raw = F.concat_ws("\n\n", F.array(start), deltas, F.array(end, F.lit("data: [DONE]"), F.lit("data: {broken")))
    blocks, messages = sse.reassemble(sse.events(c.select("id", raw.alias("raw")), "id", "raw"), "id")
    out = blocks.join(messages, "id")
    part = F.split("id", "/")
    return out.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "text", "output_tokens", "stop_reason")


@query(
    f"WITH {_E} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'session-' || user_id END AS session, CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_headers FROM e"
)
def redact_map(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("k") % 2 == 0, "X-Session").otherwise("Authorization")
    h = F.create_map(name, F.concat(F.lit("session-"), F.col("user_id").cast("string")), F.lit("Cookie"), F.lit("x"), F.lit("Accept"), F.lit("*/*"))
    r = _events(spark, d).select("event_id", text.redact(h, text.CREDENTIALS).alias("h"))
    return r.select("event_id", F.try_element_at("h", F.lit("x-session")).alias("session"), F.size("h").alias("n_headers"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT user_id, min(s) FILTER (WHERE event_type = 'click') AS first_ts FROM e GROUP BY 1")
def first_chunk_time(spark: SparkSession, d: str) -> DataFrame:
    return sse.first_chunk(_events(spark, d), "user_id", "s", "event_type", "click")


@query("SELECT o_orderpriority AS reason, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", stats.share(F.col("n")))
