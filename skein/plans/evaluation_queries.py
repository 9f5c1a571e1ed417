"""Queries that judge replays over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import evaluation
from skein.plans.catalogue import _E, _events, _t, query

#: As text.settled() rounds to six places.
_SIX = "floor(({}) * CAST('1000000' AS DOUBLE) + CAST('0.50137' AS DOUBLE)) / CAST('1000000' AS DOUBLE)"

_MATCH = "m AS (SELECT conv_id, turn, (length(text) + turn) % 7 <> 0 AS ok, turn % 2 = 0 AS turned FROM conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's recorded action, and a replayed one: the same in another order of keys and other spacing, or with another argument."""
    c = _t(spark, d, "conversations")
    n, ok = F.length("text"), (F.length("text") + F.col("turn")) % 7 != 0
    name = F.when(F.col("turn") % 2 == 0, "Read  File").otherwise("edit")
    recorded = F.to_json(F.struct(name.alias("tool"), F.struct(n.alias("a"), F.col("turn").alias("b")).alias("args")))
    replayed = F.concat(F.lit('{ "args" : {"b":'), F.col("turn").cast("string"), F.lit(', "a": '), F.when(ok, n).otherwise(n + 1).cast("string"), F.lit('.0}, "tool":"'), name, F.lit('"}'))
    return c.select("conv_id", "turn", F.parse_json(recorded).alias("recorded"), F.parse_json(replayed).alias("replayed"))


@query(f"WITH {_MATCH} SELECT conv_id, count(*) FILTER (WHERE ok) AS n_match, count(*) AS n_turns, count(*) FILTER (WHERE ok) / count(*) AS accuracy FROM m GROUP BY 1")
def action_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy(_turns(spark, d), "conv_id", evaluation.same_action(F.col("recorded"), F.col("replayed")))


@query(f"WITH {_MATCH} SELECT conv_id, coalesce(min(turn) FILTER (WHERE NOT coalesce(ok, false)), max(turn)) AS horizon, count(*) FILTER (WHERE NOT coalesce(ok, false)) > 0 AS diverged FROM m GROUP BY 1")
def divergence_horizons(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.horizons(_turns(spark, d), "conv_id", "turn", evaluation.same_action(F.col("recorded"), F.col("replayed")))


@query(
    f"""WITH {_MATCH}, h AS (SELECT coalesce(min(turn) FILTER (WHERE NOT ok), max(turn)) AS step, count(*) FILTER (WHERE NOT ok) > 0 AS diverged FROM m GROUP BY conv_id),
s AS (SELECT step, count(*) FILTER (WHERE diverged) AS n_diverged, count(*) FILTER (WHERE NOT diverged) AS n_censored FROM h GROUP BY 1),
r AS (SELECT *, CAST(sum(n_diverged + n_censored) OVER (ORDER BY step DESC) AS BIGINT) AS at_risk FROM s)
SELECT step, at_risk, n_diverged, n_censored, {_SIX.format("(SELECT product(1 - q.n_diverged / q.at_risk) FROM r AS q WHERE q.step <= r.step)")} AS survival FROM r"""
)
def divergence_survival(spark: SparkSession, d: str) -> DataFrame:
    return text.settled(evaluation.survival(divergence_horizons(spark, d)), 6, "survival")


@query(
    f"""WITH v AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, embedding FROM embeddings)
SELECT a.pair, {_SIX.format("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")} AS similarity FROM v AS a JOIN v AS b USING (pair) WHERE a.side = 0 AND b.side = 1"""
)
def aligned_similarity(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), "embedding")
    return text.settled(evaluation.aligned_similarity(v.where("side = 0"), v.where("side = 1"), "pair", "embedding"), 6, "similarity")


@query(
    """WITH p AS (SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS latency, CAST((doc_id * 7919) % 1009 AS BIGINT) AS cost FROM documents WHERE text IS NOT NULL)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS q WHERE q.lang IS NOT DISTINCT FROM p.lang AND q.latency <= p.latency AND q.cost <= p.cost AND (q.latency < p.latency OR q.cost < p.cost))"""
)
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("latency"), ((F.col("doc_id") * 7919) % 1009).alias("cost"))
    return evaluation.pareto(p, "lang", "latency", "cost")


_FIT = "p AS (SELECT 1024 * (1 + l_partkey % 3) AS total_tokens, 1 - (l_linenumber - 1) / 8 AS uncached, 40 + 0.001 * l_extendedprice + CASE WHEN l_linenumber > 4 THEN 0 ELSE 30 * (5 - l_linenumber) END AS ttft, l_orderkey % 4 <> 0 AS train FROM lineitem)"


def _fit_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    ttft = F.lit(40.0) + F.lit(0.001) * F.col("l_extendedprice") + F.when(n > 4, F.lit(0)).otherwise(30 * (5 - n))
    return _t(spark, d, "lineitem").select((1024 * (1 + F.col("l_partkey") % 3)).alias("total_tokens"), (1 - (n - 1) / 8).alias("uncached"), ttft.alias("ttft"), (F.col("l_orderkey") % 4 != 0).alias("train"))


@query(
    f"""WITH {_FIT}, g AS (SELECT total_tokens, regr_slope(ttft, uncached) AS slope, regr_intercept(ttft, uncached) AS intercept, regr_r2(ttft, uncached) AS r2, count(*) AS n_train FROM p WHERE train GROUP BY 1),
e AS (SELECT total_tokens, ttft - (slope * uncached + intercept) AS e FROM p JOIN g USING (total_tokens) WHERE NOT train), h AS (SELECT total_tokens, count(*) AS n_holdout, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM e GROUP BY 1)
SELECT total_tokens, {_SIX.format("slope")} AS slope, {_SIX.format("intercept")} AS intercept, {_SIX.format("r2")} AS r2, n_train, n_holdout, {_SIX.format("mae")} AS holdout_mae, {_SIX.format("rmse")} AS holdout_rmse FROM g JOIN h USING (total_tokens)"""
)
def fitted_ttft(spark: SparkSession, d: str) -> DataFrame:
    fit = evaluation.fitted(_fit_rows(spark, d), "total_tokens", "uncached", "ttft", F.col("train"))
    return text.settled(fit, 6, "slope", "intercept", "r2", "holdout_mae", "holdout_rmse")


@query(
    f"""WITH {_FIT}, x AS (SELECT DISTINCT total_tokens, uncached AS b FROM p WHERE train),
s AS (SELECT x.total_tokens, b, count(*) FILTER (WHERE uncached > b) AS nh, regr_syy(ttft, uncached) FILTER (WHERE uncached <= b) AS lyy, regr_sxy(ttft, uncached) FILTER (WHERE uncached <= b) AS lxy, regr_sxx(ttft, uncached) FILTER (WHERE uncached <= b) AS lxx,
  regr_syy(ttft, uncached) FILTER (WHERE uncached > b) AS hyy, regr_sxy(ttft, uncached) FILTER (WHERE uncached > b) AS hxy, regr_sxx(ttft, uncached) FILTER (WHERE uncached > b) AS hxx FROM x JOIN p ON p.total_tokens = x.total_tokens AND train GROUP BY 1, 2),
t AS (SELECT total_tokens, b, lyy - CASE WHEN lxx > 1e-9 THEN lxy * lxy / lxx ELSE 0 END + CASE WHEN nh = 0 THEN 0 ELSE hyy - CASE WHEN hxx > 1e-9 THEN hxy * hxy / hxx ELSE 0 END END AS two FROM s),
o AS (SELECT total_tokens, regr_syy(ttft, uncached) - regr_sxy(ttft, uncached) ** 2 / regr_sxx(ttft, uncached) AS one FROM p WHERE train GROUP BY 1)
SELECT total_tokens, arg_min(b, two) AS break_x, floor(any_value(one) + CAST('0.50137' AS DOUBLE)) AS sse_one, floor(min(two) + CAST('0.50137' AS DOUBLE)) AS sse_two FROM t JOIN o USING (total_tokens) GROUP BY 1"""
)
def fitted_ttft_break(spark: SparkSession, d: str) -> DataFrame:
    fit = evaluation.fitted_in_two(_fit_rows(spark, d), "total_tokens", "uncached", "ttft", F.col("train"))
    return text.settled(fit, 0, "sse_one", "sse_two")


_FLIGHT = f"""{_E}, c AS (SELECT event_id, s * 10 AS b, s * 10 + round(value * 3000) AS f FROM e WHERE value >= 0),
p AS (SELECT event_id, b AS time, 1 AS kind, 1 AS change FROM c UNION ALL SELECT event_id, f, CASE WHEN f = b THEN 2 ELSE 0 END, -1 FROM c),
l AS (SELECT *, CAST(sum(change) OVER (ORDER BY time, kind, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level FROM p)"""


def _calls_in_flight(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("s") * 10
    return evaluation.in_flight(_events(spark, d).select("event_id", start.alias("b"), (start + F.round(F.col("value") * 3000)).alias("f")), "event_id", "b", "f")


@query(f"WITH {_FLIGHT} SELECT event_id, level FROM l WHERE change > 0")
def calls_in_flight(spark: SparkSession, d: str) -> DataFrame:
    """How many calls are under way once a call has begun."""
    return _calls_in_flight(spark, d).where("change > 0").select("event_id", "level")


@query(
    f"""WITH {_FLIGHT}, s AS (SELECT lag(level) OVER w AS level, time - lag(time) OVER w AS span, change < 0 AS ended FROM l WINDOW w AS (ORDER BY time, kind, event_id)),
t AS (SELECT level, sum(span) AS seconds, count(*) FILTER (WHERE ended) AS n_ended FROM s WHERE level IS NOT NULL GROUP BY 1), y AS (SELECT *, CASE WHEN seconds > 0 THEN n_ended / seconds END AS per_second FROM t),
z AS (SELECT arg_min(per_second, level) AS y0, arg_max(per_second, level) AS y1, min(level) AS x0, max(level) AS x1 FROM y WHERE per_second IS NOT NULL),
k AS (SELECT level, per_second, coalesce(per_second - (y0 + (y1 - y0) * (level - x0) / nullif(x1 - x0, 0)), 0) AS bend FROM y, z WHERE per_second IS NOT NULL)
SELECT level, {_SIX.format("per_second")} AS per_second, row_number() OVER (ORDER BY bend DESC, level) = 1 AS is_knee FROM k"""
)
def concurrency_knee(spark: SparkSession, d: str) -> DataFrame:
    curve = evaluation.throughput(_calls_in_flight(spark, d), "event_id")
    return text.settled(evaluation.knee(curve, "level", "per_second").select("level", "per_second", "is_knee"), 6, "per_second")
