"""Expressions: percentiles, prefixes, metric text, timings."""

import pytest
from pyspark.sql import functions as F

from skein.functions import stats, text, timing
from skein.operators import experiments, windows
from skein.sources import metrics


def one(df):
    return df.first()


def test_shaped_delay_is_added_to_network(spark):
    r = one(spark.sql("SELECT 210D ttft, 30D net, 80D shaped").select(timing.effective_network(F.col("net"), F.col("shaped")), timing.corrected_server_ttft(F.col("ttft"), F.col("net"), F.col("shaped"))))
    assert tuple(r) == (110.0, 100.0)


def test_missing_delay_counts_as_none(spark):
    r = one(spark.sql("SELECT 130D ttft, 30D net, cast(null as double) shaped").select(timing.effective_network(F.col("net"), F.col("shaped")), timing.corrected_server_ttft(F.col("ttft"), F.col("net"), F.col("shaped"))))
    assert tuple(r) == (30.0, 100.0)


def test_link_summary_exposes_the_raw_leak(spark):
    cols = "configured_delay_ms double, valid boolean, shaped_ms double, ttft_ms double, total_ms double, transport_network_ms double, effective_network_ms double, raw_server_ttft_ms double, corrected_server_ttft_ms double, response_headers_ms double"
    rows = [(0.0, True, 0.0, 130.0, 140.0, 30.0, 30.0, 100.0, 100.0, 10.0), (80.0, True, 80.0, 210.0, 220.0, 30.0, 110.0, 180.0, 100.0, 10.0)]
    r = one(experiments.link_summary(spark.createDataFrame(rows, cols), 5.0).where("configured_delay_ms = 80"))
    assert (r["delta_ttft_vs_zero_ms"], r["delta_raw_server_vs_zero_ms"], r["delta_corrected_server_vs_zero_ms"]) == (80.0, 80.0, 0.0)
    assert r["ttft_tracks_shaping"] and r["corrected_server_stable"]
    alone = one(experiments.link_summary(spark.createDataFrame(rows[1:], cols), 5.0))
    assert alone["delta_ttft_vs_zero_ms"] is None and alone["ttft_tracks_shaping"] is None


@pytest.mark.parametrize("unit,size,want", [("32", "16", 32), ("None", "16", 16), ("unknown", "16", 16), ("None", "0", None)])
def test_first_positive(spark, unit, size, want):
    df = spark.createDataFrame([(unit, size)], "a string, b string")
    assert one(df.select(text.first_positive(F.col("a"), F.col("b"))))[0] == want


METRICS = """# HELP x y

vllm:kv_cache_usage_perc{engine="0"} 0.25
vllm:num_requests_running{engine="0"} 2.0
vllm:num_requests_waiting{engine="0"} 1.0 1700000000
vllm:cache_config_info{block_size="16",cache_dtype="auto",kv_cache_memory_bytes="None",kv_cache_size_tokens="131072",num_gpu_blocks="8192"} 1.0
bad{a="b"} none
total{a="1"} 3
total{a="2"} 4"""


def test_metric_text(spark):
    lines = spark.createDataFrame(list(enumerate(METRICS.split("\n"))), "line int, value string")
    m = metrics.parse_lines(lines).cache()
    got = {r["name"]: r for r in m.collect()}
    assert got["vllm:num_requests_waiting"]["value"] == 1.0 and "bad" not in got
    info = got["vllm:cache_config_info"]["labels"]
    assert info["kv_cache_size_tokens"] == "131072" and info["block_size"] == "16"
    assert one(metrics.required_total(m, "total"))[0] == 7.0
    assert one(metrics.gauge_last(m, "total", "line"))[0] == 4.0
    with pytest.raises(Exception, match="missing metric"):
        metrics.required_total(m, "absent").collect()
    x = m.where("name = 'vllm:cache_config_info'").select(
        timing.kv_estimates(F.lit(0.25), text.safe_int(F.col("labels.kv_cache_size_tokens")), text.safe_int(F.col("labels.kv_cache_memory_bytes")), F.lit(57344.0)).alias("x")
    )
    assert tuple(one(x.select("x.*"))) == (25.0, 32768, 7.0, 1.75)


def test_meminfo(spark):
    df = spark.createDataFrame([("MemTotal:       33554432 kB\nMemAvailable:   25165824 kB\n",)], "t string")
    assert tuple(one(df.select(metrics.meminfo(F.col("t")).alias("m")).select("m.*"))) == (32.0, 8.0, 25.0)


def test_nearest_rank_is_not_interpolated(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", None), ("c", 5.0), ("c", 5.0)], "g string, v double")
    got = {r["g"]: (r["p50"], r["p90"]) for r in stats.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (6.0, 10.0), "b": (0.0, 0.0), "c": (5.0, 5.0)}


def test_common_prefix(spark):
    df = spark.createDataFrame([("a", "héllo"), ("a", "hélp"), ("b", "same"), ("b", "same"), ("c", "x"), ("c", "y"), ("d", "ab"), ("d", "abc")], "g string, t string")
    assert {r[0]: r[1] for r in df.groupBy("g").agg(stats.common_prefix(F.col("t"))).collect()} == {"a": "hél", "b": "same", "c": "", "d": "ab"}


def test_ewma_folds_and_runs_alike(spark):
    rows = [("k", 1.0, 10.0), ("k", 2.0, None), ("k", 3.0, 20.0), ("k", 4.0, 5.0), ("j", 1.0, 7.0)]
    df = spark.createDataFrame(rows, "key string, ts double, x double")
    run = {(r["key"], r["ts"]): r for r in windows.running_ewma(df, "key", "ts", "x").collect()}
    assert run["k", 2.0]["n_samples"] == 1 and run["k", 2.0]["staleness_s"] == 1.0
    rtt, jitter = 10.0, 0.0
    for x in (20.0, 5.0):
        rtt, jitter = rtt + 0.2 * (x - rtt), jitter + 0.2 * (abs(x - rtt) - jitter)
    assert (run["k", 4.0]["rtt_ewma"], run["k", 4.0]["jitter_ewma"]) == pytest.approx((rtt, jitter), rel=1e-12)
    folded = df.orderBy("ts").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "x"))).alias("a")).select("key", stats.ewma(F.transform("a", lambda s: s["x"])).alias("e"))
    assert {r["key"]: (r["e"]["rtt"], r["e"]["jitter"], r["e"]["n"]) for r in folded.collect()} == {"k": (rtt, jitter, 3), "j": (7.0, 0.0, 1)}


def test_latest_sample_crosses_buckets(spark):
    recs = spark.createDataFrame([(i, t) for i, t in enumerate([5.0, 10.0, 4000.0, 9000.0, 20000.0, 100.0])], "id int, ts double")
    samples = spark.createDataFrame([(10.0, 1.0), (90.0, 2.0), (8000.0, 3.0)], "ts double, v double")
    got = {r["id"]: (r["sample"], r["age_s"]) for r in windows.latest_sample(recs, samples, "ts", "v").collect()}
    assert got == {0: (None, None), 1: (1.0, 0.0), 2: (2.0, 3910.0), 3: (3.0, 1000.0), 4: (3.0, 12000.0), 5: (2.0, 10.0)}


def test_session_gaps_ignore_missing(spark):
    rows = [(1, "a", 10.0), (2, "a", None), (3, "a", 25.0), (4, None, 26.0), (5, "b", 1.0)]
    df = spark.createDataFrame(rows, "id int, s string, ts double")
    assert {r["id"]: r["gap_s"] for r in windows.session_gaps(df, "s", "ts", ["id"]).collect()} == {1: None, 2: None, 3: 15.0, 4: None, 5: None}


def test_prefix_summary(spark):
    rows = [(1024, 0, 155.0, True), (1024, 0, 157.0, True), (1024, 512, 90.0, True), (1024, 768, 50.0, False), (2048, 512, 200.0, True)]
    got = {(r[0], r[1]): r for r in experiments.prefix_summary(spark.createDataFrame(rows, "total_tokens int, intended_cached_tokens int, ttft_ms double, valid_hit boolean")).collect()}
    assert set(got) == {(1024, 0), (1024, 512), (2048, 512)}
    assert got[1024, 512]["saved_vs_cold_ms"] == 66.0 and got[2048, 512]["saved_vs_cold_ms"] is None
    assert got[1024, 0]["median_ttft_ms"] == 156.0 and got[1024, 512]["cached_fraction"] == 0.5


def test_comma_and_units(spark):
    df = spark.createDataFrame([("1, 2",), ("1,x",), ("",)], "t string").select(text.comma_numbers(F.col("t")).alias("x"))
    assert [r[0] for r in df.collect()] == [[1.0, 2.0], None, None]
    assert one(spark.range(1).select(experiments.floor_to_unit(F.lit(1000), F.lit(0.5), F.lit(16))))[0] == 496
    assert one(spark.range(1).select(timing.transmission_ms(F.lit(100_000), F.lit(5.0)), timing.shaped_wait_ms(F.lit(10), F.lit(0.0), F.lit(9.0), F.lit(0.0))))[:] == (160.0, 0.0)


def test_link_ewma_streams_each_user(spark, tmp_path, capsys):
    """No array of a whole user is built, and ties, missing users and missing values count as in a fold."""
    from skein.plans import catalogue

    rows = [(i, (None, 1, 2)[i % 3], i // 7, None if i % 11 == 0 else float(i * 37 % 101)) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, t int, value double")
    events.selectExpr("event_id", "user_id", "CAST(timestamp_seconds(t) AS TIMESTAMP_NTZ) AS ts", "value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    df = catalogue.link_ewma(spark, str(tmp_path))
    df.explain()
    assert "collect_list" not in capsys.readouterr().out
    got = {r["user_id"]: tuple(r)[1:] for r in df.collect()}
    for user in (None, 1, 2):
        rtt, jitter, n = None, None, 0
        for _, u, _, x in rows:
            if u == user and x is not None:
                rtt, jitter = (x, 0.0) if rtt is None else (rtt + 0.2 * (x - rtt), jitter + 0.2 * (abs(x - rtt) - jitter))
                n += 1
        assert got[user] == pytest.approx((rtt, jitter, n))
    assert len(got) == 3


def test_label_escapes(spark):
    """Escapes are read once, from left to right."""
    cases = [(r'path="C:\\new"', "C:\\new"), (r'path="a\nb"', "a\nb"), (r'path="\\\n"', "\\\n"), (r'path="a\tb\u00e9"', "a\tb\u00e9"), (r'path="say \"x\", y"', 'say "x", y'), (r'path="\x41"', "A"), ('path="plain"', "plain"), ('path=""', "")]
    df = spark.createDataFrame([(f'm{{{raw},k="1"}} 2',) for raw, _ in cases], "v string").select(text.metric(F.col("v")).alias("m"))
    for r, (raw, want) in zip(df.collect(), cases):
        assert r["m"]["labels"] == {"path": want, "k": "1"} and r["m"]["value"] == 2.0, raw


def test_metric_lines(spark):
    cases = {
        "a 1": ("a", 1.0), "a{} 1": ("a", 1.0), '  a{b="}"} 1e3 123 ': ("a", 1000.0), "a 1 12x": None, "a": None, "": None, "# a 1": None, "a{b 1": None, "a 1 2 3": None,
        "a NaN": ("a", "nan"), "a +Inf": ("a", float("inf")), "{x} 1": None, "a{x}1": None, 'a{b="x"}\t5': ("a", 5.0), "a x": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.metric(F.col("v")).alias("m"), text.metric(F.col("v"), strict=True).alias("s"))
    for r in df.collect():
        got = r["m"] and (r["m"]["name"], "nan" if r["m"]["value"] != r["m"]["value"] else r["m"]["value"])
        assert got == cases[r["v"]], r["v"]
        if r["v"].startswith("  a"):
            assert r["s"] is None
    assert one(df.where("v = 'a 1'"))["s"]["value"] == 1.0


def test_numbers_for_reports(spark):
    r = one(spark.sql("SELECT 3.0D a, 2.5D b, -1.0D c").select(text.integral(F.col("a")), text.integral(F.col("b")), text.integral(F.col("c"))))
    assert tuple(r) == ("3", "2.5", "-1")
    assert tuple(one(text.rounded(spark.sql("SELECT 1.2345D a, 2.5D b"), 2, "a"))) == (1.23, 2.5)
    assert one(spark.range(1).select(text.gib(F.lit(3 * 1024**3)), timing.kv_bytes_per_token(F.lit(2), F.lit(4), F.lit(8), F.lit(2))))[:] == (3.0, 256)


def test_headers_of_one_hop(spark):
    h = F.create_map(*[F.lit(x) for kv in {"Host": "h", "X-A": "1", "TE": "t", "Content-Encoding": "gzip"}.items() for x in kv])
    r = one(spark.range(1).select(text.forwarded(h), text.returned(h)))
    assert r[0] == {"x-a": "1", "content-encoding": "gzip"} and set(r[1]) == {"host", "x-a", "te"}


def test_names_that_clash_and_null_keys(spark):
    """Columns named like results are replaced; rows without a key are one key, also where keys are numbers."""
    df = spark.createDataFrame([(None, 1.0, 10.0, 9.0), (None, 2.0, 20.0, 9.0), (3, 1.0, 7.0, 9.0)], "key int, ts double, x double, rtt_ewma double")
    got = windows.running_ewma(df, "key", "ts", "x")
    assert got.columns.count("rtt_ewma") == 1
    assert sorted((r["n_samples"], r["rtt_ewma"]) for r in got.collect()) == [(1, 7.0), (1, 10.0), (2, 12.0)]
    recs = spark.createDataFrame([(1, 5.0, "x", 1.0)], "id int, ts double, sample string, age_s double")
    r = one(windows.latest_sample(recs, spark.createDataFrame([(4.0, 2.0)], "ts double, v double"), "ts", "v"))
    assert (r["sample"], r["age_s"]) == (2.0, 1.0)
    samples = spark.createDataFrame([(200, "cloud", 1.0), (200, "cloud", None), (500, "cloud", 1.0), (200, "local", 1.0)], "s int, p string, t double")
    assert [r[0] for r in samples.select(experiments.link_valid(F.col("s"), F.col("p"), F.col("t"))).collect()] == [True, False, False, False]


def test_quantiles_match_numpy(spark):
    """Interpolated and nearest ranks of groups of every kind, negative, repeated, null and infinite values, and null keys."""
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(g, h, None if rng.random() < 0.1 else f(rng)) for g, h, f in (
        ("a", 1, lambda r: r.gauss(0, 100)), ("a", None, lambda r: float(r.randrange(4))), (None, 1, lambda r: 1e9 + r.random()), (None, None, lambda r: -(2.0 ** r.randrange(-30, 30))), ("z", 0, lambda r: 0.0)
    ) for _ in range(rng.randrange(1, 400))] + [("empty", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    qs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    groups = {}
    for g, h, v in rows:
        groups.setdefault((g, h), []).extend([] if v is None else [v])
    linear = {(r["g"], r["h"]): r for r in stats.quantiles(df, ["g", "h"], {n: ("v", q) for n, q in qs.items()}).collect()}
    nearest = {(r["g"], r["h"]): r for r in stats.nearest_rank(df, ["g", "h"], "v", qs).collect()}
    assert set(linear) == set(nearest) == set(groups)
    for k, x in groups.items():
        x.sort()
        for n, q in qs.items():
            assert nearest[k][n] == (x[min(int(q * len(x)), len(x) - 1)] if x else 0.0)
            assert linear[k][n] is None if not x else linear[k][n] == pytest.approx(float(np.quantile(x, q)), rel=1e-12)
    whole = sorted(v for *_, v in rows if v is not None)
    assert one(stats.quantiles(df, [], {"m": ("v", 0.5)}))["m"] == pytest.approx(float(np.median(whole)))


def test_percentiles_with_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", inf), ("a", 1.0), ("a", -inf), ("b", inf), ("b", inf), ("c", None), ("d", nan), ("d", 3.0), ("d", 2.0), ("e", -inf), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in stats.quantiles(df, ["k"], {"m": ("v", 0.5)}).collect()}
    assert got == {"a": 1.0, "b": inf, "c": None, "d": 3.0, "e": -inf, None: 4.0}
    top = {r["k"]: r["t"] for r in stats.nearest_rank(df, ["k"], "v", {"t": 0.99}).collect()}
    assert (top["a"], top["c"], top["e"]) == (inf, 0.0, -inf) and top["d"] != top["d"]


def test_comma_numbers_refuse_negative(spark):
    df = spark.createDataFrame([("1,2",), ("1,-2",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.comma_numbers(F.col("t"))).collect()] == [[1.0, 2.0], None, None, None, None]
