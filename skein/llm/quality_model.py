"""Quality by hierarchical empirical Bayes: document evidence, host, path.

1. Document evidence is a log-odds from shape measurements of the text (share
   of symbols, capitals, repeated words, ...), each cut into bins whose weight
   is a smoothed log-likelihood ratio learned from labels.
2. Every document, labelled or not, gives its evidence to its site: grouped
   sums per host and per path within the host.
3. A host's rate is its own sum shrunk to the global rate; a path's rate is its
   own sum shrunk to its host. The strength of each shrinkage is estimated from
   the spread between the groups (method of moments), so sparse sites follow
   the level above and large ones follow themselves.
4. posterior = logit(path) - logit(global) + evidence, the site's part being
   limited to SITE_LIMIT, so that no site alone can reject a clean text.

The hosts here are `source`, the paths `lang` within it; both are parameters.

Defined cases: a null or blank text has the evidence of zero words; a very long
text is measured whole; null hosts and paths are groups of their own; a posterior
that ties with the threshold is kept; without labels the prior is 0.5 and every
weight 0, so all are kept; a null doc_id has no label; an empty table gives an
empty result; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import ROW_KEY, SPACE, bounded, join_dim, materialize, read, release, row_keys, without

#: Labelled rows that the bins are learned from, at most.
MAX_FIT_ROWS = 50_000
THRESHOLD = 0.5
SITE_LIMIT = 2.0
SMOOTHING = 2.0
#: Measurement -> upper bounds of its bins, in share or count.
BINS = {
    "symbols": (0.02, 0.1, 0.3, 0.7, 1.5),
    "capitals": (0.02, 0.08, 0.3, 0.6),
    "bangs": (0.01, 0.05, 0.3, 0.7),
    "repeats": (0.2, 0.4, 0.6, 0.8, 0.95),
    "length": (3, 10, 30, 100, 1000),
}


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add one bin number per measurement; the frame keeps its other columns."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    length = F.length(t)

    def less(chars: str) -> Column:
        return (length - F.length(F.translate(t, chars, ""))).cast("double")

    words = F.array_remove(F.split(t, SPACE + "+", -1), "")
    one = docs.withColumn("_w", words).withColumns(
        {"_symbols": less("#*$%&|<>"), "_capitals": less("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "_bangs": less("!"), "_chars": F.greatest(length, F.lit(1))}
    )
    n = F.greatest(F.size("_w"), F.lit(1))
    values = {
        "symbols": F.col("_symbols") / n,
        "capitals": F.col("_capitals") / F.col("_chars"),
        "bangs": F.col("_bangs") / n,
        "repeats": 1 - F.size(F.array_distinct("_w")) / n,
        "length": F.size("_w").cast("double"),
    }
    two = one.withColumns({f"_v_{name}": v for name, v in values.items()})
    out = {}
    for name, bounds in BINS.items():
        number = F.lit(len(bounds))
        for i in reversed(range(len(bounds))):
            number = F.when(F.col(f"_v_{name}") < bounds[i], i).otherwise(number)
        out[f"b_{name}"] = number
    return two.withColumns(out).drop("_w", "_symbols", "_capitals", "_bangs", "_chars", *[f"_v_{name}" for name in values])


def weights(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> tuple[float, dict[str, list[float]]]:
    """Global rate, and per measurement the log-likelihood ratio of each bin."""
    known = bounded(labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), max_rows)
    joined = measured.join(F.broadcast(known), "doc_id")
    names = list(BINS)
    # One row per combination of bins: the product of the bin counts is the bound.
    rows = joined.groupBy("quality", *[f"b_{n}" for n in names]).agg(F.count("*").alias("n")).collect()
    total = {0: 0, 1: 0}
    for r in rows:
        total[r["quality"]] += r["n"]
    out = {}
    for name in names:
        k = len(BINS[name]) + 1
        count = [[0.0] * k, [0.0] * k]
        for r in rows:
            count[r["quality"]][r[f"b_{name}"]] += r["n"]
        out[name] = [
            math.log((count[1][i] + SMOOTHING / k) / (total[1] + SMOOTHING)) - math.log((count[0][i] + SMOOTHING / k) / (total[0] + SMOOTHING))
            if total[0] and total[1] else 0.0
            for i in range(k)
        ]
    rate = (total[1] + 1) / (total[0] + total[1] + 2)
    return rate, out


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, k: str, n: str, prior: Column) -> float:
    """Prior observations of a beta whose spread matches the groups' (method of moments)."""
    mean = F.col(k) / F.col(n)
    r = groups.agg(
        F.sum(F.col(n) * (mean - prior) ** 2).alias("between"), F.sum(prior * (1 - prior)).alias("within"),
        F.sum(prior * (1 - prior) * F.col(n)).alias("most"), F.count("*").alias("groups"),
    ).first()
    if not r["groups"] or not r["most"]:
        return 10.0
    extra = (r["between"] - r["within"]) / r["most"]  # share of the variance that lies between groups
    return float(min(10_000.0, max(2.0, 1 / extra - 1))) if extra > 0 else 10_000.0


@dataclass
class SiteModel:
    """What is learned: bin weights, the global rate, and a row per (host, path) with its shrunk rates."""

    llr: dict[str, list[float]]
    rate: float
    base: float
    sites: DataFrame
    n_sites: int


def _evidence(llr: dict[str, list[float]]) -> Column:
    """Log-odds of the bins. Measurements overlap, so their ratios are added at a discount."""
    total = F.lit(0.0)
    for name, w in llr.items():
        total = total + F.element_at(F.array(*[F.lit(x) for x in w]), F.col(f"b_{name}") + 1)
    return 0.7 * total


def _site(host: str, path: str) -> Column:
    """One key for a host and path; null groups get a key that no value has."""
    return F.to_json(F.struct(F.col(host).alias("h"), F.col(path).alias("p")))


def fit(measured: DataFrame, labels: DataFrame) -> SiteModel:
    """Learn from measured rows (doc_id, host, path and bins), a written table."""
    rate, llr = weights(measured, labels)
    scored = measured.select("host", "path", _evidence(llr).alias("evidence"))
    own = 1 / (1 + F.exp(-(F.col("evidence") + math.log(rate / (1 - rate)))))
    paths = materialize(scored.groupBy("host", "path").agg(F.sum(own).alias("k"), F.count("*").cast("double").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"))
    top = paths.agg(F.sum("k"), F.sum("n")).first()
    base = min(max(top[0] / top[1], 1e-6), 1 - 1e-6) if top[1] else rate
    m = _strength(hosts, "hk", "hn", F.lit(base))
    hosts = hosts.withColumn("host_rate", (F.col("hk") + m * base) / (F.col("hn") + m))
    same = F.col("h.host").eqNullSafe(F.col("p.host"))
    nested = materialize(paths.alias("p").join(hosts.alias("h"), same).select("p.host", "p.path", "k", "n", "host_rate"), "nested")
    m = _strength(nested, "k", "n", F.col("host_rate"))
    path_rate = (F.col("k") + m * F.col("host_rate")) / (F.col("n") + m)
    sites = nested.select(_site("host", "path").alias("_site"), "host_rate", path_rate.alias("path_rate"))
    return SiteModel(llr, rate, base, sites, nested.count())


def apply(df: DataFrame, model: SiteModel) -> DataFrame:
    """Add evidence, host_rate, path_rate and posterior to rows with doc_id, host, path and bins."""
    keyed = df.withColumns({"evidence": _evidence(model.llr), "_site": _site("host", "path")})
    out = join_dim(keyed, model.sites, ["_site"], "doc_id", model.n_sites)
    prior = math.log(model.base / (1 - model.base))
    site = F.least(F.greatest(_logit(F.col("path_rate")) - prior, F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
    return out.withColumn("posterior", 1 / (1 + F.exp(-(prior + site + F.col("evidence"))))).drop("_site")


def classify(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, posterior and kept of every row."""
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path")
    )
    measured = materialize(measure(source).drop("text"), "measured")
    return apply(measured, fit(measured, labels)).select(
        "doc_id", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept")
    )


def keep(docs: DataFrame, labels: DataFrame, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The rows that classify() keeps, with the named columns. Texts are measured once, in a written table of their bins by place."""
    keyed = row_keys(docs.select(*columns))
    source = keyed.select("doc_id", "text", F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), *ROW_KEY)
    measured = materialize(measure(source).drop("text"), "measured")
    judged = apply(measured, fit(measured, labels))
    gone = materialize(judged.where(F.coalesce(F.col("posterior") < threshold, F.lit(True))).select(*ROW_KEY), "rejected")
    release(measured)
    return without(keyed, gone).select(*columns)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
