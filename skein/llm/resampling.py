"""Importance resampling towards a target distribution, ranked through an exact histogram of integer scores.

1. Every feature (a run of 1 to max_n words) falls in one of n_buckets hash
   buckets. A document is kept as its array of buckets, so texts are read once.
2. Bucket counts of the corpus and of the target give a gain for each bucket, a
   fixed-point log ratio; the array of gains is one value of n_buckets numbers,
   and a document's weight is a sum over its array. A Gumbel term that depends
   on the id alone turns "draw without replacement by weight" into "take the
   highest scores".
3. The scores are integers. Their exact histogram is made by bin first, at most
   BINS rows, whose running sums from the top give each bin's rank offset and
   the bin where the draw ends; inside a bin its distinct scores are summed the
   same way. The last score that begins inside the draw is the cutoff. Only rows
   at or above it are put in order: row_number by doc_id within each score, plus
   the score's offset.

No task holds more than a bin's distinct scores (a 65,536th of the range of
scores) or one score's rows. The Gumbel term spreads even copies of one text, so
a score holds at most e^-1 / 1000 of such rows.

Defined cases: a null, blank or wordless text has no features, weight 0 and a
score of its id alone, and is never drawn (fewer than min_words words); texts
are read whole; a null doc_id is hashed as an empty id and comes after all
numbers among ties; repeated rows are ranked each, in any order; an empty table
gives no rows, an empty target gives gains of corpus counts alone; of equal
scores the smaller doc_id is drawn; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import materialize, read, release

N_BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Rows of the coarse histogram, whatever the scores.
BINS = 65_536
#: What lies between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def feature_words(text: Column) -> Column:
    """Runs of a-z, 0-9 and all beyond ASCII, A-Z lowered; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def features(words: Column, max_n: int) -> Column:
    """Runs of 1 to max_n consecutive words, joined by a space, repeats included."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.concat(words, *[runs(n) for n in range(2, max_n + 1)])


def bucketed(docs: DataFrame, id_col: str, text_col: str, max_n: int, n_buckets: int) -> DataFrame:
    """Each row's id, number of words, and the bucket of each of its features."""
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), feature_words(F.col(text_col)).alias("words"))
    bucket = lambda f: (F.crc32(f.cast("binary")) % n_buckets).cast("int")
    return words.select("doc_id", F.size("words").alias("n_words"), F.transform(features(F.col("words"), max_n), bucket).alias("buckets"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """One row: the gains of all buckets in their order, from two bucketed() tables. It has n_buckets numbers, whatever the corpus."""
    spark = corpus.sparkSession
    count = lambda df, n: df.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(n))
    every = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(corpus, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    in_order = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("b"), F.sum("s").cast("double").alias("S"), F.sum("t").cast("double").alias("T"))
    s, t = lambda b: b["s"].cast("double"), lambda b: b["t"].cast("double")
    ratio = lambda b: ((t(b) + 1) * (F.col("S") + n_buckets)) / ((s(b) + 1) * (F.col("T") + n_buckets))
    return in_order.select(F.transform("b", lambda b: F.floor(F.lit(1000.0) * F.log(ratio(b)))).alias("gains"))


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """The fixed-point Gumbel term of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def rank_by_score(scored: DataFrame, eligible: Column, m: int, low: int, high: int) -> DataFrame:
    """The m highest scores of a written table's eligible rows with their rank, ties to the smaller doc_id; other rows with a null rank.

    low and high bound the eligible scores.
    """
    width = max(1, -(-(high - low + 1) // BINS))
    binned = scored.where(eligible).withColumn("bin", F.floor((F.lit(high) - F.col("score")) / width).cast("int"))
    counted = materialize(binned.groupBy("bin", "score").agg(F.count("*").alias("n")), "histogram")
    down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(down), F.lit(0))).where(F.col("above") < m).select("bin", "above")
    inside = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.join(bins, "bin").withColumn("offset", F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where(F.col("offset") < m)
    offsets = materialize(offsets.select("score", "offset"), "offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    release(counted)
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    up = F.coalesce(eligible & (F.col("score") >= cutoff), F.lit(False))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    rank = F.row_number().over(order) + F.col("offset")
    top = scored.where(up).join(offsets, "score").withColumn("_rank", rank).withColumn("rank", F.when(F.col("_rank") <= m, F.col("_rank")))
    rest = scored.where(~up).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*rest.columns).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, max_n: int = 1, n_buckets: int = N_BUCKETS, min_words: int = MIN_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; those drawn, a percentage of the rows with min_words words, have a rank.

    target has a column text.
    """
    corpus = materialize(bucketed(docs, id_col, text_col, max_n, n_buckets), "buckets")
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text"))
    table = materialize(gains(corpus, bucketed(aim, "doc_id", "text", max_n, n_buckets), n_buckets), "gains")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(F.col("gains"), b))
    weighed = corpus.withColumn("gains", table.scalar()).select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    release(corpus, table)
    eligible = F.col("n_words") >= min_words
    n, low, high = scored.where(eligible).agg(F.count("*"), F.min("score"), F.max("score")).first()
    ranked = rank_by_score(scored, eligible, percent * n // 100, low or 0, high or 0)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# The CRC of a word is folded over its bytes with the table of the reflected polynomial 0xEDB88320.
OP11_SQL = r"""
WITH RECURSIVE poly(n, k, c) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS tab FROM poly WHERE k = 8),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
a AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, list_transform(range(0, strlen(word)), lambda i: CAST('0x' || substr(hex(word), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM (SELECT word FROM w UNION SELECT word FROM a)),
b AS (SELECT word, xor(list_reduce(bytes, lambda crc, x: xor(crc >> 8, tab[(xor(crc, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS s FROM w JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM a JOIN b USING (word) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM a) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
d AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || documents.doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
