"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; policies are versioned masks over those bits, so
that a new policy, or an ablation of an old one, reads the ledger and never the
text again. Everything here is DataFrame functions; one document is one row and
nothing is shuffled.

Defined cases: a null text has no words and fails the length rule; a very long
text is measured whole; a measurement that ties with its rule's bound passes; a
null doc_id stays null; an empty table gives an empty ledger; repeated rows give
repeated rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SPACE, read, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    failed: Column | None = None

    @property
    def mask(self) -> int:
        return 1 << self.bit


def rules() -> list[Rule]:
    """The rules in bit order. Each is true where a document fails."""
    c = F.col
    return [
        Rule(0, "few_words", c("n_words") < 50),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule(2, "symbols", 100 * c("n_symbols") > 30 * c("n_words")),
        Rule(3, "repeated_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule(4, "word_length", (c("word_chars") > 20 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        Rule(5, "shouting", 100 * c("n_upper") > 60 * c("word_chars")),
    ]


#: By bit, as rules() has them.
RULE_NAMES = ["few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting"]
BASE_MASK = 0b000011
#: Policies by version: a document is kept if it fails no rule in the mask.
POLICIES = {"v1": 0b000011, "v2": 0b111111}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every measurement the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), words(F.col(text_col)).alias("_w"))
    # Windows are sorted with their places, so equal ones stand side by side.
    windows = F.expr(
        "sort_array(transform(slice(_w, 1, greatest(size(_w) - 2, 0)),"
        " (x, i) -> struct(concat(x, ' ', get(_w, i + 1), ' ', get(_w, i + 2)) AS w, i AS i)))"
    )
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(SPACE.replace("[", "[^")))
    two = one.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", UPPER, ""))).cast("long").alias("n_upper"),
        lines.alias("_l"), windows.alias("_s"),
    )
    places = F.expr(
        "sort_array(transform(filter(_s, (x, i) -> coalesce(get(_s, i + 1).w = x.w, false) OR coalesce(get(_s, i - 1).w = x.w, false)), x -> x.i))"
    )
    three = two.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper", F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), places.alias("_p"),
    )
    # The union of [p, p + 2]: each window adds the words after the one before it.
    covered = F.expr(
        "if(size(_p) = 0, 0L, aggregate(slice(_p, 2, greatest(size(_p) - 1, 0)),"
        " struct(get(_p, 0) AS prev, 3L AS total), (a, x) -> struct(x AS prev, a.total + least(3, x - a.prev) AS total), a -> a.total))"
    )
    return three.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_upper"
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus fail_bits, one bit per failed rule."""
    bits = F.lit(0)
    for r in rules():
        bits = bits.bitwiseOR(F.when(r.failed, r.mask).otherwise(0))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, mask: int) -> DataFrame:
    """Add kept by a policy mask; base failures are never kept."""
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(BASE_MASK) != 0).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(mask | BASE_MASK) == 0
    )


def ablations(led: DataFrame, mask: int) -> DataFrame:
    """ablations_of() one policy, given by its mask."""
    return ablations_of(led, {"": mask}).drop("policy")


def ablations_of(led: DataFrame, policies: dict[str, int]) -> DataFrame:
    """Per policy and rule of it: failures, documents it alone rejects, and documents and words kept without it.

    One grouped pass over the ledger for all policies: failures are first counted
    per distinct bit pattern (at most 2^rules), then the patterns are read per rule.
    """
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    asked = [F.struct(F.lit(p).alias("policy"), F.lit(mask).alias("mask"), F.lit(r.name).alias("rule"), F.lit(r.mask).alias("m")) for p, mask in policies.items() for r in rules() if r.mask & mask]
    per = patterns.select(F.explode(F.array(*asked)).alias("r"), "fail_bits", "n", "words")
    hit = F.col("fail_bits").bitwiseAND(F.col("r.m")) != 0
    left = F.col("fail_bits").bitwiseAND(F.bitwise_not(F.col("r.m")).bitwiseAND(F.col("r.mask")))
    return per.groupBy(F.col("r.policy").alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(hit & (left == 0), F.col("n"))), F.lit(0)).alias("only_by_it"),
        F.coalesce(F.sum(F.when(left == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        F.coalesce(F.sum(F.when(left == 0, F.col("words"))), F.lit(0)).alias("words_without"),
        F.bit_or("fail_bits").alias("seen_bits"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects, over all documents."""
    return ablations_of(ledger(read(spark, sf_dir, "documents")), POLICIES)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(read(spark, sf_dir, "documents")), POLICIES["v2"])
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


_W = r"'[^\x20\x09-\x0D]+'"
_LEDGER_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
p AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, range(0, 3) AS s(j) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN p USING (rid)),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
  + CASE WHEN 100 * n_upper > 60 * word_chars THEN 32 ELSE 0 END AS INTEGER) AS fail_bits FROM m)
"""
OP1_SQL = _LEDGER_SQL + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
ABLATIONS_SQL = (
    _LEDGER_SQL.rstrip()
    + """, a AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{p}', {mask}, '{name}', {1 << bit})" for p, mask in POLICIES.items() for bit, name in enumerate(RULE_NAMES) if mask >> bit & 1)
    + """) AS v(policy, mask, rule, m))
SELECT policy, rule, count(*) FILTER (WHERE fail_bits & m <> 0) AS failed, count(*) FILTER (WHERE fail_bits & mask = m) AS only_by_it, count(*) FILTER (WHERE fail_bits & mask & ~m = 0) AS kept_without,
  CAST(coalesce(sum(n_words) FILTER (WHERE fail_bits & mask & ~m = 0), 0) AS BIGINT) AS words_without, bit_or(fail_bits) AS seen_bits FROM b, a GROUP BY 1, 2
"""
)
