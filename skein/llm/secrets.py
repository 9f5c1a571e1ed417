"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its syntax tree come the trigrams that
every match must hold, as a Boolean query: all of a literal run's trigrams, one
branch of each alternation. The index holds, for the trigrams that some rule
asks for, the postings: sorted row numbers per trigram, in chunks of CHUNK rows,
so that no list grows with the table. A rule's query intersects the lists of
each alternative and unites the alternatives, chunk by chunk. The rows found are
its candidates and are verified with the regular expression itself; a rule
without a mandatory trigram scans every row.

Rows are numbered in one written copy of ids and texts, so ids may repeat or be
null. A short list of candidates is broadcast to the texts, a long one joined.
Index, queries and verification are DataFrame functions.

Defined cases: a null text is an empty text and has no spans; a very long text is
searched whole; repeated rows give repeated rows; overlapping spans of different
kinds all stay, at one start in the order of the rules; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import BROADCAST_ROWS, materialize, read

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans are matches whose group has at least so many characters."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


#: The first three are the base; their order is the order of kinds at one start.
RULES = (
    Rule("assign", _ASSIGN, 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 27),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
BASE = ("assign", "access", "hex")

#: Row numbers of one list of postings, at most.
CHUNK = 1 << 14

#: A query is a list of alternatives; an alternative is a set of trigrams that must all be there.
Query = list[frozenset[str]]


def _grams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


@dataclass(frozen=True)
class _Way:
    """One way to match: a whole literal (last is None), or what it begins and ends with and holds."""

    first: str = ""
    inner: frozenset[str] = frozenset()
    last: str | None = None

    def then(self, o: _Way) -> _Way:
        if self.last is None:
            return _Way(self.first + o.first, o.inner, o.last)
        if o.last is None:
            return _Way(self.first, self.inner, self.last + o.first)
        return _Way(self.first, self.inner | o.inner | _grams(self.last + o.first), o.last)

    def trigrams(self) -> frozenset[str]:
        return self.inner | _grams(self.first) | _grams(self.last or "")


_GAP = _Way(last="")


def trigram_query(regex: str, most: int = 64) -> Query:
    """Alternatives of mandatory lower-case trigrams; [set()] where there are none."""

    def walk(items: list) -> list[_Way]:
        ways = [_Way()]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                here = [_Way(chr(arg).lower())]
            elif name == "SUBPATTERN":
                here = walk(list(arg[3]))
            elif name == "BRANCH":
                here = [w for b in arg[1] for w in walk(list(b))]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and (arg[0], arg[1]) == (0, 1):
                here = [_Way(), *walk(list(arg[2]))]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                here = [w.then(_GAP) for w in walk(list(arg[2]))]
            else:
                here = [_GAP]
            ways = list(dict.fromkeys(x.then(y) for x in ways for y in here))
            if len(ways) > most:
                ways = [_GAP]
        return ways

    found = {w.trigrams() for w in walk(list(sre.parse(regex)))}
    return sorted((f for f in found if not any(o < f for o in found)), key=sorted)


class TrigramIndex:
    """Postings of the rules' trigrams, and the rules' queries over them."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.regex) for r in rules}
        self.trigrams = sorted({t for q in self.queries.values() for a in q for t in a})

    def scans_all(self, kind: str) -> bool:
        return any(not a for a in self.queries[kind])

    def postings(self, texts: DataFrame, row_col: str = "row", text_col: str = "text") -> DataFrame:
        """The index: chunk and its postings, a map of trigrams to sorted row numbers."""
        low, row = F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.col(row_col)
        held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in self.trigrams]))
        found = texts.select(row.alias("row"), low.alias("_low")).select("row", F.explode(held).alias("trigram"))
        lists = found.groupBy(F.floor(F.col("row") / CHUNK).alias("chunk"), "trigram").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        return lists.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("postings"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """row and rules: a bit for each rule whose query the row answers."""

        def rows(kind: str) -> Column:
            out = None
            for alternative in self.queries[kind]:
                own = None
                for t in sorted(alternative):
                    one = F.coalesce(F.try_element_at("postings", F.lit(t)), F.array().cast("array<bigint>"))
                    own = one if own is None else F.array_intersect(own, one)
                out = own if out is None else F.array_union(out, own)
            return out

        def marked(found: Column, bit: Column) -> Column:
            return F.transform(found, lambda r: F.struct(r.alias("row"), bit))

        asked = [(i, r.kind) for i, r in enumerate(self.rules) if not self.scans_all(r.kind)]
        if not asked:
            return postings.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("rules")).limit(0)
        each = F.concat(*[marked(rows(kind), F.lit(1 << i).cast("long").alias("bit")) for i, kind in asked])
        return postings.select(F.inline(each)).groupBy("row").agg(F.bit_or("bit").alias("rules"))


_PLACES = "array<struct<s:int,e:int,n:int>>"
_SPANS = "array<struct<s:int,k:int,kind:string,e:int>>"


def _spans(rule: Rule, number: int, text: Column) -> Column:
    """(start, kind number, kind, end) of every match of a rule, in code points.

    Matches and the gaps between them alternate, so running lengths give places.
    """
    regex = F.lit(rule.java)
    both = F.zip_with(
        F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(rule.group)),
        lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")),
    )
    steps = F.zip_with(F.split(text, regex, -1), both, lambda gap, x: F.struct(F.length(gap).alias("gap"), x["m"].alias("m"), x["g"].alias("g")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.coalesce(x["m"], F.lit(0))
        one = F.array(F.struct(start.alias("s"), end.alias("e"), x["g"].alias("n")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], one)).cast(_PLACES).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out"))
    places = F.filter(F.aggregate(steps, start, step, lambda a: a["out"]), lambda x: x["n"] >= rule.least)
    return F.transform(places, lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), F.lit(rule.kind).alias("kind"), x["e"].alias("e"))).cast(_SPANS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found: all spans (s, k, kind, e) of every row, by start and then kind."""
    index = TrigramIndex(rules)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = materialize(texts, "texts")
    found = materialize(index.candidates(materialize(index.postings(texts), "postings")), "candidates")
    few = found.count() <= 4 * BROADCAST_ROWS
    marked = texts.join(F.broadcast(found) if few else found, "row", "left")
    text = F.col("text")
    per = []
    for i, r in enumerate(rules):
        asked = F.lit(True) if index.scans_all(r.kind) else F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i).cast("long")) != 0
        per.append(F.when(asked & text.rlike(r.java), _spans(r, i, text)).otherwise(F.array().cast(_SPANS)))
    return marked.select("doc_id", F.sort_array(F.concat(*per)).alias("found"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["k"] < len(BASE))

    def number(i: int) -> Column:
        return F.size(F.filter("found", lambda x: x["k"] == i)).cast("long")

    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("found")).alias("spans"),
    )


def _op9_sql() -> str:
    """The same spans in DuckDB: running lengths of gaps and matches."""
    parts = []
    for k, r in enumerate(RULES):
        lit = "'" + r.java.replace("'", "''") + "'"
        parts.append(
            f"""SELECT rid, {k} AS k, '{r.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT rid, m, g, sum(length(gap)) OVER (PARTITION BY rid ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT rid, unnest(string_split_regex(t, {lit})) AS gap, unnest(regexp_extract_all(t, {lit}, 0)) AS m, unnest(regexp_extract_all(t, {lit}, {r.group})) AS g,
    unnest(range(0, len(string_split_regex(t, {lit})))) AS i FROM d WHERE regexp_matches(t, {lit})))
  WHERE length(g) >= {r.least}"""
        )
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(parts)}),
y AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
  string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
  string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, k) AS spans FROM x GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN y USING (rid)"""


OP9_SQL = _op9_sql()
