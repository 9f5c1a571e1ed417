"""Metric lines, labels, comma lists and safe numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A label as the exposition format writes it: a name, an equals sign, a quoted string.
_PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
#: What a letter after a backslash stands for; any other character stands for itself.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", '"': '"', "'": "'"}


def unescaped(value: Column) -> Column:
    """Backslash escapes decoded from left to right: doubled backslashes part the text, so none is read twice."""

    def code_points(text: Column, mark: str, digits: int) -> Column:
        """Hexadecimal code points behind a mark."""

        def piece(x: Column, i: Column) -> Column:
            hexa = F.left(x, F.lit(digits))
            char = F.decode(F.unhex(F.lpad(hexa, 4, "0")), "UTF-16BE")
            known = F.when(hexa.rlike(f"^[0-9a-fA-F]{{{digits}}}$"), F.concat(char, F.substring(x, digits + 1, 1 << 30)))
            return F.when(i == 0, x).otherwise(F.coalesce(known, F.concat(F.lit("\\" + mark), x)))

        return F.array_join(F.transform(F.split(text, F.lit("\\\\" + mark)), piece), "")

    def decoded(text: Column) -> Column:
        for letter, meant in _ESCAPES.items():
            text = F.replace(text, F.lit("\\" + letter), F.lit(meant))
        return code_points(code_points(text, "u", 4), "x", 2)

    many = F.array_join(F.transform(F.split(value, r"\\\\"), decoded), "\\")
    return F.when(F.contains(value, F.lit("\\")), many).otherwise(value)


def labels(raw: Column) -> Column:
    """name="value" pairs as a map, escapes decoded."""
    return F.map_from_arrays(F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(1)), F.transform(F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(2)), unescaped))


def metric(line: Column, strict: bool = False) -> Column:
    """(name, labels, value) of a metric line; null for comments, blanks and lines without a number.

    A line is a name, perhaps labels in braces, a value, and perhaps a time of
    whole milliseconds. The strict form has no time and no brace within labels.
    """
    blank = F.lit(" \t\r")

    def parts(x: Column) -> Column:
        """Name, labels and the rest."""
        open_at, close_at = F.instr(x, "{"), F.length(x) - F.instr(F.reverse(x), "}") + 1
        braced = (open_at > 1) & (close_at > open_at) & F.contains(x, F.lit("}")) & ~F.substring_index(x, "{", 1).rlike(r"\s")
        bare = F.split(x, r"\s", 2)
        rest = F.concat(F.lit(" "), F.try_element_at(bare, F.lit(2)))
        names = ("name", "inner", "tail")
        with_labels = (F.substring_index(x, "{", 1), F.substring(x, open_at + 1, close_at - open_at - 1), F.substring(x, close_at + 1, F.length(x)))
        made = [F.struct(*[v.alias(n) for n, v in zip(names, values)]) for values in (with_labels, (bare[0], F.lit(""), rest))]
        return F.when(braced, made[0]).otherwise(made[1])

    def checked(p: Column) -> Column:
        return _let(F.split(F.btrim(p["tail"], blank), r"\s+"), lambda words: valued(p, words))

    def valued(p: Column, words: Column) -> Column:
        timed = F.lit(False) if strict else (F.size(words) == 2) & words[1].rlike("^[0-9]+$")
        fits = p["tail"].rlike(r"^\s") & ((F.size(words) == 1) | timed) & (p["name"] != "") & ~F.contains(p["name"], F.lit("{"))
        if strict:
            fits = fits & ~F.contains(p["inner"], F.lit("}"))
        value = words[0].try_cast("double")
        return F.when(fits & value.isNotNull(), F.struct(p["name"].alias("name"), labels(p["inner"]).alias("labels"), value.alias("value")))

    return _let(F.btrim(line, blank), lambda x: F.when(~x.startswith("#"), _let(parts(x), checked)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def integral(x: Column) -> Column:
    """A number as text, without a fraction where it has none."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """The named columns rounded for a report, half to even."""
    return df.withColumns({c: F.bround(F.col(c), places) for c in columns})


def settled(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """The named columns rounded up from 0.49863 units: exact halves lie clear of that edge.

    So results that differ by rounding errors alone are rounded alike.
    """
    unit = 10.0**places
    return df.withColumns({c: F.floor(F.col(c) * unit + F.lit(0.50137)) / unit for c in columns})


def safe_int(x: Column) -> Column:
    """An integer, or null for null, "None" and anything that is none."""
    return F.nullif(x, F.lit("None")).try_cast("bigint")


def first_positive(*xs: Column) -> Column:
    """The first that is a positive integer."""
    return F.coalesce(*[F.when(x.try_cast("bigint") > 0, x.try_cast("bigint")) for x in xs])


def comma_numbers(text: Column, kind: str = "double") -> Column:
    """Numbers of a comma list; null where one is no number or negative, or the list is empty."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast(kind))
    return F.when((F.size(parts) > 0) & ~F.exists(numbers, lambda n: n.isNull() | (n < 0)), numbers)


def all_distinct(numbers: Column) -> Column:
    return F.size(numbers) == F.size(F.array_distinct(numbers))


def gib(n: Column) -> Column:
    return F.round(n / F.lit(1024.0**3), 3)


def redact(headers: Column, secret: list[str]) -> Column:
    """Headers with lower-case names, without the named ones."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.map_filter(low, lambda k, _: ~k.isin(secret))


#: Fixed names: credentials never stored, and headers that belong to one hop.
CREDENTIALS = ["authorization", "x-api-key", "proxy-authorization", "cookie", "set-cookie"]
HOP_BY_HOP = ["host", "content-length", "connection", "keep-alive", "transfer-encoding", "upgrade", "te", "trailer", "accept-encoding", "proxy-authorization"]
RESPONSE_STRIP = ["content-length", "content-encoding", "transfer-encoding", "connection"]


def forwarded(headers: Column) -> Column:
    """Request headers that go on to the next hop: lower-case names, without those of one hop."""
    return redact(headers, HOP_BY_HOP)


def returned(headers: Column) -> Column:
    """Response headers that go back to the caller: without those that a changed body would belie."""
    return redact(headers, RESPONSE_STRIP)
