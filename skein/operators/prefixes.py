"""Prefix keys of prompts, and how much of a prompt was seen a short while ago.

A prompt is a row of content blocks: tools, system text, then messages. The key
of a block stands for everything up to it: equal keys mean equal prefixes,
whatever the order of keys in their JSON. It is a sum, by eight lanes of 32 bits,
of a digest of each block with its place, so keys of all places come from running
sums and a prompt may have any number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.scans import greater_before, last_before, numbered, running_sums
from skein.tables import in_ranges

LANES = 8
#: Where a provider may keep a prefix; no part of what it says.
_MARK = r'(?<!\\)"cache_control":(\{[^{}]*\}|null),?'


def canonical(value: Column) -> Column:
    """A variant as text that is equal for equal values: keys sorted at every depth, no spaces, escapes resolved, no trailing zeros.

    A number written with an exponent is told apart from the same written without.
    """
    return F.to_json(value)


def _said(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(canonical(value), _MARK, ""), r",\}", "}")


def _items(value: Column, path: str) -> Column:
    """An array's items; a text alone is one text block; else none."""
    many = F.try_variant_get(value, path, "array<variant>")
    one = F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.array(F.to_variant_object(F.struct(F.try_variant_get(value, path, "string").alias("text"), F.lit("text").alias("type")))))
    return F.coalesce(many, one, F.array().cast("array<variant>"))


def content_blocks(df: DataFrame, call: str, request: str) -> DataFrame:
    """call, place and block of each content block of a request: tools, system, and each message's content, with its role.

    Cache marks are left out. A request without blocks has no rows.
    """
    v = F.col(request)
    of = lambda kind, items: F.transform(items, lambda b: F.concat(F.lit(kind), _said(b)))
    turns = F.transform(_items(v, "$.messages"), lambda m: of("", _items(m, "$.content")))
    roles = F.transform(_items(v, "$.messages"), lambda m: F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("")))
    said = F.flatten(F.zip_with(roles, turns, lambda role, blocks: F.transform(blocks, lambda b: F.concat(F.lit("message "), role, F.lit(" "), b))))
    blocks = F.concat(of("tool ", _items(v, "$.tools")), of("system ", _items(v, "$.system")), said)
    return df.select(F.col(call), F.posexplode(blocks).alias("place", "block"))


def prefix_keys(blocks: DataFrame, call: str, place: str, block: str) -> DataFrame:
    """call, place and prefix_key of every block; a null block counts as an empty one.

    place numbers a call's blocks without gaps, so that equal prefixes have equal places.
    """
    digest = F.sha2(F.concat_ws(":", F.col(place).cast("string"), F.coalesce(F.col(block), F.lit(""))).cast("binary"), 256)
    lane = lambda i: F.conv(F.substring(F.col("_h"), 8 * i + 1, 8), 16, 10).cast("long")
    hashed = blocks.select(call, place, digest.alias("_h")).select(call, place, *[lane(i).alias(f"_h{i}") for i in range(LANES)])
    t = in_ranges(hashed, call, place)
    summed = running_sums(t, call, {f"_s{i}": F.col(f"_h{i}") for i in range(LANES)}, [place])
    word = lambda i: F.lpad(F.lower(F.hex(F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return summed.select(call, place, F.concat(*[word(i) for i in range(LANES)]).alias("prefix_key"))


def reuse_distances(accesses: DataFrame, key: str, *order: str) -> DataFrame:
    """Each access with its number at, and distance: how many other keys were used since the key's last use; null for a first use.

    order is a total order of the accesses. The distance is that of a least-recently-used
    list: an access hits a list of c keys exactly if its distance is below c. Of
    the accesses since the last use those are counted that are the first of
    their key there; the rest are those whose own last use is later than it.
    """
    placed = numbered(accesses, *order, out="at")
    last = last_before(in_ranges(placed, key, "at"), key, F.col("at"), ["at"], "_last").drop("_block")
    again = last.where("_last IS NOT NULL")
    n = (placed.agg(F.max("at")).first()[0] or 0) + 1
    inner = greater_before(again, "at", "_last", n, "_again")
    columns = [*accesses.columns, "at"]
    hit = inner.select(*columns, (F.col("at") - F.col("_last") - 1 - F.col("_again")).alias("distance"))
    return hit.unionByName(last.where("_last IS NULL").select(*columns, F.lit(None).cast("long").alias("distance")))


def resident_prefix(distances: DataFrame, call: str, place: str, capacity: int) -> DataFrame:
    """call, n_blocks and resident: how many blocks from its beginning a call finds among the capacity keys used last."""
    found = F.coalesce(F.col("distance") < capacity, F.lit(False))
    miss = F.min(F.when(~found, F.col(place)))  # the first one ends the prefix
    ends = distances.groupBy(call).agg(F.count("*").alias("n_blocks"), miss.alias("_miss"), F.min(place).alias("_from"))
    return ends.select(call, "n_blocks", F.coalesce((F.col("_miss") - F.col("_from")).cast("long"), F.col("n_blocks")).alias("resident"))
