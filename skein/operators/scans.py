"""Running values over ordered rows of keys of any size, as prefix scans.

Rows are dealt in balanced ranges of (key, order), so a frequent key spans many
ranges. A running value is worked out inside each range, and what a key brings
along from earlier ranges is a carry. Only the first key of a range can have begun
before it, so there is one carry a range, which is little enough to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skein.tables import BLOCK, cut, in_ranges

#: Powers of the decay stay within ten to this.
EXPONENT = 100
#: Rows of one step at most.
LONGEST = 4096


def of_first_key(ends: DataFrame, key: str, *came: str | Column) -> DataFrame:
    """One row a range: its first key as _of, and what that key brings along; ends has a row for each key of a range.

    No other key of the range began before it.
    """
    return ends.groupBy(BLOCK).agg(F.min_by(F.struct(F.col(key).alias("_of"), *came), F.struct(F.col(key).alias("key"))).alias("_first")).select(BLOCK, "_first.*")


def last_before(t: DataFrame, key: str, value: Column, order: Sequence[str], out: str) -> DataFrame:
    """The value of the key's row before each row of an in_ranges() table.

    value is never null.
    """
    here = Window.partitionBy(key, BLOCK).orderBy(*order)
    ends = t.groupBy(key, BLOCK).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carry = of_first_key(ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy(BLOCK))), key, "_carry")
    both = t.withColumn(out, F.lag(value).over(here)).join(F.broadcast(carry), BLOCK)
    return both.withColumn(out, F.coalesce(out, F.when(F.col(key).eqNullSafe(F.col("_of")), F.col("_carry")))).drop("_of", "_carry")


def composed(df: DataFrame, w: WindowSpec, steps: int) -> DataFrame:
    """Affine maps y -> _f * y + _o of ordered rows, each composed with all before it.

    By doubling: after step s a row holds the composition of 2^s rows.
    """
    for s in range(steps):
        f, o = F.coalesce(F.lag("_f", 1 << s).over(w), F.lit(1.0)), F.coalesce(F.lag("_o", 1 << s).over(w), F.lit(0.0))
        df = df.withColumns({"_f": F.col("_f") * f, "_o": F.col("_o") + F.col("_f") * o})
    return df


def decaying(t: DataFrame, key: str, order: Sequence[str], x: str, decay: float, size: tuple[int, int], out: str, first_as_start: bool, previous: str | None = None) -> DataFrame:
    """y = decay * y + (1 - decay) * x over the ordered rows of each key of an in_ranges() table; a null x leaves y.

    y starts with the key's first x, or with 0. It is null before a key's first
    x. size is what sizes() gives. previous names a column for y before the row.

    In a range a key's rows are taken in sections. Within one, y is decay^j times
    what it was before plus a sum of weighted x, so a section is one affine map.
    Sections compose to ranges, ranges to the carry of the next. The maps, one
    row for some thousand rows or a key of a range, are written once.
    """
    blocks, longest = size
    length = max(1, min(LONGEST, int(EXPONENT / -math.log10(decay))))
    steps = lambda n: max(0, n - 1).bit_length()
    here = Window.partitionBy("_unit").orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    r = F.lit(decay)
    rows = t.withColumn("_unit", F.struct(F.col(key).alias("key"), F.col(BLOCK).alias("block"))).withColumn("_c", F.count(x).over(so_far))
    rows = rows.withColumn("_section", F.floor(F.greatest(F.col("_c") - 1, F.lit(0)) / length).cast("int")).withColumn("_j", F.col("_c") - F.col("_section") * length)
    # Within a section the powers stay small.
    section = Window.partitionBy("_unit", "_section").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    weighted = F.coalesce(F.sum(F.col(x) / F.pow(r, F.col("_j"))).over(section), F.lit(0.0))
    rows = rows.withColumn("_local", (1 - r) * F.pow(r, F.col("_j")) * weighted)

    maps = rows.groupBy("_unit", "_section").agg(F.pow(r, F.max("_j")).alias("_f"), F.max_by("_local", "_j").alias("_o"), F.min_by(x, F.when(F.col(x).isNotNull(), F.col("_c"))).alias("_first"))
    maps = cut(composed(maps, Window.partitionBy("_unit").orderBy("_section"), steps(longest // length + 1)))
    # What comes before a section: only keys with several sections in a range have it.
    in_unit = Window.partitionBy("_unit").orderBy("_section")
    before = maps.select("_unit", "_section", F.lag("_f").over(in_unit).alias("_pf"), F.lag("_o").over(in_unit).alias("_po")).where("_pf IS NOT NULL")
    ends = maps.groupBy("_unit").agg(F.max_by(F.struct("_f", "_o"), "_section").alias("_m"), F.min_by("_first", "_section").alias("_first"))
    ends = composed(ends.select(F.col("_unit.key").alias("_of"), F.col("_unit.block").alias(BLOCK), "_m._f", "_m._o", "_first"), Window.partitionBy("_of").orderBy(BLOCK), steps(blocks))
    of_key = Window.partitionBy("_of").orderBy(BLOCK)
    first = F.first("_first", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    entering = F.lag("_f").over(of_key) * (first if first_as_start else F.lit(0.0)) + F.lag("_o").over(of_key)
    carry = of_first_key(ends.withColumn("_in", F.when(first.isNotNull(), entering)), "_of", "_in")

    own = F.first(x, ignorenulls=True).over(so_far) if first_as_start else F.when(F.col("_c") > 0, F.lit(0.0))
    both = rows.withColumn("_own", own).join(before, ["_unit", "_section"], "left").join(F.broadcast(carry), BLOCK)
    came = F.when(F.col(key).eqNullSafe(F.col("_of")), F.col("_in"))
    start = F.coalesce(came, F.col("_own"))
    y = F.pow(r, F.col("_j")) * F.coalesce(F.col("_pf") * start + F.col("_po"), start) + F.col("_local")
    both = both.withColumn(out, y)
    if previous:
        both = both.withColumn(previous, F.coalesce(F.lag(out).over(here), came))
    return both.select(*t.columns, out, *([previous] if previous else []))


def sizes(t: DataFrame) -> tuple[int, int]:
    """Ranges of an in_ranges() table, and the rows of the longest."""
    n = t.groupBy(BLOCK).agg(F.count("*").alias("n")).agg(F.max(BLOCK), F.max("n")).first()
    return (n[0] or 0) + 1, n[1] or 0


def running_total(t: DataFrame, value: Column, order: Sequence[str], out: str) -> DataFrame:
    """The sum of value over all rows up to each, in an in_ranges() table of one order; value is a whole number and never null.

    Rows that are equal in order are told apart in no particular way.
    """
    here = Window.partitionBy(BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = t.groupBy(BLOCK).agg(F.sum(value).alias("_end"))
    # One row a range.
    carry = ends.select(BLOCK, F.coalesce(F.sum("_end").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"))
    return t.withColumn(out, F.sum(value).over(here)).join(F.broadcast(carry), BLOCK).withColumn(out, F.col(out) + F.col("_carry")).drop("_carry")


def numbered(rows: DataFrame, *order: str | Column, out: str) -> DataFrame:
    """Rows with their place in a total order, from 0."""
    by = {f"_by{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    t = in_ranges(rows.withColumns(by), *by)
    return running_total(t, F.lit(1).cast("long"), list(by), out).withColumn(out, F.col(out) - 1).drop(BLOCK, *by)


def running_sums(t: DataFrame, key: str, sums: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """Sums over the key's rows up to each row of an in_ranges() table of (key, order); values are whole numbers, never null."""
    here = Window.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = t.groupBy(key, BLOCK).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = of_first_key(ends.select(BLOCK, key, F.struct(*[F.sum(n).over(before).alias(n) for n in sums]).alias("_c")), key, "_c")
    both = t.withColumns({n: F.sum(v).over(here) for n, v in sums.items()}).join(F.broadcast(carry), BLOCK)
    came = F.col(key).eqNullSafe(F.col("_of"))
    return both.withColumns({n: F.col(n) + F.coalesce(F.when(came, F.col("_c")[n]), F.lit(0)) for n in sums}).drop("_of", "_c")


#: Bits of one level of greater_before(): as many digits are counted side by side.
DIGIT_BITS = 4


def greater_before(rows: DataFrame, at: str, value: str, bound: int, out: str) -> DataFrame:
    """For each row, how many rows with a smaller at have a greater value.

    at is unique; value is a whole number in [0, bound) and never null. Numbers
    are compared digit by digit from the top: rows that agree above a digit are
    read in order of at, with running counts of their digits. A level is one
    range shuffle of the rows, and groups may be of any size.
    """
    levels = max(1, -(-max(1, bound - 1).bit_length() // DIGIT_BITS))
    top = (1 << DIGIT_BITS) - 1
    columns = rows.columns
    acc = rows.withColumn(out, F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        digit = F.shiftright(F.col(value), DIGIT_BITS * level).bitwiseAND(F.lit(top))
        grouped = acc.withColumns({"_g": F.shiftright(F.col(value), DIGIT_BITS * (level + 1)), "_d": digit.cast("int")})
        t = in_ranges(grouped, "_g", at)
        # _n{j}: rows so far whose digit is j or more; a row itself is not above its own digit.
        counted = running_sums(t, "_g", {f"_n{j}": (F.col("_d") >= j).cast("long") for j in range(1, top + 1)}, [at])
        above = F.get(F.array(*[F.col(f"_n{j}") for j in range(1, top + 1)], F.lit(0).cast("long")), F.col("_d"))
        acc = counted.select(*columns, (F.col(out) + above).alias(out))
    return acc


def running_least(t: DataFrame, key: str, value: Column, order: Sequence[str], out: str) -> DataFrame:
    """The least value of the key's rows strictly before each row of an in_ranges() table; null for a first row."""
    here = Window.partitionBy(key, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = t.groupBy(key, BLOCK).agg(F.min(value).alias("_end"))
    carry = of_first_key(ends.withColumn("_carry", F.min("_end").over(Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))), key, "_carry")
    both = t.withColumn(out, F.min(value).over(here)).join(F.broadcast(carry), BLOCK)
    mine = F.when(F.col(key).eqNullSafe(F.col("_of")), F.col("_carry"))
    return both.withColumn(out, F.least(out, mine)).drop("_of", "_carry")
