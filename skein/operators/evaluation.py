"""What a replay is judged by: equal actions, divergence, similarity, frontiers, fitted curves and concurrency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.stats import grouped_alike
from skein.operators.prefixes import canonical
from skein.operators.scans import last_before, running_least, running_sums
from skein.tables import in_ranges


def normal_text(text: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def same_action(a: Column, b: Column) -> Column:
    """Whether two actions (variants) do the same: texts after normalising, all else in canonical form; null equals null."""
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.concat(F.lit("text "), normal_text(v.cast("string")))).otherwise(canonical(v))
    return said(a).eqNullSafe(said(b))


def accuracy(turns: DataFrame, session: str, match: Column) -> DataFrame:
    """Matches and turns of each session, each turn judged on the recorded history before it."""
    return turns.groupBy(session).agg(F.count_if(match).alias("n_match"), F.count("*").alias("n_turns")).withColumn("accuracy", F.col("n_match") / F.col("n_turns"))


def horizons(turns: DataFrame, session: str, step: str, match: Column) -> DataFrame:
    """session, horizon and diverged: the step of a session's first mismatch, or its last step where none came (censored). A null match is a mismatch."""
    wrong = ~F.coalesce(match, F.lit(False))
    first = turns.groupBy(session).agg(F.min(F.when(wrong, F.col(step))).alias("_first"), F.max(step).alias("_last"))
    return first.select(session, F.coalesce("_first", "_last").alias("horizon"), F.col("_first").isNotNull().alias("diverged"))


def survival(horizon: DataFrame) -> DataFrame:
    """Product-limit estimate by step: at_risk, n_diverged, n_censored and the share of sessions still alike after it.

    A row for each step where a session ends; the table is as long as the longest
    session at most, whatever their number.
    """
    steps = horizon.where("horizon IS NOT NULL").groupBy(F.col("horizon").alias("step")).agg(F.count_if("diverged").alias("n_diverged"), F.count_if(~F.col("diverged")).alias("n_censored"))
    onwards = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    risk = steps.withColumn("at_risk", F.sum(F.col("n_diverged") + F.col("n_censored")).over(onwards))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    stay = 1 - F.col("n_diverged") / F.col("at_risk")
    none_left = F.max(F.col("n_diverged") == F.col("at_risk")).over(upto)
    alike = F.when(none_left, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(stay > 0, stay))).over(upto)))
    return risk.select("step", "at_risk", "n_diverged", "n_censored", alike.alias("survival"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where lengths differ, a component is null or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def aligned_similarity(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine of the vectors that two frames have under one key."""
    return left.select(key, F.col(vector).alias("_a")).join(right.select(key, F.col(vector).alias("_b")), key).select(key, cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def pareto(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The rows that no row of their group beats: none is as small in both and smaller in one. Rows without x or y are left out; equal ones stay together.

    Only the least y of each x can stay; read by x, such a row stays if it is
    below all before it. That least is carried from range to range.
    """
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = some.groupBy(group, x).agg(F.min(y).alias("_y"))
    t = running_least(in_ranges(best, group, x), group, F.col("_y"), [x], "_least")
    front = t.where("_least IS NULL OR _y < _least").select(group, x, F.col("_y").alias(y))
    return grouped_alike(some, front, [group, x, y])


def fitted(df: DataFrame, group: str, x: str, y: str, train: Column) -> DataFrame:
    """A line fitted to each group's training rows, and its error on the others: slope, intercept, r2, n_train, n_holdout, holdout_mae, holdout_rmse."""
    learnt = df.where(train).groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.when(F.col(x).isNotNull(), F.col(y))).alias("n_train"))
    held = df.where(~F.coalesce(train, F.lit(False)) & F.col(x).isNotNull() & F.col(y).isNotNull())
    # Keys under a name of their own: both frames come from one.
    lines = learnt.select(F.col(group).alias("_g"), "slope", "intercept")
    off = held.join(lines, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_e", F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))
    error = off.groupBy("_g").agg(F.count("*").alias("n_holdout"), F.avg(F.abs("_e")).alias("holdout_mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("holdout_rmse"))
    both = learnt.join(error, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    return both.withColumn("n_holdout", F.coalesce("n_holdout", F.lit(0)))


def fitted_in_two(df: DataFrame, group: str, x: str, y: str, train: Column) -> DataFrame:
    """Two lines with the break that leaves the least squared error on the training rows: break_x (the last x of the first line), sse_one and sse_two.

    Rows are summed by x once; the sums of every first and second part are running sums over the distinct x of a group.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    parts = {"n": F.lit(1.0), "sx": a, "sy": b, "sxx": a * a, "sxy": a * b, "syy": b * b}
    by_x = df.where(train & a.isNotNull() & b.isNotNull()).groupBy(F.col(group), a.alias("_x")).agg(*[F.sum(v).alias(n) for n, v in parts.items()])
    all_, upto = Window.partitionBy(group), Window.partitionBy(group).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    sums = by_x.select(group, "_x", *[F.sum(n).over(all_).alias(f"all_{n}") for n in parts], *[F.sum(n).over(upto).alias(f"low_{n}") for n in parts])
    high = sums.withColumns({f"high_{n}": F.col(f"all_{n}") - F.col(f"low_{n}") for n in parts})

    def sse(p: str) -> Column:
        c = lambda n: F.col(f"{p}_{n}")
        sxx, sxy, syy = c("sxx") - c("sx") * c("sx") / c("n"), c("sxy") - c("sx") * c("sy") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
        return F.when(c("n") <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), syy - F.when(sxx > 1e-9 * c("sxx"), sxy * sxy / sxx).otherwise(F.lit(0.0))))

    scored = high.select(group, "_x", sse("all").alias("sse_one"), (sse("low") + sse("high")).alias("_two"))
    return scored.groupBy(group).agg(F.min_by("_x", F.struct("_two", "_x")).alias("break_x"), F.first("sse_one").alias("sse_one"), F.min("_two").alias("sse_two"))


def in_flight(calls: DataFrame, call: str, start: str, end: str) -> DataFrame:
    """A row for each start and end of a call: time, change, and how many calls are under way after it.

    Calls without both times, or that end before they start, are left out. At one
    time ends come before starts; a call that takes no time starts and ends there.
    """
    some = calls.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    empty = F.col(end) == F.col(start)
    # A call of no time: its end comes after its own start.
    begins = F.struct(F.col(start).alias("time"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("change"))
    ends = F.struct(F.col(end).alias("time"), F.when(empty, 2).otherwise(0).alias("kind"), F.lit(-1).cast("long").alias("change"))
    points = some.select(call, F.explode(F.array(begins, ends)).alias("p")).select(call, "p.*").withColumn("_all", F.lit(0))
    t = in_ranges(points, "time", "kind", call)
    return running_sums(t, "_all", {"level": F.col("change")}, ["time", "kind", call]).select(call, "time", "kind", "change", "level")


def throughput(points: DataFrame, call: str) -> DataFrame:
    """By level of concurrency: seconds at it, calls that ended while at it, and calls a second."""
    t = in_ranges(points.withColumn("_all", F.lit(0)), "time", "kind", call)
    before = last_before(t, "_all", F.struct("time", "level"), ["time", "kind", call], "_before").where("_before IS NOT NULL")
    spans = before.select(F.col("_before.level").alias("level"), (F.col("time") - F.col("_before.time")).alias("span"), (F.col("change") < 0).alias("ended"))
    by_level = spans.groupBy("level").agg(F.sum("span").alias("seconds"), F.count_if("ended").alias("n_ended"))
    return by_level.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("n_ended") / F.col("seconds")))


def knee(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The point of a curve that lies farthest above the line from its first to its last point: where more x stops paying. Ties go to the smaller x.

    A row for each point, with its bend; the curve has a point a level, so it is small.
    """
    some = curve.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = some.agg(F.min_by(y, x).alias("_y0"), F.max_by(y, x).alias("_y1"), F.min(x).alias("_x0"), F.max(x).alias("_x1"))
    along = (F.col(x) - F.col("_x0")) / F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0))
    bend = F.coalesce(F.col(y) - (F.col("_y0") + (F.col("_y1") - F.col("_y0")) * along), F.lit(0.0))
    both = some.join(F.broadcast(ends), how="inner").withColumn("bend", bend)  # one row
    first = Window.orderBy(F.desc("bend"), x)
    return both.withColumn("is_knee", F.row_number().over(first) == 1).select(*curve.columns, "bend", "is_knee")
