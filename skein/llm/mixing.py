"""Mixing to target weights by iterative proportional fitting (raking).

1. Token counts are summed per cell (source, language, topic).
2. Raking scales the cells in turn until their sums meet the target shares of
   each source, of each language and of each topic.
3. The sample's size is a share of all tokens. A cell cannot give more than it
   has: what a full cell cannot give is spread over the others. Each document
   is drawn with its cell's probability, by a hash of its id, so that a rerun,
   or a rerun of a lost task, draws the same.

The cell table is grouped before anything else. While it stays within MAX_CELLS
rows, raking runs on it as arrays; a larger table is raked by grouped DataFrame
sums, one written table a round.

Defined cases: null sources and languages are groups of their own; a null or
blank text has no tokens, lies in its cell and is drawn with its probability;
a very long text counts whole; a target for a group without tokens is spread
over the rest, however large the cell table is; a null doc_id draws like any one
id; cells whose probabilities tie are drawn apart, each by the hashes of its
documents; an empty table gives an empty result; repeated rows are drawn alike;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SPACE, join_dim, materialize, read, release

DIMENSIONS = ("source", "lang", "topic")
MAX_CELLS = 200_000
SEED = 5


@dataclass
class Targets:
    """Shares per dimension; groups not named get their share of tokens to the power temper."""

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: float = 0.7
    sample: float = 0.6
    rounds: int = 40
    tolerance: float = 1e-6


def topic(text: Column) -> Column:
    """What kind of text it is, by the first that fits; a table with own topics can skip this."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.lower(t).rlike("licen[sc]e|copyright"), "legal")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(F.length(t) < 1200, "note")
        .otherwise("article")
    )


def tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")).cast("long")


def _goals(mass: np.ndarray, names: list[str], shares: dict[str, float], temper: float) -> np.ndarray:
    """Target shares of the groups of one dimension, summing to 1 over groups that have tokens."""
    own = np.where(mass > 0, np.power(np.maximum(mass, 1e-300), temper), 0.0)
    named = np.array([n in shares for n in names])
    goal = np.where(mass > 0, np.array([shares.get(n, 0.0) for n in names]), 0.0)  # a group without tokens uses up no share
    left = max(0.0, 1 - goal.sum())
    free = own * ~named
    goal = goal + (left * free / free.sum() if free.sum() else 0.0)
    return goal / goal.sum() if goal.sum() else goal


def rake(cells: list[tuple[str, ...]], mass: np.ndarray, targets: Targets, dims: tuple[str, ...] = DIMENSIONS) -> np.ndarray:
    """Raked shares of the cells: sums per dimension meet its goals."""
    w = mass / mass.sum() if mass.sum() else mass.astype(float)
    axes = []
    for d, dim in enumerate(dims):
        names, at = np.unique([c[d] for c in cells], return_inverse=True)
        own = np.bincount(at, w, len(names))
        axes.append((at, len(names), _goals(own, list(names), targets.shares.get(dim, {}), targets.temper)))
    for _ in range(targets.rounds):
        worst = 0.0
        for at, n, goal in axes:
            have = np.bincount(at, w, n)
            worst = max(worst, float(np.abs(have - goal).max(initial=0.0)))
            w = w * np.divide(goal, have, out=np.zeros(n), where=have > 0)[at]
        if worst < targets.tolerance:
            break
    return w / w.sum() if w.sum() else w


def rates(share: np.ndarray, mass: np.ndarray, sample: float) -> np.ndarray:
    """Inclusion probability per cell: sample * total tokens in these shares, no cell above 1."""
    goal = sample * mass.sum()
    full = np.zeros(len(mass), bool)
    p = np.zeros(len(mass))
    for _ in range(len(mass) + 1):
        rest = share[~full].sum()
        left = goal - mass[full].sum()
        p = np.where(full, 1.0, np.divide(share * left / rest if rest > 0 else share * 0, mass, out=np.zeros(len(mass)), where=mass > 0))
        over = (p > 1) & ~full
        if not over.any():
            break
        full |= over
    return np.clip(p, 0, 1)


def _rake_frame(cells: DataFrame, targets: Targets, dims: tuple[str, ...]) -> DataFrame:
    """rake() and rates() for a cell table too large for arrays: grouped sums, a written table a round.

    Goals are those of _goals(). A cell is full where its tokens are below the rate
    times its weight, so each round of capping is one aggregate; it ends when the
    rate stays.
    """
    total = cells.agg(F.sum("mass")).first()[0] or 1.0
    w = cells.withColumn("w", F.col("mass") / F.lit(total))
    goals = []
    for dim in dims:
        sums = w.groupBy(dim).agg(F.sum("w").alias("s"))
        given = F.lit(None).cast("double")
        for name, share in targets.shares.get(dim, {}).items():
            given = F.when(F.col(dim) == name, share).otherwise(given)
        own = materialize(sums.select(dim, given.alias("given"), F.when(given.isNull(), F.pow("s", F.lit(targets.temper))).otherwise(0.0).alias("free")), "goals")
        r = own.agg(F.sum("given"), F.sum("free")).first()
        left = max(0.0, 1 - (r[0] or 0.0)) / r[1] if r[1] else 0.0
        whole = (r[0] or 0.0) + left * (r[1] or 0.0)
        goal = (F.coalesce("given", F.lit(0.0)) + F.col("free") * left) / F.lit(whole or 1.0)
        w = w.join(own.select(dim, goal.alias(f"goal_{dim}")), dim)
        goals.append(own)
    w = materialize(w, "cells")
    release(*goals)
    for _ in range(targets.rounds):
        worst, before = 0.0, w
        for dim in dims:
            sums = w.groupBy(dim).agg(F.sum("w").alias("s"), F.first(f"goal_{dim}").alias("g"))
            worst = max(worst, sums.agg(F.max(F.abs(F.col("s") - F.col("g")))).first()[0] or 0.0)
            ratio = F.when(F.col("s") > 0, F.col("g") / F.col("s")).otherwise(0.0)
            w = w.join(sums.select(dim, ratio.alias("r")), dim).withColumn("w", F.col("w") * F.col("r")).drop("r")
        w = materialize(w, "cells")
        release(before)
        if worst < targets.tolerance:
            break
    share = w.agg(F.sum("w")).first()[0] or 1.0
    w = w.withColumn("w", F.col("w") / F.lit(share))
    goal, rate = targets.sample * total, 0.0
    while True:
        full = F.col("w") * F.lit(rate) > F.col("mass")
        r = w.agg(F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.sum(F.when(full, F.col("mass")).otherwise(0.0))).first()
        now = max(0.0, goal - (r[1] or 0.0)) / r[0] if r[0] else rate
        if now <= rate:
            break
        rate = now
    return w.select(*dims, F.col("w").alias("weight"), F.least(F.lit(1.0), F.col("w") * F.lit(rate) / F.col("mass")).alias("probability"))


def _with_cell(docs: DataFrame, topic_col: str | None, text_col: str) -> DataFrame:
    """Add the cell (null groups named so that no value is) and n_tokens."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    cell = {"_source": named("source"), "_lang": named("lang"), "_topic": named(topic_col) if topic_col else topic(F.col(text_col))}
    return docs.withColumns({**cell, "n_tokens": tokens(F.col(text_col))})


def cell_rates(rows: DataFrame, targets: Targets) -> tuple[DataFrame, int]:
    """Per cell of rows (cell, n_tokens) its raked weight and probability, and the number of cells."""
    own = [F.col(f"_{d}").alias(d) for d in DIMENSIONS]
    cells = materialize(rows.groupBy(*own).agg(F.sum("n_tokens").cast("double").alias("mass")), "cells")
    n = cells.count()
    if n <= MAX_CELLS:
        got = cells.orderBy(*DIMENSIONS).collect()  # at most MAX_CELLS rows
        names = [tuple(r[d] for d in DIMENSIONS) for r in got]
        mass = np.array([r["mass"] for r in got], float)
        share = rake(names, mass, targets) if got else mass
        p = rates(share, mass, targets.sample) if got else mass
        p = np.where(mass > 0, p, targets.sample)  # cells without tokens
        table = [(*c, float(s), float(x)) for c, s, x in zip(names, share, p)]
        dim = rows.sparkSession.createDataFrame(table, "source string, lang string, topic string, weight double, probability double")
    else:
        dim = _rake_frame(cells.where("mass > 0"), targets, DIMENSIONS).unionByName(
            cells.where("mass = 0").select(*DIMENSIONS, F.lit(0.0).alias("weight"), F.lit(targets.sample).alias("probability"))
        )
        dim = materialize(dim, "rates")
    return dim.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "weight", "probability"), n


def draw(rows: DataFrame, dim: DataFrame, n_cells: int) -> DataFrame:
    """Add weight, probability and selected to rows with doc_id and cell."""
    out = join_dim(rows, dim, [f"_{d}" for d in DIMENSIONS], "doc_id", n_cells)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return out.withColumn("selected", chance < F.col("probability"))


def mix(docs: DataFrame, targets: Targets | None = None, topic_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, cell, n_tokens, weight (raked share of the cell), probability and selected of every row."""
    source = docs.withColumn("doc_id", F.col(id_col).cast("long"))
    rows = _with_cell(source.select("doc_id", "source", "lang", text_col, *([topic_col] if topic_col else [])), topic_col, text_col)
    rows = materialize(rows.select("doc_id", *[f"_{d}" for d in DIMENSIONS], "n_tokens"), "cells_of_rows")
    out = draw(rows, *cell_rates(rows, targets or Targets()))
    back = lambda d: F.when(F.col(f"_{d}") != "\0", F.col(f"_{d}")).alias(d)
    return out.select("doc_id", *[back(d) for d in DIMENSIONS], "n_tokens", "weight", "probability", "selected")


def sample(docs: DataFrame, columns: list[str], targets: Targets | None = None) -> DataFrame:
    """The rows that mix() selects, with the named columns. Cells are found again where the texts lie, not shuffled."""
    rows = _with_cell(docs.select(*columns), None, "text")
    found = draw(rows, *cell_rates(rows.select(*[f"_{d}" for d in DIMENSIONS], "n_tokens"), targets or Targets()))
    return found.where("selected").select(*columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
