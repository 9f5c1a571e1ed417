"""Hard negatives for each anchor and positive, by blocked dense products.

Vectors are quantised to whole numbers once and written. Anchors go out in
blocks of a fixed number of bytes; for a block, every task multiplies it with
its candidates, chunk by chunk, as float64 matrices. Products and sums stay
below 2^53 and so are exact; where the components are too large for that, the
candidates are split into a high and a low part, whose products are exact.

Pass one keeps the best positives of each anchor; what a task keeps is bounded,
and the tops of tasks merge into the top of all. Pass two knows the positives'
scores, hence the window of negative scores of each, and keeps the best
negatives inside each window in the same way. A chunk is compared with the
worst that is kept before anything is sorted.

The work is the stated queries against all rows, in blocks: no pair leaves a
task but those it keeps.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; a null vec_id is no anchor, and comes last among ties;
rows of one vec_id are rows of their own, so a repeated anchor is answered once
for each of its rows, and its copies are others; vectors of unlike lengths are
padded with zeros; components are held within 2^60 / dims after quantising, root
of it, so that scores fit 64 bits; an anchor without positives, or a positive
without negatives in its window, gives no rows; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import Parts, materialize, read, release

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
SCALE = 256
#: Bytes of one block of anchors, as float64.
BLOCK_BYTES = 16 << 20
#: Bytes of the scores of one step: some anchors by some candidates.
STEP_BYTES = 16 << 20
#: A null id among ties.
LAST = np.iinfo(np.int64).max

TOP = "slot long, at long, vec_id long, score long"
NEGATIVE = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(rows: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label and whole components, as doubles, of the rows that take part."""
    x = F.col("x")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    some = some.where(F.col("label").isNotNull() & x.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return some.withColumn("x", F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v).cast("double")))


class Top:
    """The k best candidates of each of some slots: higher scores first, then smaller ids, then earlier places."""

    def __init__(self, slots: int, k: int, floor: np.ndarray) -> None:
        self.score = np.repeat(floor[:, None], k, 1)
        self.at = np.full((slots, k), -1, np.int64)
        self.id = np.full((slots, k), -LAST, np.int64)

    def worst(self, rows: slice) -> np.ndarray:
        return self.score[rows, -1, None]

    def add(self, slot: np.ndarray, score: np.ndarray, at: np.ndarray, vec_id: np.ndarray) -> None:
        """Take in candidates whose scores reach the worst kept."""
        last, last_id = self.score[slot, -1], self.id[slot, -1]
        better = (score > last) | ((score == last) & ((vec_id < last_id) | ((vec_id == last_id) & (at < self.at[slot, -1]))))
        slot, score, at, vec_id = slot[better], score[better], at[better], vec_id[better]
        used = np.unique(slot)
        k = self.score.shape[1]
        all_slot = np.concatenate([np.repeat(used, k), slot])
        all_score = np.concatenate([self.score[used].ravel(), score])
        all_at = np.concatenate([self.at[used].ravel(), at])
        all_id = np.concatenate([self.id[used].ravel(), vec_id])
        order = np.lexsort((all_at, all_id, -all_score, all_slot))
        begin = np.searchsorted(all_slot[order], used)
        take = order[begin[:, None] + np.arange(k)]
        self.score[used], self.at[used], self.id[used] = all_score[take], all_at[take], all_id[take]

    def batch(self, base: np.ndarray) -> pa.RecordBatch:
        slot, k = np.nonzero(self.at >= 0)
        ids = self.id[slot, k]
        columns = [pa.array(base[slot]), pa.array(self.at[slot, k]), pa.array(ids, mask=ids == LAST), pa.array(self.score[slot, k])]
        return pa.RecordBatch.from_arrays(columns, ["slot", "at", "vec_id", "score"])


def products(anchors: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as 64-bit integers."""
    if exact:
        return (anchors @ x.T).astype(np.int64)
    high = np.floor(x / 16384.0)
    return (anchors @ high.T).astype(np.int64) * 16384 + (anchors @ (x - high * 16384.0).T).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = column.value_lengths().to_numpy()
    if (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < n[:, None]] = flat
    return out


def _search(block, same: bool, k: int, dims: int, exact: bool):
    """Tops of a task. block: broadcast (place, label, matrix, slots) of the anchors; slots: of each anchor, (slot, low, high) arrays by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, label, matrix, windows = block.value
        tops = [Top(len(slot), k, low - 1) for slot, low, _ in windows]
        step, seen = 64, False
        for batch in batches:
            at, ids, labels = (batch.column(i) for i in range(3))
            at, labels = at.to_numpy(), labels.to_numpy()
            ids = ids.fill_null(LAST).to_numpy()
            x = _matrix(batch.column(3), dims)
            begin = 0
            while begin < len(x):
                # The first steps are small: they raise the worst score kept before many candidates are compared.
                part = slice(begin, begin + step)
                begin, seen = begin + step, True
                wide = max(1, STEP_BYTES // (8 * step))
                for a in range(0, len(matrix), wide):
                    rows = slice(a, a + wide)
                    like = label[rows, None] == labels[None, part]
                    fits = (like & (place[rows, None] != at[None, part])) if same else ~like
                    score = products(matrix[rows], x[part], exact)
                    for top, (_, _, high) in zip(tops, windows):
                        r, c = np.nonzero(fits & (score >= top.worst(rows)) & (score <= high[rows, None]))
                        if len(r):
                            top.add(r + a, score[r, c], at[part][c], ids[part][c])
                step = min(1024, 2 * step)
        if seen:
            for top, (slot, _, _) in zip(tops, windows):
                yield top.batch(slot)

    return run


def _merged(tops: DataFrame, k: int) -> DataFrame:
    """The best k of each slot over all tasks, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "at")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(score: list[int], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole negative score of each window: low * p <= 100 * n <= high * p."""
    return np.array([-(-low * p // 100) for p in score], np.int64), np.array([high * p // 100 for p in score], np.int64)


def mine(
    rows: DataFrame, anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The best negatives of each anchor and positive whose score lies within low to high percent of the positive's.

    anchor and label are expressions over the columns vec_id and label of rows;
    a row where anchor is true is an anchor.
    """
    spark = rows.sparkSession
    vectors = materialize(quantised(rows, label, scale, id_col, vector_col).withColumn("at", F.monotonically_increasing_id()), "vectors")
    dims, most = vectors.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    dims, most = max(1, dims or 1), most or 0.0
    hold = float(int((2**60 / dims) ** 0.5))
    exact = most * most * dims < 2**53
    x = F.col("x") if most <= hold else F.transform("x", lambda v: F.greatest(F.least(v, F.lit(hold)), F.lit(-hold)))
    candidates = vectors.select("at", "vec_id", "label", x.alias("x"))
    anchors = candidates.where(F.coalesce(anchor, F.lit(False)))
    blocks = -(-anchors.count() // max(1, BLOCK_BYTES // (8 * dims)))
    anchors = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(max(1, blocks)))), "anchors")
    out = Parts(spark, "negatives", NEGATIVE)
    for b in range(blocks):
        block = anchors.where(F.col("block") == b).toArrow()
        place, ids, labels = block["at"].to_numpy(), block["vec_id"].to_pylist(), block["label"].to_numpy()
        matrix, n = _matrix(block["x"].combine_chunks(), dims), len(block)
        everywhere = (np.arange(n), np.full(n, 1 - LAST), np.full(n, LAST))
        sent = spark.sparkContext.broadcast((place, labels, matrix, [everywhere]))
        best = _merged(candidates.mapInArrow(_search(sent, True, positives, dims, exact), TOP), positives).collect()  # a few rows for each anchor of the block
        # Window w holds the positives of rank w + 1; a slot of pass two is the positive's place in best.
        windows = []
        for w in range(positives):
            here = [i for i, r in enumerate(best) if r["rank"] == w + 1]
            slot, least, greatest = np.full(n, -1), np.full(n, LAST), np.full(n, -LAST)
            at = [best[i]["slot"] for i in here]
            slot[at] = here
            least[at], greatest[at] = _bounds([best[i]["score"] for i in here], low, high)
            windows.append((slot, least, greatest))
        sent = spark.sparkContext.broadcast((place, labels, matrix, windows))
        pairs = [(i, ids[r["slot"]], r["vec_id"], r["score"]) for i, r in enumerate(best)]
        pairs = spark.createDataFrame(pairs, "slot long, anchor_id long, positive_id long, positive_score long")
        found = _merged(candidates.mapInArrow(_search(sent, False, negatives, dims, exact), TOP), negatives)
        found = found.join(F.broadcast(pairs), "slot")  # at most a block's anchors times positives
        out.add(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        sent.unpersist()
    release(vectors, anchors)
    return out.read()


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(read(spark, sf_dir, "embeddings"), vec_id % ANCHOR_EVERY == 0, moved)


OP12_SQL = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) <= 10
"""
