"""Best-fit packing of tokenised documents by exact complements.

1. Tokenising is one pass: a piece is a document's run of at most `capacity`
   ids. White-space parts of a text are tokenised apart and remembered, since
   no token of the vocabulary crosses white space.
2. The plan is made over the histogram of piece lengths, at most `capacity`
   numbers whatever the corpus. Each length is taken from long to short; an
   index of single, pair and triple length sums gives pieces that fill its gap
   exactly, as many times as all their counts allow. What no exact complement
   fills goes best-fit into the least gap that holds it, or a new sequence.
3. Pieces get a rank within their length. Ranks come from counts per (length,
   salt) and a row number inside each, so a length that a third of all pieces
   share is still dealt over many tasks. A rank falls in one run of the plan,
   which names its sequence and its offset.

Defined cases: a null or blank text is the closing id alone; a text longer
than the capacity is cut, however long, its last piece being whatever is left;
repeated rows are packed each, and which of them lies where (ties of length and
id) is not said; a null doc_id stays null and its pieces are packed like any; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import materialize, read

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Parts of texts in each of the two generations that a worker remembers.
REMEMBERED = 300_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PartTokenizer:
    """Ids of a text as little-endian 32-bit bytes, through the ids of its parts.

    New parts are encoded together as one text, each followed by a mark that is
    a token of its own; parts that hold the mark are encoded alone. ASCII
    punctuation after an ASCII letter or digit is a part of its own, since a
    token of the vocabulary never joins the two.
    """

    MARK = "\u2022"
    TAIL = b".,;:!?#$%&*|"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self._ids(self.MARK)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the generation before; what is used again moves on

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: list[bytes]) -> None:
        known, mark, between = self.known, self.MARK.encode(), f" {self.MARK} ".encode()
        alone = [p for p in new if mark in p]
        rest = [p for p in new if mark not in p] if alone else new
        for p in alone:
            known[p] = np.array(self._ids(p.decode()), "<u4").tobytes()
        for at in range(0, len(rest), 8192):
            chunk = rest[at : at + 8192]
            ids = np.array(self._ids((between.join(chunk) + between[:-1]).decode()), "<u4")
            ends = np.flatnonzero(ids == self.mark)
            raw, begin = ids.tobytes(), 0
            for p, end in zip(chunk, (4 * ends).tolist()):
                known[p] = raw[begin:end]
                begin = end + 4

    def learn(self, parts: set[bytes]) -> None:
        """Remember the ids of parts."""
        known, split, cores = self.known, [], set()
        again = parts & self.before.keys()
        known.update(zip(again, map(self.before.__getitem__, again)))
        for p in parts - again:
            if p[-1] not in self.TAIL:
                cores.add(p)
                continue
            core = p.rstrip(self.TAIL)
            if core and core[-1:].isalnum():  # bytes: ASCII only
                split.append((p, core, p[len(core) :]))
                cores.add(core)
                cores.add(p[len(core) :])
            else:
                cores.add(p)
        self._learn([c for c in cores if c not in known])
        for p, core, tail in split:
            known[p] = known[core] + known[tail]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known = self.known
        parts = [t.split() if t else [] for t in texts]
        self.learn(set().union(*parts).difference(known))
        return [b"".join(map(known.__getitem__, ps)) for ps in parts]


@functools.cache
def part_tokenizer(path: str) -> PartTokenizer:
    """One per Python worker, so that its memory outlives a task."""
    return PartTokenizer(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = part_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(b.column(0).to_pylist(), ids_of(b.column(1).cast(pa.binary()).to_pylist())):
                    ids += end
                    rows += [
                        (doc, k, s // 4, min(step, len(ids) - s) // 4, zlib.crc32(ids[s : s + step]))
                        for k, s in enumerate(range(0, len(ids), step))
                    ]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document, in ids of the vocabulary."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_pieces(path or vocabulary_path(), capacity), PIECES)


class Planner:
    """Patterns of lengths for a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.count[n] = c
        have = (self.count > 0).astype(np.int64)
        #: Sums that two lengths in stock may have; kept as an upper bound.
        self.pair_sums = np.convolve(have, have)[: capacity + 1] > 0
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def _pair(self, total: int, beside: int = 0) -> tuple[int, int] | None:
        """Two lengths in stock of that sum, longest first; beside is one already chosen."""
        c = self.count
        x = np.arange(total - 1, (total - 1) // 2, -1)
        y = total - x
        ok = (c[x] > 0) & (c[y] > 0) & ((x != y) | (c[x] > 1))
        if not ok.any():
            self.pair_sums[total] = False  # stock only shrinks, so it stays so
            return None
        if beside:
            ok &= c[x] >= 1 + (x == y) + (x == beside)
            ok &= c[y] >= 1 + (x == y) + (y == beside)
            if not ok.any():
                return None
        k = int(ok.argmax())
        return int(x[k]), int(y[k])

    def _exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock whose sum is the gap; fewest and longest first."""
        if self.count[gap] > 0:
            return (gap,)
        if self.pair_sums[gap] and (p := self._pair(gap)):
            return p
        z = np.arange(gap - 1, 0, -1)
        for one in z[(self.count[z] > 0) & self.pair_sums[gap - z]].tolist():
            if p := self._pair(gap - one, one):
                return (one, *p)
        return None

    def _take(self, lengths: tuple[int, ...]) -> int:
        """As many of this pattern as the stock allows."""
        n = min(int(self.count[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            self.count[x] -= n
        self.patterns.append((lengths, n))
        return n

    def plan(self) -> list[tuple[tuple[int, ...], int]]:
        cap, c = self.capacity, self.count
        if c[cap]:
            self._take((cap,))
        short: list[tuple[int, int]] = []
        for n in range(cap - 1, 0, -1):
            while c[n] > 0:
                c[n] -= 1
                found = self._exact(cap - n)
                c[n] += 1
                if not found:
                    break
                self._take((n, *found))
            if c[n] > 0:
                # No exact complement is left for it: a residual.
                short.append((n, int(c[n])))
                c[n] = 0
        self._best_fit(short)
        return self.patterns

    def _best_fit(self, residual: list[tuple[int, int]]) -> None:
        """Best-fit decreasing over counts; equal sequences are one entry."""
        cap = self.capacity
        bins: dict[int, dict[tuple[int, ...], int]] = {}

        def put(gap: int, lengths: tuple[int, ...], n: int) -> None:
            bins.setdefault(gap, {})
            bins[gap][lengths] = bins[gap].get(lengths, 0) + n

        for length, n in residual:
            while n:
                gap = min((g for g in bins if g >= length), default=None)
                if gap is None:
                    each = cap // length
                    if n >= each:
                        put(cap - each * length, (length,) * each, n // each)
                    if n % each:
                        put(cap - n % each * length, (length,) * (n % each), 1)
                    break
                lengths, have = bins[gap].popitem()
                if not bins[gap]:
                    del bins[gap]
                used = min(n, have)
                put(gap - length, (*lengths, length), used)
                if have > used:
                    put(gap, lengths, have - used)
                n -= used
        for same in bins.values():
            self.patterns += same.items()


def plan_runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past rank, first sequence, offset) of every slot of every pattern."""
    runs, used, base = [], {}, 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            at = used.get(x, 0)
            runs.append((x, at, at + n, base, offset))
            used[x] = at + n
            offset += x
        base += n
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a sequence and an offset. cut must be a written table (it is read three times)."""
    spark = cut.sparkSession
    n = cut.count()
    salts = max(256, n // 1_000_000)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = materialize(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = plan_runs(Planner(totals, capacity).plan())
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_row", F.row_number().over(inside)).join(starts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    plan = spark.createDataFrame(runs, "length long, _from long, _past long, _base long, offset long")
    # The plan grows with the capacity, not with the corpus.
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_past")))
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("_base") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset",
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents."""
    return pack(materialize(pieces(docs, capacity, path, id_col, text_col), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
