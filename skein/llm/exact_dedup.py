"""Exact duplicates through a cuckoo-filter index of live digests.

The index is dealt over buckets. A bucket holds a cuckoo filter (16-bit
fingerprints, four slots a cell) and the stored keys behind it: digest, length,
smallest doc_id and live count. An arriving digest is looked up in the filter.
A miss is certainly new and goes in. A hit may be a false positive, so it is
verified against the bucket's stored content key: the full 256-bit digest and
the byte length of the normalised text. The key stands for the content, since
an index of texts would be a second corpus; two texts with one SHA-256 are not
known to exist, and text_sha256 is what the result itself names. When an
insertion finds no free cell, the filter doubles and is filled again from the
stored keys. Deletion lowers the live count and clears the fingerprint when the
last copy goes; where the keeper of a group goes, the smallest of its live
members becomes the keeper, found by one grouped join for such groups alone.

A group holding a third of all rows reaches a bucket as one row per task: each
task combines its own copies first. Rows learn their group by a join on the
digest; the groups of very many rows are broadcast, so their rows stay where
they are.

Defined cases: a null text is an empty text, and empty texts are equal to each
other; a very long text is normalised and digested whole; a null doc_id never
beats a number, and is its own keeper only in a group without numbers; a row
repeated with the smallest doc_id is kept each time (ties); deleting what is not
live does nothing; an empty table gives an empty result; other columns are
ignored, but for those named in carry.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import ROW_KEY, SPACE, join_hot, materialize, read, release

SLOTS = 4
KICKS = 200
#: Stored keys that one bucket is planned for.
KEYS_PER_BUCKET = 1024
#: Distinct digests that a task combines before it passes them on.
COMBINE_KEYS = 100_000

KEY_SCHEMA = "bucket int, digest binary, n_bytes long, keep_id long, live long, hit boolean"
INDEX_SCHEMA = KEY_SCHEMA + ", n_cells int, cells binary"


class CuckooFilter:
    """Fingerprints of the live digests of one bucket."""

    def __init__(self, n_cells: int = 64, cells: bytes | None = None) -> None:
        self.n_cells = n_cells
        self.cells = list(memoryview(cells).cast("H")) if cells else [0] * (n_cells * SLOTS)

    def _place(self, digest: bytes) -> tuple[int, int]:
        word = int.from_bytes(digest[8:16], "little")
        return (word & 0xFFFF) or 1, (word >> 16) & (self.n_cells - 1)

    def _other(self, cell: int, fingerprint: int) -> int:
        return (cell ^ (fingerprint * 0x5BD1E995)) & (self.n_cells - 1)

    def _find(self, digest: bytes) -> int:
        f, i = self._place(digest)
        for cell in (i, self._other(i, f)):
            at = cell * SLOTS
            for k in range(at, at + SLOTS):
                if self.cells[k] == f:
                    return k
        return -1

    def __contains__(self, digest: bytes) -> bool:
        return self._find(digest) >= 0

    def insert(self, digest: bytes) -> bool:
        """False on overflow; the caller then rebuilds from the stored keys."""
        f, i = self._place(digest)
        for cell in (i, self._other(i, f)):
            at = cell * SLOTS
            for k in range(at, at + SLOTS):
                if not self.cells[k]:
                    self.cells[k] = f
                    return True
        for kick in range(KICKS):
            k = i * SLOTS + (f + kick) % SLOTS
            self.cells[k], f = f, self.cells[k]
            i = self._other(i, f)
            at = i * SLOTS
            for k in range(at, at + SLOTS):
                if not self.cells[k]:
                    self.cells[k] = f
                    return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Clear one fingerprint; only for a digest verified to be stored."""
        if (k := self._find(digest)) < 0:
            return False
        self.cells[k] = 0
        return True

    def to_bytes(self) -> bytes:
        import array

        return array.array("H", self.cells).tobytes()


class Bucket:
    """A filter and its stored keys: (digest, length) -> [keep_id, live, hit]."""

    def __init__(self, n_cells: int = 64, cells: bytes | None = None) -> None:
        self.filter = CuckooFilter(n_cells, cells)
        self.keys: dict[tuple[bytes, int], list] = {}
        self.resized = 0

    def insert(self, digest: bytes, n_bytes: int, keep_id: int | None, n: int) -> None:
        hit = digest in self.filter
        if hit and (own := self.keys.get((digest, n_bytes))):
            own[0] = keep_id if own[0] is None else own[0] if keep_id is None else min(own[0], keep_id)
            own[1] += n
            own[2] = True
            return
        self.keys[digest, n_bytes] = [keep_id, n, False]
        if not self.filter.insert(digest):
            self._grow()

    def delete(self, digest: bytes, n_bytes: int, n: int) -> None:
        if digest in self.filter and (own := self.keys.get((digest, n_bytes))):
            own[1] -= n
            if own[1] <= 0:
                del self.keys[digest, n_bytes]
                self.filter.delete(digest)

    def _grow(self) -> None:
        size = self.filter.n_cells
        while True:
            size *= 2
            self.resized += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(d) for d, _ in self.keys):
                return


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest of the normalised text, its length in bytes, and the carried columns."""
    norm: Column = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("_n"), *carry).select(
        "doc_id", F.unhex(F.sha2(F.col("_n").cast("binary"), 256)).alias("digest"), F.octet_length("_n").cast("long").alias("n_bytes"), *carry
    )


def bucket_count(n_rows: int) -> int:
    return max(1, -(-n_rows // KEYS_PER_BUCKET))


def _combine(buckets: int):
    """Copies within a task become one row, so that a hot group is sent once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = list(seen.items())
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([zlib.crc32(k[0]) % buckets for k, _ in rows], pa.int32()),
                    pa.array([k[0] for k, _ in rows], pa.binary()),
                    pa.array([k[1] for k, _ in rows], pa.int64()),
                    pa.array([v[0] for _, v in rows], pa.int64()),
                    pa.array([v[1] for _, v in rows], pa.int64()),
                ],
                ["bucket", "digest", "n_bytes", "keep_id", "live"],
            )

        for b in batches:
            for i, d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if own := seen.get((d, n)):
                    own[0] = i if own[0] is None else own[0] if i is None else min(own[0], i)
                    own[1] += 1
                else:
                    seen[d, n] = [i, 1]
            if len(seen) >= COMBINE_KEYS:
                yield out()
        yield out()

    return run


def _table(bucket: int, b: Bucket) -> pa.Table:
    rows = list(b.keys.items())
    m = len(rows)
    return pa.table(
        {
            "bucket": pa.array([bucket] * (m + 1), pa.int32()),
            "digest": pa.array([None, *[k[0] for k, _ in rows]], pa.binary()),
            "n_bytes": pa.array([None, *[k[1] for k, _ in rows]], pa.int64()),
            "keep_id": pa.array([None, *[v[0] for _, v in rows]], pa.int64()),
            "live": pa.array([None, *[v[1] for _, v in rows]], pa.int64()),
            "hit": pa.array([None, *[v[2] for _, v in rows]], pa.bool_()),
            "n_cells": pa.array([b.filter.n_cells, *[None] * m], pa.int32()),
            "cells": pa.array([b.filter.to_bytes(), *[None] * m], pa.binary()),
        }
    )


def _apply(table: pa.Table) -> pa.Table:
    """One bucket: its state rows (op null) and the changes (op +1 insert, -1 delete)."""
    rows = table.to_pylist()
    state = next((r for r in rows if r["cells"] is not None), None)
    b = Bucket(state["n_cells"], state["cells"]) if state else Bucket()
    for r in rows:
        if r["op"] is None and r["digest"] is not None:
            b.keys[r["digest"], r["n_bytes"]] = [r["keep_id"], r["live"], r["hit"]]
    for r in rows:
        if r["op"] == 1:
            b.insert(r["digest"], r["n_bytes"], r["keep_id"], r["live"])
    for r in rows:
        if r["op"] == -1:
            b.delete(r["digest"], r["n_bytes"], r["live"])
    return _table(rows[0]["bucket"], b)


@dataclass
class CuckooIndex:
    """The index as a table: per bucket one filter row and its stored keys. members are its live rows."""

    table: DataFrame
    buckets: int
    members: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, n_rows: int) -> CuckooIndex:
        spark = rows.sparkSession
        members = spark.createDataFrame([], "doc_id long, digest binary, n_bytes long")
        return cls(spark.createDataFrame([], INDEX_SCHEMA), bucket_count(n_rows), members).insert(rows)

    def insert(self, rows: DataFrame) -> CuckooIndex:
        """Insert digests (the columns of digests(), a written table or one that can be read again)."""
        return CuckooIndex(self._change(rows, 1), self.buckets, self.members.unionByName(rows.select("doc_id", "digest", "n_bytes")))

    def delete(self, rows: DataFrame) -> CuckooIndex:
        """Delete live rows (doc_id, digest, n_bytes), one copy for each row given."""
        key = ["doc_id", "digest", "n_bytes"]
        marked = self.members.select(*key, F.lit(1).alias("_n"), F.lit(0).alias("_d")).unionByName(rows.select(*key, F.lit(0).alias("_n"), F.lit(1).alias("_d")))
        sums = materialize(marked.groupBy(*key).agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d")).where("_n > 0"), "members")
        live = sums.where("_n > _d").select(*key, F.explode(F.sequence(F.lit(1), F.col("_n") - F.col("_d")))).select(*key)
        gone = sums.where("_d > 0").select(*key, F.explode(F.sequence(F.lit(1), F.least("_n", "_d")))).select(*key)
        table = self._change(gone, -1)
        # Groups that lost their keeper and live on: the smallest of their live members.
        lost = gone.select("doc_id", "digest", "n_bytes").distinct().join(
            table.where("digest IS NOT NULL").select("digest", "n_bytes", "keep_id"), ["digest", "n_bytes"]
        ).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", "n_bytes").distinct()
        heirs = live.join(lost, ["digest", "n_bytes"]).groupBy("digest", "n_bytes").agg(F.min("doc_id").alias("_heir"), F.lit(True).alias("_new"))
        fresh = table.join(heirs, ["digest", "n_bytes"], "left").withColumn("keep_id", F.when(F.col("_new"), F.col("_heir")).otherwise(F.col("keep_id")))
        return CuckooIndex(materialize(fresh.select(*table.columns), "cuckoo"), self.buckets, live)

    def _change(self, rows: DataFrame, op: int) -> DataFrame:
        combined = rows.select("doc_id", "digest", "n_bytes").mapInArrow(
            _combine(self.buckets), "bucket int, digest binary, n_bytes long, keep_id long, live long"
        )
        change = combined.select(
            "bucket", "digest", "n_bytes", "keep_id", "live", F.lit(None).cast("boolean").alias("hit"),
            F.lit(None).cast("int").alias("n_cells"), F.lit(None).cast("binary").alias("cells"), F.lit(op).alias("op"),
        )
        state = self.table.withColumn("op", F.lit(None).cast("int"))
        return materialize(state.unionByName(change).groupBy("bucket").applyInArrow(_apply, INDEX_SCHEMA), "cuckoo")

    def keys(self) -> DataFrame:
        return self.table.where(F.col("digest").isNotNull()).select("digest", "n_bytes", "keep_id", F.col("live").alias("group_size"), "hit")

    def filters(self) -> DataFrame:
        return self.table.where(F.col("cells").isNotNull()).select("bucket", "n_cells", "cells")

    def resolve(self, rows: DataFrame) -> DataFrame:
        """Each row with its group's keeper and size; rows of digests not stored are new (nulls)."""
        return rows.join(self.keys(), ["digest", "n_bytes"], "left")


def _judged(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    rows = materialize(digests(docs, id_col, text_col, carry), "digests")
    n = rows.count()
    # Every digest is stored, so the length says nothing more and the join is on the digest.
    keys = CuckooIndex.build(rows, n).keys().select("digest", "keep_id", "group_size")
    return join_hot(rows, keys, "digest", "group_size", n).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    return _judged(docs, id_col, text_col, ()).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def surplus(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of the rows of row_keys() to remove so that one row of each group stays: of its kept rows the first."""
    place = F.struct(*ROW_KEY)
    judged = materialize(_judged(keyed, id_col, text_col, ROW_KEY).select("digest", "kept", *ROW_KEY), "judged")
    kept = judged.where("kept")
    several = kept.groupBy("digest").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    repeated = kept.join(several, "digest").where(place != F.col("_first"))
    gone = materialize(judged.where("NOT kept").select(*ROW_KEY).unionByName(repeated.select(*ROW_KEY)), "surplus")
    release(judged)
    return gone


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)
"""
