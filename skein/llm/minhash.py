"""Near duplicates: MinHash bands, signature check, exact check, star components.

1. One pass turns each text into its set of word shingles (64-bit hashes), the
   set's size and digest, and BANDS * ROWS universal hash minima.
2. Documents with the same set form a class, numbered when the classes are
   written; only the class goes on, so a group of exact copies costs one row
   whatever its size, and ids may repeat or be null.
3. Each band of a class is a bucket key. A bucket links its members to its
   smallest member (a star, never all pairs). Candidates pass a signature
   estimate, then the exact sets decide. Buckets of very many members are
   broadcast with their head, so that no task gets a whole bucket.
4. Components come from alternating large-star and small-star. Buckets whose
   members then lie in several components are looked at again: of all pairs of
   their documents across components, a prefix join over rare shingles lists
   those that can still reach the threshold (none is lost: two sets above it
   share a shingle among the first of any one order, early enough in both).
   They are checked the same way and components are formed anew. Pairs within
   a component need no check, since they cannot change it.

With 42 bands of 6 rows a pair at similarity 0.8 shares no band with a
probability below 3e-6; the signature estimate is loose by six deviations.

Defined cases: a null or blank text has an empty set, is linked with nothing
and is kept; a text with fewer words than a shingle is one shingle; a very long
text gives its whole set; repeated rows are copies of each other, and all rows
with the smallest doc_id of a group are kept (ties); rows that share a doc_id but
not a text are linked by their texts only; a group whose ids are all null has the
null id and is kept; an empty table gives an empty result; other columns are
ignored, but for those named in carry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import ROW_KEY, join_hot, materialize, read, release

BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
#: Candidates whose signatures agree less than the threshold minus this are dropped.
SLACK = 0.15
_MIX = np.random.default_rng(20_231).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_A = (np.random.default_rng(7).integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = np.random.default_rng(11).integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND_MIX = np.random.default_rng(13).integers(1, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = text.lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = len(words) - k + 1
    s = h[:n] * _MIX[0]
    for i in range(1, k):
        s += h[i : i + n] * _MIX[i]
    s ^= s >> np.uint64(32)
    s *= _MIX[15]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minimum of each universal hash over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        p = _A * x[None, at : at + 2048]
        p += _B
        np.minimum(low, p.min(axis=1), out=low)
    return (low & np.uint32(0xFFFF)).astype(np.uint16)


SIGNED = "n_shingles long, set_digest binary, signature binary"


def _sign(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Size, digest and signature of the set of each text; the columns before the text stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, sig = [], [], []
            for t in b.column(b.num_columns - 1).cast(pa.binary()):
                s = shingle_set(t.as_py(), k)
                size.append(len(s))
                digest.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                [*b.schema.names[:-1], "n_shingles", "set_digest", "signature"],
            )

    return run


def _shingles(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in b.column(0).cast(pa.binary())]
            digest = [xxhash.xxh128_digest(s) if s else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["set_digest", "shingles"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = (sig * _BAND_MIX[None, :, :ROWS]).sum(axis=2, dtype=np.uint64) + _BAND_MIX[None, :, ROWS]
        key ^= key >> np.uint64(31)
        key *= _MIX[0]
        key ^= key >> np.uint64(30)
        ids, first = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), BANDS) for i in (0, 2))
        cols = [pa.array(key.ravel().view(np.int64)), pa.array(ids, pa.int64()), pa.array(first, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "first_id"])


def _agree(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose signatures agree in at least that share of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def _similar(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose full sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


#: Counters of the sketch that orders shingles by how rare they are.
SKETCH_BITS = 20


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per sketch slot of a task."""
    seen = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        for s in b.column(0):
            seen += np.bincount((np.frombuffer(s.as_py(), np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(seen))
    slots = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(seen[slots])], ["slot", "n"])


PREFIX = "shingle long, doc_id long, label long, size long, place long"


def _prefixes(shared, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rarest shingles of each set, as many as a similar set cannot all miss; those of no other set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            out = []
            for doc, label, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(s.as_py(), np.uint64)
                often = seen[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((x, often))[: len(x) - -(-percent * len(x) // 100) + 1]
                place = np.flatnonzero(often[order] > 1)
                k = len(place)
                out.append((x[order[place]].view(np.int64), np.full(k, doc), np.full(k, label), np.full(k, len(x)), place + 1))
            cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(cols, ["shingle", "doc_id", "label", "size", "place"])

    return run


def across(docs: DataFrame, percent: int) -> DataFrame:
    """Pairs of (doc_id, label, shingles) with other labels that can reach the threshold, by prefixes and places."""
    spark = docs.sparkSession
    tally = docs.select("shingles").mapInArrow(_tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a fixed number of slots
    seen = np.zeros(1 << SKETCH_BITS, np.int64)
    seen[tally["slot"].to_numpy()] = tally["n"].to_numpy()
    p = docs.select("doc_id", "label", "shingles").mapInArrow(_prefixes(spark.sparkContext.broadcast(seen), percent), PREFIX)
    p = materialize(p, "prefixes")
    mixed = p.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y").select("shingle", "n")
    mixed = materialize(mixed, "mixed")
    p = materialize(join_hot(p, mixed, "shingle", "n", p.count()), "crossing")
    release(mixed)
    a, b = (p.select("shingle", *[F.col(c).alias(f"{c}_{n}") for c in ("doc_id", "label", "size", "place")]) for n in "ab")
    first = F.struct("size_a", "doc_id_a") < F.struct("size_b", "doc_id_b")
    sizes = 100 * F.col("size_a") >= percent * F.col("size_b")
    most = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = (100 + percent) * most >= percent * (F.col("size_a") + F.col("size_b"))
    pairs = a.join(b, "shingle").where((F.col("label_a") != F.col("label_b")) & first & sizes & enough)
    return pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def _beside(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with the value of both ends."""
    x = side.select(F.col("doc_id").alias("a"), F.col(value).alias("x"))
    y = side.select(F.col("doc_id").alias("b"), F.col(value).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def confirm(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that are links: signatures first, then the exact sets."""
    likely = _beside(pairs, signed, "signature").mapInArrow(_agree(percent / 100 - SLACK), "a long, b long")
    return _beside(likely, sets, "shingles").mapInArrow(_similar(percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) by alternating large-star and small-star.

    Nodes without links do not appear. Each round is written down, so lineage
    stays short; rounds end when the edges stay the same.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # In large every u is above its v: small-star ties u and its other v to the least v.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old, edges = edges, materialize(small.select("e.*").where("u <> v").distinct(), "edges")
        release(old)
        before, now = now, state(edges)
        if before == now:
            break
    ends = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return ends.unionByName(roots)


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, n_shingles, component_id, the number of its component (null: alone) and the carried columns of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).cast("string").alias("text"))
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    signed = materialize(source.mapInArrow(_sign(k), f"doc_id long, {kinds}{SIGNED}"), "signed")
    alike = signed.where("n_shingles > 0").groupBy("set_digest").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"), F.count("*").alias("n_rows"))
    # The classes are numbered in one write; below, doc_id is that number.
    classes = materialize(alike.select(F.monotonically_increasing_id().alias("doc_id"), *alike.columns), "classes")
    n_classes = classes.count()

    # A bucket's head is the class of its smallest id: one that others are copies of, where copies come later.
    ranked = classes.select("doc_id", "signature", F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("first_id"))
    banded = ranked.mapInArrow(_bands, "key long, doc_id long, first_id long")
    least = F.min(F.struct("first_id", "doc_id"))["doc_id"]
    buckets = materialize(banded.groupBy("key").agg(least.alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialize(join_hot(banded.drop("first_id"), buckets, "key", "n", BANDS * n_classes), "members")
    release(buckets)
    pairs = members.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()

    # Texts are found by the class' id; a set that only shares it is dropped by its digest.
    near = materialize(members.select("doc_id").distinct().join(classes.select("doc_id", "set_digest", "first_id"), "doc_id"), "near")
    wanted = near.select(F.col("first_id").alias("_id")).distinct().hint("shuffle_hash")
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    found = texts.mapInArrow(_shingles(k), "set_digest binary, shingles binary").dropDuplicates(["set_digest"])
    sets = materialize(found.join(near.select("doc_id", "set_digest"), "set_digest").select("doc_id", "shingles"), "sets")
    links = materialize(confirm(pairs, classes, sets, percent), "links")
    labels = materialize(components(links), "labels")

    # Buckets of three or more whose members lie in several components; a pair alone was checked as a star.
    placed = (
        members.where("n > 2")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    )
    placed = materialize(placed, "placed")
    release(members)
    split = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n")
    split = materialize(split, "split")
    rest = join_hot(placed, split, "key", "n", BANDS * n_classes).select("doc_id", "label").distinct()
    rest = materialize(rest.join(sets, "doc_id"), "rest")
    release(placed, split)
    more = materialize(confirm(across(rest, percent), classes, sets, percent), "more")
    release(rest)
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)), "labels")

    component = F.coalesce("label", "doc_id").alias("component")
    own = classes.select("doc_id", "set_digest", "first_id", "n_rows").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = materialize(own.select("set_digest", "first_id", "n_rows", component), "own")
    ids = own.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    own = materialize(join_hot(own.select("set_digest", "n_rows", "component"), ids, "component", "n", n_classes).drop("n"), "own")
    columns = ["doc_id", "n_shingles", "component_id", "component", *carry]
    some = join_hot(signed.where("n_shingles > 0").drop("signature"), own, "set_digest", "n_rows", n_classes)
    alone = signed.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return some.select(*columns).unionByName(alone.select(*columns))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return _grouped(docs, k, percent, id_col, text_col, ()).select("doc_id", "n_shingles", "component_id", kept)


def surplus(keyed: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of the rows of row_keys() to remove so that one row of each component stays: of its kept rows the first."""
    place = F.struct(*ROW_KEY)
    judged = materialize(_grouped(keyed, k, percent, id_col, text_col, ROW_KEY).where("component IS NOT NULL").drop("n_shingles"), "judged")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = judged.where(kept).groupBy("component").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    repeated = judged.where(kept).join(several, "component").where(place != F.col("_first"))
    gone = materialize(judged.where(~kept).select(*ROW_KEY).unionByName(repeated.select(*ROW_KEY)), "surplus")
    release(judged)
    return gone


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), k=4, percent=80)
