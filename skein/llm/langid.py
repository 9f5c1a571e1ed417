"""Language ID with language-bitmask n-gram filters.

The model is one bit-sliced Bloom filter: masks of as many 64-bit words as the
languages need, one bit per language. An n-gram reads two places; the AND of the masks there is the set of
languages that contain it, all at once. A document sums the bits per language,
takes away the hits that the filter's own false positives would give, and the
language with most hits left decides.

Learning takes at most about MAX_FIT_ROWS labelled rows of each language (chosen
by a hash of the id, whatever the size of the table; a rarer language keeps all).
Every n-gram of those rows stays. The filter has at least LEAST_SLOTS slots and
SLOTS_PER_GRAM for each n-gram of the language that has most, so its chance hits
stay few; its size so follows from the bound on rows and the number of languages
(16 MB for each 64 at the least), not from the table.

Defined cases: a text that is null or has no letter (no character of Unicode
category L) is `und` with score 0; a text with letters but no known n-gram gets
the commonest language with score 0; a very long text is read whole; ties go to
the earlier language in sorted order; repeated rows are predicted alike and
count each when learned from; without labelled rows every text is `und`; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import fold, hash_bound, read

MAX_FIT_ROWS = 20_000
N = 4
LEAST_SLOTS = 1 << 21
SLOTS_PER_GRAM = 16
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Digits, white space and ASCII punctuation all read as one gap, so layout carries nothing.
_GAP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the N-byte grams of the lower-cased text, gaps squeezed to one."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_GAP).split()) + b" "
    b = np.frombuffer(raw, np.uint8)
    n = len(b) - N + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = (b[:n].astype(np.uint64) + np.uint64(1)) * _M[0]
    for i in range(1, N):
        h ^= (b[i : i + n].astype(np.uint64) + np.uint64(1)) * _M[i]
        h *= _M[(i + 1) % 4]
    return h ^ (h >> np.uint64(29))


def places(h: np.ndarray, slots: int = LEAST_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of an n-gram; slots is a power of two."""
    return (h & np.uint64(slots - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)


@dataclass
class LanguageFilters:
    languages: list[str]
    #: Per slot as many 64-bit words as the languages need.
    masks: np.ndarray
    #: Chance per language that an n-gram it lacks still reads as its own.
    false_rate: np.ndarray
    commonest: str = ""

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray], commonest: str = "") -> LanguageFilters:
        names = sorted(by_language)
        most = max(map(len, by_language.values()), default=0)
        slots = max(LEAST_SLOTS, 1 << (SLOTS_PER_GRAM * most - 1).bit_length() if most else 0)
        masks = np.zeros((slots, max(1, -(-len(names) // 64))), np.uint64)
        rate = np.zeros(len(names))
        for i, name in enumerate(names):
            own, bit = masks[:, i // 64], np.uint64(i % 64)
            for at in places(by_language[name], slots):
                own[at] |= np.uint64(1) << bit  # the same bit, so repeats of a slot are harmless
            rate[i] = float(((own >> bit) & np.uint64(1)).mean()) ** 2
        return cls(names, masks, rate, commonest or (names[0] if names else ""))

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Per language, n-grams found less those that chance would find."""
        a, b = places(h, len(self.masks))
        found = self.masks[a] & self.masks[b]
        n = len(h)
        bits = np.array([np.count_nonzero(found[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.languages))], float)
        return np.maximum(0, (bits - n * self.false_rate) / (1 - self.false_rate))

    def decide(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        n = self.hits(grams(text))
        total = float(n.sum())
        if total <= 0:
            return self.commonest, 0.0
        best = int(n.argmax())
        return self.languages[best], float(n[best]) / total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per (language, n-gram) of a task, given out whenever the table grows large."""
    seen: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for name, c in seen.items():
            k = np.fromiter(c.keys(), np.uint64, len(c)).view(np.int64)
            v = np.fromiter(c.values(), np.int64, len(c))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array(k), pa.array(v)], ["lang", "gram", "n"])
        seen.clear()

    for b in batches:
        for text, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen.setdefault(name, Counter()).update(np.unique(grams(text)).tolist())
        if sum(map(len, seen.values())) > 300_000:
            yield from out()
    yield from out()


def fit(labelled: DataFrame, max_rows: int = MAX_FIT_ROWS) -> LanguageFilters:
    """Learn from rows (doc_id, text, lang) with text and lang, about max_rows of each language at most."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not size:
        return LanguageFilters.build({})
    large = [(name, hash_bound(max_rows, n)) for name, n in size.items() if n > max_rows]
    if large:
        bounds = rows.sparkSession.createDataFrame(large, "lang string, bound long")
        rows = rows.join(F.broadcast(bounds), "lang", "left").where(F.col("bound").isNull() | (F.xxhash64("doc_id", F.lit(97)) <= F.col("bound")))
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.select("lang", "gram").toArrow()  # the n-grams of the bounded rows
    lang, gram = table["lang"].combine_chunks().dictionary_encode(), table["gram"].to_numpy()
    names, at = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    best = {name: np.empty(0, np.uint64) for name in size} | {name: gram[at == i].view(np.uint64) for i, name in enumerate(names)}
    return LanguageFilters.build(best, min(size, key=lambda name: (-size[name], name)))


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred and score of every row (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the rows learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = shared.value.decide
        for b in batches:
            got = [decide(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
