"""SentencePiece encoding by backtracking over longest matches, and decoding.

The library merges a text's characters, best-scored piece first, leftmost among
equals. A sequence of pieces is that result exactly if every piece merges from
its own characters, and every two neighbours, merged again from theirs, come
out as the same two: a merge across some boundary would have to be the best of
its surroundings there as well. So no merging over the text is needed:

1. Aho-Corasick over all pieces gives the longest piece that starts at each
   character; shorter ones are its prefixes, from a table.
2. From left to right the longest piece is taken that fits the one before. Where
   none does, the one before is taken back, its end is marked in a bitfield of
   failed positions, and its next shorter prefix is tried. No piece ends at a
   failed position again, so the walk is linear.

Where no piece of the model goes on into a white-space mark, no merge crosses
into one: texts are then cut before each run of marks, and workers remember the
ids of a bounded number of parts. Characters that are no piece become their
bytes. The model's own rules normalise a text before and decode ids after.

Defined cases: a null text is an empty text, which has no ids and decodes to an
empty text; texts are encoded whole, however long; control and byte pieces
written out in a text are ordinary characters; repeated rows, null ids and
clashing columns are rows like others, with columns besides the id and text
ignored; an empty table gives no rows; of pieces with equal scores the leftmost
merges first.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import read

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Parts of texts, and pairs of pieces, that a worker remembers in each of two generations.
REMEMBERED = 400_000
ENCODED = "doc_id long, ids array<int>, decoded string"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """Remembers what a function gave; of two generations the older goes when the newer is full."""

    def __init__(self, of) -> None:
        self.of, self.before = of, {}

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.of(key)
        self[key] = value
        return value


#: A character that is no piece; it merges with nothing.
ALONE = -1


class PieceEncoder:
    """Ids of texts under a BPE model of pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        #: Lower merges first.
        self.cost = {m.id_to_piece(i): -m.get_score(i) for i in every if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(m.is_byte(i) for i in self.bytes)
        self.piece = [m.id_to_piece(i) for i in every]
        self.size = [len(p) for p in self.piece]
        #: The next shorter piece that begins a piece.
        self.shorter = [ALONE] * len(self.piece)
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        whole = {p: m.piece_to_id(p) for p in self.cost if self.merged(p) == [p]}  # others are never a result
        for p, i in whole.items():
            self.matches.add_word(p, i)
            self.shorter[i] = next((whole[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), ALONE)
        self.matches.make_automaton()
        crosses = any(MARK in p.lstrip(MARK) for p in whole)
        self.parts = re.compile(".+" if crosses else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.fits = Memory(self._fits)
        self.known = Memory(self.ids_of)

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged, best piece first, leftmost among equals."""
        cost, none = self.cost, float("inf")
        parts = list(text)
        costs = [cost.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost.get(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = cost.get(parts[i] + parts[i + 1], none)
        return parts

    def _fits(self, pair: int) -> bool:
        """Whether two neighbours, merged again from their characters, stay two; the first is the pair's upper half."""
        a, b = self.piece[pair >> 32], self.piece[pair & 0xFFFFFFFF]
        return self.merged(a + b) == [a, b]

    def walk(self, text: str) -> list[int]:
        """The pieces of a text by backtracking."""
        size, shorter, fits = self.size, self.shorter, self.fits
        longest = [ALONE] * len(text)
        for end, i in self.matches.iter(text):
            longest[end - size[i] + 1] = i  # of matches with one start the longest ends last
        failed = bytearray(len(text) // 8 + 1)
        taken: list[int] = []
        at, before, end_of_text = 0, ALONE, len(text)
        i = longest[0]
        while True:
            end = at + (size[i] if i >= 0 else 1)
            if not failed[end >> 3] >> (end & 7) & 1 and (before < 0 or i < 0 or fits[before << 32 | i]):
                taken.append(i)
                if end == end_of_text:
                    return taken
                at, before = end, i
                i = longest[at]
            elif i >= 0 and shorter[i] >= 0:
                i = shorter[i]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                i = taken.pop()
                before = taken[-1] if taken else ALONE
                at -= size[i] if i >= 0 else 1

    def ids_of(self, text: str) -> bytes:
        """Ids of a normalised text as 32-bit numbers."""
        out, at, unknown = array("i"), 0, self.model.unk_id()
        for i in self.walk(text):
            if i >= 0:
                out.append(i)
            elif self.fallback:
                out.extend([self.bytes[b] for b in text[at].encode()])
            else:
                out.append(unknown)
            at += self.size[i] if i >= 0 else 1
        return out.tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        known = self.known
        ids = b"".join([known[p] for p in self.parts.findall(self.model.normalize(text))])
        return ids if self.fallback else self._joined(ids)

    def _joined(self, ids: bytes) -> bytes:
        """Without byte pieces, unknown characters in a row are one."""
        every, unknown = np.frombuffer(ids, "i"), self.model.unk_id()
        again = (every[1:] == unknown) & (every[:-1] == unknown)
        return every[np.concatenate([[True], ~again])].tobytes() if again.any() else ids


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One per Python worker, so that its memory outlives a task."""
    return PieceEncoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        decode = ids_of.model.decode
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [np.frombuffer(ids_of(t) if t else b"", "i") for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids))
                texts = pa.array([decode(i.tolist()) if len(i) else "" for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text that the ids decode to, of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_encode(path or model_path()), ENCODED)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(decimal).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
