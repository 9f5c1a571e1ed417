"""Language-model scores by online logistic mixing of hashed-context bit predictors.

The text of a document is its lower-cased words, each closed by a space, and the
empty word at its end. Each byte is a path of binary decisions down a Huffman
tree of the corpus' bytes (about four a byte instead of eight). Each decision has
four predictors, made from the corpus' counts of zeros and ones in its context:

* the last three bytes of the word, and the last five: slots of hashed tables;
* the whole word so far: exact counts, without slots or collisions (see below);
* for the first REACH bytes of a word, the nearest earlier word of the document
  that is among the COMMON commonest, with the word so far: slots of a hashed
  table. This is the context that reaches across words.

Predictions are summed in the logistic domain. A gate picks the weights: how
often the word so far was seen, and whether the earlier word says anything. The
weights of each gate are learned from every decision of every training document
(see below), by Newton steps whose gradients are summed on Spark. Within
a document they are refined, gate by gate, after every block of decisions (the
first of FIRST decisions), so that only the past is used; decisions that are sure either
way (SURE) keep their mix, and are summed once per token. The score is the sum
of the logs of all decisions; bits_per_byte is the same in bits over the bytes
of the text and its end.

Word-so-far counts. Each distinct token is coded as its path of bits, and the
vocabulary is dealt in ranges of that code. In a sorted range the tokens that
share a beginning lie side by side, so all counts along a token's path are
differences of running sums; counts of beginnings that cross a range's ends come
from a list of sums at the ends. So what is learned grows with the corpus, and
no task holds more than a range. Documents are worked on in blocks; a block asks
for the predictions of its distinct tokens once, by a join on the token; the
HEAD commonest tokens are broadcast instead, which leaves no hot key.

What the gates learn from. Each occurrence is predicted without itself. Beyond
the first REACH bytes the inputs of a decision depend on the token alone, so a
range sums its tokens' counts over cells: gate and inputs, rounded to levels. In
the first REACH bytes they depend on those bytes and the earlier word; all
occurrences are counted by such pairs, which also fill the earlier word's table.
There are no more cells than levels allow, whatever the corpus.

The hashed tables and the broadcast have a fixed size. Counting and learning
cover every training document.

Defined cases: a null or blank text is the end alone; without training
documents the base is 0 and every decision has chance 1/2; repeated rows are
scored each; a null doc_id stays null; a very long text is scored whole, in
slices; its words count along their first DEPTH decisions in the word-so-far
predictor and whole in the others; ties do not arise; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import fold, materialize, read, release

#: Slots of the tables of the contexts of three and of five bytes, and of the earlier word.
NEAR_BITS, FAR_BITS, AFTER_BITS = 19, 21, 22
#: Bytes of a word that the earlier common word predicts, and how many words are common.
REACH, COMMON = 3, 1024
#: Rows that a table travels in, and how many of them are added at a time.
CHUNKS, FAN_IN = 256, 16
#: Tokens that are broadcast, at most; distinct tokens of a range.
HEAD, RANGE = 150_000, 40_000
#: Decisions of a word that the word-so-far predictor follows.
DEPTH = 256
#: How often the word so far was seen: bounds of the gate.
SEEN = (1, 3, 8, 32, 128)
GATES = len(SEEN) + 1
INPUTS = 4
START = (0.3, 0.3, 0.4, 0.3)
#: Newton steps; strength of the start.
STEPS, PRIOR = 4, 20.0
#: A decision whose mix is beyond this either way is sure: it is not refined, and summed once per token.
SURE = 4.0
#: Decisions of a document's first block and of its largest, and the step of refinement.
FIRST, LAST, STEP = 128, 4096, 0.1
#: Pairs that a task holds before it hands them on.
PAIRS = 1 << 20
#: Text of a block of documents; tokens that are scored at a time, and distinct ones whose predictions are made or mixed at a time.
BLOCK_BYTES, SLICE, PIECE = 3 << 20, 1 << 13, 1 << 12
#: Tokens of whole documents that are refined side by side.
SIDE_BY_SIDE = 1 << 15
#: Tokens whose pairs of an earlier word and a beginning are mixed at a time.
SPAN = 1 << 19
END = b""  # the empty word: no text has it, so no token reads like this one
_M = np.uint32(0x9E3779B1)
_LETTER = np.random.default_rng(5).integers(0, 2**32, (3, 256), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_PLACE = np.random.default_rng(6).integers(0, 2**32, 4096, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_NAME = np.random.default_rng(7).integers(0, 2**32, COMMON + 1, dtype=np.uint64).astype(np.uint32)
#: Largest prediction, levels a side of those that travel with a token, and of those in the tables.
TOP, SIDE = 8.0, 15
_FINE_SIDE = 127
_FINE = (TOP * np.sign(np.arange(256, dtype=np.uint8).view(np.int8)) * (np.arange(256, dtype=np.uint8).view(np.int8) / _FINE_SIDE) ** 2).astype(np.float32)
_LEVELS = (TOP * np.sign(np.arange(-SIDE, SIDE + 2)) * (np.arange(-SIDE, SIDE + 2) / SIDE) ** 2).astype(np.float32)
_N_LEVELS = 2 * SIDE + 1


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # bytes: ASCII case and white space only


@dataclass
class Code:
    """A Huffman code of bytes: per byte its decisions (bit) and where each is taken (node)."""

    start: np.ndarray
    length: np.ndarray
    bit: np.ndarray
    node: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]  # every byte has a code
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        made = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[2]], up[b[2]] = (made, 0), (made, 1)
            heapq.heappush(heap, (a[0] + b[0], made, made))
            made += 1
        bits, nodes, start = [], [], []
        for s in range(256):
            path, at = [], s
            while at in up:
                path.append(up[at])
                at = up[at][0]
            start.append(len(bits))
            bits += [b for _, b in reversed(path)]
            nodes += [n - 255 for n, _ in reversed(path)]
        start_a = np.array(start, np.int64)
        return cls(start_a, np.diff(np.append(start_a, len(bits))), np.array(bits, np.uint8), np.array(nodes, np.uint32))


def values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The values of a binary column without nulls, as to_pylist() gives them, in a tenth of its time."""
    out: list[bytes] = []
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, ends, data = a.cast(pa.binary()).buffers()
        if len(a):
            at, raw = np.frombuffer(ends, np.int32)[a.offset : a.offset + len(a) + 1].tolist(), data.to_pybytes() if data else b""
            out += [raw[s:e] for s, e in zip(at, at[1:])]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of rows of equally many bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def decisions(tokens: list[bytes], code: Code) -> np.ndarray:
    """How many decisions each token and its space take."""
    size = np.array([len(t) + 1 for t in tokens], np.int64)
    raw = np.frombuffer(b" ".join([*tokens, b""]), np.uint8)
    return np.add.reduceat(code.length[raw], np.cumsum(size) - size) if tokens else np.empty(0, np.int64)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """The slots of hashes, which are overwritten."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(13)
    h *= _M
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them) for each entry, one after the other."""
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(start - (np.cumsum(n) - n), n)


@dataclass
class Paths:
    """The decisions of tokens, one token after the other."""

    raw: np.ndarray  # their bytes, each token closed by a space
    place: np.ndarray  # of a byte in its token
    first: np.ndarray  # where a byte's token begins
    byte: np.ndarray  # of a decision
    bit: np.ndarray
    step: np.ndarray  # hash of a decision's node
    each: np.ndarray  # decisions per token

    @classmethod
    def of(cls, tokens: list[bytes], code: Code, reach: int | None = None, skip: int = 0) -> Paths:
        """All decisions of the tokens, or those of their first reach bytes, or those after their first skip bytes."""
        closed = [(t + b" ")[:reach] for t in tokens]
        raw = np.frombuffer(b"".join(closed), np.uint8)
        size = np.array([len(t) for t in closed], np.int64)
        start = np.cumsum(size) - size
        first = np.repeat(start.astype(np.int32), size)
        place = np.arange(len(raw), dtype=np.int32) - first
        n = code.length[raw]
        if skip:
            n[place < skip] = 0
        byte = np.repeat(np.arange(len(raw), dtype=np.int32), n)
        at = np.arange(len(byte), dtype=np.int64) + (code.start[raw] - (np.cumsum(n) - n))[byte]
        each = np.add.reduceat(n, start) if len(raw) else np.empty(0, np.int64)
        return cls(raw, place, first, byte, code.bit[at], code.node[at] * np.uint32(0x85EBCA6B), each)

    def _back(self, k: int) -> np.ndarray:
        """The k-th byte before, 0 before the token."""
        out = np.zeros(len(self.raw), np.uint8)
        out[k:] = self.raw[: max(0, len(self.raw) - k)]
        out[self.place < k] = 0
        return out

    def _slots(self, c: np.ndarray, bits: int) -> np.ndarray:
        return _mixed((c ^ (c >> np.uint32(15)))[self.byte] + self.step, bits)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots under the last three and the last five bytes."""
        near = (_LETTER[0][self._back(1)] * _M + _LETTER[1][self._back(2)]) * _M + _LETTER[0][self._back(3)]
        near = near + np.minimum(self.place, 3).astype(np.uint32) * np.uint32(0x27D4EB2F)  # a place before the token is no zero byte
        far = ((near ^ (near >> np.uint32(13))) * _M + _LETTER[1][self._back(4)]) * _M + _LETTER[0][self._back(5)]
        return self._slots(near, NEAR_BITS), self._slots(far + np.minimum(self.place, 5).astype(np.uint32), FAR_BITS)

    def inside(self) -> np.ndarray:
        """Hash of the token so far and the node: each byte times a factor of its place, summed."""
        sums = np.cumsum(_LETTER[2][self.raw] * _PLACE[self.place & 4095], dtype=np.uint32)
        before = np.zeros(len(self.raw), np.uint32)
        before[1:] = sums[:-1]
        so_far = before - before[self.first] + self.place.astype(np.uint32) * _M
        return (so_far ^ (so_far >> np.uint32(15)))[self.byte] + self.step

    def codes(self) -> np.ndarray:
        """The first DEPTH decisions of each token as bits, in 32 bytes."""
        m = np.zeros((len(self.each), DEPTH), np.uint8)
        row = np.repeat(np.arange(len(self.each)), self.each)
        col = np.arange(len(row)) - np.repeat(np.cumsum(self.each) - self.each, self.each)
        ok = col < DEPTH
        m[row[ok], col[ok]] = self.bit[ok]
        return np.packbits(m, axis=1)


def after_slots(names: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Slots under the name of the earlier common word and the hash of word so far and node."""
    return _mixed(inside + names, AFTER_BITS)


def logistic(right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """The prediction, positive for right, that counts give."""
    return np.clip(np.log((right + np.float32(0.2)) / (wrong + np.float32(0.2))), -TOP, TOP)


def _rounded(x: np.ndarray, side: int) -> np.ndarray:
    """The level of each prediction, 0 in the middle."""
    return np.rint(np.sign(x) * (side * np.sqrt(np.abs(x) / np.float32(TOP)))).astype(np.int8)


def without_one(table: np.ndarray, side: int) -> np.ndarray:
    """Per slot and bit the level of the prediction for that bit, made without one occurrence of it."""
    out = np.empty(table.shape, np.int8)
    for bit in (0, 1):
        right, wrong = np.maximum(table[:, bit] - 1, 0), table[:, 1 - bit]
        out[:, bit] = _rounded(np.where(right + wrong > 0, logistic(right, wrong), 0), side)
    return out


# Documents as blocks of numbered tokens.

BLOCK_SCHEMA = "block long, ids array<long>, train array<boolean>, sizes array<int>, n_bytes array<long>, at binary, tokens binary, counts binary"


def _small(raw: bytes) -> bytes:
    """Compressed, after the size: a block is written and shuffled whole."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _full(small: bytes) -> bytes:
    return pa.decompress(small[8:], int.from_bytes(small[:8], "little"), "zstd", asbytes=True)


def _numbers(at: np.ndarray) -> bytes:
    """Numbers of tokens by bytes, all first bytes in front: the last ones are nearly all zeros."""
    return _small(np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _at(small: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_full(small), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Texts as numbers of tokens, the words of each and its end; how many each has; the tokens, in which the end is the first."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # ASCII case and white space only, as in words_of
    words, bounds = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty one
    names = words.filter(pa.array(full)).dictionary_encode()
    sizes = np.diff(np.append(0, np.cumsum(full))[bounds])
    at = np.zeros(len(names) + len(sizes), np.int32)
    ends = np.cumsum(sizes + 1) - 1
    word = np.ones(len(at), bool)
    word[ends] = False
    at[word] = names.indices.to_numpy() + 1
    return at, sizes + 1, [END, *values(names.dictionary)]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc_id, text, train): documents as numbers of the block's tokens, and how often training documents hold each."""
    first, made = TaskContext.get().partitionId() << 32, 0
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]

    def out() -> pa.RecordBatch:
        ids, texts, train = (pa.concat_arrays([d.column(i) for d in docs]) for i in range(3))
        texts = texts.fill_null("")
        at, sizes, tokens = _words(texts)
        learned = np.repeat(train.fill_null(False).to_numpy(zero_copy_only=False), sizes)
        counts = np.bincount(at[learned], minlength=len(tokens)).astype(np.int64)
        n_bytes = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
        row = (first + made, ids.to_pylist(), train.fill_null(False).to_pylist(), sizes, n_bytes, _numbers(at), _small(b" ".join(tokens)), _small(counts.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["block", "ids", "train", "sizes", "n_bytes", "at", "tokens", "counts"])

    docs, size = [], 0
    for b in batches:
        done, upto = 0, np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
        # A block ends with the text that fills it.
        while done < b.num_rows:
            full = int(np.searchsorted(upto, BLOCK_BYTES - size + (upto[done - 1] if done else 0)))
            docs.append(b.slice(done, full + 1 - done))
            if full >= b.num_rows:
                size += int(upto[-1] - (upto[done - 1] if done else 0))
                break
            yield out()
            docs, size, made, done = [], 0, made + 1, full + 1
    if docs:
        yield out()


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of rows (doc_id, text, train), a written table: they are numbered within one write."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("train").cast("boolean").alias("train"))
    return materialize(rows.mapInArrow(_encode, BLOCK_SCHEMA), "blocks")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of blocks (tokens, counts)."""
    for b in batches:
        for tokens, counts in zip(b.column(0), b.column(1)):
            names = _full(tokens.as_py()).split(b" ")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(np.frombuffer(_full(counts.as_py()), np.int64))], ["token", "n"])


def vocabulary(blocks: DataFrame) -> DataFrame:
    """Each distinct token and how often training documents hold it."""
    return blocks.select("tokens", "counts").mapInArrow(_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one at a time: each may be large."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def _block(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    return _full(row["tokens"]).split(b" "), _at(row["at"]), np.array(row["sizes"], np.int64)


def earlier(common: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per token of documents the number of the nearest earlier common word of its document, 0 without one."""
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    number = common[at]
    last = np.maximum.accumulate(np.where(number > 0, np.arange(len(at)), -1))
    last = np.concatenate([[-1], last[:-1]]) if len(at) else last
    return np.where(last >= begin, number[last], 0)


# Tables of counts per slot.

TABLE_SCHEMA = "chunk int, part int, counts binary"


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as their largest needs; the length says how many."""
    most = counts.max(initial=0)
    return counts.astype(next(t for t in ("u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}")


def _table_rows(tables: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a task's tables that hold something."""
    task = TaskContext.get().partitionId()
    for i, t in enumerate(tables):
        for k, part in enumerate(np.split(t, CHUNKS)):
            if part.any():
                cols = [pa.array([first + i * CHUNKS + k], pa.int32()), pa.array([task], pa.int32()), pa.array([_narrow(part)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["chunk", "part", "counts"])


def _fill(code: Code) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts under the last bytes of the tokens of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << bits, np.uint64) for bits in (NEAR_BITS, FAR_BITS)]
        some = False
        for b in batches:
            n = b.column(1).to_numpy()
            if not (n > 0).any():
                continue
            some = True
            p = Paths.of([t for t, k in zip(values(b.column(0)), n.tolist()) if k], code)
            often = np.repeat(n[n > 0].astype(np.uint64), p.each)
            for t, s in zip(tables, p.slots()):
                np.add.at(t, s.astype(np.int64) * 2 + p.bit, often)
        if some:
            yield from _table_rows(tables, 0)

    return run


# Beginnings of words under the earlier common word.


def beginnings(tokens: list[bytes]) -> np.ndarray:
    """The first REACH bytes of each token and its space as a number; no token holds a space, so the rest may be zeros."""
    raw = np.frombuffer(b" ".join([*tokens, b"\0" * REACH]), np.uint8)
    at = np.append(0, np.flatnonzero(raw == ord(" ")) + 1)[: len(tokens)]
    out, goes_on = np.zeros(len(tokens), np.int64), np.ones(len(tokens), bool)
    for k in range(REACH):
        byte = raw[at + k]
        out = out << 8 | np.where(goes_on, byte, 0)
        goes_on &= byte != ord(" ")
    return out


def _begun(numbers: np.ndarray) -> list[bytes]:
    """Tokens with these beginnings."""
    return [n.to_bytes(REACH, "big").split(b" ")[0] for n in numbers.tolist()]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and whole numbers summed over each."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _pairs(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pair, n): the earlier common word and the beginning of every token of the training documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, keys, counts = shared.value, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(counts[0], pa.int64())], ["pair", "n"])

        for b in batches:
            for row in _rows(b):
                tokens, at, sizes = _block(row)
                train = np.repeat(np.array(row["train"], bool), sizes)
                if not train.any():
                    continue
                ctx = earlier(np.array([common.get(t, 0) for t in tokens], np.int64), at, sizes)
                pair, n = np.unique(ctx[train] << 8 * REACH | beginnings(tokens)[at[train]], return_counts=True)
                keys.append(pair)
                counts.append(n)
                if sum(map(len, keys)) > PAIRS:
                    keys, counts = ([x] for x in _merged(keys, counts))
                    if len(keys[0]) > PAIRS // 2:
                        yield out()
                        keys, counts = [], []
        if keys:
            keys, counts = ([x] for x in _merged(keys, counts))
            yield out()

    return run


def pairs(blocks: DataFrame, common: dict[bytes, int]) -> DataFrame:
    """Each pair of an earlier common word and a beginning, and how often training documents hold it."""
    seen = blocks.select("train", "sizes", "at", "tokens").mapInArrow(_pairs(blocks.sparkSession.sparkContext.broadcast(common)), "pair long, n long")
    return materialize(seen.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


def _split(pair: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, Paths, np.ndarray, np.ndarray]:
    """Per distinct beginning of pairs where it is first, and its decisions; per pair its number of decisions, and which they are."""
    begin, first, own = np.unique(pair & ((1 << 8 * REACH) - 1), return_index=True, return_inverse=True)
    p = Paths.of(_begun(begin), code, REACH)
    each = p.each[own]
    return first, begin, p, each, _runs((np.cumsum(p.each) - p.each)[own], each)


def _fill_after(code: Code) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts under the earlier common word of the pairs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(2 << AFTER_BITS, np.uint64), False
        for b in batches:
            if not b.num_rows:
                continue
            some = True
            pair, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint64)
            _, _, p, each, d = _split(pair, code)
            slot = after_slots(np.repeat(_NAME[pair >> 8 * REACH], each), p.inside()[d])
            np.add.at(table, slot.astype(np.int64) * 2 + p.bit[d], np.repeat(n, each))
        if some:
            yield from _table_rows([table], 2 * CHUNKS)

    return run


def _slots_of(chunk: int) -> int:
    return (2 << (NEAR_BITS, FAR_BITS, AFTER_BITS)[chunk // CHUNKS]) // CHUNKS


def _add(table: pa.Table) -> pa.Table:
    n = _slots_of(table.column("chunk")[0].as_py())
    total = np.zeros(n, np.uint64)
    for c in table.column("counts"):
        total += _wide(c.as_py(), n)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([_narrow(total)], pa.binary())})


def tables_of(filled: list[DataFrame]) -> list[np.ndarray]:
    """Per context the counts (zeros, ones) per slot: the tasks' tables, FAN_IN of them added at a time."""
    out = [np.zeros((1 << bits, 2), np.float32) for bits in (NEAR_BITS, FAR_BITS, AFTER_BITS)]
    for one in filled:
        parts = materialize(one, "tables")
        left = (parts.agg(F.max("part")).first()[0] or 0) + 1
        while True:
            left = -(-left // FAN_IN)
            grouped = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("chunk", "part")
            added = materialize(grouped.applyInArrow(_add, TABLE_SCHEMA), "tables")
            release(parts)
            parts = added
            if left <= 1:
                break
        for r in parts.toLocalIterator():  # CHUNKS rows of a fixed size for each table
            t = out[r["chunk"] // CHUNKS].reshape(CHUNKS, -1)
            t[r["chunk"] % CHUNKS] = _wide(r["counts"], t.shape[1])
        release(parts)
    return out


# The word so far: ranges of the sorted vocabulary.


def _beginning(x: int, d: int) -> int:
    """The first d of DEPTH bits, then zeros."""
    return x >> (DEPTH - d) << (DEPTH - d)


@dataclass
class Ranges:
    """Ends of the ranges, and counts of beginnings that cross them."""

    ends: list[int]
    #: Per end and depth, training tokens before it, or from it on, that share so many of its bits.
    before: list[list[int]] = field(default_factory=list)
    behind: list[list[int]] = field(default_factory=list)

    @classmethod
    def choose(cls, sample: list[int], n: int) -> tuple[Ranges, list[int]]:
        """n ranges of about equal numbers of sampled codes, and each end's depth: as short as can be."""
        ends: dict[int, int] = {}
        step = max(1, len(sample) // n)
        for i in range(step, len(sample), step):
            if differ := sample[i - 1] ^ sample[i]:
                depth = DEPTH - differ.bit_length() + 1
                ends[_beginning(sample[i], depth)] = depth
        return cls(sorted(ends)), [ends[e] for e in sorted(ends)]

    def points(self, depths: list[int]) -> list[int]:
        """Where running sums are needed to fill before and behind."""
        out = set(self.ends)
        for e, depth in zip(self.ends, depths):
            for d in range(depth):
                out |= {_beginning(e, d), _beginning(e, d) + (1 << (DEPTH - d))}
        return sorted(x for x in out if 0 < x < 1 << DEPTH)

    def fill(self, depths: list[int], below: dict[int, int]) -> None:
        for e, depth in zip(self.ends, depths):
            lows = [_beginning(e, d) for d in range(depth)]
            self.before.append([below[e] - below[x] for x in lows])
            self.behind.append([below[x + (1 << (DEPTH - d))] - below[e] for d, x in enumerate(lows)])


def _bytes_of(points: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(DEPTH // 8, "big") for p in points], f"S{DEPTH // 8}")


def _code_column(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(f"S{DEPTH // 8}").ravel()


def _codes(column: pa.Array, code: Code) -> np.ndarray:
    tokens = values(column)
    return np.concatenate([Paths.of(tokens[i : i + PIECE], code).codes() for i in range(0, len(tokens), PIECE)])


def _coded(code: Code, ends: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """token, n, code and range of (token, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = _codes(b.column(0), code)
            part = np.searchsorted(ends, _code_column(codes), side="right").astype(np.int32) if len(ends) else np.zeros(b.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(codes), pa.array(part)], ["token", "n", "code", "part"])

    return run


def _sums(code: Code, points: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Training tokens of a task between neighbouring points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(points) + 1, np.int64)
        for b in batches:
            if b.num_rows:
                codes = _code_column(_codes(b.column(0), code))
                np.add.at(total, np.searchsorted(points, codes, side="right"), b.column(1).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    return run


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that rows of eight 32-bit words have in common."""
    differ = a ^ b
    word = (differ != 0).argmax(axis=1)
    x = differ[np.arange(len(differ)), word].astype(np.float64)
    return np.where(x > 0, 32 * word + 32 - np.frexp(x)[1], DEPTH)


def path_counts(codes: np.ndarray, each: np.ndarray, n: np.ndarray, before: tuple[int, list[int]] | None, behind: tuple[int, list[int]] | None) -> np.ndarray:
    """How often training tokens took each decision's way so far: each + 1 numbers per token, of a sorted range.

    before and behind are the range's ends, with the counts beyond them per depth.
    """
    m = len(codes)
    words = codes.view(">u4").astype(np.uint32).reshape(m, DEPTH // 32)
    left, right = np.full(m, -1), np.full(m, -1)
    left[1:] = right[:-1] = _shared_bits(words[:-1], words[1:])

    def beyond(i: int, side: tuple[int, list[int]] | None) -> tuple[int, list[int]]:
        if side is None:
            return -1, []
        differ = int.from_bytes(codes[i].tobytes(), "big") ^ side[0]
        return min(DEPTH - differ.bit_length(), len(side[1]) - 1), side[1]

    (most_left, add_left), (most_right, add_right) = beyond(0, before), beyond(m - 1, behind)
    share = np.maximum(left, right)
    share[0] = max(share[0], most_left)
    share[-1] = max(share[-1], most_right)
    width = each + 1
    start = np.cumsum(width) - width
    out = np.repeat(n, width)
    for i in np.flatnonzero(each > DEPTH).tolist():
        out[start[i] + DEPTH + 1 : start[i] + width[i]] = 0
    active = np.arange(m)
    for d in range(DEPTH + 1):
        active = active[(share[active] >= d) & (each[active] >= d)]
        if not len(active):
            break
        head = np.flatnonzero(left[active] < d)
        head = head if len(head) and head[0] == 0 else np.concatenate([[0], head])
        sums = np.add.reduceat(n[active], head)
        if d <= most_left and active[0] == 0:
            sums[0] += add_left[d]
        if d <= most_right and active[-1] == m - 1:
            sums[-1] += add_right[d]
        out[start[active] + d] = np.repeat(sums, np.diff(np.append(head, len(active))))
    return out


def _packed(right: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The word-so-far prediction and the gate of each decision in a byte. Levels are symmetric, so chances still add up to one."""
    q = _rounded(logistic(right.astype(np.float32), (seen - right).astype(np.float32)), SIDE) + SIDE
    return (np.digitize(seen, SEEN).astype(np.uint8) << np.uint8(5)) | q.astype(np.uint8)


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prediction and the gate."""
    return _LEVELS[packed & np.uint8(31)], packed >> np.uint8(5)


def _trimmed(packed: np.ndarray, each: np.ndarray) -> list[bytes]:
    """Each token's bytes without the repeats of its last one: a word that is alone on its way stays so."""
    ends = np.cumsum(each)
    change = np.zeros(len(packed), bool)
    change[1:] = packed[1:] != packed[:-1]
    change[ends - each] = True
    # Up to the last change, and at least the first byte.
    last = np.maximum.reduceat(np.where(change, np.arange(len(packed)), 0), ends - each) + 1 if len(each) else ends
    raw = packed.tobytes()
    return [raw[s:e] for s, e in zip((ends - each).tolist(), last.tolist())]


def _spread(trimmed: list[bytes], skip: np.ndarray | int, each: np.ndarray) -> np.ndarray:
    """The bytes of decisions again: each of a token, after the first skip."""
    size = np.array([len(t) for t in trimmed], np.int64)
    own = np.frombuffer(b"".join(trimmed), np.uint8)
    first = np.cumsum(size) - size
    return own[np.minimum(_runs(first + skip, each), np.repeat(first + size - 1, each))]


@dataclass
class Learned:
    """What the gates learn from a range: its beginnings, their predictions as if seen once less, and counts of cells."""

    begin: list[int | None]  # at the first token of each
    lead: list[bytes | None]
    total: np.ndarray


def predictions(
    tokens: list[bytes], codes: np.ndarray, n: np.ndarray, code: Code, ranges: Ranges, part: int, less: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[list[bytes], Learned]:
    """Packed predictions of the tokens of a sorted range; with the levels of the two tables without one occurrence also what the gates learn from."""
    each = decisions(tokens, code)
    before = (ranges.ends[part - 1], ranges.before[part - 1]) if part > 0 else None
    behind = (ranges.ends[part], ranges.behind[part]) if part < len(ranges.ends) else None
    ways = path_counts(codes, each, n, before, behind)
    start = np.cumsum(each + 1) - each - 1
    own: list[bytes] = []
    learned, known = Learned([None] * len(tokens), [None] * len(tokens), np.zeros(GATES * _N_LEVELS**3)), set()
    for i in range(0, len(tokens), PIECE):
        e = each[i : i + PIECE]
        at, depth = _runs(start[i : i + PIECE], e), _runs(np.zeros(len(e), np.int64), e)
        right, seen = ways[at + 1] * (depth < DEPTH), ways[at] * (depth < DEPTH)
        own += _trimmed(_packed(right, seen), e)
        pick = np.flatnonzero(n[i : i + PIECE] > 0)
        if less is None or not len(pick):
            continue
        if len(pick) < len(e):
            some = np.repeat(n[i : i + PIECE] > 0, e)
            right, seen, e = right[some], seen[some], e[pick]
        taught = [tokens[i + k] for k in pick.tolist()]
        once = _packed(np.maximum(right - 1, 0), np.maximum(seen - 1, 0))
        p = Paths.of(taught, code)
        late = p.place[p.byte] >= REACH
        cell = (once >> np.uint8(5)).astype(np.int64)
        for t, slot in zip(less, p.slots()):
            cell = cell * _N_LEVELS + (t[slot, p.bit] + SIDE)
        cell = cell * _N_LEVELS + (once & np.uint8(31))
        learned.total += np.bincount(cell[late], np.repeat(n[i + pick], e)[late], len(learned.total))
        raw, first = once.tobytes(), np.cumsum(e) - e
        lead = np.add.reduceat(~late, first, dtype=np.int64)
        for k, begin, f, m in zip((i + pick).tolist(), beginnings(taught).tolist(), first.tolist(), lead.tolist()):
            if begin not in known:
                known.add(begin)
                learned.begin[k], learned.lead[k] = begin, raw[f : f + m]
    return own, learned


#: begin and lead stand at the first token of a beginning in a range, cells at the first of a range.
PREDICTED = "token binary, n long, own binary, begin long, lead binary, cells binary"


def _predict(shared) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("code")
        tokens, n = values(table.column("token")), table.column("n").to_numpy()
        codes = np.frombuffer(b"".join(values(table.column("code"))), np.uint8).reshape(-1, DEPTH // 8)
        code, ranges, less = shared.value
        own, learned = predictions(tokens, codes, n, code, ranges, table.column("part")[0].as_py(), less)
        full = np.flatnonzero(learned.total)
        cells = [full.astype("<i4").tobytes() + learned.total[full].astype("<i8").tobytes() if len(full) else None] + [None] * (len(tokens) - 1)
        return pa.table({
            "token": table.column("token"), "n": table.column("n"), "own": pa.array(own, pa.binary()),
            "begin": pa.array(learned.begin, pa.int64()), "lead": pa.array(learned.lead, pa.binary()), "cells": pa.array(cells, pa.binary()),
        })

    return run


@dataclass
class Model:
    """What the tasks need: code, tables, range ends, and the weights of the gates."""

    code: Code
    near: np.ndarray
    far: np.ndarray
    after: np.ndarray
    ranges: Ranges
    common: dict[bytes, int]
    #: Per gate without and with a word from the earlier word, the weights of the inputs.
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array(START), (2 * GATES, 1)))


@dataclass
class LanguageModel:
    model: Model
    tokens: DataFrame  # token, n: all tokens of the blocks it was fitted on
    predicted: DataFrame  # the same with predictions
    n_tokens: int
    n_distinct: int


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for b in batches:
        tokens = [t + b" " for t in values(b.column(0))]
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        np.add.at(total, raw, np.repeat(b.column(1).to_numpy(), [len(t) for t in tokens]))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["byte", "n"])


def _head(tokens: DataFrame) -> dict[bytes, int]:
    """Counts of the commonest tokens: all from the least count up at which there are no more than HEAD.

    The bound comes from a histogram in eighths of a power of two, so no more than HEAD rows come to the driver.
    """
    level = F.floor(8 * F.log2("n"))
    own = tokens.where("n > 0")
    sizes = sorted(own.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect(), reverse=True)  # at most 512 rows
    total, least = 0, None
    for r in sizes:
        total += r["size"]
        if total > HEAD:
            break
        least = r["level"]
    if least is None:
        return {}
    return {bytes(r["token"]): r["n"] for r in own.where(level >= least).toLocalIterator()}


def _ranges(tokens: DataFrame, code: Code, n_rows: int, n_tokens: int) -> Ranges:
    n = -(-n_rows // RANGE)
    if n <= 1:
        return Ranges([])
    share = min(1.0, 64 * n / n_rows)
    some = tokens.where(F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.mapInArrow(_coded(code, np.empty(0)), "token binary, n long, code binary, part int")
    ranges, depths = Ranges.choose(sorted(int.from_bytes(r["code"], "big") for r in some.select("code").toLocalIterator()), n)
    points = ranges.points(depths)
    # One Python function a stage: a second one would double the workers that a node holds.
    counted = tokens.select("token", "n").mapInArrow(_sums(code, _bytes_of(points)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    between = np.zeros(len(points) + 1, np.int64)
    for r in counted.toLocalIterator():  # a row for each end and depth at most
        between[r["at"]] = r["n"]
    ranges.fill(depths, dict(zip(points, np.cumsum(between)[:-1].tolist())) | {0: 0, 1 << DEPTH: n_tokens})
    return ranges


def predict(tokens: DataFrame, model: Model, less: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Predictions of distinct tokens (token, n), of all that the ranges' sums cover and others with n = 0; less as in predictions()."""
    shared = tokens.sparkSession.sparkContext.broadcast((model.code, model.ranges, less))
    coded = tokens.mapInArrow(_coded(model.code, _bytes_of(model.ranges.ends)), "token binary, n long, code binary, part int")
    return materialize(coded.groupBy("part").applyInArrow(_predict(shared), PREDICTED), "predicted")


# Weights of the gates.


def _cell(gate: np.ndarray, near: np.ndarray, far: np.ndarray, word: np.ndarray, after: np.ndarray | int) -> np.ndarray:
    """Gate and levels (from 0, the earlier word's fine ones as unsigned) as one number."""
    return (((gate << 5 | near) << 5 | far) << 5 | word) << 8 | after


def inputs_of(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gates and inputs of cells."""
    x = [_LEVELS[cell >> shift & 31] for shift in (18, 13, 8)]
    return cell >> 23, np.stack([*x, _FINE[cell & 255]]).T.astype(float)


def _late_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of ranges' counts."""
    for b in batches:
        for one in b.column(0).to_pylist():
            m = len(one) // 12
            left, n = np.frombuffer(one, "<i4", m).astype(np.int64), np.frombuffer(one, "<i8", m, 4 * m)
            levels = []
            for _ in range(3):
                left, x = np.divmod(left, _N_LEVELS)
                levels.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(_cell(left, *levels[::-1], 0)), pa.array(n)], ["cell", "n"])


def _lead_cells(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, n) of (pair, n, lead): decisions of the first bytes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, near, far, after = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            pair, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            first, begin, p, each, d = _split(pair, code)
            once = np.frombuffer(b"".join(b.column(2).take(pa.array(first)).to_pylist()), np.uint8)
            levels = [t[s, p.bit].astype(np.int64) + SIDE for t, s in zip((near, far), p.slots())]
            gate = (once >> np.uint8(5)).astype(np.int64)
            h = after[after_slots(np.repeat(_NAME[pair >> 8 * REACH], each), p.inside()[d]), p.bit[d]].view(np.uint8).astype(np.int64)
            cell = _cell(gate, *levels, (once & np.uint8(31)).astype(np.int64), 0)[d] + h + np.where(h != 0, GATES << 23, 0)
            cell, total = _merged([cell], [np.repeat(n, each)])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total)], ["cell", "n"])

    return run


def cells(seen: DataFrame, predicted: DataFrame, model: Model, less: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Every decision of the training documents by gate and inputs: cell, n."""
    late = predicted.where("cells IS NOT NULL").select("cells").mapInArrow(_late_cells, "cell long, n long")
    leads = predicted.where("begin IS NOT NULL").groupBy("begin").agg(F.first("lead").alias("lead"))  # the same in each range
    shared = predicted.sparkSession.sparkContext.broadcast((model.code, *less, without_one(model.after, _FINE_SIDE)))
    rows = seen.withColumn("begin", F.col("pair").bitwiseAND((1 << 8 * REACH) - 1)).join(leads, "begin").select("pair", "n", "lead")
    lead = rows.mapInArrow(_lead_cells(shared), "cell long, n long")
    return materialize(late.unionByName(lead).groupBy("cell").agg(F.sum("n").alias("n")), "cells")


def _newton(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradient and curvature of the log likelihood per gate, summed over a task's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * GATES, INPUTS, INPUTS + 1))
        for b in batches:
            (gate, x), n = inputs_of(b.column(0).to_numpy()), b.column(1).to_numpy().astype(float)
            for g in set(gate.tolist()):
                y, m = x[gate == g], n[gate == g]
                q = 1 / (1 + np.exp(np.clip(y @ weights[g], -30, 30)))  # chance given to the other bit
                total[g, :, 0] += (m * q) @ y
                total[g, :, 1:] += (y * (m * q * (1 - q))[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def learn_weights(table: DataFrame) -> np.ndarray:
    """Weights of the gates from all cells, a written table."""
    start = np.tile(np.array(START), (2 * GATES, 1))
    weights = start.copy()
    for _ in range(STEPS):
        total = np.zeros((2 * GATES, INPUTS, INPUTS + 1))
        for r in table.mapInArrow(_newton(weights), "sums binary").toLocalIterator():  # a row for each task over a table of bounded size
            total += np.frombuffer(r["sums"], float).reshape(total.shape)
        for g in range(2 * GATES):
            grad = total[g, :, 0] - PRIOR * (weights[g] - start[g])
            weights[g] += np.clip(np.linalg.solve(total[g, :, 1:] + PRIOR * np.eye(INPUTS), grad), -0.5, 0.5)
    return weights


def fit(blocks: DataFrame) -> LanguageModel:
    """Learn from the training documents of encoded blocks."""
    tokens = materialize(vocabulary(blocks), "tokens")
    total = tokens.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.count("*")).first()
    n_tokens, n_distinct = int(total[0] or 0), int(total[1])
    chars = np.zeros(256, np.int64)
    for r in tokens.mapInArrow(_count_bytes, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        chars[r["byte"]] = r["n"]
    code = Code.of(chars)
    head = _head(tokens)
    common = {t: i + 1 for i, t in enumerate(sorted((t for t in head if t != END), key=lambda t: (-head[t], t))[:COMMON])}
    seen = pairs(blocks, common)
    near, far, after = tables_of([tokens.mapInArrow(_fill(code), TABLE_SCHEMA), seen.mapInArrow(_fill_after(code), TABLE_SCHEMA)])
    model = Model(code, near, far, after, _ranges(tokens, code, int(total[2]), n_tokens), common)
    less = without_one(near, SIDE), without_one(far, SIDE)
    predicted = predict(tokens, model, less)
    release(tokens)
    table = cells(seen, predicted, model, less)
    release(seen)
    model.weights = learn_weights(table)
    release(table)
    return LanguageModel(model, predicted.select("token", "n"), predicted, n_tokens, n_distinct)


# Scores.


@dataclass
class Late:
    """Decisions beyond the first REACH bytes of tokens, which depend on the token alone: per token the loss of the sure
    ones and the number of others; per other decision the mix and its gate."""

    sure: np.ndarray
    each: np.ndarray
    alone: np.ndarray
    gate: np.ndarray


@dataclass
class Mixer:
    """Scores documents given as numbers of tokens with known predictions."""

    code: Code
    #: Levels of the predictions for bit 1 per slot.
    near: np.ndarray
    far: np.ndarray
    after: np.ndarray
    weights: np.ndarray
    step: float

    @classmethod
    def of(cls, m: Model) -> Mixer:
        def for_one(t: np.ndarray) -> np.ndarray:
            return _rounded(np.where(t.sum(axis=1) > 0, logistic(t[:, 1], t[:, 0]), 0), _FINE_SIDE)

        return cls(m.code, for_one(m.near), for_one(m.far), for_one(m.after), m.weights.astype(np.float32), STEP)

    def _mixes(self, p: Paths, packed: np.ndarray, beyond: bool) -> tuple[np.ndarray, ...]:
        """The gate of each decision, its mix without the earlier word, and (beyond) its mix beside that word; the bit as a sign."""
        word, gate = unpacked(packed)
        right = p.bit.astype(np.float32) * 2 - 1
        x = [*[_FINE.take(t[s].view(np.uint8)) * right for t, s in zip((self.near, self.far), p.slots())], word]

        def mix(kind: np.ndarray) -> np.ndarray:
            return sum(self.weights[:, i].take(kind) * x[i] for i in range(3))

        return gate, mix(gate), mix(gate + GATES) if beyond else None, right

    def _late(self, tokens: list[bytes], packed: list[bytes]) -> tuple[np.ndarray, ...]:
        p = Paths.of(tokens, self.code, skip=REACH)
        gate, alone, _, _ = self._mixes(p, _spread(packed, decisions(tokens, self.code) - p.each, p.each), False)
        other = np.abs(alone) < SURE
        loss = np.log(1 + np.exp(-np.clip(alone, -12, 12)))
        loss[other] = 0
        ends = np.cumsum(p.each)
        sums, others = (np.append(0, np.cumsum(v, dtype=t)) for v, t in ((loss, np.float64), (other, np.int64)))
        return sums[ends] - sums[ends - p.each], others[ends] - others[ends - p.each], alone[other], gate[other]

    def late(self, tokens: list[bytes], packed: list[bytes]) -> Late:
        """What the tokens bring to any document beyond their first bytes."""
        made = [self._late(tokens[i : i + PIECE], packed[i : i + PIECE]) for i in range(0, len(tokens), PIECE)]
        return Late(*map(np.concatenate, zip(*made))) if made else Late(*(np.empty(0, t) for t in (np.float64, np.int64, np.float32, np.uint8)))

    def leads(self, tokens: list[bytes], packed: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of the first bytes of tokens the number of decisions; per decision its gate, its mix without and beside the
        earlier word, that word's weight, the hash of the word so far, and the bit as a sign."""
        p = Paths.of(tokens, self.code, REACH)
        gate, alone, beside, right = self._mixes(p, _spread(packed, 0, p.each), True)
        return p.each, gate, alone, beside, self.weights[:, 3].take(gate + GATES), p.inside(), right

    def _spoken(self, leads: tuple[np.ndarray, ...], begin: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per token the number of its pair of a beginning (a row of leads) and an earlier word; of each distinct pair how many
        decisions it has; per decision of these the mix, what the earlier word says, and the gate. No pair is mixed twice."""
        lead, gate, alone, beside, pull, inside, sign = leads
        pair = pa.array(ctx * len(lead) + begin).dictionary_encode()
        context, row = np.divmod(pair.dictionary.to_numpy(), len(lead))
        each, first, made = lead[row], np.cumsum(lead) - lead, []
        for i in range(0, len(row), 16 * PIECE):
            n = each[i : i + 16 * PIECE]
            d = _runs(first[row[i : i + 16 * PIECE]], n)
            said = _FINE.take(self.after[after_slots(np.repeat(_NAME[context[i : i + 16 * PIECE]], n), inside[d])].view(np.uint8)) * sign[d]
            some = said != 0
            made.append((np.where(some, beside[d] + pull[d] * said, alone[d]), said, gate[d] + some * np.uint8(GATES)))
        return pair.indices.to_numpy().astype(np.int64), each, *map(np.concatenate, zip(*made))

    def _refine(self, state: tuple[np.ndarray, ...], losses: np.ndarray, i: np.ndarray, stop: np.ndarray, open_end: bool, t: np.ndarray, h: np.ndarray, k: np.ndarray) -> None:
        """Add the losses of documents' decisions i to stop: a block of each document at a time, after which its state is refined.

        t, h and k are the mixes, what earlier words say, and the gates. With open_end the last document goes on.
        """
        scale, more, block = state
        while len(live := np.flatnonzero(i < stop)):
            n = np.minimum(block[live], stop[live] - i[live])
            over = i[live] + n == stop[live]
            over[-1:] &= not (open_end and live[-1] == len(i) - 1)
            order = np.argsort(over, kind="stable")  # after its last block a document needs no refinement
            live, n = live[order], n[order]
            stretch = [slice(a, b) for a, b in zip(i[live].tolist(), (i[live] + n).tolist())]
            tt, hh, kk = (np.concatenate([x[s] for s in stretch]) for x in (t, h, k))
            kk = kk.astype(np.intp)
            kk += np.repeat(live * (2 * GATES), n)
            y, pull = scale.take(kk), more.take(kk)
            y *= tt
            pull *= hh
            y += pull
            np.clip(y, -12, 12, out=y)
            np.exp(np.negative(y, out=y), out=y)
            one = np.add(y, 1, out=pull)
            if go_on := len(n) - int(over.sum()):
                own = slice(0, int(n[:go_on].sum()))
                miss = y[own]
                miss /= one[own]  # chance given to the other bit
                step = np.zeros((len(scale), 1))
                step[live[:go_on], 0] = self.step / n[:go_on]
                for kept, x in ((scale, tt), (more, hh)):
                    up = np.bincount(kk[own], np.multiply(miss, x[own], out=x[own]), kept.size)
                    kept += (step * up.reshape(kept.shape)).astype(np.float32)
            losses[live] += np.add.reduceat(np.log(one, out=one), np.cumsum(n) - n, dtype=np.float64)
            i[live] += n
            block[live] = np.minimum(2 * block[live], LAST)

    def logs(self, late: Late, leads: tuple[np.ndarray, ...], begin: np.ndarray, common: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each document, given as numbers of tokens; begin has each token's row of leads.

        The documents of a slice are refined side by side: a block of decisions of each at a time.
        """
        ctx, ends = earlier(common, at, sizes), np.cumsum(sizes)
        losses = np.add.reduceat(late.sure[at], ends - sizes) if len(at) else np.empty(0)
        long = np.flatnonzero(sizes > SLICE)
        s = doc = base = top = 0
        left = None  # of a document that goes on in the next slice
        while s < len(at):
            if ends[doc] - s > SLICE:
                e = s + SLICE
            else:  # whole documents, up to the next one that is longer than a slice
                until = min([int(np.searchsorted(ends, s + SIDE_BY_SIDE, side="right")), *long[long > doc][:1].tolist()])
                e = int(ends[max(doc, until - 1)])
            if e > top:
                base, top = s, min(max(e, s + SPAN), len(at))
                pair, each, *spoken = self._spoken(leads, begin[at[base:top]], ctx[base:top])
                each = np.append(late.each, each)
                t, h, k = (np.concatenate(x) for x in zip((late.alone, np.zeros(len(late.alone), np.float32), late.gate), spoken))
                both = t + 1j * h  # side by side, as they are read together
                first = np.cumsum(each) - each
            # The first bytes and the rest of each token in turn.
            own = np.stack([len(late.each) + pair[s - base : e - base], at[s:e]], axis=1).ravel()
            n = each[own]
            done = np.append(0, np.cumsum(n))
            where = _runs(first[own], n)
            own = both.take(where)
            last = int(np.searchsorted(ends, e, side="left")) + 1
            i, stop = done[2 * np.maximum(ends[doc:last] - sizes[doc:last] - s, 0)], done[2 * (np.minimum(ends[doc:last], e) - s)]
            open_end = int(ends[last - 1]) > e
            state = np.ones((last - doc, 2 * GATES), np.float32), np.zeros((last - doc, 2 * GATES), np.float32), np.full(last - doc, FIRST)
            if left is not None:
                for kept, x in zip(state, left):
                    kept[0] = x
            self._refine(state, losses[doc:last], i, stop, open_end, own.real, own.imag, k.take(where))
            left = tuple(x[-1].copy() for x in state) if open_end else None
            s, doc = e, last - open_end
        return -losses / math.log(10)


@dataclass
class Head:
    """The tokens that are broadcast, made ready once for all blocks."""

    place: dict[bytes, int]
    n: np.ndarray
    late: Late
    lead: dict[int, bytes]  # packed predictions of the first bytes, per beginning
    common: np.ndarray  # numbers of the common words, 0 for others

    @classmethod
    def of(cls, rows: Iterator[tuple[bytes, int, bytes]], mixer: Mixer, common: dict[bytes, int]) -> Head:
        tokens, n, packed = map(list, zip(*rows)) if (rows := list(rows)) else ([], [], [])
        # No beginning has more than REACH * 255 decisions.
        lead = dict(zip(beginnings(tokens).tolist(), [p[: REACH * 255] for p in packed]))
        return cls({t: i for i, t in enumerate(tokens)}, np.array(n, np.int64), mixer.late(tokens, packed), lead, np.array([common.get(t, 0) for t in tokens], np.int64))


def _requests(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, number, token) of the tokens of blocks that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value[1].place
        for b in batches:
            for block, tokens in zip(b.column(0).to_pylist(), b.column(1)):
                names = _full(tokens.as_py()).split(b" ")
                rare = [i for i, t in enumerate(names) if t not in head]
                cols = [pa.array(np.full(len(rare), block, np.int64)), pa.array(rare, pa.int32()), pa.array([names[i] for i in rare], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "number", "token"])

    return run


SCORED = "doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long"


def _placed(number: np.ndarray, own: Late, known: np.ndarray, place: np.ndarray, head: Late) -> Late:
    """Of a block's tokens: own at their numbers, and those known by their places in the head."""
    sure, each, start = np.empty(len(number) + len(known)), *np.empty((2, len(number) + len(known)), np.int64)
    sure[number], each[number], start[number] = own.sure, own.each, np.cumsum(own.each) - own.each
    sure[known], each[known], start[known] = head.sure[place], head.each[place], (np.cumsum(head.each) - head.each)[place] + len(own.alone)
    where = _runs(start, each)
    return Late(sure, each, np.concatenate([own.alone, head.alone]).take(where), np.concatenate([own.gate, head.gate]).take(where))


def _score(shared) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block with the predictions of its tokens that are not broadcast."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        mixer, head = shared.value
        row = block.to_pylist()[0]
        tokens, at, sizes = _block(row)
        place = np.fromiter(map(head.place.get, tokens, repeat(-1)), np.int64, len(tokens))
        number, packed = found.column("number").to_numpy(), values(found.column("own"))
        count, common = np.zeros((2, len(tokens)), np.int64)
        count[number] = found.column("n").to_numpy()
        known = np.flatnonzero(place >= 0)
        count[known], common[known] = head.n[place[known]], head.common[place[known]]  # the common words are among the head's
        late = _placed(number, mixer.late([tokens[i] for i in number.tolist()], packed), known, place[known], head.late)
        starts, first, own = np.unique(beginnings(tokens), return_index=True, return_inverse=True)
        rare = dict(zip(number.tolist(), packed))
        leads = mixer.leads(_begun(starts), [head.lead.get(b) or rare[i] for b, i in zip(starts.tolist(), first.tolist())])
        gain, begin = np.log10(count + 1.0)[at], np.cumsum(sizes) - sizes
        cols = {
            "doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(sizes), "n_known": pa.array(np.add.reduceat((count > 0)[at].astype(np.int64), begin)),
            "base": pa.array(np.add.reduceat(gain, begin)),
            "score": pa.array(mixer.logs(late, leads, own, common, at, sizes)),
            "n_bytes": pa.array(row["n_bytes"], pa.int64()),
        }
        return pa.table(cols)

    return run


def score(blocks: DataFrame, lm: LanguageModel, own: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document of the blocks.

    own says that lm was fitted on these blocks, so that it has predictions of all their tokens.
    """
    sc, m = blocks.sparkSession.sparkContext, lm.model
    predicted = lm.predicted
    if not own:
        others = blocks.select("tokens", "counts").mapInArrow(_tokens, "token binary, n long").select("token", F.lit(0).cast("long").alias("n"))
        predicted = predict(lm.tokens.unionByName(others).groupBy("token").agg(F.sum("n").alias("n")), m)
    least = _head(lm.tokens)
    known = predicted.where(F.col("n") >= min(least.values())) if least else predicted.limit(0)
    mixer = Mixer.of(m)
    head = Head.of([(bytes(r["token"]), r["n"], bytes(r["own"])) for r in known.select("token", "n", "own").toLocalIterator()], mixer, m.common)  # at most HEAD rows
    shared = sc.broadcast((mixer, head))  # tables and HEAD tokens of a fixed size
    asked = blocks.select("block", "tokens").mapInArrow(_requests(shared), "block long, number int, token binary")
    found = asked.join(predicted.select("token", "n", "own").hint("shuffle_hash"), "token").select("block", "number", "n", "own")
    # A task gets a block or two, while there are not very many.
    n_blocks = blocks.count()
    parts = max(1, min(n_blocks, max(20_000, n_blocks // 16)))
    texts = blocks.select("block", "ids", "sizes", "n_bytes", "at", "tokens").repartition(parts, "block")
    scored = texts.groupBy("block").cogroup(found.repartition(parts, "block").groupBy("block")).applyInArrow(_score(shared), SCORED)
    divisor = math.log10(lm.n_tokens + lm.n_distinct + 1)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(lm.n_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * divisor).alias("base_score"),
        "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 7) == 2
    blocks = encode(read(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train")))
    scored = score(blocks, fit(blocks), own=True)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
