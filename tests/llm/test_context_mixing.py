"""Language-model scores against counts and chances made one decision at a time."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import context_mixing as c

from .conftest import EDGES
from .test_models import ENGLISH, prose


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def tokens(text):
    return [x.encode() for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x] + [b""]


class Brute:
    """The model with dictionaries: contexts are the bytes themselves, so it has no slots and no collisions."""

    def __init__(self, train, lm):
        self.m, self.m_common = lm.model, lm.model.common
        self.near, self.far, self.word, self.after = (defaultdict(lambda: [0, 0]) for _ in range(4))
        for d in train:
            for w, ctx in self.walk(d):
                for bit, keys in w:
                    for t, k in zip((self.near, self.far, self.word), keys):
                        t[k][bit] += 1
                    if keys[3]:
                        self.after[ctx, keys[2]][bit] += 1

    def walk(self, doc):
        """Per token its decisions as (bit, contexts) and the earlier common word."""
        ctx = 0
        for t in doc:
            out, path = [], b""
            for i, byte in enumerate(t + b" "):
                at, n = self.m.code.start[byte], self.m.code.length[byte]
                for j in range(at, at + n):
                    node, so_far = self.m.code.node[j], t[:i]
                    # Places before the token are no bytes; their number tells them from a zero byte.
                    out.append((int(self.m.code.bit[j]), ((so_far[-3:], node), (so_far[-5:], node), (so_far, node), i < c.REACH)))
            yield out, ctx
            ctx = self.m_common.get(t, ctx)

    def score(self, doc):
        w, scale, more = self.m.weights.astype(np.float32), np.ones(12), np.zeros(12)
        size, total, block = c.FIRST, 0.0, []

        def close():
            nonlocal scale, more, size, block
            ga, gb = np.zeros(12), np.zeros(12)
            for k, t, h, miss in block:
                ga[k] += miss * t
                gb[k] += miss * h
            scale, more = scale + c.STEP * ga / len(block), more + c.STEP * gb / len(block)
            size, block = min(2 * size, c.LAST), []

        for decisions, ctx in self.walk(doc):
            for depth, (bit, keys) in enumerate(decisions):
                def says(n):
                    return float(np.clip(math.log((n[bit] + 0.2) / (n[1 - bit] + 0.2)), -8, 8)) if sum(n) else 0.0

                word = self.word.get(keys[2], [0, 0]) if depth < c.DEPTH else [0, 0]
                x = says(word)
                x = math.copysign(8 * (round(15 * math.sqrt(abs(x) / 8)) / 15) ** 2, x)
                k = sum(sum(word) >= s for s in c.SEEN)
                h = says(self.after.get((ctx, keys[2]), [0, 0])) if keys[3] else 0.0
                k += 6 if h else 0
                t = w[k, 0] * says(self.near.get(keys[0], [0, 0])) + w[k, 1] * says(self.far.get(keys[1], [0, 0])) + w[k, 2] * x + w[k, 3] * h
                if not keys[3] and abs(t) >= c.SURE:  # sure decisions are not refined
                    total += math.log10(1 + math.exp(-t))
                    continue
                y = min(12.0, max(-12.0, t * scale[k] + h * more[k]))
                total += math.log10(1 + math.exp(-y))
                block.append((k, t, h, 1 / (1 + math.exp(y))))
                if len(block) == size:
                    close()
        return -total


def fitted(make, rows, train=lambda i: fold(i, 7) != 2):
    docs = make(rows)
    blocks = c.encode(docs.select("doc_id", "text", F.lit(True).alias("train")).where(F.col("doc_id").isNull() | F.col("doc_id").isin([i for i, _ in rows if i is not None and train(i)])))
    return c.fit(blocks), docs


def scored(docs, lm):
    return c.score(c.encode(docs.select("doc_id", "text", F.lit(False).alias("train"))), lm).collect()


def test_base_and_score_match_brute_force(make, monkeypatch):
    """Base scores, counts and scores of every kind of document; the vocabulary in several ranges, most tokens by the join."""
    rng = random.Random(6)
    rows = [(i, prose(rng, ENGLISH, rng.randrange(0, 120)).title()) for i in range(150)]
    rows += [(1000 + i, "".join(rng.choice("zxqjkv") for _ in range(300))) for i in range(5)]
    rows += [(2000, None), (2001, ""), (2001, ""), (2002, "a\0b \0 \0"), (2003, "\0"), (2004, "the " * 3000), (2005, "https://" + "a/b" * 200)]
    monkeypatch.setattr(c, "HEAD", 40)
    monkeypatch.setattr(c, "RANGE", 60)
    lm, docs = fitted(make, rows)
    assert len(lm.model.ranges.ends) > 3
    train = [tokens(t) for i, t in rows if fold(i, 7) != 2]
    count = Counter(x for t in train for x in t)
    n, v = sum(count.values()), len(count)
    assert (lm.n_tokens, lm.n_distinct) == (n, v)
    got = scored(docs, lm)
    assert len(got) == len(rows)
    text, brute = dict(rows), Brute(train, lm)
    for r in got:
        own = tokens(text[r["doc_id"]])
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(count[x] > 0 for x in own) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own), rel_tol=1e-9)
        # Slots may be shared, so the scores agree closely but not to the last digit.
        assert math.isclose(r["score"], brute.score(own), rel_tol=0.02, abs_tol=0.02), r
        assert math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / (len((text[r["doc_id"]] or "").encode()) + 1), rel_tol=1e-9)
    held = [r for r in got if fold(r["doc_id"], 7) == 2]
    usual = [r["bits_per_byte"] for r in held if r["doc_id"] < 200 and r["n_tokens"] > 20]
    odd = [r["bits_per_byte"] for r in got if 1000 <= r["doc_id"] < 2000 and fold(r["doc_id"], 7) == 2] or [9]
    assert max(usual) < 3 and max(usual) < min(odd)


def test_edges(make):
    lm, docs = fitted(make, EDGES)
    got = scored(docs, lm)
    assert len(got) == len(EDGES) and all(r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert scored(make([]), lm) == []
    none, _ = fitted(make, [])
    for r in scored(docs, none):
        assert r["base_score"] == 0 and r["n_known"] == 0 and r["score"] < 0


def test_counts_past_32_bits(spark):
    """Chunks of tables and counts along ways keep every unit of counts beyond 2^33."""
    big = [2**31, 2**33 + 1, 3]
    n = c._slots_of(0)
    chunks = [np.full(n, b, np.uint64) for b in big]
    import pyarrow as pa

    table = pa.table({"chunk": pa.array([0] * 3, pa.int32()), "part": pa.array([0] * 3, pa.int32()), "counts": pa.array([c._narrow(x) for x in chunks], pa.binary())})
    assert (c._wide(c._add(table).column("counts")[0].as_py(), n) == sum(big)).all()
    code = c.Code.of(np.ones(256))
    p = c.Paths.of([b"a", b"ab"], code)
    order = np.argsort(c._code_column(p.codes()))
    ways = c.path_counts(p.codes()[order], p.each[order], np.array(big[:2])[order], None, None)
    assert ways[0] == 2**31 + 2**33 + 1 and set(ways[[int(p.each[order][0]), -1]].tolist()) == set(big[:2])


@pytest.mark.parametrize("width", [1, 7, 50])
def test_ways_do_not_depend_on_ranges(width):
    """Counts along the ways are those of a plain count of beginnings, however the vocabulary is cut."""
    rng = random.Random(width)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))).encode() for _ in range(300)} | {b"", b"ab" * 90, b"ab" * 90 + b"c"})
    code = c.Code.of(np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256))
    p = c.Paths.of(words, code)
    codes, n = p.codes(), np.array([rng.randrange(0, 5) for _ in words])
    bits = ["".join(map(str, p.bit[s : s + e])) for s, e in zip(np.cumsum(p.each) - p.each, p.each)]
    count = Counter()
    for b, k in zip(bits, n.tolist()):
        for d in range(len(b) + 1):
            count[b[:d]] += k
    column = c._code_column(codes)
    order = np.argsort(column)
    ints = [int.from_bytes(codes[i].tobytes(), "big") for i in order]
    ranges, depths = c.Ranges.choose(ints[::2], max(1, len(words) // width))
    points = ranges.points(depths)
    ranges.fill(depths, {x: sum(int(n[i]) for i, v in zip(order, ints) if v < x) for x in points} | {0: 0, 1 << c.DEPTH: int(n.sum())})
    part = np.searchsorted(c._bytes_of(ranges.ends), column[order], side="right") if ranges.ends else np.zeros(len(words), int)
    for k in set(part.tolist()):
        own = order[part == k]
        before = (ranges.ends[k - 1], ranges.before[k - 1]) if k else None
        behind = (ranges.ends[k], ranges.behind[k]) if k < len(ranges.ends) else None
        ways = c.path_counts(codes[own], p.each[own], n[own], before, behind)
        at = 0
        for i in own:
            got = ways[at : at + p.each[i] + 1].tolist()
            want = [count[bits[i][:d]] for d in range(len(bits[i]) + 1)]
            assert got[: c.DEPTH + 1] == want[: c.DEPTH + 1] or len(want) > c.DEPTH, words[i]
            at += p.each[i] + 1


def test_decisions_are_a_probability(make):
    """Over all bytes that may come next in a word, the chances sum to the chance so far."""
    lm, _ = fitted(make, [(i, "the theme then a thaw") for i in range(20)], lambda i: True)
    mixer = c.Mixer.of(lm.model)

    def chance(raw):
        """Of a beginning, which is not closed: its own decisions only."""
        p = c.Paths.of([raw], mixer.code, len(raw))
        word = np.array([0])
        total = 1.0
        brute = Brute([tokens("the theme then a thaw")] * 20, lm)
        (walk, _), = brute.walk([raw])
        for bit, keys in walk[: len(p.bit)]:
            counts = brute.word.get(keys[2], [0, 0])
            x = c.unpacked(c._packed(np.array([counts[bit]]), np.array([sum(counts)])))
            y = c.unpacked(c._packed(np.array([counts[1 - bit]]), np.array([sum(counts)])))
            assert x[0] == -y[0] and x[1] == y[1] and word[0] == 0
            total *= 1 / (1 + math.exp(-float(x[0][0])))
        return total

    for so_far in (b"th", b"zq", b"the"):
        assert math.isclose(chance(so_far), sum(chance(so_far + bytes([s])) for s in range(256)), rel_tol=1e-4)


def test_weights_are_learned_and_refined(make, monkeypatch):
    rng = random.Random(0)
    lm, _ = fitted(make, [(i, prose(rng, ENGLISH, 200)) for i in range(30)], lambda i: True)
    assert np.abs(lm.model.weights - np.array(c.START)).max() > 0.1
    docs = make([(1, prose(rng, ["xy", "zz", "qu"], 300)), (2, prose(rng, ["xy", "zz"], 12))])
    refined = {r["doc_id"]: r["score"] for r in scored(docs, lm)}
    monkeypatch.setattr(c, "STEP", 0.0)
    fixed = {r["doc_id"]: r["score"] for r in scored(docs, lm)}
    assert refined[1] > fixed[1] and refined[2] != fixed[2]  # short documents are refined as well


def test_the_order_of_words_changes_the_score(make):
    """Words that always came in one order score better so than in another; before, within a block, all orders scored alike."""
    rng = random.Random(2)
    follows = {w: x for w, x in zip(["kat", "hond", "vis", "geit"], ["zit", "blaft", "loert", "mekt"])}
    train = [" ".join(f"{w} {follows[w]}" for w in rng.choices(list(follows), k=40)) for _ in range(200)]
    lm, _ = fitted(make, list(enumerate(train)), lambda i: True)
    pairs = rng.choices(list(follows), k=20)
    usual = " ".join(f"{w} {follows[w]}" for w in pairs)
    mixed = " ".join([*pairs, *[follows[w] for w in pairs]])
    got = {r["doc_id"]: r["score"] for r in scored(make([(1, usual), (2, mixed)]), lm)}
    assert got[1] > got[2] + 5


def test_weights_are_learned_from_every_occurrence(make, monkeypatch):
    """The weights are those of Newton steps over all decisions of all training documents, also of documents that a sample would leave out."""
    monkeypatch.setattr(c, "FIT_ROWS", 200, raising=False)
    monkeypatch.setattr(c, "FIT_TOKENS", 60, raising=False)
    monkeypatch.setattr(c, "RANGE", 100)
    rng = random.Random(3)
    rows = [(i, prose(rng, ENGLISH, 60)) for i in range(60)] + [(100 + i, " ".join(f"the {i}{rng.randrange(30)}xq" for _ in range(40))) for i in range(20)]
    lm, _ = fitted(make, rows, lambda i: True)
    assert len(lm.model.ranges.ends) > 1
    train = [tokens(t) for _, t in rows]
    brute, start = Brute(train, lm), np.array(c.START)

    def level(x, side):
        return math.copysign(8 * (round(side * math.sqrt(abs(x) / 8)) / side) ** 2, x)

    def less(n, bit):
        right, wrong = n[bit] - 1, n[1 - bit]
        return min(8, max(-8, math.log((right + 0.2) / (wrong + 0.2)))) if right + wrong else 0.0

    inputs = [[] for _ in range(12)]
    for d in train:
        for walk, ctx in brute.walk(d):
            for bit, keys in walk:
                word = brute.word[keys[2]]
                x = [level(less(t[k], bit), 15) for t, k in ((brute.near, keys[0]), (brute.far, keys[1]))]
                right = word[bit] - 1
                x.append(level(min(8, max(-8, math.log((right + 0.2) / (word[1 - bit] + 0.2)))), 15))
                x.append(level(less(brute.after[ctx, keys[2]], bit), 127) if keys[3] else 0.0)
                inputs[sum(sum(word) - 1 >= s for s in c.SEEN) + (6 if x[3] else 0)].append(x)
    want = np.tile(start, (12, 1))
    for g, own in enumerate(inputs):
        y = np.array(own).reshape(-1, 4)
        for _ in range(c.STEPS):
            q = 1 / (1 + np.exp(y @ want[g]))
            curve = (y * (q * (1 - q))[:, None]).T @ y + c.PRIOR * np.eye(4)
            want[g] += np.clip(np.linalg.solve(curve, q @ y - c.PRIOR * (want[g] - start)), -0.5, 0.5)
    assert np.abs(want - start).max() > 0.3
    # Inputs are nearly equal in some gates, and slots may be shared, so sums of weights and losses are compared.
    assert np.abs((lm.model.weights - want).sum(axis=1)).max() < 0.05

    def loss(w):
        return sum(np.log1p(np.exp(-np.array(own).reshape(-1, 4) @ w[g])).sum() for g, own in enumerate(inputs))

    assert loss(lm.model.weights) < 1.001 * loss(want)


def in_one_block(lm, docs, rare=()):
    """Scores of documents in one block, made here; tokens in rare are asked for, the others are the head."""
    import pyarrow as pa
    from types import SimpleNamespace

    known = {bytes(r["token"]): (r["n"], bytes(r["own"])) for r in lm.predicted.collect()}
    mixer = c.Mixer.of(lm.model)
    head = c.Head.of([(t, *x) for t, x in known.items() if t not in rare], mixer, lm.model.common)
    block = c.encode(docs.select("doc_id", "text", F.lit(True).alias("train")).coalesce(1)).toArrow()
    names = c._full(block.column("tokens")[0].as_py()).split(b" ")
    asked = [(i, *known[t]) for i, t in enumerate(names) if t in rare]
    found = pa.table({k: pa.array([a[i] for a in asked], t) for i, (k, t) in enumerate({"number": pa.int32(), "n": pa.int64(), "own": pa.binary()}.items())})
    got = c._score(SimpleNamespace(value=(mixer, head)))(block, found)
    return dict(zip(got.column("doc_id").to_pylist(), got.column("score").to_pylist()))


def test_no_pair_is_mixed_twice_in_a_block(make, monkeypatch):
    """However often a text stands in a block, the first bytes of its words are mixed once for each earlier word, and what tokens of the head bring is not made again."""
    lm, docs = fitted(make, [(i, "the theme then a thaw") for i in range(50)], lambda i: True)
    mixed, made, slots, late = [], [], c.after_slots, c.Mixer.late
    monkeypatch.setattr(c, "after_slots", lambda names, inside: mixed.append(len(names)) or slots(names, inside))
    monkeypatch.setattr(c.Mixer, "late", lambda self, tokens, packed: made.append(tokens) or late(self, tokens, packed))
    got = in_one_block(lm, docs, {b"then"})
    once = sum(int(lm.model.code.length[b]) for t in tokens("the theme then a thaw") for b in (t + b" ")[: c.REACH])
    assert sum(mixed) == once
    assert sorted(made[0]) == sorted(t for t in set(tokens("the theme then a thaw")) if t != b"then") and made[1:] == [[b"then"]]
    assert len(got) == 50 and len(set(got.values())) == 1


def test_scores_do_not_depend_on_what_is_beside(make, monkeypatch):
    """Documents refined side by side, alone, and in slices score alike; so do tokens of the head and those asked for."""
    rng = random.Random(8)
    rows = [(i, prose(rng, ENGLISH, rng.choice([0, 3, 40, 400]))) for i in range(40)]
    rows[7:7] = [(100, prose(rng, ENGLISH, 900)), (101, "a " * 300), (102, None)]
    monkeypatch.setattr(c, "COMMON", 3)
    lm, docs = fitted(make, rows, lambda i: True)
    rare = {w for _, t in rows for w in tokens(t)[:3]} - lm.model.common.keys()  # the common words are always in the head
    assert len(rare) > 5
    monkeypatch.setattr(c, "SLICE", 256)
    want = in_one_block(lm, docs)
    for name, n in (("SIDE_BY_SIDE", 1), ("SIDE_BY_SIDE", 300), ("SPAN", 64)):
        monkeypatch.setattr(c, name, n)
        got = in_one_block(lm, docs, rare)
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_blocks_hold_the_words_of_every_text(make, monkeypatch):
    """Blocks give back each document's words by bytes: only ASCII case and white space count."""
    rng = random.Random(4)
    odd = [*" \t\n\v\f\r\0\x1c\x85\xa0AzÄß€", "\U0001f600"]
    rows = [(i, None if i % 9 == 0 else "".join(rng.choices(odd, k=rng.randrange(0, 40)))) for i in range(200)]
    monkeypatch.setattr(c, "BLOCK_BYTES", 300)
    blocks = [r.asDict() for r in c.encode(make(rows).select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("train"))).collect()]
    got, count, text = {}, Counter(), dict(rows)
    for b in blocks:
        names, at, sizes = c._block(b)
        ends = np.cumsum(sizes)
        for i, s, e, n in zip(b["ids"], ends - sizes, ends, b["n_bytes"]):
            got[i] = [names[k] for k in at[s:e]]
            assert n == len((text[i] or "").encode()) + 1
        for t, n in zip(names, np.frombuffer(c._full(b["counts"]), np.int64).tolist()):
            count[t] += n
    assert got == {i: [*c.words_of((t or "").encode()), b""] for i, t in rows}
    assert +count == Counter(w for i, words in got.items() if i % 2 == 0 for w in words)
