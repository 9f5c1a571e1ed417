import hashlib
import random

import numpy as np
import pytest

from skein.llm import pieces as p

from .conftest import EDGES

ALPHABET = "  ▁\n\t　abcdefghth ing<>0xstéß漢字\x00\U0001f600ﬁ́ـ،क्ष"


@pytest.fixture(scope="module")
def encoder():
    return p.PieceEncoder(p.model_path())


def ids(encoder, text):
    return np.frombuffer(encoder(text), "i").tolist()


def test_equal_to_the_library(encoder):
    rng = random.Random(0)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(5000)]
    texts += ["<s> </s> <unk> <0x41>", " " * 100, "a" * 3000, "ab" * 500 + " " * 40 + "x", "the" * 20_000, "internationalization " * 3, "no▁space▁ here"]
    for t in texts:
        assert ids(encoder, t) == encoder.model.encode(t), repr(t)


def test_backtracking_is_needed_and_right(encoder):
    """Somewhere the longest match does not fit the one before."""
    rng, greedy_differs = random.Random(1), 0
    for _ in range(3000):
        t = p.MARK + "".join(rng.choices("aeinorstlhd", k=12))
        got, at, greedy = encoder.walk(t), 0, []
        while at < len(t):
            n = max((k for k in range(1, 17) if t[at : at + k] in encoder.cost), default=1)
            greedy.append(t[at : at + n])
            at += n
        pieces = [encoder.piece[i] for i in got]
        assert pieces == encoder.merged(t)
        greedy_differs += pieces != greedy
    assert greedy_differs > 100


def test_memory_forgets_and_stays_right(encoder, monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 50)
    small = p.PieceEncoder(p.model_path())
    for k in range(3):
        for i in range(300):
            t = f"number {i} and {i * k}"
            assert ids(small, t) == encoder.model.encode(t)
    assert len(small.known) <= 50 and len(small.fits) <= 50


def test_documents(make, spark, encoder):
    rng = random.Random(2)
    rows = [*EDGES, (50, "z" * 300_000), *[(60 + i, "".join(rng.choices(ALPHABET, k=200))) for i in range(50)]]
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in p.encode(make(rows)).collect()), key=str)
    own = encoder.model
    assert got == sorted(((i, e := own.encode(t or ""), own.decode(e) if e else "") for i, t in rows), key=str)
    assert p.encode(make([])).collect() == []


def test_query_digests(spark, tmp_path, make, encoder):
    rows = [*EDGES, (9, "Some words, and naïve ones.")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        e = encoder.model.encode(t or "")
        want.append((i, len(e), sha(",".join(map(str, e))), sha(encoder.model.decode(e) if e else "")))
    assert sorted((tuple(r) for r in p.op13_sentencepiece(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
