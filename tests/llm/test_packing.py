import random
import zlib
from collections import Counter

import numpy as np

from skein.llm import packing as p

from .conftest import EDGES


def test_planner_uses_each_piece_once_and_fits():
    rng = random.Random(0)
    for cap, n in ((10, 40), (64, 500), (2048, 3000)):
        counts = Counter(min(cap, 1 + int(rng.expovariate(4 / cap))) for _ in range(n))
        plan = p.Planner(dict(counts), cap).plan()
        used = Counter()
        for lengths, k in plan:
            assert k > 0 and sum(lengths) <= cap
            for x in lengths:
                used[x] += k
        assert used == counts
        total = sum(x * c for x, c in counts.items())
        assert sum(k for _, k in plan) <= 1.05 * -(-total // cap) + 1


def test_planner_finds_exact_complements():
    assert sum(k for _, k in p.Planner({7: 3, 3: 3}, 10).plan()) == 3
    assert sum(k for _, k in p.Planner({4: 2, 3: 4}, 10).plan()) == 2  # 4 + 3 + 3
    assert sum(k for _, k in p.Planner({4: 1, 2: 3}, 10).plan()) == 1  # 4 + 2 + 2 + 2
    assert p.Planner({}, 10).plan() == []


def test_documents_round_trip(make):
    from tokenizers import Tokenizer

    rows = [*EDGES, (20, "it's 42 o'clock: <|endoftext|> naïve é x y\x1cz"), *[(30 + i, "some words here " * i) for i in range(40)]]
    out = p.pack_documents(make(rows)).collect()
    encode = Tokenizer.from_file(p.vocabulary_path()).encode
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in by_doc[i]]
        cut = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
        want = Counter((k, 2048 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut))
        n = sum(1 for j, _ in rows if j == i)
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == Counter({k: n * v for k, v in want.items()})
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_empty(make):
    assert p.pack_documents(make([])).count() == 0
