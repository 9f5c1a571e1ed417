import hashlib
import math
import random
import re
import zlib
from collections import Counter

from skein.llm import resampling as r

from .conftest import EDGES


def brute(rows, target, max_n, percent, min_words):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(f.encode()) % 10_000 for f in runs]

    made = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, bs in made for b in bs), Counter(b for x in target for b in features(x)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, n, bs in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, bs))
        out.append((i, n, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted(((x[0], *x[2:]) for x in out), key=str), [(x[0], x[4]) for x in drawn]


def test_brute_force(spark, make):
    rng = random.Random(0)
    words = ["alpha", "Beta", "gamma", "Ünï", "delta", "x9", "\U0001f600", "of"]
    rows = [*EDGES, *[(100 + i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)], *[(1000 + i, "copied text of a hot group " * 5) for i in range(150)]]
    rows += [(100, "the same id with another text " * 5), (None, "no id again " * 9)]
    target = ["Alpha beta, alpha!", None, "", "copied text"]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for max_n, percent, least in ((1, 10, 20), (2, 50, 3), (1, 100, 0)):
        got = r.resample(make(rows), aim, percent=percent, max_n=max_n, min_words=least).collect()
        every, drawn = brute(rows, target, max_n, percent, least)
        assert sorted([tuple(x)[:4] for x in got], key=str) == every
        ranked = sorted(((x["rank"], x["doc_id"], x["score"]) for x in got if x["rank"] is not None), key=lambda x: x[0])
        assert [x[0] for x in ranked] == list(range(1, len(drawn) + 1))
        assert [x[1:] for x in ranked] == drawn


def test_ranks_over_few_bins(spark, monkeypatch, make):
    """A bin of many scores, and a score of many rows."""
    monkeypatch.setattr(r, "BINS", 3)
    rng = random.Random(1)
    rows = [(i, rng.choice([-5, 0, 7, rng.randint(-10_000, 10_000)])) for i in range(2000)]
    df = r.materialize(spark.createDataFrame(rows, "doc_id long, score long"), "t")
    got = {x["doc_id"]: x["rank"] for x in r.rank_by_score(df, r.F.col("doc_id") % 3 != 0, 900, -10_000, 10_000).collect()}
    order = sorted((x for x in rows if x[0] % 3), key=lambda x: (-x[1], x[0]))[:900]
    assert len(got) == 2000 and {i: k for i, k in got.items() if k is not None} == {x[0]: k for k, x in enumerate(order, 1)}


def test_empty_tables(spark, make):
    none = make([])
    aim = spark.createDataFrame([], "text string")
    assert r.resample(none, aim).collect() == []
    (one,) = r.resample(make([(1, "word " * 30)]), aim, percent=100).collect()
    assert one["n_features"] == 30 and one["rank"] == 1
    (one,) = r.resample(make([(1, None)]), aim).collect()
    assert (one["n_features"], one["weight"], one["rank"]) == (0, 0, None)
