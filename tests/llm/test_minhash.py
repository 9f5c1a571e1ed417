import random
import re

from skein.llm import minhash as m

from .conftest import EDGES


def sets(rows, k):
    out = []
    for _, t in rows:
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, k, percent=80):
    s, n = sets(rows, k), len(rows)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                up[max(root(i), root(j), key=lambda x: rows[x][0])] = min(root(i), root(j), key=lambda x: rows[x][0])
    return {(rows[i][0], len(s[i]), rows[root(i)][0], rows[root(i)][0] == rows[i][0]) for i in range(n)}


def noisy(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def test_components_match_brute_force(make):
    """A dense group of near copies, many of them below the threshold, chains, copies and short texts."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(1000 + i, noisy(rng, base, rng.randrange(9))) for i in range(120)]
    chain = [f"c{i}" for i in range(140)]
    rows += [(i, " ".join(chain[4 * i : 4 * i + 80])) for i in range(12)]
    rows += [(50, "A b c"), (51, "a B C"), (52, "a b"), (53, None), (54, ""), (55, " "), (56, "same text of six words here"), (57, "same text of six words here")]
    for k in (4, 5):
        got = {tuple(r) for r in m.near_dedup(make(rows), k).collect()}
        assert got == brute(rows, k)


def test_edges(make):
    got = m.near_dedup(make(EDGES)).collect()
    assert len(got) == len(EDGES) and all(r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert m.near_dedup(make([])).count() == 0


def test_star_rounds(spark):
    rng = random.Random(2)
    ids = list(range(300))
    links = [(i, i + 1) for i in range(0, 100)] + [(rng.randrange(150, 300), rng.randrange(150, 300)) for _ in range(120)]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {(i, root(i)) for ab in links if ab[0] != ab[1] for i in ab}
    assert {tuple(r) for r in m.components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_ids_may_repeat_or_be_null(make):
    """Rows that share an id are linked by their texts only; groups without an id are kept."""
    a, b, c_ = ("a1 a2 a3 a4 a5 a6 a7 a8 a9", "b1 b2 b3 b4 b5 b6 b7 b8 b9", "c1 c2 c3 c4 c5 c6 c7 c8 c9")
    rows = [(1, a), (5, b), (5, a), (None, c_), (None, c_), (7, b), (9, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in m.near_dedup(make(rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (5, 5, True), (5, 1, False), (None, None, True), (None, None, True), (7, 5, False), (9, 9, True)], key=str)
