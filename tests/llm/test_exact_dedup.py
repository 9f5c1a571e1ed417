import hashlib
import random
import re

from skein.llm import exact_dedup as e

from .conftest import EDGES


def brute(rows):
    norm = [hashlib.sha256(re.sub(r"[ \t-\r]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    groups = {}
    for (i, _), h in zip(rows, norm):
        groups.setdefault(h, []).append(i)
    out = []
    for (i, _), h in zip(rows, norm):
        keep = min((x for x in groups[h] if x is not None), default=None)
        out.append((i, keep, len(groups[h]), i == keep, h))
    return sorted(out, key=str)


def test_groups_match_brute_force(make):
    rows = [*EDGES, (7, "one"), (8, "a  b"), (9, "a\tb"), (10, "a b "), (11, " "), (12, "hot")] + [(i, "hot") for i in range(100, 200)]
    got = sorted(map(tuple, e.dedup(make([(i, t) for i, t in rows])).collect()), key=str)
    assert got == brute(rows)
    assert e.dedup(make([])).count() == 0


def test_filter_inserts_deletes_and_grows():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    b = e.Bucket()
    for i, k in enumerate(keys):
        b.insert(k, 1, i, 1)
    assert b.resized and all(k in b.filter for k in keys) and len(b.keys) == 5000
    random.Random(1).shuffle(keys)
    for k in keys[:4000]:
        b.delete(k, 1, 1)
    assert all(k in b.filter for k in keys[4000:]) and len(b.keys) == 1000
    assert sum(k in b.filter for k in keys[:4000]) < 40  # false positives only
    again = e.CuckooFilter(b.filter.n_cells, b.filter.to_bytes())
    assert again.cells == b.filter.cells


def test_a_false_positive_is_verified():
    b = e.Bucket()
    one = bytes(32)
    other = b"\1" * 8 + bytes(24)  # same fingerprint and cell, another digest
    b.insert(one, 1, 5, 1)
    assert other in b.filter
    b.insert(other, 1, 6, 1)
    assert b.keys[one, 1] == [5, 1, False] and b.keys[other, 1] == [6, 1, False]
    b.delete(other, 1, 1)
    assert one in b.filter and (one, 1) in b.keys


def test_index_lives_on(spark, make):
    first = e.digests(make([(1, "a"), (2, "b"), (3, "a")]))
    index = e.CuckooIndex.build(first, 3).insert(e.digests(make([(4, "b"), (5, "c")])))
    live = {r["keep_id"]: r["group_size"] for r in index.keys().collect()}
    assert live == {1: 2, 2: 2, 5: 1}
    index = index.delete(e.digests(make([(5, "c"), (4, "b"), (9, "unknown"), (9, "a"), (1, "b")])))  # the last three are not live
    assert {r["keep_id"]: r["group_size"] for r in index.keys().collect()} == {1: 2, 2: 1}
    asked = {r["doc_id"]: r["keep_id"] for r in index.resolve(e.digests(make([(7, "a"), (8, "c")]))).collect()}
    assert asked == {7: 1, 8: None}


def test_a_deleted_keeper_has_an_heir(make):
    rows = [(1, "a"), (2, "a"), (2, "a"), (7, "a"), (3, "b"), (None, "b"), (4, "c"), (6, "c"), (5, None), (8, "")]
    index = e.CuckooIndex.build(e.digests(make(rows)), len(rows))
    index = index.delete(e.digests(make([(1, "a"), (2, "a"), (3, "b"), (6, "c"), (5, "")])))
    assert sorted(((r["keep_id"], r["group_size"]) for r in index.keys().collect()), key=str) == [(2, 2), (4, 1), (8, 1), (None, 1)]
    index = index.delete(e.digests(make([(2, "a"), (2, "a"), (None, "b")])))  # one copy of 2 is live
    assert sorted((r["keep_id"], r["group_size"]) for r in index.keys().collect()) == [(4, 1), (7, 1), (8, 1)]
