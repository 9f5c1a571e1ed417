"""Prefix keys, reuse distances and resident prefixes against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import prefixes, scans

from .test_scans import ranges  # noqa: F401


def requests(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "id int, j string").select("id", F.parse_json("j").alias("request"))


def test_equal_prefixes_whatever_their_json(spark):
    tool = {"name": "a", "input_schema": {"x": 1, "y": {"b": 2, "a": 1.50}}}
    turned = {"input_schema": {"y": {"a": 1.5, "b": 2}, "x": 1}, "name": "a"}
    said = {"type": "text", "text": 'say "cache_control":{} é'}
    marked = {**said, "cache_control": {"type": "ephemeral", "ttl": "1h"}}
    rows = [
        (1, {"tools": [tool], "system": "be brief", "messages": [{"role": "user", "content": [said]}, {"role": "assistant", "content": "yes"}]}),
        (2, {"messages": [{"content": [marked], "role": "user"}, {"role": "assistant", "content": "no"}], "system": [{"text": "be brief", "type": "text"}], "tools": [turned]}),
        (3, {"tools": [tool], "messages": [{"role": "assistant", "content": [said]}]}),
        (4, {"messages": "none"}), (5, {}),
    ]
    blocks = prefixes.content_blocks(requests(spark, rows), "id", "request")
    got = {(r["id"], r["place"]): r["prefix_key"] for r in prefixes.prefix_keys(blocks, "id", "place", "block").collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1)]
    assert all(got[1, i] == got[2, i] for i in range(3)) and got[1, 3] != got[2, 3]
    assert got[3, 0] == got[1, 0] and got[3, 1] != got[1, 1] and len(set(got.values())) == 6
    assert all(len(k) == 64 for k in got.values())


@pytest.mark.parametrize("bits", [1, 4])
def test_greater_before(ranges, monkeypatch, bits):  # noqa: F811
    monkeypatch.setattr(scans, "DIGIT_BITS", bits)
    rng = random.Random(bits)
    n = 300
    values = [rng.randrange(64) for _ in range(n)]
    df = ranges.createDataFrame([(i, v) for i, v in enumerate(values)], "at long, v long")
    got = {r["at"]: r["g"] for r in scans.greater_before(df, "at", "v", 64, "g").collect()}
    assert got == {i: sum(values[j] > values[i] for j in range(i)) for i in range(n)}


def test_distances_and_resident_prefixes(ranges):  # noqa: F811
    """A hot key with a third of all accesses, others of every frequency."""
    rng = random.Random(4)
    rows = []
    for call in range(150):
        key = ""
        for place in range(rng.randint(1, 6)):
            key += rng.choice("aaab" if place else "aaaaabc")
            rows.append((call, place, key))
    df = ranges.createDataFrame(rows, "call int, place int, key string")
    dist = prefixes.reuse_distances(df, "key", "call", "place").cache()
    last, want = {}, {}
    for t, (call, place, key) in enumerate(rows):
        want[call, place] = len({k for _, _, k in rows[last[key] + 1 : t]}) if key in last else None
        last[key] = t
    assert {(r["call"], r["place"]): r["distance"] for r in dist.collect()} == want
    for capacity in (1, 5, 40):
        resident = {}
        for call, place, _ in rows:
            ok = want[call, place] is not None and want[call, place] < capacity
            n, open_ = resident.get(call, (0, True))
            resident[call] = (n + (open_ and ok), open_ and ok)
        got = {r["call"]: r["resident"] for r in prefixes.resident_prefix(dist, "call", "place", capacity).collect()}
        assert got == {c: n for c, (n, _) in resident.items()}


def test_nothing(spark):
    none = spark.createDataFrame([], "call int, place int, key string")
    assert prefixes.prefix_keys(none, "call", "place", "key").collect() == []
    assert prefixes.reuse_distances(none, "key", "call", "place").collect() == []
