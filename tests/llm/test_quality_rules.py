import re

from skein.llm import quality_rules as q

from .conftest import EDGES


def brute(text):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for i, t in enumerate(tri):
        seen.setdefault(t, []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(make):
    texts = [t for _, t in EDGES] + ["a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "a b c d a b c e b c d", "#1 *2 <p> | $", "a b c d e f g " * 9]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in q.measure(make(rows)).collect()}
    for i, t in rows:
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), t


def test_policies_and_ablations(make):
    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(1, clean), (2, "short"), (3, "again and again " * 40), (4, clean + " ###" * 30), (5, clean.upper()), (6, "###"), (7, None)]
    led = q.ledger(make(rows)).cache()
    kept = {v: {r["doc_id"] for r in q.apply_policy(led, m).where("kept").collect()} for v, m in q.POLICIES.items()}
    assert kept == {"v1": {1, 4, 5}, "v2": {1, 5}}
    got = {r["rule"]: r for r in q.ablations(led, q.POLICIES["v2"]).collect()}
    bits = {r["doc_id"]: r["fail_bits"] for r in led.collect()}
    for rule in q.rules():
        assert got[rule.name]["failed"] == sum(bool(b & rule.mask) for b in bits.values())
        assert got[rule.name]["kept_without"] == sum(not b & ~rule.mask for b in bits.values())
        assert got[rule.name]["only_by_it"] == sum(b == rule.mask for b in bits.values())


def test_ablations_of_every_policy(make):
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, "short"), (3, "again and again " * 40), (4, "A B C # " * 30)]
    led = q.ledger(make(rows)).cache()
    both = sorted(tuple(r) for r in q.ablations_of(led, q.POLICIES).collect())
    assert both == sorted((v, *r) for v, m in q.POLICIES.items() for r in q.ablations(led, m).collect())
    assert [r.name for r in q.rules()] == q.RULE_NAMES


def test_empty_and_repeated(make):
    assert q.ledger(make([])).count() == 0
    assert q.ledger(make(EDGES)).count() == len(EDGES)
