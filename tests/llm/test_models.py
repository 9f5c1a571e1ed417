"""Toxicity, language ID, quality, mixing and language-model operators."""

import math
import random
import re

import numpy as np

from skein.llm import langid, mixing, quality_model, toxicity

from .conftest import EDGES


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(n)) + "."


ENGLISH, FRENCH = ["th", "er", "on", "an", "re", "he"], ["ou", "é", "ai", "eau", "qu", "è"]


def test_toxicity_learns_words_and_stems(spark, make):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rng, ENGLISH, 40).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "zorgi" + rng.choice(["ab", "cd", "efg", "hij"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = make(rows)
    g = toxicity.fit(docs, spark.createDataFrame(labels[:300], "doc_id long, toxic int"))
    assert "blockhead" in g.exact and any("zorgi".startswith(x) or x.startswith("zorgi") for x in g.stems)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, g).collect()}
    assert all((got[i] >= 0.7) == bool(t) for i, t in labels[300:])
    assert got == {i: g.score(t) for i, t in rows}
    edges = toxicity.score(make(EDGES), g).collect()
    assert len(edges) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edges) and {r["score"] for r in edges if r["doc_id"] in (1, 2)} == {0.0}


def test_clause_grammar_composes():
    g = toxicity.Grammar(exact={"moron": 1.0})
    kinds = lambda t: [set(k) for _, k in g.clauses(t)]
    assert kinds("You are such a moron!") == [{"targeted"}] == kinds("moron, you.")
    assert kinds("It is a moron") == [{"insult"}]
    assert kinds("You are not a moron.") == [{"negated", "targeted"}]
    assert kinds("He said that you are a moron.") == [{"reported", "targeted"}]
    assert kinds("He said that you are not a moron.") == [{"reported", "negated", "targeted"}]
    assert kinds("never mind you are a moron") == [{"targeted"}]
    assert kinds("I will hurt you. Fine day.") == [{"threat"}]
    assert kinds("He said hello. A moron came.") == [{"insult"}]
    assert kinds("hurt feelings") == [] == kinds("The report said storms will burn the forest") and g.score(None) == 0.0
    assert g.score("You are a moron.") > g.score("a moron") > g.score("not a moron") > g.score("he said, not a moron")


def test_composed_machine_matches_brute_force():
    """The best path weighs what the scopes and distances say, word by word."""
    rng = random.Random(7)
    for _ in range(3000):
        read = [(x, rng.choice([0.3, 0.6, 0.9]) if x == "I" else 1.0) for x in rng.choices("oYNRTI", [5, 2, 1, 1, 2, 2], k=rng.randrange(1, 12))]
        at = [s for s, _ in read]
        want = 0.0
        for i, (x, own) in enumerate(read):
            if x in "IT":
                bound = "Y" in at[max(0, i - toxicity.REACH) : i] or "Y" in at[i + 1 : i + 1 + toxicity.BEHIND]
                w = own * (toxicity.PRIORS["negated"] if "N" in at[max(0, i - toxicity.NEGATED) : i] else 1) * (toxicity.PRIORS["reported"] if "R" in at[:i] else 1)
                kinds = (["insult"] if x == "I" else []) + ([{"I": "targeted", "T": "threat"}[x]] if bound else [])
                want = max([want, *[w * toxicity.PRIORS[k] for k in kinds]])
        assert abs(toxicity._MACHINE.best(read, toxicity.PRIORS)[0] - want) < 1e-12, read


def test_weights_come_from_labels(spark, make):
    got = toxicity.calibrated([(("targeted",), 1, 90, 90.0), (("targeted",), 0, 10, 10.0), (("negated", "targeted"), 0, 40, 40.0), (("negated", "targeted"), 1, 2, 1.0)])
    assert abs(got["targeted"] - (90 + 8 * 0.98) / 108) < 1e-12 and got["negated"] < 0.15 and got["insult"] == 0.95
    empty = toxicity.fit(make([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(make([]), empty).count() == 0
    ties = toxicity.Grammar(exact={"moron": 0.5, "idiot": 0.5})
    assert ties.score("moron idiot") == ties.score("moron") and ties.score("fine words " * 50_000 + "you moron") == ties.score("you moron")


def test_no_labels(spark, make):
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert not toxicity.fit(make(EDGES), empty).exact
    assert quality_model.classify(make(EDGES), empty).count() == len(EDGES)
    assert langid.identify(make(EDGES), langid.fit(make(EDGES))).where("lang_pred <> 'und'").count() == 0


def test_language_id(make):
    rng = random.Random(3)
    rows = [(i, prose(rng, (ENGLISH, FRENCH)[i % 2], 60), ("en", "fr")[i % 2]) for i in range(300)]
    model = langid.fit(make(rows[:200]))
    assert model.languages == ["en", "fr"] and (model.false_rate < 0.01).all()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(make(rows[200:]), model).collect()}
    assert all(got[i][0] == lang and 0.5 < got[i][1] <= 1 for i, _, lang in rows[200:])
    edges = {r["doc_id"]: r["lang_pred"] for r in langid.identify(make([*EDGES, (70, "12 34 !"), (71, "ЖЖЖ")]), model).collect()}
    assert edges[1] == edges[2] == edges[3] == edges[70] == "und" and edges[71] in ("en", "fr")
    assert langid.identify(make([]), model).count() == 0
    # Brute force: exact sets of n-grams instead of filters.
    known = {name: {g for _, t, lang in rows[:200] if lang == name for g in langid.grams(t).tolist()} for name in ("en", "fr")}
    for i, t, _ in rows[200:]:
        n = {name: sum(g in known[name] for g in langid.grams(t).tolist()) for name in known}
        best = max(sorted(n), key=lambda name: n[name])
        assert got[i][0] == best and abs(got[i][1] - n[best] / sum(n.values())) < 0.01


def test_letters_and_single_documents(make):
    model = langid.fit(make([(1, "hello world", "en"), (2, "bonjour le monde", "fr"), *[(10 + i, "good day to all", "en") for i in range(4)]]))
    asked = {1: "hello world", 2: "bonjour", 3: "½ ²", 4: "一二", 5: "12", 6: "ª", 7: "hello " * 50_000}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(make(list(asked.items())), model).collect()}
    assert got[1][0] == "en" == got[7][0] and got[2][0] == "fr" and got[3] == got[5] == ("und", 0.0)
    assert got[4] == got[6] == ("en", 0.0)  # letters without a known n-gram: the commonest language


def test_every_ngram_stays(make):
    """Far more n-grams than slots of the least size would hold well, of single documents."""
    rng = random.Random(8)
    texts = [" ".join("".join(chr(rng.randrange(97, 123)) for _ in range(6)) for _ in range(40_000)) for _ in range(2)]
    model = langid.fit(make([(1, texts[0], "aa"), (2, texts[1], "aa"), (3, "zz top", "zz")]))
    own = np.unique(np.concatenate([langid.grams(t) for t in texts]))
    assert len(own) > 150_000 and len(model.masks) >= langid.SLOTS_PER_GRAM * len(own)
    x, y = langid.places(own, len(model.masks))
    assert (model.masks[x] & model.masks[y] & np.uint64(1)).all() and model.false_rate[0] < 0.02


def test_bloom_masks_return_every_language():
    h = [np.arange(1, 2000, dtype=np.uint64) * langid._M[0], np.arange(1000, 3000, dtype=np.uint64) * langid._M[0]]
    f = langid.LanguageFilters.build({"a": h[0], "b": h[1]})
    for i, own in enumerate(h):
        x, y = langid.places(own)
        assert ((f.masks[x] & f.masks[y]) >> np.uint64(i) & np.uint64(1)).all()
    assert abs(f.hits(np.arange(10**6, 10**6 + 5000, dtype=np.uint64) * langid._M[1])).max() < 20


def test_quality_sites(spark, make):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        junk = i % 4 == 0
        text = prose(rng, ENGLISH, 60)
        if junk:
            text = " | ".join(text.split()) if i % 8 else text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", f"h{i % 7}"))
        labels.append((i, int(not junk)))
    got = {r["doc_id"]: r for r in quality_model.classify(make(rows), spark.createDataFrame(labels[:300], "doc_id long, quality int")).collect()}
    assert all(got[i]["kept"] == bool(ok) for i, ok in labels)
    for r in got.values():
        assert 0 < r["path_rate"] < 1 and 0 < r["posterior"] < 1
    sparse = rows + [(9000, prose(rng, ENGLISH, 60), None, None), (9001, None, "en", "new")]
    more = {r["doc_id"]: r for r in quality_model.classify(make(sparse), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(more) == len(sparse) and abs(more[9000]["host_rate"] - 0.75) < 0.1
    assert quality_model.classify(make([]), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_quality_matches_brute_force(spark, make):
    """Bins, weights and posteriors worked out row by row; held-out labels are met."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        junk = i % 3 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(60)) for _ in range(rng.randrange(5, 90))]
        rows.append((i, " ".join(w + "!!" if junk else w for w in words), "en", f"h{i % 4}"))
        labels.append((i, int(not junk)))
    lab = spark.createDataFrame(labels[:200], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_model.classify(make(rows), lab).collect()}

    def bins(text):
        w = text.split()
        n = max(1, len(w))
        v = {
            "symbols": sum(c in "#*$%&|<>" for c in text) / n, "capitals": sum(c.isupper() and c.isascii() for c in text) / max(1, len(text)),
            "bangs": text.count("!") / n, "repeats": 1 - len(set(w)) / n, "length": len(w),
        }
        return {k: sum(v[k] >= b for b in quality_model.BINS[k]) for k in v}

    total = [sum(q == y for _, q in labels[:200]) for y in (0, 1)]
    evidence = {}
    for i, text, *_ in rows:
        e = 0.0
        for k, b in bins(text).items():
            width = len(quality_model.BINS[k]) + 1
            share = [(sum(bins(rows[j][1])[k] == b for j, q in labels[:200] if q == y) + 2 / width) / (total[y] + 2) for y in (0, 1)]
            e += 0.7 * (math.log(share[1]) - math.log(share[0]))
        evidence[i] = e
        assert abs(got[i]["evidence"] - e) < 1e-9
    rate = (total[1] + 1) / 202
    own = {i: 1 / (1 + math.exp(-(e + math.log(rate / (1 - rate))))) for i, e in evidence.items()}
    base = sum(own.values()) / len(own)
    for i, r in got.items():
        logit = lambda p: math.log(p / (1 - p))
        site = max(-2.0, min(2.0, logit(r["path_rate"]) - logit(base)))
        assert abs(r["posterior"] - 1 / (1 + math.exp(-(logit(base) + site + evidence[i])))) < 1e-9
    for h in range(4):
        mean = np.mean([own[i] for i, *_ in rows if i % 4 == h])
        r = got[h]["host_rate"]
        assert min(mean, base) - 1e-9 <= r <= max(mean, base) + 1e-9  # between its own mean and the global one
    assert all(got[i]["kept"] == bool(q) for i, q in labels[200:])


def test_raking_meets_its_margins():
    rng = np.random.default_rng(0)
    cells = [(s, la, t) for s in "abc" for la in "xy" for t in "pq"]
    mass = rng.integers(1, 100, len(cells)).astype(float)
    goal = mixing.Targets({"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.5, "q": 0.5}}, rounds=200, tolerance=1e-12)
    w = mixing.rake(cells, mass, goal)
    for d, dim in enumerate(mixing.DIMENSIONS):
        for name, share in goal.shares[dim].items():
            assert abs(sum(x for c_, x in zip(cells, w) if c_[d] == name) - share) < 1e-9
    p = mixing.rates(w, mass, 0.5)
    assert (p <= 1).all() and abs((p * mass).sum() - 0.5 * mass.sum()) < 1e-6
    assert mixing.rates(np.array([0.9, 0.1]), np.array([1.0, 9.0]), 0.5).tolist() == [1.0, 4 / 9]


def test_mix_matches_brute_force(make):
    """Cells, raked weights and probabilities worked out with dictionaries, one group at a time."""
    rng = random.Random(21)
    rows = []
    for i in range(400):
        text = prose(rng, ENGLISH, rng.randrange(1, 500))
        text = [text, text.replace(" ", " | "), text + " licence", text + " a@b.c"][rng.randrange(4)]
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "b", "c"])))
    targets = mixing.Targets({"lang": {"en": 0.3, "absent": 0.4}}, sample=0.8)

    def cell(r):
        t = r[1]
        topic = "table" if " | " in t else "legal" if re.search("licen[sc]e|copyright", t.lower()) else "contact" if "@" in t else "note" if len(t) < 1200 else "article"
        return (r[3], r[2], topic)

    mass = {}
    for r in rows:
        mass[cell(r)] = mass.get(cell(r), 0) + len(r[1].split())
    total = sum(mass.values())
    w = {c: m / total for c, m in mass.items()}
    goals = []
    for d, named in enumerate(({}, {"en": 0.3, "absent": 0.4}, {})):
        have = {}
        for c, x in w.items():
            have[c[d]] = have.get(c[d], 0) + x
        given = {g: named[g] for g in have if g in named}
        free = {g: x**0.7 for g, x in have.items() if g not in named}
        goal = given | {g: (1 - sum(given.values())) * x / sum(free.values()) for g, x in free.items()}
        goals.append({g: x / sum(goal.values()) for g, x in goal.items()})
    for _ in range(targets.rounds):
        worst = 0.0
        for d, goal in enumerate(goals):
            have = {}
            for c, x in w.items():
                have[c[d]] = have.get(c[d], 0) + x
            worst = max(worst, max(abs(have[g] - goal[g]) for g in goal))
            w = {c: x * goal[c[d]] / have[c[d]] for c, x in w.items()}
        if worst < targets.tolerance:
            break
    w = {c: x / sum(w.values()) for c, x in w.items()}
    low, high = 0.0, 1e9  # the rate at which the sample has its size, by bisection
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(m, w[c] * rate) for c, m in mass.items()) < 0.8 * total else (low, rate)
    for r in mixing.mix(make(rows), targets).collect():
        c = (r["source"], r["lang"], r["topic"])
        assert c == cell(rows[r["doc_id"]])
        assert abs(r["weight"] - w[c]) < 1e-9 and abs(r["probability"] - min(1.0, w[c] * rate / mass[c])) < 1e-6


def test_mix_draws_by_probability(make, monkeypatch):
    rng = random.Random(9)
    rows = [(i, prose(rng, ENGLISH, rng.randrange(5, 400)), ("en", "fr", None)[i % 3], ("hot" if i % 3 else f"s{i % 5}")) for i in range(900)] + [(9001, None), (9002, "")]
    got = mixing.mix(make(rows)).collect()
    by_cell = {}
    for r in got:
        by_cell.setdefault((r["source"], r["lang"], r["topic"]), set()).add(r["probability"])
    assert all(len(p) == 1 for p in by_cell.values()) and len(got) == len(rows)
    total = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in got) - 0.6 * total) < 1e-6 * total
    assert abs(sum(r["n_tokens"] for r in got if r["selected"]) - 0.6 * total) < 0.05 * total
    assert {r["n_tokens"] for r in got if r["doc_id"] >= 9000} == {0}
    assert sorted(map(tuple, mixing.mix(make(rows)).collect()), key=str) == sorted(map(tuple, got), key=str)
    few = mixing.Targets({"lang": {"en": 0.5}}, rounds=3)
    small = mixing.mix(make(rows), few).collect()
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)  # the large-table form
    large = {r["doc_id"]: r for r in mixing.mix(make(rows), few).collect()}
    for r in small:
        assert abs(large[r["doc_id"]]["probability"] - r["probability"]) < 1e-9 and abs(large[r["doc_id"]]["weight"] - r["weight"]) < 1e-9
    # Targets for absent groups are spread alike, and cells fill up until none is over.
    odd = mixing.Targets({"topic": {"absent": 0.5}, "source": {"hot": 0.01}, "lang": {"en": 0.98, "fr": 0.01}}, rounds=4, sample=0.9)
    large = {r["doc_id"]: (r["weight"], r["probability"]) for r in mixing.mix(make(rows), odd).collect()}
    monkeypatch.undo()
    # Groups whose rows have no tokens use up no share, in both forms.
    empty = [(1, "", None, "x"), *[(10 + i, "word " * 9, None, s) for i, s in enumerate("yzzwwwww")]]
    bare = mixing.Targets({"source": {"x": 0.5, "y": 0.2}})
    shares = [dict(sorted({r["source"]: r["weight"] for r in mixing.mix(make(empty), bare).collect()}.items()))]
    monkeypatch.setattr(mixing, "MAX_CELLS", 1)
    shares.append(dict(sorted({r["source"]: r["weight"] for r in mixing.mix(make(empty), bare).collect()}.items())))
    monkeypatch.undo()
    assert list(shares[0]) == list(shares[1]) == ["w", "x", "y", "z"] and shares[0]["x"] == 0
    assert np.allclose(list(shares[0].values()), list(shares[1].values()), atol=1e-6) and abs(shares[0]["y"] - 0.2) < 1e-6
    cells = {}
    for r in mixing.mix(make(rows), odd).collect():
        assert np.allclose(large[r["doc_id"]], (r["weight"], r["probability"]), atol=1e-9)
        cells[r["source"], r["lang"], r["topic"]] = r["weight"]
    assert abs(sum(cells.values()) - 1) < 1e-9
    assert mixing.mix(make([])).count() == 0


def test_every_language_is_known(make):
    """More than 64 languages, and rare ones beside a common one, keep their names."""
    rng = random.Random(4)
    letters = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(8)] for i in range(70)}
    rows = [(i, prose(rng, letters[name], 40), name) for i, name in enumerate([*letters, *letters])]
    rows += [(1000 + i, prose(rng, letters["l69"], 40), "l69") for i in range(300)]
    rows.append((5000, "ωψχ φυτ σρπ ωψχφ", "once"))
    model = langid.fit(make(rows), max_rows=60)
    assert model.languages == [*letters, "once"] and model.commonest == "l69"
    asked = [(i, prose(rng, letters[name], 40), name) for i, name in enumerate(letters)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(make([*asked, (900, "ωψχ φυτ"), (901, "ЖЖЖ")]), model).collect()}
    assert [name for i, _, name in asked if got[i] != name] == []
    assert got[900] == "once" and got[901] == "l69"
