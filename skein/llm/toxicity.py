"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon reads a word and writes a symbol: insult (I), threat (T), target (Y),
negation (N), reported speech (R), other (o). Insult words and stems are learned
from labels with a weight; targets, threats, negations and reporting verbs are
closed classes given as parameters. Five weighted transducers over symbols are
composed into one machine:

* negation: N opens a scope of NEGATED words, in which I and T weigh less;
* report: R opens a scope to the clause's end, in which I and T weigh less;
* target: an I with a Y up to REACH words before, or up to BEHIND after it, is
  written as a bound insult (B), a T so placed as a threat at a target (H); a T
  without a target is nothing;
* insult: takes one I or B of the clause, by the weights of its two patterns;
* threat: takes one H, by its weight.

Arcs carry weights, and composition multiplies them, so a negated report of a
bound insult has all three factors. A clause's chance is its best path, with one
event, times the lexicon's weight of the insult word on it. A document is toxic
unless none of its clauses is: 1 - prod(1 - chance). The weights of the patterns
and of the two scopes are learned from the labels of the documents whose clauses
take them.

Learning takes at most about MAX_FIT_ROWS labelled rows, chosen by a hash of the
id whatever the size of the table. An entry needs a significant share of toxic
documents, at least LEAST_G2 and LEAST_ODDS; all that have it stay, so the model's
size is bounded by the rows learned from (the README gives the number in use).
Labels, language, source and ids are no inputs.

Defined cases: a null or empty text matches nothing and scores 0; a very long
text is read whole; without labelled toxic rows the lexicon is empty and only
threats score; of equally good paths (ties) the score is the same, and the one
with fewer scopes is counted; repeated rows score alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, fold, read

REMEMBERED = 50_000
MAX_FIT_ROWS = 30_000
STEMS = range(4, 8)
#: A lexicon entry needs this log-likelihood ratio and this log-odds.
LEAST_G2, LEAST_ODDS = 20.0, 2.5

TARGETS = frozenset("you your yours youre u he she they them him her his their du dich dir euch ihr sie vous toi te tu vos votre tus ustedes usted eres".split())
THREATS = frozenset("kill hurt destroy punch stab shoot burn beat hang murder töten schlagen tuer frapper matar golpear".split())
NEGATIONS = frozenset("not no never isnt arent wasnt dont doesnt didnt cannot nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says say called calls reported reports quoted claims claimed wrote according sagte sagt dit disait dijo dice".split())

_WORD = re.compile(r"\w+")
_CLAUSE = re.compile(r"[.!?;:\n]+")

#: Weights of patterns and scopes before calibration.
PRIORS = {"insult": 0.95, "targeted": 0.98, "threat": 0.9, "negated": 0.4, "reported": 0.5}
#: Words that a negation reaches, words between a target and what follows it, and before it.
NEGATED, REACH, BEHIND = 3, 5, 3
LONGEST = max(NEGATED, REACH, BEHIND)

State = Hashable
#: (next state, symbol written, names of the weights that the arc multiplies)
Arc = tuple[State, str, tuple[str, ...]]


@dataclass
class Transducer:
    """arcs(state, symbol) lists what may be done on reading a symbol; ending in final accepts."""

    start: State
    arcs: Callable[[State, str], list[Arc]]
    final: Callable[[State], bool]

    def then(self, o: Transducer) -> Transducer:
        """The composition: o reads what this one writes."""

        def arcs(state: State, symbol: str) -> list[Arc]:
            a, b = state
            return [((x, y), out, (*w, *v)) for x, middle, w in self.arcs(a, symbol) for y, out, v in o.arcs(b, middle)]

        return Transducer((self.start, o.start), arcs, lambda s: self.final(s[0]) and o.final(s[1]))


def _negation() -> Transducer:
    def arcs(left: int, x: str) -> list[Arc]:
        if x == "N":
            return [(NEGATED, "o", ())]
        return [(max(0, left - 1), x, ("negated",) if left and x in "IT" else ())]

    return Transducer(0, arcs, lambda s: True)


def _report() -> Transducer:
    def arcs(on: bool, x: str) -> list[Arc]:
        return [(True, "o", ())] if x == "R" else [(on, x, ("reported",) if on and x in "IT" else ())]

    return Transducer(False, arcs, lambda s: True)


def _target() -> Transducer:
    """States: (words for which the last target still binds, what waits for a target, words for which it waits)."""

    def arcs(state: tuple[int, str, int], x: str) -> list[Arc]:
        near, waits, left = state
        less = (max(0, near - 1), waits if left > 1 else "", max(0, left - 1))
        if x == "Y":
            return [((REACH, "", 0), {"I": "B", "T": "H"}.get(waits, "o"), ())]
        if x == "I":
            bound = [(less, "B", ())] if near else []
            return [*bound, (less, "I", ()), ((less[0], "I", BEHIND), "o", ())]
        if x == "T":
            return [(less, "H", ()) if near else (less, "o", ()), ((less[0], "T", BEHIND), "o", ())]
        return [(less, "o", ())]

    return Transducer((0, "", 0), arcs, lambda s: not s[1])


def _insult() -> Transducer:
    """Takes one insult, or leaves the event to the threats."""

    def arcs(done: bool, x: str) -> list[Arc]:
        skip = [(done, "H" if x == "H" else "o", ())]
        if done or x not in "IB":
            return skip
        return [(True, "!", ("targeted" if x == "B" else "insult",)), *skip]

    return Transducer(False, arcs, lambda s: True)


def _threat() -> Transducer:
    """One event in all: one that was taken before, or a threat at a target."""

    def arcs(done: bool, x: str) -> list[Arc]:
        if x == "!":
            return [] if done else [(True, "!", ())]
        skip = [(done, "o", ())]
        return [(True, "!", ("threat",)), *skip] if x == "H" and not done else skip

    return Transducer(False, arcs, bool)


class Machine:
    """The composition, its arcs tabled as they are met, and best paths through it."""

    def __init__(self) -> None:
        self.whole = _negation().then(_report()).then(_target()).then(_insult()).then(_threat())
        self.known: dict[tuple[State, str], list[Arc]] = {}

    def arcs(self, state: State, symbol: str) -> list[Arc]:
        key = (state, symbol)
        if (out := self.known.get(key)) is None:
            out = self.known[key] = self.whole.arcs(state, symbol)
        return out

    def best(self, read: Sequence[tuple[str, float]], weights: dict[str, float]) -> tuple[float, tuple[str, ...]]:
        """Weight and named weights of the best accepting path over (symbol, lexicon weight); (0, ()) without one.

        The weight of a word counts where its arc is the event's, or waits for a target to become it.
        """
        now: dict[State, tuple[float, int, tuple[str, ...]]] = {self.whole.start: (1.0, 0, ())}
        for symbol, own in read:
            after: dict[State, tuple[float, int, tuple[str, ...]]] = {}
            for state, (w, few, names) in now.items():
                for nxt, out, more in self.arcs(state, symbol):
                    # A scope counts only for the word that the event takes.
                    takes = symbol in "IT" and (out == "!" or (_waiting(nxt) and not _taken(nxt)))
                    used = more if takes else tuple(m for m in more if m not in ("negated", "reported"))
                    v = w * own if takes else w
                    for m in used:
                        v *= weights[m]
                    got = (v, few - len(used), names + used)
                    if nxt not in after or got[:2] > after[nxt][:2]:
                        after[nxt] = got
            now = after
        ends = [v for s, v in now.items() if self.whole.final(s)]
        w, _, names = max(ends, key=lambda v: v[:2], default=(0.0, 0, ()))
        return w, names


def _waiting(state: State) -> bool:
    """Whether a word has just begun to wait for a target."""
    return state[0][0][1][2] == BEHIND


def _taken(state: State) -> bool:
    return state[1] or state[0][1]


_MACHINE = Machine()


@dataclass
class Grammar:
    """The lexicon (exact words, and stems as their beginnings) and the weights of patterns and scopes."""

    exact: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIORS))
    #: Best paths of clauses met before, at most REMEMBERED.
    met: dict[tuple, tuple[float, tuple[str, ...]]] = field(default_factory=dict)

    def best(self, read: tuple[tuple[str, float], ...]) -> tuple[float, tuple[str, ...]]:
        if (out := self.met.get(read)) is None:
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            out = self.met[read] = _MACHINE.best(read, self.weights)
        return out

    def insult(self, word: str) -> float:
        if w := self.exact.get(word):
            return w
        for n in STEMS:
            if len(word) >= n and (w := self.stems.get(word[:n])):
                return w
        return 0.0

    def symbol(self, word: str) -> tuple[str, float]:
        if w := self.insult(word):
            return "I", w
        for symbol, words in (("Y", TARGETS), ("N", NEGATIONS), ("T", THREATS), ("R", REPORTS)):
            if word in words:
                return symbol, 1.0
        return "o", 1.0

    def clauses(self, text: str | None) -> list[tuple[float, tuple[str, ...]]]:
        """Chance and named weights of the best path of each clause that has one."""
        if not text:
            return []
        low = text.lower()
        vocabulary = set(_WORD.findall(low))
        if not any(self.insult(w) for w in vocabulary) and not vocabulary & THREATS:
            return []
        out = []
        for clause in _CLAUSE.split(low):
            read, idle = [], 0
            for w in _WORD.findall(clause):
                own = self.symbol(w)
                idle = idle + 1 if own[0] == "o" else 0
                if idle <= LONGEST:  # no scope and no target reaches further
                    read.append(own)
            if any(s in "IT" for s, _ in read):
                chance, names = self.best(tuple(read))
                if names:
                    out.append((chance, names))
        return out

    def score(self, text: str | None) -> float:
        clean = 1.0
        for chance, _ in self.clauses(text):
            clean *= 1 - chance
        return 1 - clean


def features(text: str) -> set[str]:
    """Words of a text, and beginnings marked by a star."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w)
        for n in STEMS:
            if len(w) > n:
                out.add(w[:n] + "*")
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents per feature of a task, given out whenever the table grows large."""
    seen = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        keys = list(seen[1].keys() | seen[0].keys())
        cols = [pa.array([c[k] for k in keys], pa.int64()) for c in (seen[1], seen[0])]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *cols], ["feature", "toxic", "clean"])

    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen[label].update(features(text))
        if len(seen[0]) + len(seen[1]) > 400_000:
            yield out()
    yield out()


def _weigh(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    """Per weights on the path of a document's strongest clause and label: documents, and the sum of the lexicon's weights."""
    got: dict[tuple[str, int], list[float]] = {}
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if paths := grammar.clauses(text):
                chance, names = max(paths)
                row = got.setdefault((" ".join(names), label), [0, 0.0])
                row[0] += 1
                row[1] += chance / math.prod(grammar.weights[x] for x in names)
    rows = list(got.items())
    cols = [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32())]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.float64())], ["pattern", "label", "n", "own"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Grammar:
    """Learn from texts (doc_id, text) and labels (doc_id, toxic 0 or 1)."""
    spark = docs.sparkSession
    known = bounded(labels.where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")), max_rows)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic").persist()
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad:
        rows.unpersist()
        return Grammar()
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    ea, eb = (a + b) * bad / (bad + good), (a + b) * good / (bad + good)
    g2 = 2 * (a * F.log(a / ea) + F.when(b > 0, b * F.log(b / eb)).otherwise(0.0))
    odds = F.log(((a + 0.5) / (bad + 1)) / ((b + 0.5) / (good + 1)))
    found = (
        rows.mapInArrow(_count, "feature string, toxic long, clean long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic > 0").withColumn("g2", g2).where((F.col("g2") >= LEAST_G2) & (odds >= LEAST_ODDS))
        .orderBy(F.desc("g2"), "feature").collect()
    )
    g = Grammar()
    for r in found:
        w = (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1) * (1 - math.exp(-r["g2"] / 6))
        if r["feature"].endswith("*"):
            g.stems[r["feature"][:-1]] = w
        else:
            g.exact[r["feature"]] = w
    # Patterns and scopes weigh what the labels say of the documents whose strongest clause takes them.
    shared = spark.sparkContext.broadcast(g)  # bounded by the rows learned from
    seen = rows.mapInArrow(lambda x: _weigh(x, shared.value), "pattern string, label int, n long, own double").groupBy("pattern", "label").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).collect()
    rows.unpersist()
    g.met.clear()
    g.weights = calibrated([(tuple(r["pattern"].split()), r["label"], r["n"], r["own"]) for r in seen])  # a row per set of weights
    return g


def calibrated(seen: list[tuple[tuple[str, ...], int, int, float]]) -> dict[str, float]:
    """Weights from (names on the path, label, documents, sum of the lexicon's weights): the toxic documents
    over those that the rest of the path would have, for patterns where no scope is on it, for a scope where it is alone."""
    out = dict(PRIORS)
    scopes = ("negated", "reported")
    for name in [*(x for x in PRIORS if x not in scopes), *scopes]:
        want, toxic = 8.0, 8 * PRIORS[name]
        for names, label, n, own in seen:
            if name in names and all(x == name or x not in scopes for x in names):
                want += own * math.prod(out[x] for x in names if x != name)
                toxic += n * label
        out[name] = min(1.0, toxic / want)
    return out


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score and the matched clauses per pattern of every row (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            got = [own.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 3) == 1
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    grammar = fit(docs, labels)
    return score(docs, grammar).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
