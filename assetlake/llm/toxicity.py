"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by a cascade of weighted transducers (``transducers``):

1. the lexicon maps a word to a class (insult, threat, target, negation,
   report, other) with a weight. Its insult arcs are words and word prefixes:
   fixed ones with a prior weight, and ones learned from labelled documents,
   weighted by a lower bound of their log odds; words of the other classes keep
   those;
2. negation weakens insults and threats of the next ``NEGATION_SCOPE`` words;
3. reported speech weakens them to the clause's end, and in the next clause
   after a colon or an opening quote;
4. a threat verb counts if a target follows it in the clause, else not at all:
   the machine guesses, and only right guesses are accepted;
5. an insult after another one of the clause counts by a factor of its own;
6. so does an insult with a target beside it (the word before, or one of the next
   two, again guessed), and one that is not addressed to anyone.

The factors of machines 2 to 6 (``Factors``) start from fixed values and are
learned: each pattern's share of a document's weight is an input of a logistic
regression whose coefficients are drawn to one common value; what a pattern's
coefficient has beyond that scales its factor. Patterns that labelled documents
do not show keep their first value.

Machines 2 to 6 are state tables that ``compose`` joins into one; a clause's
weight is that of the best path that it accepts, and clauses of weight 0 do not
match. Only whole clauses are scored: the same word counts by what stands around.

A document's features are the largest clause weight, the sum of the clauses'
weights and their number; a logistic function, fitted to the labelled
documents, turns them into a score. Labels are only ever used for learning.

Learning takes at most ``sample`` labelled documents (a documented bound, those
of the smallest hashed ids). When the score is calibrated, each document's own
label is taken out of the weights of its arcs. Near copies count once: of sample
documents that share one of ``MINIMA`` shingle minima the first is kept.

Defined cases: null and empty texts have no clause and get the score of that;
long texts are read whole; repeated document rows get a row each; of repeated
labels the highest counts; null labels are left out. A null id is held out.
Extra columns are ignored. Without labels of both kinds fixed values stand in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .transducers import Matcher, Transducer, compose

SAMPLE = 16_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
LEAST_WEIGHT = 1.0
PRIOR = 3.0
MINIMA = 4
NEGATION_SCOPE = 2
NEGATED = 0.4
REPORTED = 0.7
TARGETED = 1.25
THREAT = 2.0
FACTOR_RIDGE = 5.0
FACTOR_RANGE = (0.25, 4.0)
# Seed words of the lexicon.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown imbecile jerk fool filth vermin".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn hang crush tuer töten matar".split())
TARGETS = frozenset("you your yours u they them their he she him her people those these tu vous toi du ihr dich euch usted ustedes".split())
NEGATIONS = frozenset("not no never isn't aren't nobody nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says say wrote writes claimed claims called reported quoted according sagte schrieb dit écrit dijo escribió".split())
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+|, ")
_QUOTE = re.compile(r"[:\"“„«]\s*$")


# Classes of words: what the machines read and write.
OTHER, INSULT, THREATENING, TARGET, NEGATION, REPORT = CLASSES = ("other", "insult", "threat", "target", "negation", "report")
HOSTILE = (INSULT, THREATENING)


@dataclass(frozen=True)
class Factors:
    """What a hostile word counts by the pattern that it stands in."""

    plain: float = 1.0
    targeted: float = TARGETED
    piled: float = 1.0
    negated: float = NEGATED
    reported: float = REPORTED
    threat: float = THREAT


def negation(factor: float = NEGATED, scope: int = NEGATION_SCOPE) -> Transducer:
    """State n: the next n words are negated."""
    arcs = [(n, c, c, scope if c == NEGATION else max(n - 1, 0), factor if n and c in HOSTILE else 1.0) for n in range(scope + 1) for c in CLASSES]
    return Transducer(tuple(arcs), {"": 0}, frozenset(range(scope + 1)))


def reported_speech(factor: float = REPORTED) -> Transducer:
    """State 1: the rest is what someone else said."""
    arcs = [(n, c, c, 1 if c == REPORT else n, factor if n and c in HOSTILE else 1.0) for n in (0, 1) for c in CLASSES]
    return Transducer(tuple(arcs), {"plain": 0, "quoted": 1}, frozenset({0, 1}))


def threats(factor: float = THREAT) -> Transducer:
    """State 1: a threat waits for its target. A threat verb that none follows must be read as any other word."""
    arcs = [(n, c, c, 0 if c == TARGET else n, 1.0) for n in (0, 1) for c in CLASSES if c != THREATENING]
    arcs += [(0, THREATENING, OTHER, 0, 0.0), (1, THREATENING, OTHER, 1, 0.0), (0, THREATENING, THREATENING, 1, factor)]
    return Transducer(tuple(arcs), {"": 0}, frozenset({0}))


def piled(factor: float = 1.0) -> Transducer:
    """State 1: an insult stands before in the clause."""
    arcs = [(n, c, c, 1 if c == INSULT else n, factor if n and c == INSULT else 1.0) for n in (0, 1) for c in CLASSES]
    return Transducer(tuple(arcs), {"": 0}, frozenset({0, 1}))


def targets(factor: float = TARGETED, plain: float = 1.0) -> Transducer:
    """States: 0 nothing, 1 just after a target, 2 and 3 an insult that a target must follow within one or two words."""
    after = {0: 0, 1: 0, 3: 2}
    arcs = [(n, c, c, to, plain if c == INSULT else 1.0) for n, to in after.items() for c in CLASSES if c != TARGET]
    arcs += [(n, TARGET, TARGET, 1, 1.0) for n in range(4)]
    arcs += [(0, INSULT, INSULT, 3, factor), (1, INSULT, INSULT, 0, factor), (3, INSULT, INSULT, 2, factor)]
    return Transducer(tuple(arcs), {"": 0}, frozenset({0, 1}))


def clause_grammar(factors: Factors = Factors()) -> Transducer:
    """All machines in a row; its start states are ``plain`` and ``quoted``."""
    machine = compose(negation(factors.negated), reported_speech(factors.reported))
    for further in (threats(factors.threat), piled(factors.piled), targets(factors.targeted, factors.plain)):
        machine = compose(machine, further)
    return machine


@lru_cache(maxsize=64)
def matcher(factors: Factors) -> Matcher:
    return Matcher(clause_grammar(factors))


_FIXED = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREATENING, THREATS)) for w in words}


@dataclass(frozen=True)
class Arc:
    """Documents with the word or prefix that are labelled toxic and clean."""

    toxic: int
    clean: int


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Lower bound (two standard errors) of the log odds that the arc speaks for toxic."""
    toxic, clean = max(toxic, 0), max(clean, 0)
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1)) - 2 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


@dataclass
class Grammar:
    """Learned arcs, the labelled documents' numbers, and the calibration."""

    arcs: dict[str, Arc]
    n_toxic: int = 0
    n_clean: int = 0
    calibration: tuple[float, ...] = (-4.0, 0.8, 0.8, 0.0)
    factors: Factors = Factors()

    def insult(self, word: str, own: int | None = None) -> float:
        """Weight of the best insult arc of ``word``; ``own``: label to take out of the counts."""
        if word in _FIXED:
            return 0.0
        best = PRIOR if word in INSULTS else 0.0
        for key in (f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)):
            if arc := self.arcs.get(key):
                w = _log_odds(arc.toxic - (own == 1), arc.clean - (own == 0), self.n_toxic - (own == 1), self.n_clean - (own == 0))
                best = max(best, w if w >= LEAST_WEIGHT else 0.0)
        return best

    def hostile(self, text: str, own: int | None = None) -> Iterator[tuple[list[tuple[str, float]], str]]:
        """(classes and weights of the words, start state) of each clause with an insult or a threat."""
        low = text.lower()
        words = set(_WORD.findall(low))
        weights = {w: x for w in words if (x := self.insult(w, own))} if self.arcs else {w: PRIOR for w in words & INSULTS}
        if not weights and words.isdisjoint(THREATS):
            return
        quoted, at = False, 0
        for m in [*_CLAUSE.finditer(low), None]:
            clause = low[at : m.start()] if m else low[at:]
            read = [(INSULT, weights[w]) if w in weights else (_FIXED.get(w, OTHER), 1.0) for w in _WORD.findall(clause)]
            report = quoted or any(c == REPORT for c, _ in read)
            if any(c in HOSTILE for c, _ in read):
                # the weights of words that are no insult and no threat do not count
                yield [(c, x if c in HOSTILE else 0.0) for c, x in read], "quoted" if quoted else "plain"
            quoted = bool(m) and report and (":" in m[0] or bool(_QUOTE.search(clause)))
            at = m.end() if m else at

    def clauses(self, text: str, own: int | None = None) -> list[float]:
        """Weights of the matched clauses of a text."""
        machine = matcher(self.factors)
        return [w for read, start in self.hostile(text, own) if (w := machine.weight(read, start))]

    def patterns(self, text: str, own: int | None = None) -> list[float]:
        """The text's weight, and what of it each pattern of ``Factors`` holds; a word in two patterns is in both.

        The weight of a path is linear in each factor, so a pattern's part is what a slightly greater factor adds.
        """
        read = list(self.hostile(text, own))
        more = [replace(self.factors, **{f.name: getattr(self.factors, f.name) * (1 + 1e-6)}) for f in fields(Factors)]
        total, *changed = (sum(matcher(f).weight(r, start) or 0.0 for r, start in read) for f in (self.factors, *more))
        return [total, *(round((x - total) * 1e6, 3) for x in changed)]

    def score(self, text: str) -> float:
        """Probability-like score of a text, 0 to 1."""
        z = sum(c * x for c, x in zip(self.calibration, features(self.clauses(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(clauses: list[float]) -> tuple[float, ...]:
    """Constant, largest clause, sum and number of clauses (the last two in logarithms)."""
    return 1.0, max(clauses, default=0.0), math.log1p(sum(clauses)), math.log1p(len(clauses))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    c = np.zeros(x.shape[1])
    shrink = np.zeros(x.shape[1]) + ridge
    shrink[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * c)
        c += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in c)


def fitted_factors(first: Factors, parts: np.ndarray, y: np.ndarray) -> Factors:
    """Factors from the documents' ``Grammar.patterns`` under ``first`` and their labels."""
    total = parts[:, :1]
    shares = parts * np.where(total > 0, np.log1p(total) / np.maximum(total, 1e-9), 0.0)
    ridge = np.array([0.0, 0.1, *[FACTOR_RIDGE] * (parts.shape[1] - 1)])
    _, every, *beyond = _fit(np.hstack([np.ones_like(total), shares]), y, ridge)
    if every <= 0:
        return first
    scaled = [x * float(np.clip(1 + b / every, *FACTOR_RANGE)) for x, b in zip(astuple(first), beyond, strict=True)]
    return Factors(*scaled)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(divisor))


def _one_of_each(texts: DataFrame) -> DataFrame:
    """(toxic, text) of the sample without near copies of documents with smaller ids."""

    def minima(batches):
        a = np.random.default_rng(6).integers(1 << 31, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
        for batch in common.batches(batches):
            ids, keys = [], []
            for i, h, _, _ in common.hashed(batch["text"]):
                if len(h):
                    low = (common.similar_set(h) >> np.uint64(32)).astype(np.uint32)
                    with np.errstate(over="ignore"):
                        keys += [(j << 32) + int((low * a[j]).min()) for j in range(MINIMA)]
                    ids += [batch["doc_id"][i]] * MINIMA
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64())})

    keyed = common.materialize(texts.select("doc_id", "text").mapInArrow(minima, "doc_id long, key long"), "labelled-minima")
    firsts = common.materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-minima")
    copies = common.materialize(keyed.join(F.broadcast(firsts), "key").where("doc_id > first").select("doc_id").distinct(), "labelled-copies")
    return common.materialize(texts.join(F.broadcast(copies), "doc_id", "left_anti").select("toxic", "text"), "labelled-once")


def _specific(arcs: dict[str, Arc]) -> dict[str, Arc]:
    """Without the prefixes of which one longer arc explains nine tenths: they only add chance matches."""
    longest = {}
    for key, arc in arcs.items():
        for n in PREFIXES:
            if len(key) > n:
                longest[key[:n]] = max(longest.get(key[:n], 0), arc.toxic)
    return {k: a for k, a in arcs.items() if longest.get(k, 0) < 0.9 * a.toxic}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Fit the grammar to at most ``sample`` labelled documents of ``labels`` (doc_id, toxic)."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = common.materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    texts = _one_of_each(common.materialize(common.texts_of(docs).join(F.broadcast(chosen), "doc_id"), "labelled-texts"))

    def count(batches):
        for batch in common.batches(batches):
            toxic, clean = Counter(), Counter()
            for label, text in zip(batch["toxic"], batch["text"], strict=True):
                words = set(_WORD.findall(text.lower()))
                (toxic if label else clean).update({f"{w}$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n})
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})

    totals = texts.groupBy().agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n_toxic = totals["toxic"] or 0
    n_clean = totals["n"] - n_toxic
    if not n_toxic or not n_clean:
        return Grammar({})
    t, c = F.col("toxic"), F.col("clean")
    weight = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1)) - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    counted = texts.mapInArrow(count, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    arcs = counted.where((t >= 5) & (weight >= LEAST_WEIGHT)).collect()  # bounded by the sample
    grammar = Grammar(_specific({r["key"]: Arc(r["toxic"], r["clean"]) for r in arcs}), n_toxic, n_clean)

    def examples(what):
        """Label and ``what(text, label)`` of each sample document; bounded by the sample."""

        def rows(batches):
            for batch in common.batches(batches):
                found = [what(text, label) for label, text in zip(batch["toxic"], batch["text"], strict=True)]
                yield pa.RecordBatch.from_pydict({"y": pa.array(batch["toxic"], pa.int64()), "x": pa.array([list(map(float, x)) for x in found], pa.list_(pa.float64()))})

        got = texts.mapInArrow(rows, "y long, x array<double>").collect()
        return np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)

    grammar.factors = fitted_factors(grammar.factors, *examples(grammar.patterns))
    grammar.calibration = _fit(*examples(lambda text, label: features(grammar.clauses(text, label))))
    return grammar


def scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches):
        for batch in common.batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(batch["doc_id"], pa.int64()), "score": pa.array([grammar.score(t) for t in batch["text"]], pa.float64())})

    return common.texts_of(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), learning from the rows that are not held out."""
    grammar = learn(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(True))
    return scores(docs, grammar).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under the threshold, with all their columns.

    Only texts go to Python and only scores come back; rows stay in the JVM. A
    null text is scored as an empty one.
    """
    common.bounded_batches(docs.sparkSession)
    grammar = learn(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))

    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t or "") for t in texts], dtype="float64")

    return docs.where(F.pandas_udf(scored, "double")(F.col("text").cast("string")) < THRESHOLD)
