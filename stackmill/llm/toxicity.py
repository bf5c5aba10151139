"""Toxicity by a weighted finite-state grammar: word classes go through composed transducers, and clauses are scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackmill.llm.common import chunks, documents, fitted, fold, labelled_sample

#: Bound of the labelled sample that terminals and weights are learned from: rows and characters in all.
LABELLED = 8000
MOST_CHARACTERS = 40_000_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)

#: Words every grammar starts with; the labels add terminals of their own. A trailing * is a prefix.
SEEDS = {
    INSULT: "idiot* moron* stupid* dumb* loser* scum* trash worthless pathetic disgusting clown* fool* imbecile* bastard* "
    "filth* garbage vermin dummkopf* trottel* abschaum widerlich* erbärmlich* imbécile* crétin* abruti* ordure* idiota* "
    "estúpid* imbécil* basura asqueros* patétic*",
    THREAT: "kill* murder* hurt strangle* destroy* burn stab* shoot* töten umbringen tuer frapper matar golpear",
    TARGET: "you your yours yourself u he she they them these those this that everyone du dich dir ihr euch sie diese dieser "
    "tu toi vous ton votre ces cette tú usted ustedes vosotros ese esa estos",
    NEGATION: "not no never isn aren wasn don doesn neither nor without nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni sin",
    REPORT: "said says say called calls wrote writes claimed quoted reported according sagte sagt nannte dit disait appelé "
    "écrit dijo dice llamó escribió según",
}

#: Weights of the arcs; sums of logarithms. A terminal's own weight is added where an insult or threat leaves the cascade.
SEED_WEIGHT, TARGETED, NEGATED, REPORTED, THREATENED = 4.0, 1.0, -2.0, -2.0, 1.0
NEGATION_REACH = 3

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7)


@dataclass
class Transducer:
    """States 0..n-1, start 0. ``arcs[state, symbol] = (next state, symbol out, weight)``; a missing arc copies the symbol
    and stays. Every transducer goes back to its start at the end of a clause."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (0 if symbol == END else state, symbol, 0.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``first`` puts out goes into ``second``; weights add."""
    out = Transducer(first.states * second.states)
    for a in range(first.states):
        for b in range(second.states):
            for symbol in range(END + 1):
                a2, between, w1 = first.step(a, symbol)
                b2, last, w2 = second.step(b, between)
                out.arcs[a * second.states + b, symbol] = (a2 * second.states + b2, last, w1 + w2)
    return out


def negation() -> Transducer:
    """An insult or threat within three words of a negation weighs less. State: words the negation still reaches."""
    t = Transducer(NEGATION_REACH + 1)
    for s in range(t.states):
        low = max(0, s - 1)
        t.arcs |= {(s, x): (low, x, 0.0) for x in (OTHER, TARGET, REPORT)}
        t.arcs |= {(s, x): (low, x, NEGATED if s else 0.0) for x in (INSULT, THREAT)}
        t.arcs[s, NEGATION] = (NEGATION_REACH, OTHER, 0.0)
    return t


def reported() -> Transducer:
    """An insult or threat behind a verb of saying in the same clause weighs less."""
    t = Transducer(2, {(s, REPORT): (1, OTHER, 0.0) for s in (0, 1)})
    t.arcs |= {(1, x): (1, x, REPORTED) for x in (INSULT, THREAT)}
    return t


def targeted() -> Transducer:
    """State 0: nothing yet, 1: a target, 2: an insult without target, 3: both, 4: only threats. The pair weighs more, once
    per clause. A threat counts only with a target or an insult in its clause, before or behind it: alone it leaves as an
    ordinary word, and its weight waits on the arc for the word that makes it count."""
    t = Transducer(5)
    t.arcs = {
        (0, TARGET): (1, OTHER, 0.0), (1, TARGET): (1, OTHER, 0.0), (2, TARGET): (3, OTHER, TARGETED), (3, TARGET): (3, OTHER, 0.0),
        (0, INSULT): (2, INSULT, 0.0), (1, INSULT): (3, INSULT, TARGETED), (2, INSULT): (2, INSULT, 0.0), (3, INSULT): (3, INSULT, 0.0),
        (4, TARGET): (3, THREAT, THREATENED), (4, INSULT): (2, INSULT, 0.0), (4, THREAT): (4, OTHER, SEED_WEIGHT),
        (0, THREAT): (4, OTHER, SEED_WEIGHT), (1, THREAT): (3, THREAT, THREATENED), (2, THREAT): (2, THREAT, 0.0), (3, THREAT): (3, THREAT, 0.0),
    }
    return t


def cascade() -> Transducer:
    return compose(compose(negation(), reported()), targeted())


class Lexicon:
    """Symbol and weight of a word: whole words first, then the longest known prefix."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.entries: dict[str, tuple[int, float]] = {}
        for symbol, words in SEEDS.items():
            for w in words.split():
                self.entries[w] = (symbol, SEED_WEIGHT if symbol in (INSULT, THREAT) else 0.0)
        for pattern, weight in (learned or {}).items():
            self.entries[pattern] = (INSULT, weight)
        self.lengths = sorted({len(w) - 1 for w in self.entries if w[-1] == "*"}, reverse=True)
        self.known: dict[str, tuple[int, float]] = {}
        self.hot: set[str] = set()

    def add(self, words: set[str]) -> None:
        """Classify words not seen before; the memory is emptied when it has grown large."""
        if len(self.known) > 500_000:
            self.known, self.hot = {}, set()
        get, lengths = self.entries.get, self.lengths
        for w in [w for w in words if w not in self.known]:
            found = get(w)
            if found is None:
                for n in lengths:
                    if n <= len(w) and (found := get(w[:n] + "*")):
                        break
            self.known[w] = found = found or (OTHER, 0.0)
            if found[0] in (INSULT, THREAT):
                self.hot.add(w)


class Grammar:
    """Scores clauses of whole texts."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.lexicon, machine = Lexicon(learned), cascade()
        self.step = [[machine.step(s, x) for x in range(END + 1)] for s in range(machine.states)]

    def clauses(self, text: str) -> tuple[list[tuple[int, int, float, int]], int]:
        """(start, end, weight, matches) of every clause with a matched insult or threat, with places in the lower-cased
        text, and the number of words."""
        low = text.lower()
        every = _WORD.findall(low)
        words = set(every)
        self.lexicon.add(words)
        if words.isdisjoint(self.lexicon.hot):
            return [], len(every)
        known, step, out = self.lexicon.known, self.step, []
        state, weight, matches, start, last = 0, 0.0, 0, None, 0
        for token in _TOKEN.finditer(low):
            word = token.group()
            entry = known.get(word)
            if entry is None:  # a clause ends
                if matches:
                    out.append((start, last, max(0.0, weight), matches))
                state, weight, matches, start = 0, 0.0, 0, None
                continue
            state, symbol, extra = step[state][entry[0]]
            weight += extra
            if symbol == INSULT or symbol == THREAT:
                weight += entry[1]
                matches += 1
            start, last = token.start() if start is None else start, token.end()
        if matches:
            out.append((start, last, max(0.0, weight), matches))
        return out, len(every)


def features(found: list[tuple[int, int, float, int]], words: int) -> list[float]:
    """Heaviest clause, logarithm of all weight, and of the weight per hundred words (of 50 words at least)."""
    total = sum(c[2] for c in found)
    return [max((c[2] for c in found), default=0.0), math.log1p(total), math.log1p(100 * total / max(words, 50))]


def _first_of_copies(texts: list[str]) -> list[str]:
    """Drop near copies: a text that shares half of its eight smallest word hashes with an earlier one."""
    seen: dict[int, int] = {}
    out = []
    for i, t in enumerate(texts):
        least = sorted({crc32(w.encode()) for w in _WORD.findall(t.lower())})[:8]
        if max(Counter(seen[h] for h in least if h in seen).values(), default=0) < max(1, len(least) / 2):
            out.append(t)
        for h in least:
            seen.setdefault(h, i)
    return out


def learn_terminals(texts: list[str], labels: list[int], most: int = 200) -> dict[str, float]:
    """Words and word prefixes that mark labelled texts, with smoothed log-odds as weights.

    Patterns are taken one by one: the one whose likelihood ratio is strongest on the marked texts that no pattern covers yet
    (of equal ones the longest), as long as it withstands a hundred million tries. Near copies count once, or else every
    word of a text that was copied often would look like a mark.
    """
    bad = _first_of_copies([t for t, y in zip(texts, labels, strict=True) if y])
    good = _first_of_copies([t for t, y in zip(texts, labels, strict=True) if not y])
    if not bad or not good:
        return {}

    def patterns(text):
        words = set(_WORD.findall(text.lower()))
        return {w for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in _PREFIXES if len(w) >= k}

    sets = [patterns(t) for t in bad]
    inside, outside, left = Counter(), Counter(), Counter()
    for x in sets:
        inside.update(x)
    wanted = {p for p, n in inside.items() if n >= 5}
    for t in good:
        outside.update(patterns(t) & wanted)
    sets = [x & wanted for x in sets]
    for x in sets:
        left.update(x)
    out: dict[str, float] = {}
    while sets and len(out) < most:
        base = len(sets) / (len(sets) + len(good))
        best = (2 * math.log(1e8), 0, "")
        for p, a in left.items():
            share = a / (a + outside[p]) if a else 0.0
            if share > base:
                b = outside[p]
                gain = 2 * (a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0))
                best = max(best, (gain, len(p.rstrip("*")), p))
        if not best[2]:
            break
        p = best[2]
        out[p] = math.log((inside[p] + 0.5) / (len(bad) + 1)) - math.log((outside[p] + 0.5) / (len(good) + 1))
        for x in sets:
            if p in x:
                left.subtract(x)
        sets = [x for x in sets if p not in x]
    return out


#: Intercept and weights of the features when no labels of both kinds are at hand.
DEFAULT = (-2.0, 1.0, 0.2, 0.2)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton steps of a ridge logistic regression; weights below zero are not allowed to lower a score."""
    if not 0 < y.sum() < len(y):
        return DEFAULT
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x1.shape[1])
    free = np.ones(len(w), bool)
    for _ in range(2):
        w[~free] = 0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            g = x1.T @ (p - y) + ridge * w
            h = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w))
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w -= np.clip(step, -3, 3)
        free[1:] = w[1:] > 0
    return tuple(float(v) for v in np.where(free, w, 0.0))


@dataclass
class Model:
    terminals: dict[str, float]
    weights: tuple[float, ...]


def train(texts: list[str], labels: list[int]) -> tuple[dict[str, float], tuple[float, ...]]:
    """Terminals and weights of the features learned from labelled texts."""
    terminals = learn_terminals(texts, labels)
    grammar = Grammar(terminals)
    x = np.array([features(*grammar.clauses(t)) for t in texts], float).reshape(-1, 3)
    return terminals, fit_logistic(x, np.array(labels, float))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED, characters: int = MOST_CHARACTERS) -> Model:
    """Learn terminals and weights from a bounded sample (``labelled_sample``: ``rows`` rows, ``characters`` in all). Several
    labels of an id count as toxic if one is; null labels and null texts are not used."""
    labelled = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return Model(*fitted(labelled_sample(docs, labelled, rows, characters), train))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, clauses`` for every row of ``docs`` (``doc_id, text``): the probability and the matched clauses
    (start, end, weight). Null and empty texts have no clause and the lowest score; repeated rows give repeated results;
    other columns are ignored. A map over whole texts; nothing is shuffled."""

    def run(frames):
        grammar = Grammar(model.terminals)
        w = np.array(model.weights)
        for frame in frames:
            for part, texts in chunks(frame):
                found = [grammar.clauses(t) for t in texts]
                x = np.array([features(*f) for f in found], float).reshape(-1, 3)
                p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                spans = [[{"start": c[0], "end": c[1], "weight": c[2]} for c in f] for f, _ in found]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(object), "score": p, "clauses": spans})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, clauses array<struct<start: long, end: long, weight: double>>")


def learned(spark, folder, docs: DataFrame | None = None) -> Model:
    """The model of the test tables, learned outside fold 0 of 5."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where(fold(5) != 0)
    return fit(documents(spark, folder) if docs is None else docs, labels)


def op4(spark, folder):
    found = score(documents(spark, folder), learned(spark, folder))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns. Null and empty texts stay."""

    def run(batches):
        grammar, w = Grammar(model.terminals), np.array(model.weights)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([features(*grammar.clauses(t or "")) for t in texts], float).reshape(-1, 3)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
