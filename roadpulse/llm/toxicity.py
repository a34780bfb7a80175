"""Toxicity from a weighted finite-state grammar over clauses.

Five transducers read the tokens of a clause and each writes its own mark on a tape:

* insult: open for a few tokens after an addressee or an insulting word; an insulting word read
  while open is an insult aimed at somebody or one of several;
* threat: open for a few tokens after a word of intent; a violent or insulting word read while
  open is a threat;
* target: whether the clause names an addressee or a person;
* negation: open for a few tokens after a negating word;
* reported speech: open from a quotation mark or reporting word to the clause's end.

Their composition is one automaton over token classes whose states are tuples of theirs; a clause
is scored by its path: every violent or insulting word counts with its weight, marked as the state
it is read in says (negated, reported, targeted, insult, threat). A document's features are sums over its matched clauses, never over loose
words, and the weights of the marks are learned, so that negation or quoting lowers a score as far
as labels say so.

The lexicon is learned from a bounded sample of labelled rows: beginnings of words (3 to 12
letters, then each a third longer than the one before, and whole words) whose documents are labelled toxic more often than chance allows among all beginnings
seen (likelihood ratio with a Bonferroni bound). Inflected forms are thus found by their stem, in
any language. All that pass are kept: only the sample bounds them. A second part of the sample calibrates the score.

Texts are searched by one multi-pattern automaton; only clauses around a hit are tokenised.

Defined results: null and empty texts have no clause and get the score of texts without a match;
a null ``doc_id`` counts as the empty text in the split; repeated rows are scored alike; equal
texts count once in fitting; without labelled rows of both kinds nothing is called toxic and
every score is next to 0. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.labels import fit_logistic, labelled_sample, probability
from roadpulse.llm.text import fold_of
from roadpulse.session import stage

MAX_ROWS = 16_000
LEAST, DENSE = 3, 12

# Common function words of English, German, French and Spanish.
TARGETS = "you your yours yourself u he she they them him her du dich dir dein deine ihr euch tu toi te ton ta vous votre tú tu ti usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor without don't isn't aren't wasn't nicht kein keine nie niemals pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTS = "said says say told wrote writes called quoted according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split()
THREATS = "kill hurt destroy punch beat burn shoot stab töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
INTENTS = "will shall gonna going want i'll we'll they'll werde werden will wollen vais allons veux voulons voy vamos quiero".split()

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”«»„]")
_VIOLENT = frozenset(THREATS)
_CLAUSE = re.compile(r"[.!?;:\n]+")
_CLASSES = {w: c for c, ws in (("intent", INTENTS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws} | dict.fromkeys('"“”«»„', "report")
SCOPE = 3


class Transducer:
    """States from 0; ``step`` maps (state, token class) to the next state, ``mark`` names what it writes."""

    def __init__(self, states: int, step):
        self.states, self.step = states, step

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same token; a state is a pair of theirs."""
        n = other.states
        return Transducer(self.states * n, lambda s, c: self.step(s // n, c) * n + other.step(s % n, c))


#: Negation is open for SCOPE tokens, reported speech to the end of the clause, a target is remembered.
NEGATION = Transducer(SCOPE + 1, lambda s, c: SCOPE if c == "negation" else max(s - 1, 0))
REPORT = Transducer(2, lambda s, c: 1 if c == "report" else s)
TARGET = Transducer(2, lambda s, c: 1 if c == "target" else s)


def _matcher(openers: tuple[str, ...], closers: tuple[str, ...]) -> Transducer:
    """In its last state after a closer that is read at most SCOPE tokens after an opener or a match."""

    def step(state: int, token: str) -> int:
        if state and token in closers:
            return SCOPE + 1
        return SCOPE if token in openers else max(state - 1, 0)

    return Transducer(SCOPE + 2, step)


INSULT = _matcher(("target", "insult"), ("insult",))
THREAT = _matcher(("intent",), ("violent", "insult"))
TOKEN_CLASSES = ("word", "target", "negation", "report", "intent", "violent", "insult")
_all = NEGATION.compose(REPORT).compose(TARGET).compose(INSULT).compose(THREAT)
#: The composed automaton as a table, and what its states say: (negated, reported, targeted, insult, threat).
MOVES = [{c: _all.step(s, c) for c in TOKEN_CLASSES} for s in range(_all.states)]
SAYS = [
    (n > 0, bool(r), bool(t), i > SCOPE, h > SCOPE)
    for n, r, t, i, h in product(range(NEGATION.states), range(REPORT.states), range(TARGET.states), range(INSULT.states), range(THREAT.states))
]


def beginnings(word: str) -> Iterator[str]:
    """Beginnings of a word as patterns: ``^abc`` any word so begun, ``^abc$`` the whole word."""
    k = LEAST
    while k <= len(word):
        yield "^" + word[:k]
        k += 1 if k < DENSE else k // 3
    yield "^" + word + "$"


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task that have each beginning: toxic ones and others; '' counts documents."""
    bad, good = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = {""}
            for word in set(_WORD.findall(text.lower())):
                seen.update(beginnings(word))
            (bad if label else good).update(seen)
    keys = list(bad | good)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([good[k] for k in keys], pa.int64())], ["part", "bad", "good"]
    )


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of word beginnings from (text, label) rows."""
    counts = stage(
        sample.select("text", "label").mapInArrow(_lexicon_counts, "part string, bad long, good long").groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")),
        "lexicon",
    )
    whole = counts.where("part = ''").first()
    if whole is None or not whole.bad or not whole.good:
        return {}
    rate = whole.bad / (whole.bad + whole.good)
    tested = max(counts.count(), 2)
    n = F.col("bad") + F.col("good")
    p = F.col("bad") / n
    ratio = F.col("bad") * F.log(p / F.lit(rate)) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - p) / F.lit(1 - rate))).otherwise(0.0)
    found = counts.where((F.col("part") != "") & (F.col("bad") > 0) & (p > F.lit((1 + rate) / 2)) & (ratio > F.lit(float(np.log(tested)))))
    weight = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - F.lit(float(np.log(rate / (1 - rate))))
    return {r.part: r.weight for r in found.select("part", weight.alias("weight")).collect()}


class Grammar:
    """The lexicon as a multi-pattern automaton, and the composed clause automaton."""

    NAMES = ("any", "clauses", "heaviest", "plain", "negated", "reported", "targeted", "insults", "threats", "dense")

    def __init__(self, lexicon: dict[str, float]):
        self.find = ahocorasick.Automaton()
        self.lexicon = dict(lexicon)
        for word in THREATS:
            # Without evidence a threat weighs as little as one more document would show.
            self.lexicon.setdefault(f"^{word}$", 0.5)
        for part, weight in self.lexicon.items():
            self.find.add_word(part[1:].rstrip("$"), part[1:].rstrip("$"))
        self.find.make_automaton()

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(p, 0.0) for p in beginnings(word)), default=0.0)

    def matches(self, text: str) -> list[tuple[tuple, float]]:
        """Marks and weight of each violent or insulting word of a clause; a target counts for the whole clause."""
        state, found = 0, []
        for word in _WORD.findall(text):
            weight = self.weight(word)
            kind = _CLASSES.get(word, "word")
            if weight:
                kind = "violent" if word in _VIOLENT else "insult"
            state = MOVES[state][kind]
            if weight:
                found.append((state, weight))
        targeted = SAYS[state][2]
        return [((*SAYS[at][:2], targeted, *SAYS[at][3:]), weight) for at, weight in found]

    def clause(self, text: str) -> dict[tuple, float]:
        """Weights of the clause's violent and insulting words by (negated, reported, targeted)."""
        cells: dict[tuple, float] = {}
        for marks, weight in self.matches(text):
            cells[marks[:3]] = cells.get(marks[:3], 0.0) + weight
        return cells

    def features(self, text: str) -> list[float]:
        low = text.lower()
        ends = [end for end, word in self.find.iter(low) if end - len(word) < 0 or not low[end - len(word)].isalnum()]
        if not ends:
            return [0.0] * len(self.NAMES)
        bounds = [m.end() for m in _CLAUSE.finditer(low)]
        at = np.searchsorted(bounds, ends, side="right")
        plain = negated = reported = targeted = insults = threats = heaviest = 0.0
        clauses = 0
        for k in np.unique(at):
            cells: dict[tuple, float] = {}
            for marks, w in self.matches(low[bounds[k - 1] if k else 0 : bounds[k] if k < len(bounds) else len(low)]):
                cells[marks[:3]] = cells.get(marks[:3], 0.0) + w
                neg, rep, tgt, insult, threat = marks
                open_ = not neg and not rep
                plain, insults, threats = plain + w * open_, insults + w * (open_ and insult), threats + w * (open_ and threat)
                negated, reported, targeted = negated + w * neg, reported + w * rep, targeted + w * tgt
            clauses += bool(cells)
            heaviest = max(heaviest, *cells.values(), 0.0)
        if not clauses:
            return [0.0] * len(self.NAMES)
        logs = [float(np.log1p(v)) for v in (plain, negated, reported, targeted, insults, threats)]
        return [1.0, float(np.log1p(clauses)), heaviest, *logs, clauses / (len(bounds) + 1)]


def _features(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [grammar.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    return run


def _scores(lexicon: dict[str, float], weights: np.ndarray, folds: int, held: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            x = np.array([grammar.features(t or "") for t in batch.column(2).to_pylist()]).reshape(-1, len(Grammar.NAMES))
            score = probability(weights, x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.expm1(x[:, 1]).round().astype(np.int64))],
                ["doc_id", "held_out", "score", "predicted", "n_clauses"],
            )

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, max_rows: int = MAX_ROWS, key: Column | None = None) -> DataFrame:
    """Per row: doc_id (or ``key`` in its place), held_out, score, predicted, n_clauses (matched ones)."""
    sample = stage(labelled_sample(docs, labels, "toxic", folds, held, max_rows), "toxic-sample")
    lexicon = learn_lexicon(sample.where("part < 7"))
    grammar = Grammar(lexicon)

    def late(batches):
        yield from _features(Grammar(lexicon))(batches)

    rows = sample.where("part >= 7").select("text", "label").mapInArrow(late, "x array<double>, label int").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(grammar.NAMES))
    y = rows.column("label").to_numpy().astype(float)
    weights = fit_logistic(x, y) if len(set(y)) == 2 else np.array([-30.0] + [0.0] * x.shape[1])
    shown = F.col("doc_id").cast("long") if key is None else key
    df = docs.select(shown.alias("doc_id"), (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    return df.mapInArrow(_scores(lexicon, weights, folds, held, threshold), "doc_id long, held_out boolean, score double, predicted int, n_clauses long")
