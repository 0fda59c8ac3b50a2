"""Toxicity by a weighted finite-state pattern grammar.

A document is scored by its clauses, not by isolated words. Five small
transducers, composed into one pass over a clause, read its tokens:

* insult: a word or word stem of the insult lexicon emits its weight;
* threat: a threat verb emits its weight if a target follows;
* target: a second- or third-person target near an insult raises it;
* negation: a negation shortly before lowers what follows;
* reported speech: a verb of saying or a quotation mark lowers what follows.

The lexicon of insults is learnt: words and stems (prefixes) whose share among
toxic training documents is significantly higher than among clean ones, with
their log-odds as arc weights. A logistic curve over the clause scores (largest
and sum) turns them into the document's score. Labels are read only from rows
outside the held-out fold; language, source and id are no inputs.

Bounds: the grammar is fitted on at most ``fit_rows`` labelled rows (those with
the smallest hashes of the id) and holds at most ``max_arcs`` learnt arcs;
every document is scored over its whole text by an Aho-Corasick scan for the
lexicon and the transducers over the clauses that hold a match.

Edge cases: a null or empty text scores as a text without matches; several
labels for a row (repeated label rows) count once, toxic if any says so; rows
that repeat an id are scored each; without usable labels only the fixed
patterns serve; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, crc32_mod, text_of

# The fixed part of the grammar: English function words and verbs by class.
TARGETS = {"you", "your", "yours", "yourself", "u", "him", "her", "he", "she", "they", "them", "these", "those", "everyone"}
NEGATIONS = {"not", "no", "never", "isn't", "aren't", "wasn't", "don't", "doesn't", "nor", "without"}
REPORTS = {"said", "says", "say", "called", "calls", "claimed", "claims", "told", "wrote", "quoted", "reported"}
THREATS = {"kill": 6.0, "murder": 6.0, "hurt": 4.0, "destroy": 4.0, "stab": 5.0, "shoot": 5.0, "beat": 4.0}

#: Factors of the composed transducers, and their reach in tokens.
AIMED, DENIED, REPORTED = 1.5, 0.6, 0.7
REACH = 4

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = ".!?;\n"
STEMS = (4, 5, 6)
#: Toxic training rows that a learnt arc must explain at least.
LEAST = 3
#: An arc in this share of the toxic training rows needs no rows of its own.
SHARE = 0.05


def clause_score(tokens: list[str], weight_of) -> float:
    """One pass of the composed transducers over a clause: the state is the
    tokens left in the scope of a negation, of a report and of a target."""
    total, denied, reported, aimed = 0.0, 0, False, 0
    for i, token in enumerate(tokens):
        if token in NEGATIONS:
            denied = REACH + 1
        elif token in REPORTS or token in '"“”«»':
            reported = True
        elif token in TARGETS:
            aimed = REACH + 1
        weight, after = weight_of(token), tokens[i + 1:i + 1 + REACH]
        if token in THREATS and not TARGETS.isdisjoint(after):
            weight = max(weight, THREATS[token])
        if weight:
            if aimed or not TARGETS.isdisjoint(after):
                weight *= AIMED
            if denied:
                weight *= DENIED
            if reported:
                weight *= REPORTED
            total += weight
        denied, aimed = max(denied - 1, 0), max(aimed - 1, 0)
    return total


class Grammar:
    """The lexicon's arcs (whole words and stems), compiled once per worker."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], curve: tuple[float, float, float]):
        self.words, self.stems, self.curve = words, stems, curve
        self.sizes = sorted({len(s) for s in stems})
        self.scan = None

    def weight_of(self, token: str) -> float:
        best = self.words.get(token, 0.0)
        for n in self.sizes:
            if len(token) >= n:
                best = max(best, self.stems.get(token[:n], 0.0))
        return best

    def _matches(self, text: str):
        if self.scan is None:
            import ahocorasick

            self.scan = ahocorasick.Automaton()
            for t in {*self.words, *self.stems, *THREATS}:
                self.scan.add_word(t, len(t))
            self.scan.make_automaton()
        for end, size in self.scan.iter(text):
            if end < size or not text[end - size].isalpha():
                yield end

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that hold a match."""
        text = text.lower()
        out, upto = [], -1
        for end in self._matches(text):
            if end < upto:
                continue
            begin = max(text.rfind(c, 0, end) for c in _ENDS) + 1
            ends = [e for e in (text.find(c, end) for c in _ENDS) if e >= 0]
            upto = min(ends, default=len(text))
            score = clause_score(_TOKEN.findall(text, begin, upto), self.weight_of)
            if score:
                out.append(score)
        return out

    def features(self, text: str) -> tuple[float, float]:
        scores = self.clauses(text)
        return (max(scores, default=0.0), math.log1p(sum(scores)))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def document_terms(text: str) -> set[str]:
    """Distinct words, and stems marked by a trailing ``*``."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) >= 3} | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def cover(y: np.ndarray, hits: list, terms: int) -> list[int]:
    """Picks the terms of a fair share of all toxic rows, then others one by
    one, each by the toxic rows that no earlier one explains. Words that toxic
    copies or shared passages merely carry along have none left when their turn
    comes."""
    has = np.zeros((len(y), terms), dtype=bool)
    for i, h in enumerate(hits):
        has[i, h] = True
    clean = has[y == 0].sum(axis=0)
    left = has[y == 1]
    common = left.sum(axis=0) >= max(LEAST, SHARE * len(left))
    out = np.flatnonzero(common).tolist()
    left = left[~left[:, out].any(axis=1)]
    while len(left):
        t = left.sum(axis=0)
        gain = np.where(t >= LEAST, t - 3.0 * clean, -1.0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        out.append(best)
        left = left[~left[:, best]]
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([0.0, 0.01, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge @ w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return tuple(map(float, w))


def fit_grammar(docs: DataFrame, labels: DataFrame, fold: int = 5, fit_rows: int = 20_000, max_arcs: int = 2_000,
                id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Learns the lexicon and the curve from labelled rows outside the held-out fold."""
    ids = (labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("y"))
           .where(F.col("y").isin(0, 1) & (crc32_mod(F.col("id"), fold) != 0))
           .groupBy("id").agg(F.max("y").alias("y"))
           .orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    text = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = text.join(F.broadcast(ids), "id")  # at most fit_rows ids

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        n = Counter()
        for pdf in batches:
            for y, t in zip(pdf["y"], pdf["text"], strict=True):
                seen[y].update(document_terms(t))
                n[y] += 1
        for y in (0, 1):
            yield pd.DataFrame({"term": ["", *seen[y]], "y": y, "n": [n[y], *seen[y].values()]})

    terms = (rows.mapInPandas(count, "term string, y int, n long")
             .groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"),
                                  F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c")))
    total = F.broadcast(terms.where("term = ''").select(F.col("t").alias("all_t"), F.col("c").alias("all_c")))
    odds = "ln((t + 0.5) / (all_t + 1)) - ln((c + 0.5) / (all_c + 1))"
    found = (terms.where(f"term <> '' and t >= {LEAST}").join(total)
             .withColumn("w", F.expr(odds)).withColumn("z", F.expr("w / sqrt(1 / (t + 0.5) + 1 / (c + 0.5))"))
             .where("w > 3 and z > 2.5").orderBy(F.desc("z"), F.length("term"), "term").limit(max_arcs)
             .select("term", "w").collect())
    place = {r["term"]: i for i, r in enumerate(found)}

    def match(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "hits": [
                sorted(place[t] for t in document_terms(x) if t in place) for x in pdf["text"]]})

    hits = rows.mapInPandas(match, "y int, hits array<int>").where("size(hits) > 0").toPandas()
    arcs = cover(hits["y"].to_numpy(), hits["hits"].to_list(), len(found))
    words = {found[i]["term"]: found[i]["w"] for i in arcs if not found[i]["term"].endswith("*")}
    stems = {found[i]["term"][:-1]: found[i]["w"] for i in arcs if found[i]["term"].endswith("*")}
    grammar = Grammar(words, stems, (-4.0, 1.0, 1.0))

    def describe(batches):
        for pdf in batches:
            x = [grammar.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "a": [v[0] for v in x], "b": [v[1] for v in x]})

    x = rows.mapInPandas(describe, "y int, a double, b double").toPandas()
    if x["y"].nunique() == 2:
        grammar.curve = fit_curve(x[["a", "b"]].to_numpy(), x["y"].to_numpy())
    return Grammar(words, stems, grammar.curve)


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by max_arcs

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype=float)

    return docs.withColumn(score_col, score(text_of(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    grammar = fit_grammar(docs, labels, fold, id_col=id_col, text_col=text_col)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return score_toxicity(rows, grammar).select(
        "doc_id", (F.coalesce(crc32_mod(F.col("doc_id"), fold) == 0, F.lit(False))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
