"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation (a word that ends in n't is one), reported speech, clause end, other. Insults and their stems carry
weights learned from labelled documents (log-odds of document frequencies, lowered by their standard error); the other lists are
fixed. Five small transducers (insult, threat, target, negation, report) are composed into one automaton whose states are the
reachable products; each insult or threat of a clause leaves with the weight that the composed state gives it: negated and reported
ones count less, those aimed at a target more; a threat counts once it has a target or an insult beside it. A document's score is a logistic function of its clause weights.

The grammar is fitted on a bounded sample of labelled rows whose crc32(doc_id) mod 5 is not 0: the sample_rows lowest by crc32.

Defined results: null, empty and wordless texts have no clause and get the score of that; without labels of both kinds every
score is 0; a document with several label rows counts once, as toxic if any row says so; repeated rows of a document are scored
alike; very long texts are scored whole; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, own_name, tidy

SAMPLE_ROWS = 20_000
ERRORS = 2.0
STEM_LENGTHS = (4, 5, 6, 7, 8)

# Closed word lists of the grammar.
THREATS = frozenset("kill hurt destroy shoot stab beat burn töten umbringen schlagen verletzen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yourself they them he she him her du dich dir ihr sie er tu toi vous il ils elles tú usted ustedes ellos".split())
NEGATIONS = frozenset("not no never neither nor nicht kein keine nie ne pas jamais ni nunca tampoco".split())
REPORTS = frozenset("said says say claimed wrote quoted reported sagte sagt schrieb meinte dit disait écrit dijo dice escribió".split())
NEGATION_SPAN = 3
FACTORS = {"negated": 0.4, "reported": 0.6, "aimed": 1.3, "threat": 2.0}

_tokens = re.compile(r"[^\W\d_]+(?:(?<=n)['’]t(?![^\W\d_]))?|[.!?;\n]").findall


def transducers() -> dict[str, dict]:
    """Each: start state and arcs (state, symbol) -> state. A missing arc stays where it is."""
    negation = {(k, "N"): NEGATION_SPAN for k in range(NEGATION_SPAN + 1)} | {(k, s): k - 1 for k in range(1, NEGATION_SPAN + 1) for s in "oITYR"} | {(k, "."): 0 for k in range(NEGATION_SPAN + 1)}
    flag = lambda on: {(0, on): 1, (1, "."): 0}
    return {"insult": flag("I"), "threat": flag("T"), "target": flag("Y"), "negation": negation, "report": flag("R")}


def composed() -> tuple[dict, list[dict]]:
    """The product automaton: arcs (state number, symbol) -> (state number, output factor), by breadth-first composition."""
    parts = transducers()
    names = list(parts)
    start = tuple(0 for _ in names)
    number, order, arcs = {start: 0}, [start], {}
    for state in order:
        now = dict(zip(names, state, strict=True))
        for s in "oITYNR.":
            to = tuple(parts[n].get((now[n], s), now[n]) for n in names)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            weight = (FACTORS["negated"] if now["negation"] else 1.0) * (FACTORS["reported"] if now["report"] else 1.0)
            factor, alone = 0.0, not now["target"] and not now["insult"]
            if s == "I":
                factor = weight * (FACTORS["aimed"] if now["target"] else 1.0)
            elif s == "T" and not alone:
                factor = weight * FACTORS["threat"] * (FACTORS["aimed"] if now["target"] else 1.0)
            elif s == "Y" and alone and now["threat"]:  # the threat has its target now
                factor = weight * FACTORS["threat"] * FACTORS["aimed"]
            elif s == "Y" and now["insult"] and not now["target"]:
                factor = FACTORS["aimed"] - 1.0  # a target after its insult
            arcs[number[state], s] = (number[to], factor)
    return arcs, [dict(zip(names, s, strict=True)) for s in order]


def terms(word: str) -> list[str]:
    """The word and its stems (marked *), longest first."""
    return [word, *(word[:k] + "*" for k in reversed(STEM_LENGTHS) if k <= len(word))]


def weight(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Log-odds of a term, lowered by ERRORS standard errors; 0 if that is not over 1 or fewer than 3 toxic documents have it."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0)) - ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return float(odds) if odds > 1 and toxic >= 3 else 0.0


class Grammar:
    def __init__(self, fitted: dict) -> None:
        self.terms, self.n, self.beta = fitted["terms"], fitted["n"], fitted.get("beta")
        self.arcs = composed()[0]
        self.memo: dict[str, tuple[str, str | None, float]] = {}

    def symbol(self, word: str) -> tuple[str, str | None, float]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 60_000:
                self.memo.clear()
            best = max(((weight(*self.terms[t], *self.n), t) for t in terms(word) if t in self.terms), default=(0.0, None))
            kind = "." if word in ".!?;\n" else "N" if word in NEGATIONS or word.endswith(("n't", "n’t")) else "R" if word in REPORTS else "T" if word in THREATS else "Y" if word in TARGETS else "I" if best[0] > 0 else "o"
            got = self.memo[word] = (kind, best[1], best[0] if kind == "I" else 1.0)
        return got

    def clauses(self, text: str | None, own: int | None = None) -> tuple[list[float], int, int]:
        """Weights of the clauses that hold an insult or threat, distinct matched terms, and words. own: the document's label while
        fitting; its own share is then taken out of each term's counts."""
        found, matched, n, state, acc = [], set(), 0, 0, 0.0
        symbol, arcs = self.symbol, self.arcs
        toks = [symbol(w) for w in _tokens((text or "").lower())]
        if not any(t[0] in "IT" for t in toks):
            return [], 0, len(toks)
        last, named = 0.0, ""
        for kind, term, w in toks:
            if kind == "o" and state == 0:
                continue
            if kind == "I" and own is not None:
                tox, clean = self.terms[term]
                w = weight(tox - own, clean - (1 - own), self.n[0] - own, self.n[1] - (1 - own))
            state, factor = arcs[state, kind]
            if kind in "IT":
                last, named = w, term or "threat"
            if factor:
                acc += factor * last
                if last > 0:
                    matched.add(named)
            if kind == "." and acc:
                found.append(acc)
                acc = 0.0
        if acc:
            found.append(acc)
        return found, len(matched), len(toks)

    def features(self, text: str | None, own: int | None = None) -> list[float]:
        c, kinds, n = self.clauses(text, own)
        total, most = sum(c), max(c, default=0.0)
        rate = 100.0 * total / max(n, 20)
        return [1.0, np.log1p(total), np.log1p(most), np.log1p(rate), np.log1p(kinds), np.log1p(len(c)), np.log1p(total) * np.log1p(n) / 10.0]

    def score(self, text: str | None) -> float:
        if self.beta is None:
            return 0.0
        return float(1.0 / (1.0 + np.exp(-np.clip(np.dot(self.beta, self.features(text)), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised likelihood; the first column is the constant and is not penalised."""
    beta, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sampled(docs: DataFrame, labels: DataFrame, label: str, k: int, out: int, rows: int) -> DataFrame:
    """text and y of at most `rows` labelled documents outside the held-out fold; the ids sent to all tasks are bounded by that."""
    keep = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), k) != out))
    ids = keep.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    sample = sampled(docs, labels, "toxic", 5, 0, sample_rows).persist()

    @tidy
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count[y].update({t for w in set(_tokens((text or "").lower())) for t in terms(w)})
        if any(count):
            every = list({**count[1], **count[0]})
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[t] for t in every], pa.int64()) for c in (count[1], count[0]))], ["term", "toxic", "clean"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n = (sizes.get(1, 0), sizes.get(0, 0))
    fitted: dict = {"terms": {}, "n": n}
    if not all(n):
        sample.unpersist()
        return fitted
    found = sample.mapInArrow(per_task, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # One clean document less: the terms that a clean document meets while its own share is taken out must be there as well.
    others = F.greatest(F.col("clean") - 1, F.lit(0)) + 0.5
    found = found.filter(F.col("toxic") >= 3).withColumn("gain", F.log((F.col("toxic") + 0.5) / (n[0] + 1)) - F.log(others / (n[1] + 1)) - ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / others))
    fitted["terms"] = {r["term"]: (r["toxic"], r["clean"]) for r in found.filter("gain > 0.5").collect()}  # terms of the bounded sample
    known = docs.sparkSession.sparkContext.broadcast(fitted)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(known.value)
        for b in batches:
            rows = [g.features(t, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = sample.mapInArrow(measure, "x array<double>, y int").collect()
    sample.unpersist()
    rows.sort(key=lambda r: (r["y"], r["x"]))  # sums in one order, so reruns agree
    fitted["beta"] = logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)).tolist()
    return fitted


def scorer(spark, fitted: dict):
    known = spark.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g = Grammar(known.value)
        for t in texts:
            yield pd.Series([g.score(x) for x in t], dtype="float64")
        give_back()

    return of


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    of = scorer(docs.sparkSession, trained(docs, labels))
    out = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), of(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5."""
    of, name = scorer(docs.sparkSession, trained(docs, labels)), own_name(docs, "toxic")
    return docs.withColumn(name, of(F.col("text").cast("string"))).filter(F.col(name) < 0.5).drop(name)
