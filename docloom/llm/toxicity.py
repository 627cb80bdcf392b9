"""Toxic passages by maximum-scoring segments.

Weights: log-odds of each word between toxic and clean training documents, with an informative Dirichlet prior in
proportion to the words' frequency in both; words whose log-odds is not significant weigh nothing, and a constant is
taken off every word so that clean text drifts down. Scan: one linear pass finds a text's maximal scoring segments.
Calibration: the best scores of clean text follow an extreme-value law in lambda * score - ln(words); lambda solves
the law's equation, its place and scale are fitted on clean training documents, a text's significant segments are
summed with the law for several segments, and a logistic curve turns the sum into a probability.

Defined results: null and empty texts hold no word and score 0; without labels of both kinds every score is 0;
repeated rows score alike; held_out is false for a null id; an empty table gives an empty result. Only the text enters
a score. The fit takes at most `bound` labelled rows; all documents are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS, Staged, id_and_text, map_arrow
from .labels import remainder, training_rows

FOLDS, HELD = 5, 0
_words = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def maximal_segments(weights: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint, in text order; linear time."""
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest with a smaller left sum
    total = 0.0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        start, end, low, high = i, i + 1, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def best_score(w: np.ndarray) -> float:
    """Score of the best segment, 0 if none is positive."""
    if not len(w):
        return 0.0
    c = np.concatenate(([0.0], np.cumsum(w)))
    return float((c - np.minimum.accumulate(c)).max())


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    scale: float = 1.0  # lambda
    place: float = 0.0
    spread: float = 1.0
    slope: float = 0.0
    offset: float = 0.0
    significant: float = 3.0  # standard excess from which a segment counts
    fitted: bool = False

    def scores(self, text: str) -> tuple[list[str], np.ndarray]:
        t = words_of(text)
        return t, np.fromiter(map(self.weights.get, t, repeat(-self.drift)), np.float64, len(t))

    def excess(self, score: float, n: int) -> float:
        """Standardised height of a segment's score over what clean texts of n words reach."""
        return (self.scale * score - math.log(max(n, 1)) - self.place) / self.spread

    def statistic(self, w: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """(excess of all significant segments together, or of the best; the significant ones)."""
        n = len(w)
        best = best_score(w)
        top = self.excess(best, n)
        if best <= 0 or top < self.significant:
            return top, []
        found = [s for s in maximal_segments(w.tolist()) if self.excess(s[2], n) >= self.significant]
        total, most = 0.0, top
        for r, s in enumerate(sorted((s[2] for s in found), reverse=True), 1):
            total += self.excess(s, n)
            most = max(most, total - math.lgamma(r + 1))
        return most, found

    def probability(self, x: float) -> float:
        z = max(-60.0, min(60.0, self.offset + self.slope * max(-20.0, min(40.0, x))))
        return 1.0 / (1.0 + math.exp(-z))


def solve_scale(weights: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with sum(share * exp(lambda * weights)) = 1; the mean weight must be negative."""
    if float((weights * share).sum()) >= 0 or weights.max() <= 0:
        return 1.0
    f = lambda x: float((share * np.exp(x * weights)).sum()) - 1
    lo, hi = 0.0, 1e-3
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, offset) by Newton steps."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def _counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents that hold the word; the empty word counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = set(words_of(t))
                own.add("")
                counts[y].update(own)
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield made(counts)
                counts = (Counter(), Counter())
        if counts[0] or counts[1]:
            yield made(counts)

    def made(counts) -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        return pa.record_batch([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    return map_arrow(rows.select("text", "y"), run, "word string, toxic long, clean long", TEXTS)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = FOLDS, held: int = HELD, bound: int = 20_000, prior: float = 0.1, least_z: float = 3.0, drift: float = 0.5) -> ToxicityModel:
    """docs: (doc_id, text). What comes to the driver is bounded by the sample."""
    kept = Staged(spark)
    rows = training_rows(docs, labels, label_col, folds, held, bound)
    counts = kept.put(_counts(rows).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
    n = {r["k"]: (r["t"] or 0, r["c"] or 0) for r in counts.groupBy((F.col("word") == "").alias("k")).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()}
    n_t, n_c = n.get(False, (0, 0))
    if not all(n.get(True, (0, 0))) or not n_t or not n_c:
        return ToxicityModel()
    alpha = F.lit(prior) * (F.col("toxic") + F.col("clean"))  # the prior is worth this share of all counts
    odds = lambda y, total: F.log((y + alpha) / (F.lit(total + prior * (n_t + n_c)) - y - alpha))
    scored = counts.where("word <> ''").select("word", "clean", (odds(F.col("toxic"), float(n_t)) - odds(F.col("clean"), float(n_c))).alias("d"), (1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha)).alias("v"))
    told = scored.where(F.abs("d") >= least_z * F.sqrt("v")).toPandas()
    model = ToxicityModel(drift=drift)
    model.weights = {w: float(np.clip(d, -3.0, 6.0)) - drift for w, d in zip(told["word"], told["d"])}
    weights = np.array([*(model.weights[w] for w in told["word"]), -drift])
    share = np.array([*told["clean"].astype(float), max(0.0, n_c - float(told["clean"].sum()))]) / n_c
    model.scale = solve_scale(weights, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [model.scores(t)[1] for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([best_score(x) for x in w], pa.float64()), pa.array([len(x) for x in w], pa.int64()), b.column(1)], ["s", "n", "y"])

    seen = map_arrow(rows.select("text", "y"), run, "s double, n long, y int", TEXTS).toPandas()
    x = model.scale * seen["s"].to_numpy() - np.log(np.maximum(seen["n"].to_numpy(), 1))
    y = seen["y"].to_numpy()
    clean = x[y == 0]
    model.spread = max(1e-3, float(clean.std()) * math.sqrt(6) / math.pi)
    model.place = float(clean.mean()) - 0.5772156649 * model.spread

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([model.statistic(model.scores(t)[1])[0] for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], ["x", "y"])

    seen = map_arrow(rows.select("text", "y"), again, "x double, y int", TEXTS).toPandas().sort_values(["x", "y"])
    model.slope, model.offset = logistic(np.clip(seen["x"].to_numpy(), -20, 40), seen["y"].to_numpy().astype(float))
    model.fitted = True
    kept.drop(rows)
    kept.drop(counts)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted, n_words, passages (word ranges, score and text of every significant segment)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n, found = [], [], []
            for t in b.column(1).to_pylist():
                words, w = model.scores(t)
                x, segments = model.statistic(w) if model.fitted and len(w) else (0.0, [])
                p.append(model.probability(x) if model.fitted and len(w) else 0.0)
                n.append(len(w))
                found.append([{"start": a, "end": e, "score": s, "words": " ".join(words[a:e])} for a, e, s in segments])
            yield pa.record_batch([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(n, pa.int64()), pa.array(found, kind)], ["doc_id", "score", "predicted", "n_words", "passages"])

    return map_arrow(docs, run, "doc_id long, score double, predicted int, n_words long, passages array<struct<start:int,end:int,score:double,words:string>>", TEXTS)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, passages for every row of docs."""
    d = id_and_text(docs)
    out = score(d, fit(spark, d, labels, folds=folds, held=held, **how))
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they were."""
    model = fit(spark, id_and_text(docs, text_col=text_col), labels, **how)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for t in b.column(at).to_pylist():
                w = model.scores(t or "")[1]
                keep.append(not (model.fitted and len(w)) or model.probability(model.statistic(w)[0]) < 0.5)
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, schema, TEXTS)
