"""Quality classifier by supervised subword embeddings.

A word's features are the word and its character (byte) n-grams, hashed to buckets that carry learned vectors; a word's
vector is their mean, a document's the mean over its words, and a softmax over two classes reads it. Pseudo-words mark
a word that repeats the one before it or one seen shortly before, and a line that repeats, which single words can't
show (`marks`; without them there are only words and n-grams). Trained by stochastic gradient descent in numpy on the driver, on at most `bound` labelled rows outside the held-out
fold. As the output is linear in the document's vector, scoring keeps one number a bucket, and one a distinct word
while a task lasts.

Defined results: null and empty texts have no words and get the score of the bias alone; without labels of both kinds
every score is the share of label 1 (0.5 without labels); repeated rows score alike; held_out is false for a null id;
an empty table gives an empty result. Only the text enters a score; texts are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS, Staged, id_and_text, map_arrow
from .labels import remainder, training_rows
from .pieces import blocks

FOLDS, HELD = 3, 1
#: Pseudo-words; no text yields them, as words hold no blanks.
ECHO, NEAR, FRESH, SAME_LINE, NEW_LINE = " echo", " near", " fresh", " same line", " new line"
_NEAR = 24


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of each feature, bucket of each feature): the words themselves and their n-grams of 3 and 4 bytes, ends
    marked; a pseudo-word has no n-grams."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    owners = [np.arange(len(words))]
    found = [np.fromiter(map(crc32, raw), np.uint64, len(raw)) % np.uint64(buckets)]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(owners[0], np.fromiter(map(len, raw), np.int64, len(raw)))
    plain = np.fromiter((w[0] != " " for w in words), bool, len(words))
    for n in (3, 4):
        if len(data) < n:
            continue
        h = data[: len(data) - n + 1].copy()
        for i in range(1, n):
            h |= data[i : len(data) - n + 1 + i] << np.uint64(8 * i)
        ok = (owner[n - 1 :] == owner[: len(h)]) & plain[owner[: len(h)]]
        h = (h[ok] | np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        owners.append(owner[: len(ok)][ok])
        found.append((h >> np.uint64(24)) % np.uint64(buckets))
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def word_codes(text: str, numbers: _Numbers, marks: bool = True) -> np.ndarray:
    """Numbers of a text's words, in order, then, with `marks`, one pseudo-word for each word and line."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    code = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    if not marks:
        return code
    echo = np.zeros(n, bool)
    echo[1:] = code[1:] == code[:-1]
    by = np.argsort(code, kind="stable")
    gap = np.full(n, n + _NEAR, np.int64)
    same = code[by[1:]] == code[by[:-1]]
    gap[by[1:][same]] = (by[1:] - by[:-1])[same]
    near = (gap <= _NEAR) & ~echo
    lines = text.split("\n")
    again = len(lines) - len(set(lines))
    each = np.repeat([numbers[x] for x in (ECHO, NEAR, FRESH)], [echo.sum(), near.sum(), n - echo.sum() - near.sum()])
    # lines weigh as much as words together
    per = max(1, round(n / len(lines)))
    rows = np.repeat([numbers[SAME_LINE], numbers[NEW_LINE]], [again * per, (len(lines) - again) * per])
    return np.concatenate((code, each, rows))


@dataclass
class QualityModel:
    buckets: int
    weight: np.ndarray  # what a bucket adds to the logit
    bias: float
    marks: bool = True

    def words(self, words: list[str]) -> np.ndarray:
        owner, bucket = features(words, self.buckets)
        return np.bincount(owner, self.weight[bucket], len(words)) / np.bincount(owner, minlength=len(words))

    def probability(self, logit: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, logit))))


class Scorer:
    """Scores texts, with a bounded table of the words met: it starts anew beyond `most` words or `most_chars`
    characters in them."""

    def __init__(self, model: QualityModel, most: int = 400_000, most_chars: int = 8 << 20):
        self.model, self.most, self.most_chars = model, most, most_chars
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.value = np.zeros(1 << 12)
        self.known = self.chars = 0

    def __call__(self, texts: list[str]) -> list[float]:
        if len(self.numbers) > self.most or self.chars > self.most_chars:
            self.clear()
        codes = [word_codes(t, self.numbers, self.model.marks) for t in texts]
        n = len(self.numbers)
        if n > self.known:
            if n > len(self.value):
                self.value = np.concatenate((self.value, np.zeros(max(n, len(self.value)))))
            new = _last(self.numbers, n - self.known)
            self.chars += sum(map(len, new))
            self.value[self.known : n] = self.model.words(new)
            self.known = n
        return [self.model.probability(self.model.bias + (float(self.value[c].mean()) if len(c) else 0.0)) for c in codes]


def _last(numbers: dict, n: int) -> list[str]:
    """The n youngest keys, oldest first."""
    back = reversed(numbers)
    return [next(back) for _ in range(n)][::-1]


def train(docs: list[np.ndarray], words: list[str], y: np.ndarray, buckets: int, dim: int = 8, epochs: int = 10, rate: float = 0.6, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """docs: word numbers of each document. (vectors of the buckets, output vectors of the two classes, their biases)."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros((buckets, dim), np.float32), np.zeros((2, dim), np.float32), np.log(np.array([1 - p, p]))
    owner, flat = features(words, buckets)
    flat = flat[np.argsort(owner, kind="stable")]
    size = np.bincount(owner, minlength=len(words))
    start = np.cumsum(size) - size
    bags = []
    for code in docs:
        each, count = np.unique(code, return_counts=True)
        n = size[each]
        at = np.repeat(start[each] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        bucket, inverse = np.unique(flat[at], return_inverse=True)
        weight = np.bincount(inverse, np.repeat(count / n / max(1, len(code)), n))
        bags.append((bucket.astype(np.int32), weight.astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = (rng.random((buckets, dim), np.float32) - 0.5) / dim
    out = np.zeros((2, dim), np.float32)
    bias = np.array([math.log(1 - share), math.log(share)], np.float32)
    done, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            step = np.float32(rate * (1 - done / steps))
            done += 1
            bucket, weight = bags[i]
            if not len(bucket):
                continue
            own = vectors[bucket]
            hidden = weight @ own
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= step * np.outer(p, hidden)
            bias -= step * np.float32(0.1) * p
            # rows move by their share of the text, relative to the text's largest share, as an average would hardly move
            vectors[bucket] = own - step * np.outer(weight * np.float32(1.0 / max(float(weight @ weight), 1e-6) ** 0.5), back)
    return vectors, out, bias


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS, held: int = HELD, bound: int = 4000, buckets: int = 1 << 17, marks: bool = True, **how) -> QualityModel:
    """docs: (doc_id, text). The sample comes to the driver one partition at a time."""
    rows = training_rows(docs, labels, label_col, folds, held, bound)
    numbers = _Numbers()
    seen = [(r["doc_id"], r["y"], word_codes(r["text"], numbers, marks)) for r in rows.toLocalIterator()]
    Staged(spark).drop(rows)
    seen.sort(key=lambda r: r[0])
    vectors, out, bias = train([r[2] for r in seen], list(numbers), np.array([r[1] for r in seen], np.int64), buckets, **how)
    # the softmax of two classes depends on the difference of their logits, and that is linear in the mean
    return QualityModel(buckets, vectors @ (out[1] - out[0]), float(bias[1] - bias[0]), marks)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs: (doc_id, text). doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            p = [x for lo, hi in blocks(texts) for x in scorer(texts[lo:hi])]
            yield pa.record_batch([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], ["doc_id", "score", "predicted"])

    return map_arrow(docs, run, "doc_id long, score double, predicted int", TEXTS)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    d = id_and_text(docs)
    out = score(d, fit(spark, d, labels, folds=folds, held=held, **how))
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", folds) == held, F.lit(False))).select("doc_id", "held_out", "score", "predicted")
