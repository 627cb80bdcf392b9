"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are scaled and given one more component so that the largest inner product is the nearest direction;
they are centred and turned by rotations learned on a bounded sample (iterative quantisation from several starts), and
the signs are the code. Index: a code is cut into substrings, each with its own table of buckets. By the pigeonhole
principle a code within radius r of a query is within t_i of it in some substring i whenever the t_i + 1 add up to
r + 1 or more, so probing those buckets retrieves every code within r; the distance is verified and what is left is
ranked by the inner product of the original vectors in double precision.

Where a query's buckets together hold more rows than there are, all codes are verified instead of the buckets' lists.

The radius is learned: it holds `cover` of the true neighbours of the sample's queries, found by brute force within
the sample. More rows bring nearer neighbours, so recall does not fall with size. Queries that find fewer than k rows
within the radius search again with twice of it, until they have k or all.

Every row is indexed once a block of queries: a task reads its share of the rows batch by batch, indexes each batch and
keeps each query's best k over all of them, so what is shuffled is k rows a query and task, and there are as many tasks
as the cluster runs at once, however many rows there are. Rows never move. Queries come in blocks of bounded bytes,
each broadcast to the tasks and searched in one pass over the rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
whose length is not that of most; a null id takes no part; rows that repeat an id are rows of their own, except that
none with the query's id answers it, and queries of their own, each with k answers; equal scores go to the smaller id;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staged, map_arrow

_BITS = 8  # of a substring
_ROWS = 4096
_VALUES = np.arange(256, dtype=np.uint8)
_POP = np.bitwise_count(_VALUES)


@dataclass
class Codes:
    """Learned codes and radius."""

    top: float  # greatest norm
    mean: np.ndarray
    turns: list[np.ndarray]
    radius: int = 0

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.concatenate((x / n, np.zeros_like(n)), axis=1)
        y = x / self.top
        return np.concatenate((y, np.sqrt(np.maximum(0.0, 1 - (n / self.top) ** 2))), axis=1)

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(rows, substrings) of uint8."""
        if not len(x):
            return np.zeros((0, sum(t.shape[1] for t in self.turns) // _BITS), np.uint8)
        y = self.lifted(x, query) - self.mean
        return np.packbits(np.concatenate([y @ t > 0 for t in self.turns], axis=1), axis=1)


def rotation(y: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Iterative quantisation: principal directions, then the rotation that brings rows nearest to their signs."""
    p = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :bits]
    z = y @ p
    r = np.linalg.qr(rng.standard_normal((p.shape[1], p.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(z @ r).T @ z)
        r = w.T @ u.T
    return p @ r


def distances(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hamming distances of one code to many, both as uint64 words."""
    return np.bitwise_count(codes ^ q).sum(axis=1, dtype=np.int64)


def words64(codes: np.ndarray) -> np.ndarray:
    n = -(-codes.shape[1] // 8) * 8
    if n != codes.shape[1]:
        codes = np.concatenate((codes, np.zeros((len(codes), n - codes.shape[1]), np.uint8)), axis=1)
    return np.ascontiguousarray(codes).view(np.uint64)


def learn(sample: np.ndarray, top: float, k: int, codes: int = 4, cover: float = 0.95, seed: int = 4) -> Codes:
    rng = np.random.default_rng(seed)
    c = Codes(top, np.zeros(sample.shape[1] + 1), [])
    y = c.lifted(sample, False)
    c.mean = y.mean(axis=0)
    # whole substrings: a multiple of 8 bits from each rotation
    bits = max(_BITS, sample.shape[1] // _BITS * _BITS)
    y = y - c.mean
    if y.shape[1] < bits or len(y) < 2:
        y = np.concatenate((y, np.zeros((len(y), max(0, bits - y.shape[1])))), axis=1)
    for _ in range(codes):
        t = rotation(y, bits, rng)
        c.turns.append(t[: sample.shape[1] + 1])
    asked = sample[:256]
    near = words64(c(sample))
    far = []
    mine = words64(c(asked, True))
    for i, q in enumerate(asked):
        s = sample @ q
        s[i] = -np.inf
        best = np.argpartition(-s, min(k, len(s) - 1) - 1)[:k] if len(s) > 1 else np.zeros(0, int)
        far.append(distances(mine[i], near[best[np.isfinite(s[best])]]))
    far = np.concatenate(far) if far else np.zeros(0, int)
    c.radius = int(np.quantile(far, cover, method="higher")) if len(far) else 0
    return c


class Index:
    """Buckets of every substring over one block of rows."""

    def __init__(self, model: Codes, ids: np.ndarray, x: np.ndarray):
        self.model, self.ids, self.x = model, ids, x
        self.codes = np.asfortranarray(model(x))
        self.words = words64(self.codes)
        self.m = self.codes.shape[1]
        self.rows, self.start, self.size = [], [], []
        for j in range(self.m):
            own = self.codes[:, j]
            self.rows.append(np.argsort(own, kind="stable"))
            self.size.append(np.bincount(own, minlength=256))
            self.start.append(np.concatenate(([0], np.cumsum(self.size[j]))))

    def thresholds(self, radius: int) -> list[int]:
        """t_i for each substring: the t_i + 1 add up to radius + 1."""
        base, more = divmod(radius + 1, self.m)
        return [base - 1 + (j < more) for j in range(self.m)]

    def within(self, code: np.ndarray, word: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius."""
        probes = [(j, _POP[_VALUES ^ code[j]] <= t) for j, t in enumerate(self.thresholds(radius)) if t >= 0]
        if sum(int(self.size[j][p].sum()) for j, p in probes) >= len(self.ids):
            at = np.arange(len(self.ids))
        else:
            marked = np.zeros(len(self.ids), bool)
            for j, probed in probes:
                n = self.size[j][probed]
                if total := int(n.sum()):
                    lo = self.start[j][:-1][probed]
                    marked[self.rows[j][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)]] = True
            at = np.flatnonzero(marked)
        return at[distances(word, self.words[at] if len(at) < len(self.ids) else self.words) <= radius]

    def search(self, qid: int, q: np.ndarray, code: np.ndarray, word: np.ndarray, radius: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows within the radius, nearest first, of those that score `floor` or more."""
        at = self.within(code, word, radius) if radius < 8 * self.m else np.arange(len(self.ids))
        at = at[self.ids[at] != qid]
        s = (self.x[at] * q).sum(axis=1)
        good = np.flatnonzero(s >= floor)
        by = good[np.lexsort((self.ids[at[good]], -s[good]))[:k]]
        return self.ids[at[by]], s[by]


@dataclass
class Best:
    """A query's best k so far."""

    ids: np.ndarray
    scores: np.ndarray

    def add(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        if len(ids):
            ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
            by = np.lexsort((ids, -scores))[:k]
            self.ids, self.scores = ids[by], scores[by]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) as doubles, of those that take part."""
    v = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(sound & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


#: Bytes of a block of queries.
QUERIES = 32 << 20


def _found(rows: DataFrame, model: Codes, queries: pa.Table, radius: int, k: int, batch: int) -> DataFrame:
    """rows: (vec_id, v). (q, query_id, vec_id, score): each query's best k within the radius of every task's rows."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((model, queries["q"].to_numpy(), queries["vec_id"].to_numpy(), _matrix(queries["v"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, ids, q = sent.value
        codes = model(q, True)
        words = words64(codes)
        best = [Best(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

        def take(held: list[pa.RecordBatch]) -> None:
            index = Index(model, np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([_matrix(b.column(1)) for b in held]))
            for i, own in enumerate(best):
                floor = own.scores[-1] if len(own.scores) == k else -np.inf
                own.add(*index.search(int(ids[i]), q[i], codes[i], words[i], radius, k, floor), k)

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= batch:
                take(held)
                held, n = [], 0
        if held:
            take(held)
        for i in range(0, len(best), _ROWS):
            some = best[i : i + _ROWS]
            owner = np.repeat(np.arange(i, i + len(some)), [len(x.ids) for x in some])
            cols = [number[owner], ids[owner], np.concatenate([x.ids for x in some]), np.concatenate([x.scores for x in some])]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["q", "query_id", "vec_id", "score"])

    return map_arrow(rows, run, "q long, query_id long, vec_id long, score double")


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 4096, batch: int = 16384, queries: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, its nearest k among all others.
    batch: rows indexed at once; queries: queries of a block (of QUERIES bytes, if None)."""
    kept = Staged(spark)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    rows = rows_at = kept.put(usable(vectors, id_col, vec_col).repartition(tasks), "nearest-rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return empty
    d = dims[0]["d"]
    rows = rows.where(F.size("v") == d)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, top, nq = rows.agg(F.count("*"), F.max(norm), F.count_if(F.col("vec_id") % every == 0)).first()
    if not nq:
        return empty
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # bounded by `sample`
    model = learn(_matrix(picked["v"]), float(top), k)
    size = queries or max(1, QUERIES // (8 * d))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), "vec_id", "v")
    asked = kept.put(asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(-(-nq // size)))), "nearest-queries")
    radius, most, done = model.radius, sum(t.shape[1] for t in model.turns), []
    while True:
        blocks = [r[0] for r in asked.groupBy("block").count().orderBy("block").select("block").collect()]
        found = [kept.put(_found(rows.coalesce(tasks), model, asked.where(F.col("block") == b).select("q", "vec_id", "v").toArrow(), radius, k, batch), "nearest-found") for b in blocks]
        if not found:
            break
        best = reduce(DataFrame.unionByName, found)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        best = kept.put(best.withColumn("rank", rank).where(F.col("rank") <= k), "nearest-best")
        for f in found:
            kept.drop(f)
        done.append(best)
        if radius >= most:
            break
        # rows with the query's own id don't count, so a few queries may search on in vain until the radius holds all
        full = best.where(F.col("rank") == k).select("q")
        asked = kept.put(asked.join(full, "q", "left_anti"), "nearest-queries")
        radius = min(most, max(1, 2 * radius))
    kept.drop(rows_at)
    last = reduce(DataFrame.unionByName, [b.withColumn("turn", F.lit(i)) for i, b in enumerate(done)])
    newest = F.max("turn").over(Window.partitionBy("q"))
    return last.withColumn("newest", newest).where("turn = newest").select("query_id", "rank", "vec_id", "score")
