"""Near-dedup by SimHash where texts link at a Jaccard similarity of their word shingles, with fingerprints of 1024 bits.

Fingerprints: 1024 bits of every distinct shingle's hash, and a majority vote on each bit. A bit of two sets differs with
a probability that follows from their similarity (`apart`): 0.15 at 0.8, for the smallest sets 0.19; 0.5 for unrelated
sets. Each fingerprint is filed under `tables` keys of `bits` of its bits; rows that share a key are compared by 256 bits
and by the sizes of their sets, and link at `radius` bits or fewer. More distinct sets make longer keys and more of them
(`plan_keys`): fewer rows against fewer chance meetings.

The links' components are the candidates: in each, the sets of shingles themselves are compared (near_copies.exact_links),
and only pairs at the similarity stay linked. So what is linked is always verified. A pair at the similarity itself shares
no key with a probability of 4 in 10^7 or less; where its sets are the smallest (5 shingles against 4 of them), of 2 in
10^5 for 212,000 sets and 2 in 10^4 for 13 million; of 256 bits more than the radius differ for one pair in 10^7, and for one in 10^4.

Copies never meet: only distinct sets are filed. A key's rows give a spanning forest of their links, not their pairs. A
component with more than `tile` sets, or a key with four times as many, is cut into tiles that are compared two at a time in separate tasks.

Defined results, and which row stays, are those of near_copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import TEXTS, Staged, as_bytes, map_arrow
from .components import connected_components, forest

SEED = 42
#: Bits of a fingerprint, and its words of 64 bits that go with each key.
BITS, WORDS = 1024, 4
#: Mean number of keys that a pair at the similarity shares.
SHARED = 10
#: What a filed row costs, in comparisons.
_ROW = 2000
_draw = np.random.default_rng(SEED)
_FLIP, _TIMES = _draw.integers(0, 1 << 64, BITS // 64, np.uint64, endpoint=False), _draw.integers(0, 1 << 64, BITS // 64, np.uint64, endpoint=False) | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(grams: np.ndarray) -> bytes:
    """SimHash of a set of 64-bit shingle hashes; each hash is mixed anew for every 64 bits."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(grams), 255):  # a byte counts so many
        h = (grams[i : i + 255, None] ^ _FLIP) * _TIMES
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        ones = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        counts += ones.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(grams), bitorder="little").tobytes()


def apart(least: float) -> float:
    """Probability that a bit of two sets at the similarity differs: the largest over their sizes. For large sets the
    votes are normal and the angle decides, largest for equal sizes; small ones have ties, and are counted out."""
    worst = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    votes = [[math.comb(n, i) / 2**n for i in range(n + 1)] for n in range(41)]  # of n hashes, i have the bit
    above = lambda n, others: sum(p for i, p in enumerate(votes[n]) if others + 2 * i - n > 0)
    for union in range(2, 41):
        for both in range(math.ceil(least * union - 1e-9), union):
            for a in range((union - both) // 2 + 1):
                p = 0.0
                for i, w in enumerate(votes[both]):
                    x, y = above(a, 2 * i - both), above(union - both - a, 2 * i - both)
                    p += w * (x * (1 - y) + y * (1 - x))
                worst = max(worst, p)
    return worst


def plan_keys(n: int, differ: float) -> tuple[int, int]:
    """(tables, bits) for n sets: least of the rows filed and the meetings by chance expected."""
    tables = lambda bits: math.ceil(SHARED / (1 - differ) ** bits)
    bits = min(range(4, 33), key=lambda b: tables(b) * (_ROW + n / 2 ** (b + 1)))
    return tables(bits), bits


def places(tables: int, bits: int) -> np.ndarray:
    """Bits of each table's key; tables share none until all are used, then others are drawn."""
    draw, each = np.random.default_rng(SEED), BITS // bits
    rounds = [draw.permutation(BITS)[: each * bits].reshape(each, bits) for _ in range(-(-tables // each))]
    return np.concatenate(rounds)[:tables]


def keys(fps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """fps: bytes, a row each. The key of each row in each table, with the table above the 32 bits of the key."""
    ones = np.unpackbits(fps, axis=1, bitorder="little")
    out = np.zeros((len(fps), len(at)), np.int64)
    for j in range(at.shape[1]):
        out |= ones[:, at[:, j]].astype(np.int64) << j
    return out | np.arange(len(at), dtype=np.int64) << 32


def reach(differ: float, bits: int, deviations: int) -> int:
    """Differing bits of two sets at the similarity, but for few pairs."""
    return math.floor(bits * differ + deviations * math.sqrt(bits * differ * (1 - differ)))


def links(words: np.ndarray, sizes: np.ndarray, differ: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """words: (rows, WORDS). Places (u, v) that connect all pairs of one group within the radius."""
    n, radius, half = len(words), reach(differ, 64 * WORDS, 4), reach(differ, 32 * WORDS, 5)
    us, vs, step = [], [], min(64, max(1, (1 << 17) // n))
    for i in range(0, n, step):
        a, rest = words[i : i + step], words[i:]
        d = np.zeros((len(a), len(rest)), np.uint8)
        for w in range(WORDS // 2):
            d += np.bitwise_count(a[:, None, w] ^ rest[None, :, w])
        u, v = np.nonzero(d <= half)  # half of the words pass over most
        u, v = u[v > u], v[v > u]
        if len(u) > 8 * len(a) + 64:
            return _spread(words, sizes, radius, least)
        near = _near(a[u], rest[v], sizes[i + u], sizes[i + v], radius, least)
        us.append(i + u[near])
        vs.append(i + v[near])
    return np.concatenate(us), np.concatenate(vs)


def _near(a: np.ndarray, b: np.ndarray, n, m, radius: int, least: float) -> np.ndarray:
    return (np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= radius) & (n >= least * m - 1e-9) & (m >= least * n - 1e-9)


def _spread(words: np.ndarray, sizes: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for a group with many links, from each reached row to the rows it newly reaches."""
    left, us, vs = np.arange(len(words)), [], []
    queue: list = []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = left[0], left[1:]
        near = _near(words[left], words[x], sizes[left], sizes[x], radius, least)
        hit = left[near]
        us.append(np.full(len(hit), x))
        vs.append(hit)
        queue.extend(hit.tolist())
        left = left[~near]
    return np.concatenate(us), np.concatenate(vs)


def _dealt(rows: DataFrame, tiles: DataFrame, key: str, name: str) -> DataFrame:
    """rows with p and q: two of the tiles of its key, each pair of tiles a row meets."""
    own = F.pmod(F.xxhash64(name), F.col("tiles")).cast("int")
    met = rows.join(tiles, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("tiles = 1 or own <> other")
    return met.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("tiles", "own", "other")


def fingerprint_links(spark: SparkSession, distinct: DataFrame, least: float, tile: int = 8192) -> DataFrame:
    """distinct: one row (s, fp, size) for each set. Links (u, v) between sets whose fingerprints are within the radius."""
    kept, differ = Staged(spark), apart(least)
    at = places(*plan_keys(max(distinct.count(), 1), differ))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                yield b, np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fps in parts(batches):
            yield pa.record_batch([pa.array(keys(fps, at).ravel())], ["g"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, fps in parts(batches):
            words = np.repeat(fps[:, : 8 * WORDS].copy().view(np.int64), len(at), axis=0)
            s, size = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), len(at)) for i in (1, 2))
            yield pa.record_batch([pa.array(c) for c in (keys(fps, at).ravel(), s, size, *words.T.copy())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, us, vs, n = [], [], [], 0

        def meet(whole: bool) -> None:
            """Compares the groups held; the last one may go on in the next batch."""
            nonlocal held, n
            t = pa.Table.from_batches(held)
            cols = [t.column(i).to_numpy() for i in range(len(names) + 2)]
            g, p, q = cols[0], cols[-2], cols[-1]
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            ends = [0, *cuts.tolist(), *([len(g)] if whole else [])]
            words = np.stack(cols[3:-2], axis=1).view(np.uint64)
            for a, z in zip(ends[:-1], ends[1:]):
                if z - a > 1:
                    u, v = links(words[a:z], cols[2][a:z], differ, least)
                    us.append(cols[1][a + u])
                    vs.append(cols[1][a + v])
                    n += len(u)
            held = t.slice(ends[-1]).combine_chunks().to_batches()

        def flush() -> pa.RecordBatch:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            return pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 1 << 14:
                meet(False)
            if n > 1_000_000:
                yield flush()
                us, vs, n = [], [], 0
        if held:
            meet(True)
        if us:
            yield flush()

    names = ["g", "s", "size", *(f"w{i}" for i in range(WORDS))]
    rows = distinct.select("fp", "s", "size")
    counts = map_arrow(rows.select("fp"), only_keys, "g long", TEXTS).groupBy("g").count().where(F.col("count") > tile)
    hot = kept.put(counts.select("g", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "wide-hot")
    filed = map_arrow(rows, file, "g long, s long, size int, " + ", ".join(f"w{i} long" for i in range(WORDS)), TEXTS)
    dealt = filed.withColumn("p", F.lit(0)).withColumn("q", F.lit(0)) if hot.isEmpty() else _dealt(filed, hot, "g", "s")
    dealt = dealt.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q").select(*names, "p", "q")
    out = kept.put(map_arrow(dealt, run, "u long, v long"), "wide-links")
    kept.drop(hot)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = 2048) -> DataFrame:
    """The rows of docs that stay, one document of each component of near copies; all columns as they were."""
    kept = Staged(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, fps, sizes = [], [], []
            for t in as_bytes(b.column(2)):
                g = near_copies.shingles(t, width)
                names.append(xxhash.xxh64_intdigest(g.tobytes(), SEED))
                fps.append(fingerprint(g))
                sizes.append(len(g))
            cols = [b.column(0), b.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.record_batch(cols, ["doc_id", "digest", "s", "fp", "size"])

    named = docs.select(docs[id_col].cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    rows = kept.put(map_arrow(named, run, "doc_id long, digest string, s long, fp binary, size int", TEXTS), "wide-rows")
    distinct = kept.put(rows.groupBy("s").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min("digest").alias("digest")), "wide-distinct")
    found = fingerprint_links(spark, distinct, least, 4 * tile)
    placed = connected_components(spark, found).select(F.col("node").alias("s"), F.lit(0).alias("b"), F.col("root").alias("k"))
    tiles = placed.groupBy("k").count().where(F.col("count") > tile).select("k", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    some = kept.put(_dealt(placed, tiles, "k", "s").select("s", "b", "k", "p", "q"), "wide-dealt")
    exact = near_copies.exact_links(spark, some, distinct, named.select("digest", "text"), least, width)
    out = near_copies.stay(spark, docs, rows, exact, id_col, text_col)
    for old in (rows, distinct, found, some, exact):
        kept.drop(old)
    return out
