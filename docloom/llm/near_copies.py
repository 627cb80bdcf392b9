"""Near copies by word shingles: texts whose sets of shingles have a Jaccard similarity of `least` or more.

Each set gets 80 min-hashes in 20 bands of 4, and sets that agree on a band are compared by their exact similarity.
Two sets at similarity 0.8 share no band with a probability of (1 - 0.8^4)^20, 3 in 10^5; at 0.85 it is 4 in 10^7.
What is linked is always verified.

Equal sets never meet: only distinct sets are filed. Of a band's members those go on whose sketch, a byte of each
min-hash, is near enough to another's (but for one pair in 10^6 at the similarity itself), as a set of shingles is
larger than its text. Bands with the same members are compared once, and a band's members give a spanning forest of
their links, not their pairs. A band key with more than `tile` sets is cut into tiles that are compared two at a time
in separate tasks.

Defined results: words are as in `simhash`; a text of fewer words than a shingle is one shingle; null texts are empty,
and empty texts are copies of one another. Of a component the row with the smallest id stays, rows without an id after
all others, then the smallest digest of the text; rows that repeat id and text are one document and share its decision.

The pipeline's stage has its candidates from `wide_simhash`; the exact check and the choice of what stays are these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS, Staged, as_bytes, list_column, map_arrow
from .components import connected_components

SEED = 42
BANDS, ROWS = 20, 4
_BLOCK = 2048
_draw = np.random.default_rng(SEED)
_FLIP, _TIMES, _MIX = (_draw.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(odd) for n, odd in ((BANDS * ROWS, 0), (BANDS * ROWS, 1), (ROWS, 1)))


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles; only A-Z is lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())], np.uint64))


def min_hashes(grams: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), _BLOCK):
        np.minimum(low, ((grams[i : i + _BLOCK, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes."""
    return (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def sketch(low: np.ndarray) -> bytes:
    """The last byte of each min-hash; the first ones of a minimum are mostly zero."""
    return (low & np.uint64(255)).astype(np.uint8).tobytes()


def least_agreement(least: float) -> int:
    """Bytes on which the sketches of two sets at the similarity agree, but for one pair in 10^6 (five deviations)."""
    n = BANDS * ROWS
    return math.floor(n * least - 5 * math.sqrt(n * least * (1 - least)))


def with_partner(sketches: list[bytes], sizes: list[int], least: float) -> np.ndarray:
    """Which members of a group may be at the similarity to another one, by their sketches and sizes."""
    flat, n = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1), np.array(sizes, float)
    need, out = least_agreement(least), np.zeros(len(n), bool)
    for i in range(len(n)):
        near = (n >= least * n[i] - 1e-9) & (n[i] >= least * n - 1e-9)
        near[: i + 1] = False
        at = np.flatnonzero(near)
        at = at[(flat[at] == flat[i]).sum(axis=1) >= need]
        out[at] = True
        out[i] |= len(at) > 0
    return out


def similar(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among distinct sets: places (u, v) that connect all pairs at `least` or more."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    if not sizes.all():  # equal sets are one, so this is the only empty one
        return ([], []) if len(sets) < 2 else _past_empty(sets, sizes, least)
    kinds, flat = np.unique(flat, return_inverse=True)
    left, us, vs, queue = np.ones(len(sets), bool), [], [], []
    mark = np.zeros(len(kinds), bool)
    while left.any():
        x = queue.pop() if queue else int(np.argmax(left))
        left[x] = False
        own = flat[starts[x] : starts[x] + sizes[x]]
        mark[own] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        hit = np.flatnonzero(left & (both >= least * (sizes + sizes[x] - both) - 1e-9)).tolist()
        us += [x] * len(hit)
        vs += hit
        left[hit] = False
        queue += hit
    return us, vs


def _past_empty(sets: list[np.ndarray], sizes: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    at = np.flatnonzero(sizes).tolist()
    u, v = similar([sets[i] for i in at], least)
    return [at[i] for i in u], [at[i] for i in v]


def _set_hash():
    """The same for groups of the same sets."""
    return F.struct(F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("x"), F.expr("bit_xor(xxhash64(s, 1))").alias("y"))


def _alone(groups: DataFrame, key: list[str]) -> DataFrame:
    """groups: rows (key, s). Of the groups with the same members the first one, if it has two or more: key and n."""
    hashed = groups.groupBy(*key).agg(F.count("*").alias("n"), _set_hash().alias("m")).where("n > 1")
    return hashed.groupBy("n", "m").agg(F.min(F.struct(*key)).alias("x")).select("x.*", "n")


def _grouped(batches: Iterator[pa.RecordBatch], fields: tuple[int, ...], key: slice) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows that come sorted by key."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in fields)):
            if r[key] != now:
                if rows:
                    yield now, rows
                now, rows = r[key], []
            rows.append(r)
    if rows:
        yield now, rows


def shingle_links(spark: SparkSession, distinct: DataFrame, texts: DataFrame, least: float, width: int, tile: int = 2048) -> DataFrame:
    """distinct: one row (s, keys, sketch, size, digest) for each set, with one of its texts' digests; texts: (digest,
    text). Links (u, v) between sets at `least` or more."""
    kept = Staged(spark)
    filed = kept.put(distinct.select("s", F.posexplode("keys").alias("b", "k")), "near-filed")
    groups = kept.put(_alone(filed, ["b", "k"]).select("b", "k", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "near-groups")
    own = F.pmod(F.xxhash64("s"), F.col("tiles")).cast("int")
    met = filed.join(groups, ["b", "k"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.where("tiles = 1 or own <> other").select("s", "b", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    met = met.join(distinct.select("s", "sketch", "size"), "s").repartition("b", "k", "p", "q").sortWithinPartitions("b", "k", "p", "q")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in _grouped(batches, (0, 1, 2, 3, 4, 5, 6), slice(3, 7)):
            if len(rows) > 1:
                may = with_partner([r[1] for r in rows], [r[2] for r in rows], least)
                out += [(rows[i][0], *key) for i in np.flatnonzero(may).tolist()]
            if len(out) > 1 << 16:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["s", "b", "k", "p", "q"])

    likely = kept.put(map_arrow(met.select("s", "sketch", "size", "b", "k", "p", "q"), prune, "s long, b int, k long, p int, q int", TEXTS), "near-likely")
    pairs = ["b", "k", "p", "q"]
    some = kept.put(likely.join(_alone(likely, pairs), pairs).select("s", *pairs), "near-dealt")
    links = exact_links(spark, some, distinct, texts, least, width)
    for old in (filed, groups, likely, some):
        kept.drop(old)
    return links


def exact_links(spark: SparkSession, some: DataFrame, distinct: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """some: rows (s, b, k, p, q), sets that are compared where the other four are equal; distinct: (s, digest), others
    not read. Links (u, v) that connect all pairs of a group at `least` or more, by the sets themselves."""
    kept = Staged(spark)
    wanted = distinct.join(some.select("s").distinct(), "s", "left_semi").select("digest", "s")
    # copies of a text are one before they are shuffled
    held = texts.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest").select("s", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width).view(np.int64) for t in as_bytes(b.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64)))
            yield pa.record_batch([b.column(0), list_column(offsets, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["s", "grams"])

    sets = kept.put(map_arrow(held, grams, "s long, grams array<long>", TEXTS), "near-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, own = None, [], []

        def close() -> pa.RecordBatch:
            u, v = similar(own, least)
            return pa.record_batch([pa.array([names[i] for i in u], pa.int64()), pa.array([names[i] for i in v], pa.int64())], ["u", "v"])

        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_pylist()
            for i, at in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 2, 3, 4, 5)))):
                if at[1:] != now:
                    if len(names) > 1:
                        yield close()
                    now, names, own = at[1:], [], []
                names.append(at[0])
                own.append(values[ends[i] : ends[i + 1]].copy())
        if len(names) > 1:
            yield close()

    dealt = some.join(sets, "s").repartition("b", "k", "p", "q").sortWithinPartitions("b", "k", "p", "q")
    links = kept.put(map_arrow(dealt.select("s", "grams", "b", "k", "p", "q"), run, "u long, v long", TEXTS), "near-links")
    kept.drop(sets)
    return links


def keep_one(spark: SparkSession, docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each component of near copies; all columns as they were."""
    kept = Staged(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    digest = F.sha2(text, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, keys, short, sizes = [], [], [], []
            for t in as_bytes(b.column(2)):
                g = shingles(t, width)
                low = min_hashes(g)
                names.append(xxhash.xxh64_intdigest(g.tobytes(), SEED))
                keys.append(bands(low))
                short.append(sketch(low))
                sizes.append(len(g))
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            cols = [b.column(0), b.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), list_column(np.arange(len(names) + 1) * BANDS, pa.array(flat)), pa.array(short, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.record_batch(cols, ["doc_id", "digest", "s", "keys", "sketch", "size"])

    named = docs.select(docs[id_col].cast("long").alias("doc_id"), digest.alias("digest"), text.alias("text"))
    rows = kept.put(map_arrow(named, run, "doc_id long, digest string, s long, keys array<long>, sketch binary, size int", TEXTS), "near-rows")
    distinct = kept.put(rows.groupBy("s").agg(*[F.first(c).alias(c) for c in ("keys", "sketch", "size")], F.min("digest").alias("digest")), "near-distinct")
    links = shingle_links(spark, distinct, named.select("digest", "text"), least, width)
    out = stay(spark, docs, rows, links, id_col, text_col)
    for old in (rows, distinct, links):
        kept.drop(old)
    return out


def stay(spark: SparkSession, docs: DataFrame, rows: DataFrame, links: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows: (doc_id, digest, s) of docs; links: (u, v) between sets. The rows of docs that stay."""
    kept = Staged(spark)
    digest = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    roots = connected_components(spark, links)
    placed = kept.put(rows.select("doc_id", "digest", "s").join(roots.withColumnRenamed("node", "s"), "s", "left").select("doc_id", "digest", F.coalesce("root", "s").alias("root")), "near-placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("digest").alias("d")))
    best = kept.put(placed.groupBy("root").agg(first.alias("w")), "near-best")
    same = F.col("doc_id").eqNullSafe(F.col("w.i")) & (F.col("digest") == F.col("w.d"))
    gone = kept.put(placed.join(best, "root").where(~same).select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__text")).distinct(), "near-gone")
    for old in (roots, placed, best):
        kept.drop(old)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]) & (digest == gone["__text"]), "left_anti")
