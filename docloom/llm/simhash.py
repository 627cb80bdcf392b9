"""SimHash near-dedup by pigeonhole blocks.

Fingerprints: XXH64 (seed 42) of every shingle, and a majority vote on each of the 64 bits. Two fingerprints that
differ in at most `radius` bits agree on at least `blocks - radius` of `blocks` bit blocks, so each fingerprint is
filed under every choice of that many blocks; rows that share a key are compared and the Hamming distance verified.
The number of blocks follows from the number of distinct fingerprints: more blocks, longer keys, fewer chance
meetings. Every choice is exact.

Copies never meet: only distinct fingerprints are compared, and a key's rows give a spanning forest of its links,
not its pairs. A key with more than `tile` fingerprints is cut into tiles that are compared two at a time in
separate tasks.

Defined results: null text is empty; no words gives fingerprint zero, which links like any other; repeated rows have
the same component; texts of any length are read whole, and count in bounded blocks of shingles; an empty table gives an
empty result; other columns, whatever their names, are not read. component_id is the smallest id reachable (null ids are
passed over unless there is no other).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import wide_simhash
from .common import TEXTS, Staged, as_bytes, id_and_text, map_arrow
from .components import connected_components, forest

SEED = 42
_ROWS = 1 << 15


def fingerprint(text: bytes, width: int = 4) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; only A-Z is lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _ROWS):
        part = h[i : i + _ROWS]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in as_bytes(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long", TEXTS)


def _bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def plan_blocks(n: int, radius: int) -> int:
    """Number of blocks for n fingerprints: least of the rows filed and the meetings by chance expected."""

    def cost(blocks: int) -> float:
        agree = blocks - radius
        keys, bits = math.comb(blocks, agree), 64 * agree / blocks
        return 20.0 * n * keys + n * n * keys / 2 ** (bits + 1)

    return min(range(radius + 1, 2 * radius + 2), key=cost)


def _links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of one group's links: from each reached row to the rows it newly reaches."""
    left, out_u, out_v = fps, [], []
    queue: list = []
    while len(left) or queue:
        if queue:
            x = queue.pop()
        else:
            x, left = left[0], left[1:]
        near = np.bitwise_count(left ^ x) <= radius
        if near.any():
            hit = left[near]
            out_u.append(np.full(len(hit), x))
            out_v.append(hit)
            queue.extend(hit)
            left = left[~near]
    if not out_u:
        return fps[:0], fps[:0]
    return np.concatenate(out_u), np.concatenate(out_v)


def _group_links(key: np.ndarray, fps: np.ndarray, radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """key is sorted; rows of small groups are compared side by side, large groups one at a time. fps and the links
    are unsigned, as counting the bits of a signed number counts those of its magnitude."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    us, vs = [], []
    some = np.repeat(sizes <= small, sizes)
    k, f = key[some], fps[some]
    for d in range(1, small):
        if len(k) <= d:
            break
        at = np.flatnonzero(k[d:] == k[:-d])
        if not len(at):
            break
        at = at[np.bitwise_count(f[at + d] ^ f[at]) <= radius]
        us.append(f[at])
        vs.append(f[at + d])
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        u, v = _links(fps[s : s + n], radius)
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def hamming_links(spark: SparkSession, distinct: DataFrame, radius: int = 4, tile: int = 2048) -> DataFrame:
    """distinct: one row for each fingerprint fp. Links (u, v) that connect all pairs at `radius` bits or fewer."""
    n = distinct.count()
    blocks = plan_blocks(max(n, 1), radius)
    bounds = _bounds(blocks)
    mask = lambda some: sum(((1 << (b - a)) - 1) << a for a, b in (bounds[i] for i in some))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(mask(c)) for c in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])
    filed = distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.b", "x.k")
    hot = Staged(spark).put(filed.groupBy("b", "k").count().where(F.col("count") > tile).select("b", "k", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "simhash-hot")
    if hot.isEmpty():
        dealt = filed.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = filed.join(hot, ["b", "k"], "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        dealt = dealt.where("tiles is null or tiles > 1").select("fp", "b", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k = np.zeros((0, 4), np.int64)
        rest_f = np.zeros(0, np.int64)
        u_all, v_all, held = [], [], 0

        def flush() -> pa.RecordBatch:
            u, v = forest(np.concatenate(u_all), np.concatenate(v_all))
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def found(k: np.ndarray, f: np.ndarray) -> int:
            if len(f):
                group = np.cumsum(np.concatenate(([False], (k[1:] != k[:-1]).any(axis=1))))
                u, v = _group_links(group, f.view(np.uint64), radius)
                u_all.append(u)
                v_all.append(v)
                return len(u)
            return 0

        for b in batches:
            k = np.concatenate((rest_k, np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 4)], axis=1)))
            f = np.concatenate((rest_f, b.column(0).to_numpy(zero_copy_only=False)))
            whole = len(f)
            if whole:  # the last group may go on in the next batch
                same = (k == k[-1]).all(axis=1)
                whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held += found(k[:whole], f[:whole])
            rest_k, rest_f = k[whole:], f[whole:]
            if held > 1_000_000:
                yield flush()
                u_all, v_all, held = [], [], 0
        found(rest_k, rest_f)
        if u_all:
            yield flush()

    return map_arrow(dealt.repartition("b", "k", "p", "q").sortWithinPartitions("b", "k", "p", "q").select("fp", "b", "k", "p", "q"), run, "u long, v long")


def near_dedup(spark: SparkSession, docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row."""
    kept = Staged(spark)
    rows = kept.put(fingerprints(docs, width, id_col, text_col), "simhash")
    distinct = kept.put(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = kept.put(hamming_links(spark, distinct.select("fp"), radius), "simhash-links")
    roots = connected_components(spark, links)
    named = kept.put(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    least = kept.put(least, "simhash-least")
    label = kept.put(named.join(least, "root").select("fp", "component_id"), "simhash-label")
    for old in (distinct, links, roots, named, least):
        kept.drop(old)
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_least(spark: SparkSession, docs: DataFrame, radius: int = 4, width: int = 4, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component; all columns as they were. Each row is judged by its
    own id and fingerprint. Rows without an id stay only where their component has none; rows that repeat an id in one
    component stay together.

    With `least`, rows link where their sets of shingles have this Jaccard similarity or more. 64 bits can't decide that:
    at 0.8 two texts differ in 9 bits on average and in up to 17, and of unrelated pairs one in 10^4 is that near. So
    candidates are those of a longer fingerprint, and the sets themselves are compared after it (wide_simhash)."""
    if least is not None:
        return wide_simhash.keep_one(spark, docs, least, width, id_col, text_col)
    decided = near_dedup(spark, docs, radius, width, id_col, text_col)
    lost = decided.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = Staged(spark).put(lost.select(F.col("doc_id").alias("__gone"), F.col("fp").alias("__of")).distinct(), "simhash-gone")
    names, schema = [*docs.columns, "__fp"], StructType([*docs.schema, StructField("__fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in as_bytes(b.column(b.num_columns - 1))]
            yield pa.record_batch([*b.columns[:-1], pa.array(fps, pa.int64())], names)

    tagged = map_arrow(docs.withColumn("__text", F.coalesce(docs[text_col].cast("string"), F.lit(""))), run, schema, TEXTS)
    same = tagged[id_col].cast("long").eqNullSafe(gone["__gone"]) & (tagged["__fp"] == gone["__of"])
    return tagged.join(gone, same, "left_anti").drop("__fp")


def hex_of(column):
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
