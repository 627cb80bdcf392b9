"""Best-fit packing under conflicts.

Items are whole documents in tokens; what exceeds a bin's capacity is cut into full bins and one rest. Items go by
length, longest first. Open bins stand in order of what is left of them and carry two bitmaps, of the sources and of
the duplicate clusters that they hold; the search starts at the tightest bin that is large enough and goes on to the
next until one holds neither the item's source nor its cluster. No two parts from the same source, and no two members
of a duplicate cluster, share a bin.

Items are dealt by a hash of their place in the table into packs of about `pack` items, however many rows there are;
each pack is packed by itself, so a task holds a bounded number of items whatever source or cluster is hot, and however
often a row repeats. The price is at most a few open bins a pack.

Defined results: a null text is empty; an empty text is an item of one separator token; a null source conflicts with
no other document; copies (equal text but for blanks and case) are one cluster; repeated rows are items of their own
in the same cluster; texts of any length are read whole, and a long one fills bins of its own; an empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, map_arrow
from .pieces import count_ids

SCHEMA = "doc_id long, part int, first_token long, n_tokens long, bin_id long, position int, bin_offset int, bin_fill int"


class Bins:
    """Open bins in order of what is left of them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (left, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.fill: list[int] = []
        self.items: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """source and cluster: bitmaps with the item's bit. (bin, position in it, offset in it)."""
        sources, clusters, order = self.sources, self.clusters, self.order
        for at in range(bisect_left(order, (size, -1)), len(order)):
            b = order[at][1]
            if not sources[b] & source and not clusters[b] & cluster:
                del order[at]
                break
        else:
            b = len(self.fill)
            for x in (sources, clusters, self.fill, self.items):
                x.append(0)
        where = b, self.items[b], self.fill[b]
        sources[b] |= source
        clusters[b] |= cluster
        self.items[b] += 1
        self.fill[b] += size
        if self.fill[b] < self.capacity:
            insort(order, (self.capacity - self.fill[b], b))
        return where


def pack_items(items: list[tuple[int, object, object]], capacity: int) -> list[list[tuple[int, int, int, int, int]]]:
    """items: (size, source, cluster). For each its parts: (first token, size, bin, position, offset)."""
    bins = Bins(capacity)
    bits: tuple[dict, dict] = ({}, {})
    out: list[list] = [[] for _ in items]
    parts = []
    for i, (size, source, cluster) in enumerate(items):
        whole = size // capacity
        parts += [(capacity, i, p * capacity) for p in range(whole)]
        if size % capacity:
            parts.append((size % capacity, i, whole * capacity))
    parts.sort(key=lambda x: (-x[0], x[1], x[2]))
    for size, i, first in parts:
        _, source, cluster = items[i]
        s = 1 << bits[0].setdefault(("none", i) if source is None else source, len(bits[0]))
        c = 1 << bits[1].setdefault(cluster, len(bits[1]))
        out[i].append((first, size, *bins.put(size, s, c)))
    for x in out:
        x.sort()
    out_fill = bins.fill
    return [[(*p, out_fill[p[2]]) for p in x] for x in out]


def best_fit(spark: SparkSession, docs: DataFrame, model_path: str, capacity: int = 2048, separators: int = 1, pack: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each part of a document: doc_id, part, first_token, n_tokens, bin_id, position, bin_offset, bin_fill."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    plain = F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    source = docs[source_col].cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), source.alias("source"), F.xxhash64(plain).alias("cluster"), text.alias("text"))
    kept = Staged(spark)
    sized = kept.put(count_ids(rows, model_path), "pack-sizes")
    packs = max(1, -(-sized.count() // pack))
    # the table is written, so a task that runs again reads the same places
    dealt = sized.withColumn("pack", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(packs))).repartition("pack").sortWithinPartitions("pack", "doc_id", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[1] or ""))
            packed = pack_items([(r[3] + separators, r[1], r[2]) for r in rows], capacity)
            cols: list[list] = [[] for _ in range(8)]
            for r, parts in zip(rows, packed):
                for k, (first, size, b, position, offset, fill) in enumerate(parts):
                    for c, x in zip(cols, (r[0], k, first, size, (now << 32) | b, position, offset, fill)):
                        c.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for doc, source, cluster, n, p in zip(*(b.column(i).to_pylist() for i in range(5))):
                if p != now:
                    if rows:
                        yield close()
                    now, rows = p, []
                rows.append((doc, source, cluster, n))
        if rows:
            yield close()

    return map_arrow(dealt.select("doc_id", "source", "cluster", "n_tokens", "pack"), run, SCHEMA)
