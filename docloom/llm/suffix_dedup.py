"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts elsewhere.

1. Anchors. Every window of `length` bytes names its least k-gram (by a rolling hash, the rightmost of equals), so
   equal windows name equal k-grams at the same offset. An anchor is a named k-gram with the run of windows that name
   it; its segment is all those windows' bytes. Each window belongs to exactly one anchor.
2. Only anchors whose k-gram occurs twice or more go on. If all of a k-gram's segments are the same bytes, each of
   their windows is repeated and there is nothing to sort.
3. Otherwise copies of a segment are collapsed (with their number), segments are cut to what any other shares with
   them around the k-gram, and the suffix array of the distinct strings (suffix_sort) decides: of the windows that
   begin in an anchor's run, neighbours in suffix order that agree on `length` bytes are repeated.
4. A k-gram with more than `most` distinct segments (an edge of a passage that very many texts quote) is not brought
   into one task: its segments are dealt into blocks, each decided as above. What else blocks share is found by 128-bit
   hashes: first of the bytes that `_STEP` neighbouring windows have in common, and only where those recur in another
   block, of the single windows.
5. Repeated windows go back to all occurrences, and each text drops the union of their bytes.

Matches never cross documents. Judged on the input; overlaps count. Defined results: null text is empty; a text under
`length` bytes loses nothing; repeated rows are documents of their own, so a long one loses all its bytes; an empty
table gives an empty result. Texts of any length are read whole, in blocks that overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXTS, Staged, as_bytes, id_and_text, map_arrow
from .suffix_sort import suffix_array

_BLOCK = 1 << 20
#: Symbols of texts whose anchors are found at once.
_GROUP = 1 << 17
_WORD = re.compile(rb"\S+")
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = ~_LOW


class _Roller:
    """Rolling hash of k-grams, all positions at once: a polynomial over a random byte table, modulo 2**64. With a
    `unit` of 8 bytes, which are hashes already, positions are multiples of it and k-grams of k // 8 such symbols."""

    def __init__(self, k: int, unit: int = 1):
        if unit not in (1, 8):
            raise ValueError("a unit is a byte or 8 of them")
        base = 0x9E3779B97F4A7C15
        self.k, self.unit = k // unit, unit
        self.table = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.back)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self.powers(n)
        s = np.empty(n + 1, np.uint64)
        s[0] = 0
        np.cumsum((self.table[data] if self.unit == 1 else data) * self.up[:n], out=s[1:])
        h = (s[self.k :] - s[: -self.k]) * self.down[: n - self.k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(v)
    rows = -(-n // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    full = full.reshape(rows, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors_of(text: bytes, length: int, roller: _Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, last window) of every run of windows that name the same anchor."""
    unit = roller.unit
    n = length // unit
    w = n - roller.k + 1
    out = []
    whole = np.frombuffer(text, np.uint8 if unit == 1 else "<u8")
    for base in range(0, len(whole) - n + 1, _BLOCK):
        data = whole[base : base + _BLOCK + n - 1]
        h = roller(data)
        named = _LOW - (_least((h & _HIGH) | (_LOW - np.arange(len(h), dtype=np.uint64)), w) & _LOW)
        first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
        last = np.concatenate((first[1:] - 1, [len(named) - 1]))
        out.append((named[first].astype(np.int64) + base, first + base, last + base))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) * unit for x in zip(*out))


def anchors_of_all(texts: list[bytes], length: int, roller: _Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor position, first window, last window) for all texts, in order: short texts lie side by side in one
    array, and windows that cross from one to the next are left out."""
    unit, n = roller.unit, length // roller.unit
    w = n - roller.k + 1
    out: list[tuple] = []
    group: list[int] = []
    size = 0

    def close() -> None:
        data = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8 if unit == 1 else "<u8")
        h = roller(data)
        named = _LOW - (_least((h & _HIGH) | (_LOW - np.arange(len(h), dtype=np.uint64)), w) & _LOW)
        sizes = np.array([len(texts[i]) // unit for i in group])
        starts, windows = np.cumsum(sizes) - sizes, sizes - n + 1
        at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        named = named[at].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
        last = np.concatenate((first[1:] - 1, [len(named) - 1]))
        base = np.repeat(starts, windows)[first]
        out.append((np.repeat(group, windows)[first], *((x - base) * unit for x in (named[first], at[first], at[last]))))
        group.clear()

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > _GROUP * unit:
            if group:
                close()
                size = 0
            own = anchors_of(t, length, roller)
            out.append((np.full(len(own[0]), i), *own))
            continue
        group.append(i)
        size += len(t) // unit
        if size >= _GROUP:
            close()
            size = 0
    if group:
        close()
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none, none)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, *range(9, 14)]] = True


class _WordHasher:
    """Texts as the 8-byte hashes of their words: the same polynomial as of k-grams, read off its prefix sums, so a
    word's hash doesn't depend on where it stands."""

    def __init__(self):
        self.roller = _Roller(1)

    def hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every word."""
        r, n = self.roller, len(data)
        r.powers(n)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(r.table[data] * r.up[:n], out=s[1:])
        blank = np.concatenate(([True], _IS_BLANK[data], [True]))
        start, end = np.flatnonzero(~blank[1:-1] & blank[:-2]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
        h = (s[end] - s[start]) * r.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return start, h

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        group: list[bytes] = []
        size = 0

        def close() -> None:
            start, h = self.hashes(np.frombuffer(b" ".join(group), np.uint8))
            ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in group])).tolist()
            out.extend(h[a:b].tobytes() for a, b in zip([0, *ends], ends))
            group.clear()

        for t in texts:
            if len(t) <= _GROUP:
                group.append(t)
                size += len(t)
            if group and (size >= _GROUP or len(t) > _GROUP):
                close()
                size = 0
            if len(t) > _GROUP:
                out.append(b"".join(self.hashes(np.frombuffer(p, np.uint8))[1].tobytes() for p in _cut_at_blanks(t)))
        if group:
            close()
        return out


def _cut_at_blanks(text: bytes) -> Iterator[bytes]:
    """A text in parts of about _GROUP bytes, none of which ends within a word."""
    at = 0
    while at < len(text):
        stop = _BLANK.search(text, min(at + _GROUP, len(text)))
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _most_shared(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix it shares with any other of the list."""
    by = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for x, y in zip(by, by[1:]):
        n = _shared(parts[x], parts[y])
        if n > out[x]:
            out[x] = n
        if n > out[y]:
            out[y] = n
    return out


def repeated_starts(segments: list[tuple[bytes, int, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """segments: (bytes, far, near, copies), distinct as a whole; the k-gram begins `far` bytes in, and windows begin
    far to near bytes before it. For each segment, the ranges (far, near) of its windows that are repeated."""
    ahead = _most_shared([s[far:] for s, far, _, _ in segments])
    behind = _most_shared([s[:far][::-1] for s, far, _, _ in segments])
    classes: dict[tuple[bytes, int], list] = {}
    for i, (s, far, near, n) in enumerate(segments):
        b, a = behind[i], ahead[i]
        if a + b >= length:
            x = classes.setdefault((s[far - b : far + a], b), [0, []])
            x[0] += n
            x[1].append(i)
    out = [[(far, near)] if n > 1 else [] for _, far, near, n in segments]  # of copies, all windows are repeated
    strings = list(classes)
    flags = [np.full(max(0, len(s) - length + 1), classes[s, b][0] > 1) for s, b in strings]
    if not all(f.all() for f in flags):
        joined: list[int] = []
        base = []
        gap = len(strings)
        for j, (s, _) in enumerate(strings):
            base.append(len(joined))
            joined.extend([c + gap for c in s])
            joined.append(j)
        runs = np.full(len(joined), -1, np.int64)  # the string of each window that an anchor's run holds
        for j, (s, b) in enumerate(strings):
            far, near = max(segments[i][1] for i in classes[s, b][1]), min(segments[i][2] for i in classes[s, b][1])
            lo, hi = max(0, b - far), min(b - near, len(s) - length)
            if hi >= lo:
                runs[base[j] + lo : base[j] + hi + 1] = j
        order = np.array(suffix_array(joined), np.int64)
        order = order[runs[order] >= 0]
        last = None
        for p in order.tolist():
            j = int(runs[p])
            o = p - base[j]
            window = strings[j][0][o : o + length]
            if last is not None and window == last[0]:
                flags[j][o] = flags[last[1]][last[2]] = True
            last = (window, j, o)
    for (s, b), flag in zip(strings, flags):
        if not flag.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
        for lo, hi in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
            for i in classes[s, b][1]:
                if segments[i][3] > 1:
                    continue
                far, near = min(b - lo, segments[i][1]), max(b - hi, segments[i][2])
                if far >= near:
                    out[i].append((far, near))
    return out


def _anchors(rows: DataFrame, length: int, k: int, unit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(k, unit)
        hashed = _WordHasher()
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            texts = as_bytes(b.column(2)) if unit == 1 else hashed(as_bytes(b.column(2)))
            at, pos, lo, hi = anchors_of_all(texts, length, roller)
            if len(at):
                h, g = [], []
                for i, p, x, y in zip(at.tolist(), pos.tolist(), lo.tolist(), hi.tolist()):
                    t = texts[i]
                    h.append(digest(t[p : p + k]))
                    g.append(digest(t[x : y + length], p - x))
                named = pa.array(at)
                cols = [pa.array(pos), pa.array((pos - lo).astype(np.int32)), pa.array((pos - hi).astype(np.int32)), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (h, g))]
                yield pa.record_batch([b.column(0).take(named), b.column(1).take(named), *cols], ["doc_id", "t", "pos", "far", "near", "h", "g"])

    return map_arrow(rows, run, "doc_id long, t long, pos long, far int, near int, h long, g long", TEXTS)


def _segments(wanted: DataFrame, length: int, unit: int) -> DataFrame:
    """wanted: text, the list `at` of its anchors, rid and rt. One row for each anchor, with the segment's bytes. Rows
    that repeat id and text want the same: a task answers once; what it remembers are rows of the list of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        hashed = _WordHasher()
        for b in batches:
            new = []
            for i, key in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(new) < b.num_rows:
                b = b.take(pa.array(new, pa.int64()))
            at = b.column(1)
            each = at.flatten()
            texts = as_bytes(b.column(0)) if unit == 1 else hashed(as_bytes(b.column(0)))
            owner = np.repeat(np.arange(len(texts)), at.value_lengths().to_numpy(zero_copy_only=False))
            pos, far, near = (each.field(n).to_numpy(zero_copy_only=False) for n in ("pos", "far", "near"))
            size = 0
            parts, start = [], 0
            names = ["h", "g", "n", "far", "near"]
            for i, (o, p, x, y) in enumerate(zip(owner.tolist(), pos.tolist(), far.tolist(), near.tolist())):
                parts.append(texts[o][p - x : p - y + length])
                size += len(parts[-1])
                if size > 1 << 23:
                    yield pa.record_batch([each.slice(start, i + 1 - start).field(n) for n in names] + [pa.array(parts, pa.binary())], [*names, "seg"])
                    parts, size, start = [], 0, i + 1
            if parts:
                yield pa.record_batch([each.slice(start).field(n) for n in names] + [pa.array(parts, pa.binary())], [*names, "seg"])

    return map_arrow(wanted, run, "h long, g long, n long, far int, near int, seg binary")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[tuple[bytes, int, int, int]]]]:
    """(h, keys, segments) for each group of rows (h, part, g, n, far, near, seg), which come sorted by h, part and g."""
    now, keys, group = None, [], []
    for b in batches:
        for h, part, g, n, far, near, seg in zip(*(b.column(i).to_pylist() for i in range(7))):
            if (h, part) != now:
                if keys:
                    yield now[0], keys, group
                now, keys, group = (h, part), [], []
            if not keys or keys[-1] != g or group[-1][:3] != (seg, far, near):
                keys.append(g)
                group.append((seg, far, near, n))
    if keys:
        yield now[0], keys, group


_ROWS = 1 << 16


def _sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """Repeated windows of every group, by its suffix array."""
    kinds = {"h": pa.int64(), "g": pa.int64(), "a": pa.int32(), "b": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for h, keys, group in _grouped(batches):
            if len(group) > 1 or group[0][3] > 1:
                out += [(h, g, *r) for g, ranges in zip(keys, repeated_starts(group, length)) for r in ranges]
            if len(out) > _ROWS:
                yield columns(out, kinds)
                out = []
        if out:
            yield columns(out, kinds)

    return map_arrow(rows, run, "h long, g long, a int, b int")


#: Neighbouring windows whose common bytes are compared first.
_STEP = 16


def _cores(rows: DataFrame, length: int) -> DataFrame:
    """The bytes that each step of a segment's windows has in common, hashed; a step is the same distances from the
    k-gram in every segment."""
    kinds = {"h": pa.int64(), "part": pa.int32(), "g": pa.int64(), "step": pa.int32(), "core": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out = []
            for h, part, g, _, far, near, seg in zip(*(b.column(i).to_pylist() for i in range(7))):
                for step in range(near // _STEP, far // _STEP + 1):
                    lo = step * _STEP  # windows begin lo to lo + _STEP - 1 bytes before the k-gram
                    out.append((h, part, g, step, digest(seg[far - lo : far - lo - _STEP + 1 + length])))
            if out:
                yield columns(out, kinds)

    return map_arrow(rows, run, "h long, part int, g long, step int, core binary")


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """rows: as of a group, and the steps that count. The different windows of every group in those steps with their
    128-bit hash, and whether the group holds them once."""
    kinds = {"h": pa.int64(), "g": pa.int64(), "d": pa.int32(), "w": pa.binary(), "once": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        steps: dict[tuple[int, int], list[int]] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for b in batches:
                steps.update(zip(zip(b.column(0).to_pylist(), b.column(2).to_pylist()), b.column(7).to_pylist()))
                yield b

        out: list[tuple] = []
        for h, keys, group in _grouped(noted()):
            seen: dict[tuple[int, bytes], int] = {}
            twice = set()
            for g, (seg, far, near, n) in zip(keys, group):
                for step in steps.pop((h, g)):
                    for d in range(max(near, step * _STEP), min(far, step * _STEP + _STEP - 1) + 1):
                        key = (d, digest(seg[far - d : far - d + length]))
                        if seen.setdefault(key, g) != g or n > 1:
                            twice.add(key)
            out += [(h, g, *key, key not in twice) for key, g in seen.items()]
            if len(out) > _ROWS:
                yield columns(out, kinds)
                out = []
        if out:
            yield columns(out, kinds)

    return map_arrow(rows, run, "h long, g long, d int, w binary, once boolean")


def columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def repeated_spans(spark: SparkSession, rows: DataFrame, length: int = 400, k: int = 64, most: int = 512, unit: int = 1) -> DataFrame:
    """rows: (doc_id, t, text). (doc_id, t, starts), starts being the list of ranges of window starts that are repeated.
    With a `unit` of 8, texts are read as the 8-byte hashes of their words, and windows begin at one of them."""
    kept = Staged(spark)
    found = kept.put(_anchors(rows, length, k, unit), "suffix-anchors")
    shared = found.groupBy("h").agg(F.count("*").alias("c"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("c > 1")
    shared = kept.put(shared.select("h", (F.col("g0") != F.col("g1")).alias("mixed")), "suffix-shared")
    some = kept.put(found.join(shared, "h"), "suffix-candidates")
    kept.drop(found)
    kept.drop(shared)
    alike = some.where("not mixed").select("doc_id", "t", (F.col("pos") - F.col("far")).alias("lo"), (F.col("pos") - F.col("near")).alias("hi"))
    mixed = some.where("mixed").drop("mixed")
    first = F.min(F.struct("doc_id", "t", "pos", "far", "near")).alias("r")
    reps = kept.put(mixed.groupBy("h", "g").agg(F.count("*").alias("n"), first).select("h", "g", "n", "r.*"), "suffix-representatives")
    listed = reps.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "g", "n", "pos", "far", "near")).alias("at"))
    listed = listed.select(F.col("doc_id").alias("rid"), F.col("t").alias("rt"), "at")
    wanted = rows.join(listed, rows["doc_id"].eqNullSafe(listed["rid"]) & (rows["t"] == listed["rt"])).select("text", "at", "rid", "rt")
    segments = kept.put(_segments(wanted, length, unit), "suffix-segments")
    parts = F.ceil(F.col("count") / most).cast("int").alias("parts")
    large = kept.put(reps.groupBy("h").count().where(F.col("count") > most).select("h", parts), "suffix-large")
    kept.drop(reps)
    wide = not large.isEmpty()
    placed = segments.join(large, "h", "left") if wide else segments.withColumn("parts", F.lit(None).cast("int"))
    placed = placed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"), F.lit(0)))
    together = lambda df: df.repartition("h", "part").sortWithinPartitions("h", "part", "g").select("h", "part", "g", "n", "far", "near", "seg")
    said = _sorted_groups(together(placed), length)
    if wide:
        hot = kept.put(placed.where("parts is not null").dropDuplicates(["h", "g"]).drop("parts"), "suffix-hot")
        cores = kept.put(_cores(hot.select("h", "part", "g", "n", "far", "near", "seg"), length), "suffix-cores")
        shared = cores.groupBy("h", "step", "core").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1")
        steps = cores.join(shared.select("h", "step", "core"), ["h", "step", "core"], "left_semi").groupBy("h", "g").agg(F.collect_set("step").alias("steps"))
        there = hot.join(steps, ["h", "g"]).repartition("h", "part").sortWithinPartitions("h", "part", "g")
        windows = kept.put(_windows(there.select("h", "part", "g", "n", "far", "near", "seg", "steps"), length), "suffix-windows")
        often = kept.put(windows.groupBy("h", "d", "w").count().where("count > 1").select("h", "d", "w"), "suffix-often")
        apart = F.col("d") - F.row_number().over(Window.partitionBy("h", "g").orderBy("d"))  # at most a segment's windows
        hits = windows.where("once").join(often, ["h", "d", "w"]).select("h", "g", "d", apart.alias("run"))
        said = said.unionByName(hits.groupBy("h", "g", "run").agg(F.max("d").alias("a"), F.min("d").alias("b")).drop("run"))
    said = kept.put(said, "suffix-answers")
    for old in (segments, large, *((hot, cores, windows, often) if wide else ())):
        kept.drop(old)
    differ = mixed.join(said, ["h", "g"]).select("doc_id", "t", (F.col("pos") - F.col("a")).alias("lo"), (F.col("pos") - F.col("b")).alias("hi"))
    spans = alike.unionByName(differ).groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    spans = kept.put(spans, "suffix-spans")
    kept.drop(some)
    kept.drop(said)
    return spans


def _runs(ranges: list[tuple[int, int]], length: int) -> list[list[int]]:
    """The union of the windows that start in the ranges, as [start, end) runs."""
    runs: list[list[int]] = []
    for x, y in sorted(ranges):
        if runs and x <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], y + length)
        else:
            runs.append([x, y + length])
    return runs


def _in_words(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of window starts among 8-byte word hashes, as ranges of words."""
    return [(-(-lo // 8), hi // 8) for lo, hi in ranges]


def _ranges(column) -> list[list[tuple[int, int]]]:
    """Each row's ranges (lo, hi) of an Arrow column of lists; none for a null."""
    flat, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    both = list(zip(flat.field("lo").to_pylist(), flat.field("hi").to_pylist()))
    return [both[a:b] for a, b in zip([0, *ends], ends)]


def _cut(rows: DataFrame, length: int, words: int) -> DataFrame:
    """rows: (doc_id, text, starts or null, worded or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, spans, texts, where, passages, covered = [], [], [], [], [], [], []
            for t, ranges, worded in zip(as_bytes(b.column(1)), _ranges(b.column(2)), _ranges(b.column(3))):
                sizes.append(len(t))
                runs = _runs(ranges, length)
                removed.append(sum(y - x for x, y in runs))
                spans.append(len(runs))
                at, left = 0, []
                for x, y in runs:
                    left.append(t[at:x])
                    at = y
                left.append(t[at:])
                texts.append(b"".join(left) if runs else t)
                where.append([{"start": x, "end": y} for x, y in runs])
                said = _runs(_in_words(worded), words)
                passages.append(len(said))
                covered.append(sum(y - x for x, y in said))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            counts = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
            yield pa.record_batch(
                [b.column(0), *counts, pa.array(texts, pa.binary()), pa.array(where, kind), pa.array(passages, pa.int64()), pa.array(covered, pa.int64())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", "n_passages", "n_passage_words"],
            )

    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>, n_passages long, n_passage_words long", TEXTS)


def _spans(spark: SparkSession, rows: DataFrame, length: int, words: int | None, k: int = 64, most: int = 512) -> DataFrame:
    """(sid, st, starts, worded): repeated windows of `length` bytes and, with `words`, of so many words."""
    spans = repeated_spans(spark, rows, length, k, most).withColumn("by_word", F.lit(False))
    if words:
        # of short windows no k-gram of 8 words can be named
        by_word = repeated_spans(spark, rows, 8 * words, 8 * min(8, words), most, 8)
        spans = spans.unionByName(by_word.withColumn("by_word", F.lit(True)))
    of = lambda by_word: F.first(F.when(F.col("by_word") == by_word, F.col("starts")), ignorenulls=True)
    return spans.groupBy(F.col("doc_id").alias("sid"), F.col("t").alias("st")).agg(of(False).alias("starts"), of(True).alias("worded"))


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 400, k: int = 64, most: int = 512, words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (byte ranges removed), n_passages, n_passage_words, one
    row for each row of docs. The last two report, with `words`, the maximal runs of words (apart by any of
    [\\x20\\x09-\\x0D]) in strings of so many words that also start elsewhere; nothing is removed for them."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("t"), "text")
    spans = _spans(spark, rows, length, words, k, most)
    both = rows.join(spans, rows["doc_id"].eqNullSafe(spans["sid"]) & (rows["t"] == spans["st"]), "left")
    return _cut(both.select("doc_id", "text", "starts", "worded"), length, words or 1)


def cut_texts(spark: SparkSession, docs: DataFrame, length: int = 400, words: int | None = None, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with the repeated bytes gone from its texts, all columns and rows otherwise as they were. What a cut leaves
    of a character goes too. With `words`, so do strings of so many words (apart by any of [\\x20\\x09-\\x0D]) that also
    start elsewhere, however short: a string of words is one of their hashes, eight bytes each. size_col, if there, is
    the text's new length in code points."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    spans = _spans(spark, rows, length, words).withColumnsRenamed({"sid": "__sid", "st": "__st", "starts": "__starts", "worded": "__words"})
    both = docs.join(spans, docs[id_col].cast("long").eqNullSafe(spans["__sid"]) & (F.xxhash64(text) == spans["__st"]), "left")
    both = both.drop("__sid", "__st")
    at, last = docs.columns.index(text_col), len(docs.columns)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(last)]
            texts = cols[at].to_pylist()
            for i, (ranges, worded) in enumerate(zip(_ranges(b.column(last)), _ranges(b.column(last + 1)))):
                if ranges or worded:
                    keep = np.ones(len(raw := texts[i].encode()), bool)
                    for x, y in _runs(ranges, length):
                        keep[x:y] = False
                    place = [m.span() for m in _WORD.finditer(raw)] if worded else []
                    for x, y in _in_words(worded):
                        keep[place[x][0] : place[y + words - 1][1]] = False
                    texts[i] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.record_batch(cols, names=[f.name for f in schema])

    out = map_arrow(both, run, schema, TEXTS)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.char_length(text_col).cast(schema[size_col].dataType))
    return out
