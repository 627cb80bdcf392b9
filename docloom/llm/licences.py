"""Licence scan: passages against templates by the Dice coefficient over word bigrams.

Texts are normalised to their lower-case words. Passages are ranges of words, within lines or across them, so whole
texts are scanned and a statement inside a long document counts. A template of n bigrams can only reach a Dice
coefficient d against passages of n * d / (2 - d) to n * (2 - d) / d bigrams; all such ranges that begin and end in a
bigram of the template are compared, over multisets of bigrams, whatever stands between.

Defined results: null and empty texts hold no licence; repeated rows give equal rows; texts of any length are scanned
whole; an empty table gives an empty result; other columns, whatever their names, are not read. Of matches that overlap the highest coefficient stays, then the longer, then the first template.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, id_and_text, map_arrow
from .licence_texts import TEMPLATES

_words = re.compile(r"[^\W_]+").findall


def normalised(text: str) -> list[str]:
    return _words(text.lower())


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


class Scanner:
    """Templates by size, with the words and bigrams that occur in them."""

    def __init__(self, templates: list[tuple[str, str]], least: float = 0.8):
        self.least = least
        rows = [(name, normalised(text)) for name, text in templates]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in rows for w in ws))}
        self.templates = []
        for name, ws in rows:
            codes = [self.number[w] for w in ws]
            bag = Counter(zip(codes, codes[1:]))
            if bag:
                self.templates.append((bag.total(), name, bag))
        self.templates.sort(key=lambda t: t[0])
        # a match shares at least so many bigrams with the smallest template
        self.shared = max(1, math.ceil(min((t[0] for t in self.templates), default=1) * least / (2 - least) - 1e-9))
        self.holders: dict[tuple[int, int], list[int]] = {}
        for t, (_, _, bag) in enumerate(self.templates):
            for p in bag:
                self.holders.setdefault(p, []).append(t)
        self.known = np.array(sorted(a * len(self.number) + b for a, b in self.holders), np.int64)

    def hits(self, code: np.ndarray) -> np.ndarray:
        """Places of bigrams that some template holds."""
        n = len(self.number)
        at = np.flatnonzero((code[:-1] < n) & (code[1:] < n))
        pair = code[at] * n + code[at + 1]
        place = np.searchsorted(self.known, pair)
        place[place == len(self.known)] = 0
        return at[self.known[place] == pair] if len(self.known) else at[:0]

    def ranges(self, t: int, at: list[int], pairs: dict[int, tuple[int, int]]) -> Iterator[tuple[float, int, int, int]]:
        """(coefficient, first bigram, end, template) of ranges that reach the least coefficient; at: the places of
        bigrams that the template holds. Ranges that end in a bigram which adds nothing are left out: without it they
        are shorter and the coefficient is higher."""
        size, _, bag = self.templates[t]
        need, most = size * self.least / (2 - self.least) - 1e-9, int(size * (2 - self.least) / self.least + 1e-9)
        if len(at) < need:
            return
        places = np.array(at)
        reach = np.searchsorted(places, places + most)
        for i in np.flatnonzero(reach - np.arange(len(at)) >= need).tolist():
            first, common, have = at[i], 0, Counter()
            for x in at[i : reach[i]]:
                p = pairs[x]
                if have[p] < bag[p]:
                    have[p] += 1
                    common += 1
                    d = 2 * common / (x + 1 - first + size)
                    if d >= self.least:
                        yield d, first, x + 1, t

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first word, end) of every match, in text order."""
        words = normalised(text)
        if len(words) < 2:
            return []
        none = len(self.number)
        code = np.fromiter(map(self.number.get, words, repeat(none)), np.int64, len(words))
        hit = self.hits(code)
        if len(hit) < self.shared:
            return []
        pairs = dict(zip(hit.tolist(), zip(code[hit].tolist(), code[hit + 1].tolist())))
        held: dict[int, list[int]] = {}
        for i, p in pairs.items():
            for t in self.holders[p]:
                held.setdefault(t, []).append(i)
        found = [m for t, at in held.items() for m in self.ranges(t, at, pairs)]
        taken: list[tuple[str, float, int, int]] = []
        used = bytearray(len(words))
        for d, lo, hi, t in sorted(found, key=lambda m: (-m[0], m[1] - m[2], m[1], m[3])):
            if not any(used[lo : hi + 1]):
                used[lo : hi + 1] = b"\1" * (hi + 1 - lo)
                taken.append((self.templates[t][1], d, lo, hi + 1))
        return sorted(taken, key=lambda m: m[2])


_scanners: dict[tuple, Scanner] = {}


def scanner_of(templates: list[tuple[str, str]], least: float) -> Scanner:
    """This process's scanner of the templates, made once."""
    key = (tuple(templates), least)
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(templates, least)
    return _scanners[key]


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, matches (template, dice, word range and words) for every row of docs."""
    kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.string())]))
    told = [tuple(t) for t in (TEMPLATES if templates is None else templates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(told, least)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                found = scanner.scan(t)
                words = normalised(t) if found else []
                out.append([{"licence": n, "dice": d, "start": a, "end": e, "words": " ".join(words[a:e])} for n, d, a, e in found])
            yield pa.record_batch([b.column(0), pa.array(out, kind)], ["doc_id", "matches"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, matches array<struct<licence:string,dice:double,start:int,end:int,words:string>>", TEXTS)


def summary(matches):
    """Columns of a scan: number of matches, the licences by name, the highest coefficient."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["licence"]))), ",")
    return F.size(matches).alias("n_matches"), names.alias("licences"), F.array_max(F.transform(matches, lambda m: m["dice"])).alias("best_dice")
