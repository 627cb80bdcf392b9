"""Repeated passages of over 50 words, however few bytes they have, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.conftest import DATA

import corpus_pipeline as P
from docloom.llm import queries, suffix_dedup
from tests.llm.conftest import prose
from tests.llm.test_dedup import repeats_by_hand


def cut_by_hand(rows, words=51, length=400):
    """rows: distinct (id, text). Texts without the bytes in a window of `words` words or `length` bytes that recurs."""
    raw = [(t or "").encode() for _, t in rows]
    places = [[m.span() for m in re.finditer(rb"\S+", t)] for t in raw]
    named = [[t[a:b] for a, b in p] for t, p in zip(raw, places)]
    seen = Counter(tuple(w[i : i + words]) for w in named for i in range(len(w) - words + 1))
    strings = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = {}
    for (d, _), t, p, w in zip(rows, raw, places, named):
        keep = np.ones(len(t), bool)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                keep[p[i][0] : p[i + words - 1][1]] = False
        for i in range(len(t) - length + 1):
            if strings[t[i : i + length]] > 1:
                keep[i : i + length] = False
        out[d] = np.frombuffer(t, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
    return out


def test_short_words(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghil") for _ in range(rng.randint(2, 4)))
    passages = [[word() for _ in range(n)] for n in (50, 51, 52, 65)]
    rows = []
    for i in range(24):
        own = list(passages[i % 4])
        if i % 6 == 5:
            own[25] = "other"
        rows.append((i, f"{prose(i, 30)}{rng.choice(' ' + chr(10))}{rng.choice(' ' + chr(9)).join(own)} {prose(100 + i, 30)}"))
    rows += [(24, None), (25, "é " * 60), (26, "x" * 500), (27, "y" + "x" * 450)]
    out = P.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = {r["doc_id"]: r["text"] or "" for r in out.collect()}
    assert got == cut_by_hand(rows)
    assert got[0] == rows[0][1] and len(got[1]) < len(rows[1][1]) - 51  # 50 words stay, 51 go


def test_stage_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").dropDuplicates(["doc_id"]).cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in P.cut_repeats(spark, docs, DATA).collect()}
    by_bytes = {d: t.decode("utf-8", "ignore") for d, _, _, _, t in repeats_by_hand([(d, t.encode()) for d, t in rows], 400)}
    assert got == cut_by_hand(rows) != by_bytes


def words_by_hand(rows, words=51):
    """(id, maximal runs, words in them) of the strings of so many words that also start elsewhere, repeated rows too."""
    named = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + words]) for w in named for i in range(len(w) - words + 1))
    out = Counter()
    for (d, _), w in zip(rows, named):
        keep = np.zeros(len(w) + 1, int)
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                keep[i : i + words] = 1
        out[d, int((np.diff(np.concatenate(([0], keep))) == 1).sum()), int(keep.sum())] += 1
    return out


def told(df):
    return Counter((r["doc_id"], r["n_passages"], r["n_passage_words"]) for r in df.collect())


@pytest.mark.parametrize("most", [1, 512])
def test_passages_are_counted(spark, odd, most):
    rng = random.Random(4)
    passages = [prose(i, 30).split() for i in range(5)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            w += prose(rng.randint(0, 10**6), rng.randint(0, 5)).split() + p[a : rng.randint(a, 30)]
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, "a " * 40), (62, "a b " * 9), (None, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert told(suffix_dedup.remove_repeats(spark, df, words=11, most=most)) == words_by_hand(rows, 11)
    short = suffix_dedup.remove_repeats(spark, df, words=3, most=most)
    assert told(short) == words_by_hand(rows, 3)
    assert told(suffix_dedup.remove_repeats(spark, odd, words=51)) == words_by_hand([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert {(p, n) for _, p, n in told(suffix_dedup.remove_repeats(spark, df))} == {(0, 0)}


def test_passages_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert told(queries.op2_suffix_dedup(spark, DATA)) == words_by_hand(rows)
