"""Near copies against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest
from tests.conftest import DATA

import corpus_pipeline as P
from docloom.llm import near_copies
from tests.llm.conftest import prose


def sets_by_hand(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def kept_by_hand(rows, least=0.8):
    """Ids that stay; ids are distinct and texts are not empty."""
    sets = [sets_by_hand(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                up[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), d), d)
    return set(best.values())


def edited(seed):
    """Texts with copies in which 1 to 8 of 200 words are others: similarities from 0.67 to 0.96."""
    rng, out = random.Random(seed), []
    for k in range(25):
        words = prose(seed * 100 + k, 200).split()
        out.append(words)
        for n in rng.sample(range(1, 9), 3):
            copy = list(words)
            for i in rng.sample(range(200), n):
                copy[i] = f"new{rng.randrange(10**6)}"
            out.append(copy)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_stage_against_jaccard(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("trim(text) <> ''").dropDuplicates(["text"]).cache()
    one = dict(P.STAGES)["SimHash near-dedup"](spark, docs, DATA)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == kept_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("tile", [3, 2048])
def test_edited_copies(spark, monkeypatch, tile):
    links = near_copies.shingle_links
    monkeypatch.setattr(near_copies, "shingle_links", lambda *a: links(*a, tile=tile))
    rows = edited(7)
    got = near_copies.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == kept_by_hand(rows)


def test_rows_without_ids_and_empty_tables(spark, none):
    a, b = prose(1, 100), prose(2, 100)
    rows = [(1, a), (None, a + " end"), (None, b), (5, ""), (6, None), (7, b[:200]), (7, prose(3, 80)), (2, prose(3, 80) + " end")]
    got = near_copies.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, a), (None, b), (5, ""), (7, b[:200]), (2, prose(3, 80) + " end")}
    assert near_copies.keep_one(spark, none).columns == none.columns


def test_sketches_pass_over_no_similar_pair():
    """Sets at the similarity agree on enough bytes; most of those far below it do not."""
    rng = np.random.default_rng(3)
    need, passed = near_copies.least_agreement(0.8), []
    for shared in (160, 100):  # of 180 and of 260 each: similarities 0.8 and 0.24
        n = 0
        for _ in range(300):
            common = rng.integers(0, 1 << 63, shared).astype(np.uint64)
            a, b = (np.concatenate((common, rng.integers(0, 1 << 63, (180 if shared == 160 else 260) - shared).astype(np.uint64))) for _ in range(2))
            x, y = (near_copies.sketch(near_copies.min_hashes(np.unique(g))) for g in (a, b))
            n += sum(p == q for p, q in zip(x, y)) >= need
            assert near_copies.with_partner([x, y], [len(a), len(b)], 0.8).all() == (sum(p == q for p, q in zip(x, y)) >= need)
        passed.append(n)
    assert passed[0] == 300 and passed[1] < 30
    assert not near_copies.with_partner([x, x], [10, 13], 0.8).any()
