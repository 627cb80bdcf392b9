"""The pipeline's near-dedup: SimHash finds the candidates, the sets of shingles decide."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from docloom.llm import near_copies, wide_simhash
from tests.llm.conftest import prose
from tests.llm.test_near_copies import edited, kept_by_hand

FIVE = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], FIVE)
    return {r["doc_id"] for r in dict(P.STAGES)["SimHash near-dedup"](spark, docs, "").collect()}


def test_stage_goes_by_fingerprints(spark, monkeypatch):
    """No other method finds candidates, and without links between fingerprints every row stays."""
    rows, want = edited(11), kept_by_hand(edited(11))
    for other in ("keep_one", "shingle_links", "min_hashes"):
        monkeypatch.setattr(near_copies, other, None)
    assert stage(spark, rows) == want and len(want) < len(rows)
    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(wide_simhash, "fingerprint_links", lambda *a: none)
    assert stage(spark, rows) == {i for i, _ in rows}


@pytest.mark.parametrize("tile", [2, 2048])
def test_tiles_of_keys_and_components(spark, tile):
    base = prose(5, 300).split()
    many = [(1000 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(30)]  # one group, all near
    rows = edited(12) + many
    got = wide_simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)
    assert {r["doc_id"] for r in got.collect()} == kept_by_hand(rows)


def test_short_texts(spark):
    """Sets of 4 to 12 shingles at 0.8 or more, and others below it."""
    rows = []
    for k in range(60):
        words = prose(900 + k, 9 + k % 9).split()
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[:-1])), (3 * k + 2, " ".join(words[:-3]))]
    rows += [(500 + k, t) for k, t in enumerate(["one", "one two", "one two three four five", "one two three four five six"])]
    random.Random(1).shuffle(rows)
    got = wide_simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == kept_by_hand(rows)


def test_rows_without_ids_and_empty_tables(spark, none):
    a, b = prose(1, 100), prose(2, 100)
    rows = [(1, a), (None, a + " end"), (None, b), (5, ""), (6, None), (7, b[:200]), (7, prose(3, 80)), (2, prose(3, 80) + " end")]
    got = wide_simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, a), (None, b), (5, ""), (7, b[:200]), (2, prose(3, 80) + " end")}
    assert wide_simhash.keep_one(spark, none).columns == none.columns


@pytest.mark.parametrize("n", [1000, 200_000, 13_000_000])
def test_pairs_at_the_similarity_share_keys(n):
    """With the keys planned for n sets, pairs at exactly 0.8 meet and are within the radius; unrelated ones are not."""
    rng, differ = np.random.default_rng(n), wide_simhash.apart(0.8)
    assert abs(differ - 3 / 16) < 1e-9
    at, met = wide_simhash.places(*wide_simhash.plan_keys(n, differ)), 0
    least_met = 0  # the sets whose bits differ most
    for _ in range(500):
        grams = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        fps = np.frombuffer(b"".join(wide_simhash.fingerprint(g) for g in (grams[:180], grams[20:], grams[:100])), np.uint8).reshape(3, -1)
        k = wide_simhash.keys(fps, at)
        words = fps[:, : 8 * wide_simhash.WORDS].copy().view(np.uint64)
        u, v = wide_simhash.links(words[:2], np.array([180, 180]), differ, 0.8)
        small = np.frombuffer(b"".join(wide_simhash.fingerprint(g) for g in (grams[:5], grams[:4])), np.uint8).reshape(2, -1)
        least_met += (wide_simhash.keys(small, at)[0] == wide_simhash.keys(small, at)[1]).any()
        met += bool((k[0] == k[1]).any()) and list(zip(u, v)) == [(0, 1)]
        assert not len(wide_simhash.links(words[[0, 2]], np.array([180, 100]), differ, 0.8)[0])  # 0.56, by size
    assert met >= 499 and least_met >= 499


def test_links_of_dense_and_sparse_groups():
    """Both ways through a group join the same rows."""
    rng = np.random.default_rng(8)
    for clusters, each in ((300, 2), (2, 400)):
        base = rng.integers(0, 1 << 63, (clusters, wide_simhash.WORDS)).astype(np.uint64)
        words = np.repeat(base, each, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (clusters * each, wide_simhash.WORDS)).astype(np.uint64))
        u, v = wide_simhash.links(words, np.full(len(words), 50), 0.1875, 0.8)
        assert (u // each == v // each).all()
        seen = wide_simhash.forest(u, v)
        assert len(seen[0]) == clusters * (each - 1)
