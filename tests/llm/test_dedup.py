import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from tests.conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import components, exact_dedup, queries, simhash, suffix_dedup
from docloom.llm.common import scratch_path
from docloom.llm.suffix_sort import suffix_array
from tests.llm.conftest import prose

BLANK = re.compile("[\x20\x09-\x0d]")


# exact


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(BLANK.sub("", t or ""), []).append((i, t or ""))
    out = Counter()
    for key, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for i, t in own:
            out[(i, best[0], len(own), i == best[0] and len(t) == len(best[1]), hashlib.sha256(key.encode()).hexdigest())] += 1
    return out


def test_exact(spark, odd, none):
    got = Counter(map(tuple, exact_dedup.exact_dedup(spark, odd).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == exact_by_hand([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert exact_dedup.exact_dedup(spark, none).count() == 0
    assert exact_dedup.keep_first(spark, none).columns == none.columns


def test_exact_keeps_whole_rows(spark, odd):
    kept = exact_dedup.keep_first(spark, odd)
    assert kept.columns == odd.columns
    texts = [BLANK.sub("", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({BLANK.sub("", r["text"] or "") for r in odd.collect()})
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    best = {i for i, k, _, y, _ in exact_by_hand([(r["doc_id"], r["text"]) for r in plain.collect()]) if y}
    assert {r["doc_id"] for r in exact_dedup.keep_first(spark, plain).collect()} == best


def test_index_persists(spark):
    path = scratch_path(spark, "index")
    a = spark.createDataFrame([(1, "x y"), (2, "z"), (3, "xy")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "x  y"), (8, "new"), (7, "new ")], "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path, 4)
    assert {(r["doc_id"], r["kept"]) for r in first.dedup(a).collect()} == {(1, True), (2, True), (3, False)}
    spark.sql(f"DROP TABLE {first.name}")  # as if in another session: the files stay
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert {(r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in again.dedup(b).collect()} == {(9, 1, False, 3), (8, 7, False, 2), (7, 7, True, 2)}
    assert again.read().where("first").count() == 3
    once_more = exact_dedup.DigestIndex(spark, path)  # its own number of buckets, whatever the session's
    assert {(r["doc_id"], r["kept"], r["group_size"]) for r in once_more.dedup(b).collect()} == {(9, False, 4), (8, False, 4), (7, False, 4)}


def test_index_keeps_its_number_of_buckets(spark, sf_dir):
    path = scratch_path(spark, "index")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    first = exact_dedup.DigestIndex(spark, path, 4)
    stay = first.dedup(docs).where("kept").count()
    spark.sql(f"DROP TABLE {first.name}")
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, 8)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        again = exact_dedup.DigestIndex(spark, path)
        out = again.dedup(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(out) == docs.count() and not any(r["kept"] for r in out) and all(r["group_size"] % 2 == 0 for r in out)
    assert again.read().where("first").count() == stay
    with pytest.raises(ValueError, match="no digest index"):
        spark.range(3).write.parquet(f"{path}-other")
        exact_dedup.DigestIndex(spark, f"{path}-other")


def test_index_join_needs_no_shuffle_of_the_index(spark, capsys):
    i = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), 4)
    fresh = spark.createDataFrame([("a",)], "digest string").groupBy("digest").count()
    fresh.join(i.read().select("digest").hint("merge"), "digest", "left_anti").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


# SimHash


def fingerprint_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows, radius=4):
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, f"{f:016x}", least.get(top(i))) for i, (d, f) in enumerate(rows))


def near(spark, df, **how):
    return Counter(map(tuple, simhash.near_dedup(spark, df, **how).select("doc_id", simhash.hex_of("fp"), "component_id").collect()))


def test_simhash(spark, odd, none):
    assert near(spark, odd) == components_by_hand([(r["doc_id"], fingerprint_by_hand(r["text"] or "")) for r in odd.collect()])
    assert simhash.near_dedup(spark, none).count() == 0
    assert simhash.keep_least(spark, none).columns == none.columns
    kept = simhash.keep_least(spark, odd.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 6)").count() == 1


def test_simhash_query_on_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(map(tuple, queries.op6_simhash_near_dedup(spark, DATA).collect()))
    assert got == components_by_hand([(r["doc_id"], fingerprint_by_hand(r["text"])) for r in rows])


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b é d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b é d".encode(), 42)


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_of_a_dense_group(spark, tile):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base[:3] for _ in range(120)} | set(base)
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    links = simhash.hamming_links(spark, spark.createDataFrame(signed, "fp long"), 4, tile)
    assert links.count() < 5 * 6 * len(fps)  # forests, not pairs
    root = {r["node"] % 2**64: r["root"] for r in components.connected_components(spark, links).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(root.get(f, f - 2**64 if f >> 63 else f), set()).add(f)
    ids = {f: i for i, f in enumerate(sorted(fps))}
    hand = {}
    for (i, f, c) in components_by_hand([(ids[f], f) for f in fps]):
        hand.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, hand.values()))


@pytest.mark.parametrize("n", [1, 1000, 10**6, 10**10])
def test_blocks_grow_with_the_input(n):
    assert simhash.plan_blocks(n, 4) in range(5, 10)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(-5, -5)]
    got = {}
    for r in components.connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(301)), [1000 + i for i in range(200)]]
    assert components.connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


# suffix arrays


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def repeats_by_hand(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = Counter()
    for d, t in rows:
        keep = np.ones(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                keep[i : i + length] = False
        runs = int((np.diff(np.concatenate(([1], keep.astype(int)))) == -1).sum())
        out[(d, len(t), int((~keep).sum()), runs, bytes(np.frombuffer(t, np.uint8)[keep]))] += 1
    return out


def cut(spark, df, **how):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(spark, df, **how).collect())


@pytest.mark.parametrize("most", [1, 1024])
def test_repeats(spark, most):
    rng = random.Random(8)
    passages = [prose(100 + i, 12) for i in range(6)]
    docs = []
    for i in range(60):
        parts = [prose(1000 + i, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [p[a : rng.randint(a, len(p))], prose(rng.randint(0, 10**6), rng.randint(0, 4))]
        docs.append((i, " ".join(parts)))
    docs += [(60, "ab" * 60), (61, "a" * 90), (62, docs[0][1]), (63, None), (None, passages[0]), (63, "é" * 30), (64, "xyz" * 11 + "é" * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert cut(spark, df, length=32, k=8, most=most) == repeats_by_hand([(d, (t or "").encode()) for d, t in docs], 32)


def test_repeats_of_odd_rows(spark, odd, none):
    assert cut(spark, odd) == repeats_by_hand([(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()], 400)
    assert suffix_dedup.remove_repeats(spark, none).count() == 0
    out = suffix_dedup.cut_texts(spark, odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    want = {bytes(k[4]).decode("utf-8", "ignore") for k in cut(spark, odd)}
    assert {r["text"] or "" for r in out.collect()} == want  # a null text stays null
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_hot_repeated_rows_are_sent_once(spark, monkeypatch, broadcast):
    """A third of all rows repeat id and text, another third have no id and one text."""
    hot, other = prose(1, 300), prose(2, 300)
    rows = [(7, hot)] * 60 + [(None, other)] * 60 + [(100 + i, f"{prose(3, 40)} {prose(10 + i, 60)} {hot[:500]}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sent, segments = [], suffix_dedup._segments
    monkeypatch.setattr(suffix_dedup, "_segments", lambda *a: sent.append((s := segments(*a)).count()) or s)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = cut(spark, df, length=64, k=16)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == repeats_by_hand([(d, t.encode()) for d, t in rows], 64)
    distinct = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string")
    cut(spark, distinct, length=64, k=16)
    assert sent[0] <= 4 * max(1, sent[1]) + 4 * len(hot)  # at most once a task, not once a row


def test_repeats_query_on_the_table(spark):
    rows = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((d, n, gone, runs, hashlib.sha256(t).hexdigest()) for (d, n, gone, runs, t), c in repeats_by_hand(rows, 400).items() for _ in range(c))
    assert Counter(tuple(r)[:5] for r in queries.op2_suffix_dedup(spark, DATA).collect()) == want


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = prose(3, 900).encode()
    r = suffix_dedup._Roller(8)
    named = lambda: [p for p, x, y in zip(*suffix_dedup.anchors_of(text, 40, r)) for _ in range(x, y + 1)]
    whole = named()
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 700)
    assert named() == whole and len(whole) == len(text) - 39


@pytest.mark.parametrize("unit", [1, 8])
def test_anchors_of_texts_side_by_side(monkeypatch, unit):
    rng = random.Random(unit)
    texts = [prose(i, rng.randint(0, 60)).encode() for i in range(40)] + [b"", b"a" * 40, b"ab" * 300, prose(99, 700).encode()]
    if unit == 8:
        texts = suffix_dedup._WordHasher()(texts)
    r = suffix_dedup._Roller(16, unit)
    want = [(i, *x) for i, t in enumerate(texts) for x in zip(*(c.tolist() for c in suffix_dedup.anchors_of(t, 80, r)))]
    for group in (1, 50, 300, 1 << 17):
        monkeypatch.setattr(suffix_dedup, "_GROUP", group)
        assert list(zip(*(c.tolist() for c in suffix_dedup.anchors_of_all(texts, 80, r)))) == want


def test_word_hashes(monkeypatch):
    """One hash a word, wherever it stands, and none twice among many words."""
    rng = random.Random(4)
    texts = [b"", b" ", b"a", b"\xc3\xa9\x85 x", *(b"".join(w.encode() + rng.choice([b" ", b"\n", b" \t", b"\x0b\x0c\r"]) for w in prose(i, rng.randint(0, 50)).split()) for i in range(30)), b"z" * 900, prose(77, 400).encode()]
    want: dict[bytes, bytes] = {}
    for group in (1, 64, 500, 1 << 17):
        monkeypatch.setattr(suffix_dedup, "_GROUP", group)
        got = suffix_dedup._WordHasher()(texts)
        for t, h in zip(texts, got):
            words = t.split()
            assert len(h) == 8 * len(words)
            for i, w in enumerate(words):
                assert want.setdefault(w, h[8 * i : 8 * i + 8]) == h[8 * i : 8 * i + 8]
    many = sorted({prose(i, 1) for i in range(40000)} | {f"w{i}" for i in range(60000)})
    h = suffix_dedup._WordHasher()([" ".join(many).encode()])[0]
    assert len({*want.values()}) == len(want) and len(set(np.frombuffer(h, "<u8").tolist())) == len(many)
