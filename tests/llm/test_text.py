import functools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tests.conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import common, licences, packing, pieces, quality, queries, token_counts, toxicity
from docloom.llm.labels import remainder, remainder_of
from docloom.llm.licence_texts import TEMPLATES
from tests.llm.conftest import prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LABELLED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# pieces


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab 1▁\n\té😀\x00ﬁ日the"), max_size=30))
def test_chunks_give_the_library_s_ids(text):
    table = pieces.chunk_table(pieces.read_model(MODEL))
    ends, flat = table.encode([pieces.marked_words(text)])
    ids = table.lib.encode(text)
    assert flat.tolist() == ids and table.decode(pieces.marked_words(text)) == table.lib.decode(ids)
    assert table.counts([pieces.marked_words(text)]).tolist() == [len(ids)]


def test_a_full_table_starts_anew(lib):
    table = pieces.ChunkTable(pieces.read_model(MODEL), most=5)
    for text in ("a b c d e f g", "h i a b", "", "j  k"):
        assert table.encode([pieces.marked_words(text)])[1].tolist() == lib.encode(text)


def test_encode_decode(spark, odd, none, lib):
    rows = pieces.encode_decode(odd, MODEL).collect()
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"] or "")), lib.decode(lib.encode(r["text"] or ""))) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert pieces.encode_decode(none, MODEL).count() == 0


def test_encode_query_on_the_table(spark, lib):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op1_sentencepiece(spark, DATA).collect():
        ids = lib.encode(texts.pop(r["doc_id"]))
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert not texts


# token counts


def count_by_hand(word, scores, unknown):
    best = [(0.0, 0)]
    for i in range(len(word)):
        found = []
        for j in range(i + 1):
            if word[j : i + 1] in scores:
                found.append((best[j][0] + scores[word[j : i + 1]], -j, best[j][1] + 1))
        if word[i] not in scores:
            found.append((best[i][0] + unknown, -i, best[i][1] + len(word[i].encode())))
        s, _, n = max(found)
        best.append((s, n))
    return best[-1][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcé"), max_size=9), max_size=12))
def test_trie_counts(words):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "c": -4.0, "ab": -3.5, "▁a": -2.5, "abc": -5.0, "bc": -6.0, "cab": -3.0, "aa": -4.0}
    trie = token_counts.ForwardTrie(scores, most=20)
    for _ in range(2):
        assert trie.count(words) == sum(count_by_hand("▁" + w, scores, -16.0) for w in words)


def test_unigram_counts_equal_the_library(spark):
    """The library itself, told to read the same pieces as a unigram model."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(pieces.read_model(MODEL))
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -1e5)  # sums stay exact in the library's single precision
    uni = m.SerializeToString()
    lib, trie = sentencepiece.SentencePieceProcessor(model_proto=uni), token_counts.ForwardTrie(token_counts.unigram(uni))
    words = {w for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect() for w in pieces.marked_words(r["text"]) if w}
    assert [w for w in words if trie.count([w]) != len(lib.encode(w.replace("▁", " ")))] == []


def test_count_tokens(spark, odd, none):
    got = {(r["doc_id"], r["n_pretokens"]): r["n_tokens"] for r in token_counts.count_tokens(odd, MODEL).collect()}
    scores = token_counts.unigram(pieces.read_model(MODEL))
    unknown = min(scores.values()) - token_counts.PENALTY
    assert got[3, 0] == got[4, 0] == got[None, 0] == 0
    assert got[8, 2] == sum(count_by_hand("▁" + w, scores, unknown) for w in ("one", "two"))
    assert token_counts.count_tokens(none, MODEL).count() == 0


def test_count_tokens_of_the_table(spark):
    """The query against each word's own dynamic programme."""
    scores = token_counts.unigram(pieces.read_model(MODEL))
    unknown = min(scores.values()) - token_counts.PENALTY
    by_hand = functools.cache(lambda w: count_by_hand("▁" + w, scores, unknown))
    want = Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        words = pieces.marked_words(r["text"])
        want[r["doc_id"], len(words), sum(map(by_hand, words))] += 1
    assert Counter(map(tuple, queries.op7_token_counts(spark, DATA).select("doc_id", "n_pretokens", "n_tokens").collect())) == want


# packing


def pack_by_hand(items, capacity):
    parts = sorted(((min(capacity, size - p), i, p) for i, (size, _, _) in enumerate(items) for p in range(0, size, capacity)), key=lambda x: (-x[0], x[1], x[2]))
    bins = []
    for size, i, first in parts:
        fit = [(capacity - b["fill"], n) for n, b in enumerate(bins) if b["fill"] + size <= capacity and b["fill"] < capacity and items[i][1] not in b["s"] - {None} and items[i][2] not in b["c"]]
        n = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"fill": 0, "s": set(), "c": set(), "has": []})
        bins[n]["has"].append((i, first, size, bins[n]["fill"]))
        bins[n]["fill"] += size
        bins[n]["s"].add(items[i][1])
        bins[n]["c"].add(items[i][2])
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 45), st.sampled_from(["a", "b", "c", "d", None]), st.integers(0, 6)), max_size=40))
def test_best_fit(items):
    got = {}
    for i, parts in enumerate(packing.pack_items(items, 20)):
        for first, size, b, position, offset, fill in parts:
            got.setdefault(b, {})[position] = (i, first, size, offset)
    want = {n: dict(enumerate(b["has"])) for n, b in enumerate(pack_by_hand(items, 20))}
    assert got == want


def test_packed_documents(spark, odd, none, lib):
    out = packing.best_fit(spark, odd, MODEL, capacity=64, pack=4).collect()
    for own in {r["bin_id"]: [x for x in out if x["bin_id"] == r["bin_id"]] for r in out}.values():
        own.sort(key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own))) and sum(r["n_tokens"] for r in own) == own[0]["bin_fill"] <= 64
        assert [r["bin_offset"] for r in own] == [sum(x["n_tokens"] for x in own[:k]) for k in range(len(own))]
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for r in odd.collect():
        want[r["doc_id"]] += len(lib.encode(r["text"] or "")) + 1
    assert got == want
    assert packing.best_fit(spark, none, MODEL).count() == 0


def test_conflicts_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.op3_best_fit_packing(spark, DATA).join(docs.select("doc_id", "source", F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", "").alias("c")), "doc_id")
    assert out.groupBy("bin_id", "source").count().where("count > 1").isEmpty() and out.groupBy("bin_id", "c").count().where("count > 1").isEmpty()
    assert out.select("doc_id").distinct().count() == docs.count()


# classifiers


def test_remainders(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456, -4)] + [(None,)], "doc_id long")
    for r in df.withColumn("m", remainder("doc_id", 3)).collect():
        assert r["m"] == (None if r["doc_id"] is None else remainder_of(r["doc_id"], 3))


def accuracy(spark, query, label, path=LABELLED):
    lab = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = query(spark, path).join(lab, "doc_id").where("held_out").collect()
    return sum(r["predicted"] == r["y"] for r in rows) / len(rows), sum(r["predicted"] and not r["y"] for r in rows)


def test_quality_held_out(spark):
    right, _ = accuracy(spark, queries.op5_quality, "quality")
    assert right >= 0.93


def test_toxicity_held_out(spark):
    right, wrong = accuracy(spark, queries.op9_toxicity, "toxic")
    assert right >= 0.93 and wrong <= 2


def test_chunk_table_is_bounded_by_characters(lib):
    """Texts without blanks are one chunk each."""
    with open(MODEL, "rb") as f:
        table = pieces.ChunkTable(f.read(), most_chars=5000)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefé你") for _ in range(rng.randint(1, 3000))) for _ in range(40)]
    for t in texts:
        words = [pieces.marked_words(t)]
        ends, flat = table.encode(words)
        assert flat.tolist() == lib.encode(t) and table.decode(words[0]) == lib.decode(lib.encode(t)) and ends.tolist() == [0, len(flat)]
        assert table.chars <= 5000 + len(t) and sum(map(len, table.index)) == table.chars


def test_hot_rows_are_dealt_over_all_packs(spark):
    """A third of all rows have no id and one text, another third one id and one text."""
    rows = [(None, "same text", "s")] * 800 + [(7, "another text", "s")] * 800 + [(i, prose(i, 9), f"s{i % 90}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.best_fit(spark, df, MODEL, capacity=64, pack=200).collect()
    sizes = Counter(r["bin_id"] >> 32 for r in got if r["part"] == 0)
    assert sum(sizes.values()) == 2400 and len(sizes) == 12 and max(sizes.values()) < 300
    assert all(n == 1 for n in Counter(r["bin_id"] for r in got if r["doc_id"] == 7).values())


@pytest.mark.parametrize("marks", [True, False])
def test_quality_score_by_hand(marks):
    """A score is the softmax of the output over the mean of the words' vectors, each the mean of its features'."""
    rng, buckets = random.Random(5), 512
    texts = [prose(i, rng.randint(1, 40)) + (" same" * rng.randint(0, 9)) + "\nline\nline" * (i % 3) for i in range(60)] + ["", " \n"]
    numbers = quality._Numbers()
    codes = [quality.word_codes(t, numbers, marks) for t in texts]
    words = list(numbers)
    assert marks or set(words) == {w for t in texts for w in t.split()}
    vectors, out, bias = quality.train(codes, words, np.array([int(" same" in t) for t in texts]), buckets)
    assert np.abs(vectors).max() > 0.01 and np.abs(out).max() > 0.01
    scorer = quality.Scorer(quality.QualityModel(buckets, vectors @ (out[1] - out[0]), float(bias[1] - bias[0]), marks), most_chars=50)
    got = [p for t in texts for p in scorer([t])]
    for code, p in zip(codes, got):
        mean = np.zeros(vectors.shape[1])
        for c in code:
            owner, bucket = quality.features([words[c]], buckets)
            assert set(owner) == {0}
            mean += vectors[bucket].astype(float).mean(axis=0) / len(code)
        logit = out.astype(float) @ mean + bias
        want = np.exp(logit - logit.max())
        assert p == pytest.approx(want[1] / want.sum(), abs=1e-5)


def test_training_rows_are_bounded(spark):
    from docloom.llm.labels import training_rows

    docs = spark.createDataFrame([(1, "x" * 50)] * 300 + [(i, "y" * 10) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    rows = training_rows(docs, labels, "quality", 1000, 999, 30).collect()
    assert len(rows) == 30 == len({r["doc_id"] for r in rows})
    assert 0 < sum(len(r["text"]) for r in training_rows(docs, labels, "quality", 1000, 999, 30, chars=120).collect()) <= 120


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, none, module):
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = module.classify(spark, odd, some).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and math.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1
    assert not [r for r in rows if r["doc_id"] is None and r["held_out"]]
    assert module.classify(spark, none, some).count() == 0
    assert module.classify(spark, odd, some.limit(0)).count() == odd.count()


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, prose(i, 30) + (" vile" if i % 4 == 0 else "")) for i in range(120)], "doc_id long, text string")
    lab = lambda flip: spark.createDataFrame([(i, 1 - (i % 4 == 0) if flip and remainder_of(i, 5) == 0 else int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = [sorted((r["doc_id"], r["score"]) for r in toxicity.classify(spark, docs, lab(f)).collect()) for f in (False, True)]
    assert got[0] == got[1]
    assert {i for i, s in got[0] if s >= 0.5} == {i for i in range(120) if i % 4 == 0}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=40))
def test_maximal_segments(w):
    def by_hand(lo, hi):
        best = max(((sum(w[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        ties = [(a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1) if sum(w[a:b]) == best[0]]
        a, b = min(ties, key=lambda x: (x[1] - x[0], x[0]))
        return by_hand(lo, a) + [best[0]] + by_hand(b, hi)

    found = toxicity.maximal_segments([float(x) for x in w])
    assert sorted(s for _, _, s in found) == sorted(map(float, by_hand(0, len(w))))
    assert all(sum(w[a:b]) == s and s > 0 for a, b, s in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    assert math.isclose(toxicity.best_score(np.array(w, float)), max([0.0, *(s for _, _, s in found)]))


def test_scale_solves_the_equation():
    w, p = np.array([2.0, 0.5, -1.0]), np.array([0.1, 0.1, 0.8])
    x = toxicity.solve_scale(w, p)
    assert x > 0 and math.isclose((p * np.exp(x * w)).sum(), 1, rel_tol=1e-9)


def test_keep_clean_returns_whole_rows(spark, odd, none):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_clean(spark, odd, lab).exceptAll(odd).isEmpty() and toxicity.keep_clean(spark, odd, lab).count() == odd.count()
    assert toxicity.keep_clean(spark, none, lab).count() == 0


# licences


def matches_by_hand(text, least=0.8):
    """Every range of words of every line, against every template."""
    out = set()
    for line in text.split("\n"):
        words = licences.normalised(line)
        for name, t in TEMPLATES:
            bag = Counter(zip(licences.normalised(t), licences.normalised(t)[1:]))
            if bag.total() > 14:
                continue
            for a in range(len(words)):
                for b in range(a + 2, min(len(words), a + 26) + 1):
                    if licences.dice(Counter(zip(words[a:b], words[a + 1 : b])), bag) >= least:
                        out.add(name)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_licence_scan(seed):
    rng = random.Random(seed)
    statements = [t for _, t in TEMPLATES if len(t) < 90]
    lines = [prose(rng.randint(0, 999), 12)]
    for _ in range(rng.randint(0, 2)):
        words = rng.choice(statements).split()
        if rng.random() < 0.3:
            words.pop(rng.randrange(len(words)))
        lines.append(" ".join([prose(rng.randint(0, 99), 3), *words, prose(rng.randint(0, 99), 3)]) if rng.random() < 0.5 else " ".join(words))
    text = "\n".join(lines)
    found = licences.Scanner(TEMPLATES).scan(text)
    assert bool(found) == bool(matches_by_hand(text)) and {f[0] for f in found} <= matches_by_hand(text)


def test_licence_texts_are_found_whole(spark, odd, none):
    s = licences.Scanner(TEMPLATES)
    for name, text in TEMPLATES:
        found = s.scan(f"{prose(1, 40)}\n\n{text}\n{prose(2, 40)}")
        assert (name, 1.0) in [(n, d) for n, d, _, _ in found]
    assert licences.scan_licences(odd).count() == odd.count() and licences.scan_licences(none).count() == 0


def test_licence_query(spark):
    got = {r["doc_id"]: r["licences"] for r in queries.op10_licence_scan(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert set(filter(None, got[r["doc_id"]].split(","))) == {n for n, t in TEMPLATES if len(t) < 90 and t in r["text"]}


def test_batches_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(common, "BYTES", 4000)
    texts = ["x" * n for n in (10, 9000, 20, 20, 3000, 3000, 500, *[1] * 20)]
    b = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(common.slices(b, 10))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([b]).to_pydict()
    assert all(p.num_rows == 1 or p.num_rows <= 10 and p.nbytes <= 4000 for p in parts)
    assert [p.num_rows for p in common.slices(b.slice(0, 0), 10)] == [0]
