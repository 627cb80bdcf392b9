"""The pipeline's stages, one after another, each against its operator's own decisions."""

from tests.conftest import DATA

import corpus_pipeline as P
from docloom.llm import simhash, toxicity
from docloom.llm.common import id_and_text
from tests.llm.test_cut_words import cut_by_hand
from tests.llm.test_dedup import exact_by_hand
from tests.llm.test_near_copies import kept_by_hand

rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    steps = dict(P.STAGES)
    assert list(steps) == ["toxicity", "exact dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]

    clean = steps["toxicity"](spark, docs, DATA).cache()
    said = {r["doc_id"]: r["predicted"] for r in toxicity.classify(spark, docs, labels).collect()}
    assert {i for i, _ in rows(clean)} == {i for i, p in said.items() if not p} and clean.columns == docs.columns

    first = steps["exact dedup"](spark, clean, DATA).cache()
    assert {i for i, _ in rows(first)} == {i for i, _, _, kept, _ in exact_by_hand(rows(clean)) if kept} and first.columns == docs.columns

    one = steps["SimHash near-dedup"](spark, first, DATA).cache()
    assert {i for i, _ in rows(one)} == kept_by_hand(rows(first), 0.8) and one.columns == docs.columns

    short = steps["suffix-array dedup"](spark, one, DATA).cache()
    want = cut_by_hand(rows(one), words=51, length=400)
    assert dict(rows(short)) == want and short.columns == docs.columns

    bins = steps["best-fit packing"](spark, short, DATA)
    assert {r["doc_id"] for r in bins.collect()} == set(want)
    assert bins.groupBy("bin_id").sum("n_tokens").where("`sum(n_tokens)` > 2048").isEmpty()


def test_run(spark):
    assert P.run(spark, DATA).columns == ["doc_id", "part", "first_token", "n_tokens", "bin_id", "position", "bin_offset", "bin_fill"]


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    five = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (odd.select(*five), none.select(*five), odd):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, df, DATA)
            assert out.columns == df.columns and out.count() <= df.count(), name
        assert P.STAGES[-1][1](spark, df, DATA).count() >= df.count()


def test_helper_ignores_other_columns(odd):
    assert id_and_text(odd).columns == ["doc_id", "text"] and simhash.fingerprints(odd).columns == ["doc_id", "fp"]
