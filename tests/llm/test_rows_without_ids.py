"""Copies and near copies are told by row: a lost copy takes no other row of its id, or without one, along."""

import pytest

from docloom.llm import exact_dedup, simhash
from tests.llm.conftest import prose

A, B, C = prose(1, 300), prose(2, 300), prose(3, 300)


def kept(spark, keep, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    out = keep(spark, df)
    assert out.columns == df.columns
    return sorted(r["n"] for r in out.collect())


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_least])
def test_a_unique_text_beside_a_copy(spark, keep):
    assert kept(spark, keep, [(1, A, 0), (None, A, 1), (None, B, 2)]) == [0, 2]


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_least])
def test_one_id_on_two_texts(spark, keep):
    assert kept(spark, keep, [(1, A, 0), (2, A, 1), (2, B, 2), (3, B, 3), (4, C, 4)]) == [0, 2, 4]
