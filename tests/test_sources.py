"""JSON documents, chunks, dates and streams."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docloom import Database, DocumentError, Query
from docloom.sources import documents as D
from docloom.streaming import ingest

DOCS = [{"a": 1, "when": "2024-05-01T10:00:00.000Z"}, {"a": "x", "o": {"b": [1, None]}}, {}]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, DOCS)))
    return tmp_path


def test_json_round_trip(spark, folder):
    df = D.read_json(spark, f"{folder}/in")
    assert sorted(map(repr, D.to_values(df))) == sorted(map(repr, [{"a": 1, "when": datetime(2024, 5, 1, 10, tzinfo=timezone.utc)}, DOCS[1], {}]))
    D.write_json(df, f"{folder}/out")
    assert sorted(map(repr, D.to_values(D.read_json(spark, f"{folder}/out")))) == sorted(map(repr, D.to_values(df)))
    assert Query({"when": {"$gt": datetime(2024, 1, 1)}}).execute(df).count() == 1


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, "😀é"), (4, None)], "i int, t string")
    c = D.chunks(df, "i", "t", 2)
    assert sorted(map(tuple, c.collect())) == [(1, 0, "ab"), (1, 1, "cd"), (1, 2, "ef"), (1, 3, "g"), (3, 0, "😀é")]
    assert sorted(map(tuple, D.joined(c, "i").collect())) == [(1, "abcdefg"), (3, "😀é")]
    with pytest.raises(ValueError):
        D.chunks(df, "i", "t", 0)


def test_revived(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00.000Z",), ("2024-05-01T10:00:00.000Z\n",), ("2024-05-01",), (None,)], "s string")
    assert [r[0] is not None for r in df.select(D.revived(F.col("s"))).collect()] == [True, False, False, False]


def test_stream_into_collection(spark, folder):
    stream = ingest.read_json(spark, f"{folder}/in")
    with pytest.raises(DocumentError):
        ingest.find(stream, Query().limit(1))
    c = Database(spark, "s", str(folder / "db")).initialize().collection("c")
    q = ingest.insert(ingest.find(stream, {"a": {"$exists": True}}), c, f"{folder}/check", availableNow=True)
    q.awaitTermination(60)
    assert c.count() == 2 and c.count({"o.b.0": 1}) == 1


def test_a_batch_that_comes_again_is_passed_over(spark, tmp_path):
    c = Database(spark, "again", str(tmp_path)).initialize().collection("c")
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert c.insert_df(df, ("s", 0)) == 2 and c.insert_df(df, ("s", 0)) == 0 and c.insert_df(df, ("other", 0)) == 2
    assert c.insert_df(df, ("s", 1)) == 2 and c.count() == 6
    c.delete_many({"k": 1})
    assert c.insert_df(df, ("s", 1)) == 0 and c.count() == 3
    assert {n for n, folder in c.store.files.list() if folder} >= {p["folder"] for p in c.store.manifest().parts}
