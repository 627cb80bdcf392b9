"""Deep skips of sorted queries against a sorted list."""

import random
from datetime import date, datetime, timedelta

import pytest

from docloom import Query
from docloom.plans import query


@pytest.fixture
def rows():
    rng = random.Random(11)
    out = []
    for i in range(300):
        n = rng.choice([None, rng.randrange(-50, 50), rng.randrange(10**12)])
        out.append((i, n, None if i % 9 == 0 else rng.choice([0.5, 0.25, -1e9, rng.random()]), datetime(2020, 1, 1) + timedelta(seconds=rng.randrange(10**6)), date(2020, 1, 1) + timedelta(days=rng.randrange(40)), f"s{i % 7}", 5))
    return out


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "i long, n long, x double, t timestamp, d date, s string, same int").repartition(3)


@pytest.mark.parametrize("limit", [None, 4])
@pytest.mark.parametrize("way", [1, -1])
@pytest.mark.parametrize("key", ["n", "x", "t", "d", "s", "same"])
def test_against_a_list(df, rows, monkeypatch, key, way, limit):
    monkeypatch.setattr(query, "DEEP", 6)
    monkeypatch.setattr(query, "BINS", 4)
    at = ["i", "n", "x", "t", "d", "s", "same"].index(key)
    there = sorted((r for r in rows if r[at] is not None), key=lambda r: r[0])
    there = sorted(there, key=lambda r: r[at], reverse=way == -1)
    none = sorted((r for r in rows if r[at] is None), key=lambda r: r[0])
    want = [r[0] for r in (none + there if way == 1 else there + none)]
    for skip in (6, 150, 299, 300):
        q = Query().sort({key: way, "i": 1}).skip(skip).limit(limit).select(["i"])
        assert [r["i"] for r in q.execute(df).collect()] == want[skip:][:limit]


def test_nothing_passed_over_is_sorted(spark, sf_dir, monkeypatch, capsys):
    monkeypatch.setattr(query, "DEEP", 100)
    q = Query({"l_returnflag": "N"}).sort({"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1}).skip(2500).limit(3)
    got = q.execute(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    got.explain()
    plan = capsys.readouterr().out
    assert "limit=25" not in plan
    rows = sorted((r for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'N'").collect()), key=lambda r: (-r["l_extendedprice"], r["l_orderkey"], r["l_linenumber"]))
    assert got.collect() == rows[2500:2503]


def test_what_is_no_number_is_sorted_as_before(spark, monkeypatch):
    monkeypatch.setattr(query, "DEEP", 2)
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (None,)], "x double")
    assert Query().sort({"x": 1}).skip(2).limit(1).execute(df).collect() == [(2.0,)]
