"""Every operator against every kind of value, held against a plain evaluation of the documented rules."""

import json
import math
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docloom import DocumentError, Query
from docloom.functions.fields import millis, plain
from docloom.plans.criteria import matches, where

MISSING = object()
WHEN = datetime(2024, 5, 1, 12, 0, tzinfo=timezone.utc)
VALUES = [MISSING, None, 0, 5, -3, 2.5, "5", "abc", "", "  7 ", True, False, WHEN, [], ["a"], ["a", "b"], [1, "a", None], {"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": {"b": [1]}}]


def same(a, b):
    if a is MISSING or isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def number(x):
    if x is None:
        return 0.0
    if isinstance(x, datetime):
        return float(millis(x))
    if isinstance(x, (bool, int, float)):
        return float(x)
    if isinstance(x, str):
        t = x.strip()
        if not t:
            return 0.0
        return float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) else math.nan
    return math.nan


def compare(op, a, b):
    if a is MISSING or isinstance(a, (list, dict)):
        return False
    x, y = (a, b) if isinstance(a, str) and isinstance(b, str) else (number(a), number(b))
    return {"$gt": x > y, "$gte": x >= y, "$lt": x < y, "$lte": x <= y}[op]


def holds(op, v, b):
    if op == "$eq":
        return same(v, b)
    if op == "$ne":
        return not same(v, b)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return compare(op, v, b)
    if op == "$in":
        return isinstance(b, list) and (any(same(e, x) for e in v for x in b) if isinstance(v, list) else any(same(v, x) for x in b))
    if op == "$nin":
        return not holds("$in", v, b)
    if op == "$exists":
        return (v is not MISSING) == bool(b)
    if op == "$regex":
        return isinstance(v, str) and re.search(b, v) is not None
    if op == "$size":
        return isinstance(v, list) and len(v) == b
    return isinstance(v, list) and isinstance(b, list) and all(any(same(e, x) for e in v) for x in b)


CASES = (
    [(op, b) for op in ("$eq", "$ne") for b in (None, 0, 5, 5.0, "5", "abc", "", True, WHEN, [], ["a", "b"], {"a": 1, "b": 2}, {"a": {"b": [1]}}, math.nan)]
    + [(op, b) for op in ("$gt", "$gte", "$lt", "$lte") for b in (0, 2.5, "5", "abc", "", WHEN, True)]
    + [(op, b) for op in ("$in", "$nin") for b in ([], [5, "abc"], [None], ["a", 1], [["a"], {"a": 1, "b": 2}], 5)]
    + [("$exists", b) for b in (True, False, 1, 0)]
    + [("$regex", b) for b in ("^a", "c$", "5", "")]
    + [("$size", b) for b in (0, 1, 2, "1", -1)]
    + [("$all", b) for b in ([], ["a"], ["a", "b"], [1, None], "a")]
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, json.dumps({} if v is MISSING else {"v": plain(v), "o": {"v": plain(v)}})) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("doc")).cache()


def test_matrix(docs):
    """All cases in a few passes: the filter's form, its negation and the projected form."""
    cols = []
    for k, (op, b) in enumerate(CASES):
        c = {"v": {op: b}}
        cols += [F.coalesce(where(c, docs.schema), F.lit(False)).alias(f"p{k}"), F.coalesce(where({"$not": c}, docs.schema), F.lit(False)).alias(f"n{k}"), matches({"o.v": {op: b}}, docs.schema).alias(f"o{k}")]
    wrong = []
    for at in range(0, len(cols), 60):
        got = {r["i"]: r for r in docs.select("i", *cols[at : at + 60]).collect()}
        for k in range(at // 3, min(len(CASES), at // 3 + 20)):
            op, b = CASES[k]
            for i, v in enumerate(VALUES):
                e = holds(op, v, b)
                if (got[i][f"p{k}"], got[i][f"n{k}"], got[i][f"o{k}"]) != (e, not e, e):
                    wrong.append((op, b, v, e, got[i][f"p{k}"], got[i][f"n{k}"], got[i][f"o{k}"]))
    assert not wrong, wrong[:10]


def test_logic(docs):
    ids = lambda c: sorted(r["i"] for r in docs.where(where(c, docs.schema)).select("i").collect())
    every = list(range(len(VALUES)))
    assert ids({}) == ids(None) == ids({"$and": []}) == every
    assert ids({"$or": []}) == ids({"$or": {"v": 5}}) == ids({"$and": {"v": 5}}) == []
    assert ids({"$not": {"$or": []}}) == every
    assert ids({"$not": {"$and": [{"v": {"$exists": True}}, {"v": {"$ne": 5}}]}}) == [0, 3]
    assert ids({"v": {"$gte": 0, "$lt": 5}, "$not": {"v": True}}) == [i for i, v in enumerate(VALUES) if compare("$gte", v, 0) and compare("$lt", v, 5) and v is not True]


@pytest.mark.parametrize("bad", [{"$nor": []}, {"v": {"$mod": [2, 0]}}, {"v": {"a": 1}}, {"v": {}}, {"v": ["x"]}, {"v": {"$not": {"$gt": 1}}}, {"v": {"$regex": "["}}, {"v": {"$options": "i"}}])
def test_invalid_operators_fail_at_once(docs, bad):
    with pytest.raises(DocumentError) as e:
        where(bad, docs.schema)
    assert e.value.code == "QUE002"


def test_regex_translation(spark):
    df = spark.createDataFrame([("a\n",), ("A",), ("x[y",), ("a&&b",)], "s string")
    hit = lambda c: [r["s"] for r in Query({"s": c}).execute(df).collect()]
    assert hit({"$regex": "^a$"}) == []
    assert hit({"$regex": "^a$", "$options": "m"}) == ["a\n"]
    assert hit(re.compile("^a$", re.I)) == ["A"]
    assert hit({"$regex": "[[]"}) == ["x[y"]
    assert hit({"$regex": "[&&]"}) == ["a&&b"]


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for c, pushed in (
        ({"o_totalprice": {"$gt": 5}}, "GreaterThan(o_totalprice,5.0)"),
        ({"$not": {"o_orderkey": {"$gt": 5}}}, "LessThanOrEqual(o_orderkey,5)"),
        ({"o_orderstatus": {"$ne": "F"}}, "Not(EqualNullSafe(o_orderstatus,F))"),
        ({"o_orderpriority": {"$in": ["a", "b"]}}, "In(o_orderpriority, [a,b])"),
    ):
        Query(c).select(["o_orderkey"]).execute(o).explain("formatted")
        plan = capsys.readouterr().out
        assert pushed in plan and "Python" not in plan and "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_top_k_is_one_operator(spark, sf_dir, capsys):
    Query().sort({"o_totalprice": -1}).skip(5).limit(10).execute(spark.read.parquet(f"{sf_dir}/orders.parquet")).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
