"""Registered queries of the document operators over the shared tables, with the SQL each must equal.

Queries go through the compilers of criteria, queries and updates; those from `collection_` on write a whole table to a
Collection in a scratch folder, change it through the Collection's own methods and read it back. A nullable column `m`
(missing for every third key) stands in for optional fields, as the tables hold no nulls.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentError
from ..functions import ids, names
from ..functions.fields import DOC
from ..operators import indexes as X
from ..operators.collection import Collection, moved_position
from ..operators.database import Database
from ..sources import documents as D
from ..sources.scratch import scratch
from . import update as U
from .criteria import matches
from .query import Query
from .schema import PythonRule, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(lambda t: _table(spark, sf_dir, t))

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_m(t) -> DataFrame:
    o = t("orders")
    return o.withColumn("m", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))).withColumn("x", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_totalprice")))


ORDERS_M = "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS m, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders)"


def _parts(t) -> DataFrame:
    return t("part").select("p_partkey", "p_size", F.split("p_name", " ").alias("tags"))


PARTS = "(SELECT p_partkey, p_size, string_split(p_name, ' ') AS tags FROM part)"


def _event_docs(t) -> DataFrame:
    """Events as documents: id, and a variant with the parsed props."""
    return t("events").select("event_id", F.to_variant_object(F.struct("event_type", "user_id", "value", F.parse_json("props").alias("props"))).alias(DOC))


def _find(name: str, table: str, criteria, sql_where: str, fields: list[str], source=None, sql_from: str | None = None, spark_from=None) -> None:
    cols = ", ".join(fields)
    make = spark_from or (lambda t: t(table))
    _add(name, f"SELECT {cols} FROM {sql_from or table} WHERE {sql_where}", lambda t: Query(criteria).select(fields).execute(make(t)))


O = ["o_orderkey", "o_totalprice"]  # noqa: E741
OM = ["o_orderkey"]

_add("find_all", "SELECT * FROM nation", lambda t: Query().execute(t("nation")))
_find("find_eq", "customer", {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'", ["c_custkey", "c_name"])
_find("find_eq_operator", "customer", {"c_nationkey": {"$eq": 3}}, "c_nationkey = 3", ["c_custkey", "c_name"])
_find("find_implicit_and", "customer", {"c_mktsegment": "BUILDING", "c_nationkey": 3}, "c_mktsegment = 'BUILDING' AND c_nationkey = 3", ["c_custkey", "c_name"])
_find("find_eq_other_type", "customer", {"c_nationkey": "3"}, "false", ["c_custkey"])
_find("find_null_typed", "orders", {"m": None}, "false", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find("find_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'", OM)
_find("find_ne_missing", "orders", {"m": {"$ne": "F"}}, "m IS DISTINCT FROM 'F'", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find("find_gt", "orders", {"o_totalprice": {"$gt": 300000}}, "o_totalprice > 300000", O)
_find("find_gte", "orders", {"o_totalprice": {"$gte": 300000.0}}, "o_totalprice >= 300000", O)
_find("find_lt", "orders", {"o_totalprice": {"$lt": 20000}}, "o_totalprice < 20000", O)
_find("find_lte", "orders", {"o_orderkey": {"$lte": 100}}, "o_orderkey <= 100", O)
_find("find_range", "orders", {"o_totalprice": {"$gte": 100000, "$lt": 120000}}, "o_totalprice >= 100000 AND o_totalprice < 120000", O)
_find("find_lt_missing", "orders", {"x": {"$lt": 50000}}, "x < 50000", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find("find_date_range", "orders", {"o_orderdate": {"$gte": datetime(1995, 1, 1), "$lt": datetime(1996, 1, 1)}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'", OM)
_find("find_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')", OM)
_find("find_in_mixed", "orders", {"o_orderkey": {"$in": [1, 2.0, "3", None, True]}}, "o_orderkey IN (1, 2)", OM)
_find("find_nin", "orders", {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", OM)
_find("find_nin_missing", "orders", {"m": {"$nin": ["F", "O"]}}, "m IS NULL OR m NOT IN ('F', 'O')", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find("find_in_no_list", "orders", {"o_orderkey": {"$in": 1}}, "false", OM)
_find("find_nin_no_list", "orders", {"o_orderkey": {"$nin": 1}}, "true", OM)
_TAGS = ["p_partkey"]
_find("find_in_array", "part", {"tags": {"$in": ["red", "hot", "small"]}}, "list_has_any(tags, ['red', 'hot', 'small'])", _TAGS, sql_from=PARTS, spark_from=_parts)
_find("find_nin_array", "part", {"tags": {"$nin": ["red", "hot", "small"]}}, "NOT list_has_any(tags, ['red', 'hot', 'small'])", _TAGS, sql_from=PARTS, spark_from=_parts)
_find("find_size", "part", {"tags": {"$size": 2}}, "len(tags) = 2", _TAGS, sql_from=PARTS, spark_from=_parts)
_find("find_all_elements", "part", {"tags": {"$all": ["red"]}}, "list_has_all(tags, ['red'])", _TAGS, sql_from=PARTS, spark_from=_parts)
_find("find_all_empty", "part", {"tags": {"$all": []}}, "true", _TAGS, sql_from=PARTS, spark_from=_parts)
_find("find_array_equal", "part", {"tags": {"$eq": ["red", "ring"]}}, "tags = ['red', 'ring']", _TAGS, sql_from=PARTS, spark_from=_parts)
_find("find_array_index_path", "part", {"tags.0": "red"}, "tags[1] = 'red'", _TAGS, sql_from=PARTS, spark_from=_parts)
_find("find_exists", "orders", {"m": {"$exists": True}}, "m IS NOT NULL", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find("find_not_exists", "orders", {"m": {"$exists": False}}, "m IS NULL", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find("find_no_such_field", "orders", {"nothing": {"$exists": False}}, "true", OM)
_find("find_regex", "part", {"p_name": {"$regex": "^[a-m].*e"}}, "regexp_matches(p_name, '^[a-m].*e')", ["p_partkey", "p_name"])
_find("find_regex_end", "part", {"p_name": {"$regex": "e$"}}, "regexp_matches(p_name, 'e$')", ["p_partkey"])
_find("find_regex_ignore_case", "part", {"p_brand": re.compile("brand#1", re.IGNORECASE)}, "regexp_matches(p_brand, 'brand#1', 'i')", ["p_partkey"])
_find("find_regex_on_number", "part", {"p_size": {"$regex": "1"}}, "false", ["p_partkey"])
_find("find_and", "orders", {"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 200000}}]}, "o_orderstatus = 'F' AND o_totalprice > 200000", OM)
_find("find_and_empty", "nation", {"$and": []}, "true", ["n_nationkey"])
_find("find_and_no_list", "nation", {"$and": {"n_nationkey": 1}}, "false", ["n_nationkey"])
_find("find_or", "orders", {"$or": [{"o_totalprice": {"$lt": 10000}}, {"o_orderpriority": "1-URGENT"}]}, "o_totalprice < 10000 OR o_orderpriority = '1-URGENT'", OM)
_find("find_or_empty", "nation", {"$or": []}, "false", ["n_nationkey"])
_find("find_not", "orders", {"$not": {"o_totalprice": {"$lt": 100000}}}, "NOT (o_totalprice < 100000)", OM)
_find("find_not_missing", "orders", {"$not": {"x": {"$lt": 100000}}}, "NOT coalesce(x < 100000, false)", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find("find_not_not", "orders", {"$not": {"$not": {"x": {"$gte": 100000}}}}, "x >= 100000", OM, sql_from=ORDERS_M, spark_from=_orders_m)
_find(
    "find_nested_logic", "orders",
    {"$and": [{"$or": [{"x": {"$lt": 30000}}, {"x": {"$gt": 300000}}]}, {"$or": [{"o_orderstatus": "F"}, {"$not": {"m": {"$in": ["O", "P"]}}}]}], "o_orderpriority": {"$nin": ["5-LOW"]}},
    "(x < 30000 OR x > 300000) AND (o_orderstatus = 'F' OR NOT coalesce(m IN ('O', 'P'), false)) AND o_orderpriority <> '5-LOW'",
    OM, sql_from=ORDERS_M, spark_from=_orders_m,
)
_find(
    "find_not_or", "orders", {"$not": {"$or": [{"m": "F"}, {"x": {"$gte": 200000}}]}},
    "NOT (coalesce(m = 'F', false) OR coalesce(x >= 200000, false))", OM, sql_from=ORDERS_M, spark_from=_orders_m,
)
_find("find_numeric_string", "orders", {"k": {"$gt": 500}}, "TRY_CAST(k AS DOUBLE) > 500", OM, sql_from="(SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)", spark_from=lambda t: t("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k")))
_find("find_number_against_string", "orders", {"o_orderkey": {"$lt": "50"}}, "o_orderkey < 50", OM)
_add("find_nested_path", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50", lambda t: Query({"props.k": {"$gt": 50}}).execute(_event_docs(t)).select("event_id"))
_add("find_variant_eq", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id < 100", lambda t: Query({"event_type": "click", "user_id": {"$lt": 100}}).execute(_event_docs(t)).select("event_id"))
_add("find_variant_missing", "SELECT event_id FROM events", lambda t: Query({"props.z": {"$ne": 1}}).execute(_event_docs(t)).select("event_id"))
_add("deep_equals", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) = 7", lambda t: Query({"props": {"$eq": {"k": 7}}}).execute(_event_docs(t)).select("event_id"))
_add("matches_projected", f"SELECT o_orderkey, coalesce(x < 100000 AND m <> 'F', false) AS hit FROM {ORDERS_M}", lambda t: (o := _orders_m(t)).select("o_orderkey", matches({"x": {"$lt": 100000}, "m": {"$in": ["O", "P"]}}, o.schema).alias("hit")))
_add("sort_multi", "SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC LIMIT 7", lambda t: Query().sort({"n_regionkey": -1, "n_name": 1}).limit(7).select(["n_nationkey", "n_name"]).execute(t("nation")))
_add("sort_missing_first", f"SELECT o_orderkey FROM {ORDERS_M} ORDER BY m ASC NULLS FIRST, o_orderkey LIMIT 50", lambda t: Query().sort({"m": 1, "o_orderkey": 1}).limit(50).select(["o_orderkey"]).execute(_orders_m(t)))
_add("sort_missing_last", f"SELECT o_orderkey FROM {ORDERS_M} ORDER BY m DESC NULLS LAST, o_orderkey LIMIT 50", lambda t: Query().sort({"m": -1, "o_orderkey": 1}).limit(50).select(["o_orderkey"]).execute(_orders_m(t)))
_add("skip_limit", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 20 OFFSET 15", lambda t: Query().sort({"l_orderkey": 1, "l_linenumber": 1}).skip(15).limit(20).select(["l_orderkey", "l_linenumber"]).execute(t("lineitem")))
_add("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", lambda t: Query().limit(0).select(["o_orderkey"]).execute(t("orders")))
_add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", lambda t: Query().sort({"o_totalprice": -1, "o_orderkey": 1}).limit(25).select(O).execute(t("orders")))
_add(
    "flagship",
    "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000 AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10",
    lambda t: Query({"o_orderstatus": {"$in": ["F", "O"]}, "o_totalprice": {"$gt": 100000}, "$or": [{"o_orderpriority": "1-URGENT"}, {"o_orderpriority": "2-HIGH"}]}).sort({"o_totalprice": -1, "o_orderkey": 1}).skip(10).limit(100).select(["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]).execute(t("orders")),
)
_add("select_fields", "SELECT c_custkey, c_name FROM customer", lambda t: Query().select(["c_custkey", "c_name", "nothing"]).execute(t("customer")))
_add("select_exclude", "SELECT n_nationkey, n_name FROM nation", lambda t: Query().select({"n_regionkey": 0}).execute(t("nation")))
_add("select_nested", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events", lambda t: Query().select(["event_id", "props.k"]).execute(_event_docs(t).select("event_id", DOC)).select("event_id", F.variant_get(DOC, "$.props.k", "int").alias("k")))
_add("find_one", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1", lambda t: Query({"o_orderstatus": "P"}).sort({"o_orderkey": 1}).limit(1).select(O).execute(t("orders")))
_add("count_all", "SELECT count(*) AS n FROM lineitem", lambda t: Query().execute(t("lineitem")).agg(F.count("*").alias("n")))
_add("count_criteria", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 10 AND l_returnflag <> 'N'", lambda t: Query({"l_quantity": {"$lt": 10}, "l_returnflag": {"$ne": "N"}}).execute(t("lineitem")).agg(F.count("*").alias("n")))
_add("count_query_limit", "SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 30 OFFSET 5)", lambda t: Query({"o_orderstatus": "F"}).skip(5).limit(30).execute(t("orders")).agg(F.count("*").alias("n")))


def _placed(t) -> DataFrame:
    return t("nation").withColumn("_pos", F.col("n_nationkey").cast("long"))


_add("update_position_down", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 3 THEN 10 WHEN n_nationkey > 3 AND n_nationkey <= 10 THEN n_nationkey - 1 ELSE n_nationkey END AS BIGINT) AS place FROM nation", lambda t: _placed(t).select("n_nationkey", moved_position(F.col("_pos"), F.col("n_nationkey") == 3, 3, 10).alias("place")))
_add("update_position_up", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 20 THEN 4 WHEN n_nationkey >= 4 AND n_nationkey < 20 THEN n_nationkey + 1 ELSE n_nationkey END AS BIGINT) AS place FROM nation", lambda t: _placed(t).select("n_nationkey", moved_position(F.col("_pos"), F.col("n_nationkey") == 20, 20, 4).alias("place")))


def _updated(name: str, criteria, update, sql: str, cols, make=_orders_m) -> None:
    def build(t) -> DataFrame:
        df = make(t)
        out = U.apply(df, update, matches(criteria, df.schema))
        return out.select(*[c if isinstance(c, str) else c() for c in cols])

    _add(name, sql, build)


_updated("update_set", {"o_totalprice": {"$gt": 300000}}, {"$set": {"o_orderstatus": "Z"}}, f"SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM {ORDERS_M}", ["o_orderkey", "o_orderstatus"])
_updated("update_set_new", {"o_orderstatus": "F"}, {"$set": {"flag": "done"}}, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' END AS flag FROM orders", ["o_orderkey", "flag"])
_updated("update_unset", {"o_orderstatus": "F"}, {"$unset": {"m": ""}}, f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE m END AS m FROM {ORDERS_M}", ["o_orderkey", "m"])
_updated("update_inc", {"o_orderstatus": "F"}, {"$inc": {"o_orderkey": 1000}}, "SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey + 1000 ELSE o_orderkey END AS o_orderkey, o_totalprice FROM orders", O)
_updated("update_inc_missing", {}, {"$inc": {"x": 5}}, f"SELECT o_orderkey, coalesce(x, 0) + 5 AS x FROM {ORDERS_M}", ["o_orderkey", "x"])
_updated("update_merge", {"m": {"$exists": False}}, {"m": "none", "o_orderpriority": "9"}, f"SELECT o_orderkey, coalesce(m, 'none') AS m, CASE WHEN m IS NULL THEN '9' ELSE o_orderpriority END AS o_orderpriority FROM {ORDERS_M}", ["o_orderkey", "m", "o_orderpriority"])
_updated("update_combined", {"o_orderstatus": "O"}, {"$inc": {"o_orderkey": 7}, "$unset": {"m": 1}, "$set": {"o_orderkey": 100, "m": "q"}}, f"SELECT CASE WHEN o_orderstatus = 'O' THEN 107 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE m END AS m, o_totalprice FROM {ORDERS_M}", ["o_orderkey", "m", "o_totalprice"])
_updated("update_many_nothing", {"o_orderstatus": "nope"}, {"$set": {"m": "x"}}, f"SELECT o_orderkey, m FROM {ORDERS_M}", ["o_orderkey", "m"])
_joined = lambda: F.array_join("tags", "|").alias("tags")
_updated("update_push", {"p_size": {"$lt": 10}}, {"$push": {"tags": "new"}}, f"SELECT p_partkey, array_to_string(CASE WHEN p_size < 10 THEN list_append(tags, 'new') ELSE tags END, '|') AS tags FROM {PARTS}", ["p_partkey", _joined], _parts)
_updated("update_pull", {"p_size": {"$lt": 30}}, {"$pull": {"tags": "red"}}, f"SELECT p_partkey, array_to_string(CASE WHEN p_size < 30 THEN list_filter(tags, lambda x: x <> 'red') ELSE tags END, '|') AS tags FROM {PARTS}", ["p_partkey", _joined], _parts)
_updated("update_add_to_set", {}, {"$addToSet": {"tags": "red"}}, f"SELECT p_partkey, array_to_string(CASE WHEN list_contains(tags, 'red') THEN tags ELSE list_append(tags, 'red') END, '|') AS tags FROM {PARTS}", ["p_partkey", _joined], _parts)
_updated("update_set_nested", {"event_type": "click"}, {"$set": {"props.k": -1, "props.deep.er": "x"}}, "SELECT event_id, CASE WHEN event_type = 'click' THEN -1 ELSE CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_type = 'click' THEN 'x' END AS er FROM events", ["event_id", lambda: F.variant_get(DOC, "$.props.k", "int").alias("k"), lambda: F.variant_get(DOC, "$.props.deep.er", "string").alias("er")], _event_docs)
_updated("update_inc_nested", {"props.k": {"$gte": 50}}, {"$inc": {"props.k": 100, "n": 1}}, "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS INT) >= 50 THEN CAST(json_extract(props, '$.k') AS INT) + 100 ELSE CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN CAST(json_extract(props, '$.k') AS INT) >= 50 THEN 1 END AS n FROM events", ["event_id", lambda: F.variant_get(DOC, "$.props.k", "int").alias("k"), lambda: F.variant_get(DOC, "$.n", "int").alias("n")], _event_docs)
_updated("update_unset_nested", {"user_id": {"$lt": 100}}, {"$unset": {"props.k": ""}}, "SELECT event_id, CASE WHEN user_id < 100 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k FROM events", ["event_id", lambda: F.try_variant_get(DOC, "$.props.k", "int").alias("k")], _event_docs)


def _deleted(t, criteria) -> DataFrame:
    df = _orders_m(t)
    return df.where(~matches(criteria, df.schema)).select("o_orderkey")


_add("delete_many", f"SELECT o_orderkey FROM {ORDERS_M} WHERE NOT coalesce(m = 'F' OR x > 300000, false)", lambda t: _deleted(t, {"$or": [{"m": "F"}, {"x": {"$gt": 300000}}]}))
_add("delete_many_missing", f"SELECT o_orderkey FROM {ORDERS_M} WHERE m IS NOT NULL AND m = 'F'", lambda t: _deleted(t, {"m": {"$ne": "F"}}))


def _validated(name: str, table, schema: Schema, key: str, sql: str) -> None:
    def build(t) -> DataFrame:
        df = table(t)
        return df.select(key, schema.errors(df)["code"].alias("code"))

    _add(name, sql, build)


_validated("validate_required", _orders_m, Schema({"m": {"type": "string", "required": True}}, strict=False), "o_orderkey", f"SELECT o_orderkey, CASE WHEN m IS NULL THEN 'SCH002' END AS code FROM {ORDERS_M}")
_validated("validate_type", lambda t: t("customer"), Schema({"c_custkey": {"type": "number"}, "c_name": {"type": "number"}}, strict=False), "c_custkey", "SELECT c_custkey, 'SCH003' AS code FROM customer")
_validated("validate_min_max", lambda t: t("customer"), Schema({"c_acctbal": {"type": "number", "validate": {"min": 0, "max": 5000}}}, strict=False), "c_custkey", "SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN 'SCH004' END AS code FROM customer")
_validated("validate_length", lambda t: t("documents"), Schema({"text": {"type": "string", "validate": {"minLength": 100, "maxLength": 2000}}}, strict=False), "doc_id", "SELECT doc_id, CASE WHEN length(text) < 100 OR length(text) > 2000 THEN 'SCH004' END AS code FROM documents")
_validated("validate_pattern", lambda t: t("part"), Schema({"p_brand": {"type": "string", "validate": {"pattern": r"^Brand#[1-3]\d$"}}}, strict=False), "p_partkey", "SELECT p_partkey, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]$') THEN 'SCH004' END AS code FROM part")
_validated("validate_enum", lambda t: t("customer"), Schema({"c_mktsegment": {"type": "string", "validate": {"enum": ["BUILDING", "MACHINERY"]}}}, strict=False), "c_custkey", "SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'SCH004' END AS code FROM customer")
_validated("validate_custom", lambda t: t("customer"), Schema({"c_acctbal": {"type": "number", "validate": {"custom": lambda v, get: ~((get("c_mktsegment") == "BUILDING") & (v < 1000))}}}, strict=False), "c_custkey", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 1000 THEN 'SCH006' END AS code FROM customer")
_validated("validate_strict", lambda t: t("nation"), Schema({"n_nationkey": {"type": "number"}, "n_name": {"type": "string"}}), "n_nationkey", "SELECT n_nationkey, 'SCH005' AS code FROM nation")
_validated(
    "validate_first_error", _orders_m,
    Schema({"o_orderkey": {"type": "number"}, "x": {"type": "number", "required": True, "validate": {"min": 100000}}, "m": {"type": "string", "validate": {"enum": ["F"]}}}, strict=False),
    "o_orderkey", f"SELECT o_orderkey, CASE WHEN x IS NULL THEN 'SCH002' WHEN x < 100000 THEN 'SCH004' WHEN m <> 'F' THEN 'SCH004' END AS code FROM {ORDERS_M}",
)
_add(
    "apply_defaults", f"SELECT o_orderkey, coalesce(m, 'none') AS m, coalesce(x, o_orderkey * 2.0) AS x FROM {ORDERS_M}",
    lambda t: Schema({"o_orderkey": {"type": "number"}, "m": {"type": "string", "default": "none"}, "x": {"type": "number", "default": lambda get: get("o_orderkey") * 2.0}}).normalised(_orders_m(t)),
)
_add("transform", "SELECT n_nationkey, lower(n_name) AS n_name FROM nation", lambda t: Schema({"n_nationkey": {"type": "number"}, "n_name": {"type": "string", "transform": F.lower}}).normalised(t("nation")))
_add("strict_extra", "SELECT n_nationkey FROM nation", lambda t: Schema({"n_nationkey": {"type": "number"}}).normalised(t("nation")))
_add("lax_extra", "SELECT n_nationkey, n_name, n_regionkey FROM nation", lambda t: Schema({"n_nationkey": {"type": "number"}}, strict=False).normalised(t("nation")))
_add("unique_violations", "SELECT l_orderkey AS k0, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1", lambda t: X.violations(t("lineitem"), X.definition("l_orderkey", True)))
_add("compound_unique", "SELECT l_orderkey AS k0, l_partkey AS k1, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", lambda t: X.violations(t("lineitem"), X.definition(["l_orderkey", "l_partkey"], True)))
_add("unique_missing_exempt", f"SELECT m AS k0, count(*) AS n FROM {ORDERS_M} WHERE m IS NOT NULL GROUP BY 1 HAVING count(*) > 1", lambda t: X.violations(_orders_m(t), X.definition("m", True)))
_add("chunk_split", "SELECT doc_id, CAST(i AS INT) AS chunk, substring(text, CAST(i * 512 + 1 AS BIGINT), 512) AS body FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 512.0) AS BIGINT) - 1)) AS i FROM documents WHERE length(text) > 0)", lambda t: D.chunks(t("documents"), "doc_id", "text", 512))
_add("chunk_roundtrip", "SELECT doc_id, text FROM documents WHERE length(text) > 0", lambda t: D.joined(D.chunks(t("documents"), "doc_id", "text", 512), "doc_id"))
_add("date_revival", "SELECT event_id, epoch_ms(date_trunc('milliseconds', ts)) AS ms FROM events", lambda t: t("events").select("event_id", F.unix_millis(D.revived(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).alias("ms")))
_add("valid_ids", "SELECT c_custkey, regexp_full_match(substr(md5(c_name), 1, 24), '[0-9a-f]{24}') AS hex, regexp_full_match(c_name, '[0-9a-f]{24}') AS plain FROM customer", lambda t: t("customer").select("c_custkey", ids.is_id(F.substring(F.md5(F.col("c_name").cast("binary")), 1, 24)).alias("hex"), ids.is_id(F.col("c_name")).alias("plain")))
_add("valid_names", "SELECT p.page_id, NOT regexp_matches(url, '[./\\\\]') AND length(url) <= 64 AS good FROM pages p", lambda t: t("pages").select("page_id", names.is_name(F.col("url")).alias("good")))
_add("valid_names_source", "SELECT doc_id, true AS good FROM documents", lambda t: t("documents").select("doc_id", names.is_name(F.col("source")).alias("good")))


#: Of a stored document, the columns that are compared.
NATION = {"n_nationkey": "int", "n_name": "string"}
ORDER = {"o_orderkey": "long", "o_orderstatus": "string", "o_totalprice": "double"}


def _collection(name: str, sql: str, table: str, cols: dict[str, str], change: Callable[[Collection, DataFrame], DataFrame | list | None], key: str) -> None:
    """change gets a new collection with the whole table in the order of its key, and the table; what it returns, or
    else the whole collection, is the result."""

    def build(t: Callable[[str], DataFrame]) -> DataFrame:
        df = t(table)
        c = Database(df.sparkSession, "scratch", scratch(df.sparkSession)).initialize().collection(table)
        c.insert_df(df.orderBy(key))
        out = change(c, df)
        if isinstance(out, list):
            return df.sparkSession.createDataFrame([tuple(d.get(k) for k in cols) for d in out], ", ".join(f"{k} {v}" for k, v in cols.items()))
        out = c.find_df() if out is None else out
        return out.select(*[F.try_variant_get(DOC, f"$.{k}", v).alias(k) for k, v in cols.items()]) if DOC in out.columns else out

    _add(name, sql, build)


def _id(c: Collection, criteria) -> str:
    return c.find_one(criteria)["_id"]


def _raises(code: str, run: Callable[[], object]) -> None:
    try:
        run()
    except DocumentError as e:
        if code in (e.code, e.details.get("cause")):
            return
        raise
    raise AssertionError(f"no error {code}")


def _inserted(c: Collection, _: DataFrame) -> None:
    c.insert_one({"n_nationkey": 25, "n_name": "ATLANTIS"})
    c.insert_many([{"n_nationkey": 26, "n_name": "LEMURIA"}, {"n_nationkey": 27}])
    _raises("DB007", lambda: c.insert_one({"_id": _id(c, {"n_nationkey": 26}), "n_nationkey": 28}))
    _raises("DOC008", lambda: c.insert_many([{"n_nationkey": 29}, {"_id": "free text"}]))


def _updated_one(c: Collection, _: DataFrame) -> None:
    c.update_by_id(_id(c, {"n_name": "NATION_6"}), {"$set": {"n_name": "GAUL"}})
    c.update_one({"n_nationkey": {"$gte": 20}}, {"$inc": {"n_nationkey": 100}})
    c.update_one({"n_name": "nowhere"}, {"$set": {"n_name": "x"}})


def _removed(c: Collection, _: DataFrame) -> None:
    c.delete_by_id(_id(c, {"o_orderstatus": "P"}))
    c.delete_one({"o_orderstatus": "F"})
    c.delete_many({"o_totalprice": {"$gt": 300000}})
    c.delete_by_id("0" * 24)


def _moved(c: Collection, _: DataFrame) -> list:
    c.update_position(_id(c, {"n_nationkey": 3}), 10)
    c.update_position(_id(c, {"n_nationkey": 20}), 4)
    c.update_position(_id(c, {"n_nationkey": 0}), 1000)
    return [{"n_nationkey": d["n_nationkey"], "place": c.get_position(d["_id"])} for d in c.find()]


def _constrained(c: Collection, _: DataFrame) -> None:
    c.create_index("n_name", unique=True)
    c.create_index(["n_regionkey", "n_name"], unique=True)
    _raises("IDX004", lambda: c.insert_one({"n_nationkey": 90, "n_name": "NATION_6"}))
    _raises("IDX004", lambda: c.update_many({"n_nationkey": {"$lt": 2}}, {"$set": {"n_name": "SAME"}}))
    _raises("IDX004", lambda: c.create_index("n_regionkey", unique=True))
    c.drop_index("n_name")
    c.insert_one({"n_nationkey": 91, "n_name": "NATION_6", "n_regionkey": 99})
    _raises("IDX004", lambda: c.insert_one({"n_nationkey": 92, "n_name": "NATION_6", "n_regionkey": 99}))


def _reopened(c: Collection, _: DataFrame) -> DataFrame:
    c.update_many({"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "Q"}})
    again = Collection(c.spark, c.store.files.root, c.name)
    return again.find_df({"o_orderstatus": {"$ne": "F"}})


_N, _O = ", ".join(NATION), ", ".join(ORDER)
_FIRST_P, _FIRST_F = ("(SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = '%s')" % x for x in "PF")
_collection("collection_insert", f"SELECT {_N} FROM nation UNION ALL SELECT * FROM (VALUES (25, 'ATLANTIS'), (26, 'LEMURIA'), (27, NULL))", "nation", NATION, _inserted, "n_nationkey")
_collection("collection_find_by_id", f"SELECT {_O} FROM orders WHERE o_orderkey = 42", "orders", ORDER, lambda c, _: [c.find_by_id(_id(c, {"o_orderkey": 42}))], "o_orderkey")
_collection("collection_find", f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000", "orders", ORDER, lambda c, _: c.find_df({"o_orderstatus": "F", "o_totalprice": {"$gt": 200000}}), "o_orderkey")
_collection("collection_find_by_index", f"SELECT {_N} FROM nation WHERE n_regionkey = 2", "nation", NATION, lambda c, _: c.create_index("n_regionkey") and c.find_by_index("n_regionkey", 2), "n_nationkey")
_collection("collection_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'", "orders", {"n": "long"}, lambda c, _: [{"n": c.count({"o_orderstatus": "O"})}], "o_orderkey")
_collection("collection_deep_skip", f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 12000", "orders", ORDER, lambda c, _: c.find_df(Query().skip(12000).limit(7)), "o_orderkey")
_collection("collection_get_position", "SELECT count(*) AS n FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders))", "orders", {"n": "long"}, lambda c, t: [{"n": c.get_position(_id(c, {"o_totalprice": t.agg(F.max("o_totalprice")).first()[0]}))}], "o_orderkey")
_collection("collection_find_by_position", f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders)", "orders", ORDER, lambda c, t: [c.find_by_position(t.count() // 2)], "o_orderkey")
_collection(
    "collection_update_position",
    "SELECT n_nationkey, CAST(CASE WHEN n_nationkey = 0 THEN 24 WHEN n_nationkey = 20 THEN 3 WHEN n_nationkey = 3 THEN 10 WHEN n_nationkey = 4 THEN 2 WHEN n_nationkey BETWEEN 11 AND 19 THEN n_nationkey ELSE n_nationkey - 1 END AS BIGINT) AS place FROM nation",
    "nation", {"n_nationkey": "int", "place": "long"}, _moved, "n_nationkey",
)
_collection("collection_update_one", "SELECT CAST(CASE WHEN n_nationkey = 20 THEN 120 ELSE n_nationkey END AS INT) AS n_nationkey, CASE WHEN n_name = 'NATION_6' THEN 'GAUL' ELSE n_name END AS n_name FROM nation", "nation", NATION, _updated_one, "n_nationkey")
_collection("collection_update_many", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders", "orders", ORDER, lambda c, _: c.update_many({"o_totalprice": {"$gt": 200000}}, {"$set": {"o_orderstatus": "Z"}}) and None, "o_orderkey")
_collection("collection_delete", f"SELECT {_O} FROM orders WHERE o_orderkey NOT IN ({_FIRST_P}, {_FIRST_F}) AND o_totalprice <= 300000", "orders", ORDER, _removed, "o_orderkey")
_collection("collection_unique", f"SELECT {_N} FROM nation UNION ALL SELECT 91, 'NATION_6'", "nation", NATION, _constrained, "n_nationkey")
_collection("collection_reopened", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Q' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'", "orders", ORDER, _reopened, "o_orderkey")
_collection(
    "collection_reopened_constraints", "SELECT n_regionkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, 'NEW'", "nation", {"n_regionkey": "int", "n_name": "string"},
    lambda c, _: _reopened_constraints(c), "n_nationkey",
)


def _reopened_constraints(c: Collection) -> list:
    c.create_index(["n_regionkey", "n_name"], unique=True)
    again = Collection(c.spark, c.store.files.root, c.name)
    _raises("IDX004", lambda: again.insert_one({"n_regionkey": 1, "n_name": "NATION_1"}))
    again.insert_one({"n_regionkey": 1, "n_name": "NEW"})
    return Collection(c.spark, c.store.files.root, c.name).find({"n_regionkey": 1})


def _told(name: str, sql: str, cols: str, build: Callable[[SparkSession, Callable[[str], DataFrame]], list[tuple]]) -> None:
    """A query whose rows the engine's own answers are."""
    _add(name, sql, lambda t: (spark := t("nation").sparkSession).createDataFrame(build(spark, t), cols))


def _code_of(run: Callable[[], object]) -> str:
    try:
        run()
    except DocumentError as e:
        return e.code
    return "none"


REJECTED = [
    {"$nor": [{"n_name": "x"}]}, {"$where": "1"}, {"n_name": {"$mod": [2, 0]}}, {"n_name": {"$not": {"$eq": "x"}}}, {"n_name": {"$elemMatch": {}}},
    {"n_name": {}}, {"n_name": {"a": 1}}, {"n_name": ["x"]}, {"$and": [{"n_name": {"$type": "string"}}]}, {"n_name": {"$regex": "("}}, {"n_name": {"$options": "i"}},
]
_told(
    "rejected_criteria", f"SELECT CAST(i AS INT) AS place, 'QUE002' AS code FROM range({len(REJECTED)}) AS r(i)", "place int, code string",
    lambda spark, t: [(i, _code_of(lambda c=c: Query(c).execute(t("nation")))) for i, c in enumerate(REJECTED)],
)
UNDONE = [({"$mul": {"n_nationkey": 2}}, "DOC006"), ({"$pop": {"n_nationkey": 1}}, "DOC006"), ({"$rename": {"a": "b"}}, "DOC006"), ({"$set": {"_id": "x"}}, "DOC006"), ({"$inc": {"n_name": 1}}, "DOC003"), ({"$inc": {"n_nationkey": "1"}}, "DOC003"), ({"a.b": 1}, "DOC006"), ("x", "DOC009"), ({"$push": {"n_name": 1}}, "DOC006")]
_told(
    "rejected_updates", "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS INT), '{code}')" for i, (_, code) in enumerate(UNDONE)) + ") AS v(place, code)", "place int, code string",
    lambda spark, t: [(i, _code_of(lambda u=u: U.apply(t("nation"), u))) for i, (u, _) in enumerate(UNDONE)],
)
_add(
    "validate_message", f"SELECT o_orderkey, CASE WHEN x < 50000 THEN 'too cheap' END AS message FROM {ORDERS_M}",
    lambda t: (o := _orders_m(t)).select("o_orderkey", Schema({"x": {"type": "number", "validate": {"min": 50000, "message": "too cheap"}}}, strict=False).errors(o)["message"].alias("message")),
)
_validated("validate_constructor", _orders_m, Schema({"o_orderkey": {"type": int}, "m": {"type": str, "required": True}, "x": {"type": float}}, strict=False), "o_orderkey", f"SELECT o_orderkey, CASE WHEN m IS NULL THEN 'SCH002' END AS code FROM {ORDERS_M}")
_validated("validate_wrong_type", lambda t: _event_docs(t).withColumn(DOC, F.when(F.col("event_id") % 2 == 0, F.col(DOC)).otherwise(F.to_variant_object(F.struct(F.lit(7).alias("event_type"))))), Schema({"event_type": {"type": "string"}}, strict=False), "event_id", "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'SCH003' END AS code FROM events")
_validated("validate_python_rule", lambda t: t("customer"), Schema({"c_acctbal": {"type": "number", "validate": {"custom": PythonRule(lambda v: v >= 0 or "in debt")}}}, strict=False), "c_custkey", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'SCH006' END AS code FROM customer")
_add(
    "underscored_fields_go", "SELECT n_nationkey, n_name FROM nation",
    lambda t: Schema({"n_nationkey": {"type": "number"}}, strict=False).normalised(t("nation").select("n_nationkey", "n_name", F.lit(1).alias("_hidden"))),
)
_add(
    "timestamps", "SELECT n_nationkey, n_nationkey < 5 AS kept, true AS made, true AS changed FROM nation",
    lambda t: Schema({"n_nationkey": {"type": "number"}}, timestamps=True)
    .normalised(t("nation").select("n_nationkey", F.when(F.col("n_nationkey") < 5, F.lit("2001-02-03").cast("timestamp")).alias("_createdAt")))
    .select("n_nationkey", (F.year("_createdAt") == 2001).alias("kept"), F.col("_createdAt").isNotNull().alias("made"), (F.col("_updatedAt") >= F.lit("2020-01-01")).alias("changed")),
)
_add("sparse_unique", f"SELECT m AS k0, o_orderpriority AS k1, count(*) AS n FROM {ORDERS_M} WHERE m IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1", lambda t: X.violations(_orders_m(t), X.definition(["m", "o_orderpriority"], True, sparse=True)))


def _json(t) -> DataFrame:
    """Documents written as JSON lines, compressed, and read back."""
    df = t("customer")
    path = f"{scratch(df.sparkSession)}/customers"
    D.write_json(D.from_typed(df), path)
    return D.read_json(df.sparkSession, path).select(*[F.variant_get(DOC, f"$.{c}", k).alias(c) for c, k in (("c_custkey", "long"), ("c_name", "string"), ("c_acctbal", "double"))])


_add("json_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer", _json)


def _optional(c: Collection, df: DataFrame) -> list:
    """A null without a default is not stored."""
    c.delete_many()
    c.schema = Schema({"k": {"type": "number"}, "a": {"type": "string"}, "b": {"type": "string", "default": "x"}})
    c.insert_many([{"k": 1, "a": None, "b": None}, {"k": 2, "a": "y"}])
    return [{"k": d["k"], "fields": ",".join(sorted(set(d) - {"_id"}))} for d in c.find()]


_collection("optional_null_is_not_stored", "SELECT * FROM (VALUES (1, 'b,k'), (2, 'a,b,k')) AS v(k, fields)", "nation", {"k": "int", "fields": "string"}, _optional, "n_nationkey")


def _own_ids(c: Collection, _: DataFrame) -> list:
    c.schema = Schema({"_id": {"type": "string", "default": lambda get: F.concat(F.lit("N-"), get("k").cast("int").cast("string")), "validate": {"pattern": r"^N-\d+$"}}, "k": {"type": "number"}})
    c.insert_many([{"k": 7}, {"_id": "N-12", "k": 8}])
    _raises("DOC008", lambda: c.insert_one({"_id": "other", "k": 9}))
    return [{"id": d["_id"], "k": d["k"]} for d in (c.find_by_id("N-7"), c.find_by_id("N-12"))]


_collection("own_id_format", "SELECT * FROM (VALUES ('N-7', 7), ('N-12', 8)) AS v(id, k)", "nation", {"id": "string", "k": "int"}, _own_ids, "n_nationkey")


def _fresh_ids(c: Collection, df: DataFrame) -> DataFrame:
    d = c.df()
    return d.agg(F.count("*").alias("n"), F.countDistinct("_id").alias("ids"), F.bool_and(ids.is_hex_id(F.col("_id"))).alias("valid"))


_collection("fresh_ids", "SELECT count(*) AS n, count(*) AS ids, true AS valid FROM orders", "orders", {}, _fresh_ids, "o_orderkey")


def _databases(spark: SparkSession, t) -> list[tuple]:
    root = scratch(spark)
    db = Database(spark, "names", root)
    out = [("before", _code_of(lambda: db.collection("x")))]
    db.initialize()
    for n in ("b", "a:1", "a"):
        db.collection(n).insert_one({"k": n})
    out += [("list", ",".join(db.list_collections())), ("dropped", str(db.drop_collection("a:1"))), ("again", str(db.drop_collection("a:1")))]
    out += [("reopened", ",".join(Database(spark, "names", root).initialize().list_collections())), ("kept", db.collection("a").find()[0]["k"]), ("bad", _code_of(lambda: db.collection("../x")))]
    return out


_told("databases", "SELECT * FROM (VALUES ('before', 'DB011'), ('list', 'a,a:1,b'), ('dropped', 'True'), ('again', 'False'), ('reopened', 'a,b'), ('kept', 'a'), ('bad', 'COL003')) AS v(step, said)", "step string, said string", _databases)
_told(
    "error_fields", "SELECT 'DOC002' AS code, 'DB007' AS cause, true AS timed, 'DocumentError' AS name", "code string, cause string, timed boolean, name string",
    lambda spark, t: [(lambda e: (e["code"], e["details"]["cause"], "timestamp" in e, e["name"]))(DocumentError("x", "DB007").within("y", "DOC002").to_dict())],
)
