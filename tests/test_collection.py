"""Databases and collections end to end, with the scenarios that the engine's users rely on."""

import random
import threading
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from docloom import Database, DocumentError, PythonRule, Query, Schema
from docloom.functions.names import check_name
from docloom.operators import collection
from docloom.sources import store

RIVER = {"name": {"type": "string", "required": True}, "km": {"type": "number", "required": True, "validate": {"min": 0}}, "dams": {"type": "number", "default": 0}, "lands": {"type": "array"}}
ROWS = [("Danube", 2850, 59, ["DE", "AT", "HU"]), ("Isar", 292, 12, ["AT", "DE"]), ("Spree", 400, 3, ["DE", "CZ"]), ("Tisza", 966, 0, ["UA", "HU"]), ("Elbe", 1094, 4, ["CZ", "DE"]), ("Pegnitz", 113, 0, ["DE"])]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, "maps", str(tmp_path), compression=False).initialize()


@pytest.fixture
def rivers(db):
    c = db.collection("rivers", Schema(RIVER))
    c.insert_many([dict(zip(("name", "km", "dams", "lands"), r)) for r in ROWS])
    return c


def names(c, q=None):
    return [d["name"] for d in c.find(q)]


def test_queries(rivers):
    assert names(rivers, {"km": {"$gt": 500}}) == ["Danube", "Tisza", "Elbe"]
    assert names(rivers, {"lands": {"$in": ["HU"]}}) == ["Danube", "Tisza"]
    assert names(rivers, {"$and": [{"km": {"$gt": 300}}, {"dams": {"$gt": 0}}]}) == ["Danube", "Spree", "Elbe"]
    assert names(rivers, {"$or": [{"km": {"$gt": 2000}}, {"dams": 0}]}) == ["Danube", "Tisza", "Pegnitz"]
    assert names(rivers, Query().sort({"km": 1})) == ["Pegnitz", "Isar", "Spree", "Tisza", "Elbe", "Danube"]
    assert names(rivers, Query().skip(1).limit(2)) == ["Isar", "Spree"]
    assert rivers.find(Query({"name": "Isar"}).select(["name", "nothing"])) == [{"name": "Isar"}]
    assert rivers.find(Query({"name": "Isar"}).select({"lands": 0, "_id": 0})) == [{"name": "Isar", "km": 292, "dams": 12}]
    assert rivers.count() == 6 and rivers.count(Query().skip(1).limit(3)) == 3 and rivers.count({"dams": 0}) == 2
    assert rivers.find_one({"km": {"$lt": 500}})["name"] == "Isar" and rivers.find_one({"km": -1}) is None


def test_positions_and_reopening(rivers, db):
    first = rivers.find_one()["_id"]
    assert rivers.update_position(first, 2) and names(rivers) == ["Isar", "Spree", "Danube", "Tisza", "Elbe", "Pegnitz"]
    assert rivers.get_position(first) == 2 and rivers.find_by_position(2)["name"] == "Danube"
    assert rivers.update_position(first, 100) and rivers.find_by_position(5)["name"] == "Danube"
    assert rivers.update_position("0" * 24, 1) is False and rivers.get_position("0" * 24) == -1 and rivers.find_by_position(9) is None
    for bad in (-1, "1", None, True):
        with pytest.raises(DocumentError, match="Invalid index"):
            rivers.find_by_position(bad)
    with pytest.raises(DocumentError, match="Invalid ID"):
        rivers.get_position("nope")
    again = db.collection("rivers")
    assert names(again) == names(rivers) and again.count() == 6
    again.insert_one({"name": "New", "anything": 1})
    assert names(again)[-1] == "New"


@pytest.mark.parametrize("step", [1, 1 << 16])
def test_moves_against_a_list(db, monkeypatch, step):
    """With room between positions and without."""
    monkeypatch.setattr(collection, "STRIDE", step)
    c = db.collection("moves")
    want = [d["_id"] for k in range(3) for d in c.insert_many([{"k": k, "i": i} for i in range(4)])]
    rng = random.Random(2)
    for _ in range(8):
        who, to = rng.choice(want), rng.randrange(14)
        want.remove(who)
        want.insert(to, who)
        assert c.update_position(who, to)
        assert [d["_id"] for d in c.find()] == want and c.get_position(who) == want.index(who)
    assert c.df().select("_pos").distinct().count() == 12


@pytest.mark.parametrize("cut", [None, 700])
def test_deep_places(db, spark, monkeypatch, cut):
    """Few rows are sorted, whatever the place asked for; with one file and with files whose positions overlap."""
    monkeypatch.setattr(store, "FEW", 5)
    monkeypatch.setattr(store, "_BINS", 7)
    monkeypatch.setattr(collection, "FEW", 5)
    c = db.collection("deep")
    c.insert_df(spark.range(1000).select(F.col("id").alias("i")).repartitionByRange(5, "i").sortWithinPartitions("i"))
    c.insert_many([{"i": 1000 + i} for i in range(20)])
    if cut:
        c.update_many({"i": {"$gt": cut}}, {"$set": {"late": True}})
        c.store.commit(c.store.manifest(), parts=c.store.write(c.df().repartition(3)))
    for n in (0, 1, 499, 998, 1000, 1018, 1019):
        assert c.find_by_position(n)["i"] == n
        assert [d["i"] for d in c.find(Query().skip(n).limit(2))] == list(range(n, min(n + 2, 1020)))
    assert c.find_by_position(1020) is None and c.find(Query().skip(1020)) == [] and c.count(Query().skip(1010)) == 10
    even = {"i": {"$in": list(range(0, 1020, 2))}}
    assert [d["i"] for d in c.find(Query(even).skip(400).limit(3))] == [800, 802, 804] and c.find(Query(even).skip(510)) == []
    assert sorted(r[0] for r in c.find_df(Query().skip(900)).select(F.variant_get("doc", "$.i", "int")).collect()) == list(range(900, 1020))


def files(c):
    return {p["file"] for p in c.store.manifest().parts}


def test_changes_write_only_what_they_hit(db, spark):
    c = db.collection("parts")
    for k in range(4):
        c.insert_many([{"k": k, "i": i} for i in range(3)])
    before = files(c)
    assert len(before) == 4
    one = c.find_one({"k": 2})["_id"]
    c.update_by_id(one, {"$set": {"x": 1}})
    assert len(before & files(c)) == 3 and c.count() == 12
    c.delete_by_id(one)
    assert len(before & files(c)) == 3 and c.count() == 11
    c.update_position(c.find_one({"k": 0})["_id"], 7)
    assert len(before & files(c)) == 2
    c.delete_many({"k": 3})  # a whole file
    assert len(before & files(c)) == 1 and len(files(c)) == 3 and c.count() == 8
    assert c.delete_many() == 8 and files(c) == set() and c.find() == [] and c.update_many({}, {"$set": {"x": 1}}) == 0


def test_many_small_parts_are_merged(db, monkeypatch):
    monkeypatch.setattr(collection, "FAN", 4)
    c = db.collection("small")
    made = [c.insert_one({"i": i})["_id"] for i in range(18)]
    assert len(files(c)) <= 6 and [d["_id"] for d in c.find()] == made
    assert c.compact(2) > 0 and len(files(c)) <= 2 and [d["i"] for d in c.find()] == list(range(18)) and c.compact(99) == 0


def test_lost_commits_leave_nothing(db, monkeypatch):
    c = db.collection("lost")
    c.insert_one({"i": 0})
    commit, lost = c.store.commit, []

    def once(base, **changes):
        if not lost:
            lost.append(1)
            raise DocumentError("another", "DB010")
        return commit(base, **changes)

    monkeypatch.setattr(c.store, "commit", once)
    c.insert_one({"i": 1})
    with pytest.raises(DocumentError):
        c.update_many({}, {"$inc": {"i": 1}, "$push": {"i": 2}})
    folders = {n for n, folder in c.store.files.list() if folder}
    assert folders == {p["folder"] for p in c.store.manifest().parts} and c.count() == 2


def test_readers_keep_their_version(db):
    c = db.collection("old")
    c.insert_many([{"i": i} for i in range(3)])
    seen = c.find_df()
    for k in range(4):
        c.update_many({}, {"$inc": {"i": 10}})
    assert seen.count() == 3 and len({n for n, folder in c.store.files.list() if folder}) == 5
    c.store.sweep()
    assert seen.count() == 3
    c.store.sweep(keep=-1)
    assert {n for n, folder in c.store.files.list() if folder} == {p["folder"] for p in c.store.manifest().parts}
    assert [d["i"] for d in c.find()] == [40, 41, 42] and len(c.store.files.list()) == 2


@pytest.mark.parametrize("scheme", ["file", "other"])
def test_files_get_their_name_whole_and_once(db, scheme):
    f = db.collection("names").store.files
    f.make()
    f.scheme = scheme
    assert f.create("a" * 10000, "x") and not f.create("b", "x") and f.read("x") == "a" * 10000
    assert [n for n, _ in f.list()] == ["x"]


def test_cache(db):
    c = db.collection("cached", cache=True)
    c.insert_many([{"i": 1}, {"i": 2}])
    assert c.df() is c.df() and c.df().storageLevel.useMemory and c.count() == 2
    c.insert_one({"i": 3})
    assert c.count() == 3 and c.find_by_position(2)["i"] == 3
    c.clear_cache()
    assert not db.collection("cached").df().storageLevel.useMemory


def test_lookup_by_index(rivers):
    rivers.create_index(["name", "km"])
    assert rivers.has_index("name+km") and not rivers.has_index("km") and rivers.find_by_index("km", 400) is None
    assert [d["name"] for d in rivers.find_by_index(["name", "km"], "Spree", 400)] == ["Spree"] and rivers.find_by_index("name+km", "Spree", 1) == []
    with pytest.raises(DocumentError):
        rivers.find_by_index("name+km", "Spree")


def test_types_by_constructor(db):
    s = Schema({"a": {"type": str}, "b": {"type": int}, "c": {"type": bool}, "d": {"type": datetime}, "e": {"type": list}, "f": {"type": dict}})
    c = db.collection("kinds", s)
    good = {"a": "x", "b": 1.5, "c": True, "d": datetime(2024, 1, 1), "e": [1], "f": {"x": 1}}
    assert c.insert_one(good)["b"] == 1.5
    for k in good:
        with pytest.raises(DocumentError, match=f"{k} must be of type"):
            c.insert_one({**good, k: 7 if k != "b" else "7"})
    with pytest.raises(ValueError):
        Schema({"a": {"type": set}})


def test_updates(db):
    c = db.collection("free")
    d = c.insert_one({"a": {"b": 1}, "t": ["x"], "n": None, "when": datetime(2024, 1, 2, tzinfo=timezone.utc)})
    assert c.find_one() == d and d["when"] == datetime(2024, 1, 2, tzinfo=timezone.utc)
    u = c.update_by_id(d["_id"], {"$inc": {"a.b": 2, "n": 1, "q": 1.5}, "$set": {"m.x.y": "z"}, "$push": {"t": "y"}, "$addToSet": {"t": "x"}, "$unset": {"when": ""}})
    assert u == {"_id": d["_id"], "a": {"b": 3}, "t": ["x", "y"], "n": 1, "q": 1.5, "m": {"x": {"y": "z"}}}
    u = c.update_one({"a.b": 3}, {"$pull": {"t": "x"}, "$unset": {"m.x.y": "", "zz.y": ""}})
    assert u["t"] == ["y"] and u["m"] == {"x": {}} and "zz" not in u
    assert c.update_by_id(d["_id"], {"a": 5, "t": None})["a"] == 5
    assert c.update_many({"t": None}, {"$push": {"t": 1}}) == 1 and c.find_one()["t"] == [1]
    assert c.update_many({"nothing": 1}, {"$set": {"x": 1}}) == 0 and c.update_by_id("0" * 24, {"$set": {"x": 1}}) is None
    for bad, code in (({"$mul": {"a": 2}}, "DOC006"), ({"$set": {"_id": "x"}}, "DOC006"), ({"$inc": {"a": "x"}}, "DOC003")):
        with pytest.raises(DocumentError) as e:
            c.update_by_id(d["_id"], bad)
        assert e.value.code == code
    c.update_by_id(d["_id"], {"$set": {"s": "text"}})
    with pytest.raises(DocumentError) as e:
        c.update_by_id(d["_id"], {"$inc": {"s": 1}})
    assert e.value.code == "DOC006" and e.value.details["cause"] == "DOC003" and c.find_one()["s"] == "text"


def test_deletes(rivers):
    assert rivers.delete_many({"km": {"$gte": 400}}) == 4 and names(rivers) == ["Isar", "Pegnitz"]
    assert rivers.delete_one({"km": {"$gt": 0}}) and names(rivers) == ["Pegnitz"]
    assert not rivers.delete_one({"km": 0}) and not rivers.delete_by_id("0" * 24)
    with pytest.raises(DocumentError, match="Invalid document ID format"):
        rivers.delete_by_id("free text")


def test_schema_errors(db):
    c = db.collection("rules", Schema({
        "name": {"type": "string", "required": True, "validate": {"minLength": 3, "maxLength": 5}},
        "price": {"type": "number", "validate": {"min": 0, "max": 10}},
        "email": {"type": "string", "validate": {"pattern": r"^[\w-\.]+@([\w-]+\.)+[\w-]{2,4}$", "message": "no address"}},
        "size": {"type": "string", "validate": {"enum": ["S", "L"]}},
        "zip": {"type": "string", "validate": {"custom": lambda v, get: F.when((get("name") == "usa") & ~v.rlike(r"^\d{5}$"), F.lit("bad zip"))}},
        "odd": {"type": "number", "validate": {"custom": PythonRule(lambda v: v % 2 == 1)}},
        "day": {"type": "date"}, "flag": {"type": "boolean"}, "o": {"type": "object"}, "tags": {"type": "array", "validate": {"minLength": 1}},
    }))
    good = {"name": "abc", "price": 3, "email": "a.b@c.de", "size": "S", "zip": "x", "odd": 3, "day": datetime(2024, 1, 1), "flag": True, "o": {"x": 1}, "tags": [1]}
    assert c.insert_one(good)["price"] == 3
    for change, text in (
        ({"name": None}, "required"), ({"name": 5}, "type"), ({"name": "ab"}, "at least 3"), ({"name": "abcdef"}, "at most 5"),
        ({"price": -1}, "at least 0"), ({"price": 11}, "at most 10"), ({"price": "3"}, "type"), ({"email": "x"}, "no address"), ({"size": "M"}, "takes only"),
        ({"name": "usa", "zip": "123"}, "bad zip"), ({"odd": 2}, "own rule"), ({"day": "soon"}, "type"), ({"flag": 1}, "type"), ({"o": [1]}, "type"), ({"tags": []}, "at least 1"),
        ({"other": 1}, "no field"),
    ):
        with pytest.raises(DocumentError, match=text) as e:
            c.insert_many([{"name": "good"}, {**good, **change}])
        assert e.value.code == "DOC002"
    assert c.count() == 1  # nothing of a failed batch stays
    with pytest.raises(DocumentError, match="at least"):
        c.update_many({}, {"$set": {"price": -5}})
    assert c.find_one()["price"] == 3


def test_defaults_transforms_and_loose_fields(db):
    s = Schema({"name": {"type": "string", "transform": F.upper}, "n": {"type": "number", "default": 7}, "code": {"type": "string", "default": lambda get: F.concat(F.lit("X-"), get("name"))}, "o": {"type": "object", "default": {}}}, strict=False, timestamps=True)
    d = db.collection("loose", s).insert_many([{"name": "ab", "extra": [1, {"a": None}], "_hidden": 1}, {"name": "c", "n": None, "code": "own"}])
    assert d[0]["name"] == "AB" and d[0]["n"] == 7 and d[0]["code"] == "X-ab" and d[0]["o"] == {} and d[0]["extra"] == [1, {"a": None}]
    assert "_hidden" not in d[0] and d[1]["n"] == 7 and d[1]["code"] == "own" and isinstance(d[0]["_createdAt"], datetime)
    made = d[0]["_createdAt"]
    after = db.collection("loose", s).update_by_id(d[0]["_id"], {"$set": {"n": 8}})
    assert after["_createdAt"] == made and after["_updatedAt"] >= made


def test_unique_indexes(db):
    c = db.collection("u")
    c.insert_many([{"a": 1, "b": "x"}, {"a": "1", "b": "x"}, {"b": "y"}, {"b": "z"}])
    assert c.create_index("a", unique=True) and c.create_index("a")
    with pytest.raises(DocumentError, match="Duplicate") as e:
        c.insert_one({"a": 1})
    assert e.value.details["cause"] == "IDX004" and c.count() == 4
    with pytest.raises(DocumentError, match="Duplicate"):
        c.update_many({"b": {"$in": ["y", "z"]}}, {"$set": {"a": 9}})
    assert c.update_many({"b": "y"}, {"$set": {"a": 9}}) == 1
    with pytest.raises(DocumentError, match="Duplicate"):
        c.create_index("b", unique=True)
    assert [i["name"] for i in c.list_indexes()] == ["idx_a"]
    c.create_index(["a", "b"], unique=True)
    c.insert_many([{"a": 2, "b": "c|d"}, {"a": 3, "b": "c"}])
    c.drop_index("a")
    with pytest.raises(DocumentError, match="Duplicate"):
        c.insert_one({"a": 1, "b": "x"})
    assert c.insert_one({"a": 1, "b": "other"}) and c.drop_index("a+b") and c.drop_index("nothing") and c.list_indexes() == []


def test_ids(db):
    c = db.collection("ids", id_type="uuid")
    d = c.insert_one({"x": 1})
    assert len(d["_id"]) == 36
    for bad in ("free text", 5):
        with pytest.raises(DocumentError, match="Invalid document ID format"):
            c.insert_one({"_id": bad})
    assert c.insert_one({"_id": "507f1f77bcf86cd799439011", "x": 2})["_id"] == "507f1f77bcf86cd799439011"
    with pytest.raises(DocumentError) as e:
        c.insert_many([{"_id": "507f1f77bcf86cd799439011"}])
    assert e.value.details["cause"] == "DB007" and c.count() == 2
    own = db.collection("own", Schema({"_id": {"type": "string", "validate": {"pattern": r"^PROD-\d+-\d{1,3}$"}}, "n": {"type": "number"}}))
    assert own.insert_one({"_id": "PROD-12-3", "n": 1})["_id"] == "PROD-12-3" and own.find_by_id("PROD-12-3")["n"] == 1
    with pytest.raises(DocumentError):
        own.insert_one({"_id": "x", "n": 1})
    assert db.collection("own").find() == own.find()


def test_bulk_and_concurrent(db, spark, sf_dir):
    c = db.collection("orders")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert c.insert_df(o) == o.count() == c.count() and c.find_df({"o_orderstatus": "F"}).count() == o.where("o_orderstatus = 'F'").count()
    t = [threading.Thread(target=lambda k=k: c.insert_one({"k": k})) for k in range(4)]
    for x in t:
        x.start()
    for x in t:
        x.join()
    assert sorted(d["k"] for d in c.find({"k": {"$exists": True}})) == [0, 1, 2, 3]
    assert c.update_many({"k": {"$gte": 0}}, {"$inc": {"k": 10}}) == 4 and c.delete_many({"k": {"$gt": 11}}) == 2


def test_another_writer_wins(db):
    c = db.collection("race")
    c.insert_one({"n": 1})
    m = c.store.manifest()
    c.insert_one({"n": 2})
    with pytest.raises(DocumentError) as e:
        c.store.commit(m, parts=[])
    assert e.value.code == "DB010" and c.count() == 2


def test_databases(db, spark, tmp_path):
    assert db.list_collections() == []
    db.collection("a").insert_one({"x": 1})
    assert db.collection("b").find() == [] and db.list_collections() == ["a"]
    assert db.drop_collection("a") and not db.drop_collection("a") and db.list_collections() == []
    for k, odd in enumerate(("a:b", "ab", 'c"?*<d>|', "50% [x] {y}", " outer ")):
        db.collection(odd).insert_one({"k": k})
    assert db.list_collections() == sorted(["a:b", "ab", 'c"?*<d>|', "50% [x] {y}", "outer"])
    assert [db.collection(n).find()[0]["k"] for n in ("a:b", "ab", 'c"?*<d>|', "50% [x] {y}", "outer")] == [0, 1, 2, 3, 4]
    assert db.drop_collection("a:b") and not db.drop_collection("a:b") and not db.drop_collection("..") and db.collection("ab").count() == 1
    assert db.collection("a").insert_many([]) == []
    with pytest.raises(DocumentError, match="not initialized"):
        Database(spark, "x", str(tmp_path)).collection("y")
    for bad in ("", "  ", "../x", "a/b", "a\\b", "%2e%2e", "x\x00", "${x}", "{{x}}", "passwd", "ghosts", "a" * 65, "_x", "a.b", 5, None, "/etc/passwd", "%252f"):
        assert check_name(bad)
        with pytest.raises(DocumentError, match="Invalid database name"):
            Database(spark, bad)
        with pytest.raises(DocumentError, match="Collection name"):
            db.collection(bad)
    with pytest.raises(DocumentError) as e:
        db.collection("c").insert_many({"x": 1})
    assert e.value.code == "DOC009" and e.value.to_dict()["code"] == "DOC009"
