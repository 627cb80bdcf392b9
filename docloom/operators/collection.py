"""Collections: ordered documents with ids, constraints and atomic changes."""

from __future__ import annotations

import math
import re
import threading
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentError
from ..functions import ids
from ..functions.fields import DOC, field
from ..plans import criteria as C
from ..plans import update as U
from ..plans.query import Query
from ..plans.schema import Schema, typed_value
from ..sources import documents as D
from ..sources.store import FEW, Manifest, Store, place_of_rank, positions
from . import indexes as X

_locks: dict[str, threading.RLock] = {}

#: Between the positions of documents that are inserted one by one, so that another finds room there.
STRIDE = 1 << 16
#: Files of one order of size that are merged, and the bytes from which a file is not.
FAN, LARGE = 32, 128 << 20


def _code(e: Exception) -> str:
    """The code that a plan raised, if it did."""
    text = str(e)
    return next((c for c in ("DOC003", "DOC006") if f"{c}:" in text), "")


class Collection:
    """find, insert, update, delete and positions over one versioned store.

    Results come in order of position. A change is one plan over the files that hold what it changes and one commit, so
    it happens altogether or not at all; constraints are judged on the state after the change, before it is committed.
    After a change, files of one order of size are merged where there are FAN of them.

    cache: keeps the documents of the version last read in Spark's cache.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, schema: Schema | None = None, id_type: str = "mongo", codec: str = "gzip", rows: int = 0, retries: int = 10, cache: bool = False):
        self.spark, self.name, self.schema, self.id_type, self.retries = spark, name, schema, id_type, retries
        self.store = Store(spark, path, codec, rows)
        self.lock = _locks.setdefault(path, threading.RLock())
        self.cache, self._cached = cache, (0, None)

    # reading

    def df(self) -> DataFrame:
        """All documents: _id, _pos, doc. Lazy."""
        return self._frame(self.store.manifest())

    def _frame(self, m: Manifest) -> DataFrame:
        if not self.cache:
            return self.store.frame(m)
        if self._cached[0] != m.version or self._cached[1] is None:
            self.clear_cache()
            self._cached = (m.version, self.store.frame(m).persist())
        return self._cached[1]

    def clear_cache(self) -> None:
        if self._cached[1] is not None:
            self._cached[1].unpersist()
        self._cached = (0, None)

    def find_df(self, criteria: Any = None) -> DataFrame:
        """Matching documents; lazy, in no order unless the query has one."""
        return self._executed(self._query(criteria))

    def _executed(self, q: Query) -> DataFrame:
        """A deep skip in order of position becomes a range of positions: a sort would bring all that is skipped to one
        place."""
        m = self.store.manifest()
        df = self._frame(m)
        if q.order or q.skipped < FEW:
            return q.execute(df)
        kept = q.filtered(df)
        at = place_of_rank(kept, q.skipped, m.parts, q.criteria in (None, {}))
        return q.skip(0).execute(df.where(F.lit(False) if at is None else F.col("_pos") >= at))

    def find(self, criteria: Any = None) -> list[dict[str, Any]]:
        q = self._query(criteria)
        df = self._executed(q)
        return D.to_values(df if q.order or q.limited is not None or q.skipped and q.skipped < FEW or "_pos" not in df.columns else df.orderBy("_pos"))

    def find_one(self, criteria: Any = None) -> dict[str, Any] | None:
        q = self._query(criteria)
        found = self.find(q.limit(1 if q.limited is None else min(1, q.limited)))
        return found[0] if found else None

    def find_by_id(self, id: str) -> dict[str, Any] | None:
        self._check_id(id)
        found = D.to_values(self.df().where(F.col("_id") == id).limit(1))
        return found[0] if found else None

    def count(self, criteria: Any = None) -> int:
        """Documents that match; of a Query, after its skip and limit."""
        return self._executed(self._query(criteria)).count()

    def get_position(self, id: str) -> int:
        """0-based, -1 if there is no such document."""
        if not isinstance(id, str) or not self._good_id(id):
            raise DocumentError("Invalid ID", "DOC008", id=repr(id))
        df = self.df()
        at = df.where(F.col("_id") == id).select("_pos").first()
        return -1 if at is None else df.where(F.col("_pos") < at[0]).count()

    def find_by_position(self, n: int) -> dict[str, Any] | None:
        self._check_index(n)
        m = self.store.manifest()
        at = place_of_rank(self._frame(m), int(n), m.parts, True)
        return None if at is None else D.to_values(self._frame(m).where(F.col("_pos") == at))[0]

    def find_by_index(self, fields: str | list[str], *values: Any) -> list[dict[str, Any]] | None:
        """The documents with these values of an index's fields; None if there is no such index."""
        cols = X.fields_of(fields)
        if not self.has_index(cols):
            return None
        if len(values) != len(cols):
            raise DocumentError(f"{'+'.join(cols)} takes {len(cols)} values", "DOC009", fields=cols)
        return self.find({c: {"$eq": v} for c, v in zip(cols, values)})

    # writing

    def insert_one(self, doc: dict[str, Any]) -> dict[str, Any]:
        return self.insert_many([doc])[0]

    def insert_many(self, docs: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """The documents as they were stored."""
        if not isinstance(docs, (list, tuple)):
            raise DocumentError("insert_many takes a list", "DOC009")
        if bad := [d for d in docs if not isinstance(d, dict)]:
            raise DocumentError("Invalid document: must be an object", "DOC009", value=repr(bad[0])).within("Error inserting document", "DOC002")
        if not docs:
            return []
        for d in docs:
            if "_id" in d and d["_id"] is not None and not self._good_id(d["_id"]):
                raise DocumentError("Invalid document ID format", "DOC008", id=repr(d["_id"])).within("Error inserting document", "DOC002")
        batch = self._prepared(D.from_values(self.spark, list(docs)), lambda e: e.orderBy("_ord"))
        if "_id" not in (self.schema.fields if self.schema else {}) or self.schema.fields["_id"].default is None:
            fresh = {i: ids.new_id(self.id_type) for i, d in enumerate(docs) if d.get("_id") is None}
            given = self.spark.createDataFrame([(i, x) for i, x in fresh.items()], "_ord long, _new string")
            batch = batch.join(given, "_ord", "left").withColumn("_id", F.coalesce("_id", "_new")).drop("_new")
        else:
            default = self.schema.fields["_id"].default
            made = default(lambda path: typed_value(field(batch.schema, path), self.schema.fields[path].type if path in self.schema.fields else "")) if callable(default) else F.lit(default)
            batch = batch.withColumn("_id", F.coalesce("_id", made.cast("string")))
        few = len(docs) <= FEW
        parts = self._append(batch, lambda df, start: (df.coalesce(1) if few else df).withColumn("_pos", F.lit(start) + F.col("_ord") * STRIDE))
        return D.to_values(self.store.frame(parts=parts).orderBy("_pos"))

    def insert_df(self, df: DataFrame, batch_of: tuple[str, int] | None = None) -> int:
        """Bulk insert of a table (or of _id and a variant doc); the number of documents. Nothing passes the driver.
        batch_of: a stream and the number of its batch, which is inserted once however often it comes."""
        batch = df.select((F.col("_id") if "_id" in df.columns else F.lit(None)).cast("string").alias("_id"), DOC) if DOC in df.columns else D.from_typed(df)
        batch = self._prepared(batch, lambda e: e)
        batch = batch.withColumn("_id", F.coalesce("_id", ids.new_ids(self.id_type)))
        return sum(p["n"] for p in self._append(batch, positions, batch_of))

    def update_by_id(self, id: str, update: dict[str, Any]) -> dict[str, Any] | None:
        self._check_id(id)
        return self.find_by_id(id) if self._update(lambda df: F.col("_id") == id, update) else None

    def update_one(self, criteria: Any, update: dict[str, Any]) -> dict[str, Any] | None:
        """The first match in order."""
        first = self.find_one(criteria)
        return None if first is None else self.update_by_id(first["_id"], update)

    def update_many(self, criteria: Any, update: dict[str, Any]) -> int:
        """Documents that matched."""
        C.parse(criteria)
        return self._update(lambda df: C.matches(criteria, df.schema), update)

    def delete_by_id(self, id: str) -> bool:
        self._check_id(id)
        return bool(self._delete(lambda df: F.col("_id") == id))

    def delete_one(self, criteria: Any) -> bool:
        first = self.find_one(criteria)
        return first is not None and self.delete_by_id(first["_id"])

    def delete_many(self, criteria: Any = None) -> int:
        C.parse(criteria)
        return self._delete(lambda df: C.matches(criteria, df.schema))

    def update_position(self, id: str, index: int) -> bool:
        """Moves a document; beyond the end means the last place."""
        if not isinstance(id, str) or not self._good_id(id):
            raise DocumentError("Invalid ID", "DOC008", id=repr(id))
        self._check_index(index)

        def change(df: DataFrame, m: Manifest) -> dict[str, Any] | None:
            at = df.where(F.col("_id") == id).select("_pos").first()
            if at is None:
                return None
            old = at[0]
            to = place_of_rank(df, int(index), m.parts, True)
            to = max(p["hi"] for p in m.parts) if to is None else to
            if old == to:
                return {}
            # the neighbours between which it will stand
            if to < old:
                after = to
                before = df.where(F.col("_pos") < to).agg(F.max("_pos")).first()[0]
            else:
                before = to
                after = df.where(F.col("_pos") > to).agg(F.min("_pos")).first()[0]
            if before is None:
                new = after - STRIDE
            elif after is None:
                new = before + STRIDE
            else:
                new = (before + after) // 2
            if new not in (before, after):
                where = self.store.holding(m, df, F.col("_id") == id)
                touched = [p for p in m.parts if p["file"] in where]
                moved = F.when(F.col("_id") == id, F.lit(new)).otherwise(F.col("_pos"))
            else:  # no room: what lies between gives way
                low, high = min(old, to), max(old, to)
                touched = [p for p in m.parts if p["lo"] <= high and p["hi"] >= low]
                moved = moved_position(F.col("_pos"), F.col("_id") == id, old, to)
            return {**self._replaced(m, touched, lambda df: df.withColumn("_pos", moved)), "next_pos": max(m.next_pos, new + STRIDE)}

        return self._commit(change) is not None

    # constraints

    def create_index(self, fields: str | list[str], unique: bool = False, sparse: bool = False, name: str | None = None) -> bool:
        index = X.definition(fields, unique, sparse, name)

        def change(df: DataFrame, m: Manifest) -> dict[str, Any]:
            if any(i["fields"] == index["fields"] for i in m.indexes):
                return {}
            if unique and not X.violations(df, index).isEmpty():
                raise DocumentError(f"Duplicate values for {'+'.join(index['fields'])}", "IDX004").within("Error creating index", "IDX001")
            return {"indexes": [*m.indexes, index]}

        self._commit(change)
        return True

    def has_index(self, fields: str | list[str]) -> bool:
        cols = X.fields_of(fields)
        return any(i["fields"] == cols for i in self.list_indexes())

    def drop_index(self, fields: str | list[str]) -> bool:
        cols = X.fields_of(fields)
        self._commit(lambda df, m: {"indexes": [i for i in m.indexes if i["fields"] != cols]} if any(i["fields"] == cols for i in m.indexes) else {})
        return True

    def list_indexes(self) -> list[dict[str, Any]]:
        return self.store.manifest().indexes

    def compact(self, fan: int | None = None) -> int:
        """Merges files of one order of size where there are `fan` (FAN, if None) or more; the number of files that
        went."""
        fan = FAN if fan is None else fan
        gone: list[int] = []

        def change(df: DataFrame, m: Manifest) -> dict[str, Any]:
            tiers: dict[int, list[dict[str, Any]]] = {}
            for p in m.parts:
                if p["bytes"] < LARGE and p["n"] <= self.store.rows // 2:
                    tiers.setdefault(round(math.log(p["n"], max(2, fan))), []).append(p)
            small = [p for tier in tiers.values() if len(tier) >= fan for p in tier]
            gone[:] = [len(small)]
            if not small:
                return {}
            files = -(-sum(p["bytes"] for p in small) // LARGE)
            return self._replaced(m, small, lambda df: (df.coalesce(1) if files == 1 else df.repartitionByRange(files, "_pos")).sortWithinPartitions("_pos"))

        self._commit(change)
        return gone[0]

    def drop(self) -> None:
        self.clear_cache()
        with self.lock:
            self.store.files.delete()

    # how

    def _query(self, criteria: Any) -> Query:
        return criteria if isinstance(criteria, Query) else Query(criteria)

    def _good_id(self, id: object) -> bool:
        if self.schema is not None and "_id" in self.schema.fields:
            pattern = self.schema.fields["_id"].validate.get("pattern")
            if pattern is not None:
                return isinstance(id, str) and re.search(pattern, id) is not None
        return ids.valid_id(id)

    def _check_id(self, id: object) -> None:
        if not self._good_id(id):
            raise DocumentError("Invalid document ID format", "DOC008", id=repr(id))

    def _check_index(self, n: object) -> None:
        if isinstance(n, bool) or not isinstance(n, (int, float)) or n < 0 or n != int(n):
            raise DocumentError("Invalid index: Invalid Position", "DOC009", value=repr(n))

    def _prepared(self, batch: DataFrame, ordered: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The batch with the schema's defaults and transforms, or the first document's error."""
        if self.schema is None:
            return batch
        skip = ("_id",)
        bad = ordered(batch.withColumn("_e", self.schema.errors(batch, skip)).where("_e is not null")).select("_e.*").limit(1).collect()
        if bad:
            raise DocumentError(bad[0]["message"], bad[0]["code"], field=bad[0]["field"]).within("Error inserting document", "DOC002")
        return self.schema.normalised(batch)

    def _append(self, batch: DataFrame, place: Callable[[DataFrame, int], DataFrame], batch_of: tuple[str, int] | None = None) -> list[dict[str, Any]]:
        """The files written."""
        made: list[dict[str, Any]] = []

        def change(base: DataFrame, m: Manifest) -> dict[str, Any]:
            if batch_of and m.streams.get(batch_of[0], -1) >= batch_of[1]:
                return {}
            made[:] = self._write(place(batch, m.next_pos))
            self._unique(base, self.store.frame(parts=made), m)
            streams = {**m.streams, batch_of[0]: batch_of[1]} if batch_of else m.streams
            return {"parts": [*m.parts, *made], "next_pos": max((p["hi"] for p in made), default=m.next_pos - STRIDE) + STRIDE, "streams": streams}

        try:
            self._commit(change)
        except DocumentError as e:
            raise e if e.code == "DB010" else e.within("Error inserting document", "DOC002") from e
        if len(self.store.manifest().parts) >= FAN:
            self._tidy()
        return made

    def _tidy(self) -> None:
        """Merging changes no document, so a lost commit only leaves it to the next change."""
        try:
            self.compact()
        except DocumentError as e:
            if e.code != "DB010":
                raise

    def _write(self, df: DataFrame) -> list[dict[str, Any]]:
        parts = self.store.write(df)
        self._written += parts
        return parts

    def _replaced(self, m: Manifest, old: list[dict[str, Any]], change: Callable[[DataFrame], DataFrame]) -> dict[str, Any]:
        """The version with some files written anew; the others stay as they are."""
        new = self._write(change(self.store.frame(parts=old)))
        names = {p["file"] for p in old}
        return {"parts": [*(p for p in m.parts if p["file"] not in names), *new]}

    def _unique(self, base: DataFrame, new: DataFrame, m: Manifest) -> None:
        twice = new.groupBy("_id").count().where("count > 1").select("_id").unionByName(base.join(new.select("_id"), "_id", "left_semi").select("_id")).limit(1).collect()
        if twice:
            raise DocumentError(f"Duplicate id {twice[0][0]}", "DB007", id=twice[0][0])
        self._unique_keys(base, new, m.indexes)

    def _unique_keys(self, base: DataFrame, new: DataFrame, among: list[dict[str, Any]]) -> None:
        """Constraints of documents that join others; only those that share a key with them are read."""
        for index in among:
            if index["unique"]:
                both = X.touched(base, new, index).unionByName(new)
                self._report(X.violations(both, index), index)

    def _report(self, found: DataFrame, index: dict[str, Any]) -> None:
        if first := found.limit(1).collect():
            raise DocumentError(f"Duplicate value for unique index {index['name']}", "IDX004", fields=index["fields"], value=[str(x) for x in first[0][:-1]])

    def _update(self, hit: Callable[[DataFrame], Column], update: dict[str, Any]) -> int:
        try:
            U.parse(update)
        except DocumentError as e:
            raise e if e.code in ("DOC006", "DOC003") else e.within("Error updating document", "DOC006") from e
        number: list[int] = []
        paths = {path for fields in U.parse(update).values() for path in fields}

        def change(df: DataFrame, m: Manifest) -> dict[str, Any]:
            where = self.store.holding(m, df, hit(df))
            number[:] = [sum(where.values())]
            if not where:
                return {}
            held = [p for p in m.parts if p["file"] in where]
            old = self.store.frame(parts=held)
            names = old.where(hit(old)).select("_id")
            try:
                out = self._replaced(m, held, lambda df: self._changed(df, hit(df), update))
            except PySparkException as e:
                raise DocumentError(str(e).split("\n")[0], _code(e) or "DOC006").within("Error updating document", "DOC006") from e
            try:
                after = self.store.frame(parts=self._written).join(names, "_id", "left_semi")
                if self.schema is not None:
                    bad = after.withColumn("_e", self.schema.errors(after, ("_id",))).where("_e is not null").orderBy("_pos").select("_e.*").limit(1).collect()
                    if bad:
                        raise DocumentError(bad[0]["message"], bad[0]["code"], field=bad[0]["field"])
                judged = [i for i in m.indexes if any(X.overlap(path, f) for path in paths for f in i["fields"])]
                self._unique_keys(df.join(names, "_id", "left_anti"), after, judged)
            except DocumentError as e:
                raise e.within("Error updating document", "DOC006") from e
            return out

        self._commit(change)
        return number[0]

    def _changed(self, df: DataFrame, chosen: Column, update: dict[str, Any]) -> DataFrame:
        new = U.apply(df, update, chosen)
        if self.schema is not None and self.schema.timestamps:
            new = U.apply(new.withColumn("_hit", chosen), {"$set": {"_updatedAt": _now()}}, F.col("_hit")).drop("_hit")
        return new

    def _delete(self, hit: Callable[[DataFrame], Column]) -> int:
        number: list[int] = []
        gone = lambda df: F.coalesce(hit(df), F.lit(False))

        def change(df: DataFrame, m: Manifest) -> dict[str, Any]:
            where = self.store.holding(m, df, gone(df))
            number[:] = [sum(where.values())]
            held = [p for p in m.parts if p["file"] in where]
            if not any(p["n"] > where[p["file"]] for p in held):  # nothing or whole files
                return {"parts": [p for p in m.parts if p["file"] not in where]} if held else {}
            return self._replaced(m, held, lambda df: df.where(~gone(df)))

        self._commit(change)
        return number[0]

    def _commit(self, change: Callable[[DataFrame, Manifest], dict[str, Any] | None]) -> Manifest | None:
        """Runs a change on the newest version until its commit wins. What it wrote goes if it doesn't."""
        with self.lock:
            for left in range(self.retries, 0, -1):
                m = self.store.manifest()
                self._written: list[dict[str, Any]] = []
                try:
                    what = change(self.store.frame(m), m)
                    if what is None:
                        return None
                    return self.store.commit(m, **what) if what else m
                except DocumentError as e:
                    self.store.discard(self._written)
                    if e.code != "DB010" or left == 1:
                        raise
                except Exception:
                    self.store.discard(self._written)
                    raise
        return None


def _now() -> datetime:
    return datetime.now(timezone.utc)


def moved_position(pos: Column, moved: Column, old: int, new: int) -> Column:
    """Positions after one document goes from place `old` to `new`: what lies between gives way by one."""
    if old < new:
        return F.when(moved, F.lit(new)).when((pos > old) & (pos <= new), pos - 1).otherwise(pos)
    return F.when(moved, F.lit(new)).when((pos >= new) & (pos < old), pos + 1).otherwise(pos)

