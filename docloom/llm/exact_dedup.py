"""Exact dedup with a persistent digest index, bucketed and sorted by hash.

A text's digest is the SHA-256 of the text without the characters [\\x20\\x09-\\x0D]. A batch is reduced to one row
a digest (partial sums before the shuffle, so a third of all rows may be copies of one text), then what the index
already holds is taken out by a sort-merge anti-join and the rest is appended to the index. What an earlier batch kept
stays: rows of a later one that equal it are dropped, whatever their length, and its group grows by them.

Defined results: a null text is an empty text; empty texts are copies of one another. Of equal texts the longest
original (in code points) stays, then the smallest id; a null id comes after all others. Rows that repeat id and text
are one document and share its decision. Texts of any length are read whole. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, id_and_text, scratch_path

#: Characters that do not count.
BLANKS = r"[\x20\x09-\x0D]+"
ENTRY = "digest string, keep_id long, keep_points int, size long, first boolean"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, points (code points of the original text)."""
    d = id_and_text(docs, id_col, text_col)
    return d.select("doc_id", F.sha2(F.regexp_replace("text", BLANKS, ""), 256).alias("digest"), F.char_length("text").alias("points"))


class DigestIndex:
    """Append-only table of digests, bucketed and sorted by them: for each, a row with the document that stays and, for
    each later batch that holds it, a row with that batch's number of copies.

    The files at `path` outlive the session; opening the same path again goes on with them. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """buckets: fixed when the index is first made, the session's shuffle partitions by default, which spares the
        anti-join a shuffle of either side. The number is kept beside the files; to ask for another is an error."""
        self.spark, self.path = spark, path.rstrip("/")
        known = self._noted()
        if known and buckets not in (None, known):
            raise ValueError(f"the index at {path} has {known} buckets, not {buckets}")
        self.buckets = known or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not known:
            self._note(self.buckets)
        self.name = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _file(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets")  # names with an underscore are no data
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _noted(self) -> int | None:
        fs, path = self._file()
        if not fs.exists(path):
            if fs.exists(path.getParent()) and len(fs.listStatus(path.getParent())):
                raise ValueError(f"{self.path} holds files but is no digest index")
            return None
        stream = fs.open(path)
        try:
            return stream.readInt()
        finally:
            stream.close()

    def _note(self, buckets: int) -> None:
        fs, path = self._file()
        stream = fs.create(path, False)
        try:
            stream.writeInt(buckets)
        finally:
            stream.close()

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def entries(self) -> DataFrame:
        """The index without its bucketing: for a join whose other side has hot digests, which Spark may then split."""
        return self.spark.read.schema(ENTRY).parquet(self.path)

    def append(self, groups: DataFrame) -> bool:
        """groups: one row a digest. Known digests are left out by a sort-merge anti-join; only their number is noted.
        Whether the index held anything before."""
        known = self.read().where("first").select("digest").hint("merge")
        had = not known.isEmpty()
        rows = groups.join(known, "digest", "left_anti").withColumn("first", F.lit(True))
        if had:
            again = groups.join(known, "digest", "left_semi").withColumns({"first": F.lit(False), "keep_id": F.lit(None).cast("long"), "keep_points": F.lit(None).cast("int")})
            rows = rows.unionByName(again)
        rows = rows.select("digest", "keep_id", "keep_points", "size", "first")
        rows.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name)
        return had

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; returns doc_id, keep_id, group_size, kept, text_sha256, one row for each row of the batch.
        group_size counts all batches up to this one."""
        kept = Staged(self.spark)
        rows = kept.put(digests(docs, id_col, text_col), "digests")
        first = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i")))
        groups = rows.groupBy("digest").agg(first.alias("w"), F.count("*").alias("size"))
        groups = groups.select("digest", F.col("w.i").alias("keep_id"), (-F.col("w.p")).alias("keep_points"), "size")
        had = self.append(groups)
        entries = self.entries().withColumn("batches", F.lit(1))
        if had:  # the whole index is read, but only this batch's digests are summed
            mine = self.read().join(groups.select("digest").hint("merge"), "digest", "left_semi")
            of = lambda c: F.max(F.when(F.col("first"), F.col(c))).alias(c)
            entries = kept.put(mine.groupBy("digest").agg(of("keep_id"), of("keep_points"), F.sum("size").alias("size"), F.count("*").alias("batches")), "digest-sums")
        stays = (F.col("batches") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
        return rows.join(entries, "digest").select("doc_id", "keep_id", F.col("size").alias("group_size"), stays.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(spark: SparkSession, docs: DataFrame, index_path: str | None = None, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decisions for every row of docs, by an index at index_path (a new one, if None)."""
    return DigestIndex(spark, index_path or scratch_path(spark, "digest-index"), buckets).dedup(docs, id_col, text_col)


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they were; rows that repeat a whole document are listed once."""
    decided = Staged(spark).put(exact_dedup(spark, docs, id_col=id_col, text_col=text_col), "exact-decided")
    same = decided.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    twice = not decided.where("kept").groupBy("doc_id").agg(F.countDistinct("text_sha256").alias("n")).where("n > 1").isEmpty() or not same.isEmpty()
    if not twice:  # ids tell documents apart
        lost = decided.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
        also = decided.where("kept").select(F.col("doc_id").alias("__also"))
        if lost.join(also, lost["__gone"].eqNullSafe(also["__also"])).isEmpty():
            return docs.join(lost, docs[id_col].eqNullSafe(lost["__gone"]), "left_anti")
    tagged = docs.withColumn("__sha", F.sha2(F.regexp_replace(text, BLANKS, ""), 256)).withColumn("__points", F.char_length(text))
    stay = decided.where("kept").select(F.col("doc_id").alias("__stay"), F.col("text_sha256").alias("__digest")).distinct()
    best = tagged.join(stay, tagged[id_col].eqNullSafe(stay["__stay"]) & (tagged["__sha"] == stay["__digest"]), "left_semi")
    longest = best.groupBy("__sha").agg(F.max("__points").alias("__most")).withColumnRenamed("__sha", "__of")
    best = best.join(longest, (best["__sha"] == longest["__of"]) & (best["__points"] == longest["__most"]), "left_semi")
    return best.dropDuplicates(["__sha"]).drop("__sha", "__points")
