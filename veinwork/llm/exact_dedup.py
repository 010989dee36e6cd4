"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest.  New rows meet it
in a sort-merge join that needs no exchange on the index side; digests that
the index does not hold are appended by a sort-merge anti-join.

Defined results: a null text counts as empty; equal texts form one group, of
which the row with the largest id stays (an owner already in the index stays
before any new row); repeated rows of one id count as members of their group;
an empty input gives no rows.  Only id and text are read, so other columns
may have any name.

A group may hold a third of all rows: members are counted by (digest, salt)
first and meet their group again under the same salted key, so that no task
gets more than 1 / SALTS of a group.  Texts are never shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.workspace import kept_rows, partitions, rested, shared_folder, written

SALTS = 64


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """digest -> owner id, bucketed and sorted by digest, at a shared path.

    The number of buckets is fixed when the index is made, and kept in the file
    ``_buckets`` beside its data; whoever opens it later gets that number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Open the index at ``path`` or make it; a number other than the index has is an error."""
        self.spark, self.path = spark, path
        made = self._made()
        if made and buckets and buckets != made:
            raise ValueError(f"the index at {path} has {made} buckets, not {buckets}")
        self.buckets = made or buckets or partitions(spark)
        if not made:
            out = self._files().create(self._marker(), False)
            out.writeInt(self.buckets)
            out.close()
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, owner_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _marker(self) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, "_buckets")

    def _files(self) -> object:
        return self._marker().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _made(self) -> int | None:
        """The number of buckets of the index at the path; data without it is an error."""
        files, marker = self._files(), self._marker()
        if files.exists(marker):
            file = files.open(marker)
            number = file.readInt()
            file.close()
            return number
        if files.exists(marker.getParent()) and len(files.listStatus(marker.getParent())):
            raise ValueError(f"{self.path} holds files, but no index with a number of buckets")
        return None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Append the digests of ``groups`` (digest, owner_id) that the index does not hold."""
        fresh = groups.join(self.table().hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", "owner_id")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table's name; the files of this external table stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Digests new to the index are appended to it.  ``keep_id`` is the indexed
    owner where the index already had the digest, else the largest id of the
    group in this batch; ``group_size`` counts the rows of this batch.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest")).withColumn(
            "salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        ),
        f"{folder}/digests",
    )
    salted = rows.groupBy("digest", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest").agg(
        F.max("top").alias("batch_owner"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts")
    )
    known = index.table().withColumnRenamed("owner_id", "indexed_owner")
    groups = written(
        groups.join(known.hint("merge"), "digest", "left").select(
            "digest", F.coalesce("indexed_owner", "batch_owner").alias("owner_id"), "group_size", "salts"
        ),
        f"{folder}/groups",
    )
    index.append(groups)
    by_salt = groups.select("digest", "owner_id", "group_size", F.explode("salts").alias("salt"))
    return (
        rows.join(by_salt.hint("merge"), ["digest", "salt"])
        .select(
            "doc_id",
            F.col("owner_id").alias("keep_id"),
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("owner_id"), F.col("owner_id").isNull()).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def _once(docs: DataFrame) -> DataFrame:
    """``deduplicate`` against an index of its own, whose name is forgotten afterwards."""
    index = DigestIndex(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/index")
    try:
        return deduplicate(docs, index)
    finally:
        index.close()


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays, of those with the largest doc_id."""
    rested(spark)
    found = _once(docs).groupBy("doc_id", F.xxhash64("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.bool_or("kept").alias("kept"))
    decided = written(found, f"{shared_folder(spark)}/decided")
    return kept_rows(docs, {"doc_id": F.col("doc_id").cast("long"), "digest": F.xxhash64(digest(F.col("text")))}, decided)
