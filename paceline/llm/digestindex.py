"""Exact duplicates against a persistent index of text digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.words import SPACES
from paceline.operators.joins import free_names, join_lookup
from paceline.sources.scratch import new_folder, pin
from paceline.sources.tables import read_stage


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text without its white space; null counts as empty."""
    bare = F.coalesce(text, F.lit(""))
    for space in SPACES:
        bare = F.replace(bare, F.lit(space), F.lit(""))
    return F.unhex(F.sha2(bare.cast("binary"), 256))


class DigestIndex:
    """One entry per distinct text ever added, in a folder bucketed and sorted by digest.

    The folder holds the entries and their layout, so a later session opens it again by its
    path; the number of buckets is fixed when it is made (by default that of the session's
    shuffle partitions). Every batch is matched against the entries by a sort-merge anti-join
    for which only the batch's distinct digests move, and what is new is appended.

    A batch has a name, which its entries bear. Adding a batch of that name again, after a
    failure at any point, appends only what is missing and gives the same answer.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets, self.id_type = read_stage(spark, f"{self.path}/layout").first()
        except FileNotFoundError:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.id_type = id_type
            layout = spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string")
            layout.write.mode("overwrite").parquet(f"{self.path}/layout")
        self.table = f"digest_index_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        place = f"{self.path}/entries".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {self.id_type}, n_chars INT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    def entries(self) -> DataFrame:
        """``digest, keep_id, n_chars, batch`` of every text in the index."""
        return self.spark.table(self.table)

    def _by_bucket(self, groups: DataFrame) -> DataFrame:
        return groups.repartition(self.buckets, "digest").hint("merge")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """The rows of a table with ``digest`` that have no entry; the entries are not shuffled."""
        return self._by_bucket(groups).join(self.entries().select("digest"), "digest", "left_anti")

    def classes(self, rows: DataFrame, batch: str) -> DataFrame:
        """Append what is new in a batch (``id, digest, n_chars, row``); its groups of equal texts.

        Of equal texts the row with the most characters, then the smallest id (null last),
        then the first row stays, unless an earlier batch has the text: then none does.
        """
        first = F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), F.col("id"), F.col("row")))
        groups = pin(
            rows.groupBy("digest")
            .agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", "first.id", "first.row", (-F.col("first.col1")).alias("n_chars"), "group_size")
        )
        fresh = self.unknown(groups).select("digest", F.col("id").alias("keep_id"), "n_chars", F.lit(batch).alias("batch"))
        fresh.write.insertInto(self.table)
        known = self.entries().select("digest", "keep_id", (F.col("batch") == batch).alias("own"))
        found = self._by_bucket(groups).join(known, "digest")
        return pin(found.select("digest", "keep_id", "group_size", F.when(F.col("own"), F.col("row")).alias("keep_row")))

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of ``docs``, dropped ones too; texts that are new go into the index.

        ``id_col, keep_id, group_size`` (equal rows of this batch), ``kept``, ``text_sha256``.
        A text is read once. Null texts are empty, empty ones are equal; of repeated rows
        one is kept; rows without an id take part and are kept only if no equal row has one;
        an empty table adds nothing. Other columns are not looked at.
        """
        rows = docs.select(
            F.col(f"`{id_col}`").alias("id"),
            text_digest(F.col(f"`{text_col}`")).alias("digest"),
            F.coalesce(F.length(f"`{text_col}`"), F.lit(0)).alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
        )
        out = self._judged(pin(rows), batch)
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")

    def keep_new(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``docs`` that stay, with all their columns; their texts go into the index."""
        (row,) = free_names(docs.columns, ["row"])
        docs = pin(docs.withColumn(row, F.monotonically_increasing_id()))
        rows = docs.select(
            F.col(f"`{id_col}`").alias("id"),
            text_digest(F.col(f"`{text_col}`")).alias("digest"),
            F.coalesce(F.length(f"`{text_col}`"), F.lit(0)).alias("n_chars"),
            F.col(row).alias("row"),
        )
        stay = self.classes(rows, batch).where("keep_row IS NOT NULL").select(F.col("keep_row").alias(row))
        return docs.join(stay, row, "left_semi").drop(row)

    def _judged(self, rows: DataFrame, batch: str) -> DataFrame:
        # Copies of one text may be a third of all rows: their digest is joined apart.
        found = join_lookup(rows, self.classes(rows, batch), {"digest": "digest"})
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
        return found.withColumn("kept", kept).withColumn("text_sha256", F.lower(F.hex("digest")))


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query: the whole table as one batch of a new index."""
    index = DigestIndex(docs.sparkSession, new_folder(docs.sparkSession, "digest-index"))
    return index.add(docs, "documents")


ORACLE = r"""
WITH texts AS (
    SELECT doc_id, coalesce(length(text), 0) AS n,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
    FROM documents
), judged AS (
    SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
           first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id
    FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM judged
"""
