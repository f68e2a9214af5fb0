"""Exact dedup over a persistent index of text digests, bucketed and sorted by digest.

The index has one entry per distinct text ever seen: ``digest``, the id that stays, its length and the batch that
brought it. A batch is reduced to one entry per digest with map-side combining (a text that a third of all rows
share costs one entry per task), sort-merge anti-joined with the index, whose buckets need neither shuffle nor sort,
and what is new is appended. Texts are equal if they are equal without the characters ``[\\x20\\x09-\\x0D]``.

Of equal texts within a batch the one with the most code points stays, then the smallest id; a text that the index
already has stays with the row that brought it. Null text counts as empty; rows with a null id lose ties; repeated
rows count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from . import common

WHITE = " \t\n\x0b\f\r"
ENTRY = "digest binary, keep_id long, keep_points long, batch string"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest`` (SHA-256 of the text without white space, UTF-8) and ``points`` (code points of the text)."""
    texts = common.documents(docs, id_col, text_col)
    return texts.select("id", F.unhex(F.sha2(F.translate("text", WHITE, ""), 256)).alias("digest"), F.length("text").cast("long").alias("points"))


class DigestIndex:
    """A bucketed table at ``path``. Batches have names; a batch that is appended again after a failure is skipped."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or work_path(spark, "llm-digest-index")
        self.table = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"

    def entries(self) -> DataFrame:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({ENTRY}) USING parquet OPTIONS (path '{self.path}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        return self.spark.table(self.table)

    def append(self, found: DataFrame, batch: str) -> None:
        """Add one entry for each digest of ``found`` (``id``, ``digest``, ``points``) that the index lacks."""
        known = self.entries()
        if not known.filter(F.col("batch") == batch).isEmpty():
            return
        first = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("unnamed"), "id")).alias("best")
        new = found.groupBy("digest").agg(first).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"))
        new = new.repartition(self.buckets, "digest").join(known.select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        new = common.stage(new, "new-digests").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        new.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str = "0") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size`` (in this batch), ``kept``, ``digest``."""
    index = index or DigestIndex(docs.sparkSession)
    found = common.stage(digests(docs, id_col, text_col), "digests")
    index.append(found, batch)
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = sizes.join(index.entries().select("digest", "keep_id", "keep_points", "batch"), "digest")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch) & (F.col("points") == F.col("keep_points"))
    return found.join(groups, "digest").select("id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id stays; rows that repeat a kept id stay with it, and so do rows without an id if one is kept."""
    found = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("id").alias("__kept")).distinct()
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__kept")), "left_semi")
