"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of ``docs``. The last gives the packed pieces with their ids.

Null and empty texts count as empty: they are not toxic, one of them stays as an exact copy, they link with nothing, hold
no passages, and are packed as their closing id. Rows that repeat an id or have none are decided with their text; ties
go to the smallest id. Very long texts are read whole. Further columns pass through, whatever their names. An empty
table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetdrift.llm import common, exact, jaccard, packing, suffixes
from fleetdrift.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxic.drop_toxic(docs, toxic.fit(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return exact.drop_exact_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (runs of five words, similarity 0.8 or more), the document of the smallest id stays."""
    return jaccard.drop_near_copies(docs, size=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand earlier in the corpus are cut out."""
    return suffixes.cut_passages(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids, piece by piece."""
    return packing.pack(docs, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup), ("packing", packed)]
ORACLE_SQL = None  # a trained classifier and a tokenizer: held against a brute-force version in the tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
