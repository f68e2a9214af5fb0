"""Joins against keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000
SPLITS_ITSELF = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")


def split_hot_join(
    big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK, salt: bool | None = None
) -> DataFrame:
    """Equi-join of ``big``, some of whose keys may be hot, with ``small``.

    With adaptive execution Spark measures the shuffled partitions and reads an oversized one in several tasks,
    which costs no further pass over ``big``; then this is a plain join. Where a session has switched that off,
    or ``salt`` asks for it, hot keys are salted here.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"{how} would need the copies of the small side to be told apart")
    conf = big.sparkSession.conf
    if salt is None:
        salt = not all(conf.get(name, "true") == "true" for name in SPLITS_ITSELF)
    return salted_join(big, small, keys, how, rows_per_task) if salt else big.join(small, keys, how)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str, rows_per_task: int) -> DataFrame:
    """The rows per key of ``big`` are counted first, with map-side combining. A hot key gets as many salts as it
    needs; its rows of ``small`` are copied once per salt, all other rows of ``small`` stay single. The salt of a
    row is a hash of the row, so a recomputed task yields the same split.
    """
    hot = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > rows_per_task)
        .select(*keys, F.ceil(F.col("__n") / F.lit(rows_per_task)).cast("int").alias("__salts"))
    )
    salted = big.join(hot, keys, "left").withColumn(
        "__salt",
        F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.col("__salts")).cast("int")
        ),
    )
    copies = small.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    return salted.drop("__salts").join(copies.drop("__salts"), [*keys, "__salt"], how).drop("__salt")
