"""As-of joins: each row with what the last earlier row of its key says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], strict: bool = False, order: tuple[str, ...] = (), path: str | None = None
) -> DataFrame:
    """``left`` with ``last``, the ``values`` of the last row of ``right`` of its key by its time, and ``n_before``,
    how many there are.

    By its time means at it or before it, if ``strict`` only before it. ``order`` tells which of several rows of
    ``right`` at one time is the last. Without one, ``last`` is null and ``n_before`` 0; a null key or time meets none.

    No pairs: both sides are one table in the order of (key, time), cut into ranges, so that a hot key is many ranges;
    one pass per range carries the last row on. A range that begins within a key takes over from the ranges before
    it; there is at most one such key per range, so what is taken over is as small as the number of ranges. The
    ranges are written once (to ``path``, replaced there, or a new folder of the work folder): every task that is run
    again finds the same ones.
    """
    spark = left.sparkSession
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    row = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("r")).schema["r"].dataType
    named = [f"__k{i}" for i in range(len(keys))]
    key = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]
    asking = left.select(
        *key, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__value"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"),
    )
    telling = right.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, at]))
    ties = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    telling = telling.select(
        *key, F.col(at).alias("__at"), F.lit(2 if strict else 0).alias("__side"), F.struct(*values).alias("__value"), F.lit(None).cast(row).alias("__row"), *ties
    )
    every = telling.unionByName(asking, allowMissingColumns=True)
    inside = ["__at", "__side", *[f"__o{i}" for i in range(len(order))]]
    path = path or work_path(spark, "as-of")
    ranged = every.repartitionByRange(*named, *inside, F.xxhash64("__row")).withColumn("__range", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(path)
    placed = spark.read.schema(ranged.schema).parquet(path)

    tells = F.col("__row").isNull()
    group = [*named, "__range"]
    ends = placed.groupBy(*group).agg(
        F.count_if(tells).alias("n"), F.max_by("__value", F.when(tells, F.struct(*inside))).alias("v")
    )
    past = Window.partitionBy(*named).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select(*group, F.sum("n").over(past).alias("__n"), F.last("v", ignorenulls=True).over(past).alias("__v")).filter("__n > 0")
    so_far = Window.partitionBy(*group).orderBy(*inside).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumns({"__here": F.sum(tells.cast("long")).over(so_far), "__last": F.last("__value", ignorenulls=True).over(so_far)}).filter(~tells)
    # at most one row per range
    both = seen.join(F.broadcast(taken), group, "left")
    dated = F.col("__at").isNotNull()
    return both.select(
        "__row.*", F.when(dated, F.coalesce("__last", "__v")).alias("last"),
        F.when(dated, F.col("__here") + F.coalesce("__n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_before"),
    )
