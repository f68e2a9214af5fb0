"""What the operators of this folder share: Arrow batch sizes, sorted groups, written stages, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes (a batch of long texts has few rows), and this package on the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_package(spark)


def documents(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``id`` (long) and ``text`` (null becomes empty), and nothing else that could clash with an operator's columns."""
    prepare(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in more]
    )


def stage(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back; survives the loss of executors."""
    return cut_lineage(df, f"llm-{label}")


def longs(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of one or more whole groups out of batches that are sorted by ``key``; producers bound the groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the edges at hand: (node, smallest node of its component), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def each_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per group of batches that are sorted by ``key``."""
    for table in sorted_groups(batches, key):
        keys = table.column(key).to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for start, end in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            yield table.slice(start, end - start)


FOREST_ROWS = 2_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    held, rows = [], 0

    def fold():
        return forest(np.concatenate([a, *[x for x, _ in held]]), np.concatenate([b, *[y for _, y in held]]))

    for batch in batches:
        held.append((longs(batch.column(0)), longs(batch.column(1))))
        rows += batch.num_rows
        if rows > FOREST_ROWS:
            a, b = fold()
            held, rows = [], 0
    a, b = fold()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v) edges of longs to (id, component): the smallest id reachable. Ids without an edge are not listed.

    Each partition first replaces its edges by a spanning forest, then large-star and small-star steps alternate
    until the forest has depth one. Every step is two aggregations with map-side combining and joins against one
    row per node, and is written out, so plans stay flat.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    stars = stage(edges.mapInArrow(_contract, "u long, v long"), label)
    while not _is_star(stars):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        stars = stage(small.distinct().mapInArrow(_contract, "u long, v long"), label)
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _is_star(stars: DataFrame) -> bool:
    """Every node has one parent, and no parent has one."""
    nodes = stars.select("u", F.lit(0).alias("of")).union(stars.select(F.col("v").alias("u"), F.lit(1).alias("of")).distinct())
    return nodes.groupBy("u").count().filter("count > 1").isEmpty()
