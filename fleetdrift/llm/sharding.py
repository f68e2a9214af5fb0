"""Sharding by bytes with Karmarkar-Karp differencing; rows with equal texts are one indivisible group.

Differencing keeps partial partitions (tuples of subset sums), takes the two of the largest spread, and joins them
oppositely ordered, until one is left. It runs in levels, so that no task and no driver sees all groups: chunks of
``CHUNK`` items are differenced inside tasks into even composite items, composites are items of the next
level (``FOLD`` times fewer), and the last few thousand are differenced into the shards. Of each level some thousands of
items, chosen by hash, are not folded: they go into the last differencing as they are and fill the gaps that coarser
items leave, so balance does not fall with the number of groups. Groups above a share of the mean shard skip the
lower levels (there are at most ``shards * LARGE`` of them), so a group that holds a third of all bytes gets a shard
of its own with nothing added as long as that helps the balance; it is not split, since groups are indivisible.

Null text has no bytes and is one group with the empty text; ids may be null or repeat; further columns are ignored. A
very long text is a large group. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CHUNK = 4096
FOLD = 16
LAST = 16_384
LARGE = 8
ROW_BYTES = 16


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The subset, 0 to ``ways - 1``, of each item, by multi-way differencing."""
    parent = np.arange(len(sizes))
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes.tolist()):  # sums in rising order; a representative item of each subset, or -1
        sums, item = np.zeros(ways, np.int64), np.full(ways, -1)
        sums[-1], item[-1] = size, i
        heap.append((-size, i, sums, item))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, at, sums, item = heapq.heappop(heap)
        _, _, other, its = heapq.heappop(heap)
        sums = sums + other[::-1]
        for k in np.flatnonzero(its >= 0):
            mine = ways - 1 - k
            if item[mine] < 0:
                item[mine] = its[k]
            else:
                parent[its[k]] = item[mine]
        order = np.argsort(sums, kind="stable")
        sums, item = sums[order], item[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), at, sums, item))
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    subset = np.zeros(len(sizes), np.int64)
    if heap:
        item = heap[0][3]
        subset[item[item >= 0]] = np.flatnonzero(item >= 0)
    return subset[parent]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partition, chunk, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def emit():
        table = pa.Table.from_batches(held).combine_chunks()
        subset = difference(table.column("bytes").to_numpy(), -(-rows // FOLD))
        above = (np.int64(partition) << np.int64(40)) + np.int64(chunk) * CHUNK + subset
        return pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), table.column(1).combine_chunks(), pa.array(above, pa.int64())], ["item", "bytes", "above"])

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, CHUNK - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == CHUNK:
                yield emit()
                chunk, held, rows = chunk + 1, [], 0
    if held:
        yield emit()


def shard_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups``: ``item`` (binary or long) and ``bytes`` (long). Returns ``item`` and ``shard``."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bound = total / (shards * LARGE)
    large = groups.filter(F.col("bytes") > bound)  # at most shards * LARGE rows
    levels, spared, items = [], [], groups.filter(F.col("bytes") <= bound)
    while (count := items.count()) > LAST:
        kind = dict(items.dtypes)["item"]
        spare = F.pmod(F.xxhash64("item"), F.lit(1 << 40)) < int((1 << 40) * (LAST // 2) / count)
        spared.append(items.filter(spare))
        level = common.stage(items.filter(~spare).mapInArrow(_compose, f"item {kind}, bytes long, above long"), "level")
        levels.append(level)
        items = common.stage(level.groupBy(F.col("above").alias("item")).agg(F.sum("bytes").alias("bytes")), "composites")
    spared.append(items)
    top = [(at, r.item, r.bytes) for at, rows in enumerate([*spared, large]) for r in rows.collect()]
    top.sort(key=lambda r: (-r[2], r[0], r[1]))
    shard = difference(np.array([r[2] for r in top], np.int64), shards).tolist()

    def placed(at: int) -> DataFrame:
        kind = dict([*spared, large][at].dtypes)["item"]
        return spark.createDataFrame([(r[1], s) for r, s in zip(top, shard, strict=True) if r[0] == at], f"item {kind}, shard int")

    found = placed(len(levels))
    for at in reversed(range(len(levels))):
        found = levels[at].join(found.withColumnRenamed("item", "above"), "above").select("item", "shard").union(placed(at))
    return found.union(placed(len(spared)))


def with_slots(rows: DataFrame, parts: int = 64) -> DataFrame:
    """Number the rows of each ``shard`` without gaps: parts are numbered by themselves, part sizes give the offsets."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("shard", "part", before.alias("before")))  # shards * parts rows
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id"))
    return rows.withColumn("place", place).join(offsets, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long")).drop("part", "place", "before")


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` per row of ``docs``."""
    texts = common.documents(docs, id_col, text_col)
    size = (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("size")
    rows = common.stage(texts.select("id", size, F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("item")), "sizes")
    groups = common.stage(rows.groupBy("item").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.join(shard_of_groups(groups, shards), "item").select("id", "size", "text_crc32", "shard")
    return with_slots(common.stage(placed, "placed"))
