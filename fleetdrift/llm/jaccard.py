"""Set-similarity join on word n-grams: rare-first prefixes, length, positional and suffix filters, one verification per pair.

The join finds the connected components of all links, so pairs inside a component that is already known need no
verification. That is what keeps a group of thousands of near copies from becoming millions of pairs:

1. Counts of all shingles over all documents, in a table of fixed size (hash buckets), give the global order:
   rare buckets first, then the hash. Any fixed order gives exact results; rare-first gives small prefixes' groups.
2. Documents with equal sets become one node (smallest id). The first ``n - ceil(t * n) + 1`` shingles of a node are
   its prefix; two nodes over the threshold share a prefix shingle.
3. Nodes meet per prefix shingle, in random order. Groups of up to ``SMALL`` nodes give all pairs, larger ones give
   each node a few neighbours. Pairs pass the length filter and the exact prefix/suffix bound, and are verified on
   the whole sets. Larger groups meet once more in another random order, only across components.
4. What is left open is settled exactly: in every larger group that still spans components, blocks of nodes are
   compared on their prefixes; a pair is emitted by its first common shingle only, and then verified.

Results: one row per document, with ``n_shingles`` and ``component_id``. Null and empty texts have an empty set and
are linked with nothing; rows with a null id are kept and have a null component; rows that repeat an id count as one
document; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

SKETCH_BITS = 20
SKETCH_BLOCKS = 64
SMALL = 8
BLOCK = 512
_SHIFT = np.uint64(64 - SKETCH_BITS)
_LOW = np.uint64((1 << (64 - SKETCH_BITS)) - 1)
_SIGN = np.uint64(1 << 63)
longs = common.longs


def _distinct(owner: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values per text: (values, offsets)."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    value = value[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=texts))]).astype(np.int64)


def _sets(batch: pa.RecordBatch, size: int, rank: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, values, offsets) per slice; with ``rank`` the values sort in the global order, as signed longs."""
    for row, data, offsets in words.slices(batch.column("text")):
        found = words.words(data, offsets)
        owner, value = words.shingles(found, found.hashes(lower=True), size)
        if rank is not None:
            value = ((rank[(value >> _SHIFT).astype(np.int64)] << _SHIFT) | (value & _LOW)) ^ _SIGN
            value = value.view(np.int64)
        yield row, *_distinct(owner, value, len(offsets) - 1)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, value, _ in _sets(batch, size, None):
                counts += np.bincount((value >> _SHIFT).astype(np.int64), minlength=len(counts))
        for block, part in enumerate(counts.reshape(SKETCH_BLOCKS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)])], ["block", "counts"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(counts), "<i8")
    for block, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.astype("<i8").tobytes()])], ["block", "counts"])


def bucket_ranks(texts: DataFrame, size: int) -> np.ndarray:
    """The place of each hash bucket when buckets are sorted by the number of document shingles in them."""
    parts = texts.select("text").mapInArrow(_count(size), "block int, counts binary")
    sums = parts.repartition(SKETCH_BLOCKS // 4, "block").mapInArrow(_sum_blocks, "block int, counts binary")
    counts = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for row in sums.collect():  # 2 ** SKETCH_BITS numbers at every input size
        counts[row.block] = np.frombuffer(row.counts, "<i8")
    counts = counts.ravel()
    rank = np.empty(len(counts), np.uint64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts), dtype=np.uint64)
    return rank


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _profile(size: int, percent: int, rank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in batches:
            ids = batch.column("id")
            for row, value, first in _sets(batch, size, order):
                n = np.diff(first)
                padded = np.append(value.view(np.uint64), np.uint64(0))
                sums = [np.where(n > 0, np.add.reduceat(words.mix(padded ^ salt), first[:-1]), 0).view(np.int64) for salt in (np.uint64(1), np.uint64(0xABCDEF))]
                prefix = np.where(n > 0, n - _least_overlap(n, percent) + 1, 0)
                place = np.arange(len(value)) - np.repeat(first[:-1], n)
                kept = value[place < np.repeat(prefix, n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)]), pa.int32()), pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(n)), pa.array(n, pa.int64()), *(pa.array(s, pa.int64()) for s in sums), lists], ["id", "n", "sig1", "sig2", "prefix"]
                )

    return run


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Sets of these sizes can be similar enough."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _meet(percent: int):
    """Rows (token, node, n) sorted by token, in random order inside a token, to pairs and to the rows of larger groups.

    Kind 0: a pair (a, b). Kind 1: node ``b`` of size ``n`` in the group of token ``a``, for groups of more than ``SMALL``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meetings(batches, percent)

    return run


def _meetings(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    token = node = size = np.zeros(0, np.int64)
    seen = 0  # rows of the last group before the carried ones
    for batch in batches:
        fresh = len(token)
        token, node, size = (np.concatenate([x, longs(batch.column(c))]) for x, c in ((token, "token"), (node, "node"), (size, "n")))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        starts = np.flatnonzero(new)
        place = np.arange(len(token)) - np.repeat(starts, np.diff(np.append(starts, len(token))))
        if fresh:
            place[: starts[1] if len(starts) > 1 else len(token)] += seen
        is_fresh = np.arange(len(token)) >= fresh
        a, b = [], []
        for back in range(1, SMALL):
            at = np.flatnonzero(is_fresh & (place >= back) & ((place < SMALL) | (back == 1)))
            at = at[_near(size[at - back], size[at], percent)]
            a.append(node[at - back])
            b.append(node[at])
        large = np.flatnonzero(is_fresh & (place >= SMALL))
        entered = np.flatnonzero(is_fresh & (place == SMALL))
        rows = np.concatenate([large, (entered[:, None] - np.arange(1, SMALL + 1)).ravel()])
        a, b = np.concatenate(a), np.concatenate(b)
        kind = np.repeat([0, 1], [len(a), len(rows)]).astype(np.int8)
        first = np.concatenate([np.minimum(a, b), token[rows]])
        second = np.concatenate([np.maximum(a, b), node[rows]])
        sizes = np.concatenate([np.zeros(len(a), np.int64), size[rows]])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(first), pa.array(second), pa.array(sizes)], ["kind", "a", "b", "n"])
        keep = max(int(starts[-1]), len(token) - SMALL)
        seen = int(place[keep])
        token, node, size = token[keep:], node[keep:], size[keep:]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def _may_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    """Upper bound of the overlap: common prefix shingles up to the shorter prefix's end, and all that may follow."""
    if 100 * min(nx, ny) < percent * max(nx, ny):
        return False
    end = min(x[-1], y[-1])
    in_x, in_y = np.searchsorted(x, end, "right"), np.searchsorted(y, end, "right")
    both = np.concatenate([x[:in_x], y[:in_y]])
    both.sort()
    common_ = int((both[1:] == both[:-1]).sum())
    return (100 + percent) * (common_ + min(nx - in_x, ny - in_y)) >= percent * (nx + ny)


def _bound(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, fx), (y, fy) = _lists(batch.column("xa")), _lists(batch.column("xb"))
            na, nb = longs(batch.column("na")), longs(batch.column("nb"))
            ok = [i for i in range(batch.num_rows) if _may_link(x[fx[i] : fx[i + 1]], int(na[i]), y[fy[i] : fy[i + 1]], int(nb[i]), percent)]
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return run


MARK_BITS = 23
MARK_BLOCKS = 64


def _mark(ids: np.ndarray) -> np.ndarray:
    return (words.mix(ids.view(np.uint64)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _mark_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << MARK_BITS, bool)
    for batch in batches:
        seen[_mark(longs(batch.column("id")))] = True
    for block, part in enumerate(seen.reshape(MARK_BLOCKS, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(part).tobytes()])], ["block", "marks"])


def _join_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, marks in zip(batch.column("block").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            total[block] = total.get(block, np.uint8(0)) | np.frombuffer(marks, np.uint8)
    for block, marks in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([marks.tobytes()])], ["block", "marks"])


def marks_of(ids: DataFrame) -> np.ndarray:
    """Hash marks of all ``ids``, 1 MB at every input size: texts of other documents need not be read further."""
    parts = ids.mapInArrow(_mark_ids, "block int, marks binary").repartition(MARK_BLOCKS // 4, "block").mapInArrow(_join_marks, "block int, marks binary")
    marks = np.zeros((MARK_BLOCKS, (1 << MARK_BITS) // MARK_BLOCKS), bool)
    for row in parts.collect():
        marks[row.block] = np.unpackbits(np.frombuffer(row.marks, np.uint8)).astype(bool)
    return marks.ravel()


def _marked(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marks.value[_mark(longs(batch.column("node")))]))

    return run


def _whole_sets(size: int, marks):
    """Sets of the documents that may be asked for; the join that follows leaves those that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marks.value[_mark(longs(batch.column("id")))]))
            ids = batch.column("id")
            for row, value, first in _sets(batch, size, None):
                raw = pa.py_buffer(np.ascontiguousarray(value).view(np.uint8))
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int64)), raw])
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(first) - 1), sets.cast(pa.binary())], ["node", "words"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i, (x, y) in enumerate(zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (len(both) - inter):
                    ok.append(i)
            yield batch.select(["u", "v"]).take(pa.array(ok, pa.int64()))

    return run


def _settle(percent: int):
    """Pairs across components inside a block pair of one group, each by its first common shingle only."""

    def pairs(table: pa.Table) -> tuple[list[int], list[int]]:
        node, comp, n = (longs(table.column(c)) for c in ("node", "comp", "n"))
        side, token = longs(table.column("side")), int(table.column("token")[0].as_py())
        x, first = _lists(table.column("prefix"))
        out: tuple[list[int], list[int]] = ([], [])
        names, sizes = np.unique(comp, return_counts=True)
        if len(names) < 2:
            return out
        outside = np.flatnonzero(comp != names[np.argmax(sizes)])
        value, at = np.unique(x, return_inverse=True)
        owner = np.repeat(np.arange(len(node)), np.diff(first))
        by_value = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[by_value], np.arange(len(value) + 1))
        one_block = len(np.unique(side)) == 1
        for i in outside:
            shared = np.zeros(len(node), np.int64)  # how many prefix shingles each node shares with node i
            least = np.full(len(node), np.iinfo(np.int64).max)
            for k in at[first[i] : first[i + 1]][::-1]:
                hit = owner[by_value[starts[k] : starts[k + 1]]]
                shared[hit] += 1
                least[hit] = value[k]
            fit = (least == token) & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if not one_block:
                fit &= side != side[i]
            fit &= (100 + percent) * (shared + np.minimum(n, n[i])) >= percent * (n + n[i])
            for j in np.flatnonzero(fit):
                if _may_link(x[first[i] : first[i + 1]], int(n[i]), x[first[j] : first[j + 1]], int(n[j]), percent):
                    out[0].append(min(node[i], node[j]))
                    out[1].append(max(node[i], node[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.each_group(batches, "cell"):
            a, b = pairs(table)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.percent, self.size = percent, size
        self.spark = docs.sparkSession
        self.texts = docs
        rank = self.spark.sparkContext.broadcast(bucket_ranks(docs, size))
        schema = "id long, n long, sig1 long, sig2 long, prefix array<long>"
        self.profile = common.stage(docs.mapInArrow(_profile(size, percent, rank), schema), "profile")
        named = self.profile.filter("n > 0 and id is not null")
        self.classes = named.groupBy("sig1", "sig2").agg(F.min("id").alias("node"))
        reps = self.classes.select("sig1", "sig2", F.col("node").alias("id"))
        self.nodes = named.join(reps.hint("merge"), ["id", "sig1", "sig2"], "left_semi").dropDuplicates(["id", "sig1", "sig2"]).select(F.col("id").alias("node"), "n", "prefix")
        self.nodes = common.stage(self.nodes, "nodes")

    def in_random_order(self, rows: DataFrame, salt: int) -> DataFrame:
        return rows.repartition(F.col("token")).sortWithinPartitions("token", F.xxhash64("token", "node", F.lit(salt)), "node")

    def marked_nodes(self, ids: DataFrame) -> DataFrame:
        """The nodes of these ids, and few others."""
        marks = self.spark.sparkContext.broadcast(marks_of(ids))
        return self.nodes.mapInArrow(_marked(marks), self.nodes.schema)

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs within the bound on their overlap; only nodes of some pair move their prefixes."""
        pairs = common.stage(pairs.select("a", "b").distinct(), "pairs")
        nodes = self.marked_nodes(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("xa"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("xb"))
        # both sides grow with the input: merged at every size
        return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").mapInArrow(_bound(self.percent), "a long, b long")

    def linked(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs whose whole sets are similar enough, as edges (u, v)."""
        pairs = common.stage(pairs, label)
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
        marks = self.spark.sparkContext.broadcast(marks_of(wanted))
        sets = self.texts.filter("id is not null").mapInArrow(_whole_sets(self.size, marks), "node long, words binary")
        sets = common.stage(sets, f"{label}-sets")
        wa = sets.select(F.col("node").alias("a"), F.col("words").alias("wa"))
        wb = sets.select(F.col("node").alias("b"), F.col("words").alias("wb"))
        both = pairs.join(wa.hint("merge"), "a").join(wb.hint("merge"), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "wa", "wb")
        return common.stage(both.mapInArrow(_verify(self.percent), "u long, v long"), f"{label}-links")

    def run(self) -> DataFrame:
        rows = self.in_random_order(self.nodes.select(F.explode("prefix").alias("token"), "node", "n"), 0)
        met = common.stage(rows.mapInArrow(_meet(self.percent), "kind byte, a long, b long, n long"), "met")
        large = met.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), "n")
        edges = self.linked(self.passing(met.filter("kind = 0")), "first")
        members = common.components(edges)
        open_rows = self.open_rows(large, members)
        if not open_rows.isEmpty():
            again = self.in_random_order(open_rows, 1).mapInArrow(_across(self.percent), "a long, b long")
            edges = edges.union(self.linked(self.passing(again), "second"))
            members = common.components(edges)
            open_rows = self.open_rows(open_rows.select("token", "node", "n"), members)
            if not open_rows.isEmpty():
                edges = edges.union(self.linked(self.settled(open_rows), "last"))
                members = common.components(edges)
        return members

    def open_rows(self, large: DataFrame, members: DataFrame) -> DataFrame:
        """Rows of the groups that span more than one component, with the component."""
        rows = large.join(members.withColumnRenamed("id", "node"), "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("comp"))
        spans = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo < hi")
        return common.stage(rows.join(spans.select("token", "rows"), "token"), "open")

    def settled(self, open_rows: DataFrame) -> DataFrame:
        """All remaining pairs that may link; a group is cut into blocks, and every two blocks are one cell."""
        blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(BLOCK))).cast("int")
        nodes = self.marked_nodes(open_rows.select(F.col("node").alias("id")))
        rows = open_rows.join(nodes.select("node", "prefix").hint("merge"), "node").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
        rows = rows.select(F.xxhash64("token", lo, hi).alias("cell"), "token", F.col("mine").alias("side"), "node", "comp", "n", "prefix")
        return rows.repartition(F.col("cell")).sortWithinPartitions("cell", "token").mapInArrow(_settle(self.percent), "a long, b long").distinct()


def _across(percent: int):
    """Neighbours of one token in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, ...] | None = None
        for batch in batches:
            columns = [longs(batch.column(c)) for c in ("token", "node", "comp", "n")]
            if not batch.num_rows:
                continue
            if last:
                columns = [np.append(x, y) for x, y in zip(last, columns, strict=True)]
            token, node, comp, n = columns
            at = np.flatnonzero((token[1:] == token[:-1]) & (comp[1:] != comp[:-1]) & _near(n[1:], n[:-1], percent))
            a, b = node[at], node[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])
            last = tuple(c[-1] for c in columns)

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` per row of ``docs``: components of Jaccard similarity >= percent / 100."""
    join = _Join(common.documents(docs, id_col, text_col), size, percent)
    members = join.run().withColumnRenamed("id", "node")
    node_of = join.classes.join(members, "node", "left").select("sig1", "sig2", F.coalesce("component", "node").alias("component"))
    rows = join.profile.select("id", F.col("n").alias("n_shingles"), "sig1", "sig2")
    found = rows.join(node_of, ["sig1", "sig2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component"))
    return found.select("id", "n_shingles", component.cast("long").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` but for documents that are linked to a smaller id; rows with a null id stay."""
    found = jaccard_components(docs, id_col, text_col, size, percent).filter("component_id < id").select(F.col("id").alias("__copy")).distinct()
    return docs.join(found, F.col(f"`{id_col}`") == F.col("__copy"), "left_anti")
