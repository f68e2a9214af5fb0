"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only where a link is possible.

A unit vector ``x`` is held as ``s * q + e`` with int8 ``q``. From the norms of ``s * q`` and ``e`` the error of a
product of two quantised vectors is at most ``|sq| |e'| + |e| |sq'| + |e| |e'|``; products that stay below the
threshold by more than that are settled. int8 products are exact in float32 matrix products for up to 1,040 components;
longer vectors are multiplied in blocks of so many, summed in double precision. Rows and columns of a tile that hold an open pair are multiplied again in double precision, and that decides.

Equal vectors are one class with a count, so a vector that a third of all rows share is one row. Classes are dealt
to tiles by their nearest pivot; two tiles whose pivots are further apart than both radii and the threshold's angle
are skipped, which loses nothing. A tile pair returns link counts per class and a spanning forest of its links, never
the pairs.

Vectors that are null or zero or hold null or non-finite components link with nothing, nor do vectors of different
lengths. A null id has a null component. Rows that repeat id and vector link like any other equal vectors; an id with
several vectors is one node for components, and its rows share their link counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TILE_BYTES = 8 << 20  # of double vectors
SUB = 1024
PIVOTS = 256
EXACT = 1040  # components whose products, 127 * 127 each, add up to less than 2^24
SLACK = 1e-6  # rounding of scales, norms and the float32 product of scales
longs = common.longs


def _unit(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) per vector length."""
    column = batch.column("embedding")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = flat[first[rows][:, None] + np.arange(size)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, norm of the quantised vector, norm of the error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    held = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(held, axis=1), np.linalg.norm(x - held, axis=1)


def _assign(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies = longs(batch.column("node")), longs(batch.column("copies"))
            for rows, x in _unit(batch):
                size = x.shape[1]
                near = x @ pivots[size].T if size in pivots else np.ones((len(rows), 1))
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(rows)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), pa.array(copies[rows]), pa.array(np.full(len(rows), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["node", "copies", "size", "cell", "angle", "unit"],
                )

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in common.each_group(batches, "tile"):
        parts = [longs(table.column(c)).astype("<i8").tobytes() for c in ("node", "copies")]
        unit = b"".join(table.column("unit").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.column("tile")[0].as_py()], pa.string()), pa.array([table.column("size")[0].as_py()], pa.int32()), *(pa.array([p], pa.binary()) for p in (*parts, unit))],
            ["tile", "size", "nodes", "copies", "units"],
        )


def _cell_pairs(cells: list[tuple[int, int, int, float]], pivots: dict[int, np.ndarray], reach: float):
    """Of each cell, all tile pairs with itself and later cells that can hold a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("i").to_pylist():
                size, cell, tiles, radius = cells[i]
                a, b = [], []
                for other_size, other, other_tiles, other_radius in cells[i:]:
                    if other_size != size:
                        continue
                    if other != cell:
                        apart = math.acos(max(-1.0, min(1.0, float(pivots[size][cell] @ pivots[size][other]))))
                        if apart > radius + other_radius + reach + SLACK:
                            continue
                    for s in range(tiles):
                        for t in range(s if other == cell else 0, other_tiles):
                            a.append(f"{size}/{cell}/{s}")
                            b.append(f"{size}/{other}/{t}")
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return run


class _Tile:
    def __init__(self, nodes: bytes, copies: bytes, units: bytes, size: int):
        self.nodes, self.copies = np.frombuffer(nodes, "<i8"), np.frombuffer(copies, "<i8")
        self.x = np.frombuffer(units, "<f8").reshape(-1, size)
        q, scale, self.held, self.lost = quantise(self.x)
        self.q = q.astype(np.float32)
        self.scale = scale


def whole_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a b'`` of whole numbers up to 127 held as float32, exact at any length."""
    if a.shape[1] <= EXACT:
        return a @ b.T
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        total += a[:, k : k + EXACT] @ b[:, k : k + EXACT].T
    return total


def tile_links(a: _Tile, b: _Tile, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row indices of linked pairs, block by block; within one tile each pair once."""
    for i in range(0, len(a.x), SUB):
        rows = slice(i, i + SUB)
        for j in range(i if same else 0, len(b.x), SUB):
            cols = slice(j, j + SUB)
            product = whole_product(a.q[rows], b.q[cols])
            if same and i == j:
                product[np.tril_indices(len(product), 0, product.shape[1])] = -np.inf
            # the largest error of the block first: most rows end here
            most = a.held[rows].max() * b.lost[cols].max() + a.lost[rows].max() * (b.held + b.lost)[cols].max() + SLACK
            r = np.flatnonzero(product.max(axis=1) * a.scale[rows] * b.scale[cols].max() >= threshold - most)
            if not len(r):
                continue
            about = product[r] * a.scale[i + r, None] * b.scale[None, cols]
            bound = a.held[i + r, None] * b.lost[None, cols] + a.lost[i + r, None] * (b.held + b.lost)[None, cols] + SLACK
            open_ = about >= threshold - bound
            r, open_ = r[open_.any(axis=1)], open_[open_.any(axis=1)]
            c = np.flatnonzero(open_.any(axis=0))
            if not len(c):
                continue
            exact = a.x[i + r] @ b.x[j + c].T
            x, y = np.nonzero(open_[:, c] & (exact >= threshold))
            if len(x):
                yield i + r[x], j + c[y]


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023,E731
                size, same = get("size"), get("a") == get("b")
                a = _Tile(get("na"), get("ca"), get("ua"), size)
                b = a if same else _Tile(get("nb"), get("cb"), get("ub"), size)
                links_a, links_b = np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
                u, v = [], []
                for x, y in tile_links(a, b, same, threshold):
                    np.add.at(links_a, x, b.copies[y])
                    np.add.at(links_b, y, a.copies[x])
                    child, root = common.forest(a.nodes[x], b.nodes[y])
                    u.append(child)
                    v.append(root)
                if not u:
                    continue
                child, root = common.forest(np.concatenate(u), np.concatenate(v))
                nodes, counts = np.concatenate([a.nodes, b.nodes]), np.concatenate([links_a, links_b])
                some = counts > 0
                kind = np.repeat([0, 1], [int(some.sum()), len(child)]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(np.concatenate([nodes[some], child])), pa.array(np.concatenate([counts[some], root]))], ["kind", "a", "b"]
                )

    return run


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` per row of ``vectors``; links are cosines of at least ``threshold``.

    A tile has ``tile`` vectors, or as many as ``TILE_BYTES`` hold; there are at most ``pivots`` pivots, and no more
    than one for a full tile, since every tile pair moves two tiles.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable)
    classes = common.stage(good.groupBy("embedding").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "vector-classes")

    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("size")).first()
    tile = tile or max(SUB, TILE_BYTES // (8 * max(shape["size"] or 1, 1)))
    pivots = max(1, min(pivots, shape["n"] // tile))
    sample: dict[int, list] = {}
    for r in classes.select("embedding").orderBy(F.xxhash64("node"), "node").limit(pivots).collect():
        sample.setdefault(len(r.embedding), []).append(r.embedding)
    centres = {}
    for size, found in sample.items():
        x = np.array(found)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        centres[size] = x / np.linalg.norm(x, axis=1, keepdims=True)
    placed = common.stage(classes.mapInArrow(_assign(centres), "node long, copies long, size int, cell int, angle double, unit binary"), "vector-cells")
    # one row per pivot and vector length
    found = placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy("size", "cell").collect()
    if not found:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    cells = [(r["size"], r["cell"], -(-r["n"] // tile), r["radius"]) for r in found]

    salts = F.broadcast(spark.createDataFrame([(s, c, t) for s, c, t, _ in cells], "size int, cell int, tiles int"))
    name = F.concat_ws("/", "size", "cell", F.pmod(F.xxhash64("node"), F.col("tiles")))
    dealt = placed.join(salts, ["size", "cell"]).withColumn("tile", name).select("tile", "size", "node", "copies", "unit")
    tiles = common.stage(dealt.repartition(F.col("tile")).sortWithinPartitions("tile").mapInArrow(_tiles, "tile string, size int, nodes binary, copies binary, units binary"), "tiles")
    numbers = spark.range(len(cells)).select(F.col("id").alias("i")).repartition(F.col("i"))
    pairs = numbers.mapInArrow(_cell_pairs(cells, centres, math.acos(threshold)), "a string, b string")
    side = lambda s: [F.col("tile").alias(s), F.col("nodes").alias(f"n{s}"), F.col("copies").alias(f"c{s}"), F.col("units").alias(f"u{s}")]
    both = pairs.join(tiles.select(*side("a"), "size"), "a").join(tiles.select(*side("b")), "b")
    done = common.stage(both.mapInArrow(_compare(threshold), "kind byte, a long, b long"), "vector-links")

    links = done.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    members = common.components(done.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), "vector-components")
    facts = classes.join(links, "node", "left").join(members.withColumnRenamed("id", "node"), "node", "left")
    facts = facts.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.join(facts, "embedding").select("id", "n_links", "component_id")
    alone = rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select("*", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
