"""Passages that occur before: a sparse suffix array over words, sorted and compared by neighbours, extended both ways.

Defined result: number the words of all texts by (id, place). A window of ``WINDOW`` words is repeated if the same
words stand at an earlier window, in another document or in the same one. A document's repeated passages are the
maximal runs of words covered by repeated windows.

1. Positions are kept where the hash of ``RUN`` words is least among ``WINDOW - RUN + 1`` neighbouring positions (a
   minimiser, chosen by content alone). So every window of ``WINDOW`` words keeps a position, and equal windows keep
   the same one: one position in twenty is enough.
2. Positions whose run of words occurs once in the corpus are dropped (a count with map-side combining).
3. Each remaining suffix is taken with the words after it up to the end of a window, and those before it as far as a
   window that holds the run can begin. Suffixes of one run are sorted by the words after it, neighbours give the
   common lengths, and the same backwards to the left; a window is repeated if both its sides are shared with an
   earlier suffix.
4. A run that occurs more than ``HOT`` times (a passage or line that a third of all documents share) is not gathered:
   its suffixes are compared in parts of that size, and only each part's first of every window goes on, as a hash,
   to be counted over all parts with map-side combining. The result is the same.

Words are compared by 64-bit hashes, white space and nothing else is ignored. Null and empty texts and those of
fewer than ``WINDOW`` words have no passages; rows with a null id are not compared; rows that repeat an id are one
document of one text, of which the greatest text counts; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

WINDOW = 50
RUN = 12
HOT = 8000
longs = common.longs


def minimisers(found: words.Words, hashes: np.ndarray, run: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash of its run) of the kept positions; ties keep the leftmost."""
    runs = words.combine(hashes, run)
    width = window - run + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # least of `width` neighbours by doubling; indices of the least, so that equal values keep the left one
    at, span = np.arange(len(runs)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(runs[right] < runs[left], right, left)
        span += step
    text = found.text_of()
    inside = text[:n] == text[window - 1 :]
    kept = np.unique(at[:n][inside])
    return kept, runs[kept]


def _positions(run: int, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = longs(batch.column("id"))
            for row, data, offsets in words.slices(batch.column("text")):
                found = words.words(data, offsets)
                kept, runs = minimisers(found, found.hashes(), run, window)
                text = found.text_of()[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.view(np.int64)), pa.array(ids[row + text]), pa.array((kept - found.first[text]).astype(np.int32))], ["run", "id", "place"]
                )

    return work


def _suffixes(run: int, window: int):
    """Texts with the places to compare to one row per place, with its words around."""
    before = window - run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = longs(batch.column("id"))
            places = batch.column("places")
            for row, data, offsets in words.slices(batch.column("text")):
                found = words.words(data, offsets)
                hashes = found.hashes()
                part = places.slice(row, len(offsets) - 1)
                items = part.flatten()
                of = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
                place, key, parts_ = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                split = parts_ > 1
                part_of = words.mix(ids[row + of].view(np.uint64)) % parts_.astype(np.uint64)
                key = np.where(split, words.mix(key.view(np.uint64) + part_of * words.powers(2)[1] + np.uint64(1)).view(np.int64), key)
                centre = found.first[of] + place
                lo = np.minimum(place, before)
                hi = np.minimum(found.first[of + 1] - centre, window)
                # each place's words: `lo` before it and `hi` from it on
                size = lo + hi
                first = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(first[-1]) + np.repeat(centre - lo - first[:-1], size)
                around = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(split), pa.array(ids[row + of]), pa.array(place.astype(np.int32)), pa.array(lo.astype(np.int32)), around],
                    ["key", "split", "id", "place", "lo", "around"],
                )

    return work


def _sides(table: pa.Table, run: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words from the run on and words before it (nearest first), one row per suffix; 0 where the text ends."""
    around = table.column("around").combine_chunks()
    size = around.value_lengths().to_numpy(zero_copy_only=False)
    flat = around.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    lo = longs(table.column("lo"))
    ahead = np.zeros((len(size), window), np.int64)
    at = np.arange(window)
    there = at < (size - lo)[:, None]
    ahead[there] = flat[((first + lo)[:, None] + at)[there]]
    back = np.zeros((len(size), window - run), np.int64)
    at = np.arange(window - run)
    there = at < lo[:, None]
    back[there] = flat[((first + lo - 1)[:, None] - at)[there]]
    return ahead, back


def _common(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of the rows inside their groups, and the words each shares with its neighbour before it."""
    order = np.lexsort((*rows.T[::-1], group))
    same = (rows[order][1:] == rows[order][:-1]) & (rows[order][1:] != 0)
    shared = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], shared])


def repeated_windows(group: np.ndarray, ahead: np.ndarray, back: np.ndarray, rank: np.ndarray, run: int, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each place of the run in a window: (words before it, later suffixes, the earliest of each, all earliest)."""
    right, shared_right = _common(ahead, group)
    left, shared_left = _common(back, group)
    n = len(group)
    whole_right, whole_left = (ahead != 0).sum(axis=1), (back != 0).sum(axis=1)
    for d in range(window - run + 1):
        # classes of equal words: a new one where neighbours share too little
        to_right, to_left = np.empty(n, np.int64), np.empty(n, np.int64)
        to_right[right] = np.cumsum(shared_right < window - d)
        to_left[left] = np.cumsum(shared_left < d)
        fits = np.flatnonzero((whole_right >= window - d) & (whole_left >= d))
        order = fits[np.lexsort((rank[fits], to_left[fits], to_right[fits]))]
        new = np.ones(len(order), bool)
        new[1:] = (to_right[order[1:]] != to_right[order[:-1]]) | (to_left[order[1:]] != to_left[order[:-1]])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        yield d, order[~new], first[~new], order[new]


BUFFER = 20_000


def _compare(run: int, window: int):
    """Suffixes sorted by key to rows of two kinds.

    0: repeated windows of ``id`` from ``start`` to ``last``, the first of which stands at ``from_id``, ``from_start``.
    1: of runs that are compared in parts, a window that is the first of its part: ``last`` is its hash.
    """

    def settle(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        ids, place = longs(table.column("id")), longs(table.column("place")).astype(np.int64)
        split = longs(table.column("split"))
        ahead, back = _sides(table, run, window)
        _, group = np.unique(longs(table.column("key")), return_inverse=True)
        order = np.lexsort((place, ids))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        later, firsts = [np.zeros((4, 0), np.int64)], [np.zeros((3, 0), np.int64)]
        line = np.concatenate([back[:, ::-1], ahead], axis=1).view(np.uint64) if split.any() else None
        step = words.powers(window)[1 : window + 1]
        for d, again, first, own in repeated_windows(group, ahead, back, rank, run, window):
            later.append(np.array([ids[again], place[again] - d, ids[first], place[first] - d]))
            own = own[split[own]]
            if len(own):
                part = line[own, window - run - d : 2 * window - run - d]
                value = words.mix((part * step).sum(axis=1, dtype=np.uint64)).view(np.int64)
                firsts.append(np.array([ids[own], place[own] - d, value]))
        runs = merge(*np.concatenate(later, axis=1))
        own = np.concatenate(firsts, axis=1)
        kind = np.repeat([0, 1], [len(runs[0]), own.shape[1]]).astype(np.int8)
        none = np.zeros(own.shape[1], np.int64)
        columns = [np.concatenate([a, b]) for a, b in zip(runs, (own[0], own[1], own[2], none, none), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], ["kind", "id", "start", "last", "from_id", "from_start"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for table in common.sorted_groups(batches, "key"):
            held.append(table)
            rows += table.num_rows
            if rows >= BUFFER:
                yield settle(held)
                held, rows = [], 0
        if held:
            yield settle(held)

    return work


def merge(ids: np.ndarray, start: np.ndarray, from_id: np.ndarray, from_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive starts of one document as one row: id, start, last start, source of the first."""
    order = np.lexsort((from_start, from_id, start, ids))
    ids, start, from_id, from_start = ids[order], start[order], from_id[order], from_start[order]
    if not len(ids):
        return ids, start, start, from_id, from_start
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(ids)) - 1]
    return ids[at], start[at], last, from_id[at], from_start[at]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """``id``, ``start``, ``end`` (words), ``from_id``, ``from_start``: maximal runs of words that stand earlier.

    ``from_*`` tells the earliest place of the passage's first window.
    """
    texts = common.documents(docs, id_col, text_col).filter("id is not null")
    positions = common.stage(texts.mapInArrow(_positions(run, window), "run long, id long, place int"), "positions")
    several = positions.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = several.select("run", F.ceil(F.col("n") / F.lit(hot)).cast("long").alias("parts"))
    item = F.struct("place", "run", "parts")
    wanted = positions.join(several, "run").groupBy("id").agg(F.collect_list(item).alias("places"))  # a document's own places
    whole = texts.groupBy("id").agg(F.max("text").alias("text")) if _repeats(texts) else texts
    suffixes = whole.join(wanted, "id").mapInArrow(_suffixes(run, window), "key long, split boolean, id long, place int, lo int, around array<long>")
    sorted_ = suffixes.repartition(F.col("key")).sortWithinPartitions("key")
    compared = sorted_.mapInArrow(_compare(run, window), "kind byte, id long, start long, last long, from_id long, from_start long")
    compared = common.stage(compared, "windows")
    # windows of runs that were compared in parts: each part's first against the others
    parts = compared.filter("kind = 1").select(F.col("last").alias("window"), "id", "start").distinct()
    first = parts.groupBy("window").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("window", "first")
    later = parts.join(first, "window").filter("first.id <> id or first.start <> start")
    later = common.stage(later.groupBy("id", "start").agg(F.min("first").alias("first")), "later")
    spans = compared.filter("kind = 0").drop("kind").union(later.select("id", "start", "start", "first.id", "first.start"))
    found = _joined(spans, window)
    # a part's first may itself stand earlier in another part
    earlier = later.select(F.col("id").alias("from_id"), F.col("start").alias("from_start"), "first")
    found = found.join(earlier, ["from_id", "from_start"], "left")
    return found.select("id", "start", "end", F.coalesce("first.id", "from_id").alias("from_id"), F.coalesce("first.start", "from_start").alias("from_start"))


def _repeats(texts: DataFrame) -> bool:
    """Whether an id stands on several rows; ids only, aggregated before they move."""
    return not texts.groupBy("id").count().filter("count > 1").isEmpty()


def _joined(spans: DataFrame, window: int) -> DataFrame:
    """Join a document's windows that touch or overlap; a passage's source is that of its first window."""
    place = Window.partitionBy("id").orderBy("start", "last")
    reach = F.max("last").over(place.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", (F.coalesce(F.col("start") > reach + window, F.lit(True))).cast("int"))
    marked = marked.withColumn("passage", F.sum("opens").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    source = F.min(F.struct("start", "from_id", "from_start")).alias("source")
    found = marked.groupBy("id", "passage").agg(F.min("start").alias("start"), (F.max("last") + window).alias("end"), source)
    return found.select("id", "start", "end", F.col("source.from_id").alias("from_id"), F.col("source.from_start").alias("from_start"))


def _cut(id_col: str, text_col: str, length_col: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, left = [], []
            column = batch.column("__passages").to_pylist()
            for row, data, offsets in words.slices(batch.column(text_col)):
                found = words.words(data, offsets)
                for i in range(len(offsets) - 1):
                    text, passages = data[offsets[i] : offsets[i + 1]], column[row + i]
                    if not passages:
                        rest.append(batch.column(text_col)[row + i].as_py())
                        left.append(True)
                        continue
                    first, count = found.first[i], found.first[i + 1] - found.first[i]
                    keep = np.ones(len(text), bool)
                    for p in passages:
                        begin = found.start[first + p["start"]] - offsets[i]
                        finish = found.start[first + p["end"]] - offsets[i] if p["end"] < count else len(text)
                        keep[begin:finish] = False
                    rest.append(text[keep].tobytes().decode("utf-8", "replace"))
                    left.append(bool((~words.WHITE[text[keep]]).any()))
            out = batch.drop_columns(["__passages"])
            out = out.set_column(out.schema.get_field_index(text_col), text_col, pa.array(rest, pa.string()))
            if length_col:
                sizes = [None if t is None else len(t) for t in rest]
                at = out.schema.get_field_index(length_col)
                changed = pa.array([s if p else old for s, p, old in zip(sizes, column, out.column(at).to_pylist(), strict=True)], out.schema.field(at).type)
                out = out.set_column(at, length_col, changed)
            yield out.filter(pa.array(left, pa.bool_()))

    return run


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` without the passages that stand earlier; a document of which nothing is left goes.

    The words of a passage go with the white space after them. ``length_col`` is set to the new number of code points
    where a text was cut. Of rows that repeat an id, those with the greatest text are cut, as that is what was compared.
    """
    common.prepare(docs.sparkSession)
    passages = repeated_passages(docs, id_col, text_col, window)
    lists = passages.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("start", "end")).alias("__passages"))
    on = F.col(f"`{id_col}`") == F.col("__id")
    texts = common.documents(docs, id_col, text_col).filter("id is not null")
    if _repeats(texts):
        lists = lists.join(texts.groupBy(F.col("id").alias("__id")).agg(F.max("text").alias("__text")), "__id")
        on = on & (F.col(f"`{text_col}`") == F.col("__text"))
    rows = docs.join(lists, on, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__passages")
    return rows.mapInArrow(_cut(id_col, text_col, length_col), docs.schema)
