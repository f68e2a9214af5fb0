"""Periodic runs: stretches of words that repeat a block of ``q`` words, found in tiles per octave of periods.

A run is a maximal stretch whose smallest period is ``q`` and which is at least ``exponent * q`` words long (and at
least ``least``). Word ``i`` *matches* under ``q`` if it equals word ``i + q``; a run is an unbroken row of matches.

1. *Tiles.* For the octave of periods ``step <= q < 2 * step``, boundaries lie ``step`` words apart. A run of the octave
   has at least ``3 * step`` matches, so at some boundary ``c`` the block of ``2 * step`` words at ``c`` equals the one
   at ``c + q``. Block hashes, doubled from octave to octave, tell the boundaries where that may hold; all periods of
   an octave are one comparison of two arrays. Their surroundings are exploded as overlapping tiles.
2. *Boundary Z-functions.* Each tile is solved by itself: the Z-function forward from a boundary gives, for all periods
   of the octave at once, how far matches go on and whether the block is a power of a shorter one (then the period
   is not the smallest); the Z-function of the reversed surroundings tells how far they go back. Words are compared
   here, not hashes.
3. *Stitching.* Tiles give intervals of matches, clipped to the tile. They are shuffled by document and period, and
   those that overlap become one.

Tiles, not documents, are the unit of work after the first pass, so a document of a million words is solved by many
tasks. Only texts of documents with tiles are shuffled, to cut out what their runs repeat.

Words are maximal rows of characters outside ``[\\x20\\x09-\\x0D]``. Null and empty texts have no words and no runs. Ids
may be null or repeat, every row is answered; further columns are ignored. An empty table gives an empty result. A
text of one word throughout is one run of period 1; longer periods of it are powers and go unreported.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

EXPONENT, LEAST = 4, 6
TILE_WORDS = 4096
TASK_WORDS = 1 << 21  # of tiles, solved by one task
EMIT_IDS = 1 << 20
RUNS = "array<struct<start:long,period:long,length:long>>"
FOUND = "key long, id long, n_words long, plain_sha256 string, text binary, octave int, first long, centre long, centres int, ids array<int>"


def candidate_centres(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries whose block of twice the step equals one a period of the octave further on)."""
    block = words.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    octave = 0
    while 4 << octave <= longest:
        step = 1 << octave
        block = words.mix(block[:-step] * np.uint64(0xD6E8FEB86659FD93) + block[step:])
        later = block[step:]
        same = np.flatnonzero(later == np.repeat(block[::step], step)[: len(later)])
        if len(same):
            yield octave, np.unique(same // step) * step
        octave += 1


def tiles(centres: np.ndarray, octave: int) -> Iterator[tuple[int, int]]:
    """(first boundary, number of boundaries) of rows of neighbouring boundaries, cut to a tile's size."""
    step, most = 1 << octave, max(8, TILE_WORDS >> octave)
    breaks = np.flatnonzero(np.diff(centres) != step) + 1
    for start, end in zip(np.append(0, breaks), np.append(breaks, len(centres)), strict=True):
        for at in range(start, end, most):
            yield int(centres[at]), min(most, end - at)


def _explode(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            names = batch.column("id")
            for row, data, offsets in words.slices(batch.column("text")):
                texts = [data[a:b].tobytes().split() for a, b in itertools.pairwise(offsets)]
                sizes = np.array([len(t) for t in texts])
                number: defaultdict[bytes, int] = defaultdict(itertools.count(len(texts)).__next__)
                first = np.concatenate([[0], np.cumsum(sizes + 1)])
                ids = np.empty(first[-1], np.int32)
                for i, text in enumerate(texts):
                    ids[first[i] : first[i + 1] - 1] = np.fromiter(map(number.__getitem__, text), np.int32, len(text))
                ids[first[1:] - 1] = np.arange(len(texts))  # no word: differs from everything
                keys = key + np.arange(len(texts))
                key += len(texts)
                held: list[tuple] = []
                total, suspects = 0, set()
                for octave, centres in candidate_centres(ids, int(sizes.max())):
                    step = 1 << octave
                    for centre, count in tiles(centres, octave):
                        text = int(np.searchsorted(first, centre, "right")) - 1
                        low, high = max(first[text], centre - step), min(first[text + 1] - 1, centre + (count + 4) * step)
                        suspects.add(text)
                        held.append((keys[text], octave, low - first[text], centre - first[text], count, ids[low:high]))
                        total += high - low
                        if total > EMIT_IDS:
                            yield _tile_rows(held)
                            held, total = [], 0
                if held:
                    yield _tile_rows(held)
                plain = [b" ".join(t) for t in texts]
                shown = [t if with_text or i in suspects else None for i, t in enumerate(plain)]
                columns = [pa.array(keys), names.slice(row, len(texts)), pa.array(sizes.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in plain]), pa.array(shown, pa.binary())]
                yield _padded(columns, len(texts))

    return run


_EMPTY = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _padded(columns: list[pa.Array], rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(rows, t) for t in _EMPTY[len(columns) :])], _NAMES)


def _tile_rows(held: list[tuple]) -> pa.RecordBatch:
    keys, octaves, firsts, centres, counts, slices = zip(*held, strict=True)
    index = np.concatenate([[0], np.cumsum([len(s) for s in slices])])
    ids = pa.ListArray.from_arrays(pa.array(index, pa.int32()), pa.array(np.concatenate(slices), pa.int32()))
    given = [pa.array(keys, pa.int64()), pa.array(octaves, pa.int32()), *(pa.array(c, pa.int64()) for c in (firsts, centres)), pa.array(counts, pa.int32()), ids]
    return pa.RecordBatch.from_arrays([given[0], *(pa.nulls(len(held), t) for t in _EMPTY[1:5]), *given[1:]], _NAMES)


def z_function(s: list[int], upto: int) -> list[int]:
    """The length of the longest common prefix of ``s`` and ``s[i:]``, for every ``i`` below ``upto``."""
    n, upto = len(s), min(upto, len(s))
    z = [0] * upto
    if upto:
        z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


_factors: list[int] = [0, 1]


def prime_factors(q: int) -> Iterator[int]:
    """The distinct prime factors of ``q``."""
    global _factors
    if q >= len(_factors):
        size = 2 * q
        least = np.arange(size)
        for p in range(2, int(size**0.5) + 1):
            if least[p] == p:
                part = least[p * p :: p]
                part[part == np.arange(p * p, size, p)] = p
        _factors = least.tolist()
    while q > 1:
        p = _factors[q]
        yield p
        while q % p == 0:
            q //= p


def solve(ids: list[int], octave: int, first: int, centre: int, centres: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the matches around the boundaries of one tile, clipped to it."""
    step = 1 << octave
    open_: dict[int, list[int]] = {}
    done = []
    for c in range(centre, centre + centres * step, step):
        at = c - first
        ahead = z_function(ids[at : at + 5 * step], 2 * step)
        back = None
        for q in range(step, len(ahead)):
            if ahead[q] < 2 * step:
                continue
            if any(ahead[q // p] >= q - q // p for p in prime_factors(q)):
                continue  # the block is a power: its period is shorter
            end = c + min(ahead[q], 3 * step)
            known = open_.get(q)
            if known and known[1] >= c:
                known[1] = end
                continue
            if back is None:
                reach = min(step, at)
                back = z_function(ids[at - reach : at][::-1] + [-1] + ids[at - reach : at + 2 * step][::-1], reach + 1 + step + 1)
            if known:
                done.append((q, *known))
            open_[q] = [c - min(back[reach + 1 + 2 * step - q], reach), end]
    return done + [(q, *known) for q, known in open_.items()]


def _solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        get = [batch.column(c) for c in ("key", "octave", "first", "centre", "centres")]
        slices = batch.column("ids")
        for i in range(batch.num_rows):
            key, *where = (c[i].as_py() for c in get)
            out += [(key, *found) for found in solve(slices[i].values.to_pylist(), *where)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "period", "start", "end"])


def stitch(pieces: DataFrame) -> DataFrame:
    """Intervals ``start`` to ``end`` per (key, period), those that overlap or touch united."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("start") > before)).cast("int")
    numbered = pieces.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _collapse(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, texts, runs = batch.column("plain_sha256").to_pylist(), batch.column("text"), batch.column("runs")
            shown = []
            for i in np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)):
                text = np.array(texts[i].as_py().split(), object)
                keep = np.ones(len(text), bool)
                for r in runs[i].as_py():
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                left = b" ".join(text[keep])
                shas[i] = hashlib.sha256(left).hexdigest()
                shown.append((i, left))
            columns = [batch.column("id"), batch.column("n_words"), runs, pa.array(shas, pa.string())]
            if with_text:
                given = texts.to_pylist()
                for i, left in shown:
                    given[i] = left
                columns.append(pa.array(given, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed_sha256", "collapsed"][: len(columns)])

    return run


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST, with_text: bool = False) -> DataFrame:
    """Per row: ``id``, ``n_words``, ``runs`` (start, period, length; by start, then period) and ``collapsed_sha256``.

    A word is dropped if any run holds it after that run's first period; the others, joined by one space, are the
    collapsed text (``collapsed`` with ``with_text``). ``exponent`` is at least 4, which the tiles rely on.
    """
    if exponent < 4:
        raise ValueError("runs of fewer than four periods need denser boundaries")
    found = common.stage(common.documents(docs, id_col, text_col).mapInArrow(_explode(with_text), FOUND), "run-tiles")
    cut = found.filter("octave IS NOT NULL").select("key", "octave", "first", "centre", "centres", "ids")
    total = cut.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_WORDS)  # stated, since tiles are few bytes but much work
    cut = cut.repartition(tasks, "key", "octave", "first")
    pieces = common.stage(cut.mapInArrow(_solve_all, "key long, period long, start long, end long"), "run-pieces")
    length = F.col("end") - F.col("start") + F.col("period")
    runs = stitch(pieces).select("key", "start", "period", length.alias("length")).filter(F.col("length") >= F.greatest(F.lit(least), F.col("period") * exponent))
    lists = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    whole = found.filter("octave IS NULL").select("key", "id", "n_words", "plain_sha256", "text")
    out = whole.join(lists, "key", "left").select("id", "n_words", "plain_sha256", "text", "runs")
    schema = f"id long, n_words long, runs {RUNS}, collapsed_sha256 string" + (", collapsed binary" if with_text else "")
    out = out.mapInArrow(_collapse(with_text), schema).withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    return out.withColumn("collapsed", F.col("collapsed").cast("string")) if with_text else out


def longest_run(runs: Column) -> Column:
    """The run of the greatest length (of several the first, then the smallest period); null where there is none."""
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,period:long,length:long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))


def run_lines(runs: Column) -> Column:
    """``start,length,period`` of every run, each with a line feed."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.when(F.size(runs) > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
