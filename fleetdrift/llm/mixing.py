"""Mixing sources to target weights: blocks of words, multinomial counts per output shard, pseudorandom permutations.

1. *Targets.* The words of all sources are shared out by weight; a source takes at most ``repeats`` times its own words,
   and what lies above is shared out again among the others. Each target is a whole number of words in the end.
2. *Blocks.* The documents of a source, in an order that their hashes fix, are one stream of words, cut into blocks of
   ``block`` words; the last block of a source may be shorter. A document's place in the stream is the sum of what
   lies before it: sums per chunk of documents first, then within the chunk, so that no source is one task's work.
3. *Counts.* An output shard draws how many slots each source gets from a multinomial whose probabilities are what is
   left of the sources' slots. A draw never exceeds what is left, and the last shard takes the rest: totals are met.
4. *Slots.* Slot ``j`` of a source of ``b`` blocks holds block ``p(j mod b)``, where ``p`` is a Feistel permutation keyed
   by the source and the round ``j div b``; so every block is taken once before any is taken again, and none more
   than ``repeats`` times. The last slot of a source is cut where its target is reached. A permutation of the shard's
   places interleaves the sources.
5. *Join.* Slots meet blocks by source and block index. No text is moved.

One row per source and one number per source and shard reach the driver; shards are a parameter. A shard's slots are
exploded in runs of bounded length.

Words are maximal rows of characters outside ``[\\x20\\x09-\\x0D]``. Null and empty texts have no words and are taken
zero times. A null source is a source of its own, the last; a source without words has target 0. Ids may be null or
repeat; rows alike in id and text share their source's stream like any others. A very long text lies in many blocks.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

BLOCK, SHARDS, REPEATS, SEED = 256, 64, 3, 11
WEIGHTS = (5, 2, 1)
CHUNK_ROWS = 20_000
RUN = 4096
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def share_out(sizes: Sequence[int], weights: Sequence[int], repeats: int = REPEATS) -> list[Fraction]:
    """All words shared by weight; none above ``repeats`` times its size, the excess shared again by weight."""
    target = [Fraction(0)] * len(sizes)
    open_, left = list(range(len(sizes))), Fraction(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > repeats * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = Fraction(repeats * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if unit * weights[i] <= repeats * sizes[i]]
    return target


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of ``0 .. size - 1`` per key: Feistel rounds on the next even number of bits, walked until within."""
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1) / 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    limit, key = size.astype(np.uint64), words.mix(key.astype(np.uint64))
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for turn in range(6):
            left, right = right, left ^ (words.mix(right + k * np.uint64(2 * turn + 3)) & m)
        out[todo] = left << b | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source of the mix: its words, its share, its blocks and the slots that reach its share."""

    name: str | None
    size: int
    target: Fraction
    words: int  # the target as a whole number
    blocks: int
    slots: int
    last_words: int  # of the last slot


def source_key(number: int, turn: int, seed: int) -> int:
    return int(words.mix(np.array([seed * 1_000_003 + number], np.uint64))[0] ^ np.uint64(turn))


def place_of(value: int, size: int, key: int) -> int:
    """The index that ``permute`` sends to ``value``: the rounds backwards, walked until within."""
    bits = int(np.ceil(np.log2(float(max(size, 2)) + 1) / 2))
    mask, mixed = (1 << bits) - 1, words.mix(np.array([key], np.uint64))
    while True:
        left, right = value >> bits, value & mask
        for turn in reversed(range(6)):
            left, right = right ^ (int(words.mix(np.array([left], np.uint64) + mixed * np.uint64(2 * turn + 3))[0]) & mask), left
        value = left << bits | right
        if value < size:
            return value


def plan(number: int, name: str | None, size: int, target: Fraction, block: int, repeats: int, seed: int) -> Source:
    """How many slots hold exactly the target's words, given where the permutation puts the shorter last block."""
    wanted = min(round(target), repeats * size)
    blocks = -(-size // block)
    rounds, rest = divmod(wanted, size) if size else (0, 0)
    if not rest:
        return Source(name, size, target, wanted, blocks, rounds * blocks, block)
    lacking = blocks * block - size
    place = place_of(blocks - 1, blocks, source_key(number, rounds, seed))
    taken = -(-rest // block)  # slots of the last round
    if place < taken and taken * block - lacking < rest:
        taken += 1
    before = (taken - 1) * block - (lacking if place < taken - 1 else 0)
    return Source(name, size, target, wanted, blocks, rounds * blocks + taken, rest - before)


def draw_counts(slots: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """Slots per shard and source: multinomial draws by what is left of each source; shard sizes differ by one at most."""
    left = np.array(slots, np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for k in range(shards):
        room = int(left.sum()) // (shards - k)
        drawn = np.minimum(rng.multinomial(room, left / left.sum()), left) if room else np.zeros_like(left)
        while (lacking := room - int(drawn.sum())) > 0:  # what a draw had too much goes to sources that have some left
            spare = left - drawn
            if lacking == spare.sum():
                drawn = left.copy()
                break
            drawn += np.minimum(rng.multinomial(lacking, spare / spare.sum()), spare)
        out.append(drawn.tolist())
        left = left - drawn
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``size``, ``source`` and ``mark``, a hash that orders documents."""
    rows = common.documents(docs, id_col, text_col, source_col)
    return rows.select(
        "id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64("text", "id").alias("mark")
    )


def sources_of(rows: DataFrame, weights: Sequence[int], block: int, repeats: int, seed: int) -> list[Source]:
    """By code point, null last."""
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda s: (s[0] is None, s[0] or ""))
    sizes = [size for _, size in found]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(found))], repeats)
    return [plan(i, name, size, target, block, repeats, seed) for i, ((name, size), target) in enumerate(zip(found, targets, strict=True))]


def placed(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """``rows`` with ``number`` of the source, its ``source_size`` and ``target``, and ``start``: the words before the document."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(s.name, i, s.size, float(s.target)) for i, s in enumerate(sources)], "name string, number int, source_size long, target double")
    known = F.broadcast(known) if len(sources) <= BROADCAST_SOURCES else known
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    chunks = max(1, rows.count() // CHUNK_ROWS)
    rows = rows.withColumn("chunk", F.pmod("mark", F.lit(chunks)))
    sums = rows.groupBy("number", "chunk").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("number").orderBy("chunk")) - F.col("words")
    sums = sums.select("number", "chunk", before.alias("before"))
    order = Window.partitionBy("number", "chunk").orderBy("mark", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("within", F.sum("size").over(order) - F.col("size"))
    return within.join(sums, ["number", "chunk"]).withColumn("start", F.col("before") + F.col("within")).drop("chunk", "mark", "before", "within")


def block_pieces(documents: DataFrame, block: int) -> DataFrame:
    """``number``, ``block``, ``start`` of the document, ``first`` word of the piece in it, ``at`` in the block, ``length``."""
    last = F.col("start") + F.col("size")
    numbers = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    rows = documents.filter("size > 0").select("number", "id", "start", "size", F.explode(numbers).alias("block"))
    length = F.least(last, (F.col("block") + 1) * block) - low
    return rows.select("number", "block", "id", "start", (low - F.col("start")).alias("first"), (low - F.col("block") * block).alias("at"), length.alias("length"))


SLOT = "shard long, place long, number long, slot long, block long, upto long"


def _permuted(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, slot, blocks, shard, nth, room, upto = (batch.column(i).to_numpy() for i in range(7))
            turn = slot // np.maximum(blocks, 1)
            keys = words.mix(np.uint64(seed * 1_000_003) + number.astype(np.uint64)) ^ turn.astype(np.uint64)
            block = permute(slot - turn * blocks, blocks, keys)
            place = permute(nth, room, np.uint64(seed * 7_000_003 + 1) - shard.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (shard, place, number, slot, block, upto)], SLOT.replace(" long", "").split(", "))

    return run


def slot_table(spark: SparkSession, sources: list[Source], counts: list[list[int]], block: int, seed: int) -> DataFrame:
    """``shard``, ``place``, ``number``, ``slot``, ``block`` and ``upto``, the words that the slot takes of its block."""
    runs = []
    used = [0] * len(sources)
    for shard, drawn in enumerate(counts):
        nth, room = 0, sum(drawn)
        for i, count in enumerate(drawn):
            if count:
                runs.append((i, used[i], count, sources[i].blocks, shard, nth, room, sources[i].slots - 1, sources[i].last_words))
            used[i] += count
            nth += count
    given = spark.createDataFrame(runs, "number int, low long, count long, blocks long, shard int, nth long, room long, end long, last_words long")
    parts = given.withColumn("off", F.explode(F.expr(f"sequence(0L, count - 1, {RUN}L)"))).repartition("number", "shard", "off")
    each = parts.withColumn("step", F.explode(F.expr(f"sequence(off, least(off + {RUN}, count) - 1)")))
    each = each.select("number", (F.col("low") + F.col("step")).alias("slot"), "blocks", "shard", (F.col("nth") + F.col("step")).alias("nth"), "room", "end", "last_words")
    upto = F.when(F.col("slot") == F.col("end"), F.col("last_words")).otherwise(F.lit(block).cast("long"))
    each = each.withColumn("upto", upto).drop("end", "last_words")
    return each.mapInArrow(_permuted(seed), SLOT)


@dataclass
class Mix:
    """``documents``: every row with its source and place; ``spans``: shard, place and the words that the mix takes."""

    sources: list[Source]
    documents: DataFrame
    spans: DataFrame

    def taken(self) -> DataFrame:
        """``id``, ``size``, ``source``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of the document."""
        sums = self.spans.groupBy("number", "start").agg(F.sum("length").alias("taken"))
        filled = self.documents.filter("size > 0").join(sums, ["number", "start"], "left")
        rows = filled.unionByName(self.documents.filter("size = 0"), allowMissingColumns=True)
        return rows.select("id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, repeats: int = REPEATS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Mix the sources of ``docs``; ``weights`` repeat over the sources by code point. Reruns agree.

    ``spans`` has ``shard``, ``place`` (of the slot in its shard, gapless from 0), ``at`` (in the slot), ``number`` (of
    the source), ``id``, ``start`` (words of the source before the document), ``first`` and ``length`` in the document.
    """
    spark = docs.sparkSession
    rows = common.stage(measured(docs, id_col, text_col, source_col), "mix-sizes")
    sources = sources_of(rows, weights, block, repeats, seed)
    documents = common.stage(placed(rows, sources), "mix-documents")
    slots = slot_table(spark, sources, draw_counts([s.slots for s in sources], shards, seed), block, seed)
    spans = slots.join(block_pieces(documents, block), ["number", "block"]).filter("at < upto")
    length = F.least("length", F.col("upto") - F.col("at"))
    return Mix(sources, documents, spans.select("shard", "place", "at", "number", "id", "start", "first", length.alias("length")))


def block_texts(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard``, ``place`` and ``text`` of every slot, words joined by one space. Ids must be distinct and not null."""
    texts = common.documents(docs, id_col, text_col).select("id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    spans = mixed.spans.join(texts, "id").select("shard", "place", "at", F.array_join(F.expr("slice(words, int(first + 1), int(length))"), " ").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("at", "part")))
    return spans.groupBy("shard", "place").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("text"))
