"""Token ids of whole batches by a public tokenizer, and exact length histograms.

The word tokenizer drops white space and never joins characters across it, nor a letter or digit with the ASCII
punctuation after it. So a text's ids are the ids of its parts in order, and each distinct part is given to the
tokenizer once per worker; parts are found and looked up by hash, as arrays. The parts' cache is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

VOCABULARY = "word_bpe_49k.json"
CACHED_PARTS = 1_500_000
ENCODED_AT_ONCE = 20_000

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(0x21, 0x7F) if not _ALNUM[c] and chr(c) not in "<|>"]] = True  # these three spell special tokens


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file lies: a path as it is, or the name of a file of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PartEncoder:
    """Ids of texts through a cache of the ids of their parts."""

    _open: dict[str, PartEncoder] = {}

    @classmethod
    def of(cls, name: str) -> PartEncoder:
        if name not in cls._open:
            cls._open[name] = cls(name)
        return cls._open[name]

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHED_PARTS:
            self.clear()
        ids = [e.ids for at in range(0, len(texts), ENCODED_AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[at : at + ENCODED_AT_ONCE], add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        start = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, np.fromiter((x for part in ids for x in part), np.uint32, int(length.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.length = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.length, at, length)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[words.Words, np.ndarray]:
        """The parts of texts and each part's place in the cache."""
        breaks = np.zeros(len(data), bool)
        if len(data):
            breaks[1:] = _ALNUM[data[:-1]] & _PUNCTUATION[data[1:]]
        found = words.words(data, offsets, breaks)
        keys, first, at = np.unique(found.hashes(), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHED_PARTS:  # learn all of this slice anew
                self.clear()
                new = np.ones(len(keys), bool)
            body = data.tobytes()
            self._learn(keys[new], [body[found.start[i] : found.end[i]].decode("utf-8", "replace") for i in first[new]])
            place = np.searchsorted(self.keys, keys)
        return found, place[at]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        found, place = self.parts(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.length[place], dtype=np.int64)])
        return np.diff(total[found.first])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text's ids."""
        found, place = self.parts(data, offsets)
        length = self.length[place].astype(np.int64)
        after = np.cumsum(length)
        total = np.concatenate([[0], after])
        at = np.arange(total[-1]) + np.repeat(self.start[place] - (after - length), length)
        return self.pool[at], total[found.first]


def _lengths(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartEncoder.of(name)
        for batch in batches:
            for row, data, offsets in words.slices(batch.column("text")):
                n = encoder.lengths(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(n)), pa.array(n, pa.int64())], ["id", "tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id`` and ``tokens`` (number of ids) per row of ``docs``; null and empty texts have none."""
    return common.documents(docs, id_col, text_col).mapInArrow(_lengths(vocabulary), "id long, tokens long")


BAND = 1024


def length_histogram(counts: DataFrame) -> DataFrame:
    """One row per length that occurs, from rows with ``tokens``; every context limit is answered by these rows.

    ``length``, ``docs`` and ``tokens`` of that length; ``docs_le`` / ``tokens_le`` up to it; ``docs_ge`` /
    ``tokens_ge`` from it on (suffix sums); ``truncated_tokens``: all tokens if every document is cut at ``length``;
    ``share_le``: the share of documents up to it, whose inverse is the quantile.

    The histogram is aggregated with map-side combining, so a length that a third of the documents have is one row
    per task. Sums run inside bands of lengths; only the band totals (one row per ``BAND`` lengths) are summed in one
    place. An empty input gives no rows.
    """
    lengths = counts.groupBy(F.col("tokens").alias("length")).agg(F.count(F.lit(1)).alias("docs"))
    lengths = common.stage(lengths.withColumn("tokens", F.col("length") * F.col("docs")), "lengths").withColumn("band", F.floor(F.col("length") / BAND))
    bands = lengths.groupBy("band").agg(F.sum("docs").alias("band_docs"), F.sum("tokens").alias("band_tokens"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select(
        "band",
        *[F.coalesce(F.sum(f"band_{c}").over(before), F.lit(0)).alias(f"{c}_before") for c in ("docs", "tokens")],
        *[F.sum(f"band_{c}").over(everything).alias(f"{c}_all") for c in ("docs", "tokens")],
    )
    upto = Window.partitionBy("band").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lengths.join(bands, "band").select(
        "length", "docs", "tokens", "docs_all", "tokens_all",
        *[(F.col(f"{c}_before") + F.sum(c).over(upto)).alias(f"{c}_le") for c in ("docs", "tokens")],
    )
    return rows.select(
        "length",
        "docs",
        "tokens",
        "docs_le",
        "tokens_le",
        (F.col("docs_all") - F.col("docs_le") + F.col("docs")).alias("docs_ge"),
        (F.col("tokens_all") - F.col("tokens_le") + F.col("tokens")).alias("tokens_ge"),
        (F.col("tokens_le") + F.col("length") * (F.col("docs_all") - F.col("docs_le"))).alias("truncated_tokens"),
        (F.col("docs_le") / F.col("docs_all")).alias("share_le"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens that fit whole, and all tokens after cutting at the limit."""
    spark = histogram.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context long"))
    fits, rest = F.col("length") <= F.col("context"), F.col("length") > F.col("context")
    none = F.lit(0)
    return (
        histogram.select("length", "docs", "tokens")
        .join(asked, F.lit(True))
        .groupBy("context")
        .agg(
            F.sum(F.when(fits, F.col("docs")).otherwise(none)).alias("docs_fit"),
            F.sum(F.when(fits, F.col("tokens")).otherwise(none)).alias("tokens_fit"),
            F.sum(F.when(rest, F.col("docs") * F.col("context")).otherwise(F.col("tokens"))).alias("truncated_tokens"),
        )
    )


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the least length that at least this share of the documents does not exceed."""
    asked = F.broadcast(histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return histogram.select("length", "share_le").join(asked, F.col("share_le") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
