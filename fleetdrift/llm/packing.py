"""Hierarchical packing: documents into windows of several lengths, long windows' gaps filled from shorter tiers.

A document is its ids and an end id. Whole windows are cut off first. What remains is routed to the smallest tier
(power of two) that holds it; the longest remainder opens a window of its tier, whose gap is filled with the longest
shorter remainders that fit, and then with a cut of the shortest one. So every window is exactly full. Only the last
window of a partition can run out of pieces; it is cut into windows of powers of two, which need no padding either.

Packing is local to a partition of the input and needs no shuffle. Of a slice only the open window is
carried on, so memory follows neither partitions nor documents. Windows of one tier are dealt into step groups of
equally many tokens, heaviest attention cost (sum of squared piece lengths) first and back and forth.

Null text is empty: such a document is its end id alone. Ids may be null or repeat; each row is packed. Columns that
are not asked for are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens, words

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
END_ID = 1
PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple  # (id, doc_tokens, start, ids)


class Packer:
    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.window, self.step_tokens = sorted(tiers), max(tiers), step_tokens
        self.sequences = self.groups = partition << 32
        self.open: list[Piece] = []

    def pack(self, pieces: list[Piece], last: bool = False) -> list[tuple[int, list[Piece]]]:
        """Full windows (tier, pieces) of these and the carried pieces."""
        done = []
        pool: list[tuple[int, int, Piece]] = []
        count = 0
        for piece in [*self.open, *pieces]:
            doc, n, start, ids = piece
            while len(ids) >= self.window:
                done.append((self.window, [(doc, n, start, ids[: self.window])]))
                start, ids = start + self.window, ids[self.window :]
            if len(ids):
                pool.append((len(ids), count, (doc, n, start, ids)))
                count += 1
        pool.sort(key=lambda x: x[:2])
        sizes = [x[0] for x in pool]
        self.open = []
        while pool:
            size = sizes.pop()
            window = [pool.pop()[2]]
            tier = self.tiers[bisect.bisect_left(self.tiers, size)]
            gap = tier - size
            while gap and pool:
                at = max(bisect.bisect_right(sizes, gap) - 1, 0)
                size, number, piece = pool.pop(at)
                sizes.pop(at)
                if size > gap:  # nothing fits whole
                    doc, n, start, ids = piece
                    piece, rest = (doc, n, start, ids[:gap]), (size - gap, number, (doc, n, start + gap, ids[gap:]))
                    back = bisect.bisect_left(sizes, size - gap)
                    pool.insert(back, rest)
                    sizes.insert(back, size - gap)
                    size = gap
                window.append(piece)
                gap -= size
            if gap:
                self.open = window
            else:
                done.append((tier, window))
        if last:
            done += self.powers_of_two(self.open)
            self.open = []
        return done

    @staticmethod
    def powers_of_two(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
        done, pieces = [], list(pieces)
        total = sum(len(p[3]) for p in pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            window, room = [], size
            while room:
                doc, n, start, ids = pieces.pop(0)
                window.append((doc, n, start, ids[:room]))
                if len(ids) > room:
                    pieces.insert(0, (doc, n, start + room, ids[room:]))
                room -= min(room, len(ids))
            done.append((size, window))
            total -= size
        return done

    def rows(self, windows: list[tuple[int, list[Piece]]], with_ids: bool) -> pa.RecordBatch:
        group = self.step_groups(windows)
        out: list[tuple] = []
        parts = []
        for (tier, window), step in zip(windows, group, strict=True):
            offset = 0
            for doc, n, start, ids in window:
                out.append((doc, start, len(ids), zlib.crc32(ids), n, self.sequences, offset, tier, step))
                parts.append(ids)
                offset += len(ids)
            self.sequences += 1
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(9)]
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        if with_ids:
            flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            arrays.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def step_groups(self, windows: list[tuple[int, list[Piece]]]) -> list[int]:
        group = [0] * len(windows)
        by_tier: dict[int, list[int]] = {}
        for i, (tier, _) in enumerate(windows):
            by_tier.setdefault(tier, []).append(i)
        for tier, members in sorted(by_tier.items()):
            steps = max(1, round(len(members) * tier / self.step_tokens))
            members.sort(key=lambda i: -sum(len(p[3]) ** 2 for p in windows[i][1]))
            for rank, i in enumerate(members):
                lap, place = divmod(rank, steps)
                group[i] = self.groups + (place if lap % 2 == 0 else steps - 1 - place)
            self.groups += steps
        return group


def _pack(vocabulary: str, tiers: tuple[int, ...], step_tokens: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.PartEncoder.of(vocabulary)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for batch in batches:
            names = batch.column("id").to_pylist()
            for row, data, offsets in words.slices(batch.column("text")):
                ids, first = encoder.encode(data, offsets)
                texts = len(first) - 1
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                first = first + np.arange(texts + 1)
                pieces = [(names[row + i], int(first[i + 1] - first[i]), 0, ids[first[i] : first[i + 1]]) for i in range(texts)]
                yield packer.rows(packer.pack(pieces), with_ids)
        yield packer.rows(packer.pack([], last=True), with_ids)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = tokens.VOCABULARY,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence; ``with_ids`` adds the ids."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    texts = common.documents(docs, id_col, text_col)
    return texts.mapInArrow(_pack(vocabulary, tuple(tiers), step_tokens, end_id, with_ids), PIECE + (", ids array<int>" if with_ids else ""))
