"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary is a merge (BPE) model with byte fallback. Its pieces never span from a character to a following
space, so a text falls into chunks (a run of spaces and what follows); each distinct chunk of a worker is encoded once.

A batch's new chunks are concatenated and indexed by a suffix array. Every piece is searched in it by bisection, eight
bytes at a time, which gives the range of its occurrences; the occurrences of all pieces are the edges of a lattice.
Edges are sorted by where they end and relaxed in that order. The model is not additive: a piece may follow another
only if the model would not merge across them, and then exactly one edge into each place can be kept, whose path is
the model's own encoding of everything before. Two pieces fit if merging their joint characters gives them back; that
is worked out once per pair. Characters without a piece become their bytes.

Ids equal those of the library. Decoding concatenates the pieces and drops the space put before a text, so the round
trip gives back the text, except that U+2581 (the model's own sign for a space) comes back as a space. Null and empty
texts have no ids, and no ids decode to the empty text; null ids stay null; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from . import common, words
from .tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
CACHED_CHUNKS = 1_500_000
CACHED_PAIRS = 2_000_000
SPACE = "▁"
LEVEL = 8  # bytes compared at a time


class PieceModel:
    _open: dict[str, PieceModel] = {}

    @classmethod
    def of(cls, name: str) -> PieceModel:
        if name not in cls._open:
            cls._open[name] = cls(name)
        return cls._open[name]

    def __init__(self, name: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        self.size = model.get_piece_size()
        self.unknown = self.size  # a character without a piece, while relaxing
        self.text: list[bytes] = [b""] * self.size  # with spaces as spaces
        self.byte_id = np.zeros(256, np.uint32)
        self.by_text: dict[str, int] = {}
        self.score = np.zeros(self.size)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            self.score[i] = model.get_score(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.text[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(SPACE, " ")
                self.by_text[piece], self.text[i] = i, piece.encode()
        self.single = {p for p in self.by_text if len(p) == 1}
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        # a piece that merging does not build can never be an id
        built = [(p.encode(), i) for p, i in self.by_text.items() if self.merge(p) == [i]]
        built.sort()
        self.piece_id = np.array([i for _, i in built], np.int64)
        self.piece_length = np.array([len(p) for p, _ in built], np.int64)
        width = -(-int(self.piece_length.max()) // LEVEL) * LEVEL
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p, _ in built), np.uint8).reshape(len(built), -1)
        self.piece_low = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)  # pieces x levels
        filled = np.where(np.arange(width) < self.piece_length[:, None], padded, 255).astype(np.uint8)
        self.piece_high = filled.view(">u8").astype(np.uint64)
        self.pool_text = np.frombuffer(b"".join(self.text), np.uint8)
        self.text_length = np.array([len(t) for t in self.text], np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length
        self.clear()

    def clear(self) -> None:
        self.keys, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def merge(self, text: str) -> list[int]:
        """Merge neighbours of the best score, leftmost first, until none is a piece; -1 for an unknown character."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                piece = self.by_text.get(parts[i] + parts[i + 1])
                if piece is not None and self.score[piece] > best:
                    best, at = self.score[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.by_text.get(p, -1) for p in parts]

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether piece ``right`` may follow piece ``left``."""
        key = left.astype(np.int64) * (self.size + 1) + right
        asked, at = np.unique(key, return_inverse=True)
        place = np.minimum(np.searchsorted(self.pair_keys, asked), max(len(self.pair_keys) - 1, 0))
        new = self.pair_keys[place] != asked if len(self.pair_keys) else np.ones(len(asked), bool)
        if new.any():
            fresh = asked[new]
            found = []
            for k in fresh.tolist():
                a, b = divmod(k, self.size + 1)
                found.append(a == self.unknown or b == self.unknown or self.merge((self.text[a] + self.text[b]).decode()) == [a, b])
            if len(self.pair_keys) + len(fresh) > CACHED_PAIRS:
                keep = np.searchsorted(self.pair_keys, asked[~new])
                self.pair_keys, self.pair_ok = self.pair_keys[keep], self.pair_ok[keep]
            where = np.searchsorted(self.pair_keys, fresh)
            self.pair_keys, self.pair_ok = np.insert(self.pair_keys, where, fresh), np.insert(self.pair_ok, where, found)
            place = np.searchsorted(self.pair_keys, asked)
        return self.pair_ok[place][at]

    # --- matching -------------------------------------------------------------------------------------------------

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece row) of every occurrence of a piece; ``stop`` is the end of each byte's chunk."""
        n = len(data)
        levels = self.piece_low.shape[1]
        key = np.zeros(n + levels * LEVEL, np.uint64)  # the next eight bytes, zeros after the chunk
        at = np.arange(n)
        for j in range(LEVEL):
            inside = at + j < stop
            part = np.zeros(n, np.uint64)
            part[inside] = data[at[inside] + j]
            key[:n] |= part << np.uint64(8 * (LEVEL - 1 - j))
        left = stop - at  # bytes to the chunk's end

        def level(rows: np.ndarray, k: int) -> np.ndarray:
            return np.where(left[rows] > k * LEVEL, key[rows + k * LEVEL], np.uint64(0))

        deep = min(levels, -(-int(left.max()) // LEVEL)) if n else 1
        suffixes = np.lexsort([level(at, k) for k in range(deep - 1, -1, -1)])
        first = key[suffixes]
        low, high = np.zeros(len(self.piece_id), np.int64), np.full(len(self.piece_id), n, np.int64)
        for k in range(levels):
            live = np.flatnonzero((self.piece_length > k * LEVEL) & (low < high))
            if not len(live):
                break
            if k == 0:
                low[live] = np.searchsorted(first, self.piece_low[live, 0], "left")
                high[live] = np.searchsorted(first, self.piece_high[live, 0], "right")
            else:
                low[live], high[live] = self._bisect(suffixes, level, k, live, low[live], high[live])
        count = high - low
        total = np.concatenate([[0], np.cumsum(count)])
        piece = np.repeat(np.arange(len(count)), count)
        where = suffixes[np.arange(total[-1]) - np.repeat(total[:-1] - low, count)]
        return where, piece

    def _bisect(self, suffixes: np.ndarray, level, k: int, live: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Narrow the ranges of pieces, whose suffixes agree on the first ``k`` levels, by the next level."""
        out = []
        for bound, after in ((self.piece_low[live, k], False), (self.piece_high[live, k], True)):
            lo, hi = low.copy(), high.copy()
            while (lo < hi).any():
                open_ = lo < hi
                mid = (lo + hi) // 2
                value = level(suffixes[np.minimum(mid, len(suffixes) - 1)], k)
                right = open_ & (value <= bound if after else value < bound)
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            out.append(lo)
        return out[0], out[1]

    # --- relaxing -------------------------------------------------------------------------------------------------

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and the number of each."""
        data = np.frombuffer(b"".join(chunks), np.uint8)
        size = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(size) - size
        chunk = np.repeat(np.arange(len(chunks)), size)
        stop = (begin + size)[chunk]
        where, piece = self.edges(data, stop)
        end, token = where + self.piece_length[piece], self.piece_id[piece]
        # characters without a piece of their own
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        after = np.append(lead[1:], len(data))
        lone = np.zeros(len(data), bool)
        lone[lead] = True
        whole = np.flatnonzero(lone[where] & (np.minimum(after, stop[lead])[np.cumsum(lone)[where] - 1] == end))
        lone[where[whole]] = False
        odd = np.flatnonzero(lone)
        where = np.concatenate([where, odd])
        end = np.concatenate([end, np.minimum(after, stop[lead])[np.cumsum((data & 0xC0) != 0x80)[odd] - 1]])
        token = np.concatenate([token, np.full(len(odd), self.unknown)])

        into = end - begin[chunk[where]]  # relax by the place inside the chunk, all chunks at once
        order = np.argsort(into, kind="stable")
        where, end, token, into = where[order], end[order], token[order], into[order]
        cuts = np.flatnonzero(np.append(True, into[1:] != into[:-1])) if len(into) else np.zeros(0, np.int64)
        last = np.full(len(data) + 1, -1, np.int64)  # by end; a chunk's start is told by `begin`
        back = np.zeros(len(data) + 1, np.int64)
        for i, cut in enumerate(cuts):
            rows = slice(cut, cuts[i + 1] if i + 1 < len(cuts) else len(into))
            w, e, t = where[rows], end[rows], token[rows]
            opening = w == begin[chunk[w]]
            before = np.where(opening, -1, last[w])
            ok = opening.copy()
            asked = np.flatnonzero(~opening & (before >= 0))
            if len(asked):
                ok[asked] = self.fit(before[asked], t[asked])
            last[e[ok]], back[e[ok]] = t[ok], w[ok]
        # walk back from the ends, all chunks at once
        found, of = [], []
        place, alive = begin + size, np.arange(len(chunks))
        while len(alive):
            if (last[place] < 0).any():
                raise AssertionError("a chunk has no encoding")
            found.append((last[place], back[place], place))
            of.append(alive)
            place = back[place]
            more = place > begin[alive]
            alive, place = alive[more], place[more]
        token = np.concatenate([f[0] for f in found][::-1])
        from_, to = np.concatenate([f[1] for f in found][::-1]), np.concatenate([f[2] for f in found][::-1])
        of_chunk = np.concatenate(of[::-1])
        order = np.argsort(of_chunk, kind="stable")
        token, from_, to, of_chunk = token[order], from_[order], to[order], of_chunk[order]
        spread = np.where(token == self.unknown, to - from_, 1)  # a byte id for each byte
        ids = np.repeat(token, spread)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(from_, spread)
        bytes_ = ids == self.unknown
        ids[bytes_] = self.byte_id[data[at[bytes_]]]
        return ids.astype(np.uint32), np.bincount(of_chunk, weights=spread, minlength=len(chunks)).astype(np.int64)

    # --- texts ----------------------------------------------------------------------------------------------------

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text's ids."""
        texts = len(offsets) - 1
        some = np.flatnonzero(np.diff(offsets) > 0)
        # the model's sign for a space is a space; one goes before every text that is not empty
        data = np.insert(data, offsets[some], ord(" "))
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(sign):
            data = data.copy()
            data[sign] = ord(" ")
            gone = np.concatenate([sign + 1, sign + 2])
            offsets = offsets - np.searchsorted(np.sort(gone), offsets)
            data = np.delete(data, gone)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        space, line = data == ord(" "), data == ord("\n")
        cut = np.zeros(len(data), bool)
        cut[0] = True
        cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        keys = _hashes(data, start, end)
        asked, first, at = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, asked), max(len(self.keys) - 1, 0))
        new = self.keys[place] != asked if len(self.keys) else np.ones(len(asked), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > CACHED_CHUNKS:
                self.clear()
                new = np.ones(len(asked), bool)
            body = data.tobytes()
            ids, length = self.encode_chunks([body[start[i] : end[i]] for i in first[new]])
            begin = len(self.pool) + np.cumsum(length) - length
            self.pool = np.concatenate([self.pool, ids])
            where = np.searchsorted(self.keys, asked[new])
            self.keys, self.start, self.length = np.insert(self.keys, where, asked[new]), np.insert(self.start, where, begin), np.insert(self.length, where, length)
            place = np.searchsorted(self.keys, asked)
        place = place[at]
        length = self.length[place]
        after = np.cumsum(length)
        total = np.concatenate([[0], after])
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.start[place] - (after - length), length)]
        return ids, total[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        length = self.text_length[ids]
        after = np.cumsum(length)
        total = np.concatenate([[0], after])
        body = self.pool_text[np.arange(total[-1]) + np.repeat(self.text_start[ids] - (after - length), length)].tobytes()
        out = [body[total[offsets[i]] : total[offsets[i + 1]]] for i in range(len(offsets) - 1)]
        return [t[1:] if t.startswith(b" ") else t for t in out]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    place = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
    value = words.byte_values()[data] * words.powers(int(length.max()))[place]
    return words.mix(np.add.reduceat(value, start) + length.astype(np.uint64) * words.powers(2)[1])


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(name)
        for batch in batches:
            for row, data, offsets in words.slices(batch.column("text")):
                ids, first = model.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[first[i] : first[i + 1]]) for i in range(len(lists))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(lists)), lists, pa.array(crc, pa.int64())], ["id", "ids", "ids_crc32"])

    return run


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(name)
        for batch in batches:
            column = batch.column("ids")
            offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = model.decode(column.flatten().to_numpy(zero_copy_only=False), offsets)
            texts = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), texts], [*batch.schema.names, "text"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``id``, ``ids`` and ``ids_crc32`` (of the ids as unsigned little-endian 32-bit numbers) per row of ``docs``."""
    return common.documents(docs, id_col, text_col).mapInArrow(_encode(model), "id long, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``encoded`` (``ids`` and any other columns) with ``text``; a column of that name is replaced."""
    common.prepare(encoded.sparkSession)
    rows = encoded.drop("text")
    schema = StructType([*rows.schema.fields, StructField("text", StringType())])
    return rows.mapInArrow(_decode(model), schema)
