"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features are densities of a lexicon, nearness of second-person words to its hits, capitals, punctuation and rates of
obfuscation (digits and signs for letters, signs inside words, drawn-out letters). The lexicon is learned: words and
word beginnings (4 to 6 bytes) that occur far more often in toxic documents than in others. Words are compared
without case, signs and the usual look-alike digits.

Labels are used only where crc32 of the id, as text, leaves a remainder other than 0 by 5: remainders 1 and 2 give
the lexicon, 3 the trees, 4 the calibration. The fit sees at most ``SAMPLE`` labelled rows, chosen by a hash of the
id, and the lexicon has at most ``LEXICON`` entries; this is all that the driver gathers. Every document is scored
whole, by the text alone.

Null and empty texts are scored like any text, by features that are all zero. An id that is labelled more than once
is toxic if any of its labels is; null labels are ignored. Without labels of both kinds every score is the share of
toxic labels (0 without any). A row with a null id counts as held out. Repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

SAMPLE = 20_000
LEXICON = 4096
LEAST_DOCS = 5
LEAST_ODDS = 6.0
BEGINNINGS = (4, 5, 6)
NEAR = 5
PEAK = 50
SECOND_PERSON = ("you", "your", "yours", "youre", "u", "ur", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "te", "toi", "ton", "vous", "votre", "usted", "tus", "ti", "vosotros")

_LOOK = np.arange(256, dtype=np.uint8)
_LOOK[ord("A") : ord("Z") + 1] += 32
for _sign, _letter in zip("013457@$", "oieastas", strict=True):
    _LOOK[ord(_sign)] = ord(_letter)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SMALL = np.zeros(256, bool)
_SMALL[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(0x21, 0x7F) if not (_CAPITAL[c] or _SMALL[c] or _DIGIT[c])]] = True
_VALUE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FEATURES = (
    "log_words", "hits", "hit_density", "weight_density", "weight_most", "peak", "hits_near_you", "you_density", "capital_share",
    "capital_words", "exclaim_density", "sign_density", "digit_in_word", "sign_in_word", "drawn_out", "obfuscated_hits",
)


@dataclass
class Keys:
    """Per word: hash of its letters and of its beginnings (0 where there are none), and whether it is disguised."""

    found: words.Words
    whole: np.ndarray
    beginnings: list[np.ndarray]
    digit_in: np.ndarray
    sign_in: np.ndarray
    drawn: np.ndarray
    capital: np.ndarray


def keys(data: np.ndarray, offsets: np.ndarray) -> Keys:
    found = words.words(data, offsets)
    n = len(found.start)
    if not n:
        none = np.zeros(0, np.uint64)
        return Keys(found, none, [none] * len(BEGINNINGS), *[np.zeros(0, bool)] * 4)
    look = _LOOK[data]
    accented = np.zeros(len(data), bool)  # capitals of the Latin-1 block, two bytes
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    look[accented] += 0x20
    drawn = np.zeros(len(data), bool)
    drawn[2:] = (look[2:] == look[1:-1]) & (look[2:] == look[:-2]) & _LETTER[look[2:]] & (look[2:] < 0x80)
    of = np.zeros(len(data), np.int32)
    of[found.start] = 1
    of = np.cumsum(of, dtype=np.int32) - 1
    kept = np.flatnonzero(_LETTER[look] & ~drawn)
    word = of[kept]
    count = np.bincount(word, minlength=n)
    before = np.cumsum(count) - count
    place = np.arange(len(kept)) - before[word]
    value = _VALUE[look[kept]] * words.powers(int(count.max()) + 1)[place]
    some = np.flatnonzero(count > 0)

    def total(x: np.ndarray, salt: int, least: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if len(some):
            out[some] = words.mix(np.add.reduceat(x, before[some]) + np.full(1, salt, np.uint64))
        out[count < least] = 0
        return out

    whole = total(value, 1, 1)
    beginnings = [total(np.where(place < k, value, np.uint64(0)), k, k + 1) for k in BEGINNINGS]

    def has(mask: np.ndarray) -> np.ndarray:
        solid = mask & ~words.WHITE[data]
        return np.bincount(of[solid], minlength=n) > 0 if solid.any() else np.zeros(n, bool)

    letters = has(_CAPITAL[data] | _SMALL[data] | (data >= 0x80))
    inner = np.zeros(len(data), bool)  # between two letters
    inner[1:-1] = _LETTER[look[:-2]] & _LETTER[look[2:]]
    capital = has(_CAPITAL[data]) & ~has(_SMALL[data]) & (found.end - found.start > 1)
    return Keys(found, whole, beginnings, has(_DIGIT[data]) & letters, has(_SIGN[data] & inner & (data != ord("'")) & (data != ord("-"))), has(drawn), capital)


def _word_key(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(keys(raw, np.array([0, len(raw)])).whole[0])


@dataclass
class Lexicon:
    entry: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, key: np.ndarray) -> np.ndarray:
        if not len(self.entry):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        return np.where(self.entry[at] == key, self.weight[at], 0.0)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    k = keys(data, offsets)
    texts = len(offsets) - 1
    per_text, text = k.found.per_text(), k.found.text_of()
    weight = lexicon.of(k.whole)
    for b in k.beginnings:
        weight = np.maximum(weight, lexicon.of(b))
    hit = weight > 0
    you = np.isin(k.whole, second)
    first = k.found.first

    def add(x: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=x, minlength=texts)

    def around(x: np.ndarray, back: int, ahead: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        at = np.arange(len(x))
        return total[np.minimum(at + ahead + 1, first[text + 1])] - total[np.maximum(at - back, first[text])]

    some = per_text > 0
    peak, most = np.zeros(texts), np.zeros(texts)
    if some.any():
        peak[some] = np.maximum.reduceat(around(hit, 0, PEAK - 1), first[:-1][some])
        most[some] = np.maximum.reduceat(weight, first[:-1][some])
    size = np.diff(offsets).astype(float)

    def share(mask: np.ndarray, by: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(by, 1)

    count = np.maximum(per_text, 1)
    hits = add(hit)
    letters = share(_CAPITAL[data] | _SMALL[data], np.ones(texts))
    disguised = k.digit_in | k.sign_in | k.drawn
    return np.column_stack([
        np.log1p(per_text), np.log1p(hits), hits / count, add(weight) / count, most, peak,
        add(hit & (around(you, NEAR, NEAR) > 0)) / np.maximum(hits, 1), add(you) / count,
        share(_CAPITAL[data], letters), add(k.capital) / count, share(data == ord("!"), size), share(_SIGN[data], size),
        add(k.digit_in) / count, add(k.sign_in) / count, add(k.drawn) / count, add(hit & disguised) / count,
    ])


@dataclass
class Trees:
    """Boosted regression trees on logistic loss; each tree is complete, its cuts in breadth-first order."""

    start: float
    feature: np.ndarray  # trees x (2 ** depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # value <= edge: left
    inner, leaves = 2**depth - 1, 2**depth
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    raw = np.full(len(y), start)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low = 2**level - 1
            width = 2**level
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                n = len(edges[f]) + 1
                if n < 2:
                    continue
                cell = (node - low) * n + binned[:, f]
                gs = np.bincount(cell, g, width * n).reshape(width, n)
                hs = np.bincount(cell, h, width * n).reshape(width, n)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for w in np.flatnonzero(top > best):
                    best[w], feature[t, low + w], cut[t, low + w] = top[w], f, edges[f][at[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        where = node - inner
        leaf[t] = rate * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + ridge)
        raw += leaf[t][where]
    return Trees(start, feature, cut, leaf)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean raw value and label share of each pool, for linear interpolation."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # label sum, raw sum, count
    for value, label in zip(raw[order], y[order], strict=True):
        pools.append([float(label), float(value), 1.0])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    table = np.array(pools)
    return table[:, 1] / table[:, 2], table[:, 0] / table[:, 2]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        raw = self.trees.raw(x)
        if not len(self.at):
            return 1 / (1 + np.exp(-raw))
        # the tree's own order is kept inside a pool, by a part too small to move a score over 0.5
        return np.clip(np.interp(raw, self.at, self.share), 1e-4, 1 - 1e-4) + 1e-5 * np.tanh(raw / 10)


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word or beginning, of toxic ones and others, summed over a slice."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for row, data, offsets in words.slices(batch.column("text")):
            k = keys(data, offsets)
            text = k.found.text_of()
            key = np.concatenate([k.whole, *k.beginnings])
            owner = np.tile(text, 1 + len(BEGINNINGS))
            key, owner = key[key != 0], owner[key != 0]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            entry, at = np.unique(key[new], return_inverse=True)
            bad = np.bincount(at, weights=toxic[row + owner[new]], minlength=len(entry)).astype(np.int64)
            docs = np.bincount(at, minlength=len(entry)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(bad), pa.array(docs)], ["entry", "bad", "docs"])


def _second_person() -> np.ndarray:
    return np.array(sorted(_word_key(w) for w in SECOND_PERSON), np.uint64)


def _features(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = _second_person()
        for batch in batches:
            for row, data, offsets in words.slices(batch.column("text")):
                x = features(data, offsets, lexicon.value, second)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("fold").slice(row, len(x)), batch.column("toxic").slice(row, len(x)), rows], ["fold", "toxic", "x"])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = _second_person()
        for batch in batches:
            for row, data, offsets in words.slices(batch.column("text")):
                score = model.value.score(features(data, offsets, model.value.lexicon, second))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(score)), pa.array(score)], ["id", "score"])

    return run


def _clean(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = _second_person()
        for batch in batches:
            texts = batch.column(text_col)
            scores = [model.value.score(features(data, offsets, model.value.lexicon, second)) for _, data, offsets in words.slices(texts)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < 0.5))

    return run


def remainder(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)).cast("int")


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Entries whose odds of standing in a toxic document are high; copies of one text count once."""
    distinct = train.dropDuplicates(["text"])
    total = distinct.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not total[0] or not total[1] or total[1] == total[0]:
        return Lexicon()
    counts = distinct.select("text", F.col("toxic").cast("double")).mapInArrow(_count_entries, "entry long, bad long, docs long")
    counts = counts.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("docs").alias("docs")).filter(F.col("bad") >= LEAST_DOCS)
    odds = F.log((F.col("bad") + 0.5) / float(total[1])) - F.log((F.col("docs") - F.col("bad") + 0.5) / float(total[0] - total[1]))
    found = counts.select("entry", odds.alias("weight")).filter(F.col("weight") >= np.log(LEAST_ODDS)).orderBy(F.desc("weight"), "entry").limit(LEXICON).collect()
    entry = np.array([r.entry for r in found], np.int64).view(np.uint64)
    order = np.argsort(entry)
    return Lexicon(entry[order], np.array([r.weight for r in found])[order])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = common.documents(docs, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", remainder("id")).filter("fold <> 0")
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    train = common.stage(texts.join(F.broadcast(known), "id").select("text", "toxic", "fold"), "labelled")  # at most ``sample`` ids
    lexicon = learn_lexicon(train.filter("fold in (1, 2)"))
    rows = train.filter("fold in (3, 4)").mapInArrow(_features(context.broadcast(lexicon)), "fold int, toxic int, x array<double>").toPandas()
    y = rows["toxic"].to_numpy(float)
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    grow, hold = rows["fold"].to_numpy() == 3, rows["fold"].to_numpy() == 4
    if not grow.any() or y[grow].min() == y[grow].max():
        share = train.agg(F.avg("toxic")).first()[0]
        return Model(lexicon, None, np.zeros(0), np.zeros(0), float(share or 0.0))
    trees = fit_trees(x[grow], y[grow])
    at, share = (np.zeros(0), np.zeros(0)) if not hold.any() or y[hold].min() == y[hold].max() else isotonic(trees.raw(x[hold]), y[hold])
    return Model(lexicon, trees, at, share, 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``score``, ``predicted`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = common.documents(docs, id_col, text_col).mapInArrow(_score(shared), "id long, score double")
    return rows.select("id", F.coalesce(remainder("id") == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted to be toxic; nothing is shuffled."""
    common.prepare(docs.sparkSession)
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model), text_col), docs.schema)
