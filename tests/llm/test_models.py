import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from fleetdrift.llm import embeddings, licenses, pieces, toxicity


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


ODD = [" ", "  a", "a  b   c ", "\x00\x01 \x7f", "=" * 33 + "-" * 17, "http://www.example.com/" + "a" * 70, "line\n\n\tnext\r\n", "ꙮ unseen 𒀀𒀁"]


def test_pieces_equal_the_library_and_round_trip(docs, odd_rows, library, rows):
    given = [*odd_rows, *enumerate(ODD, 100)]
    encoded = pieces.encode(docs(*given))
    assert rows(encoded, "id", "ids") == sorted(((i, library.encode(t or "", num_threads=1)) for i, t in given), key=repr)
    assert rows(pieces.decode(encoded), "id", "text") == sorted(((i, (t or "").replace("▁", " ")) for i, t in given), key=repr)
    assert pieces.decode(pieces.encode(docs((1, "x")).filter("false"))).count() == 0


def test_licence_families(docs, rows):
    given = [(k, f"plain words\n{text}\nmore") for k, (_, text) in enumerate(licenses.TEMPLATES)]
    found = {r.id: r for r in licenses.scan(docs(*given)).collect()}
    assert [found[k].family for k in range(len(given))] == [f for f, _ in licenses.TEMPLATES]
    assert all(r.confirmed and r.line == 1 for r in found.values())


def test_licence_unknown(docs, odd_rows):
    held = ["A public license plate was found under the bridge.", "The general said the work is free.", "MIT is a university.", "version 3 of the plan"]
    assert licenses.scan(docs(*odd_rows, *enumerate(held, 100))).count() == 0
    assert licenses.scan(docs((1, "x")).filter("false")).count() == 0


def test_licence_short_notices(docs):
    given = ["All rights reserved.", "SPDX-License-Identifier: GPL-3.0-only", "// SPDX-License-Identifier: Apache-2.0", "x -- All Rights Reserved --", "--released.-under the +mit+ license."]
    found = {r.id: (r.family, r.confirmed) for r in licenses.scan(docs(*enumerate(given))).collect()}
    assert found == {0: ("Proprietary", True), 1: ("GPL", True), 2: ("Apache-2.0", True), 3: ("Proprietary", True), 4: ("MIT", True)}


def test_licence_scan_equals_sql(docs, odd_rows):
    rng = random.Random(3)
    words = [w for _, t in licenses.TEMPLATES for w in t.split()]
    given = [(k, "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(4))) for k in range(60)]
    given += [(100 + k, text.upper()) for k, (_, text) in enumerate(licenses.TEMPLATES)] + [r for r in odd_rows if r[0] is not None]
    given += [(100, licenses.TEMPLATES[0][1].upper())]  # a repeated row is reported once
    found = sorted(tuple(r) for r in licenses.scan(docs(*given)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", given)
    want = sorted(con.execute(licenses.scan_sql()).fetchall())
    assert [(*r[:3], *r[5:]) for r in found] == [(*r[:3], *r[5:]) for r in want]
    assert all(abs(a - b) < 2e-4 for x, y in zip(found, want, strict=True) for a, b in zip(x[3:5], y[3:5], strict=True))


def brute_links(vectors, threshold):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in vectors]
    links = [
        [b for b in range(len(vectors)) if b != a and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]
        for a in range(len(vectors))
    ]
    out = []
    for a, (i, _) in enumerate(vectors):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min(vectors[b][0] for b in seen) if i is not None else None
        out.append((i, len(links[a]), least, i == least and i is not None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("tile", "pivots"), [(None, 256), (16, 5)])
def test_embeddings_equal_brute_force(spark, rows, tile, pivots):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    vectors = [(k, (centres[k % 12] + rng.normal(size=24) * rng.choice([0, 0.1, 0.25, 0.4])).astype(np.float32).tolist()) for k in range(180)]
    vectors += [(300 + k, vectors[3][1]) for k in range(6)]
    vectors += [(400, None), (401, [0.0] * 24), (402, [float("nan")] + [1.0] * 23), (403, [None] + [1.0] * 23), (404, [float("inf")] * 24), (405, [])]
    vectors += [(406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [1e-30] * 24), (409, [3e38] * 24), (None, None)]
    frame = spark.createDataFrame([(i, v, 1, "n", 0) for i, v in vectors], "vec_id long, embedding array<float>, label int, node string, size int")
    found = embeddings.embedding_components(frame, tile=tile, pivots=pivots)
    assert rows(found) == brute_links(vectors, 0.9)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 48)) * rng.choice([0.01, 1, 30], size=(200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, held, lost = embeddings.quantise(x)
    about = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale[None, :]
    bound = held[:, None] * lost[None] + lost[:, None] * (held + lost)[None]
    assert (np.abs(about - x @ x.T) <= bound + 1e-12).all()


def test_embeddings_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.embedding_components(frame).count() == 0


INSULTS = "idiot moron scum".split()


def labelled(prose, n, seed=0):
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words, bad = prose(5000 + seed + k, 40 + k % 60).split(), k % 4 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "!!", "ish"]))
        texts.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return texts, labels


def test_toxicity_finds_held_out_insults(docs, spark, prose):
    texts, labels = labelled(prose, 1600)
    model = toxicity.fit(docs(*texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.id: r for r in toxicity.score(docs(*texts), model).collect()}
    held = [found[i] for i, _ in labels if found[i].held_out]
    assert len(held) > 200
    right = sum(r.predicted == dict(labels)[r.id] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    clean = toxicity.drop_toxic(docs(*texts), model)
    assert clean.columns == docs((1, "x")).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in found.items() if not r.predicted}


def test_toxicity_of_odd_rows(docs, spark, prose, odd_rows):
    texts, labels = labelled(prose, 600)
    labels += [(5, None), (None, 1), (0, 0)]
    model = toxicity.fit(docs(*texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.score(docs(*odd_rows), model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    assert [r.held_out for r in found if r.id is None] == [True, True]


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows_ = docs((1, "a"), (2, None))
    assert [r.score for r in toxicity.score(rows_, toxicity.fit(rows_, none)).collect()] == [0.0, 0.0]
    model = toxicity.fit(rows_.filter("false"), none)
    assert toxicity.score(rows_.filter("false"), model).count() == 0


def test_labels_of_held_out_rows_are_not_read(docs, spark, prose):
    texts, labels = labelled(prose, 400)
    held = {r.id for r in docs(*texts).selectExpr("doc_id as id").withColumn("h", toxicity.remainder("id") == 0).filter("h").collect()}
    flipped = [(i, 1 - y if i in held else y) for i, y in labels]
    a, b = (toxicity.score(docs(*texts), toxicity.fit(docs(*texts), spark.createDataFrame(x, "doc_id long, toxic int"))).collect() for x in (labels, flipped))
    assert sorted(a) == sorted(b)


def test_isotonic_is_monotone_and_averages():
    at, share = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0, 1, 0, 1]))
    assert (np.diff(share) >= 0).all() and share.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [0.0, 1.5, 3.0]


def test_products_of_long_vectors_are_exact():
    rng = np.random.default_rng(8)
    a, b = (rng.integers(100, 128, (5, n)).astype(np.float32) for n in (4099, 4099))
    assert (embeddings.whole_product(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
