"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

The model is a multinomial logistic regression over the 1- to 3-grams of licence notices, one class per family and
one for "unknown", fitted here on altered copies of the templates below and on sentences that use the same words
otherwise. A temperature and the least share that a family must reach are calibrated on altered copies that the fit
has not seen. Weights are whole numbers (``UNIT`` parts), so every engine adds them alike.

The scan is DataFrame functions only: lines, a test for the words that the model's n-grams hold (a line without one has
no feature, so it is unknown by the model), n-grams, one join with the weights (some thousand rows, whatever the input),
one sum per line. A prediction is confirmed if a template of the family has enough of its word pairs in the line.

One row per line that is taken for a licence: ``id``, ``line``, ``family``, ``share`` (calibrated probability),
``similarity`` (share of the nearest template's word pairs), ``confirmed``. Null and empty texts have no lines; a null
id stays null; rows that repeat id and line are reported once; further columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# SPDX ids and usual wordings of licence notices, by family.
SPDX = (
    ("MIT", "MIT"),
    ("Apache-2.0", "Apache-2.0"),
    ("GPL", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later"),
    ("LGPL", "LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later"),
    ("AGPL", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"),
    ("BSD", "BSD-2-Clause BSD-3-Clause"),
    ("MPL-2.0", "MPL-2.0"),
    ("ISC", "ISC"),
    ("CC-BY", "CC-BY-4.0"),
    ("CC-BY-SA", "CC-BY-SA-4.0"),
    ("CC-BY-NC", "CC-BY-NC-4.0"),
    ("CC0", "CC0-1.0"),
)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("GPL", "Distributed under the GPL v2 or any later version, see COPYING."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This library is released under the LGPL."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "This software is released under the AGPL."),
    ("BSD", "Licensed under the 3-Clause BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Released under the BSD license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the MPL 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("CC0", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright 2020 Example Inc. All rights reserved."),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    ("Proprietary", "All rights reserved."),
    *((family, f"SPDX-License-Identifier: {name}") for family, names in SPDX for name in names.split()),
)
# Sentences with some of the same words that grant nothing, and plain ones.
OTHER = (
    "He lost his driving license and had to obtain a new one at the office.",
    "The bar is licensed to sell beer and wine until midnight.",
    "License fees rose by four percent, the ministry said in a public statement.",
    "A general told the public that the file was a copy, not the source.",
    "The software was sold with documentation and a binary version for any purpose.",
    "She gave permission to use the hall free of charge for the charity event.",
    "The foundation published its terms and conditions for the creative award.",
    "The Mozilla team met the GNU people and the Apache tribe in a common hall.",
    "Rights of the author are a matter of law in every state.",
    "Massachusetts Institute of Technology, also called MIT, is in Cambridge.",
    "Commercial attribution models help you to see where the clicks come from.",
    "Students at MIT and Berkeley wrote code for the BSD kernel in version 4.",
    "In 2020 the company reserved all rooms of the hotel for its guests.",
    "The domain of the function is the set of all values with a clause in the form.",
    "and the of to in is it for on with as was that by at from this be or are an not have you which we can all any other more one will were has their when who what there",
    "der die das und ist nicht ein eine mit von zu auf für im den dem des als auch es an werden aus er hat dass sie nach bei um am sind noch wie",
    "le la les de des et est une un dans que qui pour pas sur au avec ce il par plus ne se son sont nous vous mais ou être aux cette",
    "el la los las de y que en un una por con no para se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre",
)
COMMON = 4  # the last sentences of OTHER are function words
UNKNOWN = "unknown"
UNIT = 100_000
SIMILAR = 0.6
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    import re

    return re.findall(WORD, "".join(chr(ord(c) + 32) if c in UPPER else c for c in text))


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    families: list[str]  # the last is "unknown"
    cues: list[str]  # words one of which is in every gram of the model
    weights: dict[str, list[int]]  # gram to a weight per family
    base: list[int]
    least: float  # least share of a family

    def pairs(self) -> list[tuple[str, list[str]]]:
        """(family, distinct word pairs) per template."""
        return [(family, sorted(g for g in grams_of(words_of(text)) if g.count(" ") == 1)) for family, text in TEMPLATES]


@functools.lru_cache
def trained(seed: int = 11, copies: int = 12) -> Model:
    """Fit and calibrate; the same at every call. Training rows are bounded by the templates times ``copies``."""
    rng = np.random.default_rng(seed)
    families = [*dict.fromkeys(f for f, _ in TEMPLATES), UNKNOWN]
    plain = {w for s in OTHER for w in words_of(s)}
    everything = sorted({w for _, t in TEMPLATES for w in words_of(t)})
    own = set(everything) - plain | {"mit", "bsd", "gnu", "apache", "mozilla", "license", "licensed", "licenses", "permission"}
    known = own | set(everything) - {"a", *(w for s in OTHER[-COMMON:] for w in words_of(s))}
    told = {g for s in OTHER for g in grams_of(words_of(s))}  # runs of words that are no licences' own
    grams = sorted({g for _, t in TEMPLATES for g in grams_of(words_of(t)) if own & set(g.split()) or known & set(g.split()) and " " in g and g not in told})
    cues = sorted(known)
    loose = [w for w in everything if w not in {i.lower() for _, names in SPDX for i in names.split()} - {"mit", "isc"}]  # an id names its licence
    at = {g: i for i, g in enumerate(grams)}
    filler = sorted(plain)

    def altered(words: list[str]) -> list[str]:
        kept = [w for w in words if rng.random() > rng.choice([0, 0.05, 0.15])]
        noise = list(rng.choice(filler, rng.integers(0, 25)))
        cut = rng.integers(0, len(noise) + 1)
        return [*noise[:cut], *kept, *noise[cut:]]

    def rows() -> tuple[np.ndarray, np.ndarray]:
        x, y = [], []

        def add(words: list[str], family: str) -> None:
            row = np.zeros(len(grams))
            for g in grams_of(words):
                if g in at:
                    row[at[g]] = 1
            x.append(row)
            y.append(families.index(family))

        for _ in range(copies):
            for family, text in TEMPLATES:
                add(altered(words_of(text)), family)
            for text in OTHER:
                add(altered(words_of(text)), UNKNOWN)
            for _ in range(20):  # licence words in no order
                add(altered(list(rng.choice(loose, rng.integers(1, 4)))), UNKNOWN)
        return np.array(x), np.array(y)

    x, y = rows()
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    b[-1] = 1.0
    target = np.eye(len(families))[y]
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(200):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(x)
        speed_w = 0.9 * speed_w - 2.0 * (x.T @ g + 2e-5 * w)
        speed_b = 0.9 * speed_b - 2.0 * g.sum(0)
        w, b = w + speed_w, b + speed_b

    x, y = rows()  # other alterations, for calibration
    z = x @ w + b

    def shares(heat: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / heat)
        return e / e.sum(1, keepdims=True)

    heat = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(np.maximum(shares(t)[np.arange(len(y)), y], 1e-12)).mean())
    p = shares(heat)
    false = p[y == len(families) - 1, :-1].max(1)
    least = max(0.5, round(float(np.quantile(false, 0.99)), 3))
    weights = {g: [int(v) for v in np.rint(w[i] / heat * UNIT)] for g, i in at.items()}
    base = [int(v) for v in np.rint(b / heat * UNIT)]
    assert max(range(len(base)), key=base.__getitem__) == len(base) - 1  # no feature: unknown
    return Model(families, cues, weights, base, least)


def feature_rows(model: Model) -> list[tuple[str, list[int], list[int]]]:
    """(gram, weight per family, 1 per template that has it as a pair) of every gram of the model or a template."""
    pairs = [set(p) for _, p in model.pairs()]
    none = [0] * len(model.families)
    grams = sorted({*model.weights, *(g for p in pairs for g in p)})
    return [(g, model.weights.get(g, none), [int(g in p) for p in pairs]) for g in grams]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = trained()
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.withColumn("small", F.translate("text", UPPER, LOWER))
    words = F.regexp_extract_all("small", F.lit(f"({WORD})"), 1)
    lines = lines.filter(F.arrays_overlap(words, F.array(*[F.lit(c) for c in model.cues])))
    lines = lines.select("id", "line", "small").distinct()
    lines = lines.withColumn("words", words)

    def runs(n: int):
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))

    grams = lines.select("id", "line", "small", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram"))
    table = spark.createDataFrame(feature_rows(model), "gram string, weight array<int>, has array<int>")
    hits = grams.join(F.broadcast(table), "gram")  # the model's rows: bounded by the templates
    pairs = model.pairs()
    logits = [(F.sum(F.col("weight")[i]) + F.lit(model.base[i])).alias(f"z{i}") for i in range(len(model.families))]
    shared = [F.sum(F.col("has")[i]).alias(f"t{i}") for i in range(len(pairs))]
    sums = hits.groupBy("id", "line", "small").agg(*logits, *shared)
    scores = F.array(*[F.col(f"z{i}") for i in range(len(model.families))])
    top = F.array_max(scores)
    place = F.array_position(scores, top)
    parts = F.aggregate(scores, F.lit(0.0), lambda a, z: a + F.exp((z - top) / F.lit(float(UNIT))))
    family = F.element_at(F.array(*[F.lit(f) for f in model.families]), place.cast("int"))
    found = sums.withColumn("family", family).withColumn("share", F.round(F.lit(1.0) / parts, 4))
    found = found.filter((F.col("family") != UNKNOWN) & (F.col("share") >= F.lit(model.least)))
    near = F.greatest(*[F.when(F.col("family") == f, F.col(f"t{i}") / F.lit(float(len(p)))).otherwise(0.0) for i, (f, p) in enumerate(pairs)])
    found = found.withColumn("similarity", F.round(near, 4))
    return found.select("id", "line", "family", "share", "similarity", (F.col("similarity") >= F.lit(SIMILAR)).alias("confirmed"))


def scan_sql() -> str:
    """The scan as DuckDB SQL over ``documents``."""
    model = trained()
    pairs = model.pairs()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(g)}, {w}, {t})" for g, w, t in feature_rows(model))
    families = ", ".join(map(quote, model.families))
    logits = ", ".join(f"sum(weight[{i + 1}]) + ({b})" for i, b in enumerate(model.base))
    shared = ", ".join(f"sum(has[{i + 1}])" for i in range(len(pairs)))
    near = ", ".join(f"CASE WHEN family = {quote(f)} THEN t[{i + 1}] / {float(len(p))} ELSE 0.0 END" for i, (f, p) in enumerate(pairs))
    return f"""
WITH features(gram, weight, has) AS (VALUES {rows}), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), words AS (
  SELECT DISTINCT doc_id, line, translate(t, '{UPPER}', '{LOWER}') AS small FROM lines
), tokens AS (
  SELECT *, regexp_extract_all(small, '{WORD}') AS w FROM words
), starts AS (
  SELECT *, unnest(range(1, len(w) + 1)) AS i FROM tokens
), grams AS (
  SELECT DISTINCT doc_id, line, small, unnest([w[i], CASE WHEN i < len(w) THEN array_to_string(w[i:i + 1], ' ') END, CASE WHEN i + 1 < len(w) THEN array_to_string(w[i:i + 2], ' ') END]) AS gram FROM starts
), sums AS (
  SELECT doc_id, line, [{logits}] AS z, [{shared}] AS t FROM grams JOIN features USING (gram) GROUP BY doc_id, line, small
), found AS (
  SELECT doc_id, line, t, [{families}][list_position(z, list_max(z))] AS family, round(1.0 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / {float(UNIT)}))), 4) AS share FROM sums
)
SELECT doc_id, line::INTEGER AS line, family, share, round(greatest({near}), 4) AS similarity, round(greatest({near}), 4) >= {SIMILAR} AS confirmed
FROM found WHERE family <> '{UNKNOWN}' AND share >= {model.least}
"""
