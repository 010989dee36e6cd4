"""Licence scan by a trained paragraph classifier (DataFrame operations only).

A paragraph is a line.  Its features are its distinct word bigrams; sparse
multinomial logistic regression over them gives each licence family and
``none`` a probability.  It is trained on the templates below, on cut, joined
and reworded copies of them, and on a bounded sample of ``negatives``
paragraphs of the corpus.  A temperature fitted on held-out copies calibrates
the probabilities.  Whether a paragraph that is no ``none`` is of a known
family at all is a second, calibrated question: each family in turn is left
out of the training, and a logistic function of the best probability and of
the similarity to that family's templates learns to tell the paragraphs of the
family left out from those of families trained on.  Below ``SURE`` the
paragraph is ``unknown``.  A prediction is confirmed when the paragraph holds at
least ``CONTAINED`` of the bigrams of one of the family's templates, or is
itself made of the family's bigrams to that share.

A line is looked at more closely only if it holds a word of the screen; training
proves that no line without one can be anything but ``none``, or else screens
by all known words.  Only bigrams with a weight matter, and there are no more of them than the
templates and their copies hold, so the weights are a broadcast side of proven
size; all others drop out in the join and only sums for paragraphs with known
bigrams are shuffled.

Defined results: null and empty texts and lines of fewer than two words have
no licence and give no rows; a repeated line or row is reported each time; of
equal probabilities the family first in order is taken; an empty table gives
no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.workspace import sampled

NEGATIVES = 2000
SURE = 0.5
CONTAINED = 0.6
#: Words too general to tell a licence by themselves.
_GENERAL = frozenset("a all an and any are as at be by conditions following for from have in is it list met not of on option or person program provided purpose required should source text that the this to use via with without work you your".split())
#: Licence families and the paragraphs by which they are known.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2024 the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
NONE = "none"
UNKNOWN = "unknown"
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def bigrams(text: str) -> list[str]:
    words = re.findall(_WORD, text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _pairs(words: Column) -> Column:
    first, second = (F.slice(words, F.lit(k), F.size(words) - 1) for k in (1, 2))
    return F.array_distinct(F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b)))


class LicenceModel:
    """Sparse logistic regression over bigrams, trained on the driver from templates and negatives."""

    def __init__(self, negatives: list[str], copies: int = 40, steps: int = 150):
        draw = random.Random(7)
        self.classes = [*sorted(TEMPLATES), NONE]
        plain = [w for text in negatives for w in text.split()[:20]] or ["text"]
        rows: list[tuple[list[str], int]] = [(bigrams(t), len(self.classes) - 1) for t in negatives]
        # general words about licences that name no family
        for _ in range(copies):
            rows.append((bigrams(" ".join(draw.choices(plain, k=12))), len(self.classes) - 1))
        for name, family in TEMPLATES.items():
            for template in family:
                words = template.split()
                for k in range(copies):
                    cut = words if k % 4 else words[draw.randrange(max(1, len(words) // 4)) :]
                    kept = [w for w in cut if k % 3 or draw.random() > 0.08]
                    around = draw.choices(plain, k=draw.randrange(8))
                    rows.append((bigrams(" ".join([*around[::2], *kept, *around[1::2]])), self.classes.index(name)))
        draw.shuffle(rows)
        known = {g for family in TEMPLATES.values() for t in family for g in bigrams(t)}
        self.grams = sorted(known)
        index = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(rows), len(self.grams) + 1))
        y = np.array([c for _, c in rows])
        for i, (found, _) in enumerate(rows):
            x[i, [index[g] for g in found if g in index]] = 1
            x[i, -1] = 1
        held = np.arange(len(rows)) % 5 == 0
        weights = self._fit(x[~held], y[~held], steps)
        z = x[held] @ weights

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float(-(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(1))).mean())

        self.temperature = min(np.linspace(0.3, 3, 28), key=loss)
        self.weights = weights / self.temperature
        # a line with none of these words is none, whatever other known bigrams it holds
        words = {w for g in self.grams for w in g.split()}
        self.screen = sorted(words - _GENERAL)
        general = [i for i, g in enumerate(self.grams) if set(g.split()) <= _GENERAL]
        gain = np.maximum(self.weights[general, :-1] - self.weights[general, -1:], 0).sum(0) + self.weights[-1, :-1] - self.weights[-1, -1]
        if (gain >= 0).any():
            self.screen = sorted(words)
        self.held_out_accuracy = float((z.argmax(1) == y[held]).mean())
        self.owns = np.array([[any(g in set(bigrams(t)) for t in TEMPLATES[f]) for f in self.classes[:-1]] for g in self.grams], float)
        self.templates = [(f, np.array([g in set(bigrams(t)) for g in self.grams], float)) for f in self.classes[:-1] for t in TEMPLATES[f]]
        self._calibrate(x, y, np.array([max(1, len(found)) for found, _ in rows]), held, steps)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
        weights = np.zeros((x.shape[1], len(self.classes)))
        target = np.eye(len(self.classes))[y]
        speed = np.zeros_like(weights)
        for _ in range(steps):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed + x.T @ (p - target) / len(x) + 1e-4 * weights
            weights -= 1.0 * speed
        return weights

    def _evidence(self, x: np.ndarray, total: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are best explained by a family, and for those (1, its probability, its similarity)."""
        z = x @ weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = z.argmax(1)
        own = np.flatnonzero(best < len(self.classes) - 1)
        grams = x[own, :-1]
        share = (grams * self.owns[:, best[own]].T).sum(1) / total[own]
        for family, within in self.templates:
            hit = best[own] == self.classes.index(family)
            share[hit] = np.maximum(share[hit], grams[hit] @ within / within.sum())
        return own, np.stack([np.ones(len(own)), p[own, best[own]], share], 1)

    def _calibrate(self, x: np.ndarray, y: np.ndarray, total: np.ndarray, held: np.ndarray, steps: int) -> None:
        """Weights of (1, probability, similarity) by which a paragraph is of a known family, from families left out in turn."""
        none = len(self.classes) - 1
        few = np.arange(len(y)) % 4 == 0
        own, features = self._evidence(x[held], total[held], self.weights)
        right = y[held][own] < none
        parts, labels = [features[right]], [np.ones(right.sum())]
        for family in range(none):
            rows = few & (y != family)
            _, unseen = self._evidence(x[y == family], total[y == family], self._fit(x[rows], y[rows], steps) / self.temperature)
            parts.append(unseen)
            labels.append(np.zeros(len(unseen)))
        f, label = np.concatenate(parts), np.concatenate(labels)
        # both sides count alike, however many copies they have
        weight = np.where(label > 0, 1 / max(1, (label > 0).sum()), 1 / max(1, (label == 0).sum())) * len(label) / 2
        known = np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(f @ known, -30, 30)))
            curve = (f * (weight * p * (1 - p))[:, None]).T @ f + 0.1 * np.eye(3)
            known += np.linalg.solve(curve, f.T @ (weight * (label - p)) - 0.1 * known)
        self.known = known
        p = 1 / (1 + np.exp(-np.clip(f @ known, -30, 30)))
        self.unknown_accuracy = float((weight * ((p >= SURE) == (label > 0))).sum() / weight.sum())


def train(docs: DataFrame, negatives: int = NEGATIVES, id_col: str = "doc_id", text_col: str = "text") -> LicenceModel:
    """Negatives: first lines without licence words of about ``negatives`` documents, chosen by hashed id."""
    line = F.substring(F.substring_index(F.col(text_col), "\n", 1), 1, 400)
    plain = docs.select(line.alias("line"), F.col(id_col).alias("doc_id")).filter(
        F.col("line").isNotNull() & ~F.lower("line").rlike("licen|copyright|rights reserved|public domain|permission")
    )
    return LicenceModel(sorted(r["line"] for r in sampled(plain, "doc_id", negatives).collect()))


def licences(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line, family, probability, similarity, known, confirmed: one row per licence paragraph; known is the probability that it is of a family at all."""
    spark = docs.sparkSession
    families = model.classes[:-1]
    held = {g: [f for f in families if any(g in bigrams(t) for t in TEMPLATES[f])] for g in model.grams}
    templates = [(f, k, len(bigrams(t)), set(bigrams(t))) for f in families for k, t in enumerate(TEMPLATES[f])]
    table = spark.createDataFrame(
        [
            (g, [float(w) for w in model.weights[i]], [int(f in held[g]) for f in families], [int(g in t) for _, _, _, t in templates])
            for i, g in enumerate(model.grams)
        ],
        "gram string, weights array<double>, own array<int>, within array<int>",
    )
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "paragraph"))
    words = _words(F.col("paragraph"))
    screen = F.array(*[F.lit(w) for w in model.screen])
    likely = lines.withColumn("words", words).filter(F.arrays_overlap("words", screen) & (F.size("words") > 1))
    grams = likely.select("doc_id", "row", "line", _pairs(F.col("words")).alias("grams"))
    each = grams.select("doc_id", "row", "line", F.size("grams").alias("total"), F.explode("grams").alias("gram"))
    met = each.join(F.broadcast(table), "gram")
    n = len(model.classes)
    # columns rather than arrays: sums stay in generated code, before and after the shuffle
    sums = [F.sum(F.col("weights")[j]).alias(f"w{j}") for j in range(n)]
    sums += [F.sum(F.col("own")[j]).alias(f"o{j}") for j in range(n - 1)]
    sums += [F.sum(F.col("within")[j]).alias(f"t{j}") for j in range(len(templates))]
    scored = met.groupBy("doc_id", "row", "line", "total").agg(*sums)
    z = [F.col(f"w{j}") + F.lit(float(model.weights[-1, j])) for j in range(n)]
    scored = scored.select("doc_id", "row", "line", "total", F.array(*z).alias("z"), *[c for c in scored.columns if c[0] in "ot" and c != "total"])
    top = F.array_max("z")
    scored = scored.withColumn("best", F.array_position("z", top).cast("int")).withColumn(
        "probability", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("z")))
    ).filter(F.col("best") < n)
    share = [F.col(f"o{j}") / F.col("total") for j in range(n - 1)]
    by_family = [
        F.greatest(share[j], *[F.col(f"t{k}") / F.lit(size) for k, (f, _, size, _) in enumerate(templates) if f == family])
        for j, family in enumerate(families)
    ]
    similar = F.array(*by_family)[F.col("best") - 1]
    name = F.array(*[F.lit(f) for f in families])[F.col("best") - 1]
    scored = scored.withColumn("similarity", similar)
    constant, by_probability, by_similarity = (float(w) for w in model.known)
    known = 1 / (1 + F.exp(-(F.lit(constant) + F.col("probability") * by_probability + F.col("similarity") * by_similarity)))
    return scored.withColumn("known", known).select(
        "doc_id",
        "line",
        F.when(F.col("known") >= SURE, name).otherwise(UNKNOWN).alias("family"),
        "probability",
        "similarity",
        "known",
        ((F.col("known") >= SURE) & (F.col("similarity") >= CONTAINED)).alias("confirmed"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licences(docs, train(docs))
