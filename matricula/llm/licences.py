"""License scans: a trained paragraph classifier with template comparison.

A paragraph is a line of a document. Its sparse features are its lower-case words and word pairs,
hashed. A multinomial logistic regression (Spark ML) is trained on notices of each licence family
and on all ordinary paragraphs of one half of the corpus's lines as the class ``unknown``. The probability
that a notice needs is calibrated on all of the other half. Only words and pairs of the notices are features, so
paragraphs with the same ones are one weighted row. A predicted family is confirmed by comparing the
paragraph's word pairs with the family's templates.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import cut, discard, fence, stored

UNKNOWN = "unknown"

#: Notices of the licence families (fixed values: the short notices that the licences themselves recommend).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}

#: Cue words: ordinary paragraphs with one and without one weigh alike in training (fixed values; every template has one).
CUES = ("license", "licensed", "licence", "licenced", "permission", "redistribution", "spdx", "copyright", "gnu", "licenses", "warranty")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+(?:[.+][0-9]+)?"), 0)


def _pairs(words: Column) -> Column:
    return F.array_distinct(
        F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): the lines of each text, numbered from 0. Null text: one empty line."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("paragraph", "text")
    )


def word_shares(model: LogisticRegressionModel, size: int) -> dict[str, float] | None:
    """For each word of the notices, how much it can bring a paragraph towards any family: where the model gives a family
    half of the probability, the different words' shares add up to 1 or more. ``None``: the model has no such bound.

    A family then has more than ``unknown``, so its features outweigh the difference of the intercepts. The weight of a
    pair counts for that of its words that is in fewer pairs. Features of the notices are taken by their words, not by
    hashes that other words may share."""
    grams = _notice_grams()
    index, weights, bias = HashingTF(numFeatures=size), model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    gap = bias[0] - bias[1:]
    if not (gap > 0).all():
        return None
    times: dict[str, int] = {}
    for g in grams:
        for w in g.split(" "):
            times[w] = times.get(w, 0) + 1
    share: dict[str, list[float]] = {}
    for g in grams:
        word, i = min(g.split(" "), key=lambda w: (times[w], w)), index.indexOf(g)
        own = share.setdefault(word, [0.0] * len(gap))
        for f in range(len(gap)):
            own[f] += max(0.0, float(weights[f + 1, i] - weights[0, i])) / float(gap[f])
    return {w: max(x) for w, x in share.items() if max(x) > 0}


def lines_to_score(docs: DataFrame, shares: dict[str, float] | None) -> DataFrame:
    """The paragraphs that are not empty and whose words' shares add up to 1 (``None``: all that are not empty)."""
    lines = paragraphs(docs).where(F.btrim("text") != "")
    if shares is None:
        return lines
    known = F.array(*map(F.lit, shares)).cast("array<string>")
    share = F.create_map(*[F.lit(x) for w in shares.items() for x in w]) if shares else F.create_map().cast("map<string,double>")
    total = F.aggregate(F.array_intersect(_words(F.col("text")), known), F.lit(0.0), lambda acc, w: acc + F.coalesce(share[w], F.lit(0.0)))
    return lines.where(total >= 1 - 1e-6)


def _with_features(df: DataFrame, size: int) -> DataFrame:
    """``grams``: all words and pairs; ``vector``: of these the ones that a notice has, hashed."""
    df = df.withColumn("words", _words(F.col("text"))).withColumn("pairs", _pairs(F.col("words")))
    df = fence(df.withColumn("grams", F.array_distinct(F.concat("words", "pairs"))))
    df = df.withColumn("own", F.array_intersect("grams", F.array(*map(F.lit, _notice_grams()))))
    return HashingTF(inputCol="own", outputCol="vector", numFeatures=size, binary=True).transform(df).drop("own")


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.+][0-9]+)?", text.lower())


def _notices() -> list[tuple[str, str]]:
    """Training notices: every template whole, without each of its words, and each half of the long ones."""
    out = []
    for family, texts in TEMPLATES.items():
        for w in (t.split(" ") for t in texts):
            n = len(w)
            many = [w]
            if n > 4:
                many += [w[:k] + w[k + 1 :] for k in range(n)]
            if n >= 12:
                many += [w[: -(-n // 2)], w[n // 2 :]]
            out += [(family, " ".join(x)) for x in many]
    return out


def _variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_notices(), "family string, text string")


def _notice_grams() -> list[str]:
    """The words and word pairs of the training notices."""
    words = [_words_of(t) for _, t in _notices()]
    return sorted({w for x in words for w in x} | {f"{a} {b}" for x in words for a, b in zip(x, x[1:], strict=False)})


def _ordinary(docs: DataFrame) -> DataFrame:
    """(held, cued, grams, n): all different paragraphs of which no template shares much of their word pairs, counted by
    half, by whether they have a cue word, and by the notices' words and pairs that they have."""
    known = _notice_grams()
    words = _words(F.col("text"))
    lines = paragraphs(docs).where(F.btrim("text") != "").select("text", F.xxhash64("text").alias("h"), words.alias("words"))
    single, double = ([g for g in known if (" " in g) == pair] for pair in (False, True))
    own = F.array(*map(F.lit, double)).cast("array<string>")
    lines = fence(lines).withColumn("single", F.array_intersect("words", F.array(*map(F.lit, single)).cast("array<string>")))
    # A known pair needs two known words beside each other, or one word twice.
    several = (F.size("single") > 1) | ((F.size("single") == 1) & (F.size("words") > 1))
    lines = fence(lines.withColumn("all", F.when(several, _pairs(F.col("words"))).otherwise(F.array().cast("array<string>"))))
    lines = fence(lines.withColumn("pairs", F.array_intersect("all", own)))
    cued = F.arrays_overlap("single", F.array(*map(F.lit, CUES)))
    # Templates have fewer pairs than ``most``: what a paragraph has beyond them does not change its similarity.
    most = max(len(t.split()) for texts in TEMPLATES.values() for t in texts) * 2
    size = F.when(F.size("pairs") > 0, F.least(F.size("all"), F.lit(most))).otherwise(0)
    rows = lines.select("h", cued.alias("cued"), F.array_sort("single").alias("single"), F.array_sort("pairs").alias("pairs"), size.alias("size"))
    rows = rows.distinct().groupBy((F.pmod("h", F.lit(2)) != 0).alias("held"), "cued", "single", "pairs", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = fence(rows).where((F.size("pairs") == 0) | (_similarity(None, F.col("size")) < 0.3))
    return rows.groupBy("held", "cued", F.concat("single", "pairs").alias("grams")).agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int | None = None, size: int = 1 << 14, false_alarms: float = 0.001) -> tuple[LogisticRegressionModel, list[str], float]:
    """Model, class names by index, and the calibrated least probability of a family.

    All different ordinary paragraphs take part, one half (by hash) in training, the other in calibration; no template
    shares much of their word pairs. In training, those with a cue word weigh as much together as those without, and
    both together as much as the notices. The calibrated probability is exceeded by at most ``false_alarms`` of the
    calibration paragraphs, and is 0.5 at least. ``sample``: paragraphs of so many documents only, those with the
    smallest text hash (``None``: of all).
    """
    spark = docs.sparkSession
    names = [UNKNOWN, *sorted(TEMPLATES)]
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))])
    notices = _with_features(_variants(spark), size).select("vector", index[F.col("family")].alias("label"), F.lit(1.0).alias("weight"))
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    if sample is not None:
        chosen = texts.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample)
        texts = texts.join(F.broadcast(chosen), F.xxhash64("text") == F.col("h"), "left_semi")
    ordinary = stored(_ordinary(texts))
    kinds = ordinary.where("not held").groupBy("cued").agg(F.sum("n").alias("n")).collect()
    share = len(_notices()) / max(1, len(kinds))
    weight = F.lit(0.0)
    for r in kinds:
        weight = F.when(F.col("cued") == r.cued, F.col("n") * (share / r.n)).otherwise(weight)
    hashed = HashingTF(inputCol="grams", outputCol="vector", numFeatures=size, binary=True)
    trained = hashed.transform(ordinary.where("not held")).select("vector", F.lit(0.0).alias("label"), weight.alias("weight"))
    model = LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight", family="multinomial", maxIter=40, regParam=0.002, elasticNetParam=0.5
    ).fit(cut(notices.unionByName(trained)))
    held = _predicted(hashed.transform(ordinary.where("held")), model, names).select("n", F.when(F.col("family") != UNKNOWN, F.col("score")).otherwise(0.0).alias("score"))
    over = held.agg(F.percentile("score", F.lit(1 - false_alarms), F.col("n"))).first()[0]
    discard(ordinary)
    return model, names, max(0.5, over or 0.0)


def _score(lines: DataFrame, model: LogisticRegressionModel, names: list[str], size: int) -> DataFrame:
    return _predicted(fence(_with_features(lines, size)), model, names)


def _predicted(vectors: DataFrame, model: LogisticRegressionModel, names: list[str]) -> DataFrame:
    scored = fence(model.transform(vectors).withColumn("p", vector_to_array("probability")))
    best = F.array_max("p")
    family = F.array(*map(F.lit, names[: model.numClasses]))[(F.array_position("p", best) - 1).cast("int")]
    return fence(scored.withColumn("score", best).withColumn("family", family))


def _similarity(family: Column | None, size: Column | None = None) -> Column:
    """Largest share of a template's word pairs that the paragraph's ``pairs`` have, among the templates
    of its family (``None``: of any); for a piece of a template, the share of the paragraph's pairs. ``size``: the number of the
    paragraph's pairs, if ``pairs`` are only those that a template can have."""

    def pairs_of(text: str) -> list[str]:
        w = _words_of(text)
        return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))

    def share(pairs: Column) -> Column:
        out = []
        for name, texts in TEMPLATES.items():
            each = []
            for t in texts:
                own = pairs_of(t)
                shared = F.size(F.array_intersect(pairs, F.array(*map(F.lit, own))))
                each.append(shared / F.least(F.lit(len(own)), F.greatest(F.size(pairs) if size is None else size, F.lit(3))))
            top = F.greatest(*each) if len(each) > 1 else each[0]
            out.append(top if family is None else F.when(family == name, top))
        return F.greatest(*out) if family is None else F.coalesce(*out)

    # transform over a one-element array binds the pairs once for all comparisons
    return F.transform(F.array(F.col("pairs")), share)[0]


def licence_notices(docs: DataFrame, sample: int | None = None, size: int = 1 << 14, least_similarity: float = 0.6) -> DataFrame:
    """(doc_id, paragraph, family, score, similarity, confirmed): the paragraphs that read as a licence notice.

    ``score``: probability of the family, at least the calibrated one; ``confirmed``: the family's
    templates agree to ``least_similarity``. Paragraphs whose ``word_shares`` are too small are ``unknown`` by the
    model's own weights and give no row, as do null and empty texts. Repeated rows each give their own."""
    model, names, least = train(docs, sample, size)
    lines = lines_to_score(docs, word_shares(model, size))
    found = _score(lines, model, names, size).where((F.col("family") != UNKNOWN) & (F.col("score") >= least))
    found = found.withColumn("similarity", F.round(_similarity(F.col("family")), 4))
    return found.select("doc_id", "paragraph", "family", F.round("score", 6).alias("score"), "similarity", (F.col("similarity") >= least_similarity).alias("confirmed"))
