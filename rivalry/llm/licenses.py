"""License scan: a trained paragraph classifier confirmed against templates.

A paragraph is a non-blank line.  Paragraphs that hold a cue are cut into windows
of ``WINDOW`` words, each starting ``STEP`` after the one before, so that every
template lies whole in one.  Cues are words that licences are talked about with
and those derived from the templates: no window without one can be confirmed.
Every window is classified by multinomial logistic regression over sparse 1- to
3-word n-grams into licence families or ``unknown``.  The model learns from the
templates' sentences and freer wordings, alone and inside paragraphs of the corpus
(a hash sample of about ``sample_rows`` paragraphs, at most ``vocabulary``
n-grams), against those paragraphs themselves and cue-bearing sentences that grant
no known licence.  The family probability needed is calibrated on held-out
cue-bearing paragraphs that grant none: it lets through at most ``false_rate`` of
them, and is never under ``least``; what stays below is ``unknown``.  The template
comparison then confirms a prediction: over half of the word pairs of one of the
family's templates, or ``pairs_needed`` of them, stand in the window (a template of
a single word: that word).  Predictions that are not confirmed are reported apart.

All steps are DataFrame functions and Spark ML.  Texts are reduced to the windows
of their cue paragraphs in the one pass that reads them; rows are told apart by
their place in that pass, not by doc_id.

Defined results: null text counts as empty (no paragraphs); each row has its own
findings, whatever its doc_id; repeated rows repeat their result; of equal
probabilities the family listed first wins; very long lines and texts are scanned
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, let

SAMPLE_ROWS, FALSE_RATE, LEAST, PAIRS_NEEDED, VOCABULARY = 3000, 0.005, 0.5, 6, 1 << 14
WINDOW, STEP = 64, 32

# Notices and grant sentences of public licences, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0", "Apache-2.0"],
    "mit": [
        "Released under the MIT License.", "This project is licensed under the MIT License.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT"],
    "bsd": [
        "Released under the BSD License.", "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU General Public License, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only"],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "MPL-2.0"],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted",
        "SPDX-License-Identifier: ISC"],
    "epl": [
        "Licensed under the Eclipse Public License, version 2.0.", "under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0", "EPL-2.0"],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "BSL-1.0"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "CC BY-NC 4.0", "CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": [
        "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "CC BY 4.0", "CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "public-domain": [
        "Released under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense", "CC0 1.0 Universal"],
}
# Freer wordings, to learn from; the templates do not confirm them.
WORDINGS = {
    "apache-2.0": ["Available under the Apache 2 licence.", "Licensed under Apache License 2.", "Apache Licence 2", "This code is Apache 2.0 licensed."],
    "mit": ["MIT licensed.", "This code is distributed under the MIT licence.", "License: MIT", "See the MIT license for details."],
    "bsd": ["Distributed under a BSD-style license.", "License: BSD 2-clause", "This code is BSD licensed.", "governed by a BSD licence"],
    "gpl": ["This program is distributed under GPLv3.", "License: GPL v3", "Licensed under the GPL version 2.", "This module is GPL licensed.", "GPLv2 or later"],
    "agpl": ["This server is distributed under AGPLv3.", "License: AGPL v3", "Licensed under the GNU AGPL version 3.", "covered by the Affero GPL"],
    "lgpl": ["This library is distributed under LGPLv3.", "License: LGPL v2.1", "Licensed under the GNU LGPL."],
    "mpl-2.0": ["License: MPL 2.0", "Covered by the Mozilla Public Licence 2.0.", "This file is MPL licensed."],
    "isc": ["License: ISC", "ISC licensed.", "Distributed under the ISC licence."],
    "epl": ["License: EPL 2.0", "Available under the Eclipse Public Licence.", "EPL licensed."],
    "bsl-1.0": ["License: Boost 1.0", "Use is subject to the Boost Software Licence.", "Boost licensed."],
    "cc-by-nc": ["Creative Commons, non-commercial use only.", "Content is CC-BY-NC.", "shared under a Creative Commons NonCommercial licence"],
    "cc-by": ["Content is CC-BY.", "shared under a Creative Commons Attribution licence", "Creative Commons BY-SA"],
    "public-domain": ["Dedicated to the public domain under CC0.", "The author waives all rights: CC0.", "Placed in the public domain."],
}
# Cue-bearing sentences that grant none of these licences.
UNKNOWN = [
    "A driving licence is required.", "The licence fee was raised last year.", "Copyright law protects authors for many years.",
    "All rights reserved.", "Licensed under the terms of the customer agreement.", "Permission was granted to enter the building.",
    "Redistribution of income is debated.", "The warranty covers parts and labour.", "See the license agreement for details.",
    "Released under embargo until Monday.", "This product is licensed, not sold.", "He asked for permission to use the car.",
    "Copyright 2020 by the authors.", "The license plate was stolen.", "A fishing license, version 2, is sold here.",
    "The public domain is a legal concept.", "Software may not be copied without a written license from the vendor."]
FAMILIES = list(TEMPLATES)
# Words that licences are talked about with.
TALK = ["licen", "gpl", "cc0", "public domain", "creative commons"]
#: Words too common to be cues.
COMMON = set("a and any are as by for in is it may not of or that the this to under use with you 1.0 2.0 4.0".split())


def template_units(template: str) -> list[tuple[str, ...]]:
    """The distinct word pairs of a template but those of common words alone; of a
    single word, the word."""
    w = [x for x in re.split(r"[^\w.-]+|[.](?!\w)", template.lower()) if x]
    return sorted(u for u in set(zip(w, w[1:])) if not COMMON.issuperset(u)) or [(w[0],)]


def units_needed(n: int, pairs_needed: int = PAIRS_NEEDED) -> int:
    """How many of a template's ``n`` units confirm it."""
    return min(n // 2 + 1, pairs_needed)


def derived_cues(pairs_needed: int = PAIRS_NEEDED) -> list[str]:
    """``TALK`` and words such that whatever confirms a template holds one: fewer units
    than needed are without.  The word in most units that are still open comes next."""
    templates = [template_units(t) for f in FAMILIES for t in TEMPLATES[f]]
    cues = list(TALK)
    while True:
        open_units = []
        for units in templates:
            left = [u for u in units if not any(c in w for w in u for c in cues)]
            if len(left) >= units_needed(len(units), pairs_needed):
                open_units += left
        if not open_units:
            return cues
        count = Counter(w for u in open_units for w in set(u))
        cues.append(min(count, key=lambda w: (w in COMMON, -count[w], w)))


CUES = derived_cues()


def _has_cue(text: Column, cues: list[str] = CUES) -> Column:
    return let(F.lower(text), lambda low: functools.reduce(operator.or_, [F.contains(low, F.lit(c)) for c in cues]))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.-]+|[.](?!\p{N})"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds ``pairs`` and ``grams`` to rows with a ``para`` column."""
    w = F.col("_w")
    df = df.withColumn("_w", _tokens(F.col("para"))).withColumn("pairs", F.array_distinct(_grams(w, 2)))
    return df.withColumn("grams", F.concat(w, "pairs", _grams(w, 3))).drop("_w")


def _rows(spark: SparkSession, items: list[tuple[str, int]]) -> DataFrame:
    """Constant rows (k, para, label) without a Python data source."""
    rows = [F.struct(F.lit(k).alias("k"), F.lit(t).alias("para"), F.lit(float(c)).alias("label")) for k, (t, c) in enumerate(items)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def training_rows(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(para, label, part): label 0 is unknown, family i + 1; part 0 trains, 1 calibrates."""
    spark = docs.sparkSession
    known = [(t, i + 1) for i, f in enumerate(FAMILIES) for t in TEMPLATES[f] + WORDINGS[f]]
    constant = _rows(spark, [(t, 0) for t in UNKNOWN] + known)
    n = len(UNKNOWN) + len(known)
    one_in = max(1, -(-docs.count() // sample_rows))
    text = F.col("text").cast("string")
    lines = (docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
             .select(F.explode(F.split("text", "\n")).alias("para")).where(F.col("para").rlike(r"\S") & ~_has_cue(F.col("para"))))
    # about eight lines a document: one in eight keeps the sample near its size; of a long line any 40 words stand for it
    lines = lines.where(F.pmod(F.xxhash64("para", F.lit(1)), F.lit(8)) == 0).withColumn("v", F.split("para", " "))
    start = F.pmod(F.xxhash64("para", F.lit(3)), F.greatest(F.size("v") - 39, F.lit(1))).cast("int") + 1
    noise = lines.select(F.array_join(F.slice("v", start, F.lit(40)), " ").alias("noise"))
    noise = noise.withColumn("k", F.pmod(F.xxhash64("noise"), F.lit(n)).cast("int")).withColumn("part", F.pmod(F.xxhash64("noise", F.lit(2)), F.lit(2)))
    mixed = noise.join(constant, "k").select(F.concat_ws(" ", "noise", "para").alias("para"), "label", "part")
    plain = noise.select(F.col("noise").alias("para"), F.lit(0.0).alias("label"), "part")
    alone = constant.select("para", "label", F.lit(0).alias("part"))
    return mixed.unionByName(plain).unionByName(alone)


@dataclass
class LicenseModel:
    vectorizer: object
    regression: object
    threshold: float


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, false_rate: float = FALSE_RATE, least: float = LEAST,
          vocabulary: int = VOCABULARY) -> LicenseModel:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    rows = cut_lineage(_with_grams(training_rows(docs, sample_rows)).coalesce(4), "license-rows")
    fit = rows.where("part = 0")
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, binary=True).fit(fit)
    regression = LogisticRegression(maxIter=40, regParam=0.003, family="multinomial").fit(vectorizer.transform(fit))
    held = regression.transform(vectorizer.transform(rows.where((F.col("part") == 1) & (F.col("label") == 0) & _has_cue(F.col("para"))))).select(
        F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES))).alias("p"))
    quantile = held.agg(F.percentile_approx("p", 1 - false_rate, 10_000).alias("q")).first()["q"]
    return LicenseModel(vectorizer, regression, max(least, quantile or 0.0))


def cue_windows(docs: DataFrame, pairs_needed: int = PAIRS_NEEDED) -> DataFrame:
    """row, doc_id, n_paragraphs, n_cue (cue paragraphs) and windows: array of (line, w, para)."""
    known_cues = CUES if pairs_needed >= PAIRS_NEEDED else derived_cues(pairs_needed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("para"))), lambda x: _has_cue(x["para"], known_cues))

    def cut(x: Column) -> Column:
        return let(_tokens(x["para"]), lambda v: F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil((F.size(v) - WINDOW) / STEP).cast("int"), F.lit(0))),
            lambda i: F.struct(x["line"].alias("line"), i.alias("w"), F.array_join(F.slice(v, i * STEP + 1, WINDOW), " ").alias("para"))))

    found = F.when(_has_cue(F.col("text"), known_cues), lines).otherwise(F.array().cast("array<struct<line:int,para:string>>"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text.alias("text"))
    paragraphs = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))).cast("long")
    return cut_lineage(rows.select("row", "doc_id", paragraphs.alias("n_paragraphs"), F.flatten(F.transform(found, cut)).alias("windows")), "license-windows")


def license_paragraphs(windows: DataFrame, model: LicenseModel, pairs_needed: int = PAIRS_NEEDED) -> DataFrame:
    """(row, line, w, para, family, score, confirmed) of every window of ``cue_windows``;
    ``family`` is ``unknown`` below the threshold."""
    from pyspark.ml.functions import vector_to_array

    windows = windows.select("row", F.explode("windows").alias("x")).select("row", "x.*")

    def literal(units) -> Column:
        return F.lit([" ".join(u) for u in units])

    def enough(known: Column, template: str) -> Column:
        units = template_units(template)
        return F.size(F.array_intersect(known, literal(units))) >= units_needed(len(units), pairs_needed)

    every = sorted({u for f in FAMILIES for t in TEMPLATES[f] for u in template_units(t)})

    def holds(known: Column) -> Column:
        return F.array(*[functools.reduce(operator.or_, [enough(known, t) for t in TEMPLATES[f]]) for f in FAMILIES])

    units = let(F.split("para", " "), lambda v: F.concat(v, F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.concat_ws(" ", a, b))))
    held = let(F.array_intersect(units, literal(every)), lambda known: F.when(F.size(known) > 0, holds(known)))
    # written, so that no step computes the comparison of another one again
    windows = cut_lineage(windows.withColumn("held", held), "license-held")
    scored = model.regression.transform(model.vectorizer.transform(_with_grams(windows)))
    scored = scored.withColumn("p", F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
    scored = scored.withColumn("score", F.array_max("p")).withColumn("best", F.array_position("p", F.col("score")).cast("int"))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    sure = F.col("score") >= model.threshold
    return scored.select("row", "line", "w", "para", F.when(sure, F.element_at(names, F.col("best"))).otherwise("unknown").alias("family"),
                         "score", F.coalesce(sure & F.element_at("held", F.col("best")), F.lit(False)).alias("confirmed"))


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, n_paragraphs, n_cue, n_license (confirmed paragraphs), families
    (confirmed, distinct, sorted, comma-joined), score (highest confirmed), n_likely
    (other paragraphs with a family), likely (their families)."""
    windows = cue_windows(docs)
    # a paragraph counts once: as confirmed if one of its windows is
    per_line = license_paragraphs(windows, model).groupBy("row", "line").agg(
        F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("sure"), F.max(F.when(F.col("confirmed"), F.col("score"))).alias("score"),
        F.collect_set(F.when(F.col("family") != "unknown", F.col("family"))).alias("any"))
    other = F.when(F.size("sure") == 0, F.col("any")).otherwise(F.array().cast("array<string>"))

    def joined(sets: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(sets))), ",")

    per_row = per_line.withColumn("other", other).groupBy("row").agg(
        F.count("*").alias("n_cue"), F.count_if(F.size("sure") > 0).alias("n_license"), joined(F.collect_list("sure")).alias("families"),
        F.round(F.max("score"), 6).alias("score"), F.count_if(F.size("other") > 0).alias("n_likely"), joined(F.collect_list("other")).alias("likely"))
    base = windows.select("row", "doc_id", "n_paragraphs")
    none, blank = F.lit(0).cast("long"), F.lit("")
    return base.join(per_row, "row", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_cue", none).alias("n_cue"), F.coalesce("n_license", none).alias("n_license"),
        F.coalesce("families", blank).alias("families"), "score", F.coalesce("n_likely", none).alias("n_likely"), F.coalesce("likely", blank).alias("likely"))
