"""License scan: a trained paragraph classifier, confirmed by templates.

A paragraph (a line) becomes a sparse vector of word n-grams. A multinomial
logistic regression, trained on windows of the templates and on all paragraphs
of the documents as the class ``unknown``, says which family of licenses it is of.
The unknown class is calibrated: a prediction counts only if its probability
passes what held-out unknown paragraphs reach. A comparison with the templates
of the predicted family then confirms it or not. Counts, classifier and threshold
come from every paragraph; none of them is sampled.

Only n-grams of paragraphs with an anchor are features: anchors are the words of
the templates that ordinary paragraphs hardly have, and the names of licenses.
Paragraphs that resemble a template are not counted as ordinary, so a corpus full
of notices keeps its anchors. A paragraph without one has no features and is
unknown by definition, in training as in the scan, so few are left to classify.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.llm.common import fresh_names, row_key
from tallyweave.session import settle

# The wording of public licenses and of their usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
             "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
            "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "Licensed under CC BY 4.0."),
)

# Names of licenses beside the families'.
NAMES = ("gnu", "mozilla", "bsd-style")


@dataclass(frozen=True)
class Settings:
    """``unknown`` is what all unknown paragraphs together weigh at most beside the templates' windows, of weight 1 each."""

    unknown: float = 2000.0
    features: int = 4096
    window: int = 5
    anchor_share: float = 0.002
    quantile: float = 0.999
    least_probability: float = 0.6
    confirm: float = 0.6
    ridge: float = 0.001
    iterations: int = 40


@dataclass(frozen=True)
class Model:
    classifier: LogisticRegressionModel
    families: tuple[str, ...]  # by class number; 0 is unknown
    anchors: tuple[str, ...]
    threshold: float
    settings: Settings
    templates: tuple[tuple[str, str], ...]


def words(text: Column) -> Column:
    """Lower-case words of letters, digits, dots and dashes inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def ngrams(w: Column) -> Column:
    """Single words and pairs of neighbours."""
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(w, pairs)


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, no, w``: the words of each line that has any, lines numbered from 0."""
    # Cut before the rows are made: a filter on ``w`` would otherwise cut each line again.
    return docs.select(key, F.posexplode(F.transform(F.split(F.col(text), "\n", -1), words)).alias("no", "w")).filter(F.size("w") > 0)


def _vectors(rows: DataFrame, s: Settings) -> DataFrame:
    return HashingTF(numFeatures=s.features, inputCol="g", outputCol="x", binary=True).transform(rows.withColumn("g", ngrams(F.col("w"))))


def _template_rows(spark: SparkSession, templates) -> DataFrame:
    """``family, template, w``: a constant table of the templates' words."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("template")) for f, t in templates])
    return spark.range(1).select(F.explode(each).alias("t")).select("t.family", "t.template", words(F.col("t.template")).alias("w"))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, settings: Settings = Settings()) -> Model:
    """Train on ``templates`` and on every paragraph of ``docs``.

    Paragraphs that hold most of a template are no examples of unknown. Those of
    a third of the documents, by hash of their id, calibrate the threshold; the
    others are learned from. Two passes over ``docs``: words are counted, then
    paragraphs with an anchor are written and learned from. Those without have no
    features, so one row without words stands for them with all their weight.
    """
    s, spark = settings, docs.sparkSession
    known = settle(_template_rows(spark, templates))
    families = ("unknown", *sorted({f for f, _ in templates}))
    vocabulary = sorted(r[0] for r in known.select(F.explode("w")).distinct().collect())  # the templates' words, a constant set
    third = F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string")), F.lit(3)) == 0
    lines = paragraphs(docs.select(third.alias("held"), F.col(f"`{text}`").alias("t")), "held", "t")
    lines = lines.select("held", "w", F.filter("w", lambda x: x.isin(vocabulary)).alias("u")).withColumn("v", F.array_distinct("u"))
    # How many unknown paragraphs hold each word; no word is "", which counts the paragraphs themselves.
    each = _ordinary(lines, known, s).select("held", F.explode(F.concat(F.array(F.lit("")), "v")).alias("x"))
    counts = {r.x: r for r in each.groupBy("x").agg(F.count("*").alias("n"), F.count_if("held").alias("held")).collect()}
    n, n_held = (counts[""].n, counts[""].held) if counts else (0, 0)
    usual = {x for x, r in counts.items() if r.n > max(2, s.anchor_share * n)}
    # However many notices the documents hold, also in other words than the templates', these stay anchors.
    always = {w for w in vocabulary if "licens" in w or w in families or w in NAMES}
    anchors = tuple(sorted(w for w in vocabulary if w in always or (w not in usual and len(w) > 1 and not w.isdigit())))
    # Windows of a template stand for its pieces: lines that were wrapped, quoted or cut.
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - s.window + 1, F.lit(1)))
    pieces = known.select("family", F.explode(F.flatten(F.transform(F.array(*[F.lit(x) for x in (1, 2, 4, 100)]),
                          lambda m: F.transform(starts, lambda i: F.slice(F.col("w"), i, m * s.window))))).alias("w")).distinct()
    anchored = F.arrays_overlap("w", F.array(*[F.lit(a) for a in anchors]))
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    # A piece that two families share says nothing about either; it is unknown.
    shared = pieces.filter(anchored).groupBy("w").agg(F.count_distinct("family").alias("k"), F.min("family").alias("family"))
    good = shared.select("w", F.when(F.col("k") == 1, number).otherwise(0).cast("double").alias("label"))
    # All unknown paragraphs with an anchor: no others are ever classified.
    unknown = settle(_ordinary(lines.filter(F.arrays_overlap("v", F.array(*[F.lit(a) for a in anchors]))), known, s).select("held", "w"))
    seen = unknown.agg(F.count("*").alias("n"), F.count_if("held").alias("held")).first()
    share = min(1.0, s.unknown / max(1, n - n_held))
    rows = good.withColumn("weight", F.lit(1.0)).unionByName(unknown.filter(~F.col("held")).select("w", F.lit(0.0).alias("label"), F.lit(share).alias("weight")))
    # An empty table leaves no unknown paragraph; one without words stands for them.
    rows = rows.unionByName(known.limit(1).select(F.array().cast("array<string>").alias("w"), F.lit(0.0).alias("label"), F.lit(5.0).alias("weight")))
    data = settle(_vectors(rows, s).select("x", "label", "weight"))
    classifier = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=s.ridge, maxIter=s.iterations, standardization=False
    ).fit(data)
    # Probabilities of six decimals, so that few values are left to rank however many paragraphs there are.
    p = F.floor(F.col("family_p") * 1_000_000) / 1_000_000
    top = _predict(_vectors(unknown.filter("held"), s), classifier).select(F.when(p >= s.least_probability, p).otherwise(0.0).alias("p")).groupBy("p").count()
    top = top.unionByName(spark.range(1).select(F.lit(0.0).alias("p"), F.lit(n_held - seen.held).cast("long").alias("count")))
    got = top.agg(F.percentile("p", F.lit(s.quantile), F.col("count"))).first()[0]
    return Model(classifier, families, anchors, max(s.least_probability, got or 0.0), s, tuple(templates))


def _predict(vectors: DataFrame, classifier: LogisticRegressionModel) -> DataFrame:
    """With the best family's class number and probability, unknown aside."""
    out = classifier.transform(vectors).withColumn("p", vector_to_array("probability"))
    rest = F.slice(F.col("p"), 2, 1000)
    out = out.withColumn("family_p", F.array_max(rest)).withColumn("best", F.array_position(rest, F.array_max(rest)).cast("int"))
    return out.drop("x", "g", "rawPrediction", "probability", "prediction", "p")


def _fits(rg: Column, tg: Column, s: Settings) -> Column:
    """Whether n-grams ``rg`` of a paragraph hold most of a template's ``tg``, or are most of them."""
    common = F.size(F.array_intersect(rg, tg))
    return (common >= s.confirm * F.size(tg)) | ((F.size(rg) >= 2 * s.window - 1) & (common >= s.confirm * F.size(rg)))


def _ordinary(lines: DataFrame, known: DataFrame, s: Settings) -> DataFrame:
    """``lines`` (words ``w``, those of templates ``u``, each once ``v``) that fit no template.

    The templates are a constant table, so they are broadcast. N-grams are compared
    only where words allow it: common pairs begin at common words, so there are at
    most as many as these words have places, in the template or in the paragraph.
    """
    t = known.select(F.array_distinct("w").alias("tw"), F.array_distinct(ngrams(F.col("w"))).alias("tg"), F.size("w").alias("tn"))
    t = t.select("tw", "tg", (s.confirm * F.size("tg") - (F.col("tn") - F.size("tw"))).alias("least"))
    # A paragraph of k different words has k - 1 different pairs or more.
    mostly = F.size("v") + F.size("u") >= s.confirm * (2 * F.size(F.array_distinct("w")) - 1)
    r = lines.withColumn("mostly", (F.size("v") > 0) & mostly).withColumn("rg", F.when(F.size("v") > 0, F.array_distinct(ngrams(F.col("w")))))
    enough = (2 * F.size("v") >= F.col("least")) & (2 * F.size(F.array_intersect("v", "tw")) >= F.col("least"))
    return r.join(F.broadcast(t), (F.col("mostly") | enough) & _fits(F.col("rg"), F.col("tg"), s), "left_anti").drop("mostly", "rg")


def _alike(rows: DataFrame, known: DataFrame, s: Settings, on: Column) -> DataFrame:
    """``rows`` (with ``w``) joined with the templates (family ``tf``) that meet ``on`` and that they hold most of, or are most of.

    The templates are a constant table, so they are broadcast.
    """
    t = known.select(F.col("family").alias("tf"), "template", F.array_distinct(ngrams(F.col("w"))).alias("tg"))
    r = rows.withColumn("rg", F.array_distinct(ngrams(F.col("w"))))
    return r.join(F.broadcast(t), on & _fits(F.col("rg"), F.col("tg"), s)).drop("rg", "tg")


def findings(docs: DataFrame, model: Model, *, key: str, text: str) -> DataFrame:
    """``key, no, family, probability, confirmed``: the paragraphs of a known family; ``key`` names a row."""
    s, spark = model.settings, docs.sparkSession
    lines = paragraphs(docs, key, text).filter(F.arrays_overlap("w", F.array(*[F.lit(a) for a in model.anchors])))
    names = F.array(*[F.lit(f) for f in model.families])
    said = _predict(_vectors(lines, s), model.classifier).filter(F.col("family_p") >= F.lit(model.threshold))
    said = settle(said.select(key, "no", "w", F.element_at(names, F.col("best") + 1).alias("family"), F.round("family_p", 6).alias("probability")))
    agreed = _alike(said, _template_rows(spark, model.templates), s, F.col("family") == F.col("tf")).select(key, "no", F.lit(True).alias("yes")).distinct()
    return said.join(agreed, [key, "no"], "left").select(key, "no", "family", "probability", F.coalesce("yes", F.lit(False)).alias("confirmed")).distinct()


def scan(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with an array ``into`` of (no, family, probability, confirmed), by line number from 0.

    Null and empty texts, and texts without a license, have an empty array; very
    long texts are read whole, an empty table gives an empty one. Rows of equal id
    and text have equal results. Of equally likely families the first by name is
    taken. A column named ``into`` is replaced, all others stay, whatever their names.
    """
    key, listed = fresh_names(docs, "license_rk", "found", keep=[into, "t", "no", "w"])
    t = F.col(f"`{text}`")
    keyed = docs.withColumn(key, row_key(F.col(f"`{doc_id}`"), t))
    found = findings(keyed.select(key, t.alias("t")), model, key=key, text="t")
    per_row = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("no", "family", "probability", "confirmed"))).alias(listed))
    none = F.array().cast("array<struct<no: int, family: string, probability: double, confirmed: boolean>>")
    return keyed.join(per_row, key, "left").withColumn(into, F.coalesce(listed, none)).drop(key, listed)
