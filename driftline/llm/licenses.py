"""Licence families of paragraphs: trained n-gram classifier confirmed against templates (JVM only).

1. Blocks are what blank lines separate; words are runs of a-z, 0-9, ``.``, ``+`` and ``-`` of
   the lower-cased text, without marks at either end. A block is read as its lines (those of at
   most ``longest`` words) and, for notices that are wrapped or lie in a long line, as windows:
   for each template, every ``STRIDE`` words, of the template's length and ``PAD`` words more, so
   every run of a template's length lies whole in one of its windows. Blocks, and pieces of
   ``PIECE`` words of them, without ``confirm`` of any template's word pairs cannot hold a
   licence and are not read further. The features of a line or window are the counts of the word
   1- and 2-grams that occur in the templates.
2. Training rows come from the templates below, each in ``variants`` copies that lose a tenth
   of their words and gain words of real paragraphs around them (both chosen by hash); the
   class unknown gets at most ``background`` windows of ``longest`` words of lines of the
   documents, those that match no template, and the plain sentences of ``OTHER``. A multinomial logistic regression is fitted.
3. Every fifth row is held out of the fit and calibrates it: one temperature, the one of least
   negative log likelihood, scales the scores of all classes, unknown included.
4. A line or window is predicted as a family if that family is likelier than every other class,
   unknown included. The prediction stands if some template of the family has at least
   ``confirm`` of its word pairs in it; a window must be predicted as the family it was cut for,
   and no other family may share the same of its pairs and more.
   The licence paragraphs of a block are such lines, and the whole block, once for each family
   that only windows have.

Null and empty texts have no paragraph. Every document gets a row; rows that share an id share
one result (their paragraphs together). An empty table gives an empty result, and the model is
then fitted on the templates and ``OTHER`` alone. Other columns are not read. Only paragraphs
predicted as a licence are shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import written

#: The wording of public licence notices, by family.
TEMPLATES = {
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Lesser General Public License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
UNKNOWN = "unknown"
#: Words that a window has beside a template's, words between windows (at most PAD + 1), words of a piece.
PAD, STRIDE, PIECE = 10, 8, 400
#: Own sentences that use words of licences without being one.
OTHER = [
    "The council licensed a new market under the old bridge.",
    "Version 3 of the program was released in spring.",
    "You may obtain a copy of the report at the office.",
    "The general public was free to use the hall without charge.",
    "Software of any kind may be sold with or without a warranty.",
    "This work was published by the author at the university of the city.",
    "He had permission to modify the source of the river.",
    "The conditions of the contract are met by the following persons.",
    "A driving licence is required by law in this country.",
    "The library is open to any person and free of charge.",
    "Creative work in common rooms needs attribution to no one.",
    "All rights of the holder are reserved under the terms of the treaty.",
]


def words_of(line: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(line), r"[^a-z0-9.+-]+|[.+-]+(?=[^a-z0-9]|$)|(?<![a-z0-9])[.+-]+", " ")
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Distinct word pairs."""
    return F.array_distinct(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def real_pairs(words: Column) -> Column:
    """``pairs_of`` without the last word's half pair."""
    return F.filter(pairs_of(words), lambda p: p.contains(" "))


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [(f, k, t) for f, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, template int, text string").select(
        "family", "template", words_of(F.col("text")).alias("words")).withColumn("pairs", real_pairs(F.col("words")))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line) of every non-blank line of every text."""
    lines = docs.select(docs[id_col].alias("doc_id"), F.explode(F.split(docs[text_col].cast("string"), "\n")).alias("line"))
    return lines.where(F.trim("line") != "")


def pieces(words: Column, size: int, step: int) -> Column:
    """Runs of ``size`` words, one every ``step``, up to the one that reaches the end."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + step), F.lit(step))
    return F.transform(starts, lambda i: F.slice(words, i, size))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def template_shares(words: Column, use) -> Column:
    """``use`` of the list of (family, length of the template in words, share of its pairs among the words)."""
    plain, sizes = _template_pairs(), _template_sizes()
    every = sorted({p for texts in plain.values() for pairs in texts for p in pairs})
    found = lambda w: F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                                          lambda a, b: F.concat_ws(" ", a, b)), lambda p: p.isin(every))
    of = lambda k: use([(f, sizes[f][i], F.size(F.array_intersect(F.lit(p), k)) / F.lit(float(len(p))))
                        for f, texts in plain.items() for i, p in enumerate(texts)])
    return bound(words, lambda w: bound(found(w), of))


def holds(words: Column, confirm: float) -> Column:
    """Whether some template has ``confirm`` of its pairs among the words."""
    return template_shares(words, lambda t: F.greatest(*[share for *_, share in t]) >= confirm)


def explained(pairs: Column, family: Column) -> Column:
    """Whether another family shares all pairs that this family shares with the window, and more: a part
    of a longer notice of the other family is no notice of this one."""
    plain = {f: sorted({p for pairs in texts for p in pairs}) for f, texts in _template_pairs().items()}
    shared = F.array(*[F.array_intersect(F.lit(p), pairs) for p in plain.values()])
    at = F.array_position(F.lit(list(plain)), family).cast("int") - 1
    return bound(shared, lambda all_: bound(F.get(all_, at), lambda mine: F.exists(
        all_, lambda other: (F.size(other) > F.size(mine)) & (F.size(F.array_except(mine, other)) == 0))))


def windows(words: Column, confirm: float) -> Column:
    """Windows (want, words) for the templates that have ``confirm`` of their pairs among the words."""
    def named(family: str):
        return lambda x: F.struct(F.lit(family).alias("want"), x.alias("words"))

    def cut(w: Column) -> Column:
        def for_each(t):
            none = F.array().cast("array<struct<want: string, words: array<string>>>")
            return F.concat(*[F.when(share >= confirm, F.transform(pieces(w, n + PAD, STRIDE), named(f))).otherwise(none)
                              for f, n, share in t])
        return template_shares(w, for_each)
    return bound(words, cut)


def containment(pairs: Column, families: Column | None = None) -> Column:
    """Greatest share of a template's pairs among ``pairs``, over all templates or one family's."""
    def shares(texts) -> Column:
        found = [F.size(F.array_intersect(F.lit(p), pairs)) / F.lit(float(len(p))) for p in texts if p]
        return F.greatest(*found) if len(found) > 1 else found[0]

    plain = _template_pairs()
    if families is None:
        return shares([p for texts in plain.values() for p in texts])
    out = F.lit(0.0)
    for family, texts in plain.items():
        out = F.when(families == family, shares(texts)).otherwise(out)
    return out


def _template_pairs() -> dict[str, list[list[str]]]:
    """The templates' word pairs; the same splitting as ``words_of``, on the few fixed templates."""
    import re
    out = {}
    for family, texts in TEMPLATES.items():
        out[family] = []
        for t in texts:
            w = re.sub(r"[^a-z0-9.+-]+|[.+-]+(?=[^a-z0-9]|$)|(?<![a-z0-9])[.+-]+", " ", t.lower()).split()
            out[family].append(list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:]))))
    return out


def _template_sizes() -> dict[str, list[int]]:
    """The templates' numbers of words."""
    import re
    return {f: [len(re.sub(r"[^a-z0-9.+-]+|[.+-]+(?=[^a-z0-9]|$)|(?<![a-z0-9])[.+-]+", " ", t.lower()).split()) for t in texts]
            for f, texts in TEMPLATES.items()}


def longest() -> int:
    """Words of the longest window."""
    return max(n for sizes in _template_sizes().values() for n in sizes) + PAD


class Classifier:
    """Features, fitted regression, class names and temperature."""

    def __init__(self, vocabulary: list[str], classes: list[str], model: LogisticRegressionModel | None = None,
                 temperature: float = 1.0):
        self.vocabulary, self.classes, self.model, self.temperature = vocabulary, classes, model, temperature

    def features(self, rows: DataFrame) -> DataFrame:
        """Adds ``x`` from ``words``."""
        rows = NGram(n=2, inputCol="words", outputCol="_pairs").transform(rows)
        rows = rows.withColumn("_grams", F.concat("words", "_pairs"))
        counts = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_grams", outputCol="x")
        return counts.transform(rows).drop("_pairs", "_grams")

    def scores(self, rows: DataFrame) -> DataFrame:
        """Adds ``raw``, the class scores before the temperature."""
        scored = self.model.setFeaturesCol("x").setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("").transform(
            self.features(rows))
        return scored.withColumn("raw", vector_to_array("_raw")).drop("_raw", "x")

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` (unknown included) and its calibrated ``probability``."""
        scored = self.scores(rows).withColumn("_z", F.transform("raw", lambda r: r / F.lit(self.temperature)))
        top = F.array_max("_z")
        total = F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp(z - F.array_max("_z")))
        return scored.select(*[c for c in rows.columns],
                             F.element_at(F.lit(self.classes), F.array_position("_z", top).cast("int")).alias("family"),
                             (1 / total).alias("probability"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, variants: int = 60, background: int = 4000,
          seed: int = 31) -> Classifier:
    spark = docs.sparkSession
    templates = template_rows(spark)
    vocabulary = sorted({g for row in templates.select("words", "pairs").collect() for g in [*row["words"], *row["pairs"]]})
    classes = [*sorted(TEMPLATES), UNKNOWN]
    # a bounded, hash-chosen sample: about ``background`` documents, the smallest hashes of their lines, then of the windows of these
    share = max(1, docs.count() // background)
    some = docs.where(F.pmod(F.xxhash64(F.lit(seed), docs[id_col]), F.lit(share)) == 0)
    lines = paragraphs(some, id_col, text_col).select("line", F.xxhash64(F.lit(seed), "line").alias("h"))
    lines = lines.orderBy("h", "line").limit(background).distinct().select(
        F.explode(bound(words_of(F.col("line")), lambda w: pieces(w, longest(), longest()))).alias("words")).where(F.size("words") > 0)
    sample = lines.select("words", F.xxhash64(F.lit(seed), "words").alias("h")).orderBy("h", "words").limit(background).distinct()
    sample = written(sample.withColumn("hit", containment(real_pairs(F.col("words")))).where("hit < 0.5").drop("hit"), "licence-background")
    own = spark.createDataFrame([(t,) for t in OTHER], "text string").select(words_of(F.col("text")).alias("words"))
    fill = sample.select(F.slice("words", 1, 12).alias("around"), F.row_number().over(_order()).alias("n"))
    copies = templates.select("family", "words", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("v"),
                              F.xxhash64(F.lit(seed), "family", "template").alias("t"))
    n_fill = max(1, fill.count())
    copies = copies.withColumn("n", F.pmod(F.xxhash64("t", "v"), F.lit(n_fill)) + 1).join(fill, "n", "left")
    kept = F.filter("words", lambda w, i: (F.col("v") <= 2) | (F.pmod(F.xxhash64("t", "v", i), F.lit(10)) != 0))
    before, after = F.pmod(F.col("t") + F.col("v"), F.lit(7)).cast("int"), F.pmod(F.col("t") + 3 * F.col("v"), F.lit(5)).cast("int")
    around = F.coalesce("around", F.array().cast("array<string>"))
    positive = copies.select(
        F.array_position(F.lit(classes), F.col("family")).cast("double").alias("label"),
        F.concat(F.slice(around, F.lit(1), before), kept, F.slice(around, F.lit(8), after)).alias("words"),
        F.xxhash64("t", "v", F.lit(2)).alias("h"))
    unknown = F.lit(float(len(classes))).alias("label")
    negative = sample.select(unknown, "words", "h").unionByName(
        own.select(unknown, "words", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("_k")).select(
            "label", "words", F.xxhash64("words", "_k").alias("h")))
    rows = written(positive.unionByName(negative).withColumn("label", F.col("label") - 1), "licence-training")
    held = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(5)) == 0
    out = Classifier(vocabulary, classes)
    out.model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1e-4, maxIter=60,
                                   standardization=False).fit(out.features(rows.where(~held)))
    scored = out.scores(rows.where(held))
    grid = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    losses = scored.agg(*[F.avg(_loss(t)).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    out.temperature = min((x, t) for x, t in zip(losses, grid) if x is not None)[1] if losses[0] is not None else 1.0
    return out


def _order():
    from pyspark.sql import Window
    return Window.orderBy("h")             # over the bounded sample only


def _loss(t: float) -> Column:
    """Negative log likelihood of the label at temperature t."""
    z = F.transform("raw", lambda r: r / F.lit(t))
    top = F.array_max(z)
    return top + F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))) - F.get(z, F.col("label").cast("int"))


def licensed_paragraphs(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text",
                        confirm: float = 0.6) -> DataFrame:
    """(doc_id, line, family, probability, match) of every confirmed licence paragraph; ``line`` is a
    line, or the whole block where only windows of it hold the family."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("_row"), docs[text_col].cast("string").alias("_text"))
    blocks = rows.select("doc_id", "_row", F.posexplode(F.split("_text", r"\n\s*\n")).alias("_block", "_para"))
    blocks = blocks.where(holds(words_of(F.col("_para")), confirm))
    lines = F.transform(F.split("_para", "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words")))
    cut = bound(words_of(F.col("_para")), lambda w: F.transform(pieces(w, PIECE, PIECE - longest()), lambda x: F.struct(
        F.lit(None).cast("string").alias("line"), x.alias("words"))))
    parts = blocks.select("doc_id", "_row", "_block", "_para", F.explode(F.concat(lines, cut)).alias("_part")).where(
        holds(F.col("_part.words"), confirm))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("want"), F.col("_part.words").alias("words")))
    read = parts.where(F.col("_part.line").isNull() | (F.size("_part.words") <= longest())).select(
        "doc_id", "_row", "_block", "_para", F.col("_part.line").alias("line"),
        F.explode(F.when(F.col("_part.line").isNotNull(), whole).otherwise(windows(F.col("_part.words"), confirm))).alias("_w"))
    read = read.select("doc_id", "_row", "_block", "_para", "line", F.col("_w.want").alias("want"), F.col("_w.words").alias("words"))
    read = read.where(holds(F.col("words"), confirm))
    found = model.predict(read).where((F.col("family") != UNKNOWN) & F.coalesce(F.col("want") == F.col("family"), F.lit(True)))
    found = found.withColumn("match", containment(real_pairs(F.col("words")), F.col("family"))).where(F.col("match") >= confirm)
    found = found.where(F.col("want").isNull() | ~explained(real_pairs(F.col("words")), F.col("family")))
    hit = lambda line: F.struct("probability", "match", F.col(line).alias("line"))
    per_block = found.groupBy("doc_id", "_row", "_block", "family").agg(
        F.collect_list(F.when(F.col("line").isNotNull(), hit("line"))).alias("own"), F.max(hit("_para")).alias("best"))
    return per_block.select("doc_id", "family", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("best"))).alias("x")).select(
        "doc_id", "x.line", "family", "x.probability", "x.match")


def document_licences(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text",
                      confirm: float = 0.6) -> DataFrame:
    """One row per document: doc_id, families (sorted, distinct), n_paragraphs, probability (the greatest)."""
    per_doc = licensed_paragraphs(docs, model, id_col, text_col, confirm).groupBy("doc_id", "family").agg(
        F.count(F.lit(1)).alias("n"), F.max("probability").alias("p")).groupBy(F.col("doc_id").alias("_doc")).agg(
        F.array_sort(F.collect_list("family")).alias("families"), F.sum("n").alias("n_paragraphs"), F.max("p").alias("probability"))
    rows = docs.select(docs[id_col].alias("doc_id"))
    return rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select(
        "doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), "probability")
