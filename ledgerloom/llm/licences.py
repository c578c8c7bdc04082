"""Licence scans: a trained paragraph classifier, confirmed by comparing with templates.

A paragraph is a line of a document, or lines that were wrapped: a line of 50 to 90
characters that ends no sentence goes on in the next one. Its features are word n-grams
of two and three words; a sparse multinomial logistic regression over the n-grams of the
licence texts tells the families apart, with one class for ordinary text and one for
licence talk that names no known licence. A family is accepted if its probability reaches
a threshold, lower for wordings all but equal to a template, if the paragraph and some template of the family contain most of each other's
n-grams one way or the other, and if no template of the two families next in probability
agrees as well; otherwise the paragraph counts as an unknown licence. Both thresholds are
calibrated on variants held out of training and on whole families left out of it, which
should not be named at all. If a wrapped paragraph names no licence as a whole, its lines
are judged one by one, as a notice may stand between lines of ordinary text.

Everything is DataFrame code and Spark's own estimators; no Python runs on the executors.
The texts are scanned once: each pair of words is looked up in the vocabulary (some
thousand hashes), and every paragraph with a hit is judged by the regression where it is
read; only those that are not ordinary text are kept. The training set is bounded: the
templates, their variants, and the lines of ``BACKGROUND`` documents, drawn by hash.

Defined cases: null and empty texts have no paragraphs; lines without words are none;
null doc_ids and repeated rows give one result each; equal probabilities go to the family
first in the alphabet, equal templates to the first listed, and a paragraph that agrees with
two families alike is unknown; an empty table gives no rows, and a table without ordinary
text trains on the templates alone. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ascii_lower, stored, text_key

BACKGROUND = 400
VARIANTS = 8
HELD_OUT = 2  # of the variants, so many calibrate the threshold
PRECISION = 0.95
CONTAINED = 0.6
VERBATIM = 0.95  # from this agreement on, the threshold is one of its own
MOST_FEATURES = 20_000
FOLDS = 2  # each known family is left out of one of so many trial models
RIVALS = 2  # families compared beside the predicted one

# A line that goes on in the next one, which has a word; the mark that replaces its end.
WRAPPED = r"(?md)^([^\n]{49,89}[^\n.!?:\s])[ \t\r]*+\n(?=[ \t#/*;>|-]*+[A-Za-z0-9\"'(<])"
MARK = "\x0b"

NONE, UNKNOWN = "none", "unknown"

# Wordings of public licences, their title lines and the notices that name them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed '
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License",
        "Version 2.0, January 2004",
        "License: Apache-2.0",
        "Licensed under Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "License: MIT",
        "Licensed under MIT",
        "Released under MIT.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "License: BSD-3-Clause",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "ISC License",
        "License: ISC",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "GPL v2",
        "License: GPL-2.0",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPL v3",
        "License: GPL-3.0",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "License: LGPL-3.0",
    ),
    "AGPL-3.0": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "License: AGPL-3.0",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    UNKNOWN: (
        "Licensed under the terms of a licence agreement with the publisher.",
        "All rights reserved. No part of this work may be reproduced without written permission of the copyright holder.",
        "This software is distributed under a proprietary license.",
        "Released under the license that can be found in the LICENSE file.",
        "This work is licensed under terms to be agreed.",
        "Use of this material is subject to the terms of service of the provider.",
        "SPDX-License-Identifier: LicenseRef-Other",
        "Proprietary license",
    ),
}


def words_of(text: Column) -> Column:
    """Lower-case words with their dots and digits, so that versions stay whole."""
    split = F.split(ascii_lower(text), r"[^a-z0-9.\x80-\x{10FFFF}]+")
    return F.filter(F.transform(split, lambda word: F.trim(word, F.lit("."))), lambda word: word != "")


def ngrams(words: Column) -> Column:
    """Pairs and triples of neighbouring words, of the two or three words of a short text at least one."""
    pairs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda word, i: F.concat_ws(" ", word, F.get(words, i + 1)),
    )
    triples = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda word, i: F.concat_ws(" ", word, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.concat(pairs, triples)


def templates(spark: SparkSession) -> DataFrame:
    """(template, family, words): every wording under its number."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    listed = F.array(*[F.struct(F.lit(family).alias("family"), F.lit(text).alias("text")) for family, text in rows])
    return (
        spark.range(1)
        .select(F.posexplode(listed).alias("template", "row"))
        .select("template", "row.family", words_of(F.col("row.text")).alias("words"))
    )


def rejoined(text: Column) -> Column:
    """The text with the ends of wrapped lines replaced by a mark."""
    return F.regexp_replace(text, WRAPPED, "$1" + MARK)


def _drawn(documents: DataFrame) -> DataFrame:
    """The ``BACKGROUND`` texts of smallest hash.

    A bound on the hash, from the number of rows, leaves some thousands to be ordered, so
    that no task is sent many texts by each of the others. The hash covers the text too, as one
    doc_id may be that of many rows.
    """
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("drawn"))
    share = 4 * BACKGROUND / max(documents.count(), 1)
    if share < 1:
        rows = rows.where(F.col("drawn") < F.lit(int(-(2**63) + share * 2**64)))
    return rows.orderBy("drawn").limit(BACKGROUND)


def training_set(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(family, variant, grams): templates, their variants, and background lines.

    Variant 0 is the whole wording; the others lose about every ninth word, as told by
    hashes, so that every run gets the same ones, and some keep one half of a long wording.
    """
    whole = templates(spark)
    numbered = whole.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS))))
    lost = F.filter(
        "words",
        lambda word, i: (F.col("variant") == 0)
        | (F.size("words") < 5)
        | (F.pmod(F.xxhash64("template", "variant", i), F.lit(9)) > 0),
    )
    half = F.ceil(F.size(lost) / 2).cast("int")
    long, part = F.size(lost) >= 16, F.col("variant") % 4
    begin = F.when(long & (part == 3), half).otherwise(1)
    length = F.when(long & part.isin(1, 3), half).otherwise(F.size(lost))
    variants = numbered.withColumn("kept", F.slice(lost, begin, length))
    known = whole.select(F.explode(ngrams(F.col("words"))).alias("gram")).distinct()
    drawn = stored(_drawn(documents), "licence-background").repartition(8)
    lines = (
        drawn.select(F.explode(F.split(rejoined(F.coalesce("text", F.lit(""))), "\n")).alias("line"))
        .select(words_of(F.col("line")).alias("words"))
        .where(F.size("words") > 1)
        .select(ngrams(F.col("words")).alias("grams"))
        .distinct()
        .withColumn("line", F.xxhash64("grams"))
    )
    lines = stored(lines, "licence-lines")
    # A background line with several n-grams of a licence is one, or close to it.
    told = lines.select("line", F.explode("grams").alias("gram")).join(F.broadcast(known), "gram").groupBy("line")
    licensed = told.agg(F.count("*").alias("n")).where("n > 3")
    background = lines.join(licensed, "line", "left_anti").select(
        F.lit(NONE).alias("family"), (F.pmod(F.col("line"), F.lit(VARIANTS)) + 1).cast("int").alias("variant"), "grams"
    )
    return variants.select("family", "variant", ngrams(F.col("kept")).alias("grams")).union(background)


def _featured(vocabulary: CountVectorizerModel, rows: DataFrame) -> DataFrame:
    """Unit vectors of the n-grams, so that a part of a long wording counts like a short one."""
    return Normalizer(inputCol="counts", outputCol="features").transform(vocabulary.transform(rows))


class Classifier:
    """The fitted vocabulary and regression, the families in order, and the thresholds.

    ``thresholds`` lists (least agreement, least probability), the greatest agreement first.
    """

    def __init__(self, vocabulary: CountVectorizerModel, model: LogisticRegressionModel, families: list[str]):
        self.vocabulary, self.model, self.families = vocabulary, model, families
        self.thresholds = [(VERBATIM, 0.5), (CONTAINED, 0.5)]

    def accepted(self) -> Column:
        """Of compared rows: whether the predicted family is accepted."""
        least = F.lit(None).cast("double")
        for agreement, probability in reversed(self.thresholds):
            least = F.when(F.col("agreement") >= agreement, F.lit(probability)).otherwise(least)
        return (F.col("predicted") != UNKNOWN) & F.col("confirmed") & F.coalesce(F.col("probability") >= least, F.lit(False))

    def predicted(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``grams``), their class, its ``probability``, and the ``rivals`` next to it."""
        scored = self.model.transform(_featured(self.vocabulary, rows))
        ranked = F.array_sort(
            F.zip_with(
                vector_to_array("probability"),
                F.array(*map(F.lit, self.families)),
                lambda p, family: F.struct((-p).alias("p"), family.alias("family")),
            )
        )
        best = F.get("_ranked", F.lit(0))
        return (
            scored.withColumn("_ranked", ranked)
            .drop("counts", "features", "rawPrediction", "probability", "prediction")
            .withColumns(
                {
                    "predicted": best["family"],
                    "probability": -best["p"],
                    "rivals": F.transform(F.slice("_ranked", 2, RIVALS), lambda one: one["family"]),
                }
            )
            .drop("_ranked")
        )

    def compared(self, judged: DataFrame) -> DataFrame:
        """Rows with ``grams``: adds ``agreement`` with the predicted family's wording ``template``, and ``confirmed``.

        The wordings are one row per family, met by the predicted family and its rivals.
        """
        known = (
            templates(judged.sparkSession)
            .where((F.col("family") != UNKNOWN) & F.col("family").isin(self.families))
            .groupBy("family")
            .agg(F.collect_list(F.struct("template", F.array_distinct(ngrams(F.col("words"))).alias("grams"))).alias("wordings"))
        )
        rows = judged.withColumn("_grams", F.array_distinct("grams"))

        def likeness(wording: Column) -> Column:
            common = F.size(F.array_intersect("_grams", wording["grams"]))
            own, other = F.size("_grams"), F.size(wording["grams"])
            return F.struct(
                F.greatest(common / own, common / other).alias("agreement"),
                (common / (own + other - common)).alias("shared"),
                (-wording["template"]).alias("order"),
            )

        for place in range(RIVALS + 1):
            family = F.col("predicted") if place == 0 else F.get("rivals", F.lit(place - 1))
            side = known.select(F.col("family").alias("_family"), F.col("wordings").alias("_wordings"))
            rows = (
                rows.join(F.broadcast(side), family == F.col("_family"), "left")
                .withColumn(f"_like{place}", F.array_max(F.transform("_wordings", likeness)))
                .drop("_family", "_wordings")
            )
        best = F.col("_like0")
        rival = F.array_max(
            F.array(*[F.struct(f"_like{place}.agreement", f"_like{place}.shared") for place in range(1, RIVALS + 1)])
        )
        ahead = F.struct("_like0.agreement", "_like0.shared") > rival
        return rows.withColumns(
            {
                "agreement": F.coalesce(best["agreement"], F.lit(0.0)),
                "template": -best["order"],
                "confirmed": F.coalesce((best["agreement"] >= CONTAINED) & ahead, F.lit(False)),
            }
        ).drop("_grams", *[f"_like{place}" for place in range(RIVALS + 1)])


def _fitted(rows: DataFrame, families: list[str]) -> Classifier:
    """A model of these classes alone, with the vocabulary of their wordings."""
    spark = rows.sparkSession
    label = reduce(
        lambda column, pair: F.when(F.col("family") == pair[1], float(pair[0])).otherwise(column),
        enumerate(families),
        F.lit(None).cast("double"),
    )
    fitted_on = rows.where((F.col("variant") <= VARIANTS - HELD_OUT) & F.col("family").isin(families)).withColumn("label", label)
    # Ordinary lines are many; together they weigh a quarter of all the licences, so that a
    # line that shares several n-grams with a licence is not taken for one of them.
    n_none = fitted_on.where(F.col("family") == NONE).count()
    share = fitted_on.where(F.col("family") != NONE).count() / max(n_none, 1) / 4
    weight = F.when(F.col("family") == NONE, F.lit(share)).otherwise(F.lit(1.0))
    fitted_on = fitted_on.withColumn("weight", weight)
    known = (
        templates(spark)
        .where(F.col("family").isin(families))
        .select(F.lit("").alias("family"), ngrams(F.col("words")).alias("grams"))
    )
    vocabulary = CountVectorizer(inputCol="grams", outputCol="counts", binary=True, vocabSize=MOST_FEATURES).fit(known)
    regression = LogisticRegression(
        family="multinomial", regParam=0.0001, maxIter=40, standardization=False, weightCol="weight"
    )
    model = regression.fit(_featured(vocabulary, fitted_on).select("label", "weight", "features"))
    return Classifier(vocabulary, model, families)


def _named(classifier: Classifier, rows: DataFrame) -> DataFrame:
    """(agreement, probability, right) of the rows that are given a family and confirmed."""
    judged = classifier.predicted(rows.where(F.size("grams") > 0)).where(~F.col("predicted").isin(NONE, UNKNOWN))
    return classifier.compared(judged).where("confirmed").select(
        "agreement", "probability", (F.col("predicted") == F.col("family")).cast("int").alias("right")
    )


def train(spark: SparkSession, documents: DataFrame) -> Classifier:
    """Fit on the bounded training set; calibrate on what was held out of it.

    The wordings of a family that a trial model has never seen should be accepted as none
    of the others, so each one that is counts as wrong.
    """
    # Few rows, read by every step of three fits: in few files.
    rows = stored(training_set(spark, documents).repartition(4), "licence-training")
    families = sorted(row["family"] for row in rows.select("family").distinct().collect())
    classifier = _fitted(rows, families)
    named = _named(classifier, rows.where(F.col("variant") > VARIANTS - HELD_OUT))
    left = [family for family in families if family not in (NONE, UNKNOWN)]
    for fold in range(FOLDS):
        unseen = left[fold::FOLDS]
        trial = _fitted(rows, [family for family in families if family not in unseen])
        named = named.union(_named(trial, rows.where(F.col("family").isin(unseen) & (F.col("variant") == 0))))
    # Per range of agreement, the lowest threshold from which on nearly all accepted ones are right.
    steps = [step / 20 for step in range(6, 20)]
    verbatim = F.col("agreement") >= VERBATIM
    above = [F.avg(F.when(F.col("probability") >= step, F.col("right"))).alias(f"at{i}") for i, step in enumerate(steps)]
    rates = {row["verbatim"]: row for row in named.groupBy(verbatim.alias("verbatim")).agg(*above).collect()}

    def least(row) -> float:
        right = [step for i, step in enumerate(steps) if row is not None and (row[f"at{i}"] or 0) >= PRECISION]
        return right[0] if right else steps[-1]

    classifier.thresholds = [(VERBATIM, least(rates.get(True))), (CONTAINED, least(rates.get(False)))]
    return classifier


def paragraphs(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, paragraph, part, words, grams): the paragraphs with any n-gram of the vocabulary.

    Part 0 is the whole paragraph; the lines of a wrapped one follow as parts from 1.
    A known triple holds two known pairs, so pairs tell. The pairs of all templates, some
    thousand hashes whatever the documents are, become a set in the plan, so paragraphs are
    judged where they are read and nothing is shuffled.
    """
    pairs = templates(spark).select(F.explode(ngrams(F.col("words"))).alias("gram")).where(
        F.size(F.split("gram", " ")) == 2
    )
    keys = sorted({row["key"] for row in pairs.select(F.xxhash64("gram").alias("key")).collect()})
    whole = documents.select(
        "doc_id",
        text_key(F.col("text")).alias("text_key"),
        F.posexplode_outer(F.split(rejoined(F.col("text")), "\n")).alias("paragraph", "text"),
    ).withColumn("words", words_of(F.col("text")))
    hits = F.filter(
        F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b))),
        lambda key: key.isin(keys),
    )
    lines = F.split("text", MARK)
    wrapped = F.when(F.size(lines) > 1, F.transform(lines, words_of)).otherwise(F.array().cast("array<array<string>>"))
    # Generating the words of paragraphs with hits, and null for others, keeps the condition
    # from being pushed down, where it would split every paragraph again.
    judged = F.when(F.size(hits) > 0, F.concat(F.array("words"), wrapped))
    return (
        whole.select("doc_id", "text_key", "paragraph", F.posexplode_outer(judged).alias("part", "words"))
        .where(F.size("words") > 1)
        # Spark may count n-grams before it applies the condition; null is none of them.
        .withColumn("grams", F.coalesce(ngrams(F.col("words")), F.array().cast("array<string>")))
    )


def scan(documents: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, text_key, paragraph, part, words, predicted, probability, family, template, agreement) per licence
    paragraph.

    ``family`` is the confirmed one or ``unknown``; ``template`` the wording most like the
    paragraph and ``agreement`` the share of n-grams one of both has of the other. ``part``
    is 0, or the number of the line (from 1) if a wrapped paragraph is none as a whole.
    """
    spark = documents.sparkSession
    classifier = classifier or train(spark, documents)
    keys = ["doc_id", "text_key", "paragraph"]
    judged = classifier.predicted(paragraphs(spark, documents)).where(F.col("predicted") != NONE)
    judged = stored(judged.drop("grams"), "licence-paragraphs")
    found = ["part", "words", "predicted", "probability", "family", "template", "agreement"]
    compared = classifier.compared(judged.withColumn("grams", ngrams(F.col("words")))).withColumn(
        "family", F.when(classifier.accepted(), F.col("predicted")).otherwise(F.lit(UNKNOWN))
    )
    # A paragraph's parts are no more than its lines: the named whole, else named lines, else the
    # unknown whole, else unknown lines. Repeated rows of one document fall together.
    parts = compared.groupBy(*keys).agg(F.collect_set(F.struct(*found)).alias("parts"))
    named = F.filter("parts", lambda one: one["family"] != UNKNOWN)

    def first_of(column: Column) -> Column:
        whole = F.filter(column, lambda one: one["part"] == 0)
        return F.when(F.size(whole) > 0, whole).otherwise(column)

    chosen = F.when(F.size(named) > 0, first_of(named)).otherwise(first_of(F.col("parts")))
    return parts.select(*keys, F.explode(chosen).alias("one")).select(*keys, "one.*")


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_licence, n_unknown, families) per document row.

    ``families`` are the confirmed ones, sorted and comma-joined.
    """
    found = scan(documents).groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_licence"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.array_join(
            F.sort_array(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ","
        ).alias("families"),
    )
    found = found.toDF("_doc_id", "_text_key", "n_licence", "n_unknown", "families")
    rows = documents.select(
        "doc_id",
        text_key(F.col("text")).alias("text_key"),
        F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"),
    )
    same = rows["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        F.coalesce("families", F.lit("")).alias("families"),
    )
