from __future__ import annotations

import re

import pytest

from ledgerloom.llm import licences as op

# The licence lines of the generated documents.
NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def classifier(spark, documents):
    return op.train(spark, documents)


def test_every_notice_and_nothing_else(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in op.report(documents).collect():
        named = [family for line in texts[r.doc_id].split("\n") for notice, family in NOTICES.items() if notice in line]
        assert r.families == ",".join(sorted(set(named)))
        assert (r.n_licence, r.n_unknown) == (len(named), 0)
        assert r.n_lines == texts[r.doc_id].count("\n") + 1


def brute_ngrams(text):
    words = [w.strip(".") for w in re.split(r"[^a-z0-9.\x80-\U0010ffff]+", text.lower())]
    words = [w for w in words if w]
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def like(grams, family):
    """The best (agreement, share of common n-grams) with a wording of the family."""
    if family in (op.NONE, op.UNKNOWN):
        return (0.0, 0.0)
    both = [(grams, brute_ngrams(text)) for text in op.TEMPLATES[family]]
    return max((max(len(a & b) / len(a), len(a & b) / len(b)), len(a & b) / len(a | b)) for a, b in both)


def test_scores_are_those_of_the_regression(spark, docs, classifier):
    """Probability, agreement and decision, computed plainly from the fitted coefficients."""
    import numpy as np

    lines = [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the Apache license, version 2.0",
        "Released under the license of our company",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "All rights reserved by the publisher of this software",
        "nothing of the kind here",
    ]
    found = {r.paragraph // 2: r for r in op.scan(docs([(1, "\n\n".join(lines))]), classifier).collect()}
    vocabulary = {gram: i for i, gram in enumerate(classifier.vocabulary.vocabulary)}
    coefficients, intercept = classifier.model.coefficientMatrix.toArray(), classifier.model.interceptVector.toArray()
    for number, line in enumerate(lines):
        grams = brute_ngrams(line)
        x = np.zeros(len(vocabulary))
        x[[vocabulary[g] for g in grams if g in vocabulary]] = 1
        x /= max(np.sqrt(x @ x), 1e-9)
        logits = coefficients @ x + intercept
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best, *rivals = [classifier.families[i] for i in np.argsort(-p, kind="stable")[: 1 + op.RIVALS]]
        if number not in found:
            assert best == op.NONE or sum(g.count(" ") == 1 and g in vocabulary for g in grams) < 2
            continue
        r = found[number]
        assert r.predicted == best and abs(r.probability - p.max()) < 1e-6
        own, *others = [like(grams, family) for family in (best, *rivals)]
        assert best == op.UNKNOWN or abs(r.agreement - own[0]) < 1e-9
        least = next((least for agreement, least in classifier.thresholds if own[0] >= agreement), 2)
        accepted = best != op.UNKNOWN and p.max() >= least and own > max(others)
        assert r.family == (best if accepted else op.UNKNOWN)
    assert {found[i].family for i in (0, 1, 3)} == {"GPL-3.0", "Apache-2.0", "MIT"}


# Files as they are shipped: wrapped lines, comment marks, a copyright line; and licences of no known family.
WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "ISC": """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "GPL-2.0": """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.""",
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "LGPL": """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
// version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """ * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    op.UNKNOWN: """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.""",
}


def test_wrapped_texts_name_their_family_alone(docs, classifier):
    """Every paragraph of a wrapped text is one row of its family; other licences are named by none."""
    rows = op.scan(docs(list(enumerate(WRAPPED.values()))), classifier).collect()
    for i, family in enumerate(WRAPPED):
        own = [r for r in rows if r.doc_id == i]
        assert {r.family for r in own} == {family} and all(r.part == 0 for r in own), family
        assert len({r.paragraph for r in own}) == len(own)
    licence = [r for r in rows if r.doc_id == list(WRAPPED).index("MIT")]
    assert len(licence) == 3


def test_a_notice_between_wrapped_lines_is_found(docs, classifier):
    """The paragraph as a whole is ordinary text, or one licence; its notice is found either way."""
    ordinary = "the river runs past the old mill and the children play along the bank all day"
    text = "\n".join([ordinary, ordinary, "some more about the mill, which is Licensed under the ISC License", ordinary])
    found = op.scan(docs([(1, text)]), classifier).collect()
    assert [r.family for r in found] == ["ISC"]


def test_families_left_out_of_training_are_mostly_unknown(spark, documents, classifier):
    """Wordings of a family no model has seen are accepted as another one only in a few cases."""
    rows = op.stored(op.training_set(spark, documents), "licence-test")
    unseen = ["MIT", "MPL-2.0", "Unlicense", "EPL-2.0"]
    trial = op._fitted(rows, [family for family in classifier.families if family not in unseen])
    trial.thresholds = classifier.thresholds
    whole = rows.where(rows["family"].isin(unseen) & (rows["variant"] == 0))
    assert trial.compared(trial.predicted(whole)).where(trial.accepted()).count() <= 1
    assert whole.count() > 15


def test_background_texts_are_drawn_from_all_rows(spark, docs):
    """As many as asked for, whatever the ids; fewer rows are all taken."""
    many = docs([(None if i % 3 else i, f"text {i}") for i in range(6000)])
    drawn = op._drawn(many)
    assert drawn.count() == op.BACKGROUND
    every = sorted(r.h for r in many.selectExpr("xxhash64(doc_id, text) AS h").collect())
    assert sorted(r.drawn for r in drawn.collect()) == every[: op.BACKGROUND]
    assert op._drawn(docs([(1, None), (1, "a")])).count() == 2


SHORT = [
    "MIT License", "Apache License", "Version 2.0, January 2004", "ISC License", "GPL v3", "BSD 2-Clause License",
    "Licensed under MIT", "License: Apache-2.0", "License: GPL-3.0", "Released under MIT.", "Proprietary license",
]


def test_lines_with_one_known_pair_are_judged(spark, docs, classifier):
    """Every line with a known n-gram gets the regression's class, however few it has."""
    table = docs([(i, line) for i, line in enumerate(SHORT)])
    lines = table.select("doc_id", op.ngrams(op.words_of(table["text"])).alias("grams"))
    expected = {r.doc_id: r.predicted for r in classifier.predicted(lines).collect()}
    vocabulary = set(classifier.vocabulary.vocabulary)
    known = {i for i, line in enumerate(SHORT) if brute_ngrams(line) & vocabulary}
    found = {r.doc_id: r for r in op.scan(table, classifier).collect()}
    assert {i: r.predicted for i, r in found.items()} == {i: expected[i] for i in known if expected[i] != op.NONE}
    families = [found[i].family if i in found else None for i in range(len(SHORT))]
    assert families == [
        "MIT", "Apache-2.0", "Apache-2.0", "ISC", "GPL-3.0", "BSD", "MIT", "Apache-2.0", "GPL-3.0", "MIT", op.UNKNOWN
    ]


def test_edges(docs):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, notice), (4, f"x\n{notice}\n{notice}"), (4, f"x\n{notice}\n{notice}"), (5, "a " * 50000)]
    found = sorted([tuple(r) for r in op.report(docs(rows, clashing=True)).collect()], key=str)
    assert found == sorted(
        [(1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 3, 0, 0, ""), (None, 1, 1, 0, "MIT"), (4, 3, 2, 0, "MIT"), (4, 3, 2, 0, "MIT"), (5, 1, 0, 0, "")],
        key=str,
    )
    assert op.report(docs([])).count() == 0


def test_no_python_in_the_plan(documents, classifier):
    plan = op.scan(documents, classifier)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
