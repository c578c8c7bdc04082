from __future__ import annotations

import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality, toxicity
from ledgerloom.llm.learning import held_out

# Large enough to hold some hundred toxic documents.
FOLDER = "/root/testdata/sf0.1"


def auc(scores, labels):
    """Share of (positive, negative) pairs in the right order; ties count half."""
    scores, labels = np.asarray(scores, float), np.asarray(labels)
    values, where, count = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[where]
    positive = int((labels == 1).sum())
    return (rank[labels == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(labels) - positive))


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


@pytest.mark.parametrize("op,label,modulus,remainder,least", [(quality, "quality", 4, 2, 0.97), (toxicity, "toxic", 3, 1, 0.9)])
def test_held_out_documents(tables, op, label, modulus, remainder, least):
    documents, labels = tables
    found = op.report(documents, labels).toPandas()
    assert len(found) == documents.count()
    assert found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    marks = [zlib.crc32(str(i).encode()) % modulus == remainder for i in found.doc_id]
    assert (found.held_out == marks).all()
    judged = found.merge(labels.toPandas(), on="doc_id")
    judged = judged[judged.held_out & judged[label].notna()]
    assert auc(judged.score, judged[label]) >= least
    assert (judged.predicted == judged[label]).mean() >= 0.97


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, docs, op, label):
    rows = [(1, None), (2, ""), (3, "  "), (None, "text"), (4, "some words " * 5000), (4, "some words " * 5000), (5, "\x00 � é")]
    table = docs(rows, clashing=True)
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 0), (77, 0, 1), (3, 1, 1)], schema)
    for known in (labels, labels.limit(0)):
        found = op.report(table, known).toPandas()
        assert len(found) == len(rows)
        assert found.score.between(0, 1).all()
        assert found[found.doc_id == 4].score.nunique() == 1
        blank = found[found.doc_id.isin([1, 2, 3])].score
        assert blank.max() - blank.min() < 1e-9
        assert not found[found.doc_id.isna()].held_out.any()
    assert op.report(docs([]), labels).count() == 0


def test_interactions_are_the_sum_over_pairs():
    random = np.random.default_rng(0)
    width = 7
    machine = quality.Machine(0.3, random.normal(size=width), random.normal(size=(width, 3)), np.zeros(width), np.ones(width))
    x = random.normal(size=(4, width))
    pairs = [
        sum(machine.factors[i] @ machine.factors[j] * row[i] * row[j] for i in range(width) for j in range(i))
        for row in x
    ]
    assert np.allclose(machine.logits(x), 0.3 + x @ machine.weights + pairs)


def test_quality_filter_keeps_columns(tables):
    documents, labels = tables
    kept = quality.keep_good(documents, labels)
    scores = quality.report(documents, labels).toPandas().set_index("doc_id").score
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == documents.columns
    assert ids == set(scores[scores >= 0.7].index)


def test_metadata_takes_part_in_training(spark):
    rows = [(i, f"the same words {i % 3}", "good" if i % 2 else "bad") for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    machine = quality.train(documents, labels, metadata=("source",))
    scores = {r.doc_id: r.quality_score for r in quality.score(documents, machine, ("source",)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    kept = quality.keep_good(documents, labels, 0.5, metadata=("source",))
    assert kept.columns == documents.columns and {r.doc_id % 2 for r in kept.collect()} == {1}


def test_disguised_insults(tables):
    documents, labels = tables
    machine = toxicity.train(documents, labels)
    margins = dict(zip(("idiot", "stuupid", "weather"), (m for m, _ in machine.margins(["idiot", "stuupid", "weather"]))))
    assert margins["idiot"] > 0.5 and margins["stuupid"] > 0 > margins["weather"]
    scorer = toxicity.Scorer(machine)
    spelled = scorer.traits(["an idiot", "an i d i o t", "an i.d-i_o.t", "AN IDIOT!!"])
    assert np.ptp(spelled[:, 0]) < 0.2


@pytest.mark.parametrize(
    "spelled",
    ["i d i o t", "i, d, i, o, t", "i- d- i- o- t", "i.d-i o t", "i. d. i. o. t", "i_d i_o t", "an i-d i-o-t!", "(I.D I.O T)"],
)
def test_spelled_out_words_are_joined(spelled):
    assert "idiot" in toxicity.units(f"you are {spelled}")
    assert "scum" in toxicity.units("s-c u-m")


def test_kernel_feature_map_is_exact():
    """Hashing aside, inner products are the gap-weighted counts of common subsequences."""
    from itertools import combinations

    def subsequences(word):
        out = {}
        marked = f"\x02{word}\x03"
        for i, j, k in combinations(range(len(marked)), 3):
            if k - i <= toxicity.SPAN:
                key = marked[i] + marked[j] + marked[k]
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    for a, b in [("idiot", "idxiot"), ("moron", "motion"), ("a", "a"), ("ab", "xyz")]:
        x, y = subsequences(a), subsequences(b)
        norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        exact = sum(v * y.get(k, 0) for k, v in x.items()) / norm
        left, right = toxicity.feature_map([f"\x02{a}\x03", f"\x02{b}\x03"])
        assert abs(float(left @ right) - exact) < 0.1


def test_held_out_mark(spark):
    rows = spark.createDataFrame([(1,), (None,), (-5,)], "doc_id long").select("doc_id", held_out(rows_id(), 3, 1).alias("h"))
    assert {r.doc_id: r.h for r in rows.collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, -5)} | {None: False}


def rows_id():
    from pyspark.sql import functions as F

    return F.col("doc_id")
