"""Quality classifier and toxicity grades: accuracy on held-out rows, and defined results at the edges."""

import random
import zlib

import numpy as np
import pytest

from stallwise.llm import quality_model, toxicity


def sentences(dice, n):
    return " ".join(dice.choice("of the and river stone walks slowly under morning light with seven".split()) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    dice = random.Random(11)
    docs, labels = [], []
    for i in range(500):
        text, quality, toxic = sentences(dice, 60 + i % 90), 1, 0
        if i % 5 == 0:
            text = " ".join(w + dice.choice(["$$$", "###"]) for w in text.split()) if i % 10 else text.upper().replace(" ", "!! ")
            quality = 0
        if i % 4 == 1:
            words = text.split()
            for _ in range(1 + i % 6):
                words[dice.randrange(len(words))] = dice.choice(["grobian", "Schurke!", "nitwit"])
            text, toxic = " ".join(words), 1
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 7:
            labels.append((i, quality, toxic))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(corpus):
    docs, labels, _, known = corpus
    got = {r.doc_id: r for r in quality_model.scored(docs, labels).collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    unseen = [(i, q) for i, q, _ in known if held(i)]
    assert sum(got[i].predicted == q for i, q in unseen) >= 0.97 * len(unseen)
    again = {r.doc_id: r.score for r in quality_model.scored(docs.repartition(3), labels).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in got.items())
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got.values())


def test_held_out_labels_are_not_learned_from(spark, corpus):
    docs, labels, _, known = corpus
    turned = spark.createDataFrame([(i, 1 - q if held(i) else q, t) for i, q, t in known], "doc_id long, quality int, toxic int")
    a = {r.doc_id: r.score for r in quality_model.scored(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality_model.scored(docs, turned).collect()}
    assert a == b


def test_edges_of_both_models(spark, corpus):
    docs, labels, _, _ = corpus
    odd = docs.unionByName(spark.createDataFrame(
        [(900, None, None, None, None), (901, "", None, None, None), (None, "the river", None, None, None), (902, "x " * 40000, None, None, None),
         (3, "walks", None, None, None), (3, "walks", None, None, None)], docs.schema)).selectExpr("*", "1 as score", "2 as k", "3 as label")
    scores = quality_model.scored(odd, labels).collect()
    assert len(scores) == 506 and not [r for r in scores if r.doc_id is None and r.held_out]
    assert len({r.score for r in scores if r.doc_id in (900, 901)}) == 1
    grades = toxicity.graded(odd, labels).collect()
    assert len(grades) == 506 and all(0 <= r.p_toxic <= 1 and 0 <= r.expected_severity <= 3 for r in grades)
    kept = quality_model.keep_good(odd, labels)
    assert kept.columns == odd.columns
    none, unlabelled = docs.limit(0), labels.limit(0)
    assert quality_model.scored(none, labels).count() == 0 and toxicity.graded(none, labels).count() == 0
    assert {r.predicted for r in quality_model.scored(docs, unlabelled).collect()} == {1}
    assert {r.toxic for r in toxicity.graded(docs, unlabelled).collect()} == {False}
    nulls = spark.createDataFrame([(1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality_model.scored(docs, nulls).collect()} == {1}


def test_descent_reaches_the_optimum():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    signs = np.array([1, 1, -1, -1])
    w = quality_model.dual_descent(rows, signs, np.array([1.0, 1.0, 0.5]), 3, quality_model.QualitySettings(penalty=10.0, epochs=200), 1)
    values = [w[r] @ np.array([1.0, 1.0, 0.5])[r] + w[-1] for r in rows]
    assert all(s * v >= 1 - 1e-2 for s, v in zip(signs, values))
    # the smallest weights that separate with margin one: +1 and -1 on the telling features
    assert abs(w[0] - 1) < 0.05 and abs(w[1] + 1) < 0.05 and abs(w[2]) < 0.05 and abs(w[3]) < 0.05


def test_shape():
    assert [quality_model.shape(w) for w in ("Abc12!!", "THE", "the&&&", "ÉÈé", "")] == ["Aa0!", "A", "a&", "Aa", ""]


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, texts, known = corpus
    got = {r.doc_id: r for r in toxicity.graded(docs, labels).collect()}
    unseen = [(i, t) for i, _, t in known if held(i)]
    assert sum(got[i].toxic == bool(t) for i, t in unseen) >= 0.97 * len(unseen)
    mild = np.mean([got[i].expected_severity for i in range(500) if i % 4 == 1 and i % 6 == 0 or i % 12 == 1])
    severe = np.mean([got[i].expected_severity for i in range(500) if i % 4 == 1 and i % 6 == 5])
    assert severe > mild + 0.3


def test_thresholds_are_ordered_and_shares_sum_to_one(corpus):
    docs, labels, _, _ = corpus
    model = toxicity.fit(docs, labels)
    assert all(np.diff(model.thresholds) > 0)
    shares = toxicity.grade_shares(np.linspace(-9, 9, 50), model.thresholds)
    assert np.allclose(shares.sum(axis=1), 1) and (shares > -1e-12).all()
    severity = shares @ np.arange(toxicity.GRADES)
    assert all(np.diff(severity) > 0)


def test_ordinal_fit_lowers_the_loss():
    dice = np.random.default_rng(2)
    x = dice.standard_normal(600)
    grades = np.digitize(1.5 * x + dice.logistic(size=600), [0.5, 1.5, 3.0])
    w, cuts = toxicity.ordinal_fit(np.arange(600), np.zeros(600, int), x, grades, 1, 0.0, 500)
    assert abs(w[0] - 1.5) < 0.3 and np.allclose(cuts, [0.5, 1.5, 3.0], atol=0.5)


def test_one_id_of_many_rows_is_one_training_row(spark):
    from stallwise.llm.quality_model import training_rows
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(10_000)] + [(i, "other") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    rows = training_rows(docs, labels, "quality", 100).collect()
    assert len({r.doc_id for r in rows}) == len(rows) <= 39 and 1 in {r.doc_id for r in rows}
