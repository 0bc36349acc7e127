import math

import numpy as np

from tallyloom.llm import quality_ordinal as Q
from tallyloom.llm.queries import QUERIES, ratings


def test_slopes_are_the_derivatives_of_the_likelihood():
    cuts, scores = np.array([-0.5, 1.2]), np.array([0.3, -1.0, 2.5])
    grade = np.array([1, 0, 2])

    def likelihood(s, c):
        below = 1 / (1 + np.exp(s[:, None] - c))
        upto = np.concatenate([np.zeros((3, 1)), below, np.ones((3, 1))], axis=1)
        return np.log(upto[np.arange(3), grade + 1] - upto[np.arange(3), grade]).sum()

    by_score, by_cut = Q._slopes(scores, grade, cuts)
    for i in range(3):
        d = np.eye(3)[i] * 1e-6
        assert math.isclose((likelihood(scores + d, cuts) - likelihood(scores - d, cuts)) / 2e-6, by_score[i], abs_tol=1e-5)
    for k in range(2):
        d = np.eye(2)[k] * 1e-6
        assert math.isclose((likelihood(scores, cuts + d) - likelihood(scores, cuts - d)) / 2e-6, by_cut[k], abs_tol=1e-5)


def test_thresholds_are_ordered_and_grades_add_up():
    model = Q.OrdinalModel(np.zeros(1 << Q.BITS), np.array([-1.0, 0.0, 2.0]))
    expected, tails = model.grades(np.array([-3.0, 0.0, 3.0]))
    assert np.all(np.diff(tails, axis=1) < 0) and np.allclose(tails.sum(axis=1), expected) and np.all(np.diff(expected) > 0)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rated = ratings(spark, folder)
    train, held = rated.where("doc_id % 5 <> 0"), rated.where("doc_id % 5 = 0")
    model = Q.learn(docs.join(train.select("doc_id"), "doc_id"), train, 3)
    assert np.all(np.diff(model.thresholds) > 0)
    rows = Q.graded(docs, model).join(held, "doc_id").collect()
    kept = {g: np.mean([r.tails[1] >= Q.LEAST for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert kept[0] < 0.05 and kept[1] < 0.25 and kept[2] > 0.95, kept


def test_query_rejects_labelled_junk(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_quality_ordinal"](spark, folder).collect()}
    grades = {r.doc_id: r.grade for r in ratings(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert np.mean([got[i].keep for i, g in grades.items() if g == 2]) > 0.98
    assert np.mean([got[i].keep for i, g in grades.items() if g < 2]) < 0.1
    assert all(r.p_sound >= r.p_good and abs(r.p_sound + r.p_good - r.expected_grade) < 1e-9 for r in got.values())


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x " * 100_000, 1), (4, "good words here", 1), (4, "good words here", 1), (None, "good words", 1)], "doc_id long, text string, grade int")
    none = spark.createDataFrame([], "doc_id long, grade int")
    odd = spark.createDataFrame([(4, 1), (4, 0), (3, 7), (2, None), (None, 1)], "doc_id long, grade int")
    for rated in (none, odd):
        model = Q.learn(docs, rated, 3)
        assert Q.graded(docs, model).count() == 6
        kept = Q.selected(docs, model, 2, 0.0)
        assert kept.count() == 6 and kept.columns == docs.columns
        assert Q.selected(docs.limit(0), model, 2).count() == 0
