import math

import numpy as np

from tallyloom.llm import cross_polytope as X
from tallyloom.llm.queries import QUERIES


def exact(ids, rows, query, top):
    score = rows @ rows[query]
    order = [i for i in np.lexsort((ids, -score)) if i != query][:top]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_rotation_keeps_lengths():
    rows = np.random.default_rng(1).normal(size=(5, 48))
    for turn in range(3):
        assert np.allclose(np.linalg.norm(X.rotated(rows, turn, 7), axis=1), np.linalg.norm(rows, axis=1))
    assert X.axes(np.eye(4), 0, 7, 8).shape == (4, 8)


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    data = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, rows = data.vec_id.to_numpy(), np.stack(data.embedding.to_numpy()).astype(float)
    got = {}
    for r in QUERIES["op4_cross_polytope"](spark, folder).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for query, found in got.items():
        at = int(np.flatnonzero(ids == query)[0])
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        want = exact(ids, rows, at, 20)
        hits += len({i for i, _ in want} & {r.vec_id for r in found})
    assert hits / (20 * len(got)) >= 0.9


def test_copies_ties_and_rows_that_take_no_part(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(size=8)], 0) for i in range(40)]
    rows += [(i, [1.0] * 8, 0) for i in range(100, 160)]  # equal vectors, queries among them
    rows += [(200, None, 0), (220, [0.0] * 8, 0), (240, [1.0, None] + [1.0] * 6, 0), (260, [math.nan] * 8, 0), (280, [math.inf] * 8, 0), (300, [1.0] * 3, 0), (None, [1.0] * 8, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    got = {}
    for r in X.nearest(frame, "vec_id % 20 = 0", top=20, probes=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    sound = [(i, v) for i, v, _ in rows[:100]]
    ids, matrix = np.array([i for i, _ in sound]), np.array([v for _, v in sound])
    assert set(got) == {0, 20, 100, 120, 140}
    for query, found in got.items():  # with all axes probed the search is exact
        want = exact(ids, matrix, int(np.flatnonzero(ids == query)[0]), 20)
        found.sort()
        assert [v for _, v, _ in found] == [i for i, _ in want]
        assert np.allclose([s for _, _, s in found], [s for _, s in want], atol=1e-12)


def test_small_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    found = X.nearest(frame, "vec_id % 20 = 0", probes=4).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 2, 3.0), (0, 1, 0.5)]
    assert X.nearest(frame.limit(0), "vec_id % 20 = 0").count() == 0
    assert X.nearest(frame.where("vec_id > 0"), "vec_id % 20 = 0").count() == 0


def found_and_wanted(spark, rows, queries="vec_id % 20 = 0"):
    """For each query the rows that ``nearest`` gives with its own defaults, and those of brute force."""
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: [] for r in frame.where(queries).collect()}
    for r in sorted(X.nearest(frame, queries).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    ids = np.arange(len(rows))
    return got, {q: [i for i, _ in exact(ids, rows, q, 20)] for q in got}


def test_recall_with_mixed_lengths_and_one_outlier(spark):
    random = np.random.default_rng(11)
    unit = random.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    mixed, outlier = unit * random.uniform(0.5, 1.5, (3000, 1)), unit.copy()
    mixed[7] *= 100
    outlier[7] *= 100
    for rows in (mixed, outlier):
        got, want = found_and_wanted(spark, rows)
        assert all(len(found) == 20 for found in got.values())
        assert sum(len(set(got[q]) & set(want[q])) for q in got) / (20 * len(got)) >= 0.9


def test_every_query_gets_its_rows_with_the_default_parameters(spark):
    random = np.random.default_rng(12)
    got, want = found_and_wanted(spark, random.normal(size=(15, 64)), "true")
    assert got == want
    got, want = found_and_wanted(spark, random.normal(size=(30, 64)), "true")
    assert all(len(v) == 20 for v in got.values()) and sum(len(set(got[q]) & set(want[q])) for q in got) / 600 >= 0.9
    # two clusters opposite to each other: the few rows of the smaller one do not find 20 in their own buckets
    centre = random.normal(size=64)
    rows = np.concatenate([centre + 0.01 * random.normal(size=(500, 64)), -centre + 0.01 * random.normal(size=(12, 64))])
    got, want = found_and_wanted(spark, rows, "vec_id >= 500")
    assert len(got) == 12 and got == want


def test_equal_scores_are_in_the_order_of_the_ids(spark):
    random = np.random.default_rng(13)
    rows = [(0, [1.0] + [0.0] * 15)] + [(i, [1.0, *random.normal(size=15).tolist()]) for i in range(1, 301)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(X.nearest(frame.repartition(5), "vec_id = 0", probes=32).collect(), key=lambda r: r["rank"])
    assert [(r.vec_id, r.score) for r in found] == [(i, 1.0) for i in range(1, 21)]
