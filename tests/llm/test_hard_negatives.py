import math

import numpy as np
import pyarrow as pa

from tallyloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, score string, rank int"


def plain(rows, every, positives=5, negatives=10):
    """By definition, pair by pair."""
    ready = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * x) for x in v]
            ready[i] = min(ready.get(i, (label, v)), (label, v))
    out = []
    for a in sorted(ready):
        if a % every == 0:
            la, va = ready[a]
            scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label == la) for i, (label, v) in ready.items() if i != a)
            for p, positive, _ in [s for s in scored if s[2]][:positives]:
                kept = [(-s, i) for s, i, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
                out += [(a, positive, r + 1, i, -p, s) for r, (s, i) in enumerate(kept)]
    return sorted(out)


def mined(spark, rows, every):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(frame, f"vec_id % {every} = 0").collect())


def test_clusters_ties_and_odd_rows(spark, monkeypatch):
    random = np.random.default_rng(1)
    centres = random.standard_normal((6, 20))
    rows = []
    for i in range(400):
        v = (centres[i % 6] + random.standard_normal(20) * 0.3).astype(np.float32)
        rows.append((i, int(i % 4), (v / np.linalg.norm(v)).tolist()))
    rows += [(1000 + i, i % 3, rows[7][2]) for i in range(60)]  # equal scores
    rows += [(2000, None, rows[0][2]), (2100, 1, None), (2200, 1, [None] * 20), (2300, 1, [float("nan")] * 20), (None, 1, rows[0][2]), (2400, 2, [0.0] * 20), (2500, 1, [float("inf")] * 20)]
    rows += [rows[0], rows[20]]  # repeated rows
    want = plain(rows, 20)
    assert mined(spark, rows, 20) == want and len(want) > 100
    monkeypatch.setattr(H, "ROWS", 100)
    monkeypatch.setattr(H, "ANCHORS", 7)  # many blocks of both
    assert mined(spark, rows, 20) == want


def test_small_and_empty_tables(spark):
    one = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.5])]
    assert mined(spark, one, 100) == plain(one, 100) == [(0, 1, 1, 2, 58880, 32768)] or mined(spark, one, 100) == plain(one, 100)
    assert mined(spark, [], 100) == [] and mined(spark, one[1:], 100) == []


def test_intervals_hold_the_score_and_leave_little():
    random = np.random.default_rng(2)
    rows = (random.standard_normal((3000, 64)) * 40).astype(np.int32)
    rows[:5] = 0
    anchors = rows[::100].astype(np.int64)
    codes = H.codes_of(rows)
    lower, upper = H.Probe(anchors).interval(slice(0, 64), *codes)
    exact = rows.astype(np.int64) @ anchors.T
    assert (lower <= exact).all() and (exact <= upper).all()
    tenth = np.sort(exact, axis=0)[-10]
    assert (upper >= tenth[None, :]).mean() < 0.25  # most rows need no exact score


def test_a_pair_is_estimated_once_and_positives_meet_their_label_alone(monkeypatch):
    random = np.random.default_rng(3)
    v = (random.standard_normal((1200, 64)) * 40).astype(np.int32)
    labels, ids = np.arange(1200) % 8, np.arange(1200)
    codes, aligned, remainder = H.codes_of(v)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(labels), *(pa.array([r.tobytes() for r in c], pa.binary()) for c in (v, codes, aligned)), pa.array(remainder)],
        ["vec_id", "label", "v", "codes", "aligned", "remainder"],
    )
    pairs, plain_interval = [], H.Probe.interval

    def interval(self, of, codes, *rest):
        low, high = plain_interval(self, of, codes, *rest)
        pairs.append(low.size)
        return low, high

    monkeypatch.setattr(H.Probe, "interval", interval)
    exact = v.astype(np.int64) @ v[:80].astype(np.int64).T
    shape = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    for bounds in (None, [{"low": 1000, "high": 20000}, {"low": 500, "high": 15000}, {"low": 1, "high": 0}]):
        block = H._Block(10)
        block.anchors(pa.RecordBatch.from_arrays([pa.array(ids[:80]), pa.array(labels[:80]), rows["v"].slice(0, 80), pa.array([bounds] * 80, shape)], ["vec_id", "label", "v", "bounds"]))
        pairs.clear()
        block.rows(rows)
        assert sum(pairs) == (80 * 1200 if bounds else 80 * 150)  # 150 rows have an anchor's label
        want = []
        for a in range(80):
            for slot, band in enumerate(bounds or [{"low": -(10**9), "high": 10**9}]):
                other = [i for i in range(1200) if (labels[i] != labels[a] if bounds else labels[i] == labels[a] and i != a) and band["low"] <= exact[i, a] <= band["high"]]
                want += [(a, slot, i, exact[i, a]) for i in sorted(other, key=lambda i: (-exact[i, a], i))[:10]]
        assert sorted(zip(*(c.to_pylist() for c in block.result().columns))) == sorted(want)
