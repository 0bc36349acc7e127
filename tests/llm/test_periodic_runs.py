import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyloom.llm import periodic_runs as R
from tallyloom.llm.queries import QUERIES


def plain_runs(words, least=12):
    """By definition: all maximal stretches of every period, then the smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            if words[k] != words[k + p]:
                k += 1
                continue
            start = k
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k + p - start >= max(least, 2 * p):
                found.setdefault((start, k + p), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{x},{p}\n" for s, x, p in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    short = {i for i, t in texts.items() if len(t.split()) < 3000}
    assert set(got) == set(texts) and {i: got[i] for i in short} == {i: plain_row(i, texts[i]) for i in short}
    assert sum(r[0] > 0 for r in got.values()) > 10


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_brute_force(letters):
    random.seed(letters)
    for turn in range(150):
        ids = [random.randrange(letters) for _ in range(random.randrange(0, 120))]
        for _ in range(random.randrange(4)):
            p, times = random.randrange(1, 15), random.randrange(2, 9)
            ids[len(ids) // 2 : len(ids) // 2] = [random.randrange(letters + 3) for _ in range(p)] * times
        assert R.runs_of(np.array(ids, np.int64)) == plain_runs(ids), ids


def test_extensions_equal_brute_force():
    random.seed(9)
    for letters in (1, 2, 4):
        ids = [random.randrange(letters) for _ in range(300)]
        ids += ids[20:200] + [0] * 100 + ids[:90]
        grammar = R.Grammar(np.array(ids, np.int64))
        one = np.array([random.randrange(len(ids)) for _ in range(400)])
        two = np.array([(i + random.randrange(1, len(ids))) % len(ids) for i in one])
        ahead, back = grammar.common(one, two, True), grammar.common(one, two, False)
        for i, j, f, b in zip(one.tolist(), two.tolist(), ahead.tolist(), back.tolist()):
            k = 0
            while max(i, j) + k < len(ids) and ids[i + k] == ids[j + k]:
                k += 1
            assert f == k
            k = 0
            while min(i, j) - k >= 0 and ids[i - k] == ids[j - k]:
                k += 1
            assert b == k


def test_long_texts_in_portions(monkeypatch):
    random.seed(5)
    ids = np.array([random.randrange(50) for _ in range(1500)] + [1, 2, 3, 4, 5, 6, 7] * 40 + [9] * 500 + list(range(100, 700)) * 2, np.int64)
    want = plain_runs(ids.tolist())
    assert R.runs_of(ids) == want and len(want) >= 3
    monkeypatch.setattr(R, "SHORT", 10)
    monkeypatch.setattr(R, "CHUNK", 300)
    assert R.runs_of(ids) == want


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a " * 30, 5), (3, "x y " * 40_000, 5), (3, "x y " * 40_000, 5), (4, "é\u00a0b " * 12, 5)], "doc_id long, text string, start int")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in R.runs(docs).collect())
    assert got == [("1", [], ""), ("2", [], ""), ("3", [(0, 80_000, 2)], "x y"), ("3", [(0, 80_000, 2)], "x y"), ("4", [(0, 12, 1)], "é\u00a0b"), ("None", [(0, 30, 1)], "a")]
    assert R.run_digests(docs.limit(0)).count() == 0 and R.run_digests(docs).count() == 6
