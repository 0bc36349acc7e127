import random
from collections import Counter

from tallyloom.llm import decontaminate as D
from tallyloom.llm.queries import QUERIES


def plain_best(doc, item):
    """The best window's similarity, over all windows of the item's length."""
    a, b = D.shingles(doc).tolist(), Counter(D.shingles(item).tolist())
    n = b.total()
    best = 0.0
    for start in range(max(1, len(a) - n + 1)) if a and n else ():
        window = Counter(a[start : start + n])
        common = (window & b).total()
        best = max(best, common / (window.total() + n - common))
    return best


def test_query_equals_all_windows(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    grams = {k: set(D.shingles(t).tolist()) for k, t in items.items()}
    want = {}
    for d, text in docs.items():
        own = set(D.shingles(text).tolist())
        for k, item in items.items():
            if own & grams[k] and (best := plain_best(text, item)) >= 0.8:
                want[d, k] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op8_decontaminate"](spark, folder).collect()}
    assert got == want and got


def test_changed_passages_blocks_and_edge_rows(spark):
    random.seed(2)
    fresh = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    items = [fresh(random.randint(40, 60)) for _ in range(30)]
    docs, planted = [], set()
    for i in range(60):
        body = fresh(200)
        if i % 2:
            item = list(items[i % 30])
            if i % 4 == 1:
                item[3] = "changed"  # four of at least 36 shingles
            body[100:100] = item
            planted.add((i, i % 30))
        docs.append((i, " ".join(body).upper() if i % 3 else ", ".join(body), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "one two three", "x"), (103, " ".join(items[0]), "x"), (103, " ".join(items[0]), "x"), (None, "x " * 50_000, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "one two three"), (None, "z")], "item_id long, text string")
    old, D.ITEMS_AT_ONCE = D.ITEMS_AT_ONCE, 7
    try:
        got = D.contaminated(frame, bench).collect()
        clean = D.clean(frame, bench)
        kept = sorted((r.doc_id for r in clean.collect()), key=str)
    finally:
        D.ITEMS_AT_ONCE = old
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(102, 92), (103, 0)}
    assert next(r for r in got if r.doc_id == 102)[2:] == (0, 3, 0, 1.0)
    assert all(r.start_word == 100 for r in got if r.doc_id < 60 and r.similarity == 1)
    assert kept == sorted([*range(0, 60, 2), 100, 101, None], key=str) and clean.columns == frame.columns
    assert D.contaminated(frame, bench.limit(0)).count() == 0 and D.contaminated(frame.limit(0), bench).count() == 0
