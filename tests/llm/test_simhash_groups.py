import itertools
import random
import re

import numpy as np
import xxhash

from tallyloom.llm import simhash_groups as G
from tallyloom.llm.components import components
from tallyloom.llm.queries import QUERIES


def plain_print(text, k=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, radius=4):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in prints}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    groups = plain_groups(prints)
    got = QUERIES["op6_simhash_groups"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_covering_combinations():
    for least in range(1, 9):
        combinations = G.cover(least)
        for shared in itertools.combinations(range(8), least):
            assert any(set(c) <= set(shared) for c in combinations)
    assert len(G.cover(4)) == 20


def linked(spark, prints, radius=4, block=None):
    old, G.BLOCK = G.BLOCK, block or G.BLOCK
    try:
        rows = [(i, p - (1 << 64) if p >> 63 else p, b"") for i, p in prints.items()]
        classes = spark.createDataFrame(rows, "rep long, fp long, proof binary")
        roots = {r.node: r.component for r in components(G.links(classes, radius)).collect()}
        return {i: roots.get(i, i) for i in prints}
    finally:
        G.BLOCK = old


def test_links_equal_brute_force_for_chains_and_dense_groups(spark):
    random.seed(3)
    centre = random.getrandbits(64)
    prints = {i: centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for i in range(150)}
    prints = {i: p for p, i in {p: i for i, p in prints.items()}.items()}
    chain = random.getrandbits(64)
    for i in range(200, 240):
        prints[i] = chain
        chain ^= sum(1 << b for b in random.sample(range(64), random.choice([2, 4, 5])))
    prints |= {i: random.getrandbits(64) for i in range(300, 400)}
    want = plain_groups(prints)
    assert linked(spark, prints) == want
    assert linked(spark, prints, block=16) == want  # many blocks in a bucket


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(5, None, 1), (6, "", 1), (7, " \t", 1), (8, "one two", 1), (9, "ONE  two", 1), (9, "ONE  two", 1), (10, "x " * 30_000, 1), (None, "one two", 1), (None, "lonely", 1)],
        "doc_id long, text string, fp int",
    )
    got = sorted((tuple(r)[::2] for r in G.groups(docs).collect()), key=str)
    assert got == sorted([(5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (9, 8), (10, 10), (None, 8), (None, None)], key=str)
    assert G.groups(docs.limit(0)).count() == 0
    kept = G.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, 8, 10, None, None], key=str)


def test_near_copies_are_found_by_wide_prints(spark):
    random.seed(4)
    words = [f"w{random.randrange(5000)}" for _ in range(300)]
    near = list(words)
    near[100] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in G.groups(docs, G.wide_print, 20, 3, 44).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}


def test_hashes_are_those_of_the_contract():
    assert G.majority(np.array([1, 3, 2], np.uint64)) == 3
    assert G.majority(np.array([1, 2], np.uint64)) == 0
