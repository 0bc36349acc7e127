import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tallyloom.llm import decontaminate, quality_ordinal
from tallyloom.llm.queries import GRADES, ratings
from tallyloom.llm.tables import written

from .test_decontaminate import plain_best
from .test_secret_ledger import BASE
from .test_simhash_groups import plain_groups, plain_print

FOLDER = "/root/testdata/sf0.001"


def plain_secrets(text):
    for pattern, group, least in BASE.values():
        text = pattern.sub(lambda m, g=group, n=least: "[SECRET]" if len(m[g]) >= n else m[0], text)
    return text


def test_stages_equal_brute_force(spark):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]

    model = quality_ordinal.learn(frame, ratings(spark, FOLDER), GRADES)
    scorer = quality_ordinal.Scorer(model)
    frame, _ = written(corpus_pipeline.quality(spark, frame, FOLDER), names[0])
    import numpy as np

    want = {i for i, t in docs.items() if model.grades(np.array([scorer.score(t)]))[1][0, 1] >= quality_ordinal.LEAST}
    got = {r.doc_id: r.text for r in frame.collect()}
    assert abs(len(set(got) ^ want)) <= 1 and frame.columns == columns  # single precision of the weights at the boundary

    prints = {i: plain_print(t) for i, t in got.items()}
    ids = sorted(prints)
    root = plain_groups(prints)
    frame, _ = written(corpus_pipeline.near_dedup(spark, frame, FOLDER), names[1])
    got = {r.doc_id: r.text for r in frame.collect()}
    assert set(got) == {i for i in ids if root[i] == i} and frame.columns == columns and len(got) < len(ids)

    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = [set(decontaminate.shingles(t).tolist()) for t in items]
    clean = set()
    for i, text in got.items():
        own = set(decontaminate.shingles(text).tolist())
        if not any(own & g and plain_best(text, item) >= 0.8 for g, item in zip(grams, items, strict=True)):
            clean.add(i)
    frame, _ = written(corpus_pipeline.decontamination(spark, frame, FOLDER), names[2])
    got = {r.doc_id: r.text for r in frame.collect()}
    assert set(got) == clean and frame.columns == columns

    frame, _ = written(corpus_pipeline.secrets(spark, frame, FOLDER), names[3])
    after = {r.doc_id: r.text for r in frame.collect()}
    assert after == {i: plain_secrets(t) for i, t in got.items()} and frame.columns == columns

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = {r.doc_id: r for r in corpus_pipeline.pieces(spark, frame, FOLDER).collect()}
    assert set(last) == set(after)
    for i, text in after.items():
        assert last[i].ids == library.encode(text, add_eos=True)
        assert last[i].decoded_sha256 == hashlib.sha256(library.decode(last[i].ids).encode()).hexdigest()

    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {i: r.ids_sha256 for i, r in last.items()}


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None, 7), (2, "", "en", "s", 0, 7), (None, "text", None, "s", 4, 7), (3, "w " * 40_000, "en", "s", 80_000, 7), (3, "w " * 40_000, "en", "s", 80_000, 7)],
        "doc_id long, text string, lang string, source string, n_chars long, spans int",
    )
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out, _ = written(stage(spark, frame, FOLDER), name)
            assert out.count() <= frame.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns
