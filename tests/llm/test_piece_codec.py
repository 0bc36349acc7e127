import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tallyloom.llm import piece_codec as P
from tallyloom.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "\n", "a", "b", "the", " the", "ing", "é", "ß", "漢", "😀", "\x00", "\t", "<s>", "</s>", "<0x0A>", ".", ",", "1", "12", "�", "́", "====", "AAAA", "aaaa"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return P.codec(P.model_bytes(PATH))


def agree(codec, library, text):
    ids = library.encode(text, add_eos=True)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)
    assert codec.digest(text) == (
        len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
    )


def test_random_texts_equal_the_library(codec, library):
    random.seed(8)
    for _ in range(5000):
        agree(codec, library, "".join(random.choice(PARTS) for _ in range(random.randint(0, 30))))


def test_special_texts_equal_the_library(codec, library):
    for text in ("", " ", "  ", "\n", " \n ", " " * 3000, "a" * 5000, "ab" * 4000, "▁▁", "x" + " " * 70 + "y"):
        agree(codec, library, text)


def test_words_equal_merging(codec):
    for word in ("▁internationalization", "▁unbelievably", "▁thesethethere", "▁aaaaaaa", "▁éèçß"):
        assert codec.split(word) == codec.merge(word)


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op9_piece_codec"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text, add_eos=True)
        row = got[doc.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_null_empty_and_repeated_rows(spark, library):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "ab", 3), (3, "ab", 3)], "doc_id long, text string, n_tokens int")
    got = sorted(P.tokens(docs, PATH).collect())
    assert [(r.doc_id, r.n_tokens, r.ids) for r in got] == [(1, 1, [2]), (2, 1, [2])] + [(3, 2, library.encode("ab", add_eos=True))] * 2
    assert P.token_digests(docs.limit(0), PATH).count() == 0


def test_words_are_cut_from_marks_and_split_once(monkeypatch):
    model = P.model_bytes(PATH)
    ours, library, split = P.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model), []
    plain = ours.numbers
    monkeypatch.setattr(ours, "numbers", lambda text: split.append(text) or plain(text))
    marks = ["", ",", ".", "$$$", "###", "%%%", "!?", "…", "”", ":12", "***", ")"]
    text = " ".join(f"anrend{m} ouenou{m}" for m in marks)
    n, ids, decoded = ours.joined(text)
    assert ids == " ".join(map(str, [*library.encode(text), ours.end])) and decoded == library.decode(library.encode(text))
    assert len(split) == len(set(split)) <= 2 + len(marks)  # both words once, each kind of marks once
    for odd in ("a▁b ▁c", "d'accord: l'été...", "x\n\n  y. z", " . ", "1.a,2", "né́e!", "😀!😀 😀"):
        assert ours.encode(odd) == [*library.encode(odd), ours.end] and ours.joined(odd)[2] == library.decode(library.encode(odd))
