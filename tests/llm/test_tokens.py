"""SentencePiece encoding and edit-aware counts against the libraries."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from posegrid.llm import edit_counts, sentencepiece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "▁", "\n", "\t", "the", "ing", ".", ",", "é", "日本", "x", "²", "_", "#", "😀", "ß", "<s>", "<0x41>", "́", "'", "'ll", "'re", "12", "!!"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.Model(sentencepiece_bpe.model_bytes(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return edit_counts.Counter(sentencepiece_bpe.model_bytes(RANKS), public_tokenizers.PATTERN)


def test_encoding_is_the_librarys(model, library):
    r = random.Random(1)
    texts = ["", " ", "\n", "▁▁", "a" + " " * 300 + "b", "x" * 3000, *("".join(r.choices(PARTS, k=r.randint(0, 30))) for _ in range(2000)), *(" " * n for n in range(60))]
    for t in texts:
        assert model.encode(t) == library.encode(t), t
        assert model.decode(model.encode(t)) == library.decode(library.encode(t)), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(t):
    model, library = _both()
    assert model.encode(t) == library.encode(t)


def _both(cache=[]):  # noqa: B006
    if not cache:
        cache += [sentencepiece_bpe.Model(sentencepiece_bpe.model_bytes(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)]
    return cache


def test_decoding_any_ids(model, library):
    r = random.Random(2)
    for k in range(500):
        ids = [r.randrange(0, 32000 if k % 2 else 300) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_columns(spark, library):
    data = [(1, "the house\nof it", "keep"), (2, None, None), (3, "", "x"), (3, "", "x"), (None, "日本 " * 5000, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(df, PATH), PATH)
    got = both.collect()
    assert len(got) == 5 and all(r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"]) for r in got)
    assert sentencepiece_bpe.encode(df.limit(0), PATH).count() == 0


def test_edits_against_counting_anew(counter):
    r = random.Random(3)
    for _ in range(600):
        doc = edit_counts.Document("".join(r.choices(PARTS, k=r.choice([0, 3, 40, 500]))), counter)
        for _ in range(r.randint(1, 4)):
            a = r.randint(-2, len(doc.text) + 2)
            b, new, old = a + r.choice([0, 1, 3, 30, 300]), "".join(r.choices(PARTS, k=r.choice([0, 1, 3, 700 if r.random() < 0.05 else 5]))), doc.text
            doc.edit(a, b, new)
            lo = min(max(a, 0), len(old))
            assert doc.text == old[:lo] + new + old[min(max(b, lo), len(old)) :]
            assert doc.total == len(counter.encoding.encode_ordinary(doc.text))
            assert [n for sizes, _ in doc.leaves for n in sizes] == [len(p) for p in counter.pattern.findall(doc.text)]


def test_an_edit_touches_little(counter):
    doc = edit_counts.Document("the thing of it and other words. " * 2000, counter)
    doc.edit(30_000, 30_003, "new")
    assert doc.encoded < 10


def test_edit_columns(spark, counter):
    docs = spark.createDataFrame([(1, "one two", "k"), (2, None, "k"), (3, "", None), (4, "stays", "k")], "doc_id long, text string, n_after string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 3, 3, " and a half"), (2, 1, 9, 9, "new"), (9, 1, 0, 0, "x"), (3, 1, 0, 5, None)], "doc_id long, seq int, start int, stop int, replacement string")
    got = {r["doc_id"]: r for r in edit_counts.count_edited(edit_counts.with_edits(docs, edits), RANKS, public_tokenizers.PATTERN).collect()}
    assert {k: r["edited"] for k, r in got.items()} == {1: "1 and a half two", 2: "new", 3: "", 4: "stays"}
    assert all(r["n_after"] == len(counter.encoding.encode_ordinary(r["edited"])) for r in got.values())
    assert got[4]["n_before"] == got[4]["n_after"] and got[4]["n_reencoded"] == 0
