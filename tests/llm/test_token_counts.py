"""Counts against the library on whole texts."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldloom.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SIGNS = ["a", "the", "tion", " ", "  ", "\n", "\t", ",", ".", "▁", "é", "é", "日", "🙂", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "1", "23", "()", "\r\n", "ﬁ", "'t", "_", "　", "\xa0", "Z"]


@pytest.fixture(params=[token_counts.PIECE, 5])
def small(request, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", request.param)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=16).map("".join), st.sampled_from([5, 1 << 20]))
def test_any_text(text, piece):
    kept, token_counts.PIECE = token_counts.PIECE, piece
    try:
        assert token_counts.counter(MODEL).of(text) == len(LIBRARY.encode(text))
    finally:
        token_counts.PIECE = kept


def test_proof():
    proof = token_counts.counter(MODEL).proof
    assert all(len(LIBRARY.encode(w)) == 1 for w in proof.after_space)
    assert all(len(LIBRARY.encode("\n" + w)) == 1 + proof.lead for w in proof.within)
    # most of the vocabulary, but not all, is in reach of the merges
    assert len(proof.after_space) + len(proof.within) > 0.95 * len(proof.pieces)


def test_bounded_tables(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_WORDS", 50)
    own = token_counts.Counts(token_counts.counter(MODEL).proof)
    for k in range(300):
        text = " ".join(f"zq{j % 90}x, zq{j}" for j in range(k, k + 9))
        assert own.of(text) == len(LIBRARY.encode(text))
    assert len(own.met) <= 100


def test_rows(spark):
    texts = [None, "", " ", "  x  ", "plain words", "plain words", "x" * 70_000, "wort " * 300_000, "▁ ▁", "a\nb\n", "end "]
    docs = spark.createDataFrame([(k if k else None, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.token_counts(docs, MODEL).collect()), key=str)
    want = [(k if k else None, len((t or "").encode()), (n := len(LIBRARY.encode(t or ""))), n > 4096) for k, t in enumerate(texts)]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_query(spark):
    from yieldloom.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {tuple(r) for r in queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), (n := len(LIBRARY.encode(r.text or ""))), n > 4096) for r in docs}
