import hashlib

import public_tokenizers
import pytest
import tiktoken

from parcelflow.llm import byte_bpe, queries

RANKS = queries.vocabulary()
TEXTS = ["", "a", "Hello world's  end \n\n ok", "é" * 50 + " über façade 12345", "aaaa" * 300, "ab" * 700 + "=" * 999, "你好 \U0001f600\U0001f600", " \t\n", "don't I'll 'S", "\x00\x01 \xa0x", "word " * 3000, "zqxjk" * 200]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("long_piece", [0, 256, 10**9])
def test_ids_match_library(reference, long_piece, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_PIECE", long_piece)
    bpe = byte_bpe.ByteBpe(byte_bpe.parse_ranks(RANKS), public_tokenizers.PATTERN)
    for text, pieces in zip(TEXTS, bpe.encode(TEXTS), strict=True):
        ids = bpe.ids(pieces)
        assert ids == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_round_trip_query(spark, reference):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, None, TEXTS[2]])] + [(None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "to be", "clash"), (2, None, None)], "doc_id long, text string, ids string")
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {1: b"to be", 2: b""}
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
