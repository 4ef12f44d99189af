"""Encoding against another implementation of the same vocabulary, and exact round trips."""

import base64

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import bpe
from sigloom.session import table

TOKENS = bpe.read_ranks()
ENCODER = bpe.Encoder(bpe.model(TOKENS))
OTHER = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def test_ranks_are_whole():
    assert len(TOKENS) == 50_256 and all(TOKENS)
    with open(bpe.VOCABULARY, "rb") as f:
        token, rank = f.readline().split()
    assert TOKENS[int(rank)] == base64.b64decode(token)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    ids = ENCODER.encode(text)
    assert ids == OTHER.encode_ordinary(text)
    assert ENCODER.decode(ids) == text


def test_edges():
    assert ENCODER.encode(None) == [] and ENCODER.encode("") == []
    for text in ("<|endoftext|>", "a" * 200_000, " \n\t  \r\n", "\x00\x7f", "🤔👩‍💻", "ａｂｃ", "é" * 1000, "x" * 65 + " " + "x" * 65):
        assert ENCODER.decode(ENCODER.encode(text)) == text
    assert ENCODER.encode("<|endoftext|>") == OTHER.encode_ordinary("<|endoftext|>") and 50_256 not in ENCODER.encode("<|endoftext|>")


def test_documents(spark, data, rows):
    got = {r.doc_id: r.ids for r in bpe.encoded(table(spark, data, "documents")).collect()}
    docs = rows("documents")
    assert len(got) == len(docs)
    assert all(got[d["doc_id"]] == OTHER.encode_ordinary(d["text"] or "") for d in docs)
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(table(spark, data, "documents"))).collect()}
    assert all(back[d["doc_id"]] == (d["text"] or "") for d in docs)


def test_null_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, None), (None, ""), (3, " ")], "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as model")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in bpe.encoded(df).collect())
    assert got == [(0, []), (1, ENCODER.encode("ab")), (1, ENCODER.encode("ab")), (2, []), (3, ENCODER.encode(" "))]
    assert bpe.encoded(df.limit(0)).collect() == []
    assert all(r.same for r in bpe.round_trip(df).collect())
