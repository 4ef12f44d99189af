"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

The vocabulary is serialised directly as a sentencepiece BPE model: each token
is a piece in which every byte is written as one printable character, its score
is the negative rank (so the merge with the lowest rank goes first), and
normalisation is the identity. Texts are split by the vocabulary's pattern, the
pre-tokens are encoded by that model, and decoding is the inverse mapping. The
model (about 1 MB, of the vocabulary's fixed size) is built on the driver and
broadcast; texts never leave the scan's partitions, so there is no shuffle.

Defined results: null and empty texts give an empty list; every row of the
input gives one row, repeated rows too; special tokens are never produced,
their strings are ordinary text; other columns are never read.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.session import spread

VOCABULARY = os.environ.get("SIGLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a worker remembers; longer ones than MAX_LENGTH are not kept.
MAX_KEPT, MAX_LENGTH = 500_000, 64


def byte_letters() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = {b: c for b, c in enumerate(LETTERS)}
TO_BYTES = {c: b for b, c in enumerate(LETTERS)}


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model(tokens: list[bytes]) -> bytes:
    """The vocabulary as a serialised sentencepiece model; the unknown piece comes after all tokens."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        out += _field(1, _field(1, token.decode("latin-1").translate(TO_LETTERS).encode()) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, identity))


class Encoder:
    """Encodes and decodes texts with a serialised model."""

    def __init__(self, serialised: bytes):
        import regex
        import sentencepiece

        self.split = regex.compile(PATTERN).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised)
        self.kept: dict[str, list[int]] = {}

    def pre_token(self, token: str) -> list[int]:
        got = self.kept.get(token)
        if got is None:
            got = self.pieces.encode(token.encode("utf-8", "surrogatepass").decode("latin-1").translate(TO_LETTERS), out_type=int)
            if len(token) <= MAX_LENGTH:
                if len(self.kept) >= MAX_KEPT:
                    self.kept.clear()
                self.kept[token] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            for token in self.split(text):
                out += self.pre_token(token)
        return out

    def decode(self, ids: list[int]) -> str:
        return bytes(TO_BYTES[c] for i in ids for c in self.pieces.id_to_piece(i)).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: the token ids of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model(read_ranks(path)))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [np.array(encoder.encode(t), np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text: the texts back from their ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(model(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, same: whether the decoded ids are the stored text (null counts as empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model(read_ranks(path)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [encoder.encode(t) for t in texts]
            same = [encoder.decode(i) == (t or "") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], schema=schema)

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, same boolean")
