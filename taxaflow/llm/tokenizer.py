"""Encoding of whole texts with a public byte-level BPE vocabulary, by a sentencepiece model built from it.

The vocabulary (a file of base64 tokens and ranks) is turned into a serialised
sentencepiece BPE model without training: each byte gets a printable character,
each token is the piece of its bytes' characters with the negative rank as
score, and normalisation is the identity. Texts are cut into pre-tokens by the
vocabulary's pattern, each pre-token is encoded as its bytes' characters, and
decoding maps the characters back to bytes. Merging the pair with the largest
score is then the same as merging the pair with the lowest rank.

The model goes to the executors as one broadcast, bounded by the vocabulary.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaflow.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is a visible Latin-1 sign, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(extra)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_of(path: str = VOCABULARY) -> bytes:
    """The serialised model; piece ids are the vocabulary's ranks, the unknown piece comes last."""
    chars = byte_characters()
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in open(path, "rb") if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    parts = []
    for rank in range(len(ranks)):
        piece = "".join(chars[b] for b in ranks[rank]).encode()
        parts.append(_field(1, _field(1, piece) + _field(2, float(-rank))))
    unknown = len(ranks)
    parts.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encodes and decodes whole texts; pre-tokens met before are looked up."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        chars = byte_characters()
        self.table = {b: c for b, c in enumerate(chars)}
        self.back = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for t in self.cut(text):
            ids = known.get(t)
            if ids is None:
                ids = self.sp.encode(t.encode().decode("latin-1").translate(self.table))
                if len(known) >= CACHE:
                    known.clear()
                if len(t) <= 64:
                    known[t] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(self.sp.id_to_piece(int(i)) for i in ids)
        return bytes(self.back[c] for c in pieces).decode("utf-8", "replace")


def _udf(df: DataFrame, kind: T.DataType, path: str, call: str):
    shared = df.sparkSession.sparkContext.broadcast(model_of(path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(shared.value)
        f = getattr(codec, call)
        for b in batches:
            yield pd.Series([f(x) for x in b], dtype=object)

    return F.pandas_udf(run, kind)


def encode(docs: DataFrame, text: str | Column = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``ids``: the token ids of each text without special tokens, [] for a null or empty text.

    The text is taken as it is. Strings of special tokens in it are ordinary text.
    """
    docs = spread(docs)
    return docs.withColumn("ids", _udf(docs, T.ArrayType(T.IntegerType()), path, "encode")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def decode(rows: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``rows`` with ``decoded``: the text of the ids, exact for what ``encode`` gave."""
    return rows.withColumn("decoded", _udf(rows, T.StringType(), path, "decode")(F.col(ids)))
