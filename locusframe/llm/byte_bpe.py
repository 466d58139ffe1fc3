"""Byte-level BPE through sentencepiece (operator 3).

The vocabulary of byte strings and ranks is serialised straight into a sentencepiece BPE
model: every byte is mapped to one visible character, a piece's score is minus its rank, and
normalisation is the identity.  Pre-tokens are encoded one by one; decoding maps ids back to
their bytes.

Defined cases: a null text counts as empty; an empty text has no ids; repeated rows are encoded
each for itself; null ``doc_id`` stays null; an empty table gives an empty table; columns other
than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_pandas, read_table, renamed_apart
from .segments import SegmentEncoder, batches


def byte_characters() -> list[str]:
    """One visible character for each byte: itself if printable, else the next one from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in own else free))
        free += b not in own
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) }


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: the unknown piece at 0, then the pieces in rank order."""
    chars = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        mapped = "".join(chars[b] for b in piece).encode()
        pieces.append(_field(1, mapped) + _field(2, float(-rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(i, -1) for i in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(i, 0) for i in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.pieces = [p for p, _ in order]
        self.ids = [r for _, r in order]
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.characters = byte_characters()
        size = self.ids[-1] + 1
        table = [b""] * size
        for p, r in order:
            table[r] = p
        self.bytes_of = _Spliced(table)
        self.text_of = _Spliced([b"%d " % i for i in range(size)])
        self.encode = SegmentEncoder(self._encode_segments)

    def _encode_segments(self, segments: list[str]) -> Iterator[list[int]]:
        tokens = [self.pattern.findall(s) for s in segments]
        chars = self.characters
        flat = ["".join([chars[b] for b in t.encode()]) for ts in tokens for t in ts]
        found = iter(self.model.encode(flat, out_type=int, num_threads=1) if flat else [])
        ids = self.ids
        for ts in tokens:
            yield [ids[i - 1] for _ in ts for i in next(found)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of(ids)


class _Spliced:
    """Concatenates table entries by id without a Python step for each id."""

    def __init__(self, table: list[bytes]):
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in table], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[shift + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            for a, b in batches(texts):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "ids": [x.astype(np.int32) for x in bpe.encode(texts[a:b])]})

    source = renamed_apart(docs, "doc_id", "text")
    return map_pandas(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data binary`` from ``doc_id, ids``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "data": [bpe.decode(np.asarray(x if x is not None else [], dtype=np.int64)) for x in pdf["ids"]]})

    source = renamed_apart(encoded, "doc_id", "ids")
    return map_pandas(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode each text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            for a, b in batches(texts):
                ids = bpe.encode(texts[a:b])
                out = pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[a:b].to_numpy(),
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(bpe.text_of(x)[:-1]).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
                })
                yield out.assign(ids=[x.astype(np.int32) for x in ids]) if keep_ids else out

    source = renamed_apart(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_pandas(source, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
