"""Token ids in wavelet-matrix files (operator 9).

Documents are dealt to key ranges, encoded, ended by one end id and cut into shards.  A shard is
one compressed file: for each bit, from the highest down, a bit-plane of the ids as sorted stably
by the planes before it, with a stored running count of ones for every block.  From it single tokens
are read (``access``), occurrences counted (``rank``) and found (``select``), or all ids restored;
planes are compressed in chunks, of which a look-up unpacks a few.  The files are kept as cells of a
written table, one row for each, because only Spark reaches every store.

Defined cases: a null text counts as empty (only the end id is stored); null ``doc_id`` comes
before all others; of rows with equal ``doc_id`` the order is that of their texts' checksums, then
texts; ids that do not fit the width are an error; an empty table
gives no shard and no row; other columns are not looked at.  The string of an added token in a text
is that token, as the library has it by default; no segment is cut inside of it.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import map_pandas, materialise, read_table, renamed_apart
from .segments import WORD, SegmentEncoder, batches

BLOCK = 4096  # bits between two stored counts
CHUNK = 1 << 15  # bytes of a plane that are compressed together, a multiple of BLOCK // 8


class WaveletMatrix:
    """Bit-planes over ``ids`` of ``width`` bits, with rank and select.

    A plane is a list of chunks, each an array or still compressed; a chunk is unpacked when it is
    first needed, so single look-ups read a small part of a file.
    """

    def __init__(self, size: int, planes: list[list], zeros: list[int], counts: list[np.ndarray]):
        self.size, self.planes, self.zeros, self.counts = size, planes, zeros, counts

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        if len(ids) and int(np.max(ids)) >> width:
            raise ValueError(f"id {int(np.max(ids))} does not fit {width} bits")
        now = np.asarray(ids, dtype=np.uint16 if width <= 16 else np.uint32)
        planes, zeros, counts = [], [], []
        for bit in range(width - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)) != 0
            plane = np.packbits(ones, bitorder="little")
            planes.append([plane[a : a + CHUNK] for a in range(0, len(plane), CHUNK)])
            counts.append(cls._counts(plane))
            zeros.append(len(ones) - int(np.count_nonzero(ones)))
            if bit:  # a boolean index takes several times as long
                now = np.concatenate([np.compress(~ones, now), np.compress(ones, now)])
        return cls(len(ids), planes, zeros, counts)

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        per_byte = np.bitwise_count(plane)
        edges = np.arange(0, len(plane), BLOCK // 8)
        sums = np.add.reduceat(per_byte, edges, dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(sums)]).astype("<u4")

    def _chunk(self, level: int, k: int) -> np.ndarray:
        found = self.planes[level][k]
        if isinstance(found, bytes | memoryview):
            found = self.planes[level][k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(found), dtype=np.uint8)
        return found

    @property
    def unpacked(self) -> int:
        """Chunks that were unpacked or never compressed."""
        return sum(isinstance(x, np.ndarray) for plane in self.planes for x in plane)

    def _ones_before(self, level: int, at: int) -> int:
        block = at // BLOCK
        n, rest = int(self.counts[level][block]), at % BLOCK
        if not rest:
            return n
        chunk, start = self._chunk(level, block * BLOCK // 8 // CHUNK), block * BLOCK // 8 % CHUNK
        stop = start + rest // 8
        n += int(np.bitwise_count(chunk[start:stop]).sum())
        return n + (int(chunk[stop]) & (1 << at % 8) - 1).bit_count() if at % 8 else n

    def access(self, at: int) -> int:
        """The id at position ``at``."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self._chunk(level, at // 8 // CHUNK)[at // 8 % CHUNK]) >> at % 8 & 1
            ones = self._ones_before(level, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        start = 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones_before(level, start), self._ones_before(level, stop)
            start, stop = (zeros + a, zeros + b) if value >> len(self.zeros) - 1 - level & 1 else (start - a, stop - b)
        return start, stop

    def rank(self, value: int, stop: int) -> int:
        """How often ``value`` occurs before position ``stop``."""
        a, b = self._range(value, stop)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """The position of occurrence ``nth`` (from 0) of ``value``; -1 if there are fewer."""
        a, b = self._range(value, self.size)
        if nth >= b - a:
            return -1
        at = a + nth
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> len(self.zeros) - 1 - level & 1
            wanted = at - self.zeros[level] if bit else at
            low, high = 0, self.size  # first position with wanted + 1 such bits up to it
            while low < high:
                mid = (low + high) // 2
                ones = self._ones_before(level, mid + 1)
                low, high = (low, mid) if (ones if bit else mid + 1 - ones) > wanted else (mid + 1, high)
            at = low
        return at

    def restore(self) -> np.ndarray:
        """All ids, by undoing the stable partitions from the lowest plane up."""
        now, kind = None, np.uint16 if len(self.planes) <= 16 else np.uint32
        for level in range(len(self.planes) - 1, -1, -1):
            parts = [self._chunk(level, k) for k in range(len(self.planes[level]))]
            plane = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            ones = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            bit = kind(1 << len(self.planes) - 1 - level)
            if now is None:
                now = np.where(ones, bit, kind(0))
                continue
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            up[np.flatnonzero(ones)] = now[self.zeros[level] :] | bit
            now = up
        return now if now is not None else np.zeros(0, kind)

    def to_bytes(self, starts: np.ndarray, doc_ids: list) -> bytes:
        """Header, document offsets, counts of ones and planes, each chunk compressed for itself."""
        pack = zstandard.ZstdCompressor(level=1).compress
        body = [[pack(x.tobytes()) for x in plane] for plane in self.planes]
        front = [pack(np.asarray(starts, dtype="<u8").tobytes()), pack(json.dumps(doc_ids).encode()), pack(b"".join(c.tobytes() for c in self.counts))]
        head = json.dumps({"size": self.size, "zeros": self.zeros, "front": [len(x) for x in front], "planes": [[len(x) for x in plane] for plane in body]}).encode()
        return b"WVM2" + struct.pack("<I", len(head)) + head + b"".join(front) + b"".join(x for plane in body for x in plane)

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[WaveletMatrix, np.ndarray, list]:
        if blob[:4] != b"WVM2":
            raise ValueError("not a wavelet-matrix shard")
        at = 8 + struct.unpack("<I", blob[4:8])[0]
        head = json.loads(blob[8:at])
        view = memoryview(blob)

        def take(n: int) -> memoryview:
            nonlocal at
            at += n
            return view[at - n : at]

        unpack = zstandard.ZstdDecompressor().decompress
        starts, docs, counts = (unpack(take(n)) for n in head["front"])
        planes = [[take(n) for n in plane] for plane in head["planes"]]
        rows = np.frombuffer(counts, dtype="<u4").reshape(len(planes), -1)
        return cls(head["size"], planes, head["zeros"], list(rows)), np.frombuffer(starts, dtype="<u8").astype(np.int64), json.loads(docs)


@lru_cache(maxsize=2)
def encoder(path: str) -> SegmentEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    kind = json.loads(tokenizer.to_str())
    before = kind["pre_tokenizer"] or {}
    whole = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and kind["normalizer"] is None
    if not whole:
        return SegmentEncoder(lambda xs: (e.ids for e in many(xs, add_special_tokens=False)) if xs else ())
    # A word is one pre-token as it stands, so it is not searched for others.
    plain = Tokenizer.from_file(path)
    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    words = getattr(plain, "encode_batch_fast", plain.encode_batch)

    def encode(segments: list[str]) -> Iterator[list[int]]:
        one = [WORD.fullmatch(x) is not None for x in segments]
        found = [iter(f([x for x, w in zip(segments, one, strict=True) if w == k], add_special_tokens=False)) for k, f in ((False, many), (True, words))]
        return (next(found[k]).ids for k in one)

    return SegmentEncoder(encode)


def write_shards(docs: DataFrame, path: str, end_id: int = 0, width: int = 16, shard_tokens: int = 1_000_000) -> DataFrame:
    """Encode every text and write the shards; a row of the table is one shard file's content.

    Returns the written table ``part, shard, n_docs, n_tokens, blob``; (part, shard) ascend with
    ``doc_id``.  Documents stay whole, so a shard may pass ``shard_tokens`` by its last document.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, shard, encode = TaskContext.get().partitionId(), 0, encoder(path)
        ids: list[np.ndarray] = []
        names: list = []
        held = 0

        def close() -> pd.DataFrame:
            tokens = np.concatenate(ids)
            sizes = np.array([len(x) for x in ids])
            blob = WaveletMatrix.build(tokens, width).to_bytes(np.cumsum(sizes) - sizes, names)
            return pd.DataFrame({"part": [part], "shard": [shard], "n_docs": [len(ids)], "n_tokens": [len(tokens)], "blob": [blob]})

        end = np.array([end_id], dtype=np.uint32)
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            keys = [None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in pdf["doc_id"]]
            for a, b in batches(texts):
                for key, found in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    ids.append(np.concatenate([found, end]))
                    names.append(key)
                    held += len(found) + 1
                    if held >= shard_tokens:
                        yield close()
                        ids, names, held, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    source = renamed_apart(docs, "doc_id", "text")
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    dealt = source.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text")
    return materialise(map_pandas(dealt, run, "part int, shard int, n_docs int, n_tokens long, blob binary"))


def read_shards(shards: DataFrame, doc_type: str = "bigint") -> DataFrame:
    """Every document's ids as read back: ``doc_id, start, n_tokens, ids``-level digests per row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, shard, blob in zip(pdf["part"], pdf["shard"], pdf["blob"], strict=True):
                matrix, starts, docs = WaveletMatrix.from_bytes(bytes(blob))
                ids = matrix.restore().astype("<u4")
                ends = np.append(starts[1:], matrix.size)
                yield pd.DataFrame({
                    "part": part, "shard": shard, "doc_id": pd.Series(docs, dtype="object"), "within": starts, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                })

    rows = map_pandas(shards.select("part", "shard", "blob"), run, f"part int, shard int, doc_id {doc_type}, within long, n_tokens long, ids_crc32 long")
    # Tokens before a shard: totals of the parts before it, then of the part's own shards before it.
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before_part"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.join(parts, "part").select("part", "shard", (F.col("before_part") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).alias("base"))
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = read_table(spark, sf_dir, "documents")
    shards = write_shards(docs, P.path("byte_bpe_50k.json"))
    return read_shards(shards, docs.schema["doc_id"].dataType.simpleString())
