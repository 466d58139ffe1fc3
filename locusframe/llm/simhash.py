"""SimHash fingerprints and search within a Hamming radius (operator 7).

Each distinct term of a text hashes to 64 signed bits that vote with the term's weight (1 + ln of
its count); the signs of the sums are the fingerprint.  The search cuts fingerprints in
``radius + 1`` and more blocks: two within the radius agree on at least ``blocks - radius`` of
them, so equality joins on every such choice of blocks (the permuted tables) find all of them.
The query searches every hundredth document's fingerprint in those of all documents.

Defined cases: a null text counts as empty; a text without terms has fingerprint 0; equal texts
have equal fingerprints; repeated rows are fingerprinted each for itself; of rows with equal
``doc_id`` the order is that of their texts' checksums, then texts; an empty table gives an
empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import map_pandas, materialise, read_table, renamed_apart

BITS = 64
QUERY_STEP = 100  # documents whose id it divides are searched for
HOT = 256  # fingerprints that share a key before it is cut further
_TERM = re.compile(r"\w+")


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the lower-cased words of ``text``."""
    terms = Counter(_TERM.findall(text.lower()))
    if not terms:
        return 0
    votes = np.zeros(BITS)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), dtype=np.uint64, count=len(terms))
    weights = 1 + np.log(np.fromiter(terms.values(), dtype=float, count=len(terms)))
    for a in range(0, len(keys), 4096):
        bits = np.unpackbits(keys[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[a : a + 4096] @ (bits * 2.0 - 1)
    return int.from_bytes(np.packbits(votes > 0, bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint long`` (two's complement) of every whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [_signed(fingerprint(t or "")) for t in pdf["text"]]})

    source = renamed_apart(docs, "doc_id", "text")
    return map_pandas(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _edges(blocks: int) -> list[int]:
    return [BITS * i // blocks for i in range(blocks + 1)]


def _tables(radius: int, blocks: int) -> list[int]:
    """Masks of the permuted tables: every choice of ``blocks - radius`` blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must exceed the radius")
    edges = _edges(blocks)
    return [sum(((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _keys(prints: DataFrame, masks: list[int], name: str) -> DataFrame:
    """``t, key`` and the fingerprint as ``name``, one row for each mask; ``t`` numbers the masks."""
    table = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks)])
    return prints.select(F.col("fingerprint").alias(name), F.explode(table).alias("x")).select(name, F.col("x.t").alias("t"), F.col(name).bitwiseAND(F.col("x.m")).alias("key"))


def _finer(mask: int, radius: int, parts: int) -> list[int]:
    """``mask`` with every choice of ``parts - radius`` of ``parts`` about equal cuts of the other bits."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [sum(1 << i for i in rest[len(rest) * k // parts : len(rest) * (k + 1) // parts]) for k in range(parts)]
    return [mask | sum(cuts[i] for i in chosen) for chosen in combinations(range(parts), parts - radius)]


def search(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6, most: int = HOT) -> DataFrame:
    """``a, b, distance``: for each query fingerprint ``a`` all fingerprints ``b`` at most ``radius`` bits apart, itself too.

    Both tables have one row for each distinct ``fingerprint``.  A key that more than ``most``
    fingerprints share is cut further: two within the radius that agree on its blocks differ by as
    few bits in the others, so the same choice of blocks is made among these, with longer keys.
    """
    masks = _tables(radius, blocks)
    asked = _keys(queries, masks, "a")
    # Only keys that a query has can meet: all keys are dealt once, and what meets none goes at once.
    # Neither side is small for good, so none is broadcast.
    wanted = asked.select("t", "key").distinct().hint("merge")
    keyed = materialise(_keys(prints, masks, "b").join(wanted, ["t", "key"], "left_semi"))
    # Keys that are too large are known before any pair is made.
    hot = materialise(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, ["t", "key"]).select("a", "b", distance).where(F.col("distance") <= radius)

    found = pairs(asked.join(hot, ["t", "key"], "left_anti"), keyed)
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in _finer(mask, radius, blocks)]) for mask in masks])

    def cut(side: DataFrame, name: str) -> DataFrame:
        rows = side.join(hot, ["t", "key"], "left_semi").select(name, "t", F.posexplode(F.get(finer, F.col("t"))).alias("u", "m"))
        return rows.select(name, (F.col("t") * 1000 + F.col("u")).alias("t"), F.col(name).bitwiseAND(F.col("m")).alias("key"))

    return found.unionByName(pairs(cut(asked, "a"), cut(keyed, "b"))).distinct()


def within_radius(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs ``a < b, distance`` of different fingerprints at most ``radius`` bits apart.

    ``prints`` has one row for each distinct fingerprint (column ``fingerprint``), so copies form
    one class however many they are.
    """
    return search(prints, prints, radius, blocks).where("a < b")


def count_near(rows: DataFrame, radius: int = 3) -> DataFrame:
    """``rows`` with ``n_near``: for query documents how many other rows of the table are within the radius, else null.

    Queries are the rows whose ``doc_id`` is divisible by ``QUERY_STEP``; every row is searched.
    """
    prints = materialise(rows.groupBy(F.conv("fingerprint", 16, -10).cast("long").alias("fingerprint")).agg(F.count("*").alias("copies"), F.coalesce(F.bool_or(F.col("doc_id") % QUERY_STEP == 0), F.lit(False)).alias("asked")))
    met = search(prints.where("asked").select("fingerprint"), prints.select("fingerprint"), radius)
    near = met.join(prints.select(F.col("fingerprint").alias("b"), "copies"), "b").groupBy("a").agg((F.sum("copies") - 1).alias("near"))
    asked = rows.where(F.col("doc_id") % QUERY_STEP == 0).withColumn("a", F.conv("fingerprint", 16, -10).cast("long"))
    rest = rows.where(F.coalesce(F.col("doc_id") % QUERY_STEP != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long"))
    return asked.join(near, "a").drop("a").withColumnRenamed("near", "n_near").unionByName(rest)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and an edited one whose second half comes from the next document.

    Next means the next lower ``doc_id``; after the last comes the first.  Rows are dealt to
    ranges of ``doc_id`` in that order and streamed; only a range's last row waits for the first
    row of the range that follows.
    """
    spark = docs.sparkSession
    source = renamed_apart(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(key, text: str, own: int, after: str, following: int) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = fingerprint(edited)
        return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{changed:016x}", likeness(own, changed), likeness(own, following)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        for pdf in frames:
            done = []
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                now = (key, text or "", fingerprint(text or ""))
                if last is None:
                    first = now
                else:
                    done.append(row(*last, now[1], now[2]))
                last = now
            yield pd.DataFrame(done, columns=names).assign(part=part, edge=None, text=None, first_text=None, first_print=None)
        if last is not None:
            waiting = pd.DataFrame([[last[0], len(last[1]), None, f"{last[2]:016x}", None, None, None]], columns=names)
            yield waiting.assign(part=part, edge=True, text=last[1], first_text=first[1], first_print=f"{first[2]:016x}")

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    dealt = source.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text")
    rows = materialise(map_pandas(dealt, run, f"{fields}, part int, edge boolean, text string, first_text string, first_print string"))

    edges = rows.where("edge")
    parts = edges.select("part")  # numbers of the ranges that have rows
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(every)).alias("next_part"))
    heads = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("after"), F.col("first_print").alias("following"))
    ends = edges.select("doc_id", "text", "fingerprint", "part").join(follows, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint", "after", "following")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([row(k, t, int(f, 16), a, int(g, 16)) for k, t, f, a, g in pdf.itertuples(index=False)], columns=names)

    return rows.where("edge is null").select(*names).unionByName(map_pandas(ends, finish, fields))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_near(materialise(compare_edits(read_table(spark, sf_dir, "documents"))))
