"""Ranked lexical search with deduplicated bags (operator 13).

For a slice of items, documents are restricted to the items' vocabulary: a document becomes its
length and the frequencies of the items' terms in it.  Documents with the same frequencies and the same
length norm have the same score for every item, so they form a class: rows meet by a hash and by the
whole bag, which verifies it.  A class is scored once against all items of the slice, and the best
classes are expanded to their members by ascending ``doc_id``.  Of a class the ``top`` smallest
``doc_id`` are enough, however many copies it has: no result needs more.

Scores are sums of whole numbers; block products in doubles are used only where every partial sum is
below 2^53, so they are exact too.  Items are taken in slices of a bounded number of terms; only a
slice's terms, weights and items reach the workers.

Defined cases: a null or empty text has no terms and is never ranked; a null ``doc_id`` is ranked
after all others of its score and stays null; rows with equal ``doc_id`` are documents of their
own, and rows with equal ``item_id`` are items of their own; texts of any length are read whole; at equal
scores the smaller ``doc_id`` comes first; an item without terms, or whose terms no document
has, gives no row, and so do empty tables; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialise, read_table, ship_package

#: Bytes of terms, A-Z lower-cased: 0-9, a-z and all beyond ASCII; every other byte ends a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
CELLS = 4_000_000  # of a block of classes by terms that is scored at once
LENGTH_SHARE = 75


def terms(text: bytes) -> list[bytes]:
    """The terms of a text's UTF-8 bytes, in order."""
    return text.translate(_TERM).split()


def slices(items: DataFrame, most_terms: int, most_items: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their terms, in slices of at most ``most_items`` items and ``most_terms`` terms (a longer item alone)."""
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    for row in items.select("item_id", F.coalesce(items["text"], F.lit("")).cast("binary").alias("text")).toLocalIterator():
        found = terms(bytes(row["text"]))
        if not found:
            continue
        if held and (size + len(found) > most_terms or len(held) == most_items):
            yield held
            held, size = [], 0
        held.append((row["item_id"], found))
        size += len(found)
    if held:
        yield held


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, freqs`` of every document with a term; ``terms`` are ascending places in the vocabulary."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            sizes, places, freqs = [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                sizes.append(len(found))
                bag = Counter(map(place, found))
                bag.pop(None, None)
                order = sorted(bag)
                places.append(order)
                freqs.append([bag[t] for t in order])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, kind), pa.array(freqs, kind)], ["doc_id", "n", "terms", "freqs"])

    source = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, freqs array<int>").where("n > 0")


def classes(found: DataFrame, total: int, length: int, top: int) -> DataFrame:
    """One row for each bag with its norm: ``terms, freqs, m`` and its ``top`` smallest ``members``.

    Rows meet by the hash of bag and norm together with the bag itself, so equal hashes of different
    bags stay apart.  A task keeps ``top`` rows of a class before the shuffle, so copies don't pile up.
    """
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {total}L) div {length}L")
    held = found.where(F.size("terms") > 0).select("doc_id", "terms", "freqs", m.alias("m"))
    bag = ["hash", "m", "terms", "freqs"]
    ranked = held.withColumn("hash", F.xxhash64("m", "terms", "freqs")).withColumn("nth", F.row_number().over(Window.partitionBy(*bag).orderBy(F.col("doc_id").asc_nulls_last())))
    member = F.struct("nth", "doc_id")
    return ranked.where(F.col("nth") <= top).groupBy(*bag).agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["doc_id"]).alias("members"))


def best_classes(bagged: DataFrame, items: list[list[int]], weights: np.ndarray, top: int) -> DataFrame:
    """``item, score, members`` of each task's ``top`` best classes for each item, by score, then first member."""
    spark = bagged.sparkSession
    wanted = np.zeros((len(weights), len(items)))
    for k, places in enumerate(items):
        np.add.at(wanted[:, k], places, 1.0)
    # The largest score there can be: the share of a term's frequency is below 10^6.
    reach = int((weights[:, None].astype(object) * wanted.astype(np.int64).astype(object)).sum(axis=0).max(initial=0)) * 1_000_000
    exact = np.float64 if reach < 2**53 else np.int64
    shared = spark.sparkContext.broadcast((wanted.astype(exact), weights.astype(np.int64)))
    step = max(1, CELLS // max(1, len(weights)))
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        floor = np.zeros(wanted.shape[1], dtype=np.int64)  # scores below can't be among the best
        kept: list[list[tuple]] = [[] for _ in range(wanted.shape[1])]
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                sizes = np.array([len(x) for x in part.column("terms")])
                place, freq = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "freqs"))
                row = np.repeat(np.arange(len(part)), sizes)
                norm = part.column("m").to_numpy()[row]
                share = np.zeros((len(part), len(weights)), dtype=exact)
                share[row, place] = weights[place] * ((1_000_000_000 * freq) // (1000 * freq + 8 * norm))
                scores = (share @ wanted).astype(np.int64)
                first = part.column("first").to_numpy()
                for k in np.nonzero((scores > 0).any(axis=0) & (scores.max(axis=0) >= floor))[0]:
                    column = scores[:, k]
                    least = max(floor[k], 1)
                    if len(column) > top:
                        least = max(least, np.partition(column, -top)[-top])
                    near = np.nonzero(column >= least)[0]
                    near = near[np.lexsort((first[near], -column[near]))][:top]
                    kept[k] = sorted(kept[k] + [(-int(column[i]), int(first[i]), part.column("members")[int(i)].as_py()) for i in near], key=lambda x: x[:2])[:top]
                    if len(kept[k]) == top:
                        floor[k] = -kept[k][-1][0]
        flat = [(k, -s, members) for k, best in enumerate(kept) for s, _, members in best]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.list_(pa.int64()))], ["item", "score", "members"])

    ready = bagged.select("terms", "freqs", "m", F.transform("members", lambda x: x.cast("long")).alias("members"), F.coalesce(F.element_at("members", 1).cast("long"), F.lit(int(last))).alias("first"))
    return ready.mapInArrow(run, "item int, score long, members array<long>")


def _searched(docs: DataFrame, items: list[tuple[object, list[bytes]]], item_type: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, found in items for t in found})
    place = {t: i for i, t in enumerate(vocabulary)}
    found = materialise(bags(docs, vocabulary))
    sums = found.agg(F.count("*").alias("total"), F.sum("n").alias("length")).first()
    total, length = sums["total"], sums["length"] or 0
    held = np.zeros(len(vocabulary), dtype=np.int64)
    for row in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[row["term"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) if df else 0 for df in held], dtype=np.int64)
    best = best_classes(classes(found, total, max(length, 1), top), [[place[t] for t in ts] for _, ts in items], weights, top)
    members = best.select("item", "score", F.explode("members").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = members.withColumn("rank", rank).where(F.col("rank") <= top)
    names = spark.createDataFrame([Row(item=k, item_id=name) for k, (name, _) in enumerate(items)], f"item int, item_id {item_type}")
    out = materialise(ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    discard(found)
    return out


def search(docs: DataFrame, items: DataFrame, top: int = 10, most_terms: int = 20_000, most_items: int = 500) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents with a score above 0."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = [_searched(docs, part, kind, top) for part in slices(items, most_terms, most_items)]
    none = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else none


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same rows in DuckDB: every document against every item, term by term.
ORACLE_SQL = r"""
WITH found AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), held AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, ts, len(ts) AS n FROM found WHERE len(ts) > 0
), sums AS (
  SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS total FROM held
), freqs AS MATERIALIZED (
  SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ts) AS term FROM held) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM sums) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM freqs GROUP BY term
), asked AS MATERIALIZED (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), norms AS (
  SELECT doc, doc_id, (100 - 75 + (75 * n * docs) // total)::BIGINT AS m FROM held, sums
), scores AS (
  SELECT item_id, doc, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN freqs USING (term) JOIN weights USING (term) JOIN norms USING (doc) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
