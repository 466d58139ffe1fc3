"""MinHash near-duplicate detection (operator 2).

A document's set holds the hashes of its distinct five-word shingles.  Documents with equal sets
form a class with a number of its own, of which one document goes on.  Many universal hash minima make a
signature; bands of it are bucket keys.  Candidates are verified by signature, then by their full
sets; verified links are grouped by alternating large-star and small-star.

A bucket never emits all its pairs.  First every member meets the bucket's smallest one.  Only
where members of a bucket are still in different components after that do pairs across components
follow, so a large group of copies costs one link for each member and no link is lost to it.

Defined cases: a text that is null or without words has an empty set and links with nothing; one
of fewer than five words is one shingle; rows of one doc_id are documents of their own, each linked by
its own text, and a component's id is the smallest doc_id of its rows; rows without doc_id keep their
own row, with null component and kept false; a pair at exactly the threshold links; very long texts are
read whole, and few of them share a task; an empty table gives an empty table; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._common import discard, map_pandas, materialise, read_table, renamed_apart, settled
from .components import connected_components

SHINGLE = 5
ROWS, BANDS = 4, 32
BLOCK = 1024  # documents of a family on one side of a meeting
SIDE = 32 << 20  # bytes of full sets on one side of it
SALTS = 16  # ways in which the documents of a component are dealt
PART = 8  # members of a torn bucket that meet one drawn head
#: A signature of 128 minima of a pair at similarity 0.75 agrees on fewer than this share once in a million times.
SIGNATURE_LEAST = 0.55

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ASCII letters count as lower case."""
    words = (text or "").encode().lower().split()  # bytes split at x20 and x09-x0D
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - SHINGLE + 1
    total = h[:n] * _PLACE[0]
    for i in range(1, SHINGLE):
        total += _mixed(h[i : i + n]) * _PLACE[i]
    return np.unique(_mixed(total))


def _digest(items: bytes) -> tuple[int, int]:
    """The 128-bit hash of a packed set as two signed numbers."""
    whole = xxhash.xxh3_128_digest(items)
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def signature(found: np.ndarray) -> np.ndarray:
    """The minima of all universal hash functions over a set."""
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(found), 512):
        values = ((found[a : a + 512, None] * _MULTIPLY + _ADD) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, values.min(axis=0))
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` (128-bit hash of the set), ``sig`` of every whole text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sizes, a, b, sigs = [], [], [], []
            for text in pdf["text"]:
                found = shingles(text)
                first, second = _digest(found.tobytes())
                sizes.append(len(found))
                a.append(first)
                b.append(second)
                sigs.append(signature(found).tobytes() if len(found) else b"")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": sizes, "set_a": a, "set_b": b, "sig": sigs})

    source = renamed_apart(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_pandas(source, run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """``key, doc``: one row for each band of each class."""

    @F.pandas_udf("array<long>")
    def keys(sigs: pd.Series) -> pd.Series:
        number = np.arange(BANDS, dtype=np.uint64)
        out = []
        for s in sigs:
            part = np.frombuffer(s, dtype=np.uint32).astype(np.uint64).reshape(BANDS, ROWS)
            h = number
            for i in range(ROWS):
                h = _mixed((h ^ part[:, i]) * _MULTIPLY[i])
            out.append(h.view(np.int64))
        return pd.Series(out)

    return classes.select(F.explode(keys("sig")).alias("key"), "doc")


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32))) for x, y in zip(a, b, strict=True)])


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, items``: the packed shingle hashes of the classes in ``wanted``, from a document of each."""
    few = classes.join(wanted, "doc", "left_semi").select("doc", "set_a", "set_b", F.col("least").alias("doc_id"))

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            items = [shingles(t).tobytes() for t in pdf["text"]]
            a, b = zip(*map(_digest, items), strict=True) if items else ((), ())
            yield pd.DataFrame({"set_a": a, "set_b": b, "items": items}).astype({"set_a": "int64", "set_b": "int64"})

    texts = renamed_apart(docs, "doc_id", "text").join(few.select("doc_id").distinct(), "doc_id", "left_semi")
    # A doc_id may have several texts, of which the class's own is wanted.
    full = map_pandas(texts, sets, "set_a long, set_b long, items binary").join(few.drop("doc_id"), ["set_a", "set_b"])
    return materialise(full.groupBy("doc").agg(F.first("items").alias("items")))


def _across_families(torn: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` across components, from all pairs of documents that torn buckets hold together.

    Such documents form families; a family is cut into blocks, by number and by bytes of full sets, and each
    block meets each other one.
    Only pairs that look similar enough leave a meeting, and of those only what joins components.
    """
    families = materialise(connected_components(torn.select(F.col("doc").alias("a"), F.col("head").alias("b"))).toDF("doc", "family"))
    full = _full_sets(docs, classes, families.select("doc"))
    held = families.join(full.select("doc", F.octet_length("items").alias("bytes")), "doc").groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = held.select("family", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / SIDE)).cast("int").alias("parts"))
    members = families.join(sizes, "family").join(torn.select("doc", "group").distinct(), "doc").join(classes.select("doc", "sig"), "doc").join(full, "doc")
    placed = members.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc", "group", "sig", "items")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["part"] == pdf[c].iloc[0]] for c in "ij"]
        (docs_a, group_a, items_a), (docs_b, group_b, items_b) = ([x[c].to_list() for c in ("doc", "group", "items")] for x in sides)
        sig_a, sig_b = (np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(-1, ROWS * BANDS) for x in sides)
        root: dict = {}

        def top(x):
            while x in root:
                x = root[x]
            return x

        out = []
        for k in range(len(docs_a)):
            for m in np.flatnonzero((sig_b == sig_a[k]).mean(1) >= SIGNATURE_LEAST).tolist():
                x, y = top(group_a[k]), top(group_b[m])
                if x == y:
                    continue
                p, q = np.frombuffer(items_a[k], np.uint64), np.frombuffer(items_b[m], np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    root[x] = y
                    out.append((min(docs_a[k], docs_b[m]), max(docs_a[k], docs_b[m])))
        return pd.DataFrame(out, columns=["a", "b"])

    kind = torn.schema["doc"].dataType.simpleString()
    pairs = materialise(met.groupBy("family", "i", "j").applyInPandas(meet, f"a {kind}, b {kind}").distinct())
    discard(families, full)
    return pairs


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of ``a, b`` whose signatures agree and whose full sets are similar enough."""
    sig = classes.select("doc", "sig")
    close = materialise(
        pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").where(_agreement("sig_a", "sig_b") >= SIGNATURE_LEAST).select("a", "b")
    )
    if close.isEmpty():
        return close
    full = _full_sets(docs, classes, close.select(F.explode(F.array("a", "b")).alias("doc")).distinct())

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out)

    found = materialise(close.join(full.toDF("a", "items_a"), "a").join(full.toDF("b", "items_b"), "b").where(alike("items_a", "items_b")).select("a", "b"))
    discard(close, full)
    return found


def _torn(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, doc, head, group, members`` of those buckets whose members are in several components."""
    labelled = shared.join(labels, "doc", "left").withColumn("group", F.coalesce("group", "doc"))
    split = labelled.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("members")).where("low < high")
    return materialise(labelled.join(split.select("key", "members"), "key").select("key", "doc", "head", "group", "members"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    every = materialise(signatures(docs))
    filled = every.where("n_shingles > 0 and doc_id is not null")
    # One row for each different set, numbered as it is written.
    classes = materialise(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig")).withColumn("doc", F.monotonically_increasing_id()))

    keyed = materialise(_bands(classes))
    heads = keyed.groupBy("key").agg(F.min("doc").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(heads, "key").select("key", "doc", "head"))  # buckets with more than one member
    discard(keyed)
    met = shared.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    labels = materialise(connected_components(_verified(met, classes, docs, percent)).toDF("doc", "group"))

    # Members of a bucket in different components: first each meets one drawn head of a small part of
    # the bucket, then all pairs across components that are left are compared.
    for salt in (1, 2, None):
        torn = _torn(shared, labels)
        if torn.isEmpty():
            break
        if salt is None:
            pairs = _across_families(torn, classes, docs, percent)
        else:
            part = F.pmod(F.xxhash64("doc", "key", F.lit(salt)), F.ceil(F.col("members") / PART))
            parts = torn.withColumn("part", part)
            heads = parts.groupBy("key", "part").agg(F.min(F.struct(F.xxhash64("doc", F.lit(salt)), F.col("doc").alias("b"), F.col("group").alias("gb"))).alias("x")).select("key", "part", "x.b", "x.gb")
            drawn = parts.join(heads, ["key", "part"]).where("group <> gb")
            pairs = drawn.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct()
        found = _verified(pairs, classes, docs, percent)
        if found.isEmpty():
            continue
        ends = [labels.toDF(x, f"g{x}") for x in "ab"]
        links = found.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
        merged = connected_components(links).toDF("group", "merged")
        nodes = labels.unionByName(found.select(F.explode(F.array("a", "b")).alias("doc")).select("doc", F.col("doc").alias("group")).join(labels, "doc", "left_anti").distinct())
        old, labels = labels, materialise(nodes.join(merged, "group", "left").select("doc", F.coalesce("merged", "group").alias("group")))
        discard(old, torn, found)
    discard(shared)
    groups = labels.toDF("node", "component")

    placed = classes.select("set_a", "set_b", "least", F.col("doc").alias("node")).join(groups, "node", "left").withColumn("number", F.coalesce("component", "node"))
    # A component's smallest doc_id goes back to its classes by several ways, as one may hold most of them.
    ids = placed.groupBy("number").agg(F.min("least").alias("id")).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_class = placed.withColumn("way", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(ids, ["number", "way"]).select("set_a", "set_b", F.col("id").alias("component"))
    member = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    found = every.drop("sig").join(of_class, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", member.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: near_duplicates(read_table(spark, sf_dir, "documents")))


#: The same rows in DuckDB by brute force: shingles as strings, all pairs that share one, and what they reach.
ORACLE_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM listed
), shingles AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS g FROM sets
), links AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.node = l.x
)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(node) AS component_id, doc_id = min(node) AS kept FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""
