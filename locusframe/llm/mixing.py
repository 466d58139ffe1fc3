"""Mixing sources to target weights (operator 6), in DataFrame operations only.

Water-filling: the budget is shared by weight; a source whose share would pass ``max_epochs``
times its size is clamped there, and what is left goes to the others by weight, until none is
above.  With sources ordered by cap over weight the clamped ones are a prefix, so one pass of
running sums over the table of sources gives the fixed point of that loop.

Within a source each document is taken whole as often as the target has whole epochs.  The rest
of an epoch goes to documents in seeded hash order until it is used up; the last one gives its
first words only, so a source's words meet its rounded target exactly.

Defined cases: a null or blank text has size 0 and takes 0; a null source is a source of its own
and the last; a source of size 0 has target 0; repeated rows count each for itself; null
``doc_id`` hashes as a digest of the text; an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import packed, read_table, unpacked

WORDS = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source (three hexadecimal digits): no window holds more than one of them.
BUCKET_DIGITS = 3


def with_size(docs: DataFrame, text_hash: bool = False) -> DataFrame:
    """``doc_id, source, key, size``: words of each text; on demand ``_tid``, a hash that tells texts of one doc_id apart."""
    extra = [F.xxhash64("text").alias("_tid")] if text_hash else []
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", "source", *extra, key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source: ``source, source_size, target``; weights repeat along the sources' order."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = totals.select("source", "source_size", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    running = weighed.select(
        "*",
        (F.sum("source_size").over(whole) * share).alias("budget"),
        F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)).alias("clamped"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0))).alias("open_w"),
    )
    # The level if this source and all after it were open; the first one that isn't above its cap sets it for all of those.
    level = (F.col("budget") - F.col("clamped")) / F.col("open_w")
    fits = F.when(level * F.col("w") <= F.col("cap"), level)
    return running.select("source", "source_size", "w", "cap", F.max(fits).over(whole).alias("level")).select(
        "source", "source_size", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, text_hash: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, epochs``; ``taken`` counts repeats."""
    sized = with_size(docs, text_hash)
    goal = targets(sized, weights, share, max_epochs)
    words = F.floor(F.col("target") + 0.5).cast("long")
    per_source = goal.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("rest", words - F.col("whole") * F.col("source_size"))
    hashed = sized.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "key"))).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *["_tid"] * text_hash).rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("c", F.coalesce(F.sum("size").over(within), F.lit(0)))
    known = placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["bucket"] == starts["b"])).drop("s", "b")
    known = known.join(per_source, known["source"].eqNullSafe(per_source["s"])).drop("s")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("c")))
    return known.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "source", F.when(F.col("size") > 0, F.col("whole") + part / F.col("size")).otherwise(0.0).alias("epochs"), *["_tid"] * text_hash)


def repeated(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken; a part of an epoch keeps a text's first words.

    The columns of ``docs`` stay, with ``n_chars``, where there is one, counted anew.
    """
    mixed = mix(docs.select("doc_id", "source", "text"), weights, share, max_epochs, seed, text_hash=True)
    # Rows of one doc_id and text are alike in size; what the mix takes of them together is dealt out to one row.
    plan = mixed.groupBy("doc_id", "_tid", "source").agg(F.sum("taken").alias("taken"), F.first("size").alias("size")).where("taken > 0").toDF("d", "t", "s", "taken", "size")
    one = docs.select(packed(docs), "doc_id", "source", "text", F.xxhash64("text").alias("tid")).dropDuplicates(["doc_id", "source", "tid"])
    found = one.join(plan, one["doc_id"].eqNullSafe(plan["d"]) & one["source"].eqNullSafe(plan["s"]) & (one["tid"] == plan["t"]))
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = found.withColumn("copy", F.explode(copies)).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    first = F.array_join(F.slice(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), F.lit(1), F.col("words").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*unpacked(docs.columns, **changed))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB: the running sums, seeded order and rounding are stated once more.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS size FROM documents
), weighed AS (
  SELECT source, source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), running AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, CASE WHEN level * w <= cap THEN level * w ELSE cap END AS target
  FROM (SELECT source, source_size, w, cap, max(CASE WHEN level * w <= cap THEN level END) OVER () AS level FROM running)
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM goal
), placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM sized
)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - whole * source_size - c)))::BIGINT AS taken
FROM placed JOIN parts ON placed.source IS NOT DISTINCT FROM parts.source
"""
