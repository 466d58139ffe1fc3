"""Contiguous shards of balanced size (operator 8), in DataFrame operations only.

Rows are dealt to ranges of ``doc_id``; each range's total is summed over the ranges before it,
and within a range a running sum continues from there.  The global prefix sum of bytes is cut at
equal targets: a row goes to the shard in which its middle byte falls.  Products and quotients are
whole numbers, so no cut is rounded.  A shard that lies within one long document has no row.

Defined cases: a null text has no bytes (size 8); null ``doc_id`` comes first; rows with equal
``doc_id`` follow by checksum, then size; an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, read_table

OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shards of near equal bytes, gapless slots in each."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    return cut_evenly(docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32")), shards)


def cut_evenly(sized: DataFrame, shards: int) -> DataFrame:
    """Rows ``doc_id, size, text_crc32`` in that order, with the ``shard`` of each and its ``slot`` there."""
    spark = sized.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: a second run of the range sort could draw its bounds elsewhere.
    dealt = materialise(sized.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("n"))  # one row for each range
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("part").orderBy(*order)
    running = dealt.withColumns({"upto": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)), "row": F.row_number().over(within)})
    middle = F.col("start") + F.col("upto") - F.expr("size div 2") - 1
    cut = running.join(starts, "part").withColumn("middle", middle).withColumn("shard", F.expr(f"(cast(middle as decimal(28,0)) * {shards}BD) div cast(all as decimal(28,0))").cast("int"))
    # A slot counts the shard's rows in earlier ranges, then those before it in its own range.
    held = cut.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("offset"))
    return cut.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("row") + F.col("offset")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(read_table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same rows in DuckDB by brute force: the checksum byte by byte, one running sum.
ORACLE_SQL = r"""
WITH digits AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(b))
), bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS data FROM documents
), sized AS MATERIALIZED (
  SELECT doc_id, size::BIGINT AS size, xor(list_reduce([4294967295] || data, lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)::BIGINT AS text_crc32 FROM bytes, digits
), placed AS (
  SELECT *, (sum(size) OVER before - size // 2 - 1)::HUGEINT * 24 // (sum(size) OVER ())::HUGEINT AS shard FROM sized WINDOW before AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM placed
"""
