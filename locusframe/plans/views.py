"""The operators' inputs as views over the driver tables, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BINS = 100  # of a contact map
MUT_BINS = 250  # over the whole range of mutations, whatever it is


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str, bins: int = BINS, experiments: int = 0) -> DataFrame:
    """Two lines of one order in the same run (return flag; N is the reference) are a contact of their parts' bins.

    Orders are dealt to so many ``experiments``, if any.
    """
    parts = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    at = F.floor(F.col("l_partkey") * bins / parts).cast("int")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("run"), at.alias("i"))
    pairs = lines.join(lines.withColumnRenamed("i", "j"), ["l_orderkey", "run"])
    keys = [F.concat(F.lit("exp"), F.col("l_orderkey") % experiments).alias("experiment")] if experiments else []
    return pairs.groupBy(*keys, "run", "i", "j").agg(F.count("*").cast("double").alias("value"))


def contacts_sql(bins: int = BINS) -> str:
    return f"""b AS (SELECT l_orderkey AS o, l_returnflag AS run, CAST(floor(l_partkey * {bins} / (SELECT count(*) FROM part)) AS INT) AS bin FROM lineitem),
c AS (SELECT x.run, x.bin AS i, y.bin AS j, count(*)::DOUBLE AS value FROM b x JOIN b y ON x.o = y.o AND x.run = y.run GROUP BY ALL)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") * 100
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("chrom"), start.alias("start"), (start + 1 + F.col("o_custkey") % 300).alias("end"),
        F.concat(F.lit("iv"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


INTERVALS = """v AS (SELECT o_orderpriority AS chrom, o_orderkey * 100 AS start, o_orderkey * 100 + 1 + o_custkey % 300 AS "end", 'iv' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders)"""

CHROMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chrom = F.get(F.array(*map(F.lit, CHROMS)), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select(chrom.alias("chrom"), (F.col("p_partkey") * 700).alias("start"), (F.col("p_partkey") * 700 + F.col("p_size") * 20).alias("end"))


DOMAINS = f"d AS (SELECT ({CHROMS})[p_partkey % 5 + 1] AS chrom, p_partkey * 700 AS start, p_partkey * 700 + p_size * 20 AS \"end\" FROM part)"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).groupBy("chrom").agg((F.max("end") + 1000).alias("size"))


SIZES = 's AS (SELECT chrom, max("end") + 1000 AS size FROM v GROUP BY chrom)'


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)$", 1)
    run = F.when(number == "1", "Wtd_mut").otherwise(F.concat(F.lit("Rdm_mut_"), number))
    start = F.col("p_partkey") * 64 + F.col("p_size") * 3
    return table(spark, sf_dir, "part").select(run.alias("run"), start.alias("start"), (start + F.col("p_size") * 12).alias("end"))


def mutation_binsize(spark: SparkSession, sf_dir: str, bins: int = MUT_BINS) -> int:
    """Width of ``bins`` bins that reach the end of the last mutation."""
    return int(mutations(spark, sf_dir).agg(F.ceil(F.max("end") / bins)).first()[0])


def mutation_binsize_sql(bins: int = MUT_BINS) -> str:
    return f'(SELECT ceil(max("end") / {bins}.0)::BIGINT FROM m)'


MUTATIONS = r"""m AS (SELECT CASE WHEN p_brand = 'Brand#1' THEN 'Wtd_mut' ELSE 'Rdm_mut_' || regexp_extract(p_brand, '(\d+)$', 1) END AS run, p_partkey * 64 + p_size * 3 AS start, p_partkey * 64 + p_size * 15 AS "end" FROM part)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN]+", "").alias("seq"))


SEQUENCES = "q AS (SELECT doc_id AS seq_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g') AS seq FROM documents)"


def track(spark: SparkSession, sf_dir: str, bins: int = BINS) -> DataFrame:
    parts = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    price = F.col("p_retailprice") + F.col("p_size")
    return table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") * bins / parts).cast("int").alias("bin")).agg(F.round(F.avg(price), 6).alias("track"))


TRACK = f"t AS (SELECT CAST(floor(p_partkey * {BINS} / (SELECT count(*) FROM part)) AS INT) AS bin, round(avg(p_retailprice + p_size), 6) AS track FROM part GROUP BY 1)"
