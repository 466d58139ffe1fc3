"""Sinks of intervals, traces, sequences and scores, written by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 60


def write_bed(df: DataFrame, path: str) -> None:
    columns = [c for c in ("chrom", "start", "end", "name") if c in df.columns]
    rest = [F.lit("."), F.col("strand")] if "strand" in df.columns and "name" in columns else []
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns], *rest).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A trace, run manifest or level table: tab-separated with a header."""
    df.write.partitionBy(*partition_by).csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def write_trace(trace: DataFrame, path: str) -> None:
    """Traces in a folder for each ``experiment`` and ``run``."""
    write_table(trace, path, [c for c in ("experiment", "run") if c in trace.columns])


def write_runs(runs: DataFrame, path: str) -> None:
    """A run manifest as one file; ``_`` stands for no trace."""
    write_table(runs.withColumn("trace_path", F.coalesce("trace_path", F.lit("_"))).coalesce(1), path)


def unused_name(spark: SparkSession, path: str) -> str:
    """``path``, or ``path_1``, ``path_2`` and so on if it exists."""
    name, k = path, 0
    while True:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return name
        k += 1
        name = f"{path}_{k}"


def write_fasta(sequences: DataFrame, path: str) -> None:
    """One record of ``seq_id, seq`` with ``n_mutations`` in its header: upper case, lines of ``WIDTH``."""
    head = F.format_string(">%s mutated chromosome %s mutations", F.col("seq_id").cast("string"), F.col("n_mutations").cast("string"))
    body = F.regexp_replace(F.upper("seq"), f"(.{{{WIDTH}}})(?!$)", "$1\n")
    sequences.select(F.concat_ws("\n", head, body).alias("value")).write.text(path)


def write_scores_wide(scores: DataFrame, path: str) -> str:
    """A line for each run and score type: its values in order of the bins, of which a map has a few hundred.

    Returns the name that was written to, the first unused one.
    """
    path = unused_name(scores.sparkSession, path)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bin", F.coalesce(F.col("value").cast("string"), F.lit("nan")).alias("v")))), lambda x: x["v"])
    lines = scores.groupBy("run", "score_type").agg(F.concat_ws("\t", ordered).alias("values"))
    lines.select(F.concat_ws("\t", "run", "score_type", "values").alias("value")).write.text(path)
    return path


def write_scores_long(scores: DataFrame, path: str, mode: str = "append") -> None:
    scores.write.mode(mode).partitionBy("resolution").parquet(path)
