"""Cutting lineage: tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only on one machine (tests) a folder of our own is set where that setting is absent; on a
    cluster its absence is an error.
    """
    named, found = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if found is None:
        if named is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="locusframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named or found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and not again when an executor is lost."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
