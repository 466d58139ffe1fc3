"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in ``spark.checkpoint.dir``.

    Only where that setting is absent on one machine (tests) a folder of our own is set; on a
    cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        if named is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="locusframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named or set_dir


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    # What was shuffled for it is not needed again: the written table takes its place.
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    for tables in _tracked:
        tables.append(out)
    return out


_tracked: list[list[DataFrame]] = []


@contextmanager
def tracked() -> Iterator[list[DataFrame]]:
    """The tables that ``materialise`` writes meanwhile, so that they can be discarded later."""
    tables: list[DataFrame] = []
    _tracked.append(tables)
    try:
        yield tables
    finally:
        _tracked.remove(tables)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``tables``; nothing may read them again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``build``, without the tables that were written on the way to it."""
    with tracked() as tables:
        out = materialise(build())
    discard(*[t for t in tables if t.stage_path != out.stage_path])
    return out


def packed(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The columns of ``df`` as one struct ``row``: their names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]).alias("row")


def unpacked(columns: Sequence[str], **changed: Column) -> list[Column]:
    """The columns of a struct ``row`` again, some of them ``changed``."""
    return [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for the small tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def renamed_apart(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in that order: extra or clashing columns never reach an operator."""
    return df.select(*[df[n] for n in names])


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Once for each application: workers can import this package."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='locusframe-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)  # the driver serves it to executors
        _shipped.add(context.applicationId)


def map_pandas(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInPandas(run, schema)
