"""Running values along an order, spread over all tasks whatever the keys.

A window over one chromosome is one task.  Here rows are dealt to ranges of keys and order together, so
a chromosome takes as many tasks as it has rows for; each range is scanned by itself, the
totals of the ranges are scanned in turn (one row for each range and key), and a range continues from
what the ranges before it carry.  That holds for any associative value: sums, counts, largest and
last values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

PART = "_part"


def dealt(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in ranges of ``order``, their numbers in ``_part``; equal places end in one range.

    Stored once: a second run of the range sort could draw its bounds elsewhere.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(ranges, *order).withColumn(PART, F.spark_partition_id()))


def _total(how: str, value: Column) -> Column:
    return {"sum": F.sum(value), "max": F.max(value), "last": F.last(value, ignorenulls=True)}[how]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], reverse: bool = False, **values: tuple[str, str]) -> DataFrame:
    """``df`` with a column for each of ``values``: ``name=(how, column)`` over all rows before a row.

    ``how`` is ``sum`` (0 at first), ``max`` or ``last`` (the last value that is not NULL; both NULL
    at first).  ``order`` ends in what tells rows of one place apart; ``reverse`` runs from the end.
    """
    return scanned(dealt(df, [*keys, *order]), keys, order, reverse, **values).drop(PART)


def scanned(ranges: DataFrame, keys: Sequence[str], order: Sequence[str], reverse: bool = False, **values: tuple[str, str]) -> DataFrame:
    """``running`` on rows that ``dealt`` has put in ranges of ``keys`` and ``order``."""
    way = (lambda c: F.col(c).desc_nulls_last()) if reverse else (lambda c: F.col(c).asc_nulls_first())
    # The last value of a range is the one with the largest place: structs compare by their first field.
    place, pick = F.struct(*[F.col(c) for c in order]), F.min_by if reverse else F.max_by
    ends = [(pick(F.col(c), F.when(F.col(c).isNotNull(), place)) if how == "last" else _total(how, F.col(c))).alias(f"_v_{n}") for n, (how, c) in values.items()]
    along = Window.partitionBy(*keys).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.groupBy(PART, *keys).agg(*ends).select(PART, *keys, F.lit(0).alias("_own"), *[_total(how, F.col(f"_v_{n}")).over(along).alias(f"_v_{n}") for n, (how, _) in values.items()])
    # What is carried comes as the first row of a range, so that one window adds it to what follows.
    rows = ranges.select("*", F.lit(1).alias("_own"), *[F.col(c).alias(f"_v_{n}") for n, (_, c) in values.items()]).unionByName(carried, allowMissingColumns=True)
    before = Window.partitionBy(PART, *keys).orderBy("_own", *map(way, order)).rowsBetween(Window.unboundedPreceding, -1)
    out = {n: _total(how, F.col(f"_v_{n}")).over(before) for n, (how, _) in values.items()}
    whole = rows.select(*[c for c in ranges.columns if c not in values], "_own", *[(F.coalesce(e, F.lit(0)) if values[n][0] == "sum" else e).alias(n) for n, e in out.items()])
    return whole.where("_own = 1").drop("_own")
