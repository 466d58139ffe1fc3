"""Exact quantiles of large groups: distributed selection by refined histograms.

``percentile`` keeps all values of a group in one buffer.  Here a pass counts the values of each group by
``BUCKETS`` equal steps between its least and largest one; the step that holds a wanted place goes on, as
the range of the values found in it.  After a few passes every wanted place is down to one value, or to so
few that they are sorted.  A buffer never holds more than the counts of a range or ``FEW`` values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BUCKETS = 1024
FEW = 4096  # values that are sorted instead of counted again
PASSES = 400  # more than any range of doubles needs


def _step(x: Column, low: Column, high: Column) -> Column:
    """The step of ``x`` between two finite values; infinite and undefined ones have steps of their own at the ends."""
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return F.when(x == float("-inf"), -1).when(F.isnan(x), BUCKETS + 1).when(x == float("inf"), BUCKETS).otherwise(F.greatest(inner, F.lit(0)))


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(a, b, strict=True):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def quantiles(df: DataFrame, value: str, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys, quantiles`` (an array, one for each of ``probs``), the same as ``percentile`` gives.

    NULL values are left out; groups without values have no row.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    values = cut(df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(value).cast("double").alias("_x")))
    finite = F.when(~F.isnan("_x") & (F.abs("_x") != float("inf")), F.col("_x"))
    groups = values.groupBy(*k).agg(F.count("*").alias("_n"), F.coalesce(F.min(finite), F.lit(0.0)).alias("_low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("_high"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_n") - 1) * F.lit(float(p))).alias("place")) for i, p in enumerate(probs)])
    placed = groups.withColumn("_p", F.explode(at)).select(*k, "_n", "_low", "_high", F.col("_p.i").alias("_i"), F.col("_p.place").alias("_place"))
    asked = cut(placed.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place"))))).withColumns({"_left": F.col("_rank"), "_count": F.col("_n")}))
    # _low.._high holds _count values, the wanted one is number _left of them.
    open_, done = asked.select(*k, "_rank", "_low", "_high", "_left", "_count").distinct(), []
    r = [f"_r{i}" for i in range(len(k))]
    for depth in range(PASSES):
        ranges = open_.select(*[F.col(a).alias(b) for a, b in zip(k, r, strict=True)], "_low", "_high").distinct()
        inside = F.lit(True) if depth == 0 else (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high"))
        counted = values.join(ranges, _same(k, r) & inside).withColumn("_step", _step(F.col("_x"), F.col("_low"), F.col("_high")))
        steps = counted.groupBy(*k, "_low", "_high", "_step").agg(F.count("*").alias("_found"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        upto = F.sum("_found").over(Window.partitionBy(*k, "_low", "_high").orderBy("_step"))  # a row for each step
        steps = steps.withColumn("_before", upto - F.col("_found")).withColumnsRenamed({**dict(zip(k, r, strict=True)), "_low": "_l", "_high": "_h"})
        hit = open_.join(steps, _same([*k, "_low", "_high"], [*r, "_l", "_h"]) & (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_found")))
        found = cut(hit.select(*k, "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_left") - F.col("_before")).alias("_left"), F.col("_found").alias("_count")))
        one = F.col("_low").eqNullSafe(F.col("_high"))
        done.append(found.where(one).select(*k, "_rank", F.col("_low").alias("_value")))
        few = found.where(~one & (F.col("_count") <= FEW))
        listed = values.join(few.select(*[F.col(a).alias(b) for a, b in zip(k, r, strict=True)], "_low", "_high").distinct(), _same(k, r) & (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high")))
        sorted_ = listed.groupBy(*r, "_low", "_high").agg(F.sort_array(F.collect_list("_x")).alias("_all")).withColumnsRenamed({"_low": "_l", "_high": "_h"})
        done.append(few.join(sorted_, _same([*k, "_low", "_high"], [*r, "_l", "_h"])).select(*k, "_rank", F.get("_all", F.col("_left").cast("int")).alias("_value")))
        open_ = found.where(~one & (F.col("_count") > FEW))
        if open_.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    order = every.withColumnsRenamed(dict(zip(k, r, strict=True))).withColumnRenamed("_rank", "_number")
    both = asked.join(order, _same([*k, "_rank"], [*r, "_number"])).select(*k, "_i", "_place", "_rank", "_value")
    ends = both.groupBy(*k, "_i", "_place").agg(F.min_by("_value", "_rank").alias("_a"), F.max_by("_value", "_rank").alias("_b"))
    low = F.floor("_place")
    mixed = F.when((F.col("_place") == low) | F.col("_a").eqNullSafe(F.col("_b")), F.col("_a")).otherwise((low + 1 - F.col("_place")) * F.col("_a") + (F.col("_place") - low) * F.col("_b"))
    listed = ends.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), mixed.alias("v")))), lambda s: s["v"]).alias("quantiles"))
    return listed.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], "quantiles")
