"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialise


def _star(edges: DataFrame) -> DataFrame:
    """For each node ``u`` with neighbours ``v``: the least of them all as ``m``, kept beside each ``v``."""
    return edges.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))


def _both(edges: DataFrame, *ways: tuple[str, str]) -> DataFrame:
    """An edge ``u, v`` for each of ``ways``, the two columns of ``edges`` that hold its ends."""
    pairs = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ways]
    return edges.select(F.explode(F.array(*pairs)).alias("edge")).select("edge.*")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest reachable node) for every node of ``edges`` (columns ``a, b``).

    Large-star links every larger neighbour to the least one, small-star every smaller neighbour
    and the node itself.  No neighbour list is gathered; a round is three shuffles of the edges, by two
    windows (a node's rows stand sorted and can spill) and what makes edges distinct.  Rounds end when
    the edges no longer change; each is written, and frees what it shuffled and what the one before it
    wrote.  Self-loops, repeated edges and null ends are ignored; an empty table gives an empty table.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _digest(now)
    for _ in range(most_rounds):
        large = _star(_both(now, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        linked = _both(_star(large), ("v", "m"), ("u", "m"))
        last, now = now, materialise(linked.where("u <> v").distinct())
        found = _digest(now)
        discard(last)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.bit_xor(h)).first())
