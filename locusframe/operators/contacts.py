"""Contact maps in long form: ``keys, i, j, value``; a missing cell is NULL or absent."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import cut

KEYS = ("run",)


def symmetrise(pixels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both halves of a map of which the upper triangle is given."""
    upper = pixels.select(*keys, "i", "j", "value").where("i <= j")
    return upper.unionByName(upper.where("i < j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def spine(contacts: DataFrame, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every bin of every map: ``keys, bin``."""
    return contacts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))


def expected_by_distance(contacts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of each diagonal, 1 for the main one: ``keys, distance, expected``."""
    d = F.abs(F.col("i") - F.col("j"))
    means = contacts.groupBy(*keys, d.alias("distance")).agg(F.avg("value").alias("expected"))
    return means.withColumn("expected", F.when(F.col("distance") == 0, 1.0).otherwise(F.col("expected")))


def expand_expected(expected: DataFrame, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The matrix ``keys, i, j, value`` whose diagonals hold the values of a distance vector."""
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    cells = expected.select(*keys).distinct().select(*keys, every.alias("i")).select(*keys, "i", every.alias("j"))
    placed = cells.withColumn("distance", F.abs(F.col("i") - F.col("j"))).join(expected, [*keys, "distance"])
    return placed.select(*keys, "i", "j", F.col("expected").alias("value"))


def obs_over_exp(contacts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``value`` divided by the expected one at its distance; the small table of diagonals joins back."""
    found = contacts.withColumn("distance", F.abs(F.col("i") - F.col("j"))).join(expected_by_distance(contacts, keys), [*keys, "distance"])
    return found.select(*keys, "i", "j", F.try_divide("value", "expected").alias("value"))


def obs_over_exp_geometric(contacts: DataFrame, ratio: float = 1.03, keys: Sequence[str] = KEYS) -> DataFrame:
    """O/E with distances pooled in bins that grow by ``ratio``; rows and columns without any contact are left out."""
    seen = contacts.groupBy(*keys, "i").agg(F.sum("value").alias("total")).where("total > 0").select(*keys, "i")
    contacts = contacts.join(seen, [*keys, "i"], "left_semi").join(seen.withColumnRenamed("i", "j"), [*keys, "j"], "left_semi")
    d = F.abs(F.col("i") - F.col("j"))
    level = F.when(d == 0, F.lit(-1)).otherwise(F.floor(F.log(d.cast("double")) / F.log(F.lit(ratio)) + 1e-9)).cast("int")
    placed = contacts.withColumn("level", level)
    pooled = placed.groupBy(*keys, "level").agg((F.sum("value") / F.count("value")).alias("expected"))
    return placed.join(pooled, [*keys, "level"]).select(*keys, "i", "j", F.try_divide("value", "expected").alias("value"))


def log_obs(contacts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Natural log; cells that are not positive get the log of 1."""
    return contacts.select(*keys, "i", "j", F.when(F.col("value") > 0, F.log("value")).otherwise(0.0).alias("value"))


def log_oe(contacts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Log of observed over expected; a cell that is NULL or not positive gets the log of 1."""
    ratio = obs_over_exp(contacts, keys)
    return ratio.select(*keys, "i", "j", F.when(F.col("value") > 0, F.log("value")).otherwise(0.0).alias("value"))


def reconstruct_obs(log_oe: DataFrame, expected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Observed values from log O/E and the expected vector; one of 0 or less counts as 1 % of their mean."""
    whole = Window.partitionBy(*keys)
    safe = expected.withColumn("e", F.when(F.col("expected") > 0, F.col("expected")).otherwise(F.avg("expected").over(whole) * 0.01))
    found = log_oe.withColumn("distance", F.abs(F.col("i") - F.col("j"))).join(safe, [*keys, "distance"])
    return found.select(*keys, "i", "j", F.exp(F.col("value") + F.log("e")).alias("value"))


def balance(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    """``value`` times the weights of both bins; ``weights`` has ``bin, weight``."""
    left, right = weights.toDF("i", "wi"), weights.toDF("j", "wj")
    return pixels.join(left, "i").join(right, "j").withColumn("value", F.col("value") * F.col("wi") * F.col("wj")).drop("wi", "wj")


def minmax(contacts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Values scaled to 0..1 within each map."""
    whole = Window.partitionBy(*keys)
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    return contacts.select(*keys, "i", "j", F.try_divide(F.col("value") - low, high - low).alias("value"))


def fill_neighbours(scores: DataFrame, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """NULL values of a vector become the mean of up to three bins before and two after, fewer near the ends.

    The first and last bin take their only inner neighbour.  ``scores`` has a row for every bin;
    each keeps its neighbours' original values.
    """
    order = Window.partitionBy(*keys).orderBy("bin")
    near = lambda h: F.avg("value").over(order.rowsBetween(-h, h - 1))
    inner = F.least(F.col("bin"), bins - 1 - F.col("bin"))
    edge = F.when(F.col("bin") == 0, F.lead("value").over(order)).otherwise(F.lag("value").over(order))
    mean = F.when(inner >= 3, near(3)).when(inner == 2, near(2)).when(inner == 1, near(1)).otherwise(edge)
    return scores.select(*keys, "bin", F.coalesce("value", mean).alias("value"))


def fill_cells(contacts: DataFrame, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """NULL cells become the mean of the cells around them; each keeps its neighbours' original values.

    A cell at least ``h`` bins inside of every edge looks ``h`` bins back and ``h - 1`` ahead on
    both axes, with ``h`` up to 4; one on an edge looks at the four cells beside it.
    """
    h = F.least(F.lit(4), "i", "j", bins - 1 - F.col("i"), bins - 1 - F.col("j"))
    step = lambda a, b: F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"))
    squares = [F.array(*[step(a, b) for a in range(-k, k) for b in range(-k, k)]) for k in range(1, 5)]
    steps = F.when(h == 1, squares[0]).when(h == 2, squares[1]).when(h == 3, squares[2]).when(h == 4, squares[3]).otherwise(F.array(step(-1, 0), step(1, 0), step(0, -1), step(0, 1)))
    holes = contacts.where("value is null").select(*keys, F.col("i").alias("hi"), F.col("j").alias("hj"), F.explode(steps).alias("s"))
    near = holes.select(*keys, "hi", "hj", (F.col("hi") + F.col("s.di")).alias("i"), (F.col("hj") + F.col("s.dj")).alias("j"))
    means = near.join(contacts, [*keys, "i", "j"]).groupBy(*keys, "hi", "hj").agg(F.avg("value").alias("mean")).withColumnsRenamed({"hi": "i", "hj": "j"})
    return contacts.join(means, [*keys, "i", "j"], "left").select(*keys, "i", "j", F.coalesce("value", "mean").alias("value"))


def row_correlation(contacts: DataFrame, bins: int, band: int | None = None, keys: Sequence[str] = KEYS, tile: int = 64) -> DataFrame:
    """Pearson correlation of map rows that have a column in common; ``band`` keeps rows that close only. Absent cells count as 0.

    Rows are dealt to tiles, and each pair of tiles is multiplied once: a cell goes to the tiles that
    its own one meets, not to each row.
    """
    tiles = -(-bins // tile)
    reach = tiles - 1 if band is None else min(tiles - 1, -(-band // tile))
    own = F.floor(F.col("i") / tile).cast("int")
    partners = F.sequence(F.greatest(own - reach, F.lit(0)), F.least(own + reach, F.lit(tiles - 1)))
    met = contacts.select(*keys, "i", "j", F.col("value").cast("double").alias("value"), own.alias("_own"), F.explode(partners).alias("_with")).withColumns({"_a": F.least("_own", "_with"), "_b": F.greatest("_own", "_with")})
    kinds = {f.name: f.dataType.simpleString() for f in contacts.schema.fields}

    def rows(pdf: pd.DataFrame, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        part = pdf[pdf["_own"] == at]
        x, held = np.zeros((tile, bins)), np.zeros((tile, bins))
        i, j = part["i"].to_numpy() - at * tile, part["j"].to_numpy()
        x[i, j], held[i, j] = part["value"].fillna(0.0).to_numpy(), 1
        mean = x.sum(axis=1) / bins
        return x, held, mean, np.sqrt(np.maximum((x * x).sum(axis=1) - mean * mean * bins, 0))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["_a"].iloc[0]), int(pdf["_b"].iloc[0])
        x, held_x, mx, nx = rows(pdf, a)
        y, held_y, my, ny = rows(pdf, b)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (x @ y.T - np.outer(mx, my) * bins) / np.outer(nx, ny)
        i, j = np.nonzero(held_x @ held_y.T > 0)
        value, i, j = value[i, j], i + a * tile, j + b * tile
        if a != b:
            i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
        near = np.abs(i - j) <= (bins if band is None else band)
        out = pd.DataFrame({"i": i[near].astype(np.int32), "j": j[near].astype(np.int32), "value": value[near]})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "i", "j", "value"]]

    found = met.groupBy(*keys, "_a", "_b").applyInPandas(multiply, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "i int, j int, value double"]))
    undefined = F.isnan("value") | (F.abs("value") == float("inf"))
    return found.withColumn("value", F.when(~undefined, F.col("value")))


def join_triangles(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Upper triangle of one map, lower of the other; the diagonal is the mean of all joined cells.

    Maps of different shapes are an error.
    """
    shapes = [df.agg(F.max("i"), F.max("j")).first() for df in (upper, lower)]
    if shapes[0] != shapes[1]:
        raise ValueError(f"maps of different shapes: {tuple(shapes[0])} and {tuple(shapes[1])}")
    both = upper.select("i", "j", F.col("value").alias("a")).join(lower.select("i", "j", F.col("value").alias("b")), ["i", "j"])
    joined = both.select("i", "j", F.when(F.col("i") <= F.col("j"), F.col("a")).otherwise(F.col("b")).alias("value"))
    mean = joined.agg(F.avg("value")).scalar()
    return joined.withColumn("value", F.when(F.col("i") == F.col("j"), mean).otherwise(F.col("value")))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b - a`` for every cell of both."""
    return a.select("i", "j", F.col("value").alias("x")).join(b.select("i", "j", F.col("value").alias("y")), ["i", "j"]).select("i", "j", (F.col("y") - F.col("x")).alias("value"))


def check_square(contacts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Extent and number of cells of each map, and whether it is full and square."""
    found = contacts.groupBy(*keys).agg(F.max("i").alias("max_i"), F.max("j").alias("max_j"), F.count("*").alias("cells"))
    return found.withColumn("square", (F.col("max_i") == F.col("max_j")) & (F.col("cells") == (F.col("max_i") + 1) * (F.col("max_j") + 1)))


def gaussian_smooth(contacts: DataFrame, bins: int, sigma: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Separable Gaussian of up to four sigma, mirrored at the edges; NULL cells carry no weight."""
    reach = int(4 * sigma + 0.5)
    raw = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(k - reach).alias("d"), F.lit(w / sum(raw)).alias("w")) for k, w in enumerate(raw)])
    out = contacts
    for axis in ("i", "j"):
        other = "j" if axis == "i" else "i"
        moved = out.select(*keys, other, "value", F.explode(kernel).alias("k"), F.col(axis).alias("at"))
        at = F.pmod(F.col("at") + F.col("k.d"), F.lit(2 * bins))
        placed = moved.select(*keys, other, F.when(at >= bins, 2 * bins - 1 - at).otherwise(at).alias(axis), (F.col("value") * F.col("k.w")).alias("value"))
        out = placed.groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))
    return out


def coarsegrain(contacts: DataFrame, cutoff: float, levels: int = 12, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each cell's ``value`` as the mean of its smallest block of ``2**level`` bins whose ``raw`` counts reach ``cutoff``.

    NULL where no block has enough.  A pyramid: each level is summed from the one below, four blocks to
    one, and from the top down a block without enough counts takes what holds around it.
    """
    block, around = [*keys, "block_i", "block_j"], [*keys, "around_i", "around_j"]
    half = [F.shiftright(F.col(f"block_{c}"), 1).alias(f"around_{c}") for c in "ij"]
    level = contacts.groupBy(*keys, F.col("i").alias("block_i"), F.col("j").alias("block_j")).agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.sum("raw").alias("raw"))
    pyramid = [cut(level)]
    for _ in range(levels - 1):
        above = pyramid[-1].select(*keys, *half, "total", "n", "raw").withColumnsRenamed({"around_i": "block_i", "around_j": "block_j"})
        pyramid.append(cut(above.groupBy(*block).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("raw").alias("raw"))))
    own = F.when(F.col("raw") >= cutoff, F.try_divide("total", "n"))
    enough = F.coalesce(F.col("raw") >= cutoff, F.lit(False))
    found = pyramid[-1].select(*block, own.alias("value"))
    for level in pyramid[-2::-1]:
        outer = found.toDF(*around, "outer")
        found = level.select("*", *half).join(outer, around).select(*block, F.when(enough, own).otherwise(F.col("outer")).alias("value"))
    return contacts.select(*keys, "i", "j").join(found.withColumnsRenamed({"block_i": "i", "block_j": "j"}), [*keys, "i", "j"])


def matrix_kind(source: Column, use: str) -> Column:
    """Which matrix a use reads: ratios to the expected for ``heatmap`` and ``regression``, counts otherwise.

    ``predicted`` and ``measured`` sources are in logarithms, but for ``aif``; ``plain`` ones never are.
    """
    base = "obs_o_exp" if use in ("heatmap", "regression") else "obs"
    logged = source.isin("predicted", "measured") & F.lit(use != "aif")
    return F.when(logged, f"log_{base}").otherwise(base)


def for_use(contacts: DataFrame, source: Column, use: str) -> DataFrame:
    """``run, i, j, kind, value`` with the values that ``use`` reads."""
    kind = matrix_kind(source, use)
    cells = obs_over_exp(contacts) if use in ("heatmap", "regression") else contacts
    value = F.when(kind.startswith("log_"), F.ln("value")).otherwise(F.col("value"))
    return cells.select("run", "i", "j", kind.alias("kind"), value.alias("value"))


def levels(spark: SparkSession, regions: dict[str, tuple[str, int, int]], offset: int = 0) -> DataFrame:
    """``resol, chrom, start, end`` of a region map, shifted by ``offset``."""
    rows = [(resol, chrom, start + offset, end + offset) for resol, (chrom, start, end) in regions.items()]
    return spark.createDataFrame(rows, "resol string, chrom string, start long, end long")
