"""Per-bin scores of contact maps: ``keys, bin, value``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import cut

from .contacts import KEYS, fill_cells, fill_neighbours, minmax, row_correlation, spine


def insulation(contacts: DataFrame, bins: int, w: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the row's finite cells within ``w`` of the diagonal, times their number; edges and gaps get the map's mean."""
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    band = contacts.withColumn("value", finite).where(F.abs(F.col("i") - F.col("j")) <= w).groupBy(*keys, F.col("i").alias("bin")).agg((F.avg("value") * (2 * w + 1)).alias("raw"))
    inner = F.when(F.col("bin").between(w, bins - w - 1), F.col("raw"))
    scored = spine(contacts, bins, keys).join(band, [*keys, "bin"], "left").withColumn("inner", inner)
    return scored.select(*keys, "bin", F.coalesce("inner", F.avg("inner").over(Window.partitionBy(*keys))).alias("value"))


def insulation_exp(contacts: DataFrame, bins: int, w: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Insulation of the exponential of the min-max scaled map."""
    return insulation(minmax(contacts, keys).withColumn("value", F.exp("value")), bins, w, keys)


def insulation_correl(contacts: DataFrame, bins: int, w: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Insulation of the row correlations of the filled map, of which only the band is computed."""
    return insulation(row_correlation(minmax(fill_cells(contacts, bins, keys), keys), bins, w, keys), bins, w, keys)


def pc1(contacts: DataFrame, bins: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unit eigenvector of ``value - 1`` whose eigenvalue is largest in size; its largest entry is positive.

    Bins without any contact are masked: they take no part and then get the mean of the bins around them
    (``fill_neighbours``).  A map of ``bins`` squared cells is decomposed as a whole in one task; all maps of a table run
    side by side.  Other absent and NULL cells count as 0 after the subtraction; fill them before.
    """
    kinds = {f.name: f.dataType.simpleString() for f in contacts.schema.fields}

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        a, seen = np.zeros((bins, bins)), np.zeros(bins, dtype=bool)
        filled = pdf[pdf["value"].notna()]
        i, j, x = filled["i"].to_numpy(), filled["j"].to_numpy(), filled["value"].to_numpy()
        a[i, j] = x - 1
        seen[i[x != 0]] = seen[j[x != 0]] = True
        out = np.full(bins, np.nan)
        if seen.any():
            part = a[np.ix_(seen, seen)]
            values, vectors = np.linalg.eigh((part + part.T) / 2)
            v = vectors[:, np.argmax(np.abs(values))]
            out[seen] = v * np.sign(v[np.argmax(np.abs(v))])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "bin": np.arange(bins), "value": out})

    found = contacts.groupBy(*keys).applyInPandas(decompose, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "bin int, value double"]))
    return fill_neighbours(found.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))), bins, keys)


def _ritz(now: np.ndarray, before: np.ndarray, left: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, float]:
    """A Rayleigh-Ritz step in the space of three blocks of vectors, each with its product: the best block, its remainders and how far the first is off.

    ``now``, ``before`` and ``left`` have two slices: the vectors and the map times them.  Vectors that add nothing are dropped.
    """
    s, t = (np.concatenate([x[k] for x in (now, before, left)], axis=1) for k in range(2))
    size = np.linalg.norm(s, axis=0)
    s, t = s[:, size > 0] / size[size > 0], t[:, size > 0] / size[size > 0]
    for _ in range(2):  # the second time undoes what rounding left
        weight, turn = np.linalg.eigh(s.T @ s)
        real = weight > weight[-1] * 1e-13
        turn = turn[:, real] / np.sqrt(weight[real])
        s, t = s @ turn, t @ turn
    inner = s.T @ t
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-np.abs(values))[:block]
    x, ax, values = s @ vectors[:, best], t @ vectors[:, best], values[best]
    rest = ax - x * values
    return np.stack([x, ax]), rest, float(np.linalg.norm(rest[:, 0]) / max(abs(values[0]), 1e-300))


def pc1_cells(contacts: DataFrame, bins: int, keys: Sequence[str] = KEYS, block: int = 8, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """``pc1`` of maps too large for one task: block subspace iteration on the table of cells, all maps at once.

    A round multiplies every map with a block of vectors, as a join of cells and vectors and a sum over
    columns; a task then holds ``bins`` rows of a few blocks, never a map, and takes a
    Rayleigh-Ritz step in the space of the present vectors, those before and their remainders.  Rounds end when the first
    vector of each map is an eigenvector to ``tolerance``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in contacts.schema.fields}
    ends = contacts.where("value is not null").select(*keys, "i", "j", (F.col("value") - 1).alias("x"), (F.col("value") != 0).alias("seen"))
    turned = ends.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "x", "seen")
    cells = cut(ends.unionByName(turned).select(*keys, "i", "j", (F.col("x") / 2).alias("x"), "seen"))
    alive = cells.where("seen").select(*keys, F.col("i").alias("bin")).distinct()
    kept = cells.join(alive.withColumnRenamed("bin", "i"), [*keys, "i"], "left_semi").join(alive.withColumnRenamed("bin", "j"), [*keys, "j"], "left_semi").drop("seen")
    kept = cut(kept.groupBy(*keys, "i", "j").agg(F.sum("x").alias("x")))
    fields = ["now", "anow", "before", "abefore", "left"]
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "bin int", *[f"{c} array<double>" for c in fields], "off double"])

    def product(state: DataFrame) -> DataFrame:
        vectors = state.select(*keys, F.col("bin").alias("j"), "left")
        sums = F.array(*[F.sum(F.col("x") * F.get("left", F.lit(k))) for k in range(block)])
        return kept.join(vectors, [*keys, "j"]).groupBy(*keys, F.col("i").alias("bin")).agg(sums.alias("aleft"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = len(pdf)
        read = lambda c: np.stack([np.zeros(block) if x is None else np.asarray(x, dtype=float) for x in pdf[c]])
        now, before = np.stack([read("now"), read("anow")]), np.stack([read("before"), read("abefore")])
        found, rest, off = _ritz(now, before, np.stack([read("left"), read("aleft")]), block)
        wide = lambda x: list(np.pad(x, ((0, 0), (0, block - x.shape[1]))))
        out = pd.DataFrame({"bin": pdf["bin"].to_numpy(), "now": wide(found[0]), "anow": wide(found[1]), "before": list(now[0]), "abefore": list(now[1]), "left": wide(rest), "off": [off] * n})
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "bin", *fields, "off"]]

    none = F.array(*[F.lit(0.0)] * block)
    start = F.array(*[F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(1 << 20)) / float(1 << 19) - 1 for k in range(block)])
    state = alive.select(*keys, F.col("bin").cast("int").alias("bin"), *[none.alias(c) for c in fields[:-1]], start.alias("left"))
    for _ in range(rounds):
        state = cut(state.select(*keys, "bin", *fields).join(product(state), [*keys, "bin"], "left").groupBy(*keys).applyInPandas(step, schema))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"an eigenvector is still off by {worst} of its eigenvalue")
    first = state.select(*keys, "bin", F.get("now", F.lit(0)).alias("v"))
    sign = first.groupBy(*keys).agg(F.signum(F.max_by("v", F.abs("v"))).alias("s"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    signed = first.join(sign, list(keys)).select(*keys, "bin", (F.col("v") * F.col("s") / F.col("n")).alias("value"))
    return fill_neighbours(spine(contacts, bins, keys).join(signed, [*keys, "bin"], "left"), bins, keys)


def phase(scores: DataFrame, track: DataFrame, keys: Sequence[str] = KEYS, on: Sequence[str] = ("bin",)) -> DataFrame:
    """Scores times the sign of their rank correlation with a track (``on, track``)."""
    both = scores.join(track, list(on)).where("value is not null and track is not null")

    def rank(c: str):
        same = Window.partitionBy(*keys, c)
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(same) - 1) / 2

    signs = both.select(*keys, rank("value").alias("rv"), rank("track").alias("rt")).groupBy(*keys).agg(F.signum(F.corr("rv", "rt")).alias("sign"))
    return scores.join(signs, list(keys)).select(*keys, "bin", (F.col("value") * F.col("sign")).alias("value"))


def _sign():
    return F.when(F.col("value") > 0, 1).otherwise(-1)


def compartments(scores: DataFrame, min_run: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """A or B for bins in a run of ``min_run`` equal signs or more, else U."""
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    signed = scores.withColumn("s", _sign())
    island = F.row_number().over(by_bin) - F.row_number().over(Window.partitionBy(*keys, "s").orderBy("bin"))
    runs = signed.withColumn("island", island)
    size = F.count("*").over(Window.partitionBy(*keys, "s", "island"))
    return runs.select(*keys, "bin", F.when(size < min_run, "U").when(F.col("s") > 0, "A").otherwise("B").alias("label"))


def compartments_window(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A or B where a bin and both neighbours agree; the ends look at the first or last three."""
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    around = lambda a, b: F.sum("s").over(by_bin.rowsBetween(a, b))
    signed = scores.withColumn("s", _sign())
    total = F.when(F.lag("s").over(by_bin).isNull(), around(0, 2)).when(F.lead("s").over(by_bin).isNull(), around(-2, 0)).otherwise(around(-1, 1))
    return signed.select(*keys, "bin", F.when(total == 3, "A").when(total == -3, "B").otherwise("U").alias("label"))


def borders(labels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bins whose label differs from the one before, neither being U."""
    before = F.lag("label").over(Window.partitionBy(*keys).orderBy("bin"))
    return labels.withColumn("before", before).where("before <> label and before <> 'U' and label <> 'U'").select(*keys, "bin", "before", "label")


def _quantile_groups(scores: DataFrame, q: int, keys: Sequence[str]) -> DataFrame:
    """``keys, bin, g``: how many of the inner ``q``-quantiles of its map lie below a bin's score; a map has one buffer of its bins."""
    cuts = scores.groupBy(*keys).agg(F.percentile("value", F.array(*[F.lit(k / q) for k in range(1, q)])).alias("edges"))
    return scores.join(cuts, list(keys)).select(*keys, "bin", F.size(F.filter("edges", lambda e: e < F.col("value"))).alias("g"))


def saddle(contacts: DataFrame, scores: DataFrame, q: int = 48, keys: Sequence[str] = KEYS) -> DataFrame:
    """Log of the mean cell for each pair of score quantile groups."""
    groups = _quantile_groups(scores, q, keys)
    rows, cols = groups.toDF(*keys, "i", "rq"), groups.toDF(*keys, "j", "cq")
    return contacts.join(rows, [*keys, "i"]).join(cols, [*keys, "j"]).groupBy(*keys, "rq", "cq").agg(F.log(F.avg("value")).alias("value"))


def saddle_cells(contacts: DataFrame, scores: DataFrame, q: int = 48, keys: Sequence[str] = KEYS) -> DataFrame:
    """The map with rows and columns in descending order of score, ``keys, i, j``, each cell the ``saddle`` value of its groups."""
    places = saddle_order(scores, keys).join(_quantile_groups(scores, q, keys), [*keys, "bin"])
    rows, cols = (places.select(*keys, F.col("bin").alias(c), (F.col("place") - 1).alias(f"to_{c}"), F.col("g").alias(g)) for c, g in (("i", "rq"), ("j", "cq")))
    placed = contacts.select(*keys, "i", "j").join(rows, [*keys, "i"]).join(cols, [*keys, "j"])
    return placed.join(saddle(contacts, scores, q, keys), [*keys, "rq", "cq"]).select(*keys, F.col("to_i").alias("i"), F.col("to_j").alias("j"), "value")


def saddle_order(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Place of each bin in descending order of its score."""
    return scores.select(*keys, "bin", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "bin")).alias("place"))


def restore_positions(scores: DataFrame, order: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scores moved back from permuted bins; ``order`` has ``run, bin_order``, where entry k is the bin put at k."""
    places = order.select(*keys, F.posexplode("bin_order").alias("bin", "original"))
    return scores.join(places, [*keys, "bin"]).select(*keys, F.col("original").alias("bin"), "value")


def all_scores(frames: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Union of score tables with their names as ``score_type``."""
    out = None
    for name, df in frames.items():
        part = df.select(*keys, "bin", "value", F.lit(name).alias("score_type"))
        out = part if out is None else out.unionByName(part)
    return out
