"""Runs against their reference: deviations, regressions, summaries and checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.quantiles import quantiles

from .scores import phase


def score_deviation(scores: DataFrame, reference: str, on: Sequence[str] = ("bin",)) -> DataFrame:
    """``value - reference`` of every other run, bin by bin (or cell by cell)."""
    ref = scores.where(F.col("run") == reference).select(*on, F.col("value").alias("reference"))
    return scores.where(F.col("run") != reference).join(ref, list(on)).select("run", *on, "value", "reference", (F.col("value") - F.col("reference")).alias("deviation"))


def union_runs(ref: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of the reference and of the compared runs with ``is_ref``."""
    return ref.withColumn("is_ref", F.lit(True)).unionByName(comp.withColumn("is_ref", F.lit(False)))


def phase_to(scores: DataFrame, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs turned so that each goes up and down with the reference by rank; the reference stays."""
    ref = scores.where(F.col("run") == reference)
    track = ref.select(*keys, "bin", F.col("value").alias("track"))
    rest = phase(scores.where(F.col("run") != reference).select(*keys, "run", "bin", "value"), track, [*keys, "run"], [*keys, "bin"])
    return ref.select(*keys, "run", "bin", "value").unionByName(rest)


def regress(scores: DataFrame, reference: str, phased: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Linear fit of each run on the reference: ``slope, intercept, r, ssd``; pairs with a NULL are left out.

    Runs meet the reference of their own ``keys``, such as experiment and resolution.  ``phased`` turns each
    run towards the reference first.
    """
    scores = phase_to(scores, reference, keys) if phased else scores
    ref = scores.where(F.col("run") == reference).select(*keys, "bin", F.col("value").alias("x"))
    both = scores.where(F.col("run") != reference).join(ref, [*keys, "bin"]).where("value is not null and x is not null")
    ssd = F.expr("regr_syy(value, x) - regr_sxy(value, x) * regr_sxy(value, x) / regr_sxx(value, x)")
    return both.groupBy(*keys, "run").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), F.corr("value", "x").alias("r"), ssd.alias("ssd"))


def regress_wanted(scores: DataFrame, reference: str, wanted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every run's points with the fit of the wanted run of its ``keys``: ``predicted, residual``."""
    fit = regress(scores.where(F.col("run").isin(reference, wanted)), reference, keys=keys).select(*keys, "slope", "intercept")
    ref = scores.where(F.col("run") == reference).select(*keys, "bin", F.col("value").alias("x"))
    points = scores.where(F.col("run") != reference).join(ref, [*keys, "bin"])
    points = points.join(fit, list(keys)) if keys else points.join(F.broadcast(fit))  # a single row
    return points.select(*keys, "run", "bin", "x", "value", (F.col("slope") * F.col("x") + F.col("intercept")).alias("predicted"), (F.col("value") - F.col("slope") * F.col("x") - F.col("intercept")).alias("residual"))


def role(run: Column) -> Column:
    """``wtd``, ``rdm`` or ``other`` by the parts of a run's name."""
    parts = F.split(F.lower(run), "_")
    return F.when(F.array_contains(parts, "wtd"), "wtd").when(F.array_contains(parts, "rdm"), "rdm").otherwise("other")


def merge_runs(df: DataFrame, pattern: str) -> DataFrame:
    """Runs whose names hold ``pattern`` get one name; the old one stays as ``run_name``."""
    return df.withColumn("run_name", F.col("run")).withColumn("run", F.when(F.col("run").contains(pattern), f"merged_{pattern}").otherwise(F.col("run")))


def relabel_experiments(df: DataFrame) -> DataFrame:
    """``hue_name``: the experiment, led by nothing for wanted runs and followed by ``_rdm`` for random ones; ``run_name`` keeps the run."""
    kind = role(F.col("run"))
    hue = F.when(kind == "rdm", F.concat("experiment", F.lit("_rdm"))).otherwise(F.col("experiment"))
    return df.withColumns({"run_name": F.col("run"), "hue_name": hue})


def pair_order(df: DataFrame) -> DataFrame:
    """``hue_name, place``: experiments in natural order, each followed by its random runs' name."""
    plain = F.regexp_replace("hue_name", "_rdm$", "")
    names = df.select("hue_name").distinct()  # one for each experiment and role
    order = Window.orderBy(natural_key(plain), plain, F.col("hue_name"))
    return names.select("hue_name", F.row_number().over(order).alias("place"))


def check_mutation_lists(mutations: DataFrame, keys: Sequence[str] = ("run",), level: str = "resolution") -> DataFrame:
    """Groups whose mutations (``start, end``) are not the same at every ``level``: by count and two checksums of each."""
    at = mutations.groupBy(*keys, level).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("start", "end")).alias("x"), F.bit_xor(F.xxhash64("end", "start")).alias("y"))
    lists = F.count_distinct(F.struct("n", "x", "y"))
    return at.groupBy(*keys).agg(F.count("*").alias("levels"), lists.alias("lists")).where("lists > 1")


def check_run_set(runs: DataFrame, experiment: str = "experiment") -> DataFrame:
    """Experiments without exactly one wanted and at least one random run, or with others."""
    kind = role(F.col("run"))
    found = runs.groupBy(experiment).agg(F.count_if(kind == "wtd").alias("wanted"), F.count_if(kind == "rdm").alias("random"), F.count_if(kind == "other").alias("others"))
    return found.where("wanted <> 1 or random < 1 or others > 0")


def check_references(meta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Runs whose region or resolution differs from the reference of their experiment."""
    ref = meta.where("is_ref").select("experiment", *[F.col(c).alias(f"ref_{c}") for c in columns])
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"ref_{c}"))
    return meta.where("not is_ref").join(ref, "experiment").where(differs).select("experiment", "run")


def check_consistency(meta: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which one of the columns has several values."""
    counts = meta.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    return counts.where(F.greatest(*[F.col(f"n_{c}") for c in columns], F.lit(1)) > 1)


def check_equal(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Groups in which ``value`` is not the same for all runs, with its least and greatest."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high")


def dispersion(df: DataFrame, value: str, keys: Sequence[str], probs: Sequence[float] = (0.125, 0.25, 0.5, 0.75, 0.875), merged_by: str | None = None) -> DataFrame:
    """Exact letter values, extremes, mean, standard deviation and count of each group.

    ``merged_by`` puts all runs whose names hold it in one group.
    """
    df = merge_runs(df, merged_by) if merged_by else df
    names = [f"p{round(p * 1000):03d}" for p in probs]
    stats = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    found = quantiles(df, value, keys, probs).withColumnsRenamed({k: f"q_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys])
    return stats.join(found, same, "left").select(*keys, *[F.get("quantiles", k).alias(n) for k, n in enumerate(names)], "low", "high", "mean", "sd", "n")


def value_range(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least and greatest value with 10 % added away from zero."""
    wide = lambda c, grow: F.when(grow, c * 1.1).otherwise(c * 0.9)
    low, high = F.min("value"), F.max("value")
    return df.groupBy(*keys).agg(wide(low, low < 0).alias("low"), wide(high, high > 0).alias("high"))


def name_map(text: str, df: DataFrame, column: str) -> DataFrame:
    """Relabel by ``a:b,c:d``; names that are not listed stay."""
    listed = F.str_to_map(F.lit(text), F.lit(","), F.lit(":"))
    return df.withColumn(column, F.coalesce(F.try_element_at(listed, F.col(column)), F.col(column)))


#: Resolutions at which a score is read unless others are named.
DEFAULT_RESOLUTIONS = {"insulation": ("1Mb", "2Mb", "4Mb"), "PC1": ("8Mb", "16Mb", "32Mb")}


def select_runs(df: DataFrame, runs: Sequence[str] | None = None, resolutions: Sequence[str] | None = None) -> DataFrame:
    """Rows ``run, resolution, score_type`` of the named runs and resolutions.

    Without runs all stay; without resolutions each score keeps its default ones, and other scores all.
    """
    chosen = df if runs is None else df.where(F.col("run").isin(*runs))
    if resolutions is not None:
        return chosen.where(F.col("resolution").isin(*resolutions))
    wanted = F.lit(False)
    for score, own in DEFAULT_RESOLUTIONS.items():
        wanted = wanted | (F.col("score_type").startswith(score) & F.col("resolution").isin(*own))
    known = F.lit(False)
    for score in DEFAULT_RESOLUTIONS:
        known = known | F.col("score_type").startswith(score)
    return chosen.where(wanted | ~known)


def with_binsize(meta: DataFrame, bins: int = 250) -> DataFrame:
    """``binsize`` of each row's region ``start, end``, cut in ``bins`` bins."""
    return meta.withColumn("binsize", F.floor((F.col("end") - F.col("start")) / bins).cast("long"))


def pool_experiments(scores: DataFrame, resolution: str, reference: str, names: str = "") -> DataFrame:
    """Deviations of all experiments from their references at one resolution, by score: ``experiment, hue_name, score_type, run, bin, value``.

    ``scores`` has ``experiment, resolution, score_type, run, bin, value``; ``names`` (``a:b,c:d``)
    relabels experiments in ``hue_name``.  The resolution is selected before anything is joined.
    """
    at = scores.where(F.col("resolution") == resolution)
    on = ["experiment", "score_type", "bin"]
    ref = at.where(F.col("run") == reference).select(*on, F.col("value").alias("reference"))
    moved = at.where(F.col("run") != reference).join(ref, on)
    out = moved.select("experiment", F.col("experiment").alias("hue_name"), "score_type", "run", "bin", (F.col("value") - F.col("reference")).alias("value"))
    return name_map(names, out, "hue_name") if names else out


def pool_maps(maps: dict[str, tuple[DataFrame, int]], resolution: str, score: Callable[[DataFrame, int], DataFrame], reference: str, names: str = "") -> DataFrame:
    """``pool_experiments`` from maps: ``maps`` has for each resolution its contacts and bins, of which one is scored."""
    found, bins = maps[resolution]
    return pool_experiments(score(found, bins).withColumn("resolution", F.lit(resolution)), resolution, reference, names)


def pair_scores(scores: DataFrame, a: str, b: str, check: bool = True, phased: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Two runs side by side: ``keys, bin, first, second``; runs of different lengths in any of ``keys`` are an error.

    ``phased`` turns the second towards the first.
    """
    scores = phase_to(scores.where(F.col("run").isin(a, b)), a, keys) if phased else scores
    left, right = (scores.where(F.col("run") == x) for x in (a, b))
    if check:
        sizes = scores.where(F.col("run").isin(a, b)).groupBy(*keys).agg(F.count_if(F.col("run") == a).alias("n"), F.count_if(F.col("run") == b).alias("m"))
        if not sizes.where("n <> m").isEmpty():
            raise ValueError("the runs have different numbers of bins")
    return left.select(*keys, "bin", F.col("value").alias("first")).join(right.select(*keys, "bin", F.col("value").alias("second")), [*keys, "bin"])


def check_headers(predicted: DataFrame, expected: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """``on, differ``: predictions whose header differs from that of their expected matrix, with the names of the fields; one without an expected matrix differs in all."""
    other = expected.select(on, *[F.col(c).alias(f"expected_{c}") for c in columns])
    named = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"expected_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return predicted.join(other, on, "left").select(on, named.alias("differ")).where(F.size("differ") > 0)


def repartition_of_mutations(fractions: DataFrame) -> DataFrame:
    """Mutated fraction per bin and role beside the greatest of all, a sum of one row."""
    return fractions.withColumns({"role": role(F.col("run")), "most": fractions.agg(F.max("value")).scalar()})


def humanise_bp(bp: Column) -> Column:
    """``1.2Mb``, ``3.4kb`` or ``56pb``."""
    text = lambda unit, name: F.concat(_one_digit(bp, unit), F.lit(name))
    return F.when(bp > 1e6, text(1_000_000, "Mb")).when(bp > 1e3, text(1_000, "kb")).otherwise(F.concat(bp.cast("string"), F.lit("pb")))


def _one_digit(bp: Column, unit: int) -> Column:
    """``bp / unit`` with one digit after the point, as the double's exact value rounds; halves go to even.

    Only where ``bp`` lies half way between two tenths does the double's own error decide: it is
    compared with the half as whole numbers, both times 20 and a power of two.
    """
    whole = bp.cast("long") * 10
    tenths, rest = F.floor(whole / unit).cast("long"), whole % unit
    x = bp.cast("double") / unit
    shift = F.lit(52) - F.floor(F.log2(x)).cast("int")
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    error = (x * scale).cast("long") * 20 - (tenths * 2 + 1) * scale
    half = F.when(error > 0, tenths + 1).when(error < 0, tenths).otherwise(tenths + tenths % 2)
    rounded = F.when(rest * 2 == unit, half).otherwise(F.when(rest * 2 > unit, tenths + 1).otherwise(tenths))
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers: those of over 12 digits by their length first."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(p: Column) -> Column:
        plain = F.ltrim(p, F.lit("0"))
        # A colon sorts after all digits.
        return F.when(F.length(plain) > 12, F.concat(F.lit(":"), F.lpad(F.length(plain).cast("string"), 9, "0"), plain)).otherwise(F.lpad(plain, 12, "0"))

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def analysis_table(deviations: DataFrame, distances: DataFrame, score_type: str, resolution: str, first_row_only: bool = False) -> DataFrame:
    """Long table of deviations with the distance of their bin (``i`` for cells) to a mutation.

    ``first_row_only`` keeps row 0 of a matrix alone, as tables made elsewhere may hold it.
    """
    bin_ = "i" if "i" in deviations.columns else "bin"
    rows = deviations.where("i = 0") if first_row_only and bin_ == "i" else deviations
    near = distances.select(F.col("bin").cast("int").alias(bin_), F.col("distance").alias("mutation_distance"))
    return rows.join(near, bin_, "left").select(
        F.col("run").alias("name"), F.lit(resolution).alias("resolution"), F.lit(score_type).alias("score_type"), bin_, F.col("deviation").alias("values"), "reference", "mutation_distance"
    )


def dispersion_by_distance(table: DataFrame, value: str = "values", keys: Sequence[str] = ("name",)) -> DataFrame:
    """``dispersion`` of each group at each mutation distance."""
    return dispersion(table, value, [*keys, "mutation_distance"])


def bp_report(mutated: DataFrame) -> DataFrame:
    """Bases mutated by each random run, ``run, bp``, with their readable form."""
    return mutated.where(role(F.col("run")) == "rdm").select("run", "bp", humanise_bp(F.col("bp")).alias("readable"))


def ensure_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` as doubles (NULL where they are no numbers) and in ``bad`` how many of a row's are not."""
    cast = {c: F.col(c).try_cast("double") for c in columns}
    bad = sum((F.col(c).isNotNull() & number.isNull()).cast("int") for c, number in cast.items())
    return df.withColumn("bad", bad).withColumns(cast)
