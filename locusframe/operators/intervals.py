"""Half-open intervals ``chrom, start, end``: clipping, bins, overlap joins and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.scan import dealt, running, scanned


def rebase(df: DataFrame, chrom: str, start: int, end: int, rename: str = "fake_{}", closed: bool = True) -> DataFrame:
    """Intervals inside a region, relative to its start, on a chromosome named by ``rename``, such as ``fake_chr({})``.

    An interval may touch the region's ends, unless they are not ``closed``.
    """
    low, high = (F.col("start") >= start, F.col("end") <= end) if closed else (F.col("start") > start, F.col("end") < end)
    inside = df.where((F.col("chrom") == chrom) & low & high)
    return inside.withColumns({"chrom": F.lit(rename.format(chrom)), "start": F.col("start") - start, "end": F.col("end") - start})


def pos_to_bin(pos: Column, start: int | Column, binsize: int) -> Column:
    return F.floor((pos - start) / binsize).cast("long")


def bin_to_span(at: Column, start: int, binsize: int) -> tuple[Column, Column]:
    """First and last position of a bin."""
    return at * binsize + start, (at + 1) * binsize + start - 1


def parse_region(text: Column) -> Column:
    """``chrom:start-end`` as a struct."""
    part = lambda k: F.regexp_extract(text, r"^([^:]+):(\d+)-(\d+)$", k)
    return F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def parse_order(text: Column) -> Column:
    """A bin order such as ``1,0,2``, ``[1,0,2]`` or ``1:0:2`` as an array."""
    return F.split(F.regexp_replace(text, r"[\[\]\s]", ""), "[,:]").cast("array<int>")


def _reach(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the largest end among the rows before each, NULL for the first one of its keys."""
    return running(df, keys, ["start", "end"], reach=("max", "end"))


def complement(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """The gaps between intervals, up to each chromosome's size (``chrom, size``)."""
    places = df.select("chrom", "start", "end").distinct()
    gaps = _reach(places, ["chrom"]).withColumn("reach", F.coalesce("reach", F.lit(0))).where("start > reach").select("chrom", F.col("reach").alias("start"), F.col("start").alias("end"))
    last = sizes.join(places.groupBy("chrom").agg(F.max("end").alias("reach")), "chrom", "left").select("chrom", F.coalesce("reach", F.lit(0)).alias("start"), F.col("size").alias("end"))
    return gaps.unionByName(last.where("start < end"))


def cut_out(free: DataFrame, taken: DataFrame) -> DataFrame:
    """What is left of the stretches ``free``, which don't overlap, without all places of ``taken``."""
    ends = free.groupBy("chrom").agg(F.max("end").alias("size"))
    blocked = complement(free, ends).unionByName(taken.where("start < end").select("chrom", "start", "end"))
    left = complement(blocked, ends).join(ends, "chrom").select("chrom", "start", F.least("end", "size").alias("end"))
    return left.where("start < end")


def carve(free: DataFrame, inside: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``cut_out`` where no two of ``inside`` overlap and each lies in one stretch: one scan."""
    taken = inside.where("start < end")
    opens = free.select(*keys, F.col("start").alias("at")).unionByName(taken.select(*keys, F.col("end").alias("at")))
    shuts = free.select(*keys, F.col("end").alias("at")).unionByName(taken.select(*keys, F.col("start").alias("at")))
    edges = opens.withColumns({"kind": F.lit(0), "open": F.col("at")}).unionByName(shuts.withColumns({"kind": F.lit(1), "open": F.lit(None).cast("long")}))
    return running(edges, keys, ["at", "kind"], open=("last", "open")).where("kind = 1 and open < at").select(*keys, F.col("open").alias("start"), F.col("at").alias("end"))


def find_overlaps(df: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Intervals that start before one that sorts earlier has ended."""
    return _reach(df, keys).where("start < reach")


def _events(df: DataFrame, at: str, kind: int, side: str, **others: Column) -> DataFrame:
    """Rows of ``df`` as places on a chromosome: ``_side`` has their columns, ``_tie`` tells those of one place apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.col("chrom").alias("_chrom"), F.col(at).alias("_at"), F.lit(kind).alias("_kind"), F.xxhash64(row).alias("_tie"), F.lit(side).alias("_side"), row.alias(f"_{side}"), *[c.alias(n) for n, c in others.items()])


def _placed(b: DataFrame) -> DataFrame:
    return b.where("chrom is not null and start is not null and end is not null")


#: Widths of nested bins as powers of two, the last for one bin that holds all places.
SHIFTS = (9, 12, 15, 18, 21, 24, 27, 30, 33, 36, 62)


def _homed(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with the width ``_shift`` of the smallest bin that holds them whole, and a place ``_low`` in it."""
    low, last = F.col(start).cast("long"), F.greatest(F.col(start), F.col(end) - 1).cast("long")
    bits = F.length(F.bin(low.bitwiseXOR(last)))
    shift = F.lit(SHIFTS[-1])
    for s in SHIFTS[-2::-1]:
        shift = F.when(bits <= s, s).otherwise(shift)
    return df.where(F.col("chrom").isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns({"_low": low, "_shift": shift})


def _binned(df: DataFrame) -> DataFrame:
    at = F.when(F.col("_shift") == SHIFTS[-1], F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("_low"), F.col("_shift")))
    return df.withColumn("_bin", at).drop("_low")


def _around(df: DataFrame, other: DataFrame, own: bool) -> DataFrame:
    """Rows once for each bin around their home (and the home itself if ``own``) of a width that ``other`` lives in."""
    widths = sorted(r["_shift"] for r in other.select("_shift").distinct().collect())  # of SHIFTS
    wider = F.filter(F.array(*map(F.lit, widths)).cast("array<int>"), lambda w: (w >= F.col("_shift")) if own else (w > F.col("_shift")))
    return _binned(df.withColumn("_shift", F.explode(wider)))


def overlap_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlapping pairs of ``a`` and ``b`` (whose interval becomes ``ostart, oend``), each once.

    An interval is at home in the smallest of nested bins that holds it whole.  Of two that overlap, the home
    of one lies in the other's, so an interval looks for partners at home in the bins around its own: a
    handful of keys however long it is.  A bin with very many rows is split where rows are joined:
    adaptive execution cuts its larger side in pieces and gives each the other side.
    """
    left, right = _homed(a, "start", "end"), _homed(b.withColumnsRenamed({"start": "ostart", "end": "oend"}), "ostart", "oend")
    key = ["chrom", "_shift", "_bin"]
    pairs = _around(left, right, True).join(_binned(right), key).unionByName(_binned(left).join(_around(right, left, False), key))
    others = [c for c in b.columns if c not in ("chrom", "start", "end")]
    return pairs.where("start < oend and ostart < end").select(*a.columns, "ostart", "oend", *others)


def _reached(df: DataFrame, domains: DataFrame, at: str, kinds: tuple[int, int]) -> DataFrame:
    """``_row`` of ``df`` and the largest ``_reach`` of domains that start before its column ``at``, at ``kinds`` of (row, domain) in one place."""
    rows = _events(df, at, kinds[0], "row").withColumn("_end", F.lit(None).cast("long"))
    starts = _placed(domains).groupBy("chrom", "start").agg(F.max("end").alias("end"))
    marks = starts.select(F.col("chrom").alias("_chrom"), F.col("start").alias("_at"), F.lit(kinds[1]).alias("_kind"), F.lit(0).cast("long").alias("_tie"), F.lit("domain").alias("_side"), F.col("end").cast("long").alias("_end"))
    found = running(rows.unionByName(marks, allowMissingColumns=True), ["_chrom"], ["_at", "_kind", "_tie"], _reach=("max", "_end"))
    return found.where("_side = 'row'")


def exclude(df: DataFrame, domains: DataFrame) -> DataFrame:
    """Intervals that overlap no domain; those without a place stay.

    One scan: an interval meets a domain if, of the domains that start before its end, the one that
    reaches farthest ends after its start.
    """
    found = _reached(df, domains, "end", (0, 1))
    return found.where(F.coalesce(F.col("_reach") <= F.col("_row.start"), F.lit(True))).select("_row.*")


def include(df: DataFrame, domains: DataFrame) -> DataFrame:
    """Intervals that lie inside a domain, by the same scan."""
    found = _reached(df, domains, "start", (1, 0))
    return found.where(F.col("_reach") >= F.col("_row.end")).select("_row.*")


def _per_bin(mutations: DataFrame, start: int, binsize: int, bins: int) -> DataFrame:
    first, last = pos_to_bin(F.col("start"), start, binsize), pos_to_bin(F.col("end") - 1, start, binsize)
    return mutations.withColumn("bin", F.explode(F.sequence(first, last))).where(F.col("bin").between(0, bins - 1))


def mutation_counts(mutations: DataFrame, start: int, binsize: int, bins: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Mutations that touch each bin."""
    return _per_bin(mutations, start, binsize, bins).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def mutated_bins(mutations: DataFrame, start: int, binsize: int, bins: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    return _per_bin(mutations, start, binsize, bins).select(*keys, "bin").distinct()


def mutated_fraction(mutations: DataFrame, start: int, binsize: int, bins: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Share of each bin that mutations cover, 0 where none does; overlapping ones count twice."""
    low, high = F.col("bin") * binsize + start, (F.col("bin") + 1) * binsize + start
    covered = _per_bin(mutations, start, binsize, bins).groupBy(*keys, "bin").agg(F.sum(F.least("end", high) - F.greatest("start", low)).alias("bp"))
    every = mutations.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(covered, [*keys, "bin"], "left").select(*keys, "bin", (F.coalesce("bp", F.lit(0)) / binsize).alias("value"))


def nearest_distance(mutations: DataFrame, start: int, binsize: int, bins: int, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Bins to the nearest edge of a mutation, from one scan in each direction."""
    edges = mutations.select(*keys, F.explode(F.array(pos_to_bin(F.col("start"), start, binsize), pos_to_bin(F.col("end"), start, binsize))).alias("bin")).distinct().withColumn("edge", F.col("bin"))
    every = mutations.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")).withColumn("edge", F.lit(None).cast("long"))
    # Edges of a bin come before the bin itself in both directions; they are in one range.
    ranges = dealt(edges.unionByName(every).withColumn("kind", F.col("edge").isNull().cast("int")), [*keys, "bin"])
    back = scanned(ranges, keys, ["bin", "kind"], back=("last", "edge"))
    both = scanned(back.withColumn("kind", 1 - F.col("kind")), keys, ["bin", "kind"], reverse=True, ahead=("last", "edge"))
    return both.where("edge is null").select(*keys, "bin", F.least(F.col("bin") - F.col("back"), F.col("ahead") - F.col("bin")).alias("distance"))


def mutated_bp(mutations: DataFrame, low: int, high: int, closed: bool = False, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Bases of the mutations that lie in a region; ``closed`` counts both ends."""
    inside = mutations.where((F.col("start") >= low) & (F.col("end") <= high))
    return inside.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + int(closed)).alias("bp"))


def assign_bins(df: DataFrame, binsize: int) -> DataFrame:
    """The first bin that holds an interval or at least half of it, and how far it spills to either side."""
    a, b = F.floor(F.col("start") / binsize), F.floor((F.col("end") - 1) / binsize)
    in_first = (a + 1) * binsize - F.col("start")
    at = F.when((a == b) | (in_first * 2 >= F.col("end") - F.col("start")), a).otherwise(b)
    placed = df.withColumn("bin", at.cast("long"))
    return placed.withColumns({"spill_left": F.greatest(F.lit(0), F.col("bin") * binsize - F.col("start")), "spill_right": F.greatest(F.lit(0), F.col("end") - (F.col("bin") + 1) * binsize)})


def oversize(df: DataFrame, binsize: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Longest interval of each group and whether it is longer than a bin."""
    return df.groupBy(*keys).agg(F.max(F.col("end") - F.col("start")).alias("longest")).withColumn("too_long", F.col("longest") > binsize)


def in_region(low: int | Column, high: int | Column, mode: str = "end") -> Column:
    """Whether a mutation counts as inside: by its ``end`` alone, as shares of bins do, or by ``both`` ends, as counts of bases do."""
    ends = (F.col("end") >= low) & (F.col("end") <= high)
    return ends if mode == "end" else ends & (F.col("start") >= low) & (F.col("start") <= high)


def valid_experiments(experiments: DataFrame, mutations: DataFrame, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Experiments that have a mutation, in the ``region`` (chrom, start, end) if one is given."""
    if region is not None:
        mutations = mutations.where((F.col("chrom") == region[0]) & in_region(region[1], region[2], "both"))
    return experiments.join(mutations.select("experiment").distinct(), "experiment", "left_semi")


def place_windows(loci: DataFrame, sizes: DataFrame, length: int, align: int, strict: bool = False) -> DataFrame:
    """A window of ``length`` around each locus ``chrom, pos``: start on the grid, inside the chromosome where it fits.

    ``strict`` leaves out loci whose window would not start on the grid by itself.
    """
    found = loci.join(sizes, "chrom")
    found = found.where(F.pmod(F.col("pos") - length // 2, F.lit(align)) == 0) if strict else found
    start = F.floor((F.col("pos") - length // 2) / align) * align
    placed = found.withColumn("wstart", F.greatest(F.lit(0), F.least(start, F.floor((F.col("size") - length) / align) * align)))
    return placed.select("chrom", "pos", "wstart", (F.col("wstart") + length).alias("wend"), (F.col("pos") - F.col("wstart")).alias("wpos"))


def extent_range(df: DataFrame, sizes: DataFrame, extend_to: int) -> DataFrame:
    """Per chromosome the range its intervals span, widened evenly to at least ``extend_to`` and kept on it."""
    spans = df.groupBy("chrom").agg(F.min("start").alias("low"), F.max("end").alias("high"), F.max(F.col("end") - F.col("start")).alias("longest"))
    short = F.greatest(F.lit(extend_to) - (F.col("high") - F.col("low")), F.lit(0))
    low = F.greatest(F.col("low") - F.floor(short / 2), F.lit(0))
    wide = spans.join(sizes, "chrom").withColumns({"start": low, "wanted": F.col("high") - F.col("low") + short})
    return wide.select("chrom", "start", F.least(F.col("start") + F.col("wanted"), F.col("size")).alias("end"), "longest")
