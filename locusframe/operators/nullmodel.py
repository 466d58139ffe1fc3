"""Random replicates of mutation sets; draws are hashes of seed, replicate and key, so reruns agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import cut
from locusframe.functions.scan import dealt, running, scanned

from .intervals import assign_bins, carve, complement, cut_out, find_overlaps
from .sequence import draw, drawn_order, random_sequence


def fan_out(mutations: DataFrame, n: int) -> DataFrame:
    """The wanted set and ``n`` replicates: ``run, replicate`` (-1 for the wanted one) and ``seed`` beside each row."""
    which = F.explode(F.sequence(F.lit(-1), F.lit(n - 1)))
    fanned = mutations.select("*", which.alias("replicate"))
    base = F.col("replicate").cast("long") + 3
    fanned = fanned.withColumn("seed", F.when(F.col("replicate") >= 0, base * base * base))
    return fanned.withColumn("run", F.when(F.col("replicate") < 0, "Wtd_mut").otherwise(F.concat(F.lit("Rdm_mut_"), F.col("replicate").cast("string"))))


def bin_hulls(placed: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """What counts of a bin when bins move as a whole: ``keys, bin, low, high``, from its first start to its last end.

    Both are relative to the bin and may lie outside of it.  ``placed`` has ``bin, spill_left`` and
    ``offset``, the start within the bin.  Groups in one of whose bins intervals overlap are left out:
    no arrangement of them is valid.
    """
    hulls = placed.groupBy(*keys, "bin").agg(F.min("offset").alias("low"), F.max(F.col("offset") + F.col("end") - F.col("start")).alias("high"))
    broken = find_overlaps(placed.select(*keys, "bin", "start", "end"), [*keys, "bin"]).select(*keys).distinct()
    return hulls.join(broken, list(keys), "left_anti")


def _in_bins(df: DataFrame, binsize: int) -> DataFrame:
    placed = assign_bins(df, binsize)
    return placed.withColumn("offset", F.col("start") - F.col("bin") * binsize)


def valid_arrangements(moved: DataFrame, binsize: int, bins: int, keys: Sequence[str]) -> DataFrame:
    """``keys`` of arrangements of hulls (``place, low, high``) without overlap, negative start or end past the last bin.

    Of bins in two places the one before reaches the other if its last end lies after the other's first start.
    """
    at = moved.withColumns({"first": F.col("place") * binsize + F.col("low"), "last": F.col("place") * binsize + F.col("high")})
    reach = F.max("last").over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))  # a row for each bin
    bad = F.coalesce(F.col("first") < reach, F.lit(False)) | (F.col("first") < 0) | (F.col("last") > binsize * bins)
    return at.withColumn("bad", bad).groupBy(*keys).agg(F.bool_or("bad").alias("bad")).where("not bad").drop("bad")


def _moved(placed: DataFrame, binsize: int) -> DataFrame:
    """Intervals at their bin's new ``place``; offsets in the bin stay."""
    shift = (F.col("place") - F.col("bin")) * binsize
    return placed.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift}).drop("offset", "place")


def valid_shifts(hulls: DataFrame, binsize: int, bins: int, keys: Sequence[str]) -> DataFrame:
    """``keys, shift``: cyclic shifts from 1 to ``bins - 1`` of hulls (``bin, low, high``) that ``valid_arrangements`` would keep.

    A shift puts the bins from ``shift`` on before the others and leaves both parts in order, so what
    counts is the first start and the last end of each part, and where bins of one part overlap: one scan in
    each direction over bins and shifts, no row for each pair of them.
    """
    width = binsize * bins
    own = hulls.where("bin is not null").select(*keys, F.col("bin").alias("at"), F.lit(1).alias("kind"), (F.col("bin") * binsize + F.col("low")).alias("first"), (F.col("bin") * binsize + F.col("high")).alias("last"))
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins - 1).cast("long")))
    shifts = own.select(*keys).distinct().select(*keys, every.alias("at"), F.lit(0).alias("kind")).where(F.col("at").between(1, bins - 1))
    order = ["at", "kind"]  # a shift comes before the bin that it puts first
    ranges = dealt(own.withColumn("early", -F.col("first")).unionByName(shifts, allowMissingColumns=True), [*keys, *order])
    head = scanned(ranges, keys, order, low=("max", "early"), high=("max", "last"))
    both = scanned(head, keys, order, reverse=True, low_after=("max", "early"), high_after=("max", "last"))
    both = both.withColumns({"low": -F.col("low"), "low_after": -F.col("low_after")})
    # Bins that overlap have to come in different parts: the shift lies after the first of them and not after the second.
    torn = both.where("kind = 1").groupBy(*keys).agg(F.max(F.when(F.col("last") > F.col("low_after"), F.col("at"))).alias("after"), F.min(F.when(F.col("first") < F.col("high"), F.col("at"))).alias("until"))
    moved = F.col("at") * binsize
    bad = [
        F.col("at") <= F.col("after"), F.col("at") > F.col("until"), F.col("high_after") > F.col("low") + width,
        F.col("low_after") < moved, F.col("high_after") > moved + width, F.col("low") + width < moved, F.col("high") > moved,
    ]
    judged = both.where("kind = 0").join(torn, list(keys)).withColumn("bad", reduce(Column.__or__, [F.coalesce(b, F.lit(False)) for b in bad]))
    return judged.where("not bad").select(*keys, F.col("at").cast("int").alias("shift"))


def rotate_bins(df: DataFrame, n: int, binsize: int, bins: int, seed: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``n`` replicates of each group, each a different valid cyclic ``shift`` of its bins in drawn order.

    All shifts but the identity are judged on one row for each bin and shift; only the chosen ones move intervals.
    """
    placed = cut(_in_bins(df, binsize))
    # A bin past the last one takes the place of one before, as the shift does with it.
    turned = placed.withColumns({"bin": F.pmod(F.col("bin"), F.lit(bins)), "start": F.col("offset"), "end": F.col("offset") + F.col("end") - F.col("start")})
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("shift").cast("string")))))
    drawn = valid_shifts(bin_hulls(turned, keys), binsize, bins, keys).withColumn("rank", rank).where(F.col("rank") <= n)
    chosen = cut(drawn.select(*keys, "shift", (F.col("rank") - 1).alias("replicate")))
    short = placed.select(*keys).distinct().join(chosen.groupBy(*keys).agg(F.count("*").alias("found")), list(keys), "left").where(F.coalesce("found", F.lit(0)) < n)
    if (first := short.first()) is not None:
        raise ValueError(f"only {first['found'] or 0} of {n} rotations are valid in a group: {first}")
    return _moved(placed.join(chosen, list(keys)).withColumn("place", F.pmod(F.col("bin") - F.col("shift"), F.lit(bins))), binsize)


BITS = 60  # of a drawn number


def uniform(key: Column, below: Column) -> Column:
    """A number from 0 to ``below - 1`` drawn by a key, each as likely; NULL where the draw is void.

    Void are the few numbers past the last whole multiple of ``below``, which would make some results likelier.
    """
    drawn = F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")
    return F.when((below > 0) & (drawn < F.lit(1 << BITS) - F.lit(1 << BITS) % below), drawn % below)


def _shrunk(length: Column, k: int) -> Column:
    """The length by which free places are measured: its leading bits, more of them from round to round, then zeros."""
    spare = F.greatest(F.floor(F.log2(length)).cast("int") - k // 2, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length, spare), spare)


RANGE = "_range"
#: Free stretches in a range, and draws that are looked up among them in one task, on average.
STRETCHES, DRAWS = 100_000, 200_000


def _rooms(waiting: DataFrame, free: DataFrame) -> DataFrame:
    """``on, shrunk, _range, room``: starts in each range of free stretches for each ``shrunk`` length that waits there."""
    met = free.join(F.broadcast(waiting.select("on", "shrunk").distinct()), "on").where(F.col("end") - F.col("start") >= F.col("shrunk"))
    return met.groupBy("on", "shrunk", RANGE).agg(F.sum(F.col("end") - F.col("start") - F.col("shrunk") + 1).alias("room"))


def _in_ranges(free: DataFrame, stretches: int) -> DataFrame:
    """Free places in ranges of ``chrom, start`` with their numbers in ``_range``."""
    ranges = max(int(free.sparkSession.conf.get("spark.sql.shuffle.partitions")), stretches // STRETCHES + 1)
    return cut(free.select("chrom", "start", "end").repartitionByRange(ranges, "chrom", "start").withColumn(RANGE, F.spark_partition_id()))


def _range_of(rooms: dict[tuple[str, int], list[tuple[int, int]]]):
    """A function of ``on, shrunk, u`` to the range ``part`` that holds the start numbered ``u``, and its number ``local`` there; -1 for a negative ``u``."""
    parts = {k: np.array([part for part, _ in sorted(v)]) for k, v in rooms.items()}
    stops = {k: np.cumsum([room for _, room in sorted(v)]) for k, v in rooms.items()}

    @F.pandas_udf("struct<part: int, local: long>")
    def looked_up(on: pd.Series, shrunk: pd.Series, u: pd.Series) -> pd.DataFrame:
        drawn = u.to_numpy(np.int64)
        part, local = np.full(len(drawn), -1, np.int32), drawn.copy()
        valid = np.flatnonzero(drawn >= 0)
        for key, some in pd.DataFrame({"on": on.to_numpy()[valid], "shrunk": shrunk.to_numpy()[valid]}).groupby(["on", "shrunk"]).indices.items():
            rows = valid[some]
            at = np.searchsorted(stops[key], drawn[rows], side="right")
            part[rows] = parts[key][at]
            local[rows] -= np.where(at > 0, stops[key][at - 1], 0)
        return pd.DataFrame({"part": part, "local": local})

    return looked_up


def _stretch_of(by_chrom: bool):
    """A function of draws and the stretches of their range to places, where the drawn start leaves room for the whole length."""

    def found(draws: pa.Table, stretches: pa.Table) -> pa.Table:
        stretches = stretches.sort_by([("chrom", "ascending"), ("start", "ascending")])
        low, high = stretches["start"].to_numpy(), stretches["end"].to_numpy()
        ons, shrunk, local = draws["on"].to_pandas(), draws["shrunk"].to_numpy(), draws["local"].to_numpy()
        chroms = stretches["chrom"].to_pandas().to_numpy() if by_chrom else None
        at, start = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        for (on, size), rows in pd.DataFrame({"on": ons, "shrunk": shrunk}).groupby(["on", "shrunk"]).indices.items():
            room = np.maximum(high - low - size + 1, 0)
            if by_chrom:
                room = np.where(chroms == on, room, 0)
            stops = np.cumsum(room)
            at[rows] = k = np.searchsorted(stops, local[rows], side="right")
            start[rows] = low[k] + local[rows] - (stops[k] - room[k])
        end = start + draws["length"].to_numpy()
        fits = np.flatnonzero(end <= high[at])
        at = at[fits]
        return pa.table({"id": draws["id"].take(fits), "chrom": stretches["chrom"].take(at), "start": start[fits], "end": end[fits], "low": low[at], "high": high[at], RANGE: draws[RANGE].take(fits)})

    return found


def _drawn_places(waiting: DataFrame, going: DataFrame, free: DataFrame, key: Column, by_chrom: bool) -> DataFrame:
    """``id, chrom, start, end`` drawn for ``going``, with the free stretch ``low, high`` and its range; rows whose draw is void or doesn't fit are left out.

    Starts that leave room for a length are numbered along all free stretches of its ``on``.  What reaches the driver
    is how many there are in each range; a drawn number goes to its range and is looked up among
    the stretches there.  A range with many draws is given to several tasks.
    """
    rooms = cut(_rooms(waiting, free))
    known: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in rooms.toLocalIterator():
        known.setdefault((r["on"], r["shrunk"]), []).append((r[RANGE], r["room"]))
    whole = rooms.groupBy("on", "shrunk").agg(F.sum("room").alias("whole"))
    # Void draws are dropped after the look-up, so that a key is hashed once.
    drawn = going.join(F.broadcast(whole), ["on", "shrunk"]).withColumn("u", F.coalesce(uniform(key, F.col("whole")), F.lit(-1)))
    at = _range_of(known)("on", "shrunk", "u")
    asked = cut(drawn.withColumn("at", at).where("at.part >= 0").select("id", "on", "shrunk", "length", F.col("at.part").alias(RANGE), F.col("at.local").alias("local")))
    tasks = cut(asked.groupBy(RANGE).agg(F.ceil(F.count("*") / DRAWS).cast("int").alias("tasks")))  # a row for each range
    draws = asked.join(F.broadcast(tasks), RANGE).withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")
    beside = free.join(F.broadcast(tasks), RANGE).select(RANGE, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "chrom", "start", "end")
    places = draws.groupBy(RANGE, "task").cogroup(beside.groupBy(RANGE, "task"))
    return cut(places.applyInArrow(_stretch_of(by_chrom), f"id string, chrom string, start long, end long, low long, high long, {RANGE} int"))


def place(waiting: DataFrame, free: DataFrame, seed: int, by_chrom: bool = False, rounds: int = 1000) -> DataFrame:
    """A place for each ``id`` (of ``length`` over 0) at uniform free starts, none overlapping another: ``id, chrom, start, end``.

    ``free`` are the stretches ``chrom, start, end`` that may be used; ``by_chrom`` keeps an interval on
    its own ``chrom``.  A round draws among the starts that are left, for all that wait or
    for as many as the free places can hold; a draw that meets one before it waits for the next
    round, and only stretches that were drawn are cut anew.  It is an error if no start is left for one that waits.
    """
    waiting = cut(waiting.select("id", (F.col("chrom") if by_chrom else F.lit("")).alias("on"), "length"))
    free = cut(free.select("chrom", "start", "end"))
    stretches = free.count()
    free, added = _in_ranges(free, stretches), 0
    parts, before, kept = [], -1, None
    for k in range(rounds):
        needs = cut(waiting.groupBy("on").agg(F.count("*").alias("n"), F.sum("length").alias("needed")))
        count = needs.agg(F.sum("n").alias("n")).first()["n"] or 0
        if not count:
            break
        if kept is not None and count != before:
            stretches, added = stretches + before - count, added + before - count
            used = kept.select("chrom", RANGE, F.col("low").alias("start"), F.col("high").alias("end")).distinct()
            gone = used.select(F.col("chrom").alias("_chrom"), F.col("start").alias("_start"))
            rest = free.join(gone, F.col("chrom").eqNullSafe(F.col("_chrom")) & (F.col("start") == F.col("_start")), "left_anti")
            left = rest.unionByName(carve(used, kept, ("chrom", RANGE)))
            # What is left of a stretch stays in its range; ranges are drawn anew where they have grown.
            free, added = (_in_ranges(left, stretches), 0) if added * 5 > stretches else (cut(left), added)
        here = free.withColumn("on", F.col("chrom") if by_chrom else F.lit(""))
        if count == before:
            exact = waiting.withColumn("shrunk", F.col("length"))
            if not exact.join(_rooms(exact, here).select("on", "shrunk").distinct(), ["on", "shrunk"], "left_anti").isEmpty():
                raise RuntimeError("no place is left for some of the intervals")
        before = count
        share = needs.join(here.groupBy("on").agg(F.sum(F.col("end") - F.col("start")).alias("room")), "on").select("on", (F.col("room") / F.col("needed")).alias("share"))
        key = F.concat(F.lit(f"{seed}:{k}:"), F.col("id"))
        sized = waiting.withColumn("shrunk", _shrunk(F.col("length"), k))
        going = sized.join(F.broadcast(share), "on").where((F.col("share") >= 1) | (draw(F.concat(F.lit("t"), key)) < F.col("share") * 4294967296.0))
        drawn = _drawn_places(sized, going.drop("share"), here, key, by_chrom)
        kept = cut(running(drawn, ["chrom"], ["start", "end", "id"], reach=("max", "end")).where("reach is null or reach <= start").drop("reach"))
        parts.append(kept.select("id", "chrom", "start", "end"))
        waiting = cut(waiting.join(kept.select("id"), "id", "left_anti"))
    else:
        raise RuntimeError("some intervals found no place")
    none = free.limit(0).select(F.lit("").alias("id"), "chrom", "start", "end")
    return reduce(DataFrame.unionByName, parts, none)


def random_intervals(sizes: DataFrame, size: int, seed: int, domains: DataFrame | None = None) -> DataFrame:
    """``wanted`` intervals of fixed length at uniform places of each chromosome (``chrom, size, wanted``): ``chrom, draw, start, end``.

    None touches a domain or another one.  All ``wanted`` are placed; it is an error if no room is left.
    """
    fits = sizes.where(F.col("wanted") > 0)
    wanted = fits.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wanted") - 1)).alias("draw")).select(F.concat_ws(":", "chrom", "draw").alias("id"), "chrom", F.lit(size).cast("long").alias("length"))
    free = fits.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    found = place(wanted, free if domains is None else cut_out(free, domains), seed, by_chrom=True)
    return found.select("chrom", F.substring_index("id", ":", -1).cast("long").alias("draw"), "start", "end")


def _orders(drawn: DataFrame, bins: int, seed: int) -> DataFrame:
    """``replicate, candidate, bin, place``: a drawn order of all bins for each row of ``drawn``."""
    every = drawn.select("replicate", "candidate", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "candidate", "bin"))
    place = F.row_number().over(Window.partitionBy("replicate", "candidate").orderBy(key, "bin")) - 1
    placed = every.withColumn("place", place)
    # The order that all bins have now is none.
    return placed.join(placed.where("place <> bin").select("replicate", "candidate").distinct(), ["replicate", "candidate"], "left_semi")


def shuffle_bins(df: DataFrame, n: int, binsize: int, bins: int, seed: int, candidates: int = 4, tries: int = 250_000, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``n`` replicates of each group, each the first valid one of its drawn orders of all bins; in-bin offsets stay.

    Orders are judged on one row for each bin, for all groups and replicates that have none yet; each round
    draws twice as many as the one before, so a few rounds make ``tries``.
    """
    spark = df.sparkSession
    placed = cut(_in_bins(df, binsize))
    if not placed.where(~F.col("bin").between(0, bins - 1)).isEmpty():
        raise ValueError("intervals outside of the bins")
    hulls = cut(bin_hulls(placed, keys))
    group = [*keys, "replicate"]
    waiting = cut(placed.select(*keys).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    chosen, at = [], 0
    while at < tries and not waiting.isEmpty():
        drawn = waiting.select("replicate").distinct().withColumn("candidate", F.explode(F.sequence(F.lit(at), F.lit(at + candidates - 1))))
        tried = hulls.join(waiting, list(keys)).join(_orders(drawn, bins, seed), ["replicate", "bin"])
        valid = valid_arrangements(tried, binsize, bins, [*group, "candidate"])
        chosen.append(cut(valid.groupBy(*group).agg(F.min("candidate").alias("candidate"))))
        waiting = cut(waiting.join(chosen[-1], group, "left_anti"))
        at, candidates = at + candidates, candidates * 2
    if not waiting.isEmpty():
        raise RuntimeError("no valid order of bins was drawn for every replicate")
    found = reduce(DataFrame.unionByName, chosen) if chosen else waiting.withColumn("candidate", F.lit(0))
    orders = _orders(found.select("replicate", "candidate").distinct(), bins, seed)
    return _moved(placed.join(found, list(keys)).join(orders, ["replicate", "candidate", "bin"]), binsize)


def global_shuffle(df: DataFrame, sizes: DataFrame, seed: int, excl: DataFrame | None = None, incl: DataFrame | None = None) -> DataFrame:
    """Intervals of the same lengths at uniform places of the genome that overlap no other one.

    ``df`` has ``chrom, start, end, name`` with a unique name; ``sizes`` has a row for each
    chromosome.  Places touch no interval of ``excl`` and lie within one of ``incl``.
    """
    whole = sizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    free = whole if incl is None else cut_out(whole, complement(incl.select("chrom", "start", "end"), sizes))
    free = free if excl is None else cut_out(free, excl)
    found = place(df.select(F.col("name").alias("id"), (F.col("end") - F.col("start")).cast("long").alias("length")), free, seed)
    moved = found.select(F.col("id").alias("name"), F.struct("chrom", "start", "end").alias("new"))
    return df.join(moved, "name").select(*[F.col(f"new.{c}").alias(c) if c in ("chrom", "start", "end") else F.col(c) for c in df.columns])


def first_valid(tries: DataFrame, keys: Sequence[str] = ("run",), on: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Of each replicate (``keys``) the intervals of its smallest ``attempt`` in which no two overlap.

    ``tries`` has all attempts of all replicates; intervals are compared within ``on``, such as a
    chromosome.  A replicate without a valid one is an error, or left out if not ``strict``.
    """
    tries = cut(tries)
    bad = find_overlaps(tries.select(*keys, "attempt", *on, "start", "end"), [*keys, "attempt", *on]).select(*keys, "attempt").distinct()
    good = tries.select(*keys, "attempt").distinct().join(bad, [*keys, "attempt"], "left_anti").groupBy(*keys).agg(F.min("attempt").alias("attempt"))
    if strict and (first := tries.select(*keys).distinct().join(good, list(keys), "left_anti").first()) is not None:
        raise RuntimeError(f"every attempt of a replicate overlaps itself: {first}")
    return tries.join(good, [*keys, "attempt"], "left_semi")


def random_content(df: DataFrame, seed: int, sequence: str | None = None, keys: Sequence[str] = (), binsize: int = 128_000) -> DataFrame:
    """The same places with random letters (or ``sequence``) inserted and names led by ``rdm_``.

    A list (rows of equal ``keys``, such as experiment and replicate) that only permutes between intervals keeps
    its operation, and each replicate has a drawn order of its pieces of ``binsize`` letters in ``bin_order``.
    """
    alone = df.groupBy(*keys).agg(F.min(F.col("op").eqNullSafe("permutations_inter")).alias("_alone"))
    listed = df.join(alone.withColumnsRenamed({k: f"_{k}" for k in keys}), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))).drop(*[f"_{k}" for k in keys])
    name = F.concat(F.lit("rdm_"), F.coalesce(F.nullif("name", F.lit("")), F.concat_ws("_", "chrom", "start", "end")))
    key = F.concat_ws(":", F.lit(str(seed)), *keys, "chrom", "start", "end", F.coalesce("name", F.lit("")))
    letters = F.lit(sequence) if sequence else random_sequence((F.col("end") - F.col("start")).cast("int"), key)
    order = drawn_order(F.floor((F.col("end") - F.col("start")) / binsize), F.concat(key, F.lit(":")))
    # Letters and orders come first: they are drawn by the old name.
    lettered = listed.withColumns({"sequence": F.when(F.col("_alone"), F.lit(sequence).cast("string")).otherwise(letters), "bin_order": F.when(F.col("_alone"), order)})
    return lettered.withColumns({"op": F.when(F.col("_alone"), F.col("op")).otherwise("insertion"), "name": name}).drop("_alone")
