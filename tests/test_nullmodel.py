"""Random replicates: what SQL text does not state."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import nullmodel


def test_global_shuffle(spark):
    df = spark.createDataFrame([("a", i * 10, i * 10 + 3 + i % 5, f"n{i}") for i in range(60)], "chrom string, start long, end long, name string")
    sizes = spark.createDataFrame([("a", 900), ("b", 700)], "chrom string, size long")
    domains = spark.createDataFrame([("a", 0, 300)], "chrom string, start long, end long")
    for kind in ("excl", "incl", None):
        few = df.where("start < 200") if kind == "incl" else df
        rows = nullmodel.global_shuffle(few, sizes, 3, **({kind: domains} if kind else {})).collect()
        again = nullmodel.global_shuffle(few.repartition(5), sizes, 3, **({kind: domains} if kind else {})).collect()
        assert sorted(rows) == sorted(again)
        assert sorted((r.name, r.end - r.start) for r in rows) == sorted((r.name, r.end - r.start) for r in few.collect())
        placed = sorted((r.chrom, r.start, r.end) for r in rows)
        assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(placed, placed[1:], strict=False))
        inside = [c == "a" and s < 300 for c, s, _ in placed]
        assert all(inside) if kind == "incl" else not any(inside) if kind == "excl" else len({c for c, _, _ in placed}) == 2
    assert nullmodel.global_shuffle(df.limit(0), sizes, 3).count() == 0


@pytest.mark.parametrize("million", [125, 250])
def test_places_are_uniform_at_genome_scale(spark, million):
    """Chi-square over 25 equal chromosomes, and over ten parts of them; 24 and 9 degrees of freedom."""
    sizes = spark.range(25).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chrom"), F.lit(million * 1_000_000).cast("long").alias("size"))
    df = spark.range(20_000).select(F.lit("c1").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 200).alias("end"), F.concat(F.lit("n"), "id").alias("name"))
    placed = nullmodel.global_shuffle(df, sizes, 4).select("chrom", F.floor(F.col("start") / (million * 100_000)).alias("tenth")).collect()
    for column, cells, most in (("chrom", 25, 43), ("tenth", 10, 22)):
        counts = {}
        for r in placed:
            counts[r[column]] = counts.get(r[column], 0) + 1
        assert len(counts) == cells and sum(counts.values()) == 20_000
        assert sum((n - 20_000 / cells) ** 2 / (20_000 / cells) for n in counts.values()) < most


def test_tight_places_are_filled(spark):
    """All 200 of 312 bases on 100 kb, and an interval that only just fits one stretch."""
    rows = sorted((r.start, r.end) for r in nullmodel.random_intervals(spark.createDataFrame([("a", 100_000, 200)], "chrom string, size long, wanted long"), 312, 5).collect())
    assert len(rows) == 200 and all(x[1] <= y[0] for x, y in zip(rows, rows[1:], strict=False)) and rows[-1][1] <= 100_000
    df = spark.createDataFrame([("a", 0, 100, "x")], "chrom string, start long, end long, name string")
    sizes = spark.createDataFrame([("a", 99), ("b", 100), ("c", 64)], "chrom string, size long")
    assert [(r.chrom, r.start, r.end) for r in nullmodel.global_shuffle(df, sizes, 1).collect()] == [("b", 0, 100)]


def test_no_room_is_an_error(spark):
    with pytest.raises(RuntimeError):
        nullmodel.random_intervals(spark.createDataFrame([("a", 1000, 5)], "chrom string, size long, wanted long"), 312, 5)


def test_shuffle_bins_draws_again(spark):
    # Bin 0 spills into bin 1: only orders that leave the next place free are valid.
    df = spark.createDataFrame([("a", 5, 14), ("a", 22, 28), ("a", 31, 39)], "chrom string, start long, end long")
    rows = nullmodel.shuffle_bins(df, 4, 10, 8, 1, candidates=1).collect()
    assert {r.replicate for r in rows} == set(range(4))
    for k in range(4):
        placed = sorted((r.start, r.end) for r in rows if r.replicate == k)
        assert [e - s for s, e in sorted(placed, key=lambda x: x[1] - x[0])] == [6, 8, 9]
        assert placed[0][0] >= 0 and placed[-1][1] <= 80 and all(x[1] <= y[0] for x, y in zip(placed, placed[1:], strict=False))
    with pytest.raises(RuntimeError):
        nullmodel.shuffle_bins(df.where("start = 5"), 1, 10, 1, 1, tries=8)
    with pytest.raises(ValueError):
        nullmodel.shuffle_bins(df, 1, 10, 2, 1)


def test_first_valid_attempt(spark):
    rows = [("r1", 0, 0, 10), ("r1", 0, 5, 15), ("r1", 1, 0, 10), ("r1", 1, 10, 15), ("r2", 0, 3, 4), ("r2", 1, 8, 9), ("r3", 0, 0, 5), ("r3", 0, 4, 6)]
    tries = spark.createDataFrame(rows, "run string, attempt int, start long, end long")
    got = sorted(tuple(r) for r in nullmodel.first_valid(tries, strict=False).select("run", "attempt", "start", "end").collect())
    assert got == [("r1", 1, 0, 10), ("r1", 1, 10, 15), ("r2", 0, 3, 4)]
    with pytest.raises(RuntimeError):
        nullmodel.first_valid(tries)


def test_each_replicate_has_its_own_order(spark):
    rows = [(f"r{k}", "c", 0, 640, None, "permutations_inter") for k in range(4)]
    got = nullmodel.random_content(spark.createDataFrame(rows, "run string, chrom string, start long, end long, name string, op string"), 3, keys=("run",), binsize=64).collect()
    assert all(sorted(r.bin_order) == list(range(10)) and r.sequence is None for r in got)
    assert len({tuple(r.bin_order) for r in got}) > 1


def test_bins_whose_intervals_overlap_are_never_arranged(spark):
    df = spark.createDataFrame([("a", 2, 6), ("a", 5, 8)], "chrom string, start long, end long")
    with pytest.raises(ValueError):
        nullmodel.rotate_bins(df, 1, 10, 4, 1)


def test_rotations_of_several_groups(spark):
    """A bin that spills to the left can't come first; groups are judged apart."""
    df = spark.createDataFrame([("a", 9, 15), ("a", 31, 35), ("b", 0, 10)], "chrom string, start long, end long")
    got = {}
    for r in nullmodel.rotate_bins(df, 2, 10, 4, 7).collect():
        got.setdefault(r.chrom, {}).setdefault(r["shift"], []).append((r.start, r.end))
    assert len(got["a"]) == len(got["b"]) == 2
    assert set(got["a"]) <= {2, 3} and all(len(x) == 2 and min(s for s, _ in x) >= 0 for x in got["a"].values())


def test_shifts_are_judged_as_whole_arrangements_are(spark):
    """Hulls that reach other bins, both ends of the range and each other, against every arrangement of every shift."""
    rng, bins, rows = random.Random(6), 9, []
    for g in range(60):
        for k in sorted(rng.sample(range(bins), rng.randrange(1, bins))):
            low = rng.choice([-4, -1, 0, 2, 5])
            rows.append((f"g{g}", k, low, low + rng.choice([1, 3, 8, 10, 14] if g % 3 else [1, 3, 5])))
    hulls = spark.createDataFrame(rows, "chrom string, bin long, low long, high long")
    got = {tuple(r) for r in nullmodel.valid_shifts(hulls, 10, bins, ["chrom"]).collect()}
    turned = hulls.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(bins - 1)))).withColumn("place", F.pmod(F.col("bin") - F.col("shift"), F.lit(bins)))
    assert got == {tuple(r) for r in nullmodel.valid_arrangements(turned, 10, bins, ["chrom", "shift"]).collect()} and 0 < len(got) < 60 * (bins - 1)
    # 60,000 bins: pairs of bins and shifts would be 3.6 billion rows.
    many = spark.range(60_000).select(F.lit("a").alias("chrom"), (F.col("id") * 10 + 2).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    moved = nullmodel.rotate_bins(many, 2, 10, 60_000, 3)
    assert moved.count() == 120_000 and moved.select("replicate", "start").distinct().count() == 120_000


def _drawn(key, digits):
    return int(hashlib.md5(key.encode()).hexdigest()[:digits], 16)


def _placed_one_by_one(waiting, free, seed, by_chrom):
    """``place`` in plain Python: ``waiting`` has ``id: (chrom, length)``, ``free`` has ``(chrom, start, end)``."""
    kept, k = {}, 0
    while waiting:
        drawn = []
        for name, (chrom, length) in waiting.items():
            mine = [x for x in waiting.values() if not by_chrom or x[0] == chrom]
            here = sorted(f for f in free if not by_chrom or f[0] == chrom)
            share = sum(e - s for _, s, e in here) / sum(n for _, n in mine)
            spare = max(int(math.log2(length)) - k // 2, 0)
            shrunk = length >> spare << spare
            whole = sum(max(e - s - shrunk + 1, 0) for _, s, e in here)
            x = _drawn(f"{seed}:{k}:{name}", 15)
            if not whole or x >= (1 << 60) - (1 << 60) % whole or _drawn(f"t{seed}:{k}:{name}", 8) >= share * 2**32:
                continue
            u = x % whole
            for c, s, e in here:
                room = max(e - s - shrunk + 1, 0)
                if u < room:
                    if s + u + length <= e:
                        drawn.append((c, s + u, s + u + length, name))
                    break
                u -= room
        reach = {}
        for c, s, e, name in sorted(drawn):
            if reach.get(c, s) <= s:
                kept[name] = (c, s, e)
                del waiting[name]
                free = [p for f in free for p in ([f] if not (f[0] == c and f[1] <= s and e <= f[2]) else [(c, f[1], s), (c, e, f[2])]) if p[1] < p[2]]
            reach[c] = max(reach.get(c, e), e)
        k += 1
    return kept


@pytest.mark.parametrize("by_chrom", [False, True])
def test_places_in_many_ranges_and_tasks(spark, monkeypatch, by_chrom):
    """Ranges of a few free stretches, a handful of draws in a task, one stretch that most draws meet, ranges drawn anew."""
    monkeypatch.setattr(nullmodel, "STRETCHES", 7)
    monkeypatch.setattr(nullmodel, "DRAWS", 5)
    rng = random.Random(9)
    free = [(c, s, s + rng.choice([1, 2, 9, 40])) for c in ("a", "b") for s in range(0, 2000, 50)] + [("a", 3000, 6000), ("b", 3000, 9000)]
    waiting = {f"n{k}": (rng.choice("ab"), rng.choice([1, 3, 7, 8, 13])) for k in range(120)}
    got = nullmodel.place(
        spark.createDataFrame([(n, c, x) for n, (c, x) in waiting.items()], "id string, chrom string, length long"), spark.createDataFrame(free, "chrom string, start long, end long"), 4, by_chrom
    ).collect()
    assert len(got) == 120 and {r.id: (r.chrom, r.start, r.end) for r in got} == _placed_one_by_one(dict(waiting), free, 4, by_chrom)
