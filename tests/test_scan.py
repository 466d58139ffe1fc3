"""Running values over ranges, interval operators built on them and nested bins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.functions import lineage
from locusframe.functions.scan import running
from locusframe.operators import intervals, sequence


def test_running_values_in_both_directions(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab" if k % 3 else "a") if k % 17 else None, k // 2 if k % 5 else rng.randrange(300), rng.choice([None, rng.randrange(100)]), k) for k in range(600)]
    df = spark.createDataFrame(data, "key string, at long, x long, id long").repartition(7)
    for reverse in (False, True):
        got = {r.id: (r.s, r.m, r.z, r.at) for r in running(df, ["key"], ["at", "id"], reverse, s=("sum", "x"), m=("max", "x"), z=("last", "x")).collect()}
        want, held = {}, {}
        for key, at, x, k in sorted(data, key=lambda r: (r[1], r[3]), reverse=reverse):
            xs = held.setdefault(key, [])
            want[k] = (sum(xs), max(xs, default=None), xs[-1] if xs else None, at)
            if x is not None:
                xs.append(x)
        assert got == want


def test_one_chromosome_is_spread_over_tasks(spark):
    from locusframe.functions.scan import PART, dealt

    parts = dealt(spark.range(4000).select(F.lit("a").alias("chrom"), F.col("id").alias("start")), ["chrom", "start"])
    sizes = [r["count"] for r in parts.groupBy(PART).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1000


def _some(rng, n, longest):
    return [("ab"[k % 2], s := rng.randrange(20_000), s + rng.choice([0, 1, 5, rng.randrange(longest)]), k) for k in range(n)]


@pytest.mark.parametrize("longest", [20, 3000])
def test_pairs_exclude_and_include(spark, longest):
    rng = random.Random(longest)
    a, b = [*_some(rng, 300, 60), (None, 5, 9, 900), ("a", None, 9, 901)], [*_some(rng, 60, longest), ("a", 0, 100_000_000, 99), (None, 0, 50, 98)]
    left = spark.createDataFrame(a, "chrom string, start long, end long, id long")
    right = spark.createDataFrame(b, "chrom string, start long, end long, other long")
    meet = {(x[3], y[3]) for x in a for y in b if x[0] and x[0] == y[0] and x[1] is not None and x[1] < y[2] and y[1] < x[2]}
    got = intervals.overlap_join(left, right).select("id", "other").collect()
    assert len(got) == len(meet) and {tuple(r) for r in got} == meet
    few = right.where("other < 30")
    hit = {x for x, y in meet if y < 30}
    assert sorted(r.id for r in intervals.exclude(left, few).collect()) == sorted({x[3] for x in a} - hit)
    inside = {x[3] for x in a for y in b if y[3] < 30 and x[0] and x[0] == y[0] and x[1] is not None and y[1] <= x[1] and x[2] <= y[2]}
    assert sorted(r.id for r in intervals.include(left, few).collect()) == sorted(inside)


def test_long_intervals_take_few_keys(spark):
    df = spark.createDataFrame([("a", 1000, 100_001_000)], "chrom string, start long, end long")
    homed = intervals._homed(df, "start", "end")
    other = intervals._homed(spark.createDataFrame([("a", k, k + 1) for k in range(0, 1 << 30, 1 << 22)], "chrom string, start long, end long"), "start", "end")
    assert intervals._around(other, homed, True).count() == other.count()
    assert intervals._around(homed, homed, True).count() == 1


def test_cut_out_and_carve(spark):
    rng = random.Random(4)
    free = [("a", 10, 400), ("a", 420, 900), ("b", 0, 50)]
    taken = [("a", 0, 20), ("a", 30, 35), ("a", 33, 60), ("a", 390, 430), ("a", 880, 2000), ("b", 50, 60), ("c", 1, 2), ("a", 100, 100)]
    place = lambda rows: {(c, p) for c, s, e in rows for p in range(s, e)}
    schema = "chrom string, start long, end long"
    rest = [tuple(r) for r in intervals.cut_out(spark.createDataFrame(free, schema), spark.createDataFrame(taken, schema)).collect()]
    assert place(rest) == place(free) - place(taken)
    inside = [("a", s, s + 7) for s in sorted(rng.sample(range(10, 390, 10), 20))] + [("a", 420, 430), ("a", 890, 900), ("b", 0, 50), ("a", 500, 500)]
    rest = [tuple(r) for r in intervals.carve(spark.createDataFrame(free, schema), spark.createDataFrame(inside, schema)).collect()]
    assert place(rest) == place(free) - place(inside) and all(s < e for _, s, e in rest)


def test_permute_between_is_one_cycle(spark):
    rows = [(c, k, f"{c}{k}") for c, n in (("a", 40), ("b", 2), ("c", 1)) for k in range(n)]
    got = sequence.permute_between(spark.createDataFrame(rows, "chrom string, id long, seq string"), 3).collect()
    assert len(got) == len(rows) and all(r.new_seq == f"{r.chrom}{r.donor}" for r in got)
    for c, n in (("a", 40), ("b", 2), ("c", 1)):
        to = {r.id: r.donor for r in got if r.chrom == c}
        at, seen = 0, set()
        while at not in seen:
            seen.add(at)
            at = to[at]
        assert len(seen) == n


def test_lineage_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(_, default=None):
                return default

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())
