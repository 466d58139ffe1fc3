"""Rows that the driver tables do not hold: halves, NULL names, long digit runs, eigenvectors, refused draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import compare, contacts, intervals, nullmodel, scores, sequence


def test_humanise_rounds_as_the_double_does(spark):
    rows = spark.range(1, 2_000_001, 7).union(spark.range(1050, 1_000_000, 100)).union(spark.range(1_050_000, 99_000_000, 100_000))
    for r in rows.select("id", compare.humanise_bp(F.col("id")).alias("t")).toLocalIterator():
        x = r.id
        assert r.t == (f"{x / 1e6:.1f}Mb" if x > 1e6 else f"{x / 1e3:.1f}kb" if x > 1e3 else f"{x}pb")


def test_exclude_and_include_with_nulls(spark):
    rows = spark.createDataFrame([("c", 10, 20, None), ("c", 10, 20, "x"), ("c", 500, 510, None)], "chrom string, start long, end long, name string")
    found = spark.createDataFrame([("c", 5, 30)], "chrom string, start long, end long")
    assert [r.start for r in intervals.exclude(rows, found).collect()] == [500]
    assert sorted(r.start for r in intervals.include(rows, found).collect()) == [10, 10]


def test_natural_key_of_long_numbers(spark):
    names = ["a9", "a10", "a123456789012", "a1234567890123", "a99999999999999", "a100000000000000", "b1"]
    keys = spark.createDataFrame([(n,) for n in names], "n string").orderBy(compare.natural_key(F.col("n"))).collect()
    assert [r.n for r in keys] == names


def test_pc1_is_the_leading_eigenvector(spark):
    rng = np.random.default_rng(4)
    a = rng.random((30, 30))
    a = a + a.T
    cells = spark.createDataFrame([("r", i, j, float(a[i, j])) for i in range(30) for j in range(30)], "run string, i int, j int, value double")
    v = np.array([r.value for r in scores.pc1(cells, 30).orderBy("bin").collect()])
    b = a - 1
    rate = v @ b @ v
    assert np.allclose(b @ v, rate * v) and np.isclose(abs(rate), np.abs(np.linalg.eigvalsh(b)).max())


def test_geometric_leaves_out_rows_without_contacts(spark):
    rows = [("r", i, j, 0.0 if 2 in (i, j) else 3.0) for i in range(4) for j in range(4)]
    got = contacts.obs_over_exp_geometric(spark.createDataFrame(rows, "run string, i int, j int, value double")).collect()
    assert len(got) == 9 and all(r.value == 1 and 2 not in (r.i, r.j) for r in got)


def test_rotations_are_too_few(spark):
    one = spark.createDataFrame([("c", 0, 10)], "chrom string, start long, end long")
    assert nullmodel.rotate_bins(one, 3, 100, 4, 1).count() == 3
    with pytest.raises(ValueError):
        nullmodel.rotate_bins(one, 4, 100, 4, 1)


def test_shuffled_bins_are_moved(spark):
    two = spark.createDataFrame([("c", 0, 10), ("c", 100, 120)], "chrom string, start long, end long")
    for r in nullmodel.shuffle_bins(two, 6, 100, 2, 5, candidates=8).where("end - start = 10").collect():
        assert r.start == 100


def test_pair_scores_checks_lengths(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "run string, bin int, value double")
    with pytest.raises(ValueError):
        compare.pair_scores(rows, "a", "b")


def test_six_operations(spark):
    ops = ["mask", "inversion", "shuffle", "insertion", "permutations_inter", "permutations_intra", "permutations_intra", "other"]
    rows = spark.createDataFrame([(1, op, "AACCGGTT" if k % 2 else "TTGGCCAA", "ACG", "+", 10 * k) for k, op in enumerate(ops)], "seq_id int, op string, ref_seq string, sequence string, strand string, start int")
    got = {(r.op, r.start): r for r in sequence.mutate(rows, F.col("start").cast("string"), binsize=2).collect()}
    assert len(got) == 8
    assert got["mask", 0].variant_seq == "N" * 8 and got["insertion", 30].variant_seq == "ACGACGAC"
    assert sorted(got["shuffle", 20].variant_seq) == sorted("TTGGCCAA")
    pieces = got["permutations_inter", 40].variant_seq
    assert sorted(pieces[k : k + 2] for k in range(0, 8, 2)) == ["AA", "CC", "GG", "TT"]
    assert got["permutations_intra", 50].variant_seq == "TTGGCCAA" and got["permutations_intra", 60].variant_seq == "AACCGGTT"
    assert got["other", 70].variant_seq is None and got["other", 70].reason == "unknown operation"


def test_splice_of_chunks(spark):
    """Pieces that grow, shrink, vanish, cross chunks and are rejected, against plain slices."""
    seq = "ACGTTGCA" * 20
    rows = [(1, 0, 3, "TT"), (1, 10, 10, "GGGG"), (1, 30, 75, None), (1, 80, 130, ""), (1, 155, 160, "ACGTACGTAC" * 5)]
    edits = spark.createDataFrame(rows, "seq_id int, start long, end long, variant_seq string")
    want, at = "", 0
    for _, a, b, v in rows:
        want, at = want + seq[at:a] + (seq[a:b] if v is None else v), b
    want += seq[at:]
    chunks = sequence.chunked(spark.createDataFrame([(1, seq), (2, "AC")], "seq_id int, seq string"), 16)
    got = sequence.splice_chunks(chunks, edits, 16).orderBy("seq_id", "chunk_id").collect()
    assert "".join(r.seq for r in got if r.seq_id == 1) == want and "".join(r.seq for r in got if r.seq_id == 2) == "AC"
    assert all(r.chunk_start == 16 * r.chunk_id for r in got)


def test_given_order(spark):
    row = spark.createDataFrame([("AACCGG",)], "s string")
    order = lambda *x: F.array(*map(F.lit, x))
    got = row.select(sequence.permute_within(F.col("s"), 2, order=order(2, 0, 1)).alias("a"), sequence.permute_within(F.col("s"), 2, order=order(2, 2, 1)).alias("b")).first()
    assert tuple(got) == ("GGAACC", None)


def test_phased_fits(spark):
    rows = [("n", k, float(k)) for k in range(9)] + [("a", k, -2.0 * k) for k in range(9)]
    table = spark.createDataFrame(rows, "run string, bin int, value double")
    assert compare.regress(table, "n").first().slope == -2 and compare.regress(table, "n", phased=True).first().slope == 2
    assert all(r.second == 2 * r.first for r in compare.pair_scores(table, "n", "a", phased=True).collect())


def test_strict_windows_and_shapes(spark):
    loci = spark.createDataFrame([("c", 500), ("c", 510)], "chrom string, pos long")
    sizes = spark.createDataFrame([("c", 10_000)], "chrom string, size long")
    assert [r.pos for r in intervals.place_windows(loci, sizes, 200, 100, strict=True).collect()] == [500]
    small, large = (spark.createDataFrame([(i, i, 1.0) for i in range(n)], "i int, j int, value double") for n in (2, 3))
    with pytest.raises(ValueError):
        contacts.join_triangles(small, large)
