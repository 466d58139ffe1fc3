"""Mutations of all six operations, and splicing where some were rejected."""

import random

import pandas as pd
from locusframe.operators import sequence
from pyspark.sql import functions as F

SEQ = "AACCGGTTACGTACGTTTGG"
ROWS = [
    (1, 0, 4, "mask"), (1, 4, 8, "permutations_inter"), (1, 8, 11, "permutations_inter"), (1, 12, 14, "deletion"),
    (2, 0, 4, "permutations_intra"), (2, 8, 12, "permutations_intra"), (2, 15, 19, "permutations_intra"), (3, 2, 4, "permutations_intra"),
]


def test_permutations_and_rejected_mutations(spark):
    seqs = spark.createDataFrame([(k, SEQ) for k in (1, 2, 3)], "seq_id long, seq string")
    rows = spark.createDataFrame([(k, a, b, op, SEQ[a:b], None, "+") for k, a, b, op in ROWS], "seq_id long, start int, end int, op string, ref_seq string, sequence string, strand string")
    done = sequence.mutate(rows, F.col("seq_id").cast("string"), binsize=2)
    got = {(r.seq_id, r.start): r for r in done.collect()}
    assert len(got) == len(ROWS)
    assert got[1, 0].variant_seq == "NNNN" and got[1, 4].variant_seq in ("GGTT", "TTGG") and got[1, 4].reason is None
    assert got[1, 8].variant_seq is None and got[1, 8].reason == "bin size does not divide the interval" and got[1, 12].reason == "unknown operation"
    assert sorted(got[2, a].variant_seq for a in (0, 8, 15)) == sorted(SEQ[a : a + 4] for a in (0, 8, 15))
    assert all(got[2, a].variant_seq != SEQ[a : a + 4] for a in (0, 8, 15)) and got[3, 2].variant_seq == "CC"
    valid = sequence.validate_mutations(rows).where("reason is not null").collect()
    assert [r.op for r in valid] == ["deletion"]
    whole = {r.seq_id: r.seq for r in sequence.splice(seqs, done).collect()}
    assert whole[1] == "NNNN" + got[1, 4].variant_seq + SEQ[8:] and whole[3] == SEQ
    assert {r.seq for r in sequence.revert(sequence.splice(seqs, done), done).collect()} == {SEQ}


def test_revert_after_variants_of_other_lengths(spark):
    """Longer, shorter and vanished variants, two of them side by side, and one that was rejected."""
    seq = "AACCGGTTAACC" * 5
    rows = [(1, 2, 4, "TTTTT"), (1, 8, 10, "G"), (1, 14, 18, ""), (1, 18, 21, ""), (1, 30, 33, None), (1, 40, 40, "ACGT"), (1, 58, 60, "")]
    trace = spark.createDataFrame([(k, a, b, seq[a:b], v) for k, a, b, v in rows], "seq_id long, start int, end int, ref_seq string, variant_seq string")
    seqs = spark.createDataFrame([(1, seq), (2, "ACG")], "seq_id long, seq string")
    for chunk in (4, 16, 4096):
        mutated = sequence.splice_chunks(sequence.chunked(seqs, chunk), trace, chunk)
        back = {}
        for r in sequence.revert_chunks(mutated, trace, chunk).orderBy("seq_id", "chunk_id").collect():
            back[r.seq_id] = back.get(r.seq_id, "") + r.seq
        assert back == {1: seq, 2: "ACG"}
        assert sequence.verify_chunks(sequence.chunked(seqs, chunk), mutated, trace, chunk).count() == 0


def test_changes_between_mutations_are_seen(spark):
    seq = "ACGTTGCAAC" * 10
    edits = spark.createDataFrame([(1, 10, 13, "GGGGGGGG"), (1, 50, 60, "")], "seq_id long, start int, end int, variant_seq string")
    after = seq[:10] + "GGGGGGGG" + seq[13:50] + seq[60:]
    before = spark.createDataFrame([(1, seq)], "seq_id long, seq string")
    for changed, want in ((after, []), ("T" + after[1:], [(0, 10)]), (after[:30] + "N" + after[31:], [(13, 50)]), (after + "A", [(60, 101)]), (after[:-1], [(60, 100)])):
        got = sequence.verify_splice(before, spark.createDataFrame([(1, changed)], "seq_id long, seq string"), edits, 8).collect()
        assert [(r.start, r.end) for r in got] == want


def _counted(df, column, seen):
    """``df`` whose ``column`` passes through Python, which adds up how many rows were computed."""

    @F.pandas_udf("string")
    def passed(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    return df.withColumn(column, passed.asNondeterministic()(column))


def _case(rng, n):
    """A sequence of ``n`` letters, its mutations in order, and what they make of it."""
    seq, at, rows, new = "".join(rng.choice("ACGT") for _ in range(n)), 0, [], ""
    while at < n:
        start = at + rng.choice([0, 1, 3, 40, 700])
        end = min(start + rng.choice([0, 1, 5, 64, 900]), n)
        if start > n or rows and start == end == rows[-1][1]:
            at += 1
            new += seq[at - 1 : at]
            continue
        variant = rng.choice([None, "", "T", "G" * 70, "ACG" * rng.choice([10, 400])])
        rows.append((start, end, variant))
        new += seq[at:start] + (seq[start:end] if variant is None else variant)
        at = max(end, start)
        if end == start:
            new += seq[at : at + 1]
            at += 1
    return seq, rows, new


def test_chunks_of_many_blocks(spark):
    """Kept stretches and variants within a chunk and over many blocks of chunks, there and back; the inputs are computed once."""
    rng = random.Random(8)
    cases = {k: _case(rng, n) for k, n in enumerate([0, 1, 63, 64, 65, 700, 3000, 5000, 9000])}
    cases[100] = ("ACGT" * 50, [], "ACGT" * 50)
    seqs = spark.createDataFrame([(k, c[0]) for k, c in cases.items()], "seq_id long, seq string")
    trace = spark.createDataFrame([(k, a, b, c[0][a:b], v) for k, c in cases.items() for a, b, v in c[1]], "seq_id long, start int, end int, ref_seq string, variant_seq string")
    for chunk in (3, 64):
        chunks, seen = sequence.chunked(seqs, chunk), [spark.sparkContext.accumulator(0) for _ in range(3)]
        mutated = sequence.splice_chunks(_counted(chunks, "seq", seen[0]), _counted(trace, "variant_seq", seen[1]), chunk)
        for table, which in ((mutated, 2), (sequence.revert_chunks(mutated, trace, chunk), 0)):
            found = {}
            for r in table.orderBy("seq_id", "chunk_id").collect():
                assert r.chunk_start == r.chunk_id * chunk == len(found.get(r.seq_id, ""))
                found[r.seq_id] = found.get(r.seq_id, "") + r.seq
            assert found == {k: c[which] for k, c in cases.items() if c[which]}
        assert [s.value for s in seen[:2]] == [chunks.count(), trace.count()]
        changed = mutated.withColumn("seq", F.when(F.col("seq_id") == 100, F.translate("seq", "A", "N")).otherwise(F.col("seq")))
        extra = spark.createDataFrame([(100, 90, 91, "C", "C")], trace.schema)
        edits = _counted(trace.unionByName(extra), "variant_seq", seen[2])
        assert sorted((r.seq_id, r.start, r.end) for r in sequence.verify_chunks(chunks, changed, edits, chunk).collect()) == [(100, 0, 90), (100, 91, 200)]
        assert seen[2].value == trace.count() + 1


def test_prints_of_a_batch():
    """Against the polynomial itself, in slices of any size, with characters past 16 bits and no rows."""
    texts, offsets = ["ACGT", "", "N\U0001f600é", "T" * 300, "G"], [0, 5, 10**9, 7, 2**40]
    for most in (1, 5, 1 << 20):
        got = sequence.part_printer(most)(pd.Series(texts), pd.Series(offsets))
        for column, p, base in zip("xy", sequence.MODULI, sequence.BASES, strict=True):
            assert got[column].tolist() == [sum((ord(c) + 1) * pow(base, o + k, p) for k, c in enumerate(t)) % p for t, o in zip(texts, offsets, strict=True)]
    assert sequence.part_printer()(pd.Series([], dtype=str), pd.Series([], dtype="int64")).empty
