"""Scans and sinks on small hand-written files."""

from locusframe.sources import sinks, text


def put(path, content):
    path.write_text(content)
    return str(path)


def test_bed(spark, tmp_path):
    p = put(tmp_path / "a.bed", "# head\nchr9  10 20\nchr9\t30\t41\tx\t0\t-\nshort 1\n")
    rows = sorted(map(tuple, text.read_bed(spark, p).collect()))
    assert rows == [("chr9", 10, 20, "chr9_10_20", "+"), ("chr9", 30, 41, "x", "-")]
    sinks.write_bed(text.read_bed(spark, p), str(tmp_path / "out"))
    assert sorted(map(tuple, text.read_bed(spark, str(tmp_path / "out")).collect())) == rows


def test_mutations_and_trace(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "chrom\tstart\tend\tname\tstrand\toperation\tsequence\nchr1\t105\t110\ta\t+\tmask\t\n")
    (row,) = text.read_mutations(spark, p, 100).collect()
    assert (row.start, row.end, row.operation, row.sequence) == (5, 10, "mask", None)
    p = put(tmp_path / "t.tsv", "chrom\tname\tstart\tend\tstrand\toperation\tref_seq\tvariant_seq\nchr1\ta\t5\t8\t+\tmask\tACG\tNNN\n")
    (row,) = text.trace_to_insertions(text.read_trace(spark, p), "chr2").collect()
    assert tuple(row) == ("chr2", 5, 8, "a", "+", "insertion", "ACG")


def test_matrix(spark, tmp_path):
    p = put(tmp_path / "m.txt", "# Tool=predictions resol=32Mb nbins=2\n1.5\tnan\n-2\tx\n")
    assert sorted(map(tuple, text.read_matrix(spark, p).select("i", "j", "value").collect()), key=lambda r: r[:2]) == [(0, 0, 1.5), (0, 1, None), (1, 0, -2.0), (1, 1, None)]
    assert text.read_matrix_meta(spark, p).first().meta["resol"] == "32Mb"


def test_small_tables(spark, tmp_path):
    p = put(tmp_path / "s.fai", "chr1\t1000\t6\t60\t61\nchr2\t257\t1100\t60\t61\n")
    assert sorted(map(tuple, text.read_chrom_sizes(spark, p).collect())) == [("chr1", 1000), ("chr2", 257)]
    p = put(tmp_path / "l.log", "# c\nresol\tchrom\tstart\tend\tpadding_chr\n32Mb\tchr9\t0\t320\tchr1\n1Mb\tchr9\t0\t10\tchr1\n")
    assert [(r.resol, r["rank"]) for r in text.read_levels(spark, p).orderBy("rank").collect()] == [("1Mb", 1), ("32Mb", 2)]
    p = put(tmp_path / "r.tsv", "name\tlist_resol\tpath\tgtype\tgenome\tobj_type\trefgenome\tmtype\ttrace_path\nrun\t1Mb\t/p\tg\tx\to\tr\tm\t_\n")
    assert text.read_runs(spark, p, True).first().trace_path is None


def test_pixels(spark):
    pixels = spark.createDataFrame([(10, 0, 1, 4), (10, 0, 0, 2), (20, 0, 0, 9)], "resolution int, bin1_id long, bin2_id long, count long")
    bins = spark.createDataFrame([(10, 0, "chr1", 0, 10, 0.5), (10, 1, "chr1", 10, 20, None), (20, 0, "chr1", 0, 20, 1.0)], "resolution int, bin_id long, chrom string, start long, end long, weight double")
    got = sorted(map(tuple, text.pixels_at(pixels, bins, 10, "1", 0, 20).collect()))
    assert got == [(0, 0, 0.5, 2), (0, 1, None, 4)]


def test_sinks(spark, tmp_path):
    sinks.write_fasta(spark.createDataFrame([("chr1", "acgt" * 31, 2)], "seq_id string, seq string, n_mutations int"), str(tmp_path / "fa"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "fa")).collect()]
    assert lines == [">chr1 mutated chromosome 2 mutations", ("ACGT" * 31)[:60], ("ACGT" * 31)[60:120], "ACGT"]
    scores = spark.createDataFrame([("a", "ins", 1, None), ("a", "ins", 0, 0.5)], "run string, score_type string, bin int, value double")
    sinks.write_scores_wide(scores, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first().value == "a\tins\t0.5\tnan"


def test_fasta(spark, tmp_path):
    put(tmp_path / "a.fa", ">c1 first\n" + "\n".join(["ACGTACGTAC"] * 23 + ["GGT"]) + "\n>c2\nTTAA\n\n>c3\n" + "\n".join(["CCCCCGGGGG"] * 31) + "\n")
    want = {"c1": "ACGTACGTAC" * 23 + "GGT", "c2": "TTAA", "c3": "CCCCCGGGGG" * 31}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for size in ("37b", "64b", "1m"):  # lines in many blocks, blocks without a header
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = text.read_fasta(spark, str(tmp_path / "a.fa"), 33).orderBy("seq_id", "chunk_id").collect()
            assert {k: "".join(r.seq for r in got if r.seq_id == k) for k in want} == want
            assert all(r.chunk_start == r.chunk_id * 33 for r in got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_predictions_and_manifests(spark, tmp_path):
    run, other = tmp_path / "run", tmp_path / "other"
    for folder, shift in ((run, 0), (other, 100)):
        folder.mkdir()
        put(folder / "pred_predictions_1Mb.txt", "# resol=1Mb chrom=chr9 start=5 end=25 nbins=2 genome=g\n1\t2\n3\t4\n")
        put(folder / "pred.log", f"# levels\n1Mb\tchr9\t{shift}\t{shift + 10}\tchr1\n2Mb\tchr9\t{shift}\t{shift + 20}\tchr1\n")
    put(run / "pred_normmats_1Mb.txt", "# resol=1Mb\n5\t6\n6\t5\n")
    rows = text.read_predictions(spark, str(tmp_path / "*" / "pred_*.txt")).collect()
    assert {(r.resol, r.i, r.j, r.value, r.expected) for r in rows if r.folder.endswith("run")} == {("1Mb", 0, 0, 1, 5), ("1Mb", 0, 1, 2, 6), ("1Mb", 1, 0, 3, 6), ("1Mb", 1, 1, 4, 5)}
    assert all(r.expected is None for r in rows if r.folder.endswith("other")) and len(rows) == 8
    meta = text.read_matrix_meta(spark, str(run / "pred_predictions_1Mb.txt")).select(text.typed_header(text.F.col("meta")).alias("m")).first().m
    assert (meta.resol, meta.start, meta.end, meta.nbins, meta.width) == ("1Mb", 5, 25, 2, None)

    trace = put(tmp_path / "t.tsv", "chrom\tname\tstart\tend\tstrand\toperation\tref_seq\tvariant_seq\nchr9\ta\t5\t8\t+\tmask\tACG\tNNN\n")
    head = "name\tlist_resol\tpath\tgtype\tgenome\tobj_type\trefgenome\tmtype\ttrace_path\n"
    ref = put(tmp_path / "ref.tsv", head + f"n\t1Mb,2Mb\t{run}\tg\tx\to\tr\tm\t_\nm\t1Mb\t{run}\tg\tx\to\tr\tm\t_\n")
    comp = put(tmp_path / "comp.tsv", head + f"a\t2Mb\t{other}\tg\tx\to\tr\tm\t{trace}\n")
    runs = text.read_manifests(spark, ref, comp, offset=1000)
    assert sorted((r["name"], r.resol, r.start, r.end, r.is_ref, r.has_trace) for r in runs.collect()) == [
        ("a", "2Mb", 1100, 1120, False, True), ("m", "1Mb", 1000, 1010, False, False), ("n", "1Mb", 1000, 1010, True, False), ("n", "2Mb", 1000, 1020, True, False)
    ]
    assert [tuple(r) for r in text.read_run_traces(spark, runs).collect()] == [("a", 5, 8, "mask")]


def test_more_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("a", "ins", "1Mb", 0, 0.5)], "run string, score_type string, resolution string, bin int, value double")
    names = [sinks.write_scores_wide(scores, str(tmp_path / "w")) for _ in range(3)]
    assert names == [str(tmp_path / x) for x in ("w", "w_1", "w_2")]
    sinks.write_scores_long(scores, str(tmp_path / "l"), "overwrite")
    sinks.write_scores_long(scores.withColumn("run", text.F.lit("b")), str(tmp_path / "l"))
    assert sorted(r.run for r in spark.read.parquet(str(tmp_path / "l")).collect()) == ["a", "b"]
    trace = spark.createDataFrame([("e", "r", "chr9", "a", 5, 8, "+", "mask", "ACG", "NNN")], "experiment string, run string, " + text.TRACE)
    sinks.write_trace(trace, str(tmp_path / "t"))
    assert [tuple(r)[:4] for r in text.read_trace(spark, str(tmp_path / "t" / "experiment=e" / "run=r")).collect()] == [("chr9", "a", 5, 8)]
    runs = spark.createDataFrame([("n", "1Mb", "/p", "g", "x", "o", "r", "m", None)], text.RUNS)
    sinks.write_runs(runs, str(tmp_path / "r"))
    assert text.read_runs(spark, str(tmp_path / "r")).first().trace_path is None
    p = put(tmp_path / "d.bed", "chr9 10 20 x\nchr9\t30\t41\n")
    assert sorted(map(tuple, text.read_domains(spark, p).collect())) == [("chr9", 10, 20), ("chr9", 30, 41)]
    p = put(tmp_path / "e.tsv", "id\tname\n7\tx\n")
    assert text.read_experiments(spark, p, {"id": "int"}).first().id == 7
