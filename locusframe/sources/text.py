"""Scans of the text formats of interval, mutation, matrix and run files.

Every scan is a plain Spark text or CSV read with a fixed schema: lazy, split by Spark, nothing inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MUTATIONS = "chrom string, start long, end long, name string, strand string, operation string, sequence string"
TRACE = "chrom string, name string, start long, end long, strand string, operation string, ref_seq string, variant_seq string"
LEVELS = "resol string, chrom string, start long, end long, padding_chr string"
RUNS = "name string, list_resol string, path string, gtype string, genome string, obj_type string, refgenome string, mtype string, trace_path string"


def _table(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, comment="#", enforceSchema=False)


def read_bed(spark: SparkSession, path: str, op: str | None = None, sequence: str = ".") -> DataFrame:
    """``chrom, start, end, name, strand`` of lines with three fields or more; the name defaults to the place, the strand to ``+``.

    With ``op`` they are mutations: each has that ``op`` and ``sequence``, as ``sequence.mutate`` reads them.
    """
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#")).select(fields.alias("f")).where(F.size("f") >= 3)
    at = lambda k: F.get("f", F.lit(k))
    named = F.coalesce(at(3), F.concat_ws("_", at(0), at(1), at(2)))
    mutation = [F.lit(op).alias("op"), F.lit(sequence).alias("sequence")] if op else []
    return rows.select(at(0).alias("chrom"), at(1).cast("long").alias("start"), at(2).cast("long").alias("end"), named.alias("name"), F.coalesce(at(5), F.lit("+")).alias("strand"), *mutation)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return read_bed(spark, path).select("chrom", "start", "end")


def read_mutations(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """The mutation table with places relative to ``offset``."""
    return _table(spark, path, MUTATIONS).withColumns({c: F.col(c) - offset for c in ("start", "end")})


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, TRACE)


def trace_to_insertions(trace: DataFrame, chrom: str | None = None) -> DataFrame:
    """Mutations that insert what a trace says was there before."""
    name = F.lit(chrom) if chrom else F.col("chrom")
    return trace.select(name.alias("chrom"), "start", "end", "name", F.lit("+").alias("strand"), F.lit("insertion").alias("operation"), F.col("ref_seq").alias("sequence"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, size`` from the first two fields of a sizes or index file."""
    fields = F.split("value", r"[\t ]+")
    return spark.read.text(path).select(F.get(fields, F.lit(0)).alias("chrom"), F.get(fields, F.lit(1)).try_cast("long").alias("size")).where("size is not null")


def parse_header(line: Column) -> Column:
    """Map of the ``key=value`` words of a header line; other words have a NULL value."""
    return F.str_to_map(F.regexp_replace(line, r"^#\s*", ""), F.lit(" "), F.lit("="))


def typed_header(meta: Column) -> Column:
    """The words of ``parse_header`` that matrices need, with their types."""
    word = lambda k: F.try_element_at(meta, F.lit(k))
    numbers = [word(k).try_cast("long").alias(k) for k in ("start", "end", "mpos", "wpos", "width", "chromlen")]
    return F.struct(word("resol").alias("resol"), word("chrom").alias("chrom"), *numbers, word("nbins").try_cast("int").alias("nbins"), word("genome").alias("genome"), word("mutation").alias("mutation"))


def read_matrix_meta(spark: SparkSession, path: str) -> DataFrame:
    """``file, meta`` of every matrix file."""
    return spark.read.text(path).where("value like '#%'").select(F.input_file_name().alias("file"), parse_header(F.col("value")).alias("meta"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``file, i, j, value`` of every matrix file; words that are no numbers are NULL.

    A file is one row of text until it is split: a matrix has a few hundred bins a side.
    """
    body = F.array_compact(F.transform(F.split("value", "\r?\n"), lambda x: F.when(~x.startswith("#") & (F.trim(x) != ""), x)))
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(body).alias("i", "line"))
    cells = lines.select("file", "i", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "word"))
    number = F.col("word").try_cast("double")
    return cells.select("file", "i", "j", F.when(~F.isnan(number), number).alias("value"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``folder, resol, i, j, value, expected`` of the files ``pred_predictions_<resol>.txt`` in ``path``.

    Each is paired with ``pred_normmats_<resol>.txt`` beside it; where a matrix has no such file ``expected`` is NULL.
    """
    name = r"^(.*)/pred_(predictions|normmats)_([^/]+)\.txt$"
    part = lambda k: F.regexp_extract("file", name, k)
    cells = read_matrix(spark, path).select(part(1).alias("folder"), part(2).alias("what"), part(3).alias("resol"), "i", "j", "value")
    on = ["folder", "resol", "i", "j"]
    expected = cells.where("what = 'normmats'").select(*on, F.col("value").alias("expected"))
    return cells.where("what = 'predictions'").drop("what").join(expected, on, "left")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """The level table with the ``rank`` of each level, from the narrowest region."""
    levels = _table(spark, path, LEVELS)
    # A handful of levels: one small group.
    return levels.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("end") - F.col("start"), "resol")))


def read_runs(spark: SparkSession, path: str, is_ref: bool = False) -> DataFrame:
    """A run manifest; ``_``, ``None`` and nothing are no trace."""
    trace = F.when(~F.col("trace_path").isin("_", "None", ""), F.col("trace_path"))
    return _table(spark, path, RUNS).withColumns({"trace_path": trace, "is_ref": F.lit(is_ref)})


def read_manifests(spark: SparkSession, ref_path: str, comp_path: str, offset: int = 0) -> DataFrame:
    """Reference and compared runs, one row for each of their resolutions, with the region there and whether they have a trace.

    The first row of the reference file is the reference.  ``list_resol`` names resolutions (``1Mb,2Mb``); regions
    are read from the level table ``pred.log`` in a run's folder and shifted by ``offset``.
    """
    first = Window.partitionBy(F.lit(0)).orderBy("no")  # a manifest has a few rows
    refs = read_runs(spark, ref_path).withColumn("no", F.monotonically_increasing_id())
    refs = refs.withColumn("is_ref", F.row_number().over(first) == 1).drop("no")
    runs = refs.unionByName(read_runs(spark, comp_path)).withColumn("has_trace", F.col("trace_path").isNotNull())
    each = runs.withColumn("resol", F.explode(F.split("list_resol", r"[,\s]+")))
    paths = [f"{r['path'].rstrip('/')}/pred.log" for r in runs.select("path").distinct().collect()]  # one for each run
    schema = "resol string, chrom string, start long, end long, padding_chr string"
    levels = spark.read.csv(paths, schema=schema, sep="\t", comment="#").select(F.regexp_extract(F.input_file_name(), r"^(?:[a-z]+:/*)?(/.*)/pred\.log$", 1).alias("folder"), "resol", "chrom", (F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"))
    folder = F.regexp_extract("path", r"^(?:[a-z]+:/*)?(/.*?)/?$", 1)
    return each.withColumn("folder", folder).join(levels, ["folder", "resol"], "left").drop("folder")


def read_run_traces(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """The mutations of every run with a trace: ``name`` of the run, ``start, end, operation``."""
    paths = [r["trace_path"] for r in runs.select("trace_path").distinct().where("trace_path is not null").collect()]
    if not paths:
        return spark.createDataFrame([], "name string, start long, end long, operation string")
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    rows = _table(spark, paths, TRACE).select(plain(F.input_file_name()).alias("from"), "start", "end", "operation")
    return runs.select("name", plain(F.col("trace_path")).alias("from")).distinct().join(rows, "from").drop("from")


def read_experiments(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """The experiment sheet; columns in ``types`` are cast, the others are strings."""
    sheet = spark.read.csv(path, sep="\t", header=True)
    return sheet.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()})


def pixels_at(pixels: DataFrame, bins: DataFrame, resolution: int, chrom: str, start: int, end: int) -> DataFrame:
    """``i, j, value`` of a region at a resolution, from pixel and bin tables; filters reach both scans."""
    named = chrom if chrom.startswith("chr") else f"chr{chrom}"
    inside = bins.where((F.col("resolution") == resolution) & F.col("chrom").isin(chrom, named) & (F.col("start") >= start) & (F.col("end") <= end))
    at = ((F.col("start") - start) / resolution).cast("int")
    side = lambda k, name: inside.select(F.col("bin_id").alias(f"bin{k}_id"), at.alias(name), F.col("weight").alias(f"w{k}"))
    # Bins are numbered along a chromosome, so the region's numbers bound what is read of the pixels.
    low, high = inside.agg(F.min("bin_id")).scalar(), inside.agg(F.max("bin_id")).scalar()
    near = F.col("bin1_id").between(low, high) & F.col("bin2_id").between(low, high)
    found = pixels.where((F.col("resolution") == resolution) & near).join(side(1, "i"), "bin1_id").join(side(2, "j"), "bin2_id")
    return found.select("i", "j", (F.col("count") * F.col("w1") * F.col("w2")).alias("value"), F.col("count").alias("raw"))


def read_fasta(spark: SparkSession, path: str, chunk: int = 128_000) -> DataFrame:
    """``seq_id, chunk_id, chunk_start, seq`` of FASTA files, in pieces of ``chunk`` letters.

    Lines are placed inside the file blocks that Spark reads, then by totals of the blocks before:
    no task sees more than a block or a chunk, however long a chromosome is.
    """
    line = F.trim(F.col("value"))
    read = spark.read.text(path).select(line.alias("v"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"))
    head = F.col("v").startswith(">")
    lines = read.select("path", "block", "no", "v", head.alias("head"), F.when(head, F.split(F.substring("v", 2, 1 << 20), r"\s+")[0]).alias("name"), F.when(head, 0).otherwise(F.length("v")).cast("long").alias("n"))
    blocks, up_to = Window.partitionBy("path", "block").orderBy("no"), Window.unboundedPreceding
    marked = lines.withColumns({"part": F.count("name").over(blocks), "own": F.last("name", ignorenulls=True).over(blocks)})
    within = marked.withColumn("at", F.sum("n").over(Window.partitionBy("path", "block", "part").orderBy("no").rowsBetween(up_to, 0)) - F.col("n"))

    totals = marked.groupBy("path", "block", "part").agg(F.sum("n").alias("letters"), F.max("own").alias("own"))
    tail = totals.groupBy("path", "block").agg(F.max(F.struct("part", "letters", "own")).alias("t")).select("path", "block", "t.*")
    order = Window.partitionBy("path").orderBy("block")
    grouped = tail.withColumns({"run": F.count("own").over(order), "seen": F.last("own", ignorenulls=True).over(order)})
    summed = grouped.withColumn("sum", F.sum("letters").over(Window.partitionBy("path", "run").orderBy("block")))
    before = summed.select("path", "block", F.lag("seen").over(order).alias("carried"), F.lag("sum").over(order).alias("letters"))

    first = F.col("part") == 0
    start = F.col("at") + F.when(first, F.coalesce("letters", F.lit(0))).otherwise(0)
    placed = within.where("n > 0").join(before, ["path", "block"]).select(F.when(first, F.col("carried")).otherwise(F.col("own")).alias("seq_id"), start.alias("start"), "n", "v")
    cells = placed.where("seq_id is not null").select("*", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.col("n") - 1) / chunk))).alias("chunk_id"))
    low = F.greatest(F.col("chunk_id") * chunk - F.col("start"), F.lit(0))
    high = F.least((F.col("chunk_id") + 1) * chunk - F.col("start"), F.col("n"))
    pieces = cells.select("seq_id", F.col("chunk_id").cast("int").alias("chunk_id"), (F.col("start") + low).alias("a"), F.substr("v", (low + 1).cast("int"), (high - low).cast("int")).alias("s"))
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "s"))), lambda x: x["s"]), "")
    return pieces.groupBy("seq_id", "chunk_id").agg(letters.alias("seq")).select("seq_id", "chunk_id", (F.col("chunk_id") * chunk).alias("chunk_start"), "seq")
