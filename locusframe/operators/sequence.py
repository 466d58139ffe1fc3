"""Nucleotide strings: transforms of a column, and lookup and splicing over chunk tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import cut
from locusframe.functions.scan import running

LETTERS, PAIRED = "ACGTNacgtn", "TGCANtgcan"  # fixed values: bases and their complements


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, PAIRED))


def mask(seq: Column) -> Column:
    return F.repeat(F.lit("N"), F.length(seq))


def draw(key: Column) -> Column:
    """A number from 0 to 2**32 - 1 drawn by a key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def shuffle_seq(seq: Column, key: Column) -> Column:
    """Letters in an order drawn by the key: the same for every partitioning."""
    at = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)))
    drawn = F.array_sort(F.transform(at, lambda i: F.struct(F.md5(F.concat(key, F.lit(":"), i.cast("string"))).alias("h"), F.substr(seq, i, F.lit(1)).alias("c"))))
    return F.array_join(F.transform(drawn, lambda x: x["c"]), "")


def rep_fill(seq: Column, n: Column) -> Column:
    """``seq`` repeated and cut to ``n`` letters."""
    return F.substr(F.repeat(seq, F.ceil(n / F.length(seq)).cast("int")), F.lit(1), n)


def replace_substring(seq: Column, new: Column, start: Column, end: Column) -> Column:
    """Half-open ``[start, end)`` replaced by ``new``; NULL if out of bounds or of another length."""
    ok = (start >= 0) & (end <= F.length(seq)) & (F.length(new) == end - start)
    return F.when(ok, F.overlay(seq, new, start + 1, end - start))


def drawn_order(pieces: Column, key: Column) -> Column:
    """The numbers from 0 to ``pieces - 1`` in an order drawn by the key."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(pieces - 1, F.lit(0)).cast("int")), lambda b: F.struct(F.md5(F.concat(key, F.lit(":"), b.cast("string"))).alias("h"), b.alias("b")))
    return F.transform(F.array_sort(each), lambda x: x["b"])


def permute_within(seq: Column, binsize: int, key: Column | None = None, order: Column | None = None) -> Column:
    """Pieces of ``binsize`` letters in a drawn or given ``order``; NULL if the length doesn't divide or the order isn't one of the pieces."""
    n = F.length(seq)
    count = F.floor(n / binsize).cast("int")
    placed = drawn_order(count, key) if order is None else order
    ok = (n > 0) & (n % binsize == 0)
    if order is not None:
        ok = ok & (F.array_sort(order) == F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))))
    return F.when(ok, F.array_join(F.transform(placed, lambda b: F.substr(seq, b * binsize + 1, F.lit(binsize))), ""))


def permute_between(df: DataFrame, seed: int, keys=("chrom",)) -> DataFrame:
    """Sequences exchanged within a group by a cyclic shift of a drawn order: none keeps its own if there are two.

    Places in the order are counted by a scan over ids alone; letters join by id afterwards.
    """
    drawn = df.select(*keys, "id", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("drawn"), F.lit(1).cast("long").alias("r"))
    ranked = running(drawn, keys, ["drawn", "id"], r=("sum", "r"))
    sizes = drawn.groupBy(*keys).agg(F.count("*").alias("n"))
    receivers = ranked.join(sizes, list(keys)).select(*keys, "id", ((F.col("r") + F.col("n") - 1) % F.col("n")).alias("r"))
    donors = ranked.withColumnRenamed("id", "donor").join(df.select(*keys, F.col("id").alias("donor"), F.col("seq").alias("new_seq")), [*keys, "donor"])
    return receivers.join(donors, [*keys, "r"]).select(*keys, "id", "donor", "new_seq")


def gc_fraction(seq: Column) -> Column:
    return F.try_divide((F.length(seq) - F.length(F.translate(seq, "GCgc", ""))).cast("double"), F.length(seq))


def random_sequence(length: Column, key: Column, weights=(0.22, 0.28, 0.28, 0.22)) -> Column:
    """Letters A, C, G, T drawn by weight for each place."""
    edges = [sum(weights[: k + 1]) * 4294967296 for k in range(3)]
    letter = lambda u: F.when(u < edges[0], "A").when(u < edges[1], "C").when(u < edges[2], "G").otherwise("T")
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: letter(draw(F.concat(key, F.lit(":"), i.cast("string"))))), "")


def pieces_of(seq: Column, chunk: int) -> Column:
    """``seq`` cut to pieces of ``chunk`` letters, the last one shorter, in one pass: none for no letters."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))


def chunked(seqs: DataFrame, chunk: int) -> DataFrame:
    """``seq_id, chunk_id, chunk_start, seq`` from ``seq_id, seq``."""
    cut_up = seqs.select("seq_id", F.posexplode(pieces_of(F.col("seq"), chunk)).alias("chunk_id", "seq"))
    return cut_up.select("seq_id", "chunk_id", (F.col("chunk_id") * chunk).alias("chunk_start"), "seq")


def gc_track(chunks: DataFrame, binsize: int) -> DataFrame:
    """``seq_id, bin, gc``: share of G and C in each bin, from the chunks that touch it."""
    last = F.col("chunk_start") + F.length("seq") - 1
    touched = chunks.where(F.length("seq") > 0).withColumn("bin", F.explode(F.sequence(F.floor(F.col("chunk_start") / binsize).cast("int"), F.floor(last / binsize).cast("int"))))
    a = F.greatest(F.col("bin") * binsize - F.col("chunk_start"), F.lit(0))
    b = F.least((F.col("bin") + 1) * binsize - F.col("chunk_start"), F.length("seq"))
    parts = touched.select("seq_id", "bin", F.substr("seq", (a + 1).cast("int"), (b - a).cast("int")).alias("p"))
    found = F.length("p") - F.length(F.translate("p", "GCgc", ""))
    return parts.groupBy("seq_id", "bin").agg((F.sum(found).cast("double") / F.sum(F.length("p"))).alias("gc"))


def fetch_sequences(intervals: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """The letters of ``[start, end)`` for intervals ``id, seq_id, start, end``: only the chunks touched meet."""
    touched = intervals.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("start") / chunk).cast("int"), F.floor((F.col("end") - 1) / chunk).cast("int"))))
    found = touched.join(chunks, ["seq_id", "chunk_id"])
    a = F.greatest(F.col("start") - F.col("chunk_start"), F.lit(0))
    b = F.least(F.col("end") - F.col("chunk_start"), F.length("seq"))
    part = F.when(b > a, F.substr("seq", (a + 1).cast("int"), (b - a).cast("int"))).otherwise("")
    return found.groupBy("id", "seq_id", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", part.alias("p")))), lambda x: x["p"]), "").alias("found"))


OPERATIONS = ("mask", "inversion", "shuffle", "insertion", "permutations_inter", "permutations_intra")


def mutate(df: DataFrame, key: Column, binsize: int = 128_000, seed: int = 0, group=("seq_id",)) -> DataFrame:
    """``variant_seq`` of rows ``op, ref_seq, sequence, strand, start``, NULL with a ``reason`` where the mutation is not valid.

    ``bin_order`` records the order of the pieces of ``permutations_inter``.

    ``permutations_inter`` puts the pieces of ``binsize`` letters of an interval in a drawn order;
    ``permutations_intra`` exchanges the intervals of a ``group`` that have this operation.
    """
    given = F.when(F.col("strand") == "-", revcomp(F.col("sequence"))).otherwise(F.col("sequence"))
    valid = given.rlike("^[ACGTNacgtn]+$") & (F.length(given) <= F.length("ref_seq"))
    op = F.col("op")
    moved = op.eqNullSafe("permutations_intra")
    pieces = permute_within(F.col("ref_seq"), binsize, key)
    order = F.when(op.eqNullSafe("permutations_inter") & pieces.isNotNull(), drawn_order(F.floor(F.length("ref_seq") / binsize).cast("int"), key))
    new = F.when(op == "mask", mask(F.col("ref_seq"))).when(op == "inversion", revcomp(F.col("ref_seq"))).when(op == "shuffle", shuffle_seq(F.col("ref_seq"), key)).when((op == "insertion") & valid, rep_fill(given, F.length("ref_seq"))).when(op == "permutations_inter", pieces)
    reason = F.when(~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), "unknown operation").when((op == "insertion") & ~F.coalesce(valid, F.lit(False)), "invalid insertion").when((op == "permutations_inter") & pieces.isNull(), "bin size does not divide the interval")
    alone = df.where(~moved).withColumns({"variant_seq": new, "reason": reason, "bin_order": order})
    # The next interval in a drawn order gives its letters; the first gives them to the last.
    along = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *group, "start")), "start", *[c for c in ("seq_id",) if c in df.columns])
    donor = F.coalesce(F.lead("ref_seq").over(along), F.first("ref_seq").over(along))
    exchanged = df.where(moved).withColumns({"variant_seq": donor, "reason": F.lit(None).cast("string"), "bin_order": F.lit(None).cast("array<int>")})
    return alone.unionByName(exchanged)


def mutation_counts(mutations: DataFrame, keys=("seq_id",)) -> DataFrame:
    """Mutations of each sequence and operation that were applied, and those that were rejected."""
    done = F.col("variant_seq").isNotNull()
    return mutations.groupBy(*keys, "op").agg(F.count_if(done).alias("applied"), F.count_if(~done).alias("rejected"))


BLOCK_CHUNKS, BLOCK_LETTERS = 64, 1 << 20  # at most, of chunks that are handled together


def _block(chunk: int) -> int:
    """Letters of a block, a whole number of chunks."""
    return chunk * max(1, min(BLOCK_CHUNKS, BLOCK_LETTERS // chunk))


def splice_chunks(chunks: DataFrame, mutations: DataFrame, chunk: int) -> DataFrame:
    """Chunks ``seq_id, chunk_id, chunk_start, seq`` with each ``variant_seq`` in place of ``[start, end)``, cut anew to ``chunk`` letters.

    Mutations do not overlap; one whose ``variant_seq`` is NULL keeps the letters.  Of several empty intervals in
    one place ``nth``, if there is such a column, gives the order.  Letters meet in blocks of a few chunks: a
    chunk is cut by the mutations of its block, a block is put together from what its chunks keep and the variants that
    start in it, and only lengths of blocks are summed along a sequence.  Then only the first and last chunk of a block are put
    together from others.
    """
    size = _block(chunk)
    nth = (F.col("nth") if "nth" in mutations.columns else F.lit(0)).cast("long").alias("nth")
    done = cut(mutations.where("variant_seq is not null and seq_id is not null").select("seq_id", F.col("start").cast("long"), F.col("end").cast("long"), nth, "variant_seq"))
    block = lambda place: F.floor(place / size).cast("int")
    touched = done.select("seq_id", "start", "end", F.explode(F.sequence(block(F.col("start")), block(F.greatest(F.col("end") - 1, F.col("start"))))).alias("block"))
    cuts = touched.groupBy("seq_id", "block").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    whole = chunks.where("seq_id is not null").select("seq_id", block(F.col("chunk_start")).alias("block"), F.col("chunk_start").cast("long").alias("chunk_start"), (F.col("chunk_start") + F.length("seq")).cast("long").alias("stop"), "seq").join(cuts, ["seq_id", "block"], "left")
    own = F.filter(F.coalesce("cuts", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda c: (c["start"] < F.col("stop")) & (F.greatest(c["end"], c["start"] + 1) > F.col("chunk_start")))
    whole = whole.withColumn("own", own)
    lows = F.concat(F.array("chunk_start"), F.transform("own", lambda c: c["end"]))
    highs = F.concat(F.transform("own", lambda c: c["start"]), F.array("stop"))
    kept = whole.select("seq_id", "block", "chunk_start", "stop", "seq", F.explode(F.arrays_zip(lows.alias("a"), highs.alias("b"))).alias("k"))
    a, b = F.greatest("k.a", "chunk_start"), F.least("k.b", "stop")
    piece = lambda at, kind, n, p: F.struct(at.alias("at"), F.lit(kind).alias("kind"), n.alias("nth"), p.alias("p"))
    stays = kept.where(b > a).select("seq_id", "block", piece(a, 1, F.lit(0).cast("long"), F.substr("seq", (a - F.col("chunk_start") + 1).cast("int"), (b - a).cast("int"))).alias("x"))
    comes = done.where("variant_seq <> ''").select("seq_id", block(F.col("start")).alias("block"), piece(F.col("start"), 0, F.col("nth"), F.col("variant_seq")).alias("x"))
    lists = [t.groupBy("seq_id", "block").agg(F.collect_list("x").alias(n)) for t, n in ((stays, "xs"), (comes, "ys"))]
    none = F.array().cast("array<struct<at:bigint,kind:int,nth:bigint,p:string>>")
    pieces = F.sort_array(F.concat(F.coalesce("xs", none), F.coalesce("ys", none)))
    blocks = cut(lists[0].join(lists[1], ["seq_id", "block"], "full").select("seq_id", "block", F.array_join(F.transform(pieces, lambda x: x["p"]), "").alias("text")))
    places = running(blocks.select("seq_id", "block", F.length("text").cast("long").alias("to")), ["seq_id"], ["block"], to=("sum", "to"))
    head = F.pmod(-F.col("to"), F.lit(chunk)).cast("int")  # letters up to the next chunk
    moved = blocks.join(places, ["seq_id", "block"]).withColumn("head", head)
    first = F.when(F.col("head") > 0, F.array(F.substr("text", F.lit(1), F.col("head")))).otherwise(F.array().cast("array<string>"))
    cells = moved.select("seq_id", "to", F.posexplode(F.concat(first, pieces_of(F.substr("text", F.col("head") + 1), chunk))).alias("pos", "seq"))
    cells = cells.select("seq_id", (F.floor(F.col("to") / chunk) + F.col("pos")).cast("int").alias("chunk_id"), "to", "seq")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("to", "seq"))), lambda x: x["seq"]), "")
    parts = cells.where(F.length("seq") < chunk).groupBy("seq_id", "chunk_id").agg(joined.alias("seq"))
    found = cells.where(F.length("seq") == chunk).select("seq_id", "chunk_id", "seq").unionByName(parts)
    return found.select("seq_id", "chunk_id", (F.col("chunk_id") * chunk).alias("chunk_start"), "seq")


def splice(seqs: DataFrame, mutations: DataFrame) -> DataFrame:
    """Sequences with each mutation's ``variant_seq`` in place of ``[start, end)``; mutations of a sequence don't overlap.

    A mutation that was rejected (``variant_seq`` NULL) keeps the letters that are there.
    """
    by = Window.partitionBy("seq_id").orderBy("start")
    kept = F.coalesce(F.lag("end").over(by), F.lit(0))
    new = F.coalesce("variant_seq", F.substr("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    pieces = mutations.join(seqs, "seq_id").select("seq_id", "start", F.concat(F.substr("seq", (kept + 1).cast("int"), (F.col("start") - kept).cast("int")), new).alias("p"), "end")
    head = pieces.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "p"))), lambda x: x["p"]), "").alias("head"), F.max("end").alias("reach"))
    rest = seqs.join(head, "seq_id", "left")
    return rest.select("seq_id", F.when(F.col("head").isNull(), F.col("seq")).otherwise(F.concat("head", F.substr("seq", (F.col("reach") + 1).cast("int"), F.length("seq")))).alias("seq"))


def validate_mutations(df: DataFrame) -> DataFrame:
    """Rows ``op, sequence, start, end`` with the ``reason`` for which one is rejected, else NULL."""
    text = F.coalesce("sequence", F.lit(""))
    unknown = ~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))
    inserted = F.col("op") == "insertion"
    reason = F.when(unknown, "unknown operation").when(inserted & ~text.rlike("^[ACGTNacgtn]+$"), "not a sequence").when(inserted & (F.length(text) > F.col("end") - F.col("start")), "longer than its interval")
    return df.withColumn("reason", reason)


def shifted(mutations: DataFrame) -> DataFrame:
    """Mutations with ``shift``, by how much those before have moved them, and ``reach``, where the last one before ends."""
    return running(mutations.withColumns({"shift": grown(), "reach": F.col("end").cast("long")}), ["seq_id"], ["start", "end"], shift=("sum", "shift"), reach=("max", "reach"))


def grown() -> Column:
    """Letters that a mutation adds; a rejected one adds none."""
    return F.coalesce(F.length("variant_seq").cast("long") - (F.col("end") - F.col("start")), F.lit(0))


#: Fixed values of the fingerprint of a stretch: two moduli with a base for each.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)


def part_printer(most: int = 1 << 20):
    """A function of texts and their places in a stretch to fingerprints; about ``most`` letters are held as numbers at once."""
    moduli, bases = MODULI, BASES

    def some(parts: pd.Series, sizes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        stops = np.cumsum(sizes)
        starts = stops - sizes
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        within = np.arange(len(codes)) - np.repeat(starts, sizes)
        out = []
        for modulus, base in zip(moduli, bases, strict=True):
            p, powers, known = np.uint64(modulus), np.ones(max(int(sizes.max()), 1), np.uint64), 1
            while known < len(powers):  # each step doubles those that are known
                powers[known : 2 * known] = powers[: len(powers) - known][:known] * np.uint64(pow(base, known, modulus)) % p
                known *= 2
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[within] % p)])
            found, left, square = (sums[stops] - sums[starts]) % p, offsets, base
            while left.any():
                found = np.where(left & 1, found * np.uint64(square) % p, found)
                left, square = left >> 1, square * square % modulus
            out.append(found.astype(np.int64))
        return out

    def printed(parts: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        sizes = parts.str.len().to_numpy(np.int64) if len(parts) else np.zeros(0, np.int64)
        marks = (np.cumsum(sizes) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(parts)] if len(parts) else [0]
        found = [some(parts[a:b], sizes[a:b], offsets.to_numpy(np.int64)[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k, c in enumerate("xy")})

    return printed


def stretch_prints(stretches: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """``id, n, x, y``: letters and fingerprint of stretches ``id, seq_id, a, b``, added up from the chunks that they touch.

    A fingerprint is a polynomial in the letters modulo a prime, so the parts of a stretch are computed where
    their chunk lies, each raised by its place in the stretch, and only numbers are summed.  Stretches meet
    chunks in blocks of a few chunks.
    """
    size = _block(chunk)
    blocks = F.sequence(F.floor(F.col("a") / size).cast("int"), F.floor((F.col("b") - 1) / size).cast("int"))
    touched = stretches.where("b > a").select("id", "seq_id", "a", "b", F.explode(blocks).alias("block"))
    placed = chunks.select("seq_id", F.floor(F.col("chunk_start") / size).cast("int").alias("block"), "chunk_start", (F.col("chunk_start") + F.length("seq")).alias("stop"), "seq")
    met = touched.join(placed, ["seq_id", "block"]).where("a < stop and chunk_start < b")
    low = F.greatest(F.col("a"), F.col("chunk_start"))
    parts = met.withColumns({"low": low, "n": F.least(F.col("b"), F.col("stop")) - low}).select("id", (F.col("low") - F.col("a")).alias("offset"), "n", F.substr("seq", (F.col("low") - F.col("chunk_start") + 1).cast("int"), F.col("n").cast("int")).alias("p"))
    printed = F.pandas_udf(part_printer(), "struct<x: long, y: long>")
    found = parts.select("id", "n", printed("p", "offset").alias("f"))
    return found.groupBy("id").agg(F.sum("n").alias("n"), (F.sum("f.x") % MODULI[0]).alias("x"), (F.sum("f.y") % MODULI[1]).alias("y"))


def verify_chunks(before: DataFrame, after: DataFrame, mutations: DataFrame, chunk: int) -> DataFrame:
    """Stretches between mutations, ``seq_id, start, end``, that have other letters after a splice than before.

    Stretches are compared by length and fingerprint at their places before and after, so no two
    sequences meet; a change goes unseen about once in 10^18.  Both tables have chunks of ``chunk`` letters.
    """
    edits = cut(mutations.select("seq_id", "start", F.col("end").cast("long").alias("end"), grown().alias("shift")))
    moved = running(edits.withColumn("reach", F.col("end")), ["seq_id"], ["start", "end"], shift=("sum", "shift"), reach=("max", "reach"))
    first = moved.select("seq_id", F.coalesce("reach", F.lit(0)).alias("a"), F.col("start").cast("long").alias("b"), "shift")
    sizes = [t.groupBy("seq_id").agg(F.max(F.col("chunk_start") + F.length("seq")).cast("long").alias(n)) for t, n in ((before, "old"), (after, "new"))]
    tails = edits.groupBy("seq_id").agg(F.max("end").alias("a"), F.sum("shift").alias("shift")).join(sizes[0], "seq_id", "left").join(sizes[1], "seq_id", "left")
    last = tails.select("seq_id", "a", F.greatest(F.coalesce("old", F.lit(0)), F.coalesce("new", F.lit(0)) - F.col("shift")).alias("b"), "shift")
    stretches = cut(first.unionByName(last).where("b > a").withColumn("id", F.struct("seq_id", "a", "b")))
    old = stretch_prints(stretches.select("id", "seq_id", "a", "b"), before, chunk)
    new = stretch_prints(stretches.select("id", "seq_id", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")), after, chunk)
    both = stretches.select("id").join(old, "id", "left").join(new.toDF("id", "m", "u", "v"), "id", "left")
    same = F.col("n").eqNullSafe(F.col("m")) & F.col("x").eqNullSafe(F.col("u")) & F.col("y").eqNullSafe(F.col("v"))
    return both.where(~same).select("id.seq_id", F.col("id.a").alias("start"), F.col("id.b").alias("end"))


def verify_splice(before: DataFrame, after: DataFrame, mutations: DataFrame, chunk: int = 4096) -> DataFrame:
    """``verify_chunks`` on whole strings."""
    return verify_chunks(chunked(before, chunk), chunked(after, chunk), mutations, chunk)


def revert_chunks(mutated: DataFrame, trace: DataFrame, chunk: int) -> DataFrame:
    """Chunks with each ``ref_seq`` of the trace back where its variant now is, whatever the lengths of those before."""
    back = shifted(trace).where("variant_seq is not null").select(
        "seq_id", (F.col("start") + F.col("shift")).alias("start"), (F.col("start") + F.col("shift") + F.length("variant_seq")).alias("end"), F.col("start").alias("nth"), F.col("ref_seq").alias("variant_seq")
    )
    return splice_chunks(mutated, back, chunk)


def revert(mutated: DataFrame, trace: DataFrame, chunk: int = 4096) -> DataFrame:
    """``revert_chunks`` on whole strings."""
    parts = revert_chunks(chunked(mutated, chunk), trace, chunk).groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return mutated.select("seq_id").join(parts, "seq_id", "left").select("seq_id", F.coalesce("seq", F.lit("")).alias("seq"))


def extract_region(chunks: DataFrame, seq_id, start: int, end: int) -> DataFrame:
    """The chunks of ``[start, end)`` of one sequence, cut at its ends, in upper case, with starts relative to it."""
    stop = F.col("chunk_start") + F.length("seq")
    touched = chunks.where((F.col("seq_id") == seq_id) & (F.col("chunk_start") < end) & (stop > start))
    a = F.greatest(F.lit(start) - F.col("chunk_start"), F.lit(0))
    b = F.least(F.lit(end) - F.col("chunk_start"), F.length("seq"))
    return touched.select("seq_id", (F.col("chunk_start") + a - start).alias("chunk_start"), F.upper(F.substr("seq", (a + 1).cast("int"), (b - a).cast("int"))).alias("seq"))
