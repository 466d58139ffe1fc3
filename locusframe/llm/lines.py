"""Near-duplicate lines by an exact set-similarity join (operator 4), in DataFrame operations only.

A line is the set of its lower-cased words.  Equal lower-cased lines form a class, and only its
first line goes on.  The words of a line stand in one order, long words first and equally long ones
by hash, and its tokens are its words each with the word that follows it there.  A word that is in
one of two sets only costs the other at most one token and its own two, so similar sets share a
token among their first few (prefix filter on pairs of words, which long lists seldom share by
chance); sizes and the place of the shared token rule out some pairs (length and positional filters),
a lossless bitmap of the set nearly all others; the rest is verified on the words themselves.  A line
goes if a line that comes earlier, in a document of smaller ``doc_id`` or before it in its own, is
similar enough; earlier lines count whether they stay or not.

Any order of words that is the same for all lines gives exact results; by length it needs no counts
of words, so a line is split, hashed and ordered in one pass and only its first tokens are stored.

Defined cases: lines without words stay and match nothing; a null text stays null with no lines; an
empty text is one line without words; rows of equal ``doc_id`` are ordered by a hash of their text,
and equal rows keep and lose the same lines; of lines in one place of the order (equal rows) none is
earlier; null ``doc_id`` comes first; an empty table gives an empty table; texts of any length are
read whole, and a very long line is one set; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialise, packed, read_table

PERCENT = 80
BUCKETS = 1 << 15
PASSES = 4
SLICES = 2  # of the lines' digests, grouped one after the other
WHOLE = 32  # members of a list that all meet one another at once
GROUP = 16  # members of a longer list, more or less, that a line meets first
TRIES = 8  # matches of a line that are verified before it meets all members of its lists
PART = 4096  # postings of a token that are expected in one part of its list
WIDE = 24  # words of sets that have the wider bitmap too
_LONGEST = 31  # bytes of a word; longer ones count as equally long
_WORD_BITS = 58  # of a word's hash; the bits above hold what its length lacks of ``_LONGEST``



def _lowered(text: Column) -> Column:
    """Lower-cased, with a blank for every white-space character but the line end."""
    blanks = "\t\x0b\x0c\r"
    found = reduce(Column.__or__, [F.contains(text, F.lit(b)) for b in blanks])
    return F.when(found, F.regexp_replace(F.lower(text), f"[{blanks}]", " ")).otherwise(F.lower(text))


def _words(line: Column) -> Column:
    """The distinct words of a lowered line."""
    return F.array_remove(F.array_distinct(F.split(line, " ")), "")


def _ordered(word: Column) -> Column:
    """A number for the word: the longer it is the smaller, and among equally long ones a hash."""
    short = (F.lit(_LONGEST) - F.least(F.octet_length(word), F.lit(_LONGEST))).cast("long")
    return F.shiftleft(short, _WORD_BITS).bitwiseOR(F.xxhash64(word).bitwiseAND(F.lit((1 << _WORD_BITS) - 1)))


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def list_parts(postings: DataFrame) -> Column:
    """Into how many parts the list of ``token`` is cut: by what its hash bucket holds beyond twice the mean of all.

    What reaches the driver is ``BUCKETS`` numbers, as one string.
    """
    counts = postings.groupBy(_bucket(F.col("token")).alias("b")).agg(F.count("*").alias("n"))
    every = postings.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))
    held = every.agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("held"), F.avg("n").alias("mean"))
    parts = F.transform("held", lambda e: F.greatest(F.ceil((e["n"] - 2 * F.col("mean")) / PART), F.lit(1)).cast("string"))
    listed = held.select(F.array_join(parts, ",")).first()[0]
    return F.get(F.split(F.lit(listed), ",").cast("array<long>"), _bucket(F.col("token")))  # the array is folded to a literal by the optimiser


def _probe_length(n: Column, percent: int) -> Column:
    """So many of a set's first tokens hold one of any similar set's.

    Of ``n`` tokens at most twice the words that only it has and once those that only the other has
    are lost: most where the other is as small as it may be, ``n * percent / 100`` words.
    """
    return F.least(n, F.floor(n * (2 * (100 - percent)) / 100).cast("int") + 1) if percent > 50 else n


def _index_length(n: Column, percent: int) -> Column:
    """So many are enough against sets that are not smaller."""
    return F.least(n, F.floor(n * (3 * (100 - percent)) / (100 + percent)).cast("int") + 1) if percent > 50 else n


_PLACE = ("doc_id", "tid", "no")
_BITS = ("bits", "low", "high")
_OTHER = {"id": "eid", "n": "m", "i": "j", **{x: f"e{x}" for x in _BITS}}  # columns of the other line of a pair


def _hashed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, tid, no, key, h`` of every line with words: ``h`` are the numbers of its distinct words in order."""
    # Beside ``posexplode`` a text would be carried along with each of its lines, and hashed for each.
    split = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.split(_lowered(F.col("text")), "\n").alias("split"))
    lines = split.select("doc_id", "tid", F.posexplode("split").alias("no", "line"))
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), _ordered)), _ordered(F.lit("")))
    # Asked of the line itself: a condition on ``h`` would be pushed below it, which hashes all words twice.
    return lines.where(F.trim("line") != "").select(*_PLACE, F.unhex(F.md5("line")).alias("key"), F.sort_array(hashes).alias("h"))


def _line_table(hashed: DataFrame, percent: int) -> DataFrame:
    """``doc_id, tid, no, key, n, bits, low, high, prefix`` of every line of ``_hashed_lines``.

    ``tid`` tells rows of equal doc_id apart, ``key`` is a digest of the lowered line, ``n`` the
    size of its set, ``prefix`` the words of its first tokens, and ``bits`` has for each place the parity of how
    many words hash to it; so have ``low`` and ``high``, for sets of ``WIDE`` words and more.
    """
    n = F.size("h")
    wide = [F.when(n >= WIDE, _parity(lambda h, k=k: F.when(h.bitwiseAND(F.lit(1 << 12)) == k << 12, _bit(F.shiftright(h, 6))).otherwise(F.lit(0).cast("long")))) for k in range(2)]
    bits = [c.alias(x) for c, x in zip([_parity(_bit), *wide], _BITS, strict=True)]
    return hashed.select(*_PLACE, "key", n.alias("n"), *bits, F.slice("h", F.lit(1), _probe_length(n, percent) + 1).alias("prefix"))


def _tokens(lines: DataFrame, percent: int, *columns: str) -> DataFrame:
    """``columns``, ``i`` and ``token`` for each of a line's first tokens: a word with the next one.

    Where sets of half the words in common are enough it is a word alone.
    """
    words = lines.select(*{*columns, "n"}, "prefix", F.posexplode("prefix").alias("i", "word")).where(F.col("i") < _probe_length(F.col("n"), percent))
    token = F.xxhash64("word", F.get("prefix", F.col("i") + 1)) if percent > 50 else F.xxhash64("word")
    return words.select(*columns, "i", token.alias("token"))


def _bit(h: Column) -> Column:
    """A bit at the place that the last six bits of ``h`` name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _parity(bit: Callable[[Column], Column]) -> Column:
    return F.aggregate("h", F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(bit(h)))


def _may_match(percent: int) -> Column:
    """Length, positional and bitmap filter for sizes ``n, m`` that share the words at ``i`` and ``j``.

    Each word that differs flips one bit of a bitmap, so no similar pair is lost.
    """
    n, m, i, j = (F.col(c) for c in "nmij")
    most = F.least(i, j) + F.least(n - i, m - j)
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (most * (100 + percent) >= (n + m) * percent) & (_differ() * (100 + percent) <= (n + m) * (100 - percent))


def _differ() -> Column:
    """At least so many words are in one of two sets only."""
    flipped = [F.bit_count(F.col(x).bitwiseXOR(F.col(f"e{x}"))) for x in _BITS]
    return F.greatest(flipped[0], F.coalesce(flipped[1] + flipped[2], F.lit(0)))


def _near(firsts: DataFrame, percent: int, part: int, parts: Column) -> DataFrame:
    """Likely matches within the posting lists of one part of the tokens, and the postings of long lists.

    In a list of ``WHOLE`` members or fewer all meet.  Other lists are long, and so are lists that had
    to be cut by hash into parts: their members are dealt to groups of about ``GROUP``, by a hash of
    token and line, so lists of the same lines give different neighbours, and a line meets its group
    and the first member of the list.  A match has ``id, eid, d, whole``, the last true if its list was
    not long; in a posting ``eid`` is NULL and ``doc_id, n, i, token`` and the bitmaps are set.  Matches
    within a document come both ways.
    """
    postings = _tokens(firsts, percent, "id", "doc_id", "n", *_BITS).where(F.pmod("token", F.lit(PASSES)) == part)
    salted = postings.withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")))
    listed = Window.partitionBy("token", "salt")
    # Most tokens are one line's alone: they go before anything else is done with a list.
    salted = salted.withColumn("size", F.count("*").over(listed)).where("size > 1 or parts > 1")
    groups = F.when(F.col("size") > WHOLE, F.ceil(F.col("size") / GROUP)).otherwise(F.lit(1))
    line, long = F.struct("doc_id", "id", "n", "i", *_BITS), (F.col("parts") > 1) | (F.col("size") > WHOLE)
    dealt = salted.select("token", "salt", line.alias("x"), long.alias("long"), F.pmod(F.xxhash64("token", "id"), groups).alias("group"))
    head = F.min(F.when(F.col("long"), F.col("x"))).over(listed)
    drawn = dealt.select("token", "x", "long", head.alias("head"), F.collect_list("x").over(Window.partitionBy("token", "salt", "group")).alias("all"))
    members = F.when(F.col("long"), F.concat(F.array("x", "head"), F.col("all"))).otherwise(F.col("all"))  # of a long list first the line itself, for its posting
    met = drawn.select("x", "token", "long", F.posexplode(members).alias("k", "e"))
    met = met.where(F.when(F.col("long") & (F.col("k") < 2), (F.col("k") == 0) | (F.col("x.id") != F.col("e.id"))).otherwise(F.col("x.id") > F.col("e.id")))
    posting = ("doc_id", "n", "i", *_BITS, "token")
    own = (F.col("long") & (F.col("k") == 0)).alias("posting")
    flat = met.select("token", "long", own, "x.doc_id", *[F.col(f"x.{a}").alias(a) for a in _OTHER], F.col("e.doc_id").alias("edoc"), *[F.col(f"e.{a}").alias(b) for a, b in _OTHER.items()])
    there, back = F.struct("id", "eid"), F.struct(F.col("eid").alias("id"), F.col("id").alias("eid"))
    alone = F.struct("id", F.lit(None).cast("long").alias("eid"))
    one_way = F.when(F.struct("doc_id") > F.struct("edoc"), F.array(there)).otherwise(F.array(back))
    ways = F.when(F.col("posting"), F.array(alone)).when(F.col("doc_id").eqNullSafe(F.col("edoc")), F.array(there, back)).otherwise(one_way)
    d = _differ() / (F.col("n") + F.col("m"))
    found = flat.where(F.col("posting") | _may_match(percent))
    return found.select(F.explode(ways).alias("way"), d.alias("d"), (~F.col("long")).alias("whole"), *[F.when(F.col("posting"), F.col(c)).alias(c) for c in posting]).select("way.*", "d", "whole", *posting)


def _likeliest(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("d", "eid"))), 1, TRIES).alias("best"))
    return best.select("id", F.explode("best").alias("e")).select("id", "e.d", "e.eid")


def _size_class(n: Column, percent: int) -> Column:
    """Four times as wide, on the scale of logarithms, as the sizes of similar sets are apart."""
    return F.floor(F.log(n) / (F.log(F.lit(100.1 / percent)) * 4)).cast("int")


def _classes(n: Column, larger: Column, percent: int) -> Column:
    """The classes of all sizes that sets similar to one of ``n`` words can have, those of larger sets only if ``larger``."""
    least, most = F.ceil(n * percent / 100), F.when(larger, F.floor(n * 100 / percent)).otherwise(n)
    return F.sequence(_size_class(least, percent), _size_class(most, percent))


def _open_pairs(unsettled: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """``id, eid`` that may match: lines of the postings ``unsettled`` with those of ``postings`` that do not come in later documents.

    Sizes are dealt to classes so wide that most lines look for similar sets in one or two.  The smaller
    of two sets need only show the words that it has in front of all sets that are not smaller.  A hot
    list is a skewed partition of the join, which adaptive execution splits.
    """
    def shown(postings: DataFrame) -> DataFrame:
        return postings.withColumn("shown", F.col("i") < _index_length(F.col("n"), percent))

    left = shown(unsettled.select("id", "doc_id", "n", "i", *_BITS, "token")).withColumn("c", F.explode(_classes(F.col("n"), F.col("shown"), percent)))
    right = shown(postings).select(F.col("doc_id").alias("edoc"), *[F.col(a).alias(b) for a, b in _OTHER.items()], "token", F.col("shown").alias("eshown"), _size_class(F.col("n"), percent).alias("c"))
    n, m = F.col("n"), F.col("m")
    reach = ((n >= m) & F.col("eshown")) | ((n <= m) & F.col("shown"))
    order = (F.col("id") != F.col("eid")) & (F.struct("doc_id") >= F.struct("edoc"))
    return left.join(right, ["token", "c"]).where(order & reach & _may_match(percent)).select("id", "eid").distinct()


def similar_lines(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All lines with words (``doc_id, tid, no, key``) and the ``key`` of each class that an earlier line is similar to.

    First each line meets a few members of each of its tokens' lists, and the likeliest of them are
    verified.  Only lines that are not settled so meet the others: all that they have met in short
    lists, and all members of the long ones.  So a group of many similar lines never pairs off
    within itself and no match is missed.
    """
    source = docs.select("doc_id", "text")
    wide = materialise(_line_table(_hashed_lines(source), percent))
    firsts = reduce(DataFrame.unionByName, [_firsts(wide, k) for k in range(SLICES)])
    lines = materialise(wide.select(*_PLACE, "key"))
    discard(wide)
    parts = list_parts(_tokens(firsts, percent))
    near = [materialise(_near(firsts, percent, part, parts)) for part in range(PASSES)]
    pairs = reduce(DataFrame.unionByName, near).where("eid is not null")
    settled = _verified(source, firsts, _likeliest(pairs.select("id", "d", "eid")).select("id", "eid"), percent)
    met = [materialise(pairs.where("whole").select("id", "eid").distinct().join(settled, "id", "left_anti"))]
    for table in near:
        postings = table.where("eid is null")
        met.append(materialise(_open_pairs(postings.join(settled, "id", "left_anti"), postings, percent)))
    discard(*near)
    rest = _verified(source, firsts, reduce(DataFrame.unionByName, met).distinct(), percent)
    discard(*met)
    late = settled.unionByName(rest).distinct()
    return lines, firsts.select("id", *_PLACE, "key").join(late, "id", "left_semi").select("key")


def _firsts(lines: DataFrame, part: int) -> DataFrame:
    """``id`` and the columns of ``lines`` for the first line of each class, in one part of the digests."""
    place = F.min(F.struct(*_PLACE)).alias("place")
    grouped = lines.where(F.pmod(F.xxhash64("key"), F.lit(SLICES)) == part).groupBy("key").agg(place, *[F.first(c).alias(c) for c in ("n", *_BITS, "prefix")])
    number = F.monotonically_increasing_id() * SLICES + part
    return materialise(grouped.select(number.alias("id"), *[F.col(f"place.{c}") for c in _PLACE], "key", "n", *_BITS, "prefix"))


def _verified(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``id`` of the later line of those ``pairs`` (``id, eid``) whose words are similar enough."""
    pairs = materialise(pairs)
    wanted = pairs.select("id").unionByName(pairs.select(F.col("eid").alias("id"))).distinct()
    by_doc = firsts.join(wanted, "id", "left_semi").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("id", "no")).alias("wanted")).toDF("wdoc", "wtid", "wanted").hint("shuffle_hash")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    found = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("wdoc")) & (F.col("tid") == F.col("wtid")))
    # Split before the wanted lines are exploded: beside ``explode`` it would be done for each of them.
    found = found.select("doc_id", "tid", F.split(_lowered(F.col("text")), "\n").alias("lines"), "wanted").select("doc_id", "tid", "lines", F.explode("wanted").alias("w"))
    full = materialise(found.select(F.col("w.id").alias("id"), F.struct("doc_id", "tid", "w.no").alias("place"), _words(F.get("lines", F.col("w.no"))).alias("words")).dropDuplicates(["id"]))
    both = pairs.join(full, "id").join(full.toDF("eid", "eplace", "ewords"), "eid")
    shared = F.size(F.array_intersect("words", "ewords"))
    alike = both.where(shared * 100 >= (F.size("words") + F.size("ewords") - shared) * percent)
    out = materialise(alike.select(F.when(F.col("place") > F.col("eplace"), F.col("id")).otherwise(F.col("eid")).alias("id")).distinct())
    discard(pairs, full)
    return out


def reduced(docs: DataFrame, percent: int = PERCENT, columns: Sequence[str] | None = None) -> DataFrame:
    """``row`` (a struct of ``columns``, all if not named), ``text`` without the later matches, ``n_lines`` and ``n_removed``."""
    lines, late = similar_lines(docs, percent)
    place = F.struct(*_PLACE)
    firsts = lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("members"))
    marked = firsts.join(late.withColumn("late", F.lit(True)), "key", "left").where("late or members > 1")
    gone = lines.join(marked, "key").where(F.coalesce("late", F.lit(False)) | (place > F.col("first")))
    removed = materialise(gone.groupBy("doc_id", "tid").agg(F.collect_set("no").alias("removed"))).toDF("rdoc", "rtid", "removed").hint("shuffle_hash")
    rows = docs.select(packed(docs, columns), F.col("doc_id").alias("doc"), F.col("text").alias("old"), F.xxhash64("text").alias("tid"))
    # A column of its own: within the function below a text would be split once for each line that stays.
    found = rows.join(removed, F.col("doc").eqNullSafe(F.col("rdoc")) & (F.col("tid") == F.col("rtid")), "left").withColumn("split", F.split("old", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("old")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("split", i)), "\n"))
    n_lines = F.when(F.col("old").isNull(), 0).otherwise(F.size("split")).cast("long")
    return found.select("row", text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))


def without_similar_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of every row."""
    found = reduced(docs, percent, ["doc_id"])
    return found.select("row.doc_id", "text", "n_lines", "n_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_similar_lines(read_table(spark, sf_dir, "documents"))
