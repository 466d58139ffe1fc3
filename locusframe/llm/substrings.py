"""Removal of repeated substrings by hash-compared suffix sorting (operator 5).

A byte is removed if a ``LENGTH``-byte string that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one.

1. Every ``LENGTH``-byte window picks an anchor, its least hashed ``GRAM``-byte gram.  Equal
   windows pick the same anchor, so all repeats show up between occurrences of one gram.
2. Occurrences whose whole surroundings have the same 64-bit hash, beside the same 64-bit hash of the
   gram, form a class (a large group of copies shrinks to one); all but the first are repeats at once, and
   their bytes are not read again: this part is not verified, all others are.
3. Of grams with several classes, the first occurrence of each is cut out with its surroundings.
   What follows the anchor and, reversed, what precedes it are sorted as suffixes: a mergesort
   whose comparisons find the common extension by binary search over prefix polynomial hashes.
   Extensions of sorted neighbours, checked byte by byte, tell for every window which others equal it.
4. A task holds ``MOST`` occurrences of a gram at most.  Larger groups are split by the bytes around
   the gram: windows that hold it near their end share what stands before it, the others what stands
   after it, and so on by halves.  What shares all bytes of a window needs no sorting; equal windows
   meet by their bytes.

Defined cases: a null text counts as empty; documents shorter than ``LENGTH`` lose nothing; rows of
a repeated or null ``doc_id`` are ordered by text and count as documents of their own; of equal strings
only the one that starts first stays; texts of any length are read whole; an empty
table gives an empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_pandas, materialise, read_table, renamed_apart

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM  # most bytes before an anchor within a window
MOST = 20_000

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to exponent ``n``."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))])
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PrefixHashes:
    """Polynomial hash of any substring from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, down = _power_tables(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * down[: len(data)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.up[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.up[:n])


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    have = 1
    while have * 2 <= size:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document: places of anchors, gram hashes, hashes of surroundings, bytes before and after."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    hashes = PrefixHashes(data)
    gram = hashes.grams(GRAM)
    least = _sliding(gram, LEFT + 1, np.minimum)
    edge = np.zeros(LEFT, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), LEFT + 1, np.maximum) == gram)
    left, right = np.minimum(at, LEFT), np.minimum(n - at, LENGTH)
    around = _mixed(hashes.of(at - left, at + right) + (left * 1000 + right).astype(np.uint64))
    return at, gram[at], around, left, right


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document as one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    group = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * wide) - group * wide  # never reaches back over a document's first range
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


_ROWS = "key long, around long, doc long, at int, span int"


def _rows(key, around, doc, at, span) -> pd.DataFrame:
    as_long = lambda x: np.asarray(x).astype(np.uint64, copy=False).view(np.int64)
    return pd.DataFrame({"key": as_long(key), "around": as_long(around), "doc": doc, "at": np.asarray(at, np.int32), "span": np.asarray(span, np.int32)})


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """Anchors, dealt to be by gram; a batch sends one row of each class, and settled ranges with ``at`` below zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found, ids = [], []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                found.append(anchors(np.frombuffer((text or "").encode(), np.uint8)))
                ids.append(np.full(len(found[-1][0]), doc, np.int64))
            if not found:
                continue
            at, key, around, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            doc = np.concatenate(ids)
            order = np.lexsort((at, doc, around, key))
            again = np.concatenate([[False], (key[order][1:] == key[order][:-1]) & (around[order][1:] == around[order][:-1])])[: len(order)]
            one = order[~again]
            yield _rows(key[one], around[one], doc[one], at[one], left[one] << 8 | right[one])
            more = order[again]
            more = more[left[more] + right[more] >= LENGTH]
            d, a, b = _merged(doc[more], at[more] - left[more], at[more] + right[more])
            yield _rows(_mixed(d.astype(np.uint64) + a.astype(np.uint64)), np.zeros(len(d), np.uint64), d, -1 - a, b)

    return map_pandas(docs, run, _ROWS)


def _sift(rows: DataFrame) -> DataFrame:
    """Stream classes in order: ranges of all that are not first of their class, firsts where a gram has several classes.

    Gives ``key`` (null for ranges), ``doc``, ``at`` (start of a range), ``stop``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key = last_around = None  # of the row before
        held = None  # first row of the last class, not known to be one of several
        for pdf in frames:
            settled = (pdf["at"] < 0).to_numpy()
            part = pdf[settled]
            d, a, b = part["doc"].to_numpy(), -1 - part["at"].to_numpy(), part["span"].to_numpy()
            pdf = pdf[~settled]
            key, around, doc, at, span = (pdf[c].to_numpy() for c in ("key", "around", "doc", "at", "span"))
            if len(key):
                same = np.concatenate([[key[0] == last_key and around[0] == last_around], (key[1:] == key[:-1]) & (around[1:] == around[:-1])])
                last_key, last_around = key[-1], around[-1]
                left, right = span >> 8, span & 255
                more = same & (left + right >= LENGTH)
                d, a, b = np.concatenate([d, doc[more]]), np.concatenate([a, at[more] - left[more]]), np.concatenate([b, at[more] + right[more]])
                k, kd, ka = key[~same], doc[~same], at[~same]
                if held is not None:
                    k, kd, ka = (np.concatenate([[x], y]) for x, y in zip(held[:3], (k, kd, ka), strict=True))
                if len(k):
                    twin = k[1:] == k[:-1]
                    several = np.concatenate([twin, [False]]) | np.concatenate([[held is not None and held[3]], twin])
                    held = (k[-1], kd[-1], ka[-1], bool(several[-1]))
                    k, kd, ka = k[:-1][several[:-1]], kd[:-1][several[:-1]], ka[:-1][several[:-1]]
                    yield pd.DataFrame({"key": pd.array(k, "Int64"), "doc": kd, "at": ka.astype(np.int32), "stop": np.int32(0)})
            d, a, b = _merged(d, a, b)
            yield pd.DataFrame({"key": pd.array([None] * len(d), "Int64"), "doc": d, "at": a.astype(np.int32), "stop": b.astype(np.int32)})
        if held is not None and held[3]:
            yield pd.DataFrame({"key": pd.array([held[0]], "Int64"), "doc": [held[1]], "at": [np.int32(held[2])], "stop": [np.int32(0)]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "around", "doc", "at")
    return map_pandas(dealt, run, "key long, doc long, at int, stop int")


class Suffixes:
    """Short suffixes, one in each row of ``symbols``, that groups sort among themselves."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        self.symbols, self.sizes = symbols, sizes
        weights = _power_tables(symbols.shape[1])[0][1 : symbols.shape[1] + 1]
        sums = np.cumsum(_BYTE[symbols] * weights, axis=1, dtype=np.uint64)
        self.hashes = np.concatenate([np.zeros((len(symbols), 1), np.uint64), sums], axis=1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``i`` and ``j``, by binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.sizes[i], self.sizes[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            equal = self.hashes[i, mid] == self.hashes[j, mid]
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix ``i`` sorts before ``j``; equal ones as ``ties`` says."""
        n = self.extension(i, j)
        a, b = n == self.sizes[i], n == self.sizes[j]
        last = self.symbols.shape[1] - 1
        less = self.symbols[i, np.minimum(n, last)] < self.symbols[j, np.minimum(n, last)]
        return np.where(a, np.where(b, ties, True), np.where(b, False, less))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Row numbers with each group (rows of a group stand together) in suffix order: bottom-up mergesort."""
        order = np.arange(len(group))
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(group)))
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(group)) - first
        width = 1
        while len(sizes) and width < sizes.max():
            todo = np.flatnonzero(size > width)
            mine = place[todo] // width % 2  # in the left or the right run of a pair
            pair = place[todo] // (2 * width) * (2 * width)
            at = first[todo] + pair
            mid, end = np.minimum(at + width, first[todo] + size[todo]), np.minimum(at + 2 * width, first[todo] + size[todo])
            low, high = np.where(mine == 0, mid, at), np.where(mine == 0, end, mid)
            other, me = low.copy(), order[todo]
            while (open_ := low < high).any():
                k = np.flatnonzero(open_)
                half = (low[k] + high[k]) // 2
                # A left element counts smaller right ones; a right element counts left ones not above it.
                right = mine[k] == 1
                goes = np.where(right, self.before(order[half], me[k], True), self.before(order[half], me[k], False))
                low[k], high[k] = np.where(goes, half + 1, low[k]), np.where(goes, high[k], half)
            target = at + (todo - np.where(mine == 0, at, mid)) + (low - other)
            merged = order.copy()
            merged[target] = me
            order, width = merged, 2 * width
        return order

    def sorted_groups(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order, and the common prefix of each row with the one before it (0 at a group's first), verified."""
        order = self.sort(group)
        shared = np.zeros(len(order), np.int64)
        if len(order) > 1:
            i, j = order[:-1], order[1:]
            shared[1:] = np.where(group[i] == group[j], self.extension(i, j), 0)
            # Collisions: the bytes must be equal up to there, and differ or end after.
            for a in range(0, len(i), 4096):
                x, y, n = i[a : a + 4096], j[a : a + 4096], shared[1 + a : 1 + a + 4096]
                differ = self.symbols[x] != self.symbols[y]
                true = np.minimum(np.where(differ.any(1), differ.argmax(1), self.symbols.shape[1]), np.minimum(self.sizes[x], self.sizes[y]))
                if (np.where(group[x] == group[y], true, 0) != n).any():
                    return self._plain(group)
        return order, shared

    def _plain(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, should two of them have collided."""
        wide = np.where(np.arange(self.symbols.shape[1]) < self.sizes[:, None], self.symbols + 1, 0)
        order = np.lexsort((*wide.T[::-1], group))
        shared = np.zeros(len(order), np.int64)
        differ = self.symbols[order[1:]] != self.symbols[order[:-1]]
        true = np.minimum(np.where(differ.any(1), differ.argmax(1), self.symbols.shape[1]), np.minimum(self.sizes[order[1:]], self.sizes[order[:-1]]))
        shared[1:] = np.where(group[order[1:]] == group[order[:-1]], true, 0)
        return order, shared


def repeats(group: np.ndarray, after: Suffixes, ahead: Suffixes, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (in order of place) with a window that an earlier row of the group holds too: row, most and least bytes before the anchor.

    Of a row only windows with ``low`` to ``high`` bytes before the anchor are looked at.
    """
    n = len(group)
    most, fewest = np.full(n, -1), np.full(n, LENGTH + 1)
    sorted_after, sorted_ahead = after.sorted_groups(group), ahead.sorted_groups(group)

    def classes(found: tuple[np.ndarray, np.ndarray], least: int) -> np.ndarray:
        order, shared = found
        out = np.empty(n, np.int64)
        new = shared < least
        if n:
            new[1:] |= group[order[1:]] != group[order[:-1]]
            new[0] = True
        out[order] = np.cumsum(new)
        return out

    for back in range(LEFT + 1):
        rows = np.flatnonzero((ahead.sizes >= back) & (after.sizes >= LENGTH - back) & (low <= back) & (back <= high))
        if len(rows) < 2:
            continue
        both = classes(sorted_after, LENGTH - back)[rows] * (n + 1) + classes(sorted_ahead, back)[rows]
        first = np.zeros(len(rows), bool)
        first[np.unique(both, return_index=True)[1]] = True
        later = rows[~first]
        most[later] = np.maximum(most[later], back)
        fewest[later] = np.minimum(fewest[later], back)
    hit = np.flatnonzero(most >= 0)
    return hit, most[hit], fewest[hit]


def _compare_surroundings(cut: DataFrame) -> DataFrame:
    """Ranges ``doc, start, stop`` from rows ``key, doc, at, low, high, left, bytes`` of grams with several classes."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        left, sizes = pdf["left"].to_numpy(), pdf["bytes"].map(len).to_numpy() - pdf["left"].to_numpy()
        after, ahead = np.full((len(pdf), LENGTH), 256, np.int16), np.full((len(pdf), LEFT), 256, np.int16)
        for i, (b, n) in enumerate(zip(pdf["bytes"], left, strict=True)):
            x = np.frombuffer(b, np.uint8)
            after[i, : len(x) - n] = x[n:]
            ahead[i, :n] = x[:n][::-1]
        rows, most, fewest = repeats(pdf["key"].to_numpy(), Suffixes(after, sizes), Suffixes(ahead, left), pdf["low"].to_numpy(), pdf["high"].to_numpy())
        at, doc = pdf["at"].to_numpy()[rows], pdf["doc"].to_numpy()[rows]
        d, a, b = _merged(doc, at - most, at - fewest + LENGTH)
        return pd.DataFrame({"doc": d, "start": a.astype(np.int32), "stop": b.astype(np.int32)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf["key"] == pdf["key"].iloc[-1] if len(pdf) else pd.Series([], dtype=bool)
            whole, held = pdf[~last], pdf[last]  # a gram has at most MOST rows
            if len(whole):
                yield settle(whole)
        if held is not None and len(held):
            yield settle(held)

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_pandas(cut.repartition(parts, "key").sortWithinPartitions("key", "doc", "at"), run, "doc long, start int, stop int")


def numbered(docs: DataFrame) -> DataFrame:
    """``doc, doc_id, text``: numbers in order of ``doc_id``, then text, that differ for every row.

    Where ``doc_id`` is unique and not null it is that number itself.
    """
    source = renamed_apart(docs, "doc_id", "text")
    ids = source.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").limit(1).count() == 0:
        return source.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(source.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"))


def _at_places(docs: DataFrame, places: DataFrame, of: Callable, schema: str) -> DataFrame:
    """``of(doc, bytes, place)`` yields rows of ``schema`` for each of ``places`` (``key, doc, at, low, high``)."""
    by_doc = places.groupBy("doc").agg(F.collect_list(F.struct("key", "at", "low", "high")).alias("places"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc, text, found in zip(pdf["doc"], pdf["text"], pdf["places"], strict=True):
                out += of(doc, (text or "").encode(), found)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return map_pandas(docs.select("doc", "text").join(by_doc, "doc"), run, schema)


def _halves(doc: int, data: bytes, places: list) -> Iterator[tuple]:
    """Each place twice: with fewer and with more bytes before the anchor, keyed by what all those windows share."""
    hashes = PrefixHashes(np.frombuffer(data, np.uint8))
    for place in places:
        at, low, high = place["at"], place["low"], place["high"]
        for a, b in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)):
            if a <= at and at - b + LENGTH <= len(data):
                shared = hashes.of(np.array([at - a]), np.array([at - b + LENGTH])) + np.uint64(a * 1000 + b)
                yield int(_mixed(shared).view(np.int64)[0]), doc, at, a, b


_PLACES = "key long, doc long, at int, low int, high int"


def _gram_halves(docs: DataFrame, places: DataFrame, many: DataFrame) -> DataFrame:
    """``_halves`` of the whole surroundings of ``places``, anchors whose grams are in ``many``.

    Their documents' anchors are found again where the texts are read, so no text is shuffled for a few grams.  Each of
    ``many`` has over ``MOST`` occurrences, so this list is short.
    """
    hot = np.array([r.key for r in many.collect()], np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                data = (text or "").encode()
                at, key, *_ = anchors(np.frombuffer(data, np.uint8))
                at = at[np.isin(key.view(np.int64), hot)]
                if len(at):
                    out += _halves(doc, data, [{"at": a, "low": 0, "high": LEFT} for a in at.tolist()])
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _PLACES.split(", ")])

    return map_pandas(docs.select("doc", "text"), run, _PLACES).join(places.select("doc", "at"), ["doc", "at"], "left_semi").select("key", "doc", "at", "low", "high")


def _equal_windows(windows: DataFrame) -> DataFrame:
    """Ranges ``doc, start, stop`` of all but the first of equal ``bytes`` at ``doc, at``."""
    place = F.struct("doc", "at")
    first = windows.groupBy("bytes").agg(F.min(place).alias("first"))
    later = windows.join(first, "bytes").where(place > F.col("first"))
    return later.select("doc", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("stop"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc, start, stop``: byte ranges to remove; ranges of a document may overlap."""
    sifted = materialise(_sift(_anchor_rows(docs.select("doc", "text"))))
    ranges = sifted.where("key is null").select("doc", F.col("at").alias("start"), "stop")
    rest = sifted.where("key is not null").select("key", "doc", "at", F.lit(0).alias("low"), F.lit(LEFT).alias("high"))
    ready = []
    while True:
        many = materialise(rest.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"))
        if many.isEmpty():
            ready.append(rest)
            break
        ready.append(rest.join(many, "key", "left_anti"))
        hot = rest.join(many, "key", "left_semi")
        halves = materialise(_gram_halves(docs, hot, many) if len(ready) == 1 else _at_places(docs, hot, _halves, _PLACES))
        rest = halves.where("low < high")
        if halves.where("low = high").isEmpty():  # else the texts were shuffled to meet nothing
            continue
        whole = _at_places(docs, halves.where("low = high"), lambda doc, data, places: [(doc, p["at"] - p["low"], data[p["at"] - p["low"] : p["at"] - p["low"] + LENGTH]) for p in places], "doc long, at int, bytes binary")
        ranges = ranges.unionByName(_equal_windows(whole))

    def around(doc: int, data: bytes, places: list) -> Iterator[tuple]:
        for p in places:
            left = min(p["at"], LEFT)
            yield p["key"], doc, p["at"], p["low"], p["high"], left, data[p["at"] - left : p["at"] + LENGTH]

    cut_out = materialise(_at_places(docs, reduce(DataFrame.unionByName, ready), around, "key long, doc long, at int, low int, high int, left int, bytes binary"))
    return ranges.unionByName(_compare_surroundings(cut_out))


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans`` (maximal removed runs) and ``kept`` (bytes), or its ``kept_sha256``."""
    source = numbered(docs)
    found = repeated_ranges(source).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, text, found in zip(pdf["doc_id"], pdf["text"], pdf["found"], strict=True):
                data = (text or "").encode()
                pairs = [(r["start"], r["stop"]) for r in found] if found is not None else []
                a, b = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
                _, a, b = _merged(np.zeros(len(a), np.int64), a, b)
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                spans = [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                out.append((key, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "last"])

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = map_pandas(source.join(found, "doc", "left").select("doc_id", "text", "found"), run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, last {'string' if digest else 'binary'}")
    return rows.withColumnRenamed("last", "kept_sha256" if digest else "kept")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
