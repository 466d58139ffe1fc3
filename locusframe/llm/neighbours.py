"""Near-duplicate vectors through a refined neighbour graph (operator 1, NN-descent).

The graph starts from random hyperplane tables: vectors with the same sign code meet in blocks of
bounded size, and each keeps its nearest few.  A bucket over that size is split by further bits of
the code, taken about the mean vector.  Rounds of NN-descent then let every node with a new
neighbour compare the neighbours of its neighbours with each other, until few links come.  The
audit compares a bounded sample of vectors with all others by brute force and looks for links
between two components; tables and rounds follow while recall is below the goal in any class of
vectors, and it is an error if it stays there.

Edges at or over the threshold are kept and form components.  A node whose whole list is over the
threshold is saturated: its list is enlarged to its component, block by block, so that links are
counted completely without any list or pair table of that size.

Equal directions form one class with a number of its own, so that a ``vec_id`` may stand for several
vectors.  Vectors of different lengths are compared apart and never link.
Vectors that are null, empty or zero, or that hold null or non-finite components link with nothing.

Defined cases: a row is a vector, so rows of one ``vec_id`` are counted each and a component's id is the
smallest ``vec_id`` of its rows; null ``vec_id`` rows keep null component and link with nothing; pairs at
exactly the threshold link, and of equally near neighbours the larger number comes first in a list, which
changes no link; an empty table gives an empty table; other columns are not looked at, whatever
their names, and a very long text beside a vector is never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_pandas, materialise, read_table, settled
from .components import connected_components

LIST = 8  # length of a neighbour list
BLOCK = 256  # most vectors compared at once
MEET = 4096  # rows of a component that one side of a count holds
SALTS = 16  # ways in which the rows of a component are dealt
AUDIT = 400  # most vectors of the audit
FEW = 0.001  # descent ends when a round brings at most so many new links a node
MORE_BITS = 40  # further bits of a sign code, for buckets that are too large


def _matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), -1)


def unit_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, unit``: packed doubles of length one; null where a vector can't be compared."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for x in pdf["v"]:
                v = np.array([np.nan if c is None else c for c in x], dtype=np.float64) if x is not None and len(x) else np.array([np.nan])
                top = np.abs(v).max()
                if not np.isfinite(v).all() or top == 0:
                    out.append(None)
                    continue
                v = v / top  # squares neither overflow nor vanish
                out.append((v / np.sqrt(v @ v)).tobytes())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "unit": out})

    source = vectors.select("vec_id", vectors[column].cast("array<double>").alias("v"))
    return map_pandas(source, run, f"vec_id {source.schema['vec_id'].dataType.simpleString()}, unit binary")


def _meet(nodes: np.ndarray, units: np.ndarray, bounds: np.ndarray, threshold: float, keep: int) -> pd.DataFrame:
    """The nearest few of each vector in a block, if over its bound, and a spanning forest of the links over ``threshold``."""
    n = len(nodes)
    sims = units @ units.T
    np.fill_diagonal(sims, -2.0)
    k = min(keep, n - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    u, v = np.repeat(np.arange(n), k), near.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    better = sims[u, v] > bounds[u]
    u, v = u[better], v[better]
    linked, open_ = sims >= threshold, np.ones(n, bool)
    tree = []
    for root in np.flatnonzero(linked.any(1)):
        if open_[root]:
            open_[root] = False
            todo = [root]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(linked[at] & open_)
                open_[new] = False
                tree += [(at, x) for x in new]
                todo += new.tolist()
    if tree:
        t = np.array(tree)
        u, v = np.concatenate([u, t[:, 0], t[:, 1]]), np.concatenate([v, t[:, 1], t[:, 0]])
    return pd.DataFrame({"a": nodes[u], "b": nodes[v], "sim": sims[u, v]})


def _top(edges: DataFrame, keep: int) -> DataFrame:
    """Each node's ``keep`` nearest."""
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    lists = best.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False), 1, keep).alias("x"))
    return lists.select("a", F.explode("x").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.sim").alias("sim"))


def _blocks(keyed: DataFrame, salt: int = 0) -> DataFrame:
    """Split the rows of each ``key`` at random into blocks of about ``BLOCK`` rows: ``key, part``."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK)
    return keyed.join(sizes.where("n > 1"), "key").withColumn("part", F.pmod(F.xxhash64("node", "key", F.lit(salt)), parts)).drop("n")


def _compare(blocks: DataFrame, threshold: float) -> DataFrame:
    """Edges of the blocks of ``key, part, node, unit, bound``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"a": [], "b": [], "sim": []}).astype({"a": "int64", "b": "int64"})
        return _meet(pdf["node"].to_numpy(), _matrix(pdf["unit"]), pdf["bound"].to_numpy(), threshold, LIST)

    return blocks.groupBy("key", "part").applyInPandas(run, "a long, b long, sim double")


def table_count(bits: int, threshold: float, least: int, missed: float = 0.01) -> int:
    """Tables for which a pair at the threshold shares a code of ``bits`` bits in none only ``missed`` of the times."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return least if same >= 1 else max(least, int(np.ceil(np.log(missed) / np.log1p(-same))))


def hyperplane_tables(nodes: DataFrame, count: int, tables: int, seed: int, threshold: float, centre: np.ndarray) -> DataFrame:
    """Edges between nodes that share a sign code; codes get longer and tables more with the number of nodes.

    Buckets over ``BLOCK`` rows are split by further bits about ``centre``, twice; only what shares
    those too is split at random, otherwise in each table.
    """
    bits = min(22, max(0, int(np.log2(max(1, count / (BLOCK / 2))))))
    tables = table_count(bits, threshold, tables)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            units = _matrix(pdf["unit"])
            rng = np.random.default_rng(seed)
            for t in range(tables):
                planes = rng.standard_normal((bits + MORE_BITS, units.shape[1]))
                code = (units @ planes[:bits].T > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(units), np.int64)
                more = ((units - centre) @ planes[bits:].T > 0) @ (1 << np.arange(MORE_BITS, dtype=np.int64))
                yield pd.DataFrame({"key": code * tables + t, "more": more, "node": pdf["node"]})

    keyed = materialise(map_pandas(nodes.select("node", "unit"), run, "key long, more long, node long"))
    for _ in range(2):
        sizes = keyed.groupBy("key").agg(F.least(F.greatest(F.ceil(F.log2(F.count("*") / BLOCK)), F.lit(0)), F.lit(MORE_BITS // 2)).cast("int").alias("s"))
        split = F.expr("if(s > 0, xxhash64(key, more & (shiftleft(1L, s) - 1)), key)")
        keyed = keyed.join(sizes, "key").select(split.alias("key"), F.expr("shiftright(more, s)").alias("more"), "node")
    blocks = _blocks(keyed.select("key", "node")).join(nodes.select("node", "unit"), "node")
    return _compare(blocks.withColumn("bound", F.lit(-2.0)), threshold)


def descend(nodes: DataFrame, top: DataFrame, fresh: DataFrame, threshold: float, salt: int) -> DataFrame:
    """One round: at each node with a ``fresh`` edge, its neighbours both ways are compared with each other."""
    lists = top.select(F.col("a").alias("key"), F.col("b").alias("node")).unionByName(top.select(F.col("b").alias("key"), F.col("a").alias("node"))).distinct()
    changed = fresh.select(F.col("a").alias("key")).unionByName(fresh.select(F.col("b").alias("key"))).distinct()
    bounds = top.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= LIST, F.min("sim")).alias("bound"))
    known = nodes.select("node", "unit").join(bounds, "node", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    return _compare(_blocks(lists.join(changed, "key", "left_semi"), salt).join(known, "node"), threshold)


def refine(nodes: DataFrame, edges: DataFrame, count: int, threshold: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Lists and links after rounds of NN-descent, until few new links come.

    New links of a node whose whole list was over the threshold before do not count: it is
    saturated, and its list only moves within its component.
    """
    top = fresh = materialise(_top(edges, LIST))
    links = edges.where(F.col("sim") >= threshold)
    for salt in range(rounds):
        found = materialise(descend(nodes, top, fresh, threshold, salt))
        links = links.unionByName(found.where(F.col("sim") >= threshold))
        better = materialise(_top(top.unionByName(found), LIST))
        fresh = materialise(better.join(top.select("a", "b"), ["a", "b"], "left_anti"))
        full = top.where(F.col("sim") >= threshold).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= LIST)
        gained = fresh.where(F.col("sim") >= threshold).join(full, "a", "left_anti").count()
        top = better
        if gained <= FEW * count:
            break
    return top, materialise(links.groupBy("a", "b").agg(F.max("sim").alias("sim")))


def audit_sample(nodes: DataFrame, count: int) -> pd.DataFrame:
    """At most ``2 * AUDIT`` nodes, spread by hash; for a table of any rows at least one."""
    step = max(1, count // AUDIT)
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).limit(2 * AUDIT).select("node", "unit").toPandas()
    return sample if len(sample) else nodes.limit(1).select("node", "unit").toPandas()


def audit(nodes: DataFrame, reached: DataFrame, sample: pd.DataFrame, threshold: float) -> float:
    """Share of the sample's true links whose two ends are in the same component of ``reached``.

    It is taken apart for vectors of 1 to 3, 4 to 15, 16 to 63 links and so on, and the least
    counts, so that a hot group cannot hide what small ones miss; 1 if the sample has no links.
    """
    spark = nodes.sparkSession
    placed = nodes.select("node", "unit").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = {r["node"]: r["component"] for r in reached.where(F.col("node").isin([int(x) for x in sample["node"]])).collect()}
    own = np.array([of.get(int(x), int(x)) for x in sample["node"]])
    shared = spark.sparkContext.broadcast((sample["node"].to_numpy(), own, _matrix(sample["unit"])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, components, units = shared.value
        for pdf in frames:
            if len(pdf):
                q, r = np.nonzero(units @ _matrix(pdf["unit"]).T >= threshold)
                hit = components[q] == pdf["component"].to_numpy()[r]
                yield pd.DataFrame({"a": ids[q], "n": 1, "hit": hit.astype(np.int64)})[ids[q] != pdf["node"].to_numpy()[r]].groupby("a", as_index=False).sum()

    true = map_pandas(placed.select("node", "unit", "component"), run, "a long, n long, hit long").groupBy("a").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    classes = true.groupBy(F.floor(F.log2("n") / 2).alias("class")).agg((F.sum("hit") / F.sum("n")).alias("share"))
    least = classes.agg(F.min("share")).first()[0]
    return 1.0 if least is None else least


def link_counts(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``node, n``: vectors of other classes linked with a node, all within its component, counted by blocks.

    A component is cut at random into parts of about ``MEET`` rows; a part meets each part of its component
    once, product by product of ``BLOCK`` rows, and only sums leave it.  A row is copied once for
    each part of its component.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    placed = groups.join(sizes, "component").join(nodes, "node").withColumn("parts", F.ceil(F.col("size") / MEET).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Part i meets part j >= i; a row goes to each of its part's meetings.
    i = F.least(F.col("part"), F.col("other"))
    j = F.greatest(F.col("part"), F.col("other"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("component", i.alias("i"), j.alias("j"), "part", "node", "copies", "unit")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, y = pdf[pdf["part"] == i], pdf[pdf["part"] == j]
        held, copies = _matrix(y["unit"]), y["copies"].to_numpy()
        of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for a in range(0, len(x), BLOCK):
            few = x.iloc[a : a + BLOCK]
            linked = _matrix(few["unit"]) @ held.T >= threshold
            if i == j:
                linked[np.arange(len(few)), np.arange(a, a + len(few))] = False
            of_x[a : a + BLOCK] = linked @ copies
            of_y += linked.T @ few["copies"].to_numpy()
        if i == j:
            return pd.DataFrame({"node": x["node"], "n": of_x})
        return pd.DataFrame({"node": np.concatenate([x["node"], y["node"]]), "n": np.concatenate([of_x, of_y])})

    return met.groupBy("component", "i", "j").applyInPandas(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _linked(nodes: DataFrame, count: int, threshold: float, tables: int, rounds: int, recall: float, tries: int) -> DataFrame:
    """``node, component, n`` of those of ``count`` nodes of one length that have links."""
    sample = audit_sample(nodes, count)
    centre, top, links, share = _matrix(sample["unit"]).mean(0), None, None, 0.0
    for attempt in range(tries):
        edges = materialise(hyperplane_tables(nodes, count, tables, 1000 + attempt, threshold, centre))
        edges = edges if links is None else edges.unionByName(top).unionByName(links)
        top, links = refine(nodes, edges, count, threshold, rounds)
        reached = materialise(connected_components(links.where(F.col("a") < F.col("b")).select("a", "b")))
        share = audit(nodes, reached, sample, threshold)
        if share >= recall:
            break
    else:
        raise RuntimeError(f"the audit found {share:.4f} of the links of a class of vectors after {tries} tries; the goal is {recall}")
    return reached.join(link_counts(nodes, reached, threshold), "node", "left")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, column: str = "embedding", tables: int = 16, rounds: int = 12, recall: float = 0.98, tries: int = 8) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    units = materialise(unit_vectors(vectors, column))
    usable = units.where("unit is not null and vec_id is not null")
    # One row for each different direction, numbered as it is written; rows are led back by the direction.
    alike = usable.groupBy("unit").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(alike.withColumn("node", F.monotonically_increasing_id()))
    lengths = {r["w"]: r["n"] for r in nodes.groupBy(F.octet_length("unit").alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect()}
    # Vectors of different lengths can't be compared; those alone in theirs have no links.
    found = [_linked(nodes.where(F.octet_length("unit") == w), n, threshold, tables, rounds, recall, tries) for w, n in lengths.items() if n > 1]
    none = nodes.limit(0).select("node", F.col("node").alias("component"), F.lit(0).cast("long").alias("n"))
    known = reduce(DataFrame.unionByName, found, none)
    groups = nodes.select("node", "least", "copies").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(0)).alias("n"), "least", "copies")
    # A component's smallest vec_id goes back to its nodes by several ways, as one may hold most of them.
    ids = groups.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = groups.withColumn("way", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(ids, ["component", "way"])
    of_unit = nodes.select("node", "unit").join(named.select("node", "n", "copies", "component_id"), "node")
    full = units.join(of_unit, (units["unit"] == of_unit["unit"]) & units["vec_id"].isNotNull(), "left")
    out = full.select("vec_id", F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: near_vectors(read_table(spark, sf_dir, "embeddings")))


#: The same rows in DuckDB by brute force: all pairs of rows and what they reach.
ORACLE_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), usable AS MATERIALIZED (
  SELECT r, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM usable a JOIN usable b ON len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(r, node) AS (
  SELECT r, r FROM v UNION SELECT p.r, l.y FROM reach p JOIN links l ON p.node = l.x
), component AS (
  SELECT p.r, min(o.vec_id) AS component_id FROM reach p JOIN v o ON p.node = o.r GROUP BY p.r
)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = v.r) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM component JOIN v USING (r)
"""
