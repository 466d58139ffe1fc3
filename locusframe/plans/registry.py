"""All queries on the driver tables, by name, each with its DuckDB text where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.lineage import cut
from locusframe.operators import compare, contacts, intervals, nullmodel, scores, sequence

from . import views as V

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

C, B, W = V.contacts_sql(), V.BINS, 5
NB = V.MUT_BINS


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        _queries[name] = run
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Statements shared by several texts.
SPINE = f"sp AS (SELECT run, bin::INT AS bin FROM (SELECT DISTINCT run FROM c), range({B}) r(bin))"
INS = f"""{C}, {SPINE}, raw AS (SELECT run, i AS bin, avg(value) * {2 * W + 1} AS raw FROM c WHERE abs(i - j) <= {W} GROUP BY ALL),
inn AS (SELECT sp.run, sp.bin, CASE WHEN sp.bin BETWEEN {W} AND {B - W - 1} THEN raw END AS x FROM sp LEFT JOIN raw USING (run, bin)),
ins AS (SELECT run, bin, coalesce(x, avg(x) OVER (PARTITION BY run)) AS value FROM inn)"""
EXPECT = f"{C}, e AS (SELECT run, distance, CASE WHEN distance = 0 THEN 1.0 ELSE x END AS expected FROM (SELECT run, abs(i - j) AS distance, avg(value) AS x FROM c GROUP BY ALL))"
OE = f"{EXPECT}, oe AS (SELECT c.run, i, j, CASE WHEN expected <> 0 THEN value / expected END AS value FROM c JOIN e ON c.run = e.run AND e.distance = abs(i - j))"
SIGNED = f"{INS}, sg AS (SELECT run, bin, round(value - avg(value) OVER (PARTITION BY run), 9) AS value FROM ins), s3 AS (SELECT *, CASE WHEN value > 0 THEN 1 ELSE -1 END AS s FROM sg)"
LABELS = f"""{SIGNED}, isl AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY bin) - row_number() OVER (PARTITION BY run, s ORDER BY bin) AS g FROM s3),
lab AS (SELECT run, bin, CASE WHEN count(*) OVER (PARTITION BY run, s, g) < 3 THEN 'U' WHEN s > 0 THEN 'A' ELSE 'B' END AS label FROM isl)"""
DEV = f"{INS}, dev AS (SELECT x.run, x.bin, x.value, y.value AS reference, x.value - y.value AS deviation FROM ins x JOIN ins y USING (bin) WHERE x.run <> 'N' AND y.run = 'N')"


def _insulation(s, d):
    return scores.insulation(V.contacts(s, d), B, W)


def _centred(s, d):
    from pyspark.sql import Window

    return _insulation(s, d).withColumn("value", F.round(F.col("value") - F.avg("value").over(Window.partitionBy("run")), 9))


def _deviation(s, d):
    return compare.score_deviation(_insulation(s, d), "N")


# Contact maps.
query("mat01_spine", f"WITH {C}, {SPINE} SELECT run, bin FROM sp")(lambda s, d: scores.spine(V.contacts(s, d), B))
query("mat01_symmetrise", f"WITH {C} SELECT run, i, j, round(value, 6) AS value FROM c WHERE i <= j UNION ALL SELECT run, j, i, value FROM c WHERE i < j")(lambda s, d: contacts.symmetrise(V.contacts(s, d)))
query("mat03_expected", f"WITH {EXPECT} SELECT run, distance, round(expected, 6) AS expected FROM e")(lambda s, d: contacts.expected_by_distance(V.contacts(s, d)))
query("mat04_obs_over_exp", f"WITH {OE} SELECT run, i, j, round(value, 6) AS value FROM oe")(lambda s, d: contacts.obs_over_exp(V.contacts(s, d)))
query("mat05_geometric", f"""WITH {C}, p AS (SELECT *, CASE WHEN i = j THEN -1 ELSE floor(ln(abs(i - j)::DOUBLE) / ln(1.03::DOUBLE) + 1e-9)::INT END AS level FROM c WHERE i % 9 <> 4 AND j % 9 <> 4 AND i IN (SELECT x.i FROM c x WHERE x.run = c.run AND x.j % 9 <> 4) AND j IN (SELECT x.i FROM c x WHERE x.run = c.run AND x.j % 9 <> 4))
SELECT run, i, j, round(value / (sum(value) OVER w / count(value) OVER w), 6) AS value FROM p WINDOW w AS (PARTITION BY run, level)""")(
    lambda s, d: contacts.obs_over_exp_geometric(V.contacts(s, d).withColumn("value", F.when((F.col("i") % 9 != 4) & (F.col("j") % 9 != 4), F.col("value")).otherwise(0.0)))  # every ninth row is empty
)
query("prj20_log_obs", f"WITH {C} SELECT run, i, j, round(CASE WHEN value > 0 THEN ln(value) ELSE 0 END, 6) AS value FROM c")(lambda s, d: contacts.log_obs(V.contacts(s, d)))
query("mat06_reconstruct", f"""WITH {OE}, z AS (SELECT run, distance, CASE WHEN distance % 5 = 3 THEN 0 ELSE expected END AS expected FROM e), f AS (SELECT run, distance, CASE WHEN expected > 0 THEN expected ELSE 0.01::DOUBLE * avg(expected) OVER (PARTITION BY run) END AS expected FROM z)
SELECT run, i, j, round(value * expected, 6) AS value FROM oe JOIN f USING (run) WHERE distance = abs(i - j)""")(
    lambda s, d: contacts.reconstruct_obs(
        contacts.obs_over_exp(V.contacts(s, d)).withColumn("value", F.log("value")),
        contacts.expected_by_distance(V.contacts(s, d)).withColumn("expected", F.when(F.col("distance") % 5 == 3, 0.0).otherwise(F.col("expected"))),
    )
)
query("prj20_log_oe", f"WITH {OE} SELECT run, i, j, round(CASE WHEN value > 0 THEN ln(value) ELSE 0 END, 6) AS value FROM oe")(lambda s, d: contacts.log_oe(V.contacts(s, d)))
query("mat07_balance", f"WITH {C}, {V.TRACK} SELECT run, i, j, round(value * x.track * y.track, 6) AS value FROM c JOIN t x ON x.bin = i JOIN t y ON y.bin = j")(lambda s, d: contacts.balance(V.contacts(s, d), V.track(s, d)).select("run", "i", "j", "value"))
_H = f"least(4, h.i, h.j, {B - 1} - h.i, {B - 1} - h.j)"
query("mat09_fill_cells", f"""WITH {C}, h AS (SELECT run, i, j, CASE WHEN (i * 3 + j) % 7 = 0 THEN NULL ELSE value END AS value FROM c), st AS (SELECT a::INT AS a, b::INT AS b FROM range(-4, 4) x(a), range(-4, 4) y(b)),
o AS (SELECT h.run, h.i, h.j, h.i + a AS ni, h.j + b AS nj FROM h, st WHERE h.value IS NULL AND CASE WHEN {_H} = 0 THEN abs(a) + abs(b) = 1 ELSE a BETWEEN -{_H} AND {_H} - 1 AND b BETWEEN -{_H} AND {_H} - 1 END),
f AS (SELECT o.run, o.i, o.j, avg(n.value) AS mean FROM o JOIN h n ON n.run = o.run AND n.i = ni AND n.j = nj GROUP BY ALL)
SELECT h.run, h.i, h.j, round(coalesce(value, mean), 6) AS value FROM h LEFT JOIN f USING (run, i, j)""")(
    lambda s, d: contacts.fill_cells(V.contacts(s, d).withColumn("value", F.when((F.col("i") * 3 + F.col("j")) % 7 != 0, F.col("value"))), B)
)
query("mat10_fill_bins", f"""WITH {INS}, h AS (SELECT run, bin, CASE WHEN bin % 6 NOT IN (0, 2) THEN value END AS value FROM ins), k AS (SELECT *, least(bin, {B - 1} - bin) AS inner_ FROM h)
SELECT run, bin, round(coalesce(value, CASE WHEN inner_ >= 3 THEN avg(value) OVER (o ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) WHEN inner_ = 2 THEN avg(value) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) WHEN inner_ = 1 THEN lag(value) OVER o WHEN bin = 0 THEN lead(value) OVER o ELSE lag(value) OVER o END), 6) AS value FROM k WINDOW o AS (PARTITION BY run ORDER BY bin)""")(
    lambda s, d: contacts.fill_neighbours(_insulation(s, d).withColumn("value", F.when(~(F.col("bin") % 6).isin(0, 2), F.col("value"))), B)
)
query("mat02_expand_expected", f"WITH {EXPECT} SELECT e.run, x.i::INT AS i, y.j::INT AS j, round(expected, 6) AS value FROM e, range({B}) x(i), range({B}) y(j) WHERE distance = abs(x.i - y.j)")(lambda s, d: contacts.expand_expected(contacts.expected_by_distance(V.contacts(s, d)), B))
query("mat12_row_correlation", f"""WITH {C}, w AS (SELECT run, i, j, value, sum(value) OVER (PARTITION BY run, i) / {B} AS m, sum(value * value) OVER (PARTITION BY run, i) AS ss FROM c)
SELECT run, i, j, round((xy - mx * my * {B}) / (sqrt(sx - mx * mx * {B}) * sqrt(sy - my * my * {B})), 6) AS value FROM (
SELECT x.run, x.i, y.i AS j, sum(x.value * y.value) AS xy, any_value(x.m) AS mx, any_value(y.m) AS my, any_value(x.ss) AS sx, any_value(y.ss) AS sy FROM w x JOIN w y ON x.run = y.run AND x.j = y.j WHERE abs(x.i - y.i) <= 5 GROUP BY x.run, x.i, y.i)""")(
    lambda s, d: contacts.row_correlation(V.contacts(s, d), B, 5)
)
_TRI = f"{C}, a AS (SELECT * FROM c WHERE run = 'A'), r AS (SELECT * FROM c WHERE run = 'R')"


def _two(s, d):
    c = V.contacts(s, d)
    return c.where("run = 'A'"), c.where("run = 'R'")


query("mat13_join_triangles", f"WITH {_TRI}, z AS (SELECT i, j, CASE WHEN i <= j THEN a.value ELSE r.value END AS value FROM a JOIN r USING (i, j)) SELECT i, j, round(CASE WHEN i = j THEN (SELECT avg(value) FROM z) ELSE value END, 6) AS value FROM z")(lambda s, d: contacts.join_triangles(*_two(s, d)))
query("mat14_subtract", f"WITH {_TRI} SELECT i, j, round(r.value - a.value, 6) AS value FROM a JOIN r USING (i, j)")(lambda s, d: contacts.subtract(*_two(s, d)))
query("mat15_check_square", f"WITH {C} SELECT run, max(i) AS max_i, max(j) AS max_j, count(*) AS cells, max(i) = max(j) AND count(*) = (max(i) + 1) * (max(j) + 1) AS square FROM c GROUP BY run")(lambda s, d: contacts.check_square(V.contacts(s, d)))
MINMAX = f"{C}, mm AS (SELECT run, i, j, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS value FROM c WINDOW w AS (PARTITION BY run))"
query("prj19_minmax", f"WITH {MINMAX} SELECT run, i, j, round(value, 6) AS value FROM mm")(lambda s, d: contacts.minmax(V.contacts(s, d)))
_FOLD = lambda c: f"CASE WHEN ({c} + k + {2 * B}) % {2 * B} >= {B} THEN {2 * B - 1} - ({c} + k + {2 * B}) % {2 * B} ELSE ({c} + k + {2 * B}) % {2 * B} END"
query("mat11_gaussian", f"""WITH {C}, g AS (SELECT k::INT AS k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) t(k)),
gi AS (SELECT run, {_FOLD("i")} AS i, j, sum(value * w) AS value FROM c, g GROUP BY ALL), gj AS (SELECT run, i, {_FOLD("j")} AS j, sum(value * w) AS value FROM gi, g GROUP BY ALL) SELECT run, i::INT AS i, j::INT AS j, round(value, 6) AS value FROM gj""")(lambda s, d: contacts.gaussian_smooth(V.contacts(s, d), B, 1.0))

# Scores.
query("scr01_insulation", f"WITH {INS} SELECT run, bin, round(value, 6) AS value FROM ins")(_insulation)
CORREL = f"""{MINMAX}, wm AS (SELECT run, i, j, value, sum(value) OVER r / {B} AS m, sum(value * value) OVER r AS ss FROM mm WINDOW r AS (PARTITION BY run, i)),
rc AS (SELECT run, i, j, (xy - mx * my * {B}) / (sqrt(sx - mx * mx * {B}) * sqrt(sy - my * my * {B})) AS value FROM (
SELECT x.run, x.i, y.i AS j, sum(x.value * y.value) AS xy, any_value(x.m) AS mx, any_value(y.m) AS my, any_value(x.ss) AS sx, any_value(y.ss) AS sy FROM wm x JOIN wm y ON x.run = y.run AND x.j = y.j WHERE abs(x.i - y.i) <= {W} GROUP BY x.run, x.i, y.i))"""
query("scr02_insulation_correl", "WITH " + INS.replace(C, CORREL).replace("FROM c WHERE abs", "FROM rc WHERE abs") + " SELECT run, bin, round(value, 6) AS value FROM ins")(lambda s, d: scores.insulation_correl(V.contacts(s, d), B, W))
query("scr03_insulation_exp", "WITH " + INS.replace(C, f"{MINMAX}, k AS (SELECT run, i, j, exp(value) AS value FROM mm)").replace("FROM c WHERE abs", "FROM k WHERE abs") + " SELECT run, bin, round(value, 6) AS value FROM ins")(lambda s, d: scores.insulation_exp(V.contacts(s, d), B, W))


def _powers_sql(oe: str, name: str, tag: str = "", keys: tuple[str, ...] = ("run",), squarings: int = 16) -> str:
    """``name``: the leading eigenvector of the table ``oe`` less one, from the matrix squared so often that nothing else is left."""
    k, p, q = ", ".join(keys), f"p{tag}_" if tag else "p", f"q{tag}_" if tag else "q"
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys)
    of = lambda x: ", ".join(f"{x}.{c}" for c in keys)
    steps = [f"{p}0 AS MATERIALIZED (SELECT {k}, i, j, value - 1 AS x FROM {oe})"]
    for n in range(squarings):
        steps.append(f"{q}{n} AS MATERIALIZED (SELECT {of('a')}, a.i, b.j, sum(a.x * b.x) AS x FROM {p}{n} a JOIN {p}{n} b ON {on('a', 'b')} AND a.j = b.i GROUP BY ALL)")
        steps.append(f"{p}{n + 1} AS MATERIALIZED (SELECT {k}, i, j, x / max(abs(x)) OVER (PARTITION BY {k}) AS x FROM {q}{n})")
    best = f"cx{tag} AS (SELECT {k}, arg_max(j, x) AS j FROM {p}{squarings} WHERE i = j GROUP BY {k}), cv{tag} AS (SELECT {of('p')}, p.i AS bin, p.x FROM {p}{squarings} p JOIN {f'cx{tag} cx' if tag else 'cx'} ON {on('p', 'cx')} AND p.j = cx.j)"
    return f"{', '.join(steps)}, {best}, {name} AS (SELECT {k}, bin, x * sign(arg_max(x, abs(x)) OVER w) / sqrt(sum(x * x) OVER w) AS value FROM cv{tag} WINDOW w AS (PARTITION BY {k}))"


def _eigen_sql() -> str:
    """``pc``: the leading eigenvector of O/E less one."""
    return f"{OE}, {_powers_sql('oe', 'pc')}"


PC = _eigen_sql()


def _pc1(s, d):
    return scores.pc1(contacts.obs_over_exp(V.contacts(s, d)), B)


query("scr04_pc1", f"WITH {PC} SELECT run, bin, round(value, 6) AS value FROM pc")(_pc1)
query("scr04_pc1_cells", f"WITH {PC} SELECT run, bin, round(value, 6) AS value FROM pc")(lambda s, d: scores.pc1_cells(contacts.obs_over_exp(V.contacts(s, d)), B))
query("scr05_phase", f"""WITH {INS}, {V.TRACK}, k AS (SELECT run, rank() OVER (PARTITION BY run ORDER BY value) + (count(*) OVER (PARTITION BY run, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY run ORDER BY track) + (count(*) OVER (PARTITION BY run, track) - 1) / 2.0 AS rt FROM (SELECT run, bin, round(value, 9) AS value, track FROM ins JOIN t USING (bin))),
g AS (SELECT run, sign(corr(rv, rt)) AS sg FROM k GROUP BY run) SELECT run, bin, round(round(value, 9) * sg, 6) AS value FROM ins JOIN g USING (run)""")(lambda s, d: scores.phase(_insulation(s, d).withColumn("value", F.round("value", 9)), V.track(s, d)))
query("scr06_compartments", f"WITH {LABELS} SELECT run, bin, label FROM lab")(lambda s, d: scores.compartments(_centred(s, d)))
query("scr07_compartments_window", f"""WITH {SIGNED}, z AS (SELECT run, bin, CASE WHEN bin = 0 THEN sum(s) OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) WHEN bin = {B - 1} THEN sum(s) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE sum(s) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS n FROM s3 WINDOW o AS (PARTITION BY run ORDER BY bin))
SELECT run, bin, CASE n WHEN 3 THEN 'A' WHEN -3 THEN 'B' ELSE 'U' END AS label FROM z""")(lambda s, d: scores.compartments_window(_centred(s, d)))
query("scr08_saddle", f"""WITH {PC}, cu AS (SELECT run, quantile_cont(round(value, 9), [k / 48.0 for k in range(1, 48)]) AS e FROM pc GROUP BY run), g AS (SELECT run, bin, len(list_filter(e, lambda x: x < round(value, 9))) AS g FROM pc JOIN cu USING (run))
SELECT oe.run, r.g AS rq, k.g AS cq, round(ln(avg(value)), 6) AS value FROM oe JOIN g r ON oe.run = r.run AND oe.i = r.bin JOIN g k ON oe.run = k.run AND oe.j = k.bin GROUP BY ALL""")(
    lambda s, d: scores.saddle(contacts.obs_over_exp(V.contacts(s, d)), _pc1(s, d).withColumn("value", F.round("value", 9))).withColumns({"rq": F.col("rq").cast("long"), "cq": F.col("cq").cast("long")})
)
_GROUPS = f"{PC}, rp AS (SELECT run, bin, round(value, 9) AS value FROM pc), cu AS (SELECT run, quantile_cont(value, [k / 48.0 for k in range(1, 48)]) AS e FROM rp GROUP BY run), g AS (SELECT run, bin, len(list_filter(e, lambda x: x < value)) AS g, row_number() OVER (PARTITION BY run ORDER BY value DESC, bin) - 1 AS place FROM rp JOIN cu USING (run))"
query("scr08_saddle_cells", f"WITH {_GROUPS} SELECT oe.run, r.place::INT AS i, k.place::INT AS j, round(ln(avg(value) OVER (PARTITION BY oe.run, r.g, k.g)), 6) AS value FROM oe JOIN g r ON oe.run = r.run AND oe.i = r.bin JOIN g k ON oe.run = k.run AND oe.j = k.bin")(
    lambda s, d: scores.saddle_cells(contacts.obs_over_exp(V.contacts(s, d)), _pc1(s, d).withColumn("value", F.round("value", 9)))
)
query("scr09_saddle_order", f"WITH {INS} SELECT run, bin, row_number() OVER (PARTITION BY run ORDER BY round(value, 9) DESC, bin) AS place FROM ins")(lambda s, d: scores.saddle_order(_insulation(s, d).withColumn("value", F.round("value", 9))))
query("scr10_borders", f"WITH {LABELS}, p AS (SELECT *, lag(label) OVER (PARTITION BY run ORDER BY bin) AS before FROM lab) SELECT run, bin, before, label FROM p WHERE before <> label AND before <> 'U' AND label <> 'U'")(lambda s, d: scores.borders(scores.compartments(_centred(s, d))))
query("scr11_restore", f"WITH {INS} SELECT run, {B - 1} - bin AS bin, round(value, 6) AS value FROM ins")(
    lambda s, d: scores.restore_positions(_insulation(s, d), _insulation(s, d).select("run").distinct().withColumn("bin_order", F.sequence(F.lit(B - 1), F.lit(0), F.lit(-1))))
)
ALL_SCORES = f"{PC}, {INS.removeprefix(C + ', ')}, al AS (SELECT run, bin, value, 'insulation' AS score_type FROM ins UNION ALL SELECT run, bin, value, 'PC1' FROM pc)"


def _all_scores(s, d):
    return scores.all_scores({"insulation": _insulation(s, d), "PC1": _pc1(s, d)})


query("scr12_all_scores", f"WITH {ALL_SCORES} SELECT run, bin, round(value, 6) AS value, score_type FROM al")(_all_scores)

# Comparison.
query("cmp01_score_deviation", f"WITH {DEV} SELECT run, bin, round(value, 6) AS value, round(reference, 6) AS reference, round(deviation, 6) AS deviation FROM dev")(_deviation)
query("cmp02_matrix_deviation", f"WITH {C} SELECT x.run, i, j, round(x.value, 6) AS value, round(y.value, 6) AS reference, round(x.value - y.value, 6) AS deviation FROM c x JOIN c y USING (i, j) WHERE x.run <> 'N' AND y.run = 'N'")(lambda s, d: compare.score_deviation(V.contacts(s, d), "N", ("i", "j")))
FIT = "regr_slope(value, reference) AS slope, regr_intercept(value, reference) AS intercept"
query("cmp04_regress", f"WITH {DEV} SELECT run, round(regr_slope(value, reference), 6) AS slope, round(regr_intercept(value, reference), 6) AS intercept, round(corr(value, reference), 6) AS r, round(regr_syy(value, reference) - regr_sxy(value, reference) ^ 2 / regr_sxx(value, reference), 6) AS ssd FROM dev GROUP BY run")(lambda s, d: compare.regress(_insulation(s, d), "N"))
query("cmp05_regress_wanted", f"WITH {DEV}, f AS (SELECT {FIT} FROM dev WHERE run = 'A') SELECT run, bin, round(reference, 6) AS x, round(value, 6) AS value, round(slope * reference + intercept, 6) AS predicted, round(value - slope * reference - intercept, 6) AS residual FROM dev, f")(lambda s, d: compare.regress_wanted(_insulation(s, d), "N", "A"))
query("cmp10_dispersion", f"""WITH {DEV} SELECT run, {', '.join(f'round(quantile_cont(deviation, {p}), 6) AS p{round(p * 1000):03d}' for p in (.125, .25, .5, .75, .875))},
round(min(deviation), 6) AS low, round(max(deviation), 6) AS high, round(avg(deviation), 6) AS mean, round(stddev_samp(deviation), 6) AS sd, count(deviation) AS n FROM dev GROUP BY run""")(lambda s, d: compare.dispersion(_deviation(s, d), "deviation", ["run"]))
query("cmp14_pair_scores", f"WITH {INS} SELECT bin, round(x.value, 6) AS first, round(y.value, 6) AS second FROM ins x JOIN ins y USING (bin) WHERE x.run = 'N' AND y.run = 'A'")(lambda s, d: compare.pair_scores(_insulation(s, d), "N", "A"))
query("cmp17_value_range", f"WITH {DEV} SELECT run, round(min(deviation) * CASE WHEN min(deviation) < 0 THEN 1.1 ELSE 0.9 END, 6) AS low, round(max(deviation) * CASE WHEN max(deviation) > 0 THEN 1.1 ELSE 0.9 END, 6) AS high FROM dev GROUP BY run")(lambda s, d: compare.value_range(_deviation(s, d).select("run", F.col("deviation").alias("value")), ["run"]))
query("cmp18_union_runs", f"WITH {INS} SELECT run, bin, round(value, 6) AS value, run = 'N' AS is_ref FROM ins")(lambda s, d: (lambda x: compare.union_runs(x.where("run = 'N'"), x.where("run <> 'N'")))(_insulation(s, d)))
query("cmp08_mutation_lists", f"WITH {V.MUTATIONS}, l AS (SELECT run, l.r AS resolution, start, \"end\" FROM m, (VALUES (1), (2), (4)) l(r) WHERE l.r < 4 OR run NOT LIKE '%2' OR start % 3 <> 0), h AS (SELECT run, resolution, count(*) AS n, list(start || ':' || \"end\" ORDER BY start, \"end\") AS x FROM l GROUP BY ALL) SELECT run, count(*) AS levels, count(DISTINCT x) AS lists FROM h GROUP BY run HAVING count(DISTINCT x) > 1")(
    lambda s, d: compare.check_mutation_lists(V.mutations(s, d).withColumn("resolution", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where("resolution < 4 or run not like '%2' or start % 3 <> 0"))
)
query("cmp13_pair_order", f"WITH {V.MUTATIONS}, n AS (SELECT DISTINCT 'exp' || start % 12 || CASE WHEN run = 'Wtd_mut' THEN '' ELSE '_rdm' END AS hue_name FROM m) SELECT hue_name, row_number() OVER (ORDER BY regexp_extract(hue_name, '[0-9]+')::INT, hue_name)::INT AS place FROM n")(
    lambda s, d: compare.pair_order(compare.relabel_experiments(V.mutations(s, d).withColumn("experiment", F.concat(F.lit("exp"), F.col("start") % 12))))
)
query("cmp08_consistency", "SELECT o_orderpriority AS chrom, count(DISTINCT o_orderstatus) AS n_o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")(lambda s, d: compare.check_consistency(V.table(s, d, "orders").withColumnRenamed("o_orderpriority", "chrom"), ["chrom"], ["o_orderstatus"]))
#: Maps of a sweep: their experiments, and the bins a side at each resolution.
EXPERIMENTS, SIDES = 2, {"2Mb": 100, "4Mb": 50, "8Mb": 25}


def _sweep_sql() -> str:
    """``sw``: insulation of every experiment, resolution and run, and its square as a second score."""
    steps = []
    for r, b in SIDES.items():
        steps.append(f"""b{r} AS (SELECT l_orderkey AS o, l_returnflag AS run, CAST(floor(l_partkey * {b} / (SELECT count(*) FROM part)) AS INT) AS bin FROM lineitem),
c{r} AS (SELECT 'exp' || (x.o % {EXPERIMENTS}) AS experiment, x.run, x.bin AS i, y.bin AS j, count(*)::DOUBLE AS value FROM b{r} x JOIN b{r} y ON x.o = y.o AND x.run = y.run GROUP BY ALL),
w{r} AS (SELECT experiment, run, i AS bin, avg(value) * {2 * W + 1} AS raw FROM c{r} WHERE abs(i - j) <= {W} GROUP BY ALL),
n{r} AS (SELECT k.experiment, k.run, r.bin::INT AS bin, CASE WHEN r.bin BETWEEN {W} AND {b - W - 1} THEN raw END AS x FROM (SELECT DISTINCT experiment, run FROM c{r}) k, range({b}) r(bin) LEFT JOIN w{r} w ON w.experiment = k.experiment AND w.run = k.run AND w.bin = r.bin),
s{r} AS (SELECT experiment, '{r}' AS resolution, run, bin, coalesce(x, avg(x) OVER (PARTITION BY experiment, run)) AS value FROM n{r})""")
    both = " UNION ALL ".join(f"SELECT * FROM s{r}" for r in SIDES)
    return ", ".join(steps) + f", un AS MATERIALIZED ({both}), sw AS (SELECT *, 'insulation' AS score_type FROM un UNION ALL SELECT experiment, resolution, run, bin, value * value, 'PC1' FROM un)"


SWEEP = _sweep_sql()


def _sweep_scores_sql() -> str:
    """``SWEEP`` with the leading eigenvector of every map's O/E less one as second score of ``sw``, as ``_eigen_sql`` has it."""
    maps, _ = SWEEP.rsplit(", sw AS ", 1)
    found = []
    for r in SIDES:
        oe = f"""e{r} AS (SELECT experiment, run, distance, CASE WHEN distance = 0 THEN 1.0 ELSE x END AS expected FROM (SELECT experiment, run, abs(i - j) AS distance, avg(value) AS x FROM c{r} GROUP BY ALL)),
oe{r} AS (SELECT c.experiment, c.run, i, j, CASE WHEN expected <> 0 THEN value / expected END AS value FROM c{r} c JOIN e{r} e ON c.experiment = e.experiment AND c.run = e.run AND e.distance = abs(i - j))"""
        found.append(f"{oe}, {_powers_sql(f'oe{r}', f'pc{r}', r, ('experiment', 'run'))}")
    both = " UNION ALL ".join(f"SELECT experiment, '{r}' AS resolution, run, bin, value, 'PC1' AS score_type FROM pc{r}" for r in SIDES)
    return ", ".join([maps, *found, f"sw AS (SELECT *, 'insulation' AS score_type FROM un UNION ALL {both})"])


SWEEP_SCORES = _sweep_scores_sql()
_MAP = ["experiment", "run"]


def _sweep_maps(s, d):
    return {r: (V.contacts(s, d, b, EXPERIMENTS), b) for r, b in SIDES.items()}


def _map_scores(c, b):
    return scores.all_scores({"insulation": scores.insulation(c, b, W, _MAP), "PC1": scores.pc1(contacts.obs_over_exp(c, _MAP), b, _MAP)}, _MAP)


def _sweep(s, d):
    parts = [_map_scores(c, b).select("experiment", F.lit(r).alias("resolution"), "run", "bin", "value", "score_type") for r, (c, b) in _sweep_maps(s, d).items()]
    return reduce(DataFrame.unionByName, parts)


_LEVEL = ["experiment", "resolution"]
LEVELS = f"{SWEEP}, lv AS (SELECT x.experiment, x.resolution, x.run, x.bin, x.value, y.value AS reference FROM un x JOIN un y USING (experiment, resolution, bin) WHERE x.run <> 'N' AND y.run = 'N')"
query("prj09_select_runs", f"WITH {SWEEP_SCORES} SELECT experiment, resolution, run, bin, round(value, 6) AS value, score_type FROM sw WHERE run IN ('A', 'N') AND (score_type = 'PC1') = (resolution = '8Mb')")(lambda s, d: compare.select_runs(_sweep(s, d), ["A", "N"]))
query("cmp04_regress_levels", f"WITH {LEVELS} SELECT experiment, resolution, run, round(regr_slope(value, reference), 6) AS slope, round(regr_intercept(value, reference), 6) AS intercept, round(corr(value, reference), 6) AS r, round(regr_syy(value, reference) - regr_sxy(value, reference) ^ 2 / regr_sxx(value, reference), 6) AS ssd FROM lv GROUP BY ALL")(
    lambda s, d: compare.regress(_sweep(s, d).where("score_type = 'insulation'"), "N", keys=_LEVEL)
)
query("cmp05_regress_wanted_levels", f"WITH {LEVELS}, f AS (SELECT experiment, resolution, {FIT} FROM lv WHERE run = 'A' GROUP BY ALL) SELECT experiment, resolution, run, bin, round(reference, 6) AS x, round(value, 6) AS value, round(slope * reference + intercept, 6) AS predicted, round(value - slope * reference - intercept, 6) AS residual FROM lv JOIN f USING (experiment, resolution)")(
    lambda s, d: compare.regress_wanted(_sweep(s, d).where("score_type = 'insulation'"), "N", "A", keys=_LEVEL)
)
query("cmp14_pair_levels", f"WITH {SWEEP} SELECT experiment, resolution, bin, round(x.value, 6) AS first, round(y.value, 6) AS second FROM un x JOIN un y USING (experiment, resolution, bin) WHERE x.run = 'N' AND y.run = 'A'")(
    lambda s, d: compare.pair_scores(_sweep(s, d).where("score_type = 'insulation'"), "N", "A", keys=_LEVEL)
)
query("cmp12_pool_experiments", f"WITH {SWEEP_SCORES} SELECT x.experiment, CASE x.experiment WHEN 'exp1' THEN 'odd' ELSE x.experiment END AS hue_name, x.score_type, x.run, x.bin, round(x.value - y.value, 6) AS value FROM sw x JOIN sw y USING (experiment, resolution, score_type, bin) WHERE resolution = '4Mb' AND x.run <> 'N' AND y.run = 'N'")(
    lambda s, d: compare.pool_maps(_sweep_maps(s, d), "4Mb", _map_scores, "N", "exp1:odd")
)
query("cmp08_headers", """WITH l AS (SELECT l_orderkey, min(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, o_orderstatus IS DISTINCT FROM status AS a, (o_custkey % 7) IS DISTINCT FROM n AS b FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey AS path, array_to_string([CASE WHEN a THEN 'status' END, CASE WHEN b THEN 'n' END], ',') AS differ FROM x WHERE a OR b""")(
    lambda s, d: compare.check_headers(
        V.table(s, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("n")), V.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_linestatus").alias("status"), F.count("*").alias("n")), "path", ["status", "n"]
    ).withColumn("differ", F.array_join("differ", ","))
)

# Intervals.
IV = f"{V.INTERVALS}"
_cols = ["chrom", "start", "end", "name"]
query("prj01_rebase", f"WITH {IV} SELECT 'fake_' || chrom AS chrom, start - 5000 AS start, \"end\" - 5000 AS \"end\", name, strand FROM v WHERE chrom = '2-HIGH' AND start >= 5000 AND \"end\" <= 900000")(lambda s, d: intervals.rebase(V.intervals(s, d), "2-HIGH", 5000, 900000))
query("prj02_rebase_table", f"WITH {IV} SELECT 'fake_chr(' || chrom || ')' AS chrom, start - 5000 AS start, \"end\" - 5000 AS \"end\", name, strand FROM v WHERE chrom = '2-HIGH' AND start >= 5000 AND \"end\" <= 900000")(lambda s, d: intervals.rebase(V.intervals(s, d), "2-HIGH", 5000, 900000, rename="fake_chr({})"))
query("prj05_binsize", f"WITH {V.DOMAINS} SELECT chrom, min(start) AS start, max(\"end\") AS \"end\", (max(\"end\") - min(start)) // 250 AS binsize FROM d GROUP BY chrom")(lambda s, d: compare.with_binsize(V.domains(s, d).groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))))
query("prj21_parse_order", f"WITH {IV} SELECT name, [start, \"end\" % 100, 7]::INT[]::VARCHAR AS parsed FROM v")(lambda s, d: V.intervals(s, d).select("name", intervals.parse_order(F.concat(F.lit("["), "start", F.lit(","), F.col("end") % 100, F.lit(", 7]"))).cast("string").alias("parsed")))
query("prj03_pos_to_bin", f"WITH {IV} SELECT name, floor((start - 12345) / 1000)::BIGINT AS bin, floor((start - 12345) / 1000)::BIGINT * 1000 + 12345 AS low, (floor((start - 12345) / 1000)::BIGINT + 1) * 1000 + 12344 AS high FROM v")(
    lambda s, d: V.intervals(s, d).select("name", intervals.pos_to_bin(F.col("start"), 12345, 1000).alias("bin")).select("name", "bin", *[c.alias(n) for n, c in zip(("low", "high"), intervals.bin_to_span(F.col("bin"), 12345, 1000), strict=True)])
)
query("prj11_parse_region", f"WITH {IV} SELECT name, chrom, start, \"end\" FROM v")(lambda s, d: V.intervals(s, d).select("name", intervals.parse_region(F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end")).alias("r")).select("name", "r.chrom", "r.start", "r.end"))
query("prj12_humanise", f"WITH {IV} SELECT name, CASE WHEN start > 1e6 THEN printf('%.1f', start / 1e6) || 'Mb' WHEN start > 1e3 THEN printf('%.1f', start / 1e3) || 'kb' ELSE start || 'pb' END AS bp FROM v")(lambda s, d: V.intervals(s, d).select("name", compare.humanise_bp(F.col("start")).alias("bp")))
query("prj13_natural_key", r"SELECT p_brand, p_partkey, 'brand#' || lpad(regexp_extract(p_brand, '(\d+)$', 1), 12, '0') AS key FROM part")(lambda s, d: V.table(s, d, "part").select("p_brand", "p_partkey", compare.natural_key(F.col("p_brand")).alias("key")))
query("prj14_windows", f"WITH {IV}, {V.SIZES}, w AS (SELECT chrom, start AS pos, greatest(0, least(floor((start - 16000) / 1000)::BIGINT * 1000, floor((size - 32000) / 1000)::BIGINT * 1000)) AS wstart FROM v JOIN s USING (chrom)) SELECT chrom, pos, wstart, wstart + 32000 AS wend, pos - wstart AS wpos FROM w")(
    lambda s, d: intervals.place_windows(V.intervals(s, d).select("chrom", F.col("start").alias("pos")), V.sizes(s, d), 32000, 1000)
)
REACH = f"{IV}, x AS (SELECT *, max(\"end\") OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)"
query("int01_complement", f"WITH {REACH}, {V.SIZES} SELECT chrom, coalesce(reach, 0) AS start, start AS \"end\" FROM x WHERE start > coalesce(reach, 0) UNION ALL SELECT chrom, max(\"end\"), any_value(size) FROM v JOIN s USING (chrom) GROUP BY chrom HAVING max(\"end\") < any_value(size)")(lambda s, d: intervals.complement(V.intervals(s, d), V.sizes(s, d)))
query("int02_overlaps", f"WITH {REACH} SELECT chrom, start, \"end\", name, reach FROM x WHERE start < reach")(lambda s, d: intervals.find_overlaps(V.intervals(s, d).select(*_cols)))
ON = "v.chrom = d.chrom AND v.start < d.\"end\" AND d.start < v.\"end\""
query("int03_exclude", f"WITH {IV}, {V.DOMAINS} SELECT chrom, start, \"end\", name FROM v WHERE NOT EXISTS (SELECT 1 FROM d WHERE {ON})")(lambda s, d: intervals.exclude(V.intervals(s, d).select(*_cols), V.domains(s, d)))
query("int04_include", f"WITH {IV}, {V.DOMAINS} SELECT chrom, start, \"end\", name FROM v WHERE EXISTS (SELECT 1 FROM d WHERE v.chrom = d.chrom AND d.start <= v.start AND v.\"end\" <= d.\"end\")")(lambda s, d: intervals.include(V.intervals(s, d).select(*_cols), V.domains(s, d)))
query("int05_overlap_join", f"WITH {IV}, {V.DOMAINS} SELECT v.chrom, v.start, v.\"end\", name, d.start AS ostart, d.\"end\" AS oend FROM v JOIN d ON {ON}")(lambda s, d: intervals.overlap_join(V.intervals(s, d).select(*_cols), V.domains(s, d)).select(*_cols, "ostart", "oend"))
MB = f"{V.MUTATIONS}, zz AS (SELECT {V.mutation_binsize_sql()} AS z), k AS (SELECT m.*, z, unnest(range(floor(start / z)::BIGINT, floor((\"end\" - 1) / z)::BIGINT + 1)) AS bin FROM m, zz), kk AS (SELECT * FROM k WHERE bin BETWEEN 0 AND {NB - 1}), msp AS (SELECT run, bin::BIGINT AS bin FROM (SELECT DISTINCT run FROM m), range({NB}) r(bin))"


def _mut(s, d):
    return 0, V.mutation_binsize(s, d), NB


FRACTION = f"{MB}, fr AS (SELECT msp.run, msp.bin, coalesce(sum(least(\"end\", (kk.bin + 1) * z) - greatest(start, kk.bin * z)), 0) / (SELECT z FROM zz)::DOUBLE AS value FROM msp LEFT JOIN kk USING (run, bin) GROUP BY ALL)"
query("int06_fraction", f"WITH {FRACTION} SELECT run, bin, round(value, 6)::DOUBLE AS value FROM fr")(lambda s, d: intervals.mutated_fraction(V.mutations(s, d), *_mut(s, d)))
query("int07_counts", f"WITH {MB} SELECT run, bin, count(*) AS n FROM kk GROUP BY ALL")(lambda s, d: intervals.mutation_counts(V.mutations(s, d), *_mut(s, d)))
query("int08_nearest", f"""WITH {MB}, ed AS (SELECT run, floor(start / z)::BIGINT AS e FROM m, zz UNION SELECT run, floor("end" / z)::BIGINT FROM m, zz) SELECT run, bin, min(abs(bin - e)) AS distance FROM msp JOIN ed USING (run) GROUP BY ALL""")(lambda s, d: intervals.nearest_distance(V.mutations(s, d), *_mut(s, d)))
query("int09_mutated_bp", f"WITH {V.MUTATIONS} SELECT run, sum(\"end\" - start + 1)::BIGINT AS bp FROM m WHERE start >= 1000 AND \"end\" <= 100000 GROUP BY run")(lambda s, d: intervals.mutated_bp(V.mutations(s, d), 1000, 100000, closed=True))
query("int10_assign_bins", f"""WITH {IV}, a AS (SELECT name, start, "end", CASE WHEN floor(start / 250) = floor(("end" - 1) / 250) OR ((floor(start / 250) + 1) * 250 - start) * 2 >= "end" - start THEN floor(start / 250)::BIGINT ELSE floor(("end" - 1) / 250)::BIGINT END AS bin FROM v)
SELECT name, start, "end", bin, greatest(0, bin * 250 - start) AS spill_left, greatest(0, "end" - (bin + 1) * 250) AS spill_right FROM a""")(lambda s, d: intervals.assign_bins(V.intervals(s, d).select("name", "start", "end"), 250))
query("int11_valid_experiments", "SELECT n_name AS experiment, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")(lambda s, d: intervals.valid_experiments(V.table(s, d, "nation").select(F.col("n_nationkey").alias("experiment"), "n_name", "n_regionkey"), V.table(s, d, "customer").select(F.col("c_nationkey").alias("experiment"))).select(F.col("n_name").alias("experiment"), "n_regionkey"))
query("int11_in_region", f"WITH {V.DOMAINS}, e AS (SELECT n_nationkey AS experiment, n_name, ({V.CHROMS})[n_nationkey % 5 + 1] AS chrom FROM nation) SELECT n_name AS experiment FROM e WHERE EXISTS (SELECT 1 FROM d WHERE d.chrom = e.chrom AND d.chrom = '2-HIGH' AND d.start BETWEEN 10000 AND 90000 AND d.\"end\" BETWEEN 10000 AND 90000)")(
    lambda s, d: intervals.valid_experiments(
        V.table(s, d, "nation").select(F.get(F.array(*map(F.lit, V.CHROMS)), (F.col("n_nationkey") % 5).cast("int")).alias("experiment"), "n_name"), V.domains(s, d).withColumn("experiment", F.col("chrom")), ("2-HIGH", 10_000, 90_000)
    ).select(F.col("n_name").alias("experiment"))
)
query("prj06_in_region", f"WITH {IV} SELECT name, \"end\" BETWEEN 50000 AND 700000 AS share, start BETWEEN 50000 AND 700000 AND \"end\" BETWEEN 50000 AND 700000 AS bases FROM v")(lambda s, d: V.intervals(s, d).select("name", intervals.in_region(50_000, 700_000).alias("share"), intervals.in_region(50_000, 700_000, "both").alias("bases")))
query("int12_mutated_bins", f"WITH {MB} SELECT DISTINCT run, bin FROM kk")(lambda s, d: intervals.mutated_bins(V.mutations(s, d), *_mut(s, d)))
query("int13_oversize", f"WITH {IV} SELECT chrom, max(\"end\" - start) AS longest, max(\"end\" - start) > 250 AS too_long FROM v GROUP BY chrom")(lambda s, d: intervals.oversize(V.intervals(s, d), 250))
query("cmp09_equal_bp", f"WITH {V.MUTATIONS}, z AS (SELECT run, sum(\"end\" - start)::BIGINT AS bp FROM m GROUP BY run) SELECT 'all' AS experiment, min(bp) AS low, max(bp) AS high FROM z HAVING min(bp) <> max(bp)")(lambda s, d: compare.check_equal(intervals.mutated_bp(V.mutations(s, d), -1, 1 << 60).withColumn("experiment", F.lit("all")), "bp", ["experiment"]))
query("cmp06_run_set", f"WITH {V.MUTATIONS}, x AS (SELECT DISTINCT run, 'e' || start // 4000 AS experiment FROM m) SELECT experiment, count(*) FILTER (run = 'Wtd_mut') AS wanted, count(*) FILTER (run <> 'Wtd_mut') AS random, 0::BIGINT AS others FROM x GROUP BY experiment HAVING wanted <> 1 OR random < 1")(lambda s, d: compare.check_run_set(V.mutations(s, d).select("run", F.concat(F.lit("e"), F.floor(F.col("start") / 4000)).alias("experiment")).distinct()))
query("cmp15_repartition", f"WITH {FRACTION} SELECT run, bin, round(value, 6)::DOUBLE AS value, CASE WHEN run = 'Wtd_mut' THEN 'wtd' ELSE 'rdm' END AS role, round(max(value) OVER (), 6)::DOUBLE AS most FROM fr")(lambda s, d: compare.repartition_of_mutations(intervals.mutated_fraction(V.mutations(s, d), *_mut(s, d))))
query("prj08_merge_runs", f"WITH {V.MUTATIONS} SELECT CASE WHEN run LIKE '%Rdm%' THEN 'merged_Rdm' ELSE run END AS run, run AS run_name, start, \"end\" FROM m")(lambda s, d: compare.merge_runs(V.mutations(s, d), "Rdm"))

# Sequences.
Q = V.SEQUENCES
H = lambda key: f"('0x' || substr(md5({key}), 1, 8))::BIGINT"
query("seq02_revcomp", f"WITH {Q} SELECT seq_id, reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan')) AS seq FROM q")(lambda s, d: V.sequences(s, d).select("seq_id", sequence.revcomp(F.col("seq")).alias("seq")))
query("seq03_mask", f"WITH {Q} SELECT seq_id, repeat('N', length(seq)) AS seq FROM q")(lambda s, d: V.sequences(s, d).select("seq_id", sequence.mask(F.col("seq")).alias("seq")))
query("seq04_shuffle", f"WITH {Q} SELECT seq_id, coalesce(list_reduce(list_transform(list_sort(list_transform(range(1, length(seq) + 1), lambda i: md5(seq_id || ':' || i) || seq[i])), lambda x: x[33:33]), lambda a, b: a || b), '') AS seq FROM q WHERE length(seq) > 0")(lambda s, d: V.sequences(s, d).where("seq <> ''").select("seq_id", sequence.shuffle_seq(F.col("seq"), F.col("seq_id").cast("string")).alias("seq")))
query("seq05_rep_fill", f"WITH {Q} SELECT seq_id, left(repeat('ACGGT', ceil(length(seq) / 5)::INT), length(seq)) AS seq FROM q")(lambda s, d: V.sequences(s, d).select("seq_id", sequence.rep_fill(F.lit("ACGGT"), F.length("seq")).alias("seq")))
query("seq10_replace", f"WITH {Q} SELECT seq_id, CASE WHEN length(seq) >= 9 THEN left(seq, 3) || 'NNNNNN' || substr(seq, 10) END AS seq FROM q")(lambda s, d: V.sequences(s, d).select("seq_id", sequence.replace_substring(F.col("seq"), F.lit("NNNNNN"), F.lit(3), F.lit(9)).alias("seq")))
query("seq13_gc", f"WITH {Q} SELECT seq_id, round(CASE WHEN length(seq) > 0 THEN (length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / length(seq) END, 6) AS gc FROM q")(lambda s, d: V.sequences(s, d).select("seq_id", sequence.gc_fraction(F.col("seq")).alias("gc")))
query("seq13_gc_track", f"WITH {Q}, p AS (SELECT seq_id, b::INT AS bin, substr(seq, b * 100 + 1, 100) AS x FROM q, unnest(range(0, (length(seq) + 99) // 100)) t(b)) SELECT seq_id, bin, round((length(x) - length(translate(x, 'GC', '')))::DOUBLE / length(x), 6) AS gc FROM p")(lambda s, d: sequence.gc_track(sequence.chunked(V.sequences(s, d), 256), 100))
query("seq06_permute_within", f"WITH {Q} SELECT seq_id, CASE WHEN length(seq) > 0 AND length(seq) % 4 = 0 THEN list_reduce(list_transform(list_sort(list_transform(range(0, length(seq) // 4), lambda b: md5(seq_id || ':' || b) || substr(seq, b * 4 + 1, 4))), lambda x: x[33:]), lambda a, b: a || b) END AS seq FROM q")(lambda s, d: V.sequences(s, d).select("seq_id", sequence.permute_within(F.col("seq"), 4, F.col("seq_id").cast("string")).alias("seq")))
query("seq07_permute_between", f"WITH {IV}, k AS (SELECT chrom, name AS id, row_number() OVER (PARTITION BY chrom ORDER BY md5('23:' || name), name) AS r, count(*) OVER (PARTITION BY chrom) AS n FROM v) SELECT a.chrom, a.id, b.id AS donor, b.id AS new_seq FROM k a JOIN k b ON a.chrom = b.chrom AND a.r = b.r % b.n + 1")(lambda s, d: sequence.permute_between(V.intervals(s, d).select("chrom", F.col("name").alias("id"), F.col("name").alias("seq")), 23))
query("seq01_fetch", f"WITH {Q} SELECT seq_id AS id, seq_id, length(seq) // 4 AS start, length(seq) // 2 AS \"end\", substr(seq, length(seq) // 4 + 1, length(seq) // 2 - length(seq) // 4) AS found FROM q WHERE length(seq) >= 4")(
    lambda s, d: sequence.fetch_sequences(V.sequences(s, d).where(F.length("seq") >= 4).select(F.col("seq_id").alias("id"), "seq_id", F.floor(F.length("seq") / 4).alias("start"), F.floor(F.length("seq") / 2).alias("end")), sequence.chunked(V.sequences(s, d), 256), 256)
)


def _mutated(s, d, stored=False):
    """Sequences and a mutation of each; ``stored`` writes the sequences, where much else reads them, spread over all tasks."""
    seqs = V.sequences(s, d)
    seqs = (cut(seqs.repartition("seq_id")) if stored else seqs).where(F.length("seq") >= 4)
    a, b = F.floor(F.length("seq") / 4).cast("int"), F.floor(F.length("seq") / 2).cast("int")
    op = F.get(F.array(*map(F.lit, ["mask", "inversion", "insertion"])), (F.col("seq_id") % 3).cast("int"))
    rows = seqs.select("seq_id", a.alias("start"), b.alias("end"), F.substr("seq", a + 1, b - a).alias("ref_seq"), op.alias("op"), F.lit("A").alias("sequence"), F.lit("-").alias("strand"))
    return seqs, sequence.mutate(rows, F.col("seq_id").cast("string"))


VAR = f"{Q}, mu AS (SELECT seq_id, seq, length(seq) // 4 AS a, length(seq) // 2 AS b FROM q WHERE length(seq) >= 4), va AS (SELECT *, CASE seq_id % 3 WHEN 0 THEN repeat('N', b - a) WHEN 1 THEN reverse(translate(substr(seq, a + 1, b - a), 'ACGTN', 'TGCAN')) ELSE repeat('T', b - a) END AS variant_seq FROM mu)"
query("seq08_apply", f"WITH {VAR} SELECT seq_id, a::INT AS start, b::INT AS \"end\", variant_seq FROM va")(lambda s, d: _mutated(s, d)[1].select("seq_id", "start", "end", "variant_seq"))
query("seq09_splice", f"WITH {VAR} SELECT seq_id, left(seq, a::INT) || variant_seq || substr(seq, b + 1) AS seq FROM va")(lambda s, d: sequence.splice(*_mutated(s, d)))
query("seq09_splice_chunks", f"WITH {VAR}, z AS (SELECT seq_id, left(seq, a::INT) || CASE WHEN seq_id % 2 = 0 THEN variant_seq || 'ACGT' ELSE left(variant_seq, 3) END || substr(seq, b + 1) AS seq FROM va) SELECT seq_id, b::INT AS chunk_id, (b * 64)::INT AS chunk_start, substr(seq, b * 64 + 1, 64) AS seq FROM z, unnest(range(0, (length(seq) + 63) // 64)) t(b)")(
    lambda s, d: (lambda m: sequence.splice_chunks(sequence.chunked(m[0], 64), m[1].withColumn("variant_seq", F.when(F.col("seq_id") % 2 == 0, F.concat("variant_seq", F.lit("ACGT"))).otherwise(F.substring("variant_seq", 1, 3))), 64))(_mutated(s, d, True))
)
query("seq08_counts", f"WITH {VAR} SELECT (['mask', 'inversion', 'insertion'])[seq_id % 3 + 1] AS op, count(*) AS applied, 0::BIGINT AS rejected FROM va GROUP BY ALL")(lambda s, d: sequence.mutation_counts(_mutated(s, d)[1], ()))
_SIX = ["mask", "inversion", "shuffle", "insertion", "permutations_inter", "permutations_intra", "insertion", "deletion"]


def _six(s, d):
    """Mutations of every operation, of one that is unknown and of an insertion that is no sequence; exchanges within every third sequence."""
    seqs = V.sequences(s, d).where(F.length("seq") >= 8)
    a, b = F.floor(F.length("seq") / 4).cast("int"), (F.floor(F.length("seq") / 4) + F.floor(F.length("seq") / 16) * 4 + 2 * (F.col("seq_id") % 2)).cast("int")
    op = F.get(F.array(*map(F.lit, _SIX)), (F.col("seq_id") % 8).cast("int"))
    rows = seqs.select("seq_id", (F.col("seq_id") % 3).alias("set"), a.alias("start"), b.alias("end"), F.substr("seq", a + 1, b - a).alias("ref_seq"), op.alias("op"), F.when(F.col("seq_id") % 8 == 6, "AXE").otherwise("AC").alias("sequence"), F.lit("-").alias("strand"))
    return sequence.mutate(rows.where("end > start"), F.col("seq_id").cast("string"), binsize=4, seed=11, group=("set",))


_ORDER = "list_sort(list_transform(range(n // 4), lambda b: md5(seq_id || ':' || b) || lpad(b::VARCHAR, 9, '0')))"
SIX = f"""{Q}, mu AS (SELECT seq_id, seq_id % 3 AS grp, ({_SIX})[seq_id % 8 + 1] AS op, length(seq) // 4 AS a, length(seq) // 16 * 4 + 2 * (seq_id % 2) AS n, seq FROM q WHERE length(seq) >= 8), re AS (SELECT * EXCLUDE (seq), substr(seq, a + 1, n) AS ref FROM mu WHERE n > 0),
ex AS (SELECT seq_id, coalesce(lead(ref) OVER o, first_value(ref) OVER o) AS donor FROM re WHERE op = 'permutations_intra' WINDOW o AS (PARTITION BY grp ORDER BY md5('11:' || grp || ':' || a), a, seq_id)),
six AS (SELECT re.seq_id, op, a AS start, a + n AS "end", CASE WHEN op = 'mask' THEN repeat('N', n) WHEN op = 'inversion' THEN reverse(translate(ref, 'ACGTN', 'TGCAN'))
WHEN op = 'shuffle' THEN list_reduce(list_transform(list_sort(list_transform(range(1, n + 1), lambda i: md5(re.seq_id || ':' || i) || ref[i])), lambda x: x[33:33]), lambda x, y: x || y)
WHEN op = 'insertion' AND re.seq_id % 8 = 3 THEN left(repeat('GT', n), n) WHEN op = 'permutations_inter' AND n % 4 = 0 THEN array_to_string(list_transform({_ORDER.replace('seq_id', 're.seq_id')}, lambda x: substr(ref, x[33:]::INT * 4 + 1, 4)), '') WHEN op = 'permutations_intra' THEN donor END AS variant_seq,
CASE WHEN op = 'deletion' THEN 'unknown operation' WHEN op = 'insertion' AND re.seq_id % 8 = 6 THEN 'invalid insertion' WHEN op = 'permutations_inter' AND n % 4 <> 0 THEN 'bin size does not divide the interval' END AS reason FROM re LEFT JOIN ex USING (seq_id))"""
query("seq08_six_operations", f"WITH {SIX} SELECT seq_id, op, start::INT AS start, \"end\"::INT AS \"end\", variant_seq, reason FROM six")(lambda s, d: _six(s, d).select("seq_id", "op", "start", "end", "variant_seq", "reason"))
query("seq08_six_counts", f"WITH {SIX} SELECT op, count(variant_seq) AS applied, count(*) - count(variant_seq) AS rejected FROM six GROUP BY op")(lambda s, d: sequence.mutation_counts(_six(s, d), ()))
query("seq15_random", f"WITH {V.MUTATIONS}, z AS (SELECT DISTINCT run, start, (\"end\" - start)::INT AS n FROM m) SELECT run, start, list_reduce(list_transform(range(1, n + 1), lambda i: CASE WHEN {H("run || start || ':' || i")} < 0.22 * 4294967296 THEN 'A' WHEN {H("run || start || ':' || i")} < 0.5 * 4294967296 THEN 'C' WHEN {H("run || start || ':' || i")} < 0.78 * 4294967296 THEN 'G' ELSE 'T' END), lambda a, b: a || b) AS seq FROM z")(
    lambda s, d: V.mutations(s, d).select("run", "start", (F.col("end") - F.col("start")).cast("int").alias("n")).distinct().select("run", "start", sequence.random_sequence(F.col("n"), F.concat("run", F.col("start").cast("string"))).alias("seq"))
)

# Random replicates.
query("smp01_fan_out", f"WITH {V.MUTATIONS} SELECT start, \"end\", r::INT AS replicate, CASE WHEN r >= 0 THEN ((r + 3) ** 3)::BIGINT END AS seed, CASE WHEN r < 0 THEN 'Wtd_mut' ELSE 'Rdm_mut_' || r END AS run FROM m, range(-1, 10) t(r)")(lambda s, d: nullmodel.fan_out(V.mutations(s, d).drop("run"), 10))
DSIZE = 35_000
_DB = f"(SELECT ceil(max(\"end\") / {float(DSIZE)})::BIGINT FROM d)"
PLACED = f"{V.DOMAINS}, a AS (SELECT chrom, start, \"end\", CASE WHEN floor(start / {DSIZE}) = floor((\"end\" - 1) / {DSIZE}) OR ((floor(start / {DSIZE}) + 1) * {DSIZE} - start) * 2 >= \"end\" - start THEN floor(start / {DSIZE})::BIGINT ELSE floor((\"end\" - 1) / {DSIZE})::BIGINT END AS bin FROM d)"


def _bins(s, d):
    """Bins up to the end of the last domain."""
    return int(V.domains(s, d).agg(F.ceil(F.max("end") / DSIZE)).first()[0])


query("smp02_rotate_bins", f"""WITH {PLACED}, mv AS (SELECT chrom, k AS shift, start + ((bin - k + {_DB}) % {_DB} - bin) * {DSIZE} AS start, "end" + ((bin - k + {_DB}) % {_DB} - bin) * {DSIZE} AS "end" FROM a, unnest(range(1, {_DB})) t(k)),
x AS (SELECT *, max("end") OVER (PARTITION BY chrom, shift ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mv),
ok AS (SELECT chrom, shift, row_number() OVER (PARTITION BY chrom ORDER BY md5('3:' || shift)) - 1 AS replicate FROM (SELECT chrom, shift FROM x GROUP BY ALL HAVING NOT bool_or(coalesce(start < reach, false) OR start < 0 OR "end" > {DSIZE} * {_DB})))
SELECT chrom, replicate::INT AS replicate, shift::INT AS shift, start, "end" FROM mv JOIN ok USING (chrom, shift) WHERE replicate < 2""")(
    lambda s, d: nullmodel.rotate_bins(V.domains(s, d), 2, DSIZE, _bins(s, d), 3).select("chrom", "replicate", "shift", "start", "end")
)


def _free_sql(name: str, free: str, taken: str) -> str:
    """``name``: the stretches ``free`` without the places of ``taken``, both ``chrom, start, "end"``."""
    return f"""{name}_t AS (SELECT chrom, start, max("end") AS "end" FROM {taken} GROUP BY ALL),
{name}_e AS MATERIALIZED (SELECT chrom, start AS pos, "end" AS reach, true AS taken FROM {name}_t UNION SELECT chrom, start, NULL, false FROM {free} UNION SELECT chrom, "end", NULL, NULL FROM {free} UNION SELECT chrom, t."end", NULL, false FROM {name}_t t ASOF JOIN {free} f USING (chrom, start) WHERE t."end" < f."end" UNION SELECT t.chrom, t."end", NULL, false FROM {name}_t t JOIN {free} f ON t.chrom = f.chrom AND t.start < f.start AND t."end" >= f.start AND t."end" < f."end"),
{name} AS MATERIALIZED (SELECT DISTINCT chrom, pos AS start, shut AS "end" FROM (SELECT chrom, pos, taken, coalesce(max(reach) OVER (PARTITION BY chrom ORDER BY pos), 0) AS reach, min(CASE WHEN taken IS DISTINCT FROM false THEN pos END) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS shut FROM {name}_e) WHERE NOT taken AND reach <= pos AND pos < shut)"""


def _place_sql(seed: int, by_chrom: bool, rounds: int = 8) -> str:
    """``kept``: the places ``id, chrom, start, "end"`` of ``w0`` (``id, "on", length``) within ``f0``, in so many rounds."""
    steps = []
    for k in range(rounds):
        bits = lambda key, n: f"('0x' || substr(md5({key}), 1, {n}))::BIGINT"
        steps.append(f"""sh{k} AS (SELECT *, (length >> greatest(floor(log2(length))::INT - {k // 2}, 0)) << greatest(floor(log2(length))::INT - {k // 2}, 0) AS shrunk FROM w{k}),
h{k} AS (SELECT *, {'chrom' if by_chrom else "''"} AS "on" FROM f{k}),
nb{k} AS MATERIALIZED (SELECT *, sum(room) OVER (PARTITION BY "on", shrunk ORDER BY chrom, start) - room AS first, sum(room) OVER (PARTITION BY "on", shrunk) AS whole FROM (SELECT "on", shrunk, chrom, start, "end", "end" - start - shrunk + 1 AS room FROM h{k} JOIN (SELECT DISTINCT "on", shrunk FROM sh{k}) USING ("on")) WHERE room > 0),
th{k} AS (SELECT "on", room / needed AS share FROM (SELECT "on", sum(length)::DOUBLE AS needed FROM sh{k} GROUP BY "on") JOIN (SELECT "on", sum("end" - start)::DOUBLE AS room FROM h{k} GROUP BY "on") USING ("on")),
dr{k} AS MATERIALIZED (SELECT id, "on", shrunk, length, (x % whole)::BIGINT AS u FROM (SELECT *, {bits(f"'{seed}:{k}:' || id", 15)} AS x FROM sh{k}) JOIN (SELECT DISTINCT "on", shrunk, whole FROM nb{k}) USING ("on", shrunk) JOIN th{k} USING ("on") WHERE x < {1 << 60} - {1 << 60} % whole AND {bits(f"'t{seed}:{k}:' || id", 8)} < share * 4294967296.0),
lk{k} AS (SELECT id, chrom, (n.start + u - n.first)::BIGINT AS start, (n.start + u - n.first + length)::BIGINT AS "end", n."end" AS lim FROM dr{k} d ASOF JOIN nb{k} n ON d."on" = n."on" AND d.shrunk = n.shrunk AND d.u >= n.first),
kp{k} AS MATERIALIZED (SELECT id, chrom, start, "end" FROM (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lk{k} WHERE "end" <= lim) WHERE reach IS NULL OR reach <= start),
w{k + 1} AS MATERIALIZED (SELECT * FROM w{k} ANTI JOIN kp{k} USING (id))""")
        steps.append(_free_sql(f"f{k + 1}", f"f{k}", f"kp{k}"))
    return ",\n".join(steps) + ",\nkept AS (" + " UNION ALL ".join(f"SELECT * FROM kp{k}" for k in range(rounds)) + ")"


query("smp07_random_intervals", f"""WITH {IV}, {V.SIZES}, {V.DOMAINS}, n AS (SELECT chrom, count(*) // 4 AS wanted FROM v GROUP BY chrom),
w0 AS MATERIALIZED (SELECT chrom || ':' || r AS id, chrom AS "on", 312::BIGINT AS length FROM n, unnest(range(0, wanted)) t(r)), z AS (SELECT chrom, 0::BIGINT AS start, size AS "end" FROM s),
{_free_sql("f0", "z", "d")},
{_place_sql(5, True)}
SELECT chrom, split_part(id, ':', -1)::BIGINT AS draw, start, "end" FROM kept""")(
    lambda s, d: nullmodel.random_intervals(V.sizes(s, d).join(V.intervals(s, d).groupBy("chrom").agg(F.floor(F.count("*") / 4).cast("long").alias("wanted")), "chrom"), 312, 5, V.domains(s, d))
)
query("smp05_global_shuffle", f"""WITH {IV}, {V.SIZES}, {V.DOMAINS}, w0 AS MATERIALIZED (SELECT name AS id, '' AS "on", "end" - start AS length FROM v), z AS (SELECT chrom, 0::BIGINT AS start, size * 4 AS "end" FROM s),
{_free_sql("f0", "z", "d")},
{_place_sql(7, False)}
SELECT chrom, start, "end", id AS name FROM kept""")(
    lambda s, d: nullmodel.global_shuffle(V.intervals(s, d).select(*_cols), V.sizes(s, d).withColumn("size", F.col("size") * 4), 7, excl=V.domains(s, d))
)


# Coarse maps, analysis tables and checks of mutations.
query("mat08_coarsegrain", f"""WITH {C}, k AS (SELECT run, i, j, l::INT AS level, i // (2 ** l)::INT AS bi, j // (2 ** l)::INT AS bj, value FROM c, range(5) t(l)), n AS (SELECT run, level, bi, bj, avg(value) AS mean, sum(value) AS cnt FROM k GROUP BY ALL)
SELECT run, i, j, round(min_by(mean, CASE WHEN cnt >= 40 THEN level END), 6) AS value FROM k JOIN n USING (run, level, bi, bj) GROUP BY run, i, j""")(lambda s, d: contacts.coarsegrain(V.contacts(s, d).withColumn("raw", F.col("value")), 40, 5))
_WIDE = V.mutation_binsize_sql(B)
NEAR = f"{V.MUTATIONS}, big AS (SELECT * FROM m WHERE run = 'Wtd_mut' AND \"end\" - start >= 576), eb AS (SELECT floor(start / {_WIDE})::BIGINT AS e FROM big UNION SELECT floor(\"end\" / {_WIDE})::BIGINT FROM big), nd AS (SELECT b::INT AS bin, min(abs(b - e)) AS distance FROM range({B}) t(b), eb GROUP BY b)"
LONG = f"{DEV}, {NEAR}, lt AS (SELECT run AS name, '32Mb' AS resolution, 'insulation' AS score_type, bin, deviation AS \"values\", reference, distance AS mutation_distance FROM dev LEFT JOIN nd USING (bin))"


def _long(s, d):
    big = V.mutations(s, d).where("run = 'Wtd_mut' and end - start >= 576")
    return compare.analysis_table(_deviation(s, d), intervals.nearest_distance(big, 0, V.mutation_binsize(s, d, B), B), "insulation", "32Mb")


query("cmp03_analysis_table", f"WITH {LONG} SELECT name, resolution, score_type, bin, round(\"values\", 6) AS \"values\", round(reference, 6) AS reference, mutation_distance FROM lt")(_long)
query("cmp11_dispersion_by_distance", f"""WITH {LONG} SELECT name, mutation_distance, {', '.join(f'round(quantile_cont("values", {p}), 6) AS p{round(p * 1000):03d}' for p in (.125, .25, .5, .75, .875))},
round(min("values"), 6) AS low, round(max("values"), 6) AS high, round(avg("values"), 6) AS mean, round(stddev_samp("values"), 6) AS sd, count("values") AS n FROM lt GROUP BY ALL""")(lambda s, d: compare.dispersion_by_distance(_long(s, d)))
query("cmp16_bp_report", f"WITH {V.MUTATIONS}, r AS (SELECT run, sum(\"end\" - start)::BIGINT AS bp FROM m WHERE start >= 0 AND \"end\" <= (SELECT max(\"end\") FROM m) AND run <> 'Wtd_mut' GROUP BY run) SELECT run, bp, CASE WHEN bp > 1e6 THEN printf('%.1f', bp / 1e6) || 'Mb' WHEN bp > 1e3 THEN printf('%.1f', bp / 1e3) || 'kb' ELSE bp || 'pb' END AS readable FROM r")(
    lambda s, d: compare.bp_report(intervals.mutated_bp(V.mutations(s, d), 0, V.mutation_binsize(s, d, 1)))
)
query("prj18_numeric", "SELECT o_orderkey, try_cast(o_orderpriority AS DOUBLE) AS p, try_cast(o_custkey AS DOUBLE) AS c, (o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS DOUBLE) IS NULL)::INT AS bad FROM orders")(
    lambda s, d: compare.ensure_numeric(V.table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_custkey").cast("string").alias("c")), ["p", "c"])
)
query("prj16_validate", f"""WITH {Q} SELECT seq_id, CASE WHEN seq_id % 5 = 4 THEN 'unknown operation' WHEN seq_id % 5 = 3 AND seq = '' THEN 'not a sequence' WHEN seq_id % 5 = 3 AND length(seq) > 500 THEN 'longer than its interval' END AS reason FROM q""")(
    lambda s, d: sequence.validate_mutations(V.sequences(s, d).select("seq_id", F.col("seq").alias("sequence"), F.get(F.array(*map(F.lit, ["mask", "inversion", "shuffle", "insertion", "deletion"])), (F.col("seq_id") % 5).cast("int")).alias("op"), F.lit(100).alias("start"), F.lit(600).alias("end"))).select("seq_id", "reason")
)


def _verified(s, d):
    seqs, rows = _mutated(s, d)
    broken = sequence.splice(seqs, rows).withColumn("seq", F.when(F.col("seq_id") % 4 == 0, F.concat("seq", F.lit("A"))).otherwise(F.col("seq")))
    return sequence.verify_splice(seqs, broken, rows)


query("seq11_verify_splice", f"WITH {VAR} SELECT seq_id, b::INT AS start, (length(seq) + 1)::INT AS \"end\" FROM va WHERE seq_id % 4 = 0")(_verified)
query("seq12_revert", f"WITH {VAR} SELECT seq_id, seq FROM va")(lambda s, d: (lambda m: sequence.revert(sequence.splice(*m), m[1]))(_mutated(s, d)))


def _resized(s, d):
    """Sequences and mutations of which every second one grows and the others shrink."""
    seqs, rows = _mutated(s, d, True)
    return seqs, rows.withColumn("variant_seq", F.when(F.col("seq_id") % 2 == 0, F.concat("variant_seq", F.lit("ACGT"))).otherwise(F.substring("variant_seq", 1, 3)))


def _resized_verified(s, d):
    seqs, rows = _resized(s, d)
    after = sequence.splice_chunks(sequence.chunked(seqs, 64), rows, 64)
    broken = after.withColumn("seq", F.when((F.col("seq_id") % 4 == 1) & (F.col("chunk_id") == 0) & (F.length("seq") > 0), F.concat(F.lit("N"), F.expr("substr(seq, 2)"))).otherwise(F.col("seq")))
    return sequence.verify_chunks(sequence.chunked(seqs, 64), cut(broken), rows, 64)


query("seq11_verify_chunks", f"WITH {VAR} SELECT seq_id, 0::BIGINT AS start, a::BIGINT AS \"end\" FROM va WHERE seq_id % 4 = 1 AND left(seq, 1) <> 'N'")(_resized_verified)
query("seq12_revert_chunks", f"WITH {VAR} SELECT seq_id, k::INT AS chunk_id, (k * 64)::INT AS chunk_start, substr(seq, k * 64 + 1, 64) AS seq FROM mu, unnest(range(0, (length(seq) + 63) // 64)) t(k)")(
    lambda s, d: (lambda m: sequence.revert_chunks(sequence.splice_chunks(sequence.chunked(m[0], 64), m[1], 64), m[1], 64))(_resized(s, d))
)
query("smp06_extent_range", f"""WITH {IV}, {V.SIZES}, w AS (SELECT chrom, min(start) AS low, max("end") AS high, max("end" - start) AS longest, any_value(size) AS size FROM v JOIN s USING (chrom) GROUP BY chrom), x AS (SELECT *, greatest(8000000 - (high - low), 0) AS short FROM w)
SELECT chrom, greatest(low - short // 2, 0) AS start, least(greatest(low - short // 2, 0) + high - low + short, size) AS "end", longest FROM x""")(lambda s, d: intervals.extent_range(V.intervals(s, d), V.sizes(s, d), 8_000_000))
query("seq14_extract_region", f"WITH {Q}, r AS (SELECT seq_id, substr(seq, 101, 300) AS seq FROM q WHERE seq_id = (SELECT max(seq_id) FROM q WHERE length(seq) >= 400)), t AS (SELECT * FROM (VALUES (0, 28), (28, 128), (156, 128), (284, 16)) x(a, n)) SELECT seq_id, a::INT AS chunk_start, substr(seq, a + 1, n) AS seq FROM r, t")(
    lambda s, d: (lambda q: sequence.extract_region(sequence.chunked(q, 128), q.where(F.length("seq") >= 400).agg(F.max("seq_id")).scalar(), 100, 400))(V.sequences(s, d))
)

# Shuffled bins and places, random contents, matrix kinds, levels and references.
query("smp03_shuffle_bins", f"""WITH {PLACED},
p AS (SELECT r, k, b AS bin, row_number() OVER (PARTITION BY r, k ORDER BY md5('3:' || r || ':' || k || ':' || b), b) - 1 AS place FROM range(2) t(r), range(16) u(k), unnest(range(0, {_DB})) w(b)),
mv AS (SELECT chrom, r, k, start + (place - bin) * {DSIZE} AS start, "end" + (place - bin) * {DSIZE} AS "end" FROM a JOIN p USING (bin)),
x AS (SELECT *, max("end") OVER (PARTITION BY chrom, r, k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mv),
ok AS (SELECT chrom, r, min(k) AS k FROM (SELECT chrom, r, k FROM x GROUP BY ALL HAVING NOT bool_or(coalesce(start < reach, false) OR start < 0 OR "end" > {DSIZE} * {_DB})) GROUP BY ALL)
SELECT chrom, r::INT AS replicate, start, "end" FROM mv JOIN ok USING (chrom, r, k)""")(
    lambda s, d: nullmodel.shuffle_bins(V.domains(s, d), 2, DSIZE, _bins(s, d), 3).select("chrom", "replicate", "start", "end")
)
_letter = f"list_reduce(list_transform(range(1, (\"end\" - start)::INT + 1), lambda i: CASE WHEN {H('key || i')} < 0.22 * 4294967296 THEN 'A' WHEN {H('key || i')} < 0.5 * 4294967296 THEN 'C' WHEN {H('key || i')} < 0.78 * 4294967296 THEN 'G' ELSE 'T' END), lambda a, b: a || b)"
query("smp08_random_content", f"""WITH {V.MUTATIONS}, o AS (SELECT DISTINCT run || ':' || r AS run, run AS chrom, start, "end", CASE WHEN run LIKE '%1' OR start % 2 = 0 THEN 'permutations_inter' ELSE 'mask' END AS op FROM m, range(2) t(r)),
k AS (SELECT *, bool_and(op = 'permutations_inter') OVER (PARTITION BY run) AS alone, '9:' || run || ':' || chrom || ':' || start || ':' || "end" || '::' AS key FROM o)
SELECT run, start, "end", 'rdm_' || chrom || '_' || start || '_' || "end" AS name, CASE WHEN alone THEN op ELSE 'insertion' END AS op, CASE WHEN NOT alone THEN {_letter} END AS sequence,
CASE WHEN alone THEN array_to_string(list_transform(list_sort(list_transform(range(greatest(("end" - start) // 12, 1)), lambda b: md5(key || ':' || b) || lpad(b::VARCHAR, 9, '0'))), lambda x: x[33:]::INT), ',') END AS bin_order FROM k""")(
    lambda s, d: nullmodel.random_content(
        V.mutations(s, d).distinct().withColumn("r", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.concat_ws(":", "run", "r").alias("run"), F.col("run").alias("chrom"), "start", "end", F.lit(None).cast("string").alias("name"), F.when(F.col("run").endswith("1") | (F.col("start") % 2 == 0), "permutations_inter").otherwise("mask").alias("op")), 9, keys=("run",), binsize=12
    ).drop("chrom").withColumn("bin_order", F.array_join("bin_order", ","))
)
_TRIES = f"{V.MUTATIONS}, tr AS (SELECT run, k::INT AS attempt, start + {H('run || start || k')} % 2000 AS start, start + {H('run || start || k')} % 2000 + (\"end\" - start) // 12 AS \"end\" FROM (SELECT DISTINCT * FROM m), range(6) t(k))"
query("smp09_first_valid", f"""WITH {_TRIES}, x AS (SELECT run, attempt, coalesce(start < max("end") OVER (PARTITION BY run, attempt ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS bad FROM tr),
ok AS (SELECT run, min(attempt) AS attempt FROM (SELECT run, attempt FROM x GROUP BY ALL HAVING NOT bool_or(bad)) GROUP BY run) SELECT run, attempt, start, "end" FROM tr JOIN ok USING (run, attempt)""")(
    lambda s, d: (lambda m, u: nullmodel.first_valid(m.select("run", "attempt", (F.col("start") + u).alias("start"), (F.col("start") + u + F.floor((F.col("end") - F.col("start")) / 12)).alias("end")), ("run",), strict=False))(
        V.mutations(s, d).distinct().withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(5)))), sequence.draw(F.concat("run", F.col("start").cast("string"), F.col("attempt").cast("string"))) % 2000)
)
query("prj10_matrix_kind", f"WITH {OE} SELECT run, i, j, CASE WHEN run = 'R' THEN 'obs_o_exp' ELSE 'log_obs_o_exp' END AS kind, round(CASE WHEN run = 'R' THEN value ELSE ln(value) END, 6) AS value FROM oe")(
    lambda s, d: contacts.for_use(V.contacts(s, d), F.when(F.col("run") == "R", "plain").when(F.col("run") == "N", "measured").otherwise("predicted"), "heatmap")
)
query("prj15_levels", f"WITH {IV}, l AS (SELECT * FROM (VALUES ('1Mb', 101000, 201000), ('2Mb', 51000, 401000)) t(resol, low, high)) SELECT resol, low::BIGINT AS low, high::BIGINT AS high, count(*) AS n FROM v JOIN l ON chrom = '2-HIGH' AND start >= low AND \"end\" <= high GROUP BY ALL")(
    lambda s, d: V.intervals(s, d).join(F.broadcast(contacts.levels(s, {"1Mb": ("2-HIGH", 100_000, 200_000), "2Mb": ("2-HIGH", 50_000, 400_000)}, 1000).withColumnsRenamed({"start": "low", "end": "high"})), "chrom").where("start >= low and end <= high").groupBy("resol", "low", "high").agg(F.count("*").alias("n"))
)
query("cmp07_references", "WITH r AS (SELECT *, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_ref FROM orders) SELECT a.o_custkey AS experiment, a.o_orderkey AS run FROM r a JOIN r b USING (o_custkey) WHERE NOT a.is_ref AND b.is_ref AND (a.o_orderpriority IS DISTINCT FROM b.o_orderpriority OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus)")(
    lambda s, d: compare.check_references(V.table(s, d, "orders").select(F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("run"), "o_orderpriority", "o_orderstatus").withColumn("is_ref", F.col("run") == F.min("run").over(Window.partitionBy("experiment"))), ["o_orderpriority", "o_orderstatus"])
)
