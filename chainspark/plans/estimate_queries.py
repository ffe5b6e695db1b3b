"""Estimation (E) and absorbing-chain quantities (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspark.operators import absorb as C
from chainspark.operators import chains
from chainspark.operators import estimate as E
from chainspark.plans.registry import query
from chainspark.plans.tables import SPACE, TR, draw_sql, sql, transitions

LAMBDAS = [0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0]

CELLS = TR + """,
cells AS MATERIALIZED (SELECT team, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2, 3),
rowsum AS (SELECT team, i, SUM(n) AS ni FROM cells GROUP BY 1, 2),
mle AS MATERIALIZED (SELECT c.team, c.i, c.j, n, n / ni AS p FROM cells c JOIN rowsum r ON c.team = r.team AND c.i = r.i)"""
GRID = CELLS + """,
grid AS (SELECT a.i, b.j FROM (SELECT UNNEST(range(80)) AS i) a, (SELECT UNNEST(range(84)) AS j) b),
teams AS (SELECT DISTINCT team FROM cells),
full_c AS MATERIALIZED (SELECT t.team, g.i, g.j, COALESCE(c.n, 0) AS n, SUM(COALESCE(c.n, 0)) OVER (PARTITION BY t.team, g.i) AS ni
  FROM teams t CROSS JOIN grid g LEFT JOIN cells c ON c.team = t.team AND c.i = g.i AND c.j = g.j),
rest0 AS (SELECT team, i, j, n, ni, SUM(n) OVER (PARTITION BY i, j) - n AS rn FROM full_c),
qx AS MATERIALIZED (SELECT team, i, j, n, ni, (rn + CAST(1 AS DOUBLE) / 84) / (SUM(rn) OVER (PARTITION BY team, i) + 1) AS q FROM rest0)"""
FIRST = """,
firsts AS (SELECT poss_uid, team, MIN_BY(from_state, event_index) AS i FROM tr GROUP BY 1, 2),
alpha AS MATERIALIZED (SELECT team, i, CAST(COUNT(*) AS DOUBLE) AS a FROM firsts GROUP BY 1, 2),
asum AS (SELECT team, SUM(a) AS atot FROM alpha GROUP BY 1)"""


def cells(spark, sf, keys=("team",)):
    return E.count_cells(transitions(spark, sf), keys)


def matrix(spark, sf):
    return E.mle(cells(spark, sf), ["team"])


def alpha(spark, sf):
    return C.starts(transitions(spark, sf), ["team"])


@query("e01_count_cells", sql(CELLS, " SELECT team, i, j, n FROM cells"))
def e01(spark, sf):
    return cells(spark, sf)


@query("e02_counts_by_group", sql(TR, " SELECT phase, action_type, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2, 3, 4"))
def e02(spark, sf):
    return cells(spark, sf, ("phase", "action_type"))


@query("e03_mle", sql(CELLS, " SELECT team, i, j, ROUND(p, 6) AS p FROM mle"))
def e03(spark, sf):
    return matrix(spark, sf).select("team", "i", "j", F.round("p", 6).alias("p"))


@query("e04_normalise_uniform", sql(GRID, """
SELECT team, i, j, ROUND(CASE WHEN ni > 0 THEN n / ni ELSE CAST(1 AS DOUBLE) / 84 END, 6) AS p FROM full_c"""))
def e04(spark, sf):
    return E.normalise_rows(cells(spark, sf), SPACE, ["team"]).select(
        "team", "i", "j", F.round("p", 6).alias("p"))


@query("e05_shrinkage", sql(GRID, """
SELECT team, i, j, ROUND((n + 50 * q) / (ni + 50), 6) AS p FROM qx"""))
def e05(spark, sf):
    c = cells(spark, sf)
    full = E.complete(c, SPACE, ["team"]).join(E.prior_without(c, "team", SPACE), ["team", "i", "j"])
    return E.shrink(full, 50.0, SPACE, ["team"]).select("team", "i", "j", F.round("p", 6).alias("p"))


@query("e06_prior_excluding_unit", sql(GRID, " SELECT team, i, j, ROUND(q, 6) AS q FROM qx"))
def e06(spark, sf):
    return E.prior_without(cells(spark, sf), "team", SPACE).select(
        "team", "i", "j", F.round("q", 6).alias("q"))


CV = GRID + f""",
ids AS (SELECT DISTINCT team, poss_uid FROM tr),
fl AS (SELECT team, poss_uid, NTILE(5) OVER (PARTITION BY team ORDER BY {draw_sql("'20260819'", "poss_uid")}, poss_uid) - 1 AS fold FROM ids),
fc AS (SELECT tr.team, fold, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS te FROM tr JOIN fl ON tr.team = fl.team AND tr.poss_uid = fl.poss_uid GROUP BY 1, 2, 3, 4),
fr AS (SELECT team, fold, i, SUM(te) AS tei FROM fc GROUP BY 1, 2, 3),
cv0 AS (SELECT fc.team, fc.fold, fc.i, fc.j, te, qx.n - te AS tr_, qx.ni - tei AS tri, q FROM fc JOIN fr ON fc.team = fr.team AND fc.fold = fr.fold AND fc.i = fr.i
  JOIN qx ON qx.team = fc.team AND qx.i = fc.i AND qx.j = fc.j),
lams AS (SELECT CAST(UNNEST([0, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000]) AS DOUBLE) AS lam),
cv AS (SELECT team, lam, SUM(te * LN(GREATEST(CASE WHEN tri + lam <= 1e-12 THEN q ELSE (tr_ + lam * q) / (tri + lam) END, 1e-12))) / SUM(te) AS score
  FROM cv0, lams GROUP BY 1, 2)"""


def cv_table(spark, sf):
    c = cells(spark, sf)
    fc = E.fold_cells(transitions(spark, sf), 5, 20260819, "team")
    return E.cv_scores(fc, E.prior_without(c, "team", SPACE), LAMBDAS, "team")


@query("e07_cv_lambda_scores", sql(CV, " SELECT team, lam, ROUND(score, 6) AS score FROM cv"))
def e07(spark, sf):
    return cv_table(spark, sf).withColumn("score", F.round("score", 6))


@query("e08_lambda_star_boundary", sql(CV, """
, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY score DESC, lam) AS k FROM cv)
SELECT team, lam AS lam_star, ROUND(score, 6) AS score, lam <= 0 AS at_floor, lam >= 5000 AS at_top FROM r WHERE k = 1"""))
def e08(spark, sf):
    return E.best_lambda(cv_table(spark, sf), "team").withColumn("score", F.round("score", 6))


@query("e09_sparsity", sql(GRID, """
, rw AS (SELECT team, i, SUM(n) AS n FROM full_c GROUP BY 1, 2)
SELECT team, CAST(COUNT(*) AS BIGINT) AS n_rows, SUM(n) AS n_transitions, CAST(SUM(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_empty,
 CAST(SUM(CASE WHEN n < 30 THEN 1 ELSE 0 END) AS BIGINT) AS rows_below_min, AVG(CASE WHEN n < 30 THEN 1.0 ELSE 0.0 END) AS frac_below_min,
 QUANTILE_CONT(n, 0.5) AS median_row_count, CAST(80 * 83 AS DOUBLE) / GREATEST(SUM(n), 1) AS params_per_obs FROM rw GROUP BY team"""))
def e09(spark, sf):
    return E.sparsity(cells(spark, sf), SPACE, ["team"])


@query("e10_error_curve", sql(TR, f""",
cl AS (SELECT from_state AS i, to_state AS j, COUNT(*) AS n FROM tr GROUP BY 1, 2),
grid AS (SELECT a.i, b.j FROM (SELECT UNNEST(range(80)) AS i) a, (SELECT UNNEST(range(84)) AS j) b),
fullc AS (SELECT g.i, g.j, COALESCE(n, 0) AS n, SUM(COALESCE(n, 0)) OVER (PARTITION BY g.i) AS ni FROM grid g LEFT JOIN cl ON cl.i = g.i AND cl.j = g.j),
qq AS MATERIALIZED (SELECT i, j, n, ni, (n + CAST(1 AS DOUBLE) / 84) / (ni + 1) AS q, (n + 20 * (n + CAST(1 AS DOUBLE) / 84) / (ni + 1)) / (ni + 20) AS p_full FROM fullc),
ids AS (SELECT DISTINCT poss_uid FROM tr),
rk AS (SELECT poss_uid, rep, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY {draw_sql("'7'", "rep", "poss_uid")}, poss_uid) AS pos, COUNT(*) OVER (PARTITION BY rep) AS m
  FROM ids, (SELECT UNNEST([0, 1]) AS rep)),
fr AS (SELECT UNNEST([0.1, 0.4, 1.0]) AS fraction),
sel AS (SELECT poss_uid, rep, CAST(fraction AS DOUBLE) AS fraction, GREATEST(1, CAST(ROUND(fraction * m) AS BIGINT)) AS np, pos FROM rk, fr),
sel2 AS (SELECT * FROM sel WHERE pos <= np AND (fraction < 1 OR rep = 0)),
sc AS (SELECT fraction, rep, np, from_state AS i, to_state AS j, COUNT(*) AS n FROM tr JOIN sel2 ON tr.poss_uid = sel2.poss_uid GROUP BY ALL),
ks AS (SELECT DISTINCT fraction, rep, np FROM sel2),
sf AS (SELECT ks.fraction, ks.rep, ks.np, qq.i, qq.j, COALESCE(sc.n, 0) AS n, qq.q, qq.p_full, qq.ni, SUM(COALESCE(sc.n, 0)) OVER (PARTITION BY ks.fraction, ks.rep, qq.i) AS sni
  FROM ks CROSS JOIN qq LEFT JOIN sc ON sc.fraction = ks.fraction AND sc.rep = ks.rep AND sc.i = qq.i AND sc.j = qq.j),
er AS (SELECT fraction, rep, np, i, ni, MAX(ABS((n + 20 * q) / (sni + 20) - p_full)) AS e FROM sf GROUP BY ALL)
SELECT fraction, CAST(rep AS INTEGER) AS rep, np AS n_possessions, ROUND(SUM(e * ni) / SUM(ni), 6) AS err_weighted, ROUND(QUANTILE_CONT(e, 0.5), 6) AS err_median
FROM er GROUP BY fraction, rep, np"""))
def e10(spark, sf):
    tr = transitions(spark, sf)
    df = E.error_curve(tr, E.prior(E.count_cells(tr), SPACE), 20.0, [0.1, 0.4, 1.0], 2, 7, SPACE)
    return df.withColumns({"err_weighted": F.round("err_weighted", 6),
                           "err_median": F.round("err_median", 6)})


@query("e12_plateau_attenuation", sql(CV, """
, pl AS (SELECT team, MAX(score) - MIN(score) AS score_range FROM cv WHERE lam BETWEEN 20 AND 200 GROUP BY team),
atn AS (SELECT team, AVG(ni / (ni + 50)) AS mean_weight, SUM(ni / (ni + 50) * ni) / SUM(ni) AS mass_weight FROM rowsum GROUP BY team)
SELECT pl.team, ROUND(score_range, 6) AS score_range, score_range < 0.01 AS flat, ROUND(mean_weight, 6) AS mean_weight, ROUND(mass_weight, 6) AS mass_weight
FROM pl JOIN atn ON pl.team = atn.team"""))
def e12(spark, sf):
    flat = E.plateau(cv_table(spark, sf), "team", 20, 200)
    att = E.attenuation(cells(spark, sf), 50.0, ["team"])
    return flat.join(att, "team").select(
        "team", F.round("score_range", 6).alias("score_range"), "flat",
        F.round("mean_weight", 6).alias("mean_weight"), F.round("mass_weight", 6).alias("mass_weight"))


@query("e13_rate_shrinkage_cv", sql(TR, f""",
ids AS (SELECT DISTINCT team, poss_uid FROM tr),
fl AS (SELECT team, poss_uid, NTILE(5) OVER (PARTITION BY team ORDER BY {draw_sql("'3'", "poss_uid")}, poss_uid) - 1 AS fold FROM ids),
z AS (SELECT tr.team, fold, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS DOUBLE) AS h
  FROM tr JOIN fl ON tr.team = fl.team AND tr.poss_uid = fl.poss_uid WHERE action_type <> 'TERMINAL' GROUP BY 1, 2, 3),
t AS (SELECT *, SUM(h) OVER (PARTITION BY team, zone) - SUM(h) OVER (PARTITION BY team, zone, fold) AS h_tr, SUM(n) OVER (PARTITION BY team, zone) - SUM(n) OVER (PARTITION BY team, zone, fold) AS n_tr,
  (SUM(h) OVER (PARTITION BY zone) - SUM(h) OVER (PARTITION BY zone, team)) / (SUM(n) OVER (PARTITION BY zone) - SUM(n) OVER (PARTITION BY zone, team)) AS q FROM z),
l AS (SELECT CAST(UNNEST([0, 10, 50, 200, 1000]) AS DOUBLE) AS lam),
p AS (SELECT *, LEAST(GREATEST(CASE WHEN n_tr + lam > 0 THEN (h_tr + lam * q) / (n_tr + lam) ELSE q END, 1e-12), 1 - 1e-12) AS pi FROM t, l)
SELECT team, lam, ROUND(SUM(h * LN(pi) + (n - h) * LN(1 - pi)) / SUM(n), 6) AS score FROM p GROUP BY team, lam"""))
def e13(spark, sf):
    tr = transitions(spark, sf)
    fold = E.folds(tr.select("team", "poss_uid").distinct(), 5, 3, ["team"])
    z = tr.filter(F.col("action_type") != "TERMINAL").join(fold, ["team", "poss_uid"]).groupBy(
        "team", "fold", SPACE.zone_of_state(F.col("from_state")).alias("zone")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.col("under_pressure").cast("double")).alias("hits"))
    total = z.groupBy("zone").agg(F.sum("n").alias("N"), F.sum("hits").alias("H"))
    own = z.groupBy("team", "zone").agg(F.sum("n").alias("no"), F.sum("hits").alias("ho"))
    q = own.join(total, "zone").select(
        "team", "zone", ((F.col("H") - F.col("ho")) / (F.col("N") - F.col("no"))).alias("q"))
    return E.cv_rate(z.join(q, ["team", "zone"]), [0.0, 10.0, 50.0, 200.0, 1000.0], "team").withColumn(
        "score", F.round("score", 6))


# -- absorbing chains ------------------------------------------------------------------------
VALUES = CELLS + """,
qm AS MATERIALIZED (SELECT team, i, j, p FROM mle WHERE j < 80),
em AS (SELECT team, i, SUM(CASE WHEN j = 80 THEN p ELSE 0 END) AS g, SUM(CASE WHEN j = 81 THEN p ELSE 0 END) AS s, SUM(CASE WHEN j = 82 THEN p ELSE 0 END) AS l, SUM(CASE WHEN j = 83 THEN p ELSE 0 END) AS o FROM mle GROUP BY 1, 2),
it AS (SELECT 0 AS k, team, i, CAST(1 AS DOUBLE) AS t, g AS bg, s AS bs, l AS bl, o AS bo FROM em
  UNION ALL
  SELECT it.k + 1, em.team, em.i, 1 + COALESCE(SUM(q.p * it.t), 0), ANY_VALUE(em.g) + COALESCE(SUM(q.p * it.bg), 0), ANY_VALUE(em.s) + COALESCE(SUM(q.p * it.bs), 0),
    ANY_VALUE(em.l) + COALESCE(SUM(q.p * it.bl), 0), ANY_VALUE(em.o) + COALESCE(SUM(q.p * it.bo), 0)
  FROM it JOIN qm q ON q.team = it.team AND q.j = it.i JOIN em ON em.team = q.team AND em.i = q.i WHERE it.k < 150 GROUP BY it.k, em.team, em.i),
vals AS MATERIALIZED (SELECT em.team, em.i, MAX_BY(COALESCE(it.t, 1), it.k) AS t, MAX_BY(COALESCE(bg, g), it.k) AS bg, MAX_BY(COALESCE(bs, s), it.k) AS bs, MAX_BY(COALESCE(bl, l), it.k) AS bl, MAX_BY(COALESCE(bo, o), it.k) AS bo
  FROM em LEFT JOIN it ON it.team = em.team AND it.i = em.i GROUP BY 1, 2)"""


def rsql(base, body):
    return "WITH RECURSIVE " + base.strip() + body


@query("c01_chain_checks", rsql(CELLS, """,
qm AS MATERIALIZED (SELECT team, i, j, p FROM mle WHERE j < 80),
pw AS (SELECT 0 AS k, team, i, CAST(1 AS DOUBLE) AS x FROM (SELECT DISTINCT team, i FROM mle)
  UNION ALL SELECT pw.k + 1, q.team, q.i, SUM(q.p * pw.x) / 0.75 FROM pw JOIN qm q ON q.team = pw.team AND q.j = pw.i WHERE pw.k < 2500 GROUP BY pw.k, q.team, q.i),
nm AS (SELECT team, k, SUM(x) AS s FROM pw GROUP BY 1, 2),
rh AS (SELECT team, 0.75 * MAX(CASE WHEN k = 2500 THEN s END) / MAX(CASE WHEN k = 2499 THEN s END) AS rho FROM nm GROUP BY 1),
rw AS (SELECT team, i, SUM(p) AS a, SUM(CASE WHEN j < 80 THEN p ELSE 0 END) AS q FROM mle GROUP BY 1, 2)
SELECT rw.team, ROUND(ANY_VALUE(rho), 3) AS rho, ROUND(MAX(ABS(a - 1)), 6) AS row_error, ROUND(MAX(q), 6) AS inf_norm FROM rw JOIN rh ON rh.team = rw.team GROUP BY 1"""))
def c01(spark, sf):
    d = C.checks(matrix(spark, sf), ["team"], SPACE)
    return d.withColumns({"rho": F.round("rho", 3), "row_error": F.round("row_error", 6), "inf_norm": F.round("inf_norm", 6)})


@query("c02_state_values", rsql(VALUES, """
SELECT team, CAST(i AS BIGINT) AS state, ROUND(t, 6) AS expected_length, ROUND(bg, 6) AS p_goal, ROUND(bs, 6) AS p_shot_nogoal, ROUND(bl, 6) AS p_loss, ROUND(bo, 6) AS p_out FROM vals"""))
def c02(spark, sf):
    v = C.state_values(matrix(spark, sf), ["team"], SPACE)
    return v.select("team", "state", *[F.round(c, 6).alias(c) for c in v.columns[2:]])


@query("c03_threat_and_shot", rsql(VALUES, """
SELECT team, CAST(i AS BIGINT) AS state, ROUND(bg, 6) AS threat, ROUND(bg + bs, 6) AS shot_prob FROM vals"""))
def c03(spark, sf):
    v = C.state_values(matrix(spark, sf), ["team"], SPACE)
    return v.select("team", "state", F.round("p_goal", 6).alias("threat"),
                    F.round(F.col("p_goal") + F.col("p_shot_nogoal"), 6).alias("shot_prob"))


VISITS = CELLS + FIRST + """,
qm AS MATERIALIZED (SELECT team, i, j, p FROM mle WHERE j < 80),
it AS (SELECT 0 AS k, alpha.team, i, a / atot AS m FROM alpha JOIN asum ON alpha.team = asum.team
  UNION ALL SELECT it.k + 1, q.team, q.j, SUM(it.m * q.p) FROM it JOIN qm q ON q.team = it.team AND q.i = it.i WHERE it.k < 150 GROUP BY it.k, q.team, q.j)"""


@query("c04_visit_distribution", rsql(VISITS, """,
v AS (SELECT team, i, SUM(m) AS v FROM it GROUP BY 1, 2)
SELECT team, CAST(i AS BIGINT) AS state, ROUND(v, 6) AS visits, ROUND(v / SUM(v) OVER (PARTITION BY team), 6) AS share FROM v"""))
def c04(spark, sf):
    v = C.visits(matrix(spark, sf), alpha(spark, sf), ["team"], SPACE)
    return v.select("team", "state", F.round("visits", 6).alias("visits"), F.round("share", 6).alias("share"))


@query("c05_zone_collapse", rsql(VALUES, """
, z AS (SELECT v.team, CAST(FLOOR(v.i / 4) AS BIGINT) AS zone, bg, ni FROM vals v JOIN rowsum r ON r.team = v.team AND r.i = v.i)
SELECT team, zone, ROUND(AVG(bg), 6) AS mean_threat, ROUND(SUM(bg * ni) / SUM(ni), 6) AS mass_threat FROM z GROUP BY 1, 2"""))
def c05(spark, sf):
    c = cells(spark, sf)
    mass = c.groupBy("team", F.col("i").alias("state")).agg(F.sum("n").alias("ni"))
    v = C.state_values(E.mle(c, ["team"]), ["team"], SPACE).join(mass, ["team", "state"])
    mean = C.collapse_zones(v, ["team"], SPACE, "p_goal")
    weighted = C.collapse_zones(v, ["team"], SPACE, "p_goal", "ni").withColumnRenamed("p_goal", "w")
    return mean.join(weighted, ["team", "zone"]).select(
        "team", "zone", F.round("p_goal", 6).alias("mean_threat"), F.round("w", 6).alias("mass_threat"))


@query("c06_start_distribution", sql(CELLS + FIRST, """
SELECT alpha.team, i, a, ROUND(a / atot, 6) AS share FROM alpha JOIN asum ON alpha.team = asum.team"""))
def c06(spark, sf):
    from pyspark.sql import Window
    a = alpha(spark, sf)
    share = F.col("a") / F.sum("a").over(Window.partitionBy("team"))
    return a.select("team", "i", "a", F.round(share, 6).alias("share"))


SCALARS = VALUES + FIRST + """,
scal AS (SELECT v.team, SUM(a * t) / SUM(a) AS e_t, SUM(a * bg) / SUM(a) AS p_goal, SUM(a * (bg + bs)) / SUM(a) AS p_shot
  FROM alpha JOIN vals v ON v.team = alpha.team AND v.i = alpha.i GROUP BY v.team)"""


def team_scalars(spark, sf):
    return C.scalars(matrix(spark, sf), alpha(spark, sf), ["team"], SPACE)


@query("c07_derived_scalars", rsql(SCALARS, """
SELECT team, ROUND(e_t, 6) AS e_t, ROUND(p_goal, 6) AS p_goal, ROUND(p_shot, 6) AS p_shot FROM scal"""))
def c07(spark, sf):
    s = team_scalars(spark, sf)
    return s.select("team", *[F.round(c, 6).alias(c) for c in ("e_t", "p_goal", "p_shot")])


@query("c08_pair_common_mass", rsql(VALUES, """,
pw AS (SELECT x.team AS a, y.team AS b, x.i, x.ni + y.ni AS w FROM rowsum x JOIN rowsum y ON x.i = y.i AND x.team < y.team)
SELECT a, b, ROUND(SUM(w * va.t) / SUM(w), 6) AS e_t_a, ROUND(SUM(w * vb.t) / SUM(w), 6) AS e_t_b, ROUND(SUM(w * va.bg) / SUM(w), 6) AS threat_a, ROUND(SUM(w * vb.bg) / SUM(w), 6) AS threat_b
FROM pw JOIN vals va ON va.team = a AND va.i = pw.i JOIN vals vb ON vb.team = b AND vb.i = pw.i GROUP BY a, b"""))
def c08(spark, sf):
    c = cells(spark, sf)
    v = C.state_values(E.mle(c, ["team"]), ["team"], SPACE).join(
        c.groupBy("team", F.col("i").alias("state")).agg(F.sum("n").alias("ni")), ["team", "state"])

    def side(s):
        return v.select("state", F.col("team").alias(s), F.col("expected_length").alias(f"t_{s}"),
                        F.col("p_goal").alias(f"g_{s}"), F.col("ni").alias(f"n_{s}"))
    both = side("a").join(side("b"), "state").filter("a < b").withColumn("w", F.expr("n_a + n_b"))

    def mean(c):
        return F.round(F.sum(F.col("w") * F.col(c)) / F.sum("w"), 6)
    return both.groupBy("a", "b").agg(mean("t_a").alias("e_t_a"), mean("t_b").alias("e_t_b"),
                                      mean("g_a").alias("threat_a"), mean("g_b").alias("threat_b"))


@query("c09_diagonal_removed", rsql(CELLS + FIRST + """,
od AS (SELECT team, i, SUM(CASE WHEN i <> j THEN n ELSE 0 END) AS off FROM cells GROUP BY 1, 2),
nd AS MATERIALIZED (SELECT c.team, c.i, c.j, n / CASE WHEN off > 0 THEN off ELSE n END AS p FROM cells c JOIN od ON od.team = c.team AND od.i = c.i WHERE c.i <> c.j OR off = 0),
i1 AS (SELECT 0 AS k, alpha.team, i, a / atot AS m FROM alpha JOIN asum ON alpha.team = asum.team
  UNION ALL SELECT i1.k + 1, q.team, q.j, SUM(i1.m * q.p) FROM i1 JOIN mle q ON q.team = i1.team AND q.i = i1.i WHERE q.j < 80 AND i1.k < 150 GROUP BY i1.k, q.team, q.j),
i2 AS (SELECT 0 AS k, alpha.team, i, a / atot AS m FROM alpha JOIN asum ON alpha.team = asum.team
  UNION ALL SELECT i2.k + 1, q.team, q.j, SUM(i2.m * q.p) FROM i2 JOIN nd q ON q.team = i2.team AND q.i = i2.i WHERE q.j < 80 AND i2.k < 150 GROUP BY i2.k, q.team, q.j)""", """,
a1 AS (SELECT team, SUM(m) AS e_t FROM i1 GROUP BY 1), a2 AS (SELECT team, SUM(m) AS e_t FROM i2 GROUP BY 1)
SELECT a1.team, ROUND(a1.e_t, 6) AS e_t, ROUND(a2.e_t, 6) AS e_t_moving, ROUND(1 - a2.e_t / a1.e_t, 6) AS permanence FROM a1 JOIN a2 ON a1.team = a2.team"""))
def c09(spark, sf):
    c, a = cells(spark, sf), alpha(spark, sf)
    kept = E.mle(c, ["team"]).withColumn("kind", F.lit("all"))
    gone = C.without_diagonal(c, ["team"]).withColumn("kind", F.lit("moving"))
    kinds = F.explode(F.array(F.lit("all"), F.lit("moving")))
    s = C.scalars(kept.unionByName(gone), a.withColumn("kind", kinds), ["team", "kind"], SPACE)
    wide = s.groupBy("team").agg(F.max(F.when(F.col("kind") == "all", F.col("e_t"))).alias("x"),
                                 F.max(F.when(F.col("kind") == "moving", F.col("e_t"))).alias("y"))
    return wide.select("team", F.round("x", 6).alias("e_t"), F.round("y", 6).alias("e_t_moving"),
                       F.round(1 - F.col("y") / F.col("x"), 6).alias("permanence"))


LAW = VISITS + """,
sa AS MATERIALIZED (SELECT team, k, SUM(m) AS s FROM it GROUP BY 1, 2),
sv AS (SELECT * FROM sa WHERE k <= 20),
law AS (SELECT team, k, s AS survival, LAG(s) OVER (PARTITION BY team ORDER BY k) - s AS pmf FROM sv UNION ALL SELECT team, 21, 0, s FROM sv WHERE k = 20)"""


@query("c10_phase_type_survival", rsql(LAW, """,
be AS (SELECT team, k, SUM(s) OVER (PARTITION BY team ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / s AS beyond FROM sa)
SELECT law.team, CAST(law.k AS BIGINT) AS k, ROUND(survival, 6) AS survival, ROUND(pmf, 6) AS pmf, CASE WHEN law.k <= 20 THEN ROUND(beyond, 4) END AS beyond FROM law LEFT JOIN be ON be.team = law.team AND be.k = law.k WHERE law.k >= 1"""))
def c10(spark, sf):
    s = C.survival(matrix(spark, sf), alpha(spark, sf), ["team"], SPACE, 20)
    return s.select("team", "k", F.round("survival", 6).alias("survival"), F.round("pmf", 6).alias("pmf"), F.round("beyond", 4).alias("beyond"))


@query("c11_observed_survival", sql(TR, """,
c AS (SELECT team, poss_uid, COUNT(*) AS n FROM tr GROUP BY 1, 2), k AS (SELECT DISTINCT team, n AS k FROM c)
SELECT c.team, CAST(k AS BIGINT) AS k, ROUND(AVG(CASE WHEN n > k THEN 1.0 ELSE 0.0 END), 6) AS observed FROM c JOIN k ON k.team = c.team GROUP BY 1, 2"""))
def c11(spark, sf):
    h = chains.length_histogram(transitions(spark, sf), ("team",))
    return C.observed_survival(h, ["team"]).withColumn("observed", F.round("observed", 6))


@query("c12_discrete_ks", rsql(LAW, """,
cond AS (SELECT team, k, pmf / SUM(pmf) OVER (PARTITION BY team) AS pmf FROM law WHERE k >= 2),
ln AS (SELECT team, poss_uid, COUNT(*) AS n FROM tr GROUP BY 1, 2),
ob AS (SELECT team, LEAST(n, 21) AS k, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY team) AS o FROM ln WHERE n >= 2 GROUP BY 1, 2),
g AS (SELECT cond.team, ABS(SUM(COALESCE(o, 0)) OVER w - SUM(pmf) OVER w) AS gap FROM cond LEFT JOIN ob ON ob.team = cond.team AND ob.k = cond.k WINDOW w AS (PARTITION BY cond.team ORDER BY cond.k))
SELECT team, ROUND(MAX(gap), 6) AS ks FROM g GROUP BY team"""))
def c12(spark, sf):
    law = C.survival(matrix(spark, sf), alpha(spark, sf), ["team"], SPACE, 20)
    h = chains.length_histogram(transitions(spark, sf), ("team",))
    return C.discrete_ks(h, law, ["team"], 2).withColumn("ks", F.round("ks", 6))


@query("c13_first_passage", rsql(CELLS + FIRST + """,
a0 AS (SELECT team, i, a / SUM(a) OVER (PARTITION BY team) AS m FROM alpha WHERE i < 64),
it AS (SELECT 0 AS k, team, i, m FROM a0
  UNION ALL SELECT it.k + 1, q.team, q.j, SUM(it.m * q.p) FROM it JOIN mle q ON q.team = it.team AND q.i = it.i WHERE it.i < 64 AND q.j < 80 AND it.k < 150 GROUP BY it.k, q.team, q.j)""", """
SELECT team, ROUND(SUM(m), 6) AS reach, ROUND(SUM(k * m) / SUM(m), 6) AS steps FROM it WHERE i >= 64 GROUP BY team"""))
def c13(spark, sf):
    r = C.first_passage(matrix(spark, sf), alpha(spark, sf), ["team"], SPACE, 4)
    return r.select("team", F.round("reach", 6).alias("reach"), F.round("steps", 6).alias("steps"))


@query("c14_quasi_stationary", rsql(CELLS + """,
qb AS MATERIALIZED (SELECT team, CAST(i / 4 AS BIGINT) AS i, CAST(j / 4 AS BIGINT) AS j, p FROM mle WHERE i % 4 = 0 AND j % 4 = 0 AND j < 80),
it AS (SELECT 0 AS k, team, i, CAST(1 AS DOUBLE) / 20 AS m FROM (SELECT DISTINCT team, i FROM qb)
  UNION ALL SELECT it.k + 1, q.team, q.j, SUM(it.m * q.p) FROM it JOIN qb q ON q.team = it.team AND q.i = it.i WHERE it.k < 80 GROUP BY it.k, q.team, q.j),
tot AS (SELECT team, k, SUM(m) AS s FROM it GROUP BY 1, 2),
lam AS (SELECT x.team, y.s / x.s AS l FROM tot x JOIN tot y ON x.team = y.team AND x.k = 79 AND y.k = 80)""", """
SELECT it.team, it.i AS zone, ROUND(m / s, 6) AS share, ROUND(l, 6) AS lambda1, ROUND(1 / (1 - l), 6) AS lifetime, TRUE AS irreducible
FROM it JOIN tot ON tot.team = it.team AND tot.k = it.k JOIN lam ON lam.team = it.team WHERE it.k = 80"""))
def c14(spark, sf):
    q = C.quasi_stationary(matrix(spark, sf), ["team"], SPACE)
    return q.select("team", "zone", F.round("share", 6).alias("share"), F.round("lambda1", 6).alias("lambda1"),
                    F.round("lifetime", 6).alias("lifetime"), "irreducible")


@query("c15_phase_constancy", sql(TR, """
SELECT team, AVG(CASE WHEN from_state % 4 = to_state % 4 THEN 1.0 ELSE 0.0 END) AS constancy, CAST(COUNT(*) AS BIGINT) AS n FROM tr WHERE NOT is_absorbing GROUP BY team"""))
def c15(spark, sf):
    return C.phase_constancy(transitions(spark, sf), SPACE, ["team"])


@query("c16_example_possession", sql(TR, """,
p AS (SELECT team, poss_uid, MIN(CASE WHEN NOT is_absorbing AND to_state >= 64 THEN event_index END) - MIN(event_index) + 1 AS steps FROM tr GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY ABS(steps - 3), steps, poss_uid) AS k FROM p WHERE steps IS NOT NULL)
SELECT team, poss_uid, steps FROM r WHERE k = 1"""))
def c16(spark, sf):
    return C.example_possession(transitions(spark, sf), SPACE, ["team"], 3.0, 4)


@query("c17_open_play_flow", sql(TR, """
SELECT team, CAST(FLOOR(from_state / 4) AS BIGINT) AS from_zone, CAST(CASE WHEN is_absorbing THEN to_state - 60 ELSE FLOOR(to_state / 4) END AS BIGINT) AS to_zone, CAST(COUNT(*) AS BIGINT) AS n
FROM tr WHERE from_state % 4 = 0 GROUP BY 1, 2, 3"""))
def c17(spark, sf):
    return C.zone_flow(transitions(spark, sf), SPACE, "open", ["team"])


@query("c18_zone_occupancy", sql(TR, """,
z AS (SELECT team, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone, CAST(COUNT(*) AS BIGINT) AS n FROM tr WHERE action_type <> 'TERMINAL' GROUP BY 1, 2)
SELECT team, zone, n, ROUND(n / SUM(n) OVER (PARTITION BY team), 6) AS share FROM z"""))
def c18(spark, sf):
    return C.occupancy(transitions(spark, sf), SPACE, ["team"]).withColumn("share", F.round("share", 6))
