"""Resampling, tests and multiplicity (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.draws import SPAN, chunk_of, poisson1_steps
from chainspark.operators import absorb as C
from chainspark.operators import chains
from chainspark.operators import contrast as X
from chainspark.operators import estimate as E
from chainspark.operators import relations as Q
from chainspark.operators import resample as R
from chainspark.plans.estimate_queries import CELLS, GRID, LAW, alpha, cells, matrix, rsql
from chainspark.plans.registry import query
from chainspark.session import cut_lineage
from chainspark.plans.tables import (FA, SPACE, TR, draw_sql, moves, sql, transitions)


def rounded(df, keys, cols):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in cols])


def league_prior(spark, sf):
    return E.prior(E.count_cells(transitions(spark, sf)), SPACE)


LEAGUE_Q = """,
lgrid AS (SELECT a.i, b.j FROM (SELECT UNNEST(range(80)) AS i) a, (SELECT UNNEST(range(84)) AS j) b),
lc AS (SELECT from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2),
lq AS MATERIALIZED (SELECT g.i, g.j, (COALESCE(n, 0) + CAST(1 AS DOUBLE) / 84) / (SUM(COALESCE(n, 0)) OVER (PARTITION BY g.i) + 1) AS q FROM lgrid g LEFT JOIN lc ON lc.i = g.i AND lc.j = g.j)"""


def weights_sql(table: str, stratum: str, block: str, B: int, seed: int) -> str:
    return f""",
blk AS (SELECT DISTINCT {stratum} AS s, {block} AS k FROM {table}),
rk AS MATERIALIZED (SELECT s, k, ROW_NUMBER() OVER (PARTITION BY s ORDER BY {draw_sql(f"'{seed}'", 'k')}, k) - 1 AS rnk, COUNT(*) OVER (PARTITION BY s) AS n FROM blk),
sl AS (SELECT s, b, {draw_sql(f"'{seed}'", 's', 'b', 'rnk')} % n AS rnk FROM rk, (SELECT UNNEST(range(1, {B + 1})) AS b)),
wt AS MATERIALIZED (SELECT rk.s, rk.k, x.b, x.w FROM (SELECT s, rnk, b, COUNT(*) AS w FROM sl GROUP BY ALL) x JOIN rk ON rk.s = x.s AND rk.rnk = x.rnk UNION ALL SELECT s, k, 0, 1 FROM rk)"""


# -- resampling kernels ---------------------------------------------------------------------------
PM = TR + """,
pm AS MATERIALIZED (SELECT team, match_id, CAST(COUNT(DISTINCT poss_uid) AS DOUBLE) AS n, CAST(SUM(CASE WHEN to_state = 80 THEN 1 ELSE 0 END) AS DOUBLE) AS g FROM tr GROUP BY 1, 2)"""
BOOT = PM + weights_sql("pm", "team", "match_id", 40, 11) + """,
reps AS MATERIALIZED (SELECT pm.team, b, SUM(w * g) / SUM(w * n) AS rate FROM pm JOIN wt ON wt.s = pm.team AND wt.k = pm.match_id GROUP BY 1, 2)"""


def per_match(spark, sf):
    return transitions(spark, sf).groupBy("team", "match_id").agg(
        F.countDistinct("poss_uid").cast("double").alias("n"),
        F.sum((F.col("to_state") == 80).cast("double")).alias("g"))


def goal_rate_reps(spark, sf, B=40, seed=11):
    pm = per_match(spark, sf)
    w = R.multinomial_weights(pm, ["team"], "match_id", B, seed)
    s = R.replicate_sums(pm, w, ["team", "match_id"], ["team"], ["n", "g"])
    return s.withColumn("rate", F.col("g") / F.col("n"))


@query("i05_block_bootstrap", sql(BOOT, " SELECT team, CAST(b AS INTEGER) AS b, ROUND(rate, 6) AS rate FROM reps"))
def i05(spark, sf):
    return goal_rate_reps(spark, sf).select("team", "b", F.round("rate", 6).alias("rate"))


@query("j12_replicate_weights", sql(BOOT, " SELECT s AS team, k AS match_id, CAST(b AS INTEGER) AS b, CAST(w AS BIGINT) AS w FROM wt"))
def j12(spark, sf):
    w = R.multinomial_weights(per_match(spark, sf), ["team"], "match_id", 40, 11).withColumn("x", F.explode("w"))
    return w.select("team", "match_id", "x.b", "x.w")


@query("j13_grid_completion", sql(GRID, " SELECT team, i, CAST(COUNT(*) AS BIGINT) AS cells, SUM(n) AS n, CAST(SUM(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM full_c GROUP BY 1, 2"))
def j13(spark, sf):
    full = E.complete(cells(spark, sf), SPACE, ["team"])
    return full.groupBy("team", "i").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"),
                                         F.sum((F.col("n") == 0).cast("bigint")).alias("zeros"))


@query("j14_lambda_grid", sql(CELLS, """,
l AS (SELECT CAST(UNNEST([1, 10, 100]) AS DOUBLE) AS lam)
SELECT team, lam, ROUND(AVG(ni / (ni + lam)), 6) AS mean_weight FROM rowsum, l GROUP BY 1, 2"""))
def j14(spark, sf):
    rows = cells(spark, sf).groupBy("team", "i").agg(F.sum("n").alias("ni"))
    lam = F.explode(F.array(F.lit(1.0), F.lit(10.0), F.lit(100.0)))
    return rows.withColumn("lam", lam).groupBy("team", "lam").agg(
        F.round(F.avg(F.col("ni") / (F.col("ni") + F.col("lam"))), 6).alias("mean_weight"))


@query("i05_poisson_bootstrap", sql(PM, f""",
u AS (SELECT team, match_id, n, g, b, CASE WHEN b = 0 THEN 1 ELSE (SELECT COUNT(*) FROM (SELECT UNNEST({poisson1_steps()}) AS c) WHERE (CAST({draw_sql("'5'", "b", "match_id")} AS DOUBLE) + 0.5) / {float(SPAN)!r} > c) END AS w
  FROM pm, (SELECT UNNEST(range(0, 11)) AS b))
SELECT team, CAST(b AS INTEGER) AS b, CAST(SUM(w * n) AS DOUBLE) AS n, CAST(SUM(w * g) AS DOUBLE) AS g FROM u GROUP BY 1, 2"""))
def i05b(spark, sf):
    d = R.poisson_weights(per_match(spark, sf), "match_id", 10, 5).withColumn("w", R.opened("w"))
    return d.groupBy("team", F.col("w.b").alias("b")).agg(
        F.sum(F.col("n") * F.col("w.w")).alias("n"), F.sum(F.col("g") * F.col("w.w")).alias("g"))


PERM = TR + f""",
lb AS (SELECT DISTINCT team, match_id, coach FROM tr),
sb AS (SELECT team, coach, ROW_NUMBER() OVER (PARTITION BY team ORDER BY coach, match_id) AS slot FROM lb),
sp AS (SELECT team, match_id, b, ROW_NUMBER() OVER (PARTITION BY team, b ORDER BY {draw_sql("'9'", "b", "match_id")}, match_id) AS slot FROM lb, (SELECT UNNEST(range(1, 13)) AS b)),
pl AS MATERIALIZED (SELECT sp.team, sp.match_id, sp.b, sb.coach FROM sp JOIN sb ON sb.team = sp.team AND sb.slot = sp.slot UNION ALL SELECT team, match_id, 0, coach FROM lb)"""


def permuted(spark, sf, B=12):
    lb = transitions(spark, sf).select("team", "match_id", "coach").distinct()
    return R.permutation_labels(lb, ["team"], "match_id", "coach", B, 9)


@query("i06_permutation_labels", sql(PERM, " SELECT team, match_id, CAST(b AS INTEGER) AS b, coach FROM pl"))
def i06(spark, sf):
    return permuted(spark, sf)


@query("i07_basic_interval", sql(BOOT, """,
t AS (SELECT team, MAX(CASE WHEN b = 0 THEN rate END) AS point, QUANTILE_CONT(rate, 0.025) FILTER (WHERE b > 0) AS lo, QUANTILE_CONT(rate, 0.975) FILTER (WHERE b > 0) AS hi, STDDEV_SAMP(rate) FILTER (WHERE b > 0) AS se FROM reps GROUP BY team)
SELECT team, ROUND(point, 6) AS point, ROUND(2 * point - hi, 6) AS lo, ROUND(2 * point - lo, 6) AS hi, ROUND(se, 6) AS se FROM t"""))
def i07(spark, sf):
    return rounded(R.interval(goal_rate_reps(spark, sf), ["team"], "rate"), ["team"], ["point", "lo", "hi", "se"])


PAIR_REPS = BOOT + """,
pr AS MATERIALIZED (SELECT x.team AS a, y.team AS bb, x.b, x.rate - y.rate AS d FROM reps x JOIN reps y ON x.b = y.b AND x.team < y.team),
pt AS (SELECT a, bb, d AS t FROM pr WHERE b = 0)"""


def pair_reps(spark, sf):
    r = goal_rate_reps(spark, sf).select("team", "b", "rate")
    x = r.select(F.col("team").alias("a"), "b", F.col("rate").alias("ra"))
    y = r.select(F.col("team").alias("c"), "b", F.col("rate").alias("rc"))
    return x.join(y, "b").filter("a < c").withColumn("d", F.col("ra") - F.col("rc"))


@query("i08_p_by_inversion", sql(PAIR_REPS, """
SELECT pr.a, pr.bb AS c, ROUND(LEAST(1, 2.0 * (1 + SUM(CASE WHEN (t >= 0 AND d - t >= t) OR (t < 0 AND d - t <= t) THEN 1 ELSE 0 END)) / 41), 6) AS p
FROM pr JOIN pt ON pr.a = pt.a AND pr.bb = pt.bb WHERE b > 0 GROUP BY 1, 2"""))
def i08(spark, sf):
    return rounded(R.interval(pair_reps(spark, sf), ["a", "c"], "d"), ["a", "c"], ["p"])


@query("i08_p_achieved", sql(PAIR_REPS, """
SELECT pr.a, pr.bb AS c, ROUND(LEAST(1, 2.0 * (1 + LEAST(SUM(CASE WHEN d <= 2 * t THEN 1 ELSE 0 END), SUM(CASE WHEN d >= 2 * t THEN 1 ELSE 0 END))) / 41), 6) AS p
FROM pr JOIN pt ON pr.a = pt.a AND pr.bb = pt.bb WHERE b > 0 GROUP BY 1, 2"""))
def i08b(spark, sf):
    return rounded(R.achieved_p(pair_reps(spark, sf), ["a", "c"], "d"), ["a", "c"], ["p"])


# -- fingerprints ------------------------------------------------------------------------------------
G2 = GRID + """,
g2 AS MATERIALIZED (SELECT team, i, MAX(ni) AS n, 2 * SUM(CASE WHEN n > 0 THEN n * LN(n / (ni * q)) ELSE 0 END) AS g2 FROM qx WHERE ni > 0 GROUP BY 1, 2)"""


def g2_table(spark, sf):
    c = cells(spark, sf)
    return X.g2_rows(c, E.prior_without(c, "team", SPACE), ["team"], ["team", "i", "j"])


@query("i01_g2_rows", sql(G2, " SELECT team, i, n, ROUND(g2, 6) AS g2 FROM g2"))
def i01(spark, sf):
    return rounded(g2_table(spark, sf), ["team", "i", "n"], ["g2"])


@query("i02_fingerprint", sql(TR, LEAGUE_Q + f""",
fo AS (SELECT from_state AS i, to_state AS j, COUNT(*) AS n FROM tr WHERE team = 'T1' GROUP BY 1, 2),
og AS (SELECT fo.i, MAX(ni) AS n, 2 * SUM(fo.n * LN(fo.n / (ni * q))) AS g2 FROM (SELECT *, SUM(n) OVER (PARTITION BY i) AS ni FROM fo) fo JOIN lq ON lq.i = fo.i AND lq.j = fo.j GROUP BY 1),
m AS (SELECT COUNT(DISTINCT poss_uid) AS m FROM tr WHERE team = 'T1'),
br AS (SELECT poss_uid, ROW_NUMBER() OVER (ORDER BY {draw_sql("'21'", "poss_uid")}, poss_uid) - 1 AS rnk, COUNT(*) OVER () AS n FROM (SELECT DISTINCT poss_uid FROM tr WHERE team <> 'T1')),
sl AS (SELECT b, s, {draw_sql("'21'", "b", "s")} % (SELECT MAX(n) FROM br) AS rnk FROM (SELECT UNNEST(range(1, 20)) AS b), (SELECT UNNEST(range((SELECT m FROM m))) AS s)),
dr AS (SELECT b, poss_uid FROM sl JOIN br ON br.rnk = sl.rnk),
nc AS (SELECT b, from_state AS i, to_state AS j, COUNT(*) AS n FROM tr JOIN dr ON dr.poss_uid = tr.poss_uid GROUP BY 1, 2, 3),
ng AS (SELECT b, nc.i, 2 * SUM(nc.n * LN(nc.n / (ni * q))) AS g2 FROM (SELECT *, SUM(n) OVER (PARTITION BY b, i) AS ni FROM nc) nc JOIN lq ON lq.i = nc.i AND lq.j = nc.j GROUP BY 1, 2),
ht AS (SELECT og.i, og.n, og.g2, COALESCE(SUM(CASE WHEN ng.g2 >= og.g2 THEN 1 ELSE 0 END), 0) AS k FROM og LEFT JOIN ng ON ng.i = og.i GROUP BY 1, 2, 3),
tp AS (SELECT i, n, g2, n >= 15 AS tested, CASE WHEN n >= 15 THEN (1 + k) / 20.0 ELSE 1 END AS p FROM ht),
rk2 AS (SELECT *, SUM(CASE WHEN tested THEN 1 ELSE 0 END) OVER () AS m, ROW_NUMBER() OVER (PARTITION BY tested ORDER BY p DESC) AS back FROM tp),
qq AS (SELECT *, CASE WHEN tested THEN LEAST(1, MIN(p * m / (m - back + 1)) OVER (PARTITION BY tested ORDER BY back)) ELSE 1 END AS q FROM rk2),
fin AS (SELECT *, MIN(q) OVER (PARTITION BY tested, p) AS qv FROM qq)
SELECT i, CAST(n AS DOUBLE) AS n, ROUND(g2, 6) AS g2, tested, ROUND(p, 6) AS p, ROUND(qv, 6) AS q, tested AND qv <= 0.05 AS rejected FROM fin"""))
def i02(spark, sf):
    tr = transitions(spark, sf)
    own = F.col("team") == "T1"
    d = X.fingerprint(tr.filter(own), tr.filter(~own), league_prior(spark, sf), 19, 21)
    return d.select("i", "n", F.round("g2", 6).alias("g2"), "tested", F.round("p", 6).alias("p"),
                    F.round("q", 6).alias("q"), "rejected")


DIFFS = TR + LEAGUE_Q + """,
pmx AS (SELECT CASE WHEN team = 'T1' THEN 'focus' ELSE 'base' END AS role, match_id, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2, 3, 4)""" + weights_sql(
    "pmx", "role", "match_id", 12, 4) + """,
rc AS (SELECT b, i, j, SUM(CASE WHEN role = 'focus' THEN w * n ELSE 0 END) AS f, SUM(CASE WHEN role = 'base' THEN w * n ELSE 0 END) AS g FROM pmx JOIN wt ON wt.s = role AND wt.k = match_id GROUP BY 1, 2, 3),
fr AS (SELECT bs.b, lq.i, lq.j, q, COALESCE(f, 0) AS f, COALESCE(g, 0) AS g, SUM(COALESCE(f, 0)) OVER (PARTITION BY bs.b, lq.i) AS fi, SUM(COALESCE(g, 0)) OVER (PARTITION BY bs.b, lq.i) AS gi
  FROM (SELECT DISTINCT b FROM rc) bs CROSS JOIN lq LEFT JOIN rc ON rc.b = bs.b AND rc.i = lq.i AND rc.j = lq.j),
pb AS (SELECT *, CASE WHEN gi > 0 THEN g / gi ELSE q END AS p0 FROM fr),
df AS MATERIALIZED (SELECT b, i, j, (f + 20 * p0) / (fi + 20) - p0 AS d FROM pb),
di AS (SELECT i, j, MAX(CASE WHEN b = 0 THEN d END) AS point, QUANTILE_CONT(d, 0.025) FILTER (WHERE b > 0) AS ql, QUANTILE_CONT(d, 0.975) FILTER (WHERE b > 0) AS qh FROM df GROUP BY 1, 2),
ci AS (SELECT i, j, point, 2 * point - qh AS lo, 2 * point - ql AS hi FROM di)"""


def diff_intervals(spark, sf):
    role = F.when(F.col("team") == "T1", "focus").otherwise("base")
    c = E.count_cells(transitions(spark, sf).withColumn("role", role), ("role", "match_id"))
    w = R.multinomial_weights(c, ["role"], "match_id", 12, 4)
    reps = R.replicate_sums(c, w, ["role", "match_id"], ["role", "i", "j"], ["n"])
    d = X.cell_differences(reps, league_prior(spark, sf), 20.0, SPACE, ["b"])
    return R.interval(d, ["i", "j"], "diff")


@query("i03_cell_difference_ci", sql(DIFFS, " SELECT i, j, ROUND(point, 6) AS point, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi FROM ci WHERE ABS(point) > 1e-9"))
def i03(spark, sf):
    return rounded(diff_intervals(spark, sf).filter("abs(point) > 1e-9"), ["i", "j"], ["point", "lo", "hi"])


@query("o01_top_cells", sql(DIFFS, " SELECT i, j, ROUND(point, 6) AS point, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi FROM ci WHERE lo > 0 OR hi < 0 ORDER BY ROUND(ABS(point), 9) DESC, i, j LIMIT 20"))
def o01(spark, sf):
    d = diff_intervals(spark, sf).filter("lo > 0 or hi < 0")
    return rounded(Q.top_k(d, [F.desc(F.round(F.abs("point"), 9)), F.col("i"), F.col("j")], 20), ["i", "j"],
                   ["point", "lo", "hi"])


@query("o02_top_states", sql(G2, " SELECT team, i, n, ROUND(g2, 6) AS g2 FROM g2 WHERE n >= 15 ORDER BY ROUND(g2, 6) DESC, team, i LIMIT 15"))
def o02(spark, sf):
    d = rounded(g2_table(spark, sf).filter("n >= 15"), ["team", "i", "n"], ["g2"])
    return Q.top_k(d, [F.desc("g2"), F.col("team"), F.col("i")], 15)


# -- contexts ------------------------------------------------------------------------------------------
CTX = TR + LEAGUE_Q + """,
cc AS (SELECT score_state AS lv, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2, 3),
cf AS (SELECT l.lv, lq.i, lq.j, q, COALESCE(n, 0) AS n, SUM(COALESCE(n, 0)) OVER (PARTITION BY l.lv, lq.i) AS ni FROM (SELECT DISTINCT lv FROM cc) l CROSS JOIN lq LEFT JOIN cc ON cc.lv = l.lv AND cc.i = lq.i AND cc.j = lq.j),
cp AS (SELECT lv, i, j, ni, (n + 50 * q) / (ni + 50) AS p FROM cf),
cr AS (SELECT x.lv AS a, y.lv AS b, x.i, 0.5 * SUM(ABS(x.p - y.p)) AS tv, MAX(x.ni) AS na, MAX(y.ni) AS nb FROM cp x JOIN cp y ON x.i = y.i AND x.j = y.j AND x.lv < y.lv GROUP BY 1, 2, 3)"""


@query("i04_context_contrast", sql(CTX, " SELECT a, b, ROUND(SUM(tv * (na + nb)) / SUM(na + nb), 6) AS tv_weighted, ROUND(MAX(tv), 6) AS tv_max, SUM(na) AS n_a, SUM(nb) AS n_b FROM cr GROUP BY 1, 2"))
def i04(spark, sf):
    c = E.count_cells(transitions(spark, sf), ("score_state",))
    d = X.context_contrast(c, league_prior(spark, sf), 50.0, "score_state", SPACE)
    return d.select("a", "b", F.round("tv_weighted", 6).alias("tv_weighted"), F.round("tv_max", 6).alias("tv_max"), "n_a", "n_b")


def null_summary_sql(reps: str, keys: str, value: str, observed: str | None = None) -> str:
    """Columns of a permutation summary over ``reps`` (keys, b, value); several values count as ties within 1e-12."""
    on = " AND ".join(f"r.{k.strip()} = o.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {own}, ROUND(MAX(o.w), 6) AS observed, ROUND(quantile_cont(r.v, 0.5), 6) AS null_median, ROUND(quantile_cont(r.v, 0.95), 6) AS null_p95,
 ROUND(CASE WHEN stddev_pop(r.v) > 0 THEN (MAX(o.v) - AVG(r.v)) / stddev_pop(r.v) END, 4) AS z, ROUND(MAX(o.v) - quantile_cont(r.v, 0.5), 6) AS excess, (COUNT(*) FILTER (r.v >= o.v - 1e-12) + 1.0::DOUBLE) / (COUNT(r.v) + 1) AS p
FROM (SELECT {keys}, {value} AS v, {observed or value} AS w FROM {reps} WHERE b = 0) o JOIN (SELECT {keys}, {value} AS v FROM {reps} WHERE b > 0) r ON {on} GROUP BY {own}"""


def null_summary(reps, keys, value, two_sided=False):
    p = R.permutation_p(reps, keys, value, two_sided)
    return p.withColumns({c: F.round(c, 4 if c == "z" else 6) for c in ("observed", "null_median", "null_p95", "z", "excess")})


@query("i11_context_null", sql(TR, LEAGUE_Q + f""",
lb AS MATERIALIZED (SELECT poss_uid, MIN_BY(score_state, event_index) AS lv FROM tr GROUP BY 1),
sb AS (SELECT lv, ROW_NUMBER() OVER (ORDER BY lv, poss_uid) AS slot FROM lb),
sp AS (SELECT poss_uid, b, ROW_NUMBER() OVER (PARTITION BY b ORDER BY {draw_sql("'31'", "b", "poss_uid")}, poss_uid) AS slot FROM lb, (SELECT UNNEST(range(1, 9)) AS b)),
pl AS MATERIALIZED (SELECT poss_uid, b, lv FROM sp JOIN sb ON sb.slot = sp.slot UNION ALL SELECT poss_uid, 0, lv FROM lb),
cc AS MATERIALIZED (SELECT b, lv, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr JOIN pl ON pl.poss_uid = tr.poss_uid GROUP BY 1, 2, 3, 4),
cf AS (SELECT l.b, l.lv, lq.i, lq.j, q, COALESCE(n, 0) AS n, SUM(COALESCE(n, 0)) OVER (PARTITION BY l.b, l.lv, lq.i) AS ni FROM (SELECT DISTINCT b, lv FROM cc) l CROSS JOIN lq LEFT JOIN cc ON cc.b = l.b AND cc.lv = l.lv AND cc.i = lq.i AND cc.j = lq.j),
cp AS MATERIALIZED (SELECT b, lv, i, j, ni, (n + 50 * q) / (ni + 50) AS p FROM cf),
cr AS (SELECT x.b, x.lv AS a, y.lv AS level_b, x.i, 0.5 * SUM(ABS(x.p - y.p)) AS tv, MAX(x.ni) AS na, MAX(y.ni) AS nb FROM cp x JOIN cp y ON x.b = y.b AND x.i = y.i AND x.j = y.j AND x.lv < y.lv GROUP BY 1, 2, 3, 4),
rp AS MATERIALIZED (SELECT a, level_b, b, SUM(tv * (na + nb)) / SUM(na + nb) AS t FROM cr GROUP BY 1, 2, 3)""" + null_summary_sql("rp", "a, level_b", "t")))
def i11(spark, sf):
    tr = transitions(spark, sf).withColumn("all", F.lit("all"))
    label = tr.groupBy("all", "poss_uid").agg(F.min_by("score_state", "event_index").alias("score_state"))
    perm = R.permutation_labels(label, ["all"], "poss_uid", "score_state", 8, 31)
    own = E.count_cells(tr, ("poss_uid",))
    # both sides grow with the possessions, whatever their files suggest
    c = own.join(perm.hint("merge"), "poss_uid").groupBy("b", "score_state", "i", "j").agg(F.sum("n").alias("n"))
    d = X.context_contrast(c.withColumnRenamed("b", "rep"), league_prior(spark, sf), 50.0, "score_state",
                           SPACE, ["rep"])
    d = d.withColumnRenamed("b", "level_b").withColumnRenamed("rep", "b")
    return null_summary(d, ["a", "level_b"], "tv_weighted")


# -- multiplicity ----------------------------------------------------------------------------------------
PV = G2 + """, pv AS MATERIALIZED (SELECT team, i, ROUND(EXP(-g2 / 15), 6) AS p, n >= 15 AS tested FROM g2)"""
BH_Q = """,
t AS (SELECT * FROM pv WHERE tested), f AS (SELECT team, p, COUNT(*) AS c FROM t GROUP BY 1, 2),
r AS (SELECT *, SUM(c) OVER (PARTITION BY team ORDER BY p) AS k, SUM(c) OVER (PARTITION BY team) AS m FROM f),
q AS (SELECT team, p, MIN(p * m / k{0}) OVER (PARTITION BY team ORDER BY p DESC) AS q FROM r)
SELECT pv.team, i, pv.p, ROUND(CASE WHEN tested THEN LEAST(1, q) ELSE 1 END, 6) AS q, tested AND LEAST(1, COALESCE(q, 1)) <= 0.05 AS rejected FROM pv LEFT JOIN q ON q.team = pv.team AND q.p = pv.p AND tested"""


def p_table(spark, sf):
    return g2_table(spark, sf).select("team", "i", F.round(F.exp(-F.col("g2") / 15), 6).alias("p"),
                                      (F.col("n") >= 15).alias("tested"))


LAMBDAS = [1.0, 10.0, 50.0, 200.0]


@query("e11_lambda_sensitivity", sql(GRID, LEAGUE_Q + f""",
lams AS (SELECT CAST(UNNEST({LAMBDAS}) AS DOUBLE) AS lam),
sr AS MATERIALIZED (SELECT r.team, lam, r.i, r.j, n, ni, (rn + lam * q) / (SUM(rn) OVER (PARTITION BY r.team, lam, r.i) + lam) AS p FROM rest0 r JOIN lq ON lq.i = r.i AND lq.j = r.j, lams),
g AS (SELECT team, lam, i, MAX(ni) AS n, 2 * SUM(CASE WHEN n > 0 THEN n * LN(n / (ni * p)) ELSE 0 END) AS g2 FROM sr WHERE ni >= 15 GROUP BY 1, 2, 3),
pv AS MATERIALIZED (SELECT *, ROUND(EXP(-g2 / 15), 6) AS p FROM g),
f AS (SELECT team, lam, p, COUNT(*) AS c FROM pv GROUP BY 1, 2, 3),
r AS (SELECT *, SUM(c) OVER (PARTITION BY team, lam ORDER BY p) AS k, SUM(c) OVER (PARTITION BY team, lam) AS m FROM f),
bq AS (SELECT team, lam, p, MIN(p * m / k) OVER (PARTITION BY team, lam ORDER BY p DESC) AS q FROM r),
rj AS MATERIALIZED (SELECT pv.*, LEAST(1, q) <= 0.05 AS rejected FROM pv JOIN bq ON bq.team = pv.team AND bq.lam = pv.lam AND bq.p = pv.p),
st AS MATERIALIZED (SELECT team, lam, COUNT(*) AS tested, SUM(CASE WHEN rejected THEN 1 ELSE 0 END) AS rejected, MAX(g2) AS g2_max, quantile_cont(n / (n + lam), 0.5) AS attenuation, LIST(i) FILTER (rejected) AS own FROM rj GROUP BY 1, 2),
al AS (SELECT team, COUNT(*) FILTER (c = {len(LAMBDAS)}) AS core, COUNT(*) AS anywhere FROM (SELECT team, i, COUNT(*) AS c FROM rj WHERE rejected GROUP BY 1, 2) GROUP BY 1),
pr AS (SELECT x.*, y.lam AS other, len(list_intersect(COALESCE(x.own, []), COALESCE(y.own, []))) AS both_n, y.rejected AS other_n FROM st x JOIN st y ON y.team = x.team)
SELECT pr.team, lam, other, CAST(tested AS BIGINT) AS tested, CAST(rejected AS BIGINT) AS rejected, ROUND(g2_max, 4) AS g2_max, ROUND(attenuation, 6) AS attenuation,
 ROUND(CASE WHEN rejected + other_n > 0 THEN both_n / (rejected + other_n - both_n) ELSE 1 END, 6) AS jaccard, ROUND(COALESCE(core, 0) / GREATEST(COALESCE(anywhere, 0), 1), 6) AS stability FROM pr LEFT JOIN al ON al.team = pr.team"""))
def e11(spark, sf):
    """Rows of a team that differ from the other teams' matrix, shrunk to the league's with every lambda."""
    c = cells(spark, sf)
    q = E.rest_counts(c, "team", SPACE).join(league_prior(spark, sf), ["i", "j"])

    def test(rows):
        return R.fdr(rows.withColumn("p", F.round(F.exp(-F.col("g2") / 15), 6)), ["team", "lam"])
    d = E.lambda_sensitivity(c, q, LAMBDAS, SPACE, ["team"], test)
    return d.withColumns({"g2_max": F.round("g2_max", 4), **{x: F.round(x, 6) for x in ("attenuation", "jaccard", "stability")}})


@query("i12_benjamini_hochberg", sql(PV, BH_Q.format("")))
def i12(spark, sf):
    d = R.fdr(p_table(spark, sf), ["team"], mask=F.col("tested"))
    return d.select("team", "i", "p", F.round("q", 6).alias("q"), "rejected")


@query("i12_benjamini_yekutieli", sql(PV, BH_Q.format(" * (SELECT SUM(1.0 / h) FROM (SELECT UNNEST(range(1, 1 + CAST(m AS BIGINT))) AS h))")))
def i12b(spark, sf):
    d = R.fdr(p_table(spark, sf), ["team"], mask=F.col("tested"), dependent=True)
    return d.select("team", "i", "p", F.round("q", 6).alias("q"), "rejected")


@query("i13_two_stage_fdr", sql(PV, """,
om AS (SELECT team, MIN(p) * COUNT(*) AS p FROM pv WHERE tested GROUP BY team),
ok AS (SELECT team FROM om WHERE LEAST(1, p) <= 0.2),
t AS (SELECT pv.* FROM pv JOIN ok ON ok.team = pv.team WHERE tested), f AS (SELECT p, COUNT(*) AS c FROM t GROUP BY 1),
r AS (SELECT *, SUM(c) OVER (ORDER BY p) AS k, SUM(c) OVER () AS m FROM f), q AS (SELECT p, MIN(p * m / k) OVER (ORDER BY p DESC) AS q FROM r)
SELECT t.team, t.i, t.p, ROUND(LEAST(1, q), 6) AS q, LEAST(1, q) <= 0.05 AS rejected FROM t JOIN q ON q.p = t.p"""))
def i13(spark, sf):
    p = p_table(spark, sf).filter("tested")
    stage1 = p.groupBy("team").agg(F.least(F.lit(1.0), F.min("p") * F.count(F.lit(1))).alias("po")).filter("po <= 0.2")
    d = R.fdr(p.join(stage1, "team", "left_semi"), [])
    return d.select("team", "i", "p", F.round("q", 6).alias("q"), "rejected")


@query("i14_tv_excess_fingerprint")
def i14(spark, sf):
    c = E.count_cells(transitions(spark, sf), ("team", "match_id"))
    perm = R.permutation_labels(c.select("team", "match_id").withColumn("s", F.lit("league")).withColumn(
        "block", F.concat_ws("|", "team", "match_id")), ["s"], "block", "team", 10, 17).filter("b > 0")
    null = c.withColumn("block", F.concat_ws("|", "team", "match_id")).drop("team").join(
        perm.select("block", "b", "team"), "block").groupBy("team", "b", "i", "j").agg(F.sum("n").alias("n"))
    return X.tv_excess(cells(spark, sf), null, league_prior(spark, sf), ["team"], 15, 1.0, 10)


@query("i15_family_assembly", sql(PV, """,
u AS (SELECT 'rows' AS metric, team, i AS part, p FROM pv WHERE tested UNION ALL SELECT 'mass', team, i, ROUND(SQRT(p), 4) FROM pv WHERE tested),
x AS (SELECT 'global' AS family, * FROM u UNION ALL SELECT metric, * FROM u UNION ALL SELECT team, * FROM u),
f AS (SELECT family, p, COUNT(*) AS c FROM x GROUP BY 1, 2), r AS (SELECT *, SUM(c) OVER (PARTITION BY family ORDER BY p) AS k, SUM(c) OVER (PARTITION BY family) AS m FROM f),
q AS (SELECT family, p, c, MIN(p * m / k) OVER (PARTITION BY family ORDER BY p DESC) AS q FROM r)
SELECT family, CAST(SUM(c) AS BIGINT) AS tests, CAST(SUM(CASE WHEN q <= 0.05 THEN c ELSE 0 END) AS BIGINT) AS rejected FROM q GROUP BY family"""))
def i15(spark, sf):
    p = p_table(spark, sf).filter("tested")
    u = p.select(F.lit("rows").alias("metric"), "team", "i", "p").unionByName(
        p.select(F.lit("mass").alias("metric"), "team", "i", F.round(F.sqrt("p"), 4).alias("p")))
    u = u.withColumn("family", F.explode(F.array(F.lit("global"), F.col("metric"), F.col("team"))))
    d = R.fdr(u, ["family"])
    return d.groupBy("family").agg(F.count(F.lit(1)).alias("tests"), F.sum(F.col("rejected").cast("bigint")).alias("rejected"))


ZONE_REPS = TR + """,
zm AS (SELECT team, match_id, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS DOUBLE) AS y FROM tr WHERE action_type <> 'TERMINAL' GROUP BY 1, 2, 3)""" + weights_sql(
    "zm", "team", "match_id", 30, 13) + """,
zr AS (SELECT team, zone, b, SUM(w * y) / SUM(w * n) AS r FROM zm JOIN wt ON wt.s = team AND wt.k = match_id GROUP BY 1, 2, 3),
zd AS MATERIALIZED (SELECT x.team AS a, y.team AS c, x.zone, x.b, x.r - y.r AS d FROM zr x JOIN zr y ON x.zone = y.zone AND x.b = y.b AND x.team < y.team)"""


def zone_reps(spark, sf):
    z = transitions(spark, sf).filter("action_type <> 'TERMINAL'").groupBy(
        "team", "match_id", SPACE.zone_of_state(F.col("from_state")).alias("zone")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("under_pressure").cast("double")).alias("y"))
    w = R.multinomial_weights(z, ["team"], "match_id", 30, 13)
    r = R.replicate_sums(z, w, ["team", "match_id"], ["team", "zone"], ["n", "y"]).select(
        "team", "zone", "b", (F.col("y") / F.col("n")).alias("r"))
    x = r.select(F.col("team").alias("a"), "zone", "b", F.col("r").alias("ra"))
    y = r.select(F.col("team").alias("c"), "zone", "b", F.col("r").alias("rc"))
    return x.join(y, ["zone", "b"]).filter("a < c").withColumn("d", F.col("ra") - F.col("rc"))


@query("i16_omnibus", sql(ZONE_REPS, """,
pt AS (SELECT a, c, zone, MAX(CASE WHEN b = 0 THEN d END) AS t, STDDEV_SAMP(d) FILTER (WHERE b > 0) AS se FROM zd GROUP BY 1, 2, 3),
st AS (SELECT zd.a, zd.c, b, SUM(CASE WHEN se > 0 THEN POW((d - CASE WHEN b = 0 THEN 0 ELSE t END) / se, 2) END) AS s, COUNT(*) AS k FROM zd JOIN pt ON pt.a = zd.a AND pt.c = zd.c AND pt.zone = zd.zone GROUP BY 1, 2, 3),
o AS (SELECT a, c, s AS t, k AS tested FROM st WHERE b = 0)
SELECT st.a, st.c, ROUND(MAX(o.t), 5) AS t, ROUND((1 + SUM(CASE WHEN b > 0 AND s >= o.t THEN 1 ELSE 0 END)) / 31.0, 6) AS p FROM st JOIN o ON o.a = st.a AND o.c = st.c GROUP BY 1, 2"""))
def i16(spark, sf):
    d = R.omnibus(zone_reps(spark, sf), ["a", "c"], "zone", "d")
    return d.select("a", "c", F.round("t", 5).alias("t"), F.round("p", 6).alias("p"))


@query("i17_equivalence_control", sql(PAIR_REPS, """,
q AS (SELECT pr.a, pr.bb AS c, MAX(t) AS t, QUANTILE_CONT(d, 0.025) FILTER (WHERE b > 0) AS ql, QUANTILE_CONT(d, 0.975) FILTER (WHERE b > 0) AS qh FROM pr JOIN pt ON pr.a = pt.a AND pr.bb = pt.bb GROUP BY 1, 2),
m AS (SELECT a, c, t, GREATEST(ABS(2 * t - qh), ABS(2 * t - ql)) AS margin FROM q)
SELECT a, c, ROUND(margin, 6) AS margin, margin <= 0.1 AS equivalent, ROW_NUMBER() OVER (ORDER BY ROUND(margin, 9), a, c) = 1 AS control FROM m"""))
def i17(spark, sf):
    ci = R.interval(pair_reps(spark, sf), ["a", "c"], "d")
    m = ci.withColumn("margin", F.greatest(F.abs("lo"), F.abs("hi"))).withColumn(
        "equivalent", S.within_margin(F.col("lo"), F.col("hi"), 0.1))
    best = m.select(F.lit(1).alias("k"), "a", "c", "margin")
    best = Q.first_per_key(best, ["k"], [F.round("margin", 9), F.col("a"), F.col("c")]).select("a", "c").withColumn(
        "control", F.lit(True))
    return m.join(F.broadcast(best), ["a", "c"], "left").select(
        "a", "c", F.round("margin", 6).alias("margin"), "equivalent", F.coalesce("control", F.lit(False)).alias("control"))


@query("o05_equivalence_order", sql(PAIR_REPS, """,
q AS (SELECT pr.a, pr.bb AS c, MAX(t) AS t, QUANTILE_CONT(d, 0.025) FILTER (WHERE b > 0) AS ql, QUANTILE_CONT(d, 0.975) FILTER (WHERE b > 0) AS qh FROM pr JOIN pt ON pr.a = pt.a AND pr.bb = pt.bb GROUP BY 1, 2)
SELECT a, c, ROUND(GREATEST(ABS(2 * t - qh), ABS(2 * t - ql)), 6) AS margin FROM q ORDER BY 3, a, c LIMIT 5"""))
def o05(spark, sf):
    ci = R.interval(pair_reps(spark, sf), ["a", "c"], "d")
    m = ci.select("a", "c", F.round(F.greatest(F.abs("lo"), F.abs("hi")), 6).alias("margin"))
    return Q.top_k(m, [F.col("margin"), F.col("a"), F.col("c")], 5)


REGIME = TR + """,
mo AS (SELECT team, match_id, ROW_NUMBER() OVER (PARTITION BY team ORDER BY MIN(match_date), match_id) AS pos, COUNT(*) OVER (PARTITION BY team) AS size FROM tr GROUP BY 1, 2),
mcell AS (SELECT team, match_id, from_state AS i, to_state AS j, COUNT(*) AS n FROM tr GROUP BY 1, 2, 3, 4),
sp AS (SELECT m.team, m.pos - o.o AS split, i, j, SUM(CASE WHEN o.o < 0 THEN n ELSE 0 END) AS l, SUM(CASE WHEN o.o >= 0 THEN n ELSE 0 END) AS r FROM mcell c JOIN mo m ON m.team = c.team AND m.match_id = c.match_id, (SELECT UNNEST(range(-8, 8)) AS o) o
  WHERE m.pos - o.o > 8 AND m.pos - o.o <= m.size - 7 GROUP BY 1, 2, 3, 4),
sr AS (SELECT *, SUM(l) OVER (PARTITION BY team, split, i) AS li, SUM(r) OVER (PARTITION BY team, split, i) AS ri FROM sp),
rw AS (SELECT team, split, i, MAX(li) AS li, MAX(ri) AS ri, 0.5 * (SUM(ABS(CASE WHEN li > 0 THEN l / li ELSE CAST(1 AS DOUBLE) / 84 END - CASE WHEN ri > 0 THEN r / ri ELSE CAST(1 AS DOUBLE) / 84 END)) + CASE WHEN MAX(li) = 0 OR MAX(ri) = 0 THEN (84 - COUNT(*)) / CAST(84 AS DOUBLE) ELSE 0 END) AS tv FROM sr GROUP BY 1, 2, 3)"""


def regime(spark, sf):
    tr = transitions(spark, sf)
    days = tr.groupBy("team", "match_id").agg(F.min("match_date").alias("day"))
    order = X.match_order(days, ["team"], ["day", "match_id"], F.year("day"))
    return tr, order, X.regime_series(E.count_cells(tr, ("team", "match_id")), order, 8, SPACE, ["team"])


@query("i18_regime_series", sql(REGIME, " SELECT team, split, ROUND(SUM(tv * (li + ri)) / SUM(li + ri), 6) AS tv_weighted FROM rw GROUP BY 1, 2"))
def i18(spark, sf):
    return regime(spark, sf)[2].withColumn("tv_weighted", F.round("tv_weighted", 6))


@query("w07_contiguous_windows", sql(REGIME, " SELECT team, split, CAST(SUM(l) AS DOUBLE) AS before_n, CAST(SUM(r) AS DOUBLE) AS after_n FROM sp GROUP BY 1, 2"))
def w07(spark, sf):
    tr = transitions(spark, sf)
    days = tr.groupBy("team", "match_id").agg(F.min("match_date").alias("day"), F.count(F.lit(1)).cast("double").alias("n"))
    d = X.match_order(days, ["team"], ["day", "match_id"], F.year("day")).withColumn("o", F.explode(F.sequence(F.lit(-8), F.lit(7))))
    d = d.withColumn("split", F.col("pos") - F.col("o")).filter("split > 8 and split <= size - 7")
    return d.groupBy("team", "split").agg(F.sum(F.when(F.col("o") < 0, F.col("n")).otherwise(0.0)).alias("before_n"),
                                          F.sum(F.when(F.col("o") >= 0, F.col("n")).otherwise(0.0)).alias("after_n"))


@query("i18_regime_placebo")
def i18b(spark, sf):
    tr, order, _ = regime(spark, sf)
    many = order.select("team", "match_id", "size").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(3))))
    from chainspark.functions.draws import draw
    from chainspark.functions.scan import position
    many = many.withColumn("u", draw(77, F.col("b"), F.col("match_id")))
    many = position(many, ["team", "b"], ["u", "match_id"], chunk_of(F.col("u")), "pos").drop("u")
    both = many.unionByName(order.select("team", "match_id", "size", F.lit(0).alias("b"), "pos"))
    c = E.count_cells(tr, ("team", "match_id"))
    c = c.join(both.select("team", "match_id", "b"), ["team", "match_id"])
    s = X.regime_series(c, both, 8, SPACE, ["team", "b"]).groupBy("team", "b").agg(F.max("tv_weighted").alias("peak"))
    return R.permutation_p(s, ["team"], "peak")


@query("i19_length_fit", rsql(LAW, f""",
cond AS MATERIALIZED (SELECT team, k, pmf / SUM(pmf) OVER (PARTITION BY team) AS pmf FROM law WHERE k >= 2),
cd0 AS MATERIALIZED (SELECT *, SUM(pmf) OVER (PARTITION BY team ORDER BY k) AS cdf FROM cond),
cd AS MATERIALIZED (SELECT *, LAG(cdf, 1, -1) OVER (PARTITION BY team ORDER BY k) AS before_cdf, MAX(k) OVER (PARTITION BY team) AS kmax FROM cd0),
ln AS (SELECT team, poss_uid, LEAST(COUNT(*), 21) AS n FROM tr GROUP BY 1, 2 HAVING COUNT(*) >= 2),
nn AS (SELECT team, COUNT(*) AS n FROM ln GROUP BY 1),
dr AS (SELECT team, b, s, (CAST({draw_sql("'8'", "team", "b", "s")} AS DOUBLE) + 0.5) / {float(SPAN)!r} AS u FROM nn, (SELECT UNNEST(range(1, 10)) AS b), LATERAL (SELECT UNNEST(range(n)) AS s)),
rl AS (SELECT dr.team, b, k FROM dr JOIN cd ON cd.team = dr.team AND ((u > before_cdf AND u <= cdf) OR (k = kmax AND u > cdf)) UNION ALL SELECT team, 0, n FROM ln),
rh AS (SELECT team, b, k, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY team, b) AS o FROM rl GROUP BY 1, 2, 3),
gr AS (SELECT cd.team, x.b, cd.k, cdf, SUM(COALESCE(o, 0)) OVER (PARTITION BY cd.team, x.b ORDER BY cd.k) AS oc FROM cd CROSS JOIN (SELECT UNNEST(range(0, 10)) AS b) x LEFT JOIN rh ON rh.team = cd.team AND rh.b = x.b AND rh.k = cd.k),
ks AS (SELECT team, b, MAX(ABS(oc - cdf)) AS ks FROM gr GROUP BY 1, 2)
SELECT x.team, ROUND(x.ks, 6) AS ks, ROUND((1 + (SELECT COUNT(*) FROM ks y WHERE y.team = x.team AND y.b > 0 AND y.ks >= x.ks - 1e-12)) / 10.0, 6) AS p FROM ks x WHERE b = 0"""))
def i19(spark, sf):
    law = C.survival(matrix(spark, sf), alpha(spark, sf), ["team"], SPACE, 20)
    h = chains.length_histogram(transitions(spark, sf), ("team",))
    return rounded(X.length_fit(h, law, ["team"], 2, 9, 8), ["team"], ["ks", "p"])


@query("i21_heterogeneity", sql(TR, """,
p AS (SELECT team, coach, poss_uid, CAST(COUNT(*) AS DOUBLE) AS x FROM tr GROUP BY 1, 2, 3),
u AS (SELECT team, coach, AVG(x) AS m, CAST(COUNT(*) AS DOUBLE) AS n, VAR_SAMP(x) AS v FROM p GROUP BY 1, 2),
s AS (SELECT team, COUNT(*) AS k, SUM(n / v) AS sw, SUM((n / v) * (n / v)) AS sww, SUM(n / v * m) AS swy, SUM(n / v * m * m) AS swyy, VAR_SAMP(m) AS vy, AVG(v / n) AS se2, SUM(n) AS sn, SUM(n * m) AS sny, SUM(n * m * m) AS snyy FROM u GROUP BY 1)
SELECT team, CAST(k AS BIGINT) AS k, ROUND(swyy - swy * swy / sw, 5) AS q_stat, ROUND(GREATEST(0, (swyy - swy * swy / sw - (k - 1)) / (sw - sww / sw)), 6) AS tau2_dl, ROUND(GREATEST(0, vy - se2), 6) AS tau2_moments, ROUND(GREATEST(0, snyy / sn - (sny / sn) * (sny / sn) - se2), 6) AS tau2_mixed FROM s"""))
def i21(spark, sf):
    p = transitions(spark, sf).groupBy("team", "coach", "poss_uid").agg(F.count(F.lit(1)).cast("double").alias("x"))
    u = p.groupBy("team", "coach").agg(F.avg("x").alias("m"), F.count(F.lit(1)).cast("double").alias("n"), F.var_samp("x").alias("v"))
    d = X.heterogeneity(u, ["team"], "m", "n", "v")
    return d.select("team", "k", F.round("q_stat", 5).alias("q_stat"), *[F.round(c, 6).alias(c) for c in ("tau2_dl", "tau2_moments", "tau2_mixed")])


@query("i23_spearman", sql(FA, """,
m AS (SELECT team, match_id, COUNT(*) AS x, SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS y FROM actions GROUP BY 1, 2),
r AS (SELECT team, RANK() OVER (PARTITION BY team ORDER BY x) + (COUNT(*) OVER (PARTITION BY team, x) - 1) / 2.0 AS rx, RANK() OVER (PARTITION BY team ORDER BY y) + (COUNT(*) OVER (PARTITION BY team, y) - 1) / 2.0 AS ry FROM m)
SELECT team, ROUND(CORR(rx, ry), 6) AS spearman, CAST(COUNT(*) AS BIGINT) AS n FROM r GROUP BY team"""))
def i23(spark, sf):
    m = moves(spark, sf).groupBy("team", "match_id").agg(
        F.count(F.lit(1)).alias("x"), F.sum(F.col("under_pressure").cast("bigint")).alias("y"))
    d = Q.spearman(m, ["team"], "x", "y", F.floor(F.col("x") / 64), F.floor(F.col("y") / 64))
    return d.withColumn("spearman", F.round("spearman", 6))


@query("i24_js_tv_kl", sql(CELLS, """,
pr AS (SELECT x.team AS a, y.team AS b, x.i, x.ni + y.ni AS w FROM rowsum x JOIN rowsum y ON x.i = y.i AND x.team < y.team),
c AS (SELECT pr.a, pr.b, pr.i, j, w, MAX(CASE WHEN m.team = pr.a THEN p ELSE 0 END) AS pa, MAX(CASE WHEN m.team = pr.b THEN p ELSE 0 END) AS pb FROM pr JOIN mle m ON m.i = pr.i AND m.team IN (pr.a, pr.b) GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT a, b, i, w, SUM(0.5 * CASE WHEN pa > 0 THEN pa * LOG2(pa / ((pa + pb) / 2)) ELSE 0 END + 0.5 * CASE WHEN pb > 0 THEN pb * LOG2(pb / ((pa + pb) / 2)) ELSE 0 END) AS js, 0.5 * SUM(ABS(pa - pb)) AS tv, SUM(CASE WHEN pa > 0 THEN pa * LN(pa / GREATEST(pb, 1e-12)) ELSE 0 END) AS kl FROM c GROUP BY 1, 2, 3, 4)
SELECT a, b, ROUND(SUM(js * w) / SUM(w), 6) AS js, ROUND(SUM(tv * w) / SUM(w), 6) AS tv, ROUND(SUM(kl * w) / SUM(w), 6) AS kl FROM r GROUP BY 1, 2"""))
def i24(spark, sf):
    p = matrix(spark, sf)
    rows = p.groupBy("team", "i").agg(F.sum("n").alias("ni"))
    pairs = rows.select(F.col("team").alias("a"), "i", F.col("ni").alias("na")).join(
        rows.select(F.col("team").alias("b"), "i", F.col("ni").alias("nb")), "i").filter("a < b").withColumn("w", F.expr("na + nb"))
    one = p.select("team", "i", "j", "p")
    sides = pairs.withColumn("team", F.explode(F.array("a", "b"))).join(one, ["team", "i"])
    c = sides.groupBy("a", "b", "i", "j").agg(
        F.max(F.when(F.col("team") == F.col("a"), F.col("p")).otherwise(0.0)).alias("pa"),
        F.max(F.when(F.col("team") == F.col("b"), F.col("p")).otherwise(0.0)).alias("pb"), F.max("w").alias("w"))
    return rounded(X.js_divergence(c, ["a", "b"]), ["a", "b"], ["js", "tv", "kl"])


@query("i25_p_floor", sql(PV, " SELECT team, CAST(COUNT(*) AS BIGINT) AS tests, 2.0 / 201 > 0.05 / COUNT(*) AS too_few FROM pv WHERE tested GROUP BY team"))
def i25(spark, sf):
    d = p_table(spark, sf).filter("tested").groupBy("team").agg(F.count(F.lit(1)).alias("tests"))
    return d.withColumn("too_few", R.p_floor(F.col("tests"), 200))


# -- chain quantities under resampling ---------------------------------------------------------------------
def scalar_reps(spark, sf, B, seed, keys=("team",)):
    """e_t, p_goal, p_shot per replicate from resampled match cells and starts."""
    tr = transitions(spark, sf)
    c = E.count_cells(tr, (*keys, "match_id"))
    a = tr.groupBy(*keys, "match_id", "poss_uid").agg(F.min_by("from_state", "event_index").alias("i")).groupBy(
        *keys, "match_id", "i").agg(F.count(F.lit(1)).cast("double").alias("a"))
    w = R.multinomial_weights(c, list(keys), "match_id", B, seed)
    on = [*keys, "match_id"]
    P = E.mle(R.replicate_sums(c, w, on, [*keys, "i", "j"], ["n"]), [*keys, "b"])
    al = R.replicate_sums(a, w, on, [*keys, "i"], ["a"])
    return C.scalars(P, al, [*keys, "b"], SPACE)


SCALAR_REPS = TR + """,
mc0 AS (SELECT team, match_id, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2, 3, 4),
ma0 AS (SELECT team, match_id, i, CAST(COUNT(*) AS DOUBLE) AS a FROM (SELECT team, match_id, poss_uid, MIN_BY(from_state, event_index) AS i FROM tr GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)""" + weights_sql(
    "mc0", "team", "match_id", 8, 19) + """,
rcell AS (SELECT team, b, i, j, SUM(w * n) AS n FROM mc0 JOIN wt ON wt.s = team AND wt.k = match_id GROUP BY 1, 2, 3, 4),
rp AS MATERIALIZED (SELECT team, b, i, j, n / SUM(n) OVER (PARTITION BY team, b, i) AS p FROM rcell),
ra AS (SELECT team, b, i, SUM(w * a) AS a FROM ma0 JOIN wt ON wt.s = team AND wt.k = match_id GROUP BY 1, 2, 3),
ri AS (SELECT 0 AS k, team, b, i, a / SUM(a) OVER (PARTITION BY team, b) AS m FROM ra
  UNION ALL SELECT ri.k + 1, rp.team, rp.b, rp.j, SUM(ri.m * rp.p) FROM ri JOIN rp ON rp.team = ri.team AND rp.b = ri.b AND rp.i = ri.i WHERE ri.i < 80 AND ri.k < 150 GROUP BY ri.k, rp.team, rp.b, rp.j),
rs AS MATERIALIZED (SELECT team, b, SUM(CASE WHEN i < 80 THEN m ELSE 0 END) AS e_t, SUM(CASE WHEN i = 80 THEN m ELSE 0 END) AS p_goal, SUM(CASE WHEN i IN (80, 81) THEN m ELSE 0 END) AS p_shot FROM ri GROUP BY 1, 2)"""


@query("i26_derived_intervals", rsql(SCALAR_REPS, """,
l AS (SELECT team, 'e_t' AS quantity, b, e_t AS v FROM rs UNION ALL SELECT team, 'p_goal', b, p_goal FROM rs UNION ALL SELECT team, 'p_shot', b, p_shot FROM rs),
s AS (SELECT team, quantity, MAX(CASE WHEN b = 0 THEN v END) AS point, QUANTILE_CONT(v, 0.025) FILTER (WHERE b > 0) AS ql, QUANTILE_CONT(v, 0.975) FILTER (WHERE b > 0) AS qh FROM l GROUP BY 1, 2)
SELECT team, quantity, ROUND(point, 6) AS point, ROUND(2 * point - qh, 6) AS lo, ROUND(2 * point - ql, 6) AS hi FROM s"""))
def i26(spark, sf):
    r = scalar_reps(spark, sf, 8, 19)
    long = r.select("team", "b", F.explode(F.create_map(*[x for c in ("e_t", "p_goal", "p_shot")
                                                          for x in (F.lit(c), F.col(c))])).alias("quantity", "v"))
    return rounded(R.interval(long, ["team", "quantity"], "v"), ["team", "quantity"], ["point", "lo", "hi"])


@query("i09_pair_permutation", rsql(TR, f""",
lb AS MATERIALIZED (SELECT DISTINCT team, poss_uid, coach AS era FROM tr),
sb AS (SELECT team, era, ROW_NUMBER() OVER (PARTITION BY team ORDER BY era, poss_uid) AS slot FROM lb),
sp AS (SELECT team, poss_uid, b, ROW_NUMBER() OVER (PARTITION BY team, b ORDER BY {draw_sql("'23'", "b", "poss_uid")}, poss_uid) AS slot FROM lb, (SELECT UNNEST(range(1, 5)) AS b)),
pl AS MATERIALIZED (SELECT sp.team, poss_uid, b, era FROM sp JOIN sb ON sb.team = sp.team AND sb.slot = sp.slot UNION ALL SELECT team, poss_uid, 0, era FROM lb),
ct AS MATERIALIZED (SELECT pl.team, era, b, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr JOIN pl ON pl.team = tr.team AND pl.poss_uid = tr.poss_uid GROUP BY 1, 2, 3, 4, 5),
pm AS MATERIALIZED (SELECT *, n / SUM(n) OVER (PARTITION BY team, era, b, i) AS p FROM ct),
fi AS (SELECT team, poss_uid, MIN_BY(from_state, event_index) AS i FROM tr GROUP BY 1, 2),
al AS MATERIALIZED (SELECT pl.team, era, b, i, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY pl.team, era, b) AS a FROM fi JOIN pl ON pl.team = fi.team AND pl.poss_uid = fi.poss_uid GROUP BY 1, 2, 3, 4),
it AS (SELECT 0 AS k, team, era, b, i, a AS m FROM al
  UNION ALL SELECT it.k + 1, q.team, q.era, q.b, q.j, SUM(it.m * q.p) FROM it JOIN pm q ON q.team = it.team AND q.era = it.era AND q.b = it.b AND q.i = it.i WHERE it.k < 150 AND it.i < 80 AND q.j < 80 GROUP BY it.k, q.team, q.era, q.b, q.j),
et AS MATERIALIZED (SELECT team, era, b, SUM(m) AS e_t FROM it GROUP BY 1, 2, 3),
rp AS MATERIALIZED (SELECT x.team, x.era AS a, y.era AS c, x.b, x.e_t - y.e_t AS t FROM et x JOIN et y ON y.team = x.team AND y.b = x.b AND x.era < y.era)""" + null_summary_sql("rp", "team, a, c", "ABS(t)", "t")))
def i09(spark, sf):
    """Permute eras between possessions of a club; E_T per era and replicate, spread as statistic."""
    tr = transitions(spark, sf).withColumn("era", F.col("coach"))
    lb = tr.select("team", "poss_uid", "era").distinct()
    perm = R.permutation_labels(lb, ["team"], "poss_uid", "era", 4, 23)
    first = tr.groupBy("team", "poss_uid").agg(F.min_by("from_state", "event_index").alias("i"))
    c = E.count_cells(tr, ("team", "poss_uid")).join(perm, ["team", "poss_uid"]).groupBy(
        "team", "era", "b", "i", "j").agg(F.sum("n").alias("n"))
    a = first.join(perm, ["team", "poss_uid"]).groupBy("team", "era", "b", "i").agg(F.count(F.lit(1)).cast("double").alias("a"))
    s = C.scalars(E.mle(c, ["team", "era", "b"]), a, ["team", "era", "b"], SPACE)
    x = s.select("team", "b", F.col("era").alias("a"), F.col("e_t").alias("ta"))
    y = s.select("team", "b", F.col("era").alias("c"), F.col("e_t").alias("tc"))
    d = x.join(y, ["team", "b"]).filter("a < c").withColumn("diff", F.col("ta") - F.col("tc"))
    return null_summary(d, ["team", "a", "c"], "diff", True)


@query("i10_size_matched_subsample", sql(TR, f""",
sz AS (SELECT team, coach, COUNT(DISTINCT poss_uid) AS n FROM tr GROUP BY 1, 2), mn AS (SELECT team, MIN(n) AS m FROM sz GROUP BY 1),
id AS (SELECT DISTINCT team, coach, poss_uid FROM tr),
rk AS (SELECT id.*, b, ROW_NUMBER() OVER (PARTITION BY team, coach, b ORDER BY {draw_sql("'29'", "b", "poss_uid")}, poss_uid) AS k FROM id, (SELECT UNNEST(range(1, 4)) AS b))
SELECT rk.team, rk.coach, CAST(b AS INTEGER) AS b, CAST(COUNT(DISTINCT rk.poss_uid) AS BIGINT) AS possessions, CAST(COUNT(*) AS BIGINT) AS rows_kept FROM rk JOIN mn ON mn.team = rk.team AND k <= m JOIN tr ON tr.poss_uid = rk.poss_uid GROUP BY 1, 2, 3"""))
def i10(spark, sf):
    per, cuts = size_matched(spark, sf, F.count(F.lit(1)).alias("n"))
    return R.kept(per, cuts, ["team", "coach"], "poss_uid", 3, 29).groupBy("team", "coach", "b").agg(
        F.count(F.lit(1)).alias("possessions"), F.sum("n").alias("rows_kept"))


def size_matched(spark, sf, value):
    """One row per possession with ``value``, and where the draws of every era cut to the size of the team's smallest end."""
    per = cut_lineage(transitions(spark, sf).groupBy("team", "coach", "poss_uid").agg(value))
    m = cut_lineage(per.groupBy("team", "coach").agg(F.count(F.lit(1)).alias("n")).groupBy("team").agg(F.min("n").alias("m")))
    ids = per.select("team", "coach", "poss_uid").join(m, "team")
    return per, R.subsample_cutoffs(ids, ["team", "coach"], "poss_uid", "m", 3, 29)


@query("i10_size_matched_spread", rsql(TR, f""",
sz AS (SELECT team, coach, COUNT(DISTINCT poss_uid) AS n FROM tr GROUP BY 1, 2), mn AS (SELECT team, MIN(n) AS m FROM sz GROUP BY 1),
id AS (SELECT DISTINCT team, coach, poss_uid FROM tr),
rk AS (SELECT id.*, b, ROW_NUMBER() OVER (PARTITION BY team, coach, b ORDER BY {draw_sql("'29'", "b", "poss_uid")}, poss_uid) AS k FROM id, (SELECT UNNEST(range(1, 4)) AS b)),
sd AS MATERIALIZED (SELECT rk.team, coach, b, poss_uid FROM rk JOIN mn ON mn.team = rk.team AND k <= m),
ct AS (SELECT sd.team, sd.coach, b, from_state AS i, to_state AS j, COUNT(*)::DOUBLE AS n FROM tr JOIN sd ON sd.poss_uid = tr.poss_uid AND sd.coach = tr.coach GROUP BY 1, 2, 3, 4, 5),
pm AS MATERIALIZED (SELECT *, n / SUM(n) OVER (PARTITION BY team, coach, b, i) AS p FROM ct),
fi AS (SELECT team, poss_uid, MIN_BY(from_state, event_index) AS i FROM tr GROUP BY 1, 2),
al AS MATERIALIZED (SELECT sd.team, coach, b, i, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY sd.team, coach, b) AS a FROM fi JOIN sd ON sd.team = fi.team AND sd.poss_uid = fi.poss_uid GROUP BY 1, 2, 3, 4),
it AS (SELECT 0 AS k, team, coach, b, i, a AS m FROM al
  UNION ALL SELECT it.k + 1, q.team, q.coach, q.b, q.j, SUM(it.m * q.p) FROM it JOIN pm q ON q.team = it.team AND q.coach = it.coach AND q.b = it.b AND q.i = it.i WHERE it.k < 150 AND it.i < 80 GROUP BY it.k, q.team, q.coach, q.b, q.j),
et AS (SELECT team, coach, b, SUM(CASE WHEN i < 80 THEN m ELSE 0 END) AS e_t, SUM(CASE WHEN i = 80 THEN m ELSE 0 END) AS p_goal FROM it GROUP BY 1, 2, 3)
SELECT team, coach, ROUND(AVG(e_t), 6) AS e_t_mean, ROUND(STDDEV_SAMP(e_t), 6) AS e_t_sd, ROUND(MAX(e_t) - MIN(e_t), 6) AS e_t_range, ROUND(AVG(p_goal), 6) AS p_goal_mean, ROUND(STDDEV_SAMP(p_goal), 6) AS p_goal_sd, CAST(COUNT(*) AS BIGINT) AS replicates FROM et GROUP BY 1, 2"""))
def i10b(spark, sf):
    """How much expected length and goal probability vary when every era is cut to the size of the smallest."""
    first, cuts = size_matched(spark, sf, F.min_by("from_state", "event_index").alias("i"))
    keys = ["team", "coach", "b"]
    # rows tell by their own draw which replicates they are in; cells and starts are read several times
    rows = transitions(spark, sf).select("team", "coach", "poss_uid", "from_state", "to_state")
    cells_of = cut_lineage(E.count_cells(R.kept(rows, cuts, keys[:2], "poss_uid", 3, 29), keys))
    starts = cut_lineage(R.kept(first, cuts, keys[:2], "poss_uid", 3, 29).groupBy(*keys, "i").agg(F.count(F.lit(1)).cast("double").alias("a")))
    r = C.scalars(E.mle(cells_of, keys), starts, keys, SPACE)
    out = r.groupBy("team", "coach").agg(
        F.avg("e_t").alias("e_t_mean"), F.stddev_samp("e_t").alias("e_t_sd"), (F.max("e_t") - F.min("e_t")).alias("e_t_range"),
        F.avg("p_goal").alias("p_goal_mean"), F.stddev_samp("p_goal").alias("p_goal_sd"), F.count(F.lit(1)).alias("replicates"))
    return out.select("team", "coach", *[F.round(c, 6).alias(c) for c in out.columns[2:7]], "replicates")


@query("i27_pair_compare_report", sql(CELLS, """,
u AS (SELECT x.team AS a, y.team AS b, x.i, x.ni AS na, y.ni AS nb FROM rowsum x JOIN rowsum y ON x.i = y.i AND x.team < y.team),
t AS (SELECT u.a, u.b, u.i, na, nb, 0.5 * SUM(ABS(COALESCE(ma.p, 0) - COALESCE(mb.p, 0))) AS tv FROM u, (SELECT UNNEST(range(84)) AS j) js LEFT JOIN mle ma ON ma.team = u.a AND ma.i = u.i AND ma.j = js.j LEFT JOIN mle mb ON mb.team = u.b AND mb.i = u.i AND mb.j = js.j GROUP BY 1, 2, 3, 4, 5)
SELECT a, b, CAST(COUNT(*) AS BIGINT) AS rows_compared, ROUND(SUM(tv * (na + nb)) / SUM(na + nb), 6) AS tv_weighted, CAST(SUM(na) AS DOUBLE) AS n_a, CAST(SUM(nb) AS DOUBLE) AS n_b FROM t GROUP BY 1, 2"""))
def i27(spark, sf):
    p = matrix(spark, sf)
    rows = p.groupBy("team", "i").agg(F.sum("n").alias("ni"))
    pairs = rows.select(F.col("team").alias("a"), "i", F.col("ni").alias("na")).join(
        rows.select(F.col("team").alias("b"), "i", F.col("ni").alias("nb")), "i").filter("a < b")
    c = pairs.withColumn("team", F.explode(F.array("a", "b"))).join(p.select("team", "i", "j", "p"), ["team", "i"])
    signed = F.when(F.col("team") == F.col("a"), F.col("p")).otherwise(-F.col("p"))
    t = c.groupBy("a", "b", "i", "na", "nb", "j").agg(F.abs(F.sum(signed)).alias("d")).groupBy(
        "a", "b", "i", "na", "nb").agg((0.5 * F.sum("d")).alias("tv"))
    m = F.col("na") + F.col("nb")
    return t.groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows_compared"), F.round(F.sum(F.col("tv") * m) / F.sum(m), 6).alias("tv_weighted"),
                                   F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))


@query("i28_strata_fdr", sql(PV, """,
s AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'parallel' WHEN i % 4 = 3 THEN 'diverging' ELSE 'unknown' END AS stratum FROM pv WHERE tested),
f AS (SELECT stratum, p, COUNT(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT *, SUM(c) OVER (PARTITION BY stratum ORDER BY p) AS k, SUM(c) OVER (PARTITION BY stratum) AS m FROM f),
q AS (SELECT stratum, p, c, MIN(p * m / k) OVER (PARTITION BY stratum ORDER BY p DESC) AS q FROM r)
SELECT stratum, CAST(SUM(c) AS BIGINT) AS tests, CAST(SUM(CASE WHEN LEAST(1, q) <= 0.05 THEN c ELSE 0 END) AS BIGINT) AS rejected, ROUND(MIN(LEAST(1, q)), 6) AS min_q FROM q GROUP BY stratum"""))
def i28(spark, sf):
    phase = F.col("i") % 4
    stratum = F.when(phase == 0, "parallel").when(phase == 3, "diverging").otherwise("unknown")
    d = R.fdr(p_table(spark, sf).filter("tested").withColumn("stratum", stratum), ["stratum"])
    return d.groupBy("stratum").agg(F.count(F.lit(1)).alias("tests"), F.sum(F.col("rejected").cast("bigint")).alias("rejected"),
                                    F.round(F.min("q"), 6).alias("min_q"))
