"""Standardisation, decomposition and difference-in-differences (D), pressure (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.operators import absorb as C
from chainspark.operators import chains
from chainspark.operators import estimate as E
from chainspark.operators import pressure as P
from chainspark.operators import relations as Q
from chainspark.operators import resample as R
from chainspark.operators import standardise as D
from chainspark.plans.estimate_queries import rsql
from chainspark.plans.inference_queries import rounded, weights_sql
from chainspark.plans.registry import query
from chainspark.plans.tables import FA, SPACE, TR, draw_sql, load, moves, sql, transitions

POSS = TR + """,
ps AS MATERIALIZED (SELECT poss_uid, team, coach, opponent, season, season_order, match_id, CAST(COUNT(*) AS DOUBLE) AS len, MAX(CASE WHEN to_state IN (80, 81) THEN 1.0 ELSE 0.0 END) AS shot, AVG(CASE WHEN under_pressure THEN 1.0 WHEN NOT under_pressure THEN 0.0 END) AS pr FROM tr GROUP BY ALL)"""


def possessions(spark, sf):
    keys = ("team", "coach", "opponent", "season", "season_order", "match_id")
    d = chains.per_possession(transitions(spark, sf), SPACE, keys)
    return d.withColumns({"len": F.col("n_actions").cast("double"), "shot": F.col("shot").cast("double")})


STD = POSS + """,
sm AS (SELECT team, coach, opponent, AVG(shot) AS m, COUNT(*) AS n FROM ps GROUP BY 1, 2, 3),
wh AS (SELECT team, coach, SUM(n) AS total, SUM(m * n) / SUM(n) AS crude FROM sm GROUP BY 1, 2),
pp AS (SELECT x.team, x.coach AS a, y.coach AS b, COUNT(*) AS strata, AVG(x.m) AS sa, AVG(y.m) AS sb, SUM(x.n) AS ia, SUM(y.n) AS ib FROM sm x JOIN sm y ON x.team = y.team AND x.opponent = y.opponent AND x.coach < y.coach WHERE x.n >= 3 AND y.n >= 3 GROUP BY 1, 2, 3)"""


@query("d01_standardised_difference", sql(STD, """
SELECT pp.team, a, b, CAST(strata AS BIGINT) AS strata, CAST(strata AS DOUBLE) AS n_eff, ROUND(LEAST(ia / wa.total, ib / wb.total), 6) AS cover, ROUND(sa - sb, 6) AS diff, ROUND(wa.crude - wb.crude, 6) AS crude, strata >= 3 AND LEAST(ia / wa.total, ib / wb.total) >= 0.85 AS interpretable
FROM pp JOIN wh wa ON wa.team = pp.team AND wa.coach = a JOIN wh wb ON wb.team = pp.team AND wb.coach = b"""))
def d01(spark, sf):
    m = D.stratum_means(possessions(spark, sf), "team", "coach", "opponent", "shot")
    d = D.standardised_difference(m, "team", "coach", "opponent", 3)
    return d.withColumns({c: F.round(c, 6) for c in ("cover", "diff", "crude")})


@query("d01_stratified_bootstrap", sql(POSS, f""",
bk AS (SELECT team, coach, opponent, poss_uid, shot, ROW_NUMBER() OVER (PARTITION BY team, coach, opponent ORDER BY {draw_sql("'6'", "poss_uid")}, poss_uid) - 1 AS rnk, COUNT(*) OVER (PARTITION BY team, coach, opponent) AS n FROM ps),
sl AS (SELECT team, coach, opponent, b, {draw_sql("'6'", "team || '|' || coach || '|' || opponent", "b", "rnk")} % n AS rnk FROM bk, (SELECT UNNEST(range(1, 6)) AS b)),
dr AS (SELECT sl.team, sl.coach, sl.opponent, sl.b AS rep, shot FROM sl JOIN bk ON bk.team = sl.team AND bk.coach = sl.coach AND bk.opponent = sl.opponent AND bk.rnk = sl.rnk UNION ALL SELECT team, coach, opponent, 0, shot FROM bk),
sm AS (SELECT rep, team, coach, opponent, AVG(shot) AS m, COUNT(*) AS n FROM dr GROUP BY 1, 2, 3, 4)
SELECT x.team, x.coach AS a, y.coach AS era_b, CAST(x.rep AS INTEGER) AS b, ROUND(AVG(x.m) - AVG(y.m), 6) AS diff FROM sm x JOIN sm y ON x.rep = y.rep AND x.team = y.team AND x.opponent = y.opponent AND x.coach < y.coach WHERE x.n >= 3 AND y.n >= 3 GROUP BY 1, 2, 3, 4"""))
def d01b(spark, sf):
    d = D.standardised_bootstrap(possessions(spark, sf), "team", "coach", "opponent", "shot", 3, 5, 6)
    return d.select("team", "a", "era_b", "b", F.round("diff", 6).alias("diff"))


@query("d02_positivity", sql(STD, """
SELECT pp.team, a, b, CAST(strata AS BIGINT) AS strata, ROUND(ia / wa.total, 6) AS cover_a, ROUND(ib / wb.total, 6) AS cover_b
FROM pp JOIN wh wa ON wa.team = pp.team AND wa.coach = a JOIN wh wb ON wb.team = pp.team AND wb.coach = b"""))
def d02(spark, sf):
    d = D.positivity(possessions(spark, sf), "team", "coach", "opponent", 3)
    return d.withColumns({c: F.round(c, 6) for c in ("cover_a", "cover_b")})


CONT = TR + """,
cs AS (SELECT team, season, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2, 3, 4),
al AS (SELECT season, i, j, SUM(n) AS a FROM cs GROUP BY 1, 2, 3),
ts AS (SELECT DISTINCT team, season FROM cs),
rs AS MATERIALIZED (SELECT ts.team, al.season, al.i, al.j, a - COALESCE(n, 0) AS r FROM al JOIN ts ON ts.season = al.season LEFT JOIN cs ON cs.team = ts.team AND cs.season = al.season AND cs.i = al.i AND cs.j = al.j),
rz AS (SELECT team, season, SUM(r) AS s FROM rs GROUP BY 1, 2),
mx AS (SELECT team, coach, season, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY team, coach) AS w FROM tr GROUP BY 1, 2, 3),
cb AS MATERIALIZED (SELECT mx.team, coach, i, j, SUM(w * r / s) AS n FROM rs JOIN mx ON mx.team = rs.team AND mx.season = rs.season JOIN rz ON rz.team = rs.team AND rz.season = rs.season WHERE r > 0 GROUP BY 1, 2, 3, 4)"""


def contemporaries(spark, sf):
    tr = transitions(spark, sf)
    c = E.count_cells(tr, ("team", "season"))
    mix = tr.groupBy("team", "coach", "season").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return D.contemporaneous_cells(c, mix, [])


@query("d03_contemporaneous_base", sql(CONT, " SELECT team, coach, i, j, ROUND(n * 1000, 6) AS n FROM cb"))
def d03(spark, sf):
    return contemporaries(spark, sf).withColumn("n", F.round(F.col("n") * 1000, 6))


@query("d04_chain_did_points", rsql(CONT, """,
up AS (SELECT team, coach, from_state AS i, to_state AS j, CAST(COUNT(*) AS DOUBLE) AS n FROM tr GROUP BY 1, 2, 3, 4),
bo AS (SELECT 'unit' AS role, * FROM up UNION ALL SELECT 'base', * FROM cb),
pr0 AS (SELECT role, team, coach, i, j, n / SUM(n) OVER (PARTITION BY role, team, coach, i) AS p FROM bo),
fs AS (SELECT team, coach, poss_uid, MIN_BY(from_state, event_index) AS i FROM tr GROUP BY 1, 2, 3),
st AS (SELECT team, coach, i, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY team, coach) AS a FROM fs GROUP BY 1, 2, 3),
ur AS (SELECT role, x.team, x.coach, g.i, j.j, CAST(1 AS DOUBLE) / 84 AS p FROM (SELECT DISTINCT role, team, coach FROM bo) x CROSS JOIN (SELECT UNNEST(range(80)) AS i) g CROSS JOIN (SELECT UNNEST(range(84)) AS j) j WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.role = x.role AND bo.team = x.team AND bo.coach = x.coach AND bo.i = g.i)),
pa AS MATERIALIZED (SELECT * FROM pr0 UNION ALL SELECT * FROM ur),
it AS (SELECT 0 AS k, role, st.team, st.coach, i, a AS m FROM st, (SELECT UNNEST(['unit', 'base']) AS role)
  UNION ALL SELECT it.k + 1, pa.role, pa.team, pa.coach, pa.j, SUM(it.m * pa.p) FROM it JOIN pa ON pa.role = it.role AND pa.team = it.team AND pa.coach = it.coach AND pa.i = it.i WHERE it.i < 80 AND it.k < 150 GROUP BY it.k, pa.role, pa.team, pa.coach, pa.j),
sc AS (SELECT role, team, coach, SUM(CASE WHEN i < 80 THEN m ELSE 0 END) AS e_t, SUM(CASE WHEN i = 80 THEN m ELSE 0 END) AS p_goal, SUM(CASE WHEN i IN (80, 81) THEN m ELSE 0 END) AS p_shot FROM it GROUP BY 1, 2, 3)
SELECT u.team, u.coach, ROUND(LN(u.e_t / b.e_t), 6) AS d_e_t, CASE WHEN u.p_goal > 0 THEN ROUND(LN(u.p_goal / b.p_goal), 6) END AS d_p_goal, CASE WHEN u.p_shot > 0 THEN ROUND(LN(u.p_shot / b.p_shot), 6) END AS d_p_shot, ROUND(LN(u.e_t), 6) AS l_e_t
FROM sc u JOIN sc b ON u.team = b.team AND u.coach = b.coach AND u.role = 'unit' AND b.role = 'base'"""))
def d04(spark, sf):
    d = D.chain_did(transitions(spark, sf), SPACE, 1, 41).filter("b = 0")
    return rounded(d, ["team", "coach"], ["d_e_t", "d_p_goal", "d_p_shot", "l_e_t"])


@query("d04_chain_did_pairs")
def d04b(spark, sf):
    return D.did_pairs(D.chain_did(transitions(spark, sf), SPACE, 8, 41), "team", "coach", "d_e_t", "l_e_t")


LEAGUE = POSS + """,
us AS (SELECT team, coach, season, COUNT(*) AS n_u, SUM(len) AS s_u, SUM(shot) AS h_u FROM ps GROUP BY 1, 2, 3),
cl AS (SELECT team, season, SUM(n_u) AS n, SUM(s_u) AS s, SUM(h_u) AS h FROM us GROUP BY 1, 2),
rst AS (SELECT team, season, SUM(n) OVER (PARTITION BY season) - n AS n_b, SUM(s) OVER (PARTITION BY season) - s AS s_b, SUM(h) OVER (PARTITION BY season) - h AS h_b FROM cl),
jn AS (SELECT us.*, n_b, s_b, h_b FROM us JOIN rst ON rst.team = us.team AND rst.season = us.season)"""


def per_season(spark, sf, value):
    return possessions(spark, sf).groupBy("team", "coach", "season").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("s"))


def versus_league(spark, sf, value):
    return D.against_league(per_season(spark, sf, value), "team", "season", "n", "s", ["team", "coach"])


@query("d05_ratio_to_contemporaries", sql(LEAGUE, """
SELECT team, coach, ROUND((SUM(s_u) / SUM(n_u)) / (SUM(n_u * s_b / n_b) / SUM(n_u)), 6) AS ratio FROM jn GROUP BY 1, 2"""))
def d05(spark, sf):
    d = D.standardised_rate(versus_league(spark, sf, "len"), ["team", "coach"])
    return d.select("team", "coach", F.round(F.col("unit") / F.col("base"), 6).alias("ratio"))


@query("d05_ratio_null_by_season", sql(LEAGUE, """,
r AS (SELECT team, season, (s / n) / (SELECT s_b / n_b FROM rst WHERE rst.team = cl.team AND rst.season = cl.season) AS ratio FROM cl)
SELECT team, season, ROUND(ratio, 6) AS ratio, ROUND((RANK() OVER (ORDER BY ROUND(ratio, 9)) - 1 + 0.5 * COUNT(*) OVER (PARTITION BY ROUND(ratio, 9))) / COUNT(*) OVER (), 6) AS null_position FROM r"""))
def d05b(spark, sf):
    per = per_season(spark, sf, "len").groupBy("team", "season").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    d = D.standardised_rate(D.against_league(per, "team", "season", "n", "s", ["team"]), ["team", "season"])
    d = d.select(F.lit(1).alias("k"), "team", "season", F.round(F.col("unit") / F.col("base"), 9).alias("r"))
    d = Q.midrank(d, ["k"], "r", "p", F.floor(F.col("r") * 16))
    return d.select("team", "season", F.round("r", 6).alias("ratio"), F.round("p_share", 6).alias("null_position"))


@query("d06_league_panorama", sql(LEAGUE, """
SELECT team, season, ROUND(SUM(s_u) / SUM(n_u), 6) AS actions, ROUND(100 * SUM(h_u) / SUM(n_u), 6) AS shots_100, ROUND((SUM(s_u) / SUM(n_u)) / (MAX(s_b) / MAX(n_b)), 6) AS ratio, CAST(SUM(n_u) AS DOUBLE) AS possessions FROM jn GROUP BY 1, 2"""))
def d06(spark, sf):
    ps = possessions(spark, sf).groupBy("team", "season").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("len").alias("s"), F.sum("shot").alias("h"))
    d = Q.leave_unit_out(ps, "team", ["season"], ["n", "s"])
    return d.select("team", "season", F.round(F.col("s") / F.col("n"), 6).alias("actions"),
                    F.round(100 * F.col("h") / F.col("n"), 6).alias("shots_100"),
                    F.round(F.col("s") / F.col("n") / (F.col("rest_s") / F.col("rest_n")), 6).alias("ratio"),
                    F.col("n").alias("possessions"))


@query("d07_parallel_trend", sql(TR, """,
g AS (SELECT team, season, season_order, SUM(CASE WHEN action_type = 'Carry' THEN 1 ELSE 0 END) AS c, SUM(CASE WHEN action_type = 'Pass' THEN 1 ELSE 0 END) AS p FROM tr GROUP BY 1, 2, 3),
r AS (SELECT team, season_order, c / GREATEST(p, 1) AS own, (SUM(c) OVER (PARTITION BY season) - c) / GREATEST(SUM(p) OVER (PARTITION BY season) - p, 1) AS base FROM g)
SELECT team, ROUND(REGR_SLOPE(own - base, CAST(season_order AS DOUBLE)), 6) AS slope, CAST(COUNT(*) AS BIGINT) AS seasons FROM r GROUP BY team"""))
def d07(spark, sf):
    g = transitions(spark, sf).groupBy("team", "season", "season_order").agg(
        F.sum((F.col("action_type") == "Carry").cast("bigint")).alias("c"),
        F.sum((F.col("action_type") == "Pass").cast("bigint")).alias("p"))
    d = Q.leave_unit_out(g, "team", ["season"], ["c", "p"])
    one = F.lit(1)
    d = d.withColumns({"own": F.col("c") / F.greatest(F.col("p"), one), "base": F.col("rest_c") / F.greatest(F.col("rest_p"), one)})
    return D.parallel_trend(d, ["team"], "own", "base", "season_order").withColumn("slope", F.round("slope", 6))


@query("d07_slope_interval", sql(TR, """,
gm AS MATERIALIZED (SELECT team, match_id, season, season_order, SUM(CASE WHEN action_type = 'Carry' THEN 1 ELSE 0 END) AS c, SUM(CASE WHEN action_type = 'Pass' THEN 1 ELSE 0 END) AS p FROM tr GROUP BY 1, 2, 3, 4),
ls AS (SELECT season, SUM(c) AS c, SUM(p) AS p FROM gm GROUP BY 1), os AS (SELECT team, season, SUM(c) AS c, SUM(p) AS p FROM gm GROUP BY 1, 2),
bs AS (SELECT os.team, os.season, (ls.c - os.c) / GREATEST(ls.p - os.p, 1) AS base FROM os JOIN ls ON ls.season = os.season)""" + weights_sql("gm", "team", "match_id", 20, 53) + """,
rp AS (SELECT team, season, season_order, b, SUM(w * c) / GREATEST(SUM(w * p), 1) AS own FROM gm JOIN wt ON wt.s = team AND wt.k = match_id GROUP BY 1, 2, 3, 4),
sp AS (SELECT rp.team, b, REGR_SLOPE(own - base, CAST(season_order AS DOUBLE)) AS v FROM rp JOIN bs ON bs.team = rp.team AND bs.season = rp.season GROUP BY 1, 2),
ag AS (SELECT team, MAX(CASE WHEN b = 0 THEN v END) AS t, quantile_cont(v, 0.025) FILTER (WHERE b > 0) AS ql, quantile_cont(v, 0.975) FILTER (WHERE b > 0) AS qh FROM sp GROUP BY 1)
SELECT team, ROUND(t, 6) AS point, ROUND(2 * t - qh, 6) AS lo, ROUND(2 * t - ql, 6) AS hi FROM ag"""))
def d07b(spark, sf):
    """Slope of a team against its contemporaries with the team's matches redrawn; the others stay as they are."""
    g = transitions(spark, sf).groupBy("team", "match_id", "season", "season_order").agg(
        F.sum((F.col("action_type") == "Carry").cast("double")).alias("c"), F.sum((F.col("action_type") == "Pass").cast("double")).alias("p"))
    return rounded(D.slope_intervals(g, "team", 20, 53), ["team"], ["point", "lo", "hi"])


@query("d08_drift_report", sql(TR, """,
g AS (SELECT season_order, team, COUNT(*) / COUNT(DISTINCT match_id) AS rows_match, COUNT(*) / COUNT(DISTINCT poss_uid) AS len, AVG(CASE WHEN action_type = 'Carry' THEN 1.0 ELSE 0.0 END) AS carry, AVG(CASE WHEN from_state = to_state THEN 1.0 ELSE 0.0 END) AS loops FROM tr GROUP BY 1, 2),
s AS (SELECT season_order, AVG(rows_match) AS rows_match, AVG(len) AS len, STDDEV_SAMP(len) AS sd_len, AVG(carry) AS carry, AVG(loops) AS loops FROM g GROUP BY 1),
l AS (SELECT g.*, len - LAG(len) OVER (PARTITION BY team ORDER BY season_order) AS step FROM g),
y AS (SELECT season_order, AVG(CASE WHEN step > 0 THEN 1.0 WHEN step <= 0 THEN 0.0 END) AS up_share FROM l GROUP BY 1)
SELECT s.season_order, ROUND(rows_match, 6) AS rows_match, ROUND(len, 6) AS len, ROUND(sd_len, 6) AS sd_len, ROUND(carry, 6) AS carry, ROUND(loops, 6) AS loops, ROUND(rows_match / LAG(rows_match) OVER (ORDER BY s.season_order) - 1, 6) AS growth, ROUND(up_share, 6) AS up_share FROM s JOIN y ON y.season_order = s.season_order"""))
def d08(spark, sf):
    n = F.count(F.lit(1))
    g = transitions(spark, sf).groupBy("season_order", "team").agg(
        (n / F.countDistinct("match_id")).alias("rows_match"), (n / F.countDistinct("poss_uid")).alias("len"),
        F.avg((F.col("action_type") == "Carry").cast("double")).alias("carry"),
        F.avg((F.col("from_state") == F.col("to_state")).cast("double")).alias("loops"))
    # a season table: one row per (season, club) or per season
    step = F.col("len") - F.lag("len").over(Window.partitionBy("team").orderBy("season_order"))
    g = g.withColumn("step", step)
    s = g.groupBy("season_order").agg(
        F.avg("rows_match").alias("rows_match"), F.avg("len").alias("len"), F.stddev_samp("len").alias("sd_len"),
        F.avg("carry").alias("carry"), F.avg("loops").alias("loops"),
        F.avg((F.col("step") > 0).cast("double")).alias("up_share"))
    prev = F.lag("rows_match").over(Window.partitionBy(F.lit(1)).orderBy("season_order"))
    s = s.withColumn("growth", F.col("rows_match") / prev - 1)
    return rounded(s, ["season_order"], ["rows_match", "len", "sd_len", "carry", "loops", "growth", "up_share"])


@query("d08_pattern_divergence", sql(TR, """,
g AS (SELECT season_order, phase, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY season_order) AS p FROM tr WHERE event_index = 1 GROUP BY 1, 2),
x AS (SELECT a.season_order, a.phase, b.p AS p0, a.p AS p1 FROM g a JOIN g b ON b.season_order = a.season_order - 1 AND a.phase = b.phase)
SELECT season_order, ROUND(0.5 * SUM(ABS(p1 - p0)), 6) AS tv, ROUND(SUM(p1 * LN(p1 / p0)), 6) AS kl FROM x GROUP BY 1"""))
def d08b(spark, sf):
    g = transitions(spark, sf).filter("event_index = 1").groupBy("season_order", "phase").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("season_order"))).drop("n")
    before = g.select((F.col("season_order") + 1).alias("season_order"), "phase", F.col("p").alias("p0"))
    x = g.join(before, ["season_order", "phase"])
    return x.groupBy("season_order").agg(F.round(0.5 * F.sum(F.abs(F.col("p") - F.col("p0"))), 6).alias("tv"),
                                         F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("p0"))), 6).alias("kl"))


@query("d09_standardised_rate", sql(LEAGUE, """
SELECT team, coach, ROUND(SUM(h_u) / SUM(n_u), 6) AS unit, ROUND(SUM(n_u * h_b / n_b) / SUM(n_u), 6) AS base, ROUND(SUM(h_u) / SUM(n_u) - SUM(n_u * h_b / n_b) / SUM(n_u), 6) AS did FROM jn GROUP BY 1, 2"""))
def d09(spark, sf):
    return rounded(D.standardised_rate(versus_league(spark, sf, "shot"), ["team", "coach"]), ["team", "coach"],
                   ["unit", "base", "did"])


CONTEXT = TR + """,
px AS (SELECT team, season, match_id, poss_uid, MIN_BY(score_state, event_index) AS score, MIN(match_id % 2) AS home, MIN(event_index + possession % 90) AS minute, MAX(CASE WHEN to_state IN (80, 81) THEN 1.0 ELSE 0.0 END) AS shot FROM tr GROUP BY 1, 2, 3, 4),
lv AS (SELECT team, season, shot, 'score' AS context, score AS level FROM px UNION ALL SELECT team, season, shot, 'side', CASE WHEN home = 0 THEN 'home' ELSE 'away' END FROM px UNION ALL SELECT team, season, shot, 'moment', CASE WHEN minute >= 60 THEN 'late' ELSE 'early' END FROM px),
g AS (SELECT team, context, level, season, CAST(COUNT(*) AS DOUBLE) AS n, SUM(shot) AS s FROM lv GROUP BY 1, 2, 3, 4),
jn AS (SELECT team, context, level, season, n, s, SUM(n) OVER (PARTITION BY context, level, season) - n AS nb, SUM(s) OVER (PARTITION BY context, level, season) - s AS sb FROM g),
rt AS (SELECT team, context, level, SUM(s) / SUM(n) AS u, CASE WHEN MAX(CASE WHEN nb <= 0 THEN 1 ELSE 0 END) = 0 THEN SUM(n * sb / nb) / SUM(n) END AS b FROM jn GROUP BY 1, 2, 3),
ab AS (SELECT * FROM (VALUES ('score', 'losing', 'winning'), ('side', 'home', 'away'), ('moment', 'late', 'early')) v(context, la, lb))
SELECT x.team, x.context, ROUND(x.u - y.u, 6) AS adjust_unit, ROUND(x.b - y.b, 6) AS adjust_base, ROUND((x.u - y.u) - (x.b - y.b), 6) AS theta
FROM ab JOIN rt x ON x.context = ab.context AND x.level = la JOIN rt y ON y.context = ab.context AND y.level = lb AND y.team = x.team"""


@query("d10_context_adjustment", sql("", CONTEXT.strip()))
def d10(spark, sf):
    tr = transitions(spark, sf)
    px = tr.groupBy("team", "season", "match_id", "poss_uid").agg(
        F.min_by("score_state", "event_index").alias("score"), F.min(F.col("match_id") % 2).alias("home"),
        F.min(F.col("event_index") + F.col("possession") % 90).alias("minute"),
        F.max(F.col("to_state").isin(80, 81).cast("double")).alias("shot"))
    lv = F.array(F.struct(F.lit("score").alias("context"), F.col("score").alias("level")),
                 F.struct(F.lit("side").alias("context"), F.when(F.col("home") == 0, "home").otherwise("away").alias("level")),
                 F.struct(F.lit("moment").alias("context"), S.moment_level(F.col("minute")).alias("level")))
    d = px.withColumn("c", F.explode(lv)).groupBy("team", "c.context", "c.level", "season").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("shot").alias("s"))
    d = Q.leave_unit_out(d, "team", ["context", "level", "season"], ["n", "s"]).select(
        "team", "context", "level", "season", F.col("n").alias("n_u"), F.col("s").alias("s_u"),
        F.col("rest_n").alias("n_b"), F.col("rest_s").alias("s_b"))
    out = None
    for context, la, lb in (("score", "losing", "winning"), ("side", "home", "away"), ("moment", "late", "early")):
        one = D.context_adjustment(d.filter(F.col("context") == context), ["team", "context"], la, lb)
        out = one if out is None else out.unionByName(one)
    return rounded(out.filter("adjust_unit is not null"), ["team", "context"], ["adjust_unit", "adjust_base", "theta"])


@query("d11_stratified_theta", sql(FA, """,
c AS (SELECT team, match_id, COUNT(*) % 5 AS stratum, AVG(start_x) FILTER (WHERE match_id % 3 > 0) AS d FROM actions GROUP BY 1, 2),
u AS (SELECT team, stratum, COUNT(d) AS w, SUM(d) AS s FROM c GROUP BY 1, 2),
j AS (SELECT team, stratum, w, COALESCE(s, 0) AS s, SUM(w) OVER (PARTITION BY stratum) - w AS wb, SUM(COALESCE(s, 0)) OVER (PARTITION BY stratum) - COALESCE(s, 0) AS sb FROM u)
SELECT team, ROUND(SUM(s) / SUM(w), 6) AS unit, ROUND(SUM(CASE WHEN w > 0 AND wb > 0 THEN w * sb / wb END) / SUM(CASE WHEN w > 0 AND wb > 0 THEN w END), 6) AS league, ROUND(1 - COALESCE(SUM(CASE WHEN w > 0 AND wb > 0 THEN w END), 0) / SUM(w), 6) AS discarded,
 ROUND(SUM(s) / SUM(w) - SUM(CASE WHEN w > 0 AND wb > 0 THEN w * sb / wb END) / SUM(CASE WHEN w > 0 AND wb > 0 THEN w END), 6) AS theta FROM j GROUP BY team"""))
def d11(spark, sf):
    c = moves(spark, sf).groupBy("team", "match_id").agg(
        (F.count(F.lit(1)) % 5).alias("stratum"), F.avg(F.when(F.col("match_id") % 3 > 0, F.col("start_x"))).alias("d"))
    u = c.groupBy("team", "stratum").agg(F.count("d").alias("w"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("s"))
    d = Q.leave_unit_out(u, "team", ["stratum"], ["w", "s"]).select(
        "team", "stratum", F.col("w").alias("w_u"), F.col("s").alias("d_u"), F.col("rest_w").alias("w_b"), F.col("rest_s").alias("d_b"))
    return rounded(D.stratified_theta(d, ["team"]), ["team"], ["unit", "league", "discarded", "theta"])


BUCKET = "CASE WHEN len <= 3 THEN CAST(CAST(len AS BIGINT) AS VARCHAR) WHEN len <= 5 THEN '4-5' WHEN len <= 7 THEN '6-7' WHEN len <= 10 THEN '8-10' ELSE '11+' END"


@query("d12_kitagawa", sql(POSS, f""",
c AS (SELECT team, coach, {BUCKET} AS bucket, COUNT(*) AS n, AVG(pr) AS m FROM ps GROUP BY 1, 2, 3),
w AS (SELECT *, n / SUM(n) OVER (PARTITION BY team, coach) AS w FROM c),
pr AS (SELECT DISTINCT x.team, x.coach AS a, y.coach AS b FROM w x JOIN w y ON x.team = y.team AND x.coach < y.coach),
g AS (SELECT pr.*, bk.bucket, COALESCE(x.w, 0) AS wa, COALESCE(y.w, 0) AS wb, x.m AS ma, y.m AS mb FROM pr JOIN (SELECT DISTINCT team, bucket FROM w) bk ON bk.team = pr.team LEFT JOIN w x ON x.team = pr.team AND x.coach = a AND x.bucket = bk.bucket LEFT JOIN w y ON y.team = pr.team AND y.coach = b AND y.bucket = bk.bucket)
SELECT team, a, b, ROUND(SUM(CASE WHEN ma IS NOT NULL AND mb IS NOT NULL THEN (wa + wb) / 2 * (ma - mb) ELSE 0 END), 6) AS within, ROUND(SUM(CASE WHEN ma IS NOT NULL AND mb IS NOT NULL THEN (wa - wb) * (ma + mb) / 2 ELSE 0 END), 6) AS composition,
 ROUND(SUM(wa * COALESCE(ma, 0) - wb * COALESCE(mb, 0)), 6) AS total FROM g GROUP BY 1, 2, 3"""))
def d12(spark, sf):
    ps = possessions(spark, sf).withColumn("bucket", S.length_bucket(F.col("len").cast("bigint")))
    return rounded(D.kitagawa(ps, ["team"], "coach", "bucket", "pressure_rate"), ["team", "a", "b"],
                   ["within", "composition", "total"])


def permuted_sql(rows: str, stratum: str, block: str, label: str, B: int, seed: int) -> str:
    """Labels shuffled between blocks of a stratum (table pl: s, k, b, l), as the Spark kernel does."""
    return f""",
lb AS (SELECT DISTINCT {stratum} AS s, {block} AS k, {label} AS l FROM {rows}),
sb AS (SELECT s, l, ROW_NUMBER() OVER (PARTITION BY s ORDER BY l, k) AS slot FROM lb),
sp AS (SELECT s, k, b, ROW_NUMBER() OVER (PARTITION BY s, b ORDER BY {draw_sql(f"'{seed}'", "b", "k")}, k) AS slot FROM lb, (SELECT UNNEST(range(1, {B + 1})) AS b)),
pl AS MATERIALIZED (SELECT sp.s, sp.k, sp.b, sb.l FROM sp JOIN sb ON sb.s = sp.s AND sb.slot = sp.slot UNION ALL SELECT s, k, 0, l FROM lb)"""


NULL_SQL = """ROUND(MAX(CASE WHEN b = 0 THEN v END), 6) AS observed, ROUND(QUANTILE_CONT(x, 0.5) FILTER (WHERE b > 0), 6) AS null_median,
 ROUND((1 + SUM(CASE WHEN b > 0 AND x >= o - 1e-12 THEN 1 ELSE 0 END)) / (1.0 + SUM(CASE WHEN b > 0 THEN 1 ELSE 0 END)), 6) AS p"""


def null_summary(reps, keys, value, two_sided=False):
    d = R.permutation_p(reps, keys, value, two_sided)
    return rounded(d, keys, ["observed", "null_median", "p"])


@query("d12_kitagawa_null", sql(POSS, permuted_sql("ps", "team", "match_id", "coach", 1000, 51) + f""",
c AS (SELECT ps.team, b AS rep, l AS coach, {BUCKET} AS bucket, COUNT(*) AS n, AVG(pr) AS m FROM ps JOIN pl ON pl.s = team AND pl.k = ps.match_id GROUP BY 1, 2, 3, 4),
w AS (SELECT *, n / SUM(n) OVER (PARTITION BY team, rep, coach) AS w FROM c),
g AS (SELECT x.team, x.rep AS b, x.coach AS a, y.coach AS c, SUM((x.w + y.w) / 2 * (x.m - y.m)) AS v FROM w x JOIN w y ON x.team = y.team AND x.rep = y.rep AND x.bucket = y.bucket AND x.coach < y.coach GROUP BY 1, 2, 3, 4),
t3 AS (SELECT team, a, c, b, v, ABS(v) AS x, MAX(CASE WHEN b = 0 THEN ABS(v) END) OVER (PARTITION BY team, a, c) AS o FROM g)
SELECT team, a, c, """ + NULL_SQL + " FROM t3 GROUP BY 1, 2, 3"))
def d12b(spark, sf):
    ps = possessions(spark, sf).withColumn("bucket", S.length_bucket(F.col("len").cast("bigint")))
    perm = R.permutation_labels(ps.select("team", "match_id", "coach"), ["team"], "match_id", "coach", 1000, 51)
    # match x bucket cells carry sums, so replicates never touch possessions
    cell = ps.groupBy("team", "match_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("pressure_rate").alias("s"))
    d = cell.join(perm, ["team", "match_id"]).withColumnRenamed("b", "rep")
    flat = d.groupBy("team", "rep", "coach", "bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    flat = flat.withColumn("m", F.col("s") / F.col("n"))
    flat = flat.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("team", "rep", "coach")))
    p = D.pairs_of(flat, ["team", "rep", "bucket"], "coach", ["w", "m"])
    x = p.groupBy("team", "rep", "a", "b").agg(
        F.sum((F.col("w_a") + F.col("w_b")) / 2 * (F.col("m_a") - F.col("m_b"))).alias("within"))
    x = x.withColumnRenamed("b", "c").withColumnRenamed("rep", "b")
    return null_summary(x, ["team", "a", "c"], "within", two_sided=True)


@query("d13_covariance_identity", sql(POSS, """
SELECT team, ROUND(AVG(pr), 6) AS per_possession, ROUND(SUM(len * pr) / SUM(len), 6) AS per_action, ROUND(COVAR_POP(len, pr) / AVG(len), 6) AS cov_over_mean FROM ps GROUP BY team"""))
def d13(spark, sf):
    return rounded(D.covariance_identity(possessions(spark, sf), ["team"], "len", "pressure_rate"), ["team"],
                   ["per_possession", "per_action", "cov_over_mean"])


ZONES = TR + """,
mz AS MATERIALIZED (SELECT team, coach, match_id, season, match_date, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone, CAST(COUNT(*) AS DOUBLE) AS y FROM tr WHERE action_type <> 'TERMINAL' GROUP BY 1, 2, 3, 4, 5, 6),
lg AS MATERIALIZED (SELECT season, zone, SUM(y) / SUM(SUM(y)) OVER (PARTITION BY season) AS share FROM mz GROUP BY 1, 2)"""


def excess_sql(source: str, era: str) -> str:
    return f""",
nt AS (SELECT team, {era} AS era, season, SUM(y) AS n FROM {source} GROUP BY 1, 2, 3),
ef AS (SELECT nt.team, era, zone, SUM(n * share) AS e FROM nt JOIN lg ON lg.season = nt.season GROUP BY 1, 2, 3),
ow AS (SELECT team, {era} AS era, zone, SUM(y) AS y FROM {source} GROUP BY 1, 2, 3),
ex AS MATERIALIZED (SELECT ef.team, ef.era, ef.zone, (COALESCE(y, 0) - e) / SUM(COALESCE(y, 0)) OVER (PARTITION BY ef.team, ef.era) AS excess FROM ef LEFT JOIN ow ON ow.team = ef.team AND ow.era = ef.era AND ow.zone = ef.zone),
tt AS (SELECT x.team, x.era AS a, y.era AS b, 0.5 * SUM(ABS(x.excess - y.excess)) AS T FROM ex x JOIN ex y ON x.team = y.team AND x.zone = y.zone AND x.era < y.era GROUP BY 1, 2, 3)"""


def match_zones(spark, sf, extra=()):
    z = transitions(spark, sf).filter("action_type <> 'TERMINAL'").groupBy(
        "team", "coach", "match_id", "season", "match_date", *extra,
        SPACE.zone_of_state(F.col("from_state")).alias("zone")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    g = z.groupBy("season", "zone").agg(F.sum("y").alias("y"))
    return z, g.select("season", "zone", (F.col("y") / F.sum("y").over(Window.partitionBy("season"))).alias("share"))


@query("d15_occupancy_shift", sql(ZONES, excess_sql("mz", "coach") + " SELECT team, a, b, ROUND(T, 6) AS \"T\" FROM tt"))
def d15(spark, sf):
    z, lg = match_zones(spark, sf)
    ex = D.occupancy_excess(z, lg, ["team", "coach"], F.lit(1.0))
    return D.total_shift(ex, ["team"], "coach").withColumn("T", F.round("T", 6))


@query("d15_occupancy_shift_null", sql(ZONES, permuted_sql("mz", "team", "match_id", "coach", 6, 61) + """,
mp AS (SELECT team || '|' || b AS team, l AS coach, season, zone, y FROM mz JOIN pl ON pl.s = team AND pl.k = match_id)""" + excess_sql("mp", "coach") + """,
t2 AS (SELECT split_part(team, '|', 1) AS team, CAST(split_part(team, '|', 2) AS INTEGER) AS rep, a, b AS c, T FROM tt),
t3 AS (SELECT team, a, c, rep AS b, T AS v, T AS x, MAX(CASE WHEN rep = 0 THEN T END) OVER (PARTITION BY team, a, c) AS o FROM t2)
SELECT team, a, c, """ + NULL_SQL + " FROM t3 GROUP BY 1, 2, 3"))
def d15b(spark, sf):
    z, lg = match_zones(spark, sf)
    perm = R.permutation_labels(z.select("team", "match_id", "coach"), ["team"], "match_id", "coach", 6, 61)
    d = z.groupBy("team", "match_id", "season", "zone").agg(F.sum("y").alias("y")).join(perm, ["team", "match_id"])
    ex = D.occupancy_excess(d.withColumnRenamed("b", "rep"), lg, ["team", "rep", "coach"], F.lit(1.0))
    t = D.total_shift(ex, ["team", "rep"], "coach").withColumnRenamed("b", "c").withColumnRenamed("rep", "b")
    return null_summary(t, ["team", "a", "c"], "T")


@query("d16_half_era_placebo", sql(ZONES, """,
md AS (SELECT team, coach, match_id, MIN(match_date) AS d FROM mz GROUP BY 1, 2, 3),
hf AS (SELECT team, coach, match_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY team, coach ORDER BY d, match_id) <= CEIL(COUNT(*) OVER (PARTITION BY team, coach) / 2.0) THEN 1 ELSE 2 END AS half FROM md),
mh AS (SELECT mz.team || '|' || mz.coach AS team, half, mz.season, zone, y FROM mz JOIN hf ON hf.team = mz.team AND hf.coach = mz.coach AND hf.match_id = mz.match_id)""" + excess_sql("mh", "half") + """
SELECT split_part(team, '|', 1) AS team, split_part(team, '|', 2) AS coach, ROUND(T, 6) AS "T" FROM tt"""))
def d16(spark, sf):
    z, lg = match_zones(spark, sf)
    days = z.groupBy("team", "coach", "match_id").agg(F.min("match_date").alias("d"))
    h = Q.halves(days, ["team", "coach"], ["d", "match_id"], True, F.year("d")).drop("d")
    ex = D.occupancy_excess(z.join(h, ["team", "coach", "match_id"]), lg, ["team", "coach", "half"], F.lit(1.0))
    return D.total_shift(ex, ["team", "coach"], "half").select("team", "coach", F.round("T", 6).alias("T"))


@query("d14_midpoint_decomposition", sql(TR, """,
pz AS MATERIALIZED (SELECT team, coach, player_id, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone, CAST(COUNT(*) AS DOUBLE) AS y FROM tr WHERE action_type <> 'TERMINAL' GROUP BY 1, 2, 3, 4),
lz AS (SELECT zone, SUM(y) / (SELECT SUM(y) FROM pz) AS share FROM pz GROUP BY 1),
ne AS (SELECT team, coach, SUM(y) AS nn FROM pz GROUP BY 1, 2),
tp AS (SELECT pz.team, pz.coach, player_id, SUM(y) AS n, SUM(y) / MAX(nn) AS w FROM pz JOIN ne ON ne.team = pz.team AND ne.coach = pz.coach GROUP BY 1, 2, 3),
sh AS (SELECT x.team, x.coach AS a, y.coach AS b, x.player_id, x.w AS wa, y.w AS wb, x.n AS na, y.n AS nb FROM tp x JOIN tp y ON x.team = y.team AND x.player_id = y.player_id AND x.coach < y.coach WHERE x.n >= 15 AND y.n >= 15),
xz AS (SELECT ne.team, ne.coach, lz.zone, COALESCE(SUM(y), 0) / MAX(nn) - MAX(share) AS x FROM ne CROSS JOIN lz LEFT JOIN pz ON pz.team = ne.team AND pz.coach = ne.coach AND pz.zone = lz.zone GROUP BY 1, 2, 3),
dl AS (SELECT x.team, x.coach AS a, y.coach AS b, x.zone, y.x - x.x AS delta FROM xz x JOIN xz y ON x.team = y.team AND x.zone = y.zone AND x.coach < y.coach),
us AS (SELECT sh.team, a, b, lz.zone, SUM((wa + wb) / 2 * ((COALESCE(py.y, 0) / nb - share) - (COALESCE(px.y, 0) / na - share))) AS u FROM sh CROSS JOIN lz LEFT JOIN pz px ON px.team = sh.team AND px.coach = a AND px.player_id = sh.player_id AND px.zone = lz.zone LEFT JOIN pz py ON py.team = sh.team AND py.coach = b AND py.player_id = sh.player_id AND py.zone = lz.zone GROUP BY 1, 2, 3, 4)
SELECT dl.team, dl.a, dl.b, ROUND(0.5 * SUM(ABS(delta)), 6) AS "T", ROUND(0.5 * SUM(ABS(COALESCE(u, 0))), 6) AS "U", ROUND(0.5 * SUM(ABS(delta - COALESCE(u, 0))), 6) AS "C", ROUND(SUM(ABS(COALESCE(u, 0))) / (SUM(ABS(COALESCE(u, 0))) + SUM(ABS(delta - COALESCE(u, 0)))), 6) AS phi_u
FROM dl LEFT JOIN us ON us.team = dl.team AND us.a = dl.a AND us.b = dl.b AND us.zone = dl.zone GROUP BY 1, 2, 3"""))
def d14(spark, sf):
    pz = transitions(spark, sf).filter("action_type <> 'TERMINAL'").groupBy(
        "team", "coach", "player_id", SPACE.zone_of_state(F.col("from_state")).alias("zone")).agg(
        F.count(F.lit(1)).cast("double").alias("y"))
    lz = pz.groupBy("zone").agg(F.sum("y").alias("y"))
    total = lz.agg(F.sum("y").alias("all"))
    lz = lz.crossJoin(F.broadcast(total)).select("zone", (F.col("y") / F.col("all")).alias("share"))
    league = pz.select("team", "coach").distinct().crossJoin(F.broadcast(lz))
    d = D.midpoint_decomposition(pz, league, ["team"], "coach", 15)
    return rounded(d, ["team", "a", "b"], ["T", "U", "C", "phi_u"])


@query("d17_progression_did")
def d17(spark, sf):
    """Reach of the last column and steps to it: log ratio to contemporaries per replicate, pairs."""
    tr = transitions(spark, sf)
    c = E.count_cells(tr, ("team", "coach", "match_id"))
    first = tr.groupBy("team", "coach", "match_id", "poss_uid").agg(F.min_by("from_state", "event_index").alias("i"))
    a = first.groupBy("team", "coach", "match_id", "i").agg(F.count(F.lit(1)).cast("double").alias("a"))
    on, unit = ["team", "coach", "match_id"], ["team", "coach"]
    w = R.multinomial_weights(c.select(*on), unit, "match_id", 6, 71)
    P_ = E.mle(R.replicate_sums(c, w, on, [*unit, "i", "j"], ["n"]), [*unit, "b"])
    al = R.replicate_sums(a, w, on, [*unit, "i"], ["a"])
    r = C.first_passage(P_, al, [*unit, "b"], SPACE, 4)
    base = C.first_passage(E.mle(contemporaries(spark, sf), unit),
                           C.starts(tr, unit), unit, SPACE, 4).select(
        *unit, F.col("reach").alias("reach_b"), F.col("steps").alias("steps_b"))
    r = r.join(base, unit)
    r = r.select(*unit, "b", S.log_ratio(F.col("reach"), F.col("reach_b")).alias("d"),
                 S.log_ratio(F.col("steps"), F.col("steps_b")).alias("l"))
    return D.did_pairs(r, "team", "coach", "d", "l")


FEATURES = ["len", "shot", "pr", "goals"]


def profiles(spark, sf):
    p = possessions(spark, sf)
    return p.groupBy("coach").agg(F.avg("len").alias("len"), F.avg("shot").alias("shot"),
                                  F.avg("pressure_rate").alias("pr"), F.avg(F.col("goal").cast("double")).alias("goals"))


PROF = POSS + """,
gl AS (SELECT poss_uid, MAX(CASE WHEN to_state = 80 THEN 1.0 ELSE 0.0 END) AS g FROM tr GROUP BY 1),
pf AS (SELECT coach, AVG(len) AS len, AVG(shot) AS shot, AVG(pr) AS pr, AVG(g) AS goals FROM ps JOIN gl ON gl.poss_uid = ps.poss_uid GROUP BY 1),
zs AS MATERIALIZED (SELECT coach, """ + ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS {c}" for c in FEATURES) + " FROM pf)"


@query("d18_profile_distances", sql(PROF, """,
ds AS (SELECT x.coach AS a, y.coach AS b, ROUND(SQRT(POW(x.len - y.len, 2) + POW(x.shot - y.shot, 2) + POW(x.pr - y.pr, 2) + POW(x.goals - y.goals, 2)), 9) AS distance FROM zs x JOIN zs y ON x.coach < y.coach)
SELECT a, b, ROUND(distance, 6) AS distance, ROUND((RANK() OVER (ORDER BY distance) - 1 + 0.5 * COUNT(*) OVER (PARTITION BY distance)) / COUNT(*) OVER (), 6) AS percentile FROM ds"""))
def d18(spark, sf):
    m = D.profile_map(profiles(spark, sf), "coach", FEATURES)
    return rounded(D.profile_distances(m, "coach", FEATURES), ["a", "b"], ["distance", "percentile"])


@query("d18_profile_map")
def d18b(spark, sf):
    return D.profile_map(profiles(spark, sf), "coach", FEATURES).select("coach", "pc1", "pc2")


@query("d18_embedding_map")
def d18c(spark, sf):
    """The same projection for wide profiles: scaler and PCA from the ML library, all dimensions."""
    return D.wide_profile_map(load(spark, sf, "embeddings"), "vec_id", "embedding")


@query("d19_points_per_match", sql(FA, """,
g AS (SELECT match_id, team, MIN(opponent) AS opponent, MIN(coach) AS coach, SUM(CASE WHEN outcome = 'GOAL' THEN 1 ELSE 0 END) AS gf FROM actions GROUP BY 1, 2),
m AS (SELECT g.*, COALESCE(o.gf, 0) AS ga FROM g LEFT JOIN g o ON o.match_id = g.match_id AND o.team = g.opponent)
SELECT team, coach, CAST(COUNT(*) AS BIGINT) AS matches, ROUND(AVG(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END), 6) AS points FROM m GROUP BY 1, 2"""))
def d19(spark, sf):
    g = moves(spark, sf).groupBy("match_id", "team").agg(
        F.min("opponent").alias("opponent"), F.min("coach").alias("coach"),
        F.sum((F.col("outcome") == "GOAL").cast("bigint")).alias("scored"))
    o = g.select("match_id", F.col("team").alias("opponent"), F.col("scored").alias("conceded"))
    m = g.join(o, ["match_id", "opponent"], "left").na.fill({"conceded": 0})
    return m.groupBy("team", "coach").agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg(D.points()), 6).alias("points"))


# -- pressure ------------------------------------------------------------------------------------------
RIVAL = TR + """,
mirror AS (SELECT *, (4 - CAST(FLOOR(FLOOR(from_state / 4) / 4) AS BIGINT)) * 4 + (3 - CAST(FLOOR(from_state / 4) AS BIGINT) % 4) AS zone, CASE WHEN under_pressure THEN 1.0 ELSE 0.0 END AS y FROM tr WHERE action_type <> 'TERMINAL'),
fc AS (SELECT team AS opponent, match_id, MIN(coach) AS coach_faced FROM tr GROUP BY 1, 2),
ra AS MATERIALIZED (SELECT m.match_id, m.poss_uid, m.team AS rival, m.opponent, fc.coach_faced, m.season, m.zone, m.y, m.event_index, m.phase, m.action_type, m.to_state,
  ROW_NUMBER() OVER (PARTITION BY m.poss_uid ORDER BY m.event_index) AS k, COUNT(*) OVER (PARTITION BY m.poss_uid) AS length FROM mirror m JOIN fc ON fc.opponent = m.opponent AND fc.match_id = m.match_id)"""


def rival(spark, sf):
    tr = transitions(spark, sf)
    faced = tr.groupBy(F.col("team").alias("opponent"), "match_id").agg(F.min("coach").alias("coach_faced"))
    acts = P.rival_actions(tr.join(faced, ["opponent", "match_id"]), SPACE)
    return acts.withColumnRenamed("team", "rival")


def rival_k(spark, sf):
    d = rival(spark, sf).drop("k", "length")
    # event_index counts real actions from 1, so it is the position already
    size = d.groupBy("poss_uid").agg(F.count(F.lit(1)).alias("length"))
    return d.join(size, "poss_uid").withColumn("k", F.col("event_index"))


def match_cells(spark, sf):
    return rival(spark, sf).groupBy("opponent", "coach_faced", "rival", "match_id", "zone").agg(
        F.sum("y").alias("pressed"), F.count(F.lit(1)).cast("double").alias("n"))


@query("q01_rival_actions", sql(RIVAL, " SELECT opponent, zone, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(y), 6) AS rate FROM ra GROUP BY 1, 2"))
def q01(spark, sf):
    return rival(spark, sf).groupBy("opponent", "zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@query("q02_zone_and_third_rates", sql(RIVAL, """
SELECT coach_faced, 'zone' AS level, zone AS part, CAST(SUM(y) AS DOUBLE) AS pressed, CAST(COUNT(*) AS DOUBLE) AS n, ROUND(AVG(y), 6) AS rate FROM ra GROUP BY 1, 3
UNION ALL SELECT coach_faced, 'third', CAST(FLOOR((FLOOR(zone / 4) + 0.5) / 5 * 3) AS BIGINT), CAST(SUM(y) AS DOUBLE), CAST(COUNT(*) AS DOUBLE), ROUND(AVG(y), 6) FROM ra GROUP BY 1, 3"""))
def q02(spark, sf):
    r = rival(spark, sf)
    z = P.zone_rates(r, ["coach_faced"]).withColumn("level", F.lit("zone")).withColumnRenamed("zone", "part")
    t = P.zone_rates(r.withColumn("third", SPACE.third(F.col("zone")).cast("bigint")), ["coach_faced"], "third").withColumn(
        "level", F.lit("third")).withColumnRenamed("third", "part")
    return z.unionByName(t).withColumn("rate", F.round("rate", 6))


G2_SQL = """CASE WHEN na < 1 OR nb < 1 OR p0 <= 0 OR p0 >= 1 THEN 0 ELSE 2 * (CASE WHEN da > 0 THEN da * LN(da / (na * p0)) ELSE 0 END + CASE WHEN na - da > 0 THEN (na - da) * LN((na - da) / (na * (1 - p0))) ELSE 0 END
 + CASE WHEN db > 0 THEN db * LN(db / (nb * p0)) ELSE 0 END + CASE WHEN nb - db > 0 THEN (nb - db) * LN((nb - db) / (nb * (1 - p0))) ELSE 0 END) END"""
PAIRS = RIVAL + """,
er AS (SELECT DISTINCT opponent, coach_faced FROM ra),
pa AS MATERIALIZED (SELECT x.opponent, x.coach_faced AS a, y.coach_faced AS c FROM er x JOIN er y ON x.opponent = y.opponent AND x.coach_faced < y.coach_faced),
zp AS MATERIALIZED (SELECT ra.opponent, a, c, a || '|' || c AS pair, rival, match_id, coach_faced, zone, y FROM ra JOIN pa ON pa.opponent = ra.opponent AND coach_faced IN (a, c))"""


def _sides_sql(label: str) -> str:
    return ", ".join(f"CAST(SUM(CASE WHEN {label} = {e} THEN {v} ELSE 0 END) AS DOUBLE) AS {n}" for e, v, n in (
        ("a", "y", "da"), ("a", "1", "na"), ("c", "y", "db"), ("c", "1", "nb")))


@query("q03_two_sample_g2", sql(PAIRS, f""",
zc AS (SELECT opponent, a, c, zone, {_sides_sql('coach_faced')} FROM zp GROUP BY 1, 2, 3, 4),
z0 AS (SELECT *, (da + db) / (na + nb) AS p0 FROM zc)
SELECT opponent, a, c, zone, da, na, db, nb, ROUND({G2_SQL}, 6) AS g2 FROM z0"""))
def q03(spark, sf):
    return P.zone_contrasts(match_cells(spark, sf), "opponent", "coach_faced").withColumn("g2", F.round("g2", 6))


@query("q03_zone_permutation", sql(PAIRS, f""",
lb AS MATERIALIZED (SELECT DISTINCT pair, rival, match_id, coach_faced AS l FROM zp),
sb AS (SELECT pair, rival, l, ROW_NUMBER() OVER (PARTITION BY pair, rival ORDER BY l, match_id) AS slot FROM lb),
sp AS (SELECT pair, rival, match_id, b, ROW_NUMBER() OVER (PARTITION BY pair, rival, b ORDER BY {draw_sql("'81'", "b", "match_id")}, match_id) AS slot FROM lb, (SELECT UNNEST(range(1, 21)) AS b)),
pl AS MATERIALIZED (SELECT sp.pair, sp.rival, sp.match_id, sp.b, sb.l FROM sp JOIN sb ON sb.pair = sp.pair AND sb.rival = sp.rival AND sb.slot = sp.slot UNION ALL SELECT pair, rival, match_id, 0, l FROM lb),
zc AS (SELECT opponent, a, c, b, zone, {_sides_sql('l')} FROM zp JOIN pl ON pl.pair = zp.pair AND pl.rival = zp.rival AND pl.match_id = zp.match_id GROUP BY 1, 2, 3, 4, 5),
z0 AS (SELECT *, (da + db) / (na + nb) AS p0 FROM zc),
g AS (SELECT opponent, a, c, b, zone, {G2_SQL} AS v FROM z0),
t3 AS (SELECT *, v AS x, MAX(CASE WHEN b = 0 THEN v END) OVER (PARTITION BY opponent, a, c, zone) AS o FROM g)
SELECT opponent, a, c, zone, """ + NULL_SQL + " FROM t3 GROUP BY 1, 2, 3, 4"))
def q03b(spark, sf):
    n = P.zone_contrast_null(match_cells(spark, sf), "opponent", "coach_faced", "rival", 20, 81)
    return null_summary(n, ["opponent", "a", "c", "zone"], "g2")


@query("q04_overdispersion", sql(RIVAL, """,
mc AS (SELECT coach_faced, match_id, zone, SUM(y) AS d, COUNT(*) AS n FROM ra GROUP BY 1, 2, 3),
pi AS (SELECT coach_faced, zone, SUM(d) / SUM(n) AS pi FROM mc GROUP BY 1, 2),
v AS (SELECT mc.*, pi, n * pi * (1 - pi) AS v FROM mc JOIN pi ON pi.coach_faced = mc.coach_faced AND pi.zone = mc.zone)
SELECT coach_faced, zone, ROUND(COALESCE(SUM(CASE WHEN v > 1e-12 AND n >= 5 THEN POW(d - n * pi, 2) / v END), 0) / GREATEST(SUM(CASE WHEN v > 1e-12 AND n >= 5 THEN 1 ELSE 0 END) - 1, 1), 6) AS phi, CAST(SUM(CASE WHEN v > 1e-12 AND n >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS matches FROM v GROUP BY 1, 2"""))
def q04(spark, sf):
    return P.overdispersion(match_cells(spark, sf), ["coach_faced"]).withColumn("phi", F.round("phi", 6))


@query("q05_zone_rate_intervals", sql(RIVAL, """,
mc AS (SELECT coach_faced, match_id, zone, SUM(y) AS d, CAST(COUNT(*) AS DOUBLE) AS n FROM ra GROUP BY 1, 2, 3)""" + weights_sql("mc", "coach_faced", "match_id", 20, 83) + """,
r AS (SELECT coach_faced, zone, b, SUM(w * d) / SUM(w * n) AS rate, SUM(w * n) AS n FROM mc JOIN wt ON wt.s = coach_faced AND wt.k = match_id GROUP BY 1, 2, 3),
t AS (SELECT coach_faced, zone, MAX(CASE WHEN b = 0 THEN rate END) AS point, MAX(CASE WHEN b = 0 THEN n END) AS n, QUANTILE_CONT(rate, 0.025) FILTER (WHERE b > 0) AS lo, QUANTILE_CONT(rate, 0.975) FILTER (WHERE b > 0) AS hi FROM r GROUP BY 1, 2)
SELECT coach_faced, zone, ROUND(point, 6) AS point, ROUND(lo + 1e-8, 6) AS lo, ROUND(hi + 1e-8, 6) AS hi, ROUND(CASE WHEN point * (1 - point) > 0 THEN (hi - lo) / (2 * 1.959963984540054 * SQRT(point * (1 - point) / n)) END, 6) AS inflation FROM t WHERE point IS NOT NULL"""))
def q05(spark, sf):
    c = match_cells(spark, sf).groupBy("coach_faced", "match_id", "zone").agg(F.sum("pressed").alias("d"), F.sum("n").alias("n"))
    w = R.multinomial_weights(c, ["coach_faced"], "match_id", 20, 83)
    r = R.replicate_sums(c, w, ["coach_faced", "match_id"], ["coach_faced", "zone"], ["d", "n"])
    keys = ["coach_faced", "zone"]
    i = R.interval(r.withColumn("rate", F.col("d") / F.col("n")), keys, "rate", method="percentile")
    i = i.join(r.filter("b = 0").select(*keys, "n"), keys)
    return i.select(*keys, F.round("point", 6).alias("point"),
                    *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("lo", "hi")],
                    F.round(P.inflation(F.col("lo"), F.col("hi"), F.col("point"), F.col("n")), 6).alias("inflation"))


CURVE = RIVAL + """,
cv AS (SELECT coach_faced, k, CASE WHEN COUNT(*) >= 10 THEN AVG(y) END AS rate, COUNT(*) AS n FROM ra GROUP BY 1, 2)"""


@query("q06_index_curve", sql(CURVE, " SELECT coach_faced, k, ROUND(rate, 6) AS rate, CAST(n AS BIGINT) AS n FROM cv"))
def q06(spark, sf):
    return P.index_curve(rival_k(spark, sf), ["coach_faced"], None, 10).withColumn("rate", F.round("rate", 6))


@query("q06_curve_slope", sql(CURVE, """,
d AS (SELECT coach_faced, CAST(k AS DOUBLE) AS k, rate AS y, CAST(n AS DOUBLE) AS w FROM cv WHERE k >= 2 AND rate IS NOT NULL)
SELECT coach_faced, CASE WHEN COUNT(*) >= 3 THEN ROUND((SUM(w*k*y) - SUM(w*k)*SUM(w*y)/SUM(w)) / (SUM(w*k*k) - SUM(w*k)*SUM(w*k)/SUM(w)), 6) END AS slope FROM d GROUP BY 1"""))
def q06b(spark, sf):
    c = P.index_curve(rival_k(spark, sf), ["coach_faced"], None, 10)
    return P.curve_slope(c, ["coach_faced"]).withColumn("slope", F.round("slope", 6))


KCELLS = RIVAL + """,
kc AS MATERIALIZED (SELECT opponent, coach_faced, match_id, k, SUM(y) AS s, CAST(COUNT(*) AS DOUBLE) AS n FROM ra GROUP BY 1, 2, 3, 4)"""


@query("q06_curve_interval", sql(KCELLS, weights_sql("kc", "coach_faced", "match_id", 20, 61) + """,
r AS (SELECT coach_faced, k, b, CASE WHEN SUM(w * n) >= 10 THEN SUM(w * kc.s) / SUM(w * n) END AS rate, SUM(w * n) AS n FROM kc JOIN wt ON wt.s = coach_faced AND wt.k = match_id GROUP BY 1, 2, 3)
SELECT coach_faced, k, ROUND(MAX(CASE WHEN b = 0 THEN rate END) + 1e-9, 6) AS point, ROUND(quantile_cont(rate, 0.025) FILTER (WHERE b > 0) + 1e-9, 6) AS lo, ROUND(quantile_cont(rate, 0.975) FILTER (WHERE b > 0) + 1e-9, 6) AS hi, MAX(CASE WHEN b = 0 THEN n END) AS n FROM r GROUP BY 1, 2""".replace("SELECT coach_faced, k, b,", "SELECT coach_faced, kc.k AS k, b,")))
def q06c(spark, sf):
    cells = P.index_cells(rival_k(spark, sf), ["coach_faced"])
    i = P.curve_intervals(cells, "coach_faced", 10, 20, 61)
    return i.select("coach_faced", "k", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("point", "lo", "hi")], "n")


@query("q06_slope_permutation", sql(KCELLS, f""",
er AS (SELECT DISTINCT opponent, match_id, coach_faced FROM kc),
pa AS (SELECT DISTINCT x.opponent, x.coach_faced AS a, y.coach_faced AS c FROM er x JOIN er y ON x.opponent = y.opponent AND x.coach_faced < y.coach_faced),
bl AS MATERIALIZED (SELECT pa.*, match_id, coach_faced AS era FROM er JOIN pa ON pa.opponent = er.opponent AND coach_faced IN (a, c)),
sb AS (SELECT a, c, era, ROW_NUMBER() OVER (PARTITION BY a, c ORDER BY era, match_id) AS slot FROM bl),
sp AS (SELECT a, c, match_id, b, ROW_NUMBER() OVER (PARTITION BY a, c, b ORDER BY {draw_sql("'67'", "b", "match_id")}, match_id) AS slot FROM bl, (SELECT UNNEST(range(1, 10)) AS b)),
pl AS (SELECT sp.a, sp.c, sp.match_id, sp.b, sb.era FROM sp JOIN sb ON sb.a = sp.a AND sb.c = sp.c AND sb.slot = sp.slot UNION ALL SELECT a, c, match_id, 0, era FROM bl),
cu AS (SELECT kc.opponent, pl.a, pl.c, b, era = pl.a AS side, k, SUM(n) AS n, SUM(s) / SUM(n) AS y FROM pl JOIN pa ON pa.a = pl.a AND pa.c = pl.c JOIN kc ON kc.opponent = pa.opponent AND kc.match_id = pl.match_id GROUP BY ALL HAVING SUM(n) >= 10),
sl AS (SELECT opponent, a, c, b, side, CASE WHEN COUNT(*) >= 3 THEN (SUM(n*k*y) - SUM(n*k)*SUM(n*y)/SUM(n)) / (SUM(n*k*k) - SUM(n*k)*SUM(n*k)/SUM(n)) END AS slope FROM cu WHERE k >= 2 GROUP BY ALL),
t AS (SELECT opponent, a, c, b, MAX(CASE WHEN side THEN slope END) - MAX(CASE WHEN NOT side THEN slope END) AS v FROM sl GROUP BY 1, 2, 3, 4),
t2 AS (SELECT *, ABS(v) AS x, MAX(CASE WHEN b = 0 THEN ABS(v) END) OVER (PARTITION BY opponent, a, c) AS o FROM t)
SELECT opponent, a, c, """ + NULL_SQL + " FROM t2 GROUP BY 1, 2, 3"))
def q06d(spark, sf):
    cells = P.index_cells(rival_k(spark, sf), ["opponent", "coach_faced"])
    return null_summary(P.slope_null(cells, "opponent", "coach_faced", 10, 9, 67), ["opponent", "a", "c"], "diff", two_sided=True)


@query("q07_level_contrast", sql(RIVAL, """
SELECT coach_faced, phase, ROUND(AVG(CASE WHEN k >= 3 THEN y END), 6) AS level_k3, ROUND(AVG(CASE WHEN length = 1 THEN y END), 6) AS single, CAST(SUM(CASE WHEN length = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_single FROM ra GROUP BY 1, 2"""))
def q07(spark, sf):
    return rival_k(spark, sf).groupBy("coach_faced", "phase").agg(
        F.round(F.avg(F.when(F.col("k") >= 3, F.col("y"))), 6).alias("level_k3"),
        F.round(F.avg(F.when(F.col("length") == 1, F.col("y"))), 6).alias("single"),
        F.sum((F.col("length") == 1).cast("bigint")).alias("n_single"))


@query("q08_calibration", sql(RIVAL, """,
c AS (SELECT zone, action_type, AVG(CASE WHEN y = 1 THEN CASE WHEN k = length THEN 1.0 ELSE 0.0 END END) AS m1, AVG(CASE WHEN y = 0 THEN CASE WHEN k = length THEN 1.0 ELSE 0.0 END END) AS m0, SUM(y) AS n1, SUM(1 - y) AS n0 FROM ra GROUP BY 1, 2)
SELECT ROUND(SUM((n1 + n0) * (m1 - m0)) / SUM(n1 + n0), 6) AS diff, CAST(COUNT(*) AS BIGINT) AS strata FROM c WHERE n1 >= 10 AND n0 >= 10"""))
def q08(spark, sf):
    d = rival_k(spark, sf).withColumn("last", F.col("k") == F.col("length"))
    return P.calibrated_difference(d, [], ["zone", "action_type"], "last", 10).withColumn("diff", F.round("diff", 6))


@query("q08_calibration_null", sql(RIVAL, f""",
a0 AS (SELECT zone, action_type, poss_uid || ':' || event_index AS uid, CASE WHEN k = length THEN 1.0 ELSE 0.0 END AS last, y FROM ra),
n1 AS (SELECT zone, action_type, SUM(y) AS n1 FROM a0 GROUP BY 1, 2),
ab AS (SELECT a0.*, b, ROW_NUMBER() OVER (PARTITION BY zone, action_type, b ORDER BY {draw_sql("'91'", "b", "uid")}, uid) AS k FROM a0, (SELECT UNNEST(range(1, 41)) AS b)),
al AS (SELECT zone, action_type, b, last, CASE WHEN k <= n1 THEN 1.0 ELSE 0.0 END AS y FROM ab JOIN n1 USING (zone, action_type) UNION ALL SELECT zone, action_type, 0, last, y FROM a0),
c AS (SELECT zone, action_type, b, AVG(CASE WHEN y = 1 THEN last END) AS m1, AVG(CASE WHEN y = 0 THEN last END) AS m0, SUM(y) AS n1, SUM(1 - y) AS n0 FROM al GROUP BY 1, 2, 3),
d AS (SELECT b, SUM((n1 + n0) * (m1 - m0)) / SUM(n1 + n0) AS diff FROM c WHERE n1 >= 10 AND n0 >= 10 GROUP BY b),
o AS (SELECT diff FROM d WHERE b = 0), x AS (SELECT ABS(diff) AS x FROM d WHERE b > 0),
s AS (SELECT quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.95) AS top, AVG(x) AS m, stddev_pop(x) AS sd, COUNT(*) AS n, COUNT(*) FILTER (x >= (SELECT ABS(diff) FROM o) - 1e-12) AS hits FROM x)
SELECT 'all' AS "all", ROUND(o.diff, 6) AS observed, ROUND(med, 6) AS null_median, ROUND(top, 6) AS null_p95, ROUND(CASE WHEN sd > 0 THEN (ABS(o.diff) - m) / sd END, 4) AS z, ROUND(ABS(o.diff) - med, 6) AS excess, (hits + 1.0::DOUBLE) / (n + 1) AS p FROM o, s"""))
def q08b(spark, sf):
    d = rival_k(spark, sf).withColumn("last", F.col("k") == F.col("length")).withColumn(
        "uid", F.concat_ws(":", "poss_uid", "event_index"))
    n = P.calibrated_null(d, ["zone", "action_type"], "last", 10, 40, 91, "uid")
    p = R.permutation_p(n.withColumn("all", F.lit("all")), ["all"], "diff", two_sided=True)
    return p.withColumns({c: F.round(c, 4 if c == "z" else 6) for c in ("observed", "null_median", "null_p95", "z", "excess")})


@query("q09_pressure_did", sql(RIVAL, """,
sub AS (SELECT *, 'all' AS subset FROM ra UNION ALL SELECT *, 'k3' FROM ra WHERE k >= 3 UNION ALL SELECT *, 'single_live' FROM ra WHERE length = 1 AND phase IN ('open', 'transition') UNION ALL SELECT *, 'single_dead' FROM ra WHERE length = 1 AND phase IN ('restart', 'set_piece')
 UNION ALL SELECT *, CASE WHEN k = 3 THEN 'k3_only' ELSE 'k' || k END FROM ra WHERE k <= 6),
un AS (SELECT opponent, coach_faced, season, subset, zone, CAST(COUNT(*) AS DOUBLE) AS n, SUM(y) AS s FROM sub GROUP BY ALL),
ct AS (SELECT opponent, season, subset, zone, SUM(n) AS n, SUM(s) AS s FROM un GROUP BY ALL),
lt AS (SELECT season, subset, zone, SUM(n) AS n, SUM(s) AS s FROM ct GROUP BY ALL),
bs AS (SELECT ct.opponent, ct.season, ct.subset, ct.zone, lt.n - ct.n AS nb, lt.s - ct.s AS sb FROM ct JOIN lt ON lt.season = ct.season AND lt.subset = ct.subset AND lt.zone = ct.zone),
br AS (SELECT *, CASE WHEN nb < 30 THEN SUM(sb) OVER (PARTITION BY opponent, season, subset) / NULLIF(SUM(nb) OVER (PARTITION BY opponent, season, subset), 0) ELSE sb / nb END AS rate FROM bs),
j AS (SELECT un.opponent, coach_faced, CASE WHEN un.subset = 'all' THEN 'zone ' || un.zone ELSE un.subset END AS part, un.n, un.s, rate FROM un LEFT JOIN br ON br.opponent = un.opponent AND br.season = un.season AND br.subset = un.subset AND br.zone = un.zone)
SELECT opponent, coach_faced, part, ROUND(SUM(s) / SUM(n) + 1e-9, 6) AS unit, CASE WHEN MAX(CASE WHEN rate IS NULL THEN 1 ELSE 0 END) = 0 THEN ROUND(SUM(n * rate) / SUM(n) + 1e-9, 6) END AS base, SUM(n) AS n, CASE WHEN MAX(CASE WHEN rate IS NULL THEN 1 ELSE 0 END) = 0 THEN ROUND(SUM(s) / SUM(n) - SUM(n * rate) / SUM(n) + 1e-9, 6) END AS did FROM j GROUP BY 1, 2, 3"""))
def q09(spark, sf):
    return pressure_did_table(spark, sf)


def pressure_did_table(spark, sf):
    unit = P.subset_cells(rival_k(spark, sf), ["opponent", "coach_faced", "season"])
    club = unit.groupBy("opponent", "season", "subset", "zone").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    base = Q.leave_unit_out(club, "opponent", ["season", "subset", "zone"], ["n", "s"]).select(
        "opponent", "season", "subset", "zone", F.col("rest_n").alias("n_b"), F.col("rest_s").alias("s_b"))
    d = P.pressure_did(unit, base, ["opponent", "coach_faced"])
    # a rate that ends in 5 at the seventh place rounds alike whatever the order of its sum
    return d.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("unit", "base", "did")})


@query("q10_flag_audit", sql(TR, """
SELECT CASE WHEN f IS NULL THEN 'null' ELSE 'true' END AS value, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CASE WHEN under_pressure THEN TRUE END AS f FROM actions) GROUP BY 1"""))
def q10(spark, sf):
    from chainspark.plans.chain_queries import raw_events
    return P.flag_audit(raw_events(spark, sf), "under_pressure")


@query("q11_event_inventory", sql(FA, """
SELECT team, action_type AS type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(start_x), 6) AS mean_x, ROUND(AVG(start_y), 6) AS mean_y FROM actions GROUP BY 1, 2"""))
def q11(spark, sf):
    d = P.event_inventory(moves(spark, sf).withColumnRenamed("action_type", "type"), ["team"])
    return d.withColumns({"mean_x": F.round("mean_x", 6), "mean_y": F.round("mean_y", 6)})


@query("q11_discarded_possessions", sql(TR, """,
c AS (SELECT poss_uid, coach, COUNT(*) AS n FROM tr GROUP BY 1, 2)
SELECT coach, CAST(SUM(CASE WHEN n < 2 THEN 1 ELSE 0 END) AS BIGINT) AS dropped, CAST(COUNT(*) AS BIGINT) AS possessions, ROUND(AVG(CASE WHEN n < 2 THEN 1.0 ELSE 0.0 END), 6) AS share FROM c GROUP BY coach"""))
def q11b(spark, sf):
    c = transitions(spark, sf).groupBy("poss_uid", "coach").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("coach").agg(F.sum((F.col("n") < 2).cast("bigint")).alias("dropped"), F.count(F.lit(1)).alias("possessions"),
                                  F.round(F.avg((F.col("n") < 2).cast("double")), 6).alias("share"))
