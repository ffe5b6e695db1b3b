"""Team-match metrics, players and pass networks (L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.scan import exact_quantile
from chainspark.operators import relations as Q
from chainspark.operators import resample as R
from chainspark.operators import standardise as D
from chainspark.operators import teams as L
from chainspark.plans.inference_queries import rounded, weights_sql
from chainspark.plans.registry import query
from chainspark.plans.standard_queries import NULL_SQL, null_summary, permuted_sql
from chainspark.plans.tables import FA, MOVES, SPACE, TR, era_table, load, moves, sql, transitions
from chainspark.session import cut_lineage

XG = "ROUND(1 / (1 + EXP(SQRT(POW(120 - start_x, 2) + POW(40 - start_y, 2)) / 40)), 4)"
PANEL = MOVES + f""",
tm AS MATERIALIZED (SELECT match_id, team, MIN(coach) AS coach, MIN(season) AS season, SUM(CASE WHEN action_type = 'Shot' THEN {XG} ELSE 0 END) AS xg, SUM(CASE WHEN action_type = 'Shot' AND phase <> 'set_piece' THEN {XG} ELSE 0 END) AS npxg, SUM((end_x - start_x) / 120) AS obv,
  CAST(SUM(CASE WHEN start_x >= 80 THEN 1 ELSE 0 END) AS DOUBLE) AS ft FROM moves GROUP BY 1, 2),
pn AS MATERIALIZED (SELECT a.*, b.xg AS xg_against, b.npxg AS npxg_against, b.obv AS obv_against, b.ft AS ft_against FROM tm a JOIN tm b ON a.match_id = b.match_id AND a.team <> b.team)"""


def team_match(spark, sf):
    m = moves(spark, sf)
    xg = F.round(1 / (1 + F.exp(S.goal_distance(F.col("start_x"), F.col("start_y")) / 40)), 4)
    shot = F.col("action_type") == "Shot"
    return m.groupBy("match_id", "team").agg(
        F.min("coach").alias("coach"), F.min("season").alias("season"),
        F.sum(F.when(shot, xg).otherwise(0.0)).alias("xg"),
        F.sum(F.when(shot & (F.col("phase") != "set_piece"), xg).otherwise(0.0)).alias("npxg"),
        F.sum((F.col("end_x") - F.col("start_x")) / 120).alias("obv"),
        F.sum((F.col("start_x") >= 80).cast("double")).alias("ft"))


def panel(spark, sf):
    return L.mirrored(team_match(spark, sf), "match_id", "team", ["xg", "npxg", "obv", "ft"])


@query("l01_for_and_against", sql(PANEL, " SELECT match_id, team, ROUND(xg, 6) AS xg, ROUND(npxg, 6) AS npxg, ROUND(obv, 6) AS obv, ROUND(xg_against, 6) AS xg_against, ROUND(npxg_against, 6) AS npxg_against, ROUND(obv_against, 6) AS obv_against FROM pn"))
def l01(spark, sf):
    return rounded(panel(spark, sf), ["match_id", "team"], ["xg", "npxg", "obv", "xg_against", "npxg_against", "obv_against"])


def _dist(x, y):
    return f"SQRT(POW(120 - {x}, 2) + POW(40 - {y}, 2))"


@query("l02_progressive_passes", sql(MOVES, f"""
SELECT match_id, team, CAST(SUM(CASE WHEN start_x >= 48 AND {_dist('end_x', 'end_y')} <= 0.75 * {_dist('start_x', 'start_y')} THEN 1 ELSE 0 END) AS BIGINT) AS relative,
 CAST(SUM(CASE WHEN {_dist('start_x', 'start_y')} - {_dist('end_x', 'end_y')} >= CASE WHEN start_x < 60 AND end_x < 60 THEN 30 WHEN start_x < 60 THEN 15 WHEN end_x >= 60 THEN 10 END THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(COUNT(*) AS BIGINT) AS passes
FROM moves WHERE action_type = 'Pass' AND phase <> 'set_piece' AND outcome = '' GROUP BY 1, 2"""))
def l02(spark, sf):
    p = moves(spark, sf).filter("action_type = 'Pass' and phase <> 'set_piece' and outcome = ''")
    xy = [F.col(c) for c in ("start_x", "start_y", "end_x", "end_y")]
    return p.groupBy("match_id", "team").agg(
        F.sum(S.progressive_relative(*xy).cast("bigint")).alias("relative"),
        F.sum(S.progressive_fixed(*xy).cast("bigint")).alias("fixed"), F.count(F.lit(1)).alias("passes"))


@query("l03_field_tilt", sql(PANEL, " SELECT match_id, team, CASE WHEN ft + ft_against > 0 THEN ROUND(ft / (ft + ft_against), 6) END AS tilt FROM pn"))
def l03(spark, sf):
    return panel(spark, sf).select("match_id", "team", F.round(L.field_tilt(F.col("ft"), F.col("ft_against")), 6).alias("tilt"))


@query("l04_symmetry", sql(PANEL, " SELECT ROUND(SUM(xg) - SUM(xg_against), 4) + 0 AS gap_xg, ROUND(SUM(ft) - SUM(ft_against), 4) AS gap_ft, ROUND(AVG(CASE WHEN ft + ft_against > 0 THEN ft / (ft + ft_against) END), 6) AS mean_tilt FROM pn"))
def l04(spark, sf):
    p = panel(spark, sf).withColumn("tilt", L.field_tilt(F.col("ft"), F.col("ft_against")))
    d = L.symmetry_gap(p, ["xg", "ft"], "tilt")
    return d.select((F.round("gap_xg", 4) + F.lit(0.0)).alias("gap_xg"), F.round("gap_ft", 4).alias("gap_ft"), F.round("mean_tilt", 6).alias("mean_tilt"))


@query("l05_unit_panel", sql(PANEL, """,
u AS (SELECT team, coach, season, COUNT(*) AS n, SUM(xg) AS s FROM pn GROUP BY 1, 2, 3), c AS (SELECT team, season, SUM(n) AS n, SUM(s) AS s FROM u GROUP BY 1, 2),
r AS (SELECT team, season, SUM(n) OVER (PARTITION BY season) - n AS nb, SUM(s) OVER (PARTITION BY season) - s AS sb FROM c),
x AS (SELECT u.team, coach, SUM(s) / SUM(n) AS unit, SUM(n * sb / nb) / SUM(n) AS base, SUM(n) AS n FROM u JOIN r ON r.team = u.team AND r.season = u.season GROUP BY 1, 2)
SELECT team, coach, ROUND(unit, 6) AS unit, ROUND(base, 6) AS base, ROUND(unit - base, 6) AS did, ROUND((RANK() OVER (ORDER BY ROUND(unit, 9)) - 1 + 0.5 * COUNT(*) OVER (PARTITION BY ROUND(unit, 9))) / COUNT(*) OVER (), 6) AS percentile FROM x WHERE n >= 12"""))
def l05(spark, sf):
    u = panel(spark, sf).groupBy("team", "coach", "season").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("xg").alias("s"))
    size = u.groupBy("team", "coach").agg(F.sum("n").alias("matches")).filter("matches >= 12")
    d = D.standardised_rate(D.against_league(u, "team", "season", "n", "s", ["team", "coach"]), ["team", "coach"])
    d = d.join(size, ["team", "coach"]).withColumn("r", F.round("unit", 9)).withColumn("k", F.lit(1))
    d = Q.midrank(d, ["k"], "r", "p", F.floor(F.col("r") * 8))
    return d.select("team", "coach", *[F.round(c, 6).alias(c) for c in ("unit", "base", "did")], F.round("p_share", 6).alias("percentile"))


# -- minutes and line-ups: spells derived from first and last action of a player in a match -------------
def spells(spark, sf):
    m = moves(spark, sf).withColumn("sec", F.col("possession") % 2700)
    d = m.groupBy("match_id", "team", "player_id").agg(F.min("sec").alias("f"), F.max("sec").alias("t"), F.count(F.lit(1)).alias("n"))
    text = lambda s: F.format_string("%02d:%02d:%02d.000", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), (s % 60).cast("int"))
    period = (F.col("player_id") % 2 + 1).cast("int")
    return d.select("match_id", "team", "player_id", "n", text(F.col("f")).alias("from"),
                    F.when(F.col("player_id") % 5 > 0, text(F.col("t"))).alias("to"), period.alias("from_period"),
                    F.when(F.col("player_id") % 5 > 0, F.lit(2)).alias("to_period"))


def match_ends(spark, sf):
    m = moves(spark, sf).select("match_id").distinct()
    return m.select("match_id", F.lit(2).alias("last_period"), F.create_map(
        F.lit(1), F.lit(2820.0), F.lit(2), (3000 + F.col("match_id") % 60).cast("double")).alias("end_by_period"))


SPELLS = FA + """,
sp AS MATERIALIZED (SELECT match_id, team, player_id, MIN(possession % 2700) AS f, MAX(possession % 2700) AS t, player_id % 2 + 1 AS fp, player_id % 5 > 0 AS has_to, 3000 + match_id % 60 AS e2 FROM actions GROUP BY ALL),
mi AS MATERIALIZED (SELECT match_id, team, player_id, CASE WHEN fp = 2 THEN GREATEST(CASE WHEN has_to THEN t ELSE e2 END - f, 0) ELSE GREATEST(2820 - f, 0) + CASE WHEN has_to THEN t ELSE e2 END END / 60.0 AS minutes FROM sp)"""


def minutes(spark, sf):
    return L.minutes_played(spells(spark, sf), match_ends(spark, sf), ["team", "player_id"], "period")


@query("l06_minutes_played", sql(SPELLS, " SELECT team, player_id, match_id, ROUND(minutes, 6) AS minutes FROM mi"))
def l06(spark, sf):
    return minutes(spark, sf).withColumn("minutes", F.round("minutes", 6))


@query("l06_clock_kind", sql(SPELLS, " SELECT team, CASE WHEN AVG(CASE WHEN f >= 2700 THEN 1.0 ELSE 0.0 END) FILTER (fp = 2) > 0.5 THEN 'cumulative' WHEN COUNT(*) FILTER (fp = 2) = 0 THEN 'unknown' ELSE 'period' END AS clock FROM sp GROUP BY team"))
def l06b(spark, sf):
    return L.clock_kind(spells(spark, sf), ["team"])


@query("l07_squad_concentration", sql(SPELLS, """,
p AS (SELECT team, player_id, SUM(minutes) AS m FROM mi GROUP BY 1, 2),
c AS (SELECT team, m, SUM(m) OVER (PARTITION BY team ORDER BY m DESC, player_id) AS c, SUM(m) OVER (PARTITION BY team) AS t FROM p)
SELECT team, CAST(SUM(CASE WHEN c - m < 0.799999999999 * t THEN 1 ELSE 0 END) AS BIGINT) AS n_share, CAST(COUNT(*) AS BIGINT) AS players FROM c GROUP BY team"""))
def l07(spark, sf):
    return L.concentration(minutes(spark, sf), ["team"], "player_id", "minutes")


@query("l07_line_up_continuity", sql(FA, """,
l AS (SELECT team, match_id, MIN(match_date) AS d, LIST(DISTINCT player_id) FILTER (WHERE event_index = 1) AS xi FROM actions GROUP BY 1, 2),
w AS (SELECT team, xi, LAG(xi) OVER (PARTITION BY team ORDER BY d, match_id) AS bf FROM l WHERE xi IS NOT NULL)
SELECT team, ROUND(AVG(LEN(LIST_INTERSECT(bf, xi)) / CAST(LEN(xi) AS DOUBLE)), 6) AS continuity, CAST(COUNT(*) AS BIGINT) AS pairs FROM w WHERE bf IS NOT NULL GROUP BY team"""))
def l07b(spark, sf):
    x = moves(spark, sf).groupBy("team", "match_id").agg(
        F.min("match_date").alias("d"), F.collect_set(F.when(F.col("event_index") == 1, F.col("player_id"))).alias("xi"))
    x = x.filter(F.size("xi") > 0)
    return L.line_up_continuity(x, ["team"], ["d", "match_id"], "xi", F.year("d")).withColumn("continuity", F.round("continuity", 6))


PZ = TR + """,
pz AS MATERIALIZED (SELECT team, coach, player_id, match_id, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone, CAST(COUNT(*) AS DOUBLE) AS y FROM tr WHERE action_type <> 'TERMINAL' GROUP BY 1, 2, 3, 4, 5)"""


def player_zones(spark, sf, keys=("team", "coach", "player_id")):
    return transitions(spark, sf).filter("action_type <> 'TERMINAL'").groupBy(
        *keys, SPACE.zone_of_state(F.col("from_state")).alias("zone")).agg(F.count(F.lit(1)).cast("double").alias("y"))


@query("l08_player_profile", sql(PZ, """
SELECT team, player_id, SUM(y) AS n, ROUND(SUM(y * (FLOOR(zone / 4) + 0.5)) / SUM(y) / 5, 6) AS cx, ROUND(SUM(y * (zone % 4 + 0.5)) / SUM(y) / 4, 6) AS cy, ROUND(SUM(CASE WHEN zone = 0 THEN y ELSE 0 END) / SUM(y), 6) AS share0 FROM pz GROUP BY 1, 2 HAVING SUM(y) >= 45"""))
def l08(spark, sf):
    d = L.player_profile(player_zones(spark, sf), ["team", "player_id"], 5, 4, 45)
    return d.select("team", "player_id", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round(F.col("shares")[0], 6).alias("share0"))


# change of two rates around a user's first event of a kind, against other segments' in the same stratum
SUB = """e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events),
f AS MATERIALIZED (SELECT user_id, MIN(t) AS t, MIN_BY(value, t) AS v FROM e WHERE event_type = 'signup' GROUP BY 1),
w AS (SELECT f.user_id, f.t, f.v, m.metric, SUM(CASE WHEN e.t < f.t - 60 THEN CASE WHEN event_type = m.metric THEN 1.0 ELSE 0.0 END END) / NULLIF(SUM(CASE WHEN e.t < f.t - 60 THEN 1 END), 0) AS rb, SUM(CASE WHEN e.t > f.t + 60 THEN CASE WHEN event_type = m.metric THEN 1.0 ELSE 0.0 END END) / NULLIF(SUM(CASE WHEN e.t > f.t + 60 THEN 1 END), 0) AS ra
  FROM f JOIN e ON e.user_id = f.user_id AND ((e.t >= GREATEST(f.t - 60 - 400000, 0) AND e.t < f.t - 60) OR (e.t > f.t + 60 AND e.t <= f.t + 60 + 400000)), (SELECT UNNEST(['click', 'error']) AS metric) m GROUP BY 1, 2, 3, 4),
dl AS MATERIALIZED (SELECT user_id, user_id % 5 AS segment, metric, CAST(FLOOR(t / 43200) AS BIGINT) % 2 AS block, CASE WHEN v < 30 THEN 'low' WHEN v > 70 THEN 'high' ELSE 'mid' END AS score, CAST(FLOOR(t / 1209600) AS BIGINT) % 2 AS season, ra - rb AS delta FROM w WHERE ra - rb IS NOT NULL),
cs AS (SELECT segment, metric, block, score, season, SUM(delta) AS s, COUNT(*) AS n FROM dl GROUP BY ALL),
rs AS (SELECT *, SUM(s) OVER q - s AS rest_s, SUM(n) OVER q - n AS rest_n FROM cs WINDOW q AS (PARTITION BY metric, block, score, season)),
ad AS MATERIALIZED (SELECT dl.*, CASE WHEN rest_n >= 5 THEN delta - rest_s / rest_n END AS adjusted FROM dl JOIN rs USING (segment, metric, block, score, season))"""


def event_deltas(spark, sf):
    e = load(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    first = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("t"), F.min_by("value", "t").alias("v")).withColumn("centre_id", F.col("user_id"))
    first = cut_lineage(first)
    out = None
    for metric in ("click", "error"):
        d = Q.window_rates(e, first, ["user_id"], "t", (F.col("event_type") == metric).cast("double"), F.lit(1.0), 400000.0, 60.0)
        d = d.select("user_id", (F.col("user_id") % 5).alias("segment"), F.lit(metric).alias("metric"), (F.floor(F.col("t") / 43200) % 2).alias("block"),
                     F.when(F.col("v") < 30, "low").when(F.col("v") > 70, "high").otherwise("mid").alias("score"),
                     (F.floor(F.col("t") / 1209600) % 2).alias("season"), (F.col("rate_after") - F.col("rate_before")).alias("delta"))
        out = d if out is None else out.unionByName(d)
    return out


@query("l09_substitution_effect", sql("", SUB + weights_sql("ad", "segment", "user_id", 20, 37) + """,
rp AS (SELECT segment, metric, b, SUM(w * COALESCE(adjusted, 0)) / NULLIF(SUM(w * CASE WHEN adjusted IS NULL THEN 0 ELSE 1 END), 0) AS v FROM ad JOIN wt ON wt.s = segment AND wt.k = user_id GROUP BY 1, 2, 3),
pt AS (SELECT segment, metric, v AS t FROM rp WHERE b = 0),
ag AS MATERIALIZED (SELECT rp.segment, rp.metric, t, quantile_cont(v, 0.025) AS ql, quantile_cont(v, 0.975) AS qh, LEAST(1.0::DOUBLE, 2.0::DOUBLE * (1 + COUNT(*) FILTER (CASE WHEN t >= 0 THEN v - t >= t ELSE v - t <= t END)) / (COUNT(v) + 1)) AS p FROM rp JOIN pt ON pt.segment = rp.segment AND pt.metric = rp.metric WHERE b > 0 GROUP BY 1, 2, 3),
sz AS (SELECT segment, metric, COUNT(*) AS events, COUNT(adjusted) AS matched FROM ad GROUP BY 1, 2),
vs AS (SELECT metric, p, COUNT(*) AS c FROM ag GROUP BY 1, 2),
rk2 AS (SELECT *, SUM(c) OVER (PARTITION BY metric ORDER BY p) AS k, SUM(c) OVER (PARTITION BY metric) AS m FROM vs),
qs AS (SELECT metric, p, LEAST(1, MIN(p * m / k) OVER (PARTITION BY metric ORDER BY p DESC)) AS q FROM rk2)
SELECT ag.segment, ag.metric, CAST(events AS BIGINT) AS events, CAST(matched AS BIGINT) AS matched, ROUND(t, 6) AS point, ROUND(2 * t - qh, 6) AS lo, ROUND(2 * t - ql, 6) AS hi, ROUND(ag.p, 6) AS p, ROUND(q, 6) AS q, q <= 0.05 AS rejected
FROM ag JOIN sz ON sz.segment = ag.segment AND sz.metric = ag.metric JOIN qs ON qs.metric = ag.metric AND qs.p = ag.p"""))
def l09(spark, sf):
    """First events of a kind as substitutions: windows with an exclusion zone, controls of the same block, score and season."""
    d = L.matched_effects(cut_lineage(event_deltas(spark, sf)), "segment", ["metric", "block", "score", "season"], "delta")
    out = L.unit_effects(d, "segment", "user_id", "metric", 20, 37)
    return out.withColumns({c: F.round(c, 6) for c in ("point", "lo", "hi", "p", "q")})


@query("l10_squad_core_possessions", sql(TR, """,
pc AS (SELECT team, coach, player_id FROM tr WHERE player_id IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10), cc AS (SELECT team, player_id, COUNT(*) AS eras FROM pc GROUP BY 1, 2), me AS (SELECT team, COUNT(DISTINCT coach) AS m FROM pc GROUP BY 1),
core AS (SELECT cc.team, player_id FROM cc JOIN me ON me.team = cc.team AND eras = m),
ps AS (SELECT tr.team, tr.coach, tr.poss_uid, COUNT(*) AS len, AVG(CASE WHEN core.player_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM tr LEFT JOIN core ON core.team = tr.team AND core.player_id = tr.player_id WHERE action_type <> 'TERMINAL' GROUP BY 1, 2, 3)
SELECT team, coach, CAST(COUNT(*) AS BIGINT) AS possessions, CAST(SUM(CASE WHEN share >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS kept, ROUND(AVG(len), 6) AS len_all, ROUND(AVG(CASE WHEN share >= 0.5 THEN len END), 6) AS len_core FROM ps GROUP BY 1, 2"""))
def l10(spark, sf):
    tr = transitions(spark, sf)
    pc = tr.filter("player_id is not null").groupBy("team", "coach", "player_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")
    eras = pc.groupBy("team").agg(F.countDistinct("coach").alias("m"))
    core = pc.groupBy("team", "player_id").agg(F.count(F.lit(1)).alias("k")).join(eras, "team").filter("k = m").select(
        "team", "player_id", F.lit(1.0).alias("core"))
    ps = tr.filter("action_type <> 'TERMINAL'").join(core, ["team", "player_id"], "left").groupBy("team", "coach", "poss_uid").agg(
        F.count(F.lit(1)).alias("len"), F.avg(F.coalesce("core", F.lit(0.0))).alias("share"))
    inside = F.col("share") >= 0.5
    return ps.groupBy("team", "coach").agg(
        F.count(F.lit(1)).alias("possessions"), F.sum(inside.cast("bigint")).alias("kept"),
        F.round(F.avg("len"), 6).alias("len_all"), F.round(F.avg(F.when(inside, F.col("len"))), 6).alias("len_core"))


SHIFT = PZ + """,
pc AS (SELECT team, coach, player_id, zone, SUM(y) AS y FROM pz GROUP BY 1, 2, 3, 4), pt AS (SELECT team, coach, player_id, SUM(y) AS n FROM pc GROUP BY 1, 2, 3 HAVING SUM(y) >= 15),
pp AS (SELECT x.team, x.player_id, x.coach AS a, y.coach AS b, x.n AS na, y.n AS nb FROM pt x JOIN pt y ON x.team = y.team AND x.player_id = y.player_id AND x.coach < y.coach)"""


@query("l11_player_zone_shift", sql(SHIFT, """
SELECT pp.team, pp.player_id, pp.a, pp.b, ROUND(0.5 * SUM(ABS(COALESCE(cx.y, 0) / na - COALESCE(cy.y, 0) / nb)), 6) AS "T" FROM pp CROSS JOIN (SELECT UNNEST(range(20)) AS zone) z
LEFT JOIN pc cx ON cx.team = pp.team AND cx.player_id = pp.player_id AND cx.coach = a AND cx.zone = z.zone LEFT JOIN pc cy ON cy.team = pp.team AND cy.player_id = pp.player_id AND cy.coach = b AND cy.zone = z.zone GROUP BY 1, 2, 3, 4"""))
def l11(spark, sf):
    return L.player_shift(player_zones(spark, sf), ["team"], "coach", 15).withColumn("T", F.round("T", 6))


@query("l11_half_era_null", sql(TR, """,
md AS (SELECT team, coach, match_id, MIN(match_date) AS d FROM tr GROUP BY 1, 2, 3),
hf AS (SELECT team, coach, match_id, CASE WHEN ROW_NUMBER() OVER (PARTITION BY team, coach ORDER BY d, match_id) <= FLOOR(COUNT(*) OVER (PARTITION BY team, coach) / 2.0) THEN 1 ELSE 2 END AS half FROM md),
z AS (SELECT tr.team, tr.coach, half, player_id, FLOOR(from_state / 4) AS zone, CAST(COUNT(*) AS DOUBLE) AS y FROM tr JOIN hf ON hf.team = tr.team AND hf.coach = tr.coach AND hf.match_id = tr.match_id WHERE action_type <> 'TERMINAL' GROUP BY ALL),
t AS (SELECT team, coach, half, player_id, SUM(y) AS n FROM z GROUP BY ALL HAVING SUM(y) >= 5),
pp AS (SELECT x.team, x.coach, x.player_id, x.n AS na, y.n AS nb FROM t x JOIN t y ON x.team = y.team AND x.coach = y.coach AND x.player_id = y.player_id AND x.half = 1 AND y.half = 2),
c AS (SELECT pp.team, pp.coach, pp.player_id, zone, ABS(SUM(CASE WHEN half = 1 THEN y / na ELSE -y / nb END)) AS d FROM pp JOIN z ON z.team = pp.team AND z.coach = pp.coach AND z.player_id = pp.player_id GROUP BY ALL),
s AS (SELECT team, coach, player_id, 0.5 * SUM(d) AS T FROM c GROUP BY ALL)
SELECT team, ROUND(QUANTILE_CONT(T, 0.5), 6) AS p50, ROUND(QUANTILE_CONT(T, 0.9), 6) AS p90, CAST(COUNT(*) AS BIGINT) AS n FROM s GROUP BY team"""))
def l11b(spark, sf):
    """Shift between date halves of the same era: the scale below which a shift says nothing."""
    pz = player_zones(spark, sf, ("team", "coach", "match_id", "player_id"))
    days = transitions(spark, sf).groupBy("team", "coach", "match_id").agg(F.min("match_date").alias("d"))
    h = Q.halves(days, ["team", "coach"], ["d", "match_id"], False, F.year("d")).drop("d")
    z = pz.join(h, ["team", "coach", "match_id"]).groupBy("team", "coach", "half", "player_id", "zone").agg(F.sum("y").alias("y"))
    t = L.player_shift(z, ["team", "coach"], "half", 5)
    q = exact_quantile(t, ["team"], "T", {"p50": 0.5, "p90": 0.9})
    n = t.groupBy("team").agg(F.count(F.lit(1)).alias("n"))
    return n.join(q, "team").select("team", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "n")


@query("l12_most_frequent_position", sql(TR, """,
g AS (SELECT player_id, phase, COUNT(*) AS n FROM tr WHERE player_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY n DESC, phase) AS k FROM g)
SELECT player_id, phase, CAST(n AS BIGINT) AS n FROM r WHERE k = 1"""))
def l12(spark, sf):
    return Q.mode(transitions(spark, sf).filter("player_id is not null"), ["player_id"], "phase")


NET = MOVES + """,
eg AS MATERIALIZED (SELECT team, coach, match_id, match_date, player_id, next_player AS recipient_id, CAST(COUNT(*) AS DOUBLE) AS n FROM moves WHERE action_type = 'Pass' AND next_player IS NOT NULL GROUP BY ALL),
en AS MATERIALIZED (SELECT team, coach, player_id, recipient_id, SUM(n) AS n FROM eg GROUP BY 1, 2, 3, 4)"""


def match_edges(spark, sf):
    return moves(spark, sf).filter("action_type = 'Pass' and next_player is not null").groupBy(
        "team", "coach", "match_id", "match_date", "player_id", F.col("next_player").alias("recipient_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))


def edges(spark, sf):
    return match_edges(spark, sf).groupBy("team", "coach", "player_id", "recipient_id").agg(F.sum("n").alias("n"))


NET_T = NET + """,
md AS (SELECT team, coach, player_id FROM en GROUP BY 1, 2, 3 HAVING SUM(n) >= 3),
sh AS (SELECT x.team, x.coach AS a, y.coach AS b, x.player_id FROM md x JOIN md y ON x.team = y.team AND x.player_id = y.player_id AND x.coach < y.coach),
e2 AS (SELECT e.team, s.a, s.b, e.coach AS e, e.player_id, e.recipient_id, e.n / SUM(e.n) OVER (PARTITION BY e.team, s.a, s.b, e.coach) AS p FROM en e JOIN sh s ON s.team = e.team AND s.player_id = e.player_id AND e.coach IN (s.a, s.b) WHERE EXISTS (SELECT 1 FROM sh r WHERE r.team = e.team AND r.a = s.a AND r.b = s.b AND r.player_id = e.recipient_id))"""


@query("l13_network_shift", sql(NET_T, """,
x AS (SELECT team, a, b, player_id, recipient_id, ABS(SUM(CASE WHEN e = a THEN p ELSE -p END)) AS d FROM e2 GROUP BY 1, 2, 3, 4, 5)
SELECT team, a, b, ROUND(0.5 * SUM(d), 6) AS "T" FROM x GROUP BY 1, 2, 3"""))
def l13(spark, sf):
    return L.network_shift(edges(spark, sf), ["team"], "coach", 3).withColumn("T", F.round("T", 6))


@query("l13_pass_gini", sql(NET, """,
p AS (SELECT team, coach, player_id, SUM(n) AS m FROM en GROUP BY 1, 2, 3), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, coach ORDER BY m) AS k, COUNT(*) OVER (PARTITION BY team, coach) AS c FROM p)
SELECT team, coach, ROUND(2 * SUM(k * m) / (MAX(c) * SUM(m)) - (MAX(c) + 1.0) / MAX(c), 6) AS gini, CAST(MAX(c) AS BIGINT) AS members FROM r GROUP BY 1, 2"""))
def l13b(spark, sf):
    p = edges(spark, sf).groupBy("team", "coach", "player_id").agg(F.sum("n").alias("m"))
    return L.gini(p, ["team", "coach"], "m", F.floor(F.col("m") / 256)).withColumn("gini", F.round("gini", 6))


@query("l13_hub_share", sql(NET, """,
p AS (SELECT team, coach, player_id, SUM(n) AS m FROM en GROUP BY 1, 2, 3), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, coach ORDER BY m DESC, player_id) AS k FROM p)
SELECT team, coach, ROUND(MAX(m) / SUM(m), 6) AS hub_share, MAX(CASE WHEN k = 1 THEN player_id END) AS hub FROM r GROUP BY 1, 2"""))
def l13c(spark, sf):
    return L.hub_share(edges(spark, sf), ["team", "coach"]).withColumn("hub_share", F.round("hub_share", 6))


_SHIFT_P = NET_T[len(NET):].replace(" en ", " ep ").replace("FROM en ", "FROM ep ")


@query("l13_network_null", sql(NET, permuted_sql("eg", "team", "match_id", "coach", 4, 101) + """,
ep AS MATERIALIZED (SELECT team || '|' || b AS team, l AS coach, player_id, recipient_id, SUM(n) AS n FROM eg JOIN pl ON pl.s = team AND pl.k = match_id GROUP BY ALL)""" + _SHIFT_P + """,
x AS (SELECT team, a, b, player_id, recipient_id, ABS(SUM(CASE WHEN e = a THEN p ELSE -p END)) AS d FROM e2 GROUP BY 1, 2, 3, 4, 5),
t2 AS (SELECT split_part(team, '|', 1) AS team, CAST(split_part(team, '|', 2) AS INTEGER) AS rep, a, b AS c, 0.5 * SUM(d) AS T FROM x GROUP BY team, a, b),
t3 AS (SELECT team, a, c, rep AS b, T AS v, T AS x, MAX(CASE WHEN rep = 0 THEN T END) OVER (PARTITION BY team, a, c) AS o FROM t2)
SELECT team, a, c, """ + NULL_SQL + " FROM t3 GROUP BY 1, 2, 3"))
def l13d(spark, sf):
    me = match_edges(spark, sf)
    perm = R.permutation_labels(me.select("team", "match_id", "coach"), ["team"], "match_id", "coach", 4, 101)
    d = me.groupBy("team", "match_id", "player_id", "recipient_id").agg(F.sum("n").alias("n")).join(perm, ["team", "match_id"])
    e = d.groupBy("team", F.col("b").alias("rep"), "coach", "player_id", "recipient_id").agg(F.sum("n").alias("n"))
    t = L.network_shift(e, ["team", "rep"], "coach", 3).withColumnRenamed("b", "c").withColumnRenamed("rep", "b")
    return null_summary(t, ["team", "a", "c"], "T")


@query("l14_network_block_placebo", sql(NET, """,
dm AS (SELECT team, coach, match_id, MIN(match_date) AS d FROM eg GROUP BY 1, 2, 3),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, coach ORDER BY d, match_id) AS k FROM dm),
bl AS (SELECT team, coach, match_id, (k - 1) // 6 AS block FROM rk), fb AS (SELECT team, coach, block FROM bl GROUP BY 1, 2, 3 HAVING COUNT(*) = 6),
eb AS (SELECT eg.team, eg.coach, bl.block, player_id, recipient_id, SUM(n) AS n FROM eg JOIN bl ON bl.team = eg.team AND bl.coach = eg.coach AND bl.match_id = eg.match_id JOIN fb ON fb.team = bl.team AND fb.coach = bl.coach AND fb.block = bl.block GROUP BY ALL),
pb AS (SELECT *, n / SUM(n) OVER (PARTITION BY team, coach, block) AS p FROM eb),
nx AS (SELECT x.team, x.coach, x.block AS a, x.block + 1 AS b FROM fb x JOIN fb y ON x.team = y.team AND x.coach = y.coach AND y.block = x.block + 1),
df AS (SELECT nx.team, nx.coach, nx.a, nx.b, player_id, recipient_id, ABS(SUM(CASE WHEN pb.block = nx.a THEN p ELSE -p END)) AS d FROM nx JOIN pb ON pb.team = nx.team AND pb.coach = nx.coach AND pb.block IN (nx.a, nx.b) GROUP BY ALL)
SELECT team, coach, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, ROUND(0.5 * SUM(d), 6) AS "T" FROM df GROUP BY 1, 2, 3, 4"""))
def l14(spark, sf):
    """Equal blocks of six matches inside an era: shift between adjacent blocks."""
    from chainspark.functions.scan import position
    me = match_edges(spark, sf)
    days = me.groupBy("team", "coach", "match_id").agg(F.min("match_date").alias("d"))
    b = position(days, ["team", "coach"], ["d", "match_id"], F.year("d"), "k").withColumn("block", F.floor((F.col("k") - 1) / 6))
    whole = b.groupBy("team", "coach", "block").agg(F.count(F.lit(1)).alias("m")).filter("m = 6").drop("m")
    e = me.join(b.select("team", "coach", "match_id", "block"), ["team", "coach", "match_id"]).join(
        whole, ["team", "coach", "block"], "left_semi").groupBy("team", "coach", "block", "player_id", "recipient_id").agg(F.sum("n").alias("n"))
    e = e.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("team", "coach", "block")))
    # a block meets its neighbours only: each edge row goes to the pair on its left and right
    pair = F.explode(F.array(F.struct(F.col("block").alias("a"), F.col("p").alias("s")), F.struct((F.col("block") - 1).alias("a"), (-F.col("p")).alias("s"))))
    nx = whole.join(whole.select("team", "coach", (F.col("block") - 1).alias("block")), ["team", "coach", "block"]).withColumnRenamed("block", "a")
    d = e.withColumn("x", pair).select("team", "coach", "x.a", "x.s", "player_id", "recipient_id").join(nx, ["team", "coach", "a"], "left_semi")
    d = d.groupBy("team", "coach", "a", "player_id", "recipient_id").agg(F.abs(F.sum("s")).alias("d"))
    return d.groupBy("team", "coach", "a").agg(F.round(0.5 * F.sum("d"), 6).alias("T")).withColumn("b", F.col("a") + 1)


@query("l15_pair_order", sql(FA, """,
er AS (SELECT team AS club, coach, MIN(match_date) AS s, MAX(match_date) AS e FROM actions GROUP BY 1, 2)
SELECT x.club, x.coach AS a, y.coach AS b, CAST(GREATEST(DATE_DIFF('day', y.s, LEAST(x.e, y.e)) + 1, 0) AS INTEGER) AS overlap_days, CAST(DATE_DIFF('day', x.e, y.s) AS INTEGER) AS gap_days FROM er x JOIN er y ON x.club = y.club AND (x.s < y.s OR (x.s = y.s AND x.coach < y.coach))"""))
def l15(spark, sf):
    return L.pair_order(era_table(moves(spark, sf)))


@query("l16_network_viability", sql(NET, """,
p AS (SELECT team, coach, player_id, SUM(n) AS m FROM en GROUP BY 1, 2, 3)
SELECT e.team, e.coach, CAST(SUM(n) AS BIGINT) AS passes, CAST(SUM(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS edges_ok, CAST(MAX(k) AS BIGINT) AS players_ok FROM en e JOIN (SELECT team, coach, SUM(CASE WHEN m >= 10 THEN 1 ELSE 0 END) AS k FROM p GROUP BY 1, 2) q ON q.team = e.team AND q.coach = e.coach GROUP BY 1, 2"""))
def l16(spark, sf):
    return L.viability(edges(spark, sf), ["team", "coach"], 10, 2)
