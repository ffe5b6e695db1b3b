"""Predicates (P), joins (J), aggregates (A), windows (W), order and sets (O, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.scan import Running, exact_quantile, neighbour, position, running
from chainspark.operators import chains
from chainspark.operators import eras as R
from chainspark.operators import relations as Q
from chainspark.plans.chain_queries import EV, raw_events
from chainspark.plans.registry import query
from chainspark.plans.tables import (FA, MOVES, SPACE, TR, chunk_of, draw_sql, era_table, load, moves,
                                     sql, transitions)
from chainspark.sources import events as E

def N():
    return F.count(F.lit(1))


def events_table(spark, sf):
    return load(spark, sf, "events").withColumn(
        "t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


# -- predicates --------------------------------------------------------------------------------
@query("p01_action_filter", sql(EV, """
SELECT match_id, CAST(COUNT(*) AS BIGINT) AS n FROM ev WHERE team = possession_team AND type IN ('Pass','Carry','Shot') GROUP BY match_id"""))
def p01(spark, sf):
    e = raw_events(spark, sf)
    return e.filter((F.col("team") == F.col("possession_team")) & F.col("type").isin("Pass", "Carry", "Shot")
                    & F.col("location").isNotNull()).groupBy("match_id").agg(N().alias("n"))


@query("p02_end_coordinate", sql(EV, """
SELECT type, CAST(COUNT(end_x) AS BIGINT) AS with_end, ROUND(SUM(end_x), 4) AS sx, ROUND(SUM(end_y), 4) AS sy FROM ev GROUP BY type"""))
def p02(spark, sf):
    e = E.normalise(raw_events(spark, sf))
    x, y = chains.end_point(F.col("type"), "x"), chains.end_point(F.col("type"), "y")
    return e.groupBy("type").agg(F.count(x).alias("with_end"), F.round(F.sum(x), 4).alias("sx"),
                                 F.round(F.sum(y), 4).alias("sy"))


@query("p03_outcome_class", sql(EV, " SELECT type, outcome, CAST(COUNT(*) AS BIGINT) AS n FROM ev GROUP BY 1, 2"))
def p03(spark, sf):
    return raw_events(spark, sf).groupBy("type", chains.outcome_of().alias("outcome")).agg(N().alias("n"))


@query("p04_short_carries", sql(MOVES, """
SELECT team, CAST(COUNT(*) AS BIGINT) AS kept FROM moves WHERE action_type <> 'Carry' OR sqrt((end_x-start_x)*(end_x-start_x)+(end_y-start_y)*(end_y-start_y)) >= 20 GROUP BY team"""))
def p04(spark, sf):
    run = S.distance(*(F.col(c) for c in ("start_x", "start_y", "end_x", "end_y")))
    return moves(spark, sf).filter((F.col("action_type") != "Carry") | (run >= 20)).groupBy("team").agg(
        N().alias("kept"))


@query("p05_flag_fill", sql(EV, " SELECT match_id, AVG(CASE WHEN under_pressure THEN 1.0 ELSE 0.0 END) AS rate FROM ev GROUP BY match_id"))
def p05(spark, sf):
    flag = F.coalesce(F.col("under_pressure"), F.lit(False)).cast("double")
    return raw_events(spark, sf).groupBy("match_id").agg(F.avg(flag).alias("rate"))


@query("p06_defensive_perspective", sql(TR, """
SELECT opponent, team, CAST(COUNT(*) AS BIGINT) AS n FROM tr WHERE team <> 'T1' AND opponent = 'T1' GROUP BY 1, 2"""))
def p06(spark, sf):
    d = transitions(spark, sf).withColumnRenamed("coach", "coach_faced")
    d = Q.perspective(d, "defense", "coach_faced", "T1").filter("opponent = 'T1'")
    return d.groupBy("opponent", "team").agg(N().alias("n"))


@query("p07_select_units", sql(TR, """,
x AS (SELECT 'rest' AS baseline, CASE WHEN coach = 'KT1_0' THEN 'focus' ELSE 'base' END AS role FROM tr
 UNION ALL SELECT 'other_coaches', CASE WHEN coach = 'KT1_0' THEN 'focus' ELSE 'base' END FROM tr
 UNION ALL SELECT 'other_coaches_same_club', CASE WHEN coach = 'KT1_0' THEN 'focus' ELSE 'base' END FROM tr WHERE team = 'T1'
 UNION ALL SELECT 'opponents', CASE WHEN coach = 'KT1_0' THEN 'focus' ELSE 'base' END FROM tr WHERE coach = 'KT1_0' OR team <> 'T1')
SELECT baseline, role, CAST(COUNT(*) AS BIGINT) AS n FROM x GROUP BY 1, 2"""))
def p07(spark, sf):
    tr, out = transitions(spark, sf), None
    for b in Q.BASELINES:
        one = Q.select_units(tr, "coach", "KT1_0", b, "T1").groupBy("role").agg(N().alias("n")).withColumn(
            "baseline", F.lit(b))
        out = one if out is None else out.unionByName(one)
    return out


MODES = TR + """,
m AS MATERIALIZED (SELECT 'pooled' AS mode, from_state, to_state FROM tr UNION ALL SELECT 'exclude_focus', from_state, to_state FROM tr WHERE coach <> 'KT1_0' OR coach IS NULL
 UNION ALL SELECT 'league_minus_unit', from_state, to_state FROM tr WHERE NOT (team = 'T1' AND coach = 'KT1_0')
 UNION ALL SELECT 'baseline', from_state, to_state FROM tr WHERE team = 'T1' AND coach <> 'KT1_0')"""


def prior_rows(spark, sf):
    """Transitions of every source of a prior, by mode."""
    tr = transitions(spark, sf)
    focus, own = F.col("coach").eqNullSafe("KT1_0"), F.col("team") == "T1"
    modes = F.array_compact(F.array(
        F.lit("pooled"), F.when(~focus, "exclude_focus"), F.when(~(own & focus), "league_minus_unit"),
        F.when(own & (F.col("coach") != "KT1_0"), "baseline")))
    return tr.select("from_state", "to_state", F.explode(modes).alias("mode"))


@query("p08_prior_sources", sql(MODES, """
SELECT mode, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT from_state) AS BIGINT) AS rows_used FROM m GROUP BY mode"""))
def p08(spark, sf):
    return prior_rows(spark, sf).groupBy("mode").agg(N().alias("n"), F.countDistinct("from_state").alias("rows_used"))


@query("p08_prior_matrices", sql(MODES, """,
g AS (SELECT mode, i, j FROM (SELECT DISTINCT mode FROM m), (SELECT UNNEST(range(80)) AS i), (SELECT UNNEST(range(84)) AS j)),
c AS (SELECT mode, from_state AS i, to_state AS j, COUNT(*)::DOUBLE AS n FROM m GROUP BY 1, 2, 3)
SELECT g.mode, CAST(g.i AS BIGINT) AS i, CAST(g.j AS BIGINT) AS j, ROUND((COALESCE(n, 0) + 1.0::DOUBLE / 84) / (SUM(COALESCE(n, 0)) OVER (PARTITION BY g.mode, g.i) + 1), 9) AS q FROM g LEFT JOIN c ON c.mode = g.mode AND c.i = g.i AND c.j = g.j"""))
def p08b(spark, sf):
    """The prior matrix of every mode, as a unit compared under it would be shrunk to."""
    from chainspark.operators import estimate as E
    c = E.count_cells(prior_rows(spark, sf), ("mode",))
    return E.prior(c, SPACE, ["mode"]).select("mode", "i", "j", F.round("q", 9).alias("q"))


@query("p09_excluded_matches", sql(TR, """,
ex AS (SELECT DISTINCT match_id, team AS club FROM tr WHERE match_id % 13 = 0)
SELECT team, CAST(COUNT(*) AS BIGINT) AS n FROM tr WHERE match_id NOT IN (SELECT match_id FROM ex WHERE club = 'T1') GROUP BY team"""))
def p09(spark, sf):
    tr = transitions(spark, sf)
    ex = tr.filter(F.col("match_id") % 13 == 0).select(
        "match_id", F.col("team").alias("club"), F.lit(0).alias("led_the_era")).distinct()
    return R.drop_excluded(tr, ex, "T1").groupBy("team").agg(N().alias("n"))


@query("p10_stage_class", sql("", """stages AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Apertura - Quarter-finals' WHEN '2-HIGH' THEN ' Clausura ' WHEN '3-MEDIUM' THEN 'Regular Season'
   WHEN '5-LOW' THEN 'Friendly' END AS stage FROM orders)
SELECT CASE WHEN regexp_matches(lower(trim(coalesce(stage, ''))), 'final|semi|quarter|reclasific|play|repechaje') THEN 'final'
  WHEN regexp_matches(lower(trim(coalesce(stage, ''))), '^(apertura|clausura|regular)') THEN 'regular' ELSE 'unknown' END AS stage_class, CAST(COUNT(*) AS BIGINT) AS n FROM stages GROUP BY 1"""))
def p10(spark, sf):
    pr = F.col("o_orderpriority")
    stage = (F.when(pr == "1-URGENT", "Apertura - Quarter-finals").when(pr == "2-HIGH", " Clausura ")
             .when(pr == "3-MEDIUM", "Regular Season").when(pr == "5-LOW", "Friendly"))
    return load(spark, sf, "orders").groupBy(Q.stage_class(stage).alias("stage_class")).agg(N().alias("n"))


@query("p11_season_labels", sql("", """s AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT CASE WHEN month(d) >= 7 THEN CONCAT('A', year(d)) ELSE CONCAT('C', year(d)) END AS season, CAST(MIN(year(d) * 2 + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END) AS BIGINT) AS season_order, CAST(COUNT(*) AS BIGINT) AS n FROM s GROUP BY 1"""))
def p11(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return load(spark, sf, "orders").groupBy(S.season_label(d).alias("season")).agg(
        F.min(S.season_order(d)).alias("season_order"), N().alias("n"))


@query("p12_complete_matches", sql(FA, """,
g AS (SELECT match_id FROM actions GROUP BY 1 HAVING COUNT(DISTINCT team) = 2 AND COUNT(DISTINCT CONCAT(team, opponent)) = 2)
SELECT match_id, CAST(COUNT(*) AS BIGINT) AS n FROM actions WHERE match_id IN (SELECT match_id FROM g) GROUP BY match_id"""))
def p12(spark, sf):
    return Q.complete_matches(moves(spark, sf), "match_id", "team", "opponent").groupBy("match_id").agg(
        N().alias("n"))


@query("p13_analysis_units", sql(TR, """,
c AS (SELECT team, coach, CAST(COUNT(DISTINCT match_id) AS BIGINT) AS matches, MIN(match_date) AS s FROM tr GROUP BY 1, 2),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY s, coach) = 1 AS first_one FROM c)
SELECT team, coach, matches FROM f WHERE matches >= 10 AND NOT (first_one AND team <> 'T1')"""))
def p13(spark, sf):
    tr = transitions(spark, sf)
    first = era_table(tr).groupBy("club").agg(F.min_by("coach", F.struct("start_date", "coach")).alias("coach"))
    flags = first.withColumn("flags", F.lit("FIRST_OF_WINDOW;SHORT"))
    verified = first.filter("club = 'T1'").withColumn("source", F.lit("gazette"))
    return R.analysis_units(R.coverage(tr, 10), flags, verified).select("team", "coach", "matches")


@query("p14_column_contract", sql(FA, " SELECT match_id, CAST(COUNT(DISTINCT player_id) AS BIGINT) AS players FROM actions GROUP BY match_id"))
def p14(spark, sf):
    df = E.require_columns(moves(spark, sf), ["match_id", "player_id", "team"])
    return df.groupBy("match_id").agg(F.countDistinct("player_id").alias("players"))


# -- joins ---------------------------------------------------------------------------------------
ERAS = FA + """,
er AS MATERIALIZED (SELECT team AS club, coach, MIN(match_date) AS start_date, MAX(match_date) AS end_date FROM actions GROUP BY 1, 2),
md AS MATERIALIZED (SELECT match_id, team AS club, MIN(match_date) AS match_date FROM actions GROUP BY 1, 2),
mc AS MATERIALIZED (SELECT match_id, md.club, coach, match_date FROM md JOIN er ON er.club = md.club AND match_date BETWEEN start_date AND end_date)"""


def match_days(spark, sf):
    return moves(spark, sf).groupBy("match_id", F.col("team").alias("club")).agg(
        F.min("match_date").alias("match_date"))


def match_coaches(spark, sf):
    return R.match_coach(match_days(spark, sf), era_table(moves(spark, sf)))


@query("j01_asof_era", sql(ERAS, """
SELECT match_id, md.club, md.match_date, CASE WHEN md.match_date <= er.end_date THEN er.coach END AS coach
FROM md ASOF LEFT JOIN er ON md.club = er.club AND md.match_date >= er.start_date"""))
def j01(spark, sf):
    out = Q.asof_backward(match_days(spark, sf), era_table(moves(spark, sf)), ["club"], "match_date",
                          "start_date", ["coach", "end_date"], F.year("__t"))
    return out.withColumn("coach", F.when(F.col("match_date") <= F.col("end_date"), F.col("coach"))).drop("end_date")


@query("j02_match_coach_all_clubs", sql(ERAS, " SELECT * FROM mc"))
def j02(spark, sf):
    return match_coaches(spark, sf)


@query("j03_attach_coach", sql(ERAS, """
SELECT a.team, mc.coach, CAST(COUNT(*) AS BIGINT) AS n FROM actions a LEFT JOIN mc ON mc.match_id = a.match_id AND mc.club = a.team GROUP BY 1, 2"""))
def j03(spark, sf):
    return R.attach_coach(moves(spark, sf).drop("coach", "match_date"), match_coaches(spark, sf)).groupBy(
        "team", "coach").agg(N().alias("n"))


@query("j03_attach_coach_one_club", sql(ERAS, """
SELECT a.team, CASE WHEN a.team = 'T1' THEN mc.coach END AS coach, CAST(COUNT(*) AS BIGINT) AS n FROM actions a LEFT JOIN mc ON mc.match_id = a.match_id AND mc.club = 'T1' GROUP BY 1, 2"""))
def j03b(spark, sf):
    return R.attach_coach(moves(spark, sf).drop("coach", "match_date"), match_coaches(spark, sf), "T1").groupBy(
        "team", "coach").agg(N().alias("n"))


@query("j04_coach_faced", sql(ERAS, """
SELECT a.team, mc.coach AS coach_faced, CAST(COUNT(*) AS BIGINT) AS n FROM actions a LEFT JOIN mc ON mc.match_id = a.match_id AND mc.club = a.opponent
WHERE a.match_id IN (SELECT match_id FROM actions GROUP BY 1 HAVING COUNT(DISTINCT team) = 2) GROUP BY 1, 2
UNION ALL SELECT team, NULL, CAST(COUNT(*) AS BIGINT) FROM actions WHERE match_id NOT IN (SELECT match_id FROM actions GROUP BY 1 HAVING COUNT(DISTINCT team) = 2) GROUP BY team"""))
def j04(spark, sf):
    out = R.attach_coach_faced(moves(spark, sf), match_coaches(spark, sf))
    two = out.groupBy("match_id").agg((F.countDistinct("team") == 2).alias("two"))
    return out.join(two, "match_id").groupBy("team", "coach_faced", "two").agg(N().alias("n")).drop("two")


@query("j05_keep_list", sql(TR, """,
k AS (SELECT poss_uid FROM tr GROUP BY 1 HAVING COUNT(*) >= 4)
SELECT team, CAST(COUNT(*) AS BIGINT) AS n FROM tr WHERE poss_uid IN (SELECT poss_uid FROM k) GROUP BY team"""))
def j05(spark, sf):
    tr = transitions(spark, sf)
    keep = tr.groupBy("poss_uid").agg(N().alias("n")).filter("n >= 4").select("poss_uid")
    return tr.join(keep, "poss_uid", "left_semi").groupBy("team").agg(N().alias("n"))


@query("j06_anti_join", sql(TR, """
SELECT poss_uid, event_index FROM tr WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.poss_uid = tr.poss_uid AND a.event_index = tr.event_index)"""))
def j06(spark, sf):
    tr = transitions(spark, sf).select("poss_uid", "event_index")
    return tr.join(moves(spark, sf).select("poss_uid", "event_index"), ["poss_uid", "event_index"], "left_anti")


@query("j07_semi_join_outcome", sql(TR, """
SELECT from_state, CAST(COUNT(*) AS BIGINT) AS n FROM tr WHERE poss_uid IN (SELECT poss_uid FROM tr WHERE to_state = 80) GROUP BY from_state"""))
def j07(spark, sf):
    tr = transitions(spark, sf)
    goals = tr.filter("to_state = 80").select("poss_uid").distinct()
    return tr.join(goals, "poss_uid", "left_semi").groupBy("from_state").agg(N().alias("n"))


@query("j08_event_enrichment", sql(TR, """
SELECT tr.team, AVG(CASE WHEN a.start_x IS NOT NULL THEN 1.0 ELSE 0.0 END) AS match_rate, ROUND(AVG(a.start_x), 6) AS mean_x
FROM tr LEFT JOIN actions a ON a.poss_uid = tr.poss_uid AND a.event_index = tr.event_index GROUP BY tr.team"""))
def j08(spark, sf):
    ev = moves(spark, sf).select("poss_uid", "event_index", "start_x")
    d = transitions(spark, sf).drop("start_x").join(ev, ["poss_uid", "event_index"], "left")
    return d.groupBy("team").agg(F.avg(F.col("start_x").isNotNull().cast("double")).alias("match_rate"),
                                 F.round(F.avg("start_x"), 6).alias("mean_x"))


@query("j09_possession_minute", sql(TR, """,
mi AS (SELECT match_id, possession, MIN(event_index % 90) AS minute, MIN(phase) AS pattern FROM actions GROUP BY 1, 2)
SELECT mi.pattern, mi.minute, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT DISTINCT poss_uid FROM tr) t
LEFT JOIN mi ON mi.match_id = CAST(split_part(poss_uid, '_', 1) AS BIGINT) AND mi.possession = CAST(split_part(poss_uid, '_', 2) AS BIGINT) GROUP BY 1, 2"""))
def j09(spark, sf):
    ids = transitions(spark, sf).select("poss_uid").distinct()
    part = F.split("poss_uid", "_")
    ids = ids.select(part[0].cast("bigint").alias("match_id"), part[1].cast("bigint").alias("possession"))
    ev = moves(spark, sf).groupBy("match_id", "possession").agg(
        F.min(F.col("event_index") % 90).alias("minute"), F.min("phase").alias("pattern"))
    return ids.join(ev, ["match_id", "possession"], "left").groupBy("pattern", "minute").agg(N().alias("n"))


@query("j10_dates_coverage", sql(FA, """
SELECT DISTINCT match_id FROM actions WHERE match_id NOT IN (SELECT match_id FROM actions WHERE team <> 'T1' OR match_id % 5 <> 0)"""))
def j10(spark, sf):
    m = moves(spark, sf)
    dates = m.filter("team <> 'T1' or match_id % 5 <> 0").select("match_id").distinct()
    return R.matches_without_date(m, dates)


@query("j11_unit_pairs", sql(ERAS, """
SELECT x.club, x.coach AS a, y.coach AS b FROM er x JOIN er y ON x.club = y.club AND x.coach < y.coach"""))
def j11(spark, sf):
    e = era_table(moves(spark, sf)).select("club", F.col("coach").alias("a"))
    return e.join(e.withColumnRenamed("a", "b"), "club").filter("a < b")


@query("j15_window_rates", sql("", """e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events),
c AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'),
bf AS (SELECT c.event_id, SUM(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END) AS num, COUNT(*) AS den FROM c JOIN e ON e.user_id = c.user_id AND e.t >= GREATEST(c.t - 600 - 86400, 0) AND e.t < c.t - 600 GROUP BY 1),
af AS (SELECT c.event_id, SUM(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END) AS num, COUNT(*) AS den FROM c JOIN e ON e.user_id = c.user_id AND e.t > c.t + 600 AND e.t <= c.t + 600 + 86400 GROUP BY 1)
SELECT c.event_id AS centre_id, ROUND(bf.num / bf.den, 6) AS rate_before, ROUND(af.num / af.den, 6) AS rate_after FROM c LEFT JOIN bf ON bf.event_id = c.event_id LEFT JOIN af ON af.event_id = c.event_id"""))
def j15(spark, sf):
    e = events_table(spark, sf)
    centres = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("centre_id"), "t")
    out = Q.window_rates(e, centres, ["user_id"], "t", (F.col("event_type") == "error").cast("double"),
                         F.lit(1.0), 86400.0, 600.0)
    return out.select("centre_id", F.round("rate_before", 6).alias("rate_before"),
                      F.round("rate_after", 6).alias("rate_after"))


@query("j16_max_within", sql("", """e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)
SELECT c.event_id AS start_id, MAX(e.value) AS best FROM (SELECT * FROM e WHERE event_type = 'signup') c LEFT JOIN e ON e.user_id = c.user_id AND e.t BETWEEN c.t AND c.t + 36000 GROUP BY 1"""))
def j16(spark, sf):
    e = events_table(spark, sf)
    starts = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), "t")
    pts = e.select("user_id", F.col("t").alias("x"), "value")
    return Q.max_within(pts, starts, ["user_id"], "x", "value", 36000.0).select("start_id", "best")


@query("j17_shared_players", sql(FA, """,
p AS (SELECT coach, player_id FROM actions GROUP BY 1, 2 HAVING COUNT(*) >= 5)
SELECT x.coach AS a, y.coach AS b, CAST(COUNT(*) AS BIGINT) AS shared FROM p x JOIN p y ON x.player_id = y.player_id AND x.coach < y.coach GROUP BY 1, 2"""))
def j17(spark, sf):
    p = moves(spark, sf).groupBy("coach", "player_id").agg(N().alias("n")).filter("n >= 5")
    return p.select("player_id", F.col("coach").alias("a")).join(
        p.select("player_id", F.col("coach").alias("b")), "player_id").filter("a < b").groupBy("a", "b").agg(
        N().alias("shared"))


# -- aggregates ------------------------------------------------------------------------------------
@query("a01_group_aggregates", sql(TR, """
SELECT team, coach, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT match_id) AS BIGINT) AS matches, ROUND(AVG(event_index), 6) AS mean_k, MIN(match_date) AS first_day,
  CAST(SUM(to_state) AS BIGINT) AS s, BOOL_OR(to_state = 80) AS any_goal, MIN_BY(from_state, event_index * 1000000000 + possession) AS first_state, MAX_BY(to_state, event_index * 1000000000 + possession) AS last_state
FROM tr GROUP BY 1, 2"""))
def a01(spark, sf):
    order = F.col("event_index") * 1000000000 + F.col("possession")
    return transitions(spark, sf).groupBy("team", "coach").agg(
        N().alias("n"), F.countDistinct("match_id").alias("matches"),
        F.round(F.avg("event_index"), 6).alias("mean_k"), F.min("match_date").alias("first_day"),
        F.sum("to_state").alias("s"), F.bool_or(F.col("to_state") == 80).alias("any_goal"),
        F.min_by("from_state", order).alias("first_state"), F.max_by("to_state", order).alias("last_state"))


@query("a02_conditional_mean", sql(FA, " SELECT team, AVG(CASE WHEN action_type = 'Carry' THEN start_x END) AS carry_x, AVG(CASE WHEN under_pressure THEN start_y END) AS pressed_y FROM actions GROUP BY team"))
def a02(spark, sf):
    return moves(spark, sf).groupBy("team").agg(
        F.avg(F.when(F.col("action_type") == "Carry", F.col("start_x"))).alias("carry_x"),
        F.avg(F.when(F.col("under_pressure"), F.col("start_y"))).alias("pressed_y"))


@query("a03_distinct_struct", sql(FA, " SELECT season, CAST(COUNT(DISTINCT (match_id, possession)) AS BIGINT) AS possessions FROM actions GROUP BY season"))
def a03(spark, sf):
    return moves(spark, sf).groupBy("season").agg(
        F.countDistinct(F.struct("match_id", "possession")).alias("possessions"))


@query("a04_two_level", sql(FA, """,
p AS (SELECT season, team, COUNT(*) / COUNT(DISTINCT poss_uid) AS len FROM actions GROUP BY 1, 2)
SELECT season, ROUND(AVG(len), 6) AS mean_len, ROUND(STDDEV_SAMP(len), 6) AS sd_len FROM p GROUP BY season"""))
def a04(spark, sf):
    p = moves(spark, sf).groupBy("season", "team").agg((N() / F.countDistinct("poss_uid")).alias("len"))
    return p.groupBy("season").agg(F.round(F.avg("len"), 6).alias("mean_len"),
                                   F.round(F.stddev_samp("len"), 6).alias("sd_len"))


@query("a05_pivot", sql(FA, """
SELECT season, CAST(COUNT(*) FILTER (WHERE phase = 'open') AS BIGINT) AS open, CAST(COUNT(*) FILTER (WHERE phase = 'transition') AS BIGINT) AS transition, CAST(COUNT(*) FILTER (WHERE phase = 'restart') AS BIGINT) AS restart,
  CAST(COUNT(*) FILTER (WHERE phase = 'set_piece') AS BIGINT) AS set_piece FROM actions GROUP BY season"""))
def a05(spark, sf):
    return moves(spark, sf).groupBy("season").pivot("phase", list(SPACE.phases)).agg(N()).na.fill(0)


@query("a06_weighted_sums", sql(FA, " SELECT match_id, ROUND(SUM(start_x * (1 + player_id % 3)), 4) AS wsum, CAST(SUM(1 + player_id % 3) AS BIGINT) AS w FROM actions GROUP BY match_id"))
def a06(spark, sf):
    w = 1 + F.col("player_id") % 3
    return moves(spark, sf).groupBy("match_id").agg(F.round(F.sum(F.col("start_x") * w), 4).alias("wsum"),
                                                    F.sum(w).alias("w"))


@query("a07_exact_quantiles", sql("", """q AS (SELECT l_returnflag, QUANTILE_CONT(l_extendedprice, 0.025) AS lo, QUANTILE_CONT(l_extendedprice, 0.5) AS mid, QUANTILE_CONT(l_extendedprice, 0.975) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, ROUND(lo, 6) AS lo, ROUND(mid, 6) AS mid, ROUND(hi, 6) AS hi FROM q"""))
def a07(spark, sf):
    q = exact_quantile(load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
                       {"lo": 0.025, "mid": 0.5, "hi": 0.975})
    return q.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("lo", "mid", "hi")])


@query("a08_median_sd_corr", sql(FA, """
SELECT team, ROUND(STDDEV_POP(start_x), 6) AS sd0, ROUND(STDDEV_SAMP(start_x), 6) AS sd1, ROUND(CORR(start_x, start_y), 6) AS r, ROUND(QUANTILE_CONT(start_x, 0.5), 6) AS median FROM actions GROUP BY team"""))
def a08(spark, sf):
    m = moves(spark, sf)
    s = m.groupBy("team").agg(F.round(F.stddev_pop("start_x"), 6).alias("sd0"),
                              F.round(F.stddev_samp("start_x"), 6).alias("sd1"),
                              F.round(F.corr("start_x", "start_y"), 6).alias("r"))
    q = exact_quantile(m, ["team"], "start_x", {"median": 0.5})
    return s.join(q.withColumn("median", F.round("median", 6)), "team")


@query("a09_weighted_slope", sql(FA, """,
g AS (SELECT team, event_index AS k, AVG(CASE WHEN under_pressure THEN 1.0 ELSE 0.0 END) AS y, CAST(COUNT(*) AS DOUBLE) AS w FROM actions GROUP BY 1, 2)
SELECT team, ROUND((SUM(w*k*y) - SUM(w*k)*SUM(w*y)/SUM(w)) / (SUM(w*k*k) - SUM(w*k)*SUM(w*k)/SUM(w)), 6) AS slope, ROUND(SUM(w*y)/SUM(w), 6) AS mean FROM g GROUP BY team"""))
def a09(spark, sf):
    g = moves(spark, sf).groupBy("team", F.col("event_index").alias("k")).agg(
        F.avg(F.col("under_pressure").cast("double")).alias("y"), N().cast("double").alias("w"))
    return g.groupBy("team").agg(
        F.round(Q.weighted_slope(F.col("k").cast("double"), F.col("y"), F.col("w")), 6).alias("slope"),
        F.round(F.sum(F.col("w") * F.col("y")) / F.sum("w"), 6).alias("mean"))


@query("a10_ols_slope", sql(FA, """,
g AS (SELECT team, season_order, AVG(start_x) AS y FROM actions GROUP BY 1, 2)
SELECT team, ROUND(REGR_SLOPE(y, CAST(season_order AS DOUBLE)), 6) AS slope FROM g GROUP BY team"""))
def a10(spark, sf):
    g = moves(spark, sf).groupBy("team", "season_order").agg(F.avg("start_x").alias("y"))
    return g.groupBy("team").agg(F.round(F.regr_slope(F.col("y"), F.col("season_order").cast("double")), 6).alias("slope"))


@query("a11_mode", sql(FA, """,
g AS (SELECT player_id, team, COUNT(*) AS n FROM actions GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY n DESC, team) AS k FROM g)
SELECT player_id, team, CAST(n AS BIGINT) AS n FROM r WHERE k = 1"""))
def a11(spark, sf):
    return Q.mode(moves(spark, sf), ["player_id"], "team")


@query("a12_multi_membership", sql(FA, """,
s AS (SELECT a.*, MAX(event_index) OVER (PARTITION BY poss_uid) AS len FROM actions a),
x AS (SELECT 'all' AS subset, * FROM s UNION ALL SELECT 'k3', * FROM s WHERE event_index >= 3 UNION ALL SELECT 'single_open', * FROM s WHERE len = 1 AND phase IN ('open', 'transition')
 UNION ALL SELECT 'single_dead', * FROM s WHERE len = 1 AND phase IN ('restart', 'set_piece'))
SELECT subset, team, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS BIGINT) AS y FROM x GROUP BY 1, 2"""))
def a12(spark, sf):
    single, live = F.col("length") == 1, F.col("phase").isin("open", "transition")
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("event_index") >= 3, "k3"),
                                      F.when(single & live, "single_open"), F.when(single & ~live, "single_dead")))
    return moves(spark, sf).select("team", "under_pressure", F.explode(subsets).alias("subset")).groupBy(
        "subset", "team").agg(N().alias("n"), F.sum(F.col("under_pressure").cast("bigint")).alias("y"))


@query("a14_leave_one_out", sql(FA, """,
m AS (SELECT team, match_id, CAST(COUNT(*) AS DOUBLE) AS x FROM actions GROUP BY 1, 2)
SELECT team, match_id, ROUND((SUM(x) OVER (PARTITION BY team) - x) / NULLIF(COUNT(*) OVER (PARTITION BY team) - 1, 0), 6) AS loo FROM m"""))
def a14(spark, sf):
    m = moves(spark, sf).groupBy("team", "match_id").agg(N().cast("double").alias("x"))
    return Q.leave_one_out(m, ["team"], "x", "loo").select("team", "match_id", F.round("loo", 6).alias("loo"))


@query("a15_leave_club_out", sql(FA, """,
m AS (SELECT team, season, COUNT(*) AS n, SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS y FROM actions GROUP BY 1, 2)
SELECT team, season, CAST(SUM(n) OVER (PARTITION BY season) - n AS BIGINT) AS rest_n, CAST(SUM(y) OVER (PARTITION BY season) - y AS BIGINT) AS rest_y FROM m"""))
def a15(spark, sf):
    m = moves(spark, sf).groupBy("team", "season").agg(N().alias("n"), F.sum(F.col("under_pressure").cast("bigint")).alias("y"))
    return Q.leave_unit_out(m, "team", ["season"], ["n", "y"]).select("team", "season", "rest_n", "rest_y")


# -- windows ---------------------------------------------------------------------------------------
@query("w01_cumulative_before", sql(FA, """
SELECT match_id, team, CAST(SUM(b) AS BIGINT) AS s, CAST(MAX(b) AS BIGINT) AS m FROM (SELECT match_id, team, COALESCE(SUM(CASE WHEN outcome = 'GOAL' THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY match_date, possession, event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM actions) GROUP BY 1, 2"""))
def w01(spark, sf):
    d = running(moves(spark, sf), ["match_id"], ["match_date", "possession", "event_index"],
                [Running("b", "sum", (F.col("outcome") == "GOAL").cast("int"))], F.col("match_date"))
    return d.groupBy("match_id", "team").agg(F.sum("b").alias("s"), F.max("b").alias("m"))


@query("w02_reference_team", sql(FA, " SELECT DISTINCT match_id, team, MIN(team) OVER (PARTITION BY match_id) AS team_a FROM actions"))
def w02(spark, sf):
    m = moves(spark, sf)
    ref = m.groupBy("match_id").agg(F.min("team").alias("team_a"))
    return m.select("match_id", "team").distinct().join(ref, "match_id")


@query("w03_index_and_length", sql(FA, """
SELECT k, len, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT ROW_NUMBER() OVER (PARTITION BY poss_uid ORDER BY event_index) AS k, COUNT(*) OVER (PARTITION BY poss_uid) AS len FROM actions) GROUP BY 1, 2"""))
def w03(spark, sf):
    d = position(moves(spark, sf), ["poss_uid"], ["event_index"], chunk_of(), "k", "len")
    return d.groupBy("k", "len").agg(N().alias("n"))


@query("w04_last_action", sql(FA, """
SELECT action_type, AVG(CASE WHEN k = len THEN 1.0 ELSE 0.0 END) AS last_share FROM (SELECT action_type, event_index AS k, COUNT(*) OVER (PARTITION BY poss_uid) AS len FROM actions) GROUP BY 1"""))
def w04(spark, sf):
    d = chains.with_index(moves(spark, sf).drop("length"))
    return d.groupBy("action_type").agg(F.avg((F.col("k") == F.col("length")).cast("double")).alias("last_share"))


@query("w05_first_row", sql(FA, " SELECT match_id, team, MIN_BY(phase, possession * 1048576 + event_index) AS phase, MIN_BY(start_x, possession * 1048576 + event_index) AS start_x FROM actions GROUP BY 1, 2"))
def w05(spark, sf):
    return Q.first_per_key(moves(spark, sf).select("match_id", "team", "phase", "start_x", "possession", "event_index"),
                           ["match_id", "team"], [F.col("possession"), F.col("event_index")]).select(
        "match_id", "team", "phase", "start_x")


@query("w06_runs", sql(ERAS, """,
s AS (SELECT *, CASE WHEN LAG(coach) OVER w IS DISTINCT FROM coach THEN 1 ELSE 0 END AS nw FROM mc WINDOW w AS (PARTITION BY club ORDER BY match_date, match_id)),
r AS (SELECT *, SUM(nw) OVER (PARTITION BY club ORDER BY match_date, match_id) AS run_id FROM s)
SELECT club, CAST(run_id AS BIGINT) AS run_id, coach, CAST(COUNT(*) AS BIGINT) AS n, MIN(match_date) AS start_date, MAX(match_date) AS end_date FROM r GROUP BY 1, 2, 3"""))
def w06(spark, sf):
    d = Q.runs(match_coaches(spark, sf), ["club"], ["match_date", "match_id"], "coach", F.year("match_date"))
    return d.groupBy("club", "run_id", "coach").agg(N().alias("n"), F.min("match_date").alias("start_date"),
                                                    F.max("match_date").alias("end_date"))


@query("w08_season_difference", sql(FA, """,
g AS (SELECT team, season_order, COUNT(*) / COUNT(DISTINCT poss_uid) AS len FROM actions GROUP BY 1, 2)
SELECT team, season_order, ROUND(len - LAG(len) OVER (PARTITION BY team ORDER BY season_order), 6) AS diff FROM g"""))
def w08(spark, sf):
    g = moves(spark, sf).groupBy("team", "season_order").agg((N() / F.countDistinct("poss_uid")).alias("len"))
    d = neighbour(g, ["team"], ["season_order"], {"before": F.col("len")}, -1)
    return d.select("team", "season_order", F.round(F.col("len") - F.col("before"), 6).alias("diff"))


@query("w09_midrank", sql("", """r AS (SELECT l_returnflag, l_quantity, RANK() OVER w + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rk, (RANK() OVER w - 1 + 0.5 * COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity)) / COUNT(*) OVER (PARTITION BY l_returnflag) AS sh
 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity))
SELECT DISTINCT l_returnflag, l_quantity, CAST(rk AS DOUBLE) AS rank, ROUND(sh, 6) AS rank_share FROM r"""))
def w09(spark, sf):
    d = Q.rank_values(load(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", chunk=F.floor(F.col("l_quantity") / 8))
    return d.withColumn("rank_share", F.round("rank_share", 6))


@query("w10_reverse_running_min", sql(FA, """,
m AS (SELECT team, match_id, COUNT(*) AS n FROM actions GROUP BY 1, 2)
SELECT team, match_id, CAST(MIN(n) OVER (PARTITION BY team ORDER BY match_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS least FROM m"""))
def w10(spark, sf):
    m = moves(spark, sf).groupBy("team", "match_id").agg(N().alias("n"))
    return running(m, ["team"], ["match_id"], [Running("least", "min", F.col("n"), inclusive=True, reverse=True)],
                   F.floor(F.col("match_id") / 100)).select("team", "match_id", "least")


@query("w11_gap_blocks", sql(FA, """,
m AS (SELECT DISTINCT team, match_id FROM actions), g AS (SELECT *, CASE WHEN match_id - LAG(match_id) OVER (PARTITION BY team ORDER BY match_id) > 2 THEN 1 ELSE 0 END AS j FROM m)
SELECT team, match_id, CAST(SUM(j) OVER (PARTITION BY team ORDER BY match_id) AS BIGINT) AS block FROM g"""))
def w11(spark, sf):
    ids = moves(spark, sf).select("team", "match_id").distinct()
    return Q.gap_blocks(ids, ["team"], "match_id", 2, F.floor(F.col("match_id") / 100))


@query("w12_even_spacing", sql(FA, """,
m AS (SELECT DISTINCT team, season, match_id FROM actions),
k AS (SELECT *, ROW_NUMBER() OVER w AS k, COUNT(*) OVER (PARTITION BY team, season) AS n FROM m WINDOW w AS (PARTITION BY team, season ORDER BY match_id))
SELECT team, season, match_id, CAST(DATE '2020-01-01' + CAST(CASE WHEN n > 1 THEN ROUND(150 * (k - 1) / (n - 1)) ELSE 0 END AS INTEGER) AS DATE) AS match_date FROM k"""))
def w12(spark, sf):
    ids = moves(spark, sf).select("team", "season", "match_id").distinct().withColumns(
        {"lo": F.to_date(F.lit("2020-01-01")), "hi": F.date_add(F.to_date(F.lit("2020-01-01")), 150)})
    return Q.spread_dates(ids, ["team", "season"], ["match_id"], "lo", "hi",
                          chunk=F.floor(F.col("match_id") / 100)).drop("lo", "hi")


@query("w13_date_halves", sql(ERAS, """,
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY club, coach ORDER BY match_date, match_id) AS k, COUNT(*) OVER (PARTITION BY club, coach) AS n FROM mc)
SELECT club, coach, match_id, CAST(CASE WHEN k <= CEIL(n / 2.0) THEN 1 ELSE 2 END AS INTEGER) AS half_up, CAST(CASE WHEN k <= FLOOR(n / 2.0) THEN 1 ELSE 2 END AS INTEGER) AS half_down FROM k"""))
def w13(spark, sf):
    mc = match_coaches(spark, sf)
    d = Q.halves(mc, ["club", "coach"], ["match_date", "match_id"], True, F.year("match_date"))
    d = Q.halves(d.withColumnRenamed("half", "half_up"), ["club", "coach"], ["match_date", "match_id"], False,
                 F.year("match_date"))
    return d.select("club", "coach", "match_id", "half_up", F.col("half").alias("half_down"))


@query("w14_possession_folds", sql(FA, f"""
SELECT team, poss_uid, CAST(NTILE(5) OVER (PARTITION BY team ORDER BY {draw_sql("'42'", "poss_uid")}, poss_uid) - 1 AS BIGINT) AS fold FROM (SELECT DISTINCT team, poss_uid FROM actions)"""))
def w14(spark, sf):
    from chainspark.operators.estimate import folds
    return folds(moves(spark, sf).select("team", "poss_uid").distinct(), 5, 42, ["team"])


# -- order and sets --------------------------------------------------------------------------------
@query("o03_top_per_group", sql(FA, """,
g AS (SELECT team, player_id, COUNT(*) AS n FROM actions GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY n DESC, player_id) AS k FROM g)
SELECT team, player_id, CAST(n AS BIGINT) AS n FROM r WHERE k <= 3"""))
def o03(spark, sf):
    g = moves(spark, sf).groupBy("team", "player_id").agg(N().alias("n"))
    return Q.top_k_per_key(g, ["team"], [F.desc("n"), F.col("player_id")], 3)


@query("o04_nearest_to_target", sql(FA, """,
p AS (SELECT team, poss_uid, COUNT(*) AS n, MIN(match_date) AS d FROM actions GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY ABS(n - 5), d, poss_uid) AS k FROM p)
SELECT team, poss_uid, CAST(n AS BIGINT) AS n FROM r WHERE k = 1"""))
def o04(spark, sf):
    p = moves(spark, sf).groupBy("team", "poss_uid").agg(N().alias("n"), F.min("match_date").alias("d"))
    return Q.first_per_key(p, ["team"], [F.abs(F.col("n") - 5), F.col("d"), F.col("poss_uid")]).select("team", "poss_uid", "n")


@query("u01_union_by_name", sql(FA, """
SELECT tag, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(start_x) AS BIGINT) AS with_x FROM (SELECT 'a' AS tag, start_x FROM actions UNION ALL SELECT 'e', NULL FROM events) GROUP BY tag"""))
def u01(spark, sf):
    a = moves(spark, sf).select(F.lit("a").alias("tag"), "start_x")
    e = load(spark, sf, "events").select(F.lit("e").alias("tag"), "event_id")
    return a.unionByName(e, allowMissingColumns=True).groupBy("tag").agg(N().alias("n"), F.count("start_x").alias("with_x"))


@query("u02_append_rows", sql(FA, """
SELECT team, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT team FROM actions UNION ALL SELECT team FROM (SELECT DISTINCT team, match_id FROM actions)) GROUP BY team"""))
def u02(spark, sf):
    m = moves(spark, sf)
    return m.select("team").union(m.select("team", "match_id").distinct().select("team")).groupBy("team").agg(N().alias("n"))


@query("u03_distinct_subset", sql(FA, " SELECT DISTINCT match_id, team, season FROM actions"))
def u03(spark, sf):
    return moves(spark, sf).select("match_id", "team", "season").dropDuplicates()


@query("u04_jaccard", sql(FA, """,
m AS (SELECT team, coach, player_id FROM actions WHERE action_type = 'Shot' GROUP BY 1, 2, 3), s AS (SELECT team, coach, COUNT(*) AS n FROM m GROUP BY 1, 2),
c AS (SELECT x.coach AS a, y.coach AS b, COUNT(*) AS c FROM m x JOIN m y ON x.team = y.team AND x.player_id = y.player_id AND x.coach < y.coach GROUP BY 1, 2)
SELECT x.team, x.coach AS a, y.coach AS b, CAST(x.n AS BIGINT) AS n_a, CAST(y.n AS BIGINT) AS n_b, CAST(COALESCE(c, 0) AS BIGINT) AS common, ROUND(COALESCE(c, 0) / (x.n + y.n - COALESCE(c, 0)), 6) AS jaccard
FROM s x JOIN s y ON x.team = y.team AND x.coach < y.coach LEFT JOIN c ON c.a = x.coach AND c.b = y.coach"""))
def u04(spark, sf):
    m = moves(spark, sf).filter("action_type = 'Shot'").select("team", "coach", "player_id")
    return Q.jaccard(m, ["team"], "coach", "player_id").withColumn("jaccard", F.round("jaccard", 6))


@query("u05_table_difference", sql(FA, """,
a AS (SELECT match_id, team, COUNT(*) AS n FROM actions GROUP BY 1, 2), b AS (SELECT match_id, team, COUNT(*) AS n FROM actions WHERE match_id % 10 <> 0 OR team <> 'T2' GROUP BY 1, 2)
SELECT match_id, team, CAST(n AS BIGINT) AS n, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT match_id, team, CAST(n AS BIGINT), 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""))
def u05(spark, sf):
    m = moves(spark, sf)
    a = m.groupBy("match_id", "team").agg(N().alias("n"))
    b = m.filter("match_id % 10 <> 0 or team <> 'T2'").groupBy("match_id", "team").agg(N().alias("n"))
    return Q.table_difference(a, b)


@query("u05_duplicate_rows", sql("", """d AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CAST(n AS BIGINT) AS n FROM d WHERE n > 1"""))
def u05b(spark, sf):
    return Q.duplicates(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("u06_defender_view", sql(FA, """
SELECT b.team AS defender, a.team AS attacker, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS BIGINT) AS pressed
FROM actions a JOIN (SELECT DISTINCT match_id, team FROM actions) b ON a.match_id = b.match_id AND a.team <> b.team GROUP BY 1, 2"""))
def u06(spark, sf):
    # one row per side of a match before the sides meet
    side = moves(spark, sf).groupBy("match_id", "team").agg(N().alias("n"), F.sum(F.col("under_pressure").cast("bigint")).alias("pressed"))
    rival = side.select("match_id", F.col("team").alias("defender"))
    return side.join(rival, "match_id").filter("team <> defender").groupBy("defender", F.col("team").alias("attacker")).agg(
        F.sum("n").alias("n"), F.sum("pressed").alias("pressed"))
