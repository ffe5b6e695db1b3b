"""Chain building (T), projections and predicates (P), windows (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspark.operators import chains
from chainspark.operators.resolution import resolution_sweep
from chainspark.plans.registry import query
from chainspark.plans.tables import MOVES, PHASE_SQL, SPACE, TR, artifact, moves, sql, transitions, zone_sql
from chainspark.sources import events as E


# -- raw event log derived from the lines: nested locations, foreign executors, gaps ---------
def raw_events(spark, sf):
    return artifact(spark, sf, "events", _raw_events)


def _raw_events(spark, sf):
    m = moves(spark, sf)
    odd = F.col("player_id") % 7 == 5
    kind, out = F.col("action_type"), F.col("outcome")
    loc = F.array("start_x", "start_y")
    end = F.when(F.pmod(F.col("possession"), F.lit(11)) != 3, F.array("end_x", "end_y"))
    index = (F.col("possession") * 1048576 + F.col("event_index")).cast("bigint")
    last = out != ""
    return m.select(
        F.concat_ws(":", "poss_uid", "event_index").alias("id"), index.alias("index"), "match_id",
        F.lit(1).alias("period"), (F.col("event_index") % 90).cast("int").alias("minute"),
        F.lit(0).alias("second"),
        F.when(last & out.isin("LOSS", "OUT"), "Pass").otherwise(kind).alias("type"),
        F.when(odd & ~last, F.col("opponent")).otherwise(F.col("team")).alias("team"),
        "possession", F.col("team").alias("possession_team"),
        F.when(F.col("phase") == "open", "Regular Play").when(F.col("phase") == "restart", "From Throw In")
         .when(F.col("phase") == "set_piece", "Other").otherwise("From Keeper").alias("play_pattern"),
        loc.alias("location"),
        F.when(kind != "Carry", end).alias("pass_end_location"),
        F.when(kind == "Carry", end).alias("carry_end_location"),
        F.when(out == "LOSS", "Incomplete").when(out == "OUT", "Out").alias("pass_outcome"),
        F.when(kind == "Shot", F.when(out == "GOAL", "Goal").otherwise("Saved")).alias("shot_outcome"),
        F.when(F.col("under_pressure"), True).alias("under_pressure"),
        F.col("player_id").cast("string").alias("player"), "player_id")


EV = MOVES + """,
ev AS MATERIALIZED (
  SELECT possession * 1048576 + event_index AS index, match_id, possession, event_index, poss_uid, phase, player_id, under_pressure, outcome,
    CASE WHEN outcome IN ('LOSS','OUT') THEN 'Pass' ELSE action_type END AS type,
    CASE WHEN player_id % 7 = 5 AND outcome = '' THEN opponent ELSE team END AS team, team AS possession_team,
    start_x, start_y,
    CASE WHEN action_type = 'Shot' AND outcome NOT IN ('LOSS','OUT') THEN NULL
         WHEN outcome IN ('LOSS','OUT') AND action_type = 'Carry' THEN NULL
         WHEN possession % 11 <> 3 THEN end_x END AS end_x,
    CASE WHEN action_type = 'Shot' AND outcome NOT IN ('LOSS','OUT') THEN NULL
         WHEN outcome IN ('LOSS','OUT') AND action_type = 'Carry' THEN NULL
         WHEN possession % 11 <> 3 THEN end_y END AS end_y
  FROM moves)"""

SCORE = EV + """,
refs AS (SELECT match_id, MIN(team) AS team_a FROM ev GROUP BY match_id),
sc0 AS (SELECT ev.*, team_a, CASE WHEN type = 'Shot' AND outcome = 'GOAL' THEN 1 ELSE 0 END AS g FROM ev JOIN refs USING (match_id)),
sc1 AS (SELECT *, COALESCE(SUM(CASE WHEN team = team_a THEN g ELSE -g END) OVER (PARTITION BY match_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead_a FROM sc0),
sc2 AS (SELECT *, CAST(CASE WHEN possession_team = team_a THEN lead_a ELSE -lead_a END AS BIGINT) AS goal_diff FROM sc1),
sc AS (SELECT *, CASE WHEN goal_diff < 0 THEN 'losing' WHEN goal_diff > 0 THEN 'winning' ELSE 'drawing' END AS score_state,
    CASE WHEN possession_team = 'T1' THEN goal_diff ELSE -goal_diff END AS goal_diff_club FROM sc2)"""

EXTRACTED = f""",
ex AS (SELECT *, {zone_sql('start_x', 'start_y')} * 4 + {PHASE_SQL} AS from_state,
    CASE outcome WHEN 'GOAL' THEN 80 WHEN 'SHOT_NOGOAL' THEN 81 WHEN 'LOSS' THEN 82 WHEN 'OUT' THEN 83 ELSE
      CASE WHEN end_x IS NULL THEN 82 ELSE {zone_sql('end_x', 'end_y')} * 4 + {PHASE_SQL} END END AS to_state
  FROM sc WHERE possession_team = team AND (type <> 'Carry' OR sqrt((end_x-start_x)*(end_x-start_x)+(end_y-start_y)*(end_y-start_y)) >= 5)),
b0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY poss_uid ORDER BY index DESC) AS back FROM ex),
b1 AS (SELECT poss_uid, match_id, team, index, phase, score_state, CASE WHEN goal_diff_club < 0 THEN 'losing' WHEN goal_diff_club > 0 THEN 'winning' ELSE 'drawing' END AS score_state_club,
   type AS action_type, player_id, under_pressure, from_state, to_state FROM b0
  UNION ALL SELECT poss_uid, match_id, team, index + 1, phase, score_state, CASE WHEN goal_diff_club < 0 THEN 'losing' WHEN goal_diff_club > 0 THEN 'winning' ELSE 'drawing' END,
   'TERMINAL', NULL, NULL, to_state, 82 FROM b0 WHERE back = 1 AND to_state < 80),
b2 AS (SELECT *, COUNT(*) OVER (PARTITION BY poss_uid) AS n_rows FROM b1),
built AS (SELECT * FROM b2 WHERE n_rows >= CASE WHEN team = 'T1' THEN 2 ELSE 1 END)"""


@query("t01_score_state", sql(SCORE, """
SELECT match_id, score_state, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(goal_diff) AS BIGINT) AS sum_diff, CAST(SUM(goal_diff_club) AS BIGINT) AS sum_club
FROM sc GROUP BY match_id, score_state"""))
def t01(spark, sf):
    df = chains.add_score_state(E.normalise(raw_events(spark, sf)), club="T1",
                                chunk=F.floor(F.col("index") / (1048576 * 1024)))
    return df.groupBy("match_id", "score_state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("goal_diff").alias("sum_diff"),
        F.sum("goal_diff_club").alias("sum_club"))


@query("t02_extract_actions", sql(SCORE + EXTRACTED, """
SELECT type, outcome, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS BIGINT) AS pressed,
  ROUND(SUM(start_x), 4) AS sx, ROUND(SUM(end_x), 4) AS ex FROM ex GROUP BY type, outcome"""))
def t02(spark, sf):
    df = chains.extract_actions(E.normalise(raw_events(spark, sf)))
    return df.groupBy("type", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("under_pressure").cast("bigint")).alias("pressed"),
        F.round(F.sum("start_x"), 4).alias("sx"), F.round(F.sum("end_x"), 4).alias("ex"))


@query("t03_build_transitions", sql(SCORE + EXTRACTED, """
SELECT poss_uid, match_id, team, index AS event_index, phase, score_state, score_state_club, action_type, player_id, CAST(player_id AS VARCHAR) AS player,
  under_pressure, from_state, to_state, to_state >= 80 AS is_absorbing FROM built"""))
def t03(spark, sf):
    return chains.build_transitions(E.normalise(raw_events(spark, sf)), SPACE, club="T1",
                                    chunk=F.floor(F.col("index") / (1048576 * 1024)))


@query("t04_terminal_absorption", sql(TR, """
SELECT poss_uid, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(CASE WHEN action_type = 'TERMINAL' THEN 1 ELSE 0 END) AS BIGINT) AS terminal,
  CAST(MAX(to_state) AS BIGINT) AS end_state FROM tr GROUP BY poss_uid"""))
def t04(spark, sf):
    return transitions(spark, sf).groupBy("poss_uid").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col("action_type") == "TERMINAL").cast("bigint")).alias("terminal"),
        F.max("to_state").alias("end_state"))


@query("t05_min_length_asymmetric", sql(TR, """,
c AS (SELECT poss_uid, team, COUNT(*) AS n FROM tr GROUP BY 1, 2)
SELECT team, CAST(COUNT(*) AS BIGINT) AS possessions, CAST(SUM(n) AS BIGINT) AS n_rows FROM c
WHERE n >= CASE WHEN team = 'T1' THEN 3 ELSE 2 END GROUP BY team"""))
def t05(spark, sf):
    df = chains.drop_short(transitions(spark, sf), 3, 2, "T1")
    return df.groupBy("team").agg(F.countDistinct("poss_uid").alias("possessions"),
                                  F.count(F.lit(1)).alias("n_rows"))


@query("t06_coordinate_sanity", sql(TR, """,
p AS (SELECT CAST(FLOOR(from_state / 16) AS BIGINT) AS ix, AVG(CASE WHEN to_state = 80 THEN 1.0 ELSE 0.0 END) AS rate FROM tr GROUP BY 1)
SELECT CAST(COUNT(*) AS BIGINT) AS n_columns, CORR(CAST(ix AS DOUBLE), rate) AS corr, COUNT(*) >= 3 AND CORR(CAST(ix AS DOUBLE), rate) > 0.5 AS ok FROM p"""))
def t06(spark, sf):
    return chains.coordinate_sanity(transitions(spark, sf), SPACE)


@query("t07_build_report", sql(TR, """,
x AS (SELECT *, 'all' AS level FROM tr UNION ALL SELECT *, phase FROM tr)
SELECT level, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT poss_uid) AS BIGINT) AS possessions, CAST(COUNT(DISTINCT match_id) AS BIGINT) AS matches,
 CAST(SUM(CASE WHEN action_type = 'TERMINAL' THEN 1 ELSE 0 END) AS BIGINT) AS terminal_rows,
 AVG(CASE WHEN action_type <> 'TERMINAL' THEN CASE WHEN under_pressure THEN 1.0 ELSE 0.0 END END) AS pressure_rate FROM x GROUP BY level"""))
def t07(spark, sf):
    return chains.build_report(transitions(spark, sf), "phase")


@query("t08_league_prior_table", sql(TR, """,
c AS (SELECT *, COUNT(*) OVER (PARTITION BY poss_uid) AS n FROM tr)
SELECT team, season, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT poss_uid) AS BIGINT) AS possessions, CAST(COUNT(DISTINCT coach) AS BIGINT) AS coaches
FROM c WHERE n >= 2 GROUP BY team, season"""))
def t08(spark, sf):
    df = chains.drop_short(transitions(spark, sf), 2)
    return df.groupBy("team", "season").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("poss_uid").alias("possessions"),
        F.countDistinct("coach").alias("coaches"))


@query("t09_possession_summary", sql(TR, """
SELECT poss_uid, MIN(team) AS team, MIN(coach) AS coach, MIN(opponent) AS opponent, CAST(COUNT(*) AS BIGINT) AS n_actions,
 CAST(MAX(CASE WHEN to_state IN (80, 81) THEN 1 ELSE 0 END) AS INTEGER) AS shot, CAST(MAX(CASE WHEN to_state = 80 THEN 1 ELSE 0 END) AS INTEGER) AS goal,
 AVG(CASE WHEN under_pressure THEN 1.0 WHEN NOT under_pressure THEN 0.0 END) AS pressure_rate FROM tr GROUP BY poss_uid"""))
def t09(spark, sf):
    return chains.per_possession(transitions(spark, sf), SPACE, ("team", "coach", "opponent"))


@query("t10_length_histogram", sql(TR, """,
c AS (SELECT poss_uid, team, COUNT(*) AS length FROM tr GROUP BY 1, 2)
SELECT team, length, CAST(COUNT(*) AS BIGINT) AS possessions FROM c GROUP BY 1, 2"""))
def t10(spark, sf):
    return chains.length_histogram(transitions(spark, sf), ("team",))


@query("t11_self_transitions", sql(TR, """,
x AS (SELECT *, 'all' AS level FROM tr UNION ALL SELECT *, action_type FROM tr)
SELECT level, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN from_state = to_state THEN 1 ELSE 0 END) AS BIGINT) AS loops,
 AVG(CASE WHEN from_state = to_state THEN 1.0 ELSE 0.0 END) AS share,
 AVG(CASE WHEN NOT is_absorbing THEN CASE WHEN from_state = to_state THEN 1.0 ELSE 0.0 END END) AS share_of_moving FROM x GROUP BY level"""))
def t11(spark, sf):
    return chains.self_transitions(transitions(spark, sf), "action_type")


GRIDS = [(3, 2), (5, 4), (8, 6)]


def _sweep_sql():
    parts = []
    for nx, ny in GRIDS:
        base, zone = nx * ny * 4, zone_sql("end_x", "end_y", nx, ny)
        end = f"CASE outcome WHEN 'GOAL' THEN {base} WHEN 'SHOT_NOGOAL' THEN {base + 1} WHEN 'LOSS' THEN {base + 2} WHEN 'OUT' THEN {base + 3} ELSE {zone} * 4 + {PHASE_SQL} END"
        parts.append(f"SELECT {nx} AS nx, {ny} AS ny, {base} AS nt, team, event_index, next_x IS NULL AS last, {zone_sql('start_x', 'start_y', nx, ny)} * 4 + {PHASE_SQL} AS i, {end} AS j FROM moves")
    return ",\nsw0 AS (" + " UNION ALL ".join(parts) + """),
sw AS MATERIALIZED (SELECT nx, ny, nt, UNNEST([team, 'all']) AS team, event_index, last, i, j FROM sw0),
st AS MATERIALIZED (SELECT nx, ny, nt, team, i, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY nx, team) AS a FROM sw WHERE event_index = 1 GROUP BY 1, 2, 3, 4, 5),
ct AS MATERIALIZED (SELECT nx, ny, nt, team, i, j, COUNT(*)::DOUBLE AS n FROM (SELECT nx, ny, nt, team, i, j FROM sw UNION ALL SELECT nx, ny, nt, team, j, nt + 2 FROM sw WHERE last AND j < nt) GROUP BY ALL),
ok AS (SELECT *, SUM(CASE WHEN i <> j THEN n ELSE 0 END) OVER (PARTITION BY nx, team, i) AS off FROM ct),
pq AS MATERIALIZED (SELECT 'kept' AS arm, nx, team, i, j, nt, n / SUM(n) OVER (PARTITION BY nx, team, i) AS p FROM ct
  UNION ALL SELECT 'moving', nx, team, i, j, nt, n / SUM(n) OVER (PARTITION BY nx, team, i) FROM ok WHERE i <> j OR off = 0),
it AS (SELECT 0 AS k, arm, nx, team, i, a AS m FROM st, (SELECT UNNEST(['kept', 'moving']) AS arm)
  UNION ALL SELECT it.k + 1, q.arm, q.nx, q.team, q.j, SUM(it.m * q.p) FROM it JOIN pq q ON q.arm = it.arm AND q.nx = it.nx AND q.team = it.team AND q.i = it.i WHERE it.k < 150 AND q.j < q.nt GROUP BY it.k, q.arm, q.nx, q.team, q.j),
et AS (SELECT nx, team, SUM(CASE WHEN arm = 'kept' THEN m END) AS e_t, SUM(CASE WHEN arm = 'moving' THEN m END) AS e_m FROM it GROUP BY 1, 2),
rw AS (SELECT nx, team, i, SUM(n) AS n FROM ct GROUP BY 1, 2, 3),
dg AS (SELECT nx, ny, nt, team, SUM(n) AS transitions, COUNT(*) AS cells_used, COUNT(DISTINCT i) AS rows_used, SUM(CASE WHEN i = j THEN n ELSE 0 END) / SUM(n) AS diagonal_share FROM ct GROUP BY 1, 2, 3, 4)
SELECT CAST(dg.nx AS INTEGER) AS nx, CAST(ny AS INTEGER) AS ny, dg.team, transitions, CAST(cells_used AS BIGINT) AS cells_used, CAST(rows_used AS BIGINT) AS rows_used, ROUND(diagonal_share, 6) AS diagonal_share,
 ROUND((nt - (SELECT COUNT(*) FROM rw WHERE rw.nx = dg.nx AND rw.team = dg.team AND n >= 30)) / nt, 6) AS frac_below_min, ROUND(nt * (nt + 3) / transitions, 6) AS params_per_obs,
 ROUND(et.e_t, 6) AS e_t, ROUND(et.e_m, 6) AS e_t_moving, ROUND((et.e_t / w.e_t - 1) * 100, 4) AS delta_pct, ROUND((et.e_m / w.e_m - 1) * 100, 4) AS delta_pct_moving
FROM dg JOIN et ON et.nx = dg.nx AND et.team = dg.team JOIN et w ON w.nx = dg.nx AND w.team = 'all'"""


@query("t12_resolution_sweep", "WITH RECURSIVE " + MOVES.strip() + _sweep_sql())
def t12(spark, sf):
    d = resolution_sweep(moves(spark, sf), GRIDS, SPACE, "team")
    return d.withColumns({c: F.round(c, 4 if c.startswith("delta") else 6) for c in (
        "diagonal_share", "frac_below_min", "params_per_obs", "e_t", "e_t_moving", "delta_pct", "delta_pct_moving")})
