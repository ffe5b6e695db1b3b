"""Shots and set pieces (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.draws import SPAN, poisson1_steps
from chainspark.operators import absorb as C
from chainspark.operators import estimate as E
from chainspark.operators import logistic as G
from chainspark.operators import relations as Q
from chainspark.operators import resample as R
from chainspark.operators import shots as X
from chainspark.operators import standardise as D
from chainspark.plans.estimate_queries import VALUES, matrix, rsql
from chainspark.plans.inference_queries import rounded, weights_sql
from chainspark.plans.registry import query
from chainspark.session import cut_lineage
from chainspark.plans.tables import FA, SPACE, TR, artifact, draw_sql, moves, sql, transitions


# -- shots with a frame derived from their own row: up to six players around the shot ---------------
def shots(spark, sf):
    return artifact(spark, sf, "shots", _shots)


def _shots(spark, sf):
    s = moves(spark, sf).filter("action_type = 'Shot'")
    n = (F.col("player_id") % 6 + 1).cast("int")

    def person(k):
        x = F.col("start_x") + 2.0 * k + F.col("possession") % 5 - 4.0
        y = F.col("start_y") + (k - 3) * 0.5 + (F.col("possession") % 3 - 1) * 0.25
        keeper = (k == n) & (F.col("possession") % 7 > 0)
        return F.struct(F.array(x, y).alias("location"), ((F.col("possession") + k) % 4 == 0).alias("teammate"),
                        F.struct(k.cast("bigint").alias("id"), F.when(keeper, "Goalkeeper").otherwise("Back").alias("name")).alias("position"))
    frame = F.transform(F.sequence(F.lit(1), n), person)
    goal = (F.col("outcome") == "GOAL").cast("int")
    return s.select("match_id", "poss_uid", "possession", "event_index", "team", "opponent", "coach", "season", "player_id", "start_x", "start_y",
                    goal.alias("goal"), frame.alias("frame"))


SHOTS = FA + """,
sh AS MATERIALIZED (SELECT *, CASE WHEN outcome = 'GOAL' THEN 1 ELSE 0 END AS goal FROM actions WHERE action_type = 'Shot'),
fr AS MATERIALIZED (SELECT poss_uid, start_x AS sx0, LEAST(start_x, CAST(119.9 AS DOUBLE)) AS sx, start_y AS sy, k, start_x + 2.0 * k + possession % 5 - 4.0 AS dx, start_y + (k - 3) * 0.5 + (possession % 3 - 1) * 0.25 AS dy,
  (possession + k) % 4 = 0 AS mate, k = player_id % 6 + 1 AND possession % 7 > 0 AS keeper FROM sh, LATERAL (SELECT UNNEST(range(1, player_id % 6 + 2)) AS k)),
gm AS (SELECT poss_uid, LEAST(start_x, CAST(119.9 AS DOUBLE)) AS sx, start_y AS sy, ATAN2(36 - start_y, 120 - LEAST(start_x, CAST(119.9 AS DOUBLE))) AS lo, ATAN2(44 - start_y, 120 - LEAST(start_x, CAST(119.9 AS DOUBLE))) AS hi FROM sh),
df AS (SELECT fr.poss_uid, gm.lo, gm.hi, SQRT(POW(dx - fr.sx, 2) + POW(dy - fr.sy, 2)) AS rho, ATAN2(dy - fr.sy, dx - fr.sx) AS phi FROM fr JOIN gm ON gm.poss_uid = fr.poss_uid WHERE NOT mate AND NOT keeper AND dx > fr.sx),
sd AS MATERIALIZED (SELECT poss_uid, rho, GREATEST(lo, phi - ASIN(LEAST(1, 0.3 / rho))) AS a, LEAST(hi, phi + ASIN(LEAST(1, 0.3 / rho))) AS b FROM df WHERE rho >= 1e-9),
om AS (SELECT poss_uid, a, b, GREATEST(a, COALESCE(MAX(b) OVER (PARTITION BY poss_uid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS a2 FROM sd WHERE b > a),
un AS (SELECT poss_uid, SUM(GREATEST(0, b - a2)) AS blocked FROM om GROUP BY 1),
vg AS MATERIALIZED (SELECT gm.poss_uid, CASE WHEN EXISTS (SELECT 1 FROM sd WHERE sd.poss_uid = gm.poss_uid AND rho <= 0.3) THEN 0 ELSE GREATEST(0, LEAST(1, 1 - COALESCE(blocked, 0) / (hi - lo))) END AS visible FROM gm LEFT JOIN un ON un.poss_uid = gm.poss_uid)"""


def field_locations():
    return F.transform(X.opponents(F.col("frame"), False), lambda p: p["location"])


@query("x01_frame_audit", sql(SHOTS, """,
a AS (SELECT poss_uid, SUM(CASE WHEN NOT mate AND keeper THEN 1 ELSE 0 END) AS kp, SUM(CASE WHEN NOT mate AND NOT keeper THEN 1 ELSE 0 END) AS de FROM fr GROUP BY 1)
SELECT team, CAST(COUNT(*) AS BIGINT) AS shots, CAST(SUM(CASE WHEN sh.possession % 10 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_frame, CAST(0 AS BIGINT) AS unreadable, ROUND(AVG(CASE WHEN sh.possession % 10 > 0 THEN CASE WHEN kp = 0 THEN 1.0 ELSE 0.0 END END), 6) AS no_keeper, ROUND(AVG(CASE WHEN sh.possession % 10 > 0 THEN CAST(de AS DOUBLE) END), 6) AS defenders
FROM sh JOIN a ON a.poss_uid = sh.poss_uid GROUP BY team"""))
def x01(spark, sf):
    json = F.to_json("frame")
    literal = F.replace(F.replace(F.replace(json, F.lit('"'), F.lit("'")), F.lit("true"), F.lit("True")), F.lit("false"), F.lit("False"))
    text = F.when(F.col("possession") % 10 > 0, F.when(F.col("possession") % 2 == 0, json).otherwise(literal))
    d = X.frame_audit(shots(spark, sf).withColumn("text", text), ["team"], "text")
    return d.withColumns({c: F.round(c, 6) for c in ("no_keeper", "defenders")})


@query("x02_visible_goal", sql(SHOTS, " SELECT poss_uid, ROUND(visible, 6) AS visible FROM vg"))
def x02(spark, sf):
    v = X.visible_goal(F.col("start_x"), F.col("start_y"), field_locations())
    return shots(spark, sf).select("poss_uid", F.round(v, 6).alias("visible"))


@query("x03_blocked_segments", sql(SHOTS, """
SELECT s.poss_uid, CAST(COUNT(*) AS BIGINT) AS pieces, ROUND(SUM(LEAST(44, s2.hi) - GREATEST(36, s2.lo)), 6) AS total FROM (SELECT sd.poss_uid, gm.sy + (120 - gm.sx) * TAN(a) AS lo, gm.sy + (120 - gm.sx) * TAN(b) AS hi FROM sd JOIN gm ON gm.poss_uid = sd.poss_uid WHERE b > a) s2 JOIN sh s ON s.poss_uid = s2.poss_uid
WHERE s.poss_uid NOT IN (SELECT poss_uid FROM sd WHERE rho <= 0.3) AND s2.hi > s2.lo GROUP BY 1 UNION ALL SELECT DISTINCT poss_uid, CAST(1 AS BIGINT), CAST(8 AS DOUBLE) FROM sd WHERE rho <= 0.3"""))
def x03(spark, sf):
    seg = X.blocked_segments(F.col("start_x"), F.col("start_y"), field_locations())
    d = shots(spark, sf).select("poss_uid", F.explode(seg).alias("s"))
    return d.groupBy("poss_uid").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(F.col("s.hi") - F.col("s.lo")), 6).alias("total"))


FEATS = ["goal_distance", "goal_angle", "visible", "within_3"]


def shot_features(spark, sf):
    return X.features(shots(spark, sf), "start_x", "start_y", "frame")


@query("x04_shot_features", sql(SHOTS, """,
f AS (SELECT poss_uid, MIN(CASE WHEN NOT mate AND NOT keeper THEN SQRT(POW(dx - sx0, 2) + POW(dy - sy, 2)) END) AS nearest, SUM(CASE WHEN NOT mate AND NOT keeper AND SQRT(POW(dx - sx0, 2) + POW(dy - sy, 2)) <= 3 THEN 1.0 ELSE 0.0 END) AS within_3,
  MAX(CASE WHEN NOT mate AND keeper THEN 120 - dx END) AS keeper_depth, MAX(CASE WHEN NOT mate AND keeper THEN ABS((40 - sy) * dx - (120 - sx0) * dy + 120 * sy - 40 * sx0) / (SQRT(POW(120 - sx0, 2) + POW(40 - sy, 2)) + 1e-12) END) AS keeper_offset, SUM(CASE WHEN NOT mate AND NOT keeper THEN 1.0 ELSE 0.0 END) AS defenders FROM fr GROUP BY 1)
SELECT sh.poss_uid, ROUND(SQRT(POW(120 - start_x, 2) + POW(40 - start_y, 2)), 6) AS goal_distance,
 ROUND(ACOS(LEAST(GREATEST(((120 - start_x) * (120 - start_x) + (36 - start_y) * (44 - start_y)) / (SQRT(POW(120 - start_x, 2) + POW(36 - start_y, 2)) * SQRT(POW(120 - start_x, 2) + POW(44 - start_y, 2)) + 1e-12), -1), 1)), 6) AS goal_angle,
 ROUND(visible, 6) AS visible, ROUND(nearest, 6) AS nearest, within_3, ROUND(keeper_depth, 6) AS keeper_depth, ROUND(keeper_offset, 6) AS keeper_offset, defenders FROM sh JOIN f ON f.poss_uid = sh.poss_uid JOIN vg ON vg.poss_uid = sh.poss_uid"""))
def x04(spark, sf):
    return rounded(shot_features(spark, sf), ["poss_uid"], ["goal_distance", "goal_angle", "visible", "nearest", "within_3",
                                                          "keeper_depth", "keeper_offset", "defenders"])


FT = SHOTS + """,
wi AS (SELECT poss_uid, SUM(CASE WHEN NOT mate AND NOT keeper AND SQRT(POW(dx - sx0, 2) + POW(dy - sy, 2)) <= 3 THEN 1.0 ELSE 0.0 END) AS within_3 FROM fr GROUP BY 1),
ft AS MATERIALIZED (SELECT sh.match_id, sh.poss_uid, team, coach, goal, SQRT(POW(120 - start_x, 2) + POW(40 - start_y, 2)) AS x1,
 ACOS(LEAST(GREATEST(((120 - start_x) * (120 - start_x) + (36 - start_y) * (44 - start_y)) / (SQRT(POW(120 - start_x, 2) + POW(36 - start_y, 2)) * SQRT(POW(120 - start_x, 2) + POW(44 - start_y, 2)) + 1e-12), -1), 1)) AS x2,
 CAST(visible AS DOUBLE) AS x3, CAST(within_3 AS DOUBLE) AS x4 FROM sh JOIN wi ON wi.poss_uid = sh.poss_uid JOIN vg ON vg.poss_uid = sh.poss_uid)"""


def newton_sql(rows: str, p: int, lam: float, steps: int = 14) -> str:
    """Table ``fit`` (k, m1.., s1.., b0..bp) of penalised logistic fits per k of ``rows`` (k, w, y, x1..xp), by Newton's steps.

    A step is one aggregate of the score and its derivatives and a solve by elimination, column by column.
    """
    xs = [f"x{i}" for i in range(1, p + 1)]
    n = p + 1
    out = [f"mo AS MATERIALIZED (SELECT k, {', '.join(f'SUM(w * {x}) / SUM(w) AS m{x[1:]}, SQRT(GREATEST(SUM(w * {x} * {x}) / SUM(w) - POW(SUM(w * {x}) / SUM(w), 2), 0)) AS s{x[1:]}' for x in xs)} FROM {rows} GROUP BY 1)",
           f"zr AS MATERIALIZED (SELECT r.k, w, y, CAST(1 AS DOUBLE) AS z0, {', '.join(f'({x} - m{x[1:]}) / (s{x[1:]} + 1e-9) AS z{x[1:]}' for x in xs)} FROM {rows} r JOIN mo ON mo.k IS NOT DISTINCT FROM r.k)",
           f"n0 AS (SELECT k, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(n))} FROM mo)"]
    for t in range(steps):
        eta = " + ".join(f"b{i} * z{i}" for i in range(n))
        pen = lambda i: lam if i else 0.0
        cells = [f"SUM(v * z{i} * z{j}) + {pen(i) if i == j else 0.0} AS a{i}_{j}" for i in range(n) for j in range(n)]
        cells += [f"SUM(w * z{i} * (y - mu)) - {pen(i)} * MAX(b{i}) AS a{i}_{n}" for i in range(n)]
        out.append(f"h{t}_0 AS MATERIALIZED (SELECT k, {', '.join(cells)} FROM (SELECT *, w * mu * (1 - mu) AS v FROM (SELECT zr.*, {', '.join(f'b{i}' for i in range(n))}, 1 / (1 + EXP(-({eta}))) AS mu FROM zr JOIN n{t} ON n{t}.k IS NOT DISTINCT FROM zr.k)) GROUP BY 1)")
        for c in range(n):
            cells = [f"a{c}_{j} / a{c}_{c} AS a{c}_{j}" if i == c else f"a{i}_{j} - a{i}_{c} * a{c}_{j} / a{c}_{c} AS a{i}_{j}"
                     for i in range(n) for j in range(c + 1, n + 1)]
            out.append(f"h{t}_{c + 1} AS MATERIALIZED (SELECT k, {', '.join(cells)} FROM h{t}_{c})")
        out.append(f"n{t + 1} AS MATERIALIZED (SELECT n{t}.k, {', '.join(f'b{i} + a{i}_{n} AS b{i}' for i in range(n))} FROM n{t} JOIN h{t}_{n} h ON h.k IS NOT DISTINCT FROM n{t}.k)")
    out.append(f"fit AS MATERIALIZED (SELECT mo.*, {', '.join(f'b{i}' for i in range(n))} FROM mo JOIN n{steps} ON n{steps}.k IS NOT DISTINCT FROM mo.k)")
    return ",\n" + ",\n".join(out)


def _terms_sql(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT k, '{t}' AS term, b{i} AS beta FROM fit" for i, t in enumerate(names))


OOF = FT + f""",
om1 AS (SELECT match_id, ROW_NUMBER() OVER (ORDER BY {draw_sql("'5'", "match_id")}, match_id) - 1 AS pos, COUNT(*) OVER () AS m FROM (SELECT DISTINCT match_id FROM ft)),
fo AS (SELECT match_id, CASE WHEN pos < (m % 4) * (m // 4 + 1) THEN pos // (m // 4 + 1) ELSE m % 4 + (pos - (m % 4) * (m // 4 + 1)) // GREATEST(m // 4, 1) END AS fold FROM om1),
fr2 AS MATERIALIZED (SELECT ft.*, fold FROM ft JOIN fo ON fo.match_id = ft.match_id),
tn AS MATERIALIZED (SELECT k, CAST(1 AS DOUBLE) AS w, CAST(goal AS DOUBLE) AS y, x1, x2, x3, x4 FROM fr2, (SELECT UNNEST(range(4)) AS k) WHERE k <> fold)""" + newton_sql("tn", 4, 3.0) + """,
pr AS MATERIALIZED (SELECT fr2.*, 1 / (1 + EXP(-(b0 + b1 * (x1 - m1) / (s1 + 1e-9) + b2 * (x2 - m2) / (s2 + 1e-9) + b3 * (x3 - m3) / (s3 + 1e-9) + b4 * (x4 - m4) / (s4 + 1e-9)))) AS p FROM fr2 JOIN fit ON fit.k = fr2.fold)"""


@query("x05_logistic_fit", sql(FT, """,
one AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS w, CAST(goal AS DOUBLE) AS y, x1, x2, x3, x4 FROM ft)""" + newton_sql("one", 4, 3.0) + f"""
SELECT term, ROUND(beta, 6) AS beta, TRUE AS converged FROM ({_terms_sql(['intercept', *FEATS])})"""))
def x05(spark, sf):
    fits = G.fit_logistic(shot_features(spark, sf), FEATS, "goal", [], 3.0)
    return G.coefficients(fits, FEATS, []).withColumn("beta", F.round("beta", 6))


def predictions(spark, sf):
    d = shot_features(spark, sf).select("match_id", "poss_uid", "team", "coach", "season", "goal", *FEATS)
    f = E.folds(d.select(F.lit(1).alias("all"), "match_id").distinct(), 4, 5, ["all"], "match_id").drop("all")
    # geometry is worked out once a shot: the fit's moments and rows, and the predictions, read it back
    return G.out_of_fold(cut_lineage(d.join(f, "match_id")), FEATS, "goal", "fold", 4)


@query("x06_out_of_fold", sql(OOF, " SELECT CAST(fold AS BIGINT) AS fold, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(p), 6) AS mean_p, ROUND(AVG(goal), 6) AS rate FROM pr GROUP BY 1"))
def x06(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("goal"), 6).alias("rate"))


# a plain score for the twins of the rank statistics
SCORE_P = SHOTS + """,
sp AS MATERIALIZED (SELECT team, match_id, goal, ROUND(1 / (1 + EXP(SQRT(POW(120 - start_x, 2) + POW(40 - start_y, 2)) / 40)), 4) AS p FROM sh)"""


def scored(spark, sf):
    d = S.goal_distance(F.col("start_x"), F.col("start_y"))
    return shots(spark, sf).select("team", "coach", "season", "match_id", "goal", F.round(1 / (1 + F.exp(d / 40)), 4).alias("p"))


@query("x07_auc", sql(SCORE_P, """,
r AS (SELECT team, goal, RANK() OVER (PARTITION BY team ORDER BY p) + (COUNT(*) OVER (PARTITION BY team, p) - 1) / 2.0 AS rk FROM sp)
SELECT team, ROUND((SUM(CASE WHEN goal = 1 THEN rk ELSE 0 END) - SUM(goal) * (SUM(goal) + 1) / 2.0) / (SUM(goal) * SUM(1 - goal)), 6) AS auc, CAST(COUNT(*) AS BIGINT) AS n FROM r GROUP BY team"""))
def x07(spark, sf):
    return X.auc(scored(spark, sf), ["team"], "p", "goal", F.floor(F.col("p") * 64)).withColumn("auc", F.round("auc", 6))


@query("x08_murphy", sql(SCORE_P, """,
e AS (SELECT QUANTILE_CONT(p, [0.2, 0.4, 0.6, 0.8]) AS e FROM sp),
b AS (SELECT goal, p, CASE WHEN p >= e[4] THEN 4 WHEN p >= e[3] THEN 3 WHEN p >= e[2] THEN 2 WHEN p >= e[1] THEN 1 ELSE 0 END AS bin FROM sp, e),
c AS (SELECT bin, COUNT(*) AS n, AVG(p) AS pk, AVG(goal) AS ok, SUM((p - goal) * (p - goal)) AS sq FROM b GROUP BY 1), m AS (SELECT SUM(n * ok) / SUM(n) AS base FROM c)
SELECT ROUND(SUM(sq) / SUM(n), 6) AS brier, ROUND(MAX(base) * (1 - MAX(base)), 6) AS uncertainty, ROUND(SUM(n * POW(ok - base, 2)) / SUM(n), 6) AS resolution, ROUND(SUM(n * POW(pk - ok, 2)) / SUM(n), 6) AS reliability FROM c, m"""))
def x08(spark, sf):
    return rounded(X.murphy(scored(spark, sf), "p", "goal", 5), [], ["brier", "uncertainty", "resolution", "reliability"])


@query("x07_auc_difference_bootstrap", sql(OOF, """,
pq AS MATERIALIZED (SELECT 1 AS one, match_id, goal, ROUND(p, 4) AS model, ROUND(ROUND(1 / (1 + EXP(x1 / 40)), 4), 4) AS distance FROM pr)""" + weights_sql("pq", "one", "match_id", 8, 7) + """,
sc AS (SELECT 'model' AS kind, match_id, model AS s, goal FROM pq UNION ALL SELECT 'distance', match_id, distance, goal FROM pq),
rs AS (SELECT kind, b, sc.s, SUM(w * goal) AS y, SUM(w * (1 - goal)) AS no FROM sc JOIN wt ON wt.k = match_id GROUP BY 1, 2, 3),
cu AS (SELECT *, COALESCE(SUM(no) OVER (PARTITION BY kind, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM rs),
au AS (SELECT kind, b, SUM(y * (below + no / 2.0)) / (SUM(y) * SUM(no)) AS auc FROM cu GROUP BY 1, 2),
df2 AS (SELECT b, MAX(CASE WHEN kind = 'model' THEN auc END) - MAX(CASE WHEN kind = 'distance' THEN auc END) AS d FROM au GROUP BY 1),
pt AS (SELECT MAX(CASE WHEN b = 0 THEN d END) AS t FROM df2),
ag AS (SELECT t, COUNT(d) FILTER (b > 0) AS n, quantile_cont(d, 0.025) FILTER (b > 0) AS ql, quantile_cont(d, 0.975) FILTER (b > 0) AS qh, stddev_samp(d) FILTER (b > 0) AS se, COUNT(*) FILTER (b > 0 AND CASE WHEN t >= 0 THEN d - t >= t ELSE d - t <= t END) AS c FROM df2, pt GROUP BY t)
SELECT 'all' AS k, ROUND(t, 6) AS point, ROUND(2 * t - qh, 6) AS lo, ROUND(2 * t - ql, 6) AS hi, ROUND(se, 6) AS se, ROUND(LEAST(1, 2.0 * (1 + c) / (n + 1)), 6) AS p, CAST(n AS BIGINT) AS replicates FROM ag"""))
def x07b(spark, sf):
    """AUC of the distance score minus AUC of the model, matches redrawn."""
    p = cut_lineage(predictions(spark, sf).select("match_id", "goal", "goal_distance", "p")).withColumn("q", F.round(1 / (1 + F.exp(F.col("goal_distance") / 40)), 4))
    w = R.multinomial_weights(p.select(F.lit(1).alias("all"), "match_id"), ["all"], "match_id", 8, 7).drop("all")
    out = None
    for name, col in (("model", "p"), ("distance", "q")):
        # weighted ranks: counts per distinct score and class, cumulated per replicate
        cell = p.withColumn("s", F.round(col, 4)).groupBy("match_id", "s").agg(
            F.sum("goal").cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
        c = R.replicate_sums(cell, w, ["match_id"], ["s"], ["y", "n"])
        from chainspark.functions.scan import Running, running
        c = running(c, ["b"], ["s"], [Running("below", "sum", F.col("n") - F.col("y"))], F.floor(F.col("s") * 32))
        a = c.groupBy("b").agg((F.sum(F.col("y") * (F.col("below") + (F.col("n") - F.col("y")) / 2))
                                / F.nullif(F.sum("y") * F.sum(F.col("n") - F.col("y")), F.lit(0.0))).alias(name))
        out = a if out is None else out.join(a, "b")
    i = R.interval(out.select(F.lit("all").alias("k"), "b", (F.col("model") - F.col("distance")).alias("d")), ["k"], "d")
    return i.select("k", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi", "se", "p")], "replicates")


@query("x09_shot_quality_by_era", sql(SCORE_P.replace("SELECT team, match_id, goal, ROUND", "SELECT team, coach, match_id, goal, ROUND"), """,
m AS (SELECT team, coach, match_id, SUM(goal) AS g, SUM(p) AS x, COUNT(*) AS n FROM sp GROUP BY 1, 2, 3)""" + weights_sql("m", "coach", "match_id", 20, 3) + """,
r AS (SELECT team, coach, b, SUM(w * (g - x)) / SUM(w * n) AS d FROM m JOIN wt ON wt.s = coach AND wt.k = match_id GROUP BY 1, 2, 3),
t AS (SELECT team, coach, MAX(CASE WHEN b = 0 THEN d END) AS point, QUANTILE_CONT(d, 0.025) FILTER (WHERE b > 0) AS ql, QUANTILE_CONT(d, 0.975) FILTER (WHERE b > 0) AS qh FROM r GROUP BY 1, 2)
SELECT team, coach, ROUND(point + 1e-8, 6) AS point, ROUND(2 * point - qh + 1e-8, 6) AS lo, ROUND(2 * point - ql + 1e-8, 6) AS hi FROM t"""))
def x09(spark, sf):
    m = scored(spark, sf).groupBy("team", "coach", "match_id").agg(
        F.sum("goal").alias("g"), F.sum("p").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    w = R.multinomial_weights(m, ["coach"], "match_id", 20, 3)
    r = R.replicate_sums(m, w, ["coach", "match_id"], ["team", "coach"], ["g", "x", "n"])
    r = r.withColumn("d", (F.col("g") - F.col("x")) / F.col("n"))
    i = R.interval(r, ["team", "coach"], "d")
    return i.select("team", "coach", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("point", "lo", "hi")])


@query("x09_shot_quality_pairs", sql(SCORE_P.replace("SELECT team, match_id, goal, ROUND", "SELECT team, coach, match_id, goal, ROUND"), """,
m AS (SELECT team, coach, match_id, SUM(goal) AS g, SUM(p) AS x, COUNT(*) AS n FROM sp GROUP BY 1, 2, 3)""" + weights_sql("m", "coach", "match_id", 20, 3) + """,
r AS MATERIALIZED (SELECT team, coach, b, SUM(w * (g - x)) / SUM(w * n) AS d FROM m JOIN wt ON wt.s = coach AND wt.k = match_id GROUP BY 1, 2, 3),
pr AS (SELECT x.team, x.coach AS a, y.coach AS c, x.b, x.d - y.d AS v FROM r x JOIN r y ON y.team = x.team AND y.b = x.b AND x.coach < y.coach),
pt AS (SELECT team, a, c, v AS t FROM pr WHERE b = 0),
ag AS MATERIALIZED (SELECT pr.team, pr.a, pr.c, t, quantile_cont(v, 0.025) AS ql, quantile_cont(v, 0.975) AS qh, LEAST(1.0::DOUBLE, 2.0::DOUBLE * (1 + COUNT(*) FILTER (CASE WHEN t >= 0 THEN v - t >= t ELSE v - t <= t END)) / (COUNT(v) + 1)) AS p FROM pr JOIN pt ON pt.team = pr.team AND pt.a = pr.a AND pt.c = pr.c WHERE b > 0 GROUP BY 1, 2, 3, 4),
vs AS (SELECT team, p, COUNT(*) AS c FROM ag GROUP BY 1, 2),
rk2 AS (SELECT *, SUM(c) OVER (PARTITION BY team ORDER BY p) AS k, SUM(c) OVER (PARTITION BY team) AS m FROM vs),
qs AS (SELECT team, p, LEAST(1, MIN(p * m / k) OVER (PARTITION BY team ORDER BY p DESC)) AS q FROM rk2)
SELECT ag.team, a, c, ROUND(t + 1e-8, 6) AS point, ROUND(2 * t - qh + 1e-8, 6) AS lo, ROUND(2 * t - ql + 1e-8, 6) AS hi, ROUND(ag.p, 6) AS p, ROUND(q, 6) AS q, q <= 0.05 AS rejected FROM ag JOIN qs ON qs.team = ag.team AND qs.p = ag.p"""))
def x09b(spark, sf):
    """Goals above expectation of every pair of a team's eras, matches redrawn, with FDR inside the team."""
    m = scored(spark, sf).groupBy("team", "coach", "match_id").agg(
        F.sum("goal").alias("g"), F.sum("p").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    w = R.multinomial_weights(m, ["coach"], "match_id", 20, 3)
    r = R.replicate_sums(m, w, ["coach", "match_id"], ["team", "coach"], ["g", "x", "n"])
    r = r.select("team", "b", "coach", ((F.col("g") - F.col("x")) / F.col("n")).alias("d"))
    other = r.select("team", "b", F.col("coach").alias("c"), F.col("d").alias("e"))
    pairs = r.withColumnRenamed("coach", "a").join(other, ["team", "b"]).filter("a < c").withColumn("d", F.col("d") - F.col("e"))
    i = R.fdr(R.interval(pairs, ["team", "a", "c"], "d"), ["team"])
    return i.select("team", "a", "c", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("point", "lo", "hi")],
                    F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "rejected")


# -- set pieces -----------------------------------------------------------------------------------------
def set_piece_possessions(spark, sf):
    m = moves(spark, sf)
    d = m.groupBy("match_id", "possession", "team", "coach", "season", "phase").agg(
        F.min_by("start_x", "event_index").alias("x"), F.min_by("start_y", "event_index").alias("y"),
        F.sum((F.col("action_type") == "Shot").cast("bigint")).alias("shots"), F.sum((F.col("outcome") == "GOAL").cast("bigint")).alias("goals"))
    taker = F.when(F.col("phase").isin("set_piece", "restart") & (F.col("possession") % 3 == 0),
                   F.struct(F.when(F.col("phase") == "set_piece", "Corner").otherwise("Throw").alias("pass_type"), F.col("x").alias("x")))
    pattern = F.when((F.col("phase") == "set_piece") | (F.col("possession") % 2 == 0), "From Corner").otherwise("Regular")
    return d.withColumns({"taker": taker, "pattern": pattern, "period": (F.col("possession") % 1000 < 900).cast("int") + 1})


SETP = FA + """,
p0 AS (SELECT match_id, possession, team, coach, season, phase, MIN_BY(start_x, event_index) AS x, SUM(CASE WHEN action_type = 'Shot' THEN 1 ELSE 0 END) AS shots, SUM(CASE WHEN outcome = 'GOAL' THEN 1 ELSE 0 END) AS goals FROM actions GROUP BY ALL),
p1 AS (SELECT *, CASE WHEN phase IN ('set_piece', 'restart') AND possession % 3 = 0 THEN CASE WHEN phase = 'set_piece' THEN 'Corner' ELSE 'Throw' END END AS taker, CASE WHEN phase = 'set_piece' OR possession % 2 = 0 THEN 'From Corner' ELSE 'Regular' END AS pattern, CASE WHEN possession % 1000 < 900 THEN 2 ELSE 1 END AS period FROM p0),
p2 AS (SELECT *, MAX(CASE WHEN taker IS NOT NULL THEN possession END) OVER (PARTITION BY match_id ORDER BY possession) AS sequence FROM p1),
p3 AS (SELECT p2.*, s.period AS sp, s.team AS st, s.taker AS sk, s.x AS sx FROM p2 JOIN p1 s ON s.match_id = p2.match_id AND s.possession = p2.sequence WHERE s.taker = 'Corner' AND s.x >= 20),
p4 AS (SELECT *, MAX(CASE WHEN possession <> sequence AND (period <> sp OR pattern <> 'From Corner') THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, sequence ORDER BY possession) AS broken FROM p3),
sq AS MATERIALIZED (SELECT match_id, sequence, MIN(st) AS attacker, CAST(MIN(sp) AS INTEGER) AS period, CAST(COUNT(*) AS BIGINT) AS possessions, CAST(MAX(CASE WHEN team = st AND shots > 0 THEN 1 ELSE 0 END) AS INTEGER) AS S, CAST(MAX(CASE WHEN team = st AND goals > 0 THEN 1 ELSE 0 END) AS INTEGER) AS G FROM p4 WHERE broken = 0 GROUP BY 1, 2)"""


def corner_sequences(spark, sf):
    return X.sequences(set_piece_possessions(spark, sf), "Corner", "From Corner", 20.0, F.floor(F.col("possession") / 65536))


@query("x10_set_piece_sequences", sql(SETP, ' SELECT match_id, sequence, attacker, period, possessions, S AS "S", G AS "G" FROM sq'))
def x10(spark, sf):
    return corner_sequences(spark, sf)


# seconds of an action inside its possession: three per action and some of the player's own
CLOCK = "(event_index * 3 + player_id % 3)"


def clock():
    return F.col("event_index") * 3 + F.col("player_id") % 3


@query("x11_quick_shot_flags", sql(FA, f""",
c AS (SELECT poss_uid, MIN(CASE WHEN action_type = 'Shot' THEN {CLOCK} END) - MIN({CLOCK}) AS gap, MIN(phase) AS phase FROM actions GROUP BY 1)
SELECT phase, ROUND(AVG(CASE WHEN gap IS NOT NULL AND gap <= 10 THEN 1.0 ELSE 0.0 END), 6) AS quick, ROUND(AVG(CASE WHEN gap IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS any_shot FROM c GROUP BY phase"""))
def x11(spark, sf):
    """Possessions with a shot within ten seconds of their first action."""
    shot = F.min(F.when(F.col("action_type") == "Shot", clock()))
    c = moves(spark, sf).groupBy("poss_uid").agg((shot - F.min(clock())).alias("gap"), F.min("phase").alias("phase"))
    quick = F.coalesce(F.col("gap") <= 10, F.lit(False)).cast("double")
    return c.groupBy("phase").agg(F.round(F.avg(quick), 6).alias("quick"),
                                  F.round(F.avg(F.col("gap").isNotNull().cast("double")), 6).alias("any_shot"))


@query("x12_set_piece_rates", sql(SETP, """,
ms AS (SELECT match_id, MIN(season) AS season FROM actions GROUP BY 1),
u AS (SELECT attacker AS team, season, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(S) AS DOUBLE) AS s FROM sq JOIN ms ON ms.match_id = sq.match_id GROUP BY 1, 2),
j AS (SELECT *, SUM(n) OVER (PARTITION BY season) - n AS nb, SUM(s) OVER (PARTITION BY season) - s AS sb FROM u)
SELECT team, ROUND(SUM(s) / SUM(n), 6) AS unit, CASE WHEN MAX(CASE WHEN nb <= 0 THEN 1 ELSE 0 END) = 0 THEN ROUND(SUM(n * sb / nb) / SUM(n), 6) END AS base, CASE WHEN MAX(CASE WHEN nb <= 0 THEN 1 ELSE 0 END) = 0 THEN ROUND(SUM(s) / SUM(n) - SUM(n * sb / nb) / SUM(n), 6) END AS did FROM j GROUP BY team"""))
def x12(spark, sf):
    season = moves(spark, sf).groupBy("match_id").agg(F.min("season").alias("season"))
    u = corner_sequences(spark, sf).join(season, "match_id").groupBy(F.col("attacker").alias("team"), "season").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("S").cast("double")).alias("s"))
    d = D.standardised_rate(D.against_league(u, "team", "season", "n", "s", ["team"]), ["team"])
    return rounded(d, ["team"], ["unit", "base", "did"])


@query("x12_delivery_profile", sql(SETP, """,
d AS (SELECT p1.team, CASE WHEN end_y BETWEEN 36 AND 44 THEN 'central' WHEN (start_y < 40) = (end_y < 40) THEN 'near' ELSE 'far' END AS zone, p1.shots FROM p1 JOIN (SELECT possession, match_id, start_y, LEAD(start_y, 1, start_y) OVER (PARTITION BY poss_uid ORDER BY event_index) AS end_y, event_index FROM actions) a ON a.match_id = p1.match_id AND a.possession = p1.possession AND a.event_index = 1 WHERE p1.taker = 'Corner')
SELECT team, zone, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(CASE WHEN shots > 0 THEN 1.0 ELSE 0.0 END), 6) AS shot_rate FROM d GROUP BY 1, 2"""))
def x12b(spark, sf):
    p = set_piece_possessions(spark, sf).filter(F.col("taker.pass_type") == "Corner").select("match_id", "possession", "team", "shots")
    first = moves(spark, sf).filter("event_index = 1").select("match_id", "possession", S.delivery_zone(F.col("start_y"), F.col("end_y")).alias("zone"))
    return p.join(first, ["match_id", "possession"]).groupBy("team", "zone").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("shots") > 0).cast("double")), 6).alias("shot_rate"))


@query("x13_max_state_value", rsql(VALUES, f""",
st AS (SELECT poss_uid, MIN({CLOCK}) AS t0 FROM tr WHERE phase = 'set_piece' AND action_type <> 'TERMINAL' GROUP BY 1)
SELECT st.poss_uid, ROUND(MAX(bg), 6) AS best FROM st JOIN tr ON tr.poss_uid = st.poss_uid AND {CLOCK} BETWEEN t0 AND t0 + 10 AND action_type <> 'TERMINAL' JOIN vals v ON v.team = tr.team AND v.i = tr.from_state GROUP BY 1"""))
def x13(spark, sf):
    """Best state that a set piece reaches in its first ten seconds, however many actions these are."""
    v = C.state_values(matrix(spark, sf), ["team"], SPACE).select("team", F.col("state").alias("from_state"), "p_goal")
    d = transitions(spark, sf).filter("phase = 'set_piece' AND action_type <> 'TERMINAL'").withColumn("second", clock())
    starts = d.groupBy("poss_uid").agg(F.min("second").alias("t")).withColumn("start_id", F.col("poss_uid"))
    points = d.join(v, ["team", "from_state"]).select("poss_uid", "second", "p_goal")
    best = Q.max_within(points, starts, ["poss_uid"], "second", "p_goal", 10.0)
    return best.select("poss_uid", F.round("best", 6).alias("best"))


CROSSED = [("goal_distance", "visible")]


@query("x14_coefficient_bootstrap", sql(FT, f""",
bw AS MATERIALIZED (SELECT match_id, b, CASE WHEN b = 0 THEN 1 ELSE (SELECT COUNT(*) FROM (SELECT UNNEST({poisson1_steps()}) AS c) WHERE (CAST({draw_sql("'13'", "b", "match_id")} AS DOUBLE) + 0.5) / {float(SPAN)!r} > c) END AS w
  FROM (SELECT DISTINCT match_id FROM ft), (SELECT UNNEST(range(0, 1001)) AS b)),
wr AS MATERIALIZED (SELECT b AS k, CAST(w AS DOUBLE) AS w, CAST(goal AS DOUBLE) AS y, x1, x2, x3, x4, x1 * x3 AS x5 FROM ft JOIN bw ON bw.match_id = ft.match_id)""" + newton_sql("wr", 5, 3.0) + f""",
te AS (SELECT k AS b, term, beta FROM ({_terms_sql(['intercept', *FEATS, 'goal_distance x visible'])})),
pt AS (SELECT term, beta AS t FROM te WHERE b = 0),
ag AS (SELECT te.term, t, COUNT(*) FILTER (b > 0) AS n, quantile_cont(beta, 0.025) FILTER (b > 0) AS ql, quantile_cont(beta, 0.975) FILTER (b > 0) AS qh, stddev_samp(beta) FILTER (b > 0) AS se, COUNT(*) FILTER (b > 0 AND CASE WHEN t >= 0 THEN beta - t >= t ELSE beta - t <= t END) AS c FROM te JOIN pt ON pt.term = te.term GROUP BY 1, 2)
SELECT term, ROUND(t, 6) AS point, ROUND(2 * t - qh, 6) AS lo, ROUND(2 * t - ql, 6) AS hi, ROUND(se, 6) AS se, ROUND(LEAST(1, 2.0 * (1 + c) / (n + 1)), 6) AS p, CAST(n AS BIGINT) AS replicates FROM ag"""))
def x14(spark, sf):
    """A step of all replicates' fits reads the shots once; a match's weights are drawn in the task."""
    # geometry is worked out once a shot, not at every step of the fit
    fits = G.fit_replicates(shot_features(spark, sf).select("match_id", "goal", *FEATS), FEATS, "goal", "match_id", 1000, 13, 3.0, CROSSED)
    i = R.interval(G.coefficients(fits.filter("converged"), FEATS, ["b"], CROSSED), ["term"], "beta")
    return i.select("term", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi", "se", "p")], "replicates")


@query("x15_last_action_zone", sql(TR, """,
z AS (SELECT team, to_state AS outcome, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone, CAST(COUNT(*) AS BIGINT) AS n FROM tr WHERE is_absorbing GROUP BY 1, 2, 3)
SELECT team, CAST(outcome AS BIGINT) AS outcome, zone, n, ROUND(n / SUM(n) OVER (PARTITION BY team, outcome), 6) AS share FROM z"""))
def x15(spark, sf):
    return X.last_action_zones(transitions(spark, sf), SPACE, ["team"]).withColumn("share", F.round("share", 6))


@query("x15_route_lift", sql(TR, """,
e AS (SELECT team, poss_uid, MAX(to_state) AS outcome FROM tr WHERE is_absorbing GROUP BY 1, 2), v AS (SELECT DISTINCT team, poss_uid, CAST(FLOOR(from_state / 4) AS BIGINT) AS zone FROM tr),
an AS (SELECT team, COUNT(*) AS n FROM e GROUP BY 1), onn AS (SELECT team, outcome, COUNT(*) AS n FROM e GROUP BY 1, 2), zn AS (SELECT team, zone, COUNT(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT v.team, zone, outcome, COUNT(*) AS support FROM v JOIN e ON e.team = v.team AND e.poss_uid = v.poss_uid GROUP BY 1, 2, 3)
SELECT s.team, CAST(s.outcome AS BIGINT) AS outcome, s.zone, CAST(support AS BIGINT) AS support, ROUND(support / onn.n, 6) AS route, CASE WHEN support >= 10 THEN ROUND((support / onn.n) / (zn.n / an.n), 6) END AS lift
FROM s JOIN onn ON onn.team = s.team AND onn.outcome = s.outcome JOIN zn ON zn.team = s.team AND zn.zone = s.zone JOIN an ON an.team = s.team WHERE onn.n >= 25"""))
def x15b(spark, sf):
    return X.route_lift(transitions(spark, sf), SPACE, ["team"]).withColumns({"route": F.round("route", 6), "lift": F.round("lift", 6)})
