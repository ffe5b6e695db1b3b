"""Sources and sinks (S), scalar functions (F), eras and data quality (R)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspark.functions import scalars as S
from chainspark.functions.scan import exact_quantile
from chainspark.operators import eras as R
from chainspark.operators import quality as K
from chainspark.operators import resample as B
from chainspark.operators import shots as X
from chainspark.plans.chain_queries import EV, raw_events
from chainspark.plans.inference_queries import PAIR_REPS, pair_reps
from chainspark.plans.registry import query
from chainspark.plans.relation_queries import ERAS
from chainspark.plans.tables import FA, MOVES, SPACE, TR, _BUILT, era_table, load, moves, sql, transitions
from chainspark.session import cut_lineage, is_written, scratch_dir, shared_dir
from chainspark.sources import adapters as A
from chainspark.sources import events as E


def copy_of_events(spark, sf, fmt):
    """Write the derived event log once in a text format and return its folder."""
    key = (spark.sparkContext.applicationId, sf, f"copy-{fmt}")
    if key not in _BUILT or not is_written(spark, _BUILT[key]):
        path = f"{shared_dir(spark)}/chainspark-{key[0]}/{abs(hash(sf))}/events-{fmt}"
        e = raw_events(spark, sf)
        if fmt == "csv":
            text = lambda c: F.when(F.col(c).isNotNull(), F.to_json(c))
            e = e.withColumns({c: text(c) for c in ("location", "pass_end_location", "carry_end_location")})
            e = e.withColumn("pass_outcome", F.coalesce("pass_outcome", F.lit("N/A")))
            e.write.mode("overwrite").option("header", True).csv(path)
        else:
            e.write.mode("overwrite").json(path)
        _BUILT[key] = path
    return _BUILT[key]


SUMMARY = """
SELECT type, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN outcome IN ('LOSS', 'OUT') THEN 1 ELSE 0 END) AS BIGINT) AS with_outcome, CAST(SUM(CASE WHEN under_pressure THEN 1 ELSE 0 END) AS BIGINT) AS pressed, ROUND(SUM(start_x), 3) AS sx, ROUND(SUM(CASE WHEN type = 'Pass' THEN end_x END), 3) AS px FROM ev GROUP BY type"""


def summary(df):
    return df.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count("pass_outcome").alias("with_outcome"), F.sum(F.col("under_pressure").cast("bigint")).alias("pressed"),
        F.round(F.sum("start_x"), 3).alias("sx"), F.round(F.sum(F.when(F.col("type") == "Pass", F.col("pass_end_x"))), 3).alias("px")).na.fill(0, ["pressed"])


@query("s01_scan_json", sql(EV, SUMMARY))
def s01(spark, sf):
    path = copy_of_events(spark, sf, "json")
    return summary(E.normalise(spark.read.schema(E.EVENT_SCHEMA).json(path)))


@query("s02_scan_csv", sql(EV, SUMMARY))
def s02(spark, sf):
    return summary(E.normalise(E.scan_events(spark, copy_of_events(spark, sf, "csv"))))


@query("s03_required_columns", sql(EV, " SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT match_id) AS BIGINT) AS matches FROM ev"))
def s03(spark, sf):
    e = E.require_columns(raw_events(spark, sf), E.REQUIRED)
    return e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("matches"))


@query("s04_normalise_events", sql(EV, SUMMARY))
def s04(spark, sf):
    return summary(E.normalise(raw_events(spark, sf)))


@query("s05_to_parquet_partitioned", sql(EV, " SELECT type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(start_x), 3) AS sx FROM ev GROUP BY type"))
def s05(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "events-by-type")
    if key not in _BUILT or not is_written(spark, _BUILT[key]):
        path = f"{shared_dir(spark)}/chainspark-{key[0]}/{abs(hash(sf))}/events-by-type"
        E.to_parquet(E.normalise(raw_events(spark, sf)), path, "type")
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key]).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("start_x"), 3).alias("sx"))


def nested_events(spark, sf):
    """The log in the nested form of a feed: {id, name} structs and a pass struct."""
    m = moves(spark, sf)
    def named(i, n):
        return F.struct(i.cast("bigint").alias("id"), n.cast("string").alias("name"))
    is_pass = F.col("action_type") == "Pass"
    recipient = F.when(F.col("next_player").isNotNull(), named(F.col("next_player"), F.col("next_player")))
    outcome = F.when(F.col("outcome") == "LOSS", named(F.lit(9), F.lit("Incomplete")))
    return m.select("match_id", named(F.col("event_index"), F.col("action_type")).alias("type"),
                    named(F.col("match_id") % 6, F.col("team")).alias("team"), named(F.col("player_id"), F.col("player_id")).alias("player"),
                    F.when(is_pass, F.struct(recipient.alias("recipient"), outcome.alias("outcome"), F.array("end_x", "end_y").alias("end_location"))).alias("pass"),
                    F.array(F.struct(F.col("start_x").alias("x"), F.col("start_y").alias("y"))).alias("trace"))


@query("s06_flatten_nested", sql(MOVES, """
SELECT action_type AS type, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(player_id) AS BIGINT) AS players, CAST(COUNT(CASE WHEN action_type = 'Pass' THEN next_player END) AS BIGINT) AS recipients, CAST(COUNT(*) AS BIGINT) AS traces FROM moves GROUP BY 1"""))
def s06(spark, sf):
    d = A.flatten(nested_events(spark, sf))
    return d.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("player_id").alias("players"),
                                 F.count("pass_recipient_id").alias("recipients"), F.count("trace").alias("traces"))


def index_of_matches(spark, sf):
    m = moves(spark, sf).groupBy("match_id").agg(F.min("team").alias("a"), F.max("team").alias("b"), F.min("match_date").alias("match_date"))
    stage = F.when(F.col("match_id") % 10 == 0, "Apertura - Semi-finals").otherwise("Regular Season")
    return m.select("match_id", "match_date", F.col("a").alias("home"), F.col("b").alias("away"), stage.alias("stage"), S.season_label(F.col("match_date")).alias("season"))


@query("s07_scope_filter", sql(FA, """,
ix AS (SELECT match_id, MIN(team) AS a, MAX(team) AS b, CASE WHEN month(MIN(match_date)) >= 7 THEN CONCAT('A', year(MIN(match_date))) ELSE CONCAT('C', year(MIN(match_date))) END AS season FROM actions GROUP BY 1)
SELECT match_id, CAST(COUNT(*) AS BIGINT) AS n FROM actions WHERE match_id IN (SELECT match_id FROM ix WHERE season IN ('A1996', 'C1997') AND match_id % 10 <> 0 AND (a IN ('T1', 'T2') OR b IN ('T1', 'T2'))) GROUP BY 1"""))
def s07(spark, sf):
    d = A.in_scope(moves(spark, sf), index_of_matches(spark, sf), ["A1996", "C1997"], ["regular"], ["T1", "T2"])
    return d.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


@query("s07_scope_parts", sql(FA, """,
ix AS (SELECT match_id, MIN(team) AS a, MAX(team) AS b, CASE WHEN month(MIN(match_date)) >= 7 THEN CONCAT('A', year(MIN(match_date))) ELSE CONCAT('C', year(MIN(match_date))) END AS season FROM actions GROUP BY 1)
SELECT ix.season, actions.match_id, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(event_index) AS BIGINT) AS places, ROUND(SUM(start_x), 4) AS x FROM actions JOIN ix ON ix.match_id = actions.match_id
WHERE ix.season IN ('A1996', 'C1997') AND (a IN ('T1', 'T2') OR b IN ('T1', 'T2')) GROUP BY 1, 2"""))
def s07b(spark, sf):
    """Parts of three seasons written, one of them again, and a scope of two read back."""
    m, index = moves(spark, sf), index_of_matches(spark, sf)
    path = f"{scratch_dir(spark)}/scope-{uuid.uuid4().hex}"
    A.write_scope(m, A.scope_of(index, ["A1996", "C1997", "A1997"]), path, "possession")
    A.write_scope(m, A.scope_of(index, ["C1997"]), path, "possession")
    d = A.read_scope(A.scope_of(index, ["A1996", "C1997"], clubs=["T1", "T2"]), path)
    return d.groupBy("season", "match_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_index").alias("places"), F.round(F.sum("start_x"), 4).alias("x"))


@query("s08_unify_parts", sql(FA, """
SELECT team, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(a) AS BIGINT) AS with_a, ROUND(SUM(v), 4) AS v FROM (SELECT team, event_index AS a, CAST(player_id AS DOUBLE) AS v FROM actions WHERE match_id % 2 = 0 UNION ALL SELECT team, NULL, start_x FROM actions WHERE match_id % 2 = 1) GROUP BY team"""))
def s08(spark, sf):
    m = moves(spark, sf)
    one = m.filter("match_id % 2 = 0").select("team", F.col("event_index").alias("a"), F.col("player_id").cast("int").alias("v"), F.lit(None).alias("x"))
    two = m.filter("match_id % 2 = 1").select("team", F.col("start_x").alias("v"))
    d = E.unify_parts([one, two], ["team", "v"])
    return d.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("with_a"), F.round(F.sum("v"), 4).alias("v"))


@query("s09_club_subsets", sql(FA, """,
sd AS (SELECT match_id, MIN(team) AS club FROM actions GROUP BY 1 UNION SELECT match_id, MAX(team) FROM actions GROUP BY 1)
SELECT club, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT a.match_id) AS BIGINT) AS matches FROM actions a JOIN sd ON sd.match_id = a.match_id GROUP BY club"""))
def s09(spark, sf):
    d = A.club_subsets(moves(spark, sf), index_of_matches(spark, sf))
    return d.groupBy("club").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("matches"))


def metadata(spark, sf):
    """Match metadata in the nested form of a feed, with an interim manager on some days."""
    m = moves(spark, sf).groupBy("match_id").agg(F.min("team").alias("a"), F.max("team").alias("b"), F.min("match_date").alias("match_date"))
    interim = F.col("match_id") % 13 == 0
    def side(t):
        k = F.floor((F.year("match_date") - 1995) / 2).cast("string")
        boss = F.when(interim, F.concat(F.lit("I"), t)).otherwise(F.concat(F.lit("K"), t, F.lit("_"), k))
        two = F.struct(F.lit("Aide").alias("name"))
        lst = F.when(F.col("match_id") % 17 == 0, F.array(F.struct(boss.alias("name")), two)).otherwise(F.array(F.struct(boss.alias("name"))))
        return F.struct(t.alias("name"), lst.alias("managers"))
    stage = F.when(F.col("match_id") % 10 == 0, "Apertura - Semi-finals").otherwise("Regular Season")
    return m.filter("a <> b").select("match_id", F.col("match_date").cast("string").alias("match_date"), side(F.col("a")).alias("home_team"), side(F.col("b")).alias("away_team"),
                    F.struct(stage.alias("name")).alias("competition_stage"), F.struct(F.year("match_date").cast("string").alias("name")).alias("season"))


META = FA + """,
ix AS (SELECT match_id, MIN(team) AS a, MAX(team) AS b, MIN(match_date) AS d FROM actions GROUP BY 1 HAVING MIN(team) <> MAX(team)),
mg AS MATERIALIZED (SELECT match_id, d AS match_date, t AS club, CASE WHEN match_id % 13 = 0 THEN CONCAT('I', t) ELSE CONCAT('K', t, '_', CAST(CAST(FLOOR((year(d) - 1995) / 2) AS BIGINT) AS VARCHAR)) END AS coach, CASE WHEN match_id % 17 = 0 THEN 2 ELSE 1 END AS n_managers FROM (SELECT match_id, d, a AS t FROM ix UNION ALL SELECT match_id, d, b FROM ix))"""


@query("s10_match_index", sql(META, " SELECT match_id, d AS match_date, a AS home, b AS away, CASE WHEN match_id % 10 = 0 THEN 'Apertura - Semi-finals' ELSE 'Regular Season' END AS stage, CAST(year(d) AS VARCHAR) AS season FROM ix"))
def s10(spark, sf):
    return A.match_index(metadata(spark, sf))


@query("s10_match_managers", sql(META, " SELECT match_id, match_date, club, coach, CAST(n_managers AS INTEGER) AS n_managers FROM mg"))
def s10b(spark, sf):
    return A.match_managers(metadata(spark, sf))


@query("s11_pass_edges", sql(MOVES, """
SELECT team, coach, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN outcome <> 'LOSS' THEN 1 ELSE 0 END) AS BIGINT) AS completed FROM moves WHERE action_type = 'Pass' AND next_player IS NOT NULL GROUP BY 1, 2"""))
def s11(spark, sf):
    coaches = moves(spark, sf).groupBy("match_id", F.col("team").alias("club")).agg(F.min("coach").alias("coach"))
    e = A.pass_edges(nested_events(spark, sf), coaches)
    return e.groupBy("team", "coach").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("completed").cast("bigint")).alias("completed"))


@query("s12_line_up_spells", sql(FA, """
SELECT team, CAST(COUNT(*) AS BIGINT) AS spells, CAST(SUM(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS starts FROM (SELECT DISTINCT match_id, team, player_id, UNNEST([1, 2]) AS k FROM actions) GROUP BY team"""))
def s12(spark, sf):
    m = moves(spark, sf).select("match_id", "team", "player_id").distinct()
    pos = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(k).alias("from_period")) for p, k in (("Back", 1), ("Wing", 2))])
    raw = m.groupBy("match_id", "team").agg(F.collect_list(F.struct("player_id", pos.alias("positions"))).alias("lineup"))
    return A.line_up_spells(raw).groupBy("team").agg(F.count(F.lit(1)).alias("spells"), F.sum((F.col("from_period") == 1).cast("bigint")).alias("starts"))


@query("s13_result_sinks", sql(FA, " SELECT team, CAST(3 * COUNT(*) AS BIGINT) AS n FROM actions GROUP BY team"))
def s13(spark, sf):
    d = moves(spark, sf).groupBy("team").agg(F.count(F.lit(1)).alias("n"))
    root = f"{shared_dir(spark)}/chainspark-{spark.sparkContext.applicationId}/{abs(hash(sf))}/sink"
    out = None
    for fmt in ("parquet", "json", "csv"):
        A.write_results(d, f"{root}-{fmt}", fmt, 1)
        r = spark.read.schema("team string, n bigint").option("header", True).format(fmt).load(f"{root}-{fmt}")
        out = r if out is None else out.unionByName(r)
    return out.groupBy("team").agg(F.sum("n").alias("n"))


@query("s14_provenance", sql(FA, " SELECT team, CAST(COUNT(*) AS BIGINT) AS n, 'b1a46a4d2bd4c6d1' AS config_hash, '1' AS version FROM actions GROUP BY team".replace(
    "b1a46a4d2bd4c6d1", __import__("hashlib").sha256(b'{"nx": 5, "ny": 4}').hexdigest()[:16])))
def s14(spark, sf):
    d = moves(spark, sf).groupBy("team").agg(F.count(F.lit(1)).alias("n"))
    return A.with_provenance(d, {"nx": 5, "ny": 4}, "1")


# -- scalar functions --------------------------------------------------------------------------------------
@query("f01_parse_location", sql(FA, " SELECT match_id, ROUND(SUM(start_x), 4) AS sx, ROUND(SUM(start_y), 4) AS sy, CAST(COUNT(*) AS BIGINT) AS n FROM actions GROUP BY match_id"))
def f01(spark, sf):
    d = moves(spark, sf).withColumn("loc", F.concat(F.lit("["), F.col("start_x").cast("string"), F.lit(", "), F.col("start_y").cast("string"), F.lit(", 1.5]")))
    x, y = S.location_xy(F.col("loc"), T.StringType())
    return d.groupBy("match_id").agg(F.round(F.sum(x), 4).alias("sx"), F.round(F.sum(y), 4).alias("sy"), F.count(x).alias("n"))


@query("f02_zone_centroid", sql(FA, """,
z AS (SELECT CAST(FLOOR(LEAST(GREATEST(start_x * 1.1 - 5, 0), 119.999999999) / 120 * 5) * 4 + FLOOR(LEAST(GREATEST(start_y, 0), 79.999999999) / 80 * 4) AS BIGINT) AS zone FROM actions)
SELECT zone, CAST(COUNT(*) AS BIGINT) AS n, ROUND((FLOOR(zone / 4) + 0.5) * 120 / 5, 6) AS cx, ROUND((zone % 4 + 0.5) * 80 / 4, 6) AS cy FROM z GROUP BY zone"""))
def f02(spark, sf):
    d = moves(spark, sf).groupBy(SPACE.zone(F.col("start_x") * 1.1 - 5, F.col("start_y")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    cx, cy = SPACE.centroid(F.col("zone"))
    return d.select("zone", "n", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@query("f03_mirror_state", sql(TR, """
SELECT from_state, CAST(((4 - FLOOR(FLOOR(from_state / 4) / 4)) * 4 + 3 - FLOOR(from_state / 4) % 4) * 4 + from_state % 4 AS BIGINT) AS mirrored, CAST(COUNT(*) AS BIGINT) AS n FROM tr GROUP BY 1, 2"""))
def f03(spark, sf):
    return transitions(spark, sf).groupBy("from_state", SPACE.mirror_state(F.col("from_state")).alias("mirrored")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_state_labels", sql(TR, """
SELECT to_state AS state, CASE WHEN to_state < 80 THEN CONCAT('z', CAST(FLOOR(to_state / 16) AS BIGINT), CAST(FLOOR(to_state / 4) AS BIGINT) % 4, '|', ['open', 'transition', 'restart', 'set_piece'][CAST(to_state % 4 + 1 AS BIGINT)]) ELSE ['GOAL', 'SHOT_NOGOAL', 'LOSS', 'OUT'][CAST(to_state - 79 AS BIGINT)] END AS label, CAST(COUNT(*) AS BIGINT) AS n FROM tr GROUP BY 1, 2"""))
def f04(spark, sf):
    n = transitions(spark, sf).groupBy(F.col("to_state").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(SPACE.states(spark).select("state", "label")), "state")


@query("f05_phase_map", sql("", """p AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'From Counter' WHEN '2-HIGH' THEN 'From Corner' WHEN '3-MEDIUM' THEN 'From Throw In' WHEN '4-NOT SPECIFIED' THEN 'Regular Play' ELSE 'Unlisted' END AS pattern FROM orders)
SELECT pattern, CASE pattern WHEN 'From Counter' THEN 'transition' WHEN 'From Corner' THEN 'set_piece' WHEN 'From Throw In' THEN 'restart' ELSE 'open' END AS phase, CAST(COUNT(*) AS BIGINT) AS n FROM p GROUP BY 1, 2"""))
def f05(spark, sf):
    from chainspark.operators.chains import ChainConfig, phase_of
    pr = F.col("o_orderpriority")
    pattern = (F.when(pr == "1-URGENT", "From Counter").when(pr == "2-HIGH", "From Corner").when(pr == "3-MEDIUM", "From Throw In")
               .when(pr == "4-NOT SPECIFIED", "Regular Play").otherwise("Unlisted"))
    d = load(spark, sf, "orders").withColumn("pattern", pattern)
    return d.groupBy("pattern", phase_of(F.col("pattern"), ChainConfig(), SPACE).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query("f06_score_labels", sql(MOVES, """
SELECT score_state, CASE score_state WHEN 'losing' THEN 'winning' WHEN 'winning' THEN 'losing' ELSE score_state END AS inverted, CASE WHEN event_index + possession % 90 >= 60 THEN 'late' ELSE 'early' END AS moment, CAST(COUNT(*) AS BIGINT) AS n FROM moves GROUP BY 1, 2, 3"""))
def f06(spark, sf):
    minute = F.col("event_index") + F.col("possession") % 90
    return moves(spark, sf).groupBy("score_state", S.invert_score(F.col("score_state")).alias("inverted"), S.moment_level(minute).alias("moment")).agg(F.count(F.lit(1)).alias("n"))


@query("f07_clock_text", sql("", """t AS (SELECT user_id, strftime(ts, '%H:%M:%S.%g') AS c FROM events),
v AS (SELECT user_id, CAST(split_part(c, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(c, ':', 2) AS DOUBLE) * 60 + CAST(split_part(c, ':', 3) AS DOUBLE) AS s,
  CAST(split_part(c, ':', 1) AS DOUBLE) * 60 + CAST(split_part(c, ':', 2) AS DOUBLE) AS short FROM t)
SELECT user_id, ROUND(SUM(s), 3) AS seconds, ROUND(SUM(short), 3) AS minutes_seconds FROM v GROUP BY 1"""))
def f07(spark, sf):
    text = F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss.SSS")
    short = F.substring(text, 1, 5)
    return load(spark, sf, "events").groupBy("user_id").agg(
        F.round(F.sum(S.clock_seconds(text)), 3).alias("seconds"), F.round(F.sum(S.clock_seconds(short)), 3).alias("minutes_seconds"))


@query("f08_date_text", sql("", """d AS (SELECT CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) AS d FROM orders)
SELECT d, CAST(COUNT(*) AS BIGINT) AS n FROM d GROUP BY d"""))
def f08(spark, sf):
    d = S.date_of_text(F.col("o_orderdate").cast("string"))
    return load(spark, sf, "orders").groupBy(d.alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("f09_slug", sql("", f"""x AS (SELECT doc_id, lower(replace(translate(regexp_replace(text || ' Dušan Tadić Łódź Žižek', '\\p{{Mn}}', '', 'g'), '{S.ACCENTED}', '{S.PLAIN}'), ' ', '_')) AS slug FROM documents)
SELECT doc_id, md5(slug) AS slug FROM x"""))
def f09(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(S.slug(F.concat("text", F.lit(" Dušan Tadić Łódź Žižek")))).alias("slug"))


@query("f10_distances", sql(FA, """
SELECT team, ROUND(SUM(SQRT(POW(120 - start_x, 2) + POW(40 - start_y, 2))), 4) AS goal, ROUND(SUM(ABS((40 - start_y) * 60 - (120 - start_x) * 40 + 120 * start_y - 40 * start_x) / (SQRT(POW(120 - start_x, 2) + POW(40 - start_y, 2)) + 1e-12)), 4) AS line FROM actions GROUP BY team"""))
def f10(spark, sf):
    line = S.line_distance(F.lit(60.0), F.lit(40.0), F.col("start_x"), F.col("start_y"), F.lit(120.0), F.lit(40.0))
    return moves(spark, sf).groupBy("team").agg(F.round(F.sum(S.goal_distance(F.col("start_x"), F.col("start_y"))), 4).alias("goal"), F.round(F.sum(line), 4).alias("line"))


@query("f11_goal_angle", sql(FA, """
SELECT team, ROUND(SUM(ACOS(LEAST(GREATEST(((120 - start_x) * (120 - start_x) + (36 - start_y) * (44 - start_y)) / (SQRT(POW(120 - start_x, 2) + POW(36 - start_y, 2)) * SQRT(POW(120 - start_x, 2) + POW(44 - start_y, 2)) + 1e-12), -1), 1))), 4) AS angle FROM actions GROUP BY team"""))
def f11(spark, sf):
    return moves(spark, sf).groupBy("team").agg(F.round(F.sum(S.goal_angle(F.col("start_x"), F.col("start_y"))), 4).alias("angle"))


@query("f12_shot_and_delivery_zones", sql(MOVES, """
SELECT CASE WHEN start_x >= 114 AND start_y BETWEEN 30 AND 50 THEN 'six_yard' WHEN start_x >= 102 AND start_y BETWEEN 30 AND 50 THEN 'box_centre' WHEN start_x >= 102 AND start_y BETWEEN 18 AND 62 THEN 'box_side' ELSE 'outside' END AS shot_zone,
 CASE WHEN next_y IS NULL THEN 'unknown' WHEN next_y BETWEEN 36 AND 44 THEN 'central' WHEN (start_y < 40) = (next_y < 40) THEN 'near' ELSE 'far' END AS delivery, CAST(COUNT(*) AS BIGINT) AS n FROM moves GROUP BY 1, 2"""))
def f12(spark, sf):
    return moves(spark, sf).groupBy(S.shot_zone(F.col("start_x"), F.col("start_y")).alias("shot_zone"),
                                    S.delivery_zone(F.col("start_y"), F.col("next_y")).alias("delivery")).agg(F.count(F.lit(1)).alias("n"))


@query("f13_logs", sql("", """q AS (SELECT l_returnflag, l_discount * 10 AS p, l_tax AS t FROM lineitem)
SELECT l_returnflag, ROUND(SUM(LN(LEAST(GREATEST(p, 1e-6), 1 - 1e-6)) - LN(1 - LEAST(GREATEST(p, 1e-6), 1 - 1e-6))), 2) AS logit, ROUND(SUM(EXP(t) - 1), 4) AS rel, ROUND(SUM(CASE WHEN p > 0 AND t > 0 THEN LN(p) - LN(t) END), 3) AS lr FROM q GROUP BY 1"""))
def f13(spark, sf):
    p = F.col("l_discount") * 10
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(S.logit(p)), 2).alias("logit"), F.round(F.sum(S.relative(F.col("l_tax"))), 4).alias("rel"),
        F.round(F.sum(S.log_ratio(p, F.col("l_tax"))), 3).alias("lr"))


@query("f14_length_buckets", sql(FA, """,
c AS (SELECT poss_uid, COUNT(*) AS n FROM actions GROUP BY 1)
SELECT CASE WHEN n <= 3 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '4-5' WHEN n <= 7 THEN '6-7' WHEN n <= 10 THEN '8-10' ELSE '11+' END AS bucket, CAST(COUNT(*) AS BIGINT) AS possessions FROM c GROUP BY 1"""))
def f14(spark, sf):
    c = moves(spark, sf).groupBy("poss_uid").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(S.length_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("possessions"))


@query("f15_invert_and_levels", sql(MOVES, """
SELECT team, CAST(SUM(CASE score_state WHEN 'losing' THEN 0 WHEN 'winning' THEN 1 ELSE 2 END) AS BIGINT) AS level_sum FROM moves GROUP BY team"""))
def f15(spark, sf):
    inv = S.invert_score(S.invert_score(F.col("score_state")))
    level = F.when(inv == "losing", 0).when(inv == "winning", 1).otherwise(2)
    return moves(spark, sf).groupBy("team").agg(F.sum(level).alias("level_sum"))


@query("f16_parse_frames", sql(FA, """
SELECT team, CAST(COUNT(*) AS BIGINT) AS rows_read, CAST(SUM(CASE WHEN player_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS mates, ROUND(SUM(start_x), 3) AS sx FROM actions GROUP BY team"""))
def f16(spark, sf):
    frame = F.array(F.struct(F.array("start_x", "start_y").alias("location"), (F.col("player_id") % 3 == 0).alias("teammate"),
                             F.struct(F.col("player_id").alias("id"), F.lit("Back").alias("name")).alias("position")))
    json = F.to_json(frame)
    literal = json
    for a, b in (('"', "'"), ("true", "True"), ("false", "False")):
        literal = F.replace(literal, F.lit(a), F.lit(b))
    d = moves(spark, sf).withColumn("text", F.when(F.col("possession") % 2 == 0, json).otherwise(literal))
    f = F.get(X.parse_frame(F.col("text")), 0)
    d = d.withColumn("f", f).filter("f is not null")
    return d.groupBy("team").agg(F.count(F.lit(1)).alias("rows_read"), F.sum(F.col("f.teammate").cast("bigint")).alias("mates"),
                                 F.round(F.sum(F.get(F.col("f.location"), 0)), 3).alias("sx"))


@query("f17_third_of_pitch", sql(TR, " SELECT CAST(FLOOR((FLOOR(FLOOR(from_state / 4) / 4) + 0.5) / 5 * 3) AS INTEGER) AS third, CAST(COUNT(*) AS BIGINT) AS n FROM tr GROUP BY 1"))
def f17(spark, sf):
    return transitions(spark, sf).groupBy(SPACE.third(SPACE.zone_of_state(F.col("from_state"))).alias("third")).agg(F.count(F.lit(1)).alias("n"))


@query("f18_rival_thirds", sql(FA, """,
m AS (SELECT team, match_id, AVG(start_x) AS v FROM actions GROUP BY 1, 2), c AS (SELECT QUANTILE_CONT(v, 1 / CAST(3 AS DOUBLE)) AS lo, QUANTILE_CONT(v, 2 / CAST(3 AS DOUBLE)) AS hi FROM m)
SELECT CASE WHEN v >= hi THEN 'strong' WHEN v <= lo THEN 'weak' ELSE 'mid' END AS level, CAST(COUNT(*) AS BIGINT) AS n FROM m, c GROUP BY 1"""))
def f18(spark, sf):
    m = moves(spark, sf).groupBy("team", "match_id").agg(F.avg("start_x").alias("v"))
    cut = exact_quantile(m, [], "v", {"lo": 1 / 3, "hi": 2 / 3})
    d = m.crossJoin(F.broadcast(cut))
    return d.groupBy(S.rival_level(F.col("v"), F.col("lo"), F.col("hi")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("f19_nested_access", sql(MOVES, " SELECT team, CAST(COUNT(CASE WHEN action_type = 'Pass' THEN next_player END) AS BIGINT) AS recipients, CAST(COUNT(DISTINCT player_id) AS BIGINT) AS players FROM moves GROUP BY team"))
def f19(spark, sf):
    return nested_events(spark, sf).groupBy(F.col("team.name").alias("team")).agg(
        F.count("pass.recipient.id").alias("recipients"), F.countDistinct("player.name").alias("players"))


@query("f20_pattern_match", sql("", """x AS (SELECT doc_id, lang, regexp_matches(text, '[0-9]{3}') AS hit FROM documents)
SELECT lang, CAST(SUM(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(COUNT(*) AS BIGINT) AS n FROM x GROUP BY lang"""))
def f20(spark, sf):
    return load(spark, sf, "documents").groupBy("lang").agg(
        F.sum(F.col("text").rlike("[0-9]{3}").cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("n"))


# -- eras and quality ---------------------------------------------------------------------------------------
@query("r01_era_problems", sql(ERAS, """,
bad AS (SELECT club, coach, CASE WHEN coach LIKE '%_1' THEN start_date - 200 ELSE start_date END AS start_date, CASE WHEN coach LIKE 'KT3%' THEN start_date - 500 ELSE end_date END AS end_date FROM er),
p AS (SELECT *, MAX(end_date) OVER (PARTITION BY club ORDER BY start_date, end_date, coach ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM bad)
SELECT club, coach, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date, CASE WHEN end_date < start_date THEN 'reversed' ELSE 'overlap' END AS problem FROM p WHERE end_date < start_date OR start_date <= pe"""))
def r01(spark, sf):
    e = era_table(moves(spark, sf))
    e = e.withColumn("end_date", F.when(F.col("coach").startswith("KT3"), F.date_sub("start_date", 500)).otherwise(F.col("end_date")))
    e = e.withColumn("start_date", F.when(F.col("coach").endswith("_1"), F.date_sub("start_date", 200)).otherwise(F.col("start_date")))
    return R.era_problems(e, F.year("start_date"))


RUNS = META + """,
fx AS (SELECT match_id, match_date, club, CASE WHEN club = 'T2' AND match_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN 'KT2_fix' ELSE coach END AS coach, n_managers FROM mg),
ns AS (SELECT *, CASE WHEN LAG(coach) OVER w IS DISTINCT FROM coach THEN 1 ELSE 0 END AS nw FROM fx WINDOW w AS (PARTITION BY club ORDER BY match_date, match_id)),
rn AS (SELECT *, SUM(nw) OVER (PARTITION BY club ORDER BY match_date, match_id) AS run_id FROM ns),
rr AS MATERIALIZED (SELECT club, CAST(run_id AS BIGINT) AS run_id, coach, MIN(match_date) AS start_date, MAX(match_date) AS end_date, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN n_managers > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi FROM rn GROUP BY 1, 2, 3)"""


def managers(spark, sf):
    fixes = moves(spark, sf).filter("team = 'T2' and year(match_date) = 1996").groupBy(F.col("team").alias("club")).agg(
        F.to_date(F.lit("1996-01-01")).alias("start_date"), F.to_date(F.lit("1996-12-31")).alias("end_date"), F.lit("KT2_fix").alias("coach"))
    return R.apply_corrections(A.match_managers(metadata(spark, sf)), fixes)


def run_table(spark, sf):
    return R.coach_runs(managers(spark, sf), F.year("match_date"))


@query("r02_coach_runs", sql(RUNS, " SELECT club, run_id, coach, start_date, end_date, n, multi FROM rr"))
def r02(spark, sf):
    return run_table(spark, sf).drop("seasons")


def merged(spark, sf):
    return R.merge_interims(run_table(spark, sf), 2, cut_lineage)


# a club's runs in order on a stack: a run closes the short one on top of it if the coach below is back
MERGED = RUNS + """,
rs AS MATERIALIZED (SELECT club, CAST(run_id AS BIGINT) AS run_id, list_sort(list(DISTINCT CASE WHEN month(match_date) >= 7 THEN 'A' ELSE 'C' END || year(match_date))) AS seasons FROM rn GROUP BY 1, 2),
st AS (SELECT club, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(run_id BIGINT, coach VARCHAR, start_date DATE, end_date DATE, n BIGINT, multi BIGINT, merged BIGINT, absorbed BIGINT, first_run BIGINT, last_run BIGINT, seasons VARCHAR[])[]) AS s FROM (SELECT DISTINCT club FROM rr)
  UNION ALL
  SELECT st.club, st.k + 1, CASE WHEN len(s) >= 2 AND s[-1].n <= 2 AND s[-2].coach = r.coach
    THEN list_append(list_slice(s, 1, len(s) - 2), {'run_id': s[-2].run_id, 'coach': r.coach, 'start_date': s[-2].start_date, 'end_date': r.end_date, 'n': s[-2].n + r.n, 'multi': s[-2].multi + r.multi, 'merged': s[-2].merged + 1,
      'absorbed': s[-2].absorbed + s[-1].n, 'first_run': s[-2].first_run, 'last_run': r.run_id, 'seasons': list_sort(list_distinct(list_concat(s[-2].seasons, rs.seasons)))})
    ELSE list_append(s, {'run_id': r.run_id, 'coach': r.coach, 'start_date': r.start_date, 'end_date': r.end_date, 'n': r.n, 'multi': r.multi, 'merged': 0, 'absorbed': 0, 'first_run': r.run_id, 'last_run': r.run_id, 'seasons': rs.seasons}) END
  FROM st JOIN rr r ON r.club = st.club AND r.run_id = st.k + 1 JOIN rs ON rs.club = r.club AND rs.run_id = r.run_id),
me AS MATERIALIZED (SELECT club, x.* FROM (SELECT club, UNNEST(arg_max(s, k)) AS x FROM st GROUP BY club)),
fl AS (SELECT *, COUNT(*) OVER (PARTITION BY club, coach) AS times, ROW_NUMBER() OVER (PARTITION BY club, coach ORDER BY run_id) AS seen, ROW_NUMBER() OVER (PARTITION BY club ORDER BY run_id) AS place FROM me),
eras AS MATERIALIZED (SELECT club, CASE WHEN times > 1 THEN coach || ' ' || repeat('I', seen) ELSE coach END AS coach, coach AS coach_full, start_date, end_date, n AS n_matches, n + absorbed AS n_in_range, absorbed AS n_absorbed,
  array_to_string(seasons, '|') AS seasons, n >= 10 AS analysable, concat_ws(';', CASE WHEN place = 1 THEN 'FIRST_OF_WINDOW' END, CASE WHEN n < 10 THEN 'SHORT' END, CASE WHEN times > 1 THEN 'NOT_CONTIGUOUS' END,
    CASE WHEN multi > 0 THEN 'MULTI_MANAGER(' || multi || ')' END, CASE WHEN merged > 0 THEN 'MERGED(' || merged || ')' END) AS flags, first_run, last_run FROM fl)"""


def merged_sql(body):
    return sql(MERGED, body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("r03_merge_interims", merged_sql(" SELECT club, run_id, coach, start_date, end_date, n, multi, merged, absorbed, first_run, last_run FROM me"))
def r03(spark, sf):
    return merged(spark, sf).drop("seasons")


@query("r04_era_flags", merged_sql(" SELECT * FROM eras"))
def r04(spark, sf):
    return R.flag_eras(merged(spark, sf), 10)


@query("r05_extend_ends", sql(ERAS, """
SELECT club, coach, start_date, CAST(COALESCE(LEAD(start_date) OVER (PARTITION BY club ORDER BY start_date) - 1, end_date) AS DATE) AS end_date FROM er"""))
def r05(spark, sf):
    return R.extend_ends(era_table(moves(spark, sf)), F.year("start_date"))


@query("r06_match_assignment", merged_sql("""
SELECT fx.club, match_id, match_date, e.coach AS era, e.start_date, e.end_date, fx.coach AS coach_real, CAST(fx.coach = e.coach_full AS INTEGER) AS led_the_era
FROM fx JOIN eras e ON e.club = fx.club AND fx.match_date BETWEEN e.start_date AND e.end_date"""))
def r06(spark, sf):
    return R.assign_matches(managers(spark, sf), R.flag_eras(merged(spark, sf), 10))


@query("r07_coverage", sql(TR, """,
c AS (SELECT team, coach, COUNT(DISTINCT match_id) AS matches, COUNT(DISTINCT poss_uid) AS possessions, COUNT(*) AS transitions FROM tr GROUP BY 1, 2), t AS (SELECT team, COUNT(DISTINCT match_id) AS m FROM tr GROUP BY 1)
SELECT c.team, coach, CAST(matches AS BIGINT) AS matches, CAST(possessions AS BIGINT) AS possessions, CAST(transitions AS BIGINT) AS transitions, ROUND(CAST(matches AS DOUBLE) / m * 100, 1) AS pct_matches, matches >= 25 AS sufficient FROM c JOIN t ON t.team = c.team"""))
def r07(spark, sf):
    return R.coverage(transitions(spark, sf))


@query("r08_unmapped_matches", sql(FA, " SELECT team, match_id, MIN(match_date) AS match_date FROM actions WHERE match_id % 7 = 0 GROUP BY 1, 2"))
def r08(spark, sf):
    gone = F.when(F.col("match_id") % 7 > 0, F.col("coach"))
    return R.unmapped(moves(spark, sf).withColumn("coach", gone))


@query("r09_derive_dates", sql(FA, """,
m AS (SELECT DISTINCT team, match_id FROM actions), g AS (SELECT *, CASE WHEN match_id - LAG(match_id) OVER (PARTITION BY team ORDER BY match_id) > 40 THEN 1 ELSE 0 END AS j FROM m),
b AS (SELECT team, match_id, CAST(SUM(j) OVER (PARTITION BY team ORDER BY match_id) AS BIGINT) AS block FROM g), s AS (SELECT team, block, COUNT(*) AS n FROM b GROUP BY 1, 2),
ct AS (SELECT s.team, MIN(s.n) AS cut FROM s WHERE (SELECT COUNT(*) FROM s s2 WHERE s2.team = s.team AND s2.n >= s.n) = 5 GROUP BY 1),
r AS (SELECT s.team, block, n >= cut AS regular, SUM(CASE WHEN n >= cut THEN 1 ELSE 0 END) OVER (PARTITION BY s.team ORDER BY block) AS sn FROM s JOIN ct ON ct.team = s.team),
w AS (SELECT team, block, CASE WHEN regular THEN CONCAT('S', sn) ELSE CONCAT('S', sn, ' (play-off)') END AS season, CASE WHEN regular THEN make_date(2000 + CAST(sn AS BIGINT), 1, 10) ELSE make_date(2000 + CAST(sn AS BIGINT), 5, 20) + 7 END AS lo, CASE WHEN regular THEN make_date(2000 + CAST(sn AS BIGINT), 5, 20) ELSE make_date(2000 + CAST(sn AS BIGINT), 5, 20) + 30 END AS hi FROM r WHERE sn BETWEEN 1 AND 9),
k AS (SELECT b.team, b.match_id, b.block, season, lo, hi, ROW_NUMBER() OVER (PARTITION BY b.team, b.block ORDER BY b.match_id) AS k, COUNT(*) OVER (PARTITION BY b.team, b.block) AS n FROM b JOIN w ON w.team = b.team AND w.block = b.block)
SELECT team, match_id, CAST(lo + CAST(CASE WHEN n > 1 THEN ROUND(CAST(DATE_DIFF('day', lo, hi) AS DOUBLE) * (k - 1) / (n - 1)) ELSE 0 END AS INTEGER) AS DATE) AS match_date, season, block, 'derived' AS source FROM k"""))
def r09(spark, sf):
    ids = moves(spark, sf).select("team", "match_id").distinct()
    seasons = 5  # regular blocks asked for, and so the seasons of the calendar
    cal = spark.range(1, seasons + 1).withColumnRenamed("id", "season_no").select(
        "season_no", F.concat(F.lit("S"), F.col("season_no").cast("string")).alias("season"),
        F.make_date((2000 + F.col("season_no")).cast("int"), F.lit(1), F.lit(10)).alias("first_day"),
        F.make_date((2000 + F.col("season_no")).cast("int"), F.lit(5), F.lit(20)).alias("last_day"))
    return R.derive_dates(ids, ["team"], 40, cal, seasons, (7, 30), F.floor(F.col("match_id") / 100))


@query("r10_common_club", sql(FA, """,
e AS (SELECT DISTINCT team AS club, player_id FROM actions WHERE player_id % 5 = CAST(substr(team, 2) AS BIGINT) % 5 OR player_id > 11),
p AS (SELECT DISTINCT x.player_id AS a, y.player_id AS b FROM actions x JOIN actions y ON x.poss_uid = y.poss_uid AND x.event_index + 1 = y.event_index)
SELECT p.a, p.b, MIN(x.club) AS club FROM p JOIN e x ON x.player_id = p.a JOIN e y ON y.player_id = p.b AND y.club = x.club GROUP BY 1, 2 HAVING COUNT(DISTINCT x.club) = 1"""))
def r10(spark, sf):
    m = moves(spark, sf)
    e = m.filter("player_id % 5 = cast(substr(team, 2) as bigint) % 5 or player_id > 11").select(
        F.col("team").alias("club"), F.col("player_id").alias("coach")).distinct()
    p = m.filter("next_player is not null").select(F.col("player_id").alias("a"), F.col("next_player").alias("b")).distinct()
    return R.common_club(e, p)


@query("r11_axis_checks", sql(FA, """
SELECT team, ROUND(AVG(CASE WHEN phase = 'open' THEN start_x END), 6) AS mean_a, ROUND(AVG(CASE WHEN phase <> 'open' THEN start_x END), 6) AS mean_b, ROUND(AVG(CASE WHEN phase = 'open' THEN start_x END) + AVG(CASE WHEN phase <> 'open' THEN start_x END) - 120, 6) AS gap FROM actions GROUP BY team"""))
def r11(spark, sf):
    d = moves(spark, sf).withColumn("side", F.col("phase") == "open")
    d = K.mirrored_axis(d, ["team"], "start_x", "side", 120.0)
    return d.select("team", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "gap")])


@query("r11_band_share", sql(FA, """
SELECT player_id, AVG(CASE WHEN start_y < 26 THEN 1.0 ELSE 0.0 END) AS low, AVG(CASE WHEN start_y >= 26 AND start_y < 54 THEN 1.0 ELSE 0.0 END) AS middle, AVG(CASE WHEN start_y >= 54 THEN 1.0 ELSE 0.0 END) AS high FROM actions GROUP BY 1"""))
def r11b(spark, sf):
    return K.band_share(moves(spark, sf), ["player_id"], "start_y", (26.0, 54.0))


@query("r12_regression_check", sql(TR, """,
nw AS (SELECT * FROM tr WHERE possession % 50 <> 0)
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM tr) AS rows_old, (SELECT CAST(COUNT(*) AS BIGINT) FROM nw) AS rows_new, CAST(0 AS BIGINT) AS duplicate_keys, (SELECT CAST(COUNT(*) AS BIGINT) FROM tr WHERE possession % 50 = 0) AS keys_lost, CAST(0 AS BIGINT) AS keys_added, (SELECT CAST(COUNT(*) AS BIGINT) FROM tr WHERE possession % 50 = 0) AS rows_different, (SELECT COUNT(*) FROM tr WHERE possession % 50 = 0) = 0 AS same"""))
def r12(spark, sf):
    tr = transitions(spark, sf).select("poss_uid", "event_index", "possession", "from_state", "to_state")
    return K.regression_check(tr, tr.filter("possession % 50 <> 0"), ["poss_uid", "event_index"])


@query("r13_reconcile_sources", sql(FA, """,
b AS (SELECT * FROM actions WHERE possession % 6 <> 0),
sa AS (SELECT match_id, COUNT(DISTINCT team) AS k FROM actions GROUP BY 1), sb AS (SELECT match_id, COUNT(DISTINCT team) AS k FROM b GROUP BY 1),
pa AS (SELECT DISTINCT match_id, team, player_id FROM actions), pb AS (SELECT DISTINCT match_id, team, player_id FROM b),
ms AS (SELECT pa.match_id, AVG(CASE WHEN pb.player_id IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM pa LEFT JOIN pb ON pb.match_id = pa.match_id AND pb.team = pa.team AND pb.player_id = pa.player_id GROUP BY 1)
SELECT sa.match_id, COALESCE(sa.k = sb.k, FALSE) AS same_sides, ROUND(missing, 6) AS missing, COALESCE(sa.k = sb.k, FALSE) AND missing <= 0.15 AS ok FROM sa LEFT JOIN sb ON sb.match_id = sa.match_id JOIN ms ON ms.match_id = sa.match_id"""))
def r13(spark, sf):
    a = moves(spark, sf)
    d = K.reconcile(a, a.filter("possession % 6 <> 0"), "match_id", "team", "player_id")
    return d.withColumn("missing", F.round("missing", 6))


@query("r14_table_profile")
def r14(spark, sf):
    return K.profile(load(spark, sf, "lineitem"))


@query("r14_null_shares", sql(EV, " SELECT type, AVG(CASE WHEN end_x IS NULL OR type <> 'Pass' THEN 1.0 ELSE 0.0 END) AS null_pass_end_x, AVG(CASE WHEN NOT under_pressure THEN 1.0 ELSE 0.0 END) AS null_under_pressure FROM ev GROUP BY type"))
def r14b(spark, sf):
    e = E.normalise(raw_events(spark, sf))
    e = e.withColumn("pass_end_x", F.when(F.col("type") == "Pass", F.col("pass_end_x")))
    return K.null_shares(e, ["type"], ["pass_end_x", "under_pressure"])


@query("r14_volume_probe", sql(FA, " SELECT season, CAST(COUNT(*) AS BIGINT) AS n, ROUND(QUANTILE_CONT(start_x, 0.5), 6) AS median FROM actions GROUP BY season"))
def r14c(spark, sf):
    return K.volume_by(moves(spark, sf), ["season"], "start_x").withColumn("median", F.round("median", 6))


@query("r15_artifact_identity", sql(FA, " SELECT 'coach' AS unit, coach AS value, 'attack' AS perspective, CAST(COUNT(*) AS BIGINT) AS n FROM actions GROUP BY coach"))
def r15(spark, sf):
    """Every coach's rows carry the identity of their artifact: unit and perspective are those asked for."""
    d = moves(spark, sf).groupBy(
        F.lit("coach").alias("unit"), F.col("coach").alias("value"), F.lit("attack").alias("perspective")).agg(F.count(F.lit(1)).alias("n"))
    return K.require_identity(d, {"unit": "coach", "perspective": "attack"})


@query("r16_eligible_units", sql(TR, " SELECT team, coach, CAST(COUNT(DISTINCT poss_uid) AS BIGINT) AS possessions FROM tr GROUP BY 1, 2 HAVING COUNT(DISTINCT poss_uid) >= 60"))
def r16(spark, sf):
    return K.eligible_units(transitions(spark, sf), ["team", "coach"], 60)


@query("r17_pair_table", sql(PAIR_REPS, """,
p AS (SELECT pr.a, pr.bb AS c, MAX(t) AS t, LEAST(1, 2.0 * (1 + SUM(CASE WHEN (t >= 0 AND d - t >= t) OR (t < 0 AND d - t <= t) THEN 1 ELSE 0 END)) / 41) AS p FROM pr JOIN pt ON pr.a = pt.a AND pr.bb = pt.bb WHERE b > 0 GROUP BY 1, 2),
f AS (SELECT p, COUNT(*) AS n FROM p GROUP BY 1), r AS (SELECT p, SUM(n) OVER (ORDER BY p) AS k, SUM(n) OVER () AS m FROM f), q AS (SELECT p, MIN(p * m / k) OVER (ORDER BY p DESC) AS q FROM r)
SELECT a, c, ROUND(t, 6) AS size, ROUND(p.p, 6) AS p, ROUND(LEAST(1, q), 6) AS q, CASE WHEN a = 'T0' THEN 'parallel' ELSE 'unclear' END AS stratum, CASE WHEN LEAST(1, q) <= 0.05 THEN CASE WHEN a = 'T0' THEN 'different' ELSE 'different, trend unclear' END ELSE 'not distinguished' END AS verdict FROM p JOIN q ON q.p = p.p"""))
def r17(spark, sf):
    d = B.fdr(B.interval(pair_reps(spark, sf), ["a", "c"], "d"), [])
    strata = d.select("a", "c", F.when(F.col("a") == "T0", "parallel").otherwise("unclear").alias("stratum"))
    t = K.pair_table(d, strata, ["a", "c"])
    return t.select("a", "c", F.round("point", 6).alias("size"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "stratum", "verdict")
