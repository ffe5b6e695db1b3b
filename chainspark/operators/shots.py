"""Shots and set pieces: freeze-frame geometry, logistic models, calibration, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.scan import Running, exact_quantile, running
from chainspark.operators.relations import midrank
from chainspark.space import StateSpace

# Posts, last x a shot may have, radius of a defender's body.
POST_LOW, POST_HIGH, MAX_X, RADIUS = (120.0, 36.0), (120.0, 44.0), 119.9, 0.3

FRAME_SCHEMA = ("array<struct<location: array<double>, teammate: boolean, "
                "position: struct<id: bigint, name: string>>>")


# -- frames ------------------------------------------------------------------------------------
def parse_frame(text: Column) -> Column:
    """Frame from JSON or from a printed literal; null when neither reads."""
    return F.coalesce(F.from_json(text, FRAME_SCHEMA, {"mode": "PERMISSIVE"}),
                      F.from_json(S.literal_to_json(text), FRAME_SCHEMA))


def opponents(frame: Column, keeper: bool) -> Column:
    """Rival entries of a frame: keepers only, or everybody else."""
    is_keeper = lambda p: F.coalesce(p["position"]["name"] == "Goalkeeper", F.lit(False))
    rival = lambda p: ~F.coalesce(p["teammate"], F.lit(False))
    return F.filter(frame, lambda p: rival(p) & (is_keeper(p) if keeper else ~is_keeper(p)))


def frame_audit(shots: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Coverage, parse failures, share without keeper, defenders per frame."""
    f = parse_frame(F.col(text))
    d = shots.withColumn("__f", f)
    have = F.col(text).isNotNull()
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shots"), F.sum(have.cast("bigint")).alias("with_frame"),
        F.sum((have & F.col("__f").isNull()).cast("bigint")).alias("unreadable"),
        F.avg(F.when(F.col("__f").isNotNull(), (F.size(opponents(F.col("__f"), True)) == 0).cast("double"))).alias("no_keeper"),
        F.avg(F.when(F.col("__f").isNotNull(), F.size(opponents(F.col("__f"), False)).cast("double"))).alias("defenders"))


def _number(c: Column) -> Column:
    """Null for NaN: an unknown place, which comparisons would otherwise put last."""
    return F.when(~F.isnan(c), c)


def _clipped_x(x: Column) -> Column:
    return F.least(x, F.lit(MAX_X))


def shadows(x: Column, y: Column, defenders: Column, radius: float = RADIUS) -> Column:
    """Angular intervals of the goal mouth hidden by each defender in front of the shooter.

    ``defenders`` is array<array<double>>; a frame holds at most two teams, so everything stays
    inside the row: no explode and no exchange.
    """
    x, y = _number(x), _number(y)
    sx = _clipped_x(x)
    lo = F.atan2(F.lit(POST_LOW[1]) - y, F.lit(POST_LOW[0]) - sx)
    hi = F.atan2(F.lit(POST_HIGH[1]) - y, F.lit(POST_HIGH[0]) - sx)

    def one(d: Column) -> Column:
        dx, dy = _number(F.get(d, 0)), _number(F.get(d, 1))
        rho = F.sqrt((dx - sx) * (dx - sx) + (dy - y) * (dy - y))
        semi = F.asin(F.least(F.lit(1.0), F.lit(radius) / F.greatest(rho, F.lit(1e-9))))
        phi = F.atan2(dy - y, dx - sx)
        return F.struct(F.greatest(lo, phi - semi).alias("a"), F.least(hi, phi + semi).alias("b"),
                        rho.alias("rho"), dx.alias("dx"))
    seen = F.transform(defenders, one)
    return F.filter(seen, lambda s: s["dx"].isNotNull() & s["rho"].isNotNull() & (s["dx"] > sx)
                    & (s["rho"] >= 1e-9))


def _union_length(intervals: Column) -> Column:
    """Total length of a union of intervals, by one pass over them in order."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        fresh = acc["end"].isNull() | (s["a"] > acc["end"])
        gain = F.when(fresh, s["b"] - s["a"]).otherwise(F.greatest(F.lit(0.0), s["b"] - acc["end"]))
        return F.struct((acc["sum"] + gain).alias("sum"),
                        F.when(fresh, s["b"]).otherwise(F.greatest(acc["end"], s["b"])).alias("end"))
    return F.aggregate(F.sort_array(intervals), start, step, lambda acc: acc["sum"])


def visible_goal(x: Column, y: Column, defenders: Column, radius: float = RADIUS) -> Column:
    """Angular share of the goal not hidden; null without a shooting position."""
    x, y = _number(x), _number(y)
    sx = _clipped_x(x)
    width = (F.atan2(F.lit(POST_HIGH[1]) - y, F.lit(POST_HIGH[0]) - sx)
             - F.atan2(F.lit(POST_LOW[1]) - y, F.lit(POST_LOW[0]) - sx))
    s = shadows(x, y, defenders, radius)
    on_top = F.exists(s, lambda v: v["rho"] <= radius)
    blocked = _union_length(F.filter(s, lambda v: v["b"] > v["a"]))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - blocked / width))
    return F.when(x.isNull() | y.isNull() | (width <= 1e-9), None).when(on_top, 0.0).otherwise(share)


def blocked_segments(x: Column, y: Column, defenders: Column, radius: float = RADIUS) -> Column:
    """Pieces of the goal line hidden, projected linearly; for display, not the angular share."""
    x, y = _number(x), _number(y)
    sx = _clipped_x(x)
    s = shadows(x, y, defenders, radius)
    low, high = POST_LOW[1], POST_HIGH[1]

    def piece(v: Column) -> Column:
        # shadows are already cut to the goal mouth, where tan is monotone
        at = lambda ang: y + (F.lit(120.0) - sx) * F.tan(ang)
        return F.struct(F.greatest(F.lit(low), at(v["a"])).alias("lo"), F.least(F.lit(high), at(v["b"])).alias("hi"))
    pieces = F.transform(F.filter(s, lambda v: v["b"] > v["a"]), piece)
    whole = F.array(F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")))
    return F.when(F.exists(s, lambda v: v["rho"] <= radius), whole).otherwise(
        F.filter(pieces, lambda p: p["hi"] > p["lo"]))


def features(shots: DataFrame, x: str, y: str, frame: str, radius: float = RADIUS) -> DataFrame:
    """Distance, angle, visible goal, nearest defender, defenders within 3, keeper depth and offset.

    Keeper features are null without a keeper in the frame; nothing is imputed.
    """
    sx, sy = _number(F.col(x)), _number(F.col(y))
    field = F.transform(opponents(F.col(frame), False), lambda p: p["location"])
    keeper = F.get(opponents(F.col(frame), True), 0)["location"]
    # defenders without a readable place are not near
    dist = F.filter(F.transform(field, lambda d: S.distance(sx, sy, F.get(d, 0), F.get(d, 1))), lambda d: ~F.isnan(d))
    gx, gy = F.get(keeper, 0), F.get(keeper, 1)
    return shots.withColumns({
        "goal_distance": S.goal_distance(sx, sy), "goal_angle": S.goal_angle(sx, sy),
        "visible": visible_goal(sx, sy, field, radius), "nearest": F.array_min(dist),
        "within_3": F.size(F.filter(dist, lambda d: d <= 3.0)).cast("double"),
        "keeper_depth": 120.0 - gx,
        "keeper_offset": S.line_distance(gx, gy, sx, sy, F.lit(120.0), F.lit(40.0)),
        "defenders": F.size(field).cast("double")})


# -- calibration ----------------------------------------------------------------------------------
def auc(df: DataFrame, keys: list[str], score: str, label: str, chunk: Column | None = None) -> DataFrame:
    """Rank AUC with midranks; null when a key has one class only."""
    d = midrank(df, keys, score, "__r", chunk)
    y = F.col(label).cast("double")
    n1, n0 = F.sum(y), F.sum(1 - y)
    u = (F.sum(F.when(y == 1, F.col("__r")).otherwise(0.0)) - n1 * (n1 + 1) / 2)
    return d.groupBy(*keys).agg(F.when((n1 > 0) & (n0 > 0), u / (n1 * n0)).alias("auc"),
                                F.count(F.lit(1)).alias("n"))


def murphy(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Brier score with uncertainty, resolution and reliability in quantile bins."""
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    edges = exact_quantile(df, [], score, probs)
    e = df.crossJoin(F.broadcast(edges))
    bin_ = sum((F.when(F.col(score) >= F.col(c), 1).otherwise(0) for c in probs), F.lit(0))
    y = F.col(label).cast("double")
    cell = e.withColumn("__bin", bin_).groupBy("__bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("p"), F.avg(y).alias("o"),
        F.sum((F.col(score) - y) * (F.col(score) - y)).alias("sq"))
    whole = Window.partitionBy(F.lit(1))
    cell = cell.withColumn("base", F.sum(F.col("n") * F.col("o")).over(whole) / F.sum("n").over(whole))
    n = F.sum("n")
    return cell.agg(
        (F.sum("sq") / n).alias("brier"), (F.max("base") * (1 - F.max("base"))).alias("uncertainty"),
        (F.sum(F.col("n") * F.pow(F.col("o") - F.col("base"), 2)) / n).alias("resolution"),
        (F.sum(F.col("n") * F.pow(F.col("p") - F.col("o"), 2)) / n).alias("reliability"))


# -- set pieces --------------------------------------------------------------------------------------
def sequences(poss: DataFrame, pass_type: str, pattern: str, x_min: float | None = None,
              chunk: Column | None = None) -> DataFrame:
    """Set-piece sequences: from the taking pass on, while period and pattern hold and nobody
    takes another one.

    ``poss``: match_id, possession, period, pattern, team, taker (struct pass_type, x or null),
    shots, goals (struct arrays are not needed: shots/goals by the possessing team).
    """
    order = ["possession"]
    taken = F.col("taker").isNotNull()
    start = F.when(taken, F.struct("possession", "period", "team", "taker"))
    d = running(poss, ["match_id"], order,
                [Running("__start", "max", start, inclusive=True)], chunk)
    s = F.col("__start")
    ok = s["taker"]["pass_type"] == pass_type
    if x_min is not None:
        ok = ok & F.coalesce(s["taker"]["x"] >= x_min, F.lit(False))
    d = d.filter(s.isNotNull() & ok).withColumn("sequence", s["possession"])
    follows = F.col("possession") != s["possession"]
    broken = (follows & ((F.col("period") != s["period"]) | (F.col("pattern") != pattern))).cast("int")
    d = running(d.withColumn("__bad", broken), ["match_id", "sequence"], order,
                [Running("__broken", "max", F.col("__bad"), inclusive=True)], chunk)
    d = d.filter(F.col("__broken") == 0)
    mine = F.col("team") == F.col("__start.team")
    return d.groupBy("match_id", "sequence").agg(
        F.min("__start.team").alias("attacker"), F.min("__start.period").alias("period"),
        F.count(F.lit(1)).alias("possessions"),
        F.max(F.when(mine & (F.col("shots") > 0), 1).otherwise(0)).alias("S"),
        F.max(F.when(mine & (F.col("goals") > 0), 1).otherwise(0)).alias("G"))


# -- where danger comes from -----------------------------------------------------------------------
def last_action_zones(trans: DataFrame, space: StateSpace, keys: list[str]) -> DataFrame:
    """Zone of the last action given the outcome."""
    d = trans.filter("is_absorbing").groupBy(*keys, F.col("to_state").alias("outcome"),
                                             space.zone_of_state(F.col("from_state")).alias("zone")).agg(
        F.count(F.lit(1)).alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "outcome")))


def route_lift(trans: DataFrame, space: StateSpace, keys: list[str], min_n: int = 25,
               min_support: int = 10) -> DataFrame:
    """P(zone visited | outcome) over P(zone visited): lift, only with enough support."""
    zone = space.zone_of_state(F.col("from_state"))
    end = trans.filter("is_absorbing").groupBy(*keys, "poss_uid").agg(F.max("to_state").alias("outcome"))
    visits = trans.groupBy(*keys, "poss_uid", zone.alias("zone")).agg(F.lit(1).alias("v")).drop("v")
    all_n = end.groupBy(*keys).agg(F.count(F.lit(1)).alias("all_n"))
    out_n = end.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("out_n"))
    v = visits.join(end, [*keys, "poss_uid"]).groupBy(*keys, "zone", "outcome").agg(F.count(F.lit(1)).alias("support"))
    marginal = visits.groupBy(*keys, "zone").agg(F.count(F.lit(1)).alias("zone_n"))
    d = v.join(marginal, [*keys, "zone"]).join(out_n, [*keys, "outcome"]).join(all_n, keys)
    route = F.col("support") / F.col("out_n")
    lift = F.when(F.col("support") >= min_support, route / (F.col("zone_n") / F.col("all_n")))
    return d.filter(F.col("out_n") >= min_n).select(*keys, "outcome", "zone", "support", route.alias("route"), lift.alias("lift"))
