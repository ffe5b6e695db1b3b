"""Team-match metrics, minutes and line-ups, player zones and pass networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.scan import Running, neighbour, running, same_keys
from chainspark.operators import resample as R
from chainspark.operators.relations import leave_unit_out
from chainspark.operators.standardise import pairs_of


# -- team-match panel ------------------------------------------------------------------------
def mirrored(per: DataFrame, match: str, team: str, cols: list[str]) -> DataFrame:
    """For and against: join each team-match row to the other team of the match (missing is 0)."""
    other = per.select(match, F.col(team).alias("__other"), *[F.col(c).alias(f"{c}_against") for c in cols])
    d = per.join(other, match, "left").filter(F.col(team) != F.col("__other"))
    return d.na.fill(0, [*cols, *[f"{c}_against" for c in cols]]).drop("__other")


def field_tilt(own: Column, rival: Column) -> Column:
    return F.when(own + rival > 0, own / (own + rival))


def symmetry_gap(panel: DataFrame, cols: list[str], tilt: str) -> DataFrame:
    """Total for minus total against (zero) and mean tilt (one half)."""
    return panel.agg(*[(F.sum(c) - F.sum(f"{c}_against")).alias(f"gap_{c}") for c in cols],
                     F.avg(tilt).alias("mean_tilt"))


# -- minutes ----------------------------------------------------------------------------------
def clock_kind(spells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """cumulative when most second-half entries start at 45:00 or later, else period.

    A unit without a readable second-half entry is there as unknown.
    """
    entry = F.when(F.col("from_period") == 2, S.clock_seconds(F.col("from")) >= 2700)
    late = F.avg(entry.cast("double"))
    return spells.groupBy(*keys).agg(F.when(late > 0.5, "cumulative").when(late <= 0.5, "period")
                                     .otherwise("unknown").alias("clock"))


def minutes_played(spells: DataFrame, ends: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """Minutes of a player from position spells.

    ``spells``: keys, match_id, from, to, from_period, to_period (null ``to`` = until the end);
    ``ends``: match_id, last_period, end_by_period (map period -> seconds).
    """
    d = spells.join(ends, "match_id")
    seconds = {c: S.clock_seconds(F.col(c)) for c in ("from", "to")}
    length = lambda p: F.try_element_at("end_by_period", p)
    if clock == "cumulative":
        # one axis for the match: the last period starts at 45 minutes for each one before it
        whistle = 2700 * (F.col("last_period") - 1) + length(F.col("last_period"))
        secs = F.greatest(F.coalesce(seconds["to"], whistle) - seconds["from"], F.lit(0.0))
    else:
        # a spell is played in every period from its first to its last: the overlap with each, added up
        first, last = F.coalesce("from_period", F.lit(1)), F.coalesce("to_period", "last_period")
        played = F.transform(F.sequence(first, last), lambda p: F.greatest(
            F.coalesce(F.when(p == last, seconds["to"]), length(p)) - F.when(p == first, seconds["from"]).otherwise(0.0), F.lit(0.0)))
        secs = F.when(first <= last, F.aggregate(played, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    return d.withColumn("__s", secs).groupBy(*keys, "match_id").agg((F.sum("__s") / 60.0).alias("minutes"))


def concentration(minutes: DataFrame, keys: list[str], player: str, value: str, share: float = 0.8
                  ) -> DataFrame:
    """Fewest players that cover a share of the minutes, and the number of players."""
    per = minutes.groupBy(*keys, player).agg(F.sum(value).alias("m"))
    order = [F.desc("m"), F.col(player)]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = per.withColumns({"c": F.sum("m").over(w), "t": F.sum("m").over(Window.partitionBy(*keys))})
    before = F.col("c") - F.col("m") < (share - 1e-12) * F.col("t")
    return d.groupBy(*keys).agg(F.sum(before.cast("bigint")).alias("n_share"), F.count(F.lit(1)).alias("players"))


def line_up_continuity(line_ups: DataFrame, keys: list[str], order: list[str], players: str,
                       chunk: Column | None = None) -> DataFrame:
    """Mean share of a starting line-up that also started the match before."""
    d = neighbour(line_ups, keys, order, {"__before": F.col(players)}, -1, chunk)
    kept = F.size(F.array_intersect("__before", players)) / F.greatest(F.size(players), F.lit(1))
    return d.filter(F.col("__before").isNotNull()).groupBy(*keys).agg(F.avg(kept).alias("continuity"),
                                                                     F.count(F.lit(1)).alias("pairs"))


# -- players -----------------------------------------------------------------------------------
def player_profile(player_zone: DataFrame, keys: list[str], nx: int, ny: int, min_n: int) -> DataFrame:
    """Zone shares as an array, centroid in grid units, for players with enough actions."""
    z, y = F.col("zone"), F.col("y")
    n = F.sum(y)
    shares = [(F.sum(F.when(z == k, y).otherwise(0.0)) / n) for k in range(nx * ny)]
    d = player_zone.groupBy(*keys).agg(
        n.alias("n"), F.array(*[F.round(s, 9) for s in shares]).alias("shares"),
        (F.sum(y * (F.floor(z / ny) + 0.5)) / n / nx).alias("cx"), (F.sum(y * (z % ny + 0.5)) / n / ny).alias("cy"))
    return d.filter(F.col("n") >= min_n)


def player_shift(player_zone: DataFrame, within: list[str], era: str, min_n: int) -> DataFrame:
    """T = half L1 distance of a player's zone shares between two eras."""
    k = [*within, era, "player_id"]
    tot = player_zone.groupBy(*k).agg(F.sum("y").alias("n")).filter(F.col("n") >= min_n)
    p = player_zone.join(tot, k).withColumn("p", F.col("y") / F.col("n"))
    pairs = pairs_of(tot, [*within, "player_id"], era, [])
    cells = pairs.withColumn(era, F.explode(F.array("a", "b"))).join(p.select(*k, "zone", "p"), k)
    signed = F.when(F.col(era) == F.col("a"), F.col("p")).otherwise(-F.col("p"))
    d = cells.groupBy(*within, "player_id", "a", "b", "zone").agg(F.abs(F.sum(signed)).alias("d"))
    return d.groupBy(*within, "player_id", "a", "b").agg((0.5 * F.sum("d")).alias("T"))


# -- networks -----------------------------------------------------------------------------------
def gini(df: DataFrame, keys: list[str], value: str, chunk: Column | None = None) -> DataFrame:
    """Gini index of non-negative values from ranks of distinct values."""
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    per = running(per, keys, [value], [Running("__lo", "sum", F.col("__c"))], chunk,
                  {"__n": ("sum", F.col("__c"))})
    # sum over rows of rank * value, ranks of a tie lo+1..lo+c
    rank_sum = F.col("__c") * F.col("__lo") + F.col("__c") * (F.col("__c") + 1) / 2.0
    s, n = F.sum(F.col(value) * F.col("__c")), F.max("__n")
    return per.groupBy(*keys).agg(
        F.when(s > 0, 2 * F.sum(rank_sum * F.col(value)) / (n * s) - (n + 1) / n).alias("gini"),
        n.alias("members"))


def network_shift(edges: DataFrame, within: list[str], era: str, min_player: int = 1) -> DataFrame:
    """T between the pass shares of two eras over edges of players common to both.

    ``edges``: within, era, player_id, recipient_id, n.
    """
    k = [*within, era]
    made = edges.groupBy(*k, "player_id").agg(F.sum("n").alias("m")).filter(F.col("m") >= min_player)
    shared = pairs_of(made, [*within, "player_id"], era, []).select(*within, "a", "b", "player_id")
    e = edges.select(*within, F.col(era).alias("__e"), "player_id", "recipient_id", "n")
    d = e.join(shared, [*within, "player_id"]).filter((F.col("__e") == F.col("a")) | (F.col("__e") == F.col("b")))
    d = d.join(shared.withColumnRenamed("player_id", "recipient_id"), [*within, "a", "b", "recipient_id"], "left_semi")
    side = Window.partitionBy(*within, "a", "b", "__e")
    d = d.withColumn("p", F.col("n") / F.sum("n").over(side))
    signed = F.when(F.col("__e") == F.col("a"), F.col("p")).otherwise(-F.col("p"))
    x = d.groupBy(*within, "a", "b", "player_id", "recipient_id").agg(F.abs(F.sum(signed)).alias("d"))
    return x.groupBy(*within, "a", "b").agg((0.5 * F.sum("d")).alias("T"))


def hub_share(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Share of passes made by the most active player."""
    per = edges.groupBy(*keys, "player_id").agg(F.sum("n").alias("n"))
    return per.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("hub_share"),
                                  F.max_by("player_id", F.struct(F.col("n"), -F.col("player_id"))).alias("hub"))


def viability(edges: DataFrame, keys: list[str], min_player: int, min_edge: int) -> DataFrame:
    """Passes, players and edges above thresholds."""
    per = edges.groupBy(*keys, "player_id").agg(F.sum("n").alias("m"))
    players = per.groupBy(*keys).agg(F.sum((F.col("m") >= min_player).cast("bigint")).alias("players_ok"))
    e = edges.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("passes"),
                                 F.sum((F.col("n") >= min_edge).cast("bigint")).alias("edges_ok"))
    return e.join(players, keys)


def pair_order(eras: DataFrame) -> DataFrame:
    """Era pairs of a club in date order, with days of overlap; ``eras``: club, coach, dates."""
    def side(tag):
        return eras.select("club", F.col("coach").alias(tag), F.col("start_date").alias(f"s_{tag}"), F.col("end_date").alias(f"e_{tag}"))
    d = side("a").join(side("b"), "club").filter(
        (F.col("s_a") < F.col("s_b")) | ((F.col("s_a") == F.col("s_b")) & (F.col("a") < F.col("b"))))
    overlap = F.greatest(F.datediff(F.least("e_a", "e_b"), F.col("s_b")) + 1, F.lit(0))
    return d.select("club", "a", "b", overlap.alias("overlap_days"), F.datediff("s_b", "e_a").alias("gap_days"))


# -- effects of events -------------------------------------------------------------------------
def matched_effects(deltas: DataFrame, unit: str, strata: list[str], value: str, min_base: int = 5) -> DataFrame:
    """Deltas of a unit's events less the mean delta of all other units' events in the same stratum.

    Adds ``base`` (null below ``min_base`` control events) and ``adjusted``. A control's mean is the stratum's total
    minus the unit's own sum, so no event meets another one; rows with a null delta are dropped, null
    strata are strata.
    """
    d = deltas.filter(F.col(value).isNotNull())
    own = d.groupBy(unit, *strata).agg(F.sum(value).alias("__sum"), F.count(value).cast("double").alias("__size"))
    rest = leave_unit_out(own, unit, strata, ["__sum", "__size"])
    base = F.when(F.col("rest___size") >= min_base, F.col("rest___sum") / F.col("rest___size"))
    out = same_keys(d, rest.select(unit, *strata, base.alias("base")), [unit, *strata])
    return out.withColumn("adjusted", F.col(value) - F.col("base"))


def unit_effects(effects: DataFrame, unit: str, event: str, metric: str, B: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Mean adjusted effect per unit and metric with an interval over redrawn events and FDR inside the metric.

    An event's metrics share its replicate weights. Events without a base count in ``events`` only.
    """
    d = effects.withColumns({"__x": F.coalesce("adjusted", F.lit(0.0)), "__k": F.col("adjusted").isNotNull().cast("double")})
    w = R.multinomial_weights(d.select(unit, event), [unit], event, B, seed)
    reps = R.replicate_sums(d.select(unit, event, metric, "__x", "__k"), w, [unit, event], [unit, metric], ["__x", "__k"])
    i = R.interval(reps.withColumn("effect", F.try_divide("__x", "__k")), [unit, metric], "effect")
    size = d.groupBy(unit, metric).agg(F.count(F.lit(1)).alias("events"), F.sum("__k").cast("bigint").alias("matched"))
    return R.fdr(size.join(i, [unit, metric]).select(unit, metric, "events", "matched", "point", "lo", "hi", "p"), [metric], "p", alpha)
