"""Standardisation, exact decompositions and difference-in-differences against contemporaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.operators import absorb as C
from chainspark.operators import estimate as E
from chainspark.operators import resample as R
from chainspark.operators.relations import leave_unit_out
from chainspark.session import cut_lineage
from chainspark.space import StateSpace

EPS = 1e-12


def pairs_of(df: DataFrame, within: list[str], unit: str, values: list[str]) -> DataFrame:
    """Self join of units inside ``within`` with a < b; values get suffixes _a and _b."""
    def side(tag):
        return df.select(*within, F.col(unit).alias(tag), *[F.col(v).alias(f"{v}_{tag}") for v in values])
    return side("a").join(side("b"), within).filter("a < b")


# -- rates against a season mix --------------------------------------------------------------
def standardised_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unit rate, base rate at the unit's season mix, and their difference.

    ``df``: keys, season, n_u, s_u, n_b, s_b. The base is null when it lacks a season the unit has.
    """
    rate_b = F.when(F.col("n_b") > 0, F.col("s_b") / F.col("n_b"))
    lacks = F.max(((F.col("n_u") > 0) & rate_b.isNull()).cast("int")) == 1
    n = F.sum("n_u")
    out = df.groupBy(*keys).agg(
        (F.sum("s_u") / F.greatest(n, F.lit(EPS))).alias("unit"),
        F.when(~lacks, F.sum(F.when(F.col("n_u") > 0, F.col("n_u") * rate_b)) / n).alias("base"))
    return out.withColumn("did", F.col("unit") - F.col("base"))


def against_league(per: DataFrame, team: str, season: str, n: str, s: str, unit_keys: list[str],
                   extra: list[str] = ()) -> DataFrame:
    """Join unit totals per season to the league without the unit's own club, ready for
    ``standardised_rate``. ``per``: team, unit keys, season, extra keys, n, s."""
    extra = list(extra)
    club = per.groupBy(team, season, *extra).agg(F.sum(n).alias("n"), F.sum(s).alias("s"))
    rest = leave_unit_out(club, team, [season, *extra], ["n", "s"]).select(
        team, season, *extra, F.col("rest_n").alias("n_b"), F.col("rest_s").alias("s_b"))
    unit = per.groupBy(*dict.fromkeys([team, *unit_keys]), season, *extra).agg(
        F.sum(n).alias("n_u"), F.sum(s).alias("s_u"))
    return unit.join(rest, [team, season, *extra])


# -- direct standardisation over rivals --------------------------------------------------------
def positivity(poss: DataFrame, club: str, era: str, stratum: str, min_n: int) -> DataFrame:
    """Common strata of every pair of eras and the mass they cover on both sides."""
    cell = poss.groupBy(club, era, stratum).agg(F.count(F.lit(1)).alias("n"))
    whole = cell.groupBy(club, era).agg(F.sum("n").alias("total"))
    p = pairs_of(cell.filter(F.col("n") >= min_n), [club, stratum], era, ["n"])
    p = p.groupBy(club, "a", "b").agg(F.count(F.lit(1)).alias("strata"), F.sum("n_a").alias("m_a"),
                                      F.sum("n_b").alias("m_b"))
    for tag in ("a", "b"):
        p = p.join(whole.select(club, F.col(era).alias(tag), F.col("total").alias(f"t_{tag}")), [club, tag])
    return p.select(club, "a", "b", "strata", (F.col("m_a") / F.col("t_a")).alias("cover_a"),
                    (F.col("m_b") / F.col("t_b")).alias("cover_b"))


def stratum_means(poss: DataFrame, club: str, era: str, stratum: str, metric: str) -> DataFrame:
    return poss.groupBy(club, era, stratum).agg(F.avg(metric).alias("m"), F.count(F.lit(1)).alias("n"))


def standardised_difference(means: DataFrame, club: str, era: str, stratum: str, min_n: int,
                            keys: list[str] = (), min_strata: int = 3, min_cover: float = 0.85
                            ) -> DataFrame:
    """Uniform-weight standardised means over the common support, with the crude difference.

    ``means``: keys, club, era, stratum, m, n. Effective n equals the number of strata under
    uniform weights. Pairs with little support stay, marked not interpretable.
    """
    keys = list(keys)
    whole = means.groupBy(*keys, club, era).agg(
        F.sum("n").alias("total"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("crude"))
    p = pairs_of(means.filter(F.col("n") >= min_n), [*keys, club, stratum], era, ["m", "n"])
    p = p.groupBy(*keys, club, "a", "b").agg(
        F.count(F.lit(1)).alias("strata"), F.avg("m_a").alias("std_a"), F.avg("m_b").alias("std_b"),
        F.sum("n_a").alias("in_a"), F.sum("n_b").alias("in_b"))
    for tag in ("a", "b"):
        p = p.join(whole.select(*keys, club, F.col(era).alias(tag), F.col("total").alias(f"t_{tag}"),
                                F.col("crude").alias(f"crude_{tag}")), [*keys, club, tag])
    cover = F.least(F.col("in_a") / F.col("t_a"), F.col("in_b") / F.col("t_b"))
    return p.select(*keys, club, "a", "b", "strata", F.col("strata").cast("double").alias("n_eff"),
                    cover.alias("cover"), (F.col("std_a") - F.col("std_b")).alias("diff"),
                    (F.col("crude_a") - F.col("crude_b")).alias("crude"),
                    ((F.col("strata") >= min_strata) & (cover >= min_cover)).alias("interpretable"))


def standardised_bootstrap(poss: DataFrame, club: str, era: str, stratum: str, metric: str,
                           min_n: int, B: int, seed: int) -> DataFrame:
    """Replicates of the standardised difference: possessions redrawn inside (era, stratum)."""
    s = [club, era, stratum]
    d = poss.select(*s, "poss_uid", F.col(metric).cast("double").alias("y")).withColumn("n", F.lit(1.0))
    w = R.multinomial_weights(d, s, "poss_uid", B, seed)
    r = R.replicate_sums(d, w, [*s, "poss_uid"], s, ["n", "y"])
    means = r.select(*s, "b", (F.col("y") / F.col("n")).alias("m"), F.col("n").cast("bigint").alias("n"))
    return standardised_difference(means.withColumnRenamed("b", "rep"), club, era, stratum, min_n,
                                   ["rep"]).withColumnRenamed("b", "era_b").withColumnRenamed("rep", "b")


# -- contemporaneous base ----------------------------------------------------------------------
def contemporaneous_cells(cells: DataFrame, mix: DataFrame, keys: list[str]) -> DataFrame:
    """League-without-the-club cells mixed to each unit's season mix.

    ``cells``: team, season (+ replicate keys in ``keys``), i, j, n. ``mix``: team, coach, season,
    keys, w. Every season is divided by its own total first, so a season with more events does
    not weigh more.
    """
    by = [*keys, "season", "i", "j"]
    # absent own cells must still see the league's: complete over teams of the season
    total = cells.groupBy(*by).agg(F.sum("n").alias("all_n"))
    teams = mix.select(*keys, "team", "season").distinct()
    rest = total.join(teams, [*keys, "season"]).join(
        cells.select(*by, "team", F.col("n").alias("own")), [*by, "team"], "left")
    rest = rest.withColumn("r", F.col("all_n") - F.coalesce("own", F.lit(0.0)))
    size = rest.groupBy(*keys, "team", "season").agg(F.sum("r").alias("s"))
    share = Window.partitionBy(*keys, "team", "coach")
    m = mix.withColumn("w", F.col("w") / F.sum("w").over(share))
    m = m.join(size, [*keys, "team", "season"])
    d = rest.filter("r > 0").join(m, [*keys, "team", "season"])
    return d.groupBy(*keys, "team", "coach", "i", "j").agg(
        F.sum(F.col("w") * F.col("r") / F.col("s")).alias("n"))


def chain_did(trans: DataFrame, space: StateSpace, B: int, seed: int) -> DataFrame:
    """Log ratio of e_t, p_goal, p_shot to contemporaries for every (team, coach) and replicate.

    Unit matches are redrawn inside (team, coach), league matches inside a season; league
    weights are keyed by season and replicate only, so all units of a club share them. The base
    uses the unit's start weights.
    """
    unit, league = ["team", "coach"], ["season"]
    c = cut_lineage(E.count_cells(trans, ("team", "coach", "season", "match_id")))
    first = trans.groupBy(*unit, "match_id", "poss_uid").agg(
        F.min_by("from_state", "event_index").alias("i"))
    a = first.groupBy(*unit, "match_id", "i").agg(F.count(F.lit(1)).cast("double").alias("a"))
    blocks = trans.select(*unit, *league, "match_id").distinct()
    wu = R.multinomial_weights(blocks.select(*unit, "match_id"), unit, "match_id", B, seed)
    wl = R.multinomial_weights(blocks.select(*league, "match_id"), league, "match_id", B, seed + 1)
    on = [*unit, "match_id"]
    own = cut_lineage(R.replicate_sums(c, wu, on, [*unit, "season", "i", "j"], ["n"]))
    alpha = R.replicate_sums(a, wu, on, [*unit, "i"], ["a"])
    mix = own.groupBy("b", *unit, "season").agg(F.sum("n").alias("w"))
    lc = c.groupBy("team", "season", "match_id", "i", "j").agg(F.sum("n").alias("n"))
    lc = cut_lineage(R.replicate_sums(lc, wl, ["season", "match_id"], ["team", "season", "i", "j"], ["n"]))
    base = contemporaneous_cells(lc, mix, ["b"])
    mine = own.groupBy("b", *unit, "i", "j").agg(F.sum("n").alias("n"))
    keys = [*unit, "b", "role"]
    both = mine.withColumn("role", F.lit("unit")).unionByName(base.withColumn("role", F.lit("base")))
    al = alpha.withColumn("role", F.explode(F.array(F.lit("unit"), F.lit("base"))))
    s = C.scalars(E.mle(both, keys), al, keys, space, uniform_empty=True)
    names = ("e_t", "p_goal", "p_shot")
    wide = s.groupBy(*unit, "b").agg(*[
        F.max(F.when(F.col("role") == r, F.col(n))).alias(f"{n}_{r}") for r in ("unit", "base") for n in names])
    return wide.select(*unit, "b", *[S.log_ratio(F.col(f"{n}_unit"), F.col(f"{n}_base")).alias(f"d_{n}") for n in names],
                       *[F.when(F.col(f"{n}_unit") > 0, F.log(f"{n}_unit")).alias(f"l_{n}") for n in names])


def did_pairs(reps: DataFrame, club: str, unit: str, did: str, crude: str, alpha: float = 0.05
              ) -> DataFrame:
    """Pairs of units of a club: did and crude log differences with intervals, p, q and verdicts."""
    reps = cut_lineage(reps)
    p = pairs_of(reps.withColumnRenamed("b", "rep"), [club, "rep"], unit, [did, crude]).withColumnRenamed("b", "c")
    p = p.select(club, "a", "c", F.col("rep").alias("b"),
                 (F.col(f"{did}_a") - F.col(f"{did}_b")).alias("did"),
                 (F.col(f"{crude}_a") - F.col(f"{crude}_b")).alias("crude"))
    keys = [club, "a", "c"]
    d = R.interval(p, keys, "did")
    raw = p.filter("b = 0").select(*keys, F.col("crude").alias("crude"))
    out = R.fdr(d, [], "p", alpha).join(raw, keys)
    return out.select(*keys, F.expm1("point").alias("rel"), F.expm1("lo").alias("rel_lo"),
                      F.expm1("hi").alias("rel_hi"), "p", "q", "rejected", F.expm1("crude").alias("rel_crude"),
                      (F.signum("point") != F.signum("crude")).alias("sign_change"))


def parallel_trend(per: DataFrame, keys: list[str], value: str, base: str, order: str) -> DataFrame:
    """Slope of (value - base) on the chronological season order, per key."""
    return per.groupBy(*keys).agg(
        F.regr_slope(F.col(value) - F.col(base), F.col(order).cast("double")).alias("slope"),
        F.count(F.lit(1)).alias("seasons"))


def slope_intervals(per_match: DataFrame, unit: str, B: int, seed: int) -> DataFrame:
    """Basic interval of a unit's parallel-trend slope, its matches redrawn.

    ``per_match``: unit, match_id, season, season_order, c, p (numerator and denominator of the measure). The base
    is the ratio of all other units in the season, from totals minus own sums.
    """
    from chainspark.operators import resample as R
    from chainspark.operators.relations import leave_unit_out

    own = per_match.groupBy(unit, "season").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    base = leave_unit_out(own, unit, ["season"], ["c", "p"]).select(
        unit, "season", (F.col("rest_c") / F.greatest(F.col("rest_p"), F.lit(1.0))).alias("base"))
    w = R.multinomial_weights(per_match, [unit], "match_id", B, seed)
    reps = R.replicate_sums(per_match, w, [unit, "match_id"], [unit, "season", "season_order"], ["c", "p"])
    reps = reps.withColumn("own", F.col("c") / F.greatest(F.col("p"), F.lit(1.0))).join(base, [unit, "season"])
    return R.interval(parallel_trend(reps, [unit, "b"], "own", "base", "season_order"), [unit], "slope")


# -- context adjustment --------------------------------------------------------------------------
def context_adjustment(df: DataFrame, keys: list[str], level_a: str, level_b: str) -> DataFrame:
    """[M_u(A) - M_u(B)] - [M_base(A) - M_base(B)], base at the unit's season mix inside each level.

    ``df``: keys, level, season, n_u, s_u, n_b, s_b.
    """
    r = standardised_rate(df.filter(F.col("level").isin(level_a, level_b)), [*keys, "level"])
    def at(level, c):
        return F.max(F.when(F.col("level") == level, F.col(c)))
    out = r.groupBy(*keys).agg((at(level_a, "unit") - at(level_b, "unit")).alias("adjust_unit"),
                               (at(level_a, "base") - at(level_b, "base")).alias("adjust_base"))
    return out.withColumn("theta", F.col("adjust_unit") - F.col("adjust_base"))


def stratified_theta(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean change of a unit minus the league at the unit's strata, with the discarded weight.

    ``df``: keys, stratum, w_u, d_u (weighted sum of changes), w_b, d_b.
    """
    ok = (F.col("w_u") > 0) & (F.col("w_b") > 0)
    out = df.groupBy(*keys).agg(
        (F.sum("d_u") / F.sum("w_u")).alias("unit"),
        (F.sum(F.when(ok, F.col("w_u") * F.col("d_b") / F.col("w_b"))) / F.sum(F.when(ok, F.col("w_u")))).alias("league"),
        (1 - F.coalesce(F.sum(F.when(ok, F.col("w_u"))), F.lit(0.0)) / F.sum("w_u")).alias("discarded"))
    return out.withColumn("theta", F.col("unit") - F.col("league"))


# -- exact decompositions --------------------------------------------------------------------------
def kitagawa(poss: DataFrame, keys: list[str], era: str, bucket: str, value: str) -> DataFrame:
    """Split the difference of possession means into within-bucket effect and composition."""
    cell = poss.groupBy(*keys, era, bucket).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"))
    cell = cell.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, era)))
    eras = cell.select(*keys, era).distinct()
    pairs = pairs_of(eras, keys, era, [])
    buckets = cell.select(*keys, bucket).distinct()
    grid = pairs.join(buckets, keys)
    for tag in ("a", "b"):
        grid = grid.join(cell.select(*keys, F.col(era).alias(tag), bucket, F.col("w").alias(f"w_{tag}"),
                                     F.col("m").alias(f"m_{tag}")), [*keys, tag, bucket], "left")
    zero = F.lit(0.0)
    wa, wb = F.coalesce("w_a", zero), F.coalesce("w_b", zero)
    ok = F.col("m_a").isNotNull() & F.col("m_b").isNotNull()
    within = F.sum(F.when(ok, (wa + wb) / 2 * (F.col("m_a") - F.col("m_b"))).otherwise(0.0))
    comp = F.sum(F.when(ok, (wa - wb) * (F.col("m_a") + F.col("m_b")) / 2).otherwise(0.0))
    total = F.sum(wa * F.coalesce("m_a", zero) - wb * F.coalesce("m_b", zero))
    return grid.groupBy(*keys, "a", "b").agg(within.alias("within"), comp.alias("composition"),
                                             total.alias("total"))


def covariance_identity(poss: DataFrame, keys: list[str], length: str, value: str) -> DataFrame:
    """Rate per action minus rate per possession equals Cov(L, m) / E[L]."""
    L, m = F.col(length).cast("double"), F.col(value)
    return poss.groupBy(*keys).agg(
        F.avg(m).alias("per_possession"), (F.sum(L * m) / F.sum(L)).alias("per_action"),
        (F.covar_pop(L, m) / F.avg(L)).alias("cov_over_mean"))


def occupancy_excess(match_zone: DataFrame, league: DataFrame, keys: list[str], weight: Column
                     ) -> DataFrame:
    """Zone share of a unit minus the league share of its matches' seasons.

    ``match_zone``: keys, match_id, season, zone, y; ``league``: season, zone, share. Matches
    carry a weight, so a replicate only changes weights.
    """
    d = match_zone.withColumn("__w", weight)
    own = d.groupBy(*keys, "zone").agg(F.sum(F.col("__w") * F.col("y")).alias("y"))
    by_season = d.groupBy(*keys, "season").agg(F.sum(F.col("__w") * F.col("y")).alias("n"))
    ref = by_season.join(league, "season").groupBy(*keys, "zone").agg(
        F.sum(F.col("n") * F.col("share")).alias("e"))
    both = ref.join(own, [*keys, "zone"], "full")
    n = F.sum(F.coalesce("y", F.lit(0.0))).over(Window.partitionBy(*keys))
    return both.select(*keys, "zone", ((F.coalesce("y", F.lit(0.0)) - F.coalesce("e", F.lit(0.0))) / n).alias("excess"))


def total_shift(excess: DataFrame, within: list[str], era: str) -> DataFrame:
    """T = half the L1 distance between the excess maps of every pair of eras."""
    p = pairs_of(excess, [*within, "zone"], era, ["excess"])
    return p.groupBy(*within, "a", "b").agg(
        (0.5 * F.sum(F.abs(F.col("excess_a") - F.col("excess_b")))).alias("T"))


def midpoint_decomposition(player_zone: DataFrame, league: DataFrame, keys: list[str], era: str,
                           min_actions: int) -> DataFrame:
    """Change of occupancy excess as use (same players elsewhere) plus composition.

    ``player_zone``: keys, era, player_id, zone, y; ``league``: keys, era, zone, share. Shared
    players have at least ``min_actions`` in both eras. delta = use + composition exactly.
    """
    tot = player_zone.groupBy(*keys, era, "player_id").agg(F.sum("y").alias("n"))
    size = tot.groupBy(*keys, era).agg(F.sum("n").alias("total"))
    tot = tot.join(size, [*keys, era]).withColumn("w", F.col("n") / F.col("total"))
    shared = pairs_of(tot.filter(F.col("n") >= min_actions), [*keys, "player_id"], era, ["w", "n"])
    zones = league.select(*keys, era, "zone", "share")
    delta = player_zone.groupBy(*keys, era, "zone").agg(F.sum("y").alias("y")).join(size, [*keys, era])
    delta = zones.join(delta, [*keys, era, "zone"], "left").withColumn(
        "x", F.coalesce(F.col("y") / F.col("total"), F.lit(0.0)) - F.col("share"))
    delta = pairs_of(delta, [*keys, "zone"], era, ["x"]).withColumn("delta", F.col("x_b") - F.col("x_a"))
    g = shared
    for tag in ("a", "b"):
        g = g.join(zones.select(*keys, F.col(era).alias(tag), "zone", F.col("share").alias(f"l_{tag}")),
                   [*keys, tag] if tag == "a" else [*keys, tag, "zone"])
        g = g.join(player_zone.select(*keys, F.col(era).alias(tag), "player_id", "zone", F.col("y").alias(f"y_{tag}")),
                   [*keys, tag, "player_id", "zone"], "left")
    za = F.coalesce("y_a", F.lit(0.0)) / F.col("n_a") - F.col("l_a")
    zb = F.coalesce("y_b", F.lit(0.0)) / F.col("n_b") - F.col("l_b")
    use = g.groupBy(*keys, "a", "b", "zone").agg(F.sum((F.col("w_a") + F.col("w_b")) / 2 * (zb - za)).alias("use"))
    d = delta.join(use, [*keys, "a", "b", "zone"], "left").withColumn("use", F.coalesce("use", F.lit(0.0)))
    comp = F.col("delta") - F.col("use")
    nu, nc = F.sum(F.abs("use")), F.sum(F.abs(comp))
    return d.groupBy(*keys, "a", "b").agg(
        (0.5 * F.sum(F.abs("delta"))).alias("T"), (0.5 * nu).alias("U"), (0.5 * nc).alias("C"),
        F.when(nu + nc > 0, nu / (nu + nc)).alias("phi_u"))


# -- profiles ----------------------------------------------------------------------------------------
def profile_map(units: DataFrame, key: str, features: list[str], k: int = 2) -> DataFrame:
    """Standardised features projected on their first components, sign fixed by the largest loading.

    Moments and the feature covariance are aggregates; only the features x features matrix
    (bounded by the number of columns) reaches the driver.
    """
    import numpy as np

    stats = [F.avg(c).alias(f"m_{c}") for c in features] + [F.stddev_pop(c).alias(f"s_{c}") for c in features]
    row = units.agg(*stats).first()
    z = {c: (F.col(c) - row[f"m_{c}"]) / (row[f"s_{c}"] or 1.0) for c in features}
    d = units.select(key, *[z[c].alias(c) for c in features])
    prods = [F.avg(F.col(a) * F.col(b)).alias(f"{i}_{j}")
             for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    cov = d.agg(*prods).first()
    p = len(features)
    M = np.array([[cov[f"{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    values, vectors = np.linalg.eigh(M)
    top = vectors[:, np.argsort(values)[::-1][:k]]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(k)])
    axes = [sum((F.col(c) * float(top[i, a]) for i, c in enumerate(features)), F.lit(0.0)).alias(f"pc{a + 1}")
            for a in range(k)]
    return d.select(key, *features, *axes)


def wide_profile_map(units: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """profile_map for array columns: scaler and PCA of the ML library, sign fixed the same way."""
    import numpy as np
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = units.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    model = Pipeline(stages=[
        StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
        PCA(k=k, inputCol="z", outputCol="pc")]).fit(d)
    loads = model.stages[1].pc.toArray()
    sign = np.sign(loads[np.abs(loads).argmax(0), np.arange(k)])
    out = vector_to_array("pc")
    return model.transform(d).select(key, *[(out[a] * float(sign[a])).alias(f"pc{a + 1}") for a in range(k)])


def profile_distances(profile: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Euclidean distance of every pair of unit profiles and its share among all pairs."""
    from chainspark.operators.relations import midrank

    vec = F.array(*[F.col(c) for c in features])
    v = profile.select(key, vec.alias("v"))
    a, b = v.select(F.col(key).alias("a"), F.col("v").alias("va")), v.select(F.col(key).alias("b"), F.col("v").alias("vb"))
    sq = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    d = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.sqrt(sq), 9).alias("distance"))
    d = midrank(d.withColumn("__one", F.lit(1)), ["__one"], "distance", "pos", F.floor(F.col("distance") * 16))
    return d.select("a", "b", "distance", F.col("pos_share").alias("percentile"))


def points() -> Column:
    """Points of a match row with columns scored and conceded: 3, 1 or 0."""
    return (F.when(F.col("scored") > F.col("conceded"), 3).when(F.col("scored") == F.col("conceded"), 1)
            .otherwise(0))
