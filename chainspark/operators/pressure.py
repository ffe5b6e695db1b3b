"""Pressure on the opponent: rates by zone, over-dispersion, curves over the possession,
calibration, and difference-in-differences on subsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions.draws import SPAN, Draws, chunk_of
from chainspark.functions.scan import position, same_keys
from chainspark.operators import resample as R
from chainspark.operators.relations import weighted_slope
from chainspark.session import cut_lineage
from chainspark.space import StateSpace

EPS = 1e-12


def rival_actions(trans: DataFrame, space: StateSpace, defender: str = "opponent",
                  coach: str = "coach_faced") -> DataFrame:
    """Real actions of attackers with the zone seen from the defending club."""
    zone = space.mirror_zone(space.zone_of_state(F.col("from_state")))
    return trans.filter((F.col("action_type") != "TERMINAL") & F.col(coach).isNotNull()).select(
        "*", zone.alias("zone"), F.coalesce(F.col("under_pressure"), F.lit(False)).cast("double").alias("y"))


def zone_rates(acts: DataFrame, keys: list[str], by: str = "zone") -> DataFrame:
    return acts.groupBy(*keys, by).agg(F.sum("y").alias("pressed"), F.count(F.lit(1)).cast("double").alias("n")
                                       ).withColumn("rate", F.col("pressed") / F.col("n"))


def two_sample_g2(da: Column, na: Column, db: Column, nb: Column) -> Column:
    """Likelihood ratio of equal rates in two samples; zero when it is undefined."""
    p0 = (da + db) / F.greatest(na + nb, F.lit(EPS))

    def part(obs: Column, exp: Column) -> Column:
        return F.when(obs > 0, obs * F.log(obs / F.greatest(exp, F.lit(EPS)))).otherwise(0.0)
    g = part(da, na * p0) + part(na - da, na * (1 - p0)) + part(db, nb * p0) + part(nb - db, nb * (1 - p0))
    return F.when((na < 1) | (nb < 1) | (p0 <= 0) | (p0 >= 1), 0.0).otherwise(2 * g)


def era_pairs(cells: DataFrame, club: str, era: str) -> DataFrame:
    """Every pair a < c of eras of a club: club, a, c."""
    one = cells.select(club, F.col(era).alias("a")).distinct()
    return one.join(one.withColumnRenamed("a", "c"), club).filter("a < c")


def zone_contrast(cells: DataFrame, keys: list[str], era: str) -> DataFrame:
    """Two-sample G2 per zone of two eras. ``cells``: keys, a, c, era, zone, pressed, n; an era is a or c."""
    def s(e, c):
        return F.sum(F.when(F.col(era) == F.col(e), F.col(c)).otherwise(0.0))
    d = cells.groupBy(*keys, "a", "c", "zone").agg(s("a", "pressed").alias("da"), s("a", "n").alias("na"),
                                                   s("c", "pressed").alias("db"), s("c", "n").alias("nb"))
    return d.withColumn("g2", two_sample_g2(F.col("da"), F.col("na"), F.col("db"), F.col("nb")))


def zone_contrasts(match_cells: DataFrame, club: str, era: str) -> DataFrame:
    """Two-sample G2 per zone for every pair of eras of a club: club, a, c, zone, da, na, db, nb, g2.

    Cells are summed per era first, and repeated per pair then.
    """
    per = match_cells.groupBy(club, era, "zone").agg(F.sum("pressed").alias("pressed"), F.sum("n").alias("n"))
    of_pair = (F.col(era) == F.col("a")) | (F.col(era) == F.col("c"))
    return zone_contrast(per.join(era_pairs(per, club, era), club).filter(of_pair), [club], era)


def zone_contrast_null(match_cells: DataFrame, club: str, era: str, stratum: str, B: int, seed: int) -> DataFrame:
    """The same for every pair with its eras permuted between its matches inside a rival; b = 0 is observed."""
    pairs = era_pairs(match_cells, club, era)
    of_pair = (F.col(era) == F.col("a")) | (F.col(era) == F.col("c"))
    m = match_cells.join(pairs, club).filter(of_pair).withColumn("pair", F.concat_ws("|", "a", "c"))
    perm = R.permutation_labels(m.select("pair", stratum, "match_id", era), ["pair", stratum], "match_id", era, B, seed)
    d = m.drop(era).join(perm, ["pair", stratum, "match_id"])
    return zone_contrast(d.withColumnRenamed("b", "rep"), [club, "rep"], era).withColumnRenamed("rep", "b")


def overdispersion(match_cells: DataFrame, keys: list[str], min_n: int = 5) -> DataFrame:
    """Cochran's phi per zone over matches: mean squared standardised deviation."""
    tot = match_cells.groupBy(*keys, "zone").agg((F.sum("pressed") / F.sum("n")).alias("pi"))
    d = match_cells.join(tot, [*keys, "zone"])
    v = F.col("n") * F.col("pi") * (1 - F.col("pi"))
    use = (v > EPS) & (F.col("n") >= min_n)
    z2 = F.pow(F.col("pressed") - F.col("n") * F.col("pi"), 2) / v
    d = d.groupBy(*keys, "zone").agg(F.sum(F.when(use, z2)).alias("s"), F.sum(use.cast("int")).alias("k"))
    return d.select(*keys, "zone", (F.coalesce("s", F.lit(0.0)) / F.greatest(F.col("k") - 1, F.lit(1))).alias("phi"),
                    F.col("k").cast("bigint").alias("matches"))


def inflation(lo: Column, hi: Column, rate: Column, n: Column) -> Column:
    """Width of a resampled interval over the binomial one."""
    binom = 2 * 1.959963984540054 * F.sqrt(rate * (1 - rate) / n)
    return F.when(binom > 0, (hi - lo) / binom)


def index_curve(acts: DataFrame, keys: list[str], k_max: int | None, min_n: int) -> DataFrame:
    """Rate by action index inside the possession, thin points null; all indices without ``k_max``."""
    d = acts if k_max is None else acts.filter(F.col("k") <= k_max)
    d = d.groupBy(*keys, "k").agg(F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"))
    return d.withColumn("rate", F.when(F.col("n") >= min_n, F.col("rate")))


def index_cells(acts: DataFrame, keys: list[str]) -> DataFrame:
    """Pressed actions and actions per match and index: keys, match_id, k, s, n. Resampling moves these only."""
    return acts.groupBy(*keys, "match_id", "k").agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))


def curve_of(cells: DataFrame, keys: list[str], min_n: int) -> DataFrame:
    """The index curve of summed cells."""
    d = cells.groupBy(*keys, "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return d.select(*keys, "k", "n", F.when(F.col("n") >= min_n, F.col("s") / F.col("n")).alias("rate"))


def curve_intervals(cells: DataFrame, unit: str, min_n: int, B: int, seed: int) -> DataFrame:
    """Index curve of a unit with percentile intervals over redrawn matches: unit, k, point, lo, hi, n."""
    w = R.multinomial_weights(cells.select(unit, "match_id"), [unit], "match_id", B, seed)
    reps = R.replicate_sums(cells, w, [unit, "match_id"], [unit, "k"], ["s", "n"])
    reps = reps.withColumn("rate", F.when(F.col("n") >= min_n, F.col("s") / F.col("n")))
    i = R.interval(reps, [unit, "k"], "rate", method="percentile")
    return i.join(reps.filter("b = 0").select(unit, "k", "n"), [unit, "k"]).select(unit, "k", "point", "lo", "hi", "n")


def slope_null(cells: DataFrame, club: str, era: str, min_n: int, B: int, seed: int) -> DataFrame:
    """Difference of two eras' slopes for every pair of eras of a club, with eras permuted between the
    pair's matches: club, a, c, b, diff (b = 0 is the data).

    A match is repeated per pair that it belongs to, its actions never are: cells per match carry the sums.
    """
    eras = cells.select(club, "match_id", era).distinct()
    pairs = era_pairs(eras, club, era)
    stratum = F.concat_ws("|", "a", "c").alias("pair")
    blocks = eras.join(pairs, club).filter((F.col(era) == F.col("a")) | (F.col(era) == F.col("c"))).select(club, "a", "c", stratum, "match_id", era)
    perm = R.permutation_labels(blocks.select("pair", "match_id", era), ["pair"], "match_id", era, B, seed)
    labelled = blocks.select(club, "a", "c", "pair", "match_id").join(perm, ["pair", "match_id"]).withColumn("side", F.col(era) == F.col("a"))
    moved = labelled.select(club, "a", "c", "b", "match_id", "side").join(cells.drop(era), [club, "match_id"])
    keys = [club, "a", "c", "b"]
    slope = curve_slope(curve_of(moved, [*keys, "side"], min_n), [*keys, "side"])
    both = slope.groupBy(*keys).agg(F.max(F.when(F.col("side"), F.col("slope"))).alias("x"), F.max(F.when(~F.col("side"), F.col("slope"))).alias("y"))
    return both.select(*keys, (F.col("x") - F.col("y")).alias("diff"))


def curve_slope(curve: DataFrame, keys: list[str], k_min: int = 2) -> DataFrame:
    """Weighted slope of the curve from ``k_min`` on; needs three points."""
    d = curve.filter((F.col("k") >= k_min) & F.col("rate").isNotNull())
    s = weighted_slope(F.col("k").cast("double"), F.col("rate"), F.col("n").cast("double"))
    return d.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, s).alias("slope"))


def calibrated_difference(acts: DataFrame, keys: list[str], strata: list[str], outcome: str,
                          min_n: int) -> DataFrame:
    """Outcome when pressed minus not pressed, standardised by strata with both arms populated."""
    y = F.col(outcome).cast("double")
    on = F.col("y") == 1
    cell = acts.groupBy(*keys, *strata).agg(
        F.avg(F.when(on, y)).alias("m1"), F.avg(F.when(~on, y)).alias("m0"),
        F.sum(on.cast("bigint")).alias("n1"), F.sum((~on).cast("bigint")).alias("n0"))
    cell = cell.filter((F.col("n1") >= min_n) & (F.col("n0") >= min_n))
    w = F.col("n1") + F.col("n0")
    return cell.groupBy(*keys).agg((F.sum(w * (F.col("m1") - F.col("m0"))) / F.sum(w)).alias("diff"),
                                   F.count(F.lit(1)).alias("strata"))


#: Half the range in which the last mark's draw is expected: in standard deviations, and rows beside them.
SLACK = (6, 20)


def calibrated_null(acts: DataFrame, strata: list[str], outcome: str, min_n: int, B: int, seed: int,
                    uid: str) -> DataFrame:
    """The same difference with the pressure mark permuted inside strata; b = 0 is the data.

    ``outcome`` is true or false, ``uid`` names a row. Every replicate draws for every row, and the n1 rows of a stratum with the smallest
    draws keep the marks. Rows stay where they are: tasks count the rows below a range in which the n1-th draw is
    expected, and only the rows inside it are written and ranked. Where it lies outside (once in some hundred million
    replicates), all rows of the stratum are. Null strata are strata; rows with a null mark or outcome don't count.
    """
    y, o = F.col("y").cast("bigint"), F.col(outcome).cast("bigint")
    acts = acts.select(*strata, F.col(uid).cast("string").alias("uid"), y.alias("y"), o.alias("o")).filter("y IS NOT NULL AND o IS NOT NULL")
    acts = cut_lineage(acts)
    cell = acts.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"), F.sum("o").alias("hits"), F.sum(F.col("y") * F.col("o")).alias("both"))
    cell = cut_lineage(cell.filter((F.col("n1") >= min_n) & (F.col("n") - F.col("n1") >= min_n)))
    keys = [*strata, "b"]
    share = F.col("n1") / F.col("n")
    slack = SLACK[0] * F.sqrt(share * (1 - share) / F.col("n")) + SLACK[1] / F.col("n")
    span = F.lit(float(SPAN))
    guess = cell.select(*strata, (F.greatest(share - slack, F.lit(0.0)) * span).cast("bigint").alias("lo"),
                        (F.least(share + slack, F.lit(1.0)) * span).cast("bigint").alias("hi"))
    every = cell.select(*strata, F.explode(F.sequence(F.lit(1), F.lit(B))).alias("b"))
    null, open_ = None, None
    for whole in (False, True):
        asked = guess
        if whole:
            left = open_.select(*strata).distinct()
            asked = left.select(*strata, F.lit(0).cast("bigint").alias("lo"), F.lit(SPAN).cast("bigint").alias("hi"))
        parts = cut_lineage(_near_draws(same_keys(acts.drop("y"), asked, strata), strata, B, seed))
        below = parts.filter("u IS NULL").groupBy(*keys).agg(F.sum("rows").alias("below"), F.sum("o").alias("k_below"))
        edge = same_keys(same_keys(open_ if whole else every, below, keys), cell.drop("both"), strata)
        edge = edge.withColumn("need", F.col("n1") - F.col("below"))
        near = same_keys(parts.filter("u IS NOT NULL").select(*keys, "u", "uid", "o"), edge.select(*keys, "need"), keys)
        near = position(near, keys, ["u", "uid"], chunk_of(F.col("u")), "at")
        chosen = F.col("at") <= F.col("need")
        inside = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"), F.coalesce(F.sum(F.when(chosen, F.col("o"))), F.lit(0)).alias("k_in"))
        found = same_keys(edge, inside, keys, "left").na.fill(0, ["inside", "k_in"])
        found = cut_lineage(found.select(*keys, "n", "n1", "hits", (F.col("k_below") + F.col("k_in")).alias("k"),
                                         ((F.col("need") >= 0) & (F.col("need") <= F.col("inside"))).alias("sure")))
        null = found.filter("sure") if null is None else null.unionByName(found)
        open_ = found.filter("NOT sure").select(*keys)
        if open_.isEmpty():
            break
    reps = null.select("b", "n", "n1", "hits", "k").unionByName(cell.select(F.lit(0).alias("b"), "n", "n1", "hits", F.col("both").alias("k")))
    n0 = F.col("n") - F.col("n1")
    gap = F.col("k") / F.col("n1") - (F.col("hits") - F.col("k")) / n0
    return reps.groupBy("b").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("diff"), F.count(F.lit(1)).alias("strata"))


#: Rows that a task draws for at once, and strata whose counts it holds before it passes them on.
DRAWN_ROWS, HELD_STRATA = 40_000, 2_000


def _near_draws(acts: DataFrame, strata: list[str], B: int, seed: int) -> DataFrame:
    """Rows with their draw in every replicate b = 1..B: those inside [lo, hi), and counts of those below.

    ``acts``: strata, uid, o, lo, hi. A row of counts has a null u: rows below and their outcomes, for every stratum and replicate.
    """
    fields = [acts.schema[s] for s in strata]

    def run(batches):
        counts: dict[tuple, np.ndarray] = {}

        def out(values, b, rows, o, u, uid):
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([*values, *(pa.array(x, t) for x, t in zip((b, rows, o, u, uid), kinds))],
                                              [*strata, "b", "rows", "o", "u", "uid"])

        def passed_on(types):
            if counts:
                names = [key for key in counts for _ in range(B)]
                cells = np.concatenate(list(counts.values()))
                yield out([pa.array([k[i] for k in names], t) for i, t in enumerate(types)], np.tile(np.arange(1, B + 1), len(counts)),
                          cells[:, 0], cells[:, 1], [None] * len(cells), [None] * len(cells))
                counts.clear()

        def drawn(table):
            columns = [table.column(s).combine_chunks() for s in strata]
            values = [np.asarray(c.dictionary_encode("encode").indices) for c in columns]
            _, first, code = np.unique(np.stack(values), axis=1, return_index=True, return_inverse=True)
            code = code.reshape(-1)
            own = [counts.setdefault(tuple(c[int(i)].as_py() for c in columns), np.zeros((B, 2), np.int64)) for i in first]
            uid, o = table.column("uid").combine_chunks(), table.column("o").to_numpy()
            lo, hi = (table.column(c).to_numpy().astype(np.uint64) for c in ("lo", "hi"))
            draws = Draws(seed, uid)
            rows, at, found = [], [], []
            for b in range(1, B + 1):
                u = draws.of(b)
                under = u < lo
                n = np.bincount(code[under], minlength=len(own))
                k = np.bincount(code[under], o[under], len(own)).astype(np.int64)
                for i, cells in enumerate(own):
                    cells[b - 1] += (n[i], k[i])
                near = np.flatnonzero(~under & (u < hi))
                rows.append(near)
                at.append(np.full(len(near), b, np.int32))
                found.append(u[near])
            rows = np.concatenate(rows)
            take = pa.array(rows)
            return out([c.take(take) for c in columns], np.concatenate(at), np.ones(len(rows), np.int64), o[rows],
                       np.concatenate(found).astype(np.int64), uid.take(take))

        held, types = [], None
        for batch in batches:
            types = [batch.schema.field(s).type for s in strata]
            held.append(batch)
            if sum(x.num_rows for x in held) >= DRAWN_ROWS:
                yield drawn(pa.Table.from_batches(held))
                held.clear()
                if len(counts) > HELD_STRATA:
                    yield from passed_on(types)
        if sum(x.num_rows for x in held):
            yield drawn(pa.Table.from_batches(held))
        yield from passed_on(types)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return acts.select(*strata, "uid", "o", "lo", "hi").mapInArrow(run, f"{named}, b int, rows bigint, o bigint, u bigint, uid string")


SUBSETS = ("all", "k3", "single_live", "single_dead", "k1", "k2", "k3_only", "k4", "k5", "k6")


def subset_cells(acts: DataFrame, keys: list[str]) -> DataFrame:
    """Actions and pressed actions per subset of the possession; a row may be in several."""
    k, single = F.col("k"), F.col("length") == 1
    live = F.col("phase").isin("open", "transition")
    tags = [F.lit("all"), F.when(k >= 3, "k3"), F.when(single & live, "single_live"),
            F.when(single & ~live, "single_dead")]
    tags += [F.when(k == j, name) for j, name in zip(range(1, 7), SUBSETS[4:])]
    d = acts.withColumn("subset", F.explode(F.array_compact(F.array(*tags))))
    return d.groupBy(*keys, "subset", "zone").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"))


def pressure_did(unit: DataFrame, base: DataFrame, keys: list[str], min_cell: float = 30.0
                 ) -> DataFrame:
    """Rate of a unit minus the base at its (season, zone) mix, per zone and per subset.

    ``unit``: keys, season, subset, zone, n, s; ``base``: the same with n_b, s_b. A thin base cell
    falls back to the season's rate of the subset.
    """
    w = Window.partitionBy(*[k for k in keys if k in base.columns], "season", "subset")
    rate = F.when(F.col("n_b") < min_cell, F.try_divide(F.sum("s_b").over(w), F.sum("n_b").over(w))
                  ).otherwise(F.try_divide("s_b", "n_b"))
    b = base.withColumn("rate", rate)
    on = [k for k in keys if k in base.columns] + ["season", "subset", "zone"]
    d = unit.join(b.select(*on, "rate"), on, "left")
    part = F.when(F.col("subset") == "all", F.concat(F.lit("zone "), F.col("zone").cast("string"))
                  ).otherwise(F.col("subset"))
    miss = F.max(((F.col("n") > 0) & F.col("rate").isNull()).cast("int")) == 1
    out = d.groupBy(*keys, part.alias("part")).agg(
        (F.sum("s") / F.sum("n")).alias("unit"),
        F.when(~miss, F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("base"), F.sum("n").alias("n"))
    return out.withColumn("did", F.col("unit") - F.col("base"))


def flag_audit(events: DataFrame, flag: str) -> DataFrame:
    """Counts of true, false and null: a column without false is a flag, not a boolean."""
    label = F.when(F.col(flag).isNull(), "null").when(F.col(flag), "true").otherwise("false")
    return events.groupBy(label.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def event_inventory(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events by type with mean start, the raw material of the orientation check."""
    return events.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"), F.avg("start_x").alias("mean_x"),
                                             F.avg("start_y").alias("mean_y"))
