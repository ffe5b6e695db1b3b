"""Comparisons of units on their matrices: fingerprints, cell intervals, context contrasts,
regime series, divergence, heterogeneity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions.draws import uniform
from chainspark.functions.scan import position
from chainspark.operators import estimate as E
from chainspark.operators import resample as R
from chainspark.session import cut_lineage, spread
from chainspark.space import StateSpace

EPS = 1e-12


def g2_rows(cells: DataFrame, q: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """2 sum n log(n / (n_i q)) per row; only observed cells contribute."""
    d = cells.withColumn("ni", E.row_total(keys)).join(q, on)
    term = F.col("n") * F.log(F.greatest(F.col("n"), F.lit(EPS))
                              / F.greatest(F.col("ni") * F.col("q"), F.lit(EPS)))
    return d.filter("n > 0").groupBy(*keys, "i").agg((2 * F.sum(term)).alias("g2"),
                                                     F.max("ni").alias("n"))


def fingerprint(focus: DataFrame, base: DataFrame, q: DataFrame, B: int, seed: int,
                min_row: int = 15, alpha: float = 0.05) -> DataFrame:
    """Rows where a focus leaves the reference: G2 against a null of base possessions.

    Each replicate draws as many base possessions as the focus has: slot s of replicate b takes
    base rank u mod n. Base cells are aggregated per possession before the replicates.
    """
    observed = g2_rows(E.count_cells(focus), q, [], ["i", "j"])
    m = focus.select("poss_uid").distinct().agg(F.count(F.lit(1)).alias("m"))
    ranked = R.ranked_blocks(base.withColumn("s", F.lit(0)), ["s"], "poss_uid", seed)
    size = ranked.agg(F.count(F.lit(1)).alias("n"))
    slots = m.crossJoin(size).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B))))
    # slots are split in blocks of 1000 before they are opened, so no task opens them all
    slots = slots.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / 1000))))
    slots = spread(slots, "b", "part").withColumn("slot", F.explode(F.sequence(
        F.col("part") * 1000, F.least(F.col("part") * 1000 + 999, F.col("m") - 1))))
    drawn = slots.select("b", (R.draw(seed, F.col("b"), F.col("slot")) % F.col("n")).alias("rank"))
    drawn = drawn.groupBy("rank", "b").agg(F.count(F.lit(1)).alias("w")).groupBy("rank").agg(
        F.collect_list(F.struct("b", "w")).alias("w"))
    # the planner takes opened rows for few and would send them, and the possessions, to the driver
    weights = ranked.join(drawn.hint("merge"), "rank").select("poss_uid", "w").hint("merge")
    null = R.replicate_sums(E.count_cells(base, ("poss_uid",)), weights, ["poss_uid"], ["i", "j"], ["n"])
    null = g2_rows(null, q, ["b"], ["i", "j"])
    hits = observed.select("i", F.col("g2").alias("o")).join(null, "i").groupBy("i").agg(
        F.sum((F.col("g2") >= F.col("o")).cast("bigint")).alias("k"))
    d = observed.join(hits, "i", "left")
    d = d.withColumn("tested", F.col("n") >= min_row)
    p = (1 + F.coalesce("k", F.lit(0))) / (1.0 + B)
    d = d.withColumn("p", F.when(F.col("tested"), p).otherwise(1.0)).drop("k")
    return R.fdr(d, [], "p", alpha, F.col("tested"))


def cell_differences(cells: DataFrame, q: DataFrame, lam, space: StateSpace, keys: list[str]
                     ) -> DataFrame:
    """P*(focus; shrunk to base) - P(base) per replicate; point and replicates share this path.

    ``cells``: keys, role, i, j, n. The base falls back to the reference q on empty rows.
    """
    role = F.col("role")
    units = cells.select(*keys).distinct()
    grid = F.broadcast(space.grid(cells.sparkSession))
    zero = units.crossJoin(grid).withColumns({"f": F.lit(0.0), "g": F.lit(0.0)})
    wide = cells.select(*keys, "i", "j", F.when(role == "focus", F.col("n")).otherwise(0.0).alias("f"),
                        F.when(role == "base", F.col("n")).otherwise(0.0).alias("g"))
    wide = wide.unionByName(zero).groupBy(*keys, "i", "j").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    base = E.shrink(wide.withColumnRenamed("g", "n").join(F.broadcast(q), ["i", "j"]), 0.0, space, keys)
    d = base.withColumn("fi", F.sum("f").over(Window.partitionBy(*keys, "i")))
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    star = F.when(d["fi"] + lam <= EPS, F.col("p")).otherwise(
        (F.col("f") + lam * F.col("p")) / F.greatest(F.col("fi") + lam, F.lit(EPS)))
    return d.select(*keys, "i", "j", (star - F.col("p")).alias("diff"))


def context_contrast(cells: DataFrame, q: DataFrame, lam: float, level: str, space: StateSpace,
                     keys: list[str] = ()) -> DataFrame:
    """Total variation between the matrices of every pair of context levels."""
    keys = list(keys)
    full = E.complete(cells, space, [*keys, level]).join(F.broadcast(q), ["i", "j"])
    p = E.shrink(full, lam, space, [*keys, level]).select(*keys, level, "i", "j", "n", "p")
    p = p.withColumn("ni", E.row_total([*keys, level]))
    a = p.select(*keys, "i", "j", F.col(level).alias("a"), F.col("p").alias("pa"), F.col("ni").alias("na"))
    b = p.select(*keys, "i", "j", F.col(level).alias("b"), F.col("p").alias("pb"), F.col("ni").alias("nb"))
    rows = a.join(b, [*keys, "i", "j"]).filter("a < b").groupBy(*keys, "a", "b", "i").agg(
        (0.5 * F.sum(F.abs(F.col("pa") - F.col("pb")))).alias("tv"), F.max("na").alias("na"),
        F.max("nb").alias("nb"))
    w = F.col("na") + F.col("nb")
    return rows.groupBy(*keys, "a", "b").agg(
        (F.sum(F.col("tv") * w) / F.greatest(F.sum(w), F.lit(EPS))).alias("tv_weighted"),
        F.max("tv").alias("tv_max"), F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"))


def context_null(trans: DataFrame, q: DataFrame, lam: float, level: str, B: int, seed: int,
                 space: StateSpace, keys: list[str]) -> DataFrame:
    """Context contrast against labels permuted between possessions."""
    label = trans.groupBy(*keys, "poss_uid").agg(F.min_by(level, "event_index").alias(level))
    perm = R.permutation_labels(label, list(keys), "poss_uid", level, B, seed)
    own = E.count_cells(trans, (*keys, "poss_uid"))
    cells = own.join(perm.hint("merge"), [*keys, "poss_uid"]).groupBy(*keys, "b", level, "i", "j").agg(F.sum("n").alias("n"))
    tv = context_contrast(cells, q, lam, level, space, [*keys, "b"]).withColumnRenamed("b", "rep")
    return tv


def tv_excess(cells: DataFrame, null: DataFrame, q: DataFrame, keys: list[str], min_row: int,
              min_z: float, top: int) -> DataFrame:
    """Effect-size fingerprint: row TV to the reference, minus its null median, filtered by z."""
    def tv(c: DataFrame, k: list[str]) -> DataFrame:
        d = c.withColumn("ni", E.row_total(k)).join(F.broadcast(q), ["i", "j"])
        # absent cells add their reference mass: sum|p-q| = sum over seen + (1 - seen q)
        seen = F.sum(F.abs(F.col("n") / F.col("ni") - F.col("q")))
        return d.groupBy(*k, "i").agg((0.5 * (seen + 1 - F.sum("q"))).alias("tv"), F.max("ni").alias("n"))
    obs = tv(cells, keys)
    nul = tv(null, [*keys, "b"]).groupBy(*keys, "i").agg(
        F.percentile("tv", F.lit(0.5)).alias("median"), F.stddev_pop("tv").alias("sd"),
        F.avg("tv").alias("mean"))
    d = obs.join(nul, [*keys, "i"]).withColumns({
        "excess": F.col("tv") - F.col("median"),
        "z": F.when(F.col("sd") > 0, (F.col("tv") - F.col("mean")) / F.col("sd"))})
    d = d.filter((F.col("n") >= min_row) & (F.col("z") >= min_z))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("excess", 9)), "i")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("sd", "mean")


def regime_series(cells: DataFrame, order: DataFrame, window: int, space: StateSpace,
                  keys: list[str]) -> DataFrame:
    """TV between the matrices of the ``window`` matches before and from each match on.

    ``cells``: keys, match_id, i, j, n; ``order``: keys, match_id, pos (dense from 1), size. A
    match contributes to the 2 x window splits around it: it is repeated per split, so no
    sliding frame over a whole club is needed.
    """
    d = cells.join(order, [*keys, "match_id"])
    shift = F.explode(F.sequence(F.lit(-window), F.lit(window - 1)))
    # split s compares positions s-window..s-1 with s..s+window-1
    d = d.withColumn("__o", shift).withColumn("split", F.col("pos") - F.col("__o"))
    d = d.filter((F.col("split") > window) & (F.col("split") <= F.col("size") - window + 1))
    k = [*keys, "split"]
    right = F.col("__o") >= 0
    c = d.groupBy(*k, "i", "j").agg(F.sum(F.when(right, 0.0).otherwise(F.col("n"))).alias("l"),
                                    F.sum(F.when(right, F.col("n")).otherwise(0.0)).alias("r"))
    w = Window.partitionBy(*k, "i")
    c = c.withColumns({"li": F.sum("l").over(w), "ri": F.sum("r").over(w)})
    s = float(space.n_states)
    pl = F.when(F.col("li") > 0, F.col("l") / F.col("li")).otherwise(1 / s)
    pr = F.when(F.col("ri") > 0, F.col("r") / F.col("ri")).otherwise(1 / s)
    rows = c.withColumns({"pl": pl, "pr": pr}).groupBy(*k, "i").agg(
        F.sum(F.abs(F.col("pl") - F.col("pr"))).alias("d"), F.max("li").alias("li"),
        F.max("ri").alias("ri"), F.count(F.lit(1)).alias("cells"))
    # a one-sided row is uniform on the empty side: add its mass on unseen cells
    one_sided = (F.col("li") == 0) | (F.col("ri") == 0)
    rest = F.when(one_sided, (s - F.col("cells")) / s).otherwise(0.0)
    tv = 0.5 * (F.col("d") + rest)
    m = F.col("li") + F.col("ri")
    return rows.groupBy(*k).agg((F.sum(tv * m) / F.sum(m)).alias("tv_weighted"))


def match_order(matches: DataFrame, keys: list[str], order: list[str], chunk=None) -> DataFrame:
    return position(matches, keys, order, chunk, "pos", "size")


def js_divergence(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Jensen-Shannon divergence (base 2), TV and KL between rows pa and pb, weighted by w.

    ``pairs``: keys, i, j, pa, pb, w (row weight); cells absent on both sides are not needed.
    """
    m = (F.col("pa") + F.col("pb")) / 2

    def part(p: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    kl = F.when(F.col("pa") > 0, F.col("pa") * F.log(F.col("pa") / F.greatest(F.col("pb"), F.lit(EPS)))
                ).otherwise(0.0)
    rows = pairs.groupBy(*keys, "i").agg(
        F.sum(0.5 * part(F.col("pa")) + 0.5 * part(F.col("pb"))).alias("js"),
        (0.5 * F.sum(F.abs(F.col("pa") - F.col("pb")))).alias("tv"), F.sum(kl).alias("kl"),
        F.max("w").alias("w"))
    return rows.groupBy(*keys).agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
                                     for c in ("js", "tv", "kl")])


def length_fit(lengths: DataFrame, law: DataFrame, keys: list[str], t_min: int, B: int, seed: int
               ) -> DataFrame:
    """Goodness of fit of the chain's length law: KS with p from redrawn lengths.

    Replicate lengths are inverse-CDF draws from the closed-form law, whose closing cell takes all lengths
    beyond its last one on both sides. Lengths are drawn per
    (key, replicate, possession number) and folded to a histogram at once.
    """
    from chainspark.operators.absorb import closed_lengths, condition_from

    # results tables of a few rows per key, each read several times below
    cond = cut_lineage(condition_from(law, keys, t_min))
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cdf = cond.withColumn("cdf", F.sum("pmf").over(w)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("k", "cdf"))).alias("cdf"))  # kmax entries per key
    obs = cut_lineage(closed_lengths(lengths.filter(F.col("length") >= t_min), cond, keys))
    n = obs.groupBy(*keys).agg(F.sum("possessions").alias("n"))
    draws = n.join(cdf, keys).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B))))
    draws = draws.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))))
    draws = spread(draws, *keys, "b", "part").withColumn("s", F.explode(F.sequence(
        F.col("part") * 1000, F.least(F.col("part") * 1000 + 999, F.col("n") - 1))))
    u = uniform(seed, *[F.col(k) for k in keys], F.col("b"), F.col("s"))
    # a draw above the last sum, which rounding leaves short of one, falls in the closing cell; the draw is
    # bound to a name, so that its hash is taken once and not for every cell
    at = F.transform(F.array(u), lambda v: F.least(F.size(F.filter("cdf", lambda x: x["cdf"] < v)), F.size("cdf") - 1))
    drawn = draws.withColumn("k", F.col("cdf")[at[0]]["k"])
    rep = drawn.groupBy(*keys, "b", "k").agg(F.count(F.lit(1)).alias("c"))
    real = obs.select(*keys, F.lit(0).alias("b"), F.col("length").alias("k"), F.col("possessions").alias("c"))
    all_ = rep.unionByName(real)
    share = F.col("c") / F.sum("c").over(Window.partitionBy(*keys, "b"))
    all_ = all_.withColumn("o", share)
    reps = n.select(*keys).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(B))))
    grid = reps.join(cond.select(*keys, "k", "pmf"), keys)
    g = grid.join(all_.select(*keys, "b", "k", "o"), [*keys, "b", "k"], "left")
    wk = Window.partitionBy(*keys, "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum(F.coalesce("o", F.lit(0.0))).over(wk) - F.sum("pmf").over(wk))
    ks = g.withColumn("gap", gap).groupBy(*keys, "b").agg(F.max("gap").alias("ks"))
    return R.permutation_p(ks, keys, "ks").select(*keys, F.col("observed").alias("ks"), "p")


def heterogeneity(units: DataFrame, keys: list[str], mean: str, n: str, var: str) -> DataFrame:
    """Between-unit variance of means: DerSimonian-Laird, simple moments, and the mixed-weight
    estimator kept for comparison. ``var`` is the variance of one observation."""
    y, w, m = F.col(mean), F.col(n) / F.col(var), F.col(n)
    s = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"),
        F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"),
        F.var_samp(y).alias("vy"), F.avg(F.col(var) / m).alias("se2"), F.sum(m).alias("sn"),
        F.sum(m * y).alias("sny"), F.sum(m * y * y).alias("snyy"))
    q = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    c = F.col("sw") - F.col("sww") / F.col("sw")
    spread = F.col("snyy") / F.col("sn") - F.pow(F.col("sny") / F.col("sn"), 2)
    zero = F.lit(0.0)
    return s.select(*keys, "k", q.alias("q_stat"),
                    F.greatest(zero, (q - (F.col("k") - 1)) / c).alias("tau2_dl"),
                    F.greatest(zero, F.col("vy") - F.col("se2")).alias("tau2_moments"),
                    F.greatest(zero, spread - F.col("se2")).alias("tau2_mixed"))
