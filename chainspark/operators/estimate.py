"""Counts, maximum likelihood, shrinkage to a reference and the choice of its strength.

Cells are long: keys, i, j, n. Rows of a transition matrix hold at most ``n_states`` cells, so
windows over (keys, i) are bounded by the state space whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions.draws import chunk_of, draw
from chainspark.functions.scan import position
from chainspark.operators import resample as R
from chainspark.session import cut_lineage
from chainspark.space import StateSpace

EPS = 1e-12


def count_cells(trans: DataFrame, keys=(), weight: Column | None = None) -> DataFrame:
    """Transition counts per key; map-side combine keeps the exchange to distinct cells."""
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight.cast("double"))
    return trans.groupBy(*keys, F.col("from_state").alias("i"), F.col("to_state").alias("j")).agg(
        n.alias("n"))


def row_total(keys=(), value: str = "n") -> Column:
    return F.sum(value).over(Window.partitionBy(*keys, "i"))


def mle(cells: DataFrame, keys=()) -> DataFrame:
    """n_ij / n_i on observed cells; rows without data are absent, i.e. zero."""
    return cells.withColumn("p", F.col("n") / row_total(keys))


def complete(cells: DataFrame, space: StateSpace, keys=(), units: DataFrame | None = None
             ) -> DataFrame:
    """Every (i, j) cell of every unit, absent ones with n = 0.

    The grid is broadcast: its size is fixed by the state space (80 x 84 by default).
    """
    grid = F.broadcast(space.grid(cells.sparkSession))
    if not keys:
        zero = grid.withColumn("n", F.lit(0.0))
    else:
        units = units if units is not None else cells.select(*keys).distinct()
        zero = units.crossJoin(grid).withColumn("n", F.lit(0.0))
    return cells.select(*keys, "i", "j", "n").unionByName(zero).groupBy(*keys, "i", "j").agg(
        F.sum("n").alias("n"))


def normalise_rows(cells: DataFrame, space: StateSpace, keys=()) -> DataFrame:
    """Row-stochastic matrix; a row without data becomes uniform."""
    full = complete(cells, space, keys).withColumn("ni", row_total(keys))
    p = F.when(F.col("ni") > 0, F.col("n") / F.col("ni")).otherwise(1.0 / space.n_states)
    return full.select(*keys, "i", "j", "n", p.alias("p"))


def shrink(full: DataFrame, lam, space: StateSpace, keys=(), q: str = "q") -> DataFrame:
    """(n + lam q) / (n_i + lam) on completed cells that carry the reference ``q``.

    Reference rows are renormalised, empty ones become uniform; a row with neither data nor
    weight falls back to the reference.
    """
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    w = Window.partitionBy(*keys, "i")
    df = full.withColumns({"__q": F.sum(q).over(w), "__n": F.sum("n").over(w)})
    ref = F.when(F.col("__q") > EPS, F.col(q) / F.col("__q")).otherwise(1.0 / space.n_states)
    df = df.withColumn(q, ref)
    p = F.when(F.col("__n") + lam <= EPS, F.col(q)).otherwise(
        (F.col("n") + lam * F.col(q)) / F.greatest(F.col("__n") + lam, F.lit(EPS)))
    return df.withColumn("p", p).drop("__q", "__n")


def prior(cells: DataFrame, space: StateSpace, keys=()) -> DataFrame:
    """Reference matrix: counts shrunk to the uniform with weight one."""
    full = complete(cells, space, keys).withColumn("ni", row_total(keys))
    q = (F.col("n") + 1.0 / space.n_states) / (F.col("ni") + 1.0)
    return full.select(*keys, "i", "j", q.alias("q"))


def prior_without(cells: DataFrame, unit: str, space: StateSpace, within=()) -> DataFrame:
    """Reference of every unit from all other units: total minus own counts."""
    full = complete(cells, space, (*within, unit))
    rest = F.sum("n").over(Window.partitionBy(*within, "i", "j")) - F.col("n")
    full = full.withColumn("rest", rest).withColumn(
        "ri", F.sum("rest").over(Window.partitionBy(*within, unit, "i")))
    q = (F.col("rest") + 1.0 / space.n_states) / (F.col("ri") + 1.0)
    return full.select(*within, unit, "i", "j", q.alias("q"))


def rest_counts(cells: DataFrame, unit: str, space: StateSpace) -> DataFrame:
    """Counts of all other units for every cell: unit, i, j, n."""
    full = complete(cells, space, (unit,))
    return full.select(unit, "i", "j", (F.sum("n").over(Window.partitionBy("i", "j")) - F.col("n")).alias("n"))


# -- folds and lambda ----------------------------------------------------------------------
def folds(blocks: DataFrame, k: int, seed: int, keys: list[str], block: str = "poss_uid"
          ) -> DataFrame:
    """Deterministic near-equal folds of blocks, in the order of a draw on the block id."""
    d = blocks.withColumn("__u", draw(seed, F.col(block)))
    d = position(d, keys, ["__u", block], chunk_of(F.col("__u")), "__pos", "__m")
    base, big = F.floor(F.col("__m") / k), F.col("__m") % k
    at = F.col("__pos") - 1
    fold = F.when(at < big * (base + 1), F.floor(at / (base + 1))).otherwise(
        big + F.floor((at - big * (base + 1)) / F.greatest(base, F.lit(1))))
    return d.withColumn("fold", fold.cast("bigint")).drop("__u", "__pos", "__m")


def fold_cells(trans: DataFrame, k: int, seed: int, unit: str) -> DataFrame:
    blocks = folds(trans.select(unit, "poss_uid").distinct(), k, seed, [unit])
    return count_cells(trans.join(blocks, [unit, "poss_uid"]), (unit, "fold"))


def cv_scores(cells: DataFrame, q: DataFrame, lambdas: list[float], unit: str) -> DataFrame:
    """Out-of-fold log-likelihood per transition for every unit and lambda.

    ``cells`` are counts by (unit, fold, i, j); training counts are total minus fold, so no
    data is re-read per fold, and only cells seen in the test fold are scored.
    """
    cell, row = Window.partitionBy(unit, "i", "j"), Window.partitionBy(unit, "i")
    fold_row = Window.partitionBy(unit, "fold", "i")
    d = cells.withColumns({
        "tr": F.sum("n").over(cell) - F.col("n"),
        "tri": F.sum("n").over(row) - F.sum("n").over(fold_row)}).join(q, [unit, "i", "j"])
    lam = F.explode(F.array(*[F.lit(float(x)) for x in lambdas]))
    d = d.withColumn("lam", lam)
    p = F.when(F.col("tri") + F.col("lam") <= EPS, F.col("q")).otherwise(
        (F.col("tr") + F.col("lam") * F.col("q")) / F.greatest(F.col("tri") + F.col("lam"), F.lit(EPS)))
    ll = F.sum(F.col("n") * F.log(F.greatest(p, F.lit(EPS))))
    return d.groupBy(unit, "lam").agg((ll / F.sum("n")).alias("score"))


def best_lambda(scores: DataFrame, unit: str) -> DataFrame:
    """Best lambda (smallest on ties) with flags for the ends of the grid."""
    out = scores.groupBy(unit).agg(
        F.max_by("lam", F.struct(F.col("score"), -F.col("lam"))).alias("lam_star"),
        F.max("score").alias("score"), F.min("lam").alias("lo"), F.max("lam").alias("hi"))
    return out.select(unit, "lam_star", "score", (F.col("lam_star") <= F.col("lo")).alias("at_floor"),
                      (F.col("lam_star") >= F.col("hi")).alias("at_top"))


def plateau(scores: DataFrame, unit: str, lo: float, hi: float, tol: float = 0.01) -> DataFrame:
    """Range of the score between two lambdas; flat below ``tol``."""
    inside = F.when(F.col("lam").between(lo, hi), F.col("score"))
    return scores.groupBy(unit).agg((F.max(inside) - F.min(inside)).alias("score_range")).withColumn(
        "flat", F.col("score_range") < tol)


def attenuation(cells: DataFrame, lam: float, keys=()) -> DataFrame:
    """Share of own evidence n/(n+lam): mean over rows and weighted by row mass."""
    rows = cells.groupBy(*keys, "i").agg(F.sum("n").alias("n"))
    a = F.col("n") / (F.col("n") + lam)
    return rows.groupBy(*keys).agg(F.avg(a).alias("mean_weight"),
                                   (F.sum(a * F.col("n")) / F.sum("n")).alias("mass_weight"))


# -- diagnostics ---------------------------------------------------------------------------
def sparsity(cells: DataFrame, space: StateSpace, keys=(), min_count: int = 30) -> DataFrame:
    rows = complete(cells, space, keys).groupBy(*keys, "i").agg(F.sum("n").alias("n"))
    n = F.col("n")
    cols = space.n_states - 1
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_transitions"),
        F.sum((n == 0).cast("bigint")).alias("rows_empty"),
        F.sum((n < min_count).cast("bigint")).alias("rows_below_min"),
        F.avg((n < min_count).cast("double")).alias("frac_below_min"),
        F.percentile("n", F.lit(0.5)).alias("median_row_count"),
        (F.count(F.lit(1)) * cols / F.greatest(F.sum("n"), F.lit(1.0))).alias("params_per_obs"))


def error_curve(trans: DataFrame, q: DataFrame, lam: float, fractions: list[float], reps: int,
                seed: int, space: StateSpace) -> DataFrame:
    """Error of the shrunk matrix against the full fit when only a share of possessions is used.

    One random order of the possessions per replicate; fractions are nested prefixes of it. The prefix ends at
    a draw, which the rows compare with their own: neither possessions nor rows are ranked or moved.
    """
    # one row per possession, read for its draws
    ids = cut_lineage(trans.select("poss_uid").distinct())
    key = ["fraction", "rep", "n_possessions"]
    spec = F.array(*[F.lit(float(f)) for f in fractions])
    size = ids.agg(F.count(F.lit(1)).alias("m")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    size = size.withColumn("fraction", F.explode(spec)).filter((F.col("fraction") < 1) | (F.col("rep") == 0)).filter("m > 0")
    size = cut_lineage(size.select(*key[:2], F.greatest(F.lit(1), F.round(F.col("fraction") * F.col("m")).cast("bigint")).alias("n_possessions")))
    # replicates times fractions: a fixed number of rows
    drawn = F.explode(R.replicate_draws(seed, "poss_uid", 0, reps - 1)).alias("d")
    opened = ids.select("poss_uid", drawn).select("poss_uid", F.col("d.b").alias("rep"), F.col("d.u").alias("u"))
    cuts = R.cutoffs(opened.join(F.broadcast(size), "rep"), key, "poss_uid", "n_possessions")
    rows = trans.select("poss_uid", "from_state", "to_state", drawn)
    rows = rows.withColumn("rep", F.col("d.b")).join(F.broadcast(cuts), "rep").filter(
        F.struct(F.col("d.u").alias("u"), "poss_uid") <= F.col("cut"))
    # cells of a few replicates, read twice below
    sub = cut_lineage(count_cells(rows, tuple(key)))
    total = count_cells(trans)
    q = F.broadcast(q)
    sub = shrink(complete(sub, space, key).join(q, ["i", "j"]), lam, space, key)
    full = shrink(complete(total, space).join(q, ["i", "j"]), lam, space)
    full = full.select("i", "j", F.col("p").alias("p_full"),
                       F.sum("n").over(Window.partitionBy("i")).alias("ni"))
    err = sub.join(F.broadcast(full), ["i", "j"]).groupBy(*key, "i", "ni").agg(
        F.max(F.abs(F.col("p") - F.col("p_full"))).alias("e"))
    return err.groupBy(*key).agg((F.sum(F.col("e") * F.col("ni")) / F.sum("ni")).alias("err_weighted"),
                                 F.percentile("e", F.lit(0.5)).alias("err_median"))


def lambda_sensitivity(cells: DataFrame, q: DataFrame, lambdas: list[float], space: StateSpace, keys: list[str],
                       test, min_row: int = 15) -> DataFrame:
    """How rejected rows change with lambda: keys, lam, tested, rejected, g2_max, attenuation, and the Jaccard index
    of the rejected set with that of every other lambda (other, jaccard), and the share that all lambdas reject.

    A row is tested against the reference shrunk with lambda: ``test`` turns (keys, lam, i, g2, n) into
    rows with a column ``rejected``. Rejected sets are bitmaps over the states, so sets are compared by bit
    counts, whatever their number. ``q``: keys, i, j, q and base counts n of the reference.
    """
    lam = F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lam")
    total = F.sum("n").over(Window.partitionBy(*keys, "i"))
    ref = q.withColumn("ni", total).select(*keys, "i", "j", "n", "ni", "q", lam)
    star = ref.select(*keys, "i", "j", "lam", ((F.col("n") + F.col("lam") * F.col("q")) / (F.col("ni") + F.col("lam"))).alias("p"))
    d = cells.withColumn("ni", total).join(star, [*keys, "i", "j"])
    g2 = d.filter("n > 0").groupBy(*keys, "lam", "i").agg(
        (2 * F.sum(F.col("n") * F.log(F.col("n") / (F.col("ni") * F.col("p"))))).alias("g2"), F.max("ni").alias("n"))
    tested = cut_lineage(test(g2.filter(F.col("n") >= min_row)))
    weight = F.col("n") / (F.col("n") + F.col("lam"))
    sets = cut_lineage(tested.groupBy(*keys, "lam").agg(
        F.count(F.lit(1)).alias("tested"), F.sum(F.col("rejected").cast("bigint")).alias("rejected"), F.max("g2").alias("g2_max"),
        F.percentile(weight, F.lit(0.5)).alias("attenuation"),
        # state numbers below the 32,768 bits of one bitmap
        F.bitmap_construct_agg(F.when(F.col("rejected"), F.bitmap_bit_position(F.col("i") + 1))).alias("bits")))
    other = sets.select(*keys, F.col("lam").alias("other"), F.col("bits").alias("other_bits"), F.col("rejected").alias("other_n"))
    union = sets.groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("any"))
    every = tested.filter("rejected").groupBy(*keys, "i").agg(F.countDistinct("lam").alias("c")).groupBy(*keys).agg(
        F.sum((F.col("c") == len(lambdas)).cast("bigint")).alias("core"))
    pairs = sets.join(other, keys)
    both = pairs.groupBy(*keys, "lam", "other").agg(F.first("bits").alias("a"), F.first("other_bits").alias("b"))
    either = both.select(*keys, "lam", "other", F.explode(F.array("a", "b")).alias("x")).groupBy(*keys, "lam", "other").agg(
        F.bitmap_count(F.bitmap_or_agg("x")).alias("either"))
    out = pairs.join(either, [*keys, "lam", "other"]).join(union, keys).join(every, keys, "left")
    jaccard = F.when(F.col("either") > 0, (F.col("rejected") + F.col("other_n") - F.col("either")) / F.col("either")).otherwise(1.0)
    core = F.coalesce("core", F.lit(0)) / F.greatest(F.bitmap_count("any"), F.lit(1))
    return out.select(*keys, "lam", "other", "tested", "rejected", "g2_max", "attenuation", jaccard.alias("jaccard"), core.alias("stability"))


def shrink_rate(df: DataFrame, hits: str, n: str, q: str, lam) -> Column:
    """(D + lam q) / (A + lam), the reference when both are zero."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    den = F.col(n) + lam
    return F.when(den > 0, (F.col(hits) + lam * F.col(q)) / den).otherwise(F.col(q))


def cv_rate(df: DataFrame, lambdas: list[float], unit: str) -> DataFrame:
    """Binomial analogue of cv_scores. ``df``: unit, fold, zone, hits, n, q."""
    w, wf = Window.partitionBy(unit, "zone"), Window.partitionBy(unit, "zone", "fold")
    d = df.withColumns({"n_tr": F.sum("n").over(w) - F.sum("n").over(wf),
                        "h_tr": F.sum("hits").over(w) - F.sum("hits").over(wf)})
    d = d.withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lambdas])))
    p = shrink_rate(d, "h_tr", "n_tr", "q", F.col("lam"))
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    ll = F.sum(F.col("hits") * F.log(p) + (F.col("n") - F.col("hits")) * F.log(1 - p))
    return d.groupBy(unit, "lam").agg((ll / F.sum("n")).alias("score"))
