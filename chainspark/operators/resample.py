"""Resampling: bootstrap weights, permutation labels, intervals, p-values, false-discovery control.

Draws are functions of (seed, stratum, replicate, slot or id), so results never depend on row
order or partitioning. Data are pre-aggregated to block cells before any replicate multiplies
them, and a block carries all of its replicate weights in one array: the join moves block cells
once, not once per replicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions.draws import SPAN, chunk_of, draw, poisson1, uniform
from chainspark.functions.scan import Running, position, running, same_keys
from chainspark.session import cut_lineage


def ranked_blocks(blocks: DataFrame, stratum: list[str], block: str, seed: int) -> DataFrame:
    """Give every block of a stratum a canonical rank 0..n-1 in the order of its draw."""
    d = blocks.select(*stratum, block).distinct().withColumn("__u", draw(seed, F.col(block)))
    d = position(d, stratum, ["__u", block], chunk_of(F.col("__u")), "__k", "__n")
    return d.select(*stratum, block, (F.col("__k") - 1).alias("rank"), F.col("__n").alias("n"))


def _stratum_text(stratum: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in stratum]) if stratum else F.lit("")


def multinomial_weights(blocks: DataFrame, stratum: list[str], block: str, B: int, seed: int
                        ) -> DataFrame:
    """Exact bootstrap: n draws with replacement from the n blocks of a stratum, per replicate.

    One row per block with ``w``: list of (b, w) for replicates that drew it; replicate 0 is the
    data itself. A list has at most B + 1 entries.
    """
    # one row per block, read twice below
    r = cut_lineage(ranked_blocks(blocks, stratum, block, seed))
    slots = r.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B))))
    target = draw(seed, _stratum_text(stratum), F.col("b"), F.col("rank")) % F.col("n")
    drawn = slots.select(*stratum, "b", target.alias("rank")).groupBy(*stratum, "rank", "b").agg(
        F.count(F.lit(1)).alias("w"))
    drawn = drawn.groupBy(*stratum, "rank").agg(F.collect_list(F.struct("b", "w")).alias("w"))
    self_ = F.array(F.struct(F.lit(0).cast("int").alias("b"), F.lit(1).cast("bigint").alias("w")))
    out = r.join(drawn, [*stratum, "rank"], "left")
    return out.select(*stratum, block, F.when(F.col("w").isNull(), self_).otherwise(
        F.concat(self_, "w")).alias("w"))


def poisson_weights(df: DataFrame, block: str, B: int, seed: int, column: str = "w") -> DataFrame:
    """Poisson(1) weights computed in place: no exchange at all, for very many blocks."""
    # a draw is bound to a name, so that its hash is taken once and not at every step of the quantile
    def weight(b: Column) -> Column:
        return F.transform(F.array(uniform(seed, b, F.col(block))), lambda u: poisson1(u))[0]
    reps = F.transform(F.sequence(F.lit(0), F.lit(B)), lambda b: F.struct(
        b.cast("int").alias("b"), F.when(b == 0, F.lit(1).cast("bigint")).otherwise(weight(b)).alias("w")))
    return df.withColumn(column, F.filter(reps, lambda x: x["w"] > 0))


def opened(weights: str) -> Column:
    """One row per replicate of a list of weights, which always holds replicate 0.

    A plain explode lets the planner infer that the list is not empty and test that below the aggregate of the
    block cells: all weights of a block would then be drawn for every raw row.
    """
    return F.explode_outer(weights)


def replicate_sums(cells: DataFrame, weights: DataFrame, on: list[str], keys: list[str],
                   sums: list[str]) -> DataFrame:
    """Sum block cells per replicate: keys, b, sums. ``cells`` hold one row per block cell."""
    d = cells.join(weights, on).withColumn("__w", opened("w"))
    return d.groupBy(*keys, F.col("__w.b").alias("b")).agg(
        *[F.sum(F.col(c) * F.col("__w.w")).alias(c) for c in sums])


#: Slots of labels in sorted order that one row of the layout covers.
SLOTS = 4096


def label_layout(labels: DataFrame, stratum: list[str], label: str) -> DataFrame:
    """Labels in sorted order over the slots 1..n of a stratum: one row per SLOTS of them.

    ``__labels`` lists (last slot, label) for every label inside the row's range, so a list has at most SLOTS
    entries, whatever the labels.
    """
    counts = labels.groupBy(*stratum, label).agg(F.count(F.lit(1)).alias("__c"))
    counts = running(counts, list(stratum), [label], [Running("__lo", "sum", F.col("__c"))],
                     lambda size: F.struct(F.col(label)))
    last = F.col("__lo") + F.col("__c")
    counts = counts.withColumn("__hi", last).withColumn("__range", F.explode(F.sequence(
        F.floor(F.col("__lo") / SLOTS), F.floor((F.col("__hi") - 1) / SLOTS))))
    return counts.groupBy(*stratum, "__range").agg(F.sort_array(F.collect_list(F.struct("__hi", F.col(label)))).alias("__labels"))


def permutation_labels(blocks: DataFrame, stratum: list[str], block: str, label: str, B: int,
                       seed: int) -> DataFrame:
    """Labels shuffled between blocks inside a stratum, counts kept; b = 0 is the data.

    Labels are laid out in sorted order over ranks; every replicate ranks the blocks by a fresh
    draw and takes the label at that rank. The layout follows from the labels' counts and is a row per SLOTS
    blocks, so ranked blocks meet it without being dealt again.
    """
    d = cut_lineage(blocks.select(*stratum, block, label).distinct())
    layout = cut_lineage(label_layout(d, stratum, label))
    keys = [*stratum, "b"]
    many = d.select(*stratum, block).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(B)))).withColumn(
        "__u", draw(seed, F.col("b"), F.col(block)))
    many = position(many, keys, ["__u", block], chunk_of(F.col("__u")), "__slot").drop("__u")
    many = many.withColumn("__range", F.floor((F.col("__slot") - 1) / SLOTS))
    shuffled = many.join(layout, [*stratum, "__range"])
    at = F.filter("__labels", lambda x: x["__hi"] >= F.col("__slot"))[0][label]
    return shuffled.select(*stratum, block, "b", at.alias(label)).unionByName(
        d.withColumn("b", F.lit(0)).select(*stratum, block, "b", label))


#: Ranges of a draw that are counted to find the one a rank falls in.
RANGES = 4096


def replicate_draws(seed: int, block: str, first: int, last: int) -> Column:
    """List of (b, u): the block's draw in every replicate, taken once each."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda b: F.struct(b.alias("b"), draw(seed, b, F.col(block)).alias("u")))


def cutoffs(draws: DataFrame, keys: list[str], block: str, upto: str) -> DataFrame:
    """The (u, block) at rank ``upto`` of every key, in the order of the draw; keys with fewer rows have none.

    ``draws``: keys, block, u, upto (constant in the key), one row per block. Ranges of the draw are counted
    map-side, and only the rows of the range with the rank are dealt and ranked: whoever knows a block's draw then
    tells by comparison whether it is chosen, and no block moves.
    """
    d = draws.withColumn("__r", F.floor(F.col("u").cast("double") / F.lit(float(SPAN)) * RANGES))
    counts = d.groupBy(*keys, "__r").agg(F.count(F.lit(1)).alias("__c"), F.max(upto).alias("__upto"))
    # a key has RANGES rows here at most
    counts = running(counts, list(keys), ["__r"], [Running("__before", "sum", F.col("__c"))])
    rank = F.col("__upto") - F.col("__before")
    hit = cut_lineage(counts.filter((rank >= 1) & (rank <= F.col("__c"))).select(*keys, "__r", rank.alias("__rank")))
    inside = same_keys(d.select(*keys, "u", block, "__r"), hit, [*keys, "__r"])
    at = Window.partitionBy(*keys, "__r").orderBy("u", block)
    found = inside.withColumn("__at", F.row_number().over(at)).filter("__at = __rank")
    return cut_lineage(found.select(*keys, F.struct("u", block).alias("cut")))


def subsample(blocks: DataFrame, keys: list[str], block: str, size: str, B: int, seed: int
              ) -> DataFrame:
    """Keep ``size`` blocks of every key without replacement, per replicate b = 1..B."""
    d = blocks.select(*keys, block, size).distinct()
    return kept(d, subsample_cutoffs(d, keys, block, size, B, seed), keys, block, B, seed).select(*keys, "b", block)


def subsample_cutoffs(blocks: DataFrame, keys: list[str], block: str, size: str, B: int, seed: int) -> DataFrame:
    """keys, b, cut: where the ``size`` smallest draws of a key end in a replicate; null if it has no more blocks than that.

    One row per block is expected; keys that keep none have no row.
    """
    d = blocks.withColumn("__d", F.explode(replicate_draws(seed, block, 1, B)))
    d = d.select(*keys, block, size, F.col("__d.b").alias("b"), F.col("__d.u").alias("u"))
    some = blocks.groupBy(*keys).agg(F.max(size).alias("__s")).filter("__s >= 1").select(*keys, F.explode(F.sequence(F.lit(1), F.lit(B))).alias("b"))
    return cut_lineage(same_keys(some, cutoffs(d, [*keys, "b"], block, size), [*keys, "b"], "left"))


def kept(rows: DataFrame, cuts: DataFrame, keys: list[str], block: str, B: int, seed: int) -> DataFrame:
    """``rows`` of chosen blocks, once per replicate b that chose them: every row draws for its block in place."""
    d = rows.withColumn("__d", F.explode(replicate_draws(seed, block, 1, B))).withColumn("b", F.col("__d.b"))
    d = same_keys(d, cuts, [*keys, "b"])
    own = F.struct(F.col("__d.u").alias("u"), F.col(block).alias(block))
    return d.filter(F.col("cut").isNull() | (own <= F.col("cut"))).drop("__d", "cut")


# -- summaries over replicates (groups of B rows) ----------------------------------------------
def interval(reps: DataFrame, keys: list[str], value: str, level: float = 0.95,
             method: str = "basic") -> DataFrame:
    """Point (b = 0), interval and p-value by inversion of the basic interval.

    Null replicates are ignored; quantiles are exact and interpolated.
    """
    if method not in ("basic", "percentile"):
        raise ValueError(f"unknown method: {method}")
    x = F.col(value)
    # replicate 0 is spread to its replicates without a second pass over them
    point = F.max(F.when(F.col("b") == 0, x)).over(Window.partitionBy(*keys))
    d = reps.withColumn("__t", point)
    inside = (F.col("b") > 0) & x.isNotNull()
    rep = F.when(inside, x)
    dev = rep - F.col("__t")
    beyond = F.when(F.col("__t") >= 0, dev >= F.col("__t")).otherwise(dev <= F.col("__t"))
    a = (1 - level) / 2
    out = d.groupBy(*keys).agg(
        F.max("__t").alias("point"), F.count(rep).alias("replicates"),
        F.percentile(rep, F.lit(a)).alias("__lo"), F.percentile(rep, F.lit(1 - a)).alias("__hi"),
        F.stddev_samp(rep).alias("se"), F.sum(F.when(inside, beyond.cast("bigint"))).alias("__k"))
    lo, hi = ((2 * F.col("point") - F.col("__hi"), 2 * F.col("point") - F.col("__lo"))
              if method == "basic" else (F.col("__lo"), F.col("__hi")))
    p = F.least(F.lit(1.0), 2.0 * (1 + F.col("__k")) / (F.col("replicates") + 1))
    return out.select(*keys, "point", lo.alias("lo"), hi.alias("hi"), "se", p.alias("p"),
                      "replicates")


def achieved_p(reps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2 (1 + min tail) / (1 + B) around twice the point: the other reading of the same interval."""
    x = F.col(value)
    point = F.max(F.when(F.col("b") == 0, x)).over(Window.partitionBy(*keys))
    d = reps.withColumn("__t", point).filter("b > 0")
    low, high = F.sum((x <= 2 * F.col("__t")).cast("bigint")), F.sum((x >= 2 * F.col("__t")).cast("bigint"))
    return d.groupBy(*keys).agg(F.least(F.lit(1.0), 2.0 * (1 + F.least(low, high)) / (1 + F.count(x))
                                        ).alias("p"))


def permutation_p(reps: DataFrame, keys: list[str], value: str, two_sided: bool = False,
                  plus_one: bool = True) -> DataFrame:
    """Observed value (b = 0), null median and 95th percentile, z, excess, share at least as large."""
    x = F.abs(F.col(value)) if two_sided else F.col(value)
    w = Window.partitionBy(*keys)
    d = reps.withColumn("__x", x).withColumn("__o", F.max(F.when(F.col("b") == 0, x)).over(w))
    null = F.when(F.col("b") > 0, F.col("__x"))
    # equal statistics count as ties whatever the order of their sums
    hits = F.sum((null >= F.col("__o") - 1e-12).cast("bigint"))
    extra = 1 if plus_one else 0
    out = d.groupBy(*keys).agg(
        F.max(F.when(F.col("b") == 0, F.col(value))).alias("observed"),
        F.max("__o").alias("__o"), F.percentile(null, F.lit(0.5)).alias("null_median"),
        F.percentile(null, F.lit(0.95)).alias("null_p95"), F.avg(null).alias("__m"),
        F.stddev_pop(null).alias("__sd"),
        ((hits + extra) / (F.count(null) + extra)).alias("p"))
    z = F.when(F.col("__sd") > 0, (F.col("__o") - F.col("__m")) / F.col("__sd"))
    return out.select(*keys, "observed", "null_median", "null_p95", z.alias("z"),
                      (F.col("__o") - F.col("null_median")).alias("excess"), "p")


def omnibus(reps: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Sum of squared standardised differences over parts, p from centred replicates."""
    w = Window.partitionBy(*keys, part)
    x = F.col(value)
    d = reps.withColumn("__d", F.max(F.when(F.col("b") == 0, x)).over(w)).withColumn(
        "__se", F.stddev_samp(F.when(F.col("b") > 0, x)).over(w))
    term = F.when(F.col("__se") > 0, F.pow((x - F.when(F.col("b") == 0, 0.0).otherwise(F.col("__d")))
                                           / F.col("__se"), 2))
    # a replicate counts only when every part is there
    per = d.groupBy(*keys, "b").agg(F.sum(term).alias("t"), F.count(x).alias("have"),
                                    F.count(F.lit(1)).alias("parts"))
    per = per.withColumn("t", F.coalesce("t", F.lit(0.0))).filter("have = parts")
    obs = F.max(F.when(F.col("b") == 0, F.col("t"))).over(Window.partitionBy(*keys))
    per = per.withColumn("o", obs)
    return per.groupBy(*keys).agg(
        F.max("o").alias("t"), F.max("parts").alias("tested"),
        ((1 + F.sum(((F.col("b") > 0) & (F.col("t") >= F.col("o"))).cast("bigint")))
         / (F.sum((F.col("b") > 0).cast("bigint")) + 1)).alias("p"))


# -- multiplicity --------------------------------------------------------------------------------
def fdr(df: DataFrame, family: list[str], p: str = "p", alpha: float = 0.05,
        mask: Column | None = None, dependent: bool = False) -> DataFrame:
    """Benjamini-Hochberg q-values and rejections per family; Yekutieli when ``dependent``.

    Tests are ranked by a scan chunked on p, so a family may hold any number of tests. Rows
    outside the mask keep q = 1.
    """
    keys = list(family) or ["__family"]
    # a results table, read by every scan below
    d = cut_lineage(df if family else df.withColumn("__family", F.lit(0)))
    take = (F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))) & F.col(p).isNotNull()
    d = d.withColumn("__take", take)
    # equal p-values share a q-value: rank distinct values with their counts
    values = d.filter("__take").groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__c"))
    # as many ranges of p as the family of a hot key needs, of which the scan gives the size
    def chunk(size: Column) -> Column:
        return F.floor(F.col(p) * F.ceil(size / 1000))
    values = running(values, keys, [p], [Running("__rank", "sum", F.col("__c"), inclusive=True)],
                     chunk, {"__m": ("sum", F.col("__c"))})
    factor = F.lit(1.0)
    if dependent:
        # sum of 1/k up to m: eight steps of its recurrence, then its expansion at m + 8
        m = F.col("__m").cast("double")
        far = m + 8
        square = far * far
        factor = (F.log(far) + 0.5772156649015329 + 1 / (2 * far) - 1 / (12 * square) + 1 / (120 * square * square)
                  - 1 / (252 * square * square * square)) - sum((1 / (m + k) for k in range(1, 9)), F.lit(0.0))
    values = values.withColumn("__raw", F.col(p) * F.col("__m") / F.col("__rank") * factor)
    values = running(values, keys, [p], [Running("__q", "min", F.col("__raw"), True, True)], chunk)
    q = F.when(F.col("__take"), F.least(F.lit(1.0), F.col("__q"))).otherwise(1.0)
    out = d.join(values.select(*keys, p, "__q"), [*keys, p], "left").withColumns(
        {"q": q, "rejected": F.col("__take") & (q <= alpha)})
    return out.drop("__take", "__q", "__family")


def p_floor(m: Column, B: int, alpha: float = 0.05) -> Column:
    """True when the smallest reachable p cannot pass the first step of the family."""
    return F.lit(2.0 / (B + 1)) > alpha / m
