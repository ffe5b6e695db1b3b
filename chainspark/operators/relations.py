"""Generic relational operators with chain semantics: as-of and interval joins, runs, halves,
ranks, set comparison, unit selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions.scan import Running, position, running, same_keys, scan


# -- joins over order ----------------------------------------------------------------------
def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str,
                  right_time: str, cols: list[str], chunk=None) -> DataFrame:
    """Latest right row with right_time <= left_time per key, as columns ``cols``.

    Both sides become one stream ordered by (time, side) and the last right row is carried by a
    chunked running maximum, so a hot key needs neither a single task nor a cross product.
    """
    payload = F.struct(F.col(right_time).alias("t"), *cols)
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"),
                     payload.alias("__p"))
    lcols = left.columns
    own = F.struct(*[F.col(c) for c in lcols])
    lft = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"),
                      own.alias("__l"))
    both = r.unionByName(lft, allowMissingColumns=True)
    out = running(both, keys, ["__t", "__side"],
                  [Running("__last", "max", F.col("__p"))], chunk)
    return out.filter("__side = 1").select("__l.*", *[F.col("__last")[c].alias(c) for c in cols])


def interval_pairs(points: DataFrame, windows: DataFrame, keys: list[str], time: str, lo: str,
                   hi: str, width: float, closed: str = "left") -> DataFrame:
    """Join points to the windows [lo, hi) (or (lo, hi]) that contain them.

    Time is cut into buckets of ``width``; a window is repeated once per bucket it touches and
    the join is an equi-join on (keys, bucket), so a hot key is spread over its buckets.
    """
    w = windows.withColumn("__b", F.explode(F.sequence(
        F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = points.withColumn("__b", F.floor(F.col(time) / width))
    inside = ((F.col(time) >= F.col(lo)) & (F.col(time) < F.col(hi)) if closed == "left"
              else (F.col(time) > F.col(lo)) & (F.col(time) <= F.col(hi)))
    return p.join(w, [*keys, "__b"]).filter(inside).drop("__b")


def _stream(points: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Points and queries as one stream; at equal times queries of side 0 come before points, of side 2 after."""
    present = F.lit(True)
    for k in keys:
        present &= F.col(k).isNotNull()
    marked = points.withColumn("__side", F.lit(1))
    return marked.unionByName(queries, allowMissingColumns=True).filter(present & F.col("__x").isNotNull())


def window_rates(points: DataFrame, centres: DataFrame, keys: list[str], time: str, num: Column,
                 den: Column, span: float, gap: float) -> DataFrame:
    """Rate of num/den before [t-gap-span, t-gap) and after (t+gap, t+gap+span] each centre.

    ``centres``: keys, centre_id, t. A sum over a window is the difference of two sums from the start
    of the key, which one running sum over the points, added up per time first, gives at the four ends of
    a centre's windows: no point meets a window, and a key's times are cut into chunks of the span.
    Sums are whole where num and den are; else they carry the rounding of the key's sums.
    """
    pts = points.groupBy(*keys, F.col(time).cast("double").alias("__x")).agg(F.sum(num).alias("__num"), F.sum(den).alias("__den"))
    t = F.col("t").cast("double")
    ends = (("before", -1, F.greatest(t - gap - span, F.lit(0.0)), 0), ("before", 1, F.greatest(t - gap, F.lit(0.0)), 0),
            ("after", -1, t + gap, 2), ("after", 1, t + gap + span, 2))
    asked = centres.where(t.isNotNull()).select(*keys, "centre_id", F.explode(F.array(*[
        F.struct(F.lit(tag).alias("tag"), F.lit(sign).alias("sign"), x.alias("x"), F.lit(side).alias("side"))
        for tag, sign, x, side in ends])).alias("e"))
    asked = asked.select(*keys, "centre_id", F.col("e.tag").alias("__tag"), F.col("e.sign").alias("__sign"),
                         F.col("e.x").alias("__x"), F.col("e.side").alias("__side"))
    sums = running(_stream(pts, asked, keys), keys, ["__x", "__side"],
                   [Running("__n", "sum", F.col("__num")), Running("__d", "sum", F.col("__den"))],
                   F.floor(F.col("__x") / span)).filter("__sign IS NOT NULL")

    def between(tag: str, c: str) -> Column:
        return F.sum(F.when(F.col("__tag") == tag, F.col("__sign") * F.col(c)))
    out = centres.join(sums.groupBy("centre_id").agg(*[between(tag, c).alias(f"{name}_{tag}") for tag in ("before", "after")
                                                       for name, c in (("num", "__n"), ("den", "__d"))]), "centre_id", "left")
    for tag in ("before", "after"):
        d = F.col(f"den_{tag}")
        out = out.withColumn(f"rate_{tag}", F.when(d > 0, F.col(f"num_{tag}") / d))
    return out


def max_within(points: DataFrame, starts: DataFrame, keys: list[str], time: str, value: str,
               span: float) -> DataFrame:
    """Largest value in [t, t+span] after each start; null when there is none.

    Time is cut into blocks of ``span``. A window is the end of one block and the beginning of the next,
    so its maximum is the larger of a running maximum from t to the end of its block and one from the
    start of the next to t+span; points are folded per time first, and a block with any share of them is
    cut into chunks of its own.
    """
    pts = points.groupBy(*keys, F.col(time).cast("double").alias("__x")).agg(F.max(value).alias("__v")).withColumn(
        "__b", F.floor(F.col("__x") / span))
    t = F.col("t").cast("double")
    own, far = F.floor(t / span), F.floor((t + span) / span)
    # far is the next block, or one more where t + span was rounded up to it: then all of the next counts
    ends = F.concat(F.array(F.struct(own.alias("b"), t.alias("x"), F.lit(0).alias("side"))),
                    F.transform(F.sequence(own + 1, F.greatest(far, own + 1)), lambda b: F.struct(b.alias("b"), (t + span).alias("x"), F.lit(2).alias("side"))))
    asked = starts.where(t.isNotNull()).select(*keys, "start_id", F.explode(ends).alias("e")).select(
        *keys, "start_id", F.col("e.b").alias("__b"), F.col("e.x").alias("__x"), F.col("e.side").alias("__side"))
    best = running(_stream(pts, asked, keys), [*keys, "__b"], ["__x", "__side"],
                   [Running("__before", "max", F.col("__v")), Running("__after", "max", F.col("__v"), reverse=True)],
                   F.floor(F.col("__x") / (span / 4096))).filter("__side <> 1")
    best = best.groupBy("start_id").agg(F.max(F.when(F.col("__side") == 0, F.col("__after")).otherwise(F.col("__before"))).alias("best"))
    return starts.join(best, "start_id", "left")


# -- runs and splits -----------------------------------------------------------------------
def runs(df: DataFrame, keys: list[str], order: list[str], same: str, chunk=None) -> DataFrame:
    """Number maximal stretches of equal ``same`` (run_id from 1) in the given order."""
    d = scan(df, keys, order, chunk, before={"__prev": F.struct(F.col(same).alias("v"))})
    changed = F.when(F.col("__prev").isNull() | ~F.col("__prev.v").eqNullSafe(F.col(same)), 1).otherwise(0)
    d = d.withColumn("__new", changed)
    d = running(d, keys, order, [Running("run_id", "sum", F.col("__new"), inclusive=True)], chunk)
    return d.drop("__prev", "__new")


def gap_blocks(df: DataFrame, keys: list[str], value: str, min_gap, chunk=None) -> DataFrame:
    """Number blocks (from 0) of a numeric column; a jump above ``min_gap`` opens the next."""
    d = scan(df, keys, [value], chunk, before={"__prev": F.col(value)})
    jump = F.when(F.col(value) - F.col("__prev") > min_gap, 1).otherwise(0)
    d = running(d.withColumn("__jump", jump), keys, [value],
                [Running("block", "sum", F.col("__jump"), inclusive=True)], chunk)
    return d.drop("__prev", "__jump")


def spread_dates(df: DataFrame, keys: list[str], order: list[str], start: str, end: str,
                 out: str = "match_date", chunk=None) -> DataFrame:
    """Place the n rows of a key evenly on [start, end]; a single row takes the start."""
    d = position(df, keys, order, chunk, "__k", "__n")
    span = F.datediff(F.col(end), F.col(start))
    step = F.when(F.col("__n") > 1, F.round(span * (F.col("__k") - 1) / (F.col("__n") - 1))).otherwise(0)
    return d.withColumn(out, F.date_add(F.col(start), step.cast("int"))).drop("__k", "__n")


def halves(df: DataFrame, keys: list[str], order: list[str], odd_to_first: bool = True,
           chunk=None) -> DataFrame:
    """First or second half by order; an odd middle row goes first, or second if asked."""
    d = position(df, keys, order, chunk, "__k", "__n")
    cut = F.ceil(F.col("__n") / 2) if odd_to_first else F.floor(F.col("__n") / 2)
    return d.withColumn("half", F.when(F.col("__k") <= cut, 1).otherwise(2)).drop("__k", "__n")


# -- ranks ---------------------------------------------------------------------------------
def midrank(df: DataFrame, keys: list[str], value: str, out: str = "rank", chunk=None) -> DataFrame:
    """Average rank with ties and population share below (ties count half).

    Ranks come from running counts of distinct values, so they stay exact and distributed.
    """
    # null values keep their rows and get a null rank
    return same_keys(df, rank_values(df, keys, value, out, chunk), [*keys, value])


def rank_values(df: DataFrame, keys: list[str], value: str, out: str = "rank", chunk=None) -> DataFrame:
    """The ranks of midrank, one row per distinct value."""
    per = df.groupBy(*keys, value).agg(F.count(value).alias("__c"))
    per = running(per, keys, [value], [Running("__lo", "sum", F.col("__c"))], chunk,
                  {"__n": ("sum", F.col("__c"))})
    per = per.withColumns({out: F.col("__lo") + (F.col("__c") + 1) / 2.0,
                           f"{out}_share": (F.col("__lo") + F.col("__c") * 0.5) / F.col("__n")})
    return per.select(*keys, value, *[F.when(F.col(value).isNotNull(), F.col(c)).alias(c) for c in (out, f"{out}_share")])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, chunk_x=None, chunk_y=None) -> DataFrame:
    d = midrank(df, keys, x, "__rx", chunk_x)
    d = midrank(d, keys, y, "__ry", chunk_y)
    return d.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("spearman"),
                                F.count(F.lit(1)).alias("n"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key by an aggregate (map-side combine), not a sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__r")).select(*keys, "__r.*")


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value; ties go to the smallest."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return first_per_key(n, keys, [-F.col("n"), F.col(value)])


# -- weighted statistics -------------------------------------------------------------------
def weighted_slope(x: Column, y: Column, w: Column) -> Column:
    """Slope of the weighted least-squares line, from sums only."""
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxy, sxx = F.sum(w * x * y), F.sum(w * x * x)
    return (sxy - sx * sy / sw) / F.greatest(sxx - sx * sx / sw, F.lit(1e-12))


def leave_one_out(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Mean of the key without the row itself; null for a single row."""
    whole = df.groupBy(*keys).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    mean = F.when(F.col("__n") > 1, (F.col("__s") - F.col(value)) / (F.col("__n") - 1))
    return same_keys(df, whole, keys).withColumn(out, mean).drop("__s", "__n")


def leave_unit_out(df: DataFrame, unit: str, by: list[str], sums: list[str]) -> DataFrame:
    """Totals of all other units for every (unit, by): total minus own."""
    total = df.groupBy(*by).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    return same_keys(df, total, by).withColumns({f"rest_{c}": F.col(f"__{c}") - F.col(c) for c in sums}
                                          ).drop(*[f"__{c}" for c in sums])


# -- sets ----------------------------------------------------------------------------------
def jaccard(members: DataFrame, within: list[str], unit: str, item: str) -> DataFrame:
    """Overlap of member sets for every pair of units inside ``within`` (a club).

    Common members come from an equi-join on the member; pairs without any keep overlap zero.
    """
    m = members.select(*within, unit, item).distinct()
    size = m.groupBy(*within, unit).agg(F.count(F.lit(1)).alias("n"))
    common = m.select(*within, F.col(unit).alias("a"), item).join(
        m.select(*within, F.col(unit).alias("b"), item), [*within, item]).filter("a < b").groupBy(
        *within, "a", "b").agg(F.count(F.lit(1)).alias("common"))
    a = size.select(*within, F.col(unit).alias("a"), F.col("n").alias("n_a"))
    b = size.select(*within, F.col(unit).alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, within).filter("a < b")
    out = pairs.join(common, [*within, "a", "b"], "left").withColumn(
        "common", F.coalesce("common", F.lit(0)))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return out.select(*within, "a", "b", "n_a", "n_b", "common", (F.col("common") / union).alias("jaccard"))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with multiplicity; empty when the tables are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Report of the first k rows; ties must be broken by the caller's order."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


# -- units ---------------------------------------------------------------------------------
# Names of the baselines.
BASELINES = ("rest", "other_coaches", "other_coaches_same_club", "opponents")


def select_units(trans: DataFrame, unit: str, value, baseline: str, club: str | None = None
                 ) -> DataFrame:
    """Focus and baseline rows of a comparison, tagged in column ``role``.

    Nulls are explicit: a row without unit belongs to the rest, never to other coaches.
    """
    if baseline not in BASELINES:
        raise ValueError(f"unknown baseline: {baseline}")
    if unit not in trans.columns:
        raise KeyError(f"no column {unit}")
    if baseline in ("other_coaches_same_club", "opponents") and club is None:
        raise ValueError(f"baseline {baseline} needs a club")
    if baseline == "opponents" and unit == "coach_faced":
        raise ValueError("opponents would contain the focus in the defensive view")
    focus = F.col(unit).eqNullSafe(F.lit(value))
    faced = unit == "coach_faced"
    # null is not another coach: the comparison is null there and selects nothing
    another = F.col(unit if faced else "coach") != F.lit(value) if baseline.startswith("other") else F.lit(False)
    rivals = F.col("team") != F.lit(club)
    base = dict(zip(BASELINES, (~focus, another, another & (rivals if faced else ~rivals), rivals)))[baseline]
    # the focus comes first: its rows are never their own baseline
    side = F.coalesce(F.when(focus, F.lit("focus")), F.when(base, F.lit("base")))
    return trans.withColumn("role", side).filter(F.col("role").isNotNull())


def perspective(trans: DataFrame, view: str, unit: str, club: str | None = None) -> DataFrame:
    """attack: all rows; defense: rows of the rivals, which needs coach_faced as the unit."""
    if view == "attack":
        return trans
    if view != "defense":
        raise ValueError(f"unknown perspective: {view}")
    if club is None:
        raise ValueError("the defensive view needs a club")
    if unit == "coach":
        raise ValueError("coach is null on rival rows: use coach_faced")
    if "coach_faced" not in trans.columns:
        raise KeyError("no column coach_faced")
    return trans.filter(F.col("team") != club)


def complete_matches(df: DataFrame, match: str, attacker: str, defender: str) -> DataFrame:
    """Rows of matches with exactly two attackers and two (attacker, defender) sides."""
    good = df.groupBy(match).agg(F.countDistinct(attacker).alias("a"),
                                 F.countDistinct(attacker, defender).alias("s"))
    return df.join(good.filter("a = 2 and s = 2").select(match), match, "left_semi")


# Stage name parts.
REGULAR_PREFIXES = ("apertura", "clausura", "regular")
FINAL_PARTS = ("final", "semi", "quarter", "reclasific", "play", "repechaje")


def stage_class(stage: Column) -> Column:
    """regular, final or unknown; unknown stages are left out of every fit."""
    s = F.lower(F.trim(F.coalesce(stage, F.lit(""))))
    return (F.when(s.rlike("|".join(FINAL_PARTS)), "final")
            .when(s.rlike("^(" + "|".join(REGULAR_PREFIXES) + ")"), "regular")
            .otherwise("unknown"))
