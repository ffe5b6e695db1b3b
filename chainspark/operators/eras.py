"""Eras of coaches at clubs: validation, construction, attachment to transitions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.scan import Running, neighbour, running, scan
from chainspark.operators.relations import runs


# -- validation ----------------------------------------------------------------------------
def era_problems(eras: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Eras that end before they start or overlap the previous era of the club."""
    d = running(eras, ["club"], ["start_date", "end_date", "coach"],
                [Running("prev_end", "max", F.col("end_date"))], chunk)
    why = (F.when(F.col("end_date") < F.col("start_date"), "reversed")
           .when(F.col("start_date") <= F.col("prev_end"), "overlap"))
    return d.withColumn("problem", why).filter(F.col("problem").isNotNull()).select(
        "club", "coach", "start_date", "end_date", "problem")


def load_eras(eras: DataFrame) -> DataFrame:
    """Typed eras; fails when any era is invalid."""
    d = eras.withColumns({c: S.date_of_text(F.col(c).cast("string"))
                          for c in ("start_date", "end_date")})
    bad = era_problems(d).limit(5).collect()
    if bad:
        raise ValueError(f"invalid eras: {bad}")
    return d


def extend_ends(eras: DataFrame, chunk: Column | None = None) -> DataFrame:
    """End every era on the day before the next one starts."""
    d = neighbour(eras, ["club"], ["start_date"], {"__next": F.col("start_date")}, 1, chunk)
    return d.withColumn("end_date", F.coalesce(F.date_sub("__next", 1), F.col("end_date"))).drop(
        "__next")


# -- attachment ----------------------------------------------------------------------------
def match_coach(match_dates: DataFrame, eras: DataFrame) -> DataFrame:
    """(match_id, club, match_date) -> coach whose closed interval holds the day.

    Eras of a club do not overlap, so the as-of lookup with end check is a range join: equality
    on club plus a range on dates.
    """
    d = match_dates.join(eras.select("club", "coach", "start_date", "end_date"), "club")
    return d.filter(F.col("match_date").between(F.col("start_date"), F.col("end_date"))).select(
        "match_id", "club", "coach", "match_date")


def attach_coach(trans: DataFrame, mc: DataFrame, club: str | None = None) -> DataFrame:
    """Coach of the executing team; rivals of a single-club artifact keep null."""
    if club is not None:
        one = mc.filter(F.col("club") == club).select("match_id", "coach", "match_date")
        out = trans.join(one, "match_id", "left")
        return out.withColumn("coach", F.when(F.col("team") == club, F.col("coach")))
    out = trans.join(mc.select("match_id", F.col("club").alias("team"), "coach"),
                     ["match_id", "team"], "left")
    days = mc.groupBy("match_id").agg(F.min("match_date").alias("match_date"))
    return out.join(days, "match_id", "left")


def attach_coach_faced(trans: DataFrame, mc: DataFrame) -> DataFrame:
    """Coach of the other team in the match; the rival comes from the rows themselves.

    Teams per match are reduced first (two rows per match), so the self join never touches
    action rows.
    """
    sides = trans.select("match_id", "team").distinct()
    rival = sides.join(sides.withColumnRenamed("team", "rival"), "match_id").filter(
        "team <> rival").groupBy("match_id", "team").agg(F.min("rival").alias("rival"))
    faced = rival.join(mc.select("match_id", F.col("club").alias("rival"),
                                 F.col("coach").alias("coach_faced")), ["match_id", "rival"], "left")
    return trans.join(faced.select("match_id", "team", "coach_faced"), ["match_id", "team"], "left")


def drop_excluded(events: DataFrame, exclusions: DataFrame, club: str,
                  only_absorbed: bool = True) -> DataFrame:
    """Drop whole matches listed for this club; the same match stays in other clubs' data."""
    ex = exclusions.filter(F.col("club") == club)
    if only_absorbed and "led_the_era" in ex.columns:
        ex = ex.filter(F.col("led_the_era").cast("int") == 0)
    ids = ex.select(F.col("match_id").cast("bigint").alias("match_id")).filter(
        "match_id is not null").distinct()
    return events.join(ids, "match_id", "left_anti")


def matches_without_date(trans: DataFrame, match_dates: DataFrame) -> DataFrame:
    """Matches with events but no date: must be empty; extra dates are legal."""
    return trans.select("match_id").distinct().join(match_dates.select("match_id"), "match_id",
                                                    "left_anti")


# -- coverage ------------------------------------------------------------------------------
def coverage(trans: DataFrame, min_matches: int = 25, keys=("team",)) -> DataFrame:
    """Matches, possessions and rows per era, share of the club's matches, size verdict."""
    total = trans.groupBy(*keys).agg(F.countDistinct("match_id").alias("__m"))
    d = trans.groupBy(*keys, "coach").agg(
        F.countDistinct("match_id").alias("matches"),
        F.countDistinct("poss_uid").alias("possessions"), F.count(F.lit(1)).alias("transitions"))
    return d.join(F.broadcast(total) if not keys else total, list(keys)).withColumns({
        "pct_matches": F.round(F.col("matches") / F.col("__m") * 100, 1),
        "sufficient": F.col("matches") >= min_matches}).drop("__m")


def unmapped(trans: DataFrame, keys=("team",)) -> DataFrame:
    return trans.filter(F.col("coach").isNull()).groupBy(*keys, "match_id").agg(
        F.min("match_date").alias("match_date"))


def analysis_units(cover: DataFrame, flags: DataFrame, verified: DataFrame) -> DataFrame:
    """Eras of sufficient size; a first-of-window era needs a verification with a source."""
    ok = verified.filter(F.trim(F.coalesce("source", F.lit(""))) != "").select(
        F.col("club").alias("team"), "coach").distinct()
    risky = flags.filter(F.col("flags").contains("FIRST_OF_WINDOW")).select(
        F.col("club").alias("team"), "coach")
    blocked = risky.join(ok, ["team", "coach"], "left_anti")
    return cover.filter("sufficient").join(blocked, ["team", "coach"], "left_anti")


# -- construction --------------------------------------------------------------------------
def apply_corrections(managers: DataFrame, fixes: DataFrame) -> DataFrame:
    """Reassign the coach of a club's matches inside a date range."""
    f = fixes.select(F.col("club").alias("__c"), "start_date", "end_date",
                     F.col("coach").alias("__fix"))
    hit = (F.col("club") == F.col("__c")) & F.col("match_date").between(
        F.col("start_date"), F.col("end_date"))
    d = managers.join(f, hit, "left")
    return d.withColumn("coach", F.coalesce("__fix", "coach")).select(*managers.columns)


def coach_runs(managers: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Runs of consecutive matches under one coach: dates, size, seasons, multi-manager days."""
    d = runs(managers, ["club"], ["match_date", "match_id"], "coach", chunk)
    return d.groupBy("club", "run_id", "coach").agg(
        F.min("match_date").alias("start_date"), F.max("match_date").alias("end_date"),
        F.count(F.lit(1)).alias("n"), F.sum((F.col("n_managers") > 1).cast("bigint")).alias("multi"),
        F.sort_array(F.collect_set(S.season_label(F.col("match_date")))).alias("seasons"))


def merge_interims(run_table: DataFrame, max_matches: int, cut_lineage) -> DataFrame:
    """Fold runs of at most ``max_matches`` between two runs of the same coach into them.

    Every round merges the leftmost candidate of each stretch of adjacent candidates, and every
    second one after it; rounds end when no candidate is left. ``cut_lineage`` writes the small
    run table of a round and reads it back. Matches of a folded run count as absorbed, not as
    matches of the era.
    """
    d = run_table.withColumns({"merged": F.lit(0).cast("bigint"), "absorbed": F.lit(0).cast("bigint"),
                               "first_run": F.col("run_id"), "last_run": F.col("run_id"),
                               "__p": F.col("run_id")})
    chunk = F.floor(F.col("__p") / 4096)
    while True:  # every round with a candidate removes runs, so the rounds end
        d = scan(d, ["club"], ["__p"], chunk,
                 after={"__nc": F.struct(F.col("coach").alias("v"))},
                 before={"__pc": F.struct(F.col("coach").alias("v"))})
        cand = F.coalesce((F.col("n") <= max_matches) & (F.col("__nc.v") == F.col("__pc.v")),
                          F.lit(False))
        d = cut_lineage(d.withColumn("__cand", cand).drop("__nc", "__pc"))
        if d.filter("__cand").isEmpty():
            return d.drop("__cand", "__p")
        # candidates directly before this run; positions are dense, the first run is never one
        d = running(d, ["club"], ["__p"], [
            Running("__g", "max", F.when(~F.col("__cand"), F.col("__p")))], chunk)
        odd = F.coalesce((F.col("__p") - 1 - F.col("__g")) % 2 == 1, F.lit(False))
        d = d.withColumn("__take", F.col("__cand") & ~odd)
        # a taken run and the run after it join the run before
        d = running(d.withColumn("__stay", (~(F.col("__take") | odd)).cast("int")), ["club"], ["__p"],
                    [Running("__group", "sum", F.col("__stay"), inclusive=True)], chunk)
        own = ~F.col("__take")
        d = d.groupBy("club", "__group").agg(
            F.min("run_id").alias("run_id"), F.min_by("coach", "run_id").alias("coach"),
            F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"),
            F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n"),
            F.sum(F.when(own, F.col("multi")).otherwise(0)).alias("multi"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list(
                F.when(own, F.col("seasons")))))).alias("seasons"),
            (F.sum(F.when(own, F.col("merged")).otherwise(0))
             + F.sum(F.col("__take").cast("bigint"))).alias("merged"),
            (F.sum(F.when(own, F.col("absorbed")).otherwise(0))
             + F.sum(F.when(~own, F.col("n")).otherwise(0))).alias("absorbed"),
            F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"),
        ).withColumnRenamed("__group", "__p")


def flag_eras(merged: DataFrame, min_matches: int = 10, chunk: Column | None = None) -> DataFrame:
    """Label eras (roman suffix for repeated coaches) and list their flags."""
    chunk = chunk if chunk is not None else F.floor(F.col("run_id") / 4096)
    d = scan(merged, ["club"], ["run_id"], chunk,
             [Running("__first", "count", F.lit(1))])
    d = scan(d, ["club", "coach"], ["run_id"], chunk,
             [Running("__seen", "count", F.lit(1), inclusive=True)], {"__times": ("count", F.lit(1))})
    again = F.col("__times") > 1
    label = F.when(again, F.concat_ws(" ", "coach", F.repeat(F.lit("I"), F.col("__seen").cast("int")))
                   ).otherwise(F.col("coach"))
    flags = F.concat_ws(
        ";", F.when(F.col("__first") == 0, "FIRST_OF_WINDOW"),
        F.when(F.col("n") < min_matches, "SHORT"), F.when(again, "NOT_CONTIGUOUS"),
        F.when(F.col("multi") > 0, F.concat(F.lit("MULTI_MANAGER("), F.col("multi").cast("string"), F.lit(")"))),
        F.when(F.col("merged") > 0, F.concat(F.lit("MERGED("), F.col("merged").cast("string"), F.lit(")"))))
    return d.select("club", label.alias("coach"), F.col("coach").alias("coach_full"), "start_date",
                    "end_date", F.col("n").alias("n_matches"),
                    (F.col("n") + F.col("absorbed")).alias("n_in_range"),
                    F.col("absorbed").alias("n_absorbed"), F.concat_ws("|", "seasons").alias("seasons"),
                    (F.col("n") >= min_matches).alias("analysable"), flags.alias("flags"),
                    "first_run", "last_run")


def assign_matches(managers: DataFrame, flagged: DataFrame) -> DataFrame:
    """Every match with the era it falls into and whether that coach led it."""
    e = flagged.select("club", F.col("coach").alias("era"), "coach_full", "start_date", "end_date")
    d = managers.join(e, "club").filter(F.col("match_date").between(F.col("start_date"), F.col("end_date")))
    return d.select("club", "match_id", "match_date", "era", "start_date", "end_date",
                    F.col("coach").alias("coach_real"),
                    (F.col("coach") == F.col("coach_full")).cast("int").alias("led_the_era"))


def common_club(eras: DataFrame, pairs: DataFrame) -> DataFrame:
    """Club of a pair of coaches, when exactly one club had both."""
    e = eras.select("club", "coach").distinct()
    d = pairs.join(e.withColumnRenamed("coach", "a"), "a").join(
        e.select("club", F.col("coach").alias("b")), ["b", "club"])
    return d.groupBy("a", "b").agg(F.countDistinct("club").alias("k"), F.min("club").alias("club")
                                   ).filter("k = 1").select("a", "b", "club")


def derive_dates(ids: DataFrame, keys: list[str], min_gap: int, calendar: DataFrame,
                 n_regular: int, tail_days: tuple[int, int] = (7, 30), chunk: Column | None = None
                 ) -> DataFrame:
    """Dates for ids without any: blocks of near ids, matched in order to a season calendar.

    The regular-season size threshold is the smallest block size that leaves exactly
    ``n_regular`` blocks; smaller blocks are play-offs of the season before them.
    """
    from chainspark.operators.relations import gap_blocks, spread_dates

    d = gap_blocks(ids, keys, "match_id", min_gap, chunk)
    size = d.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("size"))
    # one row per distinct block size: how many blocks are at least that large
    per = size.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    cut = per.withColumn("at_least", F.sum("c").over(w)).filter(F.col("at_least") == n_regular).groupBy(
        *keys).agg(F.min("size").alias("cut"))
    size = size.join(cut, keys)
    wo = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    size = size.withColumn("regular", F.col("size") >= F.col("cut")).withColumn(
        "season_no", F.sum(F.col("regular").cast("int")).over(wo))
    cal = calendar.select("season_no", "season", "first_day", "last_day")
    s = size.join(cal, "season_no")
    lo = F.when(F.col("regular"), F.col("first_day")).otherwise(F.date_add("last_day", tail_days[0]))
    hi = F.when(F.col("regular"), F.col("last_day")).otherwise(F.date_add("last_day", tail_days[1]))
    name = F.when(F.col("regular"), F.col("season")).otherwise(F.concat("season", F.lit(" (play-off)")))
    s = s.select(*keys, "block", lo.alias("__lo"), hi.alias("__hi"), name.alias("season"))
    out = spread_dates(d.join(s, [*keys, "block"]), [*keys, "block"], ["match_id"], "__lo", "__hi",
                       chunk=chunk)
    return out.select(*keys, "match_id", "match_date", "season", "block", F.lit("derived").alias("source"))
