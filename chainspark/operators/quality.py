"""Data-quality operators: profiles, axis checks, reconciliation, identity of artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspark.functions.scan import exact_quantile


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, distinct values (sketch), min and max as text.

    All columns are profiled in one aggregation.
    """
    cols = [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        aggs += [F.sum(c.isNull().cast("bigint")).alias(f"u{k}"), F.approx_count_distinct(c).alias(f"d{k}"),
                 F.min(c).cast("string").alias(f"a{k}"), F.max(c).cast("string").alias(f"z{k}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                              F.col("n"), F.col(f"u{k}").alias("nulls"), F.col(f"d{k}").alias("distinct_about"),
                              F.col(f"a{k}").alias("min"), F.col(f"z{k}").alias("max"))
                     for k, f in enumerate(cols)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def null_shares(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in cols])


def mirrored_axis(df: DataFrame, keys: list[str], value: str, side: str, extent: float) -> DataFrame:
    """Mean of both sides of an axis; mirrored frames add up to the extent."""
    d = df.groupBy(*keys).agg(F.avg(F.when(F.col(side), F.col(value))).alias("mean_a"),
                              F.avg(F.when(~F.col(side), F.col(value))).alias("mean_b"))
    return d.withColumn("gap", F.col("mean_a") + F.col("mean_b") - extent)


def band_share(df: DataFrame, keys: list[str], value: str, cuts: tuple[float, float]) -> DataFrame:
    """Share of rows in the low, middle and high band of a coordinate."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg((v < cuts[0]).cast("double")).alias("low"),
                                 F.avg(((v >= cuts[0]) & (v < cuts[1])).cast("double")).alias("middle"),
                                 F.avg((v >= cuts[1]).cast("double")).alias("high"))


def regression_check(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Compare two artifacts: rows, duplicate keys, keys on one side, changed rows.

    Equal rows of both sides are counted together, their counts once more by key: each table is dealt once.
    Null keys repeat each other, but are found on no other side.
    """
    cols = old.columns
    both = old.select("*", F.lit(1).alias("__old"), F.lit(0).alias("__new")).unionByName(
        new.select(*cols, F.lit(0).alias("__old"), F.lit(1).alias("__new")))
    rows = both.groupBy(*cols).agg(F.sum("__old").alias("__old"), F.sum("__new").alias("__new"))
    o, n = F.col("__old"), F.col("__new")
    per = rows.groupBy(*keys).agg(F.sum(o).alias("__old"), F.sum(n).alias("__new"), F.sum(F.abs(o - n)).alias("__diff"))
    alone = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))
    out = per.agg(total(o).alias("rows_old"), total(n).alias("rows_new"), F.count_if(n > 1).alias("duplicate_keys"),
                  total(F.when(alone | (n == 0), o)).alias("keys_lost"), total(F.when(alone | (o == 0), n)).alias("keys_added"),
                  total(F.col("__diff")).alias("rows_different"))
    return out.withColumn("same", (F.col("rows_different") == 0) & (F.col("duplicate_keys") == 0))


def reconcile(a: DataFrame, b: DataFrame, match: str, team: str, player: str, max_missing: float = 0.15
              ) -> DataFrame:
    """Per match: same sides in both sources, share of players of ``a`` missing in ``b``."""
    sides_a = a.groupBy(match).agg(F.sort_array(F.collect_set(team)).alias("sa"))
    sides_b = b.groupBy(match).agg(F.sort_array(F.collect_set(team)).alias("sb"))
    pa, pb = a.select(match, team, player).distinct(), b.select(match, team, player).distinct()
    gone = pa.join(pb, [match, team, player], "left_anti").groupBy(match).agg(F.count(F.lit(1)).alias("gone"))
    have = pa.groupBy(match).agg(F.count(F.lit(1)).alias("players"))
    d = sides_a.join(sides_b, match, "full").join(have, match, "left").join(gone, match, "left")
    share = F.coalesce("gone", F.lit(0)) / F.col("players")
    return d.select(match, F.coalesce(F.col("sa") == F.col("sb"), F.lit(False)).alias("same_sides"), share.alias("missing"),
                    (F.coalesce(F.col("sa") == F.col("sb"), F.lit(False)) & (share <= max_missing)).alias("ok"))


def require_identity(df: DataFrame, expected: dict[str, object]) -> DataFrame:
    """Fail when a result table carries another unit, value or perspective than expected."""
    for c in expected:
        if c not in df.columns:
            raise KeyError(f"result table has no identity column {c}")
    wrong = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in expected.items()])
    bad = df.select(*expected).filter(wrong).limit(1).collect()
    if bad:
        raise ValueError(f"table belongs to {bad[0].asDict()}, expected {expected}")
    return df


def eligible_units(trans: DataFrame, keys: list[str], min_possessions: int = 1000) -> DataFrame:
    return trans.groupBy(*keys).agg(F.countDistinct("poss_uid").alias("possessions")).filter(
        F.col("possessions") >= min_possessions)


def pair_table(pairs: DataFrame, strata: DataFrame, on: list[str]) -> DataFrame:
    """Flat, sortable table: pair, size, p, q, stratum, verdict."""
    d = pairs.join(strata, on, "left")
    verdict = (F.when(F.col("q") <= 0.05, F.when(F.col("stratum") == "parallel", "different").otherwise("different, trend unclear"))
               .otherwise("not distinguished"))
    return d.withColumn("verdict", verdict)


def volume_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per key with the exact median of a value: the volume probe."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.join(exact_quantile(df, keys, value, {"median": 0.5}), keys)
