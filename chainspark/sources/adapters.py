"""Adapters: nested feeds to flat logs, scope filters, club subsets, line-ups, edges, sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """{id, name} structs become x and x_id, other structs recurse with their prefix, lists of
    structs become JSON text, other lists stay. The select list is generated from the schema."""
    cols = []

    def walk(path: str, name: str, kind: T.DataType) -> None:
        c = F.col(path)
        if isinstance(kind, T.StructType):
            names = set(kind.names)
            if names == {"id", "name"}:
                cols.extend([c["name"].alias(name), c["id"].alias(f"{name}{sep}id")])
                return
            for f in kind:
                walk(f"{path}.`{f.name}`", f"{name}{sep}{f.name}", f.dataType)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            cols.append(F.to_json(c).alias(name))
        else:
            cols.append(c.alias(name))
    for f in df.schema:
        walk(f"`{f.name}`", f.name, f.dataType)
    return df.select(*cols)


def scope_of(index: DataFrame, seasons=None, stages=None, clubs=None, ids=None) -> DataFrame:
    """Rows of the match index chosen by season, stage class, club or id list."""
    from chainspark.operators.relations import stage_class

    m = index
    if seasons:
        m = m.filter(F.col("season").isin(*seasons))
    if stages:
        m = m.filter(stage_class(F.col("stage")).isin(*stages))
    if clubs:
        m = m.filter(F.col("home").isin(*clubs) | F.col("away").isin(*clubs))
    if ids is not None:
        m = m.join(ids.select("match_id").distinct(), "match_id", "left_semi")
    return m


def in_scope(events: DataFrame, index: DataFrame, seasons=None, stages=None, clubs=None, ids=None
             ) -> DataFrame:
    """Events of matches chosen on the match index by season, stage class, club or id list."""
    m = scope_of(index, seasons, stages, clubs, ids)
    return events.join(m.select("match_id").distinct(), "match_id", "left_semi")


def write_scope(events: DataFrame, scope: DataFrame, path: str, order: str = "index") -> None:
    """Write the events of a scope's matches (match_id, season) in parts, one folder per season.

    Rows are dealt by range of (season, match, order): a part holds neighbouring matches, so that its
    min/max statistics prune reads by match, and a match of any size is cut into several parts. Only
    the seasons that are written are replaced; others under the path stay as they are. A match without
    events, and a null match_id, write nothing.
    """
    tagged = events.drop("season").join(scope.select("match_id", "season").distinct(), "match_id")
    (tagged.repartitionByRange("season", "match_id", order).sortWithinPartitions("season", "match_id", order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path))


def read_scope(scope: DataFrame, path: str) -> DataFrame:
    """Events under the path of a scope's matches; folders of seasons outside it are pruned before the scan."""
    wanted = scope.select("season", "match_id").distinct()
    seasons = [r["season"] for r in wanted.select("season").distinct().collect()]  # one folder each
    parts = scope.sparkSession.read.parquet(path).filter(F.col("season").isin(*seasons) if seasons else F.lit(False))
    return parts.join(wanted, ["season", "match_id"], "left_semi")


def club_subsets(events: DataFrame, index: DataFrame) -> DataFrame:
    """Every event once per club of its match: one job for all clubs, partition by ``club``."""
    sides = index.select("match_id", F.explode(F.array("home", "away")).alias("club")).distinct()
    return events.join(sides, "match_id")


def match_index(meta: DataFrame) -> DataFrame:
    """Flat index rows from match metadata: sides, managers, stage, season, date."""
    return meta.select(
        "match_id", F.to_date(F.substring(F.col("match_date").cast("string"), 1, 10)).alias("match_date"),
        F.col("home_team.name").alias("home"), F.col("away_team.name").alias("away"),
        F.col("competition_stage.name").alias("stage"), F.col("season.name").alias("season"))


def match_managers(meta: DataFrame) -> DataFrame:
    """One row per (match, club) with the first listed manager and how many are listed."""
    side = F.explode(F.array("home_team", "away_team"))
    d = meta.select("match_id", F.to_date(F.substring(F.col("match_date").cast("string"), 1, 10)).alias("match_date"), side.alias("t"))
    return d.select("match_id", "match_date", F.col("t.name").alias("club"),
                    F.get(F.col("t.managers"), 0)["name"].alias("coach"), F.size("t.managers").alias("n_managers"))


def pass_edges(raw: DataFrame, coaches: DataFrame | None = None) -> DataFrame:
    """Passes with a recipient; completed when the outcome is missing; coach by (match, team)."""
    e = raw.filter((F.col("type.name") == "Pass") & F.col("pass.recipient.id").isNotNull()).select(
        "match_id", F.col("team.name").alias("team"), F.col("player.id").alias("player_id"),
        F.col("pass.recipient.id").alias("recipient_id"), F.col("pass.outcome").isNull().alias("completed"))
    if coaches is None:
        return e
    return e.join(coaches.select("match_id", F.col("club").alias("team"), "coach"), ["match_id", "team"], "left")


def line_up_spells(raw: DataFrame) -> DataFrame:
    """Position spells from line-ups: explode players, then their positions."""
    p = raw.select("match_id", "team", F.explode("lineup").alias("p"))
    return p.select("match_id", "team", F.col("p.player_id").alias("player_id"), F.explode("p.positions").alias("s")).select(
        "match_id", "team", "player_id", "s.*")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", files: int | None = None) -> None:
    """Result table as parquet, JSON lines or CSV with header."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    w = (df.coalesce(files) if files else df).write.mode("overwrite")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def with_provenance(df: DataFrame, config: dict, version: str) -> DataFrame:
    """Attach the hash of the parameters and the code version to every row."""
    text = json.dumps(config, sort_keys=True, default=str)
    return df.withColumns({"config_hash": F.lit(hashlib.sha256(text.encode()).hexdigest()[:16]),
                           "version": F.lit(version)})
