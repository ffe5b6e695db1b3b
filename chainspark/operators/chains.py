"""From events to transitions: score state, action extraction, states, absorption, length rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.functions.scan import position
from chainspark.space import StateSpace

OWN_GOAL = "Own Goal For"


@dataclass(frozen=True)
class ChainConfig:
    """Parameters that change results. The feed's own labels."""

    moving_types: tuple[str, ...] = ("Pass", "Carry", "Shot")
    loss_outcomes: tuple[str, ...] = ("Incomplete", "Out", "Pass Offside", "Unknown",
                                      "Injury Clearance")
    min_actions: int = 2
    min_actions_rival: int = 1
    min_carry: float = 5.0
    score_labels: tuple[str, str, str] = ("losing", "drawing", "winning")
    phase_default: str = "open"
    phases: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "open": ("Regular Play", "From Kick Off"),
        "transition": ("From Counter", "From Keeper"),
        "restart": ("From Throw In", "From Goal Kick"),
        "set_piece": ("From Corner", "From Free Kick", "Other")})


def chunk_by_index(col: str = "index", size: int = 4096) -> Column:
    return F.floor(F.col(col) / size)


def phase_of(pattern: Column, cfg: ChainConfig, space: StateSpace) -> Column:
    """Phase of a possession from how it started; unmapped patterns get the default."""
    unknown = (set(cfg.phases) | {cfg.phase_default}) - set(space.phases)
    if unknown:
        raise ValueError(f"phases outside the state space: {sorted(unknown)}")
    pairs = [F.lit(x) for phase, pats in cfg.phases.items() for p in pats for x in (p, phase)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), pattern), F.lit(cfg.phase_default))


# -- score ---------------------------------------------------------------------------------
def is_goal(kind: str = "type", outcome: str = "shot_outcome") -> Column:
    shot = (F.col(kind) == "Shot") & (F.col(outcome) == "Goal")
    return F.coalesce(shot, F.lit(False)) | (F.col(kind) == OWN_GOAL)


def add_score_state(events: DataFrame, cfg: ChainConfig = ChainConfig(), club: str | None = None,
                    order: tuple[str, ...] = ("index",), chunk: Column | None = None, keep: Column | None = None) -> DataFrame:
    """Goal difference before each event, for the possessor and for the focal club.

    Runs over all events of a match, before any filter. The scan is chunked by event index, so
    one oversized match does not end up in one task. Goals and teams of a match are counted in one
    aggregate per (match, chunk, team); the rows meet its totals where their chunk is dealt, once.
    Events without a match have no score and are left out. Only rows that ``keep`` names are returned;
    all events count.
    """
    df = events.filter(F.col("match_id").isNotNull()).withColumn("__goal", is_goal().cast("int"))
    chunk = chunk if chunk is not None else chunk_by_index()
    # one struct is the key of the join and of the windows; chunks may be null
    dealt = F.struct("match_id", chunk.alias("chunk"))
    match = Window.partitionBy("match_id")
    teams = df.groupBy("match_id", chunk.alias("chunk"), "team").agg(F.sum("__goal").alias("ab")).withColumn("__team_a", F.min("team").over(match))
    chunks = teams.groupBy("match_id", "chunk").agg(
        F.min("__team_a").alias("__team_a"), F.sum("ab").alias("ab"),
        F.sum(F.when(F.col("team") == F.col("__team_a"), F.col("ab")).otherwise(0)).alias("a"))
    earlier = match.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(F.struct("match_id", "chunk").alias("__g"), "__team_a",
                          *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in ("a", "ab")])
    if keep is not None:
        df = df.filter(keep | (F.col("__goal") == 1))
    df = df.withColumn("__g", dealt).drop("match_id").join(carry, "__g").withColumn("match_id", F.col("__g.match_id"))
    before = Window.partitionBy("__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("team") == F.col("__team_a"), F.col("__goal")).otherwise(0)
    a, ab = (F.col(c) + F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in (("__a", own), ("__ab", F.col("__goal"))))
    df = df.withColumn("__lead", a - (ab - a))
    if keep is not None:
        df = df.filter(keep)
    lead_a = F.col("__lead")

    def seen_by(team: Column) -> Column:
        return F.when(team == F.col("__team_a"), lead_a).otherwise(-lead_a).cast("bigint")

    df = df.withColumn("goal_diff", seen_by(F.col("possession_team")))
    df = df.withColumn("score_state", S.sign_label(F.col("goal_diff"), cfg.score_labels))
    if club is None:
        null = F.lit(None)
        df = df.withColumn("goal_diff_club", null.cast("bigint")).withColumn(
            "score_state_club", null.cast("string"))
    else:
        own_view = F.when(F.col("possession_team") == club, F.col("goal_diff")).otherwise(
            -F.col("goal_diff"))
        df = df.withColumn("goal_diff_club", own_view).withColumn(
            "score_state_club", S.sign_label(F.col("goal_diff_club"), cfg.score_labels))
    return df.select(*events.columns, "goal_diff", "score_state", "goal_diff_club", "score_state_club")


# -- actions -------------------------------------------------------------------------------
def end_point(kind: Column, axis: str) -> Column:
    return (F.when(kind == "Pass", F.col(f"pass_end_{axis}"))
            .when(kind == "Carry", F.col(f"carry_end_{axis}"))
            .otherwise(F.col(f"shot_end_{axis}")))


def outcome_of(cfg: ChainConfig = ChainConfig()) -> Column:
    """End state of an action; 'Out' is tested before the loss list, which also holds it."""
    kind, shot, pass_ = F.col("type"), F.col("shot_outcome"), F.col("pass_outcome")
    return (F.when((kind == "Shot") & (shot == "Goal"), "GOAL")
            .when(kind == "Shot", "SHOT_NOGOAL")
            .when((kind == "Pass") & (pass_ == "Out"), "OUT")
            .when((kind == "Pass") & pass_.isin(*cfg.loss_outcomes), "LOSS")
            .otherwise(""))


def extract_actions(events: DataFrame, cfg: ChainConfig = ChainConfig(),
                    flag: str = "under_pressure") -> DataFrame:
    """Moving actions of the possessing team with end point, outcome and pressure flag."""
    kind = F.col("type")
    df = events.filter(is_action(cfg))
    df = df.withColumns({"end_x": end_point(kind, "x"), "end_y": end_point(kind, "y"),
                         "outcome": outcome_of(cfg), "under_pressure": pressed(events, flag)})
    return df


def pressed(events: DataFrame, flag: str = "under_pressure") -> Column:
    found = F.col(flag).cast("boolean") if flag in events.columns else F.lit(False)
    return F.coalesce(found, F.lit(False))


def is_action(cfg: ChainConfig = ChainConfig()) -> Column:
    """Moving actions of the possessing team that have a place; short carries are none."""
    kind = F.col("type")
    found = ((F.col("possession_team") == F.col("team")) & kind.isin(*cfg.moving_types)
             & F.col("start_x").isNotNull() & F.col("start_y").isNotNull())
    if cfg.min_carry > 0:
        run = S.distance(F.col("start_x"), F.col("start_y"), end_point(kind, "x"), end_point(kind, "y"))
        # a carry without an end has no length and goes as well
        found &= (kind != "Carry") | (run >= cfg.min_carry)
    return found


def to_states(df: DataFrame, space: StateSpace) -> DataFrame:
    """from_state, to_state and is_absorbing of rows with phase, start, end and outcome."""
    phase = space.phase_index(F.col("phase"))
    start = space.state(space.zone(F.col("start_x"), F.col("start_y")), phase)
    end = space.state(space.zone(F.col("end_x"), F.col("end_y")), phase)
    reached = F.coalesce(space.absorbing_index(F.col("outcome")), end,
                         F.lit(space.absorbing_state("LOSS")).cast("bigint"))
    return df.withColumns({"from_state": start, "to_state": reached,
                           "is_absorbing": reached >= space.n_transient})


# -- absorption and length -----------------------------------------------------------------
def close_possessions(trans: DataFrame, space: StateSpace, min_actions: int = 1,
                      min_rival: int | None = None, club: str | None = None,
                      poss: str = "poss_uid", last: Column | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Add a TERMINAL row to LOSS after possessions that end in a transient state, and drop
    possessions with too few rows (the added row counts).

    Size and last row come from one aggregate per possession (partial aggregation first), so
    no possession has to fit a task; the extra row is exploded from the last one. ``rows`` has the
    same rows before costlier columns are added; the aggregate reads these. Where rows tell
    themselves whether they are the ``last`` and none is dropped, nothing is exchanged.
    """
    cols = trans.columns
    if last is not None and min_actions <= 1 and min_rival is None:
        df, ends = trans, last & ~F.col("is_absorbing")
    else:
        per = (trans if rows is None else rows).groupBy(poss).agg(
            F.count(F.lit(1)).alias("__n"),
            F.max("event_index").alias("__last"),
            F.max_by("is_absorbing", "event_index").alias("__closed"))
        open_end = ~F.col("__closed")
        need = F.lit(min_actions)
        if club is not None and min_rival is not None:
            need = F.when(F.col("team") == club, min_actions).otherwise(min_rival)
        df = trans.join(per, poss)
        if min_actions > 1 or min_rival is not None:
            df = df.filter(F.col("__n") + open_end.cast("int") >= need)
        ends = open_end & (F.col("event_index") == F.col("__last"))
    changed = {"from_state": F.col("to_state"), "action_type": F.lit("TERMINAL"),
               "event_index": F.col("event_index") + 1, "is_absorbing": F.lit(True),
               "to_state": F.lit(space.absorbing_state("LOSS")).cast("bigint")}
    for c in ("player_id", "player", "under_pressure"):
        if c in cols:
            changed[c] = F.lit(None).cast(trans.schema[c].dataType)
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    extra = F.struct(*[changed.get(c, F.col(c)).cast(trans.schema[c].dataType).alias(c)
                       for c in cols])
    return df.select(F.explode(F.when(ends, F.array(row, extra)).otherwise(F.array(row)))
                     .alias("r")).select("r.*")


def append_terminal(trans: DataFrame, space: StateSpace, last: Column | None = None) -> DataFrame:
    return close_possessions(trans, space, last=last)


def drop_short(trans: DataFrame, min_actions: int, min_rival: int | None = None,
               club: str | None = None, poss: str = "poss_uid") -> DataFrame:
    """Drop possessions with fewer rows than required, TERMINAL included in the count.

    Only the ids of short possessions are joined back (anti join), which AQE can broadcast or
    split on skew.
    """
    need = F.lit(min_actions)
    if club is not None and min_rival is not None:
        need = F.when(F.col("team") == club, min_actions).otherwise(min_rival)
    short = trans.groupBy(poss).agg(F.count(F.lit(1)).alias("n"), F.min("team").alias("team"))
    return trans.join(short.filter(F.col("n") < need).select(poss), poss, "left_anti")


TRANSITION_COLUMNS = ["poss_uid", "match_id", "team", "event_index", "phase", "score_state",
                      "score_state_club", "action_type", "player_id", "player", "under_pressure",
                      "from_state", "to_state", "is_absorbing"]


def build_transitions(events: DataFrame, space: StateSpace, cfg: ChainConfig = ChainConfig(),
                      team: str | None = None, club: str | None = None,
                      order: tuple[str, ...] = ("index",), chunk: Column | None = None
                      ) -> DataFrame:
    """Normalised events to the transition table, one lazy plan without any collect.

    States and phases do not depend on the score: they are worked out before rows are dealt, and
    only actions and goals are dealt, with the columns of the result.
    """
    kind = F.col("type")
    wanted = is_action(cfg)
    if team is not None:
        wanted &= F.col("possession_team") == team
    df = events.withColumns({"end_x": end_point(kind, "x"), "end_y": end_point(kind, "y"), "outcome": outcome_of(cfg),
                             "under_pressure": pressed(events), "phase": phase_of(F.col("play_pattern"), cfg, space),
                             "player_id": F.col("player_id").cast("bigint"), "__keep": F.coalesce(wanted, F.lit(False))})
    df = to_states(df, space)
    uid = F.concat_ws("_", F.col("match_id").cast("string"), F.col("possession").cast("string")).alias("poss_uid")
    rows = df.filter(F.col("__keep") & F.col("match_id").isNotNull()).select(uid, F.col("index").alias("event_index"), "is_absorbing")
    # states travel as numbers below 2^31
    df = add_score_state(df.withColumns({c: F.col(c).cast("int") for c in ("from_state", "to_state")}), cfg, club, order, chunk, F.col("__keep"))
    df = df.select(
        uid, "match_id", "team", F.col("index").alias("event_index"), "phase",
        "score_state", "score_state_club", F.col("type").alias("action_type"),
        "player_id", "player", "under_pressure",
        *[F.col(c).cast("bigint").alias(c) for c in ("from_state", "to_state")], "is_absorbing")
    if club is None or cfg.min_actions == cfg.min_actions_rival:
        return close_possessions(df, space, cfg.min_actions, rows=rows)
    return close_possessions(df, space, cfg.min_actions, cfg.min_actions_rival, club, rows=rows)


# -- reports on transitions ----------------------------------------------------------------
def coordinate_sanity(trans: DataFrame, space: StateSpace, min_columns: int = 3) -> DataFrame:
    """Correlation of the zone column with the goal rate of its actions; ok above 0.5."""
    ix = F.floor(space.zone_of_state(F.col("from_state")) / space.ny)
    per = trans.groupBy(ix.alias("ix")).agg(
        F.avg((F.col("to_state") == space.absorbing_state("GOAL")).cast("double")).alias("rate"))
    c = F.corr(F.col("ix").cast("double"), F.col("rate"))
    out = per.agg(F.count(F.lit(1)).alias("n_columns"), c.alias("corr"))
    return out.withColumn("ok", F.coalesce((F.col("n_columns") >= min_columns)
                                           & (F.col("corr") > 0.5), F.lit(False)))


def build_report(trans: DataFrame, by: str) -> DataFrame:
    """Rows, possessions, matches and pressure rate, overall and per level of a column."""
    real = F.col("action_type") != "TERMINAL"
    one = trans.withColumn("level", F.explode(F.array(F.lit("all"), F.col(by))))
    return one.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("poss_uid").alias("possessions"),
        F.countDistinct("match_id").alias("matches"),
        F.sum((~real).cast("bigint")).alias("terminal_rows"),
        F.avg(F.when(real, F.col("under_pressure").cast("double"))).alias("pressure_rate"))


def per_possession(trans: DataFrame, space: StateSpace, keys: tuple[str, ...] = ("team",),
                   with_terminal: bool = True) -> DataFrame:
    """One row per possession: actions, shot, goal, pressure rate; keys are constant inside."""
    df = trans if with_terminal else trans.filter(F.col("action_type") != "TERMINAL")
    goal, shot = space.absorbing_state("GOAL"), space.absorbing_state("SHOT_NOGOAL")
    to = F.col("to_state")
    return df.groupBy("poss_uid").agg(
        *[F.min(k).alias(k) for k in keys],
        F.count(F.lit(1)).alias("n_actions"),
        F.max(to.isin(goal, shot).cast("int")).alias("shot"),
        F.max((to == goal).cast("int")).alias("goal"),
        F.avg(F.col("under_pressure").cast("double")).alias("pressure_rate"))


def length_histogram(trans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    per = trans.groupBy("poss_uid").agg(*[F.min(k).alias(k) for k in keys],
                                        F.count(F.lit(1)).alias("length"))
    return per.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("possessions"))


def self_transitions(trans: DataFrame, by: str) -> DataFrame:
    """Share of i -> i rows among transient-to-transient rows, overall and per level."""
    rows = trans.withColumn("level", F.explode(F.array(F.lit("all"), F.col(by))))
    loop = (F.col("from_state") == F.col("to_state")).cast("bigint")
    moving = F.when(~F.col("is_absorbing"), loop)
    return rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(loop).alias("loops"),
        F.avg(loop).alias("share"), F.avg(moving).alias("share_of_moving"))


def with_index(trans: DataFrame, size: str | None = "length", poss: str = "poss_uid",
               chunk: Column | None = None) -> DataFrame:
    """Action index k inside the possession and its length L."""
    return position(trans, [poss], ["event_index"],
                    chunk if chunk is not None else chunk_by_index("event_index"), "k", size)
