"""Resolution sweep: one chain at several grids, from one pass over the actions."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.operators import absorb as C
from chainspark.operators import estimate as E
from chainspark.session import cut_lineage
from chainspark.space import StateSpace


def lattice(moves: DataFrame, grids: list[tuple[int, int]], space: StateSpace, keys: list[str]) -> tuple[DataFrame, StateSpace]:
    """Actions counted once on the coarsest lattice that every grid is a union of cells of.

    keys, zone (of the start), to_zone, phase, outcome (state number among the absorbing ones or null),
    first, last (in the possession), n. The table's size depends on the lattice and the keys, not on the
    actions; a column of next_x, null after a possession's last action, must be there.
    """
    fine = replace(space, nx=math.lcm(*(nx for nx, _ in grids)), ny=math.lcm(*(ny for _, ny in grids)))
    outcome = fine.absorbing_index(F.col("outcome")) - fine.n_transient
    cells = moves.groupBy(
        *keys, fine.zone(F.col("start_x"), F.col("start_y")).alias("zone"), fine.zone(F.col("end_x"), F.col("end_y")).alias("to_zone"),
        space.phase_index(F.col("phase")).alias("phase"), outcome.alias("outcome"),
        (F.col("event_index") == 1).alias("first"), F.col("next_x").isNull().alias("last")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return cells, fine


def roll_up(cells: DataFrame, fine: StateSpace, grid: tuple[int, int], keys: list[str]) -> tuple[DataFrame, DataFrame, StateSpace]:
    """Transition counts (keys, i, j, n) and first states (keys, i, a) of one grid, from lattice cells.

    A possession that ends in a transient state goes on to LOSS, as in the transition table.
    """
    space = replace(fine, nx=grid[0], ny=grid[1])

    def coarse(zone: str) -> Column:
        x, y = F.floor(F.col(zone) / fine.ny), F.col(zone) % fine.ny
        return F.floor(x / (fine.nx // space.nx)) * space.ny + F.floor(y / (fine.ny // space.ny))
    i = space.state(coarse("zone"), F.col("phase"))
    j = F.coalesce(F.col("outcome") + space.n_transient, space.state(coarse("to_zone"), F.col("phase"))).cast("bigint")
    steps = F.array_compact(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.when(
        F.col("last") & F.col("outcome").isNull(), F.struct(F.col("j").alias("i"), F.lit(space.absorbing_state("LOSS")).cast("bigint").alias("j")))))
    d = cells.withColumns({"i": i, "j": j})
    counts = d.withColumn("s", F.explode(steps)).groupBy(*keys, F.col("s.i").alias("i"), F.col("s.j").alias("j")).agg(F.sum("n").alias("n"))
    starts = d.filter("first").groupBy(*keys, "i").agg(F.sum("n").alias("a"))
    return counts, starts, space


def resolution_sweep(moves: DataFrame, grids: list[tuple[int, int]], space: StateSpace, unit: str, min_count: int = 30) -> DataFrame:
    """Per grid and unit: transitions, share on the diagonal, sparsity, expected length with and without
    the diagonal, and both lengths over those of all units together (unit ``all``), in percent.

    Actions are read once; every grid is a sum over the lattice's cells.
    """
    cells, fine = lattice(moves, grids, space, [unit])
    cells = cut_lineage(cells.withColumn(unit, F.explode(F.array(F.col(unit), F.lit("all")))))
    out = None
    for nx, ny in grids:
        counts, starts, own = roll_up(cells, fine, (nx, ny), [unit])
        counts = cut_lineage(counts)
        diagonal = counts.groupBy(unit).agg(
            F.sum("n").alias("transitions"), F.count(F.lit(1)).alias("cells_used"), F.countDistinct("i").alias("rows_used"),
            (F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("diagonal_share"))
        thin = E.sparsity(counts, own, [unit], min_count).select(unit, "frac_below_min", "params_per_obs")
        length = C.scalars(E.mle(counts, [unit]), starts, [unit], own).select(unit, "e_t")
        moving = C.scalars(C.without_diagonal(counts, [unit]), starts, [unit], own).select(unit, F.col("e_t").alias("e_t_moving"))
        grid = diagonal.join(thin, unit).join(length, unit).join(moving, unit).select(
            F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), "*")
        out = grid if out is None else out.unionByName(grid)
    out = cut_lineage(out)
    whole = out.filter(F.col(unit) == "all").select("nx", "ny", F.col("e_t").alias("w"), F.col("e_t_moving").alias("wm"))
    return out.join(whole, ["nx", "ny"]).withColumns({
        "delta_pct": (F.col("e_t") / F.col("w") - 1) * 100, "delta_pct_moving": (F.col("e_t_moving") / F.col("wm") - 1) * 100}).drop("w", "wm")
