"""Absorbing-chain quantities for many groups at once.

A group is a unit, or a unit x season x replicate; its matrix has at most n_transient x n_states
cells whatever the data size, so every group is one small grouped-map call and groups spread
over the cluster. Inputs are long: keys, i, j, p and keys, i, a for the start weights.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainspark.space import StateSpace

START = -1  # column index that carries the start weights inside a group


def starts(trans: DataFrame, keys=(), weight=None) -> DataFrame:
    """Start weights a_i: state of the first row of every possession."""
    first = trans.groupBy(*keys, "poss_uid").agg(F.min_by("from_state", "event_index").alias("i"))
    return first.groupBy(*keys, "i").agg(F.count(F.lit(1)).cast("double").alias("a"))


def grouped(P: DataFrame, keys: list[str], fields: list[T.StructField],
            kernel: Callable[[np.ndarray, np.ndarray], list[tuple]], space: StateSpace,
            alpha: DataFrame | None = None, uniform_empty: bool = False) -> DataFrame:
    """Run a dense kernel (P, alpha) -> rows once per group.

    Rows without data stay zero (never reached from the unit's own starts) or, when starts come
    from another unit, become uniform.
    """
    nt, ns = space.n_transient, space.n_states
    cells = P.select(*keys, F.col("i").cast("int"), F.col("j").cast("int"), F.col("p").cast("double"))
    if alpha is not None:
        cells = cells.unionByName(alpha.select(
            *keys, F.col("i").cast("int"), F.lit(START).cast("int").alias("j"),
            F.col("a").cast("double").alias("p")))
    names = [f.name for f in fields]
    schema = T.StructType([cells.schema[k] for k in keys] + fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, p = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["p"].to_numpy()
        matrix, a = np.zeros((nt, ns)), np.zeros(nt)
        cell = j >= 0
        matrix[i[cell], j[cell]] = p[cell]
        a[i[~cell]] = p[~cell]
        if uniform_empty:
            matrix[matrix.sum(1) == 0] = 1.0 / ns
        out = pd.DataFrame(kernel(matrix, a), columns=names)
        for k, value in zip(reversed(keys), reversed(key)):
            out.insert(0, k, value)
        return out

    return cells.groupBy(*keys).applyInPandas(run, schema)


def _num(name: str, kind=None) -> T.StructField:
    return T.StructField(name, kind or T.DoubleType())


def _inverse_apply(Q: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    return np.linalg.solve(np.eye(len(Q)) - Q, rhs)


def spectral_radius(Q: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(Q)).max())


def checks(P: DataFrame, keys: list[str], space: StateSpace) -> DataFrame:
    """Spectral radius of Q, largest row-sum error, infinity norm of Q."""
    nt = space.n_transient

    def kernel(M, _):
        Q, sums = M[:, :nt], M.sum(1)
        used = sums > 0
        return [(spectral_radius(Q), float(np.abs(sums[used] - 1).max(initial=0.0)),
                 float(Q.sum(1).max()))]
    return grouped(P, keys, [_num("rho"), _num("row_error"), _num("inf_norm")], kernel, space)


def state_values(P: DataFrame, keys: list[str], space: StateSpace) -> DataFrame:
    """Per transient state with data: expected steps and absorption probabilities."""
    nt = space.n_transient
    names = [f"p_{a.lower()}" for a in space.absorbing]

    def kernel(M, _):
        used = np.flatnonzero(M.sum(1) > 0)
        X = _inverse_apply(M[:, :nt], np.column_stack([np.ones(nt), M[:, nt:]]))
        return [(int(s), *map(float, X[s])) for s in used]
    fields = [_num("state", T.LongType()), _num("expected_length"), *[_num(n) for n in names]]
    return grouped(P, keys, fields, kernel, space)


def visits(P: DataFrame, alpha: DataFrame, keys: list[str], space: StateSpace) -> DataFrame:
    """Expected visits per state from the start distribution, and their share."""
    nt = space.n_transient

    def kernel(M, a):
        v = np.linalg.solve((np.eye(nt) - M[:, :nt]).T, a / max(a.sum(), 1e-300))
        return [(int(s), float(v[s]), float(v[s] / v.sum())) for s in np.flatnonzero(v > 1e-15)]
    return grouped(P, keys, [_num("state", T.LongType()), _num("visits"), _num("share")],
                   kernel, space, alpha)


def scalars(P: DataFrame, alpha: DataFrame, keys: list[str], space: StateSpace,
            uniform_empty: bool = False) -> DataFrame:
    """e_t, p_goal, p_shot of a group; null when the spectral radius reaches one."""
    nt = space.n_transient
    goal = space.absorbing.index("GOAL")
    saved = space.absorbing.index("SHOT_NOGOAL")

    def kernel(M, a):
        Q = M[:, :nt]
        if a.sum() <= 0:
            return [(None, None, None)]
        X = _inverse_apply(Q, np.column_stack([np.ones(nt), M[:, nt:]]))
        # for a nonnegative Q, expected lengths are all >= 1 exactly when its radius is below one
        if not (np.isfinite(X).all() and X[:, 0].min() >= 1 - 1e-9):
            return [(None, None, None)]
        t = (a / a.sum()) @ X
        return [(float(t[0]), float(t[1 + goal]), float(t[1 + goal] + t[1 + saved]))]
    return grouped(P, keys, [_num("e_t"), _num("p_goal"), _num("p_shot")], kernel, space, alpha,
                   uniform_empty)


def survival(P: DataFrame, alpha: DataFrame, keys: list[str], space: StateSpace, kmax: int
             ) -> DataFrame:
    """Phase-type length law: S(k) = P(length > k) and pmf(k) for k = 1..kmax, closed by the cell kmax + 1.

    That cell holds all longer lengths, so the pmf adds up to one. ``beyond`` is the expected length that is
    left after k steps, alpha Q^k (I - Q)^-1 1 / S(k): what the law says of the lengths it doesn't list.
    """
    nt = space.n_transient

    def kernel(M, a):
        Q = M[:, :nt]
        left = _inverse_apply(Q, np.ones(nt))
        v, out, before = a / max(a.sum(), 1e-300), [], 1.0
        for k in range(1, kmax + 1):
            v = v @ Q
            s = float(v.sum())
            out.append((k, s, before - s, float(v @ left) / s if s > 1e-300 else None))
            before = s
        return [*out, (kmax + 1, 0.0, before, None)]
    return grouped(P, keys, [_num("k", T.LongType()), _num("survival"), _num("pmf"), _num("beyond")],
                   kernel, space, alpha)


def first_passage(P: DataFrame, alpha: DataFrame, keys: list[str], space: StateSpace,
                  from_column: int) -> DataFrame:
    """Probability to reach the last columns before absorption, and steps given arrival."""
    nt = space.n_transient
    column = (np.arange(nt) // space.n_phases) // space.ny

    def kernel(M, a):
        band = column >= from_column
        out = ~band
        w = a[out]
        if w.sum() <= 0:
            return [(None, None)]
        w = w / w.sum()
        Q = M[np.ix_(out, np.flatnonzero(out))]
        h = _inverse_apply(Q, M[np.ix_(out, np.flatnonzero(band))].sum(1))
        reach = float(w @ h)
        if reach <= 0:
            return [(0.0, None)]
        return [(reach, float(w @ _inverse_apply(Q, h) / reach))]
    return grouped(P, keys, [_num("reach"), _num("steps")], kernel, space, alpha)


def _one_class(adj: np.ndarray) -> bool:
    """Strong connectivity: everything reached from state 0 forwards and backwards."""
    for A in (adj, adj.T):
        seen = np.zeros(len(A), dtype=bool)
        seen[0] = True
        for _ in range(len(A)):
            more = seen | A[seen].any(0)
            if (more == seen).all():
                break
            seen = more
        if not seen.all():
            return False
    return True


def quasi_stationary(P: DataFrame, keys: list[str], space: StateSpace, phase: str = "open",
                     tol: float = 1e-13, max_steps: int = 20000) -> DataFrame:
    """Quasi-stationary zone law of one phase block by power iteration, with its eigenvalue.

    One row per zone; null law when the block is not irreducible.
    """
    nt, nz = space.n_transient, space.n_zones
    block = np.arange(nt)[np.arange(nt) % space.n_phases == space.phases.index(phase)]

    def kernel(M, _):
        Q = M[np.ix_(block, block)]
        if not _one_class(Q > 0):
            return [(z, None, None, None, False) for z in range(nz)]
        mu, lam = np.full(nz, 1.0 / nz), 0.0
        for _step in range(max_steps):
            nu = mu @ Q
            lam = float(nu.sum())
            nu /= lam
            done = np.abs(nu - mu).sum() < tol
            mu = nu
            if done:
                break
        else:
            raise RuntimeError(f"the power steps did not settle within {max_steps}")
        return [(z, float(mu[z]), lam, 1.0 / (1.0 - lam), True) for z in range(nz)]
    fields = [_num("zone", T.LongType()), _num("share"), _num("lambda1"), _num("lifetime"),
              _num("irreducible", T.BooleanType())]
    return grouped(P, keys, fields, kernel, space)


# -- relational follow-ups -----------------------------------------------------------------
def collapse_zones(values: DataFrame, keys: list[str], space: StateSpace, value: str,
                   weight: str | None = None) -> DataFrame:
    """Zone value: mean over phases, or mean weighted by state mass."""
    x = F.col(value)
    agg = F.avg(x) if weight is None else F.sum(x * F.col(weight)) / F.sum(weight)
    return values.groupBy(*keys, space.zone_of_state(F.col("state")).alias("zone")).agg(
        agg.alias(value))


def without_diagonal(cells: DataFrame, keys=()) -> DataFrame:
    """Rows renormalised after dropping i = j; a row with only its diagonal keeps it."""
    w = Window.partitionBy(*keys, "i")
    off = F.sum(F.when(F.col("i") != F.col("j"), F.col("n")).otherwise(0.0)).over(w)
    d = cells.withColumn("__off", off)
    kept = d.filter((F.col("i") != F.col("j")) | (F.col("__off") == 0))
    p = F.col("n") / F.when(F.col("__off") > 0, F.col("__off")).otherwise(F.col("n"))
    return kept.select(*keys, "i", "j", "n", p.alias("p"))


def condition_from(law: DataFrame, keys: list[str], t_min: int) -> DataFrame:
    """Length law given length >= t_min, its closing cell included; a law has kmax + 1 rows per key."""
    kept = law.filter(F.col("k") >= t_min)
    total = F.sum("pmf").over(Window.partitionBy(*keys))
    return kept.withColumn("pmf", F.col("pmf") / total)


def closed_lengths(lengths: DataFrame, law: DataFrame, keys: list[str]) -> DataFrame:
    """A length histogram on the cells of a law: lengths beyond the last k fall in its closing cell."""
    last = law.groupBy(*keys).agg(F.max("k").alias("__last"))
    return lengths.join(last, keys).groupBy(*keys, F.least("length", "__last").alias("length")).agg(
        F.sum("possessions").alias("possessions"))


def observed_survival(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Share of possessions longer than k, for every length k that occurs, from a length histogram.

    A histogram has one row per distinct length, so its running sum is a window of that size.
    """
    w = Window.partitionBy(*keys)
    upto = F.sum("possessions").over(w.orderBy("length").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("possessions").over(w)
    return lengths.select(*keys, F.col("length").cast("bigint").alias("k"), ((whole - upto) / whole).alias("observed"))


def discrete_ks(lengths: DataFrame, law: DataFrame, keys: list[str], t_min: int = 1) -> DataFrame:
    """Largest gap between the observed and the implied length distribution from t_min on."""
    law = condition_from(law, keys, t_min)
    obs = closed_lengths(lengths.filter(F.col("length") >= t_min), law, keys).withColumn(
        "o", F.col("possessions") / F.sum("possessions").over(Window.partitionBy(*keys)))
    both = law.select(*keys, "k", "pmf").join(
        obs.select(*keys, F.col("length").alias("k"), "o"), [*keys, "k"], "left")
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum(F.coalesce("o", F.lit(0.0))).over(w) - F.sum("pmf").over(w))
    return both.withColumn("gap", gap).groupBy(*keys).agg(F.max("gap").alias("ks"))


def phase_constancy(trans: DataFrame, space: StateSpace, keys: list[str]) -> DataFrame:
    """Share of moving rows that stay in their phase."""
    same = (F.col("from_state") % space.n_phases) == (F.col("to_state") % space.n_phases)
    return trans.filter(~F.col("is_absorbing")).groupBy(*keys).agg(
        F.avg(same.cast("double")).alias("constancy"), F.count(F.lit(1)).alias("n"))


def zone_flow(trans: DataFrame, space: StateSpace, phase: str, keys: list[str]) -> DataFrame:
    """Zone -> zone or outcome counts of one phase, phases collapsed."""
    k = space.phases.index(phase)
    d = trans.filter(F.col("from_state") % space.n_phases == k)
    to = F.when(F.col("is_absorbing"), space.n_zones + F.col("to_state") - space.n_transient
                ).otherwise(space.zone_of_state(F.col("to_state"))).cast("bigint")
    return d.groupBy(*keys, space.zone_of_state(F.col("from_state")).alias("from_zone"),
                     to.alias("to_zone")).agg(F.count(F.lit(1)).alias("n"))


def occupancy(trans: DataFrame, space: StateSpace, keys: list[str]) -> DataFrame:
    """Share of real actions per zone."""
    d = trans.filter(F.col("action_type") != "TERMINAL").groupBy(
        *keys, space.zone_of_state(F.col("from_state")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def example_possession(trans: DataFrame, space: StateSpace, keys: list[str], target: float,
                       from_column: int) -> DataFrame:
    """The arriving possession whose steps to the band are nearest to a target (ties by id)."""
    col = F.floor(space.zone_of_state(F.col("to_state")) / space.ny)
    arrives = (~F.col("is_absorbing")) & (col >= from_column)
    per = trans.groupBy(*keys, "poss_uid").agg(
        F.min("event_index").alias("first"),
        F.min(F.when(arrives, F.col("event_index"))).alias("at")).filter(F.col("at").isNotNull())
    per = per.withColumn("steps", F.col("at") - F.col("first") + 1)
    pick = F.min_by(F.struct("poss_uid", "steps"),
                    F.struct(F.abs(F.col("steps") - target), "steps", "poss_uid"))
    return per.groupBy(*keys).agg(pick.alias("p")).select(*keys, "p.poss_uid", "p.steps")
