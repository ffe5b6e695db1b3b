"""Penalised logistic fits for any number of keys, by Newton steps that stay in the executors.

A step needs, per key, the penalised log likelihood and its first two derivatives at the trial
coefficients: sums over rows, which Spark adds up map-side. The table of these sums (one row a key) is
advanced by batched numpy solves in the executors and is itself a table, joined to the rows of
the next step. Only the number of open keys reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.functions.blas import one_thread
from chainspark.functions.draws import SPAN, Draws, poisson1_steps
from chainspark.functions.scan import same_keys
from chainspark.session import cut_lineage


def design(feats: list[str], interactions: list[tuple[str, str]] = ()) -> dict[str, Column]:
    """Names and columns of a model's terms: features, then products of pairs of them."""
    return {**{c: F.col(c).cast("double") for c in feats},
            **{f"{a} x {b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in interactions}}


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _standardised(df: DataFrame, terms: dict[str, Column]) -> Column:
    z = [(x - F.col("means")[i]) / (F.col("sds")[i] + 1e-9) for i, x in enumerate(terms.values())]
    return F.array(F.lit(1.0), *z)


def _advance(p: int, lam: float, tol: float, keys: list[str]):
    """One Newton step, or half the way back where the last one made the loss larger, for a batch of keys."""
    pen = np.full(p, lam)
    pen[0] = 0.0
    upper = np.triu_indices(p)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            numbers = {c: np.array(batch.column(c).to_pylist(), float) for c in ("trial", "taken", "sums")}
            trial, taken = numbers["trial"], numbers["taken"]
            loss, g, h = numbers["sums"][:, 0], numbers["sums"][:, 1:1 + p], numbers["sums"][:, 1 + p:]
            before = batch.column("loss").to_numpy()
            loss = loss + 0.5 * (pen * trial * trial).sum(axis=1)
            better = loss <= before + 1e-12 * np.abs(before)
            hess = np.zeros((n, p, p))
            hess[:, upper[0], upper[1]] = h
            hess[:, upper[1], upper[0]] = h
            hess += np.diag(pen) + 1e-12 * np.eye(p)
            step = np.linalg.solve(hess, (g - pen * trial)[:, :, None])[:, :, 0]
            close = better & (np.abs(step).max(axis=1) < tol)
            taken = np.where(better[:, None], trial, taken)
            trial = np.where(better[:, None], trial + step, (taken + trial) / 2)
            taken = np.where(close[:, None], trial, taken)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(trial.tolist(), pa.list_(pa.float64())), pa.array(taken.tolist(), pa.list_(pa.float64())),
                 pa.array(np.where(better, loss, before)), pa.array(batch.column("rounds").to_numpy() + 1, pa.int32()), pa.array(close)],
                [*keys, "trial", "taken", "loss", "rounds", "converged"])
    return run


def fit_logistic(df: DataFrame, feats: list[str], label: str, keys: list[str], lam: float = 3.0, weight: str | None = None,
                 interactions: list[tuple[str, str]] = (), rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """One fit per key: keys, means, sds, beta (intercept first), loss, rounds, converged.

    Terms are standardised by the key's own weighted moments; the intercept isn't penalised. A step that doesn't lower
    the loss is halved. ``converged`` is false for a key that ``rounds`` steps don't settle, and for one with
    a single class, whose intercept has no finite optimum (beta is zero there). Rows with a null term, label or weight don't
    count; null keys are keys; a key without rows has no fit.
    """
    keys_in = list(keys)
    terms = design(feats, interactions)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    d = df.select(*keys, F.array(*terms.values()).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    d = d.filter(F.col("y").isNotNull() & F.col("w").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    p = len(terms) + 1
    x = [F.col("x")[i] for i in range(p - 1)]
    means = [F.sum(F.col("w") * v) / F.sum("w") for v in x]
    spread = [F.sqrt(F.greatest(F.sum(F.col("w") * v * v) / F.sum("w") - m * m, F.lit(0.0))) for v, m in zip(x, means)]
    moments = cut_lineage(d.groupBy(*keys).agg(
        F.array(*means).alias("means"), F.array(*spread).alias("sds"),
        (F.min(F.when(F.col("w") > 0, F.col("y"))) == F.max(F.when(F.col("w") > 0, F.col("y")))).alias("one_class")).filter("one_class IS NOT NULL"))
    z = F.concat(F.array(F.lit(1.0)), F.zip_with(F.zip_with("x", "means", lambda a, m: a - m), "sds", lambda a, s: a / (s + 1e-9)))
    rows = cut_lineage(same_keys(d, moments, keys).select(*keys, z.alias("z"), "y", "w"))
    eta = _dot(F.col("z"), F.col("trial"))
    mu = 1.0 / (1.0 + F.exp(-F.col("eta")))
    # log(1 + e^eta) without overflow
    own = F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("y") * F.col("eta")
    zi = [F.col("z")[i] for i in range(p)]
    sums = [F.sum(F.col("w") * own), *[F.sum(F.col("w") * v * (F.col("y") - F.col("mu"))) for v in zi],
            *[F.sum(F.col("v") * zi[i] * zi[j]) for i in range(p) for j in range(i, p)]]

    def added(state: DataFrame) -> DataFrame:
        at = same_keys(rows, state.select(*keys, "trial"), keys).withColumn("eta", eta).withColumn("mu", mu).withColumn(
            "v", F.col("w") * F.col("mu") * (1 - F.col("mu")))
        return at.groupBy(*keys).agg(F.array(*sums).alias("sums"))

    return _newton(moments, added, keys, p, lam, tol, rounds).select(*keys_in, "means", "sds", "beta", "loss", "rounds", "converged")


def _newton(moments: DataFrame, added: Callable[[DataFrame], DataFrame], keys: list[str], p: int, lam: float, tol: float, rounds: int) -> DataFrame:
    """Steps from zero until every key has settled; ``added`` gives the sums of a step (keys, sums) at a state's trial coefficients."""
    zero = F.array(*[F.lit(0.0)] * p)

    def begun(part: DataFrame) -> DataFrame:
        return part.select(*keys, zero.alias("trial"), zero.alias("taken"), F.lit(float("inf")).alias("loss"),
                           F.lit(0).alias("rounds"), F.lit(False).alias("converged"))
    state, closed = begun(moments.filter("NOT one_class")), begun(moments.filter("one_class"))
    schema = state.schema
    for _ in range(rounds):
        state = cut_lineage(same_keys(state, added(state), keys).select(*keys, "trial", "taken", "loss", "rounds", "sums")
                            .mapInArrow(_advance(p, lam, tol, keys), schema))
        closed = closed.unionByName(state.filter("converged"))
        state = state.filter("NOT converged")
        if state.isEmpty():
            break
    out = closed.unionByName(state).select(*keys, F.col("taken").alias("beta"), "loss", "rounds", "converged")
    return same_keys(moments, out, keys)


#: Rows whose replicates are worked out at once, and blocks whose weights a task keeps.
ROWS_AT_ONCE, HELD_BLOCKS = 256, 20_000


def _replicate_sums(d: DataFrame, B: int, seed: int, p: int, size: int, of: Callable, end: Callable = lambda total: total) -> DataFrame:
    """(b, sums) for b = 0..B: what ``of(x1, y, w)`` adds up, arrays of B + 1 rows of ``size`` numbers, over all rows of a table.

    ``end`` is a linear map of these sums, of which a task does one.

    ``d``: block (text), x (array), y. x1 are the rows' terms after a one, w their blocks' Poisson(1) weights by replicate, drawn as
    ``resample.poisson_weights`` draws them. No row is repeated: a task adds up all replicates and passes their sums on.
    """
    def run(batches):
        one_thread()
        steps = np.array(poisson1_steps())
        held = np.ones((0, B + 1), np.uint8)
        known: dict[str, int] = {}
        total = np.zeros((B + 1, size))
        for batch in batches:
            codes = batch.column("block").dictionary_encode()
            names = codes.dictionary.to_pylist()
            if len(known) > HELD_BLOCKS:
                known, held = {}, held[:0]
            new = [x for x in names if x not in known]
            if new:
                draws = Draws(seed, pa.array(new, pa.string()))
                own = np.ones((len(new), B + 1), np.uint8)
                for b in range(1, B + 1):
                    own[:, b] = np.searchsorted(steps, (draws.of(b).astype(float) + 0.5) / float(SPAN))
                known |= {x: len(held) + i for i, x in enumerate(new)}
                held = np.concatenate([held, own])
            row = np.array([known[x] for x in names], np.int64)[codes.indices.to_numpy()]
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, p - 1)
            x1 = np.column_stack([np.ones(batch.num_rows), x])
            y = batch.column("y").to_numpy()
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                total += of(x1[part], y[part], held[row[part]].astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(B + 1, dtype=np.int32)), pa.array(end(total).tolist(), pa.list_(pa.float64()))], ["b", "sums"])
    parts = d.select("block", "x", "y").mapInArrow(run, "b int, sums array<double>")
    return parts.groupBy("b").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))


def fit_replicates(df: DataFrame, feats: list[str], label: str, block: str, B: int, seed: int, lam: float = 3.0,
                   interactions: list[tuple[str, str]] = (), rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """The fits of ``fit_logistic`` for replicates b = 0..B that weigh blocks by Poisson(1) draws; b = 0 is the data.

    Rows stay where they are and are not repeated, and a step reads them once for all replicates. What goes to the tasks is a
    row of coefficients and moments for each replicate.
    """
    terms = design(feats, interactions)
    p = len(terms) + 1
    d = df.select(F.col(block).cast("string").alias("block"), F.array(*terms.values()).alias("x"), F.col(label).cast("double").alias("y"))
    d = cut_lineage(d.filter(F.col("block").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull())))
    i, j = np.triu_indices(p)

    def first(x1, y, w):
        n, ones = w.sum(axis=0)[:, None], (w.T @ y)[:, None]
        return np.hstack([n, ones, w.T @ x1[:, 1:], w.T @ (x1[:, 1:] ** 2)])

    m = p - 1
    at = F.col("sums")
    means = [at[2 + k] / at[0] for k in range(m)]
    moments = cut_lineage(_replicate_sums(d, B, seed, p, 2 + 2 * m, first).filter(at[0] > 0).select(
        "b", F.array(*means).alias("means"),
        F.array(*[F.sqrt(F.greatest(at[2 + m + k] / at[0] - v * v, F.lit(0.0))) for k, v in enumerate(means)]).alias("sds"),
        ((at[1] == 0) | (at[1] == at[0])).alias("one_class")))

    def added(state: DataFrame) -> DataFrame:
        known = state.select("b", "trial").join(moments.select("b", "means", "sds"), "b").orderBy("b").collect()
        own = np.array([r["b"] for r in known])
        trial, mean, sd = (np.array([r[c] for r in known], float) for c in ("trial", "means", "sds"))
        # terms as they are to standardised ones: z = to @ x1
        to = np.zeros((len(known), p, p))
        to[:, 0, 0] = 1.0
        to[:, range(1, p), range(1, p)] = 1 / (sd + 1e-9)
        to[:, 1:, 0] = -mean / (sd + 1e-9)
        plain = np.einsum("bij,bi->bj", to, trial)

        def sums(x1, y, w):
            w = w if len(own) == B + 1 else w[:, own]
            eta = x1 @ plain.T
            e = np.abs(eta)
            np.exp(np.negative(e, out=e), out=e)
            more = e + 1
            mu = np.where(eta >= 0, 1.0, e)
            mu /= more
            # log(1 + e^eta) - y * eta, without overflow
            loss = np.maximum(eta, 0.0)
            loss += np.log(more, out=more)
            eta *= y[:, None]
            loss -= eta
            out = np.zeros((B + 1, 1 + p + len(i)))
            out[own, 0] = np.einsum("nb,nb->b", w, loss)
            v = mu * w
            out[own, 1:1 + p] = w.T @ (x1 * y[:, None]) - v.T @ x1
            np.subtract(1, mu, out=mu)
            v *= mu
            out[own, 1 + p:] = v.T @ (x1[:, i] * x1[:, j])
            return out

        def end(total):
            g, h = total[own, 1:1 + p], np.empty((len(own), p, p))
            h[:, i, j] = h[:, j, i] = total[own, 1 + p:]
            total[own, 1:1 + p] = np.einsum("bij,bj->bi", to, g)
            total[own, 1 + p:] = (to @ h @ to.transpose(0, 2, 1))[:, i, j]
            return total
        return _replicate_sums(d, B, seed, p, 1 + p + len(i), sums, end)

    return _newton(moments, added, ["b"], p, lam, tol, rounds).select("b", "means", "sds", "beta", "loss", "rounds", "converged")


def coefficients(fits: DataFrame, feats: list[str], keys: list[str], interactions: list[tuple[str, str]] = ()) -> DataFrame:
    """One row per key and term: keys, term, beta, converged."""
    names = F.array(*[F.lit(t) for t in ("intercept", *design(feats, interactions))])
    return fits.select(*keys, F.explode(F.arrays_zip(names.alias("term"), F.col("beta"))).alias("t"), "converged").select(
        *keys, F.col("t.term").alias("term"), F.col("t.beta").alias("beta"), "converged")


def predict(df: DataFrame, fits: DataFrame, feats: list[str], keys: list[str], interactions: list[tuple[str, str]] = ()) -> DataFrame:
    """Add column ``p``; null where a term is null or the key has no fit."""
    known = fits.select(*keys, "means", "sds", "beta")
    d = same_keys(df, known, keys, "left") if keys else df.crossJoin(F.broadcast(known))
    eta = _dot(_standardised(d, design(feats, interactions)), F.col("beta"))
    return d.withColumn("p", 1.0 / (1.0 + F.exp(-eta))).select(*df.columns, "p")


def out_of_fold(df: DataFrame, feats: list[str], label: str, fold: str, k: int, lam: float = 3.0) -> DataFrame:
    """Predictions of every row from a fit on the other folds.

    A row trains k-1 models: it is repeated with the id of every fold but its own.
    """
    train = df.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(F.col("__m") != F.col(fold))
    fits = fit_logistic(train.select("__m", label, *feats), feats, label, ["__m"], lam)
    return predict(df.withColumn("__m", F.col(fold).cast("int")), fits, feats, ["__m"]).drop("__m")
