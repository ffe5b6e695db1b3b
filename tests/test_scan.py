"""The chunked scans must equal plain windows for every key size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainspark.functions.scan import Running, exact_quantile, scan


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    # one key holds a third of all rows
    key = np.where(rng.random(n) < 0.33, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "t": np.arange(n), "v": rng.integers(-5, 6, n)})
    return pdf, spark.createDataFrame(pdf.sample(frac=1.0, random_state=seed))


def expected(pdf):
    g = pdf.sort_values("t").groupby("k")
    out = pdf.sort_values("t").copy()
    out["before"] = g["v"].cumsum() - out["v"]
    out["size"] = g["v"].transform("size")
    out["pos"] = g.cumcount() + 1
    out["best_after"] = g["v"].transform(lambda s: s[::-1].cummax()[::-1])
    out["next_t"] = g["t"].shift(-1)
    out["prev_v"] = g["v"].shift(1)
    return out.sort_values("t").reset_index(drop=True)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scan_equals_window(spark, width):
    pdf, df = table(spark)
    got = scan(df, ["k"], ["t"], F.floor(F.col("t") / width),
               [Running("before", "sum", F.col("v")), Running("pos", "count", F.lit(1), True),
                Running("best_after", "max", F.col("v"), True, True)],
               {"size": ("count", F.lit(1))}, {"next_t": F.col("t")}, {"prev_v": F.col("v")})
    got = got.toPandas().sort_values("t").reset_index(drop=True)
    want = expected(pdf)
    for c in ("before", "pos", "best_after", "size", "next_t", "prev_v"):
        assert np.array_equal(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(),
                              equal_nan=True), (c, width)


def test_exact_quantile_matches_numpy(hot):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.repeat([0, 1], [900, 5]), "v": np.round(rng.normal(size=905), 1)})
    got = exact_quantile(hot.createDataFrame(pdf), ["k"], "v", {"a": 0.025, "m": 0.5, "z": 0.975}).toPandas()
    for _, r in got.iterrows():
        v = pdf.v[pdf.k == r.k]
        assert np.allclose([r.a, r.m, r.z], np.quantile(v, [0.025, 0.5, 0.975]))


@pytest.mark.parametrize("kind", ["half equal", "spread", "powers", "few"])
def test_selection_in_passes(hot, kind):
    """Every key is above the limit, so all ranks are narrowed to one value."""
    rng = np.random.default_rng(5)
    v = {"half equal": np.where(rng.random(4000) < 0.5, 3.0, rng.normal(size=4000)), "spread": rng.normal(size=4000),
         "powers": 2.0 ** rng.integers(-500, 500, 4000) * rng.choice([-1, 1], 4000), "few": np.array([2.0, 1.0])}[kind]
    pdf = pd.DataFrame({"k": ["a"] * len(v) + [None] * 3, "v": np.concatenate([v, [1.0, 5.0, 2.0]])})
    df = hot.createDataFrame(pdf, "k string, v double")
    got = exact_quantile(df, ["k"], "v", {"a": 0.0, "b": 0.31, "m": 0.5, "z": 1.0}, grid=20).collect()
    assert len(got) == 2
    for r in got:
        want = np.quantile(v if r.k == "a" else [1.0, 5.0, 2.0], [0.0, 0.31, 0.5, 1.0])
        assert np.allclose([r.a, r.b, r.m, r.z], want)


def test_scan_reads_rows_once_and_sums_once(spark):
    """One full read and one pruned aggregate; no count of keys first, whatever their sizes."""
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t", "id AS v", "id AS wide")
    plan = scan(df, ["k"], ["t"], F.floor(F.col("t") / 7), [Running("s", "sum", F.col("v"))])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 100") == 2
