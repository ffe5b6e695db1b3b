"""Hand cases and exact identities of the operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainspark.functions import scalars as S
from chainspark.operators import absorb as C
from chainspark.operators import chains
from chainspark.operators import eras as R
from chainspark.operators import estimate as E
from chainspark.operators import logistic as G
from chainspark.operators import relations as Q
from chainspark.operators import resample as B
from chainspark.operators import shots as X
from chainspark.operators import standardise as D
from chainspark.operators import teams as L
from chainspark.session import cut_lineage
from chainspark.sources import events as EV
from chainspark.space import StateSpace

SPACE = StateSpace()


# -- chains ------------------------------------------------------------------------------------
def literal_events(spark):
    rows = [  # match, index, type, team, owner, possession, pattern, loc, pass end, pass outcome, shot outcome
        (1, 1, "Pass", "A", "A", 1, "From Corner", "[10, 10]", "[70, 40]", None, None),
        (1, 2, "Carry", "A", "A", 1, "From Corner", "[70, 40]", None, None, None),
        (1, 3, "Shot", "A", "A", 1, "From Corner", "[110, 40]", None, None, "Goal"),
        (1, 4, "Pass", "B", "B", 2, "Odd Pattern", "[60, 40]", "[50, 20]", "Out", None),
        (1, 5, "Pass", "A", "A", 3, "Regular Play", "[30, 30]", "[60, 30]", None, None),
        (1, 6, "Pass", "B", "A", 3, "Regular Play", "[30, 30]", "[60, 30]", None, None),
        (1, 7, "Pass", "B", "B", 4, "Regular Play", "[30, 30]", "[60, 30]", "Incomplete", None)]
    cols = "match_id bigint, index bigint, type string, team string, possession_team string, possession bigint, play_pattern string, location string, pass_end_location string, pass_outcome string, shot_outcome string"
    df = spark.createDataFrame(rows, cols)
    return df.selectExpr("cast(index as string) id", "1 period", "0 minute", "0 second", "cast(null as bigint) player_id", "*")


def test_build_transitions_hand_case(spark):
    ev = EV.normalise(literal_events(spark))
    t = chains.build_transitions(ev, SPACE, club="A").toPandas().sort_values(["poss_uid", "event_index"])
    p1 = t[t.poss_uid == "1_1"]
    # the carry has no end and goes; the corner marks the whole possession
    assert list(p1.action_type) == ["Pass", "Shot"] and set(p1.phase) == {"set_piece"}
    assert list(p1.to_state)[-1] == SPACE.absorbing_state("GOAL")
    p2 = t[t.poss_uid == "1_2"]
    assert list(p2.phase) == ["open"] and list(p2.to_state) == [SPACE.absorbing_state("OUT")]
    assert list(p2.score_state) == ["losing"] and list(p2.score_state_club) == ["winning"]
    p3 = t[t.poss_uid == "1_3"]  # foreign executor dropped, transient end gets TERMINAL
    assert list(p3.action_type) == ["Pass", "TERMINAL"] and p3.under_pressure.iloc[-1] is None
    assert len(t[t.poss_uid == "1_4"]) == 1  # one-action rival possession stays, a club one would go
    # the goal does not count for its own event
    assert list(p1.score_state) == ["drawing", "drawing"]


def test_contract_errors(spark):
    with pytest.raises(KeyError, match="possession"):
        EV.normalise(spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(ValueError):
        chains.phase_of(F.lit("x"), chains.ChainConfig(phase_default="nowhere"), SPACE)
    tr = spark.createDataFrame([("A", "k")], "team string, coach string")
    with pytest.raises(ValueError):
        Q.select_units(tr, "coach", "k", "opponents")
    with pytest.raises(ValueError):
        Q.perspective(tr, "defense", "coach", "A")


def test_csv_null_tokens_and_rare_columns(spark, tmp_path):
    p = tmp_path / "log.csv"
    lines = ["id,index,shot_outcome,location"] + [f"e{i},{i},NA," for i in range(150)] + ['e150,150,Goal,"[1.5, 2]"']
    p.write_text("\n".join(lines))
    df = EV.scan_events(spark, str(tmp_path))
    assert df.filter("shot_outcome is not null").count() == 1
    x, _ = S.location_xy(F.col("location"), df.schema["location"].dataType)
    assert df.agg(F.max(x)).first()[0] == 1.5
    with pytest.raises(ValueError):
        EV.scan_events(spark, str(tmp_path / "nothing"))


def test_mirror_is_an_involution(spark):
    z = spark.range(80).select(F.col("id"), SPACE.mirror_state(SPACE.mirror_state(F.col("id"))).alias("b"),
                               SPACE.mirror_state(F.col("id")).alias("m"))
    assert z.filter("id <> b").isEmpty() and z.filter("id % 4 <> m % 4").isEmpty()


# -- chain algebra --------------------------------------------------------------------------------
def random_chain(seed):
    rng = np.random.default_rng(seed)
    C_ = rng.integers(0, 4, (80, 84)).astype(float)
    C_[:, 80:] += 2
    return C_


def test_chain_algebra_matches_numpy(spark):
    n = random_chain(5)
    cells = spark.createDataFrame(pd.DataFrame([(1, i, j, n[i, j]) for i in range(80) for j in range(84) if n[i, j]],
                                               columns=["u", "i", "j", "n"]))
    P = n / n.sum(1, keepdims=True)
    N = np.linalg.inv(np.eye(80) - P[:, :80])
    got = C.state_values(E.mle(cells, ["u"]), ["u"], SPACE).toPandas().sort_values("state")
    assert np.allclose(got.expected_length, N.sum(1))
    assert np.allclose(got[["p_goal", "p_shot_nogoal", "p_loss", "p_out"]], N @ P[:, 80:])
    assert np.allclose(got[["p_goal", "p_shot_nogoal", "p_loss", "p_out"]].sum(axis=1), 1)
    al = spark.createDataFrame([(1, 0, 2.0), (1, 7, 1.0)], "u int, i int, a double")
    s = C.scalars(E.mle(cells, ["u"]), al, ["u"], SPACE).first()
    assert math.isclose(s.e_t, (2 * N.sum(1)[0] + N.sum(1)[7]) / 3)
    k = C.checks(E.mle(cells, ["u"]), ["u"], SPACE).first()
    assert math.isclose(k.rho, np.abs(np.linalg.eigvals(P[:, :80])).max()) and k.row_error < 1e-12 and k.rho < 1
    # Neumann series agrees with the solve
    S_, Qk = np.eye(80), P[:, :80].copy()
    for _ in range(9):
        S_ = S_ + Qk @ S_
        Qk = Qk @ Qk
    assert np.allclose(S_.sum(1), got.expected_length, atol=1e-8)


def test_shrinkage_limits(spark):
    n = random_chain(6)
    n[3] = 0
    cells = spark.createDataFrame(pd.DataFrame([(i, j, n[i, j]) for i in range(80) for j in range(84) if n[i, j]], columns=["i", "j", "n"]))
    q = E.prior(cells, SPACE)
    full = E.complete(cells, SPACE).join(q, ["i", "j"])
    for lam in (0.0, 1e9):
        p = E.shrink(full, lam, SPACE).toPandas()
        assert np.allclose(p.groupby("i").p.sum(), 1)
        ref = p.q if lam else np.where(p.i == 3, p.q, p.n / p.groupby("i").n.transform("sum").replace(0, 1))
        assert np.allclose(p.p, ref, atol=1e-5)


# -- resampling -------------------------------------------------------------------------------------
def test_weights_and_labels_ignore_partitioning(spark):
    blocks = pd.DataFrame({"s": ["x"] * 30 + ["y"] * 7, "m": range(37), "l": ["a", "b"] * 18 + ["a"]})
    one, many = spark.createDataFrame(blocks).coalesce(1), spark.createDataFrame(blocks.sample(frac=1, random_state=2)).repartition(7)

    def weights(df):
        w = B.multinomial_weights(df, ["s"], "m", 25, 3).withColumn("w", F.explode("w"))
        return w.select("s", "m", "w.b", "w.w").toPandas().sort_values(["s", "m", "b"]).reset_index(drop=True)
    a, b = weights(one), weights(many)
    assert a.equals(b)
    assert (a.groupby(["s", "b"]).w.sum().unstack(0)[["x", "y"]] == [30, 7]).all().all()
    x = B.permutation_labels(one, ["s"], "m", "l", 10, 3).toPandas()
    y = B.permutation_labels(many, ["s"], "m", "l", 10, 3).toPandas()
    key = ["s", "b", "m", "l"]
    assert x.sort_values(key)[key].reset_index(drop=True).equals(y.sort_values(key)[key].reset_index(drop=True))
    counts = x.groupby(["s", "b", "l"]).m.count().unstack(fill_value=0)
    assert (counts.loc["x"] == [15, 15]).all().all() and (counts.loc["y"] == [4, 3]).all().all()


def test_fdr_matches_definition(hot):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(60) ** 3, 2)
    got = B.fdr(hot.createDataFrame(pd.DataFrame({"t": range(60), "p": p})), []).toPandas().sort_values("t")
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 60 / np.arange(1, 61))[::-1])[::-1].clip(0, 1)
    want = np.empty(60)
    want[order] = q
    assert np.allclose(got.q, want)


# -- eras ----------------------------------------------------------------------------------------------
def reduced(runs, limit):
    """Runs after folding, by one pass with a stack: a run closes the short one below it if the coach is back."""
    stack = []
    for coach, n in runs:
        if len(stack) > 1 and stack[-1][1] <= limit and stack[-2][0] == coach:
            stack.pop()
            stack[-1] = (coach, stack[-1][1] + n)
        else:
            stack.append((coach, n))
    return stack


def test_merge_interims_matches_a_stack_reduction(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for club in range(25):
        runs, last = [], None
        for _ in range(rng.randint(1, 11)):
            c = rng.choice([x for x in "abc" if x != last])
            runs.append((c, rng.randint(1, 4)))
            last = c
        want[club] = reduced(runs, 2)
        rows += [(club, k + 1, c, n) for k, (c, n) in enumerate(runs)]
    df = spark.createDataFrame(rows, "club int, run_id bigint, coach string, n bigint").selectExpr(
        "*", "date '2020-01-01' + cast(run_id as int) start_date", "date '2020-01-01' + cast(run_id as int) end_date",
        "cast(0 as bigint) multi", "array('A2020') seasons")
    got = R.merge_interims(df, 2, cut_lineage).toPandas().sort_values(["club", "run_id"])
    for club, g in got.groupby("club"):
        assert list(zip(g.coach, g.n)) == want[club], club


def test_overlapping_eras_are_refused(spark):
    df = spark.createDataFrame([("c", "x", "2020-01-01", "2020-05-01"), ("c", "y", "2020-04-01", "2020-08-01")],
                               "club string, coach string, start_date string, end_date string")
    with pytest.raises(ValueError):
        R.load_eras(df)


# -- shots -----------------------------------------------------------------------------------------------
def visible(spark, x, y, defenders):
    d = spark.createDataFrame([(float(x), float(y), [[float(a), float(b)] for a, b in defenders])], "x double, y double, d array<array<double>>")
    return d.select(X.visible_goal(F.col("x"), F.col("y"), F.col("d"))).first()[0]


def rays(x, y, defenders, r=0.3, n=200001):
    x = min(x, 119.9)
    th = np.linspace(math.atan2(36 - y, 120 - x), math.atan2(44 - y, 120 - x), n)
    free = np.ones(n, bool)
    for a, b in defenders:
        if a <= x:
            continue
        t = np.cos(th) * (a - x) + np.sin(th) * (b - y)
        free &= ~((t > 0) & (np.abs(np.cos(th) * (b - y) - np.sin(th) * (a - x)) <= r))
    return free.mean()


def test_visible_goal(spark):
    assert math.isclose(visible(spark, 100, 40, [(110, 40)]), 1 - math.asin(0.03) / math.atan(0.2), rel_tol=1e-9)
    assert visible(spark, 100, 40, []) == 1.0 and visible(spark, 100, 40, [(90, 40)]) == 1.0
    assert visible(spark, 100, 40, [(100.1, 40.1)]) == 0.0
    rng = np.random.default_rng(8)
    for _ in range(4):
        x, y = rng.uniform(95, 120.5), rng.uniform(20, 60)
        ds = [(rng.uniform(x - 1, 120), rng.uniform(y - 4, y + 4)) for _ in range(6)]
        if any(math.hypot(a - min(x, 119.9), b - y) < 0.4 for a, b in ds):
            continue
        assert abs(visible(spark, x, y, ds) - rays(x, y, ds)) < 1e-3


def test_logistic_matches_numpy(spark):
    rng = np.random.default_rng(2)
    Z = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + Z @ [1.0, -0.7])))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": Z[:, 0], "b": Z[:, 1], "y": y}))
    fit = G.fit_logistic(df, ["a", "b"], "y", [], 3.0).collect()
    assert len(fit) == 1 and fit[0].converged
    got = fit[0].beta
    A = np.column_stack([np.ones(300), (Z - Z.mean(0)) / (Z.std(0) + 1e-9)])
    b, pen = np.zeros(3), np.diag([0, 3.0, 3.0])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-A @ b))
        b = b + np.linalg.solve((A.T * (mu * (1 - mu))) @ A + pen, A.T @ (y - mu) - pen @ b)
    assert np.allclose(got, b, atol=1e-7)


def test_logistic_per_key(spark):
    """Many keys at once against a plain fit each; interaction and weights; far optima need halved steps; one class never settles."""
    rng = np.random.default_rng(4)
    parts = []
    for k in range(25):
        n = int(rng.integers(30, 60))
        a, b = rng.normal(size=n) * 10 ** rng.uniform(-3, 3), rng.normal(size=n)
        y = (rng.random(n) < 1 / (1 + np.exp(-8 * np.sign(a)))).astype(float) if k % 2 else (rng.random(n) < 0.4).astype(float)
        parts.append(pd.DataFrame({"k": k, "a": a, "b": b, "y": y, "w": rng.integers(0, 3, n).astype(float)}))
    parts.append(pd.DataFrame({"k": 99, "a": [1.0, 2.0, 3.0], "b": [0.0, 1.0, 0.0], "y": [1.0] * 3, "w": [1.0] * 3}))
    pdf = pd.concat(parts)
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(3, None, 1.0, 1.0, 1.0)], "k bigint, a double, b double, y double, w double"))
    fits = {r.k: r for r in G.fit_logistic(df, ["a", "b"], "y", ["k"], 0.01, "w", [("a", "b")]).collect()}
    assert not fits[99].converged and len(fits) == 26
    for k, own in pdf[pdf.k < 99].groupby("k"):
        w, y = own.w.to_numpy(), own.y.to_numpy()
        t = np.column_stack([own.a, own.b, own.a * own.b])
        m = (w @ t) / w.sum()
        s = np.sqrt((w @ (t * t)) / w.sum() - m * m)
        z = np.column_stack([np.ones(len(t)), (t - m) / (s + 1e-9)])
        beta, pen = np.array(fits[k].beta), np.array([0, 0.01, 0.01, 0.01])
        # the score equations hold at the fit
        assert fits[k].converged
        assert np.abs(z.T @ (w * (y - 1 / (1 + np.exp(-z @ beta)))) - pen * beta).max() < 1e-6
    p = G.predict(df, G.fit_logistic(df, ["a", "b"], "y", ["k"], 1.0), ["a", "b"], ["k"])
    assert p.filter("p IS NULL").count() == 1 and p.count() == df.count()


def test_set_piece_sequences(spark):
    corner, none = ("Corner", 100.0), None
    rows = [(1, 1, 1, "From Corner", "A", corner, 0, 0), (1, 2, 1, "From Corner", "B", none, 1, 0), (1, 3, 1, "From Corner", "A", none, 1, 1),
            (1, 4, 1, "Regular", "A", none, 1, 0), (1, 5, 1, "From Corner", "A", none, 1, 0),  # after a break nothing resumes
            (1, 6, 1, "From Corner", "B", corner, 0, 0), (1, 7, 2, "From Corner", "B", none, 1, 0)]  # next period ends it
    df = spark.createDataFrame(rows, "match_id int, possession bigint, period int, pattern string, team string, taker struct<pass_type:string,x:double>, shots int, goals int")
    got = {r.sequence: (r.attacker, r.possessions, r.S, r.G) for r in X.sequences(df, "Corner", "From Corner").collect()}
    assert got == {1: ("A", 3, 1, 1), 6: ("B", 1, 0, 0)}


# -- standardisation ------------------------------------------------------------------------------------
def test_standardised_rate_cancels_common_drift(spark):
    rows = [("u", "s1", 30.0, 6.0, 1000.0, 200.0), ("u", "s2", 10.0, 3.0, 1000.0, 300.0)]
    r = D.standardised_rate(spark.createDataFrame(rows, "k string, season string, n_u double, s_u double, n_b double, s_b double"), ["k"]).first()
    assert math.isclose(r.unit, 9 / 40) and math.isclose(r.did, 0.0, abs_tol=1e-12)
    lacks = [("u", "s1", 30.0, 6.0, 0.0, 0.0)]
    assert D.standardised_rate(spark.createDataFrame(lacks, "k string, season string, n_u double, s_u double, n_b double, s_b double"), ["k"]).first().base is None


def test_kitagawa_is_exact(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": 1, "e": rng.choice(["a", "b"], 400), "k": rng.integers(1, 5, 400), "v": rng.random(400)})
    r = D.kitagawa(spark.createDataFrame(pdf), ["t"], "e", "k", "v").first()
    gap = pdf[pdf.e == "a"].v.mean() - pdf[pdf.e == "b"].v.mean()
    assert math.isclose(r.within + r.composition, r.total, abs_tol=1e-12) and math.isclose(r.total, gap, abs_tol=1e-12)


def test_minutes(spark):
    sp = spark.createDataFrame([("a", 1, "00:00:00.000", None, 1, None), ("b", 1, "00:10:00.000", "00:20:00.000", 2, 2)],
                               "p string, match_id int, `from` string, `to` string, from_period int, to_period int")
    ends = spark.createDataFrame([(1, 2, {1: 47 * 60.0, 2: 50 * 60.0})], "match_id int, last_period int, end_by_period map<int,double>")
    got = {r.p: r.minutes for r in L.minutes_played(sp, ends, ["p"], "period").collect()}
    assert math.isclose(got["a"], 97.0) and math.isclose(got["b"], 10.0)


def test_asof_equals_range_join(hot):
    left = hot.createDataFrame([(1, i) for i in range(0, 50, 3)], "k int, t int")
    right = hot.createDataFrame([(1, 5, "x"), (1, 20, "y"), (1, 21, "z")], "k int, s int, v string")
    got = {r.t: r.v for r in Q.asof_backward(left, right, ["k"], "t", "s", ["v"], F.floor(F.col("__t") / 10)).collect()}
    assert all(got[t] == (None if t < 5 else "x" if t < 20 else "y" if t < 21 else "z") for t in got) and len(got) == 17


def test_derived_tables_survive_a_cleared_folder(spark):
    import shutil

    from chainspark.plans import tables

    first = tables.artifact(spark, "/x", "probe", lambda s, _: s.range(5).toDF("v"))
    assert first.count() == 5
    path = tables._BUILT[(spark.sparkContext.applicationId, "/x", "probe")]
    shutil.move(path.removeprefix("file:"), path.removeprefix("file:") + "-gone")
    assert tables.artifact(spark, "/x", "probe", lambda s, _: s.range(6).toDF("v")).count() == 6


# -- unknown and missing values ---------------------------------------------------------------------------
def test_a_shot_from_an_unknown_place_has_no_visible_goal(spark):
    nan = float("nan")
    assert visible(spark, nan, 40, [(110, 40)]) is None and visible(spark, 100, nan, [(110, 40)]) is None
    assert visible(spark, 100, 40, [(nan, 40)]) == 1.0
    d = spark.createDataFrame([(nan, 40.0, [[110.0, 40.0]])], "x double, y double, d array<array<double>>")
    assert d.select(X.blocked_segments(F.col("x"), F.col("y"), F.col("d"))).first()[0] == []


def test_clock_texts_of_any_length(spark):
    from chainspark.functions import scalars as S
    d = spark.createDataFrame([("00:01:02.500",), ("70:30",), ("45",), ("x:10",), (None,)], "c string")
    assert [r[0] for r in d.select(S.clock_seconds(F.col("c"))).collect()] == [62.5, 4230.0, 45.0, None, None]


def test_slug_takes_every_decomposable_letter(spark):
    from chainspark.functions import scalars as S
    d = spark.createDataFrame([("Dušan Tadić",), ("Žižek Ő",), ("e\u0301te\u0301",), ("Łukasz",)], "c string")
    assert [r[0] for r in d.select(S.slug(F.col("c"))).collect()] == ["dusan_tadic", "zizek_o", "ete", "łukasz"]


def test_null_keys_and_values_keep_their_rows(hot):
    from chainspark.functions.scan import Running, scan
    from chainspark.operators import relations as Q
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, 1), (None, 1, 2), (None, 2, None)]
    d = hot.createDataFrame(rows, "k string, v int, c int")
    assert scan(d, ["k"], ["v"], totals={"n": ("count", F.lit(1))}).count() == 5
    got = scan(d, ["k"], ["c", "v"], F.col("c"), [Running("r", "count", F.lit(1))], {"n": ("count", F.lit(1))}).collect()
    assert sorted((r["k"] or "", r["r"], r["n"]) for r in got) == [("", 0, 2), ("", 1, 2), ("a", 0, 3), ("a", 1, 3), ("a", 2, 3)]
    ranks = {(r["k"], r["v"], r["c"]): r["rank"] for r in Q.midrank(d, ["k"], "c").collect()}
    assert len(ranks) == 5 and ranks[("a", 3, 1)] == 1.0 and ranks[("a", 1, None)] is None
    assert Q.leave_one_out(d, ["k"], "v", "m").count() == 5
    assert Q.leave_unit_out(d, "v", ["k"], ["c"]).count() == 5


def test_draws_reach_beyond_32_bits(spark):
    from chainspark.functions.draws import SPAN, draw, poisson1_steps
    top = spark.range(2000).select(F.max(draw(1, F.col("id"))), F.min(draw(1, F.col("id")))).first()
    assert 2 ** 59 < top[0] < SPAN and top[1] < SPAN / 100
    steps = poisson1_steps()
    assert len(steps) > 15 and steps == sorted(set(steps)) and 1 - steps[-1] < 1e-14


def test_yekutieli_factor_is_the_harmonic_number(spark):
    for m in (1, 2, 10, 500):
        d = spark.createDataFrame(pd.DataFrame({"t": range(m), "p": np.linspace(1e-6, 1e-5, m)}))
        q = B.fdr(d, [], dependent=True).toPandas().sort_values("p").q.to_numpy()
        harmonic = sum(1 / k for k in range(1, m + 1))
        assert abs(q[-1] - min(1, 1e-5 * harmonic if m > 1 else 1e-6)) < 1e-12


def test_hypergeometric_draws_are_exact():
    """Quantiles against all draws counted by binomials, and against every permutation of a few marks."""
    from itertools import permutations
    from chainspark.functions.draws import hypergeometric_quantiles as draws
    for n, k, m in ((9, 4, 5), (12, 12, 3), (7, 0, 2), (30, 11, 25), (400, 150, 60)):
        low, high = max(0, k + m - n), min(k, m)
        p = [math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(low, high + 1)]
        edges = np.cumsum(p)
        us = np.concatenate([[1e-12], (edges[:-1] + edges[1:]) / 2, edges[:-1] - 1e-9])
        us = us[us < 1 - 1e-9]  # above, the doubles of the sums themselves decide
        want = [low + sum(e < u for e in edges) for u in us]
        assert draws(n, k, m, us).tolist() == [min(w, high) for w in want]
    marks = (1, 1, 1, 0, 0, 0, 0)
    seen = sorted(sum(order[:4]) for order in permutations(marks))
    us = (np.arange(len(seen)) + 0.5) / len(seen)
    assert draws(7, 3, 4, us).tolist() == seen
    big = draws(10 ** 10, 3 * 10 ** 9, 10 ** 9, np.array([0.025, 0.5, 0.975]))  # the cost is the root of the size
    sd = math.sqrt(10 ** 9 * 0.3 * 0.7 * 0.9)
    assert np.allclose((big - 3 * 10 ** 8) / sd, [-1.959964, 0, 1.959964], atol=1e-3)


def test_windows_with_a_hot_bucket(spark):
    """Half of all points lie in one bucket of one key, many at one time; sums and maxima of every window."""
    rng = np.random.default_rng(9)
    t = np.where(rng.random(400) < 0.5, np.round(rng.uniform(100, 101, 400), 1), np.round(rng.uniform(0, 300, 400)))
    key = np.where(rng.random(400) < 0.6, 1, rng.integers(1, 4, 400))
    pts = pd.DataFrame({"k": key, "x": t, "v": rng.integers(0, 50, 400)})
    centres = pd.DataFrame({"k": rng.integers(1, 5, 60), "id": range(60), "t": np.round(rng.uniform(0, 300, 60))})
    p = spark.createDataFrame(pts)
    rates = Q.window_rates(p, spark.createDataFrame(centres).withColumnRenamed("id", "centre_id"), ["k"], "x", F.col("v"),
                           F.lit(1), 20.0, 3.0).collect()
    best = Q.max_within(p, spark.createDataFrame(centres).withColumnRenamed("id", "start_id"), ["k"], "x", "v", 20.0).collect()
    assert len(rates) == len(best) == 60
    for r in rates:
        own = pts[pts.k == r.k]
        for tag, inside in (("before", (own.x >= max(r.t - 23, 0)) & (own.x < r.t - 3)), ("after", (own.x > r.t + 3) & (own.x <= r.t + 23))):
            part = own[inside]
            assert (r[f"rate_{tag}"] is None) if part.empty else r[f"rate_{tag}"] == part.v.sum() / len(part), (r, tag)
    for r in best:
        own = pts[(pts.k == r.k) & (pts.x >= r.t) & (pts.x <= r.t + 20)]
        assert r.best == (None if own.empty else own.v.max())


def test_matched_effects_against_loops(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"u": rng.integers(0, 3, 200), "s": rng.integers(0, 4, 200), "e": range(200), "v": rng.normal(size=200)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(0, None, 900, 1.0), (1, None, 901, 3.0), (2, 1, 902, None)], "u bigint, s bigint, e bigint, v double"))
    got = {r.e: r for r in L.matched_effects(df, "u", ["s"], "v", 1).collect()}
    assert len(got) == 202 and got[900].base == 3.0 and got[901].adjusted == 2.0
    for r in pdf.itertuples():
        others = pdf[(pdf.u != r.u) & (pdf.s == r.s)].v
        assert abs(got[r.e].adjusted - (r.v - others.mean())) < 1e-9
    assert all(r.base is None for r in L.matched_effects(df, "u", ["s"], "v", 1000).collect())
    rows = L.unit_effects(L.matched_effects(df.withColumn("m", F.lit("x")), "u", ["s"], "v", 1), "u", "e", "m", 10, 3).collect()
    for r in rows:
        own = [x.adjusted for x in got.values() if x.u == r.u]
        assert r.matched == len(own) and abs(r.point - np.mean(own)) < 1e-9 and r.p <= r.q <= 1


def test_scope_parts_survive_a_second_write(spark, tmp_path):
    from chainspark.sources import adapters as A
    events = spark.createDataFrame([(m, i, float(m * i)) for m in range(1, 7) for i in range(50)], "match_id bigint, index bigint, x double")
    index = spark.createDataFrame([(m, "s1" if m < 4 else "s2", "a" if m % 2 else "b", "c", "Regular Season") for m in range(1, 8)],
                                  "match_id bigint, season string, home string, away string, stage string")
    path = f"file:{tmp_path}/parts"
    A.write_scope(events, A.scope_of(index), path)
    # one season again, changed: the other one stays
    A.write_scope(events.withColumn("x", F.lit(-1.0)), A.scope_of(index, ["s2"]), path)
    back = A.read_scope(A.scope_of(index, clubs=["a"]), path)
    assert {(r.match_id, r.n, r.s) for r in back.groupBy("match_id").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()} == {
        (1, 50, 1225.0), (3, 50, 3675.0), (5, 50, -50.0)}
    one = A.read_scope(A.scope_of(index, ["s1"]), path)
    assert one.count() == 150 and "PartitionFilters: [isnotnull(season" in one._jdf.queryExecution().executedPlan().toString()


def test_lattice_rolls_up_to_every_grid(spark):
    from dataclasses import replace

    from chainspark.operators import resolution as Z
    rng = np.random.default_rng(6)
    rows = []
    for p in range(80):
        n = int(rng.integers(1, 6))
        pts = [(float(rng.uniform(0, 120)), float(rng.uniform(0, 80))) for _ in range(n)]
        for k in range(n):
            nxt = pts[k + 1] if k + 1 < n else pts[k]
            out = str(rng.choice(["GOAL", "LOSS", ""])) if k + 1 == n else ""
            rows.append(("u", k + 1, "open", out, *pts[k], *nxt, None if k + 1 == n else nxt[0]))
    df = spark.createDataFrame(rows, "unit string, event_index int, phase string, outcome string, start_x double, start_y double, end_x double, end_y double, next_x double")
    cells, fine = Z.lattice(df, [(3, 2), (5, 4)], SPACE, ["unit"])
    assert (fine.nx, fine.ny) == (15, 4)
    for nx, ny in ((3, 2), (5, 4)):
        counts, starts, own = Z.roll_up(cells, fine, (nx, ny), ["unit"])
        assert own == replace(SPACE, nx=nx, ny=ny)
        want = {}
        for _, k, _, out, x, y, ex, ey, nx_ in rows:
            z = lambda a, b: (int(a / 120 * nx) * ny + int(b / 80 * ny)) * own.n_phases
            j = own.absorbing_state(out) if out else z(ex, ey)
            want[z(x, y), j] = want.get((z(x, y), j), 0) + 1
            if nx_ is None and not out:
                key = (j, own.absorbing_state("LOSS"))
                want[key] = want.get(key, 0) + 1
        assert {(r.i, r.j): r.n for r in counts.collect()} == want
        assert sum(r.a for r in starts.collect()) == 80
