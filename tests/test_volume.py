"""What the shared steps move: rows are dealt once, and hot keys give the same tables."""

import pytest
from pyspark.sql import functions as F

from chainspark.functions.scan import Running, scan
from chainspark.operators import chains
from chainspark.plans import tables as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_deals_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("id % 3 AS k", "id AS t", "id AS v", "id AS wide")
        got = plan(scan(df, ["k"], ["t"], F.floor(F.col("t") / 7), [Running("s", "sum", F.col("v"))]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the aggregate of the carry, its windows, its join and the rows
    assert got.count("Exchange hashpartitioning") == 4


def test_terminal_row_needs_no_exchange(spark):
    states = chains.to_states(T.moves(spark, SF), T.SPACE)
    got = chains.append_terminal(states, T.SPACE, F.col("event_index") == F.col("length"))
    assert "Exchange" not in plan(got)
    want = chains.append_terminal(states, T.SPACE)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_moves_of_hot_orders(spark):
    """Orders cut into parts give the moves of whole ones."""
    want = T.moves(spark, SF)

    spark.conf.set("spark.chainspark.hotRows", "3")
    try:
        got = T._moves(spark, SF).localCheckpoint()
    finally:
        spark.conf.unset("spark.chainspark.hotRows")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_moves_deal_lines_twice(spark):
    """Once narrow, for the orders, and once in full: orders' rows come to where the lines are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = plan(T._possessions(spark, SF))
        got = plan(T._moves(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "lineitem" not in orders and orders.count("Exchange hashpartitioning") == 4
    # the plan's rows go down from the join to the scan of lines on its left side
    left = got[got.index("SortMergeJoin"):got.index("lineitem")]
    assert left.count("Exchange hashpartitioning") == 1


def test_last_part_of_orders(spark, tmp_path):
    """The last part is that of the last line in the order of all columns, with ties and nulls."""
    rows = [(1, 1, 9, 5, 1.0), (1, 2, 3, 5, 1.0), (1, 2, 10, 1, 0.5), (1, 2, 10, 1, 2.0), (2, None, 8, 1, 1.0), (2, 1, None, 1, 1.0), (3, None, 4, 2, 1.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double").selectExpr(
        "*", "l_quantity l_extendedprice", "timestamp'1995-01-01' l_shipdate").createOrReplaceTempView("last_lines")
    df = spark.table("last_lines")
    want = df.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct(*T.LINE_ORDER)).alias("p"))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 2, "2-HIGH") for k in (1, 2, 3)], "o_orderkey bigint, o_custkey bigint, o_orderpriority string").selectExpr(
        "*", "timestamp'1995-01-01' + make_dt_interval(o_orderkey) o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = T._possessions(spark, str(tmp_path)).orderBy("possession").select("possession", "length", "score_state").collect()
    assert {r["l_orderkey"]: r["p"] for r in want.collect()} == {1: 10, 2: None, 3: 4}
    assert [tuple(r) for r in got] == [(1, 4, "drawing"), (2, 2, "winning"), (3, 1, "winning")]


def test_weights_are_drawn_for_blocks(spark):
    """No filter on the weights goes below the aggregate of the block cells."""
    from chainspark.operators import resample as R

    rows = spark.range(1000).selectExpr("id % 5 AS m", "id AS v").groupBy("m").agg(F.sum("v").alias("v"))
    d = R.poisson_weights(rows, "m", 10, 5).withColumn("w", R.opened("w"))
    lines = [x.lstrip(" :+-") for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert any("md5" in x for x in lines) and not any("md5" in x for x in lines if x.startswith("Filter"))


def test_draws_are_spread_over_tasks(spark):
    """Few rows that open into many draws are not merged into one task."""
    from chainspark.session import spread

    assert spread(spark.range(40).withColumnRenamed("id", "part"), "part").rdd.getNumPartitions() > 1


def test_opened_slots_are_not_sent_to_the_driver(spark):
    from chainspark.operators import contrast as X

    tr = T.transitions(spark, SF)
    own = F.col("team") == "T1"
    q = tr.groupBy(F.col("from_state").alias("i"), F.col("to_state").alias("j")).agg((F.count(F.lit(1)) / 5000).alias("q"))
    seen = []
    join = X.R.replicate_sums
    X.R.replicate_sums = lambda cells, weights, *a: seen.append(plan(cells.join(weights, "poss_uid"))) or join(cells, weights, *a)
    try:
        X.fingerprint(tr.filter(own), tr.filter(~own), q, 3, 21)
    finally:
        X.R.replicate_sums = join
    head = seen[0]
    assert head.count("SortMergeJoin") >= 2 and "rank" not in "".join(x for x in head.splitlines() if "BroadcastHashJoin" in x)


def test_layout_of_labels(spark, monkeypatch):
    """Ranges of slots hold every label at its slots, whatever the size of a range."""
    from chainspark.operators import resample as R

    monkeypatch.setattr(R, "SLOTS", 3)
    labels = ["a"] * 7 + ["b"] + ["c"] * 2 + ["d"] * 4
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "s string, m int, l string")
    rows = R.label_layout(df, ["s"], "l").collect()
    assert all(len(r["__labels"]) <= 3 for r in rows)
    got = [next(x["l"] for x in r["__labels"] if x["__hi"] > 3 * r["__range"] + k) for r in sorted(rows, key=lambda r: r["__range"])
           for k in range(3) if 3 * r["__range"] + k < len(labels)]
    assert got == labels
    perm = R.permutation_labels(df, ["s"], "m", "l", 4, 3).groupBy("b", "l").count().collect()
    assert {(r["b"], r["l"]): r["count"] for r in perm} == {(b, x): labels.count(x) for b in range(5) for x in "abcd"}


def test_calibration_null_permutes_rows(spark):
    """Every replicate draws for every row; the rows with the smallest draws keep the marks."""
    import hashlib

    import numpy as np

    from chainspark.operators import pressure as P

    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), f"r{i}", bool(rng.random() < 0.3), float(rng.random() < 0.4)) for i in range(900)]
    df = spark.createDataFrame(rows, "z int, uid string, last boolean, y double")
    got = {r["b"]: r["diff"] for r in P.calibrated_null(df, ["z"], "last", 10, 3, 7, "uid").collect()}
    for b in range(4):
        total = 0.0
        for z in range(3):
            part = [r for r in rows if r[0] == z]
            n1 = int(sum(r[3] for r in part))
            if b == 0:
                marked = [r for r in part if r[3]]
            else:
                marked = sorted(part, key=lambda r: int(hashlib.md5(f"7:{b}:{r[1]}".encode()).hexdigest()[:15], 16))[:n1]
            k, hits = sum(r[2] for r in marked), sum(r[2] for r in part)
            total += len(part) * (k / n1 - (hits - k) / (len(part) - n1))
        assert abs(got[b] - total / len(rows)) < 1e-9


@pytest.mark.parametrize("slack,passes", [((6, 20), 1), ((0.2, 0), 2)])
def test_calibration_null_draws_once_in_arrays(spark, monkeypatch, slack, passes):
    """Draws are taken in arrays, in one pass; where the range misses the last mark, a second one takes all rows."""
    from chainspark.operators import pressure as P

    plans, cut = [], P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    monkeypatch.setattr(P, "SLACK", slack, raising=False)
    test_calibration_null_permutes_rows(spark)
    assert not any("md5" in x for x in plans) and sum("MapInArrow" in x for x in plans) == passes


def test_array_draws(spark):
    """Draws in arrays are those of the column, for messages of any length."""
    import pyarrow as pa

    from chainspark.functions.draws import Draws, draw

    ids = ["", "a", "é" * 9, "x" * 49, "x" * 50, "x" * 51, "y" * 64, "z" * 200]
    want = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").select("i", *[draw(91, F.lit(b), F.col("x")) for b in (1, 9, 10, 4000)])
    draws = Draws(91, pa.array(ids))
    got = [draws.of(b).tolist() for b in (1, 9, 10, 4000)]
    assert [list(r)[1:] for r in want.orderBy("i").collect()] == [list(r) for r in zip(*got)]


def test_score_deals_events_once(spark):
    """Events meet teams and earlier goals in one exchange, and only actions and goals are dealt."""
    from chainspark.sources import events as EV
    from tests.test_operators import literal_events

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ev = EV.normalise(literal_events(spark))
        wide = plan(chains.add_score_state(ev, club="A", chunk=F.lit(0)))
        built = plan(chains.build_transitions(ev, T.SPACE, club="A"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the rows; goals by (match, chunk, team), by match, and by chunk
    assert wide.count("Exchange hashpartitioning") == 4
    # the same, and two to close possessions; no point travels
    assert built.count("Exchange hashpartitioning") == 6
    dealt = [x for x in built.splitlines() if "SortMergeJoin [__g" in x or "Window [" in x]
    assert dealt and not any("start_x" in x for x in dealt)


def test_score_counts_all_events(spark):
    """Goals of rows that are no actions count, in every chunking; events without a match go."""
    rows = [(1, 1, "Own Goal For", "B", "A", 1), (1, 2, "Pass", "A", "A", 1), (1, 3, "Pass", "B", "B", 2), (1, 4, "Pass", "A", "A", 3),
            (2, 1, "Pass", "A", "A", 1), (None, 1, "Pass", "A", "A", 1)]
    from chainspark.sources import events as EV

    df = spark.createDataFrame(rows, "match_id bigint, index bigint, type string, team string, possession_team string, possession bigint").selectExpr(
        "cast(index as string) id", "1 period", "0 minute", "0 second", "cast(null as bigint) player_id", "'Regular Play' play_pattern", "'[30, 30]' location",
        "'[60, 30]' pass_end_location", "cast(null as string) pass_outcome", "cast(null as string) shot_outcome", "*")
    ev = EV.normalise(df)
    for chunk in (F.lit(0), F.col("index"), F.floor(F.col("index") / 2)):
        got = sorted((r["match_id"], r["index"], r["goal_diff"]) for r in chains.add_score_state(ev, chunk=chunk).collect())
        assert got == [(1, 1, 0), (1, 2, -1), (1, 3, 1), (1, 4, -1), (2, 1, 0)]
        tr = chains.build_transitions(ev, T.SPACE, cfg=chains.ChainConfig(min_actions=1), chunk=chunk).filter("action_type = 'Pass'")
        assert sorted((r["match_id"], r["event_index"], r["score_state"]) for r in tr.collect()) == [
            (1, 2, "losing"), (1, 3, "winning"), (1, 4, "losing"), (2, 1, "drawing")]


def test_regression_check_deals_tables_once(spark):
    """Two aggregates; nulls, repeats and keys of one side are counted as by joins."""
    from chainspark.operators import quality as K

    old = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, 2), ("c", 2, 3), (None, 1, 4), (None, 1, 4)], "k string, i int, v int")
    new = spark.createDataFrame([(1, "a", 1), (2, "c", 9), (2, "c", 9), (5, "d", 9), (1, None, 4)], "i int, k string, v int").select("v", "k", "i")
    got = K.regression_check(old, new, ["k", "i"])
    assert plan(got).count("Exchange hashpartitioning") == 2
    assert got.collect()[0].asDict() == {"rows_old": 6, "rows_new": 5, "duplicate_keys": 1, "keys_lost": 3, "keys_added": 2, "rows_different": 7, "same": False}
    none = K.regression_check(old.filter("false"), new.filter("false"), ["k", "i"]).collect()[0].asDict()
    assert none == {"rows_old": 0, "rows_new": 0, "duplicate_keys": 0, "keys_lost": 0, "keys_added": 0, "rows_different": 0, "same": True}


def test_error_curve_moves_cells_only(spark):
    """Prefixes of a random order end at draws that rows compare with their own: the result reads cells, no possession."""
    from chainspark.operators import estimate as E

    tr = T.transitions(spark, SF)
    q = E.prior(E.count_cells(tr), T.SPACE)
    assert "poss_uid" not in plan(E.error_curve(tr, q, 20.0, [0.1, 1.0], 2, 7, T.SPACE))


def test_subsample_by_cutoffs(spark, monkeypatch):
    """The smallest draws of every key, whatever the ranges; keys of fewer blocks keep all, sizes below one none."""
    import hashlib

    from chainspark.operators import resample as R

    size = {"a": 5, "b": 9, "c": 40, "d": 0, None: 2}
    rows = [(k, f"p{i}{k}", size[k]) for k in size for i in range(9 + 3 * (k == "a"))]
    df = spark.createDataFrame(rows, "k string, p string, n int")
    want = {(k, b, p) for k in size for b in (1, 2) for p in sorted(
        (p for x, p, _ in rows if x == k), key=lambda p: (int(hashlib.md5(f"4:{b}:{p}".encode()).hexdigest()[:15], 16), p))[:size[k]]}
    for ranges in (1, 3, 4096):
        monkeypatch.setattr(R, "RANGES", ranges)
        got = [tuple(r) for r in R.subsample(df, ["k"], "p", "n", 2, 4).select("k", "b", "p").collect()]
        assert len(got) == len(want) and set(got) == want
    cuts = R.subsample_cutoffs(df, ["k"], "p", "n", 2, 4)
    assert "Exchange hashpartitioning" not in plan(R.kept(df, cuts, ["k"], "p", 2, 4))


def test_shot_geometry_is_read_back(spark, monkeypatch):
    """Fits and predictions read features that are worked out already."""
    from chainspark.plans import shot_queries as Q

    seen = []
    fold = Q.G.out_of_fold
    monkeypatch.setattr(Q.G, "out_of_fold", lambda df, *a: seen.append(plan(df)) or fold(df, *a))
    Q.predictions(spark, SF)
    assert "frame" not in seen[0] and "goal_distance" in seen[0]


def test_kitagawa_null_has_the_replicates_of_the_reference(spark):
    """A thousand permutations: p-values lie on their grid, and not only on that of a few."""
    import __spark_entry__ as entry_module

    p = [r["p"] * 1001 for r in entry_module.queries()["d12_kitagawa_null"](spark, SF).collect()]
    assert p and all(abs(x - round(x)) < 0.01 for x in p) and any(round(x) % 143 for x in p)


def test_replicate_fits_are_those_of_weighted_rows(spark):
    """Fits of all replicates at once are the fits of rows that are repeated with their weights."""
    import numpy as np

    from chainspark.operators import logistic as G
    from chainspark.operators import resample as R

    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(12)), float(rng.normal(20, 6)), float(rng.random()), int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "m int, p double, q double, y int").repartition(3)
    w = R.poisson_weights(df, "m", 6, 13).withColumn("w", R.opened("w")).select("*", F.col("w.b").alias("b"), F.col("w.w").alias("wt")).drop("w")
    want = {r["b"]: r["beta"] for r in G.fit_logistic(w, ["p", "q"], "y", ["b"], 3.0, "wt", [("p", "q")]).collect()}
    fits = G.fit_replicates(df, ["p", "q"], "y", "m", 6, 13, 3.0, [("p", "q")]).collect()
    assert len(fits) == 7 and all(r["converged"] and np.allclose(r["beta"], want[r["b"]], atol=1e-8) for r in fits)
