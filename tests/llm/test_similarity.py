import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainspark.llm import similarity as S
from chainspark.llm.components import components
from tests.llm import plain


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_key(percent):
    """The pigeonhole promise of the segments, on pairs at the edge of the threshold."""
    rng = np.random.default_rng(percent)
    bands = S.Bands(percent)
    linked = 0
    for trial in range(400):
        n = int(rng.integers(1, 400)) if trial % 2 else int(rng.integers(1, 25))
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        m = int(rng.integers(max(1, percent * len(a) // 100), 100 * len(a) // percent + 1))
        both = int(bands.overlap(len(a), m))
        if both > min(len(a), m):
            continue
        b = np.unique(np.concatenate([rng.permutation(a)[:both], rng.integers(0, 2 ** 63, m - both, dtype=np.uint64)]))
        if not S._linked(a, b, bands) or np.array_equal(a, b):
            continue
        linked += 1
        keys, owners = S.segment_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]),
                                      np.array([len(a), len(b)]), bands)
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist()), (len(a), len(b), both)
        x, y = S.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (len(a) + len(b) - S._apart(x, y)) // 2 >= both
    assert linked > 50


def varied_documents(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 15, 40, 90]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                own = own[:rng.randint(1, len(own))]
            docs.append((len(docs), " ".join(own)))
    return docs


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 3, 60)])
def test_groups_match_all_pairs(spark, seed, k, percent, monkeypatch):
    monkeypatch.setattr(S, "TILE", 3)  # many tiles a key
    monkeypatch.setattr(S, "BEST", 1)
    docs = varied_documents(seed)
    got = S.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain.groups(docs, k, percent)


def test_pairs_are_intersected_once(spark, monkeypatch):
    """Best pairs, and then all pairs, leave out those that an earlier pass has intersected."""
    monkeypatch.setattr(S, "TILE", 3)
    monkeypatch.setattr(S, "BEST", 1)
    seen = []
    verified = S._verified_pairs
    monkeypatch.setattr(S, "_verified_pairs", lambda pairs, *a: seen.append([(min(r), max(r)) for r in pairs.collect()]) or verified(pairs, *a))
    docs = varied_documents(1)
    got = S.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain.groups(docs, 4, 85)
    assert len(seen) == 3 and not set(seen[0]) & set(seen[1]) and not set(seen[2]) & {*seen[0], *seen[1]}


def test_large_sets_that_share_a_key_by_chance_are_not_moved(spark, monkeypatch):
    """Of large unrelated sets under one key no pair is left for the exact check, so none of their sets is made."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(1500))) for i in range(6)]
    docs.append((6, docs[0][1].replace(" w1", " v1", 1)))
    keys, asked = S._keys, []
    monkeypatch.setattr(S, "_keys", lambda *a: keys(*a).select(F.lit(1).cast("bigint").alias("key"), "node").distinct())
    verified = S._verified_pairs
    monkeypatch.setattr(S, "_verified_pairs", lambda pairs, *a: asked.extend({r["a"], r["b"]} for r in pairs.collect()) or verified(pairs, *a))
    got = S.similar_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: i for i in range(6)}, 6: 0}
    assert asked == [{0, 6}]


def test_filter_keeps_all_that_is_wanted(spark):
    """Rows are told before they are dealt, and none that is wanted is lost."""
    rows = spark.range(2000).selectExpr("id * 7 - 5000 AS rep", "cast(id AS string) AS items")
    ids = spark.range(0, 2000, 9).selectExpr("id * 7 - 5000 AS rep")
    likely = S._likely(rows, "rep", ids)
    assert "Exchange" not in likely._jdf.queryExecution().executedPlan().toString()
    got, want = {r["rep"] for r in likely.collect()}, {r["rep"] for r in ids.collect()}
    assert want <= got and len(got) < len(want) + 5


def test_odd_rows(spark):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in S.similar_groups(plain.odd_documents(spark), 4, 85).collect()}
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (9, 1, 9), (8, 1, 8), (None, 0, None)} <= rows
    assert {c for i, n, c in rows if i in (1, 2)} == {1} and {c for i, n, c in rows if i in (6, 7)} == {6}
    assert [c for i, n, c in rows if i is None and n] == [1]
    assert S.similar_groups(plain.empty_documents(spark), 4, 85).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)] + [(129, 90)]
    links = spark.createDataFrame(path + star + [(7, 7), (7, 6), (None, 3)], "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 90 for i in range(30)}, 90: 90}
    assert components(links.where("false")).count() == 0
