"""Classifier and quality rules."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chainspark.llm import classifier as C
from chainspark.llm import quality_rules as Q
from chainspark.llm.text import chunks
from tests.llm import plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_independence(spark, tables):
    docs, labels = tables
    rows = C.classify(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(p == 1 for q, p in held if q == 1)
    assert np.mean([p == q for q, p in held]) > 0.93
    # labels of held-out rows change no score
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 0).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in C.classify(docs, turned).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1, -1)
    w, b = C.dual_coordinate_descent([(np.arange(5), v) for v in x], y, 5, most=3000, tolerance=1e-6)

    def loss(w, b):
        return (w @ w + b * b) / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    assert all(best <= loss(w + rng.normal(size=5) * s, b + rng.normal() * s) + 1e-9 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_classifier_odd_rows(spark, tables):
    odd = plain.odd_documents(spark)
    rows = C.classify(odd, tables[1]).collect()
    assert len(rows) == odd.count() and all(r["held_out"] is not None for r in rows)
    assert C.keep_good(odd, tables[1].where("false")).collect() == odd.collect()  # no labels: all stay
    assert C.classify(plain.empty_documents(spark), tables[1]).count() == 0


def plain_statistics(text):
    w = plain.words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if plain.words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_base_statistics(spark, tables):
    texts = [r["text"] for r in tables[0].limit(150).collect()] + [r["text"] for r in plain.odd_documents(spark).collect()]
    texts += ["a b c a b c a", "a a a a", "x\nx\n\n \ny x\nx", "# | a\n# | a", "a b", "\n"]
    for chunk in chunks(pa.array(texts, pa.string())):
        stats = Q.text_statistics(chunk)
        for d in range(chunk.n):
            assert {k: int(v[d]) for k, v in stats.items()} == plain_statistics(texts[chunk.first_row + d])


def test_log_ratio_and_verdict(spark):
    """The ratio against a direct count over n-gram buckets, and the rules built on it."""
    docs = [(i, " ".join(f"{'good' if i % 3 else 'bad'}{(i * j) % 17}" for j in range(60))) for i in range(30)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 30, 2)] + [(None, 1, 0)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in Q.judge_documents(table, marks, bits=20).collect()}

    def grams(t):
        w = plain.words(plain.lower(t))
        return [*w, *zip(w, w[1:])]
    raw = Counter(g for _, t in docs for g in grams(t))
    good = Counter(g for i, t in docs if (i, 1, 0) in labels for g in grams(t))
    share = sum(good.values()) / sum(raw.values())
    for i, t in docs:
        want = np.mean([math.log((good[g] + Q.PRIOR) / ((raw[g] - 1) * share + Q.PRIOR)) for g in grams(t)])
        assert abs(rows[i]["log_ratio"] - want) < 1e-5
        failed = rows[i]["n_words"] < 50 or 100 * rows[i]["n_repeat_words"] > 50 * rows[i]["n_words"]
        assert rows[i]["base_failed"] == failed and rows[i]["kept"] == (not failed and want >= Q.THRESHOLD)


def test_rules_keep_the_good(spark, tables):
    rows = Q.judge_documents(*tables).collect()
    truth = {r["doc_id"]: r["quality"] for r in tables[1].collect()}
    passed = [(truth.get(r["doc_id"]), r["kept"]) for r in rows if not r["base_failed"]]
    assert all(k for q, k in passed if q == 1) and not any(k for q, k in passed if q == 0)


def test_rules_odd_rows(spark, tables):
    odd = plain.odd_documents(spark)
    got = Q.judge_documents(odd, tables[1]).collect()
    assert len(got) == odd.count() and all(r["base_failed"] for r in got if r["n_words"] == 0)
    assert all(r["log_ratio"] == 0 for r in Q.judge_documents(odd, tables[1].where("false")).collect())
    assert Q.judge_documents(plain.empty_documents(spark), tables[1]).count() == 0
