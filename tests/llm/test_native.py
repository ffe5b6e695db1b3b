"""Decontamination, URL filter and mixing: SQL twins, brute force and awkward rows."""

import duckdb
import pytest

from chainspark.compare import compare, register_views
from chainspark.llm import decontaminate as D
from chainspark.llm import mixing as M
from chainspark.llm import queries
from chainspark.llm import url_filter as U
from tests.llm import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    register_views(con, SF)
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) and compare(got, con.sql(queries.ORACLES[name]).df()) is None


DOCS = [(1, "The quick brown fox jumps over the lazy dog, and then it runs away fast!"), (2, "a b c"), (3, None), (4, ""),
        (5, "x b c a b c a b C. d"), (6, "runs away over the lazy dog and then it runs away fast the quick"), (6, "a b c"),
        (7, "nothing " * 30_000 + "a b c"), (None, "a b c")]
ITEMS = [(10, "quick brown fox jumps over the lazy dog and then it runs"), (11, "B c"), (11, "a B c"), (12, None), (13, "!!"),
         (None, "c a"), (14, "fox the over"), (15, "the lazy dog and then it runs away fast the quick")]


def rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in DOCS], "doc_id bigint, text string, pos int, term string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, span int")
    return docs, items


def test_contamination_matches_brute_force(spark):
    docs, items = rows(spark)
    got = D.contamination(docs, items).collect()
    assert len(got) == len(DOCS)
    want = [(i, *plain.contamination([(0, t)], ITEMS)[0]) for i, t in DOCS]
    want = sorted((i or 0, n, h, sorted(str(x) for x in found if x is not None), h > 0) for i, n, h, found in want)
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in got) == want
    assert D.contamination(docs.where("false"), items).count() == 0
    assert not any(r["contaminated"] for r in D.contamination(docs, items.where("false")).collect())
    odd = plain.odd_documents(spark)
    assert D.contamination(odd, items).count() == odd.count()


def test_proximity_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)  # the way without broadcasts
    docs, items = rows(spark)
    table = D.item_table(items)
    from pyspark.sql import functions as F
    index = D.build_index(docs, table.select(F.explode("item_words").alias("word")))
    got = {(r["doc_id"], r["item_id"]) for r in D.proximity_matches(table, index, 4).collect()}
    frequency = {}
    for _, t in DOCS:
        for w in plain.terms(t):
            frequency[w] = frequency.get(w, 0) + 1
    want = set()
    for i, t in DOCS:
        w = plain.terms(t)
        for item, it in ITEMS:
            own = set(plain.terms(it))
            if own:
                rare = min(own, key=lambda x: (frequency.get(x, 0), x))
                if any(x == rare and all(y in w[max(0, p - 4):p + 5] for y in own) for p, x in enumerate(w)):
                    want.add((i, item))
    assert got == want and want
    assert D.contamination(docs, items).where("contaminated").count() > 0


def test_url_rules_and_mined_rules(spark):
    urls = ["http://A.com/x?y=1", "https://sub.a.com/x/1", "ftp://a.com", "no scheme", None, "http://b.com/x#f", "x://a.com/x://b"]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls * 10)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(i, 0 if i % 7 in (0, 1) else 1, 0) for i in range(70)] + [(None, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    fixed = [("allow", "a.com", "/x/"), ("block", "com", "/"), ("block", "a.com", "/")]
    got = {r["page_id"]: r for r in U.judge_urls(pages, labels, fixed, confidence=0.7, least=5).collect()}
    assert len(got) == 70
    assert [(got[i]["host"], got[i]["path"]) for i in range(7)] == [
        ("a.com", "/x"), ("sub.a.com", "/x/1"), ("a.com", ""), ("", ""), ("", ""), ("b.com", "/x"), ("a.com", "/x://b")]
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(7)] == [
        ("a.com/", "block"), ("a.com/x/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "block"), ("a.com/", "block")]
    mined = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages, labels, [], confidence=0.7, least=5).collect()}
    assert [mined[i] for i in range(7)] == ["block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert U.judge_urls(pages.where("false"), labels, fixed).count() == 0
    assert {r["verdict"] for r in U.judge_urls(pages, labels.where("false"), []).collect()} == {"allow"}


def test_mix_reaches_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), f"s{i % 4}" if i % 11 else None) for i in range(3000)],
                                 "doc_id bigint, text string, source string")
    rows = M.mix_sources(docs).collect()
    total = sum(r["size"] for r in rows)
    targets, taken = {}, {}
    for r in rows:
        targets[r["source"]] = (r["target"], r["source_size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6
    assert all(t <= 2 * s + 1e-9 and abs(taken[k] - t) <= 100 for k, (t, s) in targets.items())
    again = {r["doc_id"]: r["taken"] for r in M.mix_sources(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    emitted = M.emit_mix(docs.withColumn("_times", docs["doc_id"]))
    assert emitted.columns == ["doc_id", "text", "source", "_times", "copy"]
    assert emitted.count() == sum(r["copies"] for r in rows)


def test_mix_odd_rows(spark):
    odd = plain.odd_documents(spark)
    rows = M.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert set(M.emit_mix(odd).columns) == set(odd.columns)
    assert M.mix_sources(plain.empty_documents(spark)).count() == 0
    nothing = odd.where("text IS NULL")
    assert {(r["target"], r["taken"]) for r in M.mix_sources(nothing).collect()} == {(0.0, 0)}
