import random

from chainspark.llm import line_dedup as L
from tests.llm import plain


def documents(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(300)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 30]))) for _ in range(25)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            own.append(" ".join(w))
        docs.append((i * 3, "\n".join(own)))
    return docs


def test_lines_match_all_pairs(spark):
    docs = documents(5)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: list(r["lines_removed"]) for r in L.line_report(table, 80, 4).collect()}
    want = plain.repeated_lines(docs, 80, 4)
    assert got == {i: want.get(i, []) for i, _ in docs} and any(got.values())


def test_kept_text_and_odd_rows(spark):
    table = plain.odd_documents(spark)
    out = L.dedup_lines(table)
    assert out.columns == [*table.columns, "lines_removed"]
    rows = out.collect()
    assert len(rows) == table.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["text"], list(r["lines_removed"])))
    long = next(r["text"] for r in table.collect() if r["doc_id"] == 6)
    assert by[6] == [(long, [])] and by[7] == [("", [0])] and by[2] == [("", [0])]
    assert len(by[1]) == 2 and all(not cut for _, cut in by[1])
    assert (None, []) in by[None] and by[3] == [(None, [])] and by[4] == [("", [])] and by[10][0][1] == []
    assert L.dedup_lines(plain.empty_documents(spark)).count() == 0


def test_query_removes_short_repeats(spark, tmp_path):
    from chainspark.llm.queries import QUERIES
    docs = [(i, f"All rights reserved.\nline {i}\n\n \nyes\nno no no no no no no no no\nof its own are {i} words in here, some {i}") for i in range(9)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: list(r["lines_removed"]) for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    want = plain.repeated_lines(docs, 85, 1)
    assert got == {i: want.get(i, []) for i, _ in docs} and got[8] == [0, 4, 5]
