import corpus_pipeline as P
from chainspark.llm.classifier import classify
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_every_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(P.STAGES)
    good = steps["quality"](spark, docs, SF)
    verdict = {r["doc_id"] for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == verdict
    kept = P.cut_lineage(steps["lines"](spark, good, SF))
    own = [(r["doc_id"], r["text"]) for r in good.collect()]
    cut = plain.repeated_lines(own, 85, 1)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut.get(i, [])) for i, t in own}
    want = {i: t for i, t in want.items() if not cut.get(i) or plain.words(t)}
    assert kept.columns == columns and {r["doc_id"]: r["text"] for r in kept.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect() if cut.get(r["doc_id"]))
    single = P.cut_lineage(steps["near_copies"](spark, kept, SF))
    first = {i for i, (_, c) in plain.groups(list(want.items()), 5, 80).items() if i == c}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == first
    clean = P.cut_lineage(steps["benchmark"](spark, single, SF))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, (_, h, _) in plain.contamination([(i, want[i]) for i in first], items).items() if h}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == first - hit
    mixed = steps["mix"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in mixed} <= first - hit and max(r["copy"] for r in mixed) <= 2


def test_odd_rows_pass_every_stage(spark):
    docs = plain.odd_documents(spark)
    for name, stage in P.STAGES:
        out = P.cut_lineage(stage(spark, docs, SF))
        assert out.columns == docs.columns or name == "mix"
        nothing = stage(spark, docs.where("false"), SF)
        assert nothing.count() == 0
        if name == "near_copies":
            assert sorted((r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect())) == sorted(
                {r["doc_id"] for r in docs.where("doc_id IS NOT NULL").collect()} - {2, 7})
            out = docs


def test_copies_under_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (9, b + " more"), (None, a)], "doc_id bigint, text string")
    kept = dict(P.STAGES)["near_copies"](spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, a), (3, a), (5, b)]


def test_short_lines_that_repeat_go(spark):
    docs = spark.createDataFrame([(1, "one text\nBuy now"), (2, "another one\nBuy now\n--")], "doc_id bigint, text string")
    kept = dict(P.STAGES)["lines"](spark, docs, SF).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: "one text\nBuy now", 2: "another one\n--"}


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is P.run and P.ORACLE_SQL is None
    assert {q.split("_")[0] for q in entry.queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert P.run(spark, SF).count() > 0
