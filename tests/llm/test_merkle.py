"""The Merkle manifest against a tree built in plain Python, with proofs folded by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from chainspark.llm.merkle import fold_proof, leaf_digest, manifest
from tests.llm.plain import empty_documents, odd_documents


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(digests, fan=16):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def path(levels, k, fan=16):
    out = []
    for nodes in levels[:-1]:
        start = k // fan * fan
        out += [nodes[i] for i in range(start, min(start + fan, len(nodes))) if i != k]
        k //= fan
    return out


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0], H("".join(map(cell, r)))))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels_of([d for _, d in sources[s]])
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for k, (doc, leaf) in enumerate(sources[s]):
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], H("".join(path(trees[s], k) + path(top, i)))))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


@pytest.mark.parametrize("counts", [(1,), (16,), (17, 1), (256, 257), (273, 40, 1, 2)])
def test_trees_of_many_shapes(spark, counts):
    rows = [(100 * k + 7, f"s{n}", "en" if k % 3 else None, k, f"text é {k}\n{n}") for n, c in enumerate(counts) for k in range(c)]
    got = manifest(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == expected(rows)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_many_sources_and_small_blocks(spark):
    rows = [(k, f"source {k % 300}", None, None, str(k)) for k in range(900)]
    got = manifest(table(spark, rows), levels=1).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == expected(rows)
    assert all(r.verified for r in got)


def test_tampered_rows_fail_and_proofs_fold(spark):
    rows = [(k, "a" if k % 3 else None, "en", k, f"Text {k}") for k in range(60)]
    check = F.when(F.col("doc_id") % 7 == 0, leaf_digest(text=F.lower("text"))).otherwise(leaf_digest())
    got = manifest(table(spark, rows), check=check, proofs=True).collect()
    assert {r.doc_id for r in got if not r.verified} == {k for k in range(60) if k % 7 == 0}
    for r in got:
        assert fold_proof(bytes.fromhex(r.leaf), [s.asDict() for s in r.proof]).hex() == r.root
        assert H("".join(bytes(s.others).hex() for s in r.proof)) == r.proof_sha256


def test_odd_tables(spark):
    odd = odd_documents(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(3)).withColumn("k", F.lit(1))
    rows = [(r.doc_id, r.source, None, 3, r.text) for r in odd.collect()]
    got = manifest(odd).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == expected(rows)
    assert all(r.verified for r in got)
    none = manifest(empty_documents(spark).withColumn("lang", F.lit("x")).withColumn("n_chars", F.lit(3)))
    assert none.count() == 0 and "verified" in none.columns
