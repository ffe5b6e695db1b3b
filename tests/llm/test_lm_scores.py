"""Language-model scores: counts and base against plain Python, gradients by differences, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np

from chainspark.llm import lm_scores as L
from chainspark.llm import recurrent as R
from tests.llm.plain import empty_documents, lower, odd_documents, words

SF = "/root/testdata/sf0.001"


def base(rows):
    """Per row: held_out, tokens, known, N, base score."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    tokens = [[*words(lower(t)), None] for _, t in rows]
    c = Counter(t for own, h in zip(tokens, held) if not h for t in own)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
            for (i, _), h, own in zip(rows, held, tokens)]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9), (g, w)


def test_gradient_by_differences():
    shape = R.Shape((0, 2, 5, 9), hidden=4, embed=3)
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.5, shape.size)
    at, to, state = rng.integers(0, 9, (5, 3)), rng.integers(0, 9, (5, 3)), rng.normal(size=(3, 4))
    _, grad, _ = R.window_gradient(shape, flat, at, to, state, 0)
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-5
        up, down = (R.window_gradient(shape, flat + s, at, to, state, 0)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-7


def test_probabilities_of_all_continuations_add_up():
    """Over every document of at most three words: the ends' probabilities and what is still open make one."""
    shape = R.Shape((0, 2, 4), hidden=3, embed=2)
    flat = np.random.default_rng(1).normal(0, 1, shape.size).astype(np.float32)
    end, total, texts = 1, 0.0, [[]]
    for _ in range(3):
        closed = [t + [end] for t in texts]
        total += sum(math.exp(s) for s in _scores(shape, flat, closed, end))
        texts = [t + [w] for t in texts for w in range(4) if w != end]
    open_ = sum(math.exp(s) for s in _scores(shape, flat, texts, end))
    assert abs(total + open_ - 1) < 1e-5


def _scores(shape, flat, texts, end):
    ids = np.array([w for t in texts for w in t])
    return R.document_scores(shape, flat, ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), end, window=1)


def test_state_is_carried_across_windows():
    """A long text scored with the training code's forward pass, window by window of any length."""
    shape = R.Shape((0, 3, 8), hidden=5, embed=4)
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 0.7, shape.size).astype(np.float32)
    ids = np.append(rng.integers(0, 7, 700), 7)
    whole = _scores(shape, flat, [list(ids), [3, 7]], 7)
    before = np.concatenate([[7], ids[:-1]])
    for width in (1, 13, 701):
        state, loss = np.zeros((1, 5), np.float32), 0.0
        for a in range(0, len(ids), width):
            part, _, state = R.window_gradient(shape, flat, before[a:a + width, None], ids[a:a + width, None], state, 7)
            loss += part
        assert math.isclose(-loss, whole[0], rel_tol=1e-4)


def test_training_learns_what_counts_cannot_tell():
    rng = np.random.default_rng(3)
    docs = [np.append(np.tile(rng.permutation(4) + 1, 6), 0) for _ in range(300)]  # words recur in the text's own order
    counts = np.bincount(np.concatenate(docs), minlength=5).astype(float)
    shape = R.Shape((0, 2, 5), hidden=16, embed=8)
    flat = R.start(shape, counts)
    firsts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ids = np.concatenate(docs)
    unigram = (np.log(counts / counts.sum())[ids]).sum()
    assert math.isclose(R.document_scores(shape, R.start(shape, counts) * 0 + flat, ids, firsts, 0).sum(), unigram, rel_tol=0.02)
    for _ in range(10):
        flat = R.train(shape, flat, ids, 0, 0.02, updates=100)
    assert R.document_scores(shape, flat, ids, firsts, 0).sum() > 0.6 * unigram


def test_counts_and_gain_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # few frequent tokens and model words, so that most tokens take the join
    got = L.score_documents(docs, words=300, frequent=2000, unit_tokens=10_000).cache()
    same(got.collect(), base(rows))
    out = [r for r in got.collect() if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)
    again = {r.doc_id: r.score for r in L.score_documents(docs.repartition(5), words=300, frequent=2000, unit_tokens=10_000).collect()}
    assert all(math.isclose(r.score, again[r.doc_id], rel_tol=1e-5) for r in got.collect())
    got.unpersist()


def test_odd_tables(spark):
    odd = odd_documents(spark)
    got = L.score_documents(odd, words=50, frequent=100).collect()
    same(got, base([(r.doc_id, r.text) for r in odd.collect()]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert L.score_documents(empty_documents(spark)).count() == 0
    held = odd.where("doc_id IS NOT NULL").limit(3).withColumn("doc_id", odd.doc_id * 0 + next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0))
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in L.score_documents(held).collect())
