"""Ranked search against scores of all documents in plain Python."""

import math
import re

import numpy as np
import pytest

from chainspark.llm import search as S
from tests.llm.plain import empty_documents, lower, odd_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(lower(text))


def ranked(docs, items, top=50):
    """item -> (doc, score), best first; documents by position, so repeated ids count on their own."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for item, text in items:
        rows = []
        for i, w in held:
            m = 50 + (50 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 20 * m))
                        for t in set(terms(text)) if t in w)
            if score > 0:
                rows.append((i, score))
        out[item] = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0]))[:top]
    return {k: v for k, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
    return out


def corpus(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    p = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 80)), p=p / p.sum())) for _ in range(n)]
    texts[50:120] = [texts[50]] * 70  # more equal scores than ranks
    docs = [(int(i), t) for i, t in enumerate(texts)]
    items = [(k, " ".join(rng.choice(words, 12))) for k in range(15)] + [(90, texts[50]), (91, "none of these"), (92, ""), (93, None)]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("window,block,short", [(2048, 1 << 16, 32), (7, 1 << 16, 4), (16, 40, 1000), (5, 33, 1)])
def test_skipping_loses_nothing(spark, monkeypatch, window, block, short):
    """Small windows and blocks, so that thresholds rise and lists are skipped within the test's documents."""
    docs, items, d, i = corpus(spark)
    weights = {}
    held = [(k, terms(t)) for k, t in docs]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    names = sorted({t for _, w in held for t in w})
    where = {t: k for k, t in enumerate(names)}
    df = np.zeros(len(names), int)
    for _, w in held:
        for t in set(w):
            df[where[t]] += 1
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    monkeypatch.setattr(S, "WINDOW", window)
    want = ranked(docs, items)
    for item, text in items:
        own = [where[t] for t in set(terms(text)) if t in where]
        best, beat = [], 1
        for at in range(0, len(held), block):
            part = held[at:at + block]
            lists = []
            for t in own:
                rows = [(k, w.count(names[t]), len(w)) for k, (_, w) in enumerate(part) if names[t] in w]
                scores = np.array([weights[t] * (10 ** 9 * tf // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_terms))) for _, tf, n in rows], np.int64)
                if len(rows) and scores.max() > 0:
                    lists.append(S.Iterator(np.array([r[0] for r in rows])[scores > 0], scores[scores > 0], int(scores.max())))
            few = [x for x in lists if len(x.docs) * short <= len(part)]
            if len(few) > 1:
                lists = [x for x in lists if len(x.docs) * short > len(part)] + [S.accumulate(few)]
            if lists:
                k, s = S.best_of_block(lists, len(part), 50, beat)
                best += [(part[a][0], int(b)) for a, b in zip(k, s)]
                best.sort(key=lambda r: (-r[1], r[0]))
                best = best[:50]
                beat = best[-1][1] if len(best) == 50 else 1
        assert best == want.get(item, []), item


def test_search_equals_brute_force(spark, monkeypatch):
    docs, items, d, i = corpus(spark)
    assert found(S.search(d, i)) == ranked(docs, items)
    # several passes over the documents, each with some of the items
    assert found(S.search(d, i, pairs_a_pass=60)) == ranked(docs, items)
    assert found(S.search(d, i, top=3)) == ranked(docs, items, 3)


def test_odd_tables(spark):
    odd = odd_documents(spark)
    items = [(1, "one Twelve w5 Ärger"), (2, None), (None, "ΩΩ 中文 x"), (4, "seven"), (4, "eight")]
    table = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, doc_id int")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = ranked(docs, [(1, items[0][1]), (None, items[2][1]), (4, "seven eight")])
    assert found(S.search(odd, table)) == want
    assert S.search(empty_documents(spark), table).count() == 0
    assert S.search(odd, table.where("false")).count() == 0
