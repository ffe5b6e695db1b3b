"""Ranked lexical search: term-at-a-time sums of short lists inside document-at-a-time skipping over long ones.

One pass over the texts keeps, of every document, its length and the frequencies of the asked terms.
Documents then stay where they lie: a task takes them in blocks, turns a block into postings lists,
and answers all items on it. The lists of an item that are short in the block are summed
into accumulators, which from there on are one iterator with a known greatest score beside the
long lists. Iterators whose bounds together stay below the lowest score that still ranks are not
walked: they are only looked up, by binary search, for documents that the others bring. Scores are
integers and every bound is one, so what is skipped provably doesn't rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainspark.llm.text import LOWER, Ranges, chunks, map_arrow
from chainspark.session import cut_lineage

TOP = 50
#: Bound of what is broadcast: (item, term) pairs of the items that one pass over the documents answers.
PAIRS_A_PASS = 1_000_000
#: Bounds of a block of documents: rows, and postings.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 22
#: Documents that are looked at between two rises of the threshold.
WINDOW = 2048
#: A list is short if it holds at most one in so many documents of the block.
SHORT = 32

_GAP = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _GAP[_low:_high + 1] = True


def _terms(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's lower-cased terms, and each document's first one (n + 1)."""
    starts, ends, bounds = chunk.words(_GAP)
    return Ranges(LOWER[chunk.data]).hash(starts, ends), bounds


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and hash of every distinct term of an item; rows that share an item_id are one item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batch):
        for chunk in chunks(batch.column("text")):
            terms, bounds = _terms(chunk)
            rows = np.repeat(np.arange(chunk.n), np.diff(bounds)) + chunk.first_row
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array(terms.view(np.int64))], ["item_id", "term"])
    return map_arrow(items.select("item_id", "text"), run, f"item_id {kind}, term bigint").distinct()


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), and which of the sorted vocabulary it holds how often.

    Documents without a term are left out. terms and counts are int32 arrays as bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        for chunk in chunks(batch.column("text")):
            terms, bounds = _terms(chunk)
            at = np.searchsorted(vocabulary, terms)
            at[at == len(vocabulary)] = 0
            known = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)
            doc = np.repeat(np.arange(chunk.n), np.diff(bounds))[known]
            pair, tf = np.unique(doc * max(len(vocabulary), 1) + at[known], return_counts=True)
            doc, term = np.divmod(pair, max(len(vocabulary), 1))
            cut = np.searchsorted(doc, np.arange(chunk.n + 1))
            term, tf = term.astype(np.int32), tf.astype(np.int32)
            rows = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows + chunk.first_row)), pa.array(np.diff(bounds)[rows]),
                 pa.array([term[cut[d]:cut[d + 1]].tobytes() for d in rows], pa.binary()),
                 pa.array([tf[cut[d]:cut[d + 1]].tobytes() for d in rows], pa.binary())], ["doc_id", "n", "terms", "counts"])
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n bigint, terms binary, counts binary")


def document_frequencies(counted: DataFrame) -> DataFrame:
    """term (its place in the vocabulary) and the number of documents that hold it."""
    def run(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32)
            term, df = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], ["term", "df"])
    return counted.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Iterator:
    """Documents of a block in ascending order with their scores; no score is above ``bound``."""

    docs: np.ndarray
    scores: np.ndarray
    bound: int


def accumulate(lists: list[Iterator]) -> Iterator:
    """The lists summed term at a time into one."""
    docs = np.concatenate([x.docs for x in lists])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], np.concatenate([x.scores for x in lists])[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    sums = np.add.reduceat(scores, first)
    return Iterator(docs[first], sums, int(sums.max()))


def best_of_block(lists: list[Iterator], size: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``top`` best of a block, at least ``floor``; ties to the lower document.

    Iterators are put in order of their bounds. Those at the front whose bounds add up to less than the
    score to beat cannot rank a document alone; the others bring the candidates of a window, and a
    candidate is dropped as soon as its score and the bounds still open stay below.
    """
    lists = sorted(lists, key=lambda x: x.bound)
    open_bound = np.cumsum([x.bound for x in lists])
    edges = np.arange(0, size + WINDOW, WINDOW)
    cuts = [np.searchsorted(x.docs, edges) for x in lists]
    docs, scores, beat = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
    for w in range(len(edges) - 1):
        essential = int(np.searchsorted(open_bound, beat))  # sums below it are not walked
        walked = [(x.docs[c[w]:c[w + 1]], x.scores[c[w]:c[w + 1]]) for x, c in zip(lists[essential:], cuts[essential:])]
        if not sum(len(d) for d, _ in walked):
            continue
        now = accumulate([Iterator(d, s, 0) for d, s in walked if len(d)])
        found, score = now.docs, now.scores
        for j in range(essential - 1, -1, -1):
            keep = score + open_bound[j] >= beat
            found, score = found[keep], score[keep]
            a, b = cuts[j][w], cuts[j][w + 1]
            if not len(found) or a == b:
                continue
            own = lists[j].docs[a:b]
            at = np.minimum(np.searchsorted(own, found), b - a - 1)
            score = score + np.where(own[at] == found, lists[j].scores[a:b][at], 0)
        keep = score >= beat
        docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, score[keep]])
        if len(docs) > top:
            best = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[best], scores[best]
        if len(docs) == top:
            beat = max(beat, int(scores.min()))
    return docs, scores


def _postings(docs: np.ndarray, terms: np.ndarray, scores: np.ndarray) -> dict[int, Iterator]:
    order = np.argsort(terms, kind="stable")
    docs, terms, scores = docs[order], terms[order], scores[order]
    cut = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, int)
    ends = np.append(cut[1:], len(terms))
    return {int(terms[a]): Iterator(docs[a:b], scores[a:b], int(scores[a:b].max())) for a, b in zip(cut, ends)}


def search_blocks(counted: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int,
                  top: int) -> DataFrame:
    """item (its place in the list), doc_id, score: of each block of documents the best, by item.

    The scores that a task has seen raise the threshold of its later blocks.
    """
    kind = counted.schema["doc_id"].dataType.simpleString()

    def answer(rows: pa.Table, seen: list[np.ndarray]):
        ids = rows["doc_id"].combine_chunks()
        n = rows["n"].to_numpy()
        terms = [np.frombuffer(b, np.int32) for b in rows["terms"].to_pylist()]
        doc = np.repeat(np.arange(len(n)), [len(t) for t in terms])
        term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        tf = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.int32).astype(np.int64)
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        score = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        some = score > 0
        lists = _postings(doc[some], term[some], score[some])
        of, picked, scores = [], [], []
        for i, own in enumerate(items):
            mine = [lists[t] for t in own.tolist() if t in lists]
            if not mine:
                continue
            short = [x for x in mine if len(x.docs) * SHORT <= len(n)]
            if len(short) > 1:
                mine = [x for x in mine if len(x.docs) * SHORT > len(n)] + [accumulate(short)]
            floor = int(seen[i].min()) if len(seen[i]) == top else 1
            d, s = best_of_block(mine, len(n), top, floor)
            seen[i] = np.sort(np.concatenate([seen[i], s]))[-top:]
            if len(seen[i]) == top:
                d, s = d[s >= seen[i][0]], s[s >= seen[i][0]]
            of.append(np.full(len(d), i, np.int32))
            picked.append(d)
            scores.append(s)
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), ids.take(pa.array(np.concatenate(picked))),
                                              pa.array(np.concatenate(scores))], ["item", "doc_id", "score"])

    def run(batches):
        seen = [np.zeros(0, np.int64) for _ in items]
        rows, size, held = [], 0, 0
        for batch in batches:
            lengths = np.array([len(b) // 4 for b in batch.column("terms").to_pylist()] or [0])
            at = 0
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(lengths[at:]), BLOCK_POSTINGS - size, "right")
                take = int(min(max(room, 1), BLOCK_DOCS - held, batch.num_rows - at))
                rows.append(batch.slice(at, take))
                size, held, at = size + int(lengths[at:at + take].sum()), held + take, at + take
                if held >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield from answer(pa.Table.from_batches(rows).sort_by("doc_id"), seen)
                    rows, size, held = [], 0, 0
        if held:
            yield from answer(pa.Table.from_batches(rows).sort_by("doc_id"), seen)
    return counted.mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def _best(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs_a_pass: int = PAIRS_A_PASS) -> DataFrame:
    """The ``top`` best documents (doc_id, text) for each item (item_id, text).

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document scores the sum over the item's distinct
    terms of weight * (10^9 tf div (1000 tf + 20 m)), where m = 50 + 50 n N div L. Scores of 0 don't rank;
    equal scores rank by ascending doc_id (null last).

    Items are answered in passes of about ``pairs_a_pass`` (item, term) pairs, which bounds what is
    broadcast; every pass reads all documents. Null and empty texts have no term and neither count
    nor rank; repeated rows are documents of their own; rows that share an item_id are one item; items
    without terms, and all items over an empty table, have no rows; other columns are not read.
    Returns item_id, rank, doc_id, score.
    """
    terms = cut_lineage(item_terms(items))
    passes = max(1, -(-terms.count() // pairs_a_pass))
    out = None
    for p in range(passes):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) if passes > 1 else terms
        pairs = own.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        pairs.sort(key=lambda r: (r["item_id"] is not None, r["item_id"]) if r["item_id"] is not None else (False, 0))
        vocabulary = np.unique(np.array([t for r in pairs for t in r["terms"]], np.int64).view(np.uint64))
        asked = [np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64)) for r in pairs]
        counted = cut_lineage(term_counts(docs, vocabulary))
        total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(vocabulary), np.int64)
        weight = F.floor(1000 * F.log((2.0 * total["docs"] + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
        for r in document_frequencies(counted).select("term", weight.alias("w")).collect():
            df[r["term"]] = r["w"]
        found = search_blocks(counted, asked, df, total["docs"], total["terms"] or 1, top)
        # the blocks' best meet in two steps, so that one item's many blocks are spread as well
        part = _best(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), ["item", "part"], top)
        best = _best(part.drop("rank", "part"), ["item"], top)
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(pairs)],
                                                  f"number int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = best.join(names, F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score")
        if passes > 1:
            best = cut_lineage(best)
        out = best if out is None else out.unionByName(best)
    return out


SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS uid FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
n AS (SELECT uid, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM n),
p AS (SELECT uid, t, count(*) AS tf FROM (SELECT uid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY uid, t),
v AS (SELECT t, floor(1000 * ln((2 * (SELECT big_n FROM g) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p GROUP BY t),
c AS (SELECT uid, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))) AS s
  FROM p JOIN n USING (uid) JOIN v USING (t), g),
r AS (SELECT item_id, doc_id, uid, sum(s)::BIGINT AS score FROM i JOIN c USING (t) GROUP BY item_id, doc_id, uid HAVING sum(s) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
WHERE rank <= 50
"""
