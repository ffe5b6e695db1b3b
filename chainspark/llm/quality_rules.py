"""Quality rules: text statistics, and an n-gram log-likelihood ratio of target against raw corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.llm.text import LOWER, SPACE, Chunk, Ranges, _lut, chunks, group_sum, map_arrow, shingles

SYMBOLS = _lut(b"#*$%&|<>")
BITS = 17
PRIOR = 5.0
#: A document stays when its mean log ratio per n-gram is at least this (natural logarithm).
THRESHOLD = -0.12


def _repeated_words(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each document inside 3-word windows that occur twice or more in it."""
    out = np.zeros(len(first) - 1, np.int64)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b - a < 2:
            continue
        own = grams[a:b]
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(own, twice))
            covered = np.zeros(b - a + 2, bool)
            for j in range(3):
                covered[at + j] = True
            out[d] = covered.sum()
    return out


def text_statistics(chunk: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    data, offsets = chunk.data, chunk.offsets
    starts, ends, bounds = chunk.words()
    spaces = SPACE[data]
    points = ((data & 0xC0) != 0x80) & ~spaces
    ranges = Ranges(data)
    words = ranges.hash(starts, ends)
    counts = np.diff(bounds)
    n3 = np.maximum(counts - 2, 0)
    grams, first = shingles(words, bounds, 3)
    short = np.repeat((counts < 3) & (counts > 0), np.diff(first))
    grams, first = grams[~short], np.concatenate([[0], np.cumsum(n3)])
    l_start, l_end, l_bounds = chunk.lines()
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~spaces, out=solid[1:])
    doc = np.repeat(np.arange(chunk.n), np.diff(l_bounds))
    full = solid[l_end] > solid[l_start]
    doc, h = doc[full], ranges.hash(l_start[full], l_end[full])
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return {"n_words": counts.astype(np.int64),
            "word_chars": group_sum(points.astype(np.int64), offsets),
            "n_symbols": group_sum(SYMBOLS[data].astype(np.int64), offsets),
            "n_dup_lines": np.bincount(doc[order][1:][same], minlength=chunk.n).astype(np.int64),
            "n_repeat_words": _repeated_words(grams, first)}


def _ngram_buckets(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all lower-cased words and word pairs, and the document of each."""
    data = LOWER[chunk.data]
    starts, ends, bounds = chunk.words()
    words = Ranges(data).hash(starts, ends)
    doc = np.repeat(np.arange(chunk.n), np.diff(bounds))
    pairs, first = shingles(words, bounds, 2)
    single = np.repeat(np.diff(bounds) == 1, np.diff(first))
    pair_doc = np.repeat(np.arange(chunk.n), np.diff(first))[~single]
    shift = np.uint64(64 - bits)
    return (np.concatenate([words, pairs[~single]]) >> shift).astype(np.int64), np.concatenate([doc, pair_doc])


def ngram_counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Counts per n-gram bucket over all documents (text) and over those marked ``target``.

    Each task adds its documents up before anything is shuffled: it sends 2^bits rows at most.
    """
    def run(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            marked = np.array(batch.column("target").fill_null(False).to_pylist(), bool)
            for chunk in chunks(batch.column("text")):
                bucket, doc = _ngram_buckets(chunk, bits)
                raw += np.bincount(bucket, minlength=1 << bits)
                inside = marked[chunk.first_row + doc]
                target += np.bincount(bucket[inside], minlength=1 << bits)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                         ["bucket", "raw", "target"])
    return (docs.select("text", "target").mapInArrow(run, "bucket bigint, raw bigint, target bigint")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def log_ratios(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """Log of target over raw probability per bucket.

    2^bits rows reach the driver, whatever the number of documents. PRIOR n-grams are added to what
    the target holds of a bucket and to what it would hold at the raw corpus' rate, so a bucket
    that is rare in both says little and one that is frequent in the raw corpus alone says much.
    """
    counts = ngram_counts(docs, bits).toPandas()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    if target.sum() == 0:
        return np.zeros(1 << bits, np.float32)
    share = target.sum() / raw.sum()
    return np.log((target + PRIOR) / (np.maximum(raw - 1, 0) * share + PRIOR)).astype(np.float32)


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """Statistics, base rules and n-gram verdict of every document (doc_id, text).

    The trusted target is every document with a label of quality 1 and no label of quality 0; the
    raw corpus is every document. A document's ratio is the mean log ratio of its lower-cased words
    and word pairs; without words it is 0. base_failed: fewer than 50 words, or more than half of
    the words inside repeated 3-word windows. kept: not base_failed and ratio >= threshold.

    Null texts have no words; null ids carry no label; repeated rows are judged alike; without
    labels every ratio is 0; other columns are not read.
    """
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
            .agg((F.min("quality") == 1).alias("target")))
    # always a merge join: labels are as many as documents may be, and a plan that changes with
    # their number would change what is shuffled
    marked = docs.select("doc_id", "text").hint("merge").join(good, F.col("doc_id") == F.col("_id"), "left")
    ratios = log_ratios(marked, bits)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch):
        for chunk in chunks(batch.column("text")):
            stats = text_statistics(chunk)
            bucket, doc = _ngram_buckets(chunk, bits)
            n = np.bincount(doc, minlength=chunk.n)
            total = np.bincount(doc, weights=ratios[bucket], minlength=chunk.n)
            ratio = np.where(n > 0, total / np.maximum(n, 1), 0.0)
            failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first_row, chunk.n), *[pa.array(stats[c]) for c in names],
                 pa.array(ratio), pa.array(failed), pa.array(~failed & (ratio >= threshold))],
                ["doc_id", *names, "log_ratio", "base_failed", "kept"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names)
                     + ", log_ratio double, base_failed boolean, kept boolean")
