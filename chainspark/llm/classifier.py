"""Quality classifier: naive Bayes scaled n-gram indicators under a linear hinge-loss model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.llm.text import LOWER, Chunk, Ranges, chunks, map_arrow, mix, shingles, sorted_sets

BITS = 17
#: Labelled rows that the hinge-loss fit reads, half of each class; counts are over all of them.
FIT_ROWS = 6000
_CLASS = np.full(256, 4, np.uint8)  # bytes of characters beyond ASCII: as letters
_CLASS[:33] = 1
_CLASS[33:127] = np.arange(33, 127)
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4


def _shapes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: letters, capitals and digits as runs, other characters as they are."""
    kind = _CLASS[chunk.data]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1])
    new[starts] = True
    where = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(new, out=where[1:])
    return Ranges(kind[new]).hash(where[starts], where[ends])


def features(chunk: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each document, and the first of each (n + 1).

    Features are the lower-cased words and word pairs, pairs of word shapes, and runs of 2, 4, 8 ...
    3-word windows that the document has had before.
    """
    starts, ends, bounds = chunk.words()
    words = Ranges(LOWER[chunk.data]).hash(starts, ends)
    shapes = mix(_shapes(chunk, starts, ends) + np.uint64(1))
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(chunk.n), counts)
    pairs, first2 = shingles(words, bounds, 2)
    shape_pairs, _ = shingles(shapes, bounds, 2)
    pair_doc = np.repeat(np.arange(chunk.n), np.diff(first2))
    windows, first3 = shingles(words, bounds, 3)
    runs, run_doc = [], []
    for d, (a, b) in enumerate(zip(first3[:-1], first3[1:])):
        own = windows[a:b]
        if b - a < 2:
            continue
        order = np.argsort(own, kind="stable")
        again = np.zeros(b - a, bool)
        again[order[1:]] = own[order][1:] == own[order][:-1]
        if again.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
            top = int((edge[1::2] - edge[::2]).max()).bit_length()
            runs.extend(range(1, top + 1))
            run_doc.extend([d] * top)
    runs = mix(np.array(runs, np.uint64) + np.uint64(1 << 40))
    values = np.concatenate([words, pairs, shape_pairs, runs]) >> np.uint64(64 - bits)
    owner = np.concatenate([doc, pair_doc, pair_doc, np.array(run_doc, np.int64)])
    order = np.argsort(owner, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=chunk.n))])
    return sorted_sets(values[order], first)


@dataclass
class Model:
    """Score of a document: sigmoid(slope * (sum of weight * ratio / norm of ratios + bias) + shift)."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def scores(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        n = len(first) - 1
        v = values.astype(np.int64)
        dot = np.bincount(doc, weights=(self.weight * self.ratio)[v], minlength=n)
        norm = np.sqrt(np.bincount(doc, weights=(self.ratio ** 2)[v], minlength=n))
        margin = dot / np.maximum(norm, 1e-12) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0,
                            tolerance: float = 1e-3, most: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * sum of hinge losses, by its box-constrained dual.

    One dual variable at a time is set to its best value, in a random order a round, until no
    projected gradient is above ``tolerance``.
    """
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    random = np.random.default_rng(7)
    for _ in range(most):
        worst = 0.0
        for i in random.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (float(w[at] @ v) + bias) - 1.0
            open_g = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == cost else g
            worst = max(worst, abs(open_g))
            if open_g:
                now = min(max(alpha[i] - g / square[i], 0.0), cost)
                step = (now - alpha[i]) * y[i]
                alpha[i] = now
                w[at] += step * v
                bias += step
        if worst < tolerance:
            break
    return w, bias


def _sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1 | margin), with smoothed targets, by Newton steps with halving."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a, b):
        z = a * margin + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([(weight * (p - target) * margin).sum(), (weight * (p - target)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * margin * margin).sum() + 1e-9, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step, scale = np.linalg.solve(hess, g), 1.0
        while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > loss(a, b):
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(a), float(b)


def class_counts(marked: DataFrame, bits: int) -> DataFrame:
    """Documents of each class per bucket, from rows (text, y); added up in each task first."""
    def run(batches):
        both = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for chunk in chunks(batch.column("text")):
                values, first = features(chunk, bits)
                of = np.repeat(y[chunk.first_row:chunk.first_row + chunk.n], np.diff(first))
                for c in (0, 1):
                    both[c] += np.bincount(values[of == c].astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(both[0][used]), pa.array(both[1][used])],
                                         ["bucket", "bad", "good"])
    return (marked.select("text", "y").mapInArrow(run, "bucket bigint, bad bigint, good bigint")
            .groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS) -> Model | None:
    """Model of quality from labelled documents outside the held-out fifth; None without both classes.

    Log-count ratios come from all of these documents. The hinge-loss fit and its calibration read
    about ``fit_rows`` of them, half of each class, drawn by a hash of their id; what reaches the
    driver is bounded by that and by 2^bits counts.
    """
    marks = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
             .agg(F.min("quality").cast("int").alias("y")).where(~_held_out(F.col("_id"))))
    marked = docs.select("doc_id", "text").hint("merge").join(marks, F.col("doc_id") == F.col("_id"))
    size = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not size.get(0) or not size.get(1):
        return None
    counts = class_counts(marked, bits).toPandas()
    good, bad = np.zeros(1 << bits), np.zeros(1 << bits)
    good[counts.bucket], bad[counts.bucket] = counts.good, counts.bad
    ratio = np.log((good + 1) / (good + 1).sum() / ((bad + 1) / (bad + 1).sum()))
    # a hash of the id below the share of its class
    share = F.when(F.col("y") == 1, min(1.0, fit_rows / 2 / size[1])).otherwise(min(1.0, fit_rows / 2 / size[0]))
    u = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = F.broadcast(marks.where(u < share))

    def run(batch):
        for chunk in chunks(batch.column("text")):
            values, first = features(chunk, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first_row, chunk.n), batch.column("y").slice(chunk.first_row, chunk.n),
                 pa.array([values[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                ["doc_id", "y", "at"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = map_arrow(docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("_id"))
                       .select("doc_id", "text", "y"), run, f"doc_id {kind}, y int, at binary")
    rows, y = [], []
    for r in sorted(sample.collect(), key=lambda r: (str(r["doc_id"]), bytes(r["at"]))):
        at = np.frombuffer(r["at"], np.int32)
        v = ratio[at]
        rows.append((at, v / max(float(np.sqrt(v @ v)), 1e-12)))
        y.append(1 if r["y"] else -1)
    y = np.array(y)
    if not (y > 0).any() or not (y < 0).any():
        return None
    # every fourth row is kept for the calibration
    train = np.flatnonzero(np.arange(len(y)) % 4 != 0)
    check = np.flatnonzero(np.arange(len(y)) % 4 == 0)
    if len(set(y[train])) < 2 or len(set(y[check])) < 2:
        train = check = np.arange(len(y))
    w, bias = dual_coordinate_descent([rows[i] for i in train], y[train], 1 << bits)
    margin = np.array([float(w[rows[i][0]] @ rows[i][1]) + bias for i in check])
    weight = np.where(y[check] > 0, size[1] / max((y > 0).sum(), 1), size[0] / max((y < 0).sum(), 1))
    slope, shift = _sigmoid_fit(margin, y[check], weight)
    return Model(ratio.astype(np.float32), w.astype(np.float32), bias, slope, shift, bits)


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bits: int = BITS,
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """Quality score of every document (doc_id, text): doc_id, held_out, score, predicted.

    held_out rows (crc32 of the id as text divisible by 5) are never learnt from. Scores depend on
    the text alone and lie in 0..1; predicted is 1 from ``threshold`` up. Of several labels of a
    document the lowest counts.

    Null and empty texts get the score of a text without features; null ids carry no label and are
    not held out; repeated rows score alike; without labels of both classes every score is 1; an
    empty table gives an empty table; other columns are not read.
    """
    model = fit(docs, labels, bits, fit_rows)

    def run(batch):
        for chunk in chunks(batch.column("text")):
            s = np.ones(chunk.n) if model is None else model.scores(*features(chunk, bits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first_row, chunk.n), pa.array(s)],
                                             ["doc_id", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double").select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bits: int = BITS,
              fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of documents, all columns as they are, that classify() predicts to be good.

    The model is fitted on these documents' labels; rows are filtered where they lie, without an
    exchange, so nulls and repeated rows need no key.
    """
    model = fit(docs, labels, bits, fit_rows)

    def run(batch):
        column = batch.column(batch.schema.get_field_index("text"))
        for chunk in chunks(column):
            s = np.ones(chunk.n) if model is None else model.scores(*features(chunk, bits))
            yield batch.slice(chunk.first_row, chunk.n).filter(pa.array(s >= threshold))
    return map_arrow(docs, run, docs.schema)
