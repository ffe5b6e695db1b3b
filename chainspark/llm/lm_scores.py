"""Language-model scores of whole documents: token counts of the corpus, a recurrent model, and both applied.

Counts of all distinct tokens are a table that grows with the corpus. Its most frequent tokens
are known in every task (a bounded number); the others, of which each is rare, reach their counts
by a join. The recurrent model predicts the most frequent words, the end and ``unknown``; an unknown
word's own probability is its smoothed share of the unknown ones, so that the model's
probabilities of all texts stay a distribution. Training passes over every training document once, in
rounds: in a round, units of documents are trained on side by side from the same parameters,
and these are averaged, weighted by tokens, in the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.llm.recurrent import Shape, classes_of, document_scores, one_thread, start, train
from chainspark.llm.text import LOWER, Ranges, chunks, group_sum, map_arrow
from chainspark.session import cut_lineage

#: Words that the recurrent model predicts, besides the end and ``unknown``.
WORDS = 8190
#: Most tokens whose counts every task knows.
FREQUENT = 1 << 17
#: Learning rate of each round of training.
RATES = (0.01, 0.007, 0.005, 0.003)
#: Training tokens of a unit, about: one task's work between two averages.
UNIT_TOKENS = 1_000_000
#: Ids that are scored together; documents are never cut.
SCORED_TOGETHER = 4_000_000
#: The end of a document among token hashes, and the pseudo-count.
END, PSEUDO = np.uint64(0x5ED0_0FD0_C5ED_00F1), 0.1
_CELL, _SCALE = 4096, float(1 << 20)


def _tokens(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, each document closed by END, and each document's first one (n + 1)."""
    starts, ends, bounds = chunk.words()
    words = Ranges(LOWER[chunk.data]).hash(starts, ends)
    out = np.insert(words, bounds[1:], END)
    return out, bounds + np.arange(len(bounds))


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """token (hash), c (in training documents) and c_all (in all documents) of every distinct token."""
    def run(batches):
        for batch in batches:
            train_row = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            every, learnt = [], []
            for chunk in chunks(batch.column("text")):
                tokens, firsts = _tokens(chunk)
                every.append(tokens)
                learnt.append(np.repeat(train_row[chunk.first_row:chunk.first_row + chunk.n], np.diff(firsts)))
            if not every:
                continue
            token, which = np.unique(np.concatenate(every), return_inverse=True)
            both = np.bincount(which, minlength=len(token))
            own = np.bincount(which, weights=np.concatenate(learnt), minlength=len(token)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(own), pa.array(both)], ["token", "c", "c_all"])
    return (docs.select("text", _held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "token bigint, c bigint, c_all bigint")
            .groupBy("token").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")))


@dataclass
class Lexicon:
    """What every task knows: totals of the training tokens, and the most frequent tokens in hash order.

    ids are the recurrent model's word numbers (``unknown`` where it doesn't predict the token).
    """

    total: int
    distinct: int
    tokens: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    word_counts: np.ndarray
    end: int
    unknown: int
    unknown_total: float
    unknown_distinct: int

    def base(self, c):
        """Log10 of the smoothed share of tokens counted c times."""
        return np.log10((c + PSEUDO) / (self.total + PSEUDO * (self.distinct + 1)))

    def inside_unknown(self, c):
        return np.log10((c + PSEUDO) / (self.unknown_total + PSEUDO * (self.unknown_distinct + 1)))


def lexicon(counts: DataFrame, words: int = WORDS, frequent: int = FREQUENT) -> Lexicon:
    """The bounded part of the token counts: tokens above the count that at most ``frequent`` of them reach.

    That count is read off a histogram of counts by eighths of powers of two, which has a few hundred rows.
    """
    step = F.floor(F.log2(F.col("c_all")) * 8).cast("int")
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("tokens"), F.sum("c").alias("c"),
                                                  F.sum((F.col("c") > 0).cast("bigint")).alias("known")).collect()
    total, distinct = sum(r["c"] for r in bins), sum(r["known"] for r in bins)
    room, least = frequent, None
    for r in sorted(bins, key=lambda r: -r["step"]):
        room -= r["tokens"]
        if room < 0:
            break
        least = r["step"]
    end = np.array([END]).view(np.int64)[0].item()
    chosen = counts.where((step >= F.lit(least)) | (F.col("token") == end)).toPandas() if bins else counts.limit(0).toPandas()
    token = chosen["token"].to_numpy(np.int64).view(np.uint64)
    c = chosen["c"].to_numpy(np.int64)
    order = np.argsort(token)
    token, c = token[order], c[order]
    # the model's words by falling count; the end is always one of them
    rank = np.lexsort((token, -c, token != END))
    rank = rank[c[rank] + (token[rank] == END) > 0][:words + 1]
    rest, rest_distinct = total - int(c[rank].sum()), distinct - int((c[rank] > 0).sum())
    amount = np.append(c[rank], rest)
    if not (token[rank] == END).any():  # an empty corpus
        amount, rank = np.array([0, 0]), np.array([-1])
    fall = np.argsort(-amount, kind="stable")
    number = np.empty(len(amount), np.int64)
    number[fall] = np.arange(len(amount))
    ids = np.full(len(token), number[-1])
    end_id = 0
    for at, n in zip(rank, number[:-1]):
        if at >= 0:
            ids[at] = n
        if at < 0 or token[at] == END:
            end_id = int(n)
    return Lexicon(total, distinct, token, c, ids, amount[fall].astype(float), end_id, int(number[-1]), float(rest), rest_distinct)


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Per document: its word numbers (uint16 as bytes), sums over its frequent tokens, and its rare tokens.

    doc_id, held_out, n_tokens, n_known, base (log10), inside (log10, of unknown words among the frequent
    tokens), ids, rare (distinct tokens and how often).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        held = batch.column("held_out")
        for chunk in chunks(batch.column("text")):
            tokens, firsts = _tokens(chunk)
            at = np.searchsorted(lex.tokens, tokens)
            at[at == len(lex.tokens)] = 0
            known = lex.tokens[at] == tokens if len(lex.tokens) else np.zeros(len(tokens), bool)
            ids = np.where(known, lex.ids[at] if len(lex.ids) else 0, lex.unknown)
            c = np.where(known, lex.counts[at] if len(lex.counts) else 0, 0)
            if not len(lex.tokens):
                ids[firsts[1:] - 1] = lex.end
            base = group_sum(np.where(known, lex.base(c), 0.0), firsts)
            inside = group_sum(np.where(known & (ids == lex.unknown), lex.inside_unknown(c), 0.0), firsts)
            own = np.flatnonzero(~known)
            doc = np.searchsorted(firsts, own, "right") - 1
            order = np.lexsort((tokens[own], doc))
            doc, token = doc[order], tokens[own][order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])]) if len(doc) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(doc)))
            cut = np.searchsorted(doc[begin], np.arange(chunk.n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(
                [pa.array(token[begin].view(np.int64)), pa.array(times.astype(np.int32))], ["token", "times"]))
            short = ids.astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first_row, chunk.n), held.slice(chunk.first_row, chunk.n), pa.array(np.diff(firsts)),
                 pa.array(group_sum((known & (c > 0)).astype(np.int64), firsts)), pa.array(base), pa.array(inside),
                 pa.array([short[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:])], pa.binary()), rare],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids", "rare"])
    return map_arrow(docs.select("doc_id", "text", _held_out(F.col("doc_id")).alias("held_out")), run,
                     f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, inside double, ids binary, "
                     "rare array<struct<token: bigint, times: int>>")


def _averaged(trained: DataFrame, size: int) -> np.ndarray:
    """Mean of the units' parameters by weight, cell by cell in the executors; sums are integers, so order doesn't count."""
    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for cell, weight, values in zip(*(batch.column(c).to_pylist() for c in ("cell", "weight", "values"))):
                part = np.rint(np.frombuffer(values, np.float32).astype(np.float64) * _SCALE).astype(np.int64) * weight
                have = sums.setdefault(cell, [0, np.zeros_like(part)])
                have[0] += weight
                have[1] += part
        for cell, (weight, part) in sums.items():
            mean = (part / (weight * _SCALE)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["cell", "values"])
    out = np.zeros(size, np.float32)
    for r in trained.repartition("cell").mapInArrow(run, "cell int, values binary").collect():
        part = np.frombuffer(r["values"], np.float32)
        out[r["cell"] * _CELL:r["cell"] * _CELL + len(part)] = part
    return out


def _trainer(shape: Shape, flat: np.ndarray, end: int, rate: float) -> Callable[[pa.Table], pa.Table]:
    """Trains on a unit's documents, in the order of their hashes, and returns its parameters in cells."""
    def run(table: pa.Table) -> pa.Table:
        one_thread()
        rows = table.sort_by("place")["ids"].to_pylist()
        ids = np.frombuffer(b"".join(rows), np.uint16).astype(np.int64)
        now = train(shape, flat, ids, end, rate)
        cells = range(0, len(now), _CELL)
        return pa.table({"cell": pa.array([a // _CELL for a in cells], pa.int32()), "weight": [len(ids)] * len(cells),
                         "values": pa.array([now[a:a + _CELL].tobytes() for a in cells], pa.binary())})
    return run


def fit(encoded: DataFrame, lex: Lexicon, rates: tuple[float, ...] = RATES, unit_tokens: int = UNIT_TOKENS,
        hidden: int = 32, embed: int = 24) -> tuple[Shape, np.ndarray]:
    """A recurrent model trained on every document outside the held-out tenth, each once.

    A document's round and unit follow from a hash of its id and words, so reruns agree.
    """
    shape = Shape(classes_of(lex.word_counts), hidden, embed)
    flat = start(shape, lex.word_counts)
    units = max(1, round(lex.total / (len(rates) * unit_tokens)))
    spot = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(len(rates) * units)).cast("int")
    learnt = encoded.where(~F.col("held_out")).select("ids", spot.alias("unit"), F.xxhash64("ids", "doc_id").alias("place"))
    for k, rate in enumerate(rates):
        own = learnt.where(F.col("unit") % len(rates) == k)
        trained = cut_lineage(own.groupBy("unit").applyInArrow(_trainer(shape, flat, lex.end, rate), "cell int, weight bigint, values binary"))
        if not trained.isEmpty():
            flat = _averaged(trained, shape.size)
    return shape, flat


def _scored(encoded: DataFrame, shape: Shape, flat: np.ndarray, end: int) -> DataFrame:
    """encoded without its ids, with the model's natural log likelihood of them."""
    def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        lengths = np.array([len(b) // 2 for b in batch.column("ids").to_pylist()], np.int64)
        sums, at = np.cumsum(lengths), 0
        while at < len(lengths):
            before = sums[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sums, before + SCORED_TOGETHER, "right")))
            yield at, to
            at = to

    def run(batch):
        one_thread()
        names = [n for n in batch.schema.names if n != "ids"]
        for at, to in groups(batch):
            part = batch.slice(at, to - at)
            rows = part.column("ids").to_pylist()
            firsts = np.concatenate([[0], np.cumsum([len(b) // 2 for b in rows])]).astype(np.int64)
            ids = np.frombuffer(b"".join(rows), np.uint16).astype(np.int64)
            logs = document_scores(shape, flat, ids, firsts, end)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(logs)], [*names, "logs"])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "ids"]
    return map_arrow(encoded, run, ", ".join([*fields, "logs double"]))


def score_documents(docs: DataFrame, words: int = WORDS, frequent: int = FREQUENT, rates: tuple[float, ...] = RATES,
                    unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """Base and model log10 probabilities of every whole document (doc_id, text).

    Tokens are the words of the text, A-Z lower-cased, then one end. Documents whose crc32 of the id as
    text is divisible by 10 are held out: nothing is learnt from them. base_score sums the tokens' log10
    of (c + 0.1) / (N + 0.1 (V + 1)); score is the recurrent model's.

    Null and empty texts have the end only; rows with a null id are not held out; repeated rows are learnt
    from as often as they occur and score alike; without a training document all counts are 0; an
    empty table gives an empty table; other columns are not read. Tokens are told apart by 64-bit hashes.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    counts = cut_lineage(token_counts(docs))
    lex = lexicon(counts, words, frequent)
    encoded = cut_lineage(encode(docs, lex).withColumn("uid", F.monotonically_increasing_id()))
    shape, flat = fit(encoded.select("doc_id", "held_out", "ids"), lex, rates, unit_tokens)
    rare = encoded.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.token").alias("token"), F.col("r.times").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))

    def log_share(total: float, distinct: int) -> Column:
        return F.log10((c + PSEUDO) / F.lit(total + PSEUDO * (distinct + 1)))
    sums = rare.join(counts.select("token", "c"), "token", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * log_share(float(lex.total), lex.distinct)).alias("rare_base"),
        F.sum(F.col("times") * log_share(lex.unknown_total, lex.unknown_distinct)).alias("rare_inside"))
    scored = _scored(encoded.drop("rare"), shape, flat, lex.end).join(sums, "uid", "left")

    def plus(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("bigint").alias("train_tokens"), (F.col("base") + plus("rare_base")).alias("base_score"),
        (F.col("logs") / float(np.log(10)) + F.col("inside") + plus("rare_inside")).alias("score"))
