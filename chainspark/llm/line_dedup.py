"""Line deduplication: an exact set-similarity join of lines, with prefixes in order of rarity.

The words of a line are put in order from the rarest to the most frequent. Two lines that are
similar enough share a word of their prefixes, a word at places that leave enough words after it
for the overlap that is needed. Rarity is read from a count sketch over all words: whatever the
order, it is the same for all lines, so the join is exact; a good order makes it cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.llm.similarity import Bands, _linked
from chainspark.llm.text import Chunk, LOWER, Ranges, chunks, collect_array, group_sum, map_arrow, mix, released, sorted_sets, unused
from chainspark.session import cut_lineage

#: Buckets of the rarity sketch: about one for each word that is not rare; a byte each.
SKETCH_BITS = 21
#: Bits of the filter that picks the lines whose words a check needs.
FILTER_BITS = 26
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _line_sets(chunk: Chunk):
    """Distinct words of every line (sorted by hash): values, first; and each document's lines."""
    words_start, words_end, _ = chunk.words()
    words = Ranges(LOWER[chunk.data]).hash(words_start, words_end)
    l_start, l_end, l_bounds = chunk.lines()
    first = np.searchsorted(words_start, np.append(l_start, len(chunk.data)))
    return (*sorted_sets(words, first), l_bounds)


def _prints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(first)
    fp1 = mix(group_sum(mix(values ^ _A), first) + n.astype(np.uint64))
    fp2 = mix(group_sum(mix(values ^ _B), first) + n.astype(np.uint64))
    return n.astype(np.int64), fp1.view(np.int64), fp2.view(np.int64)


def _parity(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits a line; bit i tells whether an odd number of its words hash to i."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.bitwise_xor.accumulate(np.uint64(1) << (values & np.uint64(63)), out=sums[1:])
    return (sums[first[1:]] ^ sums[first[:-1]]).view(np.int64)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """Lines with ``least`` distinct words: doc_id, print, line_no, n, fp1, fp2; and rarity counts.

    The counts are rows of their own (bucket, lines): the lines that hold a word, per bucket of the
    word's hash. Each task adds its words up and sends 2^SKETCH_BITS of them at most.
    """
    names = ["doc_id", "print", "line_no", "n", "fp1", "fp2", "bucket", "lines"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values, first, l_bounds = _line_sets(chunk)
                total += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                                     minlength=len(total)).astype(np.int32)
                n, fp1, fp2 = _prints(values, first)
                per = np.diff(l_bounds)
                doc = np.repeat(np.arange(chunk.n), per)
                no = np.arange(len(n)) - np.repeat(l_bounds[:-1], per)
                keep = n >= least
                take = pa.array(chunk.first_row + doc[keep])
                own = [batch.column("doc_id").take(take), batch.column("print").take(take), pa.array(no[keep].astype(np.int32)),
                       pa.array(n[keep]), pa.array(fp1[keep]), pa.array(fp2[keep])]
                yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(int(keep.sum()), k) for k in kinds[6:]]], names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(used), k) for k in kinds[:6]], pa.array(used.astype(np.int32)),
                                          pa.array(total[used].astype(np.int64))], names)
    return docs.mapInArrow(released(run), "doc_id bigint, print bigint, line_no int, n bigint, fp1 bigint, fp2 bigint, bucket int, lines bigint")


def _rarity(counts: DataFrame) -> np.ndarray:
    """12 times the binary logarithm of each bucket's count; 2^SKETCH_BITS bytes for any corpus."""
    level = F.least(F.round(12 * F.log2(F.sum("lines"))), F.lit(255)).cast("int")
    levels = counts.where("bucket IS NOT NULL").groupBy("bucket").agg(level.alias("level"))
    return collect_array(levels, F.col("bucket"), F.col("level"), SKETCH_BITS, np.uint8)


def _prefixes(docs: DataFrame, bands: Bands, least: int, rarity: np.ndarray) -> DataFrame:
    """(word, fp1, bits, n, place, doc_id, line_no) for the prefix words of lines that can have a partner.

    A set that a task has seen in an earlier line sends nothing again.
    """
    def run(batches):
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for chunk in chunks(batch.column("text")):
                values, first, l_bounds = _line_sets(chunk)
                n, fp1, _ = _prints(values, first)
                per = np.diff(l_bounds)
                doc = ids[chunk.first_row + np.repeat(np.arange(chunk.n), per)]
                no = np.arange(len(n)) - np.repeat(l_bounds[:-1], per)
                # small sets are only similar to equal ones, which are one class already
                partner = (bands.overlap(n, n + 1) <= n) | (bands.overlap(n, np.maximum(n - 1, 0)) <= n - 1) | (bands.overlap(n, n) <= n - 1)
                fresh = (n >= least) & partner
                for i in np.flatnonzero(fresh):
                    key, at = int(fp1[i]), (int(doc[i]), int(no[i]))
                    if key in seen and seen[key] <= at:
                        fresh[i] = False
                    else:
                        seen[key] = at
                bits = _parity(values, first)
                size = np.where(fresh, n, 0)
                own = values[np.repeat(fresh, n)]
                line = np.repeat(np.arange(len(n)), size)
                order = np.lexsort((own, rarity[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], line))
                bounds = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(len(own)) - np.repeat(bounds[:-1], size)
                # the smallest overlap with any partner decides the prefix
                need = bands.overlap(n, -(-bands.percent * n // 100))
                head = place < np.repeat(n - need + 1, size)
                at = line[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[order][head].view(np.int64)), pa.array(fp1[at]), pa.array(bits[at]), pa.array(n[at].astype(np.int32)),
                     pa.array(place[head].astype(np.int32)), pa.array(doc[at].astype(np.int64)), pa.array(no[at].astype(np.int32))],
                    ["word", "fp1", "bits", "n", "place", "doc_id", "line_no"])
    return docs.select("doc_id", "text").mapInArrow(
        released(run), "word bigint, fp1 bigint, bits bigint, n int, place int, doc_id bigint, line_no int")


def _bit_table(wanted: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, of which those at the upper bits of a wanted fp1 are set."""
    spot = F.shiftrightunsigned("fp1", 64 - FILTER_BITS)
    mask = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(fp1, {64 - FILTER_BITS}), 64) as int))")
    words = wanted.groupBy(F.floor(spot / 64).cast("int").alias("at")).agg(F.bit_or(mask).alias("mask"))
    return collect_array(words, F.col("at"), F.col("mask"), FILTER_BITS - 6, np.int64).view(np.uint64)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp1, fp2, n, items) of the lines whose fp1 is wanted: one row per set.

    What is wanted goes to the tasks as a filter of 2^FILTER_BITS bits, whatever its number; a join
    drops what the filter lets pass besides.
    """
    open_bits = _bit_table(wanted)

    def run(batch):
        for chunk in chunks(batch.column("text")):
            values, first, _ = _line_sets(chunk)
            n, fp1, fp2 = _prints(values, first)
            spot = fp1.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            at = np.flatnonzero((open_bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1))
            at = at[np.unique(fp1[at], return_index=True)[1]]
            items = [values[first[i]:first[i + 1]].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(fp1[at]), pa.array(fp2[at]), pa.array(n[at]),
                                              pa.array(items, pa.binary())], ["fp1", "fp2", "n", "items"])
    sets = map_arrow(docs.select("text"), run, "fp1 bigint, fp2 bigint, n bigint, items binary")
    return sets.join(wanted, "fp1", "left_semi").dropDuplicates(["fp1", "fp2", "n"])


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """Sets (fp1, fp2, n) that are similar to an earlier one, of pairs (early, late: fp1)."""
    pairs = cut_lineage(pairs)
    wanted = cut_lineage(pairs.select(F.explode(F.array("early", "late")).alias("fp1")).distinct())
    if wanted.isEmpty():
        return classes.where("false").select("fp1", "fp2", "n")
    at = classes.select(*[F.col(c).alias(f"_{c}") for c in ("fp1", "fp2", "n")], "at")
    sets = _sets_of(docs, wanted)
    sets = cut_lineage(sets.join(at, (F.col("fp1") == F.col("_fp1")) & (F.col("fp2") == F.col("_fp2")) & (F.col("n") == F.col("_n")))
                       .select("fp1", "fp2", "n", "items", "at"))
    early = sets.select(F.col("fp1").alias("early"), F.col("items").alias("items_a"), F.col("at").alias("at_a"))
    late = sets.select(F.col("fp1").alias("late"), "fp1", "fp2", "n", F.col("items").alias("items_b"), F.col("at").alias("at_b"))

    def run(batch):
        good = [i for i, (a, b) in enumerate(zip(batch.column("items_a"), batch.column("items_b")))
                if _linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), bands)]
        yield batch.select(["fp1", "fp2", "n"]).take(pa.array(good, pa.int64()))
    rows = (pairs.join(early, "early").join(late, "late").where("at_a < at_b")
            .select("fp1", "fp2", "n", "items_a", "items_b"))
    return map_arrow(rows, run, "fp1 bigint, fp2 bigint, n bigint").distinct()


def _pairs(entries: DataFrame, bands: Bands, only: np.ndarray | None = None) -> DataFrame:
    """Pairs (early, late: fp1) of lines that share a prefix word and pass all filters.

    Entries of a word meet in its order of (doc_id, line_no); length, positional and parity filters
    are applied to whole columns. Each line gives its earliest partner only, and ``more`` tells
    that it has others; with ``only``, a bit table of fp1, just these lines give all of theirs. A
    task holds the entries of one batch and of the word that its end cuts, 45 bytes each.
    """
    names = ["word", "fp1", "bits", "n", "place"]

    def match(t, i, j):
        n_i, n_j = t["n"][i].astype(np.int64), t["n"][j].astype(np.int64)
        need = bands.overlap(n_i, n_j)
        ok = (need <= np.minimum(n_i, n_j)) & (np.minimum(n_i - t["place"][i], n_j - t["place"][j]) >= need)
        ok &= t["fp1"][i] != t["fp1"][j]
        ok &= n_i + n_j - np.bitwise_count((t["bits"][i] ^ t["bits"][j]).view(np.uint64)).astype(np.int64) >= 2 * need
        return ok

    def of_words(t):
        size = len(t["word"])
        start = np.maximum.accumulate(np.where(np.append(True, t["word"][1:] != t["word"][:-1]), np.arange(size), 0))
        at = np.arange(size) - start
        rows = np.arange(size)
        if only is not None:
            spot = t["fp1"].view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            rows = np.flatnonzero((only[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1))
        best, count, every = np.full(size, -1), np.zeros(size, np.int32), []
        step = 1
        while len(rows := rows[at[rows] >= step]):
            hit = rows[match(t, rows, rows - step)]
            best[hit] = hit - step  # a longer step is an earlier line
            count[hit] += 1
            if only is not None:
                every.append((hit - step, hit))
            step += 1
        if only is None:
            late = np.flatnonzero(best >= 0)
            early = best[late]
        else:
            early, late = (np.concatenate(x) for x in zip(*every)) if every else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(t["fp1"][early]), pa.array(t["fp1"][late]), pa.array(count[late] > 1)],
                                          ["early", "late", "more"])

    def run(batches):
        rest = None
        for batch in batches:
            t = {c: batch.column(c).to_numpy() for c in names}
            if rest is not None:
                t = {c: np.concatenate([rest[c], t[c]]) for c in names}
            if not len(t["word"]):
                continue
            cut = int(np.searchsorted(t["word"], t["word"][-1]))
            rest = {c: v[cut:] for c, v in t.items()}
            if cut:
                yield of_words({c: v[:cut] for c, v in t.items()})
        if rest is not None:
            yield of_words(rest)
    slots = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (entries.repartition(slots, "word").sortWithinPartitions("word", "doc_id", "line_no", "fp1").select(*names)
            .mapInArrow(released(run), "early bigint, late bigint, more boolean"))


def repeated_lines(docs: DataFrame, percent: int = 85, least: int = 5) -> DataFrame:
    r"""Lines of (doc_id: bigint, text) that repeat an earlier line: (doc_id, print, line_no).

    Lines are \n-separated, counted from 0, in order of (doc_id, line number); ``print`` is
    xxhash64 of the text. A line's set are its distinct words (no ASCII white space, A-Z
    lower-cased). It is removed if an earlier line, removed or not, has a set with 100 *
    intersection >= percent * union. Lines of fewer than ``least`` distinct words never match.

    Equal sets are one class, judged by its first line. Each line is first held against its
    earliest possible partner under each prefix word; lines that this leaves open, and that have
    other possible partners, are then held against all of them. So a group of near copies gives
    as many pairs as it has members, and no match is lost.
    """
    bands = Bands(percent)
    found = cut_lineage(_lines(docs, least))
    lines = found.where("fp1 IS NOT NULL").drop("bucket", "lines")
    classes = cut_lineage(lines.groupBy("fp1", "fp2", "n").agg(
        F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("lines")))
    entries = _prefixes(docs, bands, least, _rarity(found))
    first = cut_lineage(_pairs(entries, bands).groupBy("early", "late").agg(F.max("more").alias("more")))
    gone = cut_lineage(_verified(first.select("early", "late"), docs, classes, bands))
    left = cut_lineage(first.where("more").select(F.col("late").alias("fp1")).distinct()
                       .join(gone.select("fp1").distinct(), "fp1", "left_anti"))
    if not left.isEmpty():
        others = _pairs(entries, bands, _bit_table(left)).select("early", "late").distinct()
        gone = gone.unionAll(_verified(others.join(first.select("early", "late"), ["early", "late"], "left_anti"),
                                       docs, classes, bands)).distinct()
    # a class that repeats an earlier one goes as a whole, others keep their first line
    marks = (classes.join(gone.withColumn("whole", F.lit(True)), ["fp1", "fp2", "n"], "left")
             .where("whole OR lines > 1")
             .select(*[F.col(c).alias(f"_{c}") for c in ("fp1", "fp2", "n")], "whole", "at"))
    same = (F.col("fp1") == F.col("_fp1")) & (F.col("fp2") == F.col("_fp2")) & (F.col("n") == F.col("_n"))
    return (lines.join(marks, same)
            .where(F.coalesce("whole", F.lit(False)) | (F.struct("doc_id", "line_no") != F.col("at")))
            .select("doc_id", "print", "line_no"))


def dedup_lines(docs: DataFrame, percent: int = 85, least: int = 5) -> DataFrame:
    r"""Documents (doc_id, text and any other columns) without the lines that repeat an earlier one.

    See repeated_lines for what repeats. Kept lines stay in order, joined by \n; all other columns
    stay as they are. Adds ``lines_removed``, the numbers of the removed lines.

    Null texts and rows with a null doc_id stay as they are and match nothing. Rows that repeat both
    doc_id and text are one document to the join and are all cut alike. Empty texts are one empty
    line, which matches nothing. Columns of these names that docs has itself are replaced.
    """
    narrow = (docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
              .select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("print")))
    doc, mark, cut = unused(docs, "_doc", "_print", "_cut")
    found = (repeated_lines(narrow, percent, least).distinct()
             .groupBy(F.col("doc_id").alias(doc), F.col("print").alias(mark))
             .agg(F.sort_array(F.collect_list("line_no")).alias(cut)))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(cut), i)), "\n")
    joined = docs.join(found, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left")
    return (joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept))
            .withColumn("lines_removed", F.coalesce(cut, F.array().cast("array<int>")))
            .select(*docs.columns, *([] if "lines_removed" in docs.columns else ["lines_removed"])))


def line_report(docs: DataFrame, percent: int = 85, least: int = 5) -> DataFrame:
    """doc_id, n_removed, kept_md5 (of the kept text), n_kept_lines and lines_removed of every document."""
    out = dedup_lines(docs.select("doc_id", "text"), percent, least)
    removed = F.size("lines_removed").cast("bigint")
    left = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint")
    # a text of which no line is left splits into one empty line
    return out.select("doc_id", removed.alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
                      left.alias("n_kept_lines"), "lines_removed")
