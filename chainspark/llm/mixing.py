"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.llm.ranks import rank_within
from chainspark.llm.text import unused
from chainspark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def _draw(*parts: Column) -> Column:
    """60-bit draw that depends only on its parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Target size per source: weights cycle over the sources by code point (null last).

    Together the targets make ``share`` of all sizes. A target stops at ``cap`` times its source's
    size; what that frees goes to the other sources by weight, round by round, until no target is
    above its cap. A round is one aggregate over the table of sources.
    """
    sources = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("_all", F.lit(0)).withColumn("_null", F.col("source").isNull()))
    ranked = rank_within(sources, ["_all"], ["_null", "source"], "_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    state = cut_lineage(ranked.select("source", "source_size", F.element_at(
        cycle, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight")))
    limit = F.col("source_size") * F.lit(float(cap))
    rate, total = 0.0, None
    while True:
        capped = F.col("weight") * F.lit(rate) > limit
        t = state.agg(F.sum("source_size").alias("all"),
                      F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("full"),
                      F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open")).first()
        if t["all"] is None or not t["open"]:
            break
        now = (share * t["all"] - cap * t["full"]) / t["open"]
        if total == (t["full"], t["open"]):
            break
        rate, total = now, (t["full"], t["open"])
    return state.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(rate))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                seed: str = "mix") -> DataFrame:
    """Copies of each document (doc_id, text, source) that a mix takes.

    Every document of a source expects target / source size copies. Documents of a source are put
    in order of size (ties by a draw on their id), expected copies are summed along that order,
    starting from one random offset per source, and a document is emitted once per integer boundary
    that the sum crosses. Ordering by size keeps the words taken within about one document of the
    target. Reruns agree: the draws depend on ids alone.

    Null texts have size 0; null sources are one source, last in order; rows with null or repeated
    ids are mixed like all others; an empty table gives an empty table; other columns are not read.
    Returns doc_id, source, print (xxhash64 of the text), size, source_size, target, copies, taken (copies x size).
    """
    sizes = cut_lineage(docs.select("doc_id", "source", F.xxhash64("text").alias("print"), F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    targets = source_targets(sizes, weights, share, cap)
    ranked = rank_within(sizes.withColumn("_tie", _draw(F.lit(seed), F.col("doc_id"))), ["source"],
                         ["size", "_tie", "doc_id"], "_rank")
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _draw(F.lit(seed), F.lit("offset"), F.col("source")) / F.lit(float(1 << 60))
    known = targets.select(F.col("source").alias("_source"), "source_size", "target", per_doc.alias("_per"))
    out = ranked.join(known, F.col("source").eqNullSafe(F.col("_source")))
    crossed = F.floor(F.col("_rank") * F.col("_per") + offset) - F.floor((F.col("_rank") - 1) * F.col("_per") + offset)
    copies = F.least(crossed, F.lit(int(-(-cap // 1)))).cast("bigint")
    return (out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "print", "size", "source_size", "target", "copies", "taken"))


def emit_mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of documents as often as mix_sources takes them, with ``copy`` counting from 1.

    Rows that repeat doc_id, source and text are emitted as often as all of them together. All
    columns stay as they are; a column ``copy`` that docs has itself is replaced.
    """
    doc, source, mark, times = unused(docs, "_doc", "_source", "_print", "_times")
    taken = (mix_sources(docs, **settings).groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source),
                                                   F.col("print").alias(mark))
             .agg(F.sum("copies").alias(times)).where(F.col(times) > 0))
    same = (F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source))
            & F.xxhash64("text").eqNullSafe(F.col(mark)))
    once = docs.join(taken, same).dropDuplicates([doc, source, mark])
    kept = [c for c in docs.columns if c != "copy"]
    return once.select(*kept, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))).alias("copy"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM s),
o AS (SELECT *, sum(ss) OVER () AS all_ss, sum(w) OVER () AS all_w,
  coalesce(sum(ss) OVER q, 0) AS cap_ss, coalesce(sum(w) OVER q, 0) AS cap_w, row_number() OVER (ORDER BY ss / w, source) AS k
  FROM w WINDOW q AS (ORDER BY ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (1.5::DOUBLE * all_ss - 2.0::DOUBLE * cap_ss) / (all_w - cap_w) AS rate FROM o),
lim AS (SELECT arg_min(rate, k) AS rate FROM f WHERE NOT (w * rate > 2.0::DOUBLE * ss)),
t AS (SELECT source, ss AS source_size, least(2.0::DOUBLE * ss, w * (SELECT rate FROM lim)) AS target FROM w),
r AS (SELECT doc_id, d.source, size, source_size, target,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS per,
  ('0x' || substr(md5('mix:offset:' || coalesce(d.source, 'null')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(k * per + u) - floor((k - 1) * per + u), 2) * size)::BIGINT AS taken FROM r
"""
