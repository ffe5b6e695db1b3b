"""A corpus pipeline in five stages: quality, repeated lines, near copies, benchmark text, mix.

Every stage works on whole texts of all rows that the one before it kept. ``run`` writes each
stage's result to the shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm.classifier import keep_good
from chainspark.llm.decontaminate import contamination
from chainspark.llm.line_dedup import dedup_lines
from chainspark.llm.mixing import emit_mix
from chainspark.llm.similarity import similar_groups
from chainspark.llm.text import unused
from chainspark.session import cut_lineage, drop_scratch, scratch_part


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, does not reject.

    Null and empty texts are judged like others; repeated rows fare alike; without labels of both classes all stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, short ones included; those of which no word is left go.

    n_chars, where documents have it, follows the text. Null and empty texts stay as they are; repeated rows
    repeat each other's lines.
    """
    out = dedup_lines(docs.drop("lines_removed"), least=1)
    cut = F.size("lines_removed") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    left = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.where(~cut | left).select(*[c for c in docs.columns if c != "lines_removed"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Near copies share four fifths of their distinct five-word shingles. Rows are told apart by doc_id and text, so
    that texts under one doc_id are documents of their own; rows that repeat both stay once. Null and
    empty texts are copies of nothing else; rows with a null doc_id all stay.
    """
    row = unused(docs, "_row")[0]
    named = docs.where("doc_id IS NOT NULL").withColumn(row, F.xxhash64("doc_id", "text"))
    groups = similar_groups(named.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    first = (named.select(row, "doc_id").join(groups.distinct(), row).groupBy("component_id")
             .agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row)))
    kept = named.join(first, row, "left_semi").dropDuplicates([row]).drop(row)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten consecutive words of a benchmark item.

    Null and empty texts, in documents or items, hold and are nothing; repeated rows fare alike.
    """
    doc, mark = unused(docs, "_doc", "_print")
    hit = (contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
           .select(F.col("doc_id").alias(doc), F.col("print").alias(mark)).distinct())
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(mark)), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them (copy: 1, 2 ...).

    Texts without words weigh nothing; a null source is a source; repeated rows are mixed together.
    """
    return emit_mix(docs)


def _owned(name: str, stage):
    """A stage whose derived tables are dropped when the next one begins, its result being written."""
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for other, _ in STAGES:
            if other != name:
                drop_scratch(spark, f"pipeline-{other}")
        with scratch_part(f"pipeline-{name}"):
            return stage(spark, docs, sf_dir)
    return begin


STAGES = [(f.__name__, _owned(f.__name__, f)) for f in (quality, lines, near_copies, benchmark, mix)]

#: The classifier's model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
