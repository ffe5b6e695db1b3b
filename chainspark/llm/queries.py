"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainspark.llm import (
    classifier, decontaminate, html, licenses, line_dedup, lm_scores, merkle, mixing, quality_rules, search, similarity, tokens, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard")
def op1_ngram_jaccard(spark, sf_dir):
    return similarity.similar_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op2_license_scan")
def op2_license_scan(spark, sf_dir):
    found = licenses.license_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("found").cast("bigint").alias("n_found"), "licenses")


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    import public_tokenizers  # on machines without it the other queries still register

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_source_mix", mixing.MIX_SQL)
def op5_source_mix(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    # every line with a word counts; short ones are only similar to lines of equal words
    return line_dedup.line_report(table(spark, sf_dir, "documents"), least=1)


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query("op8_decontamination", decontaminate.CONTAMINATION_SQL)
def op8_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


@query("op9_url_filter", url_filter.URL_SQL)
def op9_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), url_filter.FIXED_RULES)


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_merkle_manifest", merkle.MANIFEST_SQL)
def op12_merkle_manifest(spark, sf_dir):
    # a fifth of the rows is tampered with: what is folded is the digest of their lower-cased text
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    asked = F.when(tampered, merkle.leaf_digest(text=lowered)).otherwise(merkle.leaf_digest())
    return merkle.manifest(table(spark, sf_dir, "documents"), check=asked)


@query("op11_ranked_search", search.SEARCH_SQL)
def op11_ranked_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_lm_scores")
def op13_lm_scores(spark, sf_dir):
    return lm_scores.score_documents(table(spark, sf_dir, "documents"))
