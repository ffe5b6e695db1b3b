"""URL filtering: fixed host and path rules, and association rules mined by FP-growth from labels."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspark.llm.decontaminate import ascii_lower
from chainspark.session import cut_lineage

BAD = "label:block"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the rest of a url; all empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
            F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1))


def url_tokens(host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens of a url: host labels, words of the path, names in query and fragment."""
    def marked(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    words = F.split(F.regexp_replace(path, "[0-9]+", "0"), "[^0-9A-Za-z]+")
    names = F.split(F.regexp_replace(rest, "=[^&#]*", "="), "[^0-9A-Za-z_]+")
    return F.sort_array(F.array_distinct(F.concat(marked("h:", F.split(host, r"\.")), marked("p:", words),
                                                  marked("q:", names))))


def mine_rules(tokens: DataFrame, labels: DataFrame, support: float, confidence: float, least: int) -> DataFrame:
    """(antecedent, confidence, support) of rules 'these tokens: block' from labelled urls.

    A url is bad when its page has a label of quality 0 or toxic 1. Rules hold in at least the
    share ``support`` of all labelled urls and in ``least`` of them, and the share ``confidence``
    of the labelled urls with these tokens is bad.
    """
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
             .agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")))
    baskets = cut_lineage(
        tokens.join(marks, F.col("page_id") == F.col("_id"))
        .select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
        .where(F.size("items") > 0))
    # the miner takes a share and rounds the count up
    share = min(1.0, max(support, (least - 0.5) / max(baskets.count(), 1)))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    return (model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
            .select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"))


def blocked_sets(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets that hold all tokens of some rule.

    Rules are an inverted index from their tokens; a set meets the rules of its tokens, and a rule
    is met as often as it has tokens.
    """
    posted = rules.select(F.col("antecedent").alias("rule"), F.size("antecedent").alias("need"),
                          F.explode("antecedent").alias("token"))
    sets = tokens.select("tokens").distinct()
    return (sets.select("tokens", F.explode("tokens").alias("token")).join(posted, "token")
            .groupBy("tokens", "rule", "need").count().where("count = need").select("tokens").distinct())


def judge_urls(pages: DataFrame, labels: DataFrame, fixed: list[tuple[str, str, str]], support: float = 0.01,
               confidence: float = 0.5, least: int = 20) -> DataFrame:
    """Verdict on the url of every page (page_id, url).

    ``fixed`` holds (verdict, host, path) rules: one fits its host and all subdomains of it if the
    url's path starts with its path; the longest (host and path together; of equal ones the
    allowing one) decides. Other urls are blocked if an association rule matches, else allowed.
    Returns page_id, host, path, rule (host + path of the fixed rule, or null), verdict.

    A null url or one without '://' has an empty host and path and no tokens; it is allowed.
    Repeated rows are judged alike; labels with null ids or values count as good or not at all;
    without labels no rule is mined; empty tables give no rows; other columns are not read.
    """
    host, path, rest = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), rest.alias("_rest"))
    rows = cut_lineage(parts.select("page_id", "host", "path",
                                    url_tokens(F.col("host"), F.col("path"), F.col("_rest")).alias("tokens")))
    fits = F.array(*[F.when(
        ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
        F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allow"), F.lit(h + p).alias("rule")))
        for v, h, p in fixed]) if fixed else F.lit(None).cast("array<struct<size:int,allow:boolean,rule:string>>")
    best = F.array_max(fits)
    bad = blocked_sets(rows, mine_rules(rows, labels, support, confidence, least)).withColumnRenamed("tokens", "_tokens")
    return (rows.join(bad, F.col("tokens") == F.col("_tokens"), "left").withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.when(F.col("best").isNotNull(), F.when(F.col("best.allow"), "allow").otherwise("block"))
                    .when(F.col("_tokens").isNotNull(), "block").otherwise("allow").alias("verdict")))


#: The rules of the registered query.
FIXED_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
               ("allow", "com", "/fr/"), ("block", "com", "/de/")]

URL_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*(.*)$', 1) AS tail FROM a),
t AS (SELECT page_id, host, path, list_sort(list_distinct(
    [('h:' || x) FOR x IN string_split(host, '.') IF x <> ''] ||
    [('p:' || x) FOR x IN regexp_split_to_array(regexp_replace(path, '[0-9]+', '0', 'g'), '[^0-9A-Za-z]+') IF x <> ''] ||
    [('q:' || x) FOR x IN regexp_split_to_array(regexp_replace(tail, '=[^&#]*', '=', 'g'), '[^0-9A-Za-z_]+') IF x <> ''])) AS toks FROM p),
m AS (SELECT doc_id, max(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT toks, bad FROM t JOIN m ON page_id = doc_id WHERE len(toks) > 0 OR bad),
sub AS (SELECT list_filter(toks, lambda x, i: ((mask >> (i - 1)) & 1) = 1) AS s, bad
  FROM (SELECT toks, bad, unnest(range(1, (1 << len(toks)::INT)::BIGINT)) AS mask FROM k)),
rules AS (SELECT s FROM sub GROUP BY s
  HAVING count(*) FILTER (bad) >= greatest(20, ceil(0.01 * (SELECT count(*) FROM k))) AND count(*) FILTER (bad) >= 0.5 * count(*)),
f AS (SELECT t.*, list_max([x FOR x IN [
    CASE WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN {'n': 4, 'allow': true, 'rule': 'org/'} END,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN {'n': 15, 'allow': false, 'rule': 'example.org/es/'} END,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN {'n': 16, 'allow': false, 'rule': 'example.org/en/1'} END,
    CASE WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN {'n': 7, 'allow': true, 'rule': 'com/fr/'} END,
    CASE WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN {'n': 7, 'allow': false, 'rule': 'com/de/'} END]
    IF x IS NOT NULL]) AS best FROM t)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN CASE WHEN best.allow THEN 'allow' ELSE 'block' END
  WHEN EXISTS (SELECT 1 FROM rules WHERE list_has_all(toks, s)) THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
