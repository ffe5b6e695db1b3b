"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index has one posting (term, document, position) per training word that any test item uses,
written in the order of the documents, one segment per task, without an exchange; each document's
length is its last posting. Test windows are looked up from their rarest terms: the posting lists
of the two rarest words of a window, each shifted by the word's place in the item, are intersected,
and the few documents that are left are compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainspark.session import cut_lineage

#: Words of a window that must follow each other.
WINDOW = 10
#: Tables of test terms and items are broadcast up to this many rows, and shuffled beyond it.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_END = "\n"  # cannot be a word; its posting holds the number of words


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; plain ASCII takes the fast way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def raw_words(text: Column) -> Column:
    """Words of a text in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAK), "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_table(items: DataFrame) -> DataFrame:
    """(item, item_id, item_words, span): distinct items that have words, with an own key."""
    words = F.transform(raw_words(F.col("text")), ascii_lower)
    return cut_lineage(items.select("item_id", words.alias("item_words")).distinct().where(F.size("item_words") > 0)
                       .select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words",
                               F.least(F.size("item_words"), F.lit(WINDOW)).alias("span")))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional postings (term, doc_id, print, pos) of the terms (word) in the documents.

    ``print`` is a hash of the text: it tells rows apart that repeat a doc_id. The posting of the
    term '\\n' holds the number of words of its document.
    """
    vocabulary = cut_lineage(terms.select("word").distinct().unionAll(
        docs.sparkSession.createDataFrame([(_END,)], "word string")))
    words = F.concat(raw_words(F.col("text")), F.array(F.lit(_END)))
    tokens = (docs.select("doc_id", F.xxhash64("text").alias("print"), F.posexplode(words).alias("pos", "raw"))
              .withColumn("term", ascii_lower(F.col("raw"))))
    return cut_lineage(tokens.join(_small(vocabulary), F.col("term") == F.col("word"))
                       .select("term", "doc_id", "print", "pos"))


def _rarest(items: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors (item, place, term) of windows that can occur, and each item's pairs of places.

    A window with a word that no document has cannot occur. Of the others the two words with the
    shortest posting lists are its anchors (one word: that one).
    """
    lists = index.groupBy("term").agg(F.count("*").alias("length"))
    words = items.select("item", "span", F.posexplode("item_words").alias("place", "term"))
    known = words.join(lists, "term", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    starts = F.explode(F.sequence(F.greatest(F.col("place") - F.col("span") + 1, F.lit(0)),
                                  F.least(F.col("place"), F.col("size") - F.col("span")))).alias("start")
    in_window = (known.join(items.select("item", F.size("item_words").alias("size")), "item")
                 .select("item", "place", "term", "length", starts))
    by_length = F.sort_array(F.collect_list(F.struct("length", "place", "term")))
    windows = (in_window.groupBy("item", "start").agg(by_length.alias("words"))
               .where(F.col("words")[0]["length"] > 0)
               .select("item", F.slice("words", 1, 2).alias("two")))
    windows = cut_lineage(windows)
    anchors = windows.select("item", F.explode("two").alias("w")).select("item", "w.place", "w.term").distinct()
    pairs = windows.groupBy("item").agg(F.collect_set(F.transform("two", lambda w: w["place"])).alias("pairs"))
    return anchors, pairs


def phrase_matches(docs: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """Exact occurrences of item windows: (doc_id, print, item_id, span, starts).

    ``starts`` are the places in the document where a window of ``span`` words begins.
    """
    anchors, pairs = _rarest(items, index)
    anchors, pairs = cut_lineage(anchors), cut_lineage(pairs)
    small_items = cut_lineage(items.join(pairs, "item"))
    lists = (index.join(_small(anchors), "term")
             .select("item", "doc_id", "print", (F.col("pos") - F.col("place")).alias("shift"), "place"))
    both = F.exists("pairs", lambda p: F.size(F.array_except(p, F.col("places"))) == 0)
    found = (lists.groupBy("item", "doc_id", "print", "shift").agg(F.collect_set("place").alias("places"))
             .join(_small(small_items.select("item", "pairs")), "item").where(both)
             .groupBy(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"))
             .agg(F.collect_list(F.struct("item", "shift")).alias("at")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("print")).dropDuplicates(["doc_id", "print"])
    rows = (texts.join(cut_lineage(found), F.col("doc_id").eqNullSafe(F.col("_doc"))
                       & F.col("print").eqNullSafe(F.col("_print")))
            .select("doc_id", "print", raw_words(F.col("text")).alias("words"), F.explode("at").alias("c"))
            .select("doc_id", "print", F.col("c.item").alias("item"), F.col("c.shift").alias("shift"), "words"))
    rows = rows.join(_small(small_items.select("item", "item_id", "item_words", "span")), "item")
    low = F.greatest(F.col("shift"), F.lit(0))
    part = F.transform(F.slice("words", low + 1, F.size("item_words") + F.least(F.col("shift"), F.lit(0))), ascii_lower)
    rows = rows.select("doc_id", "print", "item_id", "item_words", "span", "shift", low.alias("low"), part.alias("part"))
    last = F.size("part") - F.col("span")
    begins = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(begins, lambda i: F.slice("part", i + 1, F.col("span")) == F.slice(
        "item_words", F.col("low") - F.col("shift") + i + 1, F.col("span")))
    return (rows.withColumn("starts", F.transform(equal, lambda i: F.col("low") + i))
            .where(F.size("starts") > 0).select("doc_id", "print", "item_id", "span", "starts"))


def proximity_matches(items: DataFrame, index: DataFrame, reach: int) -> DataFrame:
    """(doc_id, print, item_id, pos): places of an item's rarest word with all its words near.

    Each of the item's distinct words occurs at most ``reach`` words before or after ``pos``.
    Postings meet by document and stretch of ``reach`` words, so long documents are split.
    """
    lists = index.groupBy("term").agg(F.count("*").alias("length"))
    words = (items.select("item", "item_id", F.explode(F.array_distinct("item_words")).alias("term"))
             .join(lists, "term", "left").withColumn("length", F.coalesce("length", F.lit(0))))
    need = words.groupBy("item").agg(F.count("*").alias("need"), F.min("length").alias("least"),
                                     F.min_by("term", F.struct("length", "term")).alias("rarest"))
    words = cut_lineage(words.join(need, "item").where("least > 0"))
    stretch = F.floor(F.col("pos") / reach)
    near = index.withColumn("stretch", stretch).join(_small(words.select("item", "term")), "term")
    centre = (index.join(_small(words.where("term = rarest").select("item", "item_id", "need", "term")), "term")
              .select("item", "item_id", "need", "doc_id", "print", F.col("pos").alias("at"),
                      F.explode(F.sequence(stretch - 1, stretch + 1)).alias("stretch")))
    c, n = centre.alias("c"), near.alias("n")
    same = ((F.col("c.item") == F.col("n.item")) & (F.col("c.stretch") == F.col("n.stretch"))
            & F.col("c.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("c.print").eqNullSafe(F.col("n.print"))
            & (F.abs(F.col("n.pos") - F.col("c.at")) <= reach))
    return (c.join(n, same).select("c.item_id", "c.item", "c.need", "c.doc_id", "c.print", "c.at", "n.term")
            .groupBy("item", "item_id", "need", "doc_id", "print", "at").agg(F.count_distinct("term").alias("n"))
            .where("n = need").select("doc_id", "print", "item_id", F.col("at").alias("pos")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of each document (doc_id, text) that lie in a window of a test item (item_id, text).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased, of whole texts.
    A window is WINDOW consecutive words of an item, or all words of a shorter one. Returns per row
    doc_id, n_words, n_hit (words inside any occurrence), n_items, item_ids (sorted as strings),
    contaminated.

    Null and empty documents have no words; null or empty items have no windows; an item with a
    null id is found but not listed. Repeated rows are judged alike; equal ids with different texts
    are judged apart. Empty tables give no hits; other columns are not read.
    """
    items = item_table(benchmark)
    index = build_index(docs, items.select(F.explode("item_words").alias("word")))
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("span") - 1)))
    hits = (phrase_matches(docs, items, index)
            .select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"), "item_id", covered.alias("covered"))
            .groupBy("_doc", "_print")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("bigint").alias("n_hit"),
                 F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    lengths = index.where(F.col("term") == _END).select("doc_id", "print", F.col("pos").cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return (lengths.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("print").eqNullSafe(F.col("_print")), "left")
            .select("doc_id", "print", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                    F.size(F.coalesce("item_ids", none)).cast("bigint").alias("n_items"),
                    F.coalesce("item_ids", none).alias("item_ids"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT r, item_id, n, s FROM dw JOIN bw USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
  FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
