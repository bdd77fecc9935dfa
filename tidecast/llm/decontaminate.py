"""Benchmark decontamination by a positional inverted index, in DataFrame
functions only.

Windows are 10 consecutive words of a benchmark item (a shorter item is one
window). The index holds (term, document row, position) for the terms by which
windows are looked up: the two rarest of each window, counted over all documents.
Position minus offset puts both lists on the window's start; where they meet, the
words there are compared with the whole window. Proximity: the same lists, met
within a distance, find terms near each other (`near`).

Defined results: a null text or item has no words and no windows. Equal windows
of several items count for each. Rows of one text share their postings, so
repeated rows repeat their result. Postings are kept by a 64-bit hash of the text;
should two texts have the same, both are compared with every window that either may
hold, and told apart by a second hash and their length. Texts of any length are read
whole. Ties in rarity go to the lesser term. Extra columns,
of any names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import cut, lower_ascii, table

WIDTH = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and all that isn't ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, phrase): the distinct windows of each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(width - 1)))
    each = items.select("item_id", "words", F.explode(starts).alias("at"))
    return each.select("item_id", F.slice("words", F.col("at"), F.lit(width)).alias("phrase")).distinct()


def index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, row, at): where each of the terms stands. texts: (row, words)."""
    return texts.select("row", F.posexplode("words").alias("at", "term")).join(terms, "term")


def lookups(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(window, term, rarity, offset, lists): each window's two rarest terms (one, if it
    has no second), by how often they stand in the documents. Terms are written
    first, so that the join with all words is planned from their real size."""
    every = phrases.select("window", F.posexplode("phrase").alias("offset", "term"))
    own = cut(every.select("term").distinct(), "terms")
    counts = texts.select(F.explode("words").alias("term")).join(own, "term").groupBy("term").count()
    first = every.groupBy("window", "term").agg(F.min("offset").alias("offset"))
    rarity = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "term")
    ranked = first.join(counts, "term", "left").withColumn("rarity", F.row_number().over(rarity)).where("rarity <= 2")
    return ranked.withColumn("lists", F.count("*").over(Window.partitionBy("window"))).select("window", "term", "rarity", "offset", "lists")


def occurrences(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(row, check, at, window, size): every place where a phrase stands word by word.
    texts: (row, check, words), where equal row and check mean equal words, and
    phrases: (window, phrase)."""
    wanted = cut(lookups(phrases, texts), "lookups")
    found = index(texts, cut(wanted.select("term").distinct(), "terms"))
    starts = found.join(wanted, "term").select("row", "window", "lists", (F.col("at") - F.col("offset")).alias("at"), "rarity").where("at >= 0")
    # copies of a text have one row here
    met = cut(starts.groupBy("row", "at", "window", "lists").agg(F.size(F.collect_set("rarity")).alias("n")).where("n = lists").select("row", "at", "window"), "met")
    # windows have more words than their two terms: compared where the lists meet
    held = cut(met.select("row").distinct(), "rows")
    compared = met.join(phrases, "window").join(texts.join(held, "row", "left_semi").dropDuplicates(["row", "check"]), "row")
    there = F.slice("words", F.col("at") + 1, F.size("phrase")) == F.col("phrase")
    return compared.where(there).select("row", "check", "at", "window", F.size("phrase").alias("size"))


def near(texts: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """(row, first, second, at, other): where two terms of a pair stand within
    `distance` words. Lists meet by blocks of `distance` positions."""
    terms = pairs.select(F.explode(F.array("first", "second")).alias("term")).distinct()
    lists = index(texts, terms)
    block = F.floor(F.col("at") / distance)
    left = lists.join(pairs, lists["term"] == pairs["first"]).select("row", "first", "second", "at", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = lists.select(F.col("row").alias("row_"), F.col("term").alias("second_"), F.col("at").alias("other"), block.alias("block_"))
    met = left.join(right, (left["row"] == right["row_"]) & (left["second"] == right["second_"]) & (left["block"] == right["block_"]))
    return met.where((F.abs(F.col("at") - F.col("other")) <= distance) & (F.col("at") != F.col("other"))).select("row", "first", "second", "at", "other")


def row_of(text: Column) -> Column:
    return F.xxhash64(text)


def check_of(text: Column) -> Column:
    """What tells texts of one 64-bit hash apart: a hash of another seed, and the length."""
    return F.struct(F.xxhash64(F.lit(WIDTH), text).alias("hash"), F.length(text).alias("size"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256 and contaminated to docs with a text."""
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")  # take the place of columns of these names
    names = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct(*names).alias("doc_"), row_of(text).alias("row_"), check_of(text).alias("check_"), F.size(words(text)).cast("long").alias("words_"))
    texts = docs.select(row_of(text).alias("row"), check_of(text).alias("check"), words(text).alias("words"))
    every = cut(windows(benchmark, width), "windows")
    phrases = cut(every.select("phrase").distinct().withColumn("window", F.monotonically_increasing_id()), "phrases")
    found = cut(occurrences(texts, phrases), "occurrences")
    places = found.select("row", "check", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    covered = places.groupBy("row", "check").agg(F.count("*").alias("hits_"))
    held = found.select("row", "check", "window").distinct().join(phrases, "window").join(every, "phrase")
    items = held.select("row", "check", F.col("item_id").cast("string").alias("item")).distinct()
    # at most the benchmark's items for a text
    named = items.groupBy("row", "check").agg(F.count("*").alias("found_"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items_"))
    sums = cut(covered.join(named, ["row", "check"]).withColumnsRenamed({"row": "row_", "check": "check_"}), "sums")
    joined = keyed.join(sums, ["row_", "check_"], "left")
    n_hit = F.coalesce("hits_", F.lit(0)).cast("long")
    return joined.select("doc_.*", F.col("words_").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("found_", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items_", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, list_slice(words, place, place + {WIDTH - 1}) AS phrase FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - {WIDTH - 1}))) AS place FROM b WHERE len(words) > 0)),
p AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
o AS (SELECT p.row, p.place, len(w.phrase) AS size, w.item_id FROM p JOIN w ON p.word = w.phrase[1] JOIN d ON p.row = d.row WHERE list_slice(d.words, p.place, p.place + len(w.phrase) - 1) = w.phrase),
h AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(generate_series(place, place + size - 1)) AS pos FROM o) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY row)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row)
"""
