"""Ranked lexical search over postings.

The index is a DataFrame of postings (bucket, term, row, doc_id, n, tf): which document
holds a term, how often, and how many terms the document has. Postings are dealt by the
bucket of their term and a slice of their rows, so that a term of a third of all
documents lies in many tasks; files are sorted by bucket and term, so that a search for a
few terms skips most of them.

A search deals the postings out by document before it joins items' terms: then all
matches of an item and a document stand in one partition, and are summed there as they
come. Each partition keeps its best k of each item, and only these meet in the window that
ranks them. So what is shuffled are postings (one a document and term, however many items
ask for the term), never matches nor pairs of items and documents.

Defined results: null and empty texts have no terms and are not documents here; an item
without terms, or whose terms all weigh 0, has no rows. Equal scores go by doc_id, those
without an id last; repeated rows are documents of their own. Items of one id are one item
whose terms add up; items without an id are one too. Texts of any length are read whole.
Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import cut, slices, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
BUCKETS, SLICES = 64, 16
#: Rows of a written table of items' terms up to which it is broadcast (under 100 bytes each).
MOST_BROADCAST = 200_000
#: The posting of this term, which no text holds, says how many terms a document has.
LENGTH = ""

_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or re.fullmatch(TERM, chr(b)) else 32 for b in range(256))


def occurrences(docs: DataFrame) -> DataFrame:
    """docs (text and further columns) -> these columns but text, with (n, term, tf) for each
    distinct term of the text, and one row of the term LENGTH."""
    kept = docs.select(*[c for c in docs.columns if c != "text"], "text")
    schema = T.StructType([*kept.drop("text").schema.fields, *T._parse_datatype_string("n long, term string, tf long").fields])

    def run(batches):
        for batch, texts in slices(batches, most=500_000):
            rows, lengths, terms, often = [], [], [], []
            for i, text in enumerate(texts):
                found = Counter(text.translate(_SPACED).split(b" "))
                found.pop(b"", None)
                if found:
                    n = found.total()
                    found[b""] = n
                    terms += found.keys()
                    often += found.values()
                    rows += [i] * len(found)
                    lengths += [n] * len(found)
            which = pa.array(rows, pa.int32())
            # parts of a valid text between ASCII bytes are valid UTF-8
            yield pa.RecordBatch.from_arrays([*(c.take(which) for c in batch.columns[:-1]), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()).view(pa.string()), pa.array(often, pa.int64())], schema.names)

    return kept.mapInArrow(run, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, repeats), by the same reading of terms; item is a struct, as two without an id are one."""
    found = occurrences(items.select(F.struct("item_id").alias("item"), "text")).where(F.col("term") != LENGTH)
    return found.groupBy("item", "term").agg(F.sum("tf").alias("repeats"))


def _small(written: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows; else Spark joins it by its size."""
    return F.broadcast(written) if written.count() <= MOST_BROADCAST else written


def index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings of docs (doc_id, text), written; of all terms, or of those in terms (term)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = occurrences(numbered)
    if terms is not None:
        length = terms.sparkSession.createDataFrame([(LENGTH,)], "term string")
        found = found.join(_small(cut(terms.select("term").distinct().unionByName(length), "terms")), "term", "left_semi")
    slice_ = F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int")
    dealt = found.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"), "slice": slice_})
    return cut(dealt.repartition("bucket", "slice").sortWithinPartitions("bucket", "term"), "postings")


def search(postings: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text)."""
    n_docs, n_terms = postings.where(F.col("term") == LENGTH).agg(F.count("*"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    held = postings.where(F.col("term") != LENGTH)
    often = held.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.col("df") * 2.0 + 1.0)))
    gains = item_terms(items).join(often, "term").select("bucket", "term", "item", (F.col("repeats") * weight).alias("gain"))
    asked = _small(cut(gains.where("gain > 0"), "asked"))
    m = F.lit(100 - 25) + F.expr(f"(25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    tf = F.col("tf")
    match = F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(12) * m)
    dealt = held.select("bucket", "term", "row", "doc_id", match.alias("match")).repartition("row")
    sums = dealt.join(asked, ["bucket", "term"]).groupBy("item", "row", "doc_id").agg(F.sum(F.col("gain") * F.col("match")).alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = sums.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item.item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search(index(docs, item_terms(items)), items)


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
e AS (SELECT row_number() OVER () AS row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM e),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM e) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT item_id, row, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // l)))) AS BIGINT) AS score FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS rank FROM c WHERE score > 0) WHERE rank <= {TOP}
"""
