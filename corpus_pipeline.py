"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last keep the columns of documents.

Defined results: a null or empty text is scored by the classifier as such, links with
nothing, holds no benchmark passage and no secret, and is packed as its end alone.
A score equal to the threshold stays. Of a group of near duplicates the row of least
id stays (rows without an id come last; equal ids: the text of least hash); rows of one
id and one text are one document. An empty table gives no rows. Texts of any length are
read whole. Extra columns, of any names, pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import decontaminate, pack, parity_join, quality_classifier, secret_scan
from tidecast.llm.common import cut, table


def _carried(docs: DataFrame) -> DataFrame:
    """Documents as one column beside what operators read, so that no names clash."""
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(F.struct("*").alias("doc_"), "doc_id", "text", n_chars.cast("long").alias("n_chars"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    machine = quality_classifier.trained(spark, sf_dir, quality_classifier.with_n_chars(docs))
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    score = quality_classifier.score_of(spark, machine, F.col("text"), n_chars)
    return docs.where(score >= quality_classifier.THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of least id. A document is told
    by its id and text, as several texts may have one id, or none."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), F.length(text).alias("size"), F.col("text").isNull().alias("none"))
    keyed = docs.select(F.struct("*").alias("doc_"), key.alias("doc_id"), "text")
    found = parity_join.near_duplicates(keyed.select("doc_id", "text"))
    least = cut(found.select(F.col("component_id").alias("doc_id")).distinct(), "least")
    return keyed.join(least, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_.*")


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    found = decontaminate.contamination(_carried(docs), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select("doc_.*")


def free_of_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no secret stands."""
    return secret_scan.scan(_carried(docs)).where("spans = ''").select("doc_.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in sequences."""
    return pack.pack(docs, pack.default_tokenizer())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", free_of_benchmarks),
    ("secret scans", free_of_secrets),
    ("best-fit packing", packed),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
