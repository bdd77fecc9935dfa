"""Token counts kept by signed deltas.

A batch is a table of changes: inserts (+), deletes (-) and revised counts (the
difference) for documents. It is added up by source, language and tokenizer
version before it is stored, so that a batch holds one row a key. Totals are the
sum of all committed batches.

A batch is committed when its folder has Spark's `_SUCCESS` marker. Committing an
id again does nothing; a folder without the marker, from a writer that was lost,
is written anew. One writer at a time may commit a given id.

Defined results: a null text has no tokens but is a document; null sources and
languages are keys of their own; keys whose documents and tokens come to zero are
left out; an empty batch commits and adds nothing; repeated rows count each time. Texts of
any length are counted whole. Sums have no order, so there are no ties. Extra columns, of any
names, are ignored.

A compacted store knows the ids of the batches that went into it, so that committing one of
them again does nothing there either.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import cut, exists, plus, shared_dir, slices, table

KEYS = ("source", "lang", "tokenizer")

# What each tokenizer version counts, as classes of characters.
WORD = r"[^\x20\x09-\x0D]+"
RUN_OR_MARK = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
NOISE = r"[#*$%&|<>]"
TOKENIZERS = {"words-1": WORD, "marks-2": RUN_OR_MARK}


def _bytes_of(pattern: str) -> np.ndarray:
    """Which of the 256 bytes one character of the class `pattern` may begin or go on with."""
    wanted = re.compile(pattern.removesuffix("+"))
    return np.array([wanted.fullmatch(chr(b)) is not None if b < 128 else bool(wanted.fullmatch("\u00e9")) for b in range(256)])


def _counter(pattern: str, blank: np.ndarray | None = None):
    """Counts matches in bytes of UTF-8 texts that are joined, each closed by a space;
    `blank` bytes count as spaces. Patterns are alternatives of classes: those with a
    `+` count once a run, the others once a byte."""
    runs, marks = np.zeros(256, bool), np.zeros(256, bool)
    for part in pattern.split("|"):
        (runs if part.endswith("+") else marks)[_bytes_of(part)] = True
    if blank is not None:
        for kinds in (runs, marks):
            kinds[blank] = kinds[0x20]

    def count(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
        inside = runs[raw]
        found = inside.copy()
        found[1:] &= ~inside[:-1]
        if marks.any():
            found |= marks[raw]
        return np.add.reduceat(found, begin, dtype=np.int64)

    return count


def token_counts(docs: DataFrame) -> DataFrame:
    """source, lang and doc_id of docs with n_i, the tokens of the i-th tokenizer in
    the whole text, and r_i, those that are left when noise signs become spaces."""
    noise = _bytes_of(NOISE)
    counters = [_counter(p) for p in TOKENIZERS.values()] + [_counter(p, noise) for p in TOKENIZERS.values()]
    names = [f"{x}_{i}" for x in "nr" for i in range(len(TOKENIZERS))]
    kept = docs.select("doc_id", "source", "lang", "text")

    def run(batches):
        for batch, texts in slices(batches):
            raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
            begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(count(raw, begin)) for count in counters)], ["doc_id", "source", "lang", *names])

    return kept.mapInArrow(run, plus(kept.drop("text"), **dict.fromkeys(names, "long")))


class Rollup:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/batch={batch}"

    def _absorbed(self, batch: str) -> str:
        """The marker of a batch that went into a compacted one."""
        return f"{self.path}/_absorbed/{batch}"

    def committed(self, batch: str) -> bool:
        return exists(self.spark, f"{self._folder(batch)}/_SUCCESS") or exists(self.spark, self._absorbed(batch))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Store (source, lang, tokenizer, n_docs, n_tokens) changes; False if that id is there."""
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def _found(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return [x.getPath() for x in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []]

    def batches(self) -> list[str]:
        """The folders of the committed batches."""
        return sorted(x.getParent().toString() for x in self._found("batch=*/_SUCCESS"))

    def totals(self, stored: list[str] | None = None) -> DataFrame:
        stored = self.batches() if stored is None else stored
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        rows = self.spark.read.schema(schema).parquet(*stored) if stored else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, into: str) -> "Rollup":
        """All batches so far as one of a new store, which refuses their ids from then on. The ids
        are marked before the sums are committed: a compaction that is lost can be run again."""
        new, stored = Rollup(self.spark, into), self.batches()
        if new.batches():
            raise ValueError(f"{into} holds batches already")
        ids = [x.rsplit("/batch=", 1)[1] for x in stored] + [x.getName() for x in self._found("_absorbed/*")]
        for batch in ids:
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(new._absorbed(batch))
            marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(marker, True).close()
        new.commit(f"compacted-{uuid.uuid4().hex}", self.totals(stored))
        return new


def changes(counted: DataFrame, sign: int = 1, column: str = "n_{}", docs: int = 1) -> DataFrame:
    """One change a document and tokenizer, from one column of counts for each tokenizer."""
    kinds = F.array(*[F.struct(F.lit(k).alias("tokenizer"), (sign * F.col(column.format(i))).alias("n_tokens")) for i, k in enumerate(TOKENIZERS)])
    return counted.select("source", "lang", F.inline(kinds)).withColumn("n_docs", F.lit(sign * docs).cast("long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` in three batches: all inserted; those that labels call of
    low quality counted anew without noise signs; those that labels call toxic
    deleted, with their revised counts. The last is committed twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    counted = cut(token_counts(docs).join(marked, "doc_id", "left"), "counts")
    counted = counted.withColumns({f"now_{i}": F.expr(f"if(quality = 0, r_{i}, n_{i})") for i in range(len(TOKENIZERS))})
    revised = counted.where("quality = 0").withColumns({f"diff_{i}": F.expr(f"r_{i} - n_{i}") for i in range(len(TOKENIZERS))})
    store = Rollup(spark, f"{shared_dir(spark)}/tidecast/rollup-{uuid.uuid4().hex}")
    store.commit("1-insert", changes(counted))
    store.commit("2-revise", changes(revised, column="diff_{}", docs=0))
    for _ in range(2):
        store.commit("3-delete", changes(counted.where("toxic = 1"), -1, "now_{}"))
    return store.totals()


OP4_SQL = rf"""
WITH marked AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
told AS (SELECT d.source, d.lang, CASE WHEN m.quality = 0 THEN regexp_replace(d.text, '{NOISE}', ' ', 'g') ELSE d.text END AS text
  FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id WHERE coalesce(m.toxic, 0) <> 1),
counted AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS n FROM told
  UNION ALL
  SELECT source, lang, 'marks-2', coalesce(len(regexp_extract_all(text, '{RUN_OR_MARK}')), 0) FROM told)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted GROUP BY ALL
"""
