"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score = logistic(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
the pairwise part by the sum-of-squares identity, in time linear in the words.

Defined results: a null or empty text has no words, and is scored by its (zero)
statistics. With no labels, or labels of one kind only, every score is that
kind's share (0.5 without any). Of several labels of one id the least counts, of
several rows of one id the sample takes the least text. A score of THRESHOLD itself
is predicted 1. Texts of any length are read whole. Repeated rows repeat their result;
extra columns are ignored, and a table without `n_chars` counts as one with nulls.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import SPACES, drawn, remainder, slices, table

BUCKETS, FACTORS = 4096, 8
#: Labelled rows of each kind that the machine is fitted on, about; all rows are scored.
SAMPLE_PER_LABEL = 2000
THRESHOLD = 0.3

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&<>", "|", "!", ".,;:?", "()[]{}=/\\\"'_-+@~^`", SPACES.decode(), "\n"]
_OF_BYTE = np.stack([np.bincount(np.frombuffer(c.encode(), np.uint8), minlength=256) for c in _CLASSES] + [np.arange(256) >= 0x80], 1).astype(np.float32)
STATS = len(_CLASSES) + 1 + 10


def statistics(text: bytes, words: list[bytes], n_chars: int | None) -> np.ndarray:
    """Shares of kinds of bytes; sizes of words and lines; repetition; metadata."""
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float32) @ _OF_BYTE / max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    n, kinds = len(words), set(words)
    chars = len(text) if n_chars is None else n_chars
    more = [np.log1p(n), sum(map(len, words)) / max(1, n), len(kinds) / max(1, n), np.log1p(len(kinds)), np.log1p(len(lines)), np.log1p(len(text) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), max(map(len, kinds), default=0) ** 0.5, np.log1p(max(0, chars)), float(n_chars is None)]
    return np.append(share, more).astype(np.float32)


#: Words kept with their buckets by each Python worker. More take longer, as they leave the CPU's caches.
CACHE = 50_000
_bucket: dict[bytes, int] = {}


def buckets(words: list[bytes]) -> list[int]:
    if len(_bucket) > CACHE:
        _bucket.clear()
    out = []
    for w in words:
        b = _bucket.get(w)
        if b is None:
            b = _bucket[w] = zlib.crc32(w.strip(b".,;:!?#*$%&|<>()").lower()) % BUCKETS
        out.append(b)
    return out


def inputs(texts: list[bytes], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text; and its hashed words as (text, bucket, value): values' squares sum to 1."""
    stats, keys, sizes = [], [], []
    for i, (t, n) in enumerate(zip(texts, n_chars, strict=True)):
        words = t.split()
        stats.append(statistics(t, words, n))
        keys.append(np.array(buckets(words), np.int64) + i * BUCKETS)
        sizes.append(max(1, len(words)))
    found, count = np.unique(np.concatenate(keys), return_counts=True)
    row = found // BUCKETS
    return np.stack(stats), row, found % BUCKETS, np.sqrt(count / np.array(sizes)[row]).astype(np.float32)


class Machine:
    """Features: BUCKETS hashed words, then STATS standardised statistics."""

    def __init__(self, stats: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40) -> None:
        rng = np.random.default_rng(7)
        self.mean, self.std = (stats.mean(0), stats.std(0) + 1e-3) if len(y) else (np.zeros(STATS), np.ones(STATS))
        size = BUCKETS + STATS
        share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
        self.b, self.w, self.v = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
        if not 0 < share < 1 or not len(y):
            return
        self.v = rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
        x = np.hstack([words, self.standard(stats)]).astype(np.float32)
        gw, gv = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32)
        for _ in range(max(epochs, min(400, 400 * 256 // len(y)))):  # small samples have few batches
            order = rng.permutation(len(y))
            for at in range(0, len(y), 256):
                r = order[at : at + 256]
                xb, sums = x[r], x[r] @ self.v
                sq = xb * xb
                z = self.b + xb @ self.w + 0.5 * ((sums**2) - sq @ self.v**2).sum(1)
                err = (weight[r] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r])).astype(np.float32) / len(r)
                dw = xb.T @ err + 1e-4 * self.w
                dv = xb.T @ (err[:, None] * sums) - self.v * (sq.T @ err)[:, None] + 1e-3 * self.v
                gw += dw * dw
                gv += dv * dv
                self.w -= 0.1 * dw / np.sqrt(gw)
                self.v -= 0.05 * dv / np.sqrt(gv)
                self.b -= 0.1 * float(err.sum())

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.std, -4, 4).astype(np.float32) / 4

    def score(self, texts: list[bytes], n_chars: list) -> np.ndarray:
        stats, row, bucket, value = inputs(texts, n_chars)
        s, n = self.standard(stats), len(texts)
        ws, vs, wh, vh = self.w[BUCKETS:], self.v[BUCKETS:], self.w[:BUCKETS], self.v[:BUCKETS]
        z = self.b + s @ ws + np.bincount(row, weights=wh[bucket] * value, minlength=n)
        squares = (s * s) @ (vs**2).sum(1) + np.bincount(row, weights=(vh**2).sum(1)[bucket] * value**2, minlength=n)
        sums = s @ vs
        for f in range(FACTORS):
            z += 0.5 * (sums[:, f] + np.bincount(row, weights=vh[:, f][bucket] * value, minlength=n)) ** 2
        return 1 / (1 + np.exp(-np.clip(z - 0.5 * squares, -30, 30)))


def _sampled(batches):
    for batch, texts in slices(batches):
        stats, row, bucket, value = inputs(texts, batch.column(1).to_pylist())
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        cut = list(zip(at[:-1], at[1:], strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([x.astype("<f4").tobytes() for x in stats]), pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in cut]), pa.array([value[a:b].astype("<f4").tobytes() for a, b in cut])], ["label", "stats", "buckets", "values"])


def with_n_chars(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Machine:
    """docs: (doc_id, text, n_chars); labels: (doc_id, label 0 or 1). The sample of
    labels is broadcast: 2 * per_label rows, about."""
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    rate = {k: min(1.0, per_label / n) for k, n in counts.items()}
    picked = labels.where(drawn(F.when(F.col("label") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0)), "doc_id", F.lit("quality"))).select(F.col("doc_id").alias("labelled"), "label")
    # one row of an id that several rows have, so that the sample stays bounded
    found = docs.select("doc_id", "text", F.col("n_chars").cast("long")).join(F.broadcast(picked), F.col("doc_id") == F.col("labelled"))
    rows = found.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "label")).alias("row")).select("row.*")
    got = rows.select("text", "n_chars", F.col("label").cast("int")).mapInArrow(_sampled, "label int, stats binary, buckets binary, values binary").collect()
    got.sort(key=lambda r: (bytes(r["stats"]), bytes(r["buckets"]), r["label"]))
    y = np.array([r["label"] for r in got], np.float32)
    # either kind weighs the same, whatever its share of the labels
    weight = np.array([0.5 * len(y) / (y == k).sum() for k in y], np.float32)
    words = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        words[i, np.frombuffer(r["buckets"], "<i4")] = np.frombuffer(r["values"], "<f4")
    stats = np.stack([np.frombuffer(r["stats"], "<f4") for r in got]) if got else np.zeros((0, STATS), np.float32)
    return Machine(stats, words, y, weight)


def score_of(spark: SparkSession, machine: Machine, text: Column, n_chars: Column) -> Column:
    """The score of a text. The machine is broadcast: its size is fixed. Texts alone go to Python, and
    scores alone come back."""
    held = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for both in columns:
            batch = pa.RecordBatch.from_arrays(list(both), ["text", "n_chars"])
            yield pa.array(np.concatenate([np.zeros(0), *(held.value.score(texts, part.column(1).to_pylist()) for part, texts in slices([batch]))]), pa.float64())

    return run(text, n_chars.cast("long"))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Add `score` to docs, which have text and n_chars."""
    return docs.withColumn("score", score_of(docs.sparkSession, machine, F.col("text"), F.col("n_chars")))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Machine:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_n_chars(table(spark, sf_dir, "documents"))
    scored = score(docs.select("doc_id", "text", "n_chars"), trained(spark, sf_dir, docs))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
