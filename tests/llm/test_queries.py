"""The registered queries on whole small tables: ids, held-out rows, thresholds, splits of training."""

import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tidecast.llm import quality_rules, registry

AT = "/root/testdata/sf0.001"


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.fixture(scope="module")
def ids(spark):
    return sorted(r[0] for r in spark.read.parquet(f"{AT}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name, divisor, left_out", [("op1_language_id", 3, 1), ("op7_quality_classifier", 5, 0), ("op10_lm_scoring", 5, 1)])
def test_held_out_rows(spark, ids, name, divisor, left_out):
    got = registry.queries()[name](spark, AT).collect()
    assert sorted(r["doc_id"] for r in got) == ids
    for r in got:
        assert r["held_out"] == (remainder(r["doc_id"], divisor) == left_out)
        if name == "op7_quality_classifier":
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if name == "op1_language_id":
            assert 0 <= r["score"] <= 1
    if name == "op10_lm_scoring":
        texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{AT}/documents.parquet").collect()}
        n_train = sum(len(t.encode().split()) + 1 for i, t in texts.items() if remainder(i, 5) != 1)
        assert {r["train_tokens"] for r in got} == {n_train}
        assert all(r["n_tokens"] == len(texts[r["doc_id"]].encode().split()) + 1 and r["score"] <= 0 for r in got)


@pytest.mark.parametrize("name, columns", [("op1_language_id", "doc_id held_out lang_pred score"), ("op7_quality_classifier", "doc_id held_out score predicted")])
def test_training_reads_no_held_out_label(spark, ids, tmp_path, name, columns):
    """Labels of held-out rows may say anything: no result changes."""
    divisor, left_out = {"op1_language_id": (3, 1), "op7_quality_classifier": (5, 0)}[name]
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)) == left_out
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    docs.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    take = lambda at: sorted(tuple(r[c] for c in columns.split()) for r in registry.queries()[name](spark, at).collect())
    assert take(str(tmp_path)) == take(AT)


def test_short_tails_are_judged():
    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    sizes = []

    class Counting:
        def compress(self, x):
            sizes.append(len(x))
            return z.compress(x)

    text = bytes(range(32, 127)) * 80
    for n in (2048, 2049, 2175, 2176, 4096, 4200, 6000):
        sizes.clear()
        quality_rules.ratios(text[:n], Counting())
        assert sizes[0] == n and sum(sizes[1:]) == n and min(sizes) >= 128  # every byte is in a chunk


def test_bands_have_no_steps():
    for edge in range(129, 40_000, 37):
        (a, b), (c, d) = quality_rules.band(edge - 1), quality_rules.band(edge)
        assert abs(a - c) < 0.01 and abs(b - d) < 0.01
