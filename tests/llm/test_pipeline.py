"""The pipeline's stages against plain versions, on rows that are easy to get wrong."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tidecast.llm import pack, quality_classifier
from tidecast.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, least_ string, row_ long, spans string, text_ string"
R = random.Random(8)
WORDS = ["".join(R.choices("abcdefghk", k=R.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


A, B, C, LONG = prose(80), prose(50), prose(30), prose(12_000)
NEAR = A + " more"
ROWS = [(1, A), (5, NEAR), (5, B), (None, NEAR + " yet"), (None, C), (7, None), (8, ""), (9, LONG), (9, LONG), (10, " \n"), (11, B), (12, "one"), (12, "one"), (3, "token = abcdefgh12345 " + prose(20)), (4, prose(9) + " two words " + prose(30))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", k, "s", "t") for k, (i, t) in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    known = [(100 + i, prose(40) if i % 2 else prose(40).upper() + " !!", "en", "s", None) for i in range(120)]
    every = [(r[0], r[1], None, "s", None) for r in ROWS] + known
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("q1", " ".join(A.split()[10:25])), ("q2", "two words"), ("q3", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_document_of_each_group(spark, docs, sf_dir):
    kept, seen = [], []
    order = sorted(dict.fromkeys(ROWS), key=lambda r: (r[0] is None, r[0] or 0))
    own = {r: sets(r[1]) for r in order}
    group = {r: k for k, r in enumerate(order)}
    for _ in order:
        for r in order:
            for q in order:
                if own[r] and own[q] and 100 * len(own[r] & own[q]) >= 80 * len(own[r] | own[q]):
                    group[r] = min(group[r], group[q])
    for r in order:
        if group[r] not in seen:
            seen.append(group[r])
            kept.append(r)
    got = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert rows(got) == sorted(kept, key=repr)


def test_stages_keep_columns_and_take_effect(spark, docs, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    passage = " ".join(A.split()[10:25])
    hit = [r for r in ROWS if r[1] and (passage in r[1] or " two words " in r[1])]
    clean = stages["benchmark decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and rows(clean) == sorted((r for r in ROWS if r not in hit), key=repr)
    safe = stages["secret scans"](spark, docs, sf_dir)
    assert safe.columns == docs.columns and rows(safe) == sorted((r for r in ROWS if not (r[1] or "").startswith("token = ")), key=repr)
    good = stages["quality classifier"](spark, docs, sf_dir)
    machine = quality_classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars")).limit(0), spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality AS label").limit(0))
    assert machine.score([b"x"], [None])[0] == 0.5  # no labels: nothing is rejected
    assert good.columns == docs.columns and set(rows(good)) <= {(r[0], r[1]) for r in ROWS}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_rejected_documents_go(spark, sf_dir):
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, every, sf_dir).collect()}
    learned = {r["doc_id"] for r in every.where("doc_id >= 100").where(remainder(every["doc_id"], 5) != 0).collect()}
    assert {i for i in learned if i % 2} <= good and not {i for i in learned if i % 2 == 0} & good


def test_run_is_its_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(key, got), key=repr) == sorted(map(key, docs.collect()), key=repr)
    assert sum(r["length"] for r in got) and max(r["offset"] + r["length"] for r in got) <= pack.WIDTH


def test_run_without_labels_and_benchmark(spark, docs, sf_dir, tmp_path):
    """Nothing to learn from and nothing to find: only near duplicates and secrets go."""
    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    once = [r for r in rows(corpus_pipeline.one_of_each(spark, docs, at)) if not (r[1] or "").startswith("token = ")]
    got = corpus_pipeline.run(spark, at).collect()
    starts = [r["doc_id"] for r in got if r["start"] == 0]
    assert sorted(starts, key=repr) == sorted((r[0] for r in once), key=repr)
