"""What each of five filters removes under every order of applying them.

Filters fail a document alone, whatever was removed before. So a table needs only the
counts J(S) of the documents that fail all filters of S, for the 32 sets S: sums of
products of failure flags, kept for all, good and toxic documents. Möbius inversion
gives the rest without reading a document again:

- survivors of a set P of filters: the sum over S within P of (-1)^|S| J(S);
- removed by f after P: survivors of P less survivors of P and f;
- redundant: J(f) less removed;
- failing f only: the sum over S that hold f of (-1)^(|S| - 1) J(S);
- Shapley value, over all orders: the Harsanyi dividend of S is (-1)^(|S| - 1) J(S), and
  each of its filters gets an equal share, in 120 orders 120 / |S| times.

Defined results: a null text is empty, and fails A, not B (no words), not C, not D. Copies
are told by a 128-bit hash and the length; of equal texts, all but those of the least
doc_id fail E. A null doc_id is neither smaller nor larger than another and has no label.
A document with several label rows is good if one says quality 1, toxic if one says
toxic 1. A null source is the empty one. Repeated rows count each time. Texts of any
length are read whole. An empty table has no parts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import cut, slices, table

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
_SIGNS = re.compile(rb"[#$%&*|]")
KINDS = ("all", "good", "toxic")


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(hist[0x80:0xC0].sum())
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * int(hist[65:91].sum()) > 2 * points) << 2 | (_SIGNS.search(text) is not None) << 3


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, copy): failed has the bits of A to D, copy tells equal texts."""
    kept = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")

    def run(batches):
        for batch, texts in slices(batches):
            failed = pa.array([failures(t) for t in texts], pa.int32())
            copy = pa.array([hashlib.blake2b(t, digest_size=16).digest() + len(t).to_bytes(8, "big") for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), failed, copy], ["doc_id", "part", "failed", "copy"])

    return kept.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, failed int, copy binary")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a, b, c, d, e, good, toxic, n): how many documents have these flags, each 0 or 1.

    Rows are added up before each shuffle, and both joins have the text's hash or the id
    beside their key: neither rows without an id nor those of one text meet in one task."""
    rows = cut(flagged(docs).groupBy("doc_id", "copy", "part", "failed").agg(F.count("*").alias("n")), "flags")
    least = rows.groupBy("copy").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("least", F.lit(True))
    told = rows.join(least, ["copy", "doc_id"], "left").withColumn("e", F.col("doc_id").isNotNull() & F.col("least").isNull())
    said = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))]
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(*said).withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("copy")).otherwise(F.lit(0))
    joined = told.withColumn("spread", spread).join(label, ["doc_id", "spread"], "left")
    flags = [F.getbit("failed", F.lit(k)).cast("int").alias(c) for k, c in enumerate("abcd")]
    return joined.groupBy("part", *flags, F.col("e").cast("int").alias("e"), *(F.coalesce(k, F.lit(0)).alias(k) for k in KINDS[1:])).agg(F.sum("n").alias("n"))


def joint_failures(counts: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each kind the 32 counts J(S), by the bits of S."""

    def product(kind: str, members: int) -> str:
        flags = [f for k, f in enumerate(FILTERS.lower()) if members >> k & 1]
        return f"sum({' * '.join(['n', *([] if kind == 'all' else [kind]), *flags])})"

    return counts.groupBy("part").agg(*(F.expr(f"array({', '.join(product(kind, s) for s in SETS)})").alias(kind) for kind in KINDS))


def _sign(members: int) -> int:
    return -1 if members.bit_count() % 2 else 1


def _sums(kind: str, weights: list[dict[int, int]]) -> Column:
    """An array of sums of weight * J(S), each from its weights by S."""
    sums = (" + ".join(f"{w} * `{kind}`[{s}]" for s, w in each.items()) for each in weights)
    return F.expr(f"array({', '.join(sums)})")


def _inverted(kind: str) -> Column:
    """Survivors of each of the 32 sets of filters, by the bits of the set."""
    return _sums(kind, [{s: _sign(s) for s in SETS if s & p == s} for p in SETS])


def _by_filter(weight) -> Column:
    """For each filter, the sum of weight(S) * J(S) over the sets S that hold it."""
    return _sums("all", [{s: weight(s) for s in SETS if s >> k & 1} for k in range(len(FILTERS))])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = len(FILTERS)
    before = [sum(1 << FILTERS.index(f) for f in o[:k]) for o in orders for k in range(steps)]
    own = [FILTERS.index(f) for o in orders for f in o]
    joint = joint_failures(marked(docs, labels))
    told = joint.select(
        "part",
        *(_inverted(kind).alias(f"alive_{kind}") for kind in KINDS),
        F.array(*(F.col("all")[1 << k] for k in range(steps))).alias("fails"),
        _by_filter(lambda s: -_sign(s)).alias("unique"),
        _by_filter(lambda s: -_sign(s) * len(orders) // s.bit_count()).alias("shares"),
        F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1))).alias("k"),
    )
    placed = told.withColumns({"filter_order": F.lit(orders)[F.floor(F.col("k") / steps).cast("int")], "step": (F.col("k") % steps + 1).cast("int"), "before": F.lit(before)[F.col("k")], "own": F.lit(own)[F.col("k")]})
    now = F.col("before") + F.expr("shiftleft(1, own)")
    lost = {kind: F.col(f"alive_{kind}")[F.col("before")] - F.col(f"alive_{kind}")[now] for kind in KINDS}
    return placed.select(
        "part",
        "filter_order",
        "step",
        F.col("alive_all")[now].alias("kept"),
        lost["all"].alias("removed"),
        (F.col("fails")[F.col("own")] - lost["all"]).alias("redundant"),
        F.col("unique")[F.col("own")].alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.col("shares")[F.col("own")].alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Plays all orders through over counts by failure mask; no inversion.
OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(w.doc_id) OVER (PARTITION BY text) < w.doc_id THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [0, a.b, a.b + b.b, a.b + b.b + c.b, 31 - e.b] AS before, [a.b, b.b, c.b, d.b, e.b] AS own
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, unnest(before) AS before, unnest(own) AS own, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, own,
    CAST(sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
