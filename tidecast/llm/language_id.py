"""Language identification: the family first, then pairwise machines within it.

Byte 4-grams of the lower-cased text, hashed to a fixed number of buckets, are
the only features. One linear support vector machine per pair of families picks
the family by votes; one per pair of languages of that family picks the
language. Both levels are scored in one gather per byte, since a linear score of
mean bucket frequencies is a mean of weights.

Defined results: a null text, and one without a letter, gives `und` with score
0. With no usable label every text is `und`. Of families or languages with equal
votes the first by name is taken. Texts of any length are read whole. Rows are
independent, so repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import drawn, letters, plus, remainder, slices, table

BUCKETS = 1 << 14
#: Labelled texts that the machines are fitted on: about so many a language, and of
#: those at most so many a family for the machines between families. All else is scored.
SAMPLE_PER_LANGUAGE, SAMPLE_PER_FAMILY = 400, 2000

# Branches of languages by ISO 639-1 code. Codes not listed form a family each.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def gram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the 4-gram at each byte (BUCKETS: none), each text's first
    position, and its number of grams. Three zero bytes end each text."""
    parts = [b" " + t.decode("utf-8", "replace").lower().encode().replace(b"\0", b" ") + b" \0\0\0" for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    b = raw.astype(np.uint32)
    gram = np.zeros(len(b), np.uint32)
    gram[:-3] = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    ids = ((gram * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)
    ids[raw == 0] = BUCKETS
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return ids, np.cumsum(sizes) - sizes, sizes - 3


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = 120, penalty: float = 1e-3) -> np.ndarray:
    """Weights and, last, bias of a linear machine with squared hinge loss, by
    accelerated gradient. Classes weigh the same. x has a last column of ones; y: -1 or 1."""
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v, rate = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32), 1.0
    for _ in range(8):  # largest curvature, by power iteration
        v /= np.linalg.norm(v) + 1e-12
        v = x.T @ (weigh * (x @ v))
    rate = 1.0 / (2 * np.linalg.norm(v) + penalty)
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        nxt = z - rate * (penalty * z - 2 * (x.T @ (weigh * y * slack)))
        w, z = nxt, nxt + k / (k + 3) * (nxt - w)
    return w


class Model:
    """machines: (level, positive, negative); columns of weights: those of all machines.
    rows: each text's buckets and their shares; y: its language's number. Rows are kept
    sparse; only those of the two classes of a machine are spread out, while it is fitted."""

    def __init__(self, langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        self.langs = sorted(set(langs))
        family = {k: FAMILY_OF.get(k.lower().split("-")[0].split("_")[0], k) for k in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[i for i, k in enumerate(self.langs) if family[k] == f] for f in self.families]
        own = np.array([self.families.index(family[k]) for k in self.langs], int)
        self.machines, columns = [], []
        sums, squares = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for u, c in rows:
            sums[u] += c
            squares[u] += c.astype(float) ** 2
        n = max(1, len(rows))
        scale = (1 / (np.sqrt(np.maximum(0, squares / n - (sums / n) ** 2)) + 1e-4) / np.sqrt(BUCKETS)).astype(np.float32)

        def spread_out(picked: np.ndarray) -> np.ndarray:
            x = np.zeros((len(picked), BUCKETS + 1), np.float32)
            x[:, -1] = 1
            for i, r in enumerate(picked):
                u, c = rows[r]
                x[i, u] = c * scale[u]
            return x

        pairs = [(0, a, b, own[y], SAMPLE_PER_FAMILY) for a, b in combinations(range(len(self.families)), 2)]
        pairs += [(1, a, b, y, None) for m in self.members for a, b in combinations(m, 2)]
        for level, a, b, of, most in pairs:
            # rows stand in the order of a hash: a family's first ones are a sample of its languages
            picked = np.sort(np.concatenate([np.flatnonzero(of == k)[:most] for k in (a, b)]))
            w = fit_machine(spread_out(picked), np.where(of[picked] == a, 1, -1).astype(np.float32))
            self.machines.append((level, a, b))
            columns.append(np.append(w[:-1] * scale, w[-1]))
        self.weights = np.array(columns, np.float32).reshape(len(columns), BUCKETS + 1).T.copy() if columns else np.zeros((BUCKETS + 1, 0), np.float32)
        self.bias, self.weights[-1] = self.weights[-1].copy(), 0

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        known = [bool(self.langs) and letters(t) for t in texts]
        ids, begin, size = gram_buckets(texts)
        margins = np.empty((len(texts), len(self.machines)), np.float32)
        for c in range(len(self.machines)):
            margins[:, c] = np.add.reduceat(self.weights[:, c][ids], begin) / size + self.bias[c]
        chance = 1 / (1 + np.exp(-np.clip(4 * margins, -30, 30)))
        votes = [np.zeros((len(texts), max(1, n))) for n in (len(self.families), len(self.langs))]
        for c, (level, a, b) in enumerate(self.machines):
            votes[level][:, a] += chance[:, c]
            votes[level][:, b] += 1 - chance[:, c]
        names, scores = [], []
        for i, ok in enumerate(known):
            if not ok:
                names.append("und")
                scores.append(0.0)
                continue
            f = int(votes[0][i].argmax())
            members = self.members[f]
            k = members[int(votes[1][i][members].argmax())]
            sure = (votes[0][i][f] / (len(self.families) - 1) if len(self.families) > 1 else 1.0) * (votes[1][i][k] / (len(members) - 1) if len(members) > 1 else 1.0)
            names.append(self.langs[k])
            scores.append(float(min(1.0, max(0.0, sure))))
        return names, scores


def _features(batches):
    for batch, texts in slices(batches):
        ids, begin, size = gram_buckets(texts)
        found = [np.unique(ids[b : b + n], return_counts=True) for b, n in zip(begin, size, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("lang")), pa.array([u.astype("<i4").tobytes() for u, _ in found], pa.binary()), pa.array([(c / c.sum()).astype("<f4").tobytes() for _, c in found], pa.binary())], ["lang", "buckets", "shares"])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of rows (doc_id, text, lang), drawn by a hash of id and text. Every language is learned."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().collect()  # as many as there are languages
    if not counts:
        return Model([], [], np.zeros(0, int))
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))])
    picked = rows.where(drawn(rate[F.col("lang")], "doc_id", "text", F.lit("language")))
    got = picked.select("lang", "text").mapInArrow(_features, "lang string, buckets binary, shares binary").collect()
    got.sort(key=lambda r: (zlib.crc32(bytes(r["buckets"])), r["lang"], bytes(r["buckets"]), bytes(r["shares"])))
    langs = sorted({r["lang"] for r in got})
    sparse = []
    for r in got:
        u, c = np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shares"], "<f4")
        sparse.append((u[u < BUCKETS], c[u < BUCKETS]))
    return Model([r["lang"] for r in got], sparse, np.array([langs.index(r["lang"]) for r in got], int))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, text) -> (doc_id, held_out, lang_pred, score), one row each.

    The model is broadcast: BUCKETS weights for each pair of families, and of languages of a family."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in slices(batches):
            names, scores = held.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, plus(docs.select("doc_id", "held_out"), lang_pred="string", score="double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    return predict(docs, fit(docs.where("not held_out")))
