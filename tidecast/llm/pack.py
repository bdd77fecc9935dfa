"""Best-fit packing of tokenized documents by non-negative least squares.

1. One pass tokenizes whole texts and cuts them into pieces of at most `width`.
2. The histogram of piece lengths (at most `width` numbers, whatever the corpus)
   goes to the driver. Patterns of one to four lengths are fitted to it by
   non-negative least squares, their repeat counts are rounded down, and what
   is left is packed best-fit decreasing, a whole count of equal sequences at a
   time.
3. Pieces of one length are interchangeable, so each gets its rank among those
   of its length and takes the slot of that rank. Ranks come from counts by
   (length, salt), so that one common length is ranked in many tasks.

Defined results: a null or empty text is one piece, the end id alone. Added tokens
of the vocabulary, such as '<|endoftext|>', have their own id wherever they stand.
Repeated rows are packed once each, in any order among themselves; which of several
pieces of one length gets which place is settled by id, piece and start. Texts of any
length are cut into as many pieces as it takes. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import cut, plus, slices, table

WIDTH = 2048
END_ID = 0
#: Words kept with their ids by each Python worker. More take longer, as they leave the CPU's caches.
CACHE = 50_000
#: A space between white space, or between white space and the end: there the
#: text's pieces can't be tokenized one by one.
_LONG_GAP = re.compile(r"\s (?=\s|$)|\s\s\Z")


# Fixed value: the pre-token pattern of this byte-level vocabulary.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(1)
def _tokenizer(path: str):
    """An encoder of `tiktoken` over the vocabulary of a byte-level BPE file, and the ids of
    its added tokens. Between added tokens it gives the ids that the `tokenizers` library
    gives for the file, and is some five times as fast on single words."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary, special = (lambda x: (x["model"]["vocab"], {t["content"]: t["id"] for t in x.get("added_tokens", ())}))(json.load(f))
    # printable bytes stand for themselves in the file, the others from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}), special


_words: dict[str, bytes] = {}


def _plain_bytes(text: str, encode) -> bytes:
    """The ids of a text without added tokens. This vocabulary's pre-tokens never cross from a
    word into the space after it, so words with their leading space are encoded once and remembered."""
    if _LONG_GAP.search(text):
        return np.array(encode(text), "<u4").tobytes()
    out = []
    for i, x in enumerate(text.split(" ")):
        word = x if i == 0 else " " + x
        if (got := _words.get(word)) is None:
            got = _words[word] = np.array(encode(word), "<u4").tobytes()
        out.append(got)
    return b"".join(out)


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers. The file's added
    tokens are found first, and what stands between them is encoded piece by piece."""
    if len(_words) > CACHE:
        _words.clear()
    encoder, special = _tokenizer(path)
    added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    out = []
    for t in texts:
        parts = added.split(t) if added and any(x in t for x in special) else [t]
        out.append(b"".join(np.array([special[x]], "<u4").tobytes() if k % 2 else _plain_bytes(x, encoder.encode_ordinary) for k, x in enumerate(parts)))
    return out


def pieces(docs: DataFrame, path: str, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32[, ids]); every id once."""
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        for batch, texts in slices(batches):
            ids = token_bytes([t.decode("utf-8", "replace") for t in texts], path)
            rows: list[tuple] = []
            for i, raw in enumerate(ids):
                raw += end
                n = len(raw) // 4
                stops = list(range(n, 0, -width))[::-1]
                for k, stop in enumerate(stops):
                    start = stops[k - 1] if k else 0
                    part = raw[4 * start : 4 * stop]
                    rows.append((i, k, start, stop - start, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 4 + with_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=False))], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def patterns(histogram: np.ndarray, width: int) -> np.ndarray:
    """Patterns of one to four lengths, as rows of lengths with 0 for none. All
    but the single ones fill a sequence exactly; only lengths that occur are used."""
    there = np.flatnonzero(histogram)
    have = histogram > 0
    rows = [np.stack([there, 0 * there, 0 * there, 0 * there], 1)]
    a = there[(there < width)]
    b = width - a
    ok = (b <= a) & have[b]
    rows.append(np.stack([a[ok], b[ok], 0 * a[ok], 0 * a[ok]], 1))
    for first in there[there < width][::-1]:
        rest = width - first
        b = there[(there <= min(first, rest - 1)) & (2 * there >= rest)]
        if len(b):
            b = b[have[rest - b]]
            rows.append(np.stack([np.full_like(b, first), b, rest - b, 0 * b], 1))
    if width % 2 == 0:
        a = there[there < width // 2]
        b = width // 2 - a
        ok = (b > 0) & (b <= a) & have[np.maximum(b, 0)]
        rows.append(np.stack([a[ok], a[ok], b[ok], b[ok]], 1))
    return np.concatenate(rows)


def fit_counts(histogram: np.ndarray, found: np.ndarray, width: int, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2 plus a small price
    of the room that a pattern leaves, by accelerated projected gradient."""
    target = histogram.astype(float)
    scale = max(1.0, target.max())
    target = target / scale
    used = found > 0
    price = 1e-3 * (width - found.sum(1)) / width
    per = np.bincount(found[used], minlength=width + 1).max()
    rate = 1.0 / (4.0 * per)
    x = z = np.zeros(len(found))
    for k in range(steps):
        miss = np.bincount(found.ravel(), weights=np.repeat(z, 4), minlength=width + 1) - target
        miss[0] = 0
        nxt = np.maximum(0, z - rate * (miss[found].sum(1) + price))
        x, z = nxt, nxt + k / (k + 3) * (nxt - x)
    return x * scale


def plan(histogram: np.ndarray, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how often each is used; together
    they use every piece of the histogram (index: length) exactly once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    done: list[tuple[tuple[int, ...], int]] = []
    if left[width]:
        done.append(((width,), int(left[width])))
        left[width] = 0
    if left.any():
        found = patterns(left, width)
        fitted = fit_counts(left, found, width)
        # single lengths are left to best fit, which may still find them company
        order = [i for i in np.argsort(-fitted, kind="stable") if fitted[i] >= 0.5 and found[i][1]]
        for rounded in (np.floor, np.round):
            for i in order:
                lengths = found[i][found[i] > 0]
                value, need = np.unique(lengths, return_counts=True)
                n = int(min(rounded(fitted[i]), (left[value] // need).min()))
                if n > 0:
                    done.append((tuple(int(v) for v in lengths), n))
                    left[value] -= n * need
                    fitted[i] -= n
    while left.any():  # best fit decreasing: each turn uses up one length at least
        room, picked = width, []
        now = left.copy()
        while room and (fit := np.flatnonzero(now[: room + 1])).size:
            longest = int(fit[-1])
            take = min(int(now[longest]), room // longest) if picked and longest * 2 <= room else 1
            picked += [longest] * take
            now[longest] -= take
            room -= longest * take
        value, need = np.unique(picked, return_counts=True)
        n = int((left[value] // need).min())
        done.append((tuple(picked), n))
        left[value] -= n * need
    return done


def assign(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add sequence_id and offset to pieces (written before: ranks must not change)."""
    spark = found.sparkSession
    by_length = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `width` rows
    histogram = np.zeros(width + 1, np.int64)
    for k, n in by_length.items():
        histogram[k] = n
    total = int(histogram.sum())
    # a slot: for a length, ranks from `low` on fall `need` to a sequence of this pattern
    slots, used, first = [], np.zeros(width + 1, np.int64), 0
    for lengths, n in plan(histogram, width) if total else []:
        offset, k = 0, 0
        while k < len(lengths):
            need = lengths.count(lengths[k])
            low = int(used[lengths[k]])
            slots.append((lengths[k], low, low + n * need, need, first, offset))
            used[lengths[k]] += n * need
            offset += need * lengths[k]
            k += need
        first += n
    salts = max(16, min(65_536, total // 20_000))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("in_salt", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("in_salt"))
    # the slots of each length, in the order of their ranks: bounded by the plan, a few thousand
    slots_of: dict[int, list] = {}
    for s in sorted(slots):
        slots_of.setdefault(s[0], []).append(s[1:])
    lows = {k: np.array([s[0] for s in v]) for k, v in slots_of.items()}
    held = spark.sparkContext.broadcast((slots_of, lows))

    def run(batches):
        slots_of, lows = held.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                rows = np.flatnonzero(length == k)
                own = np.array(slots_of[int(k)], np.int64)[np.searchsorted(lows[int(k)], rank[rows], "right") - 1]
                turn = rank[rows] - own[:, 0]
                sequence[rows] = own[:, 3] + turn // own[:, 2]
                offset[rows] = own[:, 4] + turn % own[:, 2] * k
            keep = [batch.schema.get_field_index(c) for c in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = found.columns
    return ranked.mapInArrow(run, plus(found, sequence_id="long", offset="long"))


def pack(docs: DataFrame, path: str, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    return assign(cut(pieces(docs, path, width, with_ids), "pieces"), width)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
