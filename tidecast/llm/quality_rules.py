"""Quality rules: word statistics, and bands of zstandard compression ratios.

A text compresses to a share of its size that depends on its length. Ordinary
prose stays within a band; repeated text falls below it and random or encoded
text rises above it. Both the whole text and its chunks, the last one too, are held against
the band of their own length.

Defined results: null and empty texts have no words and are not kept, as any
text of under 20 words. Texts too short for a ratio to mean anything (under 128
bytes) have only the base rules. Repeated rows repeat their result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import SPACES, slices, table

#: Lowest share at a number of bytes, with straight lines over its logarithm between.
LOWEST = ((128, 0.40), (256, 0.35), (1024, 0.28), (4096, 0.22), (16384, 0.16))
#: Highest share at a number of bytes, with straight lines over its logarithm between: above the 99th percentile of
#: prose (licenses, manuals and messages in ten languages of Latin, Greek and Cyrillic letters), below the least of
#: 100 random texts in wrapped base64 or printable words.
HIGHEST = ((128, 1.035), (144, 0.99), (160, 0.96), (192, 0.94), (224, 0.915), (256, 0.91), (384, 0.86), (512, 0.825), (768, 0.785), (1024, 0.75), (1536, 0.70), (2048, 0.66), (3072, 0.63), (4096, 0.61), (8192, 0.56), (16384, 0.515), (32768, 0.48))
CHUNK, CHUNK_LOWEST = 2048, 0.25
#: A text goes if more than this share of its chunks lies outside the band of their length.
BAD_CHUNKS = 0.25
_LOW_AT, _LOW = [float(np.log(n)) for n, _ in LOWEST], [x for _, x in LOWEST]
_AT, _UP = [float(np.log(n)) for n, _ in HIGHEST], [x for _, x in HIGHEST]
LEVEL = 3
WINDOW = 8
_MIX = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.frombuffer(SPACES, np.uint8)


def spread(ids: np.ndarray) -> np.ndarray:
    """Numbers to 64 bits that look random (a bijection)."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 8-word windows that occur at two places or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    own = spread(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    if len(number) == len(words):
        return 0
    seen = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        seen += own[j : j + n] * _MIX[j]
    _, which, count = np.unique(seen, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    begin = np.flatnonzero(count[which] > 1)
    edge[begin] += 1
    edge[begin + WINDOW] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def band(n_bytes: int) -> tuple[float, float]:
    """Lowest and highest compressed share of a text of so many bytes, 128 at least."""
    return float(np.interp(np.log(n_bytes), _LOW_AT, _LOW)), float(np.interp(np.log(n_bytes), _AT, _UP))


def ratios(text: bytes, z: zstandard.ZstdCompressor) -> tuple[float | None, float | None]:
    """Compressed share of the whole text; share of its chunks outside their band, if it has a whole one."""
    if len(text) < LOWEST[0][0]:
        return None, None
    whole = len(z.compress(text)) / len(text)
    if len(text) < CHUNK:
        return whole, None
    bad = []
    begins = list(range(0, len(text), CHUNK))
    if len(text) - begins[-1] < LOWEST[0][0]:
        begins.pop()  # a tail too short for a band is judged with the chunk before it
    for begin, end in zip(begins, [*begins[1:], len(text)], strict=True):
        low, high = band(end - begin)
        low = CHUNK_LOWEST if end - begin >= CHUNK else low
        bad.append(not low <= len(z.compress(text[begin:end])) / (end - begin) <= high)
    return whole, sum(bad) / len(bad)


def in_bands(n_bytes: int, whole: float | None, bad_chunks: float | None) -> bool:
    if whole is None:
        return True
    low, high = band(n_bytes)
    return low <= whole <= high and (bad_chunks is None or bad_chunks <= BAD_CHUNKS)


def judge(text: bytes, z: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    repeats = repeated_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    whole, bad = ratios(text, z)
    return (len(words), int(hist.sum() - hist[0x80:0xC0].sum() - hist[_SPACE].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeats, failed, not failed and in_bands(len(text), whole, bad), whole, bad)


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, bad_chunks double"
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2


def apply_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row each with the statistics and the verdict."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        z = zstandard.ZstdCompressor(level=LEVEL)
        for batch, texts in slices(batches):
            cols = zip(*(judge(t, z) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {RESULT}")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
