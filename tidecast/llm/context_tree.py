"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions. Each decision (the bits of the byte so far)
has a tree over the bytes before it, DEPTH deep; each node holds a
Krichevsky-Trofimov estimate of its counts. A node's weighted probability is half
its own estimate and half the product of its children's, so all depths are mixed by
how well they code the training data. The score is the log10 probability of the
lower-cased text and its end; `code_length` is the same in bits a byte.

Counts come from all training rows: byte n-grams and tokens are counted in tasks
and added up by a shuffle. The tree holds every counted n-gram. Its subtrees below
TOP bytes of context are computed in tasks, each from the grams of whole contexts
of TOP bytes; the tree above them, whose size the alphabet bounds, on the driver.
The log10 probabilities of the MOST_GRAMS most frequent grams are broadcast; a text's
other grams, seen in training or not, are looked up by a join. Token counts
are looked up among the MOST_TOKENS most frequent of at most LONGEST_TOKEN bytes,
which are broadcast; the rest are joined.

Defined results: null and empty texts are their end alone. With no training rows
every decision is even. Repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import cut, plus, remainder, slices, table

DEPTH = 5
#: Bytes of context by which grams are dealt to tasks.
TOP = 3
#: Frequent grams whose log10 probability is broadcast; results don't depend on it.
MOST_GRAMS = 1 << 19
MOST_TOKENS = 1 << 17
#: Longer tokens, in bytes, are never broadcast but joined.
LONGEST_TOKEN = 64
END = b""
#: Bytes of text that a task works on at a time: a byte takes some 100 bytes of work space.
SLICE = 1_000_000
#: Distinct grams, and tokens, that a task adds up before it hands them on.
HELD_GRAMS, HELD_TOKENS = 400_000, 100_000
#: Grams whose subtrees a task computes at a time, if contexts of TOP bytes have no more.
SUBTREE_GRAMS = 100_000
#: Rows that go to a Python worker at a time; results don't depend on it.
BATCH_ROWS = 500


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH + 1 bytes that end at each byte of the texts and at their ends, as
    numbers (the last byte lowest); and where each text's begin."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    key = raw.copy()
    for k in range(1, DEPTH + 1):
        key[k:] |= raw[:-k] << np.uint64(8 * k)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(sizes) - sizes
    skip = np.repeat(np.arange(1, len(texts) + 1) * DEPTH, sizes)
    return key[np.arange(len(skip)) + skip], begin


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(6):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


class Lookup:
    """A fixed hash table from 64-bit keys to positions, for arrays of keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(1.5 * len(keys) + 4))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        rest, place = np.arange(len(keys)), self._first(keys)
        while len(rest):
            free = self.at[place] < 0
            self.at[place[free]] = rest[free]
            won = self.at[place] == rest
            self.keys[place[won]] = keys[rest[won]]
            rest, place = rest[~won], (place[~won] + 1) & (len(self.at) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        place = self._first(keys)
        out = np.where(self.keys[place] == keys, self.at[place], -1)
        rest = np.flatnonzero((out < 0) & (self.at[place] >= 0))
        place = place[rest]
        while len(rest):
            place = (place + 1) & (len(self.at) - 1)
            hit = self.keys[place] == keys[rest]
            out[rest[hit]] = self.at[place[hit]]
            more = ~hit & (self.at[place] >= 0)
            rest, place = rest[more], place[more]
        return out


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


class Level:
    """The grams of one size: sorted, how often each occurs, and where each one's
    gram without its earliest byte is in the level above."""

    def __init__(self, size: int, keys: np.ndarray, n: np.ndarray, above: Level | None) -> None:
        self.keys, self.n = keys, n
        self.up = None if above is None else np.searchsorted(above.keys, keys & _mask(size - 1))

    def nodes(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the decisions on bit j: where each one's grams begin, each gram's decision, zeros and ones."""
        prefix = self.keys >> np.uint64(8 - j)
        new = np.append(True, prefix[1:] != prefix[:-1])
        begin = np.flatnonzero(new)
        ones = np.add.reduceat(self.n * ((self.keys >> np.uint64(7 - j)) & np.uint64(1)).astype(float), begin)
        return begin, np.cumsum(new) - 1, np.add.reduceat(self.n, begin) - ones, ones


def levels(keys: np.ndarray, n: np.ndarray, sizes: range) -> list[Level]:
    """Levels of grams of `sizes` bytes, from grams that are at least as long."""
    out: list[Level] = []
    for size in sizes:
        own, at = np.unique(keys & _mask(size), return_inverse=True)
        out.append(Level(size, own, np.bincount(at, n, len(own)), out[-1] if out else None))
    return out


def weights(tree: list[Level], j: int, below: np.ndarray | None = None) -> tuple[list[tuple], np.ndarray]:
    """For the decisions on bit j: at each level where grams begin, each gram's decision, its decision's parent,
    chance of a one, weight of its own estimate, and whether it was ever taken; and ln of the first level's
    weighted probabilities. below: sums of these over the children of the last level's nodes, if it has any."""
    out, total, lower = [], np.zeros(0), None
    nodes = [level.nodes(j) for level in tree]
    for d in range(len(tree) - 1, -1, -1):
        begin, which, zeros, ones = nodes[d]
        own = log_estimate(zeros, ones)
        kids = below if lower is None else np.bincount(lower, total, len(begin))
        if kids is None:
            total, weight = own, np.ones(len(begin))
        else:
            total = np.logaddexp(own, kids) - np.log(2)
            weight = np.exp(np.minimum(0, own - np.log(2) - total))
        lower = nodes[d - 1][1][tree[d].up[begin]] if d else None
        out.append((begin, which, lower, (ones + 0.5) / (zeros + ones + 1), weight, zeros + ones > 0))
    return out[::-1], total


def descend(found: list[tuple], state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple]:
    """From the chances mixed so far, the weight that is left and what is predicted above the first level, these
    at each level. A node that was never reached in training predicts what its parent does."""
    out = []
    for _, _, parent, chance, weight, taken in found:
        mixed, rest, predicted = (x[parent] for x in state) if parent is not None else state
        state = mixed + rest * weight * chance, rest * (1 - weight), np.where(taken, mixed + rest * chance, predicted)
        out.append(state)
    return out


def _decisions(level: Level, begin: np.ndarray, j: int) -> np.ndarray:
    """Numbers of the decisions on bit j: the context and the bits so far."""
    key = level.keys[begin]
    return (key >> np.uint64(8)) << np.uint64(8) | np.uint64(1 << j) | (key & np.uint64(255)) >> np.uint64(8 - j)


class Top:
    """The tree down to contexts of TOP - 1 bytes. keys, n: grams of TOP bytes; ids, below: sums of ln weighted
    probabilities of the deeper nodes by the decision of the last level that they are below."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, ids: np.ndarray, below: np.ndarray) -> None:
        order = np.argsort(ids)
        ids, below = ids[order], below[order]
        parts: list[list[tuple]] = [[] for _ in range(TOP)]
        if len(keys):
            tree = levels(keys, n, range(1, TOP + 1))
            for j in range(8):
                last = tree[-1]
                found, _ = weights(tree, j, below[np.searchsorted(ids, _decisions(last, last.nodes(j)[0], j))])
                k = len(found[0][0])
                for d, state in enumerate(descend(found, (np.zeros(k), np.ones(k), np.full(k, 0.5)))):
                    parts[d].append((_decisions(tree[d], found[d][0], j), *state))
        self.levels = []
        for part in parts:
            id_, *state = (np.concatenate(x) for x in zip(*part, strict=True)) if part else (np.zeros(0, np.uint64), *[np.zeros(0)] * 3)
            order = np.argsort(id_)
            self.levels.append((id_[order], *(x[order] for x in state)))

    def state(self, level: Level, begin: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the decisions of a level of TOP bytes, as descend() has it; from the deepest known decision."""
        wanted = _decisions(level, begin, j)
        out = np.zeros(len(wanted)), np.ones(len(wanted)), np.full(len(wanted), 0.5)
        for d, (ids, *state) in enumerate(self.levels):
            if len(ids):
                id_ = (wanted >> np.uint64(8) & _mask(d)) << np.uint64(8) | wanted & np.uint64(255)
                at = np.minimum(np.searchsorted(ids, id_), len(ids) - 1)
                hit = ids[at] == id_
                for x, own in zip(out, state, strict=True):
                    x[hit] = own[at[hit]]
        return out


def below_top(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decisions on contexts of TOP - 1 bytes, and the sums over their children of ln weighted probabilities.
    keys, n: all grams of some contexts of TOP bytes."""
    tree, ids, sums = levels(keys, n, range(TOP, DEPTH + 2)), [], []
    for j in range(8):
        found, total = weights(tree[1:], j)
        begin, which, _, _ = tree[0].nodes(j)
        ids.append(_decisions(tree[0], begin, j))
        sums.append(np.bincount(which[tree[1].up[found[0][0]]], total, len(begin)))
    return np.concatenate(ids), np.concatenate(sums)


def log10_of(keys: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of the last byte of each distinct gram; those with n = 0 were not seen in training.
    keys, n: all grams of some contexts of TOP bytes."""
    tree = levels(keys, n, range(TOP, DEPTH + 2))
    out = np.zeros(len(keys))
    for j in range(8):
        found, _ = weights(tree[1:], j)
        begin, which, _, _ = tree[0].nodes(j)
        first = found[0]
        state = descend([(*first[:2], which[tree[1].up[first[0]]], *first[3:]), *found[1:]], top.state(tree[0], begin, j))[-1]
        one = (tree[-1].keys >> np.uint64(7 - j)) & np.uint64(1) == 1
        chance = state[2][found[-1][1]]
        out += np.log10(np.where(one, chance, 1 - chance))
    return out[np.searchsorted(tree[-1].keys, keys)]


class Frequent:
    """log10 probabilities of the most frequent grams."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.lookup, self.values = Lookup(keys), np.append(values, 0.0)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Each text's sum over the grams held here; its other grams, and how often each occurs in it."""
        keys, begin = grams(texts)
        at = self.lookup.find(keys)
        miss = np.flatnonzero(at < 0)
        text, other = np.searchsorted(begin, miss, "right") - 1, keys[miss]
        order = np.lexsort((other, text))
        text, other = text[order], other[order]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (other[1:] != other[:-1]))) if len(text) else np.zeros(0, int)
        n = np.diff(np.append(first, len(text)))
        stops = np.searchsorted(text[first], np.arange(1, len(texts)))
        return np.add.reduceat(self.values[at], begin), np.split(other[first].astype(np.int64), stops), np.split(n, stops)


def _cut_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """cut(), with at most BATCH_ROWS rows in an Arrow batch."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        return cut(df, name)
    finally:
        spark.conf.set(key, before)


def counted(texts: DataFrame) -> DataFrame:
    """(token, gram, n) over all texts: tokens have no gram and grams no token. Written."""

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held] or [np.zeros(0, np.uint64)]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held] or [np.zeros(0, np.int64)]), len(keys)).astype(np.int64)

    def batch(tokens: Counter, held: list) -> pa.RecordBatch:
        keys, n = merged(held)
        words = list(tokens)
        return pa.RecordBatch.from_arrays([pa.array(words + [None] * len(keys), pa.binary()), pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(keys.astype(np.int64))]), pa.array(np.append(np.fromiter(tokens.values(), np.int64, len(words)), n))], ["token", "gram", "n"])

    def run(batches):
        tokens, held = Counter(), []
        for _, texts in slices(batches, most=SLICE):
            low = [t.lower() for t in texts]
            for t in low:
                tokens.update(t.split())
            tokens[END] += len(low)
            held.append(np.unique(grams(low)[0], return_counts=True))
            if sum(len(k) for k, _ in held) > 2 * HELD_GRAMS:
                held = [merged(held)]
            if len(tokens) > HELD_TOKENS or (len(held) == 1 and len(held[0][0]) > HELD_GRAMS):
                yield batch(tokens, held)
                tokens, held = Counter(), []
        yield batch(tokens, held)

    return _cut_in_small_batches(texts.select("text").mapInArrow(run, "token binary, gram long, n long").groupBy("token", "gram").agg(F.sum("n").alias("n")), "counts")


def _by_contexts(grams: DataFrame, run: Callable[[np.ndarray, pa.RecordBatch], pa.RecordBatch], kinds: str) -> DataFrame:
    """run() over rows (gram, ...) that hold whole contexts of TOP bytes."""

    def parts(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def whole(last: bool):
            nonlocal held, size
            if not size:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            context = rows["context"].to_numpy()
            stop = len(context) if last else int(np.searchsorted(context, context[-1]))
            if stop:
                yield run(rows["gram"].to_numpy()[:stop].astype(np.uint64), rows.slice(0, stop))
            held = rows.slice(stop).to_batches()
            size = len(context) - stop

        limit = SUBTREE_GRAMS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= limit:
                yield from whole(False)
                limit = max(SUBTREE_GRAMS, 2 * size)
        yield from whole(True)

    dealt = grams.withColumn("context", F.shiftright("gram", 8).bitwiseAND((1 << 8 * TOP) - 1)).repartition("context").sortWithinPartitions("context")
    return dealt.mapInArrow(parts, kinds)


def top_of(every: DataFrame) -> Top:
    """The tree's top, from (gram, n) of all counted grams."""

    def run(keys, rows):
        ids, below = below_top(keys, rows["n"].to_numpy().astype(float))
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(below)], ["id", "below"])

    sums = _by_contexts(every, run, "id long, below double").groupBy("id").agg(F.sum("below").alias("below")).toArrow()
    short = every.groupBy(F.col("gram").bitwiseAND((1 << 8 * TOP) - 1).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    return Top(short["gram"].to_numpy().astype(np.uint64), short["n"].to_numpy().astype(float), sums["id"].to_numpy().astype(np.uint64), sums["below"].to_numpy())


def valued(every: DataFrame, top: Broadcast) -> DataFrame:
    """(gram, n, value) of (gram, n, wanted), where wanted: value is the log10 probability of the gram's last byte."""

    def run(keys, rows):
        value = log10_of(keys, rows["n"].to_numpy().astype(float), top.value)
        own = rows.append_column("value", pa.array(value)).filter(rows["wanted"]).select(["gram", "n", "value"]).combine_chunks()
        return own.to_batches()[0] if own.num_rows else pa.RecordBatch.from_pylist([], own.schema)

    return _by_contexts(every, run, "gram long, n long, value double")


def frequent_grams(every: DataFrame, top: Broadcast, most: int) -> Frequent:
    """Of grams that occur equally often all or none are held."""
    steps = sorted(((r["n"], r["count"]) for r in every.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()), reverse=True)
    least, held = None, 0
    for n, count in steps:
        held += count
        if held > most:
            break
        least = n
    wanted = F.lit(False) if least is None else F.col("n") >= least
    found = valued(every.withColumn("wanted", wanted), top).select("gram", "value").toArrow()
    return Frequent(found["gram"].to_numpy().astype(np.uint64), found["value"].to_numpy())


def score(docs: DataFrame, training: DataFrame, most_tokens: int = MOST_TOKENS, most_grams: int = MOST_GRAMS) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score, score and code_length of docs,
    beside their columns but the text, by a model of the training texts."""
    spark, names = docs.sparkSession, [c for c in docs.columns if c != "text"]
    counts = counted(training)
    vocabulary = counts.where("token is not null").select("token", F.col("n").alias("c"))
    n_all, n_distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = vocabulary.where(F.octet_length("token") <= LONGEST_TOKEN).orderBy(F.desc("c"), "token").limit(most_tokens).toArrow()
    known = dict(zip(frequent["token"].to_pylist(), frequent["c"].to_pylist(), strict=True))
    every = counts.where("gram is not null").select("gram", "n")
    top = spark.sparkContext.broadcast(top_of(every))
    held = spark.sparkContext.broadcast((frequent_grams(every, top, most_grams), known))

    def run(batches):
        model, known = held.value
        logs = {w: np.log10(c + 0.5) for w, c in known.items()}
        nothing = np.log10(0.5)
        for batch, texts in slices(batches, most=SLICE):
            low = [t.lower() for t in texts]
            n, n_known, base, rest = [], [], [], []
            for t in low:
                words = t.split()
                words.append(END)
                got = [logs[w] for w in words if w in logs]
                other = [w for w in words if w not in logs]
                n.append(len(words))
                n_known.append(len(got))
                base.append(float(np.sum(got)) + len(other) * nothing)
                rest.append(other)
            sums, other, times = model.score(low)
            cols = [pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums, pa.float64()), pa.array([len(t) + 1 for t in low], pa.int64()), pa.array(rest, pa.list_(pa.binary())), pa.array(other, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *cols], [*names, *more])

    more = {"n_tokens": "long", "known_": "long", "base_": "double", "held_": "double", "bytes_": "long", "rest_": "array<binary>", "grams_": "array<long>", "times_": "array<long>"}
    scored = _cut_in_small_batches(docs.mapInArrow(run, plus(docs.drop("text"), **more)).withColumn("row_", F.monotonically_increasing_id()), "scored")
    held.destroy()  # all that reads it has been written
    # tokens beyond the frequent ones; one that is unknown keeps the log of 0.5 it has
    rare = scored.select("row_", F.explode("rest_").alias("token")).join(vocabulary, "token")
    sums = rare.groupBy("row_").agg(F.count("*").alias("more_"), F.sum(F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5))).alias("sum_"))
    # grams beyond the frequent ones, with those of the same contexts that were counted
    other = scored.select("row_", F.inline(F.arrays_zip(F.col("grams_").alias("gram"), F.col("times_").alias("times"))))
    asked = other.select("gram").distinct().select("gram", F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted"))
    both = every.select("gram", "n", F.lit(False).alias("wanted")).unionByName(asked).groupBy("gram").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted"))
    values = cut(valued(both, top).select("gram", "value"), "values")
    top.destroy()
    deep = other.join(values, "gram").groupBy("row_").agg(F.sum(F.col("times") * F.col("value")).alias("deep_"))
    joined = scored.drop("rest_", "grams_", "times_").join(sums, "row_", "left").join(deep, "row_", "left").withColumn("score", F.col("held_") + F.coalesce("deep_", F.lit(0.0)))
    base = F.col("base_") + F.coalesce("sum_", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n_all + 0.5 * (n_distinct + 1))))
    return joined.select(*[F.col(f"`{c}`") for c in names], "n_tokens", (F.col("known_") + F.coalesce("more_", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / F.col("bytes_") / F.lit(float(np.log10(2)))).alias("code_length"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    return score(docs, docs.where("not held_out"))
