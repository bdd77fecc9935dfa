"""Near duplicates by a parity-sketch join on 5-word shingles.

Each token (shingle) flips one bit of a wide sketch. Two sets differ in at least
as many tokens as their sketches differ in bits, and a Jaccard similarity of t
bounds the difference: |A d B| <= (1 - t) / (1 + t) * (|A| + |B|) = D. The wide
sketch of a size band is cut into blocks; D differences spoil D blocks at most, so
of any D + 1 blocks one is equal (pigeonhole). A set of n tokens emits its first
floor(n (1 - t) / t) + 1 blocks that aren't empty, each as the XOR of its tokens'
hashes. That loses no pair: among the first L blocks, L the lesser of the two sets'
counts, the equal ones outnumber those that are empty in both. The least band has
a block for each bit. Sets near a band's lower end also emit blocks of the band
below. A second sketch of two bits or more a token goes with each set; the Hamming
distances of it and of its fold to a fixed number of bits, lower bounds too, discard most false
candidates before their sets are read.

Candidates are not paired within a block. Equal sets are one class; each class is
first verified with that head of its blocks which it shares most blocks with, under
size and Hamming bounds, and what links is contracted. Blocks of more than FULL
classes that still hold several groups get HEADS random heads each, and what links
is contracted again. In blocks that stay open and hold at most FULL classes, those
of different groups are then paired. Fuller blocks come from
passages that many documents share: their classes get keys anew, from their own
rarest tokens (any order of tokens is as exact as another, and with common tokens
last, a passage makes no key unless it is most of a document). So copies in
thousands and passages in thousands of documents make candidates in proportion to
their number, and no link between groups is missed.

Defined results: a null or empty text has no shingles, is its own component and
linked with nothing. Equal rows repeat their result. Rows without an id take part;
a component of them alone has a null id. Several texts of one id are documents of
their own, and tied sizes or distances are within every bound (bounds are inclusive).
A text of any length is shingled whole. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import cut, discard, slices, table
from tidecast.llm.components import connected
from tidecast.llm.quality_rules import spread

WORDS, PERCENT = 5, 80
#: Bits of the sketch by which pairs are bounded at first, and least bits of a class's own.
NARROW, LEAST_BITS = 512, 2048
#: Most classes of a block that are paired; fuller ones get keys from rare tokens.
FULL = 64
#: Random heads of a fuller block: a class of a group links with one of them, or nearly all do.
HEADS = 8
#: Most common tokens that come last in the order of rarity; broadcast. Results don't depend on it.
MOST_COMMON = 1 << 18
#: Classes of a block that one task pairs with the others.
PART = 512
#: Sizes at which bands end: the least, and the ratio from one to the next (over 100 / PERCENT).
FIRST_BAND, BAND_RATIO = 32, 1.5
_MIX = np.random.default_rng(5).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    long = min(width, len(words))
    total = np.full(n, long, np.uint64)
    for j in range(long):
        total += own[j : j + n] * _MIX[j]
    return np.unique(spread(total))


def band_ends(most: int) -> list[int]:
    ends = [FIRST_BAND]
    while ends[-1] < most:
        ends.append(int(ends[-1] * BAND_RATIO))
    return ends


def block_keys(tokens: np.ndarray, band: int, end: int, wanted: int, percent: int = PERCENT) -> np.ndarray:
    """Keys of the first `wanted` blocks that aren't empty, in the band's sketch."""
    high = tokens >> np.uint64(32)
    if band == 0:
        block = high  # a block for each bit
    else:
        blocks = int(1.4 * (end * (100 - percent) // percent + 1)) + 48
        block = (high * np.uint64(blocks)) >> np.uint64(32)
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    value = np.bitwise_xor.reduceat(spread(tokens), begin)
    return spread(value ^ spread(block[begin] + np.uint64(band << 48)))[:wanted]


def parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The bit sketch of a power of two of bits, as 64-bit words."""
    count = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(count.astype(np.uint8) & 1, bitorder="little").view("<i8")


def sketch(tokens: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of two bits or more a token, and the keys of the pigeonhole blocks."""
    n = len(tokens)
    own = parity(tokens, max(LEAST_BITS, 1 << (2 * n - 1).bit_length()))
    ends = band_ends(n)
    band = len(ends) - 1
    keys = [block_keys(tokens, band, ends[band], n * (100 - percent) // percent + 1, percent)]
    if band and n * percent <= 100 * ends[band - 1]:  # a partner may lie in the band below
        most = (100 - percent) * (n + ends[band - 1]) // (100 + percent)
        keys.append(block_keys(tokens, band - 1, ends[band - 1], most + 1, percent))
    return own, np.unique(np.concatenate(keys))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int64)))


def sketches(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, n, set_a, set_b, w0.., sketch, keys): h tells texts of one id apart, equal sets have
    equal (n, set_a, set_b); w0.. are the sketch folded to NARROW bits."""
    kind = dict(docs.dtypes)["doc_id"]
    narrow = [f"w{i}" for i in range(NARROW // 64)]

    def run(batches):
        for batch, texts in slices(batches):
            n, a, b, words, wide, keys = [], [], [], [], [], []
            for t in texts:
                own = shingles(t, width)
                n.append(len(own))
                bits, blocks = sketch(own, percent) if len(own) else (np.zeros(LEAST_BITS // 64, "<i8"), own)
                both = np.array([np.bitwise_xor.reduce(own) if len(own) else 0, spread(own ^ np.uint64(77)).sum()], np.uint64)
                a.append(both[:1].astype(np.int64)[0])
                b.append(both[1:].astype(np.int64)[0])
                wide.append(bits)
                words.append(np.bitwise_xor.reduce(bits.reshape(-1, NARROW // 64), axis=0))
                keys.append(blocks.astype(np.int64))
            folded = np.stack(words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(folded[:, i]) for i in range(len(narrow))), _lists(wide), _lists(keys)],
                ["doc_id", "h", "n", "set_a", "set_b", *narrow, "sketch", "keys"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"doc_id {kind}, h long, n long, set_a long, set_b long, {', '.join(f'{w} long' for w in narrow)}, sketch array<long>, keys array<long>")


def token_sets(docs: DataFrame, wanted: DataFrame, width: int = WORDS) -> DataFrame:
    """(cls, tokens) of the wanted classes (cls, rep, set_a), read again from one text of each."""

    def run(batches):
        for batch, texts in slices(batches):
            own = [shingles(t, width) for t in texts]
            right = [(np.bitwise_xor.reduce(x) if len(x) else np.uint64(0)).astype(np.int64) == a for x, a in zip(own, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(own)], ["cls", "tokens"]).filter(pa.array(right))

    picked = wanted.select("cls", "set_a", F.col("rep.doc_id").alias("id_"), F.col("rep.h").alias("h_"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    joined = rows.join(picked, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))).select("cls", "set_a", "text")
    return joined.mapInArrow(run, "cls long, tokens array<long>").dropDuplicates(["cls"])


def bounds_of(x: str, y: str, percent: int) -> str:
    """Size and Hamming bounds of a pair of classes, as rows or structs x and y."""
    differ = " + ".join(f"bit_count({x}.w{i} ^ {y}.w{i})" for i in range(NARROW // 64))
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) AND {100 + percent} * ({differ}) <= {100 - percent} * ({x}.n + {y}.n)"


def may_link(x: str, y: str, percent: int = PERCENT) -> Column:
    return F.expr(bounds_of(x, y, percent))


def folded(words: Column) -> Column:
    """A sketch of half the bits."""
    half = (F.size(words) / 2).cast("int")
    return F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the Hamming bound on the longer sketches leaves, written."""
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    other = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    both = pairs.join(one, "a").join(other, "b")
    x, y = F.col("x"), F.col("y")
    longer, shorter = F.when(F.size(x) >= F.size(y), x).otherwise(y), F.when(F.size(x) >= F.size(y), y).otherwise(x)
    longer = F.when(F.size(longer) > F.size(shorter), folded(longer)).otherwise(longer)
    differ = F.aggregate(F.zip_with(longer, shorter, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return cut(both.where((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "pairs")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose token sets are similar enough, written."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "rep", "set_a"), "cls")
    sets = cut(token_sets(docs, wanted, width), "tokens")
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = cut(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")
    discard(sets)
    return links


def jumped(up: DataFrame) -> DataFrame:
    """Links (node, root) from each node to one lesser node, as links to where all such links end.
    Each turn doubles the steps, until none leads further. Written."""
    further = up
    while True:
        last = further.select(F.col("node").alias("at"), F.col("root").alias("next"))
        up = cut(further.select("node", "root").join(last, F.col("root") == F.col("at"), "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "labels")
        if hasattr(further, "cut_path"):
            discard(further)
        if up.where("moved").isEmpty():
            return up.drop("moved")
        further = up


def named(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Rows with the labels of their columns of nodes in place of the nodes."""
    for c in columns:
        rows = rows.join(labels.select(F.col("node").alias(c), F.col("root").alias("to_")), c, "left").withColumn(c, F.coalesce("to_", c)).drop("to_")
    return rows


def merged(labels: DataFrame, up: DataFrame) -> DataFrame:
    """Labels after their roots have got labels of their own. Written."""
    return cut(named(labels, up, "root").unionByName(up), "labels")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, cls, root) of the keys under which several roots stand, with `m`, the key's
    classes, and `lead`, one of them that a hash picks."""
    dealt = rows.repartition("key")  # both the aggregate and the join use it
    lead = F.min(F.struct(F.xxhash64("cls", F.lit("lead")).alias("h_"), "cls", "root")).alias("lead")
    told = dealt.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"), lead).where("low <> high")
    return dealt.join(told.select("key", "m", "lead"), "key")


def with_heads(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of HEADS classes of each key and its other classes of other roots, within the bounds, which
    the join itself tests: classes that share a passage alone make no pair. A class that is a head of one key
    is likely that of others too. A row meets all heads of its key as one array, and a class has those of all its
    keys in one before pairs are made, so that two classes make one pair, however many keys they share."""
    bounds = ["n", *[f"w{i}" for i in range(NARROW // 64)]]
    dealt = rows.select("key", "cls", "root", *bounds).repartition("key")
    turn = F.pmod(F.xxhash64("cls", F.lit("turn")), F.lit(HEADS)).alias("turn")
    heads = dealt.groupBy("key", turn).agg(F.min(F.struct(F.xxhash64("cls", F.lit("head")).alias("h_"), "cls", "root", *bounds)).alias("head"))
    held = heads.groupBy("key").agg(F.sort_array(F.collect_list("head")).alias("heads"))
    x, y = dealt.alias("x"), held.alias("y")
    near = F.expr(f"filter(y.heads, h -> h.root <> x.root AND {bounds_of('h', 'x', percent)}).cls")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.size(near) > 0)).select("x.cls", near.alias("near"))
    told = met.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"))
    return told.select("cls", F.explode("near").alias("head")).select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()


def rare_keys(docs: DataFrame, wanted: DataFrame, width: int, percent: int, most_common: int = MOST_COMMON) -> DataFrame:
    """(cls, key) of the wanted classes (cls, rep, set_a): the first tokens of each, common ones last. Of two sets
    that link, each has at most (1 - t) of its n tokens alone, so the first token that they share is one of these."""
    sets = cut(token_sets(docs, wanted, width), "common_sets")
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > FULL)
    common = often.orderBy(F.desc("count"), "token").limit(most_common).select("token").toArrow()["token"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(np.sort(common))

    def run(batches):
        known = held.value
        for batch in batches:
            tokens = batch.column(1)
            own = tokens.flatten().to_numpy()
            sizes = np.diff(tokens.offsets.to_numpy())
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            last = known[at] == own if len(known) else np.zeros(len(own), bool)
            of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((own, last, of))
            place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = order[place < np.repeat(sizes * (100 - percent) // 100 + 1, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[kept])), pa.array(own[kept])], ["cls", "key"])

    return sets.mapInArrow(run, "cls long, key long")


def across(rows: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different roots under one key of rows (key, cls, root, m), within the bounds.
    A full block is dealt to several tasks."""
    parts = F.ceil(F.col("m") / PART).cast("int")
    rich = cut(rows.select("key", "cls", "root", "m").join(brief, "cls"), "open_blocks")
    x = rich.withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).alias("x")
    y = rich.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & may_link("x", "y", percent))
    found = cut(met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), "across")
    discard(rich)
    return found


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs."""
    narrow = [f"w{i}" for i in range(NARROW // 64)]
    sketched = cut(sketches(docs, width, percent), "sketches")
    every = cut(sketched.select("doc_id", "n", "set_a", "set_b"), "members")
    held = [F.first(c).alias(c) for c in [*narrow, "sketch", "keys"]]  # equal in equal sets
    grouped = sketched.where("n > 0").groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "h")).alias("rep"), *held)
    keyed = cut(grouped.withColumn("cls", F.monotonically_increasing_id()), "keyed")
    discard(sketched)

    # blocks that several classes share; a class is its own root so far
    blocks = keyed.select(F.explode("keys").alias("key"), "cls").withColumn("root", F.col("cls"))
    shared = cut(in_blocks(blocks).select("key", "cls", "m", F.col("lead.cls").alias("head")), "blocks")
    classes = cut(keyed.drop("keys"), "classes")
    discard(keyed)
    brief = classes.select("cls", "n", *narrow)

    def bounded(pairs: DataFrame) -> DataFrame:
        both = pairs.join(brief.alias("x"), F.col("a") == F.col("x.cls")).join(brief.alias("y"), F.col("b") == F.col("y.cls"))
        return both.where(may_link("x", "y", percent)).select(*[F.col(c) for c in pairs.columns])

    def checked(pairs: DataFrame) -> DataFrame:
        return verified(near_enough(pairs, classes, percent), classes, docs, width, percent)

    # each class with the head that it shares most blocks with; a link leads to the lesser class
    counted = bounded(shared.where("cls <> head").groupBy(F.col("head").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("n_")))
    best = counted.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"), "n_").groupBy("b").agg(F.max_by("a", F.struct("n_", -F.col("a"))).alias("a"))
    stars = checked(best.select("a", "b"))
    labels = jumped(stars.select(F.col("b").alias("node"), F.col("a").alias("root")))

    # full blocks that hold several groups, with many heads each
    left = cut(in_blocks(named(shared.select("key", "cls", F.col("cls").alias("root")), labels, "root")).drop("lead"), "blocks")
    discard(shared)
    second = checked(with_heads(left.where(F.col("m") > FULL).join(brief, "cls"), percent))
    labels = merged(labels, connected(named(second, labels, "a", "b")))

    # blocks that stay open: those of a few classes as they are, the others by rare tokens
    open_ = cut(in_blocks(named(left.select("key", "cls", F.col("cls").alias("root")), labels, "root")).drop("lead"), "blocks")
    discard(left)
    common = open_.where(F.col("m") > FULL).select("cls").distinct().join(classes.select("cls", "rep", "set_a"), "cls")
    rare = in_blocks(named(rare_keys(docs, common, width, percent).withColumn("root", F.col("cls")), labels, "root")).drop("lead")
    pairs = across(open_.where(F.col("m") <= FULL), brief, percent).unionByName(across(rare, brief, percent)).distinct()
    rest = checked(pairs)
    discard(open_)

    final = merged(labels, connected(named(stars.unionByName(rest), labels, "a", "b")))
    told = classes.select("cls", "doc_id", "n", "set_a", "set_b").join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = told.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = told.join(least, "root").select("n", "set_a", "set_b", "component_id")
    result = every.select("doc_id", "n", "set_a", "set_b").join(component, ["n", "set_a", "set_b"], "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, k, k + {WORDS - 1}), ' ') AS shingle FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - {WORDS - 1}))) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {PERCENT} * (na.n + nb.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.a = w.doc_id
"""
