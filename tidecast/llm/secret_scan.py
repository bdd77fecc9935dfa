"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that
any match must hold: alternatives, each a set of trigrams. Texts are indexed by
the trigrams that some query names; postings of a query's trigrams are
intersected by counting, and only the candidates of a rule are searched by its
expression. A rule without a mandatory trigram (hex) scans every text.

Defined results: a null text is empty; no spans give an empty list, whose hash is
that of the empty text. Matches of several kinds that begin at one place are listed in
the order of RULES. Texts of any length are searched whole. Repeated rows repeat their
result; extra columns, of any names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import cut, lower_ascii, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # valid for Java; only ASCII letters may be in either case
    base: bool = False
    group: int = 0  # whose length counts
    least: int = 1


# The kinds of secrets, in the order that ties are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", True),
    # a run of 32 or more; shorter runs fail, so they needn't be matched first
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

MOST_STRINGS = 32


def required(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-case trigrams: a match holds all of one of them.
    [frozenset()] if none is mandatory.

    Runs of literals, small classes and alternatives are multiplied out; where
    that stops, the trigrams of each string so far are what it demands."""

    def strings(node) -> set[str] | None:
        """All texts that the node matches, lower-cased, if few."""
        kind, value = node
        if kind is sre.LITERAL:
            return {chr(value).lower()}
        if kind is sre.IN and all(k is sre.LITERAL for k, _ in value):
            return {chr(v).lower() for _, v in value}
        if kind in (sre.ASSERT, sre.ASSERT_NOT, sre.AT):
            return {""}
        if kind is sre.SUBPATTERN:
            return every(value[-1])
        if kind is sre.BRANCH:
            found = [every(x) for x in value[1]]
            return None if None in found else set().union(*found)
        if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
            one = every(value[2])
            return None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
        return None

    def every(nodes) -> set[str] | None:
        out = {""}
        for x in nodes:
            if (more := strings(x)) is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def trigrams(run: set[str]) -> set[frozenset[str]]:
        return {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}

    def demand(nodes) -> set[frozenset[str]]:
        out, run = {frozenset()}, {""}

        def both(more: set[frozenset[str]]) -> None:
            nonlocal out
            if frozenset() not in more:
                out = {a | b for a in out for b in more}

        for x in nodes:
            more = strings(x)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            both(trigrams(run))
            run = more if more is not None else {""}
            if more is None:
                kind, value = x
                if kind is sre.SUBPATTERN:
                    both(demand(value[-1]))
                elif kind is sre.BRANCH:
                    both(set().union(*(demand(v) for v in value[1])))
                elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
                    both(demand(value[2]))
        both(trigrams(run))
        return out

    found = demand(sre_parser.parse(pattern))
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


NO_SPANS = "array<struct<start:int,number:int,end:int>>"
RUN = 256  # matches listed at a time


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind number, end):
    the parts between them give the places, in code points. Matches are listed in
    runs, as appending to one list copies it for every match."""
    number = [r.kind for r in RULES].index(rule.kind)
    whole, part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), part.alias("part"))

    def runs_of(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(found) / RUN).cast("int")), lambda i: F.slice(found, i * RUN + 1, F.lit(RUN)))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.char_length(x["part"]) >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    def each_run(state: Column, run: Column) -> Column:
        own = F.aggregate(run, F.struct(state["at"].alias("at"), F.array().cast(NO_SPANS).alias("found")), step)
        return F.struct(own["at"].alias("at"), F.concat(state["runs"], F.array(own["found"])).alias("runs"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NO_SPANS}>").alias("runs"))
    # an array of one, so that the matches have a name and are found once, not for every run
    return F.transform(F.array(steps), lambda found: F.aggregate(runs_of(found), begin, each_run, lambda s: F.flatten(s["runs"])))[0]


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(row, trigram) of (row, text), for the trigrams that queries name; case is ignored."""
    low = texts.select("row", lower_ascii(F.col("text")).alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("row", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """(row, rules): the rules of which a row holds every trigram of an alternative."""
    number = {t: i for i, t in enumerate(trigrams)}
    terms = [(rule, a, len(alternative), number[t]) for rule, found in queries.items() for a, alternative in enumerate(found) for t in sorted(alternative)]
    spark = index.sparkSession
    demanded = spark.createDataFrame(terms, "rule int, alternative int, need int, trigram int")
    # the table of terms comes from the rules alone: a few dozen rows
    met = index.join(F.broadcast(demanded), "trigram").groupBy("row", "rule", "alternative", "need").agg(F.count_distinct("trigram").alias("have"))
    return met.where("have = need").groupBy("row").agg(F.collect_set("rule").alias("rules"))  # at most one entry a rule


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans to docs with a text."""
    added = {f"n_{r.kind}" for r in RULES if r.base} | {"base_sha256", "spans"}  # take the place of columns of these names
    names = [c for c in docs.columns if c not in added]
    queries = {i: q for i, r in enumerate(RULES) if (q := required(r.pattern)) != [frozenset()]}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    # rows that have the same text share their candidates
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_"), text.alias("text_"), F.xxhash64(text).alias("row_"))
    index = postings(docs.select(F.xxhash64(text).alias("row"), text.alias("text")), trigrams)
    found = cut(candidates(index, queries, trigrams).select(F.col("row").alias("row_"), F.col("rules").alias("rules_")), "candidates")  # joined by its real size
    known = rows.join(found, "row_", "left")
    none = F.array().cast(NO_SPANS)
    per_rule = []
    for i, rule in enumerate(RULES):
        hits = spans_of(F.col("text_"), rule)
        if i in queries:
            hits = F.when(F.array_contains("rules_", i), hits).otherwise(none)
        else:
            hits = F.when(F.col("text_").rlike(rule.pattern), hits).otherwise(none)
        per_rule.append(hits.alias(f"spans_{i}_"))
    searched = known.select("doc_", *per_rule)
    base = F.array_sort(F.concat(*[F.col(f"spans_{i}_") for i, r in enumerate(RULES) if r.base]))
    every = F.array_sort(F.concat(*[F.col(f"spans_{i}_") for i in range(len(RULES))]))
    counts = [F.size(f"spans_{i}_").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(RULES) if r.base]
    return searched.select("doc_.*", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    """The same in DuckDB, by matches and the parts between them, without an index.
    RE2 folds beyond ASCII, so letters in either case are written out as classes."""
    word = "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in "password|passwd|secret|token|api_?key")
    pattern = {r.kind: r.pattern for r in RULES}
    pattern["assign"] = f"""({word})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    pattern["hex"] = r"[0-9a-f]{32,}"
    parts = []
    for i, r in enumerate(RULES):
        p = pattern[r.kind]
        parts.append(f"""SELECT row, {i} AS number, '{r.kind}' AS kind, hit, part, gap, generate_subscripts(hit, 1) AS k FROM
 (SELECT row, regexp_extract_all(text, '{p}') AS hit, regexp_extract_all(text, '{p}', {r.group}) AS part, regexp_split_to_array(text, '{p}') AS gap FROM t)""")
    joined = reduce(lambda a, b: f"{a}\nUNION ALL {b}", parts)
    least = "CASE number " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES)) + " END"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({joined}),
s AS (SELECT row, number, kind, length(part[k]) AS size, CAST(coalesce(list_sum([length(x) FOR x IN gap[1:k]]), 0) + coalesce(list_sum([length(x) FOR x IN hit[1:k-1]]), 0) AS BIGINT) AS start, length(hit[k]) AS long FROM m),
ok AS (SELECT row, number, kind, start, start + long AS stop FROM s WHERE size >= {least}),
a AS (SELECT row, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans FROM ok GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (row)
"""


OP2_SQL = _sql()
