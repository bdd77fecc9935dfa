"""Online packing, the filter audit and ranked search against plain versions, on edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tidecast.llm import filter_audit, lexical_search, online_pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, term string, bucket string, part string, failed string, start string, level string, words string, n int, tf int, score string"
EXTRA = ("r", "t", "b", "p", "f", "s", "l", "w", 1, 2, "x")
R = random.Random(5)
WORDS = ["".join(R.choices("abcdefgh", k=R.randint(1, 6))) for _ in range(150)]


def prose(n, rng=R):
    return " ".join(rng.choice(WORDS) for _ in range(n))


COPY = prose(230)
TEXTS = [None, "", " \n\t", "a", prose(220), prose(220), COPY, COPY, COPY + " #", "THE " + COPY, prose(9000), "ab " * 30_000, "x" * 60_000, "Über STRASSE　İß" * 9, "a <|endoftext|> b<|startoftext|>", "1²①\x1c\x85\xa0a", COPY.upper(), *[prose(R.randint(1, 400)) for _ in range(30)]]


@pytest.fixture(scope="module")
def rows():
    data = [(i, t, "en", (None, "", "s1", "s2")[i % 4], 3, *EXTRA) for i, t in enumerate(TEXTS)]
    return [*data, data[6], data[4], (None, COPY, None, "s1", None, *EXTRA), (None, "nobody", None, None, None, *EXTRA), (6, prose(30), None, "s2", None, *EXTRA), (90, "", None, "s2", 0, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(spark, tmp_path_factory, **tables):
    at = tmp_path_factory.mktemp("tables")
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def pieces_hold(got, rows, want_ids):
    """Every id of every document in one piece, in place, and sequences without gaps."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        docs[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    want = defaultdict(Counter)
    for r in rows:
        want[r[0]][want_ids(r[1] or "")] += 1
    for doc, parts in docs.items():
        if sum(want[doc].values()) == 1:
            whole = b"".join(ids for _, ids, _ in sorted(parts))
            assert want[doc][whole] and {n for *_, n in parts} == {len(whole) // 4}
            assert [s for s, *_ in sorted(parts)] == list(np.cumsum([0, *(len(i) // 4 for _, i, _ in sorted(parts))])[:-1])
        assert sum(len(i) for _, i, _ in parts) == sum(len(k) * n for k, n in want[doc].items())
    assert docs.keys() == want.keys()
    return sequences


def test_online_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    path = online_pack.default_tokenizer()
    library = Tokenizer.from_file(path)

    def want_ids(text):
        return np.array([*library.encode(text, add_special_tokens=False).ids, online_pack.END_ID], "<u4").tobytes()

    for width, most_open in ((2048, 1024), (64, 3), (1, 4)):
        got = online_pack.pack_online(docs, path, width, most_open, with_ids=True).collect()
        sizes = [sum(n for _, n in s) for s in pieces_hold(got, rows, want_ids).values()]
        assert max(sizes) <= width
        assert all(n == width or n & (n - 1) == 0 for n in sizes)  # no padding
    assert online_pack.pack_online(empty, path).count() == 0


def test_word_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path, rng = online_pack.default_tokenizer(), random.Random(2)
    library = Tokenizer.from_file(path)
    signs = list("abcdeinorstABSTz'sStTll 12²①\t\n\r\x0b\x0c\x1c\x1d\x85\xa0 　éÉé̀İıßΣς한ᄒ<|>ʼn中文🙂#_-%&ñáÿŐǆǅɏɐ\x00\x7f\xad¤.,") + ["<|endoftext|>", "<|startoftext|>", "'re", "'LL"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(4000)] + ["".join(rng.choices("aeioustr", k=rng.randint(1, 30))) for _ in range(2000)]
    for t in texts:
        assert online_pack.text_ids(t.encode(), path) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_level_is_that_of_the_least_squares():
    rng = random.Random(4)
    done = []
    packer = online_pack.Packer(done.append, width=16, most_open=10**6)
    for i in range(400):
        size = rng.randint(1, 15)
        counts = packer.level.copy()
        change = {}
        for level in [0, *np.flatnonzero(counts[:16])]:
            if level + size <= 16:
                now = counts[1:16].copy()
                if level:
                    now[level - 1] -= 1
                if level + size < 16:
                    now[level + size - 1] += 1
                change[level] = int((now**2).sum())
        best = [k for k, v in change.items() if v == min(change.values())]
        assert packer.fittest(size) == max(best)
        packer.add(i, bytes(4 * size))
        assert packer.level[1:16].tolist() == [len(x) for x in packer.at[1:16]]
    assert packer.n_open == sum(map(len, packer.at))


def test_few_documents_are_cut_to_fill_windows():
    rng, done = random.Random(8), []
    packer = online_pack.Packer(done.append)
    sizes = [rng.randint(1, 900) for _ in range(6000)]
    for i, n in enumerate(sizes):
        packer.add(i, bytes(4 * n))
    packer.finish()
    pieces = Counter(p[0] for w in done for p in w)
    assert sum(n > 1 for n in pieces.values()) < 0.02 * len(sizes)
    assert sum(sum(len(p[2]) for p in w) for w in done) == 4 * sum(sizes)


def plain_audit(rows, labels):
    low = {}
    for r in rows:
        if r[0] is not None:
            low[r[1] or ""] = min(low.get(r[1] or "", r[0]), r[0])
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": r[0] is not None and low[text] < r[0]}
        parts[r[3] or ""].append(({k for k, v in fails.items() if v}, r[0] in good, r[0] in toxic))
    out = {}
    for part, found in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def test_filter_audit_against_every_order_played(docs, rows, empty, spark, tmp_path_factory):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(4, 0, 1), (6, 1, 0), (6, None, None), (None, 1, 1), (7, None, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], frame.schema)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in filter_audit.audit(docs, frame).collect()}
    assert got == plain_audit(rows, labels)
    assert len(got) == 600 * 3
    bare = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in filter_audit.audit(docs, none).collect()}
    assert bare == plain_audit(rows, [])
    assert filter_audit.audit(empty, frame).count() == 0
    at = folder(spark, tmp_path_factory, documents=docs, labels=frame)
    assert filter_audit.op12_filter_audit(spark, at).count() == 1800


def plain_search(rows, items, k=20):
    terms = lambda t: re.findall(lexical_search.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(r[0], c) for r in rows if (c := Counter(terms(r[1])))]
    total = sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in docs:
            m = 75 + 25 * c.total() * len(docs) // total
            score = sum(n * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in wanted.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search_against_every_score(docs, rows, empty, spark, tmp_path_factory, monkeypatch):
    items = [(1, prose(12)), (2, COPY[:90] + " 1² über"), (3, None), (4, "?!"), (5, "a a a b"), (5, "c"), (None, prose(5)), (7, "nowhere to befound"), (8, prose(300))]
    frame = spark.createDataFrame([(i, t, "t", 1) for i, t in items], "item_id long, text string, term string, rank int")
    want = plain_search(rows, items)
    get = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert get(lexical_search.search(lexical_search.index(docs), frame)) == want
    assert get(lexical_search.search(lexical_search.index(docs, lexical_search.item_terms(frame)), frame)) == want
    monkeypatch.setattr(lexical_search, "MOST_BROADCAST", 0)  # joined by Spark's own choice
    assert get(lexical_search.search(lexical_search.index(docs, lexical_search.item_terms(frame)), frame)) == want
    assert get(lexical_search.search(lexical_search.index(docs), frame, 2)) == plain_search(rows, items, 2)
    assert lexical_search.search(lexical_search.index(empty), frame).count() == 0
    assert lexical_search.search(lexical_search.index(docs), frame.limit(0)).count() == 0
    at = folder(spark, tmp_path_factory, documents=docs, benchmark=frame)
    assert get(lexical_search.op13_ranked_search(spark, at)) == want
