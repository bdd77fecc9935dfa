"""Online packing of tokenized documents by the sum of squares.

Each task packs the documents of its partition as they come, without a shuffle. It
keeps, for every fill level from 1 to width - 1, the number of open windows at that
level (the level array). A document goes into the level for which the sum of the
squared counts becomes least, or opens a window where that is less; levels then stay
evenly spread, so that for most lengths some window can be filled exactly. Of equal
choices the fullest level is taken, a new window last. A full window is written at once.

Documents longer than a window fill whole windows first; only their rest is placed.
Others are cut in two cases alone. Where more than `most_open` windows are open, and
at the end of a partition, the emptiest windows are poured into the fullest, which
cuts one document a window at most. Windows whose length is a power of two need no
padding and stay as they are then; the one window that is left unfilled at the end
is dealt out to sequences whose lengths are powers of two. So no sequence is padded,
and a task holds the ids of `most_open` windows and one slice of texts, whatever its
partition's size.

A sequence's number is made of the partition's number and a count within it. The
partitions of a table's files are the same when a lost task runs again, and so are
its rows.

Defined results: a null or empty text is one piece, the end id alone. Added tokens of
the vocabulary have their own id wherever they stand. Repeated rows, and documents of
one id or none, are packed once each. Texts of any length are read whole. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import slices, table

WIDTH = 2048
END_ID = 1
#: Windows that a task holds open, with their ids (8 KB each at most).
MOST_OPEN = 1024
#: Words kept with their ids by each Python worker, and the longest of them in bytes.
CACHE, LONGEST = 300_000, 64
_ROWS = 20_000


# Fixed value: the pre-token pattern of this vocabulary, whose white space is dropped.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+"""
#: Stands for the end of a word in the ranks; no byte of UTF-8.
_ENDED = b"\xff"
#: Marks that often close a word; a run of them after letters is one part.
_MARKS = ".,;:!?)"


class _Words(dict):
    """Words (without ASCII white space) and their ids, as little-endian unsigned 32-bit
    numbers; a new word is encoded when it is first asked for.

    Words of Latin letters, where normal forms change nothing and lower case is the same
    everywhere, go to `tiktoken` over the ranks of the file: the end of a word is one more
    byte, which merges with the byte before it first, as in the file. All others go to the
    `tokenizers` library. Both give the same ids."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.added = [t["content"].encode() for t in held["added_tokens"]]
        suffix = held["model"]["end_of_word_suffix"]
        ranks = {}
        for token, rank in held["model"]["vocab"].items():
            stem = token.removesuffix(suffix)
            ranks[bytes(BYTE_OF[c] for c in stem) + (_ENDED if stem != token else b"")] = rank
        if held["model"]["vocab"].keys() & {t["content"] for t in held["added_tokens"]}:
            raise ValueError("added tokens stand among the ranks")
        # any byte must have a rank; that of the end mark can't be asked for
        self.piece = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks | {_ENDED: max(ranks.values()) + 1}, special_tokens={})._core_bpe.encode_single_piece
        self.parts = regex.compile(PRE_TOKENS).findall
        self.turned_away = 0

    def _encode(self, word: bytes) -> list[int]:
        if word.isalpha():
            return self.piece(word.lower() + _ENDED)
        text = word.decode("utf-8", "replace")
        if (not word.isascii() and max(text) >= "\u0250") or any(a in word for a in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        text = text.lower()
        letters = text.rstrip(_MARKS)
        if letters.isalpha():
            parts = [letters, text[len(letters) :]] if len(letters) < len(text) else [letters]
        else:
            parts = self.parts(text)
        return [i for part in parts for i in self.piece(part.encode() + _ENDED)]

    def __missing__(self, word: bytes) -> bytes:
        found = self._encode(word)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST:
            if len(self) < CACHE:
                self[word] = ids
            else:  # full: the first words stay until as many others have come
                self.turned_away += 1
        return ids


# printable bytes stand for themselves in such files, the others from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_words = lru_cache(1)(_Words)


def text_ids(text: bytes, path: str) -> bytes:
    """The ids of a whole text. This vocabulary drops white space before it merges, and
    no token, composed character or added token holds any, so words are encoded one by one."""
    words = _words(path)
    if words.turned_away > CACHE:
        words.clear()
        words.turned_away = 0
    return b"".join([words[w] for w in text.split()])


class Packer:
    """The open windows of one task. A piece is [document, start, ids, document's tokens];
    `done` is called with each finished window's pieces, in their order."""

    def __init__(self, done, width: int = WIDTH, most_open: int = MOST_OPEN) -> None:
        self.done, self.width, self.most_open = done, width, most_open
        self.level = np.zeros(width + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(width + 1)]
        self.n_open = 0

    def add(self, doc, ids: bytes) -> None:
        """A document of at least one id."""
        n = len(ids) // 4
        whole = n - n % self.width
        for start in range(0, whole, self.width):
            self.done([[doc, start, ids[4 * start : 4 * (start + self.width)], n]])
        if n > whole:
            self._place([doc, whole, ids[4 * whole :], n], n - whole)

    def _place(self, piece: list, size: int) -> None:
        before = self.fittest(size)
        window = self.at[before].pop() if before else []
        window.append(piece)
        after = before + size
        if before:
            self.level[before] -= 1
            self.n_open -= 1
        if after == self.width:
            self.done(window)
            return
        self.level[after] += 1
        self.at[after].append(window)
        self.n_open += 1
        if self.n_open > self.most_open:
            self._keep(self.pour(self._take()))

    def fittest(self, size: int) -> int:
        """The level to which a piece is added (0: a new window), by the change in the sum of
        squares: (n - 1)^2 - n^2 at the level it leaves and (n + 1)^2 - n^2 where it comes to."""
        have = self.level[1 : self.width - size + 1]
        change = np.where(have > 0, 2 - 2 * have + 2 * self.level[size + 1 :], np.iinfo(np.int64).max)
        if len(change) and have[-1] > 0:
            change[-1] = 1 - 2 * have[-1]  # a full window counts no more
        fullest = len(change) - 1 - int(change[::-1].argmin()) if len(change) else -1
        return fullest + 1 if fullest >= 0 and change[fullest] <= 2 * self.level[size] + 1 else 0

    def _take(self) -> list[list]:
        windows = [w for level in self.at for w in level]
        self.at = [[] for _ in range(self.width + 1)]
        self.level[:] = 0
        self.n_open = 0
        return windows

    def _keep(self, window: list) -> None:
        if window:
            size = _length(window)
            self.level[size] += 1
            self.at[size].append(window)
            self.n_open += 1

    def pour(self, windows: list[list]) -> list:
        """Fill the fullest windows from the ends of the emptiest; what is left is one window or none."""
        order = sorted(windows, key=_length, reverse=True)
        first, last = 0, len(order) - 1
        while first < last:
            gap, giver = self.width - _length(order[first]), order[last]
            while gap and first < last:
                doc, start, ids, n = giver[-1]
                if len(ids) <= 4 * gap:
                    order[first].append(giver.pop())
                    gap -= len(ids) // 4
                else:
                    kept = len(ids) // 4 - gap
                    giver[-1] = [doc, start, ids[: 4 * kept], n]
                    order[first].append([doc, start + kept, ids[4 * kept :], n])
                    gap = 0
                if not giver:
                    last -= 1
                    giver = order[last]
            if not gap:
                self.done(order[first])
                first += 1
        return order[first] if first == last and order else []

    def finish(self) -> None:
        """Write all that is open: windows of a power of two as they are, others poured together."""
        ready, rest = [], []
        for window in self._take():
            (ready if _power(_length(window)) else rest).append(window)
        for window in ready:
            self.done(window)
        left = self.pour(rest)
        while left:
            size = 1 << (_length(left).bit_length() - 1)
            part: list = []
            while size:
                doc, start, ids, n = left.pop(0)
                cut = min(size, len(ids) // 4)
                part.append([doc, start, ids[: 4 * cut], n])
                if 4 * cut < len(ids):
                    left.insert(0, [doc, start + cut, ids[4 * cut :], n])
                size -= cut
            self.done(part)


def _length(window: list) -> int:
    return sum(len(piece[2]) for piece in window) // 4


def _power(n: int) -> bool:
    return n & (n - 1) == 0


FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_online(docs: DataFrame, path: str, width: int = WIDTH, most_open: int = MOST_OPEN, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row a piece."""
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", *(x.split()[0] for x in FIELDS.split(", ")), "ids"][: 8 if with_ids else 7]

    def run(batches):
        rows: list[tuple] = []
        first = TaskContext.get().partitionId() << 40
        count = 0
        kind = None

        def done(window):
            nonlocal count
            offset = 0
            for doc, start, ids, n in window:
                size = len(ids) // 4
                rows.append((doc, start, size, zlib.crc32(ids), n, first + count, offset, ids)[: len(names)])
                offset += size
            count += 1

        def out():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

        packer = Packer(done, width, most_open)
        for batch, texts in slices(batches):
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                packer.add(doc, text_ids(text, path) + end)
                if len(rows) >= _ROWS:
                    yield out()
        packer.finish()
        if rows:
            yield out()

    extra = ", ids binary" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {FIELDS}{extra}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(table(spark, sf_dir, "documents"), default_tokenizer())
