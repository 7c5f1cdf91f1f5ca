"""Packing of documents into token sequences of fixed size by minimum bin slack.

Each task tokenizes its documents.  Full windows of a document are sequences of their own; the remainders wait in a
pool.  A window takes the pool's longest remainder; a subset-sum dynamic program over the multiset of remaining lengths
(bitsets, one a length and power-of-two multiple) finds the sum closest to the free room, and backtracking its bitsets
gives the count of each length.  If room stays free, a remainder is cut to fill it; the last few tokens of a task
are cut into sequences whose lengths are powers of two, which need no padding.  So there is no padding at all, and no
shuffle; a task holds at most POOL remainders.

Defined cases: null or empty text is one piece, the end id; repeated rows are packed each; null doc_id stays; an empty
table gives no rows; extra columns are left out.  Sequence ids are unique: the task's number times 2^33 and a counter.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tactus.llm.bpe_count import byte_symbols
from tactus.llm.common import Recent, give_back

WINDOW, END = 2048, 1
POOL = 4_096
#: Words whose ids a worker keeps, twice, and code points of the longest of them: some 55 MB.
KEPT, LONGEST = 150_000, 48
#: The split of word_bpe_49k.json, as its file has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same on Latin-1 text in lower case, where \p{L}, \p{N} and white space are these few; a set of bytes is matched faster than properties.
LATIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids(Recent):
    """word -> its ids as little-endian 32-bit integers; a word that is not there is tokenized when it is asked for."""

    def __init__(self, path: str):
        super().__init__(KEPT, LONGEST)
        self.tokenizer = Tokenizer.from_file(path)
        self.findall, self.latin_findall = regex.compile(WORDS).findall, re.compile(LATIN_WORDS).findall
        self.foreign = regex.compile("[^\0-ÿ]").search
        self.symbols = str.maketrans({chr(i): c for i, c in enumerate(byte_symbols())})
        added = {t.content: i.to_bytes(4, "little") for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def make(self, word: str) -> bytes:
        letters = word.encode("utf-8").decode("latin-1").translate(self.symbols)
        return b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(letters))

    def ids(self, text: str) -> bytes:
        if self.split is not None and "<|" in text:
            return b"".join(self.added[p] if p in self.added else self.plain(p) for p in self.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        # Latin-1 text is composed already, and lower() does to it what the tokenizer's normalizer does; white space is dropped by the split
        words = self.findall(self.tokenizer.normalizer.normalize_str(text)) if self.foreign(text) else self.latin_findall(text.lower())
        return b"".join(map(self.__getitem__, words))


def closest_sum(lengths: list[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """How many of each of ascending lengths to take so that their sum is as near to `room` as it can be without going over."""
    reach, before = 1, []
    full = (1 << room + 1) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length, many = lengths[i], 1
        left = min(count(length), room // length)
        while left:
            many = min(many, left)
            before.append((reach, length, many))
            reach |= reach << length * many & full
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for had, length, many in reversed(before):
        if not had >> at & 1:
            at -= length * many
            taken[length] = taken.get(length, 0) + many
    return taken


class Packer:
    """Pieces (doc_id, start, ids, doc_tokens) in; rows with sequence and offset out.  `emit` takes rows without the sequence's number."""

    def __init__(self, first_sequence: int, window: int = WINDOW, pool: int = POOL):
        self.sequence, self.window, self.most = first_sequence, window, pool
        self.by_length: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []  # the keys of by_length, ascending
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        for start in range(0, n - self.window + 1, self.window):
            self.put([(doc_id, start, ids[4 * start : 4 * (start + self.window)], n)])
        if rest := n % self.window:
            self.wait((doc_id, n - rest, ids[4 * (n - rest) :], n))
            if self.waiting >= self.most:
                while self.waiting > self.most // 2:
                    self.fill()

    def wait(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append(piece)
        self.waiting += 1

    def take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.waiting -= 1
        return piece

    def put(self, pieces: list[tuple]) -> None:
        """One sequence."""
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def fill(self) -> None:
        """One full window from the pool, which holds enough for it."""
        longest = self.lengths[-1]
        pieces, room = [self.take(longest)], self.window - longest
        for length, many in closest_sum(self.lengths, lambda x: len(self.by_length[x]), room).items():
            pieces += [self.take(length) for _ in range(many)]
            room -= length * many
        if room and self.by_length:  # every remainder left is longer than the room
            doc_id, start, ids, n = self.take(self.lengths[0])
            pieces.append((doc_id, start, ids[: 4 * room], n))
            self.wait((doc_id, start + room, ids[4 * room :], n))
        self.put(pieces)

    def end(self) -> None:
        left = sum(k * len(v) for k, v in self.by_length.items())
        while left >= self.window:
            self.fill()
            left = sum(k * len(v) for k, v in self.by_length.items())
        rest = [self.take(k) for k in sorted(self.by_length) for _ in range(len(self.by_length[k]))]
        while left:
            room, pieces = 1 << left.bit_length() - 1, []
            left -= room
            while room:
                doc_id, start, ids, n = rest.pop()
                if len(ids) > 4 * room:
                    rest.append((doc_id, start + room, ids[4 * room :], n))
                    ids = ids[: 4 * room]
                pieces.append((doc_id, start, ids, n))
                room -= len(ids) // 4
            self.put(pieces)


_ids: dict[str, Ids] = {}


def pack(docs: DataFrame, path: str, end_id: int = END, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """One row a piece.  `path`: the tokenizer's file, at the same place on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ids.get(path) or _ids.setdefault(path, Ids(path))
        packer = Packer(TaskContext.get().partitionId() << 33, window, pool)
        tail = end_id.to_bytes(4, "little")
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, words.ids(text.as_py() or "") + tail)
                if len(packer.rows) >= 10_000:
                    yield _batch(packer)
        packer.end()
        yield _batch(packer)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _batch(packer: Packer) -> pa.RecordBatch:
    rows, packer.rows = packer.rows, []
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def op10(docs: DataFrame, tokenizer: Callable[[], str] = lambda: public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return pack(docs, tokenizer())
