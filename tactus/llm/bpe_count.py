"""Token counts of a byte-level BPE by merging with a heap and a linked list.

A text is cut at the tokenizer's added tokens (one token each) and between them by its pattern.  A piece starts as one
symbol a byte in a linked list; the heap holds adjacent pairs by (rank, position); the pair of lowest rank is popped and
merged until none is left.  A piece's count is its initial symbols minus its merges; no identifiers are made.  Counts of
pieces are kept in a dictionary of bounded size, as pieces repeat; long pieces are counted each time.

Defined cases: null or empty text has 0 tokens; repeated rows each get a row; null doc_id stays; extra columns are left
out.  Time is n log n in the longest piece, so a text without white space is no worse than others.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import Recent, map_text

LIMIT = 512
#: Pieces whose counts a worker keeps, twice, and code points of the longest of them: some 45 MB.
KEPT, LONGEST = 150_000, 48


def byte_symbols() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others follow from code point 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


#: The usual pattern on Latin-1 text, where \p{L}, \p{N} and white space are these few; a set of bytes is matched faster than properties.
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"


class Counter(Recent):
    """piece -> tokens; a piece that is not there is counted when it is asked for."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        super().__init__(KEPT, LONGEST)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]) or spec["normalizer"] or spec["model"]["ignore_merges"]:
            raise ValueError(f"{path}: only plain added tokens, no normalizer and merges by rank are supported")
        self.rank = {(a, b): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.symbols = byte_symbols()
        self.any_findall = regex.compile(pattern).findall
        self.latin_findall = re.compile(LATIN_PATTERN).findall if pattern == public_tokenizers.PATTERN else self.any_findall
        self.foreign = regex.compile("[^\0-ÿ]").search
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def make(self, piece: str) -> int:
        return self.merge(piece.encode("utf-8"))

    def merge(self, piece: bytes) -> int:
        """Initial symbols minus merges."""
        symbol = [self.symbols[b] for b in piece]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            r = rank.get((symbol[i], symbol[i + 1]))
            if r is not None:
                heap.append((r, i, symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if symbol[i] != a or (j := after[i]) >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = a + b, ""
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        return n - merges

    def findall(self, text: str) -> list[str]:
        return self.any_findall(text) if self.foreign(text) else self.latin_findall(text)

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return sum(map(self.__getitem__, self.findall(text)))
        pieces = self.added.split(text)
        return len(pieces) - 1 + sum(sum(map(self.__getitem__, self.findall(p))) for p in pieces)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_bytes and n_tokens.  `path`: the tokenizer's file, at the same place on every executor."""

    def start():
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))

        def make(texts: list) -> dict[str, list]:
            texts = [t or "" for t in texts]
            return {"n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(list(map(counter.count, texts)), pa.int64())}

        return make

    return map_text(docs, F.col("text"), keep, "n_bytes long, n_tokens long", start)


def op8(docs: DataFrame) -> DataFrame:
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
