"""Subword models over token ids: byte-pair merges, WordPiece and Unigram, trained on counts of distinct words.

A word is a bar, a beat or a whole sequence of ids, written one letter an id.  Models are fitted on all distinct words:
Spark keeps their table and counts pairs, symbols or substrings of it round by round; the driver sees only counts of
pairs of the vocabulary, or the distinct words themselves if they are IN_MEMORY ids at most.  A BPE round takes all merges that are sure from one count: the next pair in order is, as long as
it shares no symbol with those before it.  train_bpe(), train_wordpiece() and train_unigram() are the same fits in memory.
Ties: larger count, then smaller left id, then smaller right id.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_CHAR = 33
#: Pairs of one count that come to the driver in a BPE round, the best ones.
BEST_PAIRS = 1_000
#: Merges after which the words' table is made anew.
PENDING = 64
#: Ids of distinct words up to which the fit runs on the driver: 16 bytes each.
IN_MEMORY = 20_000_000


def to_chars(ids: Column) -> Column:
    """Ids as a string, one letter each: the letter of id i has code point i + 33, past the surrogates 2,048 more."""
    def byte(x: Column) -> Column:
        return F.unhex(F.hex(x.cast("long")))

    def letter(i: Column) -> Column:
        plain = i + FIRST_CHAR
        point = F.when(plain < 0xD800, plain).otherwise(plain + 0x800)
        tail = lambda shift: byte(F.lit(128) + F.shiftright(point, shift) % 64)
        two = F.concat(byte(F.lit(192) + F.shiftright(point, 6)), tail(0))
        three = F.concat(byte(F.lit(224) + F.shiftright(point, 12)), tail(6), tail(0))
        four = F.concat(byte(F.lit(240) + F.shiftright(point, 18)), tail(12), tail(6), tail(0))
        wide = F.when(point < 0x800, two).when(point < 0x10000, three).otherwise(four)
        return F.when(point < 128, F.char(point)).otherwise(F.decode(wide, "utf-8"))

    return F.array_join(F.transform(ids, letter), "")


def to_ids(chars: str) -> list[int]:
    """The inverse of to_chars() for one string."""
    return [c - FIRST_CHAR - (0x800 if c >= 0xE000 else 0) for c in map(ord, chars)]


def word_counts(words: DataFrame, ids: str = "ids") -> DataFrame:
    """(ids, n) of the distinct words that have an id."""
    return words.where(F.size(ids) > 0).groupBy(ids).agg(F.count("*").alias("n"))


class _Pairs:
    """Words one after the other in one array, -1 after each, with counts of symbols and of adjacent pairs.

    A merge looks at the array once and counts anew only what is next to the places where it happens.
    """

    def __init__(self, x: np.ndarray, freq: np.ndarray):
        self.x = x
        self.n = np.repeat(freq, np.diff(np.flatnonzero(np.concatenate([[-1], x])  == -1))) if len(x) else np.zeros(0, np.int64)
        self.single: dict[int, int] = _sums(x[x >= 0], self.n[x >= 0])
        self.count: dict[tuple[int, int], int] = {}
        self._add(np.arange(max(len(x) - 1, 0)), 1)

    def _add(self, at: np.ndarray, sign: int) -> None:
        """Count the pairs that begin at these places, or take them off."""
        at = at[(at >= 0) & (at + 1 < len(self.x))]
        left, right = self.x[at], self.x[at + 1]
        ok = (left >= 0) & (right >= 0)
        for key, n in _sums(left[ok] << 32 | right[ok], self.n[at[ok]]).items():
            pair = key >> 32, key & 0xFFFFFFFF
            total = self.count.get(pair, 0) + sign * n
            if total:
                self.count[pair] = total
            else:
                self.count.pop(pair, None)

    def merge(self, pair: tuple[int, int], new: int) -> None:
        a, b = pair
        hit = np.flatnonzero((self.x[:-1] == a) & (self.x[1:] == b))
        hit = _apart(hit) if a == b else hit
        if not len(hit):
            return
        near = np.unique(np.concatenate([hit - 1, hit, hit + 1]))
        self._add(near, -1)
        weight = int(self.n[hit].sum())
        for s in pair:
            self.single[s] -= weight
        self.single[new] = self.single.get(new, 0) + weight
        self.x[hit] = new
        self.x, self.n = np.delete(self.x, hit + 1), np.delete(self.n, hit + 1)
        at = hit - np.arange(len(hit))  # where the merged symbols are now
        self._add(np.unique(np.concatenate([at - 1, at])), 1)


def _sums(keys: np.ndarray, n: np.ndarray) -> dict[int, int]:
    found, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, inverse, n)
    return dict(zip(found.tolist(), total.tolist(), strict=True))


def _apart(hit: np.ndarray) -> np.ndarray:
    """Of places in a row every second."""
    at = np.arange(len(hit))
    first = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, at, 0))
    return hit[(at - first) % 2 == 0]


def _flat(counts: list[tuple[list[int], int]]) -> _Pairs:
    words = [np.array([*w, -1], dtype=np.int64) for w, _ in counts]
    return _Pairs(np.concatenate(words) if words else np.zeros(0, np.int64), np.array([n for _, n in counts], dtype=np.int64))


def merged(ids: list, pair: tuple, new) -> list:  # noqa: ANN001
    out, k = [], 0
    while k < len(ids):
        if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
            out.append(new)
            k += 2
        else:
            out.append(ids[k])
            k += 1
    return out


def train_bpe(counts: list[tuple[list[int], int]] | _Pairs, base_size: int, vocab_size: int) -> list[tuple[int, int, int]]:
    """Merges (left, right, new id) until the vocabulary has vocab_size ids or no pair is left that occurs twice."""
    pairs = counts if isinstance(counts, _Pairs) else _flat(counts)
    merges = []
    for new in range(base_size, vocab_size):
        n, best = min(((-n, p) for p, n in pairs.count.items()), default=(0, None))
        if n > -2:
            break
        pairs.merge(best, new)
        merges.append((*best, new))
    return merges


def apply_bpe(ids: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the pair of lowest rank, from the left, until none is left: a heap of pairs over a linked list."""
    ids, n = list(ids), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
            continue  # one of the two has been merged since
        ids[i], ids[j] = rank[pair][1], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for h, m in ((before[i], i), (i, k)):
            if h >= 0 and m < n and (p := (ids[h], ids[m])) in rank:
                heapq.heappush(heap, (rank[p][0], h, p))
    return [x for x in ids if x >= 0]


def train_wordpiece(counts: list[tuple[list[int], int]] | _Pairs, base_size: int, vocab_size: int) -> list[tuple[int, ...]]:
    """Pieces of several base ids: pairs of highest count(pair) / (count(left) * count(right)), as merges go on."""
    pairs = counts if isinstance(counts, _Pairs) else _flat(counts)
    pieces: list[tuple[int, ...]] = []
    ids: dict[tuple[int, ...], int] = {}
    made: dict[int, tuple[int, ...]] = {}
    piece = lambda x: made.get(x) or (x,)
    while base_size + len(pieces) < vocab_size:
        # ties go to the smaller pieces, so these are looked at for the best alone
        best = max((n / (pairs.single[a] * pairs.single[b]) for (a, b), n in pairs.count.items() if n > 1), default=None)
        if best is None:
            break
        left, right, a, b = min((piece(a), piece(b), a, b) for (a, b), n in pairs.count.items() if n > 1 and n / (pairs.single[a] * pairs.single[b]) == best)
        if left + right not in ids:
            ids[left + right] = base_size + len(pieces)
            made[ids[left + right]] = left + right
            pieces.append(left + right)
        pairs.merge((a, b), ids[left + right])
    return pieces


def longest_first(ids: list[int], pieces: dict[tuple[int, ...], int], longest: int) -> list[int]:
    """WordPiece: from the left the longest piece that is known; single ids always are."""
    out, i = [], 0
    while i < len(ids):
        for n in range(min(longest, len(ids) - i), 0, -1):
            piece = tuple(ids[i : i + n])
            if n == 1 or piece in pieces:
                out.append(pieces[piece] if n > 1 else ids[i])
                i += n
                break
    return out


def train_unigram(counts: list[tuple[list[int], int]], base_size: int, vocab_size: int, longest: int = 8, rounds: int = 4) -> dict[tuple[int, ...], float]:
    """Log probabilities of pieces: frequent substrings, re-estimated on best segmentations and pruned to vocab_size."""
    seen: Counter = Counter()
    for w, n in counts:
        for i in range(len(w)):
            for k in range(1, min(longest, len(w) - i) + 1):
                seen[tuple(w[i : i + k])] += n * k
    singles = {p for p in seen if len(p) == 1}
    more = sorted((p for p in seen if len(p) > 1), key=lambda p: (-seen[p], p))[: 4 * vocab_size]
    weight = {p: float(seen[p]) for p in [*singles, *more]}
    for r in range(rounds):
        total = sum(weight.values())
        logs = {p: math.log(x / total) for p, x in weight.items()}
        used: Counter = Counter()
        for w, n in counts:
            for p in best_segmentation(w, logs, longest):
                used[p] += n
        room = max(vocab_size - base_size, 0) if r == rounds - 1 else 2 * vocab_size
        keep = sorted((p for p in used if len(p) > 1), key=lambda p: (-used[p], p))[:room]
        weight = {p: float(used[p]) + 0.01 for p in [*sorted(singles), *keep]}
    total = sum(weight.values())
    return {p: math.log(x / total) for p, x in weight.items()}


def best_segmentation(ids: list[int], logs: dict[tuple[int, ...], float], longest: int) -> list[tuple[int, ...]]:
    best, back = [0.0] + [-math.inf] * len(ids), [0] * (len(ids) + 1)
    for j in range(1, len(ids) + 1):
        for i in range(max(0, j - longest), j):
            score = best[i] + logs.get(tuple(ids[i:j]), -1e9 if j - i == 1 else -math.inf)
            if score > best[j]:
                best[j], back[j] = score, i
    out, j = [], len(ids)
    while j:
        out.append(tuple(ids[back[j] : j]))
        j = back[j]
    return out[::-1]


def _merge_all(x: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """x, words one after the other with -1 after each, with the merges done in order, from the left."""
    for a, b, new in merges:
        hit = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
        if a == b and len(hit):
            hit = _apart(hit)
        if len(hit):
            x[hit] = new
            x = np.delete(x, hit + 1)
    return x


def _merged_words(batch: pa.RecordBatch, merges: list[tuple[int, int, int]]) -> np.ndarray:
    ids = batch.column(0)
    size = np.diff(ids.offsets.to_numpy())
    values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return _merge_all(np.insert(values, np.cumsum(size), -1), merges)


class _Words:
    """A persisted table (ids, n) of distinct words, on which merges are done."""

    def __init__(self, words: DataFrame):
        self.now, self.pending = words.select(F.col("ids").cast("array<int>"), "n").persist(), []

    def merge(self, merges: list[tuple[int, int, int]]) -> None:
        self.pending += merges
        if len(self.pending) < PENDING:
            return
        done, before = list(self.pending), self.now

        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                x = _merged_words(b, done)
                end = np.flatnonzero(x == -1)
                offsets = np.concatenate([[0], end - np.arange(len(end))])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[x >= 0], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, b.column(1)], names=["ids", "n"])

        self.now = before.mapInArrow(run, "ids array<int>, n long").persist()
        self.now.count()
        before.unpersist()
        self.pending = []

    def counts(self) -> DataFrame:
        """(a, b, n) of all adjacent pairs, and (a, -1, n) of all symbols."""
        merges = list(self.pending)

        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                x, n = _merged_words(b, merges), b.column(1).to_numpy()
                if not len(x):
                    continue
                word = np.cumsum(x == -1)
                at = np.flatnonzero(x >= 0)
                pair = at[x[at + 1] >= 0]
                left, right = np.concatenate([x[at], x[pair]]), np.concatenate([np.full(len(at), -1), x[pair + 1]])
                key, inverse = np.unique(left << 32 | right + 1, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, inverse, n[word[np.concatenate([at, pair])]])
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array((key & 0xFFFFFFFF) - 1), pa.array(total)], names=["a", "b", "n"])

        return self.now.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _in_memory(words: DataFrame, most: int) -> _Pairs | None:
    """The distinct words on the driver, if they are `most` ids at most; the fit is the same either way, without a job a round."""
    size = words.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    if size > most:
        return None
    table = words.select(F.col("ids").cast("array<int>"), F.col("n").cast("long")).toArrow().combine_chunks()
    if not table.num_rows:
        return _flat([])
    ids = table.column(0).chunk(0)
    values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return _Pairs(np.insert(values, np.cumsum(np.diff(ids.offsets.to_numpy())), -1), table.column(1).to_numpy())


def fit_bpe(words: DataFrame, base_size: int, vocab_size: int, in_memory: int = IN_MEMORY) -> list[tuple[int, int, int]]:
    """train_bpe() over the table (ids, n)."""
    if (pairs := _in_memory(words, in_memory)) is not None:
        return train_bpe(pairs, base_size, vocab_size)
    table, merges = _Words(words), []
    while len(merges) < vocab_size - base_size:
        best = table.counts().where("b >= 0 and n > 1").orderBy(F.col("n").desc(), "a", "b").limit(BEST_PAIRS).collect()
        found, touched = [], set()
        for r in best[: vocab_size - base_size - len(merges)]:
            if touched & {r["a"], r["b"]}:
                break
            touched |= {r["a"], r["b"]}
            found.append((r["a"], r["b"], base_size + len(merges) + len(found)))
        if not found:
            break
        merges += found
        table.merge(found)
    table.now.unpersist()
    return merges


def fit_wordpiece(words: DataFrame, base_size: int, vocab_size: int, in_memory: int = IN_MEMORY) -> list[tuple[int, ...]]:
    """train_wordpiece() over the table (ids, n)."""
    if (pairs := _in_memory(words, in_memory)) is not None:
        return train_wordpiece(pairs, base_size, vocab_size)
    table, pieces = _Words(words), []
    ids: dict[tuple[int, ...], int] = {}
    made: dict[int, tuple[int, ...]] = {}
    while base_size + len(pieces) < vocab_size:
        rows = table.counts().where("b < 0 or n > 1").collect()  # pairs of the vocabulary
        single = {r["a"]: r["n"] for r in rows if r["b"] < 0}
        symbol = {x: made.get(x, (x,)) for x in single}
        found = min(((-r["n"] / (single[r["a"]] * single[r["b"]]), symbol[r["a"]], symbol[r["b"]], r["a"], r["b"]) for r in rows if r["b"] >= 0), default=None)
        if found is None:
            break
        _, left, right, a, b = found
        piece = left + right
        if piece not in ids:
            ids[piece] = base_size + len(pieces)
            made[ids[piece]] = piece
            pieces.append(piece)
        table.merge([(a, b, ids[piece])])
    table.now.unpersist()
    return pieces


def fit_unigram(words: DataFrame, base_size: int, vocab_size: int, longest: int = 8, rounds: int = 4) -> dict[tuple[int, ...], float]:
    """train_unigram() over the table (ids, n)."""
    table = words.select(F.col("ids").cast("array<int>"), "n").persist()
    parts = f"flatten(transform(sequence(1, size(ids)), i -> transform(sequence(i, least(i + {longest - 1}, size(ids))), j -> slice(ids, i, j - i + 1))))"
    seen = table.select(F.explode(F.expr(parts)).alias("p"), "n").groupBy("p").agg(F.sum(F.col("n") * F.size("p")).alias("n")).persist()
    singles = {tuple(r["p"]): r["n"] for r in seen.where("size(p) = 1").collect()}
    more = {tuple(r["p"]): r["n"] for r in seen.where("size(p) > 1").orderBy(F.col("n").desc(), "p").limit(4 * vocab_size).collect()}
    seen.unpersist()
    weight = {p: float(x) for p, x in {**singles, **more}.items()}
    for r in range(rounds):
        total = sum(weight.values())
        logs = {p: math.log(x / total) for p, x in weight.items()}

        def use(batches, logs=logs):  # noqa: ANN001, ANN202
            for b in batches:
                used: Counter = Counter()
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for p in best_segmentation(w, logs, longest):
                        used[p] += n
                yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in used], pa.list_(pa.int32())), pa.array(list(used.values()), pa.int64())], names=["p", "n"])

        used = {tuple(x["p"]): x["n"] for x in table.mapInArrow(use, "p array<int>, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()}
        room = max(vocab_size - base_size, 0) if r == rounds - 1 else 2 * vocab_size
        keep = sorted((p for p in used if len(p) > 1), key=lambda p: (-used[p], p))[:room]
        weight = {p: float(used.get(p, 0)) + 0.01 for p in [*sorted(singles), *keep]}
    table.unpersist()
    total = sum(weight.values())
    return {p: math.log(x / total) for p, x in weight.items()}


class SubwordModel:
    """A trained model; encode() and decode() work on DataFrames with an `ids` column of words."""

    def __init__(self, kind: str, base_size: int, pieces: list[tuple[int, ...]], merges: list[tuple[int, int, int]] = (), scores: dict[tuple[int, ...], float] | None = None):
        self.kind, self.base_size, self.pieces, self.merges, self.scores = kind, base_size, pieces, list(merges), scores

    @classmethod
    def train(cls, words: DataFrame, kind: str, base_size: int, vocab_size: int, ids: str = "ids") -> SubwordModel:
        if vocab_size <= base_size:
            raise ValueError(f"vocab_size {vocab_size}: more than the {base_size} base ids")
        counts = word_counts(words, ids).select(F.col(f"`{ids}`").alias("ids"), "n")
        if kind == "BPE":
            merges = fit_bpe(counts, base_size, vocab_size)
            made = {i: (i,) for i in range(base_size)}
            for a, b, new in merges:
                made[new] = made[a] + made[b]
            return cls(kind, base_size, [made[new] for *_, new in merges], merges)
        if kind == "WordPiece":
            return cls(kind, base_size, fit_wordpiece(counts, base_size, vocab_size))
        if kind == "Unigram":
            scores = fit_unigram(counts, base_size, vocab_size)
            return cls(kind, base_size, [p for p in scores if len(p) > 1], scores=scores)
        raise ValueError(f"{kind}: BPE, WordPiece or Unigram")

    def __len__(self) -> int:
        return self.base_size + len(self.pieces)

    def encoder(self):  # noqa: ANN201
        """A function of one word's ids."""
        known = {p: self.base_size + i for i, p in enumerate(self.pieces)}
        longest = max(map(len, self.pieces), default=1)
        if self.kind == "BPE":
            rank = {(a, b): (i, new) for i, (a, b, new) in enumerate(self.merges)}
            return lambda ids: apply_bpe(ids, rank)
        if self.kind == "WordPiece":
            return lambda ids: longest_first(ids, known, longest)
        scores = self.scores
        return lambda ids: [p[0] if len(p) == 1 else known[p] for p in best_segmentation(ids, scores, longest)]

    def encode(self, words: DataFrame, ids: str = "ids") -> DataFrame:
        """words with `ids` encoded: each distinct word of an Arrow batch once."""
        one, columns = self.encoder(), words.columns
        at = columns.index(ids)

        def run(batches):  # noqa: ANN001, ANN202
            cache: dict[tuple, list[int]] = {}
            for b in batches:
                if len(cache) > 200_000:
                    cache.clear()
                out = []
                for w in b.iloc[:, at]:
                    key = tuple(w)
                    if key not in cache:
                        cache[key] = one(list(key))
                    out.append(cache[key])
                yield b.assign(**{ids: pd.Series(out, index=b.index, dtype=object)})

        schema = ", ".join(f"`{f.name}` {'array<int>' if f.name == ids else f.dataType.simpleString()}" for f in words.schema)
        return words.mapInPandas(run, schema)

    def decode(self, words: DataFrame, ids: str = "ids") -> DataFrame:
        """words with `ids` back as base ids: pieces are rows of two Arrow arrays, so a batch is one lookup."""
        offsets = np.concatenate([np.arange(self.base_size), self.base_size + np.cumsum([0, *map(len, self.pieces)])]).astype(np.int64)
        values = np.concatenate([np.arange(self.base_size), *[np.array(p) for p in self.pieces]]).astype(np.int32)
        columns = words.columns
        at = columns.index(ids)

        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                column = b.column(at).cast(pa.list_(pa.int32()))
                held = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = offsets[held + 1] - offsets[held]
                start = np.repeat(offsets[held] - (np.cumsum(sizes) - sizes), sizes)
                flat = values[np.arange(int(sizes.sum())) + start]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                made = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(flat, pa.int32()), mask=pc.is_null(column))
                yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(b.columns)], names=columns)

        schema = ", ".join(f"`{f.name}` {'array<int>' if f.name == ids else f.dataType.simpleString()}" for f in words.schema)
        return words.mapInArrow(run, schema)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            scores = [[list(p), x] for p, x in (self.scores or {}).items()]
            json.dump({"kind": self.kind, "base_size": self.base_size, "pieces": self.pieces, "merges": self.merges, "scores": scores}, f)

    @classmethod
    def load(cls, path: str) -> SubwordModel:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        scores = {tuple(p): x for p, x in d["scores"]} or None
        return cls(d["kind"], d["base_size"], [tuple(p) for p in d["pieces"]], [tuple(m) for m in d["merges"]], scores)
