"""SimHash near-duplicates: 64-bit fingerprints, linked at 2 or fewer differing bits by anchor-point covering.

Fingerprints: a text's words (A-Z lower-cased, split at ASCII white space) give 3-word shingles, repeats included; bit i
is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).

Links: the anchors are the direct sum of two binary Golay codes [23, 12] over bits 0-22 and 23-45, 2^24 codewords.  The
Golay code is perfect with covering radius 3, so every fingerprint has exactly one anchor within radius 3 of each half:
its home.  If x and y differ in at most t bits, y lies within 3 + t1 and 3 + t2 of the two halves of x's home, with
t1 + t2 <= t, so y is replicated to every anchor within covering radius plus threshold (61 on average for t = 2) and
compared with the fingerprints whose home is there.  Every pair within t meets; none is lost and no bucket is capped.
Only distinct fingerprints take part, so copies never meet each other.

Components: alternating large-star and small-star rounds over the links, each written to the shared folder, until
nothing changes.  A component's id is its smallest doc_id.

Defined cases: null or empty text, or white space alone: fingerprint 0, linked like any other; null doc_id counts as
the largest id; repeated rows each get a row; an empty table gives no rows; extra columns are left out by
near_duplicates() and kept by keep_one_per_group().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import map_text, remove, written

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Shingles whose bits are counted at once.
BLOCK = 32_768
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
HALF = 23
MASK = (1 << HALF) - 1
NO_ID = 2**63 - 1
#: Rows of one fingerprint from which its component is broadcast; rows / HOT of them at most.
HOT = 1_000_000


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: both are ASCII only
    n = max(len(words) - SHINGLE + 1, 1)
    if not words:
        return 0
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        parts = [b" ".join(words[i : i + SHINGLE]) for i in range(at, min(n, at + BLOCK))]
        h = np.fromiter((hashed(p, SEED) for p in parts), dtype=np.uint64, count=len(parts))
        ones += _bit_counts(h)
    bits = np.flatnonzero(2 * ones > n)
    return sum(1 << int(i) for i in bits)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of h have each bit, bit 0 first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `fp` (long, the 64 bits as they are)."""

    def start():
        def make(texts: list) -> dict[str, list]:
            fps = np.array([fingerprint(t or b"") for t in texts], dtype=np.uint64)
            return {"fp": pa.array(fps.view(np.int64), pa.int64())}

        return make

    return map_text(docs, F.col("text").cast("binary"), keep, "fp long", start)


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: the words modulo the generator polynomial."""
    out = words.copy()
    for bit in range(HALF - 1, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


_tables: list = []


def _patterns() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The syndrome of each of 23 bits' words by two bytes and more; for weights 3 (at most), 4 and 5 the error patterns in order of syndrome, and where each syndrome's begin."""
    if not _tables:
        by_weight = []
        for weights in ((0, 1, 2, 3), (4,), (5,)):
            e = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(HALF), w)], dtype=np.int64)
            s = _remainders(e)
            order = np.argsort(s, kind="stable")
            by_weight.append((e[order], np.searchsorted(s[order], np.arange(2**11 + 1))))
        _tables.append((_remainders(np.arange(2**12, dtype=np.int64) << 11), by_weight))
    return _tables[0]


def _codewords(word: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for all codewords at distance 3 or less (level 0), 4 (1) or 5 (2) of each word."""
    high, by_weight = _patterns()
    errors, begin = by_weight[level]
    syndrome = high[word >> 11] ^ (word & 0x7FF)
    first, n = begin[syndrome], begin[syndrome + 1] - begin[syndrome]
    row = np.repeat(np.arange(len(word)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    return row, word[row] ^ errors[at]


def anchors(fp: np.ndarray, t: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor within covering radius plus t, shared between the halves, of each fingerprint."""
    low, high = (fp & MASK).astype(np.int64), (fp >> HALF & MASK).astype(np.int64)
    a, b = [_codewords(low, k) for k in range(t + 1)], [_codewords(high, k) for k in range(t + 1)]
    out = []
    for i in range(t + 1):
        for j in range(t + 1 - i):
            (ra, ca), (rb, cb) = a[i], b[j]
            nb = np.bincount(rb, minlength=len(fp))
            first = np.cumsum(nb) - nb
            row = np.repeat(ra, nb[ra])
            at = np.arange(len(row)) - np.repeat(np.cumsum(nb[ra]) - nb[ra], nb[ra]) + first[row]
            out.append((row, np.repeat(ca, nb[ra]) | cb[at] << HALF, np.full(len(row), i + j == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(distinct: DataFrame, t: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints `fp` that differ in t bits at most; each may come more than once."""

    def replicate(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 2_000):
                part = fps[i : i + 2_000]
                row, anchor, home = anchors(part.view(np.uint64), t)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])

    def homes(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            _, anchor, home = anchors(fps.view(np.uint64), 0)
            assert home.all() and len(anchor) == len(fps)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps)], names=["anchor", "fp"])

    home = distinct.select("fp").mapInArrow(homes, "anchor long, fp long").alias("x")
    near = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean").alias("y")
    far = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    return home.join(near.hint("merge"), F.expr("x.anchor = y.anchor and x.fp != y.fp") & (far <= t)).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have an edge (a, b); root is the smallest node of the component."""
    spark = edges.sparkSession
    now = written(edges.select("a", "b").distinct(), "links")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        # large star: larger neighbours go to the smallest of the neighbours and the node itself
        m = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest neighbour; here u > v in every row
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("m")), F.struct(F.col("u").alias("x"), F.col("m").alias("m")))).alias("e"))
        new = written(small.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a != b").distinct(), "links")
        same = now.select("a", "b").exceptAll(new).isEmpty() and now.count() == new.count()
        remove(spark, now)
        now = new
        if same:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = (), root: bool = False) -> DataFrame:
    """(doc_id, `keep`, fp, component_id) of every row, and if asked for its component's smallest fingerprint, `__root`."""
    made = written(fingerprints(docs, ("doc_id", *keep)), "fingerprints")
    ids = made.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.count("*").alias("n"))
    ids = written(ids, "distinct-fingerprints")
    roots = components(links(ids))
    rooted = ids.join(roots, ids.fp == roots.node, "left").select("fp", "id", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = written(rooted.join(least, "root").select("fp", "n", "component", F.col("root").alias("__root")), "fingerprint-components")
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    # a fingerprint of very many rows would meet them all in one task
    hot, rest = F.broadcast(named.where(F.col("n") >= HOT)), named.where(F.col("n") < HOT)
    joined = made.join(hot, "fp").unionByName(made.join(hot, "fp", "left_anti").join(rest, "fp")) if not named.where(F.col("n") >= HOT).isEmpty() else made.join(rest, "fp")
    return joined.select("doc_id", *keep, "fp", component.alias("component_id"), *(["__root"] if root else []))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of the smallest doc_id, null last, the row of smallest hash, one of repeated rows.

    Components are told apart by their smallest fingerprint, so a doc_id that is null, or repeated with unlike texts,
    stands for as many rows as it has components.
    """
    rest = [c for c in docs.columns if c != "doc_id"]
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in rest])
    found = near_duplicates(docs.withColumn("__row", row_hash), ("__row",), root=True)
    rows = found.groupBy("__root", "doc_id", "__row").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("__row").alias("kept"), "n")).alias("least")
    kept = rows.groupBy("__root").agg(least).select(F.col("least.id").alias("__id"), F.col("least.kept").alias("__kept"), F.col("least.n").alias("__n"))
    kept = written(kept, "kept")
    left = docs.withColumn("__row", row_hash)
    out = left.join(kept, left.doc_id.eqNullSafe(kept["__id"]) & (left["__row"] == kept["__kept"]), "left_semi")
    # repeated rows are rare, and only then is a second shuffle of the texts needed
    return (out if kept.where("__n > 1").isEmpty() else out.dropDuplicates(["doc_id", "__row"])).drop("__row")


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
