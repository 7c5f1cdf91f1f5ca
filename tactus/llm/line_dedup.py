"""Exact line deduplication by range-partitioned hashes, with DataFrame functions only.

Each line becomes (hash, document, position): 128 bits of hash of its key, the line stripped of ASCII white space at
both ends with A-Z lower-cased.  The rows are range-partitioned by (hash, document), so that a line that a third of
all documents share spreads over many partitions, and sorted by position within.  A running row number marks the first
occurrence in each document as it streams by; first occurrences are counted per hash with partial sums, so a hash costs
one row a partition.  What goes back to the documents is not text but one bitmap a document: its words of 32 lines,
bit 1 for a line to drop, words without such a bit left out.

Defined cases: null or empty text is one empty line; a key without code points never counts; a row with the same
doc_id (null too) and the same text as another is the same document; distinct texts under one doc_id are two
documents; extra columns stay as they are.  If no line is dropped a text is unchanged (null becomes empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import ASCII_SPACE, lower_ascii, written

#: Frequent keys up to which they are broadcast (16 bytes each, 40 more with a first place); beyond, they are joined by shuffle,
#: but for the HOT ones, which are found in so many documents that no more than lines / HOT_DOCS of them can be there.
BROADCAST_KEYS, HOT_DOCS = 1_000_000, 1_000_000
DOC = ("__doc", "__hash")


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__doc": F.col("doc_id"), "__hash": F.xxhash64(text)})


def line_table(docs: DataFrame) -> DataFrame:
    """(document, position, h1, h2) of every line whose key has a code point."""
    stripped = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))
    keys = F.transform(stripped, lower_ascii)  # before the explode, so that a key is made once for its three uses
    lines = _identified(docs).select(*DOC, F.posexplode(keys).alias("pos", "key")).where(F.length("key") > 0)
    return lines.select(*DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Per document with a line to drop: `__drop`, a map from word number to 32 bits.

    Lines whose key is found in `min_docs` documents go; with keep_first, all but the first in order of document and position.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = written(line_table(docs), "lines")  # read three times: for the ranges, for the counts and for the bitmaps
    ranged = lines.repartitionByRange(n, "h1", "h2", *DOC).sortWithinPartitions("h1", "h2", *DOC, "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", *DOC).orderBy("pos"))
    seen = ranged.withColumn("is_first", (first == 1).cast("long"))
    place = F.struct(*DOC, "pos")
    often = seen.groupBy("h1", "h2").agg(F.sum("is_first").alias("n_docs"), *([F.min(place).alias("first_place")] if keep_first else []))
    often = written(often.where(F.col("n_docs") >= min_docs), "frequent-lines")
    keys = often.drop("n_docs")
    if often.count() <= BROADCAST_KEYS:
        hit = lines.join(F.broadcast(keys), ["h1", "h2"])
    else:
        hot, rest = F.broadcast(keys.where(often["n_docs"] >= HOT_DOCS)), keys.where(often["n_docs"] < HOT_DOCS)
        hit = lines.join(hot, ["h1", "h2"]).unionByName(lines.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    if keep_first:
        hit = hit.where(~place.eqNullSafe(F.col("first_place")))
    words = hit.groupBy(*DOC, F.expr("pos div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 32)")).alias("bits"))
    return words.groupBy(*DOC).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__drop"))


#: The bitmap's words in order, words left out as 0, so that each line finds its own at once; then the lines whose bit is 0.
DENSE = "transform(sequence(0, (size(__lines) - 1) div 32), w -> coalesce(__drop[bigint(w)], 0L))"
KEPT = "array_join(filter(__lines, (x, i) -> (shiftright(__dense[i div 32], i % 32) & 1) = 0), '\n')"


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with `text` without its dropped lines, and n_lines and n_dropped."""
    left = _identified(docs)
    marks = drop_bitmaps(docs, min_docs, keep_first)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in DOC]
    joined = left.alias("d").join(marks.alias("m"), same[0] & same[1], "left").select(*[F.col(f"d.`{c}`") for c in left.columns], "m.__drop")
    joined = joined.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("__lines", F.split("text", "\n", -1))
    dropped = F.coalesce(F.aggregate(F.map_values("__drop"), F.lit(0), lambda a, w: a + F.bit_count(w)), F.lit(0)).cast("long")
    out = joined.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": dropped})
    out = out.withColumn("__dense", F.expr(f"if(n_dropped = 0, null, {DENSE})"))
    return out.withColumn("text", F.expr(f"if(n_dropped = 0, text, {KEPT})")).drop("__lines", "__drop", "__dense", *DOC)


def op5(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT DISTINCT d.doc_id, coalesce(d.text, '') AS text, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u),
often AS (SELECT key FROM lines WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10),
marked AS (SELECT l.*, o.key IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.key = o.key),
done AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
         FROM marked GROUP BY doc_id, text)
SELECT d.doc_id, n_lines, n_dropped, kept_sha256 FROM documents d JOIN done m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND coalesce(d.text, '') = m.text
"""
