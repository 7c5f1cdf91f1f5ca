"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, at most MAX_EPOCHS times its own words; what that cuts off goes
to the other sources by weight until none is above.  A target of e complete epochs and a fraction takes every document
e times, then documents in order of their keys until the fraction is full: key = -ln(u) / quality, with u from a hash of
the document, so that documents of higher quality tend to come first.  The document at the boundary is taken in part
(its first words), so a source's words equal its target rounded to a whole word.

Scale: keys fall into BUCKETS classes in key order, and each class into BUCKETS finer ones.  Sums of each class (partial
sums first) and their running totals locate the boundary's class, then its finer class; only the rows of that one, about
one in a million of a source, are sorted and prefix-summed, one task a source.  All other rows are decided on their own,
without a shuffle of texts.  Sources are broadcast up to BROADCAST_SOURCES of them, beyond that joined by shuffle; only
the list of sources itself, a row each, is ordered in one task.

Defined cases: null text has size 0 and takes 0; null source is a source, last in order; equal keys go by doc_id, then
size, then the text's hash, and rows equal in these are interchangeable; sources of size 0 have target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import aside, written

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, "42"
BUCKETS, BROADCAST_SOURCES = 1024, 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Mean word length, white space included, at which quality() is highest.
USUAL_WORD = 6.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1] from the mean word length: tables, lists of codes and runs of single letters weigh less."""
    return F.when(size > 0, 1.0 / (1.0 + F.abs(F.length(text) / size - USUAL_WORD))).otherwise(1.0)


def sized(docs: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """docs with __size, __key (exponential, divided by weight), __bucket and __fine (rising functions of the key) and __tie."""
    size, u = F.col("__size"), F.col("__u")
    w = quality(F.col("text"), size) if weight is None else weight
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size.cast("string"))
    out = _once(docs, "__size", size_of(F.col("text")))
    out = _once(out, "__u", (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 1.0) / float(2**52))
    out = _once(out, "__key", -F.log(u) / w)
    # each step rounds upwards or downwards with the key, so classes are in key order to the last bit
    out = _once(out, "__at", F.lit(float(BUCKETS * BUCKETS)) * (1.0 - 2.0 / (F.col("__key") + 2.0)))
    out = out.withColumn("__fine", F.least(F.floor("__at"), F.lit(BUCKETS * BUCKETS - 1)).cast("int"))
    return out.withColumns({"__bucket": F.expr(f"__fine div {BUCKETS}").cast("int"), "__tie": F.xxhash64("text")}).drop("__u", "__at")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a later filter or expression can't repeat it, as it comes out of a generator."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def plan(marked: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row a source: source_size, target, epochs, words beyond them (budget), the class at the boundary and the words before it."""
    classes = written(marked.groupBy("source", "__bucket").agg(F.sum("__size").alias("words")), "mix-classes")
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    # from here on, one row a source or fewer than BUCKETS
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    # sources fill up in order of cap / weight; those before the first that is not full are at their cap, the rest share what is left by weight
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ranked.withColumns({"before": F.coalesce(F.sum("source_size").over(fill), F.lit(0)) * max_epochs, "w_before": F.coalesce(F.sum("w").over(fill), F.lit(0.0))})
    level = level.withColumns({"total": F.sum("source_size").over(every), "w_all": F.sum("w").over(every)})
    level = level.withColumn("share", (F.col("total") - F.col("before")) / (F.col("w_all") - F.col("w_before")))
    level = level.withColumn("open", F.col("share") * F.col("w") < max_epochs * F.col("source_size"))
    level = level.withColumn("level", F.max(F.when(F.col("open"), F.struct(-F.col("before"), F.col("share")))).over(every)["share"])
    target = F.when(F.col("open"), F.col("level") * F.col("w")).otherwise((max_epochs * F.col("source_size")).cast("double"))
    made = level.select("source", "source_size", target.alias("target"))
    quota = F.floor(F.col("target") + 0.5).cast("long")
    made = made.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0).cast("long"))
    made = made.withColumn("budget", quota - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = classes.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    edge = at.alias("c").join(made.alias("s"), F.expr("c.source <=> s.source and c.before <= s.budget and s.budget < c.before + c.words"))
    edge = edge.select(F.col("c.source").alias("source"), F.col("__bucket").alias("coarse"), F.col("c.before").alias("coarse_before"), F.col("s.budget").alias("budget"))
    edge = written(edge, "mix-edges")
    # the same once more within the boundary's class
    side = edge.select(F.col("source").alias("__source"), "coarse", "coarse_before", "budget")
    inner = marked.join(F.broadcast(side) if edge.count() <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("coarse")))
    fine = inner.groupBy("source", "__fine").agg(F.sum("__size").alias("words"), F.first("coarse_before").alias("coarse_before"), F.first("budget").alias("budget"))
    running = Window.partitionBy("source").orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.col("coarse_before") + F.coalesce(F.sum("words").over(running), F.lit(0)))
    fine = fine.where("before <= budget and budget < before + words").select("source", F.col("__fine").alias("edge"), F.col("before").alias("edge_before"))
    return written(made.alias("s").join(fine.alias("e"), F.expr("s.source <=> e.source"), "left").select("s.*", "e.edge", "e.edge_before"), "mix-plan")


def mix(marked: DataFrame) -> DataFrame:
    """The rows of sized() with size, source_size, target, taken, __epochs and __part: each document `__epochs` times whole and its first `__part` words once more."""
    sources = plan(marked.select("source", "__bucket", "__fine", "__size"))
    side = sources.select(F.col("source").alias("__source"), "source_size", "target", "epochs", "budget", "edge", "edge_before")
    if sources.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    rows = marked.join(side, F.col("source").eqNullSafe(F.col("__source")))
    plain = rows.where(~F.col("__fine").eqNullSafe(F.col("edge"))).withColumn("__part", F.when((F.col("budget") > 0) & (F.col("__fine") < F.coalesce("edge", F.lit(BUCKETS * BUCKETS))), F.col("__size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("source").orderBy("__key", "doc_id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("__fine = edge").withColumn("__seen", F.col("edge_before") + F.coalesce(F.sum("__size").over(order), F.lit(0)))
    edge = edge.withColumn("__part", F.least(F.greatest(F.col("budget") - F.col("__seen"), F.lit(0)), F.col("__size")).cast("long")).drop("__seen")
    out = plain.unionByName(edge).withColumn("taken", F.col("epochs") * F.col("__size") + F.col("__part"))
    return out.withColumnsRenamed({"__size": "size", "epochs": "__epochs"}).drop("__key", "__bucket", "__fine", "__tie", "__source", "budget", "edge", "edge_before")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: docs' columns, a row for each time a document is taken; the document at a source's boundary once with its first words.

    n_chars, if there, becomes the length of the text; other columns stay as they are.
    """
    named, back = aside(docs, ("doc_id", "source", "text"))
    # words and the white space before them, up to the last word taken
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    cut = F.when(F.col("__part") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("__part").cast("int")), "")).otherwise(F.col("text"))
    times = F.concat(F.array_repeat(F.col("text"), F.col("__epochs").cast("int")), F.when(F.col("__part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    taken = mix(sized(named)).where("taken > 0").select(*[c for c in named.columns if c != "text"], F.explode(times).alias("text"))
    out = taken.withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op9(docs: DataFrame) -> DataFrame:
    marked = written(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")  # texts are read once
    return mix(marked).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size), 1, 13) AS BIGINT) + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE)
             / CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(length(text)::DOUBLE / size - 6.0::DOUBLE)) ELSE 1.0::DOUBLE END AS key FROM s),
w AS (SELECT source, sum(size)::BIGINT AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM k GROUP BY source),
f AS (SELECT *, 3 * coalesce(sum(source_size) OVER a, 0) AS before, coalesce(sum(w) OVER a, 0) AS w_before, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
      FROM w WINDOW a AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - before)::DOUBLE / (w_all - w_before) AS share FROM f),
h AS (SELECT *, share * w < 3 * source_size AS open FROM g),
t AS (SELECT source, source_size, CASE WHEN open THEN first_value(share) OVER (ORDER BY open DESC, before) * w ELSE 3.0::DOUBLE * source_size END AS target FROM h),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, CAST(floor(p.target + 0.5) AS BIGINT) - p.epochs * p.source_size AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
      FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, CAST(epochs * size + least(greatest(budget - seen, 0), size) AS BIGINT) AS taken FROM r
"""
