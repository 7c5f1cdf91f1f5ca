"""Bars and beats: the grid that notes are counted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(time_sigs: DataFrame) -> DataFrame:
    """Time signatures of positive numbers; 4/4 from tick 0 to a score's first if that is later."""
    rows = time_sigs.where((F.col("num") > 0) & (F.col("den") > 0)).select("score_id", "tick", "num", "den")
    first = rows.groupBy("score_id").agg(F.min("tick").alias("t")).where("t > 0")
    return rows.unionByName(first.select("score_id", F.lit(0).cast("long").alias("tick"), F.lit(4).alias("num"), F.lit(4).alias("den")))


def bar_length(num: Column, den: Column, tpq: int) -> Column:
    return (F.floor(F.lit(4 * tpq) / den) * num).cast("long")


def sections(time_sigs: DataFrame, tpq: int) -> DataFrame:
    """(score_id, sections) with an ascending array of (tick, num, den, bar): the first bar of each time signature.  A bar that a change cuts off is a bar."""
    w = Window.partitionBy("score_id").orderBy("tick")
    bars = F.ceil((F.lead("tick").over(w) - F.col("tick")) / bar_length(F.col("num"), F.col("den"), tpq)).cast("long")
    first = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = time_sigs.withColumn("n", bars).withColumn("bar", first)
    return rows.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("tick", "num", "den", "bar"))).alias("sections"))


def section_at(tick: Column, name: str = "sections") -> Column:
    """The section that holds a tick: the last that begins at it or before it."""
    return F.element_at(F.filter(name, lambda s: s["tick"] <= tick), -1)


def section_of_bar(bar: Column, name: str = "sections") -> Column:
    return F.element_at(F.filter(name, lambda s: s["bar"] <= bar), -1)


def bar_start(section: Column, bar: Column, tpq: int) -> Column:
    """Tick at which a bar of a section begins."""
    return (section["tick"] + (bar - section["bar"]) * bar_length(section["num"], section["den"], tpq)).cast("long")


def with_bars(rows: DataFrame, tpq: int, time_sigs: DataFrame | None = None, tick: str = "tick", keep: bool = False) -> DataFrame:
    """rows with bar, bar_tick, num and den at their tick; all 4/4 without time signatures.  With keep, `sections` stays.

    time_sigs: of every score, the first at tick 0, as complete() or preprocessing gives them.
    """
    if time_sigs is None:
        bar = bar_of(F.col(tick), tpq)
        return rows.withColumns({"bar": bar, "bar_tick": bar * (4 * tpq), "num": F.lit(4), "den": F.lit(4)})
    s = section_at(F.col(tick))
    rows = rows.join(sections(time_sigs, tpq), "score_id").withColumn("__s", s)
    bar = F.col("__s.bar") + F.floor((F.col(tick) - F.col("__s.tick")) / bar_length(F.col("__s.num"), F.col("__s.den"), tpq)).cast("long")
    rows = rows.withColumn("bar", bar).withColumns({"bar_tick": bar_start(F.col("__s"), F.col("bar"), tpq), "num": F.col("__s.num"), "den": F.col("__s.den")})
    return rows.drop("__s", *([] if keep else ["sections"]))


def grid_ticks(time_sigs: DataFrame, ends: DataFrame, tpq: int, beats: bool = False, only_onsets: bool = False) -> DataFrame:
    """(score_id, idx, tick) of the bars, or beats, of each score up to its end.

    ends: (score_id, end), the end of the score, or its last onset with only_onsets (last_onsets()); then a bar that
    begins at the last onset counts, and a beat there does not.  A score that ends at tick 0 has one bar and one beat.
    """
    w = Window.partitionBy("score_id").orderBy("tick")
    last = F.col("end") + (1 if only_onsets and not beats else 0)
    rows = complete(time_sigs).join(ends, "score_id").where(F.col("tick") <= F.col("end"))
    rows = rows.withColumn("until", F.greatest(F.coalesce(F.lead("tick").over(w), last), F.when(F.col("end") == 0, F.lit(1)).otherwise(F.lit(0))))
    step = F.floor(F.lit(4 * tpq) / F.col("den")) if beats else bar_length(F.col("num"), F.col("den"), tpq)
    rows = rows.withColumn("step", step.cast("long")).where("step > 0 and until > tick")
    ticks = rows.select("score_id", F.explode(F.expr("sequence(tick, until - 1, step)")).alias("tick"))
    return ticks.select("score_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "tick")


def last_onsets(*tables: DataFrame | None) -> DataFrame:
    """(score_id, end): the last tick at which anything begins, of notes, tempos, time signatures, pedals and bends alike."""
    ends = [t.groupBy("score_id").agg(F.max("tick").alias("end")) for t in tables if t is not None]
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    return every.groupBy("score_id").agg(F.max("end").alias("end"))


def bar_of(tick: Column, tpq: int) -> Column:
    """Bar of a tick in 4/4."""
    return F.floor(tick / (4 * tpq)).cast("long")


def attach(rows: DataFrame, grid: DataFrame, name: str = "bar", keys: tuple[str, ...] = ("score_id",)) -> DataFrame:
    """rows (with `tick`) and the index of the last grid tick at or before theirs: an as-of join by one sort, linear in both sides."""
    marks = grid.select(*keys, "tick", F.col("idx").alias(name), F.lit(0).alias("__rank"))
    both = rows.withColumn("__rank", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("tick", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, True).over(w)).where("__rank = 1").drop("__rank")


def notes_per_bar(notes: DataFrame, tpq: int, by_track: bool = False, time_sigs: DataFrame | None = None) -> DataFrame:
    """(score_id, [track_idx,] bar, n_notes) from bar 0 to the last, empty bars too."""
    keys = ["score_id", *(["track_idx"] if by_track else [])]
    counted = with_bars(notes.select(*keys, "tick"), tpq, time_sigs).groupBy(*keys, "bar").agg(F.count("*").alias("n_notes"))
    last = counted.groupBy("score_id").agg(F.max("bar").alias("last"))
    every = (counted.select(*keys).distinct().join(last, "score_id") if by_track else last).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bar"))
    return every.join(counted, [*keys, "bar"], "left").select(*keys, "bar", F.coalesce("n_notes", F.lit(0)).alias("n_notes"))


def sections_table(time_sigs: DataFrame, ends: DataFrame, tpq: int) -> DataFrame:
    """(score_id, end_tick, tpb): stretches of equal ticks a beat, neighbours merged."""
    w = Window.partitionBy("score_id").orderBy("tick")
    rows = time_sigs.withColumn("tpb", F.floor(F.lit(4 * tpq) / F.col("den")).cast("long"))
    rows = rows.withColumn("before", F.lag("tpb").over(w)).where("before is null or before != tpb")
    return rows.join(ends, "score_id").withColumn("end_tick", F.coalesce(F.lead("tick").over(w), F.col("end"))).select("score_id", "end_tick", "tpb")
