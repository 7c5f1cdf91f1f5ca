"""Splitting scores and sequences into parts of a size for training, and putting scores together."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.config import DRUMS_PITCH_RANGE, INSTRUMENT_CLASSES, instrument_class, tessitura
from tactus.operators import grid
from tactus.sources.tables import Score


def subsequences(rows: DataFrame, ids: str, max_len: int, min_len: int = 1) -> DataFrame:
    """A row for each chunk of max_len ids; a last chunk of min_len ids or fewer is left out."""
    starts = F.expr(f"if(size({ids}) > {min_len}, sequence(0, size({ids}) - {min_len} - 1, {max_len}), array())")
    return rows.select("*", F.posexplode(F.transform(starts, lambda i: F.slice(ids, i + 1, max_len))).alias("chunk", "part")).drop(ids).withColumnRenamed("part", ids)


def with_special(ids: Column, max_len: int, bos: int | None = None, eos: int | None = None) -> Column:
    """Ids cut to max_len less the special ids, BOS before, EOS after if nothing was cut.  Id 0 is an id like any other."""
    room = max_len - (bos is not None) - (eos is not None)
    head = [F.array(F.lit(bos))] if bos is not None else []
    tail = [F.when(F.size(ids) <= room, F.array(F.lit(eos))).otherwise(F.array().cast("array<int>"))] if eos is not None else []
    return F.concat(*head, F.slice(ids, 1, room), *tail)


def per_beats(notes: DataFrame, ticks_per_beat: int, beats: int) -> DataFrame:
    """Notes with part, the n-th stretch of so many beats of one length, and ticks from its beginning; ends are not cut."""
    span = ticks_per_beat * beats
    part = F.floor(F.col("tick") / span).cast("long")
    return notes.withColumn("part", part).withColumn("tick", F.col("tick") - F.col("part") * span)


def beat_parts(score: Score, beats: int, least: int = 1) -> DataFrame:
    """(score_id, part, start, stop): stretches of so many beats, as the time signatures have them, to the last onset; a last one of fewer than `least` beats is left out."""
    signatures = score.time_sigs if score.time_sigs is not None else default_signatures(score.notes)
    ends = grid.last_onsets(score.notes, score.tempos, signatures, score.pedals, score.bends)
    ticks = grid.grid_ticks(signatures, ends, score.tpq, beats=True, only_onsets=True)
    parts = ticks.groupBy("score_id", F.floor(F.col("idx") / beats).cast("int").alias("part")).agg(F.min("tick").alias("start"), F.count("*").alias("n"))
    stop = F.lead("start").over(Window.partitionBy("score_id").orderBy("part"))
    return parts.withColumn("stop", F.coalesce(stop, F.lit(2**62))).where(F.col("n") >= least).select("score_id", "part", "start", "stop")


def tick_parts(scores: DataFrame, cuts: list[int]) -> DataFrame:
    """(score_id, part, start, stop) of scores (score_id) cut at the same ticks."""
    at = [0, *sorted(cuts), 2**62]
    rows = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop")) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))])
    return scores.select("score_id", F.explode(rows).alias("p")).select("score_id", "p.*")


def bar_parts(chunks: DataFrame, time_sigs: DataFrame, tpq: int) -> DataFrame:
    """(score_id, part, start, stop) of chunks (score_id, chunk, first_bar, last_bar)."""
    rows = chunks.join(grid.sections(time_sigs, tpq), "score_id")
    start = lambda bar: grid.bar_start(grid.section_of_bar(bar), bar, tpq)
    return rows.select("score_id", F.col("chunk").alias("part"), start(F.col("first_bar").cast("long")).alias("start"), start((F.col("last_bar") + 1).cast("long")).alias("stop"))


def default_signatures(notes: DataFrame) -> DataFrame:
    return notes.select("score_id").distinct().select("score_id", F.lit(0).cast("long").alias("tick"), F.lit(4).alias("num"), F.lit(4).alias("den"))


def split_score(score: Score, parts: DataFrame) -> Score:
    """The tables of a score with `part`, ticks from the beginning of the part; parts (score_id, part, start, stop) may overlap.

    What begins within a part is in it, ends are not cut.  The tempo and the time signature in force where a part begins
    stand at its tick 0.
    """
    held = parts.groupBy("score_id").agg(F.collect_list(F.struct("part", "start", "stop")).alias("__parts"))

    def cut(df: DataFrame | None, in_force: bool = False) -> DataFrame | None:
        if df is None:
            return None
        inside = lambda p: (p["start"] <= F.col("tick")) & (F.col("tick") < p["stop"])
        if in_force:
            until = F.coalesce(F.lead("tick").over(Window.partitionBy("score_id").orderBy("tick")), F.lit(2**62))
            df_ = df.withColumn("__until", until)
            inside = lambda p: (F.col("tick") < p["stop"]) & (p["start"] < F.col("__until"))
        else:
            df_ = df
        rows = df_.join(held, "score_id").withColumn("__p", F.explode(F.filter("__parts", inside)))
        return rows.withColumn("tick", F.greatest(F.col("tick") - F.col("__p.start"), F.lit(0))).select(*df.columns, F.col("__p.part").alias("part"))

    return dataclasses.replace(score, notes=cut(score.notes), tempos=cut(score.tempos, True), time_sigs=cut(score.time_sigs, True), pedals=cut(score.pedals), bends=cut(score.bends))


def per_ticks(notes: DataFrame, cuts: list[int]) -> DataFrame:
    """Notes with part, the number of cuts at or before their tick, and ticks from the beginning of the part."""
    at = F.array(F.lit(0), *[F.lit(c) for c in sorted(cuts)])
    before = F.filter(at, lambda c: c <= F.col("tick"))
    return notes.withColumn("part", F.size(before) - 1).withColumn("tick", F.col("tick") - F.element_at(before, -1))


def per_tracks(notes: DataFrame) -> DataFrame:
    """A score a track: part is its place among the score's tracks."""
    return notes.withColumn("part", F.dense_rank().over(Window.partitionBy("score_id").orderBy("track_idx")) - 1)


def tokens_per_note(lengths: DataFrame, notes: DataFrame, most: int | None = None) -> DataFrame:
    """Average of n_tokens / n_notes over all scores, or the first `most`; lengths: (score_id, n_tokens)."""
    counted = notes.groupBy("score_id").agg(F.count("*").alias("n_notes")).join(lengths, "score_id")
    counted = counted if most is None else counted.orderBy("score_id").limit(most)
    return counted.agg(F.avg(F.col("n_tokens") / F.col("n_notes")).alias("tokens_per_note"))


def density_chunks(per_bar: DataFrame, max_len: int, tokens_per_note: float, overlap: int = 1, min_len: int | None = None) -> DataFrame:
    """(score_id, chunk, first_bar, last_bar) from (score_id, bar, n_notes): bars are added until their tokens pass max_len.

    The cut is after that bar, or before it if there is no overlap and less than half of it still fits; the next chunk
    begins `overlap` bars before the end, or one bar after its own beginning at least, and right at the end after a bar
    that is too long alone.  Only the last chunk, which ends with the score, may be too short (min_len, a quarter of
    max_len by default) and then goes.  A fold over each score's array of running sums: the tokens of a chunk are the
    difference of two, so the state is where the chunk begins and the cuts so far.
    """
    if overlap < 0:
        raise ValueError("overlap is 0 or more")
    least = max_len / 4 if min_len is None else min_len
    least = int(least) if min_len is None else least
    sums = per_bar.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bar", "n_notes"))), lambda b: b["n_notes"]).alias("n"))
    sums = sums.withColumn("sums", F.aggregate("n", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x * float(tokens_per_note)))))
    bars = F.size("n")
    upto = lambda i: F.get("sums", i)  # noqa: E731  tokens of the bars before bar i
    begin = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<first:int,last:int>>").alias("cuts"))

    def step(state: Column, at: Column) -> Column:
        start = state["start"]
        alone = at == start
        spare = max_len - (upto(at) - upto(start))
        before = ~alone & F.lit(overlap == 0) & (spare < (upto(at + 1) - upto(at)) / 2)
        stop = F.when(before, at).otherwise(at + 1)
        cut = (upto(at + 1) - upto(start) > max_len) & (stop < bars)
        after = F.greatest(start + 1, stop - F.when(alone, 0).otherwise(overlap))
        longer = F.concat(state["cuts"], F.array(F.struct(start.alias("first"), (stop - 1).alias("last"))))
        return F.when(cut, F.struct(after.alias("start"), longer.alias("cuts"))).otherwise(state)

    done = sums.withColumn("end", F.aggregate(F.sequence(F.lit(0), bars - 1), begin, step))
    rest = F.struct(F.col("end.start").alias("first"), (bars - 1).alias("last"))
    kept = F.when(upto(bars) - upto(F.col("end.start")) >= least, F.concat("end.cuts", F.array(rest))).otherwise(F.col("end.cuts"))
    return done.select("score_id", F.posexplode(kept).alias("chunk", "c")).select("score_id", "chunk", F.col("c.first").alias("first_bar"), F.col("c.last").alias("last_bar"))


def concat_scores(notes: DataFrame, order: str, keys: list[str], ends: DataFrame) -> DataFrame:
    """Scores of each group one after the other: ticks shifted by the ends of those before.  ends: (keys, order, end)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shifts = ends.withColumn("shift", F.coalesce(F.sum("end").over(w), F.lit(0)))
    return notes.join(shifts.drop("end"), [*keys, order]).withColumn("tick", F.col("tick") + F.col("shift")).drop("shift")


def merge_per_class(
    notes: DataFrame,
    most: int | dict[int, int] | None = None,
    filter_pitches: bool = True,
    classes: list[int] | None = None,
    programs: dict[int, int] | None = None,
    valid_programs: list[int] | None = None,
) -> DataFrame:
    """Tracks of one instrument class become one, its program the first of the class, or that of `programs`; notes out of its range go.

    classes: those that are merged (all by default; drums are class 16).  most: of a merged class so many tracks stay,
    those with the most notes, for all classes or by class.  valid_programs: tracks of other programs go first; drums
    are program -1.
    """
    for c, p in (programs or {}).items():
        if instrument_class(p) != c:
            raise ValueError(f"program {p} is not of class {c}, {INSTRUMENT_CLASSES[c]}")
    drum = F.col("is_drum")
    own = F.when(drum, -1).otherwise(F.col("program")).cast("int")
    rows = notes.withColumn("program", own)
    if valid_programs is not None:
        rows = rows.where(F.col("program").isin(*valid_programs))
    low, high = (F.array(*[F.lit(tessitura(p)[i]) for p in range(128)]) for i in (0, 1))
    rows = rows.withColumn("inst_class", F.when(drum, 16).otherwise(F.floor(F.col("program") / 8)).cast("int"))
    merged = F.lit(True) if classes is None else F.col("inst_class").isin(*classes)
    if most is not None:
        limits = most if isinstance(most, dict) else dict.fromkeys(range(17), most)
        limit = F.coalesce(*[F.when(F.col("inst_class") == c, F.lit(n)) for c, n in limits.items()], F.lit(2**31 - 1))
        counts = rows.groupBy("score_id", "inst_class", "track_idx").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("score_id", "inst_class").orderBy(F.col("n").desc(), "track_idx"))
        rows = rows.join(counts.withColumn("r", rank).where(~merged | (F.col("r") <= limit)).select("score_id", "inst_class", "track_idx"), ["score_id", "inst_class", "track_idx"], "left_semi")
    first = F.min("track_idx").over(Window.partitionBy("score_id", "inst_class"))
    program = F.coalesce(*[F.when(F.col("inst_class") == c, F.lit(p)) for c, p in (programs or {}).items()], F.when(drum, -1).otherwise(F.col("inst_class") * 8)).cast("int")
    rows = rows.withColumns({"track_idx": F.when(merged, first).otherwise(F.col("track_idx")), "program": F.when(merged, program).otherwise(F.col("program"))})
    if filter_pitches:
        at = F.greatest("program", F.lit(0))
        rows = rows.where(F.when(drum, F.col("pitch").between(*DRUMS_PITCH_RANGE)).otherwise(F.col("pitch").between(F.get(low, at), F.get(high, at))))
    return rows.drop("inst_class")


def bar_and_positions(ids: Column, bar_id: int, position_ids: list[int]) -> Column:
    """struct(bars, positions): how many bars a sequence has, and how many positions after the last of them."""
    last = F.size(ids) - F.array_position(F.reverse(ids), F.lit(bar_id)).cast("int") + 1
    bars = F.size(F.filter(ids, lambda i: i == bar_id))
    after = F.when(bars > 0, F.slice(ids, last + 1, F.size(ids))).otherwise(ids)
    return F.struct(bars.alias("bars"), F.size(F.filter(after, lambda i: i.isin(*position_ids))).alias("positions"))
