"""Scores brought onto the grid of a vocabulary: filter, bin, regrid, deduplicate.  Doing it twice changes nothing."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.config import DEFAULT_TEMPO, TokenizerConfig
from tactus.functions.columns import duration_bins, half_even, nearest, nearest_whole, regrid
from tactus.operators.grid import section_at, sections
from tactus.sources.tables import Score

TRACK = ("score_id", "track_idx")


def in_pitch_range(notes: DataFrame, config: TokenizerConfig) -> DataFrame:
    """Both ends belong to a range; drums have their own."""
    (lo, hi), (dlo, dhi) = config.pitch_range, config.drums_pitch_range if config.use_pitchdrum_tokens else config.pitch_range
    return notes.where(F.when(F.col("is_drum"), F.col("pitch").between(dlo, dhi)).otherwise(F.col("pitch").between(lo, hi)))


def nearest_velocity(velocity: Column, config: TokenizerConfig) -> Column:
    return nearest_whole(velocity, config.velocities, "int")


def nearest_duration(dur: Column, config: TokenizerConfig, tpb: int) -> Column:
    return nearest_whole(dur, sorted({t for _, t in duration_bins(config, tpb)}))


def align_time_signatures(time_sigs: DataFrame, config: TokenizerConfig, tpq: int, new_tpq: int | None = None) -> DataFrame:
    """Supported time signatures, each pushed to the next bar line of the one before; the last of a tick counts; one at tick 0.

    A bar line depends on where the change before it has been pushed, so this is a fold over each score's few changes.
    """
    new_tpq = new_tpq or config.tpq
    known = F.lit(False)
    for n, d in config.time_signatures:
        known = known | ((F.col("num") == n) & (F.col("den") == d))
    ticks = F.floor(F.col("tick") * float(new_tpq) / float(tpq)).cast("long")
    rows = time_sigs.where(known).withColumn("tick", ticks)
    changes = rows.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("tick", "num", "den"))).alias("changes"))
    drop_equal = config.delete_equal_successive_time_sig_changes
    num, den = (4, 4)
    start = F.array(F.struct(F.lit(0).cast("long").alias("tick"), F.lit(num).alias("num"), F.lit(den).alias("den")))

    def add(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        bar = last["num"] * (4 * new_tpq) / last["den"]
        at = (last["tick"] + F.ceil((c["tick"] - last["tick"]) / bar) * bar).cast("long")
        new = F.struct(at.alias("tick"), c["num"].alias("num"), c["den"].alias("den"))
        same_tick = at == last["tick"]
        kept = F.when(same_tick, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(new))).otherwise(F.concat(done, F.array(new)))
        equal = (last["num"] == c["num"]) & (last["den"] == c["den"])
        return F.when(equal & (same_tick | F.lit(drop_equal)), done).otherwise(kept)

    return changes.select("score_id", F.explode(F.aggregate("changes", start, add)).alias("c")).select("score_id", "c.*")


def preprocess_tempos(tempos: DataFrame, config: TokenizerConfig, tpq: int, new_tpq: int | None = None) -> DataFrame:
    """Nearest tempo in time per quarter; the last of a tick counts; a tempo at tick 0."""
    bins = sorted(config.tempos, reverse=True)
    spans = [6e7 / t for t in bins]
    by_span = F.create_map(*[F.lit(x) for s, t in zip(spans, bins, strict=True) for x in (s, t)])
    rows = tempos.select("score_id", regrid(F.col("tick"), tpq, new_tpq or config.tpq).alias("tick"), F.col("tick").alias("raw"), (F.lit(6e7) / F.col("qpm")).alias("span"), "qpm")
    rows = rows.withColumn("qpm", F.element_at(by_span, nearest(F.col("span"), spans, "double")))
    last = F.row_number().over(Window.partitionBy("score_id", "tick").orderBy(F.col("raw").desc(), F.col("span").desc()))
    rows = rows.withColumn("n", last).where("n = 1").select("score_id", "tick", "qpm")
    first = rows.groupBy("score_id").agg(F.min("tick").alias("t")).where("t > 0").select("score_id", F.lit(0).cast("long").alias("tick"), nearest_tempo(DEFAULT_TEMPO, config).alias("qpm"))
    rows = rows.unionByName(first)
    if config.delete_equal_successive_tempo_changes:
        before = F.lag("qpm").over(Window.partitionBy("score_id").orderBy("tick"))
        rows = rows.withColumn("b", before).where("b is null or b != qpm").drop("b")
    return rows


def nearest_tempo(qpm: float, config: TokenizerConfig) -> Column:
    return F.lit(min(config.tempos, key=lambda t: abs(t - qpm)))


def preprocess_notes(notes: DataFrame, config: TokenizerConfig, tpq: int, time_sigs: DataFrame | None = None) -> DataFrame:
    """(score_id, track_idx, program, is_drum, tick, dur, pitch, velocity, ord).

    ord is the place in the track by (tick, pitch, dur, velocity): equal rows are interchangeable, so it decides every order.
    """
    f = in_pitch_range(notes, config)
    f = f.withColumns({"velocity": nearest_velocity(F.col("velocity"), config), "end": F.col("tick") + F.col("dur")})
    f = f.withColumns({"tick": regrid(F.col("tick"), tpq, config.tpq), "dur": regrid(F.col("dur"), tpq, config.tpq)})
    if time_sigs is None:
        f = f.withColumn("dur", F.greatest("dur", F.lit(1)))
        f = f.withColumn("dur", nearest_duration(F.col("dur"), config, config.tpb(4)))
    else:
        f = f.join(sections(time_sigs, config.tpq), "score_id").withColumn("den", section_at(F.col("tick"))["den"])
        dens = sorted({d for _, d in config.time_signatures})
        step = F.coalesce(*[F.when(F.col("den") == d, F.lit(config.tpb(d) // config.max_res)) for d in dens])
        f = f.withColumn("step", step).withColumns({"tick": half_even(F.col("tick") / F.col("step")) * F.col("step"), "dur": F.greatest(half_even(F.col("dur") / F.col("step")), F.lit(1)) * F.col("step")})
        f = f.withColumn("dur", F.coalesce(*[F.when(F.col("den") == d, nearest_duration(F.col("dur"), config, config.tpb(d))) for d in dens]))
    f = f.select(*TRACK, F.when(F.col("is_drum"), -1).otherwise(F.col("program")).alias("program"), "is_drum", "tick", "dur", "pitch", "velocity")
    f = f.where(F.col("program").isin(*config.programs)) if len(config.programs) < 129 else f
    order = Window.partitionBy(*TRACK).orderBy("tick", "pitch", "dur", "velocity")
    f = f.withColumn("ord", F.row_number().over(order).cast("long"))
    return deduplicated(f) if config.remove_duplicated_notes else f


def deduplicated(notes: DataFrame, with_duration: bool = False) -> DataFrame:
    """Of adjacent notes of one tick and pitch (and duration) the first."""
    order = Window.partitionBy(*TRACK).orderBy(*(("tick", "pitch", "dur", "ord") if with_duration else ("tick", "pitch", "ord")))
    same = (F.lag("tick").over(order) == F.col("tick")) & (F.lag("pitch").over(order) == F.col("pitch"))
    if with_duration:
        same = same & (F.lag("dur").over(order) == F.col("dur"))
    return notes.withColumn("same", same).where(~F.coalesce("same", F.lit(False))).drop("same")


def without_overlaps(notes: DataFrame) -> DataFrame:
    """Notes end at the latest where the next of their pitch begins."""
    order = Window.partitionBy(*TRACK, "pitch").orderBy("tick", "dur", "velocity")
    return notes.withColumn("dur", F.least(F.col("dur"), F.coalesce(F.lead("tick").over(order) - F.col("tick"), F.col("dur"))))


def merge_same_program(notes: DataFrame) -> DataFrame:
    """Tracks of one program become the first of them."""
    same = Window.partitionBy("score_id", F.when(F.col("is_drum"), -1).otherwise(F.col("program")))
    return notes.withColumn("track_idx", F.min("track_idx").over(same))


def merge_same_program_tracks(score: Score) -> Score:
    """merge_same_program() for notes, pedals and bends alike.  A track without notes has no program and stays as it is."""
    if score.pedals is None and score.bends is None:
        return dataclasses.replace(score, notes=merge_same_program(score.notes))
    tracks = score.notes.groupBy(*TRACK).agg(F.max("is_drum").alias("is_drum"), F.min("program").alias("program"))
    first = merge_same_program(tracks.withColumn("own", F.col("track_idx"))).select("score_id", F.col("own").alias("track_idx"), F.col("track_idx").alias("first"))
    return moved(dataclasses.replace(score, notes=merge_same_program(score.notes)), first, notes=False)


def moved(score: Score, first: DataFrame, notes: bool = True) -> Score:
    """The score with the tracks of its pedals, bends and notes renumbered by (score_id, track_idx, first)."""

    def move(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        return df.join(first, list(TRACK), "left").withColumn("track_idx", F.coalesce("first", "track_idx")).select(*df.columns)

    return dataclasses.replace(score, pedals=move(score.pedals), bends=move(score.bends), **({"notes": move(score.notes)} if notes else {}))


def _at_den(den: Column, config: TokenizerConfig, make) -> Column:  # noqa: ANN001
    """make(ticks a beat) for each denominator."""
    return F.coalesce(*[F.when(den == d, make(config.tpb(d))) for d in sorted({d for _, d in config.time_signatures})])


def preprocess_pedals(pedals: DataFrame, config: TokenizerConfig, tpq: int, time_sigs: DataFrame | None = None) -> DataFrame:
    """Overlapping and touching pedals merged (islands of a running end), then a duration of the vocabulary or the grid."""
    tick, dur = regrid(F.col("tick"), tpq, config.tpq), F.greatest(regrid(F.col("dur"), tpq, config.tpq), F.lit(1))
    rows = pedals.select(*TRACK, tick.alias("tick"), dur.alias("dur"))
    if time_sigs is not None:  # ticks and ends on the grid of the time signature in force
        step = lambda at: _at_den(section_at(at)["den"], config, lambda tpb: F.lit(tpb // config.max_res))
        rows = rows.join(sections(time_sigs, config.tpq), "score_id").withColumn("step", step(F.col("tick")))
        rows = rows.select(*TRACK, (half_even(F.col("tick") / F.col("step")) * F.col("step")).alias("tick"), (F.greatest(half_even(F.col("dur") / F.col("step")), F.lit(1)) * F.col("step")).alias("dur"))
    merged = islands(rows, TRACK)
    if not config.sustain_pedal_duration:
        return merged
    if time_sigs is None:
        return merged.withColumn("dur", nearest_duration(F.col("dur"), config, config.tpb(4)))
    merged = merged.join(sections(time_sigs, config.tpq), "score_id")
    return merged.select(*TRACK, "tick", _at_den(section_at(F.col("tick"))["den"], config, lambda tpb: nearest_duration(F.col("dur"), config, tpb)).alias("dur"))


def islands(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Intervals (tick, dur) of each key merged where one begins at or before the end of those before it."""
    order = Window.partitionBy(*keys).orderBy("tick", "dur")
    before = F.max(F.col("tick") + F.col("dur")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before >= F.col("tick"), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*keys, "island").agg(F.min("tick").alias("tick"), F.max(F.col("tick") + F.col("dur")).alias("end"))
    return merged.select(*keys, "tick", (F.col("end") - F.col("tick")).alias("dur"))


def preprocess_bends(bends: DataFrame, config: TokenizerConfig, tpq: int) -> DataFrame:
    """Nearest bin; at one tick the value of largest size, the first of equals."""
    rows = bends.select(*TRACK, F.col("tick").alias("raw"), regrid(F.col("tick"), tpq, config.tpq).alias("tick"), nearest(F.col("value"), config.pitch_bends, "int").alias("value"))
    size = F.struct(F.abs("value"), -F.col("raw"), F.col("value"))
    return rows.groupBy(*TRACK, "tick").agg(F.max_by("value", size).alias("value"))


def preprocess(score: Score, config: TokenizerConfig) -> Score:
    signatures = None
    if config.use_time_signatures and score.time_sigs is not None:
        signatures = align_time_signatures(score.time_sigs, config, score.tpq)
    if config.use_programs:
        # windows by program, by track and by stream all lie within a score, so one exchange serves them all
        score = merge_same_program_tracks(dataclasses.replace(score, notes=score.notes.repartition("score_id")))
    notes = preprocess_notes(score.notes, config, score.tpq, signatures)
    tempos = preprocess_tempos(score.tempos, config, score.tpq) if config.use_tempos and score.tempos is not None else None
    pedals = preprocess_pedals(score.pedals, config, score.tpq, signatures) if config.use_sustain_pedals and score.pedals is not None else None
    bends = preprocess_bends(score.bends, config, score.tpq) if config.use_pitch_bends and score.bends is not None else None
    return Score(notes, tempos, signatures, pedals, bends, config.tpq)


def preprocess_fine(score: Score, config: TokenizerConfig, tpq: int) -> Score:
    """A score on a fine grid of tpq ticks a quarter: as preprocess(), but times and durations are only brought to that grid."""
    signatures = align_time_signatures(score.time_sigs, config, score.tpq, tpq) if config.use_time_signatures and score.time_sigs is not None else None
    score = merge_same_program_tracks(score) if config.use_programs else score
    f = in_pitch_range(score.notes, config).withColumn("velocity", nearest_velocity(F.col("velocity"), config))
    f = f.withColumns({"tick": regrid(F.col("tick"), score.tpq, tpq), "dur": F.greatest(regrid(F.col("dur"), score.tpq, tpq), F.lit(1)), "program": F.when(F.col("is_drum"), -1).otherwise(F.col("program"))})
    f = f.where(F.col("program").isin(*config.programs)) if len(config.programs) < 129 else f
    if config.remove_duplicated_notes:
        order = Window.partitionBy(*TRACK).orderBy("tick", "pitch", "dur", "velocity")
        f = deduplicated(f.withColumn("ord", F.row_number().over(order).cast("long"))).drop("ord")
    tempos = preprocess_tempos(score.tempos, config, score.tpq, tpq) if config.use_tempos and score.tempos is not None else None
    return Score(f, tempos, signatures, tpq=tpq)
