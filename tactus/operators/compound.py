"""Encoders whose tokens are rows of sub-tokens: Octuple, MuMIDI and CPWord, as projections over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.functions.columns import duration_bins, duration_token, greedy
from tactus.operators.encode import _named
from tactus.operators.grid import section_at, section_of_bar, with_bars
from tactus.operators.preprocess import preprocess
from tactus.plans.vocab import effective
from tactus.sources.tables import Score

IGNORE = "Ignore_None"
STREAM = ("score_id", "stream")


def placed_notes(score: Score, config: TokenizerConfig, by_program: bool = False, keep: bool = False) -> DataFrame:
    """Notes with stream, bar, position, tempo and time signature in force at their tick."""
    notes = with_bars(score.notes, config.tpq, score.time_sigs, keep=keep)
    step = F.coalesce(*[F.when(F.col("den") == d, F.lit(config.tpb(d) // config.max_res)) for d in sorted({d for _, d in config.time_signatures})])
    notes = notes.withColumn("position", F.floor((F.col("tick") - F.col("bar_tick")) / step).cast("int")).drop("bar_tick")
    one = config.use_programs and config.one_token_stream_for_programs
    notes = notes.withColumn("stream", F.lit(0) if one or by_program else F.col("track_idx").cast("int"))
    if score.tempos is not None:
        # as-of: a score's few tempos as one array, the last at or before each note
        tempos = score.tempos.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("tick", "qpm"))).alias("__t"))
        notes = notes.join(tempos, "score_id", "left").withColumn("qpm", section_at(F.col("tick"), "__t")["qpm"]).drop("__t")
    else:
        notes = notes.withColumn("qpm", F.lit(config.default_tempo))
    return notes


def _order(config: TokenizerConfig, by_program: bool = False) -> list[str]:
    return ["tick", *(["program"] if by_program else []), "track_idx", "ord"]


def _tokens(config: TokenizerConfig) -> dict[str, Column]:
    pitch = _named("Pitch_", F.col("pitch"))
    if config.use_pitchdrum_tokens:
        pitch = F.when(F.col("is_drum"), _named("PitchDrum_", F.col("pitch"))).otherwise(pitch)
    length = F.coalesce(*[F.when(F.col("den") == d, duration_token(F.col("dur"), config, config.tpb(d))) for d in sorted({d for _, d in config.time_signatures})])
    return {"pitch": pitch, "velocity": _named("Velocity_", F.col("velocity")), "duration": length, "program": _named("Program_", F.col("program")), "tempo": _named("Tempo_", F.col("qpm")), "sig": F.concat(F.lit("TimeSig_"), F.col("num"), F.lit("/"), F.col("den"))}


def octuple(score: Score, config: TokenizerConfig, *, preprocessed: bool = False) -> DataFrame:
    """(score_id, stream, pos, tick, tokens): Pitch, Position, Bar, then Velocity, Duration, Program, Tempo, TimeSig if used.  Notes from bar max_bar_embedding (60) on are left out."""
    config = effective("Octuple", config)
    notes = placed_notes(score if preprocessed else preprocess(score, config), config)
    notes = notes.where(F.col("bar") < (config.additional_params.get("max_bar_embedding") or 60))
    t = _tokens(config)
    row = [t["pitch"], _named("Position_", F.col("position")), _named("Bar_", F.col("bar"))]
    row += [t[k] for k, on in (("velocity", config.use_velocities), ("duration", config.use_note_durations), ("program", config.use_programs), ("tempo", config.use_tempos), ("sig", config.use_time_signatures)) if on]
    pos = F.row_number().over(Window.partitionBy(*STREAM).orderBy(*_order(config))) - 1
    return notes.select(*STREAM, pos.cast("long").alias("pos"), "tick", F.array(*row).alias("tokens"))


def _with_chords(notes: DataFrame, chords: DataFrame | None) -> DataFrame:
    """A column `chord` with the chord that begins at a note's track and tick."""
    if chords is None:
        return notes.withColumn("chord", F.lit(None).cast("string"))
    return notes.join(chords.groupBy("score_id", "track_idx", "tick").agg(F.min("chord").alias("chord")), ["score_id", "track_idx", "tick"], "left")


def mumidi(score: Score, config: TokenizerConfig, chords: DataFrame | None = None, *, preprocessed: bool = False) -> DataFrame:
    """(score_id, stream, pos, tick, tokens): rows for new bars, positions and programs, then notes; 4/4 only."""
    config = effective("MuMIDI", config)
    score = score if preprocessed else preprocess(score, config)
    notes = placed_notes(Score(score.notes, score.tempos, tpq=score.tpq), config, True)
    notes = notes.where(F.col("bar") < (config.additional_params.get("max_bar_embedding") or 60))
    notes = _with_chords(notes, chords)
    w = Window.partitionBy(*STREAM).orderBy(*_order(config, True))
    new_tick = ~F.lag("tick").over(w).eqNullSafe(F.col("tick"))
    notes = notes.withColumns({"new_tick": new_tick, "last_bar": F.coalesce(F.lag("bar").over(w), F.lit(-1)), "new_program": new_tick | ~F.lag("program").over(w).eqNullSafe(F.col("program"))})
    t = _tokens(config)
    tempo = [t["tempo"]] if config.use_tempos else []
    blank = [F.lit(IGNORE)] * (config.use_velocities + config.use_note_durations)
    bar, position = _named("BarPosEnc_", F.col("bar")), _named("PositionPosEnc_", F.col("position"))
    none = F.array().cast("array<array<string>>")
    bars = F.when(F.col("bar") > F.col("last_bar"), F.transform(F.sequence(F.col("last_bar") + 1, F.col("bar")), lambda b: F.array(F.lit("Bar_None"), _named("BarPosEnc_", b), F.lit("PositionPosEnc_None"), *tempo, *blank))).otherwise(none)
    place = F.when(F.col("new_tick"), F.array(F.array(_named("Position_", F.col("position")), bar, position, *tempo, *blank))).otherwise(none)
    program = F.when(F.col("new_program"), F.array(F.array(t["program"], bar, position, *tempo, *blank))).otherwise(none)
    # a chord stands before the notes of its track that begin with it
    first = F.row_number().over(Window.partitionBy(*STREAM, "tick", "track_idx").orderBy("ord")) == 1
    notes = notes.withColumn("chord", F.when(first, F.col("chord")))
    chord = F.when(F.col("chord").isNotNull(), F.array(F.array(_named("Chord_", F.col("chord")), bar, position, *tempo, *blank))).otherwise(none)
    note = [t["pitch"], bar, position, *tempo, *([t["velocity"]] if config.use_velocities else []), *([t["duration"]] if config.use_note_durations else [])]
    return _exploded(notes.withColumn("rows", F.concat(bars, place, program, chord, F.array(F.array(*note)))), w, _order(config, True))


def cpword(score: Score, config: TokenizerConfig, chords: DataFrame | None = None, *, preprocessed: bool = False) -> DataFrame:
    """(score_id, stream, pos, tick, tokens): Family, Bar or Position, Pitch, then the used ones of Velocity, Duration, Program, Rest, Tempo, TimeSig."""
    config = effective("CPWord", config)
    score = score if preprocessed else preprocess(score, config)
    notes = _with_chords(placed_notes(score, config, keep=True), chords)
    w = Window.partitionBy(*STREAM).orderBy(*_order(config))
    ended = F.coalesce(F.max(F.col("tick") + F.col("dur")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new_tick = ~F.lag("tick").over(w).eqNullSafe(F.col("tick"))
    notes = notes.withColumns({"new_tick": new_tick, "last_bar": F.coalesce(F.lag("bar").over(w), F.lit(-1)), "ended": ended})
    t = _tokens(config)
    names = ["family", "place", "pitch", *[k for k, on in (("velocity", config.use_velocities), ("duration", config.use_note_durations), ("program", config.use_programs), ("chord", config.use_chords), ("rest", config.use_rests), ("tempo", config.use_tempos), ("sig", config.use_time_signatures)) if on]]
    row = lambda **x: F.array(*[x.get(n, F.lit(IGNORE)) for n in names])
    none = F.array().cast("array<array<string>>")
    metric = F.lit("Family_Metric")
    rests = none
    if config.use_rests:
        bins = duration_bins(config, config.tpb(4), "Rest_", rest=True)
        gap = F.col("tick") - F.col("ended")
        rests = F.when(F.col("new_tick") & (gap >= min(x for _, x in bins)), F.transform(greedy(gap, bins), lambda r: row(family=metric, rest=r))).otherwise(none)
    sig = lambda b: t["sig"] if score.time_sigs is None else (lambda s: F.concat(F.lit("TimeSig_"), s["num"], F.lit("/"), s["den"]))(section_of_bar(b))
    bars = F.when(F.col("bar") > F.col("last_bar"), F.transform(F.sequence(F.col("last_bar") + 1, F.col("bar")), lambda b: row(family=metric, place=F.lit("Bar_None"), sig=sig(b)))).otherwise(none)
    position = F.when(F.col("new_tick"), F.array(row(family=metric, place=_named("Position_", F.col("position")), tempo=t["tempo"], chord=F.coalesce(_named("Chord_", F.col("chord")), F.lit(IGNORE))))).otherwise(none)
    note = row(family=F.lit("Family_Note"), pitch=t["pitch"], velocity=t["velocity"], duration=t["duration"], program=t["program"])
    return _exploded(notes.withColumn("rows", F.concat(rests, bars, position, F.array(note))), w, _order(config))


def _exploded(notes: DataFrame, w, order: list[str]) -> DataFrame:  # noqa: ANN001
    at = F.coalesce(F.sum(F.size("rows")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = notes.withColumn("at", at).select(*STREAM, "at", "tick", F.posexplode("rows").alias("k", "tokens"))
    return rows.select(*STREAM, (F.col("at") + F.col("k")).alias("pos"), "tick", "tokens")
