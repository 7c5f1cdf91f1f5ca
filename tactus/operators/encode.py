"""Encoders: typed events in a total order, then time tokens from windows over them.  One physical plan a tokenization.

An event is a group of tokens that begin at one tick: a note is [Program] Pitch Velocity Duration.  Between events the
time tokens follow from the tick before (lag), the running end of the notes so far, and the bar of the tick, so no state
is carried row by row; every window shares one exchange on (score_id, stream).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.functions.columns import duration_bins, duration_token, greedy, greedy_length, lookup
from tactus.operators.grid import section_at, sections
from tactus.operators.preprocess import TRACK, preprocess
from tactus.plans.vocab import Vocabulary, effective
from tactus.sources.tables import Score

STREAM = ("score_id", "stream")
PLACE = ("tick", "track_rank", "kind_rank", "place", "part")
STRINGS = "array<string>"


def _strings(*items: Column) -> Column:
    return F.filter(F.array(*[i.cast("string") for i in items]), lambda x: x.isNotNull())


def _named(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _by_den(config: TokenizerConfig, make) -> Column:  # noqa: ANN001
    """make(ticks a beat) for each denominator, chosen by the column `den`."""
    dens = sorted({d for _, d in config.time_signatures})
    return make(config.tpb(4)) if dens == [4] else F.coalesce(*[F.when(F.col("den") == d, make(config.tpb(d))) for d in dens])


def note_pitch(config: TokenizerConfig, on: str = "Pitch", drum: str = "PitchDrum") -> Column:
    """Token of a note's pitch: absolute, or an interval to the note before it in the chord or at the onset before."""
    plain = _named(f"{on}_", F.col("pitch"))
    if config.use_pitchdrum_tokens:
        plain = F.when(F.col("is_drum"), _named(f"{drum}_", F.col("pitch"))).otherwise(plain)
    if not config.use_pitch_intervals:
        return plain
    w = Window.partitionBy(*TRACK).orderBy("ord")
    last_tick, last = F.lag("tick").over(w), F.lag("pitch").over(w)
    chord = last_tick == F.col("tick")
    most = config.max_pitch_interval
    # an onset's anchor is its first note, or a later one that stands on its own
    anchor = F.last(F.when(F.coalesce(~chord | (F.abs(F.col("pitch") - last) > most), F.lit(True)), F.col("pitch")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = F.col("tick") - last_tick <= int(config.pitch_intervals_max_time_dist * config.tpb(4))
    step, jump = F.col("pitch") - last, F.col("pitch") - anchor
    token = F.when(chord & (F.abs(step) <= most), _named("PitchIntervalChord_", step)).when(~chord & near & (F.abs(jump) <= most), _named("PitchIntervalTime_", jump))
    return F.coalesce(F.when(~F.col("is_drum"), token), plain)


def note_events(score: Score, config: TokenizerConfig, kind: str) -> DataFrame:
    """A row a note; for MIDILike a row where it begins and one where it ends."""
    notes = score.notes
    if score.time_sigs is not None:
        notes = notes.join(sections(score.time_sigs, config.tpq), "score_id").withColumn("den", section_at(F.col("tick"))["den"]).drop("sections")
    on_off = kind == "MIDILike"
    program = _named("Program_", F.col("program")) if config.use_programs and not config.program_changes else F.lit(None)
    pitch = note_pitch(config, *(("NoteOn", "DrumOn") if on_off else ()))
    velocity = _named("Velocity_", F.col("velocity")) if config.use_velocities else F.lit(None)
    length = _by_den(config, lambda tpb: duration_token(F.col("dur"), config, tpb)) if config.use_note_durations and not on_off else F.lit(None)
    common = [*TRACK, F.col("program"), F.col("track_idx").cast("int").alias("track_rank"), F.lit(3).alias("kind_rank"), F.col("ord").alias("place")]
    end = F.col("tick") + F.col("dur")
    rows = notes.select(*common, F.lit(0).alias("part"), F.col("tick"), _strings(program, pitch, velocity, length).alias("tokens"), F.lit("Note").alias("head"), end.alias("end"))
    if not on_off:
        return rows
    off = _named("NoteOff_", F.col("pitch"))
    off = F.when(F.col("is_drum"), _named("DrumOff_", F.col("pitch"))).otherwise(off) if config.use_pitchdrum_tokens else off
    return rows.unionByName(notes.select(*common, F.lit(1).alias("part"), end.alias("tick"), _strings(program, off).alias("tokens"), F.lit("NoteOff").alias("head"), end.alias("end")))


def events(score: Score, config: TokenizerConfig, kind: str, chords: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    """All events of all streams: (score_id, stream, place columns, tokens, head, end, ts).

    controls: (score_id, track_idx, tick, place, head, token) of attribute controls, head ACTrack or ACBar; they come
    first in their track at their tick.
    """
    one = config.use_programs and config.one_token_stream_for_programs
    out = note_events(score, config, kind)

    def effect(df: DataFrame, rank: int, head: str, *tokens: Column, **more: Column) -> DataFrame:
        return df.select(*TRACK, more.get("program", F.lit(None).cast("int")).alias("program"), F.col("track_idx").cast("int").alias("track_rank"), F.lit(rank).alias("kind_rank"), F.row_number().over(Window.partitionBy(*TRACK).orderBy("tick")).cast("long").alias("place"), more.get("part", F.lit(0)).alias("part"), more.get("tick", F.col("tick")).alias("tick"), _strings(*tokens).alias("tokens"), F.lit(head).alias("head"), more.get("tick", F.col("tick")).alias("end"))

    programs = score.notes.select(*TRACK, "program").distinct()
    if score.pedals is not None:
        pedals = score.pedals.join(programs, list(TRACK)) if config.use_programs else score.pedals.withColumn("program", F.lit(0))
        length = duration_token(F.col("dur"), config, config.tpb(4)) if config.sustain_pedal_duration else F.lit(None)
        out = out.unionByName(effect(pedals, 0, "Pedal", _named("Pedal_", F.col("program")), length))
        if not config.sustain_pedal_duration:
            out = out.unionByName(effect(pedals, 0, "PedalOff", _named("PedalOff_", F.col("program")), part=F.lit(1), tick=F.col("tick") + F.col("dur")))
    if score.bends is not None:
        bends = score.bends.join(programs, list(TRACK)) if config.use_programs and not config.program_changes else score.bends.withColumn("program", F.lit(None))
        out = out.unionByName(effect(bends, 1, "PitchBend", _named("Program_", F.col("program")), _named("PitchBend_", F.col("value"))))
    if chords is not None:
        chords = chords.join(programs, list(TRACK)) if config.use_programs and not config.program_changes else chords.withColumn("program", F.lit(None))
        out = out.unionByName(effect(chords, 2, "Chord", _named("Program_", F.col("program")), _named("Chord_", F.col("chord"))))
    if controls is not None:
        out = out.unionByName(controls.select(*TRACK, F.lit(None).cast("int").alias("program"), F.col("track_idx").cast("int").alias("track_rank"), F.lit(-1).alias("kind_rank"), F.col("place").cast("long").alias("place"), F.lit(0).alias("part"), "tick", F.array("token").alias("tokens"), "head", F.lit(None).cast("long").alias("end")))
    out = out.withColumn("stream", F.lit(0) if one else F.col("track_idx").cast("int")).drop("track_idx").withColumn("ts", F.lit(None).cast("struct<num:int,den:int>"))
    streams = out.select(*STREAM).distinct()
    for df, rank, head, token in ((score.time_sigs, -2, "TimeSig", None), (score.tempos, -1, "Tempo", None)):
        if df is None:
            continue
        token = F.concat(F.lit("TimeSig_"), F.col("num"), F.lit("/"), F.col("den")) if head == "TimeSig" else _named("Tempo_", F.col("qpm"))
        ts = F.struct("num", "den") if head == "TimeSig" else F.lit(None)
        rows = df.select("score_id", F.lit(None).cast("int").alias("program"), F.lit(rank).alias("track_rank"), F.lit(rank).alias("kind_rank"), F.col("tick").alias("place"), F.lit(0).alias("part"), "tick", F.array(token).alias("tokens"), F.lit(head).alias("head"), F.col("tick").alias("end"), ts.cast("struct<num:int,den:int>").alias("ts"))
        out = out.unionByName(rows.join(streams, "score_id"))
    if config.use_programs and config.program_changes:
        out = _with_program_changes(out)
    return out


def _with_program_changes(out: DataFrame) -> DataFrame:
    """A Program token where the program of notes, bends and chords changes."""
    w = Window.partitionBy(*STREAM).orderBy(*PLACE)
    before = F.last("program", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    change = F.col("program").isNotNull() & ~before.eqNullSafe(F.col("program"))
    return out.withColumn("tokens", F.when(change, F.concat(F.array(_named("Program_", F.col("program"))), F.col("tokens"))).otherwise(F.col("tokens")))


def _timed(out: DataFrame, config: TokenizerConfig, kind: str) -> DataFrame:
    """Events with prev (tick before), ended (end of the notes so far) and den (denominator in force before the event)."""
    w = Window.partitionBy(*STREAM).orderBy(*PLACE)
    sofar = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.col("end") if kind != "MIDILike" else F.when(F.col("head") != "TimeSig", F.col("end"))
    columns = {"prev": F.coalesce(F.lag("tick").over(w), F.lit(0)), "ended": F.coalesce(F.max(counted).over(sofar), F.lit(0))}
    if config.use_time_signatures:
        columns["den"] = F.coalesce(F.last(F.col("ts.den"), True).over(sofar), F.lit(4))
    return out.withColumns(columns)


def _rests(config: TokenizerConfig) -> tuple[Column, Column]:
    """Rest tokens before an event, and the tick that they lead to."""
    def tokens(tpb: int) -> Column:
        bins = duration_bins(config, tpb, "Rest_", rest=True)
        gap = F.col("tick") - F.col("ended")
        return F.when((F.col("tick") != F.col("prev")) & (gap >= min(t for _, t in bins)), greedy(gap, bins)).otherwise(F.array().cast(STRINGS))

    def length(tpb: int) -> Column:
        return greedy_length(F.col("tick") - F.col("ended"), duration_bins(config, tpb, "Rest_", rest=True))

    reached = F.when(F.size("rests") > 0, F.col("ended") + _by_den(config, length)).otherwise(F.col("prev"))
    return _by_den(config, tokens), reached


def _shifted(out: DataFrame, config: TokenizerConfig, kind: str) -> DataFrame:
    """TSD and MIDILike: a rest where notes have ended, then time shifts for what is left."""
    out = _timed(out, config, kind)
    if config.use_rests:
        rests, reached = _rests(config)
        out = out.withColumn("rests", rests).withColumn("reached", reached)
    else:
        out = out.withColumns({"rests": F.array().cast(STRINGS), "reached": F.col("prev")})
    shift = _by_den(config, lambda tpb: greedy(F.col("tick") - F.col("reached"), duration_bins(config, tpb, "TimeShift_")))
    shift = F.when(F.col("tick") > F.col("reached"), shift).otherwise(F.array().cast(STRINGS))
    return out.withColumn("tokens", F.concat("rests", shift, "tokens"))


def _structured(out: DataFrame, config: TokenizerConfig) -> DataFrame:
    """One time shift before each note, the nearest."""
    w = Window.partitionBy(*STREAM).orderBy(*PLACE)
    gap = (F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0))).cast("int")
    names = dict((t, n) for n, t in duration_bins(config, config.tpb(4)))
    # the nearest bin of every gap up to the largest; beyond it the largest
    bins, top = sorted(names), max(names)
    near = ["0.0.1"] + [names[min(bins, key=lambda b: (abs(b - g), -b))] for g in range(1, top + 1)]
    out = out.withColumn("gap", gap)
    value = lookup(near, F.least("gap", F.lit(top)))
    return out.withColumn("tokens", F.concat(F.array(_named("TimeShift_", value)), "tokens"))


def _barred(out: DataFrame, score: Score, config: TokenizerConfig) -> DataFrame:
    """REMI: the bars since the event before, and the position in the bar where the tick is new."""
    out = _timed(out, config, "REMI")
    w = Window.partitionBy(*STREAM).orderBy(*PLACE)
    if score.time_sigs is not None:
        out = out.join(sections(score.time_sigs, config.tpq), "score_id").withColumn("s", section_at(F.col("tick")))
        # just before a change, ticks belong to the section before it
        bar = F.col("s.bar") + F.floor((F.col("tick") - F.col("s.tick")) * F.col("s.den") / (F.col("s.num") * (4 * config.tpq))).cast("long")
        bar_tick = F.col("s.tick") + ((F.col("bar") - F.col("s.bar")) * F.col("s.num") * (4 * config.tpq) / F.col("s.den")).cast("long")
        step = _by_den(config, lambda tpb: F.lit(tpb // config.max_res))
    else:
        bar, bar_tick, step = F.floor(F.col("tick") / (4 * config.tpq)).cast("long"), F.col("bar") * (4 * config.tpq), F.lit(config.tpb(4) // config.max_res)
    out = out.withColumn("bar", bar).withColumn("bar_tick", bar_tick)
    if score.time_sigs is not None:
        out = out.withColumn("den", F.col("s.den"))
    empty = F.array().cast(STRINGS)
    last_bar = F.coalesce(F.lag("bar").over(w), F.lit(-1))
    new_tick = F.lag("tick").over(w).isNull() | (F.lag("tick").over(w) != F.col("tick"))
    out = out.withColumns({"last_bar": last_bar, "new_tick": new_tick, "last_head": F.lag("head").over(w)})
    if config.use_rests:
        if score.time_sigs is not None:
            out = out.withColumn("den", F.coalesce(F.last("ts.den", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(4)))
        rests, reached = _rests(config)
        out = out.withColumn("rests", rests).withColumn("reached", reached)
        if score.time_sigs is not None:
            at = section_at(F.col("reached"))
            rest_bar = at["bar"] + F.floor((F.col("reached") - at["tick"]) * at["den"] / (at["num"] * (4 * config.tpq))).cast("long")
            out = out.withColumn("den", F.col("s.den"))
        else:
            rest_bar = F.floor(F.col("reached") / (4 * config.tpq)).cast("long")
        # bars that a rest passes have no token; the bar of the first event has
        out = out.withColumn("last_bar", F.when(F.size("rests") > 0, F.greatest("last_bar", rest_bar)).otherwise(F.col("last_bar")))
    else:
        out = out.withColumn("rests", empty)
    numbered = config.additional_params.get("max_bar_embedding")
    ends = config.additional_params.get("use_bar_end_tokens")

    def one_bar(b: Column) -> Column:
        items = [F.when(b > 0, F.lit("Bar_End"))] if ends else []
        items.append(_named("Bar_", b) if numbered else F.lit("Bar_None"))
        if score.time_sigs is not None:
            at = F.element_at(F.filter("sections", lambda s: s["bar"] <= b), -1)
            own = (F.col("head") == "TimeSig") & (b == F.col("bar"))
            items.append(F.when(~own, F.concat(F.lit("TimeSig_"), at["num"], F.lit("/"), at["den"])))
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    missing = F.col("new_tick") & (F.col("bar") > F.col("last_bar"))
    if not numbered and not ends and score.time_sigs is None:
        made = F.array_repeat(F.lit("Bar_None"), (F.col("bar") - F.col("last_bar")).cast("int"))
    else:
        made = F.flatten(F.transform(F.sequence(F.col("last_bar") + 1, F.col("bar")), one_bar))
    bars = F.when(missing, made).otherwise(empty)
    placed = (F.col("new_tick") | F.col("last_head").isin("TimeSig", "ACBar", "ACTrack")) & ~F.col("head").isin("TimeSig", "ACBar", "ACTrack")
    position = F.when(placed, F.array(_named("Position_", F.floor((F.col("tick") - F.col("bar_tick")) / step).cast("int")))).otherwise(empty)
    return out.withColumn("tokens", F.concat("rests", bars, position, "tokens"))


def encode(score: Score, kind: str, config: TokenizerConfig, *, preprocessed: bool = False, base: str = "TSD", chords: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    """Token sequences of a one-vocabulary tokenization: (score_id, stream, place columns, tokens), a row an event in order of PLACE."""
    config = effective(kind, config)
    if not preprocessed:
        score = preprocess(score, config)
    if kind == "MMM":
        config = config.copy(one_token_stream_for_programs=False, use_programs=False)
        return encode(score, base, config, preprocessed=True, chords=chords, controls=controls)
    if kind == "Structured":
        score = Score(score.notes, tpq=score.tpq)
    out = events(score, config, kind, chords, controls)
    if kind in ("TSD", "MIDILike"):
        out = _shifted(out, config, kind)
    elif kind == "Structured":
        out = _structured(out, config)
    elif kind == "REMI":
        out = _barred(out, score, config)
    else:
        raise ValueError(f"{kind} is not encoded by windows over one vocabulary")
    return out.select(*STREAM, *PLACE, "program", "tokens")


def token_rows(encoded: DataFrame) -> DataFrame:
    """(score_id, stream, pos, tick, token), pos from 0 in each stream.

    Positions are running sums over events, which are in order already, so the tokens are never sorted.
    """
    before = Window.partitionBy(*STREAM).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    at = encoded.withColumn("at", F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)))
    return at.select(*STREAM, "at", "tick", F.posexplode("tokens").alias("k", "token")).select(*STREAM, (F.col("at") + F.col("k")).alias("pos"), "tick", "token")


def sequences(encoded: DataFrame) -> DataFrame:
    """(score_id, stream, tokens): one row a sequence, the form that files and models take."""
    return encoded.groupBy(*STREAM).agg(F.array_sort(F.collect_list(F.struct(*PLACE, "tokens"))).alias("e")).select(*STREAM, F.flatten(F.transform("e", lambda e: e["tokens"])).alias("tokens"))


def mmm_sequences(score: Score, config: TokenizerConfig, base: str = "TSD", *, preprocessed: bool = False, chords: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    """(score_id, tokens): the tracks' sequences between Track_Start, Program and Track_End, one after the other."""
    encoded = encode(score, "MMM", config, base=base, preprocessed=preprocessed, chords=chords, controls=controls)
    programs = encoded.groupBy(*STREAM).agg(F.max("program").alias("program"))
    tracks = sequences(encoded).join(programs, list(STREAM))
    wrapped = F.concat(F.array(F.lit("Track_Start"), _named("Program_", F.col("program"))), F.col("tokens"), F.array(F.lit("Track_End")))
    tracks = tracks.select("score_id", F.struct("stream", wrapped.alias("tokens")).alias("t"))
    return tracks.groupBy("score_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tokens"])).alias("tokens"))


def with_ids(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Token rows with their id, null for a token outside the vocabulary.

    A dictionary lookup by hash join; the vocabulary's size follows from the options alone, so it may be broadcast.
    """
    ids = vocabulary.table(rows.sparkSession).where("voc = 0").select("token", "id")
    return rows.join(F.broadcast(ids), "token", "left").select(*rows.columns, "id")
