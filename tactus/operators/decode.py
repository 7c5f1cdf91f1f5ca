"""Decoders: token sequences back to notes.

Without rests a tick is a running sum, so window plans decode TSD, MIDILike, Structured, REMI and the compound
tokenizations.  With rests a tick depends on the end of the notes before it, which is no associative sum; decode_fold()
then walks each sequence in one pass (Arrow batches, one sequence in memory at a time).
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.config import DEFAULT_VELOCITY, TokenizerConfig
from tactus.functions.columns import token_ticks
from tactus.plans.vocab import OWN

STREAM = ("score_id", "stream")
HEADS = ("Pitch", "PitchDrum")


def _typed(rows: DataFrame) -> DataFrame:
    """Token rows (score_id, stream, pos, token) with type and value."""
    parts = F.split("token", "_", 2)
    return rows.withColumns({"type": parts[0], "value": parts[1]})


def _after(name: str, w, most: int = 2) -> Column:  # noqa: ANN001
    """Value of the next token of a type within the note: Velocity and Duration follow their pitch."""
    return F.coalesce(*[F.when(F.lead("type", k).over(w) == name, F.lead("value", k).over(w)) for k in range(1, most + 1)])


def _notes(rows: DataFrame, config: TokenizerConfig, w) -> DataFrame:  # noqa: ANN001
    """Notes of rows that have a tick: pitch heads with the Velocity and Duration that follow and the Program before."""
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"velocity": _after("Velocity", w), "length": _after("Duration", w), "program": F.last(F.when(F.col("type") == "Program", F.col("value").cast("int")), True).over(sofar)})
    notes = rows.where(F.col("type").isin(*HEADS))
    if config.use_velocities:
        notes = notes.where("velocity is not null")
    if config.use_note_durations:
        notes = notes.where("length is not null")
    dur = token_ticks(F.col("length"), config.tpb(4)) if config.use_note_durations else F.lit(int(config.default_note_duration * config.tpq)).cast("long")
    return notes.select(*STREAM, F.col("program"), (F.col("type") == "PitchDrum").alias("is_drum"), "tick", dur.alias("dur"), F.col("value").cast("int").alias("pitch"), F.coalesce(F.col("velocity").cast("int"), F.lit(DEFAULT_VELOCITY)).alias("velocity"))


def decode_shifts(rows: DataFrame, config: TokenizerConfig) -> DataFrame:
    """TSD and Structured, without rests: notes at the running sum of time shifts; `0.0.1` is no shift."""
    w = Window.partitionBy(*STREAM).orderBy("pos")
    shift = F.when((F.col("type") == "TimeShift") & (F.col("value") != "0.0.1"), token_ticks(F.col("value"), config.tpb(4))).otherwise(0)
    rows = _typed(rows).withColumn("tick", F.sum(shift).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return _notes(rows, config, w)


def decode_bars(rows: DataFrame, config: TokenizerConfig) -> DataFrame:
    """REMI in 4/4 without rests: every Bar token is a bar, numbered or not, and positions count within it."""
    w = Window.partitionBy(*STREAM).orderBy("pos")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _typed(rows).withColumn("is_bar", (F.col("type") == "Bar") & (F.col("value") != "End"))
    rows = rows.withColumn("bar", F.sum(F.col("is_bar").cast("long")).over(sofar) - 1)
    place = F.last(F.when(F.col("type") == "Position", F.col("value").cast("long")).when(F.col("is_bar"), 0), True).over(sofar)
    rows = rows.withColumn("tick", F.greatest("bar", F.lit(0)) * (4 * config.tpq) + F.coalesce(place, F.lit(0)) * (config.tpb(4) // config.max_res))
    return _notes(rows, config, w)


def decode_on_off(rows: DataFrame, config: TokenizerConfig) -> DataFrame:
    """MIDILike without rests: a NoteOff ends the open note of its program and pitch that began first.

    An off without an open note is left out: it lowers the running balance of its pitch below all values before it.  With
    max_duration, notes end after that at the latest, those without an off too; otherwise those are left out.
    """
    w = Window.partitionBy(*STREAM).orderBy("pos")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    shift = F.when(F.col("type") == "TimeShift", token_ticks(F.col("value"), config.tpb(4))).otherwise(0)
    rows = _typed(rows).withColumns({"tick": F.sum(shift).over(sofar).cast("long"), "velocity": _after("Velocity", w, 1)})
    rows = rows.withColumn("program", F.last(F.when(F.col("type") == "Program", F.col("value").cast("int")), True).over(sofar))
    rows = rows.where(F.col("type").isin("NoteOn", "NoteOff", "DrumOn", "DrumOff")).withColumns({"pitch": F.col("value").cast("int"), "is_drum": F.col("type").startswith("Drum"), "on": F.col("type").endswith("On")})
    keys = [*STREAM, "program", "is_drum", "pitch"]
    mine = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("balance", F.sum(F.when(F.col("on"), 1).otherwise(-1)).over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.least(F.coalesce(F.min("balance").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    rows = rows.withColumn("least", least).where(F.col("on") | (F.col("balance") >= F.col("least")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "on").orderBy("pos")))
    both = rows.groupBy(*keys, "n").agg(F.min(F.when(F.col("on"), F.col("tick"))).alias("tick"), F.min(F.when(~F.col("on"), F.col("tick"))).alias("end"), F.min(F.when(F.col("on"), F.col("velocity"))).alias("velocity"))
    most = max_duration(config)
    dur = F.col("end") - F.col("tick")
    dur = dur if most is None else F.least(F.coalesce(dur, F.lit(most)), F.lit(most)).cast("long")
    return both.withColumn("dur", dur).where("tick is not null and dur is not null").select(*STREAM, "program", "is_drum", "tick", "dur", "pitch", F.coalesce(F.col("velocity").cast("int"), F.lit(DEFAULT_VELOCITY)).alias("velocity"))


def max_duration(config: TokenizerConfig, tpb: int | None = None) -> int | None:
    """Ticks of the option max_duration (beats, position, resolution), or None."""
    most = config.additional_params.get("max_duration")
    return config.ticks(tuple(map(int, most.split("."))) if isinstance(most, str) else tuple(most), tpb) if most else None


def _by_den(config: TokenizerConfig, make) -> Column:  # noqa: ANN001
    """make(ticks a beat) by the column `den`."""
    return F.coalesce(*[F.when(F.col("den") == d, make(config.tpb(d))) for d in sorted({d for _, d in config.time_signatures})])


def _with_signature(rows: DataFrame, sig: Column | None) -> DataFrame:
    """num and den of a TimeSig value `num/den`; 4/4 without."""
    if sig is None:
        return rows.withColumns({"num": F.lit(4), "den": F.lit(4)})
    parts = F.split(sig, "/")
    return rows.withColumns({"num": parts[0].try_cast("int"), "den": parts[1].try_cast("int")})


def decode_octuple(rows: DataFrame, config: TokenizerConfig) -> DataFrame:
    """Rows Pitch, Position, Bar, ...: every row says where it is.

    Bars are as long as the time signature of their rows says; a change counts from the bar of the first row that has it,
    as bars without notes say nothing.
    """
    value = lambda i: F.split(F.get("tokens", F.lit(i)), "_", 2)[1]
    at = 3 + config.use_velocities
    after = at + config.use_note_durations
    sig = value(after + config.use_programs + config.use_tempos) if config.use_time_signatures else None
    rows = _with_signature(rows, sig).withColumn("bar", value(2).cast("long"))
    per_bar = (F.col("num") * (4 * config.tpq) / F.col("den")).cast("long")
    if config.use_time_signatures:
        w = Window.partitionBy(*STREAM).orderBy("pos")
        change = F.lag("num").over(w).isNull() | (F.lag("num").over(w) != F.col("num")) | (F.lag("den").over(w) != F.col("den"))
        rows = rows.withColumn("new", change).withColumn("section", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        first = rows.where("new").select(*STREAM, "section", F.when(F.col("section") == 1, 0).otherwise(F.col("bar")).alias("first"), per_bar.alias("length"))
        by = Window.partitionBy(*STREAM).orderBy("section")
        ticks = (F.lead("first").over(by) - F.col("first")) * F.col("length")
        first = first.withColumn("ticks", ticks).withColumn("start", F.coalesce(F.sum("ticks").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.join(first.select(*STREAM, "section", "first", "start"), [*STREAM, "section"])
        bar_tick = F.col("start") + (F.col("bar") - F.col("first")) * per_bar
    else:
        bar_tick = F.col("bar") * (4 * config.tpq)
    dur = _by_den(config, lambda tpb: token_ticks(value(at), tpb)) if config.use_note_durations else F.lit(int(config.default_note_duration * config.tpq)).cast("long")
    program = value(after).cast("int") if config.use_programs else F.lit(None).cast("int")
    tick = bar_tick + value(1).cast("long") * _by_den(config, lambda tpb: F.lit(tpb // config.max_res))
    return rows.select(*STREAM, program.alias("program"), F.startswith(F.get("tokens", F.lit(0)), F.lit("PitchDrum")).alias("is_drum"), tick.cast("long").alias("tick"), dur.alias("dur"), value(0).cast("int").alias("pitch"), (value(3).cast("int") if config.use_velocities else F.lit(DEFAULT_VELOCITY)).alias("velocity"))


def decode_mumidi(rows: DataFrame, config: TokenizerConfig) -> DataFrame:
    """Note rows carry their bar and position; the program is that of the last Program row."""
    w = Window.partitionBy(*STREAM).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.split(F.get("tokens", F.lit(0)), "_", 2)
    value = lambda i: F.split(F.get("tokens", F.lit(i)), "_", 2)[1]
    rows = rows.withColumns({"type": first[0], "value": first[1]}).withColumn("program", F.last(F.when(F.col("type") == "Program", F.col("value").cast("int")), True).over(w))
    at = 3 + config.use_tempos
    tick = value(1).cast("long") * (4 * config.tpq) + value(2).cast("long") * (config.tpb(4) // config.max_res)
    return rows.where(F.col("type").isin(*HEADS)).select(*STREAM, "program", (F.col("type") == "PitchDrum").alias("is_drum"), tick.alias("tick"), token_ticks(value(at + config.use_velocities), config.tpb(4)).alias("dur"), F.col("value").cast("int").alias("pitch"), value(at).cast("int").alias("velocity"))


def decode_cpword(rows: DataFrame, config: TokenizerConfig) -> DataFrame:
    """Without rests: each bar row is as long as its time signature says, positions are carried forward; rows without a pitch are no notes."""
    w = Window.partitionBy(*STREAM).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    token = lambda i: F.get("tokens", F.lit(i))
    value = lambda i: F.split(token(i), "_", 2)[1]
    is_bar = F.startswith(token(1), F.lit("Bar"))
    at = 3 + config.use_velocities
    after = at + config.use_note_durations
    sig = value(after + config.use_programs + config.use_chords + config.use_rests + config.use_tempos) if config.use_time_signatures else None
    rows = _with_signature(rows, sig).withColumns({"num": F.last(F.when(is_bar, F.col("num")), True).over(w), "den": F.last(F.when(is_bar, F.col("den")), True).over(w)})
    # ticks of all bars so far less those of the one that goes on
    length = (F.col("num") * (4 * config.tpq) / F.col("den")).cast("long")
    rows = rows.withColumn("bar_tick", F.sum(F.when(is_bar, length)).over(w) - length)
    place = F.last(F.when(F.startswith(token(1), F.lit("Position")), value(1).cast("long")).when(is_bar, 0), True).over(w)
    rows = rows.withColumn("tick", F.col("bar_tick") + place * _by_den(config, lambda tpb: F.lit(tpb // config.max_res)))
    program = value(after).cast("int") if config.use_programs else F.lit(None).cast("int")
    dur = _by_den(config, lambda tpb: token_ticks(value(at), tpb)) if config.use_note_durations else F.lit(int(config.default_note_duration * config.tpq)).cast("long")
    return rows.where(F.startswith(token(2), F.lit("Pitch"))).select(*STREAM, program.alias("program"), F.startswith(token(2), F.lit("PitchDrum")).alias("is_drum"), "tick", dur.alias("dur"), value(2).cast("int").alias("pitch"), (value(3).cast("int") if config.use_velocities else F.lit(DEFAULT_VELOCITY)).alias("velocity"))


def split_mmm(rows: DataFrame) -> DataFrame:
    """(score_id, tokens) of MMM to token rows, one stream a track; Track_Start and Track_End are left out."""
    flat = rows.select("score_id", F.posexplode("tokens").alias("pos", "token"))
    w = Window.partitionBy("score_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("stream", (F.sum((F.col("token") == "Track_Start").cast("int")).over(w) - 1).cast("int"))
    return flat.where(~F.col("token").startswith("Track_")).select("score_id", "stream", F.col("pos").cast("long").alias("pos"), "token")


def _ticks(value: str, tpb: int) -> int:
    beat, pos, res = map(int, value.split("."))
    return (beat * res + pos) * tpb // res


#: kind: note (a pitch, b velocity), tempo, time_sig (a over b), pedal or bend (a).
ROWS = "score_id long, stream int, kind string, program int, is_drum boolean, tick long, dur long, a int, b int, qpm double"


def walk(tokens: list[str], kind: str, config: TokenizerConfig, effects: list | None = None, times: list | None = None) -> list[tuple]:
    """Notes (program, is_drum, tick, dur, pitch, velocity) of one sequence, with rests, time signatures and pitch intervals.

    effects, if given, gets (kind, program, tick, dur, a, b, qpm) of tempos, time signatures, pedals and bends.  times, if
    given, gets the tick of each token: that of time shifts and rests is the tick before them.
    """
    pedal: dict[int, int] = {}
    tick = end = bar_tick = section_tick = 0
    bar, section_bar, num, den = -1, 0, 4, 4
    tpq, program, out = config.tpq, None, []
    onset_pitch: dict[int | None, int] = {}  # by program
    last_pitch: dict[int | None, int] = {}
    open_notes: dict[tuple, deque] = {}
    i, n = 0, len(tokens)
    while i < n:
        kind_, _, value = tokens[i].partition("_")
        tpb = config.tpb(den)
        per_bar = num * 4 * tpq // den
        if times is not None and kind_ in ("TimeShift", "Rest"):
            times.append(tick)
        if kind_ == "TimeShift":
            tick += 0 if value == "0.0.1" else _ticks(value, tpb)
        elif kind_ == "Rest":
            tick = max(tick, end) + _ticks(value, tpb)
            if kind == "REMI":
                bar = max(bar, section_bar + (tick - section_tick) // per_bar)
                bar_tick = section_tick + (bar - section_bar) * per_bar
            end = max(end, tick)
        elif kind_ == "Bar" and value != "End":
            bar += 1
            bar_tick = section_tick + (bar - section_bar) * per_bar
            tick = bar_tick
        elif kind_ == "Position":
            tick = bar_tick + int(value) * (tpb // config.max_res)
        elif kind_ == "TimeSig":
            num, den = map(int, value.split("/"))
            section_tick, section_bar = tick, max(bar, 0)
            bar_tick = tick
            end = max(end, tick)
            if effects is not None and not (effects and ("time_sig", num, den) in [(e[0], e[4], e[5]) for e in effects if e[0] == "time_sig"][-1:]):
                effects.append(("time_sig", None, tick, None, num, den, None))
        elif kind_ in ("Tempo", "Pedal", "PedalOff", "PitchBend", "Chord"):
            end = max(end, tick)
            if effects is not None:
                if kind_ == "Tempo":
                    effects.append(("tempo", None, tick, None, None, None, float(value)))
                elif kind_ == "PitchBend":
                    effects.append(("bend", program, tick, None, int(value), None, None))
                elif kind_ == "Pedal" and config.sustain_pedal_duration:
                    effects.append(("pedal", int(value), tick, _ticks(tokens[i + 1].partition("_")[2], tpb), None, None, None))
                elif kind_ == "Pedal":
                    pedal.setdefault(int(value), tick)
                elif kind_ == "PedalOff" and int(value) in pedal:
                    begin = pedal.pop(int(value))
                    effects.append(("pedal", int(value), begin, tick - begin, None, None, None))
        elif kind_ == "Program":
            program = int(value)
        elif kind_ in ("Pitch", "PitchDrum", "PitchIntervalTime", "PitchIntervalChord", "NoteOn", "DrumOn"):
            if kind_ == "PitchIntervalTime":
                pitch = onset_pitch[program] = onset_pitch.get(program, 0) + int(value)
            elif kind_ == "PitchIntervalChord":
                pitch = last_pitch.get(program, 0) + int(value)
            else:
                pitch = onset_pitch[program] = int(value)
            last_pitch[program] = pitch
            fields = dict(t.split("_", 1) for t in tokens[i + 1 : i + 3])
            velocity = int(fields.get("Velocity", DEFAULT_VELOCITY))
            drum = kind_ in ("PitchDrum", "DrumOn")
            if kind == "MIDILike":
                open_notes.setdefault((program, drum, pitch), deque()).append((tick, velocity))
            elif "Duration" in fields or not config.use_note_durations:
                dur = _ticks(fields["Duration"], tpb) if config.use_note_durations else int(config.default_note_duration * tpq)
                out.append((program, drum, tick, dur, pitch, velocity))
                end = max(end, tick + dur)
        elif kind_ in ("NoteOff", "DrumOff"):
            waiting = open_notes.get((program, kind_ == "DrumOff", int(value)))
            if waiting:
                begin, velocity = waiting.popleft()
                most = max_duration(config, tpb)
                out.append((program, kind_ == "DrumOff", begin, tick - begin if most is None else min(tick - begin, most), int(value), velocity))
            end = max(end, tick)
        if times is not None and kind_ not in ("TimeShift", "Rest"):
            times.append(tick)
        i += 1
    if (most := max_duration(config, config.tpb(den))) is not None:  # notes that never end
        out += [(program_, drum, begin, most, pitch, velocity) for (program_, drum, pitch), waiting in open_notes.items() for begin, velocity in waiting]
    return out


def token_grid(tokens: list[str], kind: str, config: TokenizerConfig) -> list[tuple[int, int]]:
    """(bar, beat) of each token of one sequence, counted from its beginning, as its time signatures have them."""
    times: list[int] = []
    walk(tokens, kind, config, times=times)
    tick = bar = beat = 0
    num, den = 4, 4
    out = []
    for t, at in zip(tokens, times, strict=True):
        if t.startswith("TimeSig_"):
            per_bar, per_beat = num * 4 * config.tpq // den, config.tpb(den)
            bar, beat, tick = bar + -(-(at - tick) // per_bar), beat + -(-(at - tick) // per_beat), at
            num, den = map(int, t.partition("_")[2].split("/"))
        out.append((bar + (at - tick) // (num * 4 * config.tpq // den), beat + (at - tick) // config.tpb(den)))
    return out


def split_words(sequences: DataFrame, kind: str, config: TokenizerConfig, beats: bool = False) -> DataFrame:
    """(score_id, stream, word, ids) of (score_id, stream, tokens, ids): cut where the bar, or the beat, of the tokens changes."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for s, t, tokens, ids in zip(b["score_id"], b["stream"], b["tokens"], b["ids"], strict=True):
                at = [g[beats] for g in token_grid(list(tokens), kind, config)]
                cuts = [0, *[i for i in range(1, len(at)) if at[i] > at[i - 1]], len(at)]
                rows += [(s, t, n, list(ids[i:j])) for n, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            yield pd.DataFrame(rows, columns=["score_id", "stream", "word", "ids"])

    return sequences.select(*STREAM, "tokens", "ids").mapInPandas(run, "score_id long, stream int, word int, ids array<int>")


def decode_rows(sequences: DataFrame, kind: str, config: TokenizerConfig) -> DataFrame:
    """Notes, tempos, time signatures, pedals and bends of (score_id, stream, tokens), any options, in one pass: see ROWS."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    own = OWN[kind].walk if kind in OWN else None

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for s, t, tokens in zip(b["score_id"], b["stream"], b["tokens"], strict=True):
                found: list = []
                notes = own(list(tokens), config) if own else walk(list(tokens), kind, config, found)
                rows += [(s, t, "note", program, drum, tick, dur, pitch, velocity, None) for program, drum, tick, dur, pitch, velocity in notes]
                rows += [(s, t, name, program, None, tick, dur, x, y, qpm) for name, program, tick, dur, x, y, qpm in found]
            out = pd.DataFrame(rows, columns=names)
            for c in ("program", "a", "b"):
                out[c] = out[c].astype("Int32")
            yield out.astype({"tick": "Int64", "dur": "Int64", "qpm": "float64", "is_drum": "boolean"})

    return sequences.select(*STREAM, "tokens").mapInPandas(run, ROWS)


def decoded_notes(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'note'").select(*STREAM, "program", "is_drum", "tick", "dur", F.col("a").alias("pitch"), F.col("b").alias("velocity"))


def decode_fold(sequences: DataFrame, kind: str, config: TokenizerConfig) -> DataFrame:
    """Notes of (score_id, stream, tokens), any options."""
    return decoded_notes(decode_rows(sequences, kind, config))
