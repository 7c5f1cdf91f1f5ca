"""Operators in which each step depends on what the step before decided: chord detection and the PerTok encoder.

They run on one array of notes a track or stream, in Arrow batches, one in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.config import PITCH_CLASSES, TokenizerConfig
from tactus.operators.grid import sections, with_bars
from tactus.plans.vocab import fine_durations, micro_timings, positions
from tactus.sources.tables import Score

#: A chord has so many notes, within two octaves.
CHORD_NOTES, CHORD_SPAN = (3, 5), 24


def heard_together(tick: np.ndarray, end: np.ndarray, tpb: np.ndarray, spread: float, most: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of groups of notes that begin within `spread` beats of the first and end within half a beat of its end.

    At most `most` notes are looked at.  Where ends lie further apart, none of them is in a group.  If the first note is
    no longer than half a beat, only notes of its tick count.  Notes at the tick of the last note of a group begin none.
    """
    at, last = 0, None
    after = lambda t: int(np.searchsorted(tick, t, "right"))
    while at < len(tick):
        if tick[at] == last:
            at = after(last)
            continue
        half = tpb[at] // 2
        stop = min(at + most, after(tick[at] + spread * tpb[at]))
        if np.abs(end[at:stop] - end[at]).max() > half:
            at = stop
            continue
        if end[at] - tick[at] <= half:
            stop = min(stop, after(tick[at]))
        yield at, stop
        at, last = stop, tick[stop - 1]


def find_chords(tick: np.ndarray, end: np.ndarray, pitch: np.ndarray, tpb: np.ndarray | int, config: TokenizerConfig, beat_res: int = 4, onset_offset: int = 1, most: int = 10) -> list[tuple[int, str]]:
    """(tick, name) of the chords of one track, notes in order of (tick, pitch); tpb: ticks a beat, of all notes or of each."""
    names = {m: k for k, m in reversed(config.chord_maps.items())}
    unknown = range(*config.chord_unknown) if config.chord_unknown else ()
    out = []
    for i, j in heard_together(tick, end, np.broadcast_to(tpb, tick.shape), onset_offset / beat_res, max(most, CHORD_NOTES[1])):
        steps = tuple(int(x) for x in pitch[i:j] - pitch[i])
        if CHORD_NOTES[0] <= len(steps) <= CHORD_NOTES[1] and steps[-1] <= CHORD_SPAN:
            name = names.get(steps) or (f"ukn{len(steps)}" if len(steps) in unknown else None)
            if name:
                out.append((int(tick[i]), f"{PITCH_CLASSES[int(pitch[i]) % 12]}:{name}" if config.chord_tokens_with_root_note else name))
    return out


def chords(notes: DataFrame, config: TokenizerConfig, time_sigs: DataFrame | None = None) -> DataFrame:
    """(score_id, track_idx, tick, chord) of the tracks that aren't drums; a beat is as long as the time signature says."""
    rows = with_bars(notes.where("not is_drum"), config.tpq, time_sigs)
    note = F.struct("tick", "pitch", "dur", "velocity", "den")
    tracks = rows.groupBy("score_id", "track_idx").agg(F.array_sort(F.collect_list(note)).alias("notes"))

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            found = []
            for score, track, held in zip(b["score_id"], b["track_idx"], b["notes"], strict=True):
                tick, pitch, dur, den = (np.array([n[k] for n in held], dtype=np.int64) for k in ("tick", "pitch", "dur", "den"))
                found += [(score, track, t, c) for t, c in find_chords(tick, tick + dur, pitch, 4 * config.tpq // den, config)]
            yield pd.DataFrame(found, columns=["score_id", "track_idx", "tick", "chord"])

    return tracks.mapInPandas(run, "score_id long, track_idx int, tick long, chord string")


def fine_tpq(config: TokenizerConfig) -> int:
    return config.additional_params.get("ticks_per_quarter", 220)


def pertok_tokens(rows: list[tuple], config: TokenizerConfig, signatures: list[tuple] = (), tempos: list[tuple] = ()) -> list[tuple[int, str]]:
    """(tick, token) of one stream's notes (tick, dur, pitch, velocity, is_drum, program) on the fine grid.

    signatures: (tick, num, den), tempos: (tick, qpm).  The error of each time shift is carried on; with use_position_toks,
    places in the bar stand instead of shifts and carry none.  A Bar's TimeSig follows it where it is new; a tempo stands
    before the first note at its tick or after it.
    """
    p = config.additional_params
    tpq = fine_tpq(config)
    bins = fine_durations(config)
    ticks = np.array([t for t, _ in bins])
    least = ticks.min() / 2
    micro = np.array(micro_timings(config)) if p.get("use_microtiming", True) else None
    near = lambda v: int(np.abs(ticks - v).argmin())  # noqa: E731  the smaller on ties
    places = np.array(positions(config)) if p.get("use_position_toks") else None
    left, waiting = list(signatures), list(tempos)
    num, den = 4, 4
    out, bar_tick, next_bar, previous, placed = [], 0, 0, 0, None
    with_program = config.use_programs and not config.program_changes
    last_program = None
    for tick, dur, pitch, velocity, drum, program in rows:
        while tick > next_bar - least:
            bar_tick = next_bar
            out.append((bar_tick, "Bar_None"))
            while left and left[0][0] <= bar_tick:
                num, den = left.pop(0)[1:]
                if config.use_time_signatures:
                    out.append((bar_tick, f"TimeSig_{num}/{den}"))
            next_bar += num * 4 * tpq // den
            previous = max(previous, bar_tick)
        while waiting and waiting[0][0] <= tick:
            out.append((tick, f"Tempo_{waiting.pop(0)[1]}"))
        shift = tick - previous
        if places is not None:
            at = int(places[np.abs(places - (tick - bar_tick)).argmin()])
            previous = bar_tick + at
            if previous != placed:
                out.append((tick, f"Position_{at}"))
                placed = previous
        elif shift >= least:
            t, name = bins[near(shift)]
            out.append((tick, f"TimeShift_{name}"))
            previous += t
        if with_program or config.use_programs and program != last_program:
            out.append((tick, f"Program_{program}"))
            last_program = program
        out.append((tick, f"{'PitchDrum' if drum and config.use_pitchdrum_tokens else 'Pitch'}_{pitch}"))
        if config.use_velocities:
            out.append((tick, f"Velocity_{velocity}"))
        if micro is not None:
            out.append((tick, f"MicroTiming_{micro[np.abs(micro - (tick - previous)).argmin()]}"))
        if config.use_note_durations:
            out.append((tick, f"Duration_{bins[near(dur)][1]}"))
    return out


def pertok(score: Score, config: TokenizerConfig) -> DataFrame:
    """(score_id, stream, pos, tick, token) of a score at ticks_per_quarter, preprocessed but for its grid."""
    one = config.use_programs and config.one_token_stream_for_programs
    note = F.struct("tick", "track_idx", "pitch", "dur", "velocity", "is_drum", "program")
    rows = score.notes.withColumn("stream", F.lit(0) if one else F.col("track_idx").cast("int"))
    rows = rows.groupBy("score_id", "stream").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    if score.time_sigs is not None:
        rows = rows.join(sections(score.time_sigs, score.tpq), "score_id")
    if score.tempos is not None:
        rows = rows.join(score.tempos.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("tick", "qpm"))).alias("tempos")), "score_id", "left")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for i, (score_id, stream, held) in enumerate(zip(b["score_id"], b["stream"], b["notes"], strict=True)):
                signatures = [(s["tick"], s["num"], s["den"]) for s in b["sections"].iloc[i]] if "sections" in b else ()
                tempos = [(t["tick"], t["qpm"]) for t in b["tempos"].iloc[i]] if "tempos" in b and b["tempos"].iloc[i] is not None else ()
                made = pertok_tokens([(n["tick"], n["dur"], n["pitch"], n["velocity"], n["is_drum"], n["program"]) for n in held], config, signatures, tempos)
                yield pd.DataFrame({"score_id": score_id, "stream": stream, "pos": range(len(made)), "tick": [t for t, _ in made], "token": [t for _, t in made]})

    return rows.mapInPandas(run, "score_id long, stream int, pos long, tick long, token string")


def pertok_notes(tokens: list[str], config: TokenizerConfig) -> list[tuple]:
    """(tick, dur, pitch, velocity, is_drum, program) of one PerTok sequence."""
    tpq = fine_tpq(config)
    length = lambda v: (lambda b, s, _: b * tpq + s)(*map(int, v.split(".")))
    out, bar_tick, next_bar, tick, program = [], 0, 0, 0, None
    num, den = 4, 4
    for i, t in enumerate(tokens):
        kind, _, value = t.partition("_")
        if kind == "Bar":
            bar_tick, next_bar = next_bar, next_bar + num * 4 * tpq // den
            tick = max(tick, bar_tick)
        elif kind == "TimeSig":
            num, den = map(int, value.split("/"))
            next_bar = bar_tick + num * 4 * tpq // den
        elif kind == "TimeShift":
            tick += length(value)
        elif kind == "Position":
            tick = bar_tick + int(value)
        elif kind == "Program":
            program = int(value)
        elif kind in ("Pitch", "PitchDrum"):
            fields = {}
            for x in tokens[i + 1 : i + 4]:
                k, _, v = x.partition("_")
                if k not in ("Velocity", "MicroTiming", "Duration"):
                    break
                fields[k] = v
            dur = length(fields["Duration"]) if "Duration" in fields else int(config.default_note_duration * tpq)
            out.append((tick + int(fields.get("MicroTiming", 0)), dur, int(value), int(fields.get("Velocity", 100)), kind == "PitchDrum", program))
    return out


def decode_pertok(sequences: DataFrame, config: TokenizerConfig) -> DataFrame:
    """(score_id, stream, tick, dur, pitch, velocity, is_drum, program) of (score_id, stream, tokens)."""
    names = ["score_id", "stream", "tick", "dur", "pitch", "velocity", "is_drum", "program"]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = pd.DataFrame([(s, t, *n) for s, t, tokens in zip(b["score_id"], b["stream"], b["tokens"], strict=True) for n in pertok_notes(list(tokens), config)], columns=names)
            yield out.astype({"program": "Int32"})

    return sequences.select("score_id", "stream", "tokens").mapInPandas(run, "score_id long, stream int, tick long, dur long, pitch int, velocity int, is_drum boolean, program int")
