"""Vocabularies and successor graphs of the tokenizations, as rows made on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.config import PITCH_CLASSES, TokenizerConfig

KINDS = ("TSD", "MIDILike", "REMI", "Structured", "CPWord", "Octuple", "MuMIDI", "MMM", "PerTok")
MULTI = ("CPWord", "Octuple", "MuMIDI")
#: Types that a tokenization never has, whatever the options say.
OFF = {
    "Structured": ("use_chords", "use_rests", "use_tempos", "use_time_signatures", "use_sustain_pedals", "use_pitch_bends", "use_pitch_intervals", "program_changes"),
    "CPWord": ("use_sustain_pedals", "use_pitch_bends", "use_pitch_intervals", "program_changes"),
    "Octuple": ("use_chords", "use_rests", "use_sustain_pedals", "use_pitch_bends", "use_pitch_intervals", "program_changes"),
    "MuMIDI": ("use_rests", "use_time_signatures", "use_sustain_pedals", "use_pitch_bends", "program_changes"),
    "PerTok": ("use_rests", "use_sustain_pedals"),
}


@dataclass(frozen=True)
class Tokenization:
    """A tokenization of one's own, registered by name in OWN.

    tokens(config): its vocabulary after the special tokens.  encode(score, config): rows (score_id, stream, pos, tick,
    token) of a preprocessed score.  walk(tokens, config): notes (program, is_drum, tick, dur, pitch, velocity) of one
    sequence.  graph(config): type -> types that may follow; none is forbidden without.  off: options that it never has.
    """

    tokens: Callable[[TokenizerConfig], list[str]]
    encode: Callable
    walk: Callable[[list[str], TokenizerConfig], list[tuple]]
    graph: Callable[[TokenizerConfig], dict[str, set[str]]] = lambda config: {}
    off: tuple[str, ...] = ()


OWN: dict[str, Tokenization] = {}


def effective(kind: str, config: TokenizerConfig) -> TokenizerConfig:
    """The options as the tokenization takes them."""
    off = OWN[kind].off if kind in OWN else OFF.get(kind, ())
    changes: dict = {k: False for k in off if getattr(config, k)}
    if kind == "MuMIDI":
        changes["use_programs"] = True
    return config.copy(**changes) if changes else config


def dotted(value: tuple[int, ...]) -> str:
    return ".".join(map(str, value))


class Vocabulary:
    """Tokens of a tokenization in order of id: special, base, attribute controls.  With several vocabularies, one list each."""

    def __init__(self, kind: str, config: TokenizerConfig, base: str = "REMI"):
        if kind not in KINDS and kind not in OWN:
            raise ValueError(f"{kind}: one of {', '.join([*KINDS, *OWN])}")
        self.kind, self.config, self.base = kind, effective(kind, config), base

    # --- token groups

    def special(self) -> list[str]:
        return [t if "_" in t else f"{t}_None" for t in self.config.special_tokens]

    def notes(self) -> list[str]:
        c = self.config
        lo, hi = c.pitch_range
        on_off = self.kind == "MIDILike" or self.kind == "MMM" and self.base == "MIDILike"
        out = [f"{t}_{p}" for t in (("NoteOn", "NoteOff") if on_off else ("Pitch",)) for p in range(lo, hi + 1)]
        out += [f"Velocity_{v}" for v in c.velocities] if c.use_velocities else []
        return out + ([] if on_off or not c.use_note_durations else [f"Duration_{d}" for d in self.lengths()])

    def lengths(self) -> list[str]:
        """Values of Duration and TimeShift."""
        return [v for _, v in fine_durations(self.config)] if self.kind == "PerTok" else [dotted(d) for d in self.config.durations]

    def time_shifts(self) -> list[str]:
        return [f"TimeShift_{d}" for d in self.lengths()]

    def positions(self) -> list[str]:
        return [f"Position_{i}" for i in range(self.config.tpb(4) * self.config.max_num if self.config.use_time_signatures else self.config.max_res * 4)]

    def bars(self) -> list[str]:
        n = self.config.additional_params.get("max_bar_embedding")
        return [f"Bar_{i}" for i in range(n)] if n else ["Bar_None"]

    def chords(self) -> list[str]:
        c = self.config
        if not c.use_chords:
            return []
        names = list(c.chord_maps) + ([f"ukn{n}" for n in range(*c.chord_unknown)] if c.chord_unknown else [])
        return [f"Chord_{r}:{n}" for r in PITCH_CLASSES for n in names] if c.chord_tokens_with_root_note else [f"Chord_{n}" for n in names]

    def extras(self, skip: tuple[str, ...] = ()) -> list[str]:
        c, out = self.config, []
        on_off = self.kind == "MIDILike" or self.kind == "MMM" and self.base == "MIDILike"
        if c.use_pitch_intervals and self.kind != "MuMIDI":
            out += [f"{t}_{i}" for t in ("PitchIntervalTime", "PitchIntervalChord") for i in range(-c.max_pitch_interval, c.max_pitch_interval + 1)]
        if c.use_pitchdrum_tokens:
            lo, hi = c.drums_pitch_range
            out += [f"{t}_{p}" for t in (("DrumOn", "DrumOff") if on_off else ("PitchDrum",)) for p in range(lo, hi + 1)]
        out += self.chords()
        out += [f"Rest_{dotted(r)}" for r in c.rests]
        out += [f"Tempo_{t}" for t in c.tempos] if c.use_tempos else []
        out += [f"Program_{p}" for p in sorted(c.programs)] if (c.use_programs or self.kind == "MMM") and "Program" not in skip else []
        out += [f"TimeSig_{n}/{d}" for n, d in c.time_signatures] if c.use_time_signatures else []
        if c.use_sustain_pedals:
            programs = sorted(c.programs) if c.use_programs else [0]
            out += [f"Pedal_{p}" for p in programs] + ([] if c.sustain_pedal_duration else [f"PedalOff_{p}" for p in programs])
            out += [f"Duration_{dotted(d)}" for d in c.durations] if c.sustain_pedal_duration and on_off else []
        out += [f"PitchBend_{b}" for b in c.pitch_bends] if c.use_pitch_bends else []
        return out

    def _attribute_controls(self) -> list[str]:
        c, out = self.config, []
        if c.ac_polyphony_track:
            out += [f"ACTrackOnsetPolyphony{m}_{i}" for m in ("Min", "Max") for i in range(c.ac_polyphony_min, c.ac_polyphony_max + 1)]
        if c.ac_note_duration_track:
            out += [f"ACTrackNoteDuration{n}_{i}" for n in DURATION_NAMES for i in (0, 1)]
        if c.ac_note_density_track:
            out += [f"ACTrackNoteDensity{m}_{i}" for m in ("Min", "Max") for i in range(c.ac_note_density_track_min, c.ac_note_density_track_max + 1)]
        if c.ac_repetition_track:
            n = c.ac_repetition_track_num_bins
            out += [f"ACTrackRepetition_{i / (n - 1):.2f}" for i in range(n)]
        if c.ac_polyphony_bar:
            out += [f"ACBarOnsetPolyphony{m}_{i}" for m in ("Min", "Max") for i in range(c.ac_polyphony_min, c.ac_polyphony_max + 1)]
        if c.ac_pitch_class_bar:
            out += [f"ACBarPitchClass_{i}" for i in range(12)]
        if c.ac_note_density_bar:
            out += [f"ACBarNoteDensity_{i}" for i in range(c.ac_note_density_bar_max)] + [f"ACBarNoteDensity_{c.ac_note_density_bar_max}+"]
        if c.ac_note_duration_bar:
            out += [f"ACBarNoteDuration{n}_{i}" for n in DURATION_NAMES for i in (0, 1)]
        return out

    # --- lists

    @cached_property
    def lists(self) -> list[list[str]]:
        """One list of tokens a vocabulary."""
        c, special = self.config, self.special()
        if self.kind in OWN:
            return [list(dict.fromkeys([*special, *OWN[self.kind].tokens(c), *self._attribute_controls()]))]
        if self.kind in MULTI:
            return [special + v for v in self._compound()]
        if self.kind == "MMM":
            inner = Vocabulary(self.base, c)
            tokens = [t for t in inner.lists[0] if t not in special]
            more = ["Track_Start", "Track_End", *([] if c.use_programs else [f"Program_{p}" for p in sorted(c.programs)])]
            return [list(dict.fromkeys([*special, *tokens, *more]))]
        if self.kind == "REMI":
            ends = ["Bar_End"] if c.additional_params.get("use_bar_end_tokens") else []
            tokens = [*self.bars(), *ends, *self.notes(), *self.positions(), *self.extras()]
        elif self.kind == "Structured":
            tokens = [*self.notes(), "TimeShift_0.0.1", *self.time_shifts(), *([f"PitchDrum_{p}" for p in range(c.drums_pitch_range[0], c.drums_pitch_range[1] + 1)] if c.use_pitchdrum_tokens else []), *([f"Program_{p}" for p in sorted(c.programs)] if c.use_programs else [])]
        elif self.kind == "PerTok":
            times = [f"Position_{v}" for v in positions(c)] if c.additional_params.get("use_position_toks") else self.time_shifts()
            tokens = [*self.bars(), *self.notes(), *times, *[f"MicroTiming_{v}" for v in micro_timings(c)], *self.extras()]
        else:
            tokens = [*self.notes(), *self.time_shifts(), *self.extras()]
        return [list(dict.fromkeys([*special, *tokens, *self._attribute_controls()]))]

    def _compound(self) -> list[list[str]]:
        c = self.config
        lo, hi = c.pitch_range
        drums = [f"PitchDrum_{p}" for p in range(c.drums_pitch_range[0], c.drums_pitch_range[1] + 1)] if c.use_pitchdrum_tokens else []
        pitches, velocities = [f"Pitch_{p}" for p in range(lo, hi + 1)], [f"Velocity_{v}" for v in c.velocities]
        durations = [f"Duration_{dotted(d)}" for d in c.durations]
        programs = [f"Program_{p}" for p in sorted(c.programs)]
        tempos, signatures = [f"Tempo_{t}" for t in c.tempos], [f"TimeSig_{n}/{d}" for n, d in c.time_signatures]
        bars = [f"Bar_{i}" for i in range(c.additional_params.get("max_bar_embedding") or 60)]
        if self.kind == "Octuple":
            columns = [pitches + drums, self.positions(), bars]
            columns += [velocities] if c.use_velocities else []
            columns += [durations] if c.use_note_durations else []
            columns += [programs] if c.use_programs else []
            columns += [tempos] if c.use_tempos else []
            return columns + ([signatures] if c.use_time_signatures else [])
        if self.kind == "MuMIDI":
            first = [*pitches, *drums, *programs, "Bar_None", *self.positions(), *self.chords()]
            columns = [first, [x.replace("Bar_", "BarPosEnc_") for x in bars], ["PositionPosEnc_None", *[x.replace("Position_", "PositionPosEnc_") for x in self.positions()]]]
            columns += [tempos] if c.use_tempos else []
            columns += [["Ignore_None", *velocities]] if c.use_velocities else []
            return columns + ([["Ignore_None", *durations]] if c.use_note_durations else [])
        none = ["Ignore_None"]
        columns = [["Family_Metric", "Family_Note"], [*none, "Bar_None", *self.positions()], [*none, *pitches, *drums]]
        columns += [none + velocities] if c.use_velocities else []
        columns += [none + durations] if c.use_note_durations else []
        columns += [none + programs] if c.use_programs else []
        columns += [none + self.chords()] if c.use_chords else []
        columns += [none + [f"Rest_{dotted(r)}" for r in c.rests]] if c.use_rests else []
        columns += [none + tempos] if c.use_tempos else []
        return columns + ([none + signatures] if c.use_time_signatures else [])

    @property
    def is_multi(self) -> bool:
        return self.kind in MULTI

    def __len__(self) -> int:
        return sum(map(len, self.lists))

    def ids(self, voc: int = 0) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.lists[voc])}

    def rows(self) -> list[tuple]:
        """(voc, id, token, type, value, char): char is the letter of an id in subword training."""
        letter = lambda i: chr(i + 33 if i + 33 < 0xD800 else i + 33 + 0x800)
        return [(v, i, t, t.split("_", 1)[0], t.split("_", 1)[1], letter(i)) for v, tokens in enumerate(self.lists) for i, t in enumerate(tokens)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "voc int, id int, token string, type string, value string, char string")

    def id_of(self, token: Column, voc: int = 0) -> Column:
        """Dictionary lookup in a literal map, so that no join is needed; a token outside it gives null."""
        return F.element_at(F.create_map(*[F.lit(x) for t, i in self.ids(voc).items() for x in (t, i)]), token)

    def token_of(self, id_: Column, voc: int = 0) -> Column:
        """The inverse of id_of()."""
        tokens = F.array(*[F.lit(t) for t in self.lists[voc]])
        return F.get(tokens, id_.cast("int"))

    # --- successor graph

    def graph(self) -> dict[str, set[str]]:
        """Token type -> types that may follow it; empty where a tokenization does not restrict them."""
        c, g = self.config, {}
        if self.kind in OWN:
            return {k: set(v) for k, v in OWN[self.kind].graph(c).items()}
        if self.kind == "MMM":
            g = Vocabulary(self.base, c).graph()
            for v in g.values():
                v |= {"Track_End"}
            return g
        if self.kind in ("Octuple", "PerTok"):
            return {}
        on_off = self.kind == "MIDILike"
        note = "NoteOn" if on_off else "Pitch"
        drum = "DrumOn" if on_off else "PitchDrum"
        program = c.use_programs and not c.program_changes
        heads = {"Program"} if program else {note, *([drum] if c.use_pitchdrum_tokens else [])}
        intervals = {"PitchIntervalTime", "PitchIntervalChord"} if c.use_pitch_intervals and self.kind not in ("Structured", "MuMIDI") else set()
        pitches = {note, *intervals, *([drum] if c.use_pitchdrum_tokens else [])}
        if not program:
            heads |= intervals
        if self.kind == "CPWord":
            inner = {"Bar": {"Position", "Bar"}, "Position": {"Pitch"}, "Pitch": {"Pitch", "Bar", "Position"}}
            if c.use_rests:
                inner["Rest"] = {"Rest", "Position", "Bar"}
                inner["Pitch"] |= {"Rest"}
                inner["Bar"] |= {"Rest"}
            return inner
        if self.kind == "MuMIDI":
            inner = {"Bar": {"Bar", "Position"}, "Position": {"Program"}, "Program": {"Pitch", "PitchDrum", *(["Chord"] if c.use_chords else [])}, "Chord": {"Pitch"}}
            for p in ("Pitch", "PitchDrum"):
                inner[p] = {"Pitch", "PitchDrum", "Program", "Bar", "Position"}
            return inner
        times = {"REMI": {"Position", "Bar"}}.get(self.kind, {"TimeShift"})
        last = set()
        chain = [pitches, *([{"Velocity"}] if c.use_velocities else []), *([{"Duration"}] if c.use_note_durations and not on_off else [])]
        if program:
            g["Program"] = set(pitches) | ({"NoteOff", "DrumOff"} if on_off else set())
        for here, after in zip(chain, chain[1:], strict=False):
            for t in here:
                g.setdefault(t, set()).update(after)
        last = chain[-1]
        offs = {"NoteOff", *(["DrumOff"] if c.use_pitchdrum_tokens else [])} if on_off else set()
        ends = offs if not program else ({"Program"} if on_off else set())
        if self.kind == "Structured":
            for t in last:
                g.setdefault(t, set()).add("TimeShift")
            g["TimeShift"] = set(heads)
            return g
        follow = heads | times | ends
        for t in last | offs:
            g.setdefault(t, set()).update(follow)
        extra: set[str] = set()
        extra |= {"Tempo"} if c.use_tempos else set()
        extra |= {"TimeSig"} if c.use_time_signatures and self.kind != "REMI" else set()
        extra |= ({"Program"} if program else {"Pedal", *([] if c.sustain_pedal_duration else ["PedalOff"])}) if c.use_sustain_pedals else set()
        extra |= ({"Program"} if program else {"PitchBend"}) if c.use_pitch_bends else set()
        extra |= {"Chord"} if c.use_chords and not program else set()
        extra |= {"Program"} if c.program_changes and c.use_programs else set()
        if self.kind == "REMI":
            g["Position"] = heads | extra
            g["Bar"] = {"Position", "Bar", *(["TimeSig"] if c.use_time_signatures else [])}
            if c.use_time_signatures:
                g["TimeSig"] = {"Position", "Bar"}
        else:
            g["TimeShift"] = heads | ends | extra | {"TimeShift"}
        body = heads | times | ends | extra
        for t in last | offs:
            g[t] |= body
        for t in extra - {"Program"}:
            g.setdefault(t, set()).update(body)
        if program:
            g["Program"] |= {t for t, on in (("Pedal", c.use_sustain_pedals), ("PedalOff", c.use_sustain_pedals and not c.sustain_pedal_duration), ("PitchBend", c.use_pitch_bends), ("Chord", c.use_chords)) if on}
            for t in ("Pedal", "PedalOff", "PitchBend", "Chord"):
                if t in g["Program"]:
                    g.setdefault(t, set()).update(body)
        if c.program_changes and c.use_programs:
            g.setdefault("Program", set()).update(body)
        if c.use_sustain_pedals and c.sustain_pedal_duration:
            g["Pedal"] = {"Duration"}
            g.setdefault("Duration", set()).update(body)
        if c.use_rests:
            g["Rest"] = heads | times | extra | {"Rest", *ends, *(["TimeSig"] if c.use_time_signatures else [])}
            for t in list(g):
                if t not in ("TimeShift", "Position") and times <= g[t] | {"Bar"}:
                    g[t].add("Rest")
        return g

    def graph_rows(self) -> list[tuple[str, str]]:
        """(src, dst) with the special tokens: nothing follows EOS or comes before BOS."""
        g = {k: set(v) for k, v in self.graph().items()}
        special = [t.split("_")[0] for t in self.special()]
        types = {t.split("_")[0] for tokens in self.lists for t in tokens} - set(special)
        for k in g:
            g[k] |= set(special) - {"BOS"}
        for s in special:
            g[s] = set() if s == "EOS" else types | (set(special) - {"BOS"})
        return sorted((a, b) for a, to in g.items() for b in to)


#: Note lengths that attribute controls tell apart, and their length in quarter notes.
DURATION_NAMES = ("Whole", "Half", "Quarter", "Eight", "Sixteenth")
DURATION_QUARTERS = (4.0, 2.0, 1.0, 0.5, 0.25)


def fine_durations(config: TokenizerConfig) -> list[tuple[int, str]]:
    """(ticks, `beats.ticks.tpq`) of PerTok's durations and time shifts, in order."""
    tpq = config.additional_params.get("ticks_per_quarter", 220)
    found: dict[int, str] = {}
    for beat, pos, res in config.durations:
        sub = pos * tpq // res
        found.setdefault(beat * tpq + sub, f"{beat}.{sub}.{tpq}")
    return sorted((t, v) for t, v in found.items() if t > 0)


def positions(config: TokenizerConfig) -> list[int]:
    """Ticks in the bar of PerTok's Position tokens."""
    tpq = config.additional_params.get("ticks_per_quarter", 220)
    steps = sorted({beat * tpq + pos * tpq // res for beat in range(4) for res in config.beat_res.values() for pos in range(res)})
    return steps


def micro_timings(config: TokenizerConfig) -> list[int]:
    """Ticks of the MicroTiming tokens."""
    p = config.additional_params
    tpq, n = p.get("ticks_per_quarter", 220), p.get("num_microtiming_bins", 30)
    most = int(p.get("max_microtiming_shift", 0.125) * tpq)
    return list(dict.fromkeys(int(-most + 2 * most * i / n) for i in range(n + 1)))
