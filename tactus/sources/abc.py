"""ABC notation: tunes to notes.  Fields X, T, M, L, Q, K; notes with accidentals, octaves and lengths, rests, ties, chords,
broken rhythm, tuplets, repeats with first and second endings; grace notes and decorations make no notes."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.sources.tables import Score

NOTES = "path string, tune int, title string, track_idx int, program int, is_drum boolean, tick long, dur long, pitch int, velocity int, num int, den int"
TPQ = 480
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARPS, MODES = "FCGDAEB", {"maj": 0, "ion": 0, "": 0, "mix": -1, "dor": -2, "m": -3, "min": -3, "aeo": -3, "phr": -4, "loc": -5, "lyd": 1}
FIFTHS = {"C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5, "F": -1}
TUPLETS = {2: 3, 3: 2, 4: 3, 6: 2, 8: 3}
TOKEN = re.compile(
    r'"[^"]*"|\{[^}]*\}|![^!]*!|\[[A-Za-z]:[^\]]*\]|\[(?P<ending>\d)|(?P<bar>\|\]|\[\||:\|:?\d?|\|:|\|\||\|\d?|::)'
    r"|\((?P<tuplet>\d)(?::(?P<tq>\d*))?(?::(?P<tr>\d*))?|(?P<broken>[<>]+)|(?P<chord>\[)|(?P<close>\](?P<clen>\d*/*\d*))"
    r"|(?P<acc>\^\^|__|\^|_|=)?(?P<note>[A-Ga-gzxZ])(?P<oct>[,']*)(?P<len>\d*/*\d*)|(?P<tie>-)|(?P<other>.)",
    re.S,
)


def key_accidentals(key: str) -> dict[str, int]:
    m = re.match(r"\s*([A-G])([#b]?)\s*([A-Za-z]*)", key)
    if not m:
        return {}
    mode = m[3].lower()
    mode = "m" if mode == "m" else mode[:3]
    n = FIFTHS[m[1]] + {"#": 7, "b": -7, "": 0}[m[2]] + MODES.get(mode, 0)
    return {s: 1 for s in SHARPS[:n]} if n >= 0 else {s: -1 for s in SHARPS[::-1][:-n]}


def _length(text: str) -> Fraction:
    if not text:
        return Fraction(1)
    num, slash, den = text.partition("/")
    if not slash:
        return Fraction(int(num))
    halves = den.count("/") + 1
    den = den.replace("/", "")
    return Fraction(int(num or 1), int(den) if den else 2**halves)


def _meter(value: str) -> tuple[int, int]:
    value = value.strip()
    if value.startswith("C"):
        return (2, 2) if value.startswith("C|") else (4, 4)
    m = re.match(r"(\d+)\s*/\s*(\d+)", value)
    return (int(m[1]), int(m[2])) if m else (4, 4)


def _unfold(body: str) -> str:
    """The music with its repeats written out, first and second endings each in their turn."""
    parts = re.split(r"(\|:|::|:\|\]?|:\|(?=\d)|\|\||\|\])", body)
    out, section = [], []
    for p in parts:
        if p in ("|:", "||", "|]"):
            out.append("".join(section))
            section = []
        elif p == "::" or p.startswith(":|"):
            text = "".join(section)
            head, mark, first = text.partition("|1") if "|1" in text else text.partition("[1")
            out.append(f"{head}|{first}|{head}|" if mark else f"{text}|{text}|")
            section = []
        else:
            section.append(p)
    return "|".join([*out, "".join(section)])


def parse_tune(text: str) -> tuple[str, tuple[int, int], list[tuple[int, int, int]]]:
    """(title, meter, notes as (tick, dur, pitch))."""
    title, meter, unit, key, music = "", (4, 4), None, {}, []
    for line in text.splitlines():
        line = line.split("%")[0].rstrip()
        m = re.match(r"([A-Za-z]):(.*)", line)
        if m:
            if m[1] == "T" and not title:
                title = m[2].strip()
            elif m[1] == "M":
                meter = _meter(m[2])
            elif m[1] == "L":
                unit = Fraction(*map(int, m[2].strip().split("/")))
            elif m[1] == "K":
                key = key_accidentals(m[2])
        elif line:
            music.append(line.rstrip("\\"))
    unit = unit or (Fraction(1, 16) if Fraction(*meter) < Fraction(3, 4) else Fraction(1, 8))
    at, notes, bar, tuplet, broken, chord, tied = Fraction(0), [], {}, (0, Fraction(1)), Fraction(1), None, False
    for m in TOKEN.finditer(_unfold("\n".join(music))):
        if m["bar"]:
            bar = {}
        elif m["tuplet"]:
            p = int(m["tuplet"])
            q = int(m["tq"]) if m["tq"] else TUPLETS.get(p, 3 if meter[1] == 8 and meter[0] % 3 == 0 else 2)
            tuplet = (int(m["tr"]) if m["tr"] else p, Fraction(q, p))
        elif m["broken"]:
            n = len(m["broken"])
            long, short = 2 - Fraction(1, 2**n), Fraction(1, 2**n)
            this, broken = (long, short) if m["broken"][0] == ">" else (short, long)
            if notes:  # the note before, and all of its chord
                begin, span = notes[-1][0], notes[-1][1]
                for i in range(len(notes) - 1, -1, -1):
                    if notes[i][0] != begin:
                        break
                    notes[i] = (begin, span * this, notes[i][2])
                at = begin + span * this
        elif m["chord"]:
            chord = []
        elif m["close"] and chord is not None:
            scale = _length(m["clen"]) if m["clen"] else Fraction(1)
            span = max((d for d, _ in chord), default=Fraction(0)) * scale
            notes += [(at, d * scale, p) for d, p in chord]
            at, chord = at + span, None
        elif m["tie"]:
            tied = True
            continue
        elif m["note"]:
            span = _length(m["len"]) * unit * 4 * broken
            if tuplet[0]:
                span, tuplet = span * tuplet[1], (tuplet[0] - 1 if chord is None else tuplet[0], tuplet[1])
            if m["note"] in "zxZ":
                at, broken, tied = at + span, Fraction(1), False
                continue
            step = m["note"].upper()
            octave = (5 if m["note"].islower() else 4) + m["oct"].count("'") - m["oct"].count(",")
            if m["acc"]:
                bar[step, octave] = {"^": 1, "^^": 2, "_": -1, "__": -2, "=": 0}[m["acc"]]
            pitch = 12 * (octave + 1) + STEPS[step] + bar.get((step, octave), key.get(step, 0))
            if chord is not None:
                chord.append((span, pitch))
                continue
            if tied and notes and notes[-1][2] == pitch:
                notes[-1] = (notes[-1][0], notes[-1][1] + span, pitch)
            else:
                notes.append((at, span, pitch))
            at, broken = at + span, Fraction(1)
        tied = False
    return title, meter, [(int(t * TPQ), int(d * TPQ), p) for t, d, p in notes]


def to_score(rows: DataFrame) -> Score:
    """Tables of parsed tunes at TPQ ticks a quarter, with their meter; score_id is a hash of path and tune."""
    rows = rows.withColumn("score_id", F.xxhash64("path", "tune"))
    meters = rows.groupBy("score_id").agg(F.first("num").alias("num"), F.first("den").alias("den"))
    notes = rows.select("score_id", "track_idx", "program", "is_drum", "tick", "dur", "pitch", "velocity")
    return Score(notes, time_sigs=meters.select("score_id", F.lit(0).cast("long").alias("tick"), "num", "den"), tpq=TPQ, source=rows)


def read_abc(spark: SparkSession, path: str) -> DataFrame:
    """Notes of all .abc files below a path; a file may hold many tunes, told apart by their X: field."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[aA][bB][cC]").option("recursiveFileLookup", "true").load(path)
    names = [x.split()[0] for x in NOTES.split(", ")]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                tunes = [t for t in re.split(r"(?m)^(?=X:)", bytes(content).decode("utf-8", "replace")) if t.startswith("X:")]
                rows = [(name, i, title, 0, 0, False, t, d, p, 100, *meter) for i, tune in enumerate(tunes) for title, meter, notes in [parse_tune(tune)] for t, d, p in notes]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, NOTES)
