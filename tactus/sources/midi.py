"""Standard MIDI files: bytes to rows and rows to bytes.

read_midi() parses whole files in Arrow batches (a file is one unit of work, as its delta times chain); a file that
can't be parsed becomes one row with `error` and no data, so counts of bad input are kept.
"""

from __future__ import annotations

import struct
from collections import defaultdict, deque
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.sources.tables import Score

#: kind: note, pedal, bend, control, tempo, time_sig, key_sig, marker, track or error; a and b are its values.
ROWS = "path string, tpq int, kind string, track_idx int, program int, is_drum boolean, tick long, dur long, a int, b int, qpm double, text string"


#: Rows of parsed files that leave a task together.
BATCH_ROWS = 50_000


class MidiError(ValueError):
    pass


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for _ in range(4):
        if at >= len(data):
            raise MidiError("ends within a number")
        byte = data[at]
        at += 1
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            return value, at
    raise MidiError("number of more than four bytes")


def _track_events(data: bytes):  # noqa: ANN202
    """(tick, status, bytes) of a track chunk; metas as (tick, 0xFF, type, bytes)."""
    at = tick = 0
    running = 0
    while at < len(data):
        delta, at = _varlen(data, at)
        tick += delta
        if at >= len(data):
            raise MidiError("ends within an event")
        status = data[at]
        if status >= 0x80:
            at += 1
        elif running:
            status = running
        else:
            raise MidiError("no status byte")
        if status == 0xFF:
            if at >= len(data):
                raise MidiError("ends within a meta event")
            kind = data[at]
            n, at = _varlen(data, at + 1)
            yield tick, 0xFF, kind, data[at : at + n]
            at += n
            if kind == 0x2F:
                return
        elif status in (0xF0, 0xF7):
            n, at = _varlen(data, at)
            at += n
        else:
            running = status
            n = 1 if status >> 4 in (0xC, 0xD) else 2
            if at + n > len(data):
                raise MidiError("ends within an event")
            yield tick, status, 0, data[at : at + n]
            at += n


def parse(data: bytes) -> tuple[int, list[tuple]]:
    """(ticks a quarter, rows without path and tpq).  A track of rows is one channel and program of a track chunk."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise MidiError("no MIDI header")
    length, _, count, division = struct.unpack(">IHHH", data[4:14])
    if division & 0x8000 or not division:
        raise MidiError("no ticks a quarter")
    at, rows, tracks = 8 + length, [], {}
    for chunk in range(count):
        if data[at : at + 4] != b"MTrk":
            raise MidiError(f"no track {chunk}")
        (n,) = struct.unpack(">I", data[at + 4 : at + 8])
        body, at = data[at + 8 : at + 8 + n], at + 8 + n
        program: dict[int, int] = defaultdict(int)
        opened: dict[tuple, deque] = defaultdict(deque)
        pedal: dict[int, int] = {}
        name = ""
        for tick, status, kind, value in _track_events(body):
            channel, what = status & 15, status >> 4
            if status == 0xFF:
                if kind == 0x51 and len(value) == 3:
                    rows.append(("tempo", None, None, None, tick, None, None, None, 6e7 / max(int.from_bytes(value, "big"), 1), None))
                elif kind == 0x58 and len(value) >= 2:
                    rows.append(("time_sig", None, None, None, tick, None, value[0], 1 << value[1], None, None))
                elif kind == 0x59 and len(value) >= 2:
                    rows.append(("key_sig", None, None, None, tick, None, struct.unpack("b", value[:1])[0], value[1], None, None))
                elif kind == 0x03:
                    name = value.decode("utf-8", "replace")
                elif kind in (0x05, 0x06):
                    rows.append(("lyric" if kind == 5 else "marker", None, None, None, tick, None, None, None, None, value.decode("utf-8", "replace")))
                continue
            drum = channel == 9
            track = tracks.setdefault((chunk, channel, -1 if drum else program[channel]), len(tracks))
            who = (track, -1 if drum else program[channel], drum)
            if what == 0x9 and value[1]:
                opened[channel, value[0]].append((tick, value[1], who))
            elif what in (0x8, 0x9):
                if opened[channel, value[0]]:
                    begin, velocity, who = opened[channel, value[0]].popleft()
                    rows.append(("note", *who, begin, tick - begin, value[0], velocity, None, None))
            elif what == 0xC:
                program[channel] = value[0]
            elif what == 0xE:
                rows.append(("bend", *who, tick, None, (value[1] << 7 | value[0]) - 8192, None, None, None))
            elif what == 0xB:
                if value[0] == 64:
                    if value[1] >= 64:
                        pedal.setdefault(channel, tick)
                    elif channel in pedal:
                        begin = pedal.pop(channel)
                        rows.append(("pedal", *who, begin, tick - begin, None, None, None, None))
                else:
                    rows.append(("control", *who, tick, None, value[0], value[1], None, None))
        if name:
            rows.append(("track", chunk, None, None, 0, None, None, None, None, name))
    return division, rows


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all .mid and .midi files below a path, of any case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][iI][dD]*").option("recursiveFileLookup", "true").load(path)
    return parse_files(files.select("path", "content"))


def parse_files(files: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in ROWS.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            held: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    tpq, rows = parse(content.as_py())
                    held += [(path, tpq, *r) for r in rows]
                except (MidiError, struct.error, IndexError) as e:
                    held.append((path, None, "error", *[None] * 8, str(e)))
                if len(held) >= BATCH_ROWS:
                    yield table(held)
                    held = []
            if held:
                yield table(held)

    return files.select("path", "content").mapInArrow(run, ROWS)


def to_score(rows: DataFrame, tpq: int) -> Score:
    """Tables of parsed rows, ticks brought to one tpq; score_id is a hash of the path."""
    rows = rows.withColumn("score_id", F.xxhash64("path"))
    at = lambda c: F.rint(F.col(c) * tpq / F.col("tpq")).cast("long")
    of = lambda kind: rows.where(F.col("kind") == kind)
    who = ["score_id", "track_idx"]
    notes = of("note").select(*who, "program", "is_drum", at("tick").alias("tick"), at("dur").alias("dur"), F.col("a").alias("pitch"), F.col("b").alias("velocity"))
    tables = Score(notes, of("tempo").select("score_id", at("tick").alias("tick"), "qpm"), of("time_sig").select("score_id", at("tick").alias("tick"), F.col("a").alias("num"), F.col("b").alias("den")), of("pedal").select(*who, at("tick").alias("tick"), at("dur").alias("dur")), of("bend").select(*who, at("tick").alias("tick"), F.col("a").alias("value")), tpq, of("error").select("path", F.col("text").alias("error")))
    tables.source = rows
    return tables


def _number(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def _chunk(events: list[tuple[int, int, bytes]]) -> bytes:
    body, last = bytearray(), 0
    for tick, _, data in sorted(events, key=lambda e: (e[0], e[1])):
        body += _number(tick - last) + data
        last = tick
    body += b"\0\xff\x2f\0"
    return b"MTrk" + struct.pack(">I", len(body)) + bytes(body)


def build(notes: list[tuple], tpq: int, tempos: list[tuple] = (), time_sigs: list[tuple] = (), pedals: list[tuple] = (), bends: list[tuple] = ()) -> bytes:
    """A file of notes (track, program, is_drum, tick, dur, pitch, velocity), pedals (track, tick, dur) and bends (track, tick, value)."""
    first = [(t, 0, b"\xff\x51\x03" + round(6e7 / q).to_bytes(3, "big")) for t, q in tempos or [(0, 120.0)]]
    first += [(t, 0, bytes([0xFF, 0x58, 4, n, d.bit_length() - 1, 24, 8])) for t, n, d in time_sigs or [(0, 4, 4)]]
    chunks, free = [_chunk(first)], deque(c for c in range(16) if c != 9)
    held: dict[int, list] = defaultdict(list)
    for n in notes:
        held[n[0]].append(n)
    for track in sorted({*held, *(p[0] for p in pedals), *(b[0] for b in bends)}):
        mine = held[track]
        drum, program = (mine[0][2], mine[0][1]) if mine else (False, 0)  # a track of pedals and bends alone has program 0
        channel = 9 if drum else free[0]
        free.rotate(-1) if not drum else None
        events = [(0, 0, bytes([0xC0 | channel, max(program, 0)]))]
        for _, _, _, tick, dur, pitch, velocity in mine:
            events += [(tick, 3, bytes([0x90 | channel, pitch, velocity])), (tick + dur, 2, bytes([0x80 | channel, pitch, 0]))]
        for t, tick, dur in pedals:
            if t == track:
                events += [(tick, 1, bytes([0xB0 | channel, 64, 127])), (tick + dur, 1, bytes([0xB0 | channel, 64, 0]))]
        events += [(tick, 1, bytes([0xE0 | channel, (v + 8192) & 127, (v + 8192) >> 7])) for t, tick, v in bends if t == track]
        chunks.append(_chunk(events))
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(chunks), tpq) + b"".join(chunks)


def to_files(score: Score | DataFrame, tpq: int | None = None) -> DataFrame:
    """(score_id, content) of each score as a MIDI file, with tempos, time signatures, pedals and bends; or of notes alone.

    All tables meet as rows of one shape, a score's in one group.
    """
    score = score if isinstance(score, Score) else Score(score)
    tpq = tpq or score.tpq
    none = F.lit(None)

    def rows(df: DataFrame | None, kind: str, **columns: Column) -> DataFrame | None:
        if df is None:
            return None
        shape = {"track_idx": none.cast("int"), "program": none.cast("int"), "is_drum": none.cast("boolean"), "dur": none.cast("long"), "a": none.cast("int"), "b": none.cast("int"), "qpm": none.cast("double")} | columns
        return df.select("score_id", F.lit(kind).alias("kind"), F.col("tick").cast("long").alias("tick"), *[c.alias(k) for k, c in shape.items()])

    track, dur = F.col("track_idx").cast("int"), F.col("dur").cast("long")
    found = [
        rows(score.notes, "note", track_idx=track, program=F.col("program").cast("int"), is_drum=F.col("is_drum"), dur=dur, a=F.col("pitch").cast("int"), b=F.col("velocity").cast("int")),
        rows(score.tempos, "tempo", qpm=F.col("qpm")),
        rows(score.time_sigs, "time_sig", a=F.col("num").cast("int"), b=F.col("den").cast("int")),
        rows(score.pedals, "pedal", track_idx=track, dur=dur),
        rows(score.bends, "bend", track_idx=track, a=F.col("value").cast("int")),
    ]
    every = reduce(lambda a, b: a.unionByName(b), [f for f in found if f is not None])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def of(kind: str, *columns: str) -> list[tuple]:
            part = pdf[pdf["kind"] == kind][list(columns)].sort_values(list(columns), kind="stable")
            return [tuple(float(x) if c == "qpm" else int(x) for c, x in zip(columns, r, strict=True)) for r in part.itertuples(index=False, name=None)]

        notes = [(t, program, drum, tick, dur, pitch, velocity) for t, tick, pitch, dur, velocity, program, drum in of("note", "track_idx", "tick", "a", "dur", "b", "program", "is_drum")]
        content = build(notes, tpq, of("tempo", "tick", "qpm"), of("time_sig", "tick", "a", "b"), of("pedal", "track_idx", "tick", "dur"), of("bend", "track_idx", "tick", "a"))
        return pd.DataFrame({"score_id": [pdf["score_id"].iloc[0]], "content": [content]})

    return every.groupBy("score_id").applyInPandas(run, "score_id long, content binary")


def write_files(files: DataFrame, folder: str, name: str = "score_id") -> DataFrame:
    """(path, bytes) of files (`name`, content) written below a folder that all executors reach, by any file system that Arrow knows.

    A file is written under its own name, so a task that runs twice writes the same file again.
    """

    def run(batches):  # noqa: ANN001, ANN202
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            paths = []
            for key, content in zip(b[name], b["content"], strict=True):
                with store.open_output_stream(f"{root}/{key}.mid") as f:
                    f.write(bytes(content))
                paths.append(f"{folder}/{key}.mid")
            yield pd.DataFrame({"path": paths, "bytes": [len(c) for c in b["content"]]})

    return files.select(name, "content").mapInPandas(run, "path string, bytes long")


def valid_files(rows: DataFrame, valid: Column | None = None) -> DataFrame:
    """Rows of the files that were parsed, and of which `valid`, an aggregate over a file's rows, holds.  Files are never deleted."""
    good = rows.groupBy("path").agg(F.max((F.col("kind") == "error").cast("int")).alias("bad"), (F.lit(True) if valid is None else valid).alias("ok"))
    return rows.join(good.where("bad = 0 and ok").select("path"), "path", "left_semi")
