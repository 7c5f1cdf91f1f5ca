"""Tracks and scores as wholes: what they hold, and how they come together."""

from __future__ import annotations

import dataclasses
import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.operators.preprocess import moved
from tactus.sources.tables import Score

TRACK = ["score_id", "track_idx"]


def programs(notes: DataFrame) -> DataFrame:
    """(score_id, programs): struct(program, is_drum) of the tracks in their order."""
    rows = notes.groupBy(*TRACK).agg(F.min("program").alias("program"), F.max("is_drum").alias("is_drum"))
    return rows.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", "program", "is_drum"))), lambda t: F.struct(t["program"].alias("program"), t["is_drum"].alias("is_drum"))).alias("programs"))


def empty_tracks(tracks: DataFrame, score: Score, check_pedals: bool = False, check_bends: bool = False) -> DataFrame:
    """The tracks without a note, and, if checked, without pedals and bends."""
    held = [score.notes, *([score.pedals] if check_pedals and score.pedals is not None else []), *([score.bends] if check_bends and score.bends is not None else [])]
    for df in held:
        tracks = tracks.join(df.select(*TRACK).distinct(), TRACK, "left_anti")
    return tracks


def merge_tracks(score: Score, names: DataFrame | None = None, effects: bool = True) -> tuple[Score, DataFrame | None]:
    """All tracks of a score as one, the first, with notes, pedals and bends; and its name with those of the others, ` / ` between them.

    names: (score_id, track_idx, name).  Without effects, pedals and bends of the first track alone stay.
    """
    tracks = reduce(lambda a, b: a.unionByName(b), [t.select(*TRACK) for t in (score.notes, score.pedals, score.bends) if t is not None]).distinct()
    first = score.notes.groupBy("score_id").agg(F.min("track_idx").alias("first"))
    to = tracks.join(first, "score_id")
    merged = moved(score, to)
    if not effects:
        own = lambda t: t if t is None else t.join(first.withColumnRenamed("first", "track_idx"), TRACK, "left_semi")
        merged = dataclasses.replace(merged, pedals=own(score.pedals), bends=own(score.bends))
    # one track has one program: that of the first
    program = score.notes.join(first.withColumnRenamed("first", "track_idx"), TRACK, "left_semi").groupBy("score_id").agg(F.min("program").alias("__p"), F.max("is_drum").alias("__d"))
    notes = merged.notes.join(program, "score_id").withColumns({"program": F.col("__p"), "is_drum": F.col("__d")}).select(*score.notes.columns)
    merged = dataclasses.replace(merged, notes=notes)
    joined = None
    if names is not None:
        joined = names.groupBy("score_id").agg(F.min("track_idx").alias("track_idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", "name"))), lambda t: t["name"]), " / ").alias("name"))
    return merged, joined


def merge_scores(scores: list[Score]) -> Score:
    """Tables of several scores in one; they must have the same tpq."""
    if len({s.tpq for s in scores}) != 1:
        raise ValueError("scores of different ticks a quarter")

    def all_of(name: str) -> DataFrame | None:
        found = [getattr(s, name) for s in scores if getattr(s, name) is not None]
        return reduce(lambda a, b: a.unionByName(b), found) if found else None

    return Score(all_of("notes"), all_of("tempos"), all_of("time_sigs"), all_of("pedals"), all_of("bends"), scores[0].tpq)


def common_folder(paths: list[str]) -> str:
    """The deepest folder that holds all paths."""
    return os.path.commonpath([os.path.dirname(p) for p in paths])
