"""Data augmentation: pitch, velocity and duration offsets, as a join of scores with a few offsets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.config import tessitura
from tactus.sources.tables import Score


def offsets(pitch: list[int] = (), velocity: list[int] = (), duration: list[float] = (), combinations: bool = False) -> list[tuple[int, int, float]]:
    """Offsets to apply: one axis at a time, or all combinations but (0, 0, 0)."""
    if combinations:
        found = [(p, v, d) for p, v, d in product((0, *pitch), (0, *velocity), (0, *duration)) if (p, v, d) != (0, 0, 0)]
    else:
        found = [(p, 0, 0) for p in pitch] + [(0, v, 0) for v in velocity] + [(0, 0, d) for d in duration]
    return list(dict.fromkeys(found))


def allowed_pitch_offsets(notes: DataFrame, pitch: list[int], by_tessitura: bool = True) -> DataFrame:
    """(score_id, pitch_offset): those that keep every track that isn't drums within its program's range, or within 0 to 127."""
    low = F.array(*[F.lit(tessitura(p)[0]) for p in range(128)])
    high = F.array(*[F.lit(tessitura(p)[1]) for p in range(128)])
    tracks = notes.where("not is_drum").groupBy("score_id", "track_idx", "program").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    lo = F.get(low, F.col("program")) if by_tessitura else F.lit(0)
    hi = F.get(high, F.col("program")) if by_tessitura else F.lit(127)
    # a track that is out of range already doesn't forbid anything further
    room = tracks.groupBy("score_id").agg(F.min(F.greatest(hi - F.col("hi"), F.lit(0))).alias("up"), F.min(F.greatest(F.col("lo") - lo, F.lit(0))).alias("down"))
    every = room.select("score_id", "up", "down", F.explode(F.array(*[F.lit(p) for p in pitch])).alias("pitch_offset"))
    return every.where("pitch_offset between -down and up").select("score_id", "pitch_offset")


def shifted(notes: DataFrame, p: Column, v: Column, d: Column, velocity_range: tuple[int, int] = (1, 127), min_dur: int = 1) -> DataFrame:
    """Drums keep their pitch and duration; velocities are clamped, durations have a least value."""
    lo, hi = velocity_range
    return notes.withColumns({
        "pitch": F.when(F.col("is_drum"), F.col("pitch")).otherwise(F.col("pitch") + p).cast("int"),
        "velocity": F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("velocity") + v)).cast("int"),
        "dur": F.when(F.col("is_drum"), F.col("dur")).otherwise(F.greatest(F.col("dur") + d, F.lit(min_dur))).cast("long"),
    })


def augment(
    notes: DataFrame,
    tpq: int,
    pitch: list[int] = (),
    velocity: list[int] = (),
    duration: list[float] = (),
    combinations: bool = False,
    by_tessitura: bool = True,
    min_duration: float = 0.03125,
    keep_original: bool = True,
    velocity_range: tuple[int, int] = (1, 127),
    in_ticks: bool = False,
) -> DataFrame:
    """notes of every variant, told apart by pitch_offset, velocity_offset and duration_offset (ticks); durations in beats, or in ticks.

    The offsets are a literal array, so notes are multiplied in place by one explode and never shuffled; only the few
    rows of allowed pitch offsets are joined, by score.
    """
    found = offsets(pitch, velocity, duration, combinations) + ([(0, 0, 0)] if keep_original else [])
    triples = F.array(*[F.struct(F.lit(a).alias("pitch_offset"), F.lit(b).alias("velocity_offset"), F.lit(int(c if in_ticks else c * tpq)).cast("long").alias("duration_offset")) for a, b, c in found])
    rows = notes.select("*", F.explode(triples).alias("o")).select(*notes.columns, "o.*")
    if pitch:
        zero = notes.select("score_id", F.lit(0).alias("pitch_offset")).distinct()
        rows = rows.join(allowed_pitch_offsets(notes, list(pitch), by_tessitura).union(zero), ["score_id", "pitch_offset"], "left_semi")
    return shifted(rows, F.col("pitch_offset"), F.col("velocity_offset"), F.col("duration_offset"), velocity_range, max(1, int(min_duration if in_ticks else min_duration * tpq)))


def report(augmented: DataFrame) -> DataFrame:
    """Scores and notes of each variant."""
    return augmented.groupBy("pitch_offset", "velocity_offset", "duration_offset").agg(F.countDistinct("score_id").alias("n_scores"), F.count("*").alias("n_notes"))


def suffix(p: Column, v: Column, d: Column) -> Column:
    """File name suffix of a variant, `#p1_v2_d3` with the offsets that are not 0."""
    part = lambda name, c: F.when(c != 0, F.concat(F.lit(name), c.cast("string")))
    return F.concat(F.lit("#"), F.concat_ws("_", part("p", p), part("v", v), part("d", d)))


def augment_score(score: Score, *args, **options) -> Score:  # noqa: ANN002, ANN003
    """Every variant as a score of its own, with its tempos, signatures, pedals and bends: score_id is a hash of the score's and the offsets.

    `source` has (score_id, original, suffix) of the variants; the suffix of an original is empty.
    """
    names = ["pitch_offset", "velocity_offset", "duration_offset"]
    rows = augment(score.notes, score.tpq, *args, **options)
    key = F.when(F.col(names[0]).eqNullSafe(0) & (F.col(names[1]) == 0) & (F.col(names[2]) == 0), F.col("score_id")).otherwise(F.xxhash64("score_id", *names))
    rows = rows.withColumn("__new", key)
    tail = suffix(*[F.col(n) for n in names])
    variants = rows.select(F.col("score_id").alias("original"), F.col("__new").alias("score_id"), *names).distinct().select("score_id", "original", F.when(tail != "#", tail).otherwise("").alias("suffix"))
    copies = variants.select(F.col("original").alias("__old"), F.col("score_id").alias("__new"))
    of = lambda df: None if df is None else df.join(copies, F.col("score_id") == F.col("__old")).select(F.col("__new").alias("score_id"), *[c for c in df.columns if c != "score_id"])
    notes = rows.select(F.col("__new").alias("score_id"), *[c for c in score.notes.columns if c != "score_id"])
    return Score(notes, of(score.tempos), of(score.time_sigs), of(score.pedals), of(score.bends), score.tpq, source=variants)
