"""Scores as tables.  The star-schema tables hold no music, so a deterministic view over `lineitem` stands in for parsed scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TPQ = 480
NOTES = "score_id long, track_idx int, program int, is_drum boolean, tick long, dur long, pitch int, velocity int"
TEMPOS = "score_id long, tick long, qpm double"
TIME_SIGS = "score_id long, tick long, num int, den int"
PEDALS = "score_id long, track_idx int, tick long, dur long"
BENDS = "score_id long, track_idx int, tick long, value int"


@dataclass
class Score:
    """Tables of many scores, joined by score_id.  Absent tables are None; ticks are at `tpq` a quarter note."""

    notes: DataFrame
    tempos: DataFrame | None = None
    time_sigs: DataFrame | None = None
    pedals: DataFrame | None = None
    bends: DataFrame | None = None
    tpq: int = RAW_TPQ
    errors: DataFrame | None = field(default=None)
    #: what the tables were made from, if it is kept: unpersist() it when they are no longer needed
    source: DataFrame | None = field(default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` read as notes at 480 ticks a quarter: a supplier is a score, a line number a track, line 7 the drums."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    drum = F.col("l_linenumber") == 7
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("score_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("track_idx"),
        F.when(drum, -1).otherwise((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 128).cast("int").alias("program"),
        drum.alias("is_drum"),
        (days * 120 + (F.col("l_partkey") % 7) * 30).cast("long").alias("tick"),
        (F.col("l_quantity") * 30).cast("long").alias("dur"),
        (F.lit(21) + F.col("l_partkey") % 88).cast("int").alias("pitch"),
        (F.lit(1) + F.col("l_orderkey") % 127).cast("int").alias("velocity"),
    )


def companions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tempos and time signatures for the scores of notes_view(): three tempos, and a change from 4/4 to 3/4 to 6/8 on bar lines."""
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("score_id")).distinct()
    s = F.col("score_id")
    tempos = scores.select("score_id", F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("tick"), (60.0 + (s * k) % 150).alias("qpm")) for t, k in ((0, 7), (153_600, 11), (225_600, 13))])).alias("t")).select("score_id", "t.*")
    signatures = scores.select("score_id", F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("tick"), F.lit(n).alias("num"), F.lit(d).alias("den")) for t, n, d in ((0, 4, 4), (153_600, 3, 4), (225_600, 6, 8))])).alias("t")).select("score_id", "t.*")
    return tempos, signatures


def effects_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pedals and pitch bends for the scores of notes_view(): pedals from lines of more than 40 pieces, bends from discounts of 9 % and more, one a tick."""
    lines = table(spark, sf_dir, "lineitem")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    who = [F.col("l_suppkey").alias("score_id"), (F.col("l_linenumber") - 1).cast("int").alias("track_idx"), (days * 120).cast("long").alias("tick")]
    pedals = lines.where("l_quantity > 40").select(*who, (F.col("l_quantity") * 60).cast("long").alias("dur"))
    bends = lines.where("l_discount > 0.085").select(*who, ((F.col("l_partkey") * 37) % 16384 - 8192).cast("int").alias("value"))
    return pedals, bends.groupBy("score_id", "track_idx", "tick").agg(F.max("value").alias("value"))


def score_tables(spark: SparkSession, sf_dir: str, with_globals: bool = False, with_effects: bool = False) -> Score:
    tempos, signatures = companions(spark, sf_dir) if with_globals else (None, None)
    pedals, bends = effects_view(spark, sf_dir) if with_effects else (None, None)
    return Score(notes_view(spark, sf_dir), tempos, signatures, pedals, bends)
