"""Attribute controls: what a track or a bar is like, as aggregations.

Per-bar controls use each bar's own notes, and minima and maxima are clamped to the vocabulary on both sides.  Bars follow
the time signatures.  The controls of CONTROLS are switched on by the options; a Control of one's own is handed to
control_tokens(), or to Tokenizer.add_control(), which puts its tokens into the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tactus.config import TokenizerConfig
from tactus.operators.grid import bar_length, bar_start, notes_per_bar, section_of_bar, sections, with_bars
from tactus.plans.vocab import DURATION_NAMES, DURATION_QUARTERS

TRACK = ["score_id", "track_idx"]
BAR = [*TRACK, "bar"]


def with_bar(notes: DataFrame, tpq: int, time_sigs: DataFrame | None = None) -> DataFrame:
    return with_bars(notes, tpq, time_sigs).drop("num", "den")


def onset_polyphony(notes: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """Fewest and most notes that begin together."""
    per_tick = notes.groupBy(*keys, "tick").agg(F.count("*").alias("n"))
    clamp = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), c)).cast("int")
    return per_tick.groupBy(*keys).agg(clamp(F.min("n")).alias("poly_min"), clamp(F.max("n")).alias("poly_max"))


def pitch_classes(notes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each pitch class that is there."""
    return notes.select(*keys, (F.col("pitch") % 12).alias("pitch_class")).distinct()


def note_density(notes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Number of notes; `most` or more is one value, `most+`."""
    n = F.count("*")
    return notes.groupBy(*keys).agg(F.when(n >= most, F.lit(f"{most}+")).otherwise(n.cast("string")).alias("density"))


def note_durations(notes: DataFrame, keys: list[str], tpq: int) -> DataFrame:
    """1 for each length that a note has."""
    flags = [F.max((F.col("dur") == int(q * tpq)).cast("int")).alias(f"has_{n.lower()}") for n, q in zip(DURATION_NAMES, DURATION_QUARTERS, strict=True)]
    return notes.groupBy(*keys).agg(*flags)


def track_density(notes: DataFrame, tpq: int, lo: int, hi: int, time_sigs: DataFrame | None = None) -> DataFrame:
    """Fewest and most notes in a bar, empty bars too."""
    bars = notes_per_bar(notes, tpq, by_track=True, time_sigs=time_sigs)
    clamp = lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), c)).cast("int")
    return bars.groupBy(*TRACK).agg(clamp(F.min("n_notes")).alias("density_min"), clamp(F.max("n_notes")).alias("density_max"))


def repetition(notes: DataFrame, tpq: int, num_bins: int, num_bars: int, time_sigs: DataFrame | None = None) -> DataFrame:
    """How much of a bar's onsets and ends (pitch and place in the bar) the next num_bars - 1 bars have too, on average, to the nearest of num_bins, the lower on ties.

    Bars of another length, and bars that end after the track, are not compared; bars without a note that begins or ends
    there have nothing to be found again.  Pairs of bars come from cells that match, so only shared cells are joined.
    The mean is a fraction of whole numbers: sums of doubles fall on either side of a tie, by the order they are added in.
    """
    begins = notes.select(*TRACK, "tick", F.lit(0).alias("kind"), "pitch")
    ends = notes.select(*TRACK, (F.col("tick") + F.col("dur")).alias("tick"), F.lit(1).alias("kind"), "pitch")
    cells = with_bar(begins.unionByName(ends), tpq, time_sigs).select(*BAR, (F.col("tick") - F.col("bar_tick")).alias("at"), "kind", "pitch").distinct()
    sizes = cells.groupBy(*BAR).agg(F.count("*").alias("n"))
    # each cell to the bars that look back at it: num_bars - 1 copies, an equi-join instead of a band join
    ahead = cells.select(*TRACK, F.explode(F.expr(f"sequence(bar - {num_bars - 1}, bar - 1)")).alias("bar"), F.col("bar").alias("other"), "at", "kind", "pitch")
    same = cells.join(ahead, [*BAR, "at", "kind", "pitch"]).groupBy(*BAR, "other").agg(F.count("*").alias("shared"))
    # bars of the whole score; the last of them is compared with none
    last_tick = notes.groupBy("score_id").agg(F.max("tick").alias("tick"))
    last = with_bar(last_tick, tpq, time_sigs).select("score_id", F.col("bar").alias("last"))
    until = notes.groupBy(*TRACK).agg(F.max(F.col("tick") + F.col("dur")).alias("until"))
    pairs = sizes.join(last, "score_id").join(until, TRACK).where("bar < last")
    pairs = pairs.select(*BAR, "n", "until", F.explode(F.expr(f"sequence(bar + 1, least(bar + {num_bars - 1}, last))")).alias("other"))
    if time_sigs is None:
        pairs = pairs.where((F.col("other") + 1) * (4 * tpq) <= F.col("until"))
    else:
        pairs = pairs.join(sections(time_sigs, tpq), "score_id").withColumns({"a": section_of_bar(F.col("bar")), "b": section_of_bar(F.col("other"))})
        length = lambda x: bar_length(F.col(f"{x}.num"), F.col(f"{x}.den"), tpq)
        pairs = pairs.where((length("a") == length("b")) & (bar_start(F.col("b"), F.col("other"), tpq) + length("b") <= F.col("until")))
    counts = pairs.join(same, [*BAR, "other"], "left").groupBy(*TRACK, "n").agg(F.sum(F.coalesce("shared", F.lit(0))).alias("shared"), F.count("*").alias("pairs"))
    tracks = counts.groupBy(*TRACK).agg(F.collect_list(F.array("n", "shared", "pairs")).alias("sizes"))
    steps = num_bins - 1
    bins = [i / steps for i in range(num_bins)]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            found = []
            for sizes in b.column("sizes").to_pylist():
                num, den, count = 0, 1, 0
                for n, shared, k in sizes:
                    num, den, count = num * n + shared * den, den * n, count + k
                # the mean is num / (den * count); ceil(mean * steps - 1 / 2)
                found.append(bins[max(-((den * count - 2 * num * steps) // (2 * den * count)), 0)])
            yield pa.RecordBatch.from_arrays([b.column(k) for k in TRACK] + [pa.array(found, pa.float64())], names=[*TRACK, "repetition"])

    return tracks.mapInArrow(run, StructType(tracks.select(*TRACK).schema.fields).add("repetition", DoubleType()))


@dataclass(frozen=True)
class Control:
    """An attribute control: its tokens' name, whether it is on, and its values.

    rows(notes, config, time_sigs) gives (score_id, track_idx, [bar, bar_tick,] name -> value columns); a null value
    gives no token.  `columns` maps columns to what follows `name` in the token.
    """

    name: str
    columns: dict[str, str]
    rows: Callable[[DataFrame, TokenizerConfig, DataFrame | None], DataFrame]
    bar: bool = False
    on: Callable[[TokenizerConfig], bool] = lambda config: True
    #: the tokens of a control of one's own; those that the options switch on are in the vocabulary
    tokens: tuple[str, ...] = ()

    @property
    def head(self) -> str:
        return "ACBar" if self.bar else "ACTrack"


_POLYPHONY = {"poly_min": "Min", "poly_max": "Max"}
_FLAGS = {f"has_{n.lower()}": n for n in DURATION_NAMES}
_BAR = [*BAR, "bar_tick"]
_barred = lambda n, c, ts: with_bar(n, c.tpq, ts)


def _classes(notes: DataFrame, config: TokenizerConfig, time_sigs: DataFrame | None) -> DataFrame:
    """The pitch classes of a bar as twelve columns."""
    found = F.collect_set((F.col("pitch") % 12).cast("int"))
    rows = _barred(notes, config, time_sigs).groupBy(*_BAR).agg(found.alias("set"))
    return rows.select(*_BAR, *[F.when(F.array_contains("set", i), F.lit(i)).alias(f"class_{i}") for i in range(12)])


#: In order of place at a tick.
CONTROLS: tuple[Control, ...] = (
    Control("OnsetPolyphony", _POLYPHONY, lambda n, c, ts: onset_polyphony(n, TRACK, c.ac_polyphony_min, c.ac_polyphony_max), on=lambda c: c.ac_polyphony_track),
    Control("NoteDuration", _FLAGS, lambda n, c, ts: note_durations(n, TRACK, c.tpq), on=lambda c: c.ac_note_duration_track),
    Control("NoteDensity", {"density_min": "Min", "density_max": "Max"}, lambda n, c, ts: track_density(n, c.tpq, c.ac_note_density_track_min, c.ac_note_density_track_max, ts), on=lambda c: c.ac_note_density_track),
    Control(
        "Repetition",
        {"repetition": ""},
        lambda n, c, ts: repetition(n, c.tpq, c.ac_repetition_track_num_bins, c.ac_repetition_track_num_consec_bars, ts).withColumn("repetition", F.format_number("repetition", 2)),
        on=lambda c: c.ac_repetition_track,
    ),
    Control("OnsetPolyphony", _POLYPHONY, lambda n, c, ts: onset_polyphony(_barred(n, c, ts), _BAR, c.ac_polyphony_min, c.ac_polyphony_max), True, lambda c: c.ac_polyphony_bar),
    Control("PitchClass", {f"class_{i}": "" for i in range(12)}, _classes, True, lambda c: c.ac_pitch_class_bar),
    Control("NoteDensity", {"density": ""}, lambda n, c, ts: note_density(_barred(n, c, ts), _BAR, c.ac_note_density_bar_max), True, lambda c: c.ac_note_density_bar),
    Control("NoteDuration", _FLAGS, lambda n, c, ts: note_durations(_barred(n, c, ts), _BAR, c.tpq), True, lambda c: c.ac_note_duration_bar),
)


def own_control(name: str, values: Column, tokens: tuple[str, ...], bar: bool = False) -> Control:
    """A control whose value is an aggregate over the notes of a bar or track, and the values that it can have."""
    keys = _BAR if bar else TRACK
    rows = lambda n, c, ts: (_barred(n, c, ts) if bar else n).groupBy(*keys).agg(values.alias("value"))
    made = Control(name, {"value": ""}, rows, bar)
    return Control(name, {"value": ""}, rows, bar, tokens=tuple(f"{made.head}{name}_{t}" for t in tokens))


def sample_rows(rows: DataFrame, keys: list[str], ratio: Column | float, seed: int, order: list[str]) -> DataFrame:
    """Of each group round(ratio * n) rows, chosen by a hash, so that reruns agree."""
    w = Window.partitionBy(*keys)
    by = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]).cast("binary"))
    rows = rows.withColumns({"__n": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(by, *order))})
    return rows.where(F.col("__r") <= F.rint(F.col("__n") * ratio)).drop("__n", "__r")


Ratio = float | tuple[float, float] | None


def _ratio(value: Ratio, seed: int, keys: list[str]) -> Column:
    """A ratio, or one between two bounds by the hash of the keys."""
    if not isinstance(value, tuple):
        return F.lit(float(value or 0.0))
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("ratio"), *keys), F.lit(1 << 20)) / float(1 << 20)
    return F.lit(value[0]) + u * (value[1] - value[0])


def sampled(controls: DataFrame, track_ratio: Ratio, bar_ratio: Ratio, seed: int = 0) -> DataFrame:
    """Of control_tokens(): for each track round(track_ratio * n) of its n track controls, and of each bar control round(bar_ratio * n) of its n bars, by hash.

    A pair of ratios is a range of which each track takes one.
    """
    rows = controls.withColumn("__name", F.regexp_extract("token", r"^(?:ACTrack|ACBar)[A-Z][a-z]+(?:[A-Z][a-z]+)??(?=Min_|Max_|_|Whole|Half|Quarter|Eight|Sixteenth)", 0))
    tracks = rows.where("head = 'ACTrack'").select(*TRACK, "__name").distinct()
    tracks = sample_rows(tracks.withColumn("__k", _ratio(track_ratio, seed, TRACK)), TRACK, F.col("__k"), seed, ["__name", *TRACK]).drop("__k")
    bars = rows.where("head = 'ACBar'").select(*TRACK, "__name", "tick").distinct()
    bars = sample_rows(bars.withColumn("__k", _ratio(bar_ratio, seed + 1, [*TRACK, "__name"])), [*TRACK, "__name"], F.col("__k"), seed + 1, ["tick", "__name", *TRACK]).drop("__k")
    kept = rows.where("head = 'ACTrack'").join(tracks, [*TRACK, "__name"], "left_semi").unionByName(rows.where("head = 'ACBar'").join(bars, [*TRACK, "__name", "tick"], "left_semi"))
    return kept.drop("__name")


def control_tokens(notes: DataFrame, config: TokenizerConfig, time_sigs: DataFrame | None = None, own: tuple[Control, ...] = ()) -> DataFrame:
    """(score_id, track_idx, tick, place, head, token) of the controls that the options ask for and one's own: a track's at tick 0, a bar's at its first tick."""
    made: list[DataFrame] = []
    for place, control in enumerate([c for c in CONTROLS if c.on(config)] + list(own)):
        rows = control.rows(notes, config, time_sigs)
        tokens = F.filter(F.array(*[F.concat(F.lit(f"{control.head}{control.name}{after}_"), F.col(c).cast("string")) for c, after in control.columns.items()]), lambda x: x.isNotNull())
        tick = F.col("bar_tick") if control.bar else F.lit(0).cast("long")
        found = rows.select(*TRACK, tick.alias("tick"), F.lit(control.head).alias("head"), F.posexplode(tokens).alias("k", "token"))
        # a track's controls stand before a bar's
        made.append(found.withColumn("place", F.col("k") + 100 * (place + (1_000 if control.bar else 0))).drop("k"))
    if not made:
        raise ValueError("no attribute control is on")
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out
