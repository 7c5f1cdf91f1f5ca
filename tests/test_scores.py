"""Golden cases of the grid and of duplicates, fixpoints, and round trips with many options."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.functions.columns import greedy, nearest
from tactus.operators import attributes, decode, encode, grid, preprocess, tracks, validate
from tactus.plans.vocab import KINDS, Vocabulary, effective
from tactus.sources.tables import NOTES, Score, score_tables

BAR = 1920


def _notes(spark, rows):
    return spark.createDataFrame([(1, 0, 0, False, t, d, p, 100) for t, d, p in rows], NOTES)


@pytest.mark.parametrize(
    ("onsets", "end", "only", "num", "expected"),
    [
        ([0, BAR, 2 * BAR, 3 * BAR], None, True, 4, [0, BAR, 2 * BAR, 3 * BAR]),
        ([1, BAR + 1, 2 * BAR + 1], None, True, 4, [0, BAR, 2 * BAR]),
        ([0, BAR, 2 * BAR, 4 * BAR - 1], None, True, 4, [0, BAR, 2 * BAR, 3 * BAR]),
        ([0], 4 * BAR, False, 4, [0, BAR, 2 * BAR, 3 * BAR]),
        ([0, 1440, 2880, 4320], None, True, 3, [0, 1440, 2880, 4320]),
        ([0], None, True, 4, [0]),
    ],
)
def test_bar_ticks(spark, onsets, end, only, num, expected):
    sig = spark.createDataFrame([(1, 0, num, 4)], "score_id long, tick long, num int, den int")
    ends = spark.createDataFrame([(1, max(onsets) if end is None else end)], "score_id long, end long")
    found = grid.grid_ticks(sig, ends, 480, only_onsets=only).orderBy("idx").collect()
    assert [r["tick"] for r in found] == expected


@pytest.mark.parametrize(
    ("rows", "removed", "removed_with_duration"),
    [
        ([(0, 10, 50), (0, 10, 51), (2, 10, 50), (4, 10, 50)], 0, 0),
        ([(0, 10, 50), (0, 10, 50), (2, 10, 50), (4, 10, 50)], 1, 1),
        ([(0, 10, 50), (0, 11, 50), (2, 10, 50), (4, 10, 50)], 1, 0),
        ([(0, 10, 50), (0, 10, 50), (0, 11, 50), (2, 10, 50), (4, 10, 50)], 2, 1),
        ([(0, 10, 50), (0, 10, 50), (0, 11, 50), (2, 10, 50), (2, 11, 50), (4, 10, 50)], 3, 1),
    ],
)
def test_duplicates(spark, rows, removed, removed_with_duration):
    notes = _notes(spark, rows).withColumn("ord", F.monotonically_increasing_id())
    assert len(rows) - preprocess.deduplicated(notes).count() == removed
    assert len(rows) - preprocess.deduplicated(notes, True).count() == removed_with_duration


def test_nearest_ties_go_up(spark):
    c = TokenizerConfig()
    got = {r["v"]: r["n"] for r in spark.range(128).select(F.col("id").alias("v"), nearest(F.col("id"), c.velocities, "int").alias("n")).collect()}
    assert all(abs(got[v] - v) == min(abs(b - v) for b in c.velocities) for v in got)
    assert got[5] == 7  # 3 and 7 are as near


def test_greedy(spark):
    bins = [("a", 32), ("b", 4), ("c", 1)]
    assert spark.range(1).select(greedy(F.lit(37), bins).alias("x")).collect()[0]["x"] == ["a", "b", "c"]


def test_preprocess_is_a_fixpoint(spark, sf):
    c = TokenizerConfig(remove_duplicated_notes=True)
    once = preprocess.preprocess_notes(score_tables(spark, sf).notes, c, 480).where("score_id < 3")
    twice = preprocess.preprocess_notes(once.drop("ord"), c, c.tpq)
    assert once.drop("ord").exceptAll(twice.drop("ord")).isEmpty() and twice.drop("ord").exceptAll(once.drop("ord")).isEmpty()


def test_vocabulary_sizes_and_order():
    c = TokenizerConfig()
    assert len(Vocabulary("REMI", c)) == 284 and len(Vocabulary("TSD", c)) == 315
    assert Vocabulary("TSD", c).lists[0][:5] == ["PAD_None", "BOS_None", "EOS_None", "MASK_None", "Pitch_21"]
    for kind in KINDS:
        lists = Vocabulary(kind, c).lists
        assert all(len(set(x)) == len(x) for x in lists)


def test_config():
    c = TokenizerConfig(use_rests=True, use_time_signatures=True, additional_params={"a": 1})
    assert TokenizerConfig.from_dict(c.to_dict()) == c
    with pytest.raises(ValueError, match="powers of 2"):
        TokenizerConfig(use_time_signatures=True, time_signature_range={3: [4]})
    with pytest.raises(ValueError, match="num_velocities"):
        TokenizerConfig(num_velocities=0)


OPTIONS = [
    {},
    {"use_rests": True},
    {"use_rests": True, "use_programs": True, "use_tempos": True},
    {"use_time_signatures": True},
    {"use_time_signatures": True, "use_rests": True, "use_tempos": True, "use_programs": True},
    {"use_pitch_intervals": True, "use_rests": True},
    {"use_programs": True, "program_changes": True},
    {"use_pitchdrum_tokens": False},
    {"use_rests": True, "use_tempos": True, "use_time_signatures": True, "use_programs": True, "use_pitch_intervals": True},
]


@pytest.mark.parametrize(("kind", "options"), list(itertools.product(("TSD", "MIDILike", "REMI"), OPTIONS)), ids=str)
def test_round_trip(spark, sf, kind, options):
    """decode(encode(score)) gives the preprocessed notes, and every token is in the vocabulary."""
    config = TokenizerConfig(**options)
    score = score_tables(spark, sf, True)
    few = F.col("score_id") <= 2
    score = Score(score.notes.where(few), score.tempos.where(few), score.time_sigs.where(few))
    pre = preprocess.preprocess(score, effective(kind, config))
    encoded = encode.encode(pre, kind, config, preprocessed=True)
    rows = encode.token_rows(encoded)
    known = set(Vocabulary(kind, config).lists[0])
    assert {r["token"] for r in rows.select("token").distinct().collect()} <= known
    found = decode.decode_fold(encode.sequences(encoded), kind, effective(kind, config)).toPandas()
    want = pre.notes.toPandas()
    columns = ["score_id", "tick", "pitch", "velocity"] + ([] if kind == "MIDILike" else ["dur"])
    assert sorted(found[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))
    if kind == "MIDILike":
        assert found["dur"].sum() == want["dur"].sum()
    if options.get("use_programs"):
        assert sorted(found["program"].tolist()) == sorted(want["program"].tolist())


@pytest.mark.parametrize(("kind", "options"), [(k, o) for k in ("TSD", "REMI", "Structured", "MIDILike") for o in OPTIONS if k != "Structured" or not o], ids=str)
def test_own_sequences_have_no_type_error(spark, sf, kind, options):
    config = TokenizerConfig(**options)
    score = score_tables(spark, sf, True)
    few = F.col("score_id") <= 1
    rows = encode.token_rows(encode.encode(Score(score.notes.where(few), score.tempos.where(few), score.time_sigs.where(few)), kind, config))
    wrong = validate.type_errors(rows, Vocabulary(kind, config)).where("error = 1").groupBy("before", "type").count().collect()
    assert wrong == []


def test_time_signatures_are_pushed_to_bar_lines(spark):
    config = TokenizerConfig(use_time_signatures=True)
    sig = spark.createDataFrame([(1, 100, 3, 4), (1, 2000, 6, 8), (1, 2100, 4, 4), (1, 9000, 7, 16)], "score_id long, tick long, num int, den int")
    found = [tuple(r)[1:] for r in preprocess.align_time_signatures(sig, config, 480).orderBy("tick").collect()]
    assert found == [(0, 4, 4), (64, 3, 4), (112, 4, 4)]


def test_pedals_bends_and_empty_tables(spark, sf):
    notes = _notes(spark, [(0, 480, 60), (960, 480, 64)])
    pedals = spark.createDataFrame([(1, 0, 0, 500), (1, 0, 400, 300), (1, 0, 960, 200)], "score_id long, track_idx int, tick long, dur long")
    bends = spark.createDataFrame([(1, 0, 0, -8192), (1, 0, 1, 100)], "score_id long, track_idx int, tick long, value int")
    config = TokenizerConfig(use_sustain_pedals=True, use_pitch_bends=True)
    tokens = [r["token"] for r in encode.token_rows(encode.encode(Score(notes, pedals=pedals, bends=bends), "TSD", config)).orderBy("pos").collect()]
    assert tokens[:3] == ["Pedal_0", "PitchBend_-8192", "Pitch_60"]
    assert tokens.count("Pedal_0") == tokens.count("PedalOff_0") == 2
    empty = Score(notes.where("false"))
    for kind in ("TSD", "REMI", "MIDILike", "Structured"):
        assert encode.token_rows(encode.encode(empty, kind, TokenizerConfig())).count() == 0


def test_bars_of_time_signatures(spark):
    sig = spark.createDataFrame([(1, 4000, 3, 4), (1, 8000, 6, 8), (2, 0, 0, 4)], "score_id long, tick long, num int, den int")
    ends = spark.createDataFrame([(1, 9000), (2, 0)], "score_id long, end long")
    # 4/4 until the first signature; bars that a change cuts off count
    bars = [r["tick"] for r in grid.grid_ticks(sig, ends, 480, only_onsets=True).where("score_id = 1").orderBy("idx").collect()]
    assert bars == [0, 1920, 3840, 4000, 5440, 6880, 8000]
    rows = spark.createDataFrame([(1, t) for t in (0, 1919, 1920, 3999, 4000, 5440, 7999, 8000, 9000)], "score_id long, tick long")
    found = [(r["bar"], r["bar_tick"], r["num"]) for r in grid.with_bars(rows, 480, grid.complete(sig)).orderBy("tick").collect()]
    assert found == [(0, 0, 4), (0, 0, 4), (1, 1920, 4), (2, 3840, 4), (3, 4000, 3), (4, 5440, 3), (5, 6880, 3), (6, 8000, 6), (6, 8000, 6)]
    assert [r["end"] for r in grid.last_onsets(rows, sig).orderBy("score_id").collect()] == [9000, 0]


def test_bars_by_brute_force(spark, sf):
    """Notes a bar in changing signatures, against a walk of one score."""
    config = TokenizerConfig(use_time_signatures=True)
    pre = preprocess.preprocess(score_tables(spark, sf, True), config)
    notes = [r["tick"] for r in pre.notes.where("score_id = 3").select("tick").collect()]
    sigs = sorted((r["tick"], r["num"], r["den"]) for r in pre.time_sigs.where("score_id = 3").collect())
    bars, tick, k = [], 0, 0
    while tick <= max(notes):
        while k + 1 < len(sigs) and sigs[k + 1][0] <= tick:
            k += 1
        bars.append(tick)
        tick += sigs[k][1] * 4 * config.tpq // sigs[k][2]
    want = [sum(a <= t < b for t in notes) for a, b in zip(bars, [*bars[1:], tick], strict=True)]
    got = [r["n_notes"] for r in grid.notes_per_bar(pre.notes, config.tpq, time_sigs=pre.time_sigs).where("score_id = 3").orderBy("bar").collect()]
    assert got == want


def test_effects_of_merged_tracks(spark):
    notes = spark.createDataFrame([(1, 0, 5, False, 0, 480, 60, 100), (1, 1, 5, False, 960, 480, 64, 100), (1, 2, 7, False, 0, 480, 50, 90)], NOTES)
    pedals = spark.createDataFrame([(1, 1, 960, 200), (1, 9, 0, 100)], "score_id long, track_idx int, tick long, dur long")
    bends = spark.createDataFrame([(1, 1, 960, -8192), (1, 2, 0, 4000)], "score_id long, track_idx int, tick long, value int")
    config = TokenizerConfig(use_programs=True, use_sustain_pedals=True, use_pitch_bends=True)
    pre = preprocess.preprocess(Score(notes, pedals=pedals, bends=bends), config)
    assert sorted(r["track_idx"] for r in pre.pedals.collect()) == [0, 9] and sorted(r["track_idx"] for r in pre.bends.collect()) == [0, 2]
    tokens = [r["token"] for r in encode.token_rows(encode.encode(pre, "TSD", config, preprocessed=True)).orderBy("pos").collect()]
    assert tokens.count("Pedal_5") == 1 and "PitchBend_-8192" in tokens and tokens[tokens.index("PitchBend_-8192") - 1] == "Program_5"
    whole, name = tracks.merge_tracks(Score(notes, pedals=pedals, bends=bends), spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "score_id long, track_idx int, name string"))
    assert {r["track_idx"] for df in (whole.notes, whole.pedals, whole.bends) for r in df.collect()} == {0}
    assert {r["program"] for r in whole.notes.collect()} == {5} and name.collect()[0]["name"] == "a / b"
    first, _ = tracks.merge_tracks(Score(notes, pedals=pedals, bends=bends), effects=False)
    assert first.notes.count() == 3 and first.pedals.count() == 0


def test_on_off_pairs_with_orphans_and_max_duration(spark):
    tokens = ["NoteOff_60", "NoteOn_60", "Velocity_99", "TimeShift_1.0.8", "NoteOff_60", "NoteOff_60", "NoteOn_60", "Velocity_91", "TimeShift_4.0.4", "NoteOff_60", "NoteOn_62", "Velocity_95"]
    rows = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(tokens)], "score_id long, stream int, pos long, token string")
    pairs = lambda c: sorted((r["tick"], r["dur"], r["velocity"]) for r in decode.decode_on_off(rows, c).collect())
    plain, short = TokenizerConfig(), TokenizerConfig(additional_params={"max_duration": (2, 0, 8)})
    assert pairs(plain) == [(0, 8, 99), (8, 32, 91)]
    assert pairs(short) == [(0, 8, 99), (8, 16, 91), (40, 16, 95)]
    for c in (plain, short):
        assert sorted((t, d, v) for _, _, t, d, _, v in decode.walk(tokens, "MIDILike", c)) == pairs(c)
    errors = lambda c: tuple(validate.on_off_errors(rows, c).collect()[0])[2:]
    assert errors(plain) == (2, 1, 0) and errors(short) == (2, 1, 1)


def test_rows_with_errors(spark):
    row = lambda p, place, bar, program: [f"Pitch_{p}", f"Position_{place}", f"Bar_{bar}", "Velocity_99", "Duration_1.0.8", f"Program_{program}"]
    octuple = [row(60, 4, 1, 0), row(60, 4, 1, 0), row(60, 4, 1, 3), row(62, 2, 1, 0), row(62, 9, 0, 0), ["PAD_None"] * 6, row(62, 0, 2, 0)]
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(octuple)], "score_id long, stream int, pos long, tokens array<string>")
    assert [r["n_errors"] for r in validate.octuple_errors(df).collect()] == [3]
    assert [r["n_errors"] for r in validate.octuple_errors(df, 5, True).collect()] == [4]
    line = lambda t, bar, place: [t, f"BarPosEnc_{bar}", f"PositionPosEnc_{place}", "Ignore_None", "Ignore_None"]
    good = [line("Bar_None", 0, "None"), line("Position_4", 0, 4), line("Program_0", 0, 4), line("Pitch_60", 0, 4), line("Pitch_62", 0, 4), line("Position_6", 0, 6), line("Program_0", 0, 6), line("Pitch_60", 0, 6)]
    bad = [*good, line("Position_5", 0, 5), line("Program_0", 0, 5), line("Pitch_61", 0, 5), line("Bar_None", 1, "None"), line("Pitch_61", 1, 3), line("MASK_None", 1, 3)]
    voc = Vocabulary("MuMIDI", TokenizerConfig())
    count = lambda x: validate.mumidi_errors(spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(x)], df.schema), voc).collect()[0]["n_errors"]
    assert count(good) == 0 and count(bad) == 3


def test_repetition_by_brute_force(spark):
    rnd = random.Random(5)
    rows = [(1, 0, 0, False, rnd.randrange(0, 12) * 16, rnd.choice([8, 16, 40]), rnd.choice([60, 61]), 9) for _ in range(40)]
    notes = spark.createDataFrame(rows, NOTES)
    sigs = spark.createDataFrame([(1, 0, 4, 4), (1, 64, 2, 4), (1, 128, 4, 4)], "score_id long, tick long, num int, den int")
    for signatures, starts in ((None, range(0, 400, 32)), (sigs, [0, 32, 64, 80, 96, 112, 128, 160, 192, 224])):
        starts = [*starts]
        bars = [s for s in starts if s <= max(r[4] for r in rows)]
        until = max(r[4] + r[5] for r in rows)
        cells = lambda i: {(t - starts[i], k, r[6]) for r in rows for k, t in ((0, r[4]), (1, r[4] + r[5])) if starts[i] <= t < starts[i + 1]}  # noqa: B023, E731
        length = lambda i: starts[i + 1] - starts[i]  # noqa: B023, E731
        found = [len(cells(i) & cells(j)) / len(cells(i)) for i in range(len(bars) - 1) if cells(i) for j in range(i + 1, min(len(bars), i + 4)) if length(i) == length(j) and starts[j + 1] <= until]
        mean = sum(found) / len(found)
        want = min((i / 9 for i in range(10)), key=lambda b: abs(b - mean))
        got = attributes.repetition(notes, 8, 10, 4, signatures).collect()[0]["repetition"]
        assert got == pytest.approx(want)


@pytest.mark.parametrize(
    ("bars", "lower"),
    [
        ([[40], range(50, 59), range(50, 57)], 3),  # (0 + 7 / 9) / 2
        ([range(50, 56), [*range(50, 55), 60], range(50, 55)], 7),  # 5 / 6, twice
    ],
)
def test_repetition_between_two_bins_is_the_lower(spark, bars, lower):
    rows = [(1, 0, 0, False, 32 * i, 8, p, 9) for i, pitches in enumerate(bars) for p in pitches] + [(1, 0, 0, False, 95, 8, 90, 9)]
    got = attributes.repetition(spark.createDataFrame(rows, NOTES), 8, 10, 2).collect()
    assert [r["repetition"] for r in got] == [lower / 9]
