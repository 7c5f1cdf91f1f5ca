"""The front: every tokenization encodes to ids of its vocabulary and decodes to the preprocessed notes."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.operators import attributes, encode
from tactus.plans.vocab import KINDS
from tactus.sources import midi, tokens
from tactus.sources.tables import NOTES, Score, score_tables
from tactus.tokenizer import Tokenizer

LONG = {"max_bar_embedding": 300}


@pytest.fixture(scope="module")
def score(spark, sf):
    s = score_tables(spark, sf, True)
    few = F.col("score_id") <= 2
    s = Score(s.notes.where(few & (F.col("tick") < 200_000)), s.tempos.where(few), s.time_sigs.where(few))
    return s


@pytest.mark.parametrize("kind", KINDS)
def test_round_trip(spark, score, kind):
    multi = kind in ("Octuple", "MuMIDI")
    t = Tokenizer(kind, TokenizerConfig(use_programs=kind != "MMM", use_tempos=kind == "REMI", additional_params=LONG if multi else {}))
    seqs = t.encode(score).cache()
    assert seqs.where(F.exists(F.flatten("ids") if t.vocabulary.is_multi else F.col("ids"), lambda i: i.isNull())).isEmpty()
    assert t.errors(seqs).where("n_errors > 0").isEmpty() and t.errors(seqs).count() == seqs.count()
    found = t.decode(seqs)
    if kind == "PerTok":
        assert found.notes.count() == score.notes.where("(is_drum and pitch between 27 and 88) or (not is_drum and pitch between 21 and 109)").count()
        return
    want = t.preprocess(score).notes.toPandas()
    got = found.notes.toPandas()
    columns = ["score_id", "tick", "pitch", "velocity"] if kind != "Structured" else ["score_id", "dur", "pitch", "velocity"]  # its shifts end at 12 beats
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))
    if kind == "REMI":
        assert found.tempos.exceptAll(t.preprocess(score).tempos).isEmpty()


def test_files(spark, score, tmp_path):
    t = Tokenizer("REMI", TokenizerConfig(additional_params={"use_bar_end_tokens": True}))
    (tmp_path / "in").mkdir()
    for r in midi.to_files(score.notes, 480).collect():
        (tmp_path / "in" / f"{r['score_id']}.mid").write_bytes(r["content"])
    (tmp_path / "in" / "bad.mid").write_bytes(b"x")
    out = str(tmp_path / "out")
    t.tokenize_dataset(spark, str(tmp_path / "in"), out)
    found = tokens.read_tokens(spark, out)
    assert found.count() == 21 and found.where("size(programs) = 7 and not ids_encoded").count() == 21
    t.train(found, len(t) + 40)
    coded = t.encode_ids(found)
    assert t.decode_ids(coded).exceptAll(found.select("score_id", "stream", "ids")).isEmpty()
    path = t.save(str(tmp_path / "tok.json"))
    assert Tokenizer.load(path) == t
    n = len(t)
    assert t.add_to_vocab("NEW") == len(t.vocabulary) - 1 and t.add_to_vocab("NEW") == len(t.vocabulary) - 1 and len(t) == n


def test_attribute_controls(spark, score):
    names = ["ac_polyphony_track", "ac_polyphony_bar", "ac_pitch_class_bar", "ac_note_density_track", "ac_note_density_bar", "ac_note_duration_bar", "ac_note_duration_track", "ac_repetition_track"]
    config = TokenizerConfig(**dict.fromkeys(names, True))
    for kind in ("REMI", "TSD", "MIDILike"):
        t = Tokenizer(kind, config)
        seqs = t.encode(score, with_controls=True)
        assert seqs.where(F.exists("ids", lambda i: i.isNull())).isEmpty()
        first = seqs.select(F.explode("tokens").alias("t")).where("t like 'AC%'").select(F.split("t", "_")[0].alias("t")).distinct().count()
        assert first == 19
    rows = encode.token_rows(encode.encode(t.preprocess(score), "REMI", config, preprocessed=True, controls=attributes.control_tokens(t.preprocess(score).notes, config)))
    seq = [r["token"] for r in rows.where("score_id = 1 and stream = 0").orderBy("pos").collect()]
    first_bar = next(i for i, x in enumerate(seq) if x.startswith("ACBar"))
    assert seq[first_bar - 1] == "Bar_None"
    after = next(x for x in seq[first_bar:] if not x.startswith("ACBar"))
    assert after.startswith("Position_")


def test_splitting_for_training(spark, score):
    t = Tokenizer("TSD")
    whole = t.preprocess(score).notes.select("score_id", "track_idx", "pitch", "velocity", "dur")
    # without overlap the chunks are the score, but for an end that is too short
    apart = t.split_for_training(score, 400, 4.0, overlap=0).notes
    kept = apart.select(*whole.columns)
    assert kept.exceptAll(whole).isEmpty() and kept.count() >= 0.95 * whole.count()
    rows = t.split_for_training(score, 400, 4.0).notes
    assert rows.select(*whole.columns).distinct().exceptAll(whole.distinct()).isEmpty() and rows.count() > kept.count()
    assert rows.where("not marker rlike '^chunk \\\\d+/\\\\d+$'").isEmpty() and rows.where("tick < 0").isEmpty()
    df = spark.createDataFrame([([5, 6, 7], "chunk 0/2"), ([5, 6, 7], "chunk 1/2"), ([5, 6], "chunk 2/2")], "ids array<int>, marker string")
    assert [r["ids"] for r in t.samples(df, 4).collect()] == [[1, 5, 6, 7], [5, 6, 7], [5, 6, 2]]


def test_pertok_positions(spark, score):
    t = Tokenizer("PerTok", TokenizerConfig(additional_params={"ticks_per_quarter": 220, "max_microtiming_shift": 0.25, "num_microtiming_bins": 110, "use_position_toks": True}))
    seqs = t.encode(score)
    assert seqs.where(F.exists("ids", lambda i: i.isNull())).isEmpty()
    raw = sorted(round(r["tick"] * 220 / 480) for r in score.notes.where("track_idx = 0 and score_id = 1").collect())
    got = sorted(r["tick"] for r in t.decode(seqs).notes.where("track_idx = 0 and score_id = 1").collect())
    assert len(raw) == len(got) and max(abs(a - b) for a, b in zip(raw, got, strict=True)) <= 2


def test_written_files_and_valid_ones(spark, score, tmp_path):
    done = midi.write_files(midi.to_files(score.notes, 480), f"file://{tmp_path}/out").collect()
    assert len(done) == 3
    rows = midi.read_midi(spark, str(tmp_path / "out"))
    many = F.count_if(F.col("kind") == "note") > 10**6
    assert midi.valid_files(rows).count() == rows.count() and midi.valid_files(rows, many).isEmpty()


def test_bars_and_positions(spark):
    from tactus.operators.split import bar_and_positions

    df = spark.createDataFrame([([4, 7, 4, 8, 9, 7],), ([7],), ([],)], "ids array<int>")
    assert [tuple(r["x"]) for r in df.select(bar_and_positions(F.col("ids"), 4, [7, 8]).alias("x")).collect()] == [(2, 2), (0, 1), (0, 0)]


def test_formats():
    assert Tokenizer("TSD").io_format == ("I", "T")
    assert Tokenizer("Octuple", TokenizerConfig(use_programs=True)).io_format == ("T", "C")
    assert Tokenizer("TSD").pad_token_id == 0 and Tokenizer("TSD")[0] == "PAD_None"
    with pytest.raises(ValueError, match="one of"):
        Tokenizer("None")


def test_words_are_bars_and_beats(spark):
    notes = spark.createDataFrame([(1, 0, 0, False, t * 480, 240, 60, 100) for t in range(12)], NOTES)
    sigs = spark.createDataFrame([(1, 0, 4, 4), (1, 1920, 3, 4)], "score_id long, tick long, num int, den int")
    for kind in ("TSD", "MIDILike", "REMI"):
        n = {}
        for how in ("bar", "beat", "no"):
            t = Tokenizer(kind, TokenizerConfig(encode_ids_split=how))
            seqs = t.encode(Score(notes))
            words = t.words(seqs)
            n[how] = words.count()
            joined = words.groupBy("score_id", "stream").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("word", "ids"))), lambda w: w["ids"])).alias("ids"))
            assert joined.collect()[0]["ids"] == seqs.collect()[0]["ids"]
        assert n == {"bar": 3, "beat": 12, "no": 1}, kind
    t = Tokenizer("TSD", TokenizerConfig(use_time_signatures=True))
    assert t.words(t.encode(Score(notes, time_sigs=sigs))).count() == 1 + 3  # a bar of 4/4, then three of 3/4 with the last cut short
    two = notes.unionByName(notes.withColumn("track_idx", F.lit(1)))
    t = Tokenizer("MMM", TokenizerConfig())
    assert t.words(t.encode(Score(two))).count() == 6


def test_own_controls_and_sampling(spark, score):
    t = Tokenizer("TSD", TokenizerConfig(**dict.fromkeys(["ac_polyphony_track", "ac_note_density_track", "ac_note_density_bar", "ac_pitch_class_bar"], True)))
    n = len(t)
    t.add_control(attributes.own_control("Loudest", F.max("velocity").cast("string"), tuple(str(v) for v in t.config.velocities), bar=True))
    assert len(t) == n + 32
    whole = t.encode(score, with_controls=True)
    assert whole.where(F.exists("ids", lambda i: i.isNull())).isEmpty()
    flat = lambda df: df.select("score_id", "stream", F.explode("tokens").alias("t")).where("t like 'AC%'")
    bars = flat(whole).where("t like 'ACBarLoudest%'").count()
    assert bars == flat(whole).where("t like 'ACBarNoteDensity%'").count() > 0
    part = flat(t.encode(score, with_controls=True, track_ratio=0.5, bar_ratio=(0.2, 0.4), seed=3))
    share = part.where("t like 'ACBarLoudest%'").count() / bars
    assert 0.15 < share < 0.45
    tracks = part.where("t like 'ACTrack%'").groupBy("score_id", "stream").agg(F.countDistinct(F.regexp_extract("t", "ACTrack(Onset|Note)", 1)).alias("n"))
    assert {r["n"] for r in tracks.collect()} == {1}
    again = flat(t.encode(score, with_controls=True, track_ratio=0.5, bar_ratio=(0.2, 0.4), seed=3))
    assert part.exceptAll(again).isEmpty()


def test_own_tokenization(spark, score):
    from tactus.plans.vocab import OWN, Tokenization

    def encode_(ready, config):
        w = Window.partitionBy("score_id", "track_idx").orderBy("ord")
        rows = ready.notes.withColumn("at", (F.row_number().over(w) - 1) * 2)
        pairs = F.array(F.concat(F.lit("At_"), F.col("tick")), F.concat(F.lit("Pitch_"), F.col("pitch")))
        return rows.select("score_id", F.col("track_idx").alias("stream"), "at", "tick", F.posexplode(pairs).alias("k", "token")).select("score_id", "stream", (F.col("at") + F.col("k")).alias("pos"), "tick", "token")

    def walk(tokens, config):
        return [(None, False, int(a.split("_")[1]), 1, int(p.split("_")[1]), 100) for a, p in zip(tokens[::2], tokens[1::2], strict=True)]

    OWN["Plain"] = Tokenization(lambda c: [*(f"At_{i}" for i in range(8000)), *(f"Pitch_{p}" for p in range(128))], encode_, walk, lambda c: {"At": {"Pitch"}, "Pitch": {"At"}}, ("use_rests",))
    try:
        t = Tokenizer("Plain", TokenizerConfig(use_rests=True, encode_ids_split="no"))
        assert not t.config.use_rests
        seqs = t.encode(score)
        got = sorted((r["score_id"], r["tick"], r["pitch"]) for r in t.decode(seqs).notes.collect())
        assert got == sorted((r["score_id"], r["tick"], r["pitch"]) for r in t.preprocess(score).notes.collect())
        assert t.errors(seqs).where("n_errors > 0").isEmpty()
        t.train(seqs, len(t) + 5)
        assert t.decode_ids(t.encode_ids(seqs)).exceptAll(seqs.select("score_id", "stream", "ids")).isEmpty()
    finally:
        del OWN["Plain"]


def test_datasets_of_files(spark, score, tmp_path):
    (tmp_path / "in").mkdir()
    for r in midi.to_files(score).collect():
        (tmp_path / "in" / f"{r['score_id']}.mid").write_bytes(r["content"])
    (tmp_path / "in" / "bad.mid").write_bytes(b"x")
    (tmp_path / "in" / "tune.abc").write_text("X:1\nT:A\nM:6/8\nL:1/8\nK:D\nABc def|gab agf|\n")
    t = Tokenizer("TSD", TokenizerConfig(use_programs=True, use_time_signatures=True))
    read, paths = t.read(spark, str(tmp_path / "in"))
    assert paths.count() == 5 and paths.where("error is not null").count() == 1
    assert {(r["num"], r["den"]) for r in read.time_sigs.collect()} == {(4, 4), (3, 4), (6, 8)}
    data = {r["path"].rpartition("/")[2]: r for r in t.dataset(spark, str(tmp_path / "in"), 50, F.size("tokens")).collect()}
    assert set(data) == {"0.mid", "1.mid", "2.mid", "bad.mid", "tune.abc#0"} or len(data) == 5
    assert data["bad.mid"]["ids"] is None and data["bad.mid"]["error"] and data["tune.abc#0"]["labels"] > 20
    assert all(r["ids"] is None or r["ids"][0] == 1 for r in data.values())
    out = str(tmp_path / "tokens")
    t.tokenize_dataset(spark, str(tmp_path / "in"), out)
    assert {r["path"].rpartition("/")[2] for r in tokens.read_tokens(spark, out).collect()} == set(data) - {"bad.mid"}
    tokens.split_files(spark, out, str(tmp_path / "parts"), 100, 10)
    parts = tokens.read_tokens(spark, str(tmp_path / "parts"))
    assert parts.where("size(ids) > 100").isEmpty() and parts.count() > 4
    report = t.augment_dataset(spark, str(tmp_path / "in"), f"file://{tmp_path}/aug", [-1, 1], [4], by_tessitura=False)
    names = {p.name for p in (tmp_path / "aug").iterdir() if p.suffix == ".mid"}
    assert {"tune#0.mid", "tune#0#p1.mid", "tune#0#v4.mid"} <= names and sum(r["n_files"] for r in report.collect()) == len(names)
    chunks = t.split_files(spark, str(tmp_path / "in"), f"file://{tmp_path}/chunks", 400, 4.0).collect()
    assert len(chunks) > 4
    back = midi.to_score(midi.read_midi(spark, str(tmp_path / "chunks")), 16)
    assert back.errors.isEmpty() and back.time_sigs.where("tick = 0").count() == len(chunks)


def test_sequences(spark, score):
    from tactus.operators import sequences

    t = Tokenizer("TSD")
    seqs = t(score).where("score_id = 1 and stream < 2").cache()
    n = len(seqs.first()["ids"])
    whole = t.complete(seqs.drop("tokens"))
    assert whole.where("tokens is null or chars is null").isEmpty()
    for kept in (("tokens",), ("chars",), ("ids",)):
        again = t.complete(whole.select("score_id", "stream", *kept))
        assert again.select("stream", "ids", "tokens", "chars").exceptAll(whole.select("stream", "ids", "tokens", "chars")).isEmpty()
    part = sequences.cut(whole, 2, -3)
    r, p = (x.where("stream = 0").first() for x in (whole, part))
    assert p["ids"] == r["ids"][2:-3] and p["tokens"] == r["tokens"][2:-3] and p["chars"] == r["chars"][2:-3]
    assert sequences.cut(whole, -2).where("stream = 0").first()["ids"] == r["ids"][-2:]
    both = sequences.joined(whole.withColumn("k", F.lit(1)), ["k"], "stream").first()
    assert both["ids"] == [i for x in sorted(whole.collect(), key=lambda x: x["stream"]) for i in x["ids"]] and len(both["chars"]) == len(both["ids"])
    look = whole.where("stream = 0").select(sequences.length(F.col("ids"), F.col("tokens"), F.col("chars")).alias("n"), sequences.item(F.col("tokens"), -1).alias("last"), sequences.item(F.col("ids"), 10**6).alias("none")).first()
    assert (look["n"], look["last"], look["none"]) == (len(r["ids"]), r["tokens"][-1], None) and n
    pairs = spark.createDataFrame([((([1], None, "a")), ([1], ["x"], "a")), (([1], None, None), ([2], None, None)), (([1], None, None), (None, ["x"], None))], "a struct<ids:array<int>,tokens:array<string>,chars:string>, b struct<ids:array<int>,tokens:array<string>,chars:string>")
    assert [x["s"] for x in pairs.select(sequences.same("a", "b").alias("s")).collect()] == [True, False, False]
    t = Tokenizer("TSD", TokenizerConfig(encode_ids_split="no"))
    t.train(seqs, len(t) + 10)
    coded = t.encode_ids(seqs)
    assert coded.where(~sequences.are_encoded(F.col("ids"), len(t.vocabulary))).isEmpty()
    assert t.complete(coded.withColumn("ids_encoded", F.lit(True))).select("stream", "ids").exceptAll(seqs.select("stream", "ids")).isEmpty()
    assert "BPE model" in repr(t) and t(seqs).notes.count() > 0
    assert Tokenizer("TSD", TokenizerConfig(use_time_signatures=True, time_signature_range={4: [4]})).unknown_time_signatures(score).select("num").distinct().count() == 2
