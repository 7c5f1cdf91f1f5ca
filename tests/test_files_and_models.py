"""MIDI and ABC files, token files, folds, subword models, batches and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.operators import batch, folds, split
from tactus.operators.subword import SubwordModel, apply_bpe, best_segmentation, fit_bpe, fit_unigram, fit_wordpiece, longest_first, to_chars, to_ids, train_bpe, train_unigram, train_wordpiece
from tactus.sources import abc, midi, tokens
from tactus.streaming import windows


def test_midi_files(spark, tmp_path):
    notes = [(0, 5, 0, 0, 480, 60, 100), (0, 5, 0, 480, 240, 64, 90), (1, -1, 1, 0, 100, 36, 127)]
    data = midi.build(notes, 480, [(0, 100.0), (960, 140.0)], [(0, 3, 4)], [(0, 0, 300)], [(0, 10, -8192)])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "A.MID").write_bytes(data)
    (tmp_path / "bad.mid").write_bytes(b"MThd\0\0\0\6\0\1\0\2\1\xe0MTrk\0\0")
    (tmp_path / "other.txt").write_bytes(b"no")
    rows = midi.read_midi(spark, str(tmp_path)).cache()
    assert {r["path"].rpartition("/")[2] for r in rows.select("path").distinct().collect()} == {"A.MID", "bad.mid"}
    assert rows.where("kind = 'error'").count() == 1
    score = midi.to_score(rows, 480)
    found = sorted((r["program"], r["is_drum"], r["tick"], r["dur"], r["pitch"], r["velocity"]) for r in score.notes.collect())
    assert found == sorted((p, bool(d), t, n, pitch, v) for _, p, d, t, n, pitch, v in notes)
    assert [(r["tick"], round(r["qpm"], 3)) for r in score.tempos.orderBy("tick").collect()] == [(0, 100.0), (960, 140.0)]
    assert [(r["num"], r["den"]) for r in score.time_sigs.collect()] == [(3, 4)]
    assert [(r["tick"], r["dur"]) for r in score.pedals.collect()] == [(0, 300)]
    assert [r["value"] for r in score.bends.collect()] == [-8192]


def test_truncated_midi_never_crashes():
    data = midi.build([(0, 5, 0, 0, 480, 60, 100)], 480)
    for n in range(len(data)):
        try:
            midi.parse(data[:n])
        except (midi.MidiError, IndexError, midi.struct.error):
            pass


def test_abc_tunes(spark, tmp_path):
    tune = "X:1\nT:Own\nM:6/8\nL:1/8\nK:D\n|:A2B c>d{g}e|[FA]2 z f'|(3ABc ^G=G:|\n"
    (tmp_path / "t.abc").write_text(tune)
    rows = abc.read_abc(spark, str(tmp_path)).orderBy("tick", "pitch").collect()
    assert [(r["tick"], r["dur"], r["pitch"]) for r in rows][:3] == [(0, 480, 69), (480, 240, 71), (720, 360, 73)]
    assert len(rows) == 2 * 13 and rows[0]["title"] == "Own"
    assert abc.key_accidentals("Eb") == {"B": -1, "E": -1, "A": -1} and abc.key_accidentals("Ador") == {"F": 1}
    assert abc.parse_tune("X:1\nK:C\n|:C|1 D:|2 E|]")[2] == [(0, 240, 60), (240, 240, 62), (480, 240, 60), (720, 240, 64)]


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [4, 5, 6], [0])], "score_id long, stream int, ids array<int>, programs array<int>")
    tokens.write_tokens(df, str(tmp_path / "x"))
    assert tokens.read_tokens(spark, str(tmp_path / "x")).collect()[0]["ids"] == [4, 5, 6]


def test_chords():
    import numpy as np

    a = lambda *x: np.array(x)
    config = TokenizerConfig(use_chords=True, chord_unknown=(3, 6))
    find = lambda t, e, p, c=config: folds.find_chords(a(*t), a(*e), a(*p), 8, c)
    assert find([0, 0, 0], [8, 8, 8], [60, 64, 67]) == [(0, "maj")]
    assert find([0, 0, 0], [8, 8, 20], [60, 64, 67]) == []  # ends too far apart
    assert find([0, 0, 0], [8, 8, 8], [60, 61, 67]) == [(0, "ukn3")]
    assert find([0, 0, 0], [8, 8, 8], [60, 64, 67], TokenizerConfig(chord_tokens_with_root_note=True)) == [(0, "C:maj")]
    # notes at the tick of the last of a group begin none: after ten of thirteen, the last three are no chord
    assert find([0] * 13, [8] * 13, [*range(40, 50), 60, 64, 67]) == []
    # a beat of an eighth is half as long
    assert folds.find_chords(a(0, 0, 0), a(8, 8, 11), a(60, 64, 67), 8, config) == [(0, "maj")]
    assert folds.find_chords(a(0, 0, 0), a(8, 8, 11), a(60, 64, 67), a(4, 4, 4), config) == []


def test_chords_by_brute_force(spark):
    """Against the rules, note by note."""
    import numpy as np

    config = TokenizerConfig(use_chords=True, chord_unknown=(3, 6))
    rnd = random.Random(12)
    names = {m: k for k, m in config.chord_maps.items()}

    def walk(notes, tpb):
        out, i, last = [], 0, None
        while i < len(notes):
            if notes[i][0] == last:
                i += 1
                continue
            group = [n for n in notes[i : i + 10] if n[0] <= notes[i][0] + tpb / 4]
            if any(abs(n[1] - group[0][1]) > tpb // 2 for n in group):
                i += len(group)
                continue
            if group[0][1] - group[0][0] <= tpb // 2:
                group = [n for n in group if n[0] == group[0][0]]
            steps = tuple(n[2] - group[0][2] for n in group)
            if 3 <= len(steps) <= 5 and steps[-1] <= 24:
                out.append((group[0][0], names.get(steps, f"ukn{len(steps)}")))
            last, i = group[-1][0], i + len(group)
        return out

    for _ in range(300):
        notes = sorted((t, t + rnd.choice([2, 4, 8, 9, 10]), rnd.choice([60, 63, 64, 67, 70])) for t in (rnd.randrange(0, 12) for _ in range(rnd.randint(1, 25))))
        notes = sorted(set(notes), key=lambda n: (n[0], n[2], n[1]))
        t, e, p = (np.array(x) for x in zip(*notes, strict=True))
        assert folds.find_chords(t, e, p, 8, config) == walk(notes, 8)


def test_pertok_round_trip():
    config = TokenizerConfig(additional_params={"ticks_per_quarter": 220, "max_microtiming_shift": 0.25, "num_microtiming_bins": 110})
    rnd = random.Random(3)
    rows = sorted((rnd.randint(0, 9000), rnd.choice([55, 110, 220, 440]), rnd.randint(40, 80), 99, False, 3) for _ in range(200))
    for c, signatures in ((config, ()), (config.copy(use_time_signatures=True, use_programs=True), [(0, 4, 4), (1760, 3, 4), (3740, 6, 8)])):
        tokens = [t for _, t in folds.pertok_tokens(rows, c, signatures, [(0, 120.0)])]
        found = folds.pertok_notes(tokens, c)
        assert len(found) == len(rows)
        for (t, d, p, v, _, _), (t2, d2, p2, v2, _, program) in zip(rows, found, strict=True):
            assert (d, p, v) == (d2, p2, v2) and abs(t - t2) <= 110 and program == (3 if c.use_programs else None)  # within half a beat
        assert sum(abs(a[0] - b[0]) for a, b in zip(rows, found, strict=True)) / len(rows) < 3
        last = max(r[0] for r in rows)
        bars = -(-last // 880) if not signatures else 2 + 3 + -(-(last - 3740) // 660)
        assert abs(tokens.count("Bar_None") - bars) <= 1 and tokens.count("Tempo_120.0") == 1


@pytest.mark.parametrize("kind", ["BPE", "WordPiece", "Unigram"])
def test_subword_models(spark, tmp_path, kind):
    rnd = random.Random(1)
    words = [[rnd.choice([1, 2, 3, 4, 5]) for _ in range(rnd.randint(0, 9))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(words)), "k long, ids array<int>")
    model = SubwordModel.train(df, kind, 10, 30)
    assert len(model) <= 30 and model.pieces
    model.save(str(tmp_path / "m.json"))
    coded = SubwordModel.load(str(tmp_path / "m.json")).encode(df)
    back = {r["k"]: r["ids"] for r in model.decode(coded).collect()}
    assert back == dict(enumerate(words))
    assert sum(len(r["ids"]) for r in coded.collect()) < sum(map(len, words))


def test_bpe_by_brute_force():
    rnd = random.Random(5)
    counts = [([rnd.randint(0, 3) for _ in range(rnd.randint(1, 8))], rnd.randint(1, 5)) for _ in range(40)]
    words, merges, new = [(list(w), n) for w, n in counts], [], 4
    while new < 12:
        pairs = {}
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < 2:
            break
        merges.append((*best, new))
        words = [(apply_bpe(w, {best: (0, new)}), n) for w, n in words]
        new += 1
    assert train_bpe(counts, 4, 12) == merges


def test_segmentations():
    assert longest_first([1, 2, 3, 1], {(1, 2): 9}, 2) == [9, 3, 1]
    assert best_segmentation([1, 2, 3], {(1,): -2.0, (2,): -2.0, (3,): -2.0, (1, 2): -1.0}, 3) == [(1, 2), (3,)]
    assert best_segmentation([], {}, 3) == []


def test_letters(spark):
    ids = [0, 5, 93, 94, 95, 300, 700, 2014, 2015, 30_000, 0xD800 - 34, 0xD800 - 33, 63_454, 63_455, 100_000]
    got = spark.createDataFrame([(ids,)], "ids array<int>").select(to_chars(F.col("ids")).alias("s")).collect()[0]["s"]
    assert got == "".join(chr(i + 33 if i + 33 < 0xD800 else i + 33 + 2048) for i in ids) and to_ids(got) == ids


@pytest.mark.parametrize("seed", range(3))
def test_bpe_is_that_of_the_library(seed):
    """Merges and encodings of the tokenizers library on the same words, letters standing for ids."""
    from tokenizers import Tokenizer as Library
    from tokenizers import models, pre_tokenizers, trainers

    rnd = random.Random(seed)
    words = [[min(int(rnd.expovariate(0.4)), 11) for _ in range(rnd.randint(1, 14))] for _ in range(400)]
    counts = {}
    for w in words:
        counts[tuple(w)] = counts.get(tuple(w), 0) + 1
    letter = lambda w: "".join(chr(65 + i) for i in w)
    theirs = Library(models.BPE())
    theirs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    theirs.train_from_iterator([letter(w) for w in words], trainers.BpeTrainer(vocab_size=60, min_frequency=2, initial_alphabet=[chr(65 + i) for i in range(12)], show_progress=False))
    merges = train_bpe([(list(w), n) for w, n in counts.items()], 12, 60)
    made = {i: (i,) for i in range(12)}
    for a, b, new in merges:
        made[new] = made[a] + made[b]
    rank = {(a, b): (i, new) for i, (a, b, new) in enumerate(merges)}
    vocab = theirs.get_vocab()
    assert len(vocab) == 12 + len(merges) and {letter(p) for p in made.values()} == set(vocab)
    for w in words:
        assert [letter(made[i]) for i in apply_bpe(w, rank)] == theirs.encode(letter(w)).tokens


def test_collator(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (0, []), (0, None), (1, [7])], "b int, ids array<int>")
    got = {tuple(r["ids"]): (r["attention_mask"], r["labels"]) for r in batch.collate(df, "ids", ["b"], 0, copy_labels=True).collect()}
    assert got == {(1, 2, 3): ([1, 1, 1], [1, 2, 3]), (4, 0, 0): ([1, 0, 0], [4, -100, -100]), (7,): ([1], [7])}


def test_special_ids(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2],)], "ids array<int>")
    got = [r["x"] for r in df.select(split.with_special(F.col("ids"), 4, 0, 9).alias("x")).collect()]
    assert got == [[0, 1, 2], [0, 1, 2, 9]]


def test_density_chunks_cover_all_bars(spark):
    counts = [3, 50, 1, 1, 1, 400, 2, 2, 30, 30, 30]
    df = spark.createDataFrame([(1, b, n) for b, n in enumerate(counts)], "score_id long, bar long, n_notes long")
    chunks = split.density_chunks(df, 100, 2.0, overlap=1, min_len=0).orderBy("chunk").collect()
    assert {b for c in chunks for b in range(c["first_bar"], c["last_bar"] + 1)} == set(range(len(counts)))
    assert all(a["first_bar"] < b["first_bar"] for a, b in zip(chunks, chunks[1:], strict=False))


def test_density_chunks_keep_all_but_a_short_end(spark):
    chunks = lambda counts, **o: [(r["first_bar"], r["last_bar"]) for r in split.density_chunks(spark.createDataFrame([(1, b, n) for b, n in enumerate(counts)], "score_id long, bar long, n_notes long"), 100, 1.0, **o).orderBy("chunk").collect()]
    assert chunks([10, 200, 60, 60], overlap=0) == [(0, 0), (1, 1), (2, 3)]
    assert chunks([10, 200, 60, 60, 5], overlap=0) == [(0, 0), (1, 1), (2, 3)]  # an end of less than a quarter goes
    assert chunks([5]) == [] and chunks([30]) == [(0, 0)]

    def walk(tokens, most, overlap):  # bar by bar
        out, start, bar, held = [], 0, 0, 0
        while bar < len(tokens):
            if held + tokens[bar] > most:
                alone = bar == start
                stop = bar if not alone and not overlap and most - held < tokens[bar] / 2 else bar + 1
                if stop < len(tokens):
                    out.append((start, stop - 1))
                    start = max(start + 1, stop - (0 if alone else overlap))
                    held = sum(tokens[start : bar + 1])
                else:
                    held += tokens[bar]
            else:
                held += tokens[bar]
            bar += 1
        return [*out, (start, len(tokens) - 1)] if held >= most // 4 else out

    rnd = random.Random(3)
    for overlap in (0, 1, 3):
        counts = [rnd.choice([0, 5, 20, 45, 80, 130]) for _ in range(60)]
        assert chunks(counts, overlap=overlap) == walk(counts, 100, overlap)


def test_parts_of_scores(spark):
    from tactus.sources.tables import NOTES, Score

    notes = spark.createDataFrame([(1, 0, 5, False, t, 480, 60, 9) for t in range(0, 9600, 480)], NOTES)
    sigs = spark.createDataFrame([(1, 0, 4, 4), (1, 3840, 3, 4)], "score_id long, tick long, num int, den int")
    pedals = spark.createDataFrame([(1, 0, 4000, 100)], "score_id long, track_idx int, tick long, dur long")
    score = Score(notes, time_sigs=sigs, pedals=pedals)
    parts = split.beat_parts(score, 8)
    assert [(r["start"], r["stop"]) for r in parts.orderBy("part").collect()][:2] == [(0, 3840), (3840, 7680)]
    made = split.split_score(score, parts)
    assert sorted((r["part"], r["tick"]) for r in made.notes.collect()) == sorted((t // 3840, t % 3840) for t in range(0, 9600, 480))
    assert sorted((r["part"], r["tick"], r["num"]) for r in made.time_sigs.collect()) == [(0, 0, 4), (1, 0, 3), (2, 0, 3)]
    assert [(r["part"], r["tick"]) for r in made.pedals.collect()] == [(1, 160)]
    assert split.beat_parts(score, 8, least=4).count() == 2
    cut = split.split_score(score, split.tick_parts(notes.select("score_id").distinct(), [1000]))
    assert {r["part"] for r in cut.notes.collect()} == {0, 1} and cut.notes.count() == 20


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("bars").collect()}
    assert got == {(r["start"], r["event_type"], r["n"]) for r in windows.tumbling(events).collect()}


def test_tracks_and_scores(spark):
    from tactus.operators import tracks
    from tactus.sources.tables import NOTES, Score

    notes = spark.createDataFrame([(1, 0, 5, False, 0, 1, 60, 9), (1, 2, -1, True, 4, 1, 36, 9)], NOTES)
    assert [tuple(p) for p in tracks.programs(notes).collect()[0]["programs"]] == [(5, False), (-1, True)]
    names = spark.createDataFrame([(1, 2, "drums"), (1, 0, "piano")], "score_id long, track_idx int, name string")
    merged, name = tracks.merge_tracks(Score(notes), names)
    assert {r["track_idx"] for r in merged.notes.collect()} == {0} and name.collect()[0]["name"] == "piano / drums"
    assert tracks.empty_tracks(names.select("score_id", "track_idx").union(spark.createDataFrame([(1, 1)], "score_id long, track_idx int")), Score(notes)).collect()[0]["track_idx"] == 1
    assert tracks.merge_scores([Score(notes), Score(notes)]).notes.count() == 4
    with pytest.raises(ValueError, match="different"):
        tracks.merge_scores([Score(notes), Score(notes, tpq=8)])
    assert tracks.common_folder(["/a/b/c.mid", "/a/b/d/e.mid"]) == "/a/b"


def test_subword_models_are_fitted_on_all_words(spark):
    # 60,000 words that occur once; those of a common pair come last in order of ids
    last = F.when(F.col("id") >= 50_000, F.array(F.lit(252), F.lit(253))).otherwise(F.array((F.col("id") % 241).cast("int"), (F.col("id") % 239).cast("int")))
    df = spark.range(60_000).select(F.concat(F.array((F.col("id") / 240).cast("int"), (F.col("id") % 240).cast("int")), last).alias("ids"))
    assert SubwordModel.train(df, "BPE", 254, 255).pieces == [(252, 253)]


def test_fits_in_spark_and_in_memory_are_the_same(spark, monkeypatch):
    from tactus.operators import subword

    monkeypatch.setattr(subword, "PENDING", 5)
    rnd = random.Random(5)
    counts = list({tuple(rnd.choices(range(6), [8, 4, 2, 1, 1, 1], k=rnd.randint(1, 12))): rnd.randint(1, 9) for _ in range(300)}.items())
    df = spark.createDataFrame([(list(w), n) for w, n in counts], "ids array<int>, n long")
    for fit, train in ((fit_bpe, train_bpe), (fit_wordpiece, train_wordpiece)):
        assert fit(df, 6, 30, in_memory=0) == fit(df, 6, 30) == train(counts, 6, 30)
    assert fit_unigram(df, 6, 30) == train_unigram(counts, 6, 30)
