"""The engine's front: a tokenization with its options, vocabulary and, if trained, subword model."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.operators import attributes, augment, compound, decode, encode, folds, grid, preprocess, sequences, split, validate
from tactus.operators.subword import SubwordModel
from tactus.plans.vocab import MULTI, OWN, Vocabulary, effective
from tactus.sources import abc, midi, tokens
from tactus.sources.tables import Score

COMPOUND = {"Octuple": compound.octuple, "MuMIDI": compound.mumidi, "CPWord": compound.cpword}
ROW_DECODERS = {"Octuple": decode.decode_octuple, "MuMIDI": decode.decode_mumidi, "CPWord": decode.decode_cpword}
FILE = "tokenizer.json"


class Tokenizer:
    def __init__(self, kind: str, config: TokenizerConfig | None = None, base: str = "TSD"):
        self.kind, self.base = kind, base
        self.config = effective(kind, config or TokenizerConfig())
        self.vocabulary = Vocabulary(kind, self.config, base)
        self.model: SubwordModel | None = None
        self.controls: tuple[attributes.Control, ...] = ()

    # --- vocabulary

    def __len__(self) -> int:
        return len(self.model) if self.model else len(self.vocabulary)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Tokenizer) and (self.kind, self.config, self.vocabulary.lists, self.model and self.model.pieces) == (other.kind, other.config, other.vocabulary.lists, other.model and other.model.pieces)

    __hash__ = None

    def __getitem__(self, item: str | int | tuple) -> int | str:
        """Id of a token or token of an id; (vocabulary, item) where there are several."""
        voc, item = item if isinstance(item, tuple) else (0, item)
        return self.vocabulary.lists[voc].index(item) if isinstance(item, str) else self.vocabulary.lists[voc][item]

    def __repr__(self) -> str:
        trained = f", {self.model.kind} model of {len(self.model)}" if self.model else ""
        return f"Tokenizer({self.kind}, {len(self.vocabulary)} tokens in {len(self.vocabulary.lists)} vocabularies{trained})"

    def __call__(self, data: Score | DataFrame | str, spark: SparkSession | None = None) -> DataFrame | Score:
        """Sequences of a score or of the files below a path, or the score of sequences."""
        if isinstance(data, Score):
            return self.encode(data)
        if isinstance(data, str):
            return self.encode(self.read(spark or SparkSession.active(), data)[0])
        return self.decode(data)

    @property
    def pad_token_id(self) -> int:
        return self["PAD_None"]

    @property
    def io_format(self) -> tuple[str, ...]:
        one = self.config.use_programs and self.config.one_token_stream_for_programs or self.kind == "MMM"
        return (*(() if one else ("I",)), "T", *(("C",) if self.kind in MULTI else ()))

    def token_ids_of_type(self, name: str, voc: int = 0) -> list[int]:
        return [i for i, t in enumerate(self.vocabulary.lists[voc]) if t.split("_")[0] == name]

    def add_to_vocab(self, token: str, voc: int = 0) -> int:
        """Append a token; one that is there keeps its id."""
        found = self.vocabulary.lists[voc]
        token = token if "_" in token else f"{token}_None"
        if token not in found:
            found.append(token)
        return found.index(token)

    def add_control(self, control: attributes.Control) -> None:
        """Have an attribute control of one's own in encode(with_controls=True); its tokens join the vocabulary."""
        if self.kind in MULTI:
            raise ValueError("tokenizations of several vocabularies have no attribute controls")
        self.controls += (control,)
        for token in control.tokens:
            self.add_to_vocab(token)

    # --- scores to tokens and back

    def preprocess(self, score: Score) -> Score:
        if self.kind == "PerTok":
            return preprocess.preprocess_fine(score, self.config, folds.fine_tpq(self.config))
        return preprocess.preprocess(score, self.config)

    def encode(self, score: Score, with_controls: bool = False, track_ratio: attributes.Ratio = 1.0, bar_ratio: attributes.Ratio = 1.0, seed: int = 0) -> DataFrame:
        """(score_id, stream, tokens, ids): a row a sequence.  Compound tokens and their ids are arrays of arrays.

        with_controls: attribute controls as well; with ratios below 1, or ranges of them, a sample by hash: of each
        track's controls, and of each bar control's bars.
        """
        ready = self.preprocess(score)
        chords = folds.chords(ready.notes, self.config, ready.time_sigs) if self.config.use_chords else None
        if self.kind in MULTI:
            args = () if self.kind == "Octuple" else (chords,)
            rows = COMPOUND[self.kind](ready, self.config, *args, preprocessed=True)
            seqs = rows.groupBy("score_id", "stream").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("r")).select("score_id", "stream", F.transform("r", lambda r: r["tokens"]).alias("tokens"))
            n = len(self.vocabulary.lists)
            return seqs.withColumn("ids", F.transform("tokens", lambda t: F.array(*[self.vocabulary.id_of(F.get(t, F.lit(i)), i) for i in range(n)])))
        controls = None
        if with_controls:
            controls = attributes.control_tokens(ready.notes, self.config, ready.time_sigs, self.controls)
            if (track_ratio, bar_ratio) != (1.0, 1.0):
                controls = attributes.sampled(controls, track_ratio, bar_ratio, seed)
        if self.kind in OWN:
            rows = OWN[self.kind].encode(ready, self.config)
        elif self.kind == "PerTok":
            rows = folds.pertok(ready, self.config)
        elif self.kind == "MMM":
            found = encode.mmm_sequences(ready, self.config, self.base, preprocessed=True, chords=chords, controls=controls)
            rows = found.select("score_id", F.lit(0).alias("stream"), F.posexplode("tokens").alias("pos", "token"))
        else:
            rows = encode.token_rows(encode.encode(ready, self.kind, self.config, preprocessed=True, chords=chords, controls=controls))
        rows = encode.with_ids(rows, self.vocabulary).groupBy("score_id", "stream").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "id"))).alias("r"))
        return rows.select("score_id", "stream", F.transform("r", lambda r: r["token"]).alias("tokens"), F.transform("r", lambda r: r["id"]).alias("ids"))

    def unknown_time_signatures(self, score: Score) -> DataFrame:
        """(score_id, num, den) of the time signatures that the vocabulary does not have."""
        known = self.config.time_signatures
        rows = score.time_sigs if score.time_sigs is not None else split.default_signatures(score.notes)
        return rows.where(~F.struct(F.col("num").cast("int"), F.col("den").cast("int")).isin(*[F.struct(F.lit(n), F.lit(d)) for n, d in known])).select("score_id", "num", "den").distinct()

    def complete(self, rows: DataFrame) -> DataFrame:
        """Sequences with ids, tokens and letters, each from the others; ids of the model become base ids."""
        return sequences.complete(rows, self.vocabulary, self.model)

    def with_tokens(self, sequences: DataFrame) -> DataFrame:
        """(score_id, stream, tokens, ids) of (score_id, stream, ids)."""
        if "tokens" in sequences.columns:
            return sequences.select("score_id", "stream", "tokens", "ids")
        return sequences.select("score_id", "stream", F.transform("ids", lambda i: self.vocabulary.token_of(i)).alias("tokens"), "ids")

    def decode(self, sequences: DataFrame) -> Score:
        """A score of (score_id, stream, ids); what the tokens do not say is at its default.

        Sequences are walked once: the rows of all tables are kept as the score's `source`, to be unpersisted when they
        are no longer needed.
        """
        n = len(self.vocabulary.lists)
        if self.kind in MULTI:
            rows = sequences.select("score_id", "stream", F.posexplode("ids").alias("pos", "row"))
            rows = rows.select("score_id", "stream", "pos", F.array(*[self.vocabulary.token_of(F.get("row", F.lit(i)), i) for i in range(n)]).alias("tokens"))
            return Score(ROW_DECODERS[self.kind](rows, self.config).withColumnRenamed("stream", "track_idx"), tpq=self.config.tpq)
        seqs = self.with_tokens(sequences)
        if self.kind == "PerTok":
            found = folds.decode_pertok(seqs, self.config)
            return Score(found.withColumnRenamed("stream", "track_idx").withColumn("program", F.coalesce("program", F.lit(0))), tpq=folds.fine_tpq(self.config))
        kind = self.kind
        if kind == "MMM":
            kind = self.base
            seqs = decode.split_mmm(seqs).groupBy("score_id", "stream").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("r")).select("score_id", "stream", F.transform("r", lambda r: r["token"]).alias("tokens"))
        rows = decode.decode_rows(seqs, kind, self.config).persist(StorageLevel.MEMORY_AND_DISK)
        of = lambda name, *columns: rows.where(F.col("kind") == name).select("score_id", *columns).distinct()
        track = F.col("stream").alias("track_idx")
        notes = decode.decoded_notes(rows).withColumnRenamed("stream", "track_idx")
        return Score(
            notes,
            of("tempo", "tick", "qpm"),
            of("time_sig", "tick", F.col("a").alias("num"), F.col("b").alias("den")),
            of("pedal", track, "tick", "dur"),
            of("bend", track, "tick", F.col("a").alias("value")),
            self.config.tpq,
            source=rows,
        )

    def errors(self, sequences: DataFrame) -> DataFrame:
        """(score_id, stream, n_tokens, n_errors, ratio) of (score_id, stream, tokens)."""
        c = self.config
        if self.kind in MULTI:
            rows = sequences.select("score_id", "stream", F.posexplode("tokens").alias("pos", "tokens"))
            if self.kind == "CPWord":
                return validate.error_ratio(validate.family_rows(rows), self.vocabulary)
            if self.kind == "Octuple":
                program = 3 + c.use_velocities + c.use_note_durations if c.use_programs else None
                found = validate.octuple_errors(rows, program, c.remove_duplicated_notes)
            else:
                found = validate.mumidi_errors(rows, self.vocabulary)
            found = found.withColumnRenamed("n_rows", "n_tokens")
            return found.withColumn("ratio", F.col("n_errors") / F.col("n_tokens"))
        if self.kind == "MMM":
            tracks = decode.split_mmm(sequences).where(~F.col("token").startswith("Program_"))
            return validate.error_ratio(tracks, Vocabulary(self.base, c)).groupBy("score_id").agg(F.lit(0).alias("stream"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_errors").alias("n_errors")).withColumn("ratio", F.col("n_errors") / F.col("n_tokens"))
        rows = sequences.select("score_id", "stream", F.posexplode("tokens").alias("pos", "token"))
        if self.kind == "PerTok":  # its syntax forbids nothing
            return rows.groupBy("score_id", "stream").agg(F.count("*").alias("n_tokens")).select("*", F.lit(0).cast("long").alias("n_errors"), F.lit(0.0).alias("ratio"))
        found = validate.error_ratio(rows, self.vocabulary)
        if self.kind != "MIDILike":
            return found
        pairs = validate.on_off_errors(rows, c)
        errors = F.col("n_errors") + F.coalesce(F.col("orphan_offs") + F.col("open_notes") + F.col("too_long"), F.lit(0))
        return found.join(pairs, ["score_id", "stream"], "left").select("score_id", "stream", "n_tokens", errors.alias("n_errors"), (errors / F.col("n_tokens")).alias("ratio"))

    # --- subword models

    def words(self, sequences: DataFrame) -> DataFrame:
        """(score_id, stream, word, ids): sequences cut at bars or beats, or whole, as encode_ids_split says; models never cross a cut.

        A cut is before the first token of a bar, or beat, that is not a time shift or rest into it.  MMM is cut at its
        tracks, too.
        """
        how = self.config.encode_ids_split
        seqs, kind = sequences, self.kind
        if how == "no":
            return sequences.select("score_id", "stream", F.lit(0).alias("word"), "ids")
        if kind == "MMM":
            kind = self.base
            w = Window.partitionBy("score_id", "stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
            rows = self.with_tokens(sequences).select("score_id", "stream", F.posexplode(F.arrays_zip("tokens", "ids")).alias("pos", "t"))
            rows = rows.withColumn("track", F.sum((F.col("t.tokens") == "Track_Start").cast("int")).over(w))
            rows = rows.groupBy("score_id", "stream", "track").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("r"))
            seqs = rows.select("score_id", F.col("track").alias("stream"), F.transform("r", lambda r: r["t"]["tokens"]).alias("tokens"), F.transform("r", lambda r: r["t"]["ids"]).alias("ids"))
            found = decode.split_words(seqs, kind, self.config, how == "beat")
            return found.select("score_id", F.lit(0).alias("stream"), (F.col("stream").cast("long") * (1 << 32) + F.col("word")).alias("word"), "ids")
        if kind == "REMI" and how == "bar":  # every bar has its token
            heads = self.token_ids_of_type("Bar")
            ends = [self["Bar_End"]] if "Bar_End" in self.vocabulary.lists[0] else []
            rows = seqs.select("score_id", "stream", F.posexplode("ids").alias("pos", "id"))
            w = Window.partitionBy("score_id", "stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn("word", F.sum(F.col("id").isin([h for h in heads if h not in ends]).cast("int")).over(w))
            made = rows.groupBy("score_id", "stream", "word").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("r"))
            return made.select("score_id", "stream", "word", F.transform("r", lambda r: r["id"]).alias("ids"))
        if kind in OWN or kind == "PerTok":
            raise ValueError(f"{kind} is not cut at bars or beats: encode_ids_split='no'")
        return decode.split_words(self.with_tokens(seqs), kind, self.config, how == "beat")

    def train(self, sequences: DataFrame, vocab_size: int, model: str = "BPE") -> SubwordModel:
        if self.kind in MULTI:
            raise ValueError("tokenizations of several vocabularies take no subword model")
        self.model = SubwordModel.train(self.words(sequences), model, len(self.vocabulary), vocab_size)
        return self.model

    def encode_ids(self, sequences: DataFrame) -> DataFrame:
        coded = self.model.encode(self.words(sequences))
        joined = coded.groupBy("score_id", "stream").agg(F.array_sort(F.collect_list(F.struct("word", "ids"))).alias("w"))
        return joined.select("score_id", "stream", F.flatten(F.transform("w", lambda w: w["ids"])).alias("ids"))

    def decode_ids(self, sequences: DataFrame) -> DataFrame:
        return self.model.decode(sequences)

    # --- files

    def read(self, spark: SparkSession, path: str, valid: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Score, DataFrame]:
        """The scores of all MIDI and ABC files below a path, and (score_id, path, error); a file that can't be parsed has an error and no score.

        valid: takes the parsed MIDI rows and gives those of the files to keep, as midi.valid_files() does.
        """
        rows = midi.read_midi(spark, path)
        score = midi.to_score(valid(rows) if valid else rows, 480)
        tunes = abc.to_score(abc.read_abc(spark, path))
        paths = score.source.where("kind != 'error'").select("score_id", "path", F.lit(None).cast("string").alias("error")).distinct()
        bad = rows.where("kind = 'error'").select(F.xxhash64("path").alias("score_id"), "path", F.col("text").alias("error"))
        tune_paths = tunes.source.select("score_id", F.concat("path", F.lit("#"), F.col("tune")).alias("path"), F.lit(None).cast("string").alias("error")).distinct()
        both = dataclasses.replace(score, notes=score.notes.unionByName(tunes.notes), time_sigs=score.time_sigs.unionByName(tunes.time_sigs), source=None)
        return both, paths.unionByName(bad).unionByName(tune_paths)

    def tokenize_dataset(self, spark: SparkSession, path: str, out: str, valid: Callable[[DataFrame], DataFrame] | None = None, overwrite: bool = True) -> None:
        """All MIDI and ABC files below a path to token files; files that can't be parsed, or that `valid` leaves out, are skipped."""
        score, paths = self.read(spark, path, valid)
        rows = self.encode(score)
        programs = score.notes.groupBy("score_id").agg(F.sort_array(F.collect_set(F.when(F.col("is_drum"), -1).otherwise(F.col("program")))).alias("programs"))
        if self.model:
            rows = self.encode_ids(rows)
        named = rows.join(programs, "score_id").join(paths.where("error is null").select("score_id", "path"), "score_id")
        tokens.write_tokens(named.select("score_id", "path", "stream", "ids", "programs"), out, overwrite, self.model is not None)

    def augment_dataset(self, spark: SparkSession, path: str, out: str, *args, **options) -> DataFrame:  # noqa: ANN002, ANN003
        """All files below a path, and their variants by augment.augment()'s arguments, as MIDI files in a folder, `name#p1_v2_d3.mid`; the report of the variants."""
        score, paths = self.read(spark, path)
        made = augment.augment_score(score, *args, **options)
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z]+(?=$|#)", "")
        # names of files in different folders may be the same: the score's number tells them apart then
        stems = paths.where("error is null").select(F.col("score_id").alias("original"), name.alias("stem"))
        twice = F.count("*").over(Window.partitionBy("stem")) > 1
        stems = stems.withColumn("stem", F.when(twice, F.concat("stem", F.lit("-"), F.hex("original"))).otherwise(F.col("stem")))
        names = made.source.join(stems, "original").select("score_id", "original", "suffix", F.concat("stem", "suffix").alias("name"))
        files = midi.to_files(made).join(names, "score_id")
        midi.write_files(files.select("name", "content"), out, "name").count()
        return names.groupBy("suffix").agg(F.count("*").alias("n_files"))

    def split_for_training(self, score: Score, max_len: int, tokens_per_note: float, overlap: int = 1) -> Score:
        """Chunks of bars that give about max_len tokens: the score's tables with `part`, and in its notes `marker` (`chunk i/n`).

        Ticks count from a chunk's first bar, where its tempo and time signature stand.
        """
        ready = self.preprocess(score)
        signatures = ready.time_sigs if ready.time_sigs is not None else split.default_signatures(ready.notes)
        bars = grid.notes_per_bar(ready.notes, ready.tpq, time_sigs=signatures)
        chunks = split.density_chunks(bars, max_len, tokens_per_note, overlap)
        made = split.split_score(ready, split.bar_parts(chunks, signatures, ready.tpq))
        last = chunks.groupBy("score_id").agg(F.max("chunk").alias("last"))
        notes = made.notes.join(last, "score_id").withColumn("marker", F.concat(F.lit("chunk "), F.col("part"), F.lit("/"), F.col("last"))).drop("last")
        return dataclasses.replace(made, notes=notes)

    def split_files(self, spark: SparkSession, path: str, out: str, max_len: int, tokens_per_note: float, overlap: int = 1) -> DataFrame:
        """The chunks of all files below a path as MIDI files `score_part.mid` in a folder: (path, bytes)."""
        score, _ = self.read(spark, path)
        made = self.split_for_training(score, max_len, tokens_per_note, overlap)
        key = lambda df: None if df is None else df.withColumn("score_id", F.xxhash64("score_id", "part")).drop("part", "marker")
        names = made.notes.select(F.xxhash64("score_id", "part").alias("score_id"), F.concat(F.hex("score_id"), F.lit("_"), F.col("part")).alias("name")).distinct()
        whole = dataclasses.replace(made, notes=key(made.notes), tempos=key(made.tempos), time_sigs=key(made.time_sigs), pedals=key(made.pedals), bends=key(made.bends))
        return midi.write_files(midi.to_files(whole).join(names, "score_id").select("name", "content"), out, "name")

    def dataset(self, spark: SparkSession, path: str, max_len: int, label: Column | None = None, bos: str = "BOS_None", eos: str = "EOS_None") -> DataFrame:
        """(path, stream, ids, labels, error): samples of all files below a path; a file that can't be parsed is a row with null ids.

        label: a column over (path, stream, tokens, ids), by default null.
        """
        score, paths = self.read(spark, path)
        rows = self.encode(score).join(paths, "score_id", "right")
        rows = rows.withColumn("labels", F.lit(None) if label is None else label)
        return self.samples(rows, max_len, bos, eos).select("path", "stream", "ids", "labels", "error")

    def samples(self, sequences: DataFrame, max_len: int, bos: str = "BOS_None", eos: str = "EOS_None") -> DataFrame:
        """Sequences cut to max_len with BOS and EOS; with a `marker` column, BOS on the first chunk only and EOS on the last."""
        ids = {False: None, True: self[bos]}, {False: None, True: self[eos]}
        if "marker" not in sequences.columns:
            return sequences.withColumn("ids", split.with_special(F.col("ids"), max_len, ids[0][True], ids[1][True]))
        part, last = (F.regexp_extract("marker", r"chunk (\d+)/(\d+)", i).cast("int") for i in (1, 2))
        cases = [(a, b, split.with_special(F.col("ids"), max_len, ids[0][a], ids[1][b])) for a in (True, False) for b in (True, False)]
        return sequences.withColumn("ids", F.coalesce(*[F.when(((part == 0) == a) & ((part == last) == b), c) for a, b, c in cases]))

    def save(self, path: str) -> str:
        """A file, or FILE in a folder."""
        path = os.path.join(path, FILE) if os.path.isdir(path) or not path.endswith(".json") else path
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"tokenization": self.kind, "base": self.base, "config": self.config.to_dict(), "vocabulary": self.vocabulary.lists}, f)
        if self.model:
            self.model.save(path.removesuffix(".json") + ".model.json")
        return path

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        path = os.path.join(path, FILE) if os.path.isdir(path) else path
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        made = cls(d["tokenization"], TokenizerConfig.from_dict(d["config"]), d["base"])
        made.vocabulary.lists[:] = d["vocabulary"]
        model = path.removesuffix(".json") + ".model.json"
        if os.path.exists(model):
            made.model = SubwordModel.load(model)
        return made
