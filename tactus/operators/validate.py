"""Syntax of token sequences: types that may not follow each other, times that do not advance, notes that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.functions.columns import token_ticks
from tactus.operators.decode import max_duration
from tactus.plans.vocab import Vocabulary

STREAM = ("score_id", "stream")


def type_errors(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Token rows with `error`: 1 where the successor graph has no edge from the type before.  The graph is a literal map: no join."""
    rows = rows.withColumn("type", F.split("token", "_", 2)[0])
    g: dict[str, list[str]] = {}
    for a, b in vocabulary.graph_rows() if vocabulary.graph() else ():  # some tokenizations restrict no succession
        g.setdefault(a, []).append(b)
    w = Window.partitionBy(*STREAM).orderBy("pos")
    before = F.lag("type").over(w)
    if not g:
        return rows.withColumns({"before": before, "error": F.lit(0)})
    allowed = F.create_map(*[x for a, to in g.items() for x in (F.lit(a), F.array(*map(F.lit, to)))])
    ok = F.coalesce(F.array_contains(allowed[F.col("before")], F.col("type")), F.lit(False))
    return rows.withColumn("before", before).withColumn("error", F.when(F.col("before").isNull() | ok, 0).otherwise(1))


def time_errors(rows: DataFrame) -> DataFrame:
    """Token rows with `error`: 1 where a Position is not after the last of its bar; a rest between excuses it."""
    w = Window.partitionBy(*STREAM).orderBy("pos")
    rows = rows.withColumn("type", F.split("token", "_", 2)[0])
    rows = rows.where(F.col("type").isin("Bar", "Position", "Rest"))
    place = F.when(F.col("type") == "Position", F.split("token", "_", 2)[1].cast("int")).otherwise(-1)
    rows = rows.withColumn("place", place).withColumn("last", F.lag("place").over(w))
    return rows.withColumn("error", F.when((F.col("type") == "Position") & (F.col("place") <= F.col("last")), 1).otherwise(0))


def repeated_notes(rows: DataFrame) -> DataFrame:
    """Pitch tokens that stand twice between two time tokens: (score_id, stream, error count)."""
    w = Window.partitionBy(*STREAM).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("type", F.split("token", "_", 2)[0])
    moment = F.sum(F.col("type").isin("Bar", "Position", "TimeShift", "Rest").cast("int")).over(w)
    program = F.last(F.when(F.col("type") == "Program", F.col("token")), True).over(w)
    notes = rows.withColumns({"moment": moment, "program": program}).where(F.col("type").isin("Pitch", "PitchDrum"))
    per = notes.groupBy(*STREAM, "moment", "program", "token").agg((F.count("*") - 1).alias("again"))
    return per.groupBy(*STREAM).agg(F.sum("again").alias("errors"))


def error_ratio(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(score_id, stream, n_tokens, n_errors, ratio): type, time and, with remove_duplicated_notes, note errors by token; 0 for no token."""
    types = type_errors(rows, vocabulary).groupBy(*STREAM).agg(F.count("*").alias("n_tokens"), F.sum("error").alias("t"))
    times = time_errors(rows).groupBy(*STREAM).agg(F.sum("error").alias("p"))
    out = types.join(times, list(STREAM), "left")
    errors = F.col("t") + F.coalesce("p", F.lit(0))
    if vocabulary.config.remove_duplicated_notes:
        out = out.join(repeated_notes(rows), list(STREAM), "left")
        errors = errors + F.coalesce("errors", F.lit(0))
    return out.select(*STREAM, "n_tokens", errors.alias("n_errors"), (errors / F.col("n_tokens")).alias("ratio"))


def on_off_errors(rows: DataFrame, config: TokenizerConfig | None = None) -> DataFrame:
    """MIDILike: offs without an open note, notes that never end, and, with max_duration, notes that are too long, per stream: running balance of each pitch."""
    most = max_duration(config) if config else None
    if most is not None:
        shift = F.when(F.split("token", "_", 2)[0].isin("TimeShift", "Rest"), token_ticks(F.split("token", "_", 2)[1], config.tpb(4))).otherwise(0)
        rows = rows.withColumn("tick", F.sum(shift).over(Window.partitionBy(*STREAM).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = rows.withColumn("tick", F.lit(0))
    rows = rows.withColumns({"type": F.split("token", "_", 2)[0], "value": F.split("token", "_", 2)[1]})
    w = Window.partitionBy(*STREAM).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("program", F.last(F.when(F.col("type") == "Program", F.col("value")), True).over(w)).where(F.col("type").isin("NoteOn", "NoteOff", "DrumOn", "DrumOff"))
    key = [*STREAM, "program", F.col("type").startswith("Drum").alias("drum"), "value"]
    rows = rows.select(*key, "pos", "tick", F.when(F.col("type").endswith("On"), 1).otherwise(-1).alias("d"))
    names = [*STREAM, "program", "drum", "value"]
    # an off without an on lowers the running balance below every value before it: the lowest value counts them
    mine = Window.partitionBy(*names).orderBy("pos")
    rows = rows.withColumn("balance", F.sum("d").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    per = rows.groupBy(*names).agg(F.greatest(-F.min("balance"), F.lit(0)).alias("orphans"), F.sum("d").alias("total"))
    out = per.groupBy(*STREAM).agg(F.sum("orphans").alias("orphan_offs"), F.sum(F.col("total") + F.col("orphans")).alias("open_notes"))
    if most is None:
        return out.withColumn("too_long", F.lit(0).cast("long"))
    # the n-th on and the n-th off that has one belong together
    least = F.least(F.coalesce(F.min("balance").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    rows = rows.withColumn("least", least).where((F.col("d") > 0) | (F.col("balance") >= F.col("least")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*names, "d").orderBy("pos")))
    spans = rows.groupBy(*names, "n").agg((F.max(F.when(F.col("d") < 0, F.col("tick"))) - F.max(F.when(F.col("d") > 0, F.col("tick")))).alias("span"))
    long = spans.groupBy(*STREAM).agg(F.count_if(F.col("span") > most).alias("too_long"))
    return out.join(long, list(STREAM))


def octuple_errors(rows: DataFrame, program: int | None = None, repeats: bool = False) -> DataFrame:
    """Octuple rows with a special token, whose bar is before the greatest so far, whose position is before the greatest so far in that bar, or, with repeats, whose program and pitch are there already.

    program: place of the Program token.  (score_id, stream, n_rows, n_errors), one error a row at most.
    """
    w = Window.partitionBy(*STREAM).orderBy("pos")
    sofar = w.rowsBetween(Window.unboundedPreceding, -1)
    value = lambda i: F.split(F.get("tokens", F.lit(i)), "_", 2)[1].try_cast("int")
    rows = rows.withColumns({"bar": value(2), "place": value(1), "special": F.exists("tokens", lambda t: t.endswith("_None"))})
    # a special row says nothing of time; struct order is bar, then position
    here = F.when(~F.col("special"), F.struct("bar", "place"))
    rows = rows.withColumn("most", F.max(here).over(sofar))
    back = (F.col("bar") < F.col("most.bar")) | (F.col("bar") == F.col("most.bar")) & (F.col("place") < F.col("most.place"))
    wrong = F.col("special") | F.coalesce(back, F.lit(False))
    if repeats:
        key = [*STREAM, "bar", "place", *([value(program)] if program is not None else []), F.get("tokens", F.lit(0))]
        wrong = wrong | (F.row_number().over(Window.partitionBy(*key).orderBy("pos")) > 1)
    return rows.withColumn("error", wrong.cast("int")).groupBy(*STREAM).agg(F.count("*").alias("n_rows"), F.sum("error").alias("n_errors"))


def mumidi_errors(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """MuMIDI rows with PAD or MASK, of a type that may not follow, whose bar or position falls back, or whose Position is not their place.

    (score_id, stream, n_rows, n_errors), one error a row at most.
    """
    w = Window.partitionBy(*STREAM).orderBy("pos")
    token = lambda i: F.get("tokens", F.lit(i))
    value = lambda i: F.split(token(i), "_", 2)[1].try_cast("int")
    typed = type_errors(rows.withColumn("token", token(0)), vocabulary)
    typed = typed.withColumns({"bar": value(1), "place": F.coalesce(value(2), F.lit(-1)), "pad": F.exists("tokens", lambda t: t.startswith("PAD_") | t.startswith("MASK_"))})
    last_bar, last_place = F.lag("bar").over(w), F.lag("place").over(w)
    back = (F.col("bar") < last_bar) | (F.col("bar") == last_bar) & (F.col("place") < last_place)
    position = F.col("type") == "Position"
    wrong = position & (F.split("token", "_", 2)[1].try_cast("int") != F.col("place")) | position & (F.col("bar") == last_bar) & (F.col("place") <= last_place)
    wrong = F.col("pad") | (F.col("error") == 1) | F.coalesce(back, F.lit(False)) | F.coalesce(wrong, F.lit(False))
    if vocabulary.config.remove_duplicated_notes:
        moment = F.sum(F.col("type").isin("Bar", "Position", "Program").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        typed = typed.withColumn("moment", moment)
        again = F.row_number().over(Window.partitionBy(*STREAM, "moment", "token").orderBy("pos")) > 1
        wrong = wrong | F.col("type").isin("Pitch", "PitchDrum") & again
    return typed.withColumn("wrong", wrong.cast("int")).groupBy(*STREAM).agg(F.count("*").alias("n_rows"), F.sum("wrong").alias("n_errors"))


def family_rows(rows: DataFrame) -> DataFrame:
    """CPWord rows as token rows of their type, so that the checks of types and times hold for them: a note, a bar, a position or a rest."""
    token = lambda i: F.get("tokens", F.lit(i))
    rest = F.get(F.filter("tokens", lambda t: t.startswith("Rest_")), F.lit(0))
    kind = F.when(token(0) == "Family_Note", F.concat(F.lit("Pitch_"), F.split(token(2), "_", 2)[1])).otherwise(F.coalesce(rest, token(1)))
    return rows.select(*STREAM, "pos", kind.alias("token"))
