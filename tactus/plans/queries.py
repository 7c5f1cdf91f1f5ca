"""Registered queries over the notes view, each with the SQL that DuckDB answers the same way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.config import CHORD_MAPS, TESSITURA, TokenizerConfig
from tactus.operators import attributes, augment, batch, compound, decode, encode, folds, grid, preprocess, split, tracks, validate
from tactus.operators.subword import SubwordModel
from tactus.plans.vocab import Vocabulary, fine_durations, micro_timings
from tactus.sources import midi
from tactus.sources.tables import Score, notes_view, score_tables, table
from tactus.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = TokenizerConfig()
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# --- SQL building blocks

RAW = """raw AS (
  SELECT l_suppkey AS score_id, CAST(l_linenumber - 1 AS INTEGER) AS track_idx,
         CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE (l_suppkey * 7 + l_linenumber) % 128 END AS INTEGER) AS program, l_linenumber = 7 AS is_drum,
         CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 120 + (l_partkey % 7) * 30 AS BIGINT) AS tick, CAST(l_quantity * 30 AS BIGINT) AS dur,
         CAST(21 + l_partkey % 88 AS INTEGER) AS pitch, CAST(1 + l_orderkey % 127 AS INTEGER) AS velocity FROM lineitem)"""
VEL = "vel AS (SELECT v, CAST(b AS INTEGER) AS b FROM (SELECT v, b, row_number() OVER (PARTITION BY v ORDER BY abs(v - b), b DESC) AS rn FROM range(1, 128) t(v), (SELECT unnest(range(1, 33)) * 127 // 32 AS b)) WHERE rn = 1)"
BINS = "bins AS (SELECT unnest(range(1, 32)) AS b UNION ALL SELECT unnest(range(32, 95, 2)) UNION ALL SELECT 96)"
DUR = "durs AS (SELECT d, b FROM (SELECT d, b, row_number() OVER (PARTITION BY d ORDER BY abs(d - b), b DESC) AS rn FROM range(1, 101) t(d), bins) WHERE rn = 1)"


def quantized(where: str = "(is_drum AND pitch BETWEEN 27 AND 88) OR (NOT is_drum AND pitch BETWEEN 21 AND 109)") -> str:
    return f"""{RAW}, {VEL}, {BINS}, {DUR}, n AS (
  SELECT *, row_number() OVER (PARTITION BY score_id, track_idx ORDER BY tick, pitch, dur, velocity) AS ord FROM (
    SELECT score_id, track_idx, program, is_drum, CAST(round_even(tick / 60.0, 0) AS BIGINT) AS tick, durs.b AS dur, pitch, vel.b AS velocity
    FROM raw JOIN vel ON vel.v = raw.velocity JOIN durs ON durs.d = greatest(CAST(round_even(dur / 60.0, 0) AS BIGINT), 1) WHERE {where}))"""


N = quantized()
TESS_ALL = "tess AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {lo}, {hi})" for p, (lo, hi) in enumerate(TESSITURA)) + ") v(program, lo, hi))"
NOTE_COLUMNS = "score_id, track_idx, program, is_drum, tick, dur, pitch, velocity, ord"


def bin_name(t: str) -> str:
    return f"(CASE WHEN ({t}) < 32 THEN (({t}) // 8) || '.' || (({t}) % 8) || '.8' ELSE (({t}) // 8) || '.' || ((({t}) % 8) // 2) || '.4' END)"


def shifts(g: str, name: str = "TimeShift") -> str:
    """Greedy list for g ticks: 12 beats as often as they fit, then one bin, and a last tick where bins are even."""
    r = f"(({g}) % 96)"
    one = f"CASE WHEN {r} = 0 THEN [] WHEN {r} < 32 OR {r} % 2 = 0 THEN ['{name}_' || {bin_name(r)}] ELSE ['{name}_' || {bin_name(f'{r} - 1')}, '{name}_0.1.8'] END"
    return f"list_concat(['{name}_12.0.4' for i in range(greatest(({g}) // 96, 0))], {one})"


PITCH = "(CASE WHEN is_drum THEN 'PitchDrum_' ELSE 'Pitch_' END || pitch)"
NOTE = f"[{PITCH}, 'Velocity_' || velocity, 'Duration_' || {bin_name('dur')}]"


def exploded(source: str, order: str) -> str:
    """(score_id, stream, pos, tick, token) of rows with score_id, stream, tick and a list `tokens`."""
    return f"""SELECT score_id, stream, CAST(row_number() OVER (PARTITION BY score_id, stream ORDER BY {order}, k) - 1 AS BIGINT) AS pos, tick, token
FROM (SELECT *, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM {source})"""


PREV = "coalesce(lag(tick) OVER w, 0)"
TSD = f"""{N}, e AS (SELECT *, track_idx AS stream, list_concat({shifts('tick - prev')}, {NOTE}) AS tokens FROM
  (SELECT *, {PREV} AS prev FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord)))"""
BARS = "CAST(tick // 32 AS BIGINT)"
REMI = f"""{N}, e AS (SELECT *, track_idx AS stream, list_concat(list_concat(['Bar_None' for i in range(greatest(bar - last_bar, 0))],
    CASE WHEN last_tick IS NULL OR last_tick <> tick THEN ['Position_' || (tick % 32)] ELSE [] END), {NOTE}) AS tokens FROM
  (SELECT *, {BARS} AS bar, coalesce(lag({BARS}) OVER w, -1) AS last_bar, lag(tick) OVER w AS last_tick FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord)))"""


def notes(spark: SparkSession, sf: str, config: TokenizerConfig = CONFIG) -> DataFrame:
    return preprocess.preprocess_notes(notes_view(spark, sf), config, 480)


def tokens(spark: SparkSession, sf: str, kind: str, config: TokenizerConfig = CONFIG) -> DataFrame:
    return encode.token_rows(encode.encode(score_tables(spark, sf), kind, config))


# --- preprocessing

register("quantize_ticks", f"WITH {N} SELECT {NOTE_COLUMNS} FROM n")(lambda s, sf: notes(s, sf).select(*NOTE_COLUMNS.split(", ")))

register("nearest_velocity", f"WITH {RAW}, {VEL} SELECT velocity, b AS nearest, count(*) AS n FROM raw JOIN vel ON v = velocity GROUP BY ALL")(
    lambda s, sf: notes_view(s, sf).groupBy("velocity").agg(F.count("*").alias("n")).withColumn("nearest", preprocess.nearest_velocity(F.col("velocity"), CONFIG))
)

register("nearest_duration", f"""WITH {RAW}, {BINS}, d AS (SELECT DISTINCT CAST(round_even(dur * (1 + track_idx) / 60.0, 0) AS BIGINT) AS dur FROM raw)
SELECT dur, (SELECT max(b) FROM bins WHERE abs(b - dur) = (SELECT min(abs(b - dur)) FROM bins)) AS nearest FROM d""")(
    lambda s, sf: notes_view(s, sf).select(F.rint(F.col("dur") * (1 + F.col("track_idx")) / 60).cast("long").alias("dur")).distinct().withColumn("nearest", preprocess.nearest_duration(F.col("dur"), CONFIG, 8))
)

NARROW = TokenizerConfig(pitch_range=(40, 80), drums_pitch_range=(35, 81))
register("pitch_range_filter", f"""WITH {RAW} SELECT score_id, track_idx, count(*) AS n, min(pitch) AS lo, max(pitch) AS hi FROM raw
WHERE (is_drum AND pitch BETWEEN 35 AND 81) OR (NOT is_drum AND pitch BETWEEN 40 AND 80) GROUP BY score_id, track_idx""")(
    lambda s, sf: preprocess.in_pitch_range(notes_view(s, sf), NARROW).groupBy("score_id", "track_idx").agg(F.count("*").alias("n"), F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
)

COARSE = "CAST(pitch % 4 AS INTEGER)"  # few pitches, so that notes repeat
register("dedup_notes", f"""WITH {N}, c AS (SELECT score_id, track_idx, tick // 8 AS tick, {COARSE} AS pitch, dur, ord FROM n)
SELECT score_id, track_idx, tick, pitch, min(ord) AS ord FROM c GROUP BY score_id, track_idx, tick, pitch""")(
    lambda s, sf: preprocess.deduplicated(notes(s, sf).withColumns({"tick": F.floor(F.col("tick") / 8).cast("long"), "pitch": (F.col("pitch") % 4).cast("int")})).select("score_id", "track_idx", "tick", "pitch", "ord")
)

register("fix_overlaps", f"""WITH {N} SELECT score_id, track_idx, tick, pitch, velocity, least(dur, coalesce(lead(tick) OVER w - tick, dur)) AS dur
FROM n WINDOW w AS (PARTITION BY score_id, track_idx, pitch ORDER BY tick, dur, velocity)""")(
    lambda s, sf: preprocess.without_overlaps(notes(s, sf)).select("score_id", "track_idx", "tick", "pitch", "velocity", "dur")
)

register("merge_same_program", f"""WITH {RAW}, p AS (SELECT score_id, track_idx, is_drum, CASE WHEN is_drum THEN -1 ELSE program % 3 END AS program FROM raw)
SELECT score_id, program, m AS track_idx, count(*) AS n FROM (SELECT *, min(track_idx) OVER (PARTITION BY score_id, program) AS m FROM p) GROUP BY ALL""")(
    lambda s, sf: preprocess.merge_same_program(notes_view(s, sf).withColumn("program", F.when(F.col("is_drum"), -1).otherwise(F.col("program") % 3))).groupBy("score_id", "program", "track_idx").agg(F.count("*").alias("n"))
)


@register("pedal_islands", """WITH p AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tick, 3600 * (1 + CAST(event_id % 9 AS BIGINT)) AS dur FROM events),
m AS (SELECT *, max(tick + dur) OVER (PARTITION BY user_id ORDER BY tick, dur ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
i AS (SELECT *, sum(CASE WHEN before >= tick THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tick, dur ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(tick) AS tick, max(tick + dur) - min(tick) AS dur FROM i GROUP BY user_id, island""")
def pedal_islands(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.unix_timestamp("ts").alias("tick"), (3600 * (1 + F.col("event_id") % 9)).cast("long").alias("dur"))
    return preprocess.islands(e, ("user_id",))


TEMPO_BINS = "tb AS (SELECT round(40 + 210 * i / 31.0, 2) AS t FROM range(32) r(i))"
TEMPOS = f"""{TEMPO_BINS}, tempos AS (SELECT score_id, tick, qpm FROM (SELECT score_id, CAST(r.tick // 60 AS BIGINT) AS tick, tb.t AS qpm,
    row_number() OVER (PARTITION BY score_id, r.tick ORDER BY abs(6e7 / q - 6e7 / t), t) AS rn
  FROM (SELECT DISTINCT l_suppkey AS score_id, k.tick, 60.0 + (l_suppkey * k.m) % 150 AS q FROM lineitem, (VALUES (0, 7), (153600, 11), (225600, 13)) k(tick, m)) r, tb) WHERE rn = 1)"""
WITH_TEMPO = TokenizerConfig(use_tempos=True)
register("preprocess_tempos", f"WITH {TEMPOS} SELECT score_id, tick, qpm FROM tempos")(
    lambda s, sf: preprocess.preprocess_tempos(score_tables(s, sf, True).tempos, WITH_TEMPO, 480)
)


@register("tempo_ffill_asof", f"WITH {N}, {TEMPOS} SELECT n.score_id, n.track_idx, n.ord, n.tick, t.qpm FROM n ASOF JOIN tempos t ON n.score_id = t.score_id AND n.tick >= t.tick")
def tempo_ffill_asof(spark: SparkSession, sf: str) -> DataFrame:
    score = preprocess.preprocess(score_tables(spark, sf, True), WITH_TEMPO)
    return compound.placed_notes(score, WITH_TEMPO).select("score_id", "track_idx", "ord", "tick", "qpm")


# --- grid

ENDS = "ends AS (SELECT score_id, max(tick) AS last FROM raw GROUP BY score_id)"
SECTIONS = """sig AS (SELECT e.score_id, k.tick, k.num, k.den, coalesce(lead(k.tick) OVER (PARTITION BY e.score_id ORDER BY k.tick), last + 1) AS until, last
  FROM ends e, (VALUES (0, 4, 4), (153600, 3, 4), (225600, 6, 8)) k(tick, num, den) WHERE k.tick <= e.last)"""


def _signatures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return score_tables(spark, sf, True).time_sigs, notes_view(spark, sf).groupBy("score_id").agg(F.max("tick").alias("end"))


register("bar_ticks", f"""WITH {RAW}, {ENDS}, {SECTIONS}, t AS (SELECT score_id, unnest(range(tick, until, 1920 // den * num)) AS tick FROM sig)
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY tick) - 1 AS BIGINT) AS idx, CAST(tick AS BIGINT) AS tick FROM t""")(
    lambda s, sf: grid.grid_ticks(*_signatures(s, sf), 480, only_onsets=True)
)
register("beat_ticks", f"""WITH {RAW}, {ENDS}, {SECTIONS}, t AS (SELECT score_id, unnest(range(tick, least(until, last), 1920 // den)) AS tick FROM sig)
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY tick) - 1 AS BIGINT) AS idx, CAST(tick AS BIGINT) AS tick FROM t""")(
    lambda s, sf: grid.grid_ticks(*_signatures(s, sf), 480, beats=True, only_onsets=True)
)
register("time_sections", f"""WITH {RAW}, {ENDS}, {SECTIONS}, m AS (SELECT *, lag(1920 // den) OVER (PARTITION BY score_id ORDER BY tick) AS b FROM sig)
SELECT score_id, CAST(coalesce(lead(tick) OVER (PARTITION BY score_id ORDER BY tick), last) AS BIGINT) AS end_tick, CAST(1920 // den AS BIGINT) AS tpb FROM m WHERE b IS NULL OR b <> 1920 // den""")(
    lambda s, sf: grid.sections_table(*_signatures(s, sf), 480)
)


@register("bar_asof", f"""WITH {RAW}, {ENDS}, {SECTIONS}, t AS (SELECT score_id, unnest(range(tick, until, 1920 // den * num)) AS tick FROM sig),
b AS (SELECT score_id, tick, row_number() OVER (PARTITION BY score_id ORDER BY tick) - 1 AS bar FROM t)
SELECT r.score_id, bar, count(*) AS n_notes FROM raw r ASOF JOIN b ON r.score_id = b.score_id AND r.tick >= b.tick GROUP BY ALL""")
def bar_asof(spark: SparkSession, sf: str) -> DataFrame:
    bars = grid.grid_ticks(*_signatures(spark, sf), 480, only_onsets=True)
    return grid.attach(notes_view(spark, sf), bars).groupBy("score_id", "bar").agg(F.count("*").alias("n_notes"))


def _per_bar(keys: str) -> str:
    on = " AND ".join(f"c.{k} = g.{k}" for k in keys.split(", "))
    return f"""WITH {N}, c AS (SELECT {keys}, tick // 32 AS bar, count(*) AS n FROM n GROUP BY ALL), last AS (SELECT score_id, max(bar) AS last FROM c GROUP BY score_id),
g AS (SELECT {', '.join('k.' + k for k in keys.split(', '))}, unnest(range(last + 1)) AS bar FROM (SELECT DISTINCT {keys} FROM c) k JOIN last USING (score_id))
SELECT {', '.join('g.' + k for k in keys.split(', '))}, g.bar, coalesce(c.n, 0) AS n_notes FROM g LEFT JOIN c ON {on} AND c.bar = g.bar"""


register("notes_per_bar", _per_bar("score_id"))(lambda s, sf: grid.notes_per_bar(notes(s, sf), 8))
register("notes_per_bar_track", _per_bar("score_id, track_idx"))(lambda s, sf: grid.notes_per_bar(notes(s, sf), 8, by_track=True))

# --- attribute controls

BARRED = f"{N}, b AS (SELECT *, tick // 32 AS bar FROM n)"
for where, names in (("track", ["score_id", "track_idx"]), ("bar", ["score_id", "track_idx", "bar"])):
    keys = ", ".join(names)
    register(f"onset_polyphony_{where}", f"""WITH {BARRED}, t AS (SELECT {keys}, tick, count(*) AS n FROM b GROUP BY {keys}, tick)
SELECT {keys}, CAST(greatest(1, least(6, min(n))) AS INTEGER) AS poly_min, CAST(greatest(1, least(6, max(n))) AS INTEGER) AS poly_max FROM t GROUP BY {keys}""")(
        lambda s, sf, k=names: attributes.onset_polyphony(attributes.with_bar(notes(s, sf), 8), k, 1, 6)
    )
    register(f"note_density_{where}", f"WITH {BARRED} SELECT {keys}, CASE WHEN count(*) >= 18 THEN '18+' ELSE CAST(count(*) AS VARCHAR) END AS density FROM b GROUP BY {keys}")(
        lambda s, sf, k=names: attributes.note_density(attributes.with_bar(notes(s, sf), 8), k, 18)
    )
    flags = ", ".join(f"max(CAST(dur = {d} AS INTEGER)) AS has_{n}" for n, d in (("whole", 32), ("half", 16), ("quarter", 8), ("eight", 4), ("sixteenth", 2)))
    register(f"note_duration_flags_{where}", f"WITH {BARRED} SELECT {keys}, {flags} FROM b GROUP BY {keys}")(
        lambda s, sf, k=names: attributes.note_durations(attributes.with_bar(notes(s, sf), 8), k, 8)
    )
register("pitch_class_bar", f"WITH {BARRED} SELECT DISTINCT score_id, track_idx, bar, pitch % 12 AS pitch_class FROM b")(
    lambda s, sf: attributes.pitch_classes(attributes.with_bar(notes(s, sf), 8), attributes.BAR)
)
register("track_density", f"""SELECT score_id, track_idx, CAST(greatest(0, least(18, min(n_notes))) AS INTEGER) AS density_min, CAST(greatest(0, least(18, max(n_notes))) AS INTEGER) AS density_max
FROM ({_per_bar('score_id, track_idx')}) GROUP BY score_id, track_idx""")(lambda s, sf: attributes.track_density(notes(s, sf), 8, 0, 18))


def repetition(source: str, bar: str = "{t} // 32", start: str = "{b} * 32", length: str = "32") -> str:
    """WITH parts up to `rep` (score_id, track_idx, repetition); bar of a tick t, start and length of a bar b."""
    return f"""c AS (SELECT DISTINCT score_id, track_idx, bar, t - ({start.format(b='bar')}) AS at, kind, pitch FROM (SELECT *, {bar.format(t='t')} AS bar FROM (
    SELECT score_id, track_idx, tick AS t, 0 AS kind, pitch FROM {source} UNION ALL SELECT score_id, track_idx, tick + dur, 1, pitch FROM {source}))),
z AS (SELECT score_id, track_idx, bar, count(*) AS n FROM c GROUP BY ALL), u AS (SELECT score_id, track_idx, max(tick + dur) AS until FROM {source} GROUP BY ALL),
l AS (SELECT score_id, {bar.format(t='max(tick)')} AS last FROM {source} GROUP BY score_id),
p AS (SELECT z.*, o.k AS other FROM z JOIN l USING (score_id) JOIN u USING (score_id, track_idx), LATERAL (SELECT unnest(range(z.bar + 1, least(z.bar + 3, l.last) + 1)) AS k) o
      WHERE z.bar < l.last AND ({start.format(b='o.k')}) + ({length.format(b='o.k')}) <= until AND ({length.format(b='o.k')}) = ({length.format(b='z.bar')})),
m AS (SELECT p.score_id, p.track_idx, p.bar, p.other, p.n, count(d.bar) AS shared FROM p JOIN c USING (score_id, track_idx, bar)
      LEFT JOIN c d ON d.score_id = p.score_id AND d.track_idx = p.track_idx AND d.bar = p.other AND d.at = c.at AND d.kind = c.kind AND d.pitch = c.pitch GROUP BY ALL),
rep AS (SELECT score_id, track_idx, CAST(greatest(ceil(avg(shared / n) * 9.0 - 0.5), 0.0) / 9.0 + 0.0 AS DOUBLE) AS repetition FROM m GROUP BY ALL)"""


# few pitches and places in the bar, so that bars are alike
register("bar_repetition", f"WITH {N}, o AS (SELECT * REPLACE (pitch % 2 AS pitch, tick - tick % 16 AS tick, dur % 2 * 8 + 8 AS dur) FROM n), {repetition('o')} SELECT * FROM rep")(
    lambda s, sf: attributes.repetition(notes(s, sf).withColumns({"pitch": F.col("pitch") % 2, "tick": F.col("tick") - F.col("tick") % 16, "dur": F.col("dur") % 2 * 8 + 8}), 8, 10, 4)
)

# --- time signatures: 4/4 to bar 80, 3/4 to bar 130, then 6/8, at 16 ticks a quarter

SIGNED = TokenizerConfig(use_time_signatures=True)
N_TS = f"""{RAW}, {VEL}, {BINS}, {DUR}, n AS (
  SELECT *, row_number() OVER (PARTITION BY score_id, track_idx ORDER BY tick, pitch, dur, velocity) AS ord, CASE WHEN tick >= 7520 THEN 8 ELSE 4 END AS den, CASE WHEN tick >= 7520 THEN 1 ELSE 2 END AS step,
         CASE WHEN tick < 5120 THEN tick // 64 WHEN tick < 7520 THEN 80 + (tick - 5120) // 48 ELSE 130 + (tick - 7520) // 48 END AS bar,
         CASE WHEN tick < 5120 THEN tick - tick % 64 WHEN tick < 7520 THEN tick - (tick - 5120) % 48 ELSE tick - (tick - 7520) % 48 END AS bar_tick,
         CASE WHEN tick < 5120 THEN '4/4' WHEN tick < 7520 THEN '3/4' ELSE '6/8' END AS sig
  FROM (SELECT score_id, track_idx, program, is_drum, CAST(round_even(t1 / s, 0) * s AS BIGINT) AS tick, durs.b * s AS dur, pitch, vel.b AS velocity
        FROM (SELECT *, CAST(round_even(tick / 30.0, 0) AS BIGINT) AS t1, CASE WHEN round_even(tick / 30.0, 0) >= 7520 THEN 1 ELSE 2 END AS s FROM raw WHERE (is_drum AND pitch BETWEEN 27 AND 88) OR (NOT is_drum AND pitch BETWEEN 21 AND 109)) r
        JOIN vel ON vel.v = r.velocity JOIN durs ON durs.d = greatest(CAST(round_even(round_even(dur / 30.0, 0) / s, 0) AS BIGINT), 1)))"""
BAR_TS = "(CASE WHEN {t} < 5120 THEN ({t}) // 64 WHEN {t} < 7520 THEN 80 + ({t} - 5120) // 48 ELSE 130 + ({t} - 7520) // 48 END)"
START_TS = "(CASE WHEN {b} < 80 THEN ({b}) * 64 WHEN {b} < 130 THEN 5120 + ({b} - 80) * 48 ELSE 7520 + ({b} - 130) * 48 END)"
LENGTH_TS = "(CASE WHEN {b} < 80 THEN 64 ELSE 48 END)"


def signed(spark: SparkSession, sf: str, config: TokenizerConfig = SIGNED) -> Score:
    return preprocess.preprocess(score_tables(spark, sf, True), config)


register("quantize_ticks_ts", f"WITH {N_TS} SELECT {NOTE_COLUMNS} FROM n")(lambda s, sf: signed(s, sf).notes.select(*NOTE_COLUMNS.split(", ")))


@register("notes_per_bar_ts", f"""WITH {N_TS}, c AS (SELECT score_id, track_idx, bar, count(*) AS n FROM n GROUP BY ALL), last AS (SELECT score_id, max(bar) AS last FROM c GROUP BY score_id),
g AS (SELECT k.score_id, k.track_idx, unnest(range(last + 1)) AS bar FROM (SELECT DISTINCT score_id, track_idx FROM c) k JOIN last USING (score_id))
SELECT g.score_id, g.track_idx, g.bar, coalesce(c.n, 0) AS n_notes FROM g LEFT JOIN c USING (score_id, track_idx, bar)""")
def notes_per_bar_ts(spark: SparkSession, sf: str) -> DataFrame:
    score = signed(spark, sf)
    return grid.notes_per_bar(score.notes, score.tpq, by_track=True, time_sigs=score.time_sigs)


ALL_CONTROLS = dict.fromkeys(("ac_polyphony_track", "ac_polyphony_bar", "ac_pitch_class_bar", "ac_note_density_track", "ac_note_density_bar", "ac_note_duration_bar", "ac_note_duration_track", "ac_repetition_track"), True)


def controls(source: str, tpq: int, rep: str) -> str:
    """All attribute controls of notes with bar and bar_tick; rep: the WITH parts of repetition()."""
    def poly(keys: str, tick: str, head: str, place: int) -> str:
        t = f"(SELECT {keys}, CAST(greatest(1, least(6, min(k))) AS INTEGER) AS lo, CAST(greatest(1, least(6, max(k))) AS INTEGER) AS hi FROM (SELECT {keys}, tick, count(*) AS k FROM {source} GROUP BY {keys}, tick) GROUP BY {keys})"
        return f"SELECT score_id, track_idx, {tick} AS tick, '{head}' AS head, '{head}OnsetPolyphony' || w || '_' || CASE w WHEN 'Min' THEN lo ELSE hi END AS token, {place} + k AS place FROM {t}, (VALUES (0, 'Min'), (1, 'Max')) v(k, w)"

    def lengths(keys: str, tick: str, head: str, place: int) -> str:
        return f"SELECT score_id, track_idx, {tick}, '{head}', '{head}NoteDuration' || name || '_' || max(CAST(dur = d AS INTEGER)), {place} + k FROM {source}, (VALUES (0, 'Whole', {4 * tpq}), (1, 'Half', {2 * tpq}), (2, 'Quarter', {tpq}), (3, 'Eight', {tpq // 2}), (4, 'Sixteenth', {tpq // 4})) v(k, name, d) GROUP BY {keys}, k, name"

    track, bar = "score_id, track_idx", "score_id, track_idx, bar, bar_tick"
    return f"""{rep}, every AS (SELECT s.score_id, s.track_idx, unnest(range(last + 1)) AS bar FROM (SELECT DISTINCT score_id, track_idx FROM {source}) s JOIN (SELECT score_id, max(bar) AS last FROM {source} GROUP BY score_id) USING (score_id)),
dens AS (SELECT score_id, track_idx, CAST(least(18, min(k)) AS INTEGER) AS lo, CAST(least(18, max(k)) AS INTEGER) AS hi FROM (SELECT e.score_id, e.track_idx, e.bar, count(s.bar) AS k FROM every e LEFT JOIN {source} s USING (score_id, track_idx, bar) GROUP BY ALL) GROUP BY ALL)
SELECT score_id, track_idx, CAST(tick AS BIGINT) AS tick, head, token, CAST(place AS INTEGER) AS place FROM (
{poly(track, '0', 'ACTrack', 0)} UNION ALL {lengths(track, '0', 'ACTrack', 100)}
UNION ALL SELECT score_id, track_idx, 0, 'ACTrack', 'ACTrackNoteDensity' || w || '_' || CASE w WHEN 'Min' THEN lo ELSE hi END, 200 + k FROM dens, (VALUES (0, 'Min'), (1, 'Max')) v(k, w)
UNION ALL SELECT score_id, track_idx, 0, 'ACTrack', 'ACTrackRepetition_' || format('{{:.2f}}', repetition), 300 FROM rep
UNION ALL {poly(bar, 'bar_tick', 'ACBar', 100400)}
UNION ALL SELECT score_id, track_idx, bar_tick, 'ACBar', 'ACBarPitchClass_' || pc, 100500 + row_number() OVER (PARTITION BY score_id, track_idx, bar ORDER BY pc) - 1 FROM (SELECT DISTINCT {bar}, pitch % 12 AS pc FROM {source})
UNION ALL SELECT score_id, track_idx, bar_tick, 'ACBar', 'ACBarNoteDensity_' || CASE WHEN count(*) >= 18 THEN '18+' ELSE CAST(count(*) AS VARCHAR) END, 100600 FROM {source} GROUP BY {bar}
UNION ALL {lengths(bar, 'bar_tick', 'ACBar', 100700)})"""


register("control_tokens", f"WITH {N}, b AS (SELECT *, tick // 32 AS bar, tick - tick % 32 AS bar_tick FROM n), {controls('b', 8, repetition('b'))}")(
    lambda s, sf: attributes.control_tokens(notes(s, sf), CONFIG.copy(**ALL_CONTROLS))
)


@register("controls_ts", f"WITH {N_TS}, {controls('n', 16, repetition('n', BAR_TS, START_TS, LENGTH_TS))}")
def controls_ts(spark: SparkSession, sf: str) -> DataFrame:
    score = signed(spark, sf)
    return attributes.control_tokens(score.notes, SIGNED.copy(**ALL_CONTROLS), score.time_sigs)


WIDE_TS = TokenizerConfig(use_programs=True, use_tempos=True, use_time_signatures=True, additional_params={"max_bar_embedding": 400})
OCTUPLE_TS = f"""{N_TS}, {TEMPOS.replace('r.tick // 60', 'r.tick // 30')}, o AS (SELECT n.*, t.qpm, CAST(row_number() OVER (PARTITION BY n.score_id ORDER BY n.tick, track_idx, ord) - 1 AS BIGINT) AS pos
  FROM n ASOF JOIN tempos t ON n.score_id = t.score_id AND n.tick >= t.tick)"""
register("octuple_rows_ts", f"""WITH {OCTUPLE_TS} SELECT score_id, 0 AS stream, pos, tick, [{PITCH}, 'Position_' || ((tick - bar_tick) // step), 'Bar_' || bar, 'Velocity_' || velocity, 'Duration_' || {bin_name('(dur // step)')},
  'Program_' || program, 'Tempo_' || qpm, 'TimeSig_' || sig] AS tokens FROM o""")(lambda s, sf: compound.octuple(score_tables(s, sf, True), WIDE_TS))
# a change counts from the bar of the first note that has it
register("decode_octuple_ts", f"""WITH {OCTUPLE_TS}, f AS (SELECT score_id, min(bar) FILTER (sig = '3/4') AS b3, min(bar) FILTER (sig = '6/8') AS b6 FROM o GROUP BY score_id)
SELECT score_id, 0 AS stream, program, is_drum, dur, pitch, velocity, CAST(tick - bar_tick + CASE sig WHEN '4/4' THEN bar * 64 WHEN '3/4' THEN b3 * 64 + (bar - b3) * 48 ELSE b3 * 64 + (b6 - b3) * 48 + (bar - b6) * 48 END AS BIGINT) AS tick
FROM o JOIN f USING (score_id)""")(lambda s, sf: decode.decode_octuple(compound.octuple(score_tables(s, sf, True), WIDE_TS), WIDE_TS))
register("cpword_rows_ts", f"""WITH {N_TS}, m AS (SELECT *, lag(tick) OVER w AS lt, coalesce(lag(bar) OVER w, -1) AS lb FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord)),
e AS (SELECT *, list_concat(list_concat([['Family_Metric', 'Bar_None', 'Ignore_None', 'Ignore_None', 'Ignore_None', 'TimeSig_' || CASE WHEN x < 80 THEN '4/4' WHEN x < 130 THEN '3/4' ELSE '6/8' END] for x in range(lb + 1, bar + 1)],
   CASE WHEN lt IS NULL OR lt <> tick THEN [['Family_Metric', 'Position_' || ((tick - bar_tick) // step), 'Ignore_None', 'Ignore_None', 'Ignore_None', 'Ignore_None']] ELSE [] END),
   [['Family_Note', 'Ignore_None', {PITCH}, 'Velocity_' || velocity, 'Duration_' || {bin_name('(dur // step)')}, 'Ignore_None']]) AS rows FROM m)
SELECT score_id, track_idx AS stream, CAST(row_number() OVER (PARTITION BY score_id, track_idx ORDER BY ord, k) - 1 AS BIGINT) AS pos, tick, tokens
FROM (SELECT *, unnest(rows) AS tokens, generate_subscripts(rows, 1) AS k FROM e)""")(lambda s, sf: compound.cpword(score_tables(s, sf, True), SIGNED))
register("decode_cpword_ts", f"WITH {N_TS} SELECT score_id, track_idx AS stream, is_drum, tick, dur, pitch, velocity FROM n")(
    lambda s, sf: decode.decode_cpword(compound.cpword(score_tables(s, sf, True), SIGNED), SIGNED).select("score_id", "stream", "is_drum", "tick", "dur", "pitch", "velocity")
)

# --- encoders

register("tsd_tokens", f"WITH {TSD} {exploded('e', 'ord')}")(lambda s, sf: tokens(s, sf, "TSD"))
register("structured_tokens", f"""WITH {N}, e AS (SELECT *, track_idx AS stream, list_concat(['TimeShift_' || CASE WHEN g = 0 THEN '0.0.1' WHEN g > 96 THEN '12.0.4' WHEN g < 32 OR g % 2 = 0 THEN {bin_name('g')}
    ELSE {bin_name('g + 1')} END], {NOTE}) AS tokens FROM (SELECT *, tick - {PREV} AS g FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord))) {exploded('e', 'ord')}""")(
    lambda s, sf: tokens(s, sf, "Structured")
)
register("remi_tokens", f"WITH {REMI} {exploded('e', 'ord')}")(lambda s, sf: tokens(s, sf, "REMI"))
MIDILIKE = f"""{N}, v AS (SELECT *, track_idx AS stream, 0 AS part, tick AS moment, [CASE WHEN is_drum THEN 'DrumOn_' ELSE 'NoteOn_' END || pitch, 'Velocity_' || velocity] AS own FROM n
  UNION ALL SELECT *, track_idx, 1, tick + dur, [CASE WHEN is_drum THEN 'DrumOff_' ELSE 'NoteOff_' END || pitch] FROM n),
e AS (SELECT score_id, stream, moment AS tick, ord, part, list_concat({shifts('moment - prev')}, own) AS tokens FROM (SELECT *, coalesce(lag(moment) OVER (PARTITION BY score_id, stream ORDER BY moment, ord, part), 0) AS prev FROM v))"""
register("midilike_tokens", f"WITH {MIDILIKE} {exploded('e', 'tick, ord, part')}")(lambda s, sf: tokens(s, sf, "MIDILike"))

RESTS = TokenizerConfig(use_rests=True)
# rests: 12 beats as often as they fit, then whole half beats above 2, quarters of a beat between 1 and 2, eighths below
REST_ONE = "CASE WHEN {r} < 8 THEN '0.' || ({r}) || '.8' WHEN {r} < 16 THEN '1.' || ((({r}) % 8) // 2) || '.4' ELSE (({r}) // 8) || '.' || ((({r}) % 8) // 4) || '.2' END"


def rests(g: str) -> str:
    r, low = f"(({g}) % 96)", "(({g}) % 96)".format(g=g)
    size = f"(CASE WHEN {r} < 8 THEN {low} WHEN {r} < 16 THEN {low} - {low} % 2 ELSE {low} - {low} % 4 END)"
    left = f"({r} - {size})"
    return f"list_concat(list_concat(['Rest_12.0.2' for i in range(greatest(({g}) // 96, 0))], CASE WHEN {r} > 0 THEN ['Rest_' || {REST_ONE.format(r=size)}] ELSE [] END), CASE WHEN {left} > 0 THEN ['Rest_' || {REST_ONE.format(r=left)}] ELSE [] END)"


register("rest_tokens", f"""WITH {N}, p AS (SELECT *, {PREV} AS prev, coalesce(max(tick + dur) OVER (PARTITION BY score_id, track_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord)),
e AS (SELECT *, track_idx AS stream, list_concat(CASE WHEN tick <> prev AND tick - ended >= 1 THEN {rests('tick - ended')} ELSE {shifts('tick - prev')} END, {NOTE}) AS tokens FROM p) {exploded('e', 'ord')}""")(
    lambda s, sf: tokens(s, sf, "TSD", RESTS)
)
register("tsd_ids", f"""WITH {TSD}, names AS (SELECT unnest(list_concat(list_concat(list_concat(list_concat(list_concat(['PAD_None', 'BOS_None', 'EOS_None', 'MASK_None'], ['Pitch_' || p for p in range(21, 110)]), ['Velocity_' || (v * 127 // 32) for v in range(1, 33)]),
   list_concat(['Duration_' || (d // 8) || '.' || (d % 8) || '.8' for d in range(1, 32)], list_concat(['Duration_' || (d // 8) || '.' || ((d % 8) // 2) || '.4' for d in range(32, 96, 2)], ['Duration_12.0.4']))),
   list_concat(['TimeShift_' || (d // 8) || '.' || (d % 8) || '.8' for d in range(1, 32)], list_concat(['TimeShift_' || (d // 8) || '.' || ((d % 8) // 2) || '.4' for d in range(32, 96, 2)], ['TimeShift_12.0.4']))), ['PitchDrum_' || p for p in range(27, 89)])) AS token),
voc AS (SELECT token, CAST(row_number() OVER () - 1 AS INTEGER) AS id FROM names), t AS ({exploded('e', 'ord')})
SELECT t.*, voc.id FROM t JOIN voc USING (token)""")(lambda s, sf: encode.with_ids(tokens(s, sf, "TSD"), Vocabulary("TSD", CONFIG)))


@register("token_histogram", f"WITH {TSD} SELECT split_part(token, '_', 1) AS type, token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM e) GROUP BY ALL")
def token_histogram(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encode.encode(score_tables(spark, sf), "TSD", CONFIG).select(F.explode("tokens").alias("token"))
    return encoded.groupBy("token").agg(F.count("*").alias("n")).select(F.split("token", "_", 2)[0].alias("type"), "token", "n")


INTERVALS = TokenizerConfig(use_pitch_intervals=True)


@register("pitch_intervals", f"""WITH {N}, a AS (SELECT *, lag(tick) OVER w AS lt, lag(pitch) OVER w AS lp FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord)),
b AS (SELECT *, last_value(CASE WHEN lt IS NULL OR lt <> tick OR abs(pitch - lp) > 16 THEN pitch END IGNORE NULLS) OVER (PARTITION BY score_id, track_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM a)
SELECT score_id, track_idx, ord, tick, CASE WHEN is_drum THEN 'PitchDrum_' || pitch WHEN lt = tick AND abs(pitch - lp) <= 16 THEN 'PitchIntervalChord_' || (pitch - lp)
  WHEN lt <> tick AND tick - lt <= 8 AND abs(pitch - ref) <= 16 THEN 'PitchIntervalTime_' || (pitch - ref) ELSE 'Pitch_' || pitch END AS token FROM b""")
def pitch_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf, INTERVALS).select("score_id", "track_idx", "ord", "tick", encode.note_pitch(INTERVALS).alias("token"))


CHANGES = TokenizerConfig(use_programs=True, program_changes=True)


@register("program_changes", f"""WITH {N}, m AS (SELECT *, lag(program) OVER (PARTITION BY score_id ORDER BY tick, track_idx, ord) AS before FROM n)
SELECT score_id, tick, program, count(*) AS n FROM m WHERE before IS NULL OR before <> program GROUP BY ALL""")
def program_changes(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encode.encode(score_tables(spark, sf), "TSD", CHANGES)
    return encoded.where(F.exists("tokens", lambda t: t.startswith("Program_"))).groupBy("score_id", "tick", "program").agg(F.count("*").alias("n"))


WIDE = TokenizerConfig(use_programs=True, use_tempos=True, additional_params={"max_bar_embedding": 300})
register("octuple_rows", f"""WITH {N}, {TEMPOS} SELECT n.score_id, 0 AS stream, CAST(row_number() OVER (PARTITION BY n.score_id ORDER BY n.tick, track_idx, ord) - 1 AS BIGINT) AS pos, n.tick,
 [{PITCH}, 'Position_' || (n.tick % 32), 'Bar_' || (n.tick // 32), 'Velocity_' || velocity, 'Duration_' || {bin_name('dur')}, 'Program_' || program, 'Tempo_' || t.qpm] AS tokens
 FROM n ASOF JOIN tempos t ON n.score_id = t.score_id AND n.tick >= t.tick""".replace("tokens\n", "tokens\n"))(lambda s, sf: compound.octuple(score_tables(s, sf, True), WIDE))
NARROWER = TokenizerConfig(additional_params={"max_bar_embedding": 300})
register("mumidi_rows", f"""WITH {N}, m AS (SELECT *, tick // 32 AS bar, lag(tick) OVER w AS lt, coalesce(lag(tick // 32) OVER w, -1) AS lb, lag(program) OVER w AS lprog FROM n WINDOW w AS (PARTITION BY score_id ORDER BY tick, program, track_idx, ord)),
f AS (SELECT *, lt IS NULL OR lt <> tick AS new_tick, 'BarPosEnc_' || bar AS b, 'PositionPosEnc_' || (tick % 32) AS p FROM m),
e AS (SELECT *, list_concat(list_concat([['Bar_None', 'BarPosEnc_' || x, 'PositionPosEnc_None', 'Ignore_None', 'Ignore_None'] for x in range(lb + 1, bar + 1)],
   CASE WHEN new_tick THEN [['Position_' || (tick % 32), b, p, 'Ignore_None', 'Ignore_None']] ELSE [] END),
   list_concat(CASE WHEN new_tick OR lprog <> program THEN [['Program_' || program, b, p, 'Ignore_None', 'Ignore_None']] ELSE [] END,
   [[{PITCH}, b, p, 'Velocity_' || velocity, 'Duration_' || {bin_name('dur')}]])) AS rows FROM f)
SELECT score_id, 0 AS stream, CAST(row_number() OVER (PARTITION BY score_id ORDER BY tick, program, track_idx, ord, k) - 1 AS BIGINT) AS pos, tick, tokens
FROM (SELECT *, unnest(rows) AS tokens, generate_subscripts(rows, 1) AS k FROM e)""")(lambda s, sf: compound.mumidi(score_tables(s, sf), NARROWER))
register("cpword_rows", f"""WITH {N}, m AS (SELECT *, tick // 32 AS bar, lag(tick) OVER w AS lt, coalesce(lag(tick // 32) OVER w, -1) AS lb FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord)),
e AS (SELECT *, list_concat(list_concat([['Family_Metric', 'Bar_None', 'Ignore_None', 'Ignore_None', 'Ignore_None'] for x in range(lb + 1, bar + 1)],
   CASE WHEN lt IS NULL OR lt <> tick THEN [['Family_Metric', 'Position_' || (tick % 32), 'Ignore_None', 'Ignore_None', 'Ignore_None']] ELSE [] END),
   [['Family_Note', 'Ignore_None', {PITCH}, 'Velocity_' || velocity, 'Duration_' || {bin_name('dur')}]]) AS rows FROM m)
SELECT score_id, track_idx AS stream, CAST(row_number() OVER (PARTITION BY score_id, track_idx ORDER BY ord, k) - 1 AS BIGINT) AS pos, tick, tokens
FROM (SELECT *, unnest(rows) AS tokens, generate_subscripts(rows, 1) AS k FROM e)""")(lambda s, sf: compound.cpword(score_tables(s, sf), CONFIG))
register("mmm_concat", f"""WITH {TSD}, t AS (SELECT score_id, stream, list_concat(list_concat(['Track_Start', 'Program_' || min(program)], flatten(list(tokens ORDER BY ord))), ['Track_End']) AS tokens FROM e GROUP BY score_id, stream)
SELECT score_id, md5(array_to_string(flatten(list(tokens ORDER BY stream)), ' ')) AS digest, len(flatten(list(tokens))) AS n_tokens FROM t GROUP BY score_id""")(
    lambda s, sf: encode.mmm_sequences(score_tables(s, sf), CONFIG).select("score_id", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"), F.size("tokens").cast("long").alias("n_tokens"))
)


def _unit_rests(gap: str, unit: str) -> str:
    """Rest tokens of a gap in ticks, where an eighth of a beat is `unit` ticks."""
    return rests(f"(({gap}) // {unit})")


FULL = f"""{N_TS}, {TEMPOS.replace('r.tick // 60', 'r.tick // 30')}, a AS (SELECT *, lag(tick) OVER w AS lt, lag(pitch) OVER w AS lp FROM n WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY ord)),
i AS (SELECT *, last_value(CASE WHEN lt IS NULL OR lt <> tick OR abs(pitch - lp) > 16 THEN pitch END IGNORE NULLS) OVER (PARTITION BY score_id, track_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM a),
ev AS (SELECT score_id, tick, track_idx AS rank, ord AS place, 'Note' AS head, tick + dur AS until, CAST(NULL AS INTEGER) AS sig_den, ['Program_' || program, CASE WHEN is_drum THEN 'PitchDrum_' || pitch WHEN lt = tick AND abs(pitch - lp) <= 16 THEN 'PitchIntervalChord_' || (pitch - lp)
    WHEN lt <> tick AND tick - lt <= 16 AND abs(pitch - ref) <= 16 THEN 'PitchIntervalTime_' || (pitch - ref) ELSE 'Pitch_' || pitch END, 'Velocity_' || velocity, 'Duration_' || {bin_name('(dur // step)')}] AS own FROM i
  UNION ALL SELECT score_id, k.tick, -2, k.tick, 'TimeSig', k.tick, k.den, ['TimeSig_' || k.num || '/' || k.den] FROM (SELECT DISTINCT score_id FROM n), (VALUES (0, 4, 4), (5120, 3, 4), (7520, 6, 8)) k(tick, num, den)
  UNION ALL SELECT score_id, tick, -1, tick, 'Tempo', tick, NULL, ['Tempo_' || qpm] FROM tempos WHERE score_id IN (SELECT score_id FROM n)),
t1 AS (SELECT *, {BAR_TS.format(t='tick')} AS bar, CASE WHEN tick >= 7520 THEN 1 ELSE 2 END AS step, coalesce(lag(tick) OVER w, 0) AS prev, lag(tick) OVER w AS before, lag(head) OVER w AS last_head, coalesce(lag({BAR_TS.format(t='tick')}) OVER w, -1) AS lb,
  coalesce(max(until) OVER (PARTITION BY score_id ORDER BY tick, rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
  CASE coalesce(last_value(sig_den IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY tick, rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) WHEN 8 THEN 1 ELSE 2 END AS unit FROM ev WINDOW w AS (PARTITION BY score_id ORDER BY tick, rank, place)),
t2 AS (SELECT *, CASE WHEN tick <> prev AND tick - ended >= unit THEN {_unit_rests('(tick - ended)', 'unit')} ELSE [] END AS rest, ended + (tick - ended) // unit * unit AS reached, before IS NULL OR before <> tick AS new_tick FROM t1),
t3 AS (SELECT *, CASE WHEN len(rest) > 0 THEN greatest(lb, {BAR_TS.format(t='reached')}) ELSE lb END AS last_bar FROM t2),
e AS (SELECT *, 0 AS stream, list_concat(list_concat(list_concat(rest, CASE WHEN new_tick AND bar > last_bar THEN flatten([CASE WHEN head = 'TimeSig' AND x = bar THEN ['Bar_None'] ELSE ['Bar_None', 'TimeSig_' || CASE WHEN x < 80 THEN '4/4' WHEN x < 130 THEN '3/4' ELSE '6/8' END] END for x in range(last_bar + 1, bar + 1)]) ELSE [] END),
  CASE WHEN (new_tick OR last_head = 'TimeSig') AND head <> 'TimeSig' THEN ['Position_' || ((tick - {START_TS.format(b='bar')}) // step)] ELSE [] END), own) AS tokens FROM t3)"""


@register("full_options_remi", f"WITH {FULL} {exploded('e', 'tick, rank, place')}")
def full_options_remi(spark: SparkSession, sf: str) -> DataFrame:
    """Rests, tempos, time signatures, programs and intervals together."""
    c = TokenizerConfig(use_rests=True, use_tempos=True, use_time_signatures=True, use_programs=True, use_pitch_intervals=True)
    return encode.token_rows(encode.encode(score_tables(spark, sf, True), "REMI", c))


# --- validation, decoding

HOLES = "WHERE pos % 7 <> 3"  # every seventh token left out, so that there are errors
register("type_succession_errors", f"""WITH {TSD}, t AS (SELECT score_id, stream, pos, split_part(token, '_', 1) AS type FROM ({exploded('e', 'ord')}) {HOLES}),
x AS (SELECT *, lag(type) OVER (PARTITION BY score_id, stream ORDER BY pos) AS before FROM t)
SELECT score_id, stream, count(*) AS n_tokens, CAST(sum(CASE WHEN before IS NULL OR (before, type) IN (('Pitch','Velocity'),('PitchDrum','Velocity'),('Velocity','Duration'),('Duration','Pitch'),('Duration','PitchDrum'),
 ('Duration','TimeShift'),('TimeShift','Pitch'),('TimeShift','PitchDrum'),('TimeShift','TimeShift')) THEN 0 ELSE 1 END) AS BIGINT) AS n_errors FROM x GROUP BY ALL""")(
    lambda s, sf: validate.type_errors(tokens(s, sf, "TSD").where("pos % 7 <> 3"), Vocabulary("TSD", CONFIG)).groupBy("score_id", "stream").agg(F.count("*").alias("n_tokens"), F.sum("error").cast("long").alias("n_errors"))
)
register("position_errors", f"""WITH {REMI}, t AS (SELECT * FROM ({exploded('e', 'ord')}) WHERE token NOT LIKE 'Bar%' OR pos % 3 <> 0),
p AS (SELECT *, CASE WHEN token LIKE 'Position%' THEN CAST(split_part(token, '_', 2) AS INTEGER) ELSE -1 END AS place FROM t WHERE token LIKE 'Bar%' OR token LIKE 'Position%'),
x AS (SELECT *, lag(place) OVER (PARTITION BY score_id, stream ORDER BY pos) AS last FROM p)
SELECT score_id, stream, CAST(sum(CASE WHEN token LIKE 'Position%' AND place <= last THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM x GROUP BY ALL""")(
    lambda s, sf: validate.time_errors(tokens(s, sf, "REMI").where(~F.col("token").startswith("Bar") | (F.col("pos") % 3 != 0))).groupBy("score_id", "stream").agg(F.sum("error").cast("long").alias("n_errors"))
)
register("token_errors", f"""WITH {TSD}, t AS (SELECT score_id, stream, pos, split_part(token, '_', 1) AS type FROM ({exploded('e', 'ord')}) {HOLES}),
x AS (SELECT *, lag(type) OVER (PARTITION BY score_id, stream ORDER BY pos) AS before FROM t),
y AS (SELECT score_id, stream, count(*) AS n_tokens, CAST(sum(CASE WHEN before IS NULL OR (before, type) IN (('Pitch','Velocity'),('PitchDrum','Velocity'),('Velocity','Duration'),('Duration','Pitch'),('Duration','PitchDrum'),
 ('Duration','TimeShift'),('TimeShift','Pitch'),('TimeShift','PitchDrum'),('TimeShift','TimeShift')) THEN 0 ELSE 1 END) AS BIGINT) AS n_errors FROM x GROUP BY ALL)
SELECT *, n_errors / n_tokens AS ratio FROM y""")(
    lambda s, sf: validate.error_ratio(tokens(s, sf, "TSD").where("pos % 7 <> 3"), Vocabulary("TSD", CONFIG)).withColumn("n_errors", F.col("n_errors").cast("long"))
)
register("token_errors_zero", f"WITH {REMI} SELECT score_id, stream, count(*) AS n_tokens, CAST(0 AS BIGINT) AS n_errors, CAST(0 AS DOUBLE) AS ratio FROM ({exploded('e', 'ord')}) GROUP BY ALL")(
    lambda s, sf: validate.error_ratio(tokens(s, sf, "REMI"), Vocabulary("REMI", CONFIG)).withColumn("n_errors", F.col("n_errors").cast("long"))
)
register("on_off_errors", f"""WITH {MIDILIKE}, t AS (SELECT *, split_part(token, '_', 1) AS type, split_part(token, '_', 2) AS value FROM ({exploded('e', 'tick, ord, part')}) {HOLES}),
o AS (SELECT *, type LIKE 'Drum%' AS drum, CASE WHEN type LIKE '%On' THEN 1 ELSE -1 END AS d FROM t WHERE type IN ('NoteOn','NoteOff','DrumOn','DrumOff')),
b AS (SELECT *, sum(d) OVER (PARTITION BY score_id, stream, drum, value ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bal FROM o),
k AS (SELECT score_id, stream, greatest(-min(bal), 0) AS orphans, sum(d) AS total FROM b GROUP BY score_id, stream, drum, value)
SELECT score_id, stream, CAST(sum(orphans) AS BIGINT) AS orphan_offs, CAST(sum(total + orphans) AS BIGINT) AS open_notes FROM k GROUP BY ALL""")(
    lambda s, sf: validate.on_off_errors(tokens(s, sf, "MIDILike").where("pos % 7 <> 3")).select("score_id", "stream", F.col("orphan_offs").cast("long").alias("orphan_offs"), F.col("open_notes").cast("long").alias("open_notes"))
)
DECODED = f"WITH {N} SELECT score_id, track_idx AS stream, is_drum, tick, dur, pitch, velocity FROM n"
_plain = lambda df: df.select("score_id", "stream", "is_drum", "tick", "dur", "pitch", "velocity")
register("decode_tsd", DECODED)(lambda s, sf: _plain(decode.decode_shifts(tokens(s, sf, "TSD"), CONFIG)))
register("decode_remi", DECODED)(lambda s, sf: _plain(decode.decode_bars(tokens(s, sf, "REMI"), CONFIG)))
register("decode_rests_fold", DECODED)(lambda s, sf: _plain(decode.decode_fold(encode.sequences(encode.encode(score_tables(s, sf), "TSD", RESTS)), "TSD", RESTS)))
register("decode_octuple", DECODED.replace("track_idx AS stream", "0 AS stream, program").replace("is_drum", "is_drum"))(lambda s, sf: decode.decode_octuple(compound.octuple(score_tables(s, sf, True), WIDE), WIDE))
register("decode_mumidi", DECODED.replace("track_idx AS stream", "0 AS stream, program"))(lambda s, sf: decode.decode_mumidi(compound.mumidi(score_tables(s, sf), NARROWER), NARROWER))
register("decode_cpword", DECODED)(lambda s, sf: _plain(decode.decode_cpword(compound.cpword(score_tables(s, sf), CONFIG), CONFIG)))
register("decode_mmm", DECODED)(lambda s, sf: _plain(decode.decode_shifts(decode.split_mmm(encode.mmm_sequences(score_tables(s, sf), CONFIG)), CONFIG)))
# notes of one pitch that overlap trade their ends, first in first out
register("noteon_off_pairing", f"""WITH {N}, a AS (SELECT score_id, track_idx AS stream, is_drum, pitch, tick, velocity, row_number() OVER (PARTITION BY score_id, track_idx, is_drum, pitch ORDER BY tick, ord) AS k FROM n),
z AS (SELECT score_id, track_idx AS stream, is_drum, pitch, tick + dur AS until, row_number() OVER (PARTITION BY score_id, track_idx, is_drum, pitch ORDER BY tick + dur, ord) AS k FROM n)
SELECT score_id, stream, is_drum, tick, until - tick AS dur, pitch, velocity FROM a JOIN z USING (score_id, stream, is_drum, pitch, k)""")(
    lambda s, sf: _plain(decode.decode_on_off(tokens(s, sf, "MIDILike"), CONFIG))
)

# --- augmentation

AUG = f"""WITH {N}, o AS (SELECT * FROM (VALUES (0, 0, 0), (-2, 0, 0), (3, 0, 0), (0, -40, 0), (0, 50, 0), (0, 0, 4), (0, 0, -8)) v(p, v, d)),
room AS (SELECT score_id, min(greatest(127 - hi, 0)) AS up, min(greatest(lo - 0, 0)) AS down FROM (SELECT score_id, track_idx, min(pitch) AS lo, max(pitch) AS hi FROM n WHERE NOT is_drum GROUP BY ALL) GROUP BY ALL),
a AS (SELECT n.*, p, v, d FROM n JOIN room USING (score_id), o WHERE p BETWEEN -down AND up)"""
register("augment_offsets", f"""{AUG} SELECT score_id, track_idx, tick, is_drum, p AS pitch_offset, v AS velocity_offset, CAST(d AS BIGINT) AS duration_offset, CASE WHEN is_drum THEN pitch ELSE pitch + p END AS pitch,
 greatest(1, least(127, velocity + v)) AS velocity, CASE WHEN is_drum THEN dur ELSE greatest(dur + d, 1) END AS dur FROM a""")(
    lambda s, sf: augment.augment(notes(s, sf), 8, [-2, 3], [-40, 50], [0.5, -1.0], by_tessitura=False).select("score_id", "track_idx", "tick", "is_drum", "pitch_offset", "velocity_offset", "duration_offset", "pitch", "velocity", "dur")
)
register("augment_report", f"{AUG} SELECT p AS pitch_offset, v AS velocity_offset, CAST(d AS BIGINT) AS duration_offset, count(DISTINCT score_id) AS n_scores, count(*) AS n_notes FROM a GROUP BY ALL")(
    lambda s, sf: augment.report(augment.augment(notes(s, sf), 8, [-2, 3], [-40, 50], [0.5, -1.0], by_tessitura=False))
)
register("augment_tessitura", f"""WITH {N}, t AS (SELECT score_id, min(pitch % 12 + 60) AS lo, max(pitch % 12 + 60) AS hi FROM n WHERE NOT is_drum GROUP BY ALL), o AS (SELECT unnest([-40, -12, 7, 36, 48]) AS p)
SELECT score_id, p AS pitch_offset FROM t, o WHERE (p < 0 AND lo + p >= 21) OR (p >= 0 AND hi + p <= 108)""")(
    lambda s, sf: augment.allowed_pitch_offsets(notes(s, sf).withColumns({"pitch": F.col("pitch") % 12 + 60, "program": F.when(F.col("is_drum"), -1).otherwise(0)}), [-40, -12, 7, 36, 48])
)

register("augment_notes_tessitura", f"""WITH {N}, {TESS_ALL}, o AS (SELECT unnest([-12, -5, 5, 12]) AS p), q AS (SELECT * REPLACE (CASE WHEN is_drum THEN -1 ELSE program % 40 END AS program, CASE WHEN is_drum THEN pitch ELSE 50 + pitch % 24 END AS pitch) FROM n),
room AS (SELECT score_id, min(greatest(hi - top, 0)) AS up, min(greatest(low - lo, 0)) AS down FROM (SELECT score_id, track_idx, program, min(pitch) AS low, max(pitch) AS top FROM q WHERE NOT is_drum GROUP BY ALL) JOIN tess USING (program) GROUP BY score_id)
SELECT score_id, p AS pitch_offset, count(*) AS n, CAST(sum(CASE WHEN is_drum THEN pitch ELSE pitch + p END) AS BIGINT) AS total FROM q JOIN room USING (score_id), o WHERE p BETWEEN -down AND up GROUP BY ALL""")(
    lambda s, sf: augment.augment(notes(s, sf).withColumns({"program": F.when(F.col("is_drum"), -1).otherwise(F.col("program") % 40), "pitch": F.when(F.col("is_drum"), F.col("pitch")).otherwise(50 + F.col("pitch") % 24)}), 8, [-12, -5, 5, 12], keep_original=False)
    .groupBy("score_id", "pitch_offset").agg(F.count("*").alias("n"), F.sum("pitch").cast("long").alias("total"))
)

# --- splitting and batching

SEQ = f"{TSD}, s AS (SELECT score_id, stream, CAST(count(*) AS INTEGER) AS n FROM (SELECT score_id, stream, unnest(tokens) FROM e) GROUP BY ALL)"


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    """Positions stand for ids, so that a plain query can tell what is where."""
    seqs = encode.sequences(encode.encode(score_tables(spark, sf), "TSD", CONFIG))
    return seqs.select("score_id", "stream", F.sequence(F.lit(1), F.size("tokens")).alias("ids"))


register("split_subsequences", f"WITH {SEQ} SELECT score_id, stream, CAST(c AS INTEGER) AS chunk, CAST(c * 100 + 1 AS INTEGER) AS first_id, CAST(least(100, n - c * 100) AS INTEGER) AS n_ids FROM s, LATERAL (SELECT unnest(range(0, greatest((n - 10 + 99) // 100, 0))) AS c) x WHERE n - c * 100 > 10")(
    lambda s, sf: split.subsequences(_ids(s, sf), "ids", 100, 10).select("score_id", "stream", "chunk", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").alias("n_ids"))
)
register("truncate_bos_eos", f"WITH {SEQ} SELECT score_id, stream, list_concat(list_concat([-1], range(1, least(n, 298) + 1)), CASE WHEN n <= 298 THEN [-2] ELSE [] END)::VARCHAR AS ids FROM s")(
    lambda s, sf: _ids(s, sf).select("score_id", "stream", F.concat(F.lit("["), F.array_join(split.with_special(F.col("ids"), 300, -1, -2).cast("array<string>"), ", "), F.lit("]")).alias("ids"))
)
for side in ("right", "left"):
    inner = "list_concat(range(1, n + 1), [0 for i in range(m - n)])" if side == "right" else "list_concat([0 for i in range(m - n)], range(1, n + 1))"
    register(f"pad_{side}", f"WITH {SEQ}, p AS (SELECT *, max(n) OVER (PARTITION BY score_id) AS m FROM s) SELECT score_id, stream, md5(array_to_string({inner}, ',')) AS ids, CAST(n AS BIGINT) AS n_mask, CAST(m AS BIGINT) AS length FROM p")(
        lambda s, sf, left=side == "left": batch.collate(_ids(s, sf), "ids", ["score_id"], 0, left).select("score_id", "stream", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_mask"), F.size("ids").cast("long").alias("length"))
    )
register("shifted_labels", f"WITH {SEQ}, p AS (SELECT *, max(n - 1) OVER (PARTITION BY score_id) AS m FROM s) SELECT score_id, stream, md5(array_to_string(list_concat(range(2, n + 1), [-100 for i in range(m - n + 1)]), ',')) AS labels, CAST(m AS BIGINT) AS length FROM p")(
    lambda s, sf: batch.collate(_ids(s, sf), "ids", ["score_id"], 0, copy_labels=True, shift_labels=True).select("score_id", "stream", F.md5(F.array_join(F.col("labels").cast("array<string>"), ",").cast("binary")).alias("labels"), F.size("labels").cast("long").alias("length"))
)
register("avg_tokens_per_note", f"WITH {SEQ}, t AS (SELECT score_id, sum(n) AS k FROM s GROUP BY score_id), c AS (SELECT score_id, count(*) AS m FROM n GROUP BY score_id) SELECT round(avg(k / m), 9) AS tokens_per_note FROM t JOIN c USING (score_id)")(
    lambda s, sf: split.tokens_per_note(_ids(s, sf).groupBy("score_id").agg(F.sum(F.size("ids")).alias("n_tokens")), notes(s, sf)).select(F.round("tokens_per_note", 9).alias("tokens_per_note"))
)
register("split_by_beats", f"WITH {N} SELECT score_id, track_idx, tick // 128 AS part, tick % 128 AS tick, pitch FROM n")(lambda s, sf: split.per_beats(notes(s, sf), 8, 16).select("score_id", "track_idx", "part", "tick", "pitch"))
register("concat_shift", f"""WITH {N}, en AS (SELECT score_id, max(tick + dur) AS stop FROM n GROUP BY score_id), sh AS (SELECT score_id, coalesce(sum(stop) OVER (PARTITION BY score_id % 10 ORDER BY score_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM en)
SELECT score_id % 10 AS grp, score_id, track_idx, CAST(tick + s AS BIGINT) AS tick, pitch FROM n JOIN sh USING (score_id)""")(
    lambda s, sf: (lambda n: split.concat_scores(n, "score_id", ["grp"], n.groupBy("grp", "score_id").agg(F.max(F.col("tick") + F.col("dur")).alias("end"))))(notes(s, sf).withColumn("grp", F.col("score_id") % 10)).select("grp", "score_id", "track_idx", "tick", "pitch")
)
register("split_per_tracks", f"WITH {N} SELECT score_id, track_idx, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY track_idx) - 1 AS INTEGER) AS part, tick, pitch FROM n")(lambda s, sf: split.per_tracks(notes(s, sf)).select("score_id", "track_idx", "part", "tick", "pitch"))
register("merge_per_class", f"""WITH {RAW}, {TESS_ALL}, c AS (SELECT *, CASE WHEN is_drum THEN 16 ELSE program // 8 END AS cl FROM (SELECT * REPLACE (CASE WHEN is_drum THEN -1 ELSE (program * 5) % 24 END AS program) FROM raw)),
k AS (SELECT score_id, cl, track_idx FROM (SELECT *, row_number() OVER (PARTITION BY score_id, cl ORDER BY c DESC, track_idx) AS r FROM (SELECT score_id, cl, track_idx, count(*) AS c FROM c GROUP BY score_id, cl, track_idx)) WHERE cl <> 1 OR r <= 1),
m AS (SELECT score_id, CASE WHEN cl = 2 THEN track_idx ELSE min(track_idx) OVER (PARTITION BY score_id, cl) END AS track_idx, CASE WHEN cl = 16 THEN -1 WHEN cl = 2 THEN program WHEN cl = 0 THEN 3 ELSE cl * 8 END AS program, is_drum, pitch FROM c JOIN k USING (score_id, cl, track_idx))
SELECT score_id, track_idx, CAST(m.program AS INTEGER) AS program, count(*) AS n FROM m LEFT JOIN tess ON tess.program = m.program
WHERE CASE WHEN is_drum THEN pitch BETWEEN 27 AND 88 ELSE pitch BETWEEN lo AND hi END GROUP BY ALL""")(
    lambda s, sf: split.merge_per_class(notes_view(s, sf).withColumn("program", F.when(F.col("is_drum"), -1).otherwise(F.col("program") * 5 % 24)), most={1: 1}, classes=[0, 1, 16], programs={0: 3}).groupBy("score_id", "track_idx", "program").agg(F.count("*").alias("n"))
)


@register("merge_effects", f"""WITH {RAW}, p AS (SELECT DISTINCT score_id, track_idx, CASE WHEN is_drum THEN -1 ELSE program % 3 END AS program FROM raw), m AS (SELECT *, min(track_idx) OVER (PARTITION BY score_id, program) AS first FROM p),
e AS (SELECT l_suppkey AS score_id, CAST(l_linenumber - 1 AS INTEGER) AS track_idx, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 120 AS BIGINT) AS tick, l_quantity, l_discount, (l_partkey * 37) % 16384 - 8192 AS value FROM lineitem),
r AS (SELECT score_id, track_idx, 'pedal' AS kind, tick, CAST(l_quantity * 60 AS BIGINT) AS value FROM e WHERE l_quantity > 40 UNION ALL SELECT score_id, track_idx, 'bend', tick, max(value) FROM e WHERE l_discount > 0.085 GROUP BY ALL)
SELECT score_id, first AS track_idx, kind, count(*) AS n, CAST(sum(tick) AS BIGINT) AS ticks, CAST(sum(value) AS BIGINT) AS total FROM r JOIN m USING (score_id, track_idx) GROUP BY ALL""")
def merge_effects(spark: SparkSession, sf: str) -> DataFrame:
    score = score_tables(spark, sf, with_effects=True)
    score.notes = score.notes.withColumn("program", F.when(F.col("is_drum"), -1).otherwise(F.col("program") % 3))
    merged = preprocess.merge_same_program_tracks(score)
    pedals = merged.pedals.select("score_id", "track_idx", F.lit("pedal").alias("kind"), "tick", F.col("dur").alias("value"))
    rows = pedals.unionByName(merged.bends.select("score_id", "track_idx", F.lit("bend").alias("kind"), "tick", F.col("value").cast("long").alias("value")))
    return rows.groupBy("score_id", "track_idx", "kind").agg(F.count("*").alias("n"), F.sum("tick").alias("ticks"), F.sum("value").alias("total"))


@register("split_score_parts", f"""WITH {RAW}, k AS (SELECT * FROM (VALUES (0, 0, 200000), (1, 200000, 300000), (2, 250000, 1000000000)) v(part, start, stop)),
s AS (SELECT score_id, unnest([{{'tick': 0, 'num': 4, 'den': 4}}, {{'tick': 153600, 'num': 3, 'den': 4}}, {{'tick': 225600, 'num': 6, 'den': 8}}]) AS s FROM (SELECT DISTINCT score_id FROM raw)),
g AS (SELECT score_id, s.tick AS tick, s.num AS num, s.den AS den, lead(s.tick, 1, 1000000000) OVER (PARTITION BY score_id ORDER BY s.tick) AS until FROM s)
SELECT score_id, part, 'note' AS kind, CAST(sum(tick - start) AS BIGINT) AS ticks, count(*) AS n, CAST(sum(pitch) AS BIGINT) AS total FROM raw, k WHERE tick >= start AND tick < stop GROUP BY score_id, part
UNION ALL SELECT score_id, part, 'time_sig', CAST(sum(greatest(tick - start, 0)) AS BIGINT), count(*), CAST(sum(num * 100 + den) AS BIGINT) FROM g, k WHERE tick < stop AND start < until GROUP BY score_id, part""")
def split_score_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that overlap, with the time signature in force at the beginning of each."""
    score = score_tables(spark, sf, True)
    three = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop")) for i, a, b in ((0, 0, 200_000), (1, 200_000, 300_000), (2, 250_000, 10**9))])
    parts = score.notes.select("score_id").distinct().select("score_id", F.explode(three).alias("p")).select("score_id", "p.*")
    made = split.split_score(score, parts)
    total = lambda df, kind, value: df.groupBy("score_id", "part").agg(F.lit(kind).alias("kind"), F.sum("tick").cast("long").alias("ticks"), F.count("*").alias("n"), F.sum(value).cast("long").alias("total"))
    return total(made.notes, "note", F.col("pitch")).unionByName(total(made.time_sigs, "time_sig", F.col("num") * 100 + F.col("den")))


register("score_programs", f"""WITH {RAW}, t AS (SELECT DISTINCT score_id, track_idx, program, is_drum FROM raw)
SELECT score_id, string_agg(program || CASE WHEN is_drum THEN 'd' ELSE '' END, ' ' ORDER BY track_idx) AS programs FROM t GROUP BY score_id""")(
    lambda s, sf: tracks.programs(notes_view(s, sf)).select("score_id", F.array_join(F.transform("programs", lambda p: F.concat(p["program"], F.when(p["is_drum"], "d").otherwise(""))), " ").alias("programs"))
)
register("empty_tracks", f"""WITH {RAW}, late AS (SELECT * FROM raw WHERE tick > 424000 AND pitch > 60)
SELECT DISTINCT score_id, track_idx FROM raw WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.score_id = raw.score_id AND late.track_idx = raw.track_idx)""")(
    lambda s, sf: tracks.empty_tracks(notes_view(s, sf).select("score_id", "track_idx").distinct(), Score(notes_view(s, sf).where("tick > 424000 and pitch > 60")))
)
# every fifth row says a bar three bars early
register("octuple_errors", f"""WITH {N}, o AS (SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY tick, track_idx, ord) - 1 AS pos, tick // 32 AS bar, tick % 32 AS place FROM n),
m AS (SELECT *, (bar - CASE WHEN pos % 5 = 4 THEN 3 ELSE 0 END) * 32 + place AS spot FROM o), x AS (SELECT *, max(spot) OVER (PARTITION BY score_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM m)
SELECT score_id, CAST(0 AS INTEGER) AS stream, count(*) AS n_rows, count(*) FILTER (spot < most) AS n_errors FROM x GROUP BY score_id""")(
    lambda s, sf: validate.octuple_errors(
        compound.octuple(score_tables(s, sf, True), WIDE).withColumn(
            "tokens", F.transform("tokens", lambda t, i: F.when((i == 2) & (F.col("pos") % 5 == 4), F.concat(F.lit("Bar_"), F.split(t, "_")[1].cast("int") - 3)).otherwise(t))
        )
    ).withColumn("n_errors", F.col("n_errors").cast("long"))
)
register("split_by_ticks", f"WITH {RAW} SELECT score_id, track_idx, CAST(CASE WHEN tick >= 300000 THEN 2 WHEN tick >= 200000 THEN 1 ELSE 0 END AS INTEGER) AS part, CASE WHEN tick >= 300000 THEN tick - 300000 WHEN tick >= 200000 THEN tick - 200000 ELSE tick END AS tick, pitch FROM raw")(
    lambda s, sf: split.per_ticks(notes_view(s, sf), [300_000, 200_000]).select("score_id", "track_idx", "part", F.col("tick").cast("long").alias("tick"), "pitch")
)
register("repeated_notes", f"""WITH {REMI}, t AS (SELECT * FROM ({exploded('e', 'ord')})), m AS (SELECT *, sum(CASE WHEN token LIKE 'Bar%' OR token LIKE 'Position%' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, stream ORDER BY pos ROWS UNBOUNDED PRECEDING) AS moment FROM t),
r AS (SELECT score_id, stream, token, count(*) - 1 AS again FROM m WHERE token LIKE 'Pitch%' GROUP BY score_id, stream, moment, token)
SELECT score_id, stream, CAST(sum(again) AS BIGINT) AS errors FROM r GROUP BY ALL""")(
    lambda s, sf: validate.repeated_notes(tokens(s, sf, "REMI"))
)
register("sampled_bars", f"""WITH {BARRED}, d AS (SELECT DISTINCT score_id, track_idx, bar FROM b),
r AS (SELECT *, count(*) OVER (PARTITION BY score_id, track_idx) AS n, row_number() OVER (PARTITION BY score_id, track_idx ORDER BY md5('7:' || bar), bar) AS r FROM d)
SELECT score_id, track_idx, bar FROM r WHERE r <= round_even(n * 0.3, 0)""")(lambda s, sf: attributes.sample_rows(attributes.with_bar(notes(s, sf), 8).select(*attributes.BAR).distinct(), ["score_id", "track_idx"], 0.3, 7, ["bar"]))


# --- folds, models and files: rows only

# signatures off the bar lines: k-th change of a score at (k + 1) * 5000 + score ticks, of every second score 4/4 at first
OFF_LINES = "off AS (SELECT s AS score_id, k, CAST((k + 1) * 5000 + s % 997 AS BIGINT) AS tick, CASE (s + k) % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 7 ELSE 4 END AS num, CASE (s + k) % 4 WHEN 1 THEN 8 ELSE 4 END AS den FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem), range(6) r(k))"


@register("ts_alignment", f"""WITH RECURSIVE {OFF_LINES}, c AS (SELECT score_id, CAST(tick * 16 // 480 AS BIGINT) AS tick, num, den, row_number() OVER (PARTITION BY score_id ORDER BY tick) AS i FROM off WHERE num <> 7),
w AS (SELECT score_id, 0 AS i, CAST(0 AS BIGINT) AS tick, 4 AS num, 4 AS den FROM (SELECT DISTINCT score_id FROM c)
  UNION ALL SELECT w.score_id, w.i + 1, CASE WHEN c.num = w.num AND c.den = w.den AND w.tick + ceil((c.tick - w.tick) / (w.num * 64 / w.den)) * (w.num * 64 / w.den) = w.tick THEN w.tick
    ELSE CAST(w.tick + ceil((c.tick - w.tick) / (w.num * 64 / w.den)) * (w.num * 64 / w.den) AS BIGINT) END, c.num, c.den FROM w JOIN c ON c.score_id = w.score_id AND c.i = w.i + 1)
SELECT score_id, tick, num, den FROM (SELECT *, lead(tick) OVER (PARTITION BY score_id ORDER BY i) AS after FROM w) WHERE after IS NULL OR after <> tick""")
def ts_alignment(spark: SparkSession, sf: str) -> DataFrame:
    score, k = F.col("l_suppkey"), F.col("k")
    rows = table(spark, sf, "lineitem").select("l_suppkey").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    kind = (score + k) % 4
    num = F.when(kind == 0, 3).when(kind == 1, 6).when(kind == 2, 7).otherwise(4)
    off = rows.select(score.alias("score_id"), ((k + 1) * 5000 + score % 997).alias("tick"), num.alias("num"), F.when(kind == 1, 8).otherwise(4).alias("den"))
    return preprocess.align_time_signatures(off, SIGNED, 480)


CHORDS = TokenizerConfig(use_chords=True, chord_unknown=(3, 6))
CHORD_NAMES = ", ".join(f"('{'-'.join(map(str, m))}', '{k}')" for k, m in CHORD_MAPS.items())
# few ticks, lengths and pitches, so that there are chords; groups of notes that could be heard together, from each note; then hops from one group to the next
register("chords", f"""WITH RECURSIVE {N}, q AS (SELECT score_id, track_idx, tick - tick % 64 AS tick, 8 + dur % 4 AS dur, [60, 63, 64, 67, 70][pitch % 5 + 1] AS pitch, velocity FROM n WHERE NOT is_drum),
s AS (SELECT *, tick + dur AS stop, row_number() OVER (PARTITION BY score_id, track_idx ORDER BY tick, pitch, dur, velocity) AS i FROM q),
g AS (SELECT a.score_id, a.track_idx, a.i, a.tick, count(*) AS many, max(CASE WHEN abs(b.stop - a.stop) > 4 THEN 1 ELSE 0 END) AS apart, count(*) FILTER (a.dur > 4 OR b.tick = a.tick) AS size,
   max(b.tick) FILTER (a.dur > 4 OR b.tick = a.tick) AS last_tick, list(b.pitch - a.pitch ORDER BY b.i) FILTER (a.dur > 4 OR b.tick = a.tick) AS steps
   FROM s a JOIN s b ON b.score_id = a.score_id AND b.track_idx = a.track_idx AND b.i BETWEEN a.i AND a.i + 9 AND b.tick <= a.tick + 2 GROUP BY a.score_id, a.track_idx, a.i, a.tick),
h AS (SELECT score_id, track_idx, CAST(1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS tick, CAST(NULL AS INTEGER[]) AS steps FROM (SELECT DISTINCT score_id, track_idx FROM s)
  UNION ALL SELECT h.score_id, h.track_idx, CASE WHEN g.tick = h.last THEN h.i + 1 WHEN apart = 1 THEN h.i + many ELSE h.i + size END, CASE WHEN g.tick = h.last OR apart = 1 THEN h.last ELSE last_tick END,
    CASE WHEN g.tick <> h.last AND apart = 0 THEN g.tick END, CASE WHEN g.tick <> h.last AND apart = 0 THEN g.steps END FROM h JOIN g ON g.score_id = h.score_id AND g.track_idx = h.track_idx AND g.i = h.i)
SELECT score_id, track_idx, tick, coalesce(name, 'ukn' || len(steps)) AS chord FROM h LEFT JOIN (VALUES {CHORD_NAMES}) c(key, name) ON array_to_string(steps, '-') = c.key
WHERE len(steps) BETWEEN 3 AND 5 AND steps[-1] <= 24""")(
    lambda s, sf: folds.chords(notes(s, sf).withColumns({"tick": F.col("tick") - F.col("tick") % 64, "dur": 8 + F.col("dur") % 4, "pitch": F.element_at(F.array(*map(F.lit, (60, 63, 64, 67, 70))), F.col("pitch") % 5 + 1)}), CHORDS)
)
DENSITY = """bars AS (SELECT score_id, bar, n_notes * 4.0::DOUBLE AS k, sum(n_notes * 4.0::DOUBLE) OVER (PARTITION BY score_id ORDER BY bar) AS upto, max(bar) OVER (PARTITION BY score_id) AS last FROM per_bar),
f AS (SELECT score_id, CAST(0 AS BIGINT) AS here, CAST(0 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS first_bar, CAST(NULL AS BIGINT) AS last_bar FROM (SELECT DISTINCT score_id FROM bars)
  UNION ALL SELECT score_id, here + 1, CASE WHEN cut THEN greatest(start + 1, stop - CASE WHEN alone THEN 0 ELSE {overlap} END) ELSE start END, CASE WHEN cut THEN start END, CASE WHEN cut THEN stop - 1 END
  FROM (SELECT *, held > {most} AND stop <= last AS cut FROM (SELECT *, CASE WHEN NOT alone AND {overlap} = 0 AND {most} - (held - k) < k / 2 THEN here ELSE here + 1 END AS stop
    FROM (SELECT f.score_id, f.here, f.start, b.k, b.last, b.upto - s.upto + s.k AS held, f.here = f.start AS alone FROM f JOIN bars b ON b.score_id = f.score_id AND b.bar = f.here JOIN bars s ON s.score_id = f.score_id AND s.bar = f.start)))),
done AS (SELECT score_id, first_bar, last_bar FROM f WHERE first_bar IS NOT NULL
  UNION ALL SELECT f.score_id, f.start, b.last FROM f JOIN bars b ON b.score_id = f.score_id AND b.bar = b.last AND f.here = b.last + 1 JOIN bars s ON s.score_id = f.score_id AND s.bar = f.start WHERE b.upto - s.upto + s.k >= {most} // 4)
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY first_bar, last_bar) - 1 AS INTEGER) AS chunk, CAST(first_bar AS INTEGER) AS first_bar, CAST(last_bar AS INTEGER) AS last_bar FROM done"""
for name, overlap in (("density_split", 1), ("density_split_apart", 0)):
    register(name, f"WITH RECURSIVE per_bar AS ({_per_bar('score_id')}), {DENSITY.format(overlap=overlap, most=100)}")(
        lambda s, sf, overlap=overlap: split.density_chunks(grid.notes_per_bar(notes(s, sf), 8), 100, 4.0, overlap)
    )
PERTOK = TokenizerConfig(additional_params={"ticks_per_quarter": 220, "use_microtiming": True, "max_microtiming_shift": 0.25, "num_microtiming_bins": 110})


FINE = sorted({(t, n) for t, n in fine_durations(PERTOK)})
_values = lambda rows: "VALUES " + ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)
# the error of each shift is carried on, so notes follow each other in a fold
PERTOK_SQL = f"""{RAW}, {VEL}, fine AS (SELECT * FROM ({_values(FINE)}) v(t, name)), micro AS (SELECT * FROM ({_values([(m,) for m in micro_timings(PERTOK)])}) v(m)),
near AS (SELECT v, t, name FROM (SELECT v, t, name, row_number() OVER (PARTITION BY v ORDER BY abs(t - v), t) AS r FROM range(0, 1400) r(v), fine) WHERE r = 1),
mic AS (SELECT v, m FROM (SELECT v, m, row_number() OVER (PARTITION BY v ORDER BY abs(m - v), m) AS r FROM range(-1000, 1001) r(v), micro) WHERE r = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY score_id, track_idx ORDER BY tick, pitch, dur, velocity, is_drum, program) AS i, CAST(floor((tick + {min(t for t, _ in FINE) / 2}) / 880) AS BIGINT) AS bar FROM (
  SELECT score_id, track_idx, program, is_drum, CAST(round_even(tick * 220 / 480.0, 0) AS BIGINT) AS tick, greatest(CAST(round_even(dur * 220 / 480.0, 0) AS BIGINT), 1) AS dur, pitch, vel.b AS velocity FROM raw JOIN vel ON vel.v = velocity
  WHERE (is_drum AND pitch BETWEEN 27 AND 88) OR (NOT is_drum AND pitch BETWEEN 21 AND 109))),
f AS (SELECT score_id, track_idx, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS previous, CAST(-1 AS BIGINT) AS bar, CAST(NULL AS BIGINT) AS shift, CAST(0 AS BIGINT) AS last_bar FROM (SELECT DISTINCT score_id, track_idx FROM n)
  UNION ALL SELECT score_id, track_idx, i, CASE WHEN shift >= {min(t for t, _ in FINE) / 2} THEN start + near.t ELSE start END, bar, shift, last_bar
  FROM (SELECT n.score_id, n.track_idx, n.i, n.bar, f.bar AS last_bar, greatest(f.previous, n.bar * 880) AS start, n.tick - greatest(f.previous, n.bar * 880) AS shift FROM f JOIN n ON n.score_id = f.score_id AND n.track_idx = f.track_idx AND n.i = f.i + 1) x JOIN near ON near.v = greatest(shift, 0)),
e AS (SELECT n.score_id, n.track_idx AS stream, n.i, [{{'tick': b * 880, 'token': 'Bar_None'}} for b in range(f.last_bar + 1, n.bar + 1)] AS bars,
  [{{'tick': n.tick, 'token': x}} for x in list_concat(CASE WHEN shift >= {min(t for t, _ in FINE) / 2} THEN ['TimeShift_' || near.name] ELSE [] END, [{PITCH}, 'Velocity_' || velocity, 'MicroTiming_' || mic.m, 'Duration_' || d.name])] AS own
  FROM n JOIN f ON n.score_id = f.score_id AND n.track_idx = f.track_idx AND n.i = f.i JOIN near ON near.v = greatest(shift, 0) JOIN mic ON mic.v = n.tick - f.previous JOIN near d ON d.v = n.dur),
u AS (SELECT score_id, stream, i, unnest(list_concat(bars, own)) AS x, generate_subscripts(list_concat(bars, own), 1) AS k FROM e)
SELECT score_id, stream, CAST(row_number() OVER (PARTITION BY score_id, stream ORDER BY i, k) - 1 AS BIGINT) AS pos, x.tick AS tick, x.token AS token FROM u"""


@register("pertok_tokens", f"WITH RECURSIVE {PERTOK_SQL}")
def pertok_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return folds.pertok(preprocess.preprocess_fine(score_tables(spark, sf), PERTOK, 220), PERTOK)


@register("pertok_ts")
def pertok_ts(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as the time signatures have them, with tempos and programs, in one stream."""
    config = PERTOK.copy(use_time_signatures=True, use_tempos=True, use_programs=True)
    return folds.pertok(preprocess.preprocess_fine(score_tables(spark, sf, True), config, 220), config)


def _bar_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of subword training: the ids of one bar of one track."""
    rows = encode.with_ids(tokens(spark, sf, "REMI"), Vocabulary("REMI", CONFIG))
    w = Window.partitionBy("score_id", "stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bar", F.sum(F.col("token").startswith("Bar_").cast("int")).over(w))
    words = rows.groupBy("score_id", "stream", "bar").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("e"))
    return words.select("score_id", "stream", "bar", F.transform("e", lambda e: e["id"]).alias("ids"))


def _subword(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        words = _bar_words(spark, sf)
        base = len(Vocabulary("REMI", CONFIG))
        return SubwordModel.train(words, kind, base, base + 60).encode(words)

    return run


for kind in ("BPE", "WordPiece", "Unigram"):
    register(f"{kind.lower()}_encode")(_subword(kind))


@register("bpe_roundtrip", f"""WITH {REMI}, t AS ({exploded('e', 'ord')}), b AS (SELECT *, sum(CASE WHEN token = 'Bar_None' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, stream ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bar FROM t)
SELECT score_id, stream, CAST(bar AS BIGINT) AS bar, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM b GROUP BY score_id, stream, bar""")
def bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    words = _bar_words(spark, sf)
    vocabulary = Vocabulary("REMI", CONFIG)
    model = SubwordModel.train(words, "BPE", len(vocabulary), len(vocabulary) + 60)
    tokens_ = F.array_join(F.transform("ids", lambda i: vocabulary.token_of(i)), " ")
    return model.decode(model.encode(words)).select("score_id", "stream", F.col("bar").cast("long").alias("bar"), F.md5(tokens_.cast("binary")).alias("digest"))


@register("midi_roundtrip", f"""WITH {RAW}, a AS (SELECT *, row_number() OVER (PARTITION BY score_id, track_idx, pitch ORDER BY tick, dur, velocity) AS k FROM raw),
z AS (SELECT score_id, track_idx, pitch, tick + dur AS until, row_number() OVER (PARTITION BY score_id, track_idx, pitch ORDER BY tick + dur) AS k FROM raw)
SELECT a.score_id, program, is_drum, tick, until - tick AS dur, pitch, velocity FROM a JOIN z USING (score_id, track_idx, pitch, k)""")
def midi_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Notes written as MIDI files and read again.  Ends of overlapping notes of one pitch trade places, first in first out."""
    files = midi.to_files(notes_view(spark, sf), 480).select(F.col("score_id").cast("string").alias("path"), "content")
    rows = midi.parse_files(files).where("kind = 'note'")
    return rows.select(F.col("path").cast("long").alias("score_id"), "program", "is_drum", "tick", "dur", F.col("a").alias("pitch"), F.col("b").alias("velocity"))


@register("midi_roundtrip_full", f"""WITH {RAW}, a AS (SELECT *, row_number() OVER (PARTITION BY score_id, track_idx, pitch ORDER BY tick, dur, velocity) AS k FROM raw),
z AS (SELECT score_id, track_idx, pitch, tick + dur AS until, row_number() OVER (PARTITION BY score_id, track_idx, pitch ORDER BY tick + dur) AS k FROM raw),
who AS (SELECT DISTINCT score_id, track_idx, program FROM raw),
e AS (SELECT l_suppkey AS score_id, CAST(l_linenumber - 1 AS INTEGER) AS track_idx, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 120 AS BIGINT) AS tick, l_quantity, l_discount, (l_partkey * 37) % 16384 - 8192 AS value FROM lineitem),
p AS (SELECT score_id, track_idx, tick, CAST(l_quantity * 60 AS BIGINT) AS dur FROM e WHERE l_quantity > 40),
pm AS (SELECT *, max(tick + dur) OVER (PARTITION BY score_id, track_idx ORDER BY tick, dur ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
pi AS (SELECT *, sum(CASE WHEN before >= tick THEN 0 ELSE 1 END) OVER (PARTITION BY score_id, track_idx ORDER BY tick, dur ROWS UNBOUNDED PRECEDING) AS island FROM pm),
pd AS (SELECT score_id, track_idx, min(tick) AS tick, max(tick + dur) - min(tick) AS dur FROM pi GROUP BY score_id, track_idx, island),
b AS (SELECT score_id, track_idx, tick, max(value) AS value FROM e WHERE l_discount > 0.085 GROUP BY ALL),
s AS (SELECT DISTINCT score_id FROM raw)
SELECT a.score_id, 'note' AS kind, program, tick, until - tick AS dur, pitch AS a, velocity AS b, 0.0::DOUBLE AS qpm FROM a JOIN z USING (score_id, track_idx, pitch, k)
UNION ALL SELECT score_id, 'pedal', program, tick, dur, -9999, -9999, 0.0 FROM pd JOIN who USING (score_id, track_idx)
UNION ALL SELECT score_id, 'bend', program, tick, -9999, CAST(value AS INTEGER), -9999, 0.0 FROM b JOIN who USING (score_id, track_idx)
UNION ALL SELECT score_id, 'tempo', -9999, k.tick, -9999, -9999, -9999, round(6e7 / round_even(6e7 / (60.0 + (score_id * k.m) % 150), 0), 6) FROM s, (VALUES (0, 7), (153600, 11), (225600, 13)) k(tick, m)
UNION ALL SELECT score_id, 'time_sig', -9999, k.tick, -9999, k.num, k.den, 0.0 FROM s, (VALUES (0, 4, 4), (153600, 3, 4), (225600, 6, 8)) k(tick, num, den)""")
def midi_roundtrip_full(spark: SparkSession, sf: str) -> DataFrame:
    """Notes, tempos, time signatures, pedals (those that touch as one) and bends written as MIDI files and read again."""
    score = score_tables(spark, sf, True, True)
    score.pedals = preprocess.islands(score.pedals, preprocess.TRACK)
    files = midi.to_files(score).select(F.col("score_id").cast("string").alias("path"), "content")
    rows = midi.parse_files(files).where("kind in ('note', 'pedal', 'bend', 'tempo', 'time_sig')")
    none = lambda c: F.coalesce(c, F.lit(-9999)).alias(c)
    return rows.select(F.col("path").cast("long").alias("score_id"), "kind", none("program"), "tick", none("dur"), none("a"), none("b"), F.round(F.coalesce("qpm", F.lit(0.0)), 6).alias("qpm"))


register("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")(lambda s, sf: windows.tumbling(table(s, sf, "events")))
register("user_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, k""")(lambda s, sf: windows.sessions(table(s, sf, "events")))
