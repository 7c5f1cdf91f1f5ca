"""Token sequences as array columns: length, items and slices, putting together, comparing, and filling in what is missing.

A sequence is a row with `ids`, `tokens` and `chars` (the letters of subword training), any of them null; `ids_encoded` says
that its ids are those of a subword model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.operators.subword import SubwordModel, to_chars
from tactus.plans.vocab import Vocabulary

#: In the order in which length() and item() look at them.
PARTS = ("ids", "tokens", "chars")


def _letters(chars: Column) -> Column:
    return F.when(F.length(chars) > 0, F.split(chars, "")).otherwise(F.array().cast("array<string>"))


def length(ids: Column, tokens: Column, chars: Column) -> Column:
    """Number of elements of the first part that has any."""
    sizes = F.size(ids), F.size(tokens), F.length(chars)
    return F.coalesce(*[F.when(s > 0, s) for s in sizes], F.lit(0))


def item(part: Column, i: int) -> Column:
    """The i-th element of an array or string, from the end if i is negative; null outside it."""
    return F.try_element_at(part, F.lit(i + 1 if i >= 0 else i))


def cut(rows: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Sequences without what is outside [start, stop), in all their parts; negative bounds count from the end."""
    def bounds(n: Column) -> tuple[Column, Column]:
        at = lambda x, default: default if x is None else F.least(F.greatest(F.lit(x) if x >= 0 else n + x, F.lit(0)), n)
        first, after = at(start, F.lit(0)), at(stop, n)
        return first + 1, F.greatest(after - first, F.lit(0))

    out = rows
    for name in (p for p in PARTS if p in rows.columns):
        n = F.length(name) if name == "chars" else F.size(name)
        first, count = bounds(n)
        part = F.substr(name, first, count) if name == "chars" else F.slice(name, first, count)
        out = out.withColumn(name, F.when(n >= 0, part))
    return out


def joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The sequences of each key one after the other; a part that one of them lacks is null."""
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[p for p in PARTS if p in rows.columns]))).alias("__s"))
    made = []
    for name in (p for p in PARTS if p in rows.columns):
        pieces = F.col("__s")[name]
        whole = F.array_join(pieces, "") if name == "chars" else F.flatten(pieces)
        made.append(F.when(~F.exists(pieces, lambda p: p.isNull()), whole).alias(name))
    return found.select(*keys, *made)


def same(a: str, b: str, parts: tuple[str, ...] = PARTS) -> Column:
    """Whether the sequences of the struct columns a and b are equal in all parts that both have, of which there must be one."""
    both = [F.col(f"{a}.{p}").isNotNull() & F.col(f"{b}.{p}").isNotNull() for p in parts]
    equal = [F.when(k, F.col(f"{a}.{p}") == F.col(f"{b}.{p}")).otherwise(True) for k, p in zip(both, parts, strict=True)]
    any_, all_ = both[0], equal[0]
    for k, e in zip(both[1:], equal[1:], strict=True):
        any_, all_ = any_ | k, all_ & e
    return any_ & all_


def complete(rows: DataFrame, vocabulary: Vocabulary, model: SubwordModel | None = None) -> DataFrame:
    """Sequences with ids, tokens and chars, each from the others where it is null; ids of a subword model become base ids first."""
    rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in (("ids", "array<int>"), ("tokens", "array<string>"), ("chars", "string"), ("ids_encoded", "boolean")) if k not in rows.columns})
    if model is not None:
        base = model.decode(rows.where("ids_encoded"))
        rows = rows.where("not coalesce(ids_encoded, false)").unionByName(base.withColumn("ids_encoded", F.lit(False)))
    from_tokens = F.transform("tokens", lambda t: vocabulary.id_of(t))
    first = 33
    point = lambda c: F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("int")
    from_chars = F.transform(_letters(F.col("chars")), lambda c: point(c) - first - F.when(point(c) >= 0xE000, 0x800).otherwise(0))
    rows = rows.withColumn("ids", F.coalesce("ids", from_tokens, F.when(F.col("chars").isNotNull(), from_chars)))
    return rows.withColumns({"tokens": F.coalesce("tokens", F.transform("ids", lambda i: vocabulary.token_of(i))), "chars": F.coalesce("chars", F.when(F.col("ids").isNotNull(), to_chars(F.col("ids"))))})


def are_encoded(ids: Column, base_size: int) -> Column:
    """Whether a sequence holds an id that only a subword model has."""
    return F.exists(ids, lambda i: i >= base_size)
