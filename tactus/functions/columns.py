"""Column expressions of the time grid and of binning.  All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tactus.config import TokenizerConfig
from tactus.plans.vocab import dotted


def half_even(x: Column) -> Column:
    """Round half to even, as the grid does."""
    return F.rint(x).cast("long")


def regrid(tick: Column, old_tpq: int, new_tpq: int) -> Column:
    return half_even(tick * float(new_tpq) / float(old_tpq)) if old_tpq != new_tpq else tick.cast("long")


def nearest(value: Column, bins: Sequence[float], kind: str = "long", upper_tie: bool = True) -> Column:
    """The nearest of ascending bins; ties go to the larger one, or to the smaller one.

    Bins at even steps need no search; others are cut by the midpoints between neighbours, a balanced chain of comparisons.
    """
    bins = sorted(bins)

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(bins[lo])
        mid = (lo + hi) // 2
        middle = (bins[mid] + bins[mid + 1]) / 2
        right = value >= middle if upper_tie else value > middle
        return F.when(right, pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return pick(0, len(bins) - 1).cast(kind)


def nearest_whole(value: Column, bins: Sequence[int], kind: str = "long") -> Column:
    """nearest() of whole numbers from 0 on, by a table up to the largest bin."""
    top = max(bins)
    table = [min(bins, key=lambda b: (abs(b - v), -b)) for v in range(top + 1)]
    return lookup(table, F.least(F.greatest(value, F.lit(0)), F.lit(top))).cast(kind)


def lookup(values: Sequence, index: Column) -> Column:
    """values[index]: a literal array, so one step a row; null outside it."""
    plain = lambda v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    return F.get(F.array(*[plain(v) if isinstance(v, (list, tuple)) else F.lit(v) for v in values]), index.cast("int"))


def _greedy_table(bins: list[tuple[str, int]]) -> tuple[str, int, list[list[str]], list[int]]:
    """The largest bin, and for each rest below it the names that it takes and the ticks that are left."""
    seen: dict[int, str] = {}
    for name, size in bins:
        seen.setdefault(size, name)
    sizes = sorted(seen, reverse=True)
    names, left = [], []
    for rest in range(sizes[0]):
        out = []
        for size in sizes:
            while rest >= size:
                out.append(seen[size])
                rest -= size
        names.append(out)
        left.append(rest)
    return seen[sizes[0]], sizes[0], names, left


def greedy(ticks: Column, bins: list[tuple[str, int]]) -> Column:
    """Ticks as the fewest values, largest first: array of bin names.  What is left below the smallest bin is dropped.

    bins: (name, ticks), any order; of equal ticks the first counts.  The largest bin is repeated, and what remains below
    it is a row of a table that is made on the driver.
    """
    name, top, names, _ = _greedy_table(bins)
    return F.concat(F.array_repeat(F.lit(name), F.floor(ticks / top).cast("int")), lookup(names, F.pmod(ticks, F.lit(top))))


def greedy_length(ticks: Column, bins: list[tuple[str, int]]) -> Column:
    """Ticks that greedy() covers."""
    _, top, _, left = _greedy_table(bins)
    return ticks - lookup(left, F.pmod(ticks, F.lit(top)))


def duration_bins(config: TokenizerConfig, tpb: int, prefix: str = "", rest: bool = False) -> list[tuple[str, int]]:
    """(token, ticks) of the durations, or rests, at so many ticks a beat, those of no tick left out."""
    found = [(f"{prefix}{dotted(d)}", config.ticks(d, tpb)) for d in (config.rests if rest else config.durations)]
    return [(n, t) for n, t in found if t > 0]


def duration_token(dur: Column, config: TokenizerConfig, tpb: int, prefix: str = "Duration_") -> Column:
    """Token of a duration that is one of the bins; of two with the same ticks the later, as in a dictionary that is filled in order."""
    names = dict((t, n) for n, t in duration_bins(config, tpb, prefix))
    return lookup([names.get(t) for t in range(max(names) + 1)], dur)


def token_ticks(value: Column, tpb: Column | int) -> Column:
    """Ticks of `beats.position.resolution`."""
    parts = F.split(value, r"\.")
    beat, pos, res = (parts[i].cast("long") for i in range(3))
    return F.floor((beat * res + pos) * tpb / res).cast("long")
