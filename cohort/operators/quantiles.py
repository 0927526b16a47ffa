"""Exact quantiles without holding a column in one task.

The built-in exact percentile keeps every distinct value of the column in one reducer. Here a
bounded sketch brackets each wanted rank, one pass counts what lies below and inside the brackets,
and only bracketed values are fetched; a bracket that is still too rich is bracketed again. All
columns and ranks share the passes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

FETCH_ROWS = 20_000
_ACCURACY = 10_000
_MARGIN = 2.0 / _ACCURACY
_LARGEST = sys.float_info.max


def as_number(c: str) -> Column:
    """A column as double, with NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass
class _Bracket:
    """Values of ``col`` in ``[low, high]`` hold the wanted 0-based ``rank``."""

    col: str
    rank: int
    low: float
    high: float
    below: int
    inside: int

    def test(self) -> Column:
        return F.col(self.col).between(self.low, self.high)

    def open(self, fetch: int) -> bool:
        return self.low < self.high and self.inside > fetch


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> None:
    """One round for all brackets: propose tighter ends, count, keep them if they hold the rank."""
    # Brackets over the same stretch share one sketch.
    shared: dict[tuple, list[int]] = {}
    for i, b in enumerate(brackets):
        shared.setdefault((b.col, b.low, b.high), []).append(i)
    asks = []
    for members in shared.values():
        probs = []
        for i in members:
            at = (brackets[i].rank - brackets[i].below + 0.5) / brackets[i].inside
            probs += [max(0.0, at - _MARGIN), min(1.0, at + _MARGIN)]
        first = brackets[members[0]]
        asks.append(F.percentile_approx(F.when(first.test(), F.col(first.col)), probs, _ACCURACY))
    proposals: list = [None] * len(brackets)
    for members, found in zip(shared.values(), df.agg(*asks).first()):
        for place, i in enumerate(members):
            proposals[i] = tuple(found[2 * place : 2 * place + 2])
    # Halves of the value range, for the case that the sketch does not help.
    middles = [max(b.low, -_LARGEST) / 2 + min(b.high, _LARGEST) / 2 for b in brackets]
    counts = []
    for b, (low, high), middle in zip(brackets, proposals, middles):
        c = F.col(b.col)
        for test in (c < low, c.between(low, high), c.between(b.low, middle)):
            counts.append(F.count(F.when(test, 1)))
    got = list(df.agg(*counts).first())
    for i, (b, (low, high), middle) in enumerate(zip(brackets, proposals, middles)):
        under, within, lower_half = got[3 * i : 3 * i + 3]
        if 0 <= b.rank - under < within < b.inside:
            b.low, b.high, b.below, b.inside = low, high, under, within
        elif b.rank - b.below < lower_half:
            b.high, b.inside = middle, lower_half
        else:
            b.low = math.nextafter(middle, math.inf)
            b.below, b.inside = b.below + lower_half, b.inside - lower_half


def exact_quantiles(
    df: DataFrame, cols: Sequence[str] | str, probs: Sequence[float], fetch: int = FETCH_ROWS
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the known values, ``{column: [one per prob]}``.

    Null and NaN are missing; infinite values count as the smallest and largest.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    # NaN is a missing value
    numbers = df.select(*[as_number(c).alias(c) for c in cols])
    ends = numbers.agg(*[f(c) for c in cols for f in (F.count, F.min, F.max)]).first()
    size = {c: tuple(ends[3 * i : 3 * i + 3]) for i, c in enumerate(cols)}

    places = {c: [p * (size[c][0] - 1) for p in probs] if size[c][0] else [] for c in cols}
    brackets = {}
    for c in cols:
        n, low, high = size[c]
        for place in places[c]:
            for rank in (math.floor(place), min(math.ceil(place), n - 1)):
                brackets[c, rank] = _Bracket(c, rank, low, high, 0, n)
    while todo := [b for b in brackets.values() if b.open(fetch)]:
        _narrow(numbers, todo)

    found: dict[tuple[str, int], float] = {k: b.low for k, b in brackets.items() if b.low == b.high}
    for c in cols:
        rest = [b for b in brackets.values() if b.col == c and b.low < b.high]
        if not rest:
            continue
        wanted = rest[0].test()
        for b in rest[1:]:
            wanted = wanted | b.test()
        rows = sorted(tuple(r) for r in numbers.filter(wanted).groupBy(c).count().collect())
        for b in rest:
            seen = b.below
            for value, n in rows:
                if b.low <= value <= b.high:
                    seen += n
                    if b.rank < seen:
                        found[c, b.rank] = value
                        break

    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = [None] * len(probs)
        for i, place in enumerate(places[c]):
            a, z = found[c, math.floor(place)], found[c, min(math.ceil(place), size[c][0] - 1)]
            out[c][i] = a if a == z else a + (z - a) * (place - math.floor(place))
    return out
