"""Exact quantiles by selection: sketches bracket the wanted ranks, counts narrow them down, and only the values of a small bracket are gathered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import floor, isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class _Target:
    """The value of a 0-based rank among those strictly between two bounds, ``below`` values lying at or under the lower one; no bound is None."""

    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    found: float | None = None

    def within(self) -> Column:
        x, out = F.col(self.column), F.col(self.column).isNotNull()
        if self.low is not None:
            out = out & (x > F.lit(self.low))
        return out if self.high is None else out & (x < F.lit(self.high))


def _row(df: DataFrame, columns: Sequence[Column]) -> list:
    return list(df.agg(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def selected(df: DataFrame, wanted: Sequence[tuple[str, int]], most: int = 1 << 14, accuracy: int = 10_000) -> list[float]:
    """The value at each (column, 0-based rank) of double columns, nulls left out, in the order of Spark: NaN is the greatest.

    Each round is one pass for all ranks still open. A sketch of bounded size
    gives two values that should enclose a rank; the next pass counts what lies
    under, at, between and over them, which tells where the rank is, whether the
    sketch was right or not. What lies between is some 4 in ``accuracy`` of what
    was there before, however the values are distributed, and repeated values
    end up at a bound, so a few rounds leave at most ``most`` values, which are
    gathered and sorted. Ranks outside the column raise ``ValueError``.
    """
    totals = dict(zip(dict.fromkeys(c for c, _ in wanted), _row(df, [F.count(c) for c in dict.fromkeys(c for c, _ in wanted)])))
    targets = [_Target(c, k, inside=totals[c]) for c, k in dict.fromkeys(wanted)]
    if any(not 0 <= t.rank < t.inside for t in targets):
        raise ValueError("a rank that the column doesn't have")
    while open_ := [t for t in targets if t.found is None]:
        few, many = [t for t in open_ if t.inside <= most], [t for t in open_ if t.inside > most]
        if few:
            for t, values in zip(few, _row(df, [F.sort_array(F.collect_list(F.when(t.within(), F.col(t.column)))) for t in few])):
                t.found = values[t.rank - t.below]
            continue
        sketches = []
        for t in many:
            share, margin = (t.rank - t.below + 0.5) / t.inside, 2.0 / accuracy
            ends = [F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin))]
            sketches.append(F.percentile_approx(F.when(t.within(), F.col(t.column)), F.array(*ends), F.lit(accuracy)))
        brackets = _row(df, sketches)
        counts = []
        for t, (a, b) in zip(many, brackets):
            x = F.when(t.within(), F.col(t.column))
            counts += [F.count_if(x < F.lit(a)), F.count_if(x == F.lit(a)), F.count_if((x > F.lit(a)) & (x < F.lit(b))), F.count_if((x == F.lit(b)) & F.lit(a != b and not (isnan(a) and isnan(b))))]
        found = _row(df, counts)
        for i, (t, (a, b)) in enumerate(zip(many, brackets)):
            _narrow(t, a, b, *found[4 * i : 4 * i + 4])
    known = {(t.column, t.rank): t.found for t in targets}
    return [known[w] for w in wanted]


def _narrow(t: _Target, a: float, b: float, under: int, at_a: int, between: int, at_b: int) -> None:
    """Puts a target where its rank lies: at one of the two values, between, below or above them."""
    rank = t.rank - t.below
    if rank < under:
        t.high, t.inside = a, under
    elif rank < under + at_a:
        t.found = a
    elif rank < under + at_a + between:
        t.low, t.high, t.below, t.inside = a, b, t.below + under + at_a, between
    elif rank < under + at_a + between + at_b:
        t.found = b
    else:
        t.low, t.below, t.inside = b, t.below + under + at_a + between + at_b, t.inside - under - at_a - between - at_b


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], **settings: int) -> dict[str, list[float] | None]:
    """For each double column its quantiles, interpolated linearly between the two ranks beside them; None for one without values."""
    counts = dict(zip(columns, _row(df, [F.count(c) for c in columns])))
    places = {(c, p): p * (counts[c] - 1) for c in columns for p in probabilities if counts[c]}
    ranks = sorted({(c, r) for (c, _), at in places.items() for r in (floor(at), min(floor(at) + 1, counts[c] - 1))})
    values = dict(zip(ranks, selected(df, ranks, **settings))) if ranks else {}

    def between(c: str, p: float) -> float:
        at = places[c, p]
        low, high = values[c, floor(at)], values[c, min(floor(at) + 1, counts[c] - 1)]
        return low if low == high else low + (high - low) * (at - floor(at))

    return {c: [between(c, p) for p in probabilities] if counts[c] else None for c in columns}
