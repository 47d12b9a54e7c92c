"""Quantiles of many columns at once, approximate or exact, without gathering a column anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.columns import aggregate_row, as_double

# Columns with at most this many values together are handed to the ``percentile`` aggregate, whose states meet in one task.
DIRECT_LIMIT = 1_000_000
# The last stretch of the selection sorts at most this many values, of all quantiles and columns together.
SORT_LIMIT = 100_000
# Rank error of the sketches that drive the selection. Only speed depends on it.
STEP_ERROR = 0.001


def quantiles(
    df: DataFrame,
    names: Sequence[str],
    probs: Sequence[float],
    mode: str = "approx",
    error: float = 0.01,
    direct_limit: int = DIRECT_LIMIT,
    sort_limit: int = SORT_LIMIT,
) -> dict[str, list[float] | None]:
    """Quantiles ``probs`` of each column, NULL and NaN ignored; ``None`` for a column without values.

    ``approx`` returns data values whose rank is within ``error`` (one tree-aggregated job for all columns).
    ``exact`` interpolates linearly between the two neighbouring order statistics.
    """
    if mode not in ("approx", "exact"):
        raise ValueError(f"mode is 'approx' or 'exact', not {mode!r}")
    if not names:
        return {}
    flat = df.select(*[as_double(df, n).alias(f"q{i}") for i, n in enumerate(names)])
    if mode == "approx":
        if error <= 0:
            raise ValueError("error must be positive; use mode='exact' for exact quantiles")
        found = flat.stat.approxQuantile(flat.columns, list(probs), error)
        return {n: (v or None) for n, v in zip(names, found)}
    counts = dict(zip(flat.columns, aggregate_row(flat, [F.count(c) for c in flat.columns])))
    direct, room = [], direct_limit
    for c in sorted(flat.columns, key=counts.get):
        if 0 < counts[c] <= room:
            direct.append(c)
            room -= counts[c]
    exprs = [F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])) for c in direct]
    result = dict(zip(direct, aggregate_row(flat, exprs)))
    large = [c for c in flat.columns if counts[c] > 0 and c not in direct]
    if large:
        result.update(_select_large(flat, large, probs, counts, sort_limit))
    return {n: result.get(c) for n, c in zip(names, flat.columns)}


@dataclass
class _Target:
    """The value of zero-based rank ``rank`` of a column, known to lie strictly between ``low`` and ``high``."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def masked(self) -> Column:
        cell = F.col(self.column)
        keep = F.lit(True)
        if self.low is not None:
            keep = keep & (cell > F.lit(self.low))
        if self.high is not None:
            keep = keep & (cell < F.lit(self.high))
        return F.when(keep, cell)

    def narrow(self, pivots: list[float], less: list[int], upto: list[int]) -> None:
        above = self.below + self.inside
        for pivot, lt, le in zip(pivots, less, upto):
            if lt <= self.rank < le:
                self.value = pivot
                return
            if le <= self.rank and le >= self.below:
                self.low, self.below = pivot, le
            elif lt > self.rank and lt <= above:
                self.high, above = pivot, lt
        self.inside = above - self.below


def _select_large(flat, columns, probs, counts, sort_limit) -> dict[str, list[float]]:
    targets: dict[tuple[str, int], _Target] = {}
    for c in columns:
        for p in probs:
            first = floor(p * (counts[c] - 1))
            for rank in (first, min(first + 1, counts[c] - 1)):
                targets.setdefault((c, rank), _Target(c, rank, counts[c]))
    sort_limit = max(1, sort_limit // len(targets))
    while True:
        wide = [t for t in targets.values() if t.value is None and t.inside > sort_limit]
        if not wide:
            break
        _narrow_by_sketch(flat, wide)
    last = [t for t in targets.values() if t.value is None]
    picks = [F.element_at(F.array_sort(F.collect_list(t.masked())), t.rank - t.below + 1) for t in last]
    for target, value in zip(last, aggregate_row(flat, picks)):
        target.value = value
    found: dict[str, list[float]] = {}
    for c in columns:
        for p in probs:
            position = p * (counts[c] - 1)
            first = floor(position)
            a = targets[c, first].value
            b = targets[c, min(first + 1, counts[c] - 1)].value
            found.setdefault(c, []).append(a + (b - a) * (position - first))
    return found


def _narrow_by_sketch(flat: DataFrame, wide: list[_Target]) -> None:
    """Take pivots near each rank from a sketch, count exactly around them, and shrink each open interval.

    A pivot is a data value of the interval, so every round excludes at least one value, and normally all but about
    ``4 * STEP_ERROR`` of the rows. The counts are exact, so the sketch decides only how fast this goes.
    """
    # neighbouring ranks share an interval until it gets small, so each interval is sketched once
    spans = {(t.column, t.low, t.high): t for t in wide}
    slots = {span: f"m{i}" for i, span in enumerate(spans)}
    masked = flat.select(*[t.masked().alias(slots[span]) for span, t in spans.items()])
    aims = [(t.rank - t.below + 0.5) / t.inside for t in wide]
    grid = sorted({min(1.0, max(0.0, a + d)) for a in aims for d in (-2 * STEP_ERROR, 0.0, 2 * STEP_ERROR)})
    sketched = dict(zip(masked.columns, masked.stat.approxQuantile(masked.columns, grid, STEP_ERROR)))
    pivots: list[tuple[_Target, str, list[float]]] = []
    tests: dict[tuple[str, float], int] = {}
    for target, aim in zip(wide, aims):
        slot = slots[target.column, target.low, target.high]
        near = sorted({v for g, v in zip(grid, sketched[slot]) if abs(g - aim) <= 2.5 * STEP_ERROR})
        pivots.append((target, slot, near))
        for v in near:
            tests.setdefault((slot, v), len(tests))
    counts = [F.count_if(F.col(slot) < F.lit(v)) for slot, v in tests]
    counts += [F.count_if(F.col(slot) <= F.lit(v)) for slot, v in tests]
    counted = aggregate_row(masked, counts)
    for target, slot, near in pivots:
        at = [tests[slot, v] for v in near]
        less = [counted[i] + target.below for i in at]
        upto = [counted[i + len(tests)] + target.below for i in at]
        target.narrow(near, less, upto)
