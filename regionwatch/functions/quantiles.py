"""Exact interpolated quantiles without a whole column in one task.

The built-in exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer. Here each wanted rank has a bracket, at first everything. A
round lets a mergeable sketch propose two cuts around the rank inside its bracket,
counts exactly what lies below, at, between and above them, and keeps the part that
holds the rank. Cuts are values of the column and leave the bracket, so every round
makes it smaller, whatever the sketch's error is, and a value with many copies is
found as soon as it is a cut. The few values that are left are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

SKETCH_ACCURACY = 10_000
MARGIN = 10 / SKETCH_ACCURACY       # of the bracket's values, ten times the sketch's error
FEW = 4_096                         # so many values of a bracket are sorted
AT_A_TIME = 48                      # ranks that one pass narrows


@dataclass(frozen=True)
class Bracket:
    """The open interval that holds the value of one rank; ``below`` values are not above its lower end."""

    column: str
    rank: int
    count: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        c = F.col(f"`{self.column}`")
        kept = c.isNotNull()
        if self.low is not None:
            kept = kept & (c > F.lit(self.low))
        return kept if self.high is None else kept & (c < F.lit(self.high))

    @property
    def settled(self) -> bool:
        return self.value is not None or self.count <= FEW

    def shares(self) -> tuple[float, float]:
        at = (self.rank - self.below + 0.5) / self.count
        return max(at - MARGIN, 0.0), min(at + MARGIN, 1.0)

    def narrowed(self, cuts: Sequence[float], counts: Sequence[int]) -> "Bracket":
        """The part that holds the rank, of those below, at, between, at and above two cuts."""
        low, high = cuts
        parts = [(self.low, low, None), (None, None, low), (low, high, None), (None, None, high), (high, self.high, None)]
        below = self.below
        for (a, b, value), n in zip(parts, counts):
            if self.rank < below + n:
                return replace(self, count=n, below=below, low=a, high=b, value=value)
            below += n
        raise AssertionError("counts of a bracket do not add up")


def _sketched(c: str, b: Bracket | None, shares: Sequence[float]) -> Column:
    values = F.col(f"`{c}`") if b is None else F.when(b.inside(), F.col(f"`{c}`"))
    return F.percentile_approx(values, list(shares), SKETCH_ACCURACY)


def _narrow(numbers: DataFrame, brackets: Sequence[Bracket], cuts: Sequence[Sequence[float]]) -> list[Bracket]:
    """Counts the parts of every bracket in one pass and keeps the part with its rank."""
    sums = []
    for b, (low, high) in zip(brackets, cuts):
        c, inside = F.col(f"`{b.column}`"), b.inside()
        at_high = (c == high) if high > low else F.lit(False)
        sums += [F.count_if(inside & part) for part in (c < low, c == low, (c > low) & (c < high), at_high, c > high)]
    counts = numbers.agg(*[s.alias(f"n{i}") for i, s in enumerate(sums)]).first()
    return [b.narrowed(cut, counts[5 * i : 5 * i + 5]) for i, (b, cut) in enumerate(zip(brackets, cuts))]


def values_at(numbers: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[tuple[str, float], float]:
    """The interpolated quantile of every column with values; ``numbers`` is read in a few passes."""
    around = [s for p in probabilities for s in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    first = numbers.agg(
        *[agg.alias(f"{k}{i}") for i, c in enumerate(columns) for k, agg in (("n", F.count(F.col(f"`{c}`"))), ("c", _sketched(c, None, around)))]
    ).first()
    position = {(c, p): p * (first[f"n{i}"] - 1) for i, c in enumerate(columns) if first[f"n{i}"] for p in probabilities}
    found: dict[tuple[str, int], Bracket] = {}
    cuts: dict[tuple[str, int], Sequence[float]] = {}
    for (c, p), at in position.items():
        i, k = columns.index(c), 2 * probabilities.index(p)
        for rank in (math.floor(at), math.ceil(at)):
            found[c, rank], cuts[c, rank] = Bracket(c, rank, first[f"n{i}"]), first[f"c{i}"][k : k + 2]
    while wide := [key for key, b in found.items() if not b.settled][:AT_A_TIME]:
        unknown = [key for key in wide if key not in cuts]
        if unknown:
            row = numbers.agg(*[_sketched(c, found[c, r], found[c, r].shares()).alias(f"b{i}") for i, (c, r) in enumerate(unknown)]).first()
            cuts.update(zip(unknown, row))
        found.update(zip(wide, _narrow(numbers, [found[key] for key in wide], [cuts.pop(key) for key in wide])))
    few = [b for b in found.values() if b.value is None]
    for at in range(0, len(few), AT_A_TIME):
        some = few[at : at + AT_A_TIME]
        left = [F.sort_array(F.collect_list(F.when(b.inside(), F.col(f"`{b.column}`")))) for b in some]  # at most FEW values each
        row = numbers.agg(*[F.get(v, F.lit(b.rank - b.below)).alias(f"v{i}") for i, (b, v) in enumerate(zip(some, left))]).first()
        found.update({(b.column, b.rank): replace(b, value=v) for b, v in zip(some, row)})
    out = {}
    for (c, p), at in position.items():
        low, high = found[c, math.floor(at)].value, found[c, math.ceil(at)].value
        out[c, p] = low + (high - low) * (at - math.floor(at)) if high > low else low
    return out


def quantile_values(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[tuple[str, float], float]:
    """Quantiles by (column, probability); the columns are kept while they are read, and let go."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return values_at(numbers, list(columns), [float(p) for p in probabilities])
    finally:
        numbers.unpersist()


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row per (column, probability): the linearly interpolated quantile; none for a column without values."""
    rows = [(c, p, v) for (c, p), v in quantile_values(df, columns, probabilities).items()]
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double")


def with_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], name: str = "_q"
) -> tuple[DataFrame, dict[tuple[str, float], Column]]:
    """Add the same quantiles as a struct column, null without values; also their fields by (column, probability)."""
    values = quantile_values(df, columns, probabilities)
    keys = [(c, float(p)) for c in columns for p in probabilities]
    row = F.struct(*[F.lit(values.get(key)).cast("double").alias(f"q{i}") for i, key in enumerate(keys)])
    return df.withColumn(name, row), {key: F.col(f"{name}.q{i}") for i, key in enumerate(keys)}
