"""Compositions as lists of Columns, so that every operation is plain arithmetic inside whole-stage code.

A part that was not measured is null, which is not zero; only zero replacement turns either into a small share.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Parts = list[Column]


def total(parts: Parts) -> Column:
    """Sum of the parts, null where any is null."""
    return reduce(lambda a, b: a + b, parts)


def closure(parts: Parts) -> Parts:
    """Shares of the whole; null where the whole is 0 or a part is null."""
    whole = F.nullif(total(parts), F.lit(0.0))
    return [p / whole for p in parts]


def closed_array(parts: Parts) -> Column:
    """The closed parts as an array; null where a part is missing or the whole is 0."""
    return F.when(total(parts) > 0, F.array(*closure(parts)))


def zero_replaced(parts: Parts, delta: float | None = None) -> Parts:
    """Closed shares without zeros: a zero or unmeasured part gets delta = (1 / k)^2, the others shrink in proportion."""
    delta = (1 / len(parts)) ** 2 if delta is None else delta
    filled = [F.coalesce(p, F.lit(0.0)) for p in parts]
    shares = closure(filled)
    zeros = total([F.when(p == 0, 1).otherwise(0) for p in filled])
    return [F.when(p == 0, F.lit(delta)).otherwise(s * (1 - zeros * F.lit(delta))) for p, s in zip(filled, shares)]


def clr(parts: Parts) -> Parts:
    """Centred log-ratios of positive parts."""
    logs = [F.log(p) for p in parts]
    mean = total(logs) / len(parts)
    return [x - mean for x in logs]


def clr_inverse(coords: Parts) -> Parts:
    """The closed composition of log-ratio coordinates (any added constant drops out)."""
    return closure([F.exp(c) for c in coords])


def basis(k: int) -> list[list[float]]:
    """Orthonormal contrasts: coordinate i sets the first i parts' geometric mean against part i + 1."""
    return [[math.sqrt(i / (i + 1)) * (1 / i if j < i else -1.0 if j == i else 0.0) for j in range(k)] for i in range(1, k)]


def ilr(parts: Parts) -> Parts:
    """Isometric log-ratio coordinates, one fewer than parts."""
    logs = [F.log(p) for p in parts]
    return [total([F.lit(v) * x for v, x in zip(row, logs) if v]) for row in basis(len(parts))]


def ilr_inverse(coords: Parts) -> Parts:
    """The closed composition of isometric coordinates."""
    rows = basis(len(coords) + 1)
    return clr_inverse([total([F.lit(row[j]) * c for row, c in zip(rows, coords)]) for j in range(len(coords) + 1)])


def ilr_sampling_variance(shares: Parts, n: Column) -> Parts:
    """Variance of each coordinate for a multinomial sample of size n, by the delta method; shares count as 1e-6 at least."""
    return [total([F.lit(v * v) / F.greatest(s, F.lit(1e-6)) for v, s in zip(row, shares) if v]) / n for row in basis(len(shares))]


def perturbed(parts: Parts, index: int, factor: Column | float) -> Parts:
    """One part times a factor, closed again."""
    return closure([p * factor if i == index else p for i, p in enumerate(parts)])


def swung(baseline: Parts, before: Parts, after: Parts) -> Parts:
    """Uniform log-ratio swing: the change from before to after, applied to a baseline."""
    return clr_inverse([b + y - x for b, x, y in zip(clr(baseline), clr(before), clr(after))])


def clamped(value: Column, limit: float) -> Column:
    """Within limit of 0 on either side."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), value))


def shifted(shares: Parts, shifts: Parts, limit: float = 0.35) -> Parts:
    """Shares moved in isometric coordinates by clamped shifts."""
    return ilr_inverse([c + clamped(s, limit) for c, s in zip(ilr(shares), shifts)])
