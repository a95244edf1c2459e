"""Time axis: regimes, campaign clocks and cycles as expressions over dates, with the boundaries as parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def regime_index(day: Column, changepoints: Sequence[str]) -> Column:
    """How many changepoints lie on or before the day."""
    return reduce(lambda a, b: a + b, [F.when(day >= F.lit(c).cast("date"), 1).otherwise(0) for c in changepoints])


def window_days(day: Column, windows: Sequence[tuple[str, str]]) -> Column:
    """Days of the windows that have passed before the day."""
    def passed(first: str, last: str) -> Column:
        a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
        return F.greatest(F.lit(0), F.datediff(F.least(day, b), a))

    return reduce(lambda a, b: a + b, [passed(*w) for w in windows])


def cycle_of(day: Column, ends: Sequence[tuple[str, str]], last: str) -> Column:
    """Label of the first cycle that ends on or after the day; later days belong to the last one."""
    out = F.lit(last)
    for end, label in reversed(ends):
        out = F.when(day <= F.lit(end).cast("date"), label).otherwise(out)
    return out


def dilated_days(day: Column, start: Column, windows: Sequence[tuple[str, str]], dilation: float) -> Column:
    """Days since start on a clock that runs `dilation` times as fast inside the windows."""
    return F.datediff(day, start) + F.lit(dilation - 1) * (window_days(day, windows) - window_days(start, windows))
