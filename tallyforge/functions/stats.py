"""Choices and scores with the tie rules of the operators that use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_argmax(label: Column, value: Column, position: Column) -> Column:
    """Label of the largest value; of equal ones, that of the lowest position (max_by leaves this open)."""
    return F.max(F.struct(value.alias("v"), (-position).alias("p"), label.alias("label")))["label"]


def erf(x: Column) -> Column:
    """Error function by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    # The published coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = ((((F.lit(a[4]) * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal."""
    return (1 + erf(z / F.sqrt(F.lit(2.0)))) / 2
