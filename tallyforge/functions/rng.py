"""Counter-based random numbers: call number i of a seeded stream as a pure expression, the same on any partition or retry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = (1 << 32) - 1


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_WORD))


def _times(a: Column, b: Column) -> Column:
    """Low 32 bits of a product, in halves so that no 64-bit product overflows."""
    high = _low(F.shiftright(a, 16) * b)
    return _low(F.shiftleft(high, 16) + a.bitwiseAND(F.lit(0xFFFF)) * b)


def uniform(seed: int, call: Column) -> Column:
    """Call number `call` (from 1) of the 32-bit stream with increment 0x6d2b79f5, as a double in [0, 1)."""
    t = _low(F.lit(seed) + _low(call.cast("long")) * F.lit(0x6D2B79F5))
    a = _times(_low(t.bitwiseXOR(F.shiftrightunsigned(t, 15))), t.bitwiseOR(F.lit(1)))
    b = a.bitwiseXOR(_low(a + _times(_low(a.bitwiseXOR(F.shiftrightunsigned(a, 7))), a.bitwiseOR(F.lit(61)))))
    return _low(b.bitwiseXOR(F.shiftrightunsigned(b, 14))) / F.lit(4294967296.0)


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal from two uniforms, cosine branch; a first uniform of 0 counts as 1e-10."""
    u1 = F.when(u1 == 0, F.lit(1e-10)).otherwise(u1)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)


def with_uniforms(df: DataFrame, seed: int, calls: Mapping[str, Column]) -> DataFrame:
    """Add one uniform column per entry. The steps become columns in turn, as one expression would repeat each step many times over."""
    t, a, b = ({n: F.col(f"_{step}_{n}") for n in calls} for step in "tab")
    df = df.withColumns({f"_t_{n}": _low(F.lit(seed) + _low(c.cast("long")) * F.lit(0x6D2B79F5)) for n, c in calls.items()})
    df = df.withColumns({f"_a_{n}": _times(_low(t[n].bitwiseXOR(F.shiftrightunsigned(t[n], 15))), t[n].bitwiseOR(F.lit(1))) for n in calls})
    df = df.withColumns({f"_b_{n}": a[n].bitwiseXOR(_low(a[n] + _times(_low(a[n].bitwiseXOR(F.shiftrightunsigned(a[n], 7))), a[n].bitwiseOR(F.lit(61))))) for n in calls})
    df = df.withColumns({n: _low(b[n].bitwiseXOR(F.shiftrightunsigned(b[n], 14))) / F.lit(4294967296.0) for n in calls})
    return df.drop(*[f"_{step}_{n}" for step in "tab" for n in calls])
