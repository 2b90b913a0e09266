"""Numeric functions with IEEE division, half-even casts and other differences from ANSI Spark."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

_INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def fdivide(a, b) -> Column:
    """a / b as doubles, with signed infinities and NaN for division by zero."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    # NaN is the greatest of doubles to Spark, so it is told apart first.
    by_zero = F.when(F.isnan(x), x).when(x > 0, F.lit(_INF)).when(x < 0, F.lit(-_INF)).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def idivide(a, b) -> Column:
    """a // b, null for division by zero."""
    return F.call_function("div", _c(a), F.nullif(_c(b), F.lit(0)))


def mod(a, b) -> Column:
    """a % b, null for a zero divisor."""
    return F.try_mod(_c(a), _c(b))


def to_integer(x, kind: str = "int") -> Column:
    """Cast of a float to an integer: half to even."""
    return F.bround(_c(x), 0).cast(kind)


def decimal_to_integer(x, kind: str = "int") -> Column:
    """Cast of a decimal to an integer: half away from zero."""
    return F.round(_c(x), 0).cast(kind)


def trunc(x) -> Column:
    return F.when(_c(x) < 0, F.ceil(_c(x))).otherwise(F.floor(_c(x))).cast("double")


def even(x) -> Column:
    """Away from zero to an even integer."""
    v = _c(x).cast("double")
    return F.signum(v) * F.ceil(F.abs(v) / 2) * 2


def log(x, base=None) -> Column:
    """log(x) is base 10; with two arguments the first of the reference is the base."""
    return F.log10(_c(x)) if base is None else F.ln(_c(x)) / F.ln(_c(base))


def fmod_floor(a, b) -> Column:
    """fmod(a, b) = a - b * floor(a / b)."""
    return _c(a) - _c(b) * F.floor(_c(a) / _c(b))


def signbit(x) -> Column:
    return (_c(x) < 0) | (_c(x).cast("string") == "-0.0")


def isinf(x) -> Column:
    return F.abs(_c(x)) == F.lit(_INF)


def isfinite(x) -> Column:
    return ~F.isnan(_c(x)) & ~isinf(x)


def greatest(*xs) -> Column:
    return F.greatest(*map(_c, xs))


def factorial(x) -> Column:
    """Up to 20 by the built-in; above, exact in decimal(38, 0) up to 33."""
    v = _c(x).cast("int")
    big = F.aggregate(F.sequence(F.lit(1), F.greatest(v, F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda s, i: (s * i.cast("decimal(2,0)")).cast("decimal(38,0)"))
    return F.when(v <= 1, F.lit(1).cast("decimal(38,0)")).otherwise(big)


def _by_value(f: Callable[..., float], *columns: pd.Series) -> pd.Series:
    """f of each row's values; null where one is null."""
    known = pd.concat(columns, axis=1).notna().all(axis=1)
    out = pd.Series(float("nan"), index=columns[0].index).astype(object).where(known, None)
    out[known] = [f(*row) for row in zip(*[c[known] for c in columns])]
    return out


def _long_pairs(f: Callable, a: pa.Array, b: pa.Array) -> pa.Array:
    known = pc.and_(a.is_valid(), b.is_valid())
    x, y = (c.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (a, b))
    return pc.if_else(known, pa.array(f(x, y), pa.int64()), pa.scalar(None, pa.int64()))


@F.arrow_udf(T.LongType())
def gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    """Vectorised; null where an argument is null."""
    return _long_pairs(np.gcd, a, b)


@F.arrow_udf(T.LongType())
def lcm(a: pa.Array, b: pa.Array) -> pa.Array:
    """Vectorised; null where an argument is null."""
    return _long_pairs(np.lcm, a, b)


@F.pandas_udf(T.DoubleType())
def gamma(x: pd.Series) -> pd.Series:
    return _by_value(math.gamma, x)


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """Infinite at 0 and the negative whole numbers, its poles."""
    return _by_value(lambda v: math.inf if v <= 0 and float(v).is_integer() else math.lgamma(v), x)


@F.pandas_udf(T.DoubleType())
def nextafter(a: pd.Series, b: pd.Series) -> pd.Series:
    return _by_value(math.nextafter, a, b)


def equi_width_bins(low, high, n: int) -> Column:
    """n upper bounds of equal width."""
    a, b = _c(low).cast("double"), _c(high).cast("double")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: a + (b - a) * i / n)


# Bit strings are text of 0 and 1.
def get_bit(s, n: int) -> Column:
    return F.substring(_c(s), n + 1, 1).cast("int")


def set_bit(s, n: int, value: int) -> Column:
    return F.overlay(_c(s), F.lit(str(value)), n + 1)


def bit_position(part, s) -> Column:
    return F.instr(_c(s), part if isinstance(part, str) else _c(part))


def bitstring(s, length: int) -> Column:
    return F.lpad(_c(s), length, "0")
