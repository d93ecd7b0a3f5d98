"""Arithmetic and mathematics: errors give NULL, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import Value, col, number


def divide(a: Value, b: Value) -> Column:
    """A double; NULL for a divisor of 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def mod(a: Value, b: Value) -> Column:
    """Remainder with the sign of the dividend; NULL for a divisor of 0."""
    return F.when(col(b) != 0, F.try_mod(col(a), col(b)))


def _finite(x: Column) -> Column:
    return ~x.isin(float("inf"), float("-inf"))


def _trig(f):
    def of(x: Value) -> Column:
        d = col(x).cast("double")
        return F.when(_finite(d), f(d))

    return of


sin, cos, tan = _trig(F.sin), _trig(F.cos), _trig(F.tan)


def _whole(d: Column, f) -> Column:
    """``f`` of a double where that is a long; beyond 2 ** 53 a double has no fraction, and what is not finite stays."""
    return F.when(F.abs(d) < float(1 << 53), f(d).cast("double")).otherwise(d)


def ceiling(x: Value, kind: str = "double") -> Column:
    """Rounded up, in the type of the argument (``kind``); infinities and NaN stay what they are."""
    return _whole(col(x).cast("double"), F.ceil).cast(kind) if kind == "double" else F.ceil(col(x)).cast(kind)


def floor(x: Value, kind: str = "double") -> Column:
    return _whole(col(x).cast("double"), F.floor).cast(kind) if kind == "double" else F.floor(col(x)).cast(kind)


def log(x: Value, base: Value | None = None) -> Column:
    """Natural logarithm, or to a base; NULL for arguments or bases of 0 or less and for a base of 1."""
    d = col(x).cast("double")
    natural = F.when(F.isnan(d), d).when(d > 0, F.ln(d))
    if base is None:
        return natural
    b = number(base).cast("double")
    return F.when((b > 0) & (b != 1), natural / F.ln(b))


def log10(x: Value) -> Column:
    d = col(x).cast("double")
    return F.when(F.isnan(d), d).when(d > 0, F.log10(d))


def power(x: Value, y: Value) -> Column:
    return F.pow(col(x).cast("double"), number(y).cast("double"))


def round_even(x: Value, digits: int = 0) -> Column:
    """Ties to even; NULL for digits outside -20 to 100."""
    return F.bround(col(x), digits) if -20 <= digits <= 100 else F.lit(None).cast("double")


def sqrt(x: Value) -> Column:
    d = col(x).cast("double")
    return F.when(F.isnan(d), d).when(d >= 0, F.sqrt(d))


def absolute(x: Value) -> Column:
    return F.abs(col(x))


def degrees(x: Value) -> Column:
    return F.degrees(col(x).cast("double"))


def radians(x: Value) -> Column:
    return F.radians(col(x).cast("double"))


def truncate(x: Value, digits: int = 0) -> Column:
    """Digits beyond ``digits`` cut off, towards 0."""
    scale = 10.0**digits
    d = col(x).cast("double")
    return F.when(d < 0, _whole(d * scale, F.ceil)).otherwise(_whole(d * scale, F.floor)) / scale
