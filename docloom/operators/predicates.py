"""Match predicates as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import Value, col


def nor(*conditions: Column) -> Column:
    """True where no condition is true."""
    return ~reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def has_all(array: Value, *values) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(col(array), v) for v in values))


def size_is(array: Value, n: int) -> Column:
    return F.array_size(col(array)) == n


def mod_is(x: Value, divisor: int, remainder: int) -> Column:
    return F.try_mod(col(x), F.lit(divisor)) == remainder


def bits_all_set(x: Value, mask: int) -> Column:
    return col(x).bitwiseAND(F.lit(mask)) == mask


def bits_any_set(x: Value, mask: int) -> Column:
    return col(x).bitwiseAND(F.lit(mask)) != 0


def bits_all_clear(x: Value, mask: int) -> Column:
    return col(x).bitwiseAND(F.lit(mask)) == 0


def bits_any_clear(x: Value, mask: int) -> Column:
    return col(x).bitwiseAND(F.lit(mask)) != mask


def elem_match(array: Value, f) -> Column:
    return F.exists(col(array), f)


def regex(x: Value, pattern: str, options: str = "") -> Column:
    return F.rlike(col(x), F.lit(f"(?{options}){pattern}" if options else pattern))


def exists(x: Value) -> Column:
    return col(x).isNotNull()


def not_in(x: Value, *values) -> Column:
    """SQL NOT IN over a list: NULL if the value, or one not matched against, is NULL."""
    return ~col(x).isin(*values)
