"""Arrays: places count from 0, and from the end if negative."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.columns import Value, col, number

Lambda = Callable[[Column], Column]


def size(x: Value) -> Column:
    return F.array_size(col(x))


def element(x: Value, place) -> Column:
    """NULL beyond either end."""
    i = number(place).cast("int")
    return F.get(col(x), F.when(i < 0, i + F.array_size(col(x))).otherwise(i))


def slice_first(x: Value, n) -> Column:
    """The first n, or the last -n."""
    a, k = col(x), number(n).cast("int")
    k = F.greatest(F.least(k, F.array_size(a)), -F.array_size(a))
    return F.when(k >= 0, F.slice(a, F.lit(1), k)).otherwise(F.slice(a, F.array_size(a) + k + 1, -k))


def slice_from(x: Value, start, n) -> Column:
    """n from ``start``, which counts from the end if negative; NULL for n of 0 or less."""
    a, s, k = col(x), number(start).cast("int"), number(n).cast("int")
    s = F.when(s < 0, F.greatest(F.lit(0), s + F.array_size(a))).otherwise(s)
    return F.when(k > 0, F.slice(a, s + 1, k))


def map_(x: Value, f: Lambda) -> Column:
    return F.transform(col(x), f)


def filter_(x: Value, f: Lambda) -> Column:
    return F.filter(col(x), f)


def reduce_(x: Value, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.reduce(col(x), start, f)


def cast(x: Value, kind: str) -> Column:
    return F.transform(col(x), lambda e: e.try_cast(kind))


def extract(x: Value, field: str) -> Column:
    return F.transform(col(x), lambda e: e.getField(field))


def compact(x: Value) -> Column:
    return F.array_compact(col(x))


def remove(x: Value, value) -> Column:
    return F.filter(col(x), lambda e: e.isNull() | (e != value))


def count_if(x: Value, f: Lambda) -> Column:
    return F.array_size(F.filter(col(x), f))


def total(x: Value) -> Column:
    return F.reduce(F.array_compact(col(x)), F.lit(0.0), lambda a, e: a + e)


def product(x: Value) -> Column:
    return F.reduce(F.array_compact(col(x)), F.lit(1.0), lambda a, e: a * e)


def average(x: Value) -> Column:
    return F.try_divide(total(x), F.array_size(F.array_compact(col(x))))


def all_(x: Value, f: Lambda) -> Column:
    return F.forall(col(x), f)


def any_(x: Value, f: Lambda) -> Column:
    return F.exists(col(x), f)


def join(x: Value, delimiter: str) -> Column:
    return F.array_join(col(x), delimiter)


def first_n(x: Value, n: int) -> Column:
    return F.slice(col(x), 1, n)


def last_n(x: Value, n: int) -> Column:
    return slice_first(x, -n)


def zip_(*arrays: Value, longest: bool = False) -> Column:
    """Array of arrays of the values at each place, up to the end of the shortest array, or padded with NULL to the longest."""
    named = F.arrays_zip(*(col(a).alias(f"a{i}") for i, a in enumerate(arrays)))
    both = F.transform(named, lambda s: F.array(*(s[f"a{i}"] for i in range(len(arrays)))))
    return both if longest else F.slice(both, F.lit(1), F.least(*(F.size(col(a)) for a in arrays)))


def max_n(x: Value, n: int) -> Column:
    return F.slice(F.sort_array(F.array_compact(col(x)), asc=False), 1, n)


def min_n(x: Value, n: int) -> Column:
    return F.slice(F.sort_array(F.array_compact(col(x))), 1, n)


def index_of(x: Value, value) -> Column:
    """-1 if it is not there."""
    return F.array_position(col(x), value) - 1


def set_equals(x: Value, y: Value) -> Column:
    return F.array_sort(F.array_distinct(col(x))) == F.array_sort(F.array_distinct(col(y)))


def is_subset(x: Value, y: Value) -> Column:
    return F.array_size(F.array_except(col(x), col(y))) == 0
