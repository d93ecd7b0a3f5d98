"""Aggregates whose treatment of NULLs, documents or order differs from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions.columns import Value, col


def _some(*columns: Value) -> Column:
    out = col(columns[0]).isNotNull()
    for c in columns[1:]:
        out = out | col(c).isNotNull()
    return out


def count_any(*columns: Value) -> Column:
    """Rows in which at least one of the columns is there."""
    return F.count_if(_some(*columns))


def count_distinct_any(*columns: Value) -> Column:
    """Distinct combinations, but for the one of NULLs alone."""
    return F.count_distinct(F.when(_some(*columns), F.struct(*map(col, columns))))


def count_documents(df: DataFrame, name: str) -> Column:
    """Documents with at least one field that is not NULL."""
    return count_any(*(f"{name}.{f}" for f in df.schema[name].dataType.fieldNames()))


def add_to_array(x: Value, order: Value | None = None) -> Column:
    """All values, NULLs too; in order of ``order`` if given."""
    if order is None:
        return F.transform(F.collect_list(F.struct(col(x).alias("v"))), lambda s: s.v)
    return F.transform(F.sort_array(F.collect_list(F.struct(col(order).alias("o"), col(x).alias("v")))), lambda s: s.v)


def add_to_set(x: Value) -> Column:
    """Distinct values, a NULL once, in ascending order."""
    return F.transform(F.sort_array(F.collect_set(F.struct(col(x).alias("v")))), lambda s: s.v)


def merge_documents(df: DataFrame, name: str, order: Value) -> Column:
    """One document: each field's last value in order of ``order`` that is not NULL."""
    kind = df.schema[name].dataType
    assert isinstance(kind, T.StructType)
    last = lambda f: F.max_by(F.col(f"{name}.{f}"), F.when(F.col(f"{name}.{f}").isNotNull(), col(order)))
    return F.struct(*(last(f).alias(f) for f in kind.fieldNames()))


def first_by(x: Value, order: Value) -> Column:
    """The first value in an order that is given, so that it is the same in every run."""
    return F.min_by(col(x), col(order))


def last_by(x: Value, order: Value) -> Column:
    return F.max_by(col(x), col(order))


def top_n(df: DataFrame, keys: list[str], x: str, n: int, order: str | None = None, name: str = "top", descending: bool = True) -> DataFrame:
    """Per group an array of the n values of highest (or lowest) order, which is that of the values if none is given.

    Rows are ranked first, and Spark cuts each task's groups to n rows before it shuffles them: no group is gathered.
    NULLs are left out; a group of NULLs alone has an empty array.
    """
    by = F.col(order or x)
    ranked = Window.partitionBy(*keys).orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), F.col(x).desc() if descending else F.col(x).asc())
    some = df.select(*keys, F.col(x).alias("_v"), F.row_number().over(ranked).alias("_i")).where(F.col("_i") <= n)
    kept = F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_i", "_v")))
    return some.groupBy(*keys).agg(F.transform(F.sort_array(kept), lambda s: s["_v"]).alias(name))


def avg_distinct(x: Value) -> Column:
    """Spark's own two-step distinct aggregate: no group's values are gathered."""
    return F.try_divide(F.sum_distinct(col(x)), F.count_distinct(col(x)))
