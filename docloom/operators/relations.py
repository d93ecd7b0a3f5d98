"""Operators between and over whole relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dual(spark: SparkSession) -> DataFrame:
    """One row without fields of interest, for expressions without a table."""
    return spark.range(1).select()


def array_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Constant documents as rows; a field that a document lacks is NULL."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, columns matched by name; one that a relation lacks is NULL there."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    return union_all(first, *others).distinct()


def distinct_documents(df: DataFrame) -> DataFrame:
    return df.distinct()


def bound(df: DataFrame, alias: str) -> DataFrame:
    """The relation's rows as one document column, by which several relations can be told apart."""
    return df.select(F.struct("*").alias(alias))


def spread(df: DataFrame) -> DataFrame:
    """Document columns as columns; names that occur in two of them are an error."""
    names = [f for d in df.columns for f in df.schema[d].dataType.fieldNames()]
    if len(set(names)) < len(names):
        raise ValueError(f"names occur in several documents: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.select(*(f"{d}.*" for d in df.columns))


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def quantified(df: DataFrame, value: Column, op: str, quantifier: str, other: DataFrame, column: str, on: list[tuple[str, str]] | None = None, name: str = "holds") -> DataFrame:
    """``df`` with ``value op ANY|ALL (column of other)`` as column ``name``, in three-valued logic.

    ``on`` pairs columns of ``df`` with columns of ``other`` for a correlated subquery. Only the least and greatest
    value and two counts of each group are joined: nothing is compared row by row. Over no rows ANY is false, ALL true.
    """
    stats = [F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count("*").alias("_n"), F.count(column).alias("_known")]
    if on:
        grouped = other.groupBy(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on))).agg(*stats)
        met = df.join(grouped, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(on)], "left").drop(*(f"_k{i}" for i in range(len(on))))
    else:
        met = df.join(F.broadcast(other.agg(*stats)), F.lit(True), "left")  # one row
    lo, hi, f = F.col("_lo"), F.col("_hi"), _COMPARE[op]
    n, known = F.coalesce("_n", F.lit(0)), F.coalesce("_known", F.lit(0))
    any_ = quantifier.upper() in ("ANY", "SOME")
    if (op, any_) in (("=", True), ("<>", False)):
        return _membership(df, value, other, column, on, name, op == "=")
    edge = (hi if op in ("<", "<=") else lo) if any_ else (lo if op in ("<", "<=") else hi)
    met_edge = F.when(known > 0, f(value, edge))
    if op in ("=", "<>"):
        # = ALL: every value is the least and the greatest one; <> ANY: one of those two differs
        differs = F.when(known > 0, (value != lo) | (value != hi))
        unknown = (known < n) | value.isNull()
        out = F.when(n == 0, not any_).when(differs, any_).when(unknown, None).otherwise(not any_)
    elif any_:
        out = F.when(n == 0, False).when(met_edge, True).when((known < n) | value.isNull(), None).otherwise(False)
    else:
        out = F.when(n == 0, True).when(~met_edge, False).when((known < n) | value.isNull(), None).otherwise(True)
    return met.withColumn(name, out).drop("_lo", "_hi", "_n", "_known")


def _membership(df: DataFrame, value: Column, other: DataFrame, column: str, on: list[tuple[str, str]] | None, name: str, within: bool) -> DataFrame:
    """``= ANY`` (``within``) or ``<> ALL`` as a value: a join with the distinct values, and with each group's counts."""
    pairs = on or []
    keys = [F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]
    of_group = [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(pairs)]
    names = [f"_k{i}" for i in range(len(pairs))]
    values = other.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v")).distinct().withColumn("_hit", F.lit(True))
    met = df.withColumn("_x", value).join(values, [F.col("_x") == F.col("_v"), *of_group], "left").drop("_v", *names)
    counts = [F.count("*").alias("_n"), F.count(column).alias("_known")]
    if pairs:
        met = met.join(other.groupBy(*keys).agg(*counts), of_group, "left").drop(*names)
    else:
        met = met.join(F.broadcast(other.agg(*counts)), F.lit(True), "left")  # one row
    n, known = F.coalesce("_n", F.lit(0)), F.coalesce("_known", F.lit(0))
    out = F.when(n == 0, not within).when(F.col("_hit"), within).when((known < n) | F.col("_x").isNull(), None).otherwise(not within)
    return met.withColumn(name, out).drop("_x", "_hit", "_n", "_known")


def semi_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value is in the other relation's column (``= ANY``)."""
    return df.join(other.select(F.col(other_column).alias("_v")), F.col(column) == F.col("_v"), "left_semi")


def anti_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value is known not to be in the other relation's column (``<> ALL``): none if that holds a NULL."""
    values = other.select(F.col(other_column).alias("_v"))
    nulls = values.agg(F.count_if(F.col("_v").isNull()).alias("_nulls"), F.count("*").alias("_rows"))
    kept = df.join(values, F.col(column) == F.col("_v"), "left_anti").join(F.broadcast(nulls), F.lit(True))
    return kept.where("_rows = 0 or (_nulls = 0 and " + f"`{column}` is not null)").drop("_nulls", "_rows")


def scalar(df: DataFrame, column: str) -> Column:
    """The value of a relation of one row at most; NULL without a row, an error with more."""
    return df.select(column).scalar()
