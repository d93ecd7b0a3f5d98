"""Unwinding and flattening of nested documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(path: list[str]) -> str:
    return ".".join(f"`{p}`" for p in path)


def _replaced(parent: Column, path: list[str], value: Column) -> Column:
    return value if not path else parent.withField(path[0], _replaced(parent.getField(path[0]), path[1:], value))


def unwind(df: DataFrame, path: str, index: str | None = None, outer: bool = False, where=None) -> DataFrame:
    """One row per element of the array at a dotted path, the element in the array's place.

    A value that is no array passes through with a NULL index. Rows without elements go, or stay with NULL if
    ``outer``. ``index`` names a column for the element's place, from 0. ``where``, a predicate on the element, is
    applied before rows are made, so that rows of other elements never are.
    """
    parts = path.split(".")
    kind: T.DataType = df.schema
    for p in parts:
        kind = kind[p].dataType
    if index is not None and index in df.columns:
        raise ValueError(f"index name {index} is a column already")
    value = F.col(_quoted(parts))
    if not isinstance(kind, T.ArrayType):
        kept = df if outer else df.where(value.isNotNull())
        if where is not None:
            kept = kept.where(where(value))
        return kept if index is None else kept.withColumn(index, F.lit(None).cast("long"))
    items = F.transform(value, lambda x, i: F.struct(x.alias("v"), i.cast("long").alias("i")))
    if where is not None:
        items = F.filter(items, lambda s: where(s.v))
    made = df.withColumn("_item", (F.explode_outer if outer else F.explode)(items))
    made = made.withColumn(parts[0], _replaced(F.col(f"`{parts[0]}`"), parts[1:], F.col("_item.v")))
    if index is not None:
        made = made.withColumn(index, F.col("_item.i"))
    return made.drop("_item")


@dataclass(frozen=True)
class Path:
    """One path to unwind, with its own index name and treatment of rows without elements."""

    path: str
    index: str | None = None
    outer: bool = False


def unwind_paths(df: DataFrame, *paths: Path | str) -> DataFrame:
    """Several paths, one after the other; a path inside an unwound one is named from the top."""
    for p in paths:
        p = Path(p) if isinstance(p, str) else p
        df = unwind(df, p.path, p.index, p.outer)
    return df


def flatten(df: DataFrame, separator: str = "_", depth: int | None = None) -> DataFrame:
    """Fields of nested documents as columns of their own, to a depth; names that would clash are an error."""
    out: list[tuple[str, Column]] = []

    def walk(kind: T.StructType, path: list[str], left: int | None) -> None:
        for f in kind.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType) and (left is None or left > 0):
                walk(f.dataType, here, None if left is None else left - 1)
            else:
                out.append((separator.join(here), F.col(_quoted(here))))

    walk(df.schema, [], depth)
    names = [n for n, _ in out]
    if len(set(names)) < len(names):
        raise ValueError(f"fields clash when flattened: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.select(*(c.alias(n) for n, c in out))
