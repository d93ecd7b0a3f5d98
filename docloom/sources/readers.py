"""Readers and writers of tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.schemas import from_spark

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    """A table; text formats should be given a schema, so that they are read once."""
    if format not in FORMATS:
        raise ValueError(f"no reader for {format}")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", partition: list[str] | None = None, mode: str = "error", **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition) if partition else writer).save(path)


class Catalog:
    """Tables of one folder by name, as frames and as schemas."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def schema(self, name: str) -> dict:
        return from_spark(self.table(name).schema)

    def register(self, *names: str) -> None:
        """The tables as temporary views."""
        for n in names:
            self.table(n).createOrReplaceTempView(n)

    def describe(self, *names: str) -> DataFrame:
        """(table_name, column_name, ordinal, type) of the tables."""
        rows = [(n, f.name, i, f.dataType.simpleString()) for n in names for i, f in enumerate(self.table(n).schema.fields, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, type string")


def save_schema(spark: SparkSession, schema: dict, path: str, mode: str = "error") -> None:
    """A schema as one JSON text in any store that the session can write to."""
    spark.createDataFrame([(json.dumps(schema, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path)


def load_schema(spark: SparkSession, path: str) -> dict:
    """A schema from a JSON file, or a folder that ``save_schema`` wrote."""
    return json.loads(spark.read.text(path, wholetext=True).where("trim(value) <> ''").first()["value"])


def names(spark: SparkSession, folder: str) -> list[str]:
    """Tables of a folder in any store that the session can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(n.removesuffix(".parquet") for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))
