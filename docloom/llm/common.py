"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.intermediate import Scratch

#: A word: a run of anything but ASCII white space. ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20
#: Bytes of a batch that goes to Python or comes back.
BATCH, _BATCH_LIMIT = str(8 << 20), "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about ``limit`` bytes of text, so that what is made from a run stays small."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype="i8")))
    run = ends[1:] // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(int(a), int(b - a))


def raw_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of each text, None where it is null."""
    return batch.column(text).cast(pa.binary()).to_pylist()


def with_text_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[pa.RecordBatch], list],
    keep: list[str] | None = None,
    text: str = "text",
    end: Callable[[], None] | None = None,
) -> DataFrame:
    """Columns computed from whole texts, batch by batch, beside the columns ``keep`` (all but the text if None).

    ``make`` gets a run of rows and returns one array or list per field. ``end`` is called when a task is done.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, text):
                    made = make(part)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in keep] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made],
                        names=[*keep, *(f.name for f in fields)],
                    )
        finally:
            if end is not None:
                end()

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size.

    Spark fills batches up to 64 MB unless told otherwise, and each task holds several; a session that has not set the
    bound itself gets ``BATCH``.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_LIMIT) in ("64m", "64MB", "67108864b", "67108864"):
        conf.set(_BATCH_LIMIT, BATCH)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds none

    return df.mapInArrow(bounded, schema)
