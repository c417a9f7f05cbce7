"""What several corpus operators share: reading a table, cleaning columns, per-task Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The contracts' word pattern, white space being ASCII only, and the letters that are lowered.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)

SLICE = 256  # rows of an Arrow batch that are Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII bytes alone take the much faster ``lower``, which gives the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row as one value ``row`` beside the ``keys`` made from it, so that no name of its own columns can clash with others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def per_batch(df: DataFrame, start: Callable[[], Callable[[dict[str, list]], dict[str, pa.Array]]], schema: str) -> DataFrame:
    """Run Python on each Arrow batch of ``df``.

    ``start()`` is called once in each task and returns the function for its batches, which maps
    lists by column name to Arrow arrays by column name. Batches without rows give nothing; others are handed over in slices
    of SLICE rows, so that few texts at a time are held as Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                work = work or start()
                out = work({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return df.mapInArrow(run, schema)


@contextmanager
def rows_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most ``n`` rows for what is executed inside; the session's own setting comes back after it.

    Batches are counted in rows, so where a row holds long texts, or gives many rows, fewer of them bound a task's memory.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())
