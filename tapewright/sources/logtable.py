"""Tables that grow by appended deltas and are resolved when they are read.

A load or micro-batch writes its own rows into a generation folder and touches nothing else, so its cost does not depend on what is
stored already. Rows carry their order number; per key the row with the greatest one counts, whichever generation it lies in, so
batches may arrive out of order or twice. ``compact`` writes the resolved rows as one generation and removes those it was made
from; order numbers stay, so that late corrections still find their place, and a compaction that stops halfway does no harm.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapewright.operators.bars import latest_by_key

ORDER, GENERATION = "_order", "gen"


@dataclass(frozen=True)
class LogTable:
    """``schema`` holds all columns of a row, keys and partition columns included; partition columns must belong to the key."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    partitions: tuple[str, ...]

    def __post_init__(self):
        if not set(self.partitions) <= set(self.keys):
            raise ValueError("a row that moves to another partition would be stored twice; partition columns must be keys")

    def append(self, rows: DataFrame, number: int | None = None, order: str | None = None) -> None:
        """Write one generation. ``number`` names it: writing it again replaces it, so a repeated batch is harmless.

        Without ``order``, later numbers win.
        """
        if order is None and number is None:
            raise ValueError("rows need an order column, or their load a number")
        place = F.col(order).cast("long") if order is not None else F.lit(number).cast("long")
        ready = rows.withColumn(ORDER, place).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], ORDER)
        self._write(ready, f"d{number:012d}" if number is not None else f"d{uuid.uuid4().hex}")

    def _write(self, rows: DataFrame, generation: str) -> None:
        newest = latest_by_key(rows, list(self.keys), [ORDER], drop_order=False).select(*rows.columns)
        spread = newest.hint("rebalance", *self.partitions) if self.partitions else newest
        writer = spread.sortWithinPartitions(*self.partitions, *[k for k in self.keys if k not in self.partitions]).write.mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "static")
        writer.partitionBy(*self.partitions).parquet(f"{self.path}/{GENERATION}={generation}")

    def generations(self, spark: SparkSession) -> list[str]:
        """Names of the finished generations, as many as were written since the last compaction."""
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{GENERATION}=*/_SUCCESS")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(s.getPath().getParent().getName().split("=", 1)[1] for s in found or [])

    def deltas(self, spark: SparkSession, generations: list[str] | None = None) -> DataFrame:
        """All stored rows with their order numbers, not resolved."""
        names = self.generations(spark) if generations is None else generations
        stored = T.StructType([*self.schema.fields, T.StructField(ORDER, T.LongType())])
        if not names:
            return spark.createDataFrame([], stored)
        full = T.StructType([*stored.fields, T.StructField(GENERATION, T.StringType())])
        reader = spark.read.schema(full).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{GENERATION}={n}" for n in names]).drop(GENERATION)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as it stands. Filters on keys reach the scan, and those on partition columns prune it."""
        return latest_by_key(self.deltas(spark), list(self.keys), [ORDER]).select(*self.schema.names)

    def compact(self, spark: SparkSession) -> int:
        """Put all generations into one; returns how many there were. Readers that are under way must have ended."""
        names = self.generations(spark)
        if len(names) > 1:
            self._write(self.deltas(spark, names), f"c{uuid.uuid4().hex}")
            for name in names:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{GENERATION}={name}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return len(names)
