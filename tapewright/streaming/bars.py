"""Streams of ticks and bars."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tapewright.operators.bars import normalise, recent_dates, session_bars
from tapewright.operators.features import build_features
from tapewright.operators.metrics import decide
from tapewright.session import shared_folder
from tapewright.sources.logtable import LogTable
from tapewright.sources.tables import BAR_SCHEMA


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder or glob as a stream; ``ts`` becomes a timestamp, as watermarks need one."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(ticks: DataFrame, minutes: int = 5, delay: str = "10 minutes", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Tumbling OHLCV bars; a bar is emitted once the watermark has passed its end."""
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    bars = (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("_w"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("volume").alias("volume"),
        )
    )
    return bars.select("symbol", F.col("_w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def without_repeats(bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drops exact repeats of a bar that arrive within the delay."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def run_to_files(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process what is available now into Parquet files and stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or f"{path}-checkpoint").start(path)
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    return query


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bar_log_table(path: str) -> LogTable:
    """Bars as appended deltas, a folder per market and day."""
    kept = [f for f in BAR_SCHEMA.fields if f.name != "year"]
    return LogTable(path, T.StructType([*kept, T.StructField("date", T.DateType())]), ("market", "date", "symbol", "ts"), ("market", "date"))


def _rows(batch: DataFrame, market: str, *extra: str) -> DataFrame:
    bars = normalise(batch, keys=("symbol", *extra)) if extra else normalise(batch)
    return bars.withColumn("market", F.lit(market)).withColumn("date", F.to_date("ts"))


def keep_corrected(path: str, market: str, order: str) -> Callable[[DataFrame, int], None]:
    """Batch sink: a bar with a higher ``order`` replaces the stored one, in whichever batch either comes.

    A batch appends its own rows; ``bar_log_table(path).read`` resolves them.
    """
    target = bar_log_table(path)

    def each(batch: DataFrame, number: int) -> None:
        target.append(_rows(batch, market, order), number, order)

    return each


def _past(target: LogTable, spark: SparkSession, market: str, first: dt.date, history: int, lookback: int) -> DataFrame:
    """Bars of each symbol's last ``history`` dates before ``first``.

    Only the folders of the last ``lookback`` days are read, and older ones for symbols that have too few dates in them.
    """
    stored = target.read(spark).filter((F.col("market") == market) & (F.col("date") < F.lit(first)))
    since = F.lit(first - dt.timedelta(days=lookback))
    near = recent_dates(session_bars(stored.filter(F.col("date") >= since).drop("date"), market), history - 1).drop("is_target")
    enough = near.select("symbol", "date").distinct().groupBy("symbol").count().filter(F.col("count") >= history).select("symbol")
    deltas = target.deltas(spark).filter((F.col("market") == market) & (F.col("date") < since))
    few = deltas.join(enough, "symbol", "left_anti").select("symbol").distinct()
    if few.isEmpty():
        return near
    all_of = recent_dates(session_bars(stored.join(few, "symbol", "left_semi").drop("date"), market), history - 1).drop("is_target")
    return near.join(few, "symbol", "left_anti").unionByName(all_of)


def signals_of_batch(
    bars_path: str, out_path: str, market: str, peak: Column, trough: Column, threshold: float, history: int = 5, lookback: int = 30
) -> Callable[[DataFrame, int], None]:
    """Batch sink: store the bars, build features on them and the days before, write the batch's signals.

    The stored table is the memory of the stream: a batch appends to it and reads the folders of its own days and of the days just
    before. Output goes to one folder per batch, so a repeated batch replaces its own rows.
    """
    target = bar_log_table(bars_path)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bars = _rows(batch, market)
        target.append(bars, number)
        first = bars.agg(F.min("date")).first()[0]
        if first is None:
            return
        stored = target.read(spark).filter((F.col("market") == market) & (F.col("date") >= F.lit(first)))
        now = session_bars(stored.drop("date"), market)
        past = _past(target, spark, market, first, history, lookback)
        scored = build_features(past.select(*now.columns).unionByName(now)).select(
            "symbol", "ts", "close", peak.alias("peak_prob"), trough.alias("trough_prob")
        )
        fresh = scored.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
        signals = fresh.withColumn("signal", decide(F.col("peak_prob"), F.col("trough_prob"), threshold, tie="peak"))
        signals.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return each
