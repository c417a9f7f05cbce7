"""Stage tables at rest, vendor lists and result files.

One Parquet table per stage, partitioned by market, symbol and year; what varies between runs
(timeframe, label and model variant) are plain columns, so one job serves all variants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tapewright.functions.columns import between_dates, pad_code
from tapewright.operators.bars import merge_loads, normalise, resample, validate_bars
from tapewright.operators.features import feature_columns
from tapewright.operators.summaries import upsert_ledger
from tapewright.session import stage

PARTITIONS = ("market", "symbol", "year")

BAR_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("volume", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)
SYMBOL_LIST_SCHEMA = "ticker string, name string, tv_symbol string, exchange string, type string"
CACHE_SCHEMA = "symbol string, period_start date, period_end date, stock_close double, filtered_symbols array<string>"


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS, mode: str = "overwrite") -> None:
    """Write a partitioned table; with ``overwrite`` only the partitions present in ``df`` are replaced.

    The rebalance hint gives each partition few files and splits a partition that holds much of the
    data over several tasks. A table with times also keeps their ``date``, whose bounds the Parquet footers then know.
    """
    if "year" in partitions and "year" not in df.columns:
        df = df.withColumn("year", F.year("ts"))
    if "ts" in df.columns and "date" not in df.columns:
        df = df.withColumn("date", F.to_date("ts"))
    order = ["ts"] if "ts" in df.columns else []
    spread = df.hint("rebalance", *partitions)
    spread = spread.sortWithinPartitions(*partitions, *order)
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    market: str | None = None,
    symbols: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    closed: str = "day",
    schema: T.StructType | None = None,
    **variant: str,
) -> DataFrame:
    """Scan of a stage table; market, symbol and year prune partitions, time reaches the Parquet filter.

    ``variant`` filters plain columns, e.g. ``label_config="L2"``. An unreadable file is an error.
    """
    reader = spark.read
    df = (reader.schema(schema) if schema is not None else reader).parquet(path)
    keep: list[Column] = [F.col(k) == v for k, v in variant.items()]
    if market is not None:
        keep.append(F.col("market") == market)
    if symbols is not None:
        keep.append(F.col("symbol").isin(*symbols))
    for bound, text in ((">=", start), ("<=", end)):
        if text is not None and "year" in df.columns:
            # An end that includes the next midnight may reach into the next year.
            year = int(text[:4]) + (1 if bound == "<=" and closed == "next_midnight" else 0)
            keep.append(F.col("year") >= year if bound == ">=" else F.col("year") <= year)
    if start is not None or end is not None:
        keep.append(between_dates(F.col("ts"), start, end, closed))
    for k in keep:
        df = df.filter(k)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_bars(new: DataFrame, path: str, market: str, source: str = "", pad: bool = False, order: Sequence[str] = ()) -> None:
    """Merge a load into the bar table; only the symbol years it touches are rewritten.

    Of rows of the load with the same key, the last by ``order`` wins: a file position, or several columns.
    """
    spark = new.sparkSession
    load = normalise(new, source, ("symbol", *order)).withColumn("market", F.lit(market)).withColumn("year", F.year("ts"))
    if pad:
        load = load.withColumn("symbol", pad_code(F.col("symbol")))
    # A load may repeat a bar; the same rule as on merging applies.
    load = merge_loads(load.limit(0), load, ("market", "symbol", "year", "ts"), order).drop(*order)
    if exists(spark, path):
        load = stage(load, "load")
        touched = load.select(*PARTITIONS).distinct()
        stored = spark.read.schema(BAR_SCHEMA).parquet(path).join(touched, list(PARTITIONS), "left_semi")
        merged = merge_loads(stored, load, ("market", "symbol", "year", "ts"))
        # Staged first: the partitions being replaced are also being read.
        load = stage(merged, "merged")
    write_table(load, path)


def save_resampled(load: DataFrame, bars_path: str, path: str, market: str, minutes: int = 5) -> None:
    """Bring a table of coarser bars up to date with a load that the one-minute table already holds.

    The days that the load touches are made anew from all their stored minutes, so a late or corrected minute changes its window;
    other days are not read.
    """
    spark = load.sparkSession
    days = load.select("symbol", F.to_date("ts").alias("_day")).distinct().withColumn("year", F.year("_day"))
    stored = read_table(spark, bars_path, market, schema=BAR_SCHEMA).withColumn("_day", F.to_date("ts"))
    touched = stored.join(days, ["symbol", "year", "_day"], "left_semi").select("symbol", "ts", "open", "high", "low", "close", "volume", "source")
    save_bars(resample(touched, minutes), path, market)


def save_and_track(new: DataFrame, path: str, market: str, source: str, ledger: DataFrame, exchange: str) -> DataFrame:
    """Save a load and return the ledger with one row per symbol of it, marked complete when valid."""
    save_bars(new, path, market, source)
    checked = validate_bars(normalise(new, source))
    status = F.when(F.col("valid"), F.lit("complete")).otherwise(F.lit("partial"))
    updates = checked.select(
        "symbol",
        F.lit(exchange).alias("exchange"),
        F.lit(source).alias("source"),
        F.lit(market).alias("market"),
        F.col("bar_count").cast("long").alias("bar_count"),
        status.alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.to_date("first_ts").alias("start_date"),
        F.to_date("last_ts").alias("end_date"),
        F.lit(0).cast("long").alias("seq"),
    )
    return upsert_ledger(ledger, updates)


def partition_counts(spark: SparkSession, path: str, partitions: Sequence[str] = PARTITIONS) -> DataFrame:
    """Rows per partition, from footers."""
    return footer_scan(spark, path).groupBy(*partitions).agg(F.count(F.lit(1)).alias("n_rows"))


def catalogue(df: DataFrame, columns: Sequence[str] = PARTITIONS) -> DataFrame:
    """Distinct partition values: symbols, years or variants at hand."""
    return df.select(*columns).distinct()


def variants(df: DataFrame, columns: Sequence[str] = ("timeframe", "label_config", "model_config")) -> DataFrame:
    """The variants that a stored table holds, with their symbols and dates; columns it lacks are left out."""
    known = [c for c in columns if c in df.columns]
    return df.groupBy(*known).agg(
        F.count_distinct("symbol").alias("n_symbols"), F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"), F.count(F.lit(1)).alias("n_rows")
    )


def result_contents(df: DataFrame) -> DataFrame:
    """Symbols and dates of a result, with their rows."""
    return df.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n_rows"))


def footer_scan(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as a scan that answers counts and bounds from the Parquet footers.

    Only the second version of Spark's file reader takes aggregates; tables are read by the first one elsewhere. Grouping must be
    by all partition columns, and bounds must be of numbers or dates, for the footers to be enough.
    """
    v1 = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(v1)
    spark.conf.set(v1, ",".join(name for name in before.split(",") if name != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(v1, before)


def partition_bounds(spark: SparkSession, path: str, partitions: Sequence[str] = PARTITIONS) -> DataFrame:
    """Rows, first and last date of each partition, from footers: no row is read."""
    return footer_scan(spark, path).groupBy(*partitions).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_rows")
    )


def date_range(spark: SparkSession, path: str, by: Sequence[str] = ("symbol",), partitions: Sequence[str] = PARTITIONS) -> DataFrame:
    """First and last date by any of the partition columns, from the bounds of the partitions."""
    return partition_bounds(spark, path, partitions).groupBy(*by).agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def table_size(spark: SparkSession, path: str) -> DataFrame:
    """Rows, number of feature columns, files and bytes of a stored table: footers and the listing of its files tell them."""
    table = footer_scan(spark, path)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    files = listing.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")).select(F.struct("n_files", "n_bytes")).scalar()
    rows = table.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_f", files)
    return rows.select("n_rows", "_f.n_files", "_f.n_bytes", F.lit(len(feature_columns(table))).alias("n_features"))


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbol master lists; tickers stay text so that leading zeros survive."""
    return spark.read.option("header", "true").schema(SYMBOL_LIST_SCHEMA).csv(path)


def read_contract_cache(spark: SparkSession, path: str, multi_line: bool = True, skip_unreadable: bool = False) -> DataFrame:
    """Weekly JSON documents with contract arrays, one row per contract.

    A document that cannot be read is an error, unless asked to be skipped; ``unreadable_contract_documents`` lists those.
    """
    mode = "DROPMALFORMED" if skip_unreadable else "FAILFAST"
    docs = spark.read.option("multiLine", str(multi_line).lower()).option("mode", mode).schema(CACHE_SCHEMA).json(path)
    return docs.select("symbol", "period_start", "period_end", "stock_close", F.explode("filtered_symbols").alias("_s")).select(
        "symbol", "period_start", "period_end", "stock_close", F.trim("_s").alias("contract")
    )


def unreadable_contract_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The documents that ``read_contract_cache`` fails on, whole, with their file."""
    docs = spark.read.option("wholetext", str(multi_line).lower()).text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    parsed = F.from_json("value", f"{CACHE_SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return docs.filter((F.trim("value") != "") & parsed["_corrupt"].isNotNull()).select("file_path", F.col("value").alias("document"))


def write_result(df: DataFrame, path: str, csv: bool = False) -> None:
    """Result table as Parquet, and as CSV beside it when asked for."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if csv:
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def read_result(spark: SparkSession, path: str, symbol: str | None = None, date: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/parquet")
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    return df if date is None else df.filter(between_dates(F.col("ts"), date, date))


def first_usable_variant(
    predictions: DataFrame,
    option_bars: DataFrame,
    timeframes: Sequence[str] = ("1m", "5m"),
    labels: Sequence[str] = ("L2", "L1", "L3"),
    models: Sequence[str] = ("M3", "M1", "M2", "M4"),
) -> DataFrame:
    """The first variant and symbol, in order of preference, whose dates overlap option data."""
    keys = ["timeframe", "label_config", "model_config", "symbol"]
    spans = predictions.groupBy(*keys).agg(F.min(F.to_date("ts")).alias("_a"), F.max(F.to_date("ts")).alias("_b"))
    options = option_bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("_c"), F.max(F.to_date("ts")).alias("_d"))

    def place(c: str, names: Sequence[str]) -> Column:
        return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))

    both = spans.join(options, "symbol").select(
        *keys, F.greatest("_a", "_c").alias("date_min"), F.least("_b", "_d").alias("date_max"),
        place("timeframe", timeframes).alias("_t"), place("label_config", labels).alias("_l"), place("model_config", models).alias("_m"),
    )
    usable = both.filter((F.col("date_min") < F.col("date_max")) & (F.col("_t") > 0) & (F.col("_l") > 0) & (F.col("_m") > 0))
    return usable.orderBy("_t", "_l", "_m", "symbol").limit(1).drop("_t", "_l", "_m")
