"""Queries that run a stream over the data at hand and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators.joins import rounded
from tapewright.plans import inputs as I
from tapewright.plans.inputs import with_tables
from tapewright.plans.registry import query
from tapewright.session import STATE_STORE
from tapewright.streaming import bars as SB
from tapewright.streaming import state as SS

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _tick_stream(spark, folder):
    raw = SB.read_stream(spark, f"{folder}/events*.parquet", EVENTS)
    return raw.select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), (1 + F.col("event_id") % 100).alias("volume"), "event_id"
    )


def _replay(spark, df, name):
    """The table as a replay source: a file per symbol and half of the month, in time order, one file per batch."""
    path = SB.folder(spark, name)
    for part in (F.to_date("ts") < "2024-01-16", F.to_date("ts") >= "2024-01-16"):
        df.filter(part).repartition("symbol").write.mode("append").parquet(path)
    return SB.read_stream(spark, path, df.schema, files_per_batch=1)


@query(
    "R-01 R-02",
    with_tables(
        """SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
          arg_max(price, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY 1, time_bucket(INTERVAL 5 MINUTE, ts)
        HAVING time_bucket(INTERVAL 5 MINUTE, ticks.ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)""",
        "ticks",
    ),
)
def streamed_bars(spark, folder):
    path = SB.folder(spark, "bars")
    out = SB.stream_bars(_tick_stream(spark, folder), 5, "10 minutes", ("ts", "event_id"))
    SB.run_to_files(out, path)
    return spark.read.schema(out.schema).parquet(path)


@query(
    "R-05 R-07",
    """SELECT symbol, ts, close, CAST(volume AS BIGINT) AS volume FROM (
      SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, value AS close, 1 + event_id % 100 AS volume,
        row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def streamed_corrections(spark, folder):
    path = SB.folder(spark, "bars")
    ticks = _tick_stream(spark, folder).withColumn("ts", F.date_trunc("minute", "ts"))
    bars = ticks.select("symbol", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume", "event_id")
    SB.run_batches(bars, SB.keep_corrected(path, "us", "event_id"), SB.folder(spark, "checkpoint"))
    return SB.bar_log_table(path).read(spark).select("symbol", "ts", "close", "volume")


@query(
    "R-05 R-07 S-12",
    """SELECT symbol, ts, close, CAST(volume AS BIGINT) AS volume FROM (
      SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, value AS close, 1 + event_id % 100 AS volume,
        row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY (event_id * 7919) % 1000003 DESC, value DESC) AS rn FROM events) WHERE rn = 1""",
)
def corrections_out_of_order(spark, folder):
    """Loads whose order numbers are mixed, with a compaction between them, resolved on reading."""
    target = SB.bar_log_table(SB.folder(spark, "bars"))
    rank = (F.col("event_id") * 7919) % 1000003
    ticks = I.ticks(spark, folder).withColumn("rank", rank)
    bars = ticks.select(
        "symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
        "volume", F.lit("").alias("source"), F.lit("us").alias("market"), F.to_date("ts").alias("date"), "rank", "event_id",
    )
    for number in range(3):
        target.append(bars.filter(F.col("event_id") % 3 == number), number, "rank")
        if number == 1:
            target.compact(spark)
    return target.read(spark).select("symbol", "ts", "close", "volume")


@query(
    "R-04 R-03 R-01 P-13",
    # Bars of the second half of the month see the five dates before it, as the stream keeps them.
    with_tables(
        """SELECT symbol, ts, close, round(p, 8) AS peak_prob, round(t, 8) AS trough_prob,
          CAST(CASE WHEN p >= 0.5 AND p >= t THEN 1 WHEN t >= 0.5 AND t > p THEN 2 ELSE 0 END AS TINYINT) AS signal
        FROM (SELECT *, CASE WHEN h > l THEN (close - l) / (h - l) ELSE 0.5 END AS p, 1 - CASE WHEN h > l THEN (close - l) / (h - l) ELSE 0.5 END AS t
          FROM (SELECT *, max(high) OVER w AS h, min(low) OVER w AS l FROM seen
            WINDOW w AS (PARTITION BY symbol, half ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))) WHERE fresh""",
        "sess",
        extra="""past AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r
            FROM (SELECT DISTINCT symbol, date FROM sess WHERE date < DATE '2024-01-16')),
          seen AS (SELECT *, 1 AS half, true AS fresh FROM sess WHERE date < DATE '2024-01-16'
            UNION ALL SELECT *, 2, true FROM sess WHERE date >= DATE '2024-01-16'
            UNION ALL SELECT s.*, 2, false FROM sess s JOIN past p ON s.symbol = p.symbol AND s.date = p.date WHERE p.r <= 5)""",
    ),
)
def streamed_signals(spark, folder):
    out, stoch = SB.folder(spark, "signals"), F.col("tf_stoch")
    stream = _replay(spark, I.minute_bars(spark, folder), "replay")
    each = SB.signals_of_batch(SB.folder(spark, "bars"), out, "us", stoch, 1 - stoch, 0.5)
    SB.run_batches(stream, each, SB.folder(spark, "checkpoint"))
    return rounded(spark.read.parquet(out).drop("batch"), ["peak_prob", "trough_prob"])


@query(
    "R-03",
    with_tables(
        """SELECT symbol, ts, close, CAST(least(5, row_number() OVER (PARTITION BY symbol ORDER BY ts)) AS INTEGER) AS n_bars,
          round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean_close FROM sess""",
        "sess",
    ),
)
def streamed_recent_bars(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    path = SB.folder(spark, "recent")
    stream = _replay(spark, I.session(spark, folder).select("symbol", "ts", "close"), "replay")
    SB.run_to_files(SS.recent_bars(stream, 5), path)
    out = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(out, ["mean_close"], 6)


WALK = """b AS MATERIALIZED (SELECT symbol, ts, close, minutes_from_open AS m, peak_prob AS pp, trough_prob AS tp, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM scored),
  w AS (SELECT symbol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS ts, '' AS action, '' AS reason, CAST(0 AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS pnl, CAST(NULL AS DOUBLE) AS ep
      FROM (SELECT DISTINCT symbol FROM b)
    UNION ALL SELECT symbol, rn, ts, CASE WHEN why IS NOT NULL THEN 'SELL' WHEN buy THEN 'BUY' ELSE '' END, CASE WHEN why IS NOT NULL THEN why WHEN buy THEN 'PEAK_SIGNAL' ELSE '' END,
      close, CASE WHEN why IS NOT NULL THEN (close - ep) / ep ELSE 0 END, CASE WHEN why IS NOT NULL THEN NULL WHEN buy THEN close ELSE ep END
    FROM (SELECT b.*, w.ep, w.ep IS NULL AND m < 270 AND pp >= 0.6 AND pp >= tp AS buy, CASE WHEN w.ep IS NULL THEN NULL WHEN m >= 270 THEN 'FORCE_CLOSE'
        WHEN close / w.ep - 1 <= -0.05 THEN 'STOP_LOSS' WHEN close / w.ep - 1 >= 0.1 THEN 'PROFIT_TARGET' WHEN tp >= 0.6 AND tp > pp THEN 'TROUGH_SIGNAL' END AS why
      FROM w JOIN b ON b.symbol = w.symbol AND b.rn = w.rn + 1))"""


@query(
    "R-06 R-07 R-01",
    with_tables(
        "SELECT symbol, ts, action, reason, price, round(pnl, 8) AS pnl_pct FROM w WHERE action <> ''", "scored", recursive=True, extra=WALK
    ),
)
def streamed_positions(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    path = SB.folder(spark, "events")
    rows = I.scored(spark, folder).select("symbol", "ts", F.col("close").alias("price"), "minutes_from_open", "peak_prob", "trough_prob")
    SB.run_to_files(SS.positions(_replay(spark, rows, "replay"), 0.6), path)
    out = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rounded(out, ["pnl_pct"])
