"""Queries on bar tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions.columns import between_dates, pad_code, to_market_time
from tapewright.operators import bars as B
from tapewright.operators.features import add_index_features, bar_numbers, build_features
from tapewright.operators.joins import rounded
from tapewright.operators.ordered import asof_join
from tapewright.operators.summaries import market_summary, volume_cap
from tapewright.plans.inputs import daily, minute_bars, scored, session, table, ticks, with_tables
from tapewright.plans.registry import query

BINS5 = "time_bucket(INTERVAL 5 MINUTE, ts)"


@query(
    "A-01 P-02 P-20 W-01 W-02 W-14",
    with_tables(
        f"""SELECT symbol, date, ts, open, high, low, close, volume,
          round((close - o) / o, 8) AS pf_open_return, round(close / lag(close, 1) OVER s - 1, 8) AS pf_return_1m,
          round(close / lag(close, 5) OVER s - 1, 8) AS pf_return_5m,
          round((close - pv / v) / o, 8) AS vf_vwap_dev
        FROM (SELECT *, first_value(open) OVER d AS o, sum(close * volume) OVER d AS pv, sum(volume) OVER d AS v
              FROM five WINDOW d AS (PARTITION BY symbol, date ORDER BY ts))
        WINDOW s AS (PARTITION BY symbol, year(date) ORDER BY ts)""",
        "sess",
        extra=f"""five AS (SELECT symbol, CAST({BINS5} AS DATE) AS date, {BINS5} AS ts, arg_min(open, ts) AS open, max(high) AS high,
          min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM sess GROUP BY 1, 2, 3)""",
    ),
)
def five_minute_signals(spark, folder):
    five = B.session_bars(B.resample(minute_bars(spark, folder)), "us")
    names = ["pf_open_return", "pf_return_1m", "pf_return_5m", "vf_vwap_dev"]
    return rounded(build_features(five), names).select("symbol", "date", "ts", "open", "high", "low", "close", "volume", *names)


@query("A-01 A-03", with_tables("SELECT symbol, ts, open, high, low, close, volume FROM bars", "bars"))
def bars_from_ticks(spark, folder):
    return minute_bars(spark, folder)


@query(
    "A-01 S-03",
    with_tables(
        f"""SELECT b.symbol, ts, open, high, low, close, volume, source FROM
          (SELECT symbol, {BINS5} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
             arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, {BINS5}) b
        JOIN (SELECT symbol, 'feed' || arg_min(volume % 3, ts) AS source FROM bars GROUP BY 1) f ON b.symbol = f.symbol""",
        "bars",
    ),
)
def bars_resampled(spark, folder):
    src = F.concat(F.lit("feed"), (F.col("volume") % 3).cast("string"))
    return B.resample(minute_bars(spark, folder).withColumn("source", src))


@query("P-02 P-19 F-09", with_tables("SELECT symbol, ts, open, high, low, close, volume, date, minutes_from_open FROM sess", "sess"))
def bars_session(spark, folder):
    return session(spark, folder)


VENUE = "CASE WHEN event_id % 3 = 0 THEN 'XNAS.ITCH' WHEN event_id % 3 = 1 THEN 'XNYS.PILLAR' ELSE 'ARCX.PILLAR' END"


@query(
    "A-03 P-04 U-01",
    with_tables(
        f"""SELECT symbol, m AS ts, arg_min(open, k) AS open, max(high) AS high, min(low) AS low, arg_max(close, k) AS close,
          CAST(sum(volume) AS BIGINT) AS volume
        FROM (SELECT *, venue * 1000000000000 + epoch_us(ts) % 60000000 AS k FROM v) GROUP BY 1, m""",
        extra="""v AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS m, ts, value AS open, value AS high, value AS low, value AS close,
          event_id % 5 AS volume, event_id % 3 AS venue FROM events WHERE event_id % 5 > 0)""",
    ),
)
def bars_of_venues(spark, folder):
    v = F.when(F.col("event_id") % 3 == 0, "XNAS.ITCH").when(F.col("event_id") % 3 == 1, "XNYS.PILLAR").otherwise("ARCX.PILLAR")
    rows = ticks(spark, folder).select(
        "symbol", "ts", v.alias("venue"), *[F.col("price").alias(c) for c in B.PRICES], (F.col("event_id") % 5).alias("volume")
    )
    return B.merge_venues(rows)


LOAD = "symbol, ts, open, high, low, close, volume"


@query(
    "A-02 S-12 U-01 P-01 K-01",
    with_tables(
        """SELECT symbol, ts, open, high, low, close, volume, source FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY load DESC) AS rn FROM (
            SELECT *, 'base' AS source, 0 AS load FROM bars WHERE volume % 3 < 2
            UNION ALL SELECT symbol, ts, open, high, low, close + 1, volume, 'fresh', 1 FROM bars WHERE volume % 3 > 0)) WHERE rn = 1""",
        "bars",
    ),
)
def bars_merged_loads(spark, folder):
    bars = minute_bars(spark, folder)
    old = B.normalise(bars.filter(F.col("volume") % 3 < 2), "base")
    new = B.normalise(bars.filter(F.col("volume") % 3 > 0).withColumn("close", F.col("close") + 1), "fresh")
    return B.merge_loads(old, new)


@query(
    "U-04 P-01",
    with_tables(
        """SELECT symbol, ts, open, high, low, close, volume, source FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY rank DESC) AS rn FROM (
            SELECT *, 'base' AS source, 0 AS rank FROM bars
            UNION ALL SELECT *, 'overlay', 1 FROM bars WHERE volume % 2 = 0
            UNION ALL SELECT *, 'premium', 2 FROM bars WHERE volume % 5 = 0)) WHERE rn = 1""",
        "bars",
    ),
)
def bars_source_precedence(spark, folder):
    bars = minute_bars(spark, folder)
    parts = [("base", bars), ("overlay", bars.filter(F.col("volume") % 2 == 0)), ("premium", bars.filter(F.col("volume") % 5 == 0))]
    return B.by_precedence([(i, B.normalise(df, name)) for i, (name, df) in enumerate(parts)])


@query(
    "S-24 P-01 P-04",
    """SELECT event_type AS symbol, ts, value AS open, value AS high, value AS low, value AS close,
      CAST(coalesce(CASE WHEN event_id % 7 > 0 THEN event_id % 7 END, 0) AS BIGINT) AS volume, 'vendor' AS source FROM events""",
)
def bars_vendor_columns(spark, folder):
    raw = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("Datetime"),
        *[F.col("value").alias(c) for c in ("Open", "High", "Low", "Close")],
        F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 7).alias("Volume"),
    )
    return B.normalise(B.rename_vendor(raw), "vendor")


@query(
    "P-03",
    """SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS eastern,
      ts AT TIME ZONE 'Asia/Seoul' AT TIME ZONE 'America/New_York' AS from_seoul FROM events""",
)
def clock_conversion(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        to_market_time(F.col("ts"), "UTC", "America/New_York").alias("eastern"),
        to_market_time(F.col("ts"), "Asia/Seoul", "America/New_York").alias("from_seoul"),
    )


@query(
    "P-05",
    with_tables("SELECT symbol, ts, date, close FROM (SELECT *, count(*) OVER (PARTITION BY symbol, date) AS n FROM sess) WHERE n >= 10", "sess"),
)
def bars_full_days(spark, folder):
    return B.full_days(session(spark, folder)).select("symbol", "ts", "date", "close")


@query(
    "P-06 P-16 S-01 S-07",
    with_tables(
        """SELECT symbol, count(*) FILTER (ts >= '2024-01-10' AND ts < '2024-01-16') AS whole_day,
          count(*) FILTER (ts >= '2024-01-10' AND ts <= '2024-01-15') AS at_midnight,
          count(*) FILTER (ts >= '2024-01-10' AND ts < '2024-01-15') AS before_day,
          count(*) FILTER (ts >= '2024-01-10' AND ts <= '2024-01-16') AS next_midnight,
          count(*) AS n FROM bars GROUP BY 1""",
        "bars",
    ),
)
def bars_date_ranges(spark, folder):
    ts = F.col("ts")
    named = {"whole_day": "day", "at_midnight": "midnight", "before_day": "open", "next_midnight": "next_midnight"}
    return (
        minute_bars(spark, folder)
        .groupBy("symbol")
        .agg(
            *[F.count_if(between_dates(ts, "2024-01-10", "2024-01-15", how)).alias(c) for c, how in named.items()],
            F.count(F.lit(1)).alias("n"),
        )
    )


RECENT = "(SELECT DISTINCT symbol, date FROM sess)"


@query(
    "P-15 K-03 R-03",
    with_tables(
        f"""SELECT s.symbol, s.ts, s.date, s.close, d.r = 1 AS is_target FROM sess s JOIN
          (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM {RECENT}) d
          ON s.symbol = d.symbol AND s.date = d.date WHERE d.r <= 6""",
        "sess",
    ),
)
def recent_history(spark, folder):
    return B.recent_dates(session(spark, folder)).select("symbol", "ts", "date", "close", "is_target")


@query(
    "P-18",
    with_tables(
        f"""SELECT symbol, date FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS r FROM {RECENT})
          WHERE r > 5 AND date >= DATE '2024-01-03' AND date <= DATE '2024-01-25'""",
        "sess",
    ),
)
def replay_dates(spark, folder):
    return B.replay_dates(session(spark, folder), 5, "2024-01-03", "2024-01-25")


@query(
    "U-02",
    with_tables(
        f"""SELECT date, count(*) AS n_symbols FROM {RECENT} GROUP BY 1
          HAVING count(*) = (SELECT count(DISTINCT symbol) FROM sess)""",
        "sess",
    ),
)
def common_dates(spark, folder):
    return B.common_dates(session(spark, folder))


@query("A-33 K-01", with_tables("SELECT DISTINCT symbol, CAST(ts AS DATE) AS date FROM bars", "bars"))
def trading_dates(spark, folder):
    return minute_bars(spark, folder).select("symbol", F.to_date("ts").alias("date")).distinct()


@query(
    "A-05 S-26",
    """SELECT symbol, CAST(sum(n) AS BIGINT) AS bar_count, min(ts) AS first_ts, max(ts) AS last_ts,
      CAST(sum(n) - sum(p) AS BIGINT) AS null_open, CAST(0 AS BIGINT) AS null_high, CAST(0 AS BIGINT) AS null_low, CAST(0 AS BIGINT) AS null_close,
      CAST(0 AS BIGINT) AS null_volume, CAST(sum(neg) AS BIGINT) AS negative_prices, round(sum(z) / sum(n), 8) AS zero_volume_share,
      CAST(sum(n) - count(*) AS BIGINT) AS duplicate_ts, sum(neg) = 0 AND sum(n) = count(*) AS valid
    FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, count(*) AS n,
            count(CASE WHEN event_id % 11 > 0 THEN value END) AS p, count(*) FILTER (value < 1) AS neg,
            count(*) FILTER (event_id % 4 = 0) AS z FROM events GROUP BY 1, date_trunc('hour', ts)) GROUP BY 1""",
)
def bar_validation(spark, folder):
    hour = F.col("ts") - F.make_dt_interval(mins=F.minute("ts"), secs=F.extract(F.lit("SECOND"), F.col("ts")))
    raw = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        hour.alias("ts"),
        F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("open"),
        F.col("value").alias("high"),
        (F.col("value") - 1).alias("low"),
        F.col("value").alias("close"),
        (F.col("event_id") % 4).alias("volume"),
    )
    return rounded(B.validate_bars(raw), ["zero_volume_share"])


@query(
    "A-06",
    with_tables(
        """SELECT symbol, count(*) AS total_days, count(*) FILTER (n >= 16) AS full_days, count(*) FILTER (n < 16) AS short_days,
          round(avg(n), 8) AS avg_bars_per_day, CAST(sum(n) AS BIGINT) AS total_bars
        FROM (SELECT symbol, date, count(*) AS n FROM sess GROUP BY 1, 2) GROUP BY 1""",
        "sess",
    ),
)
def session_validation(spark, folder):
    return rounded(B.validate_sessions(session(spark, folder), expected=20), ["avg_bars_per_day"])


@query("A-06", with_tables("SELECT symbol, date, count(*) AS n FROM sess GROUP BY 1, 2 HAVING count(*) < 16", "sess"))
def session_short_days(spark, folder):
    return B.short_days(session(spark, folder), expected=20)


@query(
    "A-09 S-21",
    with_tables(
        """SELECT 'us' AS market, count(DISTINCT symbol) AS n_symbols, count(*) AS total_bars, min(CAST(ts AS DATE)) AS first_date,
          max(CAST(ts AS DATE)) AS last_date FROM bars""",
        "bars",
    ),
)
def raw_market_summary(spark, folder):
    return market_summary(minute_bars(spark, folder).withColumn("market", F.lit("us")))


@query(
    "A-17",
    with_tables(
        """SELECT b.symbol, round(cap, 8) AS cap, coalesce(avg(volume) FILTER (volume > cap) > 2 * cap, false) AS has_outliers
        FROM bars b JOIN (SELECT symbol, quantile_cont(CAST(volume AS DOUBLE), 0.95) AS cap FROM bars GROUP BY 1) q ON b.symbol = q.symbol
        GROUP BY 1, cap""",
        "bars",
    ),
)
def volume_outlier_cap(spark, folder):
    return rounded(volume_cap(minute_bars(spark, folder)), ["cap"])


@query(
    "W-27",
    with_tables(
        """SELECT s.symbol, prev + to_microseconds(CAST(median * 1000000 AS BIGINT)) AS gap_start, round(step - median, 6) AS gap_seconds
        FROM s JOIN (SELECT symbol, quantile_cont(step, 0.5) AS median FROM s GROUP BY 1) m ON s.symbol = m.symbol
        WHERE step > 2 * median""",
        "bars",
        extra="""s AS (SELECT symbol, prev, CAST(epoch(ts) - epoch(prev) AS DOUBLE) AS step
          FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars) WHERE prev IS NOT NULL)""",
    ),
)
def bar_gaps(spark, folder):
    return rounded(B.gaps(minute_bars(spark, folder)), ["gap_seconds"], 6)


@query("A-32", with_tables("SELECT symbol, date, open, high, low, close, volume, round(avg_price, 8) AS avg_price FROM daily", "daily"))
def daily_mean_price(spark, folder):
    return rounded(daily(spark, folder), ["avg_price"])


BRAND = """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS qty,
  l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query(
    "A-32 A-01",
    f"""SELECT symbol, date, round(max(price), 8) AS high, round(min(price), 8) AS low, CAST(sum(qty) AS DOUBLE) AS volume, count(*) AS n
      FROM ({BRAND}) GROUP BY 1, 2""",
)
def daily_brand_range(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity")
    # High, low, volume and count merge, so lines shrink to one row per part and day before the join.
    small = lines.groupBy("l_partkey", "date").agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    out = small.join(part, "l_partkey").groupBy("symbol", "date").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").cast("double").alias("volume"), F.sum("n").alias("n")
    )
    return rounded(out, ["high", "low"])


@query(
    "W-28",
    with_tables(
        f"""SELECT symbol, date, coalesce(lead(date) OVER (PARTITION BY symbol ORDER BY date), date + 1) AS next_date FROM {RECENT}""", "sess"
    ),
)
def trading_day_pairs(spark, folder):
    return B.next_days(session(spark, folder))


@query(
    "W-29",
    with_tables("SELECT symbol, ts, row_number() OVER (PARTITION BY symbol, date ORDER BY ts) AS bar_num FROM sess", "sess").replace(
        "row_number() OVER (PARTITION BY symbol, date ORDER BY ts) AS", "CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY ts) AS INTEGER) AS"
    ),
)
def session_bar_numbers(spark, folder):
    return bar_numbers(session(spark, folder)).select("symbol", "ts", "bar_num")


@query(
    "J-08",
    with_tables(
        """SELECT d.symbol, d.date, CASE WHEN b.date >= d.date - 6 THEN b.close END AS close_before FROM
          (SELECT DISTINCT symbol, CAST(date_trunc('week', date) AS DATE) AS date FROM sess) d
          ASOF LEFT JOIN daily b ON d.symbol = b.symbol AND d.date >= b.date""",
        "sess", "daily",
    ),
)
def week_start_close(spark, folder):
    days = session(spark, folder).select("symbol", F.date_sub("date", F.weekday("date")).alias("date")).distinct()
    closes = daily(spark, folder).select("symbol", "date", F.col("close").alias("close_before"))
    return asof_join(days, closes, ["symbol"], ["close_before"], "date", "date", tolerance="6 DAYS")


@query(
    "U-05",
    with_tables(
        """SELECT u.symbol, coalesce(h.last + 1, DATE '2020-01-01') AS range_start, DATE '2024-01-31' AS range_end
        FROM (SELECT DISTINCT symbol FROM bars UNION SELECT p_brand FROM part) u
        LEFT JOIN (SELECT symbol, max(CAST(ts AS DATE)) AS last FROM bars WHERE volume % 2 = 0 GROUP BY 1) h ON u.symbol = h.symbol
        WHERE coalesce(h.last + 1, DATE '2020-01-01') <= DATE '2024-01-31'""",
        "bars",
    ),
)
def ranges_to_load(spark, folder):
    bars = minute_bars(spark, folder)
    universe = bars.select("symbol").union(table(spark, folder, "part").select("p_brand"))
    return B.missing_ranges(bars.filter(F.col("volume") % 2 == 0), "2024-01-31", "2020-01-01", universe)


@query(
    "S-02 F-10",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 6, '0') ELSE p_brand END AS code FROM part",
)
def symbol_codes(spark, folder):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_brand"))
    return table(spark, folder, "part").select("p_partkey", pad_code(raw).alias("code"))


@query(
    "J-10 U-03",
    with_tables("SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars WHERE close > 400)", "bars"),
)
def symbols_without_premium(spark, folder):
    bars = minute_bars(spark, folder)
    premium = bars.filter(F.col("close") > 400).select("symbol")
    return bars.select("symbol").distinct().join(premium.distinct(), "symbol", "left_anti")


@query(
    "U-03",
    with_tables("SELECT symbol, date FROM sess EXCEPT SELECT symbol, date FROM scored WHERE label = 1", "sess", "scored"),
)
def days_without_peaks(spark, folder):
    days = session(spark, folder).select("symbol", "date").distinct()
    return days.exceptAll(scored(spark, folder).filter(F.col("label") == 1).select("symbol", "date").distinct())


@query(
    "W-24 J-02",
    with_tables(
        """SELECT b.symbol, b.ts, CASE WHEN i.ts >= b.ts - INTERVAL 2 MINUTE THEN round(i.r1, 8) END AS mf_idx_return_1m,
          CASE WHEN i.ts >= b.ts - INTERVAL 2 MINUTE THEN round(i.r3, 8) END AS mf_idx_return_3m,
          CASE WHEN i.ts >= b.ts - INTERVAL 2 MINUTE THEN round(i.r5, 8) END AS mf_idx_return_5m,
          CASE WHEN i.ts >= b.ts - INTERVAL 2 MINUTE THEN round(i.r10, 8) END AS mf_idx_return_10m,
          CASE WHEN i.ts >= b.ts - INTERVAL 2 MINUTE THEN round(i.vol, 8) END AS mf_idx_volatility
        FROM sess b ASOF LEFT JOIN (
          SELECT *, CASE WHEN count(r1) OVER w = 10 THEN stddev_samp(r1) OVER w END AS vol FROM (
            SELECT ts, 'us' AS market, close / lag(close, 1) OVER t - 1 AS r1, close / lag(close, 3) OVER t - 1 AS r3,
              close / lag(close, 5) OVER t - 1 AS r5, close / lag(close, 10) OVER t - 1 AS r10 FROM idx WINDOW t AS (ORDER BY ts))
          WINDOW w AS (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) i ON b.ts >= i.ts""",
        "sess",
        extra=f"idx AS (SELECT {BINS5} AS ts, arg_max(price, ts) AS close FROM ticks GROUP BY {BINS5})",
    ),
)
def index_features(spark, folder):
    index = B.bars_from_ticks(ticks(spark, folder).withColumn("market", F.lit("us")), 5, ("market",), ("ts", "event_id"))
    out = add_index_features(session(spark, folder).withColumn("market", F.lit("us")), index)
    names = [c for c in out.columns if c.startswith("mf_")]
    return rounded(out, names).select("symbol", "ts", *names)
