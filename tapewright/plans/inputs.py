"""Input tables of the registered queries, and the same tables as SQL.

Ticks are events: the event type is the symbol, the value the price. Minute bars, sessions,
contracts and option bars all follow from them, so every query grows with the events table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapewright.functions.contracts import make_symbol, next_week_friday
from tapewright.functions.pricing import LADDER, strike_ladder
from tapewright.operators.bars import bars_from_ticks, daily_bars, resample, session_bars
from tapewright.operators.options import by_day


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("price"),
        (1 + F.col("event_id") % 100).alias("volume"),
        "event_id",
        "user_id",
    )


def minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, folder), order=("ts", "event_id"))


def session(spark: SparkSession, folder: str, market: str = "us") -> DataFrame:
    return session_bars(minute_bars(spark, folder), market)


def _mixed(a: int, b: int, modulus: int):
    minutes = F.unix_seconds(F.col("ts").cast("timestamp")) / 60
    return F.pmod(F.floor(minutes) * a + F.col("volume") * b, F.lit(modulus))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Session bars with deterministic stand-ins for model scores and labels."""
    kind = _mixed(31, 17, 20)
    return session(spark, folder).select(
        "*",
        F.round(_mixed(7919, 104729, 10007) / 10006.0, 4).alias("peak_prob"),
        F.round(_mixed(6101, 15485863, 10009) / 10008.0, 4).alias("trough_prob"),
        F.when(kind < 2, 1).when(kind < 4, 2).otherwise(0).alias("label"),
    )


TIMEFRAMES, LABELS = (1, 5), ("L1", "L2", "L3")


def scored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-ins for the scores of each timeframe and labelling variant, told apart by ``run``."""
    bars = minute_bars(spark, folder)
    sets = []
    for minutes in TIMEFRAMES:
        of = session_bars(bars if minutes == 1 else resample(bars, minutes), "us")
        sets += [
            of.select(
                F.lit(f"{minutes}m {label}").alias("run"), "symbol", "date", "ts", "minutes_from_open", "close",
                F.round(_mixed(7919 + 2 * k, 104729, 10007) / 10006.0, 4).alias("peak_prob"),
                F.round(_mixed(6101 + 2 * k, 15485863, 10009) / 10008.0, 4).alias("trough_prob"),
            )
            for k, label in enumerate(LABELS)
        ]
    return reduce(DataFrame.unionByName, sets)


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of the session with their mean price."""
    return daily_bars(session(spark, folder).drop("date", "minutes_from_open"))


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts listed around each day's close, expiring on the next week's Friday."""
    listed = (
        daily(spark, folder)
        .select("symbol", "date", "close", F.explode(strike_ladder(F.col("close") * 8)).alias("s"))
        .select("symbol", "date", "close", (F.col("s") / 8).alias("strike"), F.explode(F.array(F.lit("P"), F.lit("C"))).alias("cp"))
        .withColumn("expiry", next_week_friday(F.col("date")))
    )
    return (
        listed.groupBy(F.col("symbol").alias("underlying"), "expiry", "cp", "strike")
        .agg(F.min("date").alias("period_start"), F.min_by("close", "date").alias("stock_close"))
        .withColumn("contract", make_symbol(F.col("underlying"), F.col("expiry"), F.col("cp"), F.col("strike")))
    )


def option_ticks(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """Events traded as one of the contracts of their symbol that are active on the day."""
    per_day = Window.partitionBy("underlying", "date")
    active = by_day(contracts(spark, folder) if listed is None else listed).select(
        F.col("underlying").alias("symbol"),
        "date",
        "contract",
        (F.row_number().over(per_day.orderBy("contract")) - 1).cast("long").alias("slot"),
        F.count(F.lit(1)).over(per_day).alias("n_active"),
    )
    sizes = active.groupBy("symbol", "date").agg(F.max("n_active").alias("n_active"))
    placed = (
        ticks(spark, folder)
        .withColumn("date", F.to_date("ts"))
        .join(sizes, ["symbol", "date"])
        .withColumn("slot", (F.col("event_id") * 7 + F.col("user_id")) % F.col("n_active"))
    )
    return placed.join(active.drop("n_active"), ["symbol", "date", "slot"]).select(
        "contract",
        "symbol",
        "ts",
        (F.col("price") / 10 + 0.5).alias("price"),
        (F.col("event_id") % 4).alias("volume"),
        "event_id",
    )


def option_bars(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    return bars_from_ticks(option_ticks(spark, folder, listed), keys=("contract", "symbol"), order=("ts", "event_id"))


# --- the same tables for the SQL twins ---------------------------------------------------------

_TICK = "CASE WHEN {p} >= 100000 THEN 2500.0 WHEN {p} >= 50000 THEN 1000.0 WHEN {p} >= 10000 THEN 500.0 WHEN {p} >= 1000 THEN 100.0 WHEN {p} >= 100 THEN 5.0 ELSE 1.0 END"
_MIN = "CAST(floor(epoch(ts) / 60) AS BIGINT)"
_OHLCV = (
    "arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, "
    "CAST(sum(volume) AS BIGINT) AS volume"
)
FRIDAY = "CAST({d} + CAST(((4 - (isodow({d}) - 1)) % 7 + 7) % 7 + 7 AS INTEGER) AS DATE)"
_STEPS = "[" + ", ".join(f"CAST({1 + p} AS DOUBLE)" for p in LADDER) + "]"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": (
        (),
        "SELECT event_type AS symbol, ts, value AS price, CAST(1 + event_id % 100 AS BIGINT) AS volume, event_id, user_id FROM events",
    ),
    "bars": (("ticks",), f"SELECT symbol, date_trunc('minute', ts) AS ts, {_OHLCV} FROM ticks GROUP BY 1, date_trunc('minute', ts)"),
    "sess": (
        ("bars",),
        "SELECT *, CAST(ts AS DATE) AS date, CAST(hour(ts) * 60 + minute(ts) - 570 AS INTEGER) AS minutes_from_open "
        "FROM bars WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960",
    ),
    "scored": (
        ("sess",),
        f"""SELECT *,
          round((({_MIN} * 7919 + volume * 104729) % 10007) / CAST(10006.0 AS DOUBLE), 4) AS peak_prob,
          round((({_MIN} * 6101 + volume * 15485863) % 10009) / CAST(10008.0 AS DOUBLE), 4) AS trough_prob,
          CASE WHEN ({_MIN} * 31 + volume * 17) % 20 < 2 THEN 1 WHEN ({_MIN} * 31 + volume * 17) % 20 < 4 THEN 2 ELSE 0 END AS label
          FROM sess""",
    ),
    "five": (
        ("sess",),
        "SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, "
        "min(date) AS date, CAST(floor(min(minutes_from_open) / 5) * 5 AS INTEGER) AS minutes_from_open FROM sess GROUP BY 1, 2",
    ),
    "scored_runs": (
        ("five",),
        f"""SELECT tf || ' ' || label AS run, symbol, date, ts, minutes_from_open, close,
          round((({_MIN} * (7919 + 2 * k) + volume * 104729) % 10007) / CAST(10006.0 AS DOUBLE), 4) AS peak_prob,
          round((({_MIN} * (6101 + 2 * k) + volume * 15485863) % 10009) / CAST(10008.0 AS DOUBLE), 4) AS trough_prob
          FROM (SELECT '1m' AS tf, symbol, date, ts, minutes_from_open, close, volume FROM sess UNION ALL SELECT '5m', symbol, date, ts, minutes_from_open, close, volume FROM five),
            (VALUES (0, 'L1'), (1, 'L2'), (2, 'L3')) v(k, label)""",
    ),
    "daily": (
        ("sess",),
        "SELECT *, (open + high + low + close) / 4 AS avg_price FROM (SELECT symbol, date, arg_min(open, ts) AS open, max(high) AS high, "
        "min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM sess GROUP BY 1, 2)",
    ),
    "ladders": (
        ("daily",),
        f"""SELECT symbol, date, close, unnest(list_distinct(list_filter(list_transform({_STEPS},
            lambda s: round_even(money * s / tick, 0) * tick), lambda s: s > 0))) AS s
          FROM (SELECT *, round_even(close * 8 / tick, 0) * tick AS money
                FROM (SELECT symbol, date, close, CAST({_TICK.format(p='close * 8')} AS DOUBLE) AS tick FROM daily))""",
    ),
    "contracts": (
        ("ladders",),
        f"""SELECT *, rpad(upper(underlying), CAST(greatest(length(underlying), 6) + 1 AS INTEGER), ' ') || strftime(expiry, '%y%m%d') || cp
              || lpad(CAST(CAST(round(strike * 1000) AS BIGINT) AS VARCHAR), 8, '0') AS contract
          FROM (SELECT symbol AS underlying, {FRIDAY.format(d='date')} AS expiry, cp, s / 8 AS strike,
                  min(date) AS period_start, arg_min(close, date) AS stock_close
                FROM ladders, (VALUES ('P'), ('C')) v(cp) GROUP BY 1, 2, 3, 4)""",
    ),
    "active": (
        ("contracts",),
        "SELECT c.*, CAST(d.d AS DATE) AS date FROM contracts c, generate_series(DATE '2023-12-01', DATE '2024-03-31', INTERVAL 1 DAY) d(d) "
        "WHERE c.period_start <= d.d AND d.d < c.expiry",
    ),
    "option_ticks": (
        ("ticks", "active"),
        """SELECT s.contract, t.symbol, t.ts, t.price / 10 + 0.5 AS price, t.event_id % 4 AS volume, t.event_id
          FROM (SELECT underlying, date, contract, row_number() OVER (PARTITION BY underlying, date ORDER BY contract) - 1 AS slot,
                  count(*) OVER (PARTITION BY underlying, date) AS n FROM active) s
          JOIN ticks t ON t.symbol = s.underlying AND CAST(t.ts AS DATE) = s.date AND (t.event_id * 7 + t.user_id) % s.n = s.slot""",
    ),
    "option_bars": (
        ("option_ticks",),
        f"SELECT contract, symbol, date_trunc('minute', ts) AS ts, {_OHLCV} FROM option_ticks GROUP BY 1, 2, date_trunc('minute', ts)",
    ),
}


def with_tables(body: str, *needs: str, recursive: bool = False, extra: str = "") -> str:
    """``body`` behind the CTEs it needs, in order of dependence; ``extra`` holds further CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
