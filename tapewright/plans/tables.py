"""Queries on stored tables, ledgers and lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapewright.operators import splits as S
from tapewright.operators import summaries as M
from tapewright.operators.bars import merge_loads
from tapewright.operators.features import build_features
from tapewright.operators.joins import rounded
from tapewright.operators.labels import label_bars
from tapewright.params import label_variant
from tapewright.plans import inputs as I
from tapewright.plans.inputs import table, with_tables
from tapewright.plans.registry import query
from tapewright.session import shared_folder, stage
from tapewright.sources import tables as ST
from tapewright.sources.optiontables import OptionStore


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S-01 S-12 P-06 K-01",
    with_tables(
        """SELECT symbol, ts, open, high, low, close, volume, 'feed' AS source FROM bars
        WHERE symbol IN ('click', 'view') AND ts >= '2024-01-05' AND ts < '2024-01-21'""",
        "bars",
    ),
)
def stored_bars_scanned(spark, folder):
    path = _path(spark, "bars")
    ST.save_bars(I.minute_bars(spark, folder), path, "us", "feed")
    out = ST.read_table(spark, path, "us", ["click", "view"], "2024-01-05", "2024-01-20", schema=ST.BAR_SCHEMA)
    return out.select("symbol", "ts", "open", "high", "low", "close", "volume", "source")


@query(
    "S-12 A-02 R-05",
    with_tables(
        """SELECT symbol, ts, CASE WHEN volume % 3 = 0 THEN close + 1 ELSE close END AS close, volume,
          CASE WHEN volume % 3 = 0 THEN 'fresh' ELSE 'base' END AS source FROM bars WHERE volume % 3 < 2""",
        "bars",
    ),
)
def stored_bars_merged(spark, folder):
    path, bars = _path(spark, "bars"), I.minute_bars(spark, folder)
    ST.save_bars(bars.filter(F.col("volume") % 3 < 2), path, "us", "base")
    ST.save_bars(bars.filter(F.col("volume") % 3 == 0).withColumn("close", F.col("close") + 1), path, "us", "fresh")
    return ST.read_table(spark, path, schema=ST.BAR_SCHEMA).select("symbol", "ts", "close", "volume", "source")


@query(
    "S-03 A-01 S-12",
    with_tables(
        """SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
          CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT symbol, ts, open, high, low, CASE WHEN volume % 3 = 0 THEN close + 1 ELSE close END AS close, volume FROM bars)
        WHERE symbol IN ('click', 'view') AND ts >= '2024-01-05' AND ts < '2024-01-21' GROUP BY 1, 2""",
        "bars",
    ),
)
def stored_five_minutes_scanned(spark, folder):
    """Two loads of minutes, the second of which changes windows that the first has filled."""
    minutes, fives, bars = _path(spark, "bars"), _path(spark, "bars-5m"), I.minute_bars(spark, folder)
    later = bars.filter(F.col("volume") % 3 == 0).withColumn("close", F.col("close") + 1)
    for load in (bars.filter(F.col("volume") % 3 > 0), later):
        ST.save_bars(load, minutes, "us")
        ST.save_resampled(load, minutes, fives, "us")
    out = ST.read_table(spark, fives, "us", ["click", "view"], "2024-01-05", "2024-01-20", schema=ST.BAR_SCHEMA)
    return out.select("symbol", "ts", "open", "high", "low", "close", "volume")


def _option_store(spark, folder, bars=True, contracts=False):
    """Two loads of bars, of contracts, or of both; the second corrects a part of the first."""
    store = OptionStore(_path(spark, "options"), buckets=2)
    listed = stage(I.contracts(spark, folder), "contracts")
    if bars:
        rows = stage(I.option_bars(spark, folder, listed), "option_bars")
        store.save_bars(rows, "base")
        store.save_bars(rows.filter(F.col("volume") % 3 == 0).withColumn("close", F.col("close") + 1), "fresh")
    if contracts:
        store.save_contracts(listed)
        store.save_contracts(listed.filter(F.col("cp") == "C").withColumn("stock_close", F.col("stock_close") + 1))
    return store


KEPT = """kept AS (SELECT contract, symbol AS underlying, CAST(ts AS DATE) AS day, ts, CASE WHEN volume % 3 = 0 THEN close + 1 ELSE close END AS close, volume,
  CASE WHEN volume % 3 = 0 THEN 'fresh' ELSE 'base' END AS source FROM option_bars),
  terms AS (SELECT contract, underlying, expiry, cp, strike, CASE WHEN cp = 'C' THEN stock_close + 1 ELSE stock_close END AS stock_close FROM contracts)"""


@query("S-16 A-02", with_tables("SELECT underlying, day, contract, ts, round(close, 8) AS close, volume, source FROM kept", "option_bars", extra=KEPT))
def stored_option_bars_merged(spark, folder):
    return rounded(_option_store(spark, folder).bars(spark).select("underlying", "day", "contract", "ts", "close", "volume", "source"), ["close"])


@query("S-17", with_tables("SELECT contract, underlying, expiry, cp, strike, round(stock_close, 8) AS stock_close FROM terms", "option_bars", extra=KEPT))
def stored_contracts_merged(spark, folder):
    return rounded(_option_store(spark, folder, bars=False, contracts=True).contracts(spark).select("contract", "underlying", "expiry", "cp", "strike", "stock_close"), ["stock_close"])


@query(
    "S-08 S-22",
    with_tables(
        """SELECT k.underlying, k.contract, k.ts, round(k.close, 8) AS close, t.strike, t.expiry, t.cp FROM kept k JOIN terms t ON k.contract = t.contract
        WHERE k.underlying IN ('click', 'signup')""",
        "option_bars", extra=KEPT,
    ),
)
def stored_options_of_underlyings(spark, folder):
    out = _option_store(spark, folder, contracts=True).bars_with_contracts(spark, ["click", "signup"])
    return rounded(out.select("underlying", "contract", "ts", "close", "strike", "expiry", "cp"), ["close"])


@query(
    "S-09",
    with_tables(
        """SELECT k.underlying, k.day, k.contract, k.ts, round(k.close, 8) AS close FROM kept k JOIN daily d ON k.underlying = d.symbol AND k.day = d.date
        WHERE d.volume % 3 = 1""",
        "option_bars", "daily", extra=KEPT,
    ),
)
def stored_options_of_days(spark, folder):
    store = _option_store(spark, folder)
    days = I.daily(spark, folder).filter(F.col("volume") % 3 == 1).select(F.col("symbol").alias("underlying"), F.col("date").alias("day"))
    return rounded(store.bars_of_days(stage(days, "days")).select("underlying", "day", "contract", "ts", "close"), ["close"])


@query("S-09 A-34", with_tables("SELECT contract, day, count(*) AS n_bars FROM kept GROUP BY 1, 2", "option_bars", extra=KEPT))
def stored_option_days_counted(spark, folder):
    return _option_store(spark, folder).traded_days(spark)


@query("S-22", with_tables("SELECT underlying, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM (SELECT DISTINCT underlying, day FROM kept) GROUP BY 1", "option_bars", extra=KEPT))
def stored_underlyings(spark, folder):
    return _option_store(spark, folder).underlyings(spark)


@query(
    "S-22 S-07",
    with_tables(
        """SELECT split_part(run, ' ', 1) AS timeframe, split_part(run, ' ', 2) AS label_config, count(DISTINCT symbol) AS n_symbols, min(date) AS first_date,
          max(date) AS last_date, count(*) AS n_rows FROM scored_runs GROUP BY 1, 2""",
        "scored_runs",
    ),
)
def stored_variants(spark, folder):
    path = _path(spark, "predictions")
    rows = I.scored_runs(spark, folder).withColumns(
        {"market": F.lit("us"), "timeframe": F.split("run", " ")[0], "label_config": F.split("run", " ")[1]}
    )
    ST.write_table(rows, path)
    return ST.variants(ST.read_table(spark, path, "us"))


@query("S-25", with_tables("SELECT symbol, date, count(*) AS n_rows FROM scored GROUP BY 1, 2", "scored"))
def stored_result_contents(spark, folder):
    path = _path(spark, "result")
    ST.write_result(I.scored(spark, folder).select("symbol", "ts", "peak_prob"), path)
    return ST.result_contents(ST.read_result(spark, path))


@query(
    "S-26 A-05 A-11",
    with_tables(
        """SELECT symbol, 'MULTI' AS exchange, 'feed' AS source, 'us' AS market, min(CAST(ts AS DATE)) AS start_date, max(CAST(ts AS DATE)) AS end_date,
          count(*) AS bar_count, 'complete' AS status, CAST(NULL AS VARCHAR) AS error_message FROM bars GROUP BY 1""",
        "bars",
    ),
)
def load_saved_and_tracked(spark, folder):
    ledger = _ledger(spark, folder).limit(0)
    return ST.save_and_track(I.minute_bars(spark, folder), _path(spark, "bars"), "us", "feed", ledger, "MULTI")


@query("S-13 S-04", with_tables("SELECT symbol, ts, label FROM scored WHERE symbol = 'error' AND CAST(ts AS DATE) >= DATE '2024-01-10'", "scored"))
def stored_labels_scanned(spark, folder):
    path = _path(spark, "labelled")
    rows = I.scored(spark, folder).withColumns({"market": F.lit("us"), "label_config": F.lit("L2"), "timeframe": F.lit("1m")})
    ST.write_table(rows, path)
    return ST.read_table(spark, path, "us", ["error"], start="2024-01-10", label_config="L2", timeframe="1m").select("symbol", "ts", "label")


@query("S-14 S-05 S-20", with_tables("SELECT 'us' AS market, symbol, 2024 AS year, count(*) AS n_rows FROM sess GROUP BY 1, 2", "sess"))
def stored_features_counted(spark, folder):
    path = _path(spark, "featured")
    ST.write_table(build_features(I.session(spark, folder)).withColumn("market", F.lit("us")), path)
    return ST.partition_counts(spark, path)


@query("A-37 S-23", with_tables("SELECT count(*) AS n_rows, 51 AS n_features, count(DISTINCT symbol) AS n_files, true AS has_bytes FROM sess", "sess"))
def stored_features_size(spark, folder):
    """One file a symbol and year; bytes depend on the writer, so the twin only says that there are some for each row."""
    path = _path(spark, "featured")
    ST.write_table(build_features(I.session(spark, folder)).withColumn("market", F.lit("us")), path)
    return ST.table_size(spark, path).select("n_rows", "n_features", "n_files", (F.col("n_bytes") > F.col("n_rows")).alias("has_bytes"))


@query(
    "S-15 S-07",
    with_tables(
        """SELECT symbol, ts, peak_prob FROM scored WHERE symbol IN ('click', 'signup') AND ts >= '2024-01-08' AND ts <= '2024-01-13'""", "scored"
    ),
)
def stored_predictions_scanned(spark, folder):
    path = _path(spark, "predictions")
    rows = I.scored(spark, folder).withColumns({"market": F.lit("us"), "model_type": F.lit("gbm")})
    ST.write_table(rows, path)
    out = ST.read_table(spark, path, "us", ["click", "signup"], "2024-01-08", "2024-01-12", "next_midnight", model_type="gbm")
    return out.select("symbol", "ts", "peak_prob")


@query("S-22", with_tables("SELECT DISTINCT 'us' AS market, symbol, 2024 AS year FROM bars", "bars"))
def stored_catalogue(spark, folder):
    path = _path(spark, "bars")
    ST.save_bars(I.minute_bars(spark, folder), path, "us")
    return ST.catalogue(ST.read_table(spark, path))


@query("S-21", with_tables("SELECT symbol, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date FROM bars GROUP BY 1", "bars"))
def stored_date_ranges(spark, folder):
    path = _path(spark, "bars")
    ST.save_bars(I.minute_bars(spark, folder), path, "us")
    return ST.date_range(spark, path)


@query(
    "S-18 W-30",
    """SELECT split, count(*) AS n FROM (SELECT CASE WHEN o_orderdate < last - INTERVAL 12 MONTH - INTERVAL 6 MONTH THEN 'train'
      WHEN o_orderdate < last - INTERVAL 12 MONTH THEN 'val' ELSE 'test' END AS split
      FROM orders, (SELECT max(o_orderdate) AS last FROM orders)) GROUP BY 1""",
)
def stored_splits(spark, folder):
    path = _path(spark, "splits")
    rows = table(spark, folder, "orders").withColumnRenamed("o_orderdate", "ts")
    ST.write_table(S.time_split(rows, tie="o_orderkey"), path, ["split"])
    return ST.partition_counts(spark, path, ["split"]).withColumnRenamed("n_rows", "n")


@query(
    "S-19 S-25 S-27",
    with_tables("SELECT symbol, ts, peak_prob FROM scored WHERE symbol = 'view' AND CAST(ts AS DATE) = DATE '2024-01-09'", "scored"),
)
def stored_results_scanned(spark, folder):
    path = _path(spark, "result")
    ST.write_result(I.scored(spark, folder).select("symbol", "ts", "peak_prob"), path, csv=True)
    return ST.read_result(spark, path, "view", "2024-01-09")


@query("S-10", "SELECT CAST(p_partkey AS VARCHAR) AS ticker, p_name AS name, p_brand AS exchange FROM part")
def symbol_master(spark, folder):
    path = _path(spark, "symbols")
    part = table(spark, folder, "part")
    part.select(
        F.col("p_partkey").cast("string").alias("ticker"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("tv_symbol"),
        F.col("p_brand").alias("exchange"), F.col("p_type").alias("type"),
    ).write.option("header", "true").csv(path)
    return ST.read_symbol_list(spark, path).select("ticker", "name", "exchange")


@query(
    "S-11",
    with_tables(
        "SELECT underlying AS symbol, period_start, CAST(period_start + 7 AS DATE) AS period_end, round(min(stock_close) OVER (PARTITION BY underlying, period_start), 8) AS stock_close, contract FROM contracts",
        "contracts",
    ),
)
def contract_cache(spark, folder):
    path = _path(spark, "cache")
    docs = I.contracts(spark, folder).groupBy(F.col("underlying").alias("symbol"), "period_start").agg(
        F.min("stock_close").alias("stock_close"), F.collect_list("contract").alias("filtered_symbols")
    )
    docs.withColumn("period_end", F.date_add("period_start", 7)).write.json(path)
    # One document per line here, one per file at the vendor.
    out = ST.read_contract_cache(spark, path, multi_line=False)
    return out.withColumn("stock_close", F.round("stock_close", 8))


LEDGER = """led AS (SELECT c_name AS symbol, 'EX' || c_nationkey AS exchange, c_mktsegment AS source, CASE WHEN c_custkey % 2 = 0 THEN 'us' ELSE 'kr' END AS market,
  CASE WHEN c_custkey % 3 > 0 THEN DATE '2023-01-01' END AS start_date, CASE WHEN c_custkey % 4 > 0 THEN DATE '2023-06-30' END AS end_date,
  c_custkey % 1000 AS bar_count, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'partial' ELSE 'complete' END AS status,
  CAST(NULL AS VARCHAR) AS error_message FROM customer)"""


def _ledger(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.col("c_name").alias("symbol"), F.concat(F.lit("EX"), F.col("c_nationkey").cast("string")).alias("exchange"), F.col("c_mktsegment").alias("source"),
        F.when(k % 2 == 0, "us").otherwise("kr").alias("market"), (k % 1000).alias("bar_count"),
        F.when(k % 3 == 0, "pending").when(k % 3 == 1, "partial").otherwise("complete").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.when(k % 3 > 0, F.lit("2023-01-01").cast("date")).alias("start_date"), F.when(k % 4 > 0, F.lit("2023-06-30").cast("date")).alias("end_date"),
    )


@query("A-10", f"WITH {LEDGER} SELECT market, source, status, count(*) AS n, CAST(sum(bar_count) AS BIGINT) AS total_bars FROM led GROUP BY 1, 2, 3")
def ledger_summary(spark, folder):
    return M.ledger_summary(_ledger(spark, folder))


@query("A-11", f"WITH {LEDGER} SELECT symbol, exchange FROM led WHERE market = 'us' AND source = 'BUILDING' AND status <> 'complete'")
def ledger_pending(spark, folder):
    return M.pending(_ledger(spark, folder), "us", "BUILDING").select("symbol", "exchange")


@query(
    "A-11 A-02",
    f"""WITH {LEDGER}, up AS (SELECT *, bar_count % 5 = 0 AS hit, bar_count % 10 = 0 AS again FROM led)
    SELECT symbol, exchange, source, market, CASE WHEN hit THEN coalesce(DATE '2024-01-01', start_date) ELSE start_date END AS start_date, end_date,
      CASE WHEN again THEN bar_count + 2 WHEN hit THEN bar_count + 1 ELSE bar_count END AS bar_count,
      CASE WHEN again THEN 'error' WHEN hit THEN 'complete' ELSE status END AS status, CASE WHEN again THEN 'late' END AS error_message FROM up""",
)
def ledger_upserted(spark, folder):
    led = _ledger(spark, folder)
    none = F.lit(None)
    first = led.filter(F.col("bar_count") % 5 == 0).withColumns(
        {"bar_count": F.col("bar_count") + 1, "status": F.lit("complete"), "start_date": F.lit("2024-01-01").cast("date"),
         "end_date": none.cast("date"), "seq": F.lit(1).cast("long")}
    )
    second = led.filter(F.col("bar_count") % 10 == 0).withColumns(
        {"bar_count": F.col("bar_count") + 2, "status": F.lit("error"), "error_message": F.lit("late"), "start_date": none.cast("date"),
         "end_date": none.cast("date"), "seq": F.lit(2).cast("long")}
    )
    return M.upsert_ledger(led, first.unionByName(second))


@query("A-11", f"WITH {LEDGER} SELECT symbol, exchange, source FROM led WHERE NOT (bar_count % 7 = 0)")
def ledger_entries_removed(spark, folder):
    led = _ledger(spark, folder)
    return M.without_entries(led, led.filter(F.col("bar_count") % 7 == 0)).select("symbol", "exchange", "source")


@query(
    "A-12",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END AS name, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def instrument_info(spark, folder):
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    info = table(spark, folder, "supplier").join(nation, "s_nationkey").select("s_suppkey", F.col("s_name").alias("name"), "country")
    changed = info.filter(F.col("s_suppkey") % 3 == 0).withColumn("name", F.concat("name", F.lit("!")))
    return merge_loads(info, changed, ["s_suppkey"])


@query(
    "K-06",
    with_tables(
        """SELECT timeframe, label_config, model_config, s.symbol, greatest(a, c) AS date_min, least(b, d) AS date_max FROM
          (SELECT CASE WHEN volume % 2 = 0 THEN '1m' ELSE '5m' END AS timeframe, CASE WHEN volume % 3 = 0 THEN 'L1' ELSE 'L3' END AS label_config,
             CASE WHEN volume % 5 = 0 THEN 'M4' ELSE 'M1' END AS model_config, symbol, min(date) AS a, max(date) AS b FROM scored GROUP BY 1, 2, 3, 4) s
          JOIN (SELECT symbol, min(CAST(ts AS DATE)) AS c, max(CAST(ts AS DATE)) AS d FROM option_bars GROUP BY 1) o ON s.symbol = o.symbol
        WHERE greatest(a, c) < least(b, d) ORDER BY timeframe, label_config, model_config, s.symbol LIMIT 1""",
        "scored", "option_bars",
    ),
)
def default_variant(spark, folder):
    v = F.col("volume")
    rows = I.scored(spark, folder).withColumns(
        {"timeframe": F.when(v % 2 == 0, "1m").otherwise("5m"), "label_config": F.when(v % 3 == 0, "L1").otherwise("L3"),
         "model_config": F.when(v % 5 == 0, "M4").otherwise("M1")}
    )
    return ST.first_usable_variant(rows, I.option_bars(spark, folder))


@query("F-13", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_object('k', json_extract(props, '$.k')) AS VARCHAR) AS doc FROM events")
def json_properties(spark, folder):
    parsed = F.from_json("props", "k bigint")
    return table(spark, folder, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("doc"))


@query("W-21 P-05 S-13")
def labels_of_variants(spark, folder):
    """All three labelling variants of the session bars in one table, told apart by a column."""
    bars = I.session(spark, folder)
    parts = [label_bars(bars, label_variant(k)).withColumn("label_config", F.lit(k)) for k in ("L1", "L2", "L3")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
