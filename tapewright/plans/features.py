"""Queries on per-bar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import features as X
from tapewright.operators.joins import rounded
from tapewright.operators.summaries import box_summary, correlations, feature_summary, histogram, seeded_sample
from tapewright.plans.inputs import scored, session, with_tables
from tapewright.plans.registry import query

# Windows of the SQL twins: the series of a symbol and year, its day, and the day so far.
WINDOWS = """WINDOW s AS (PARTITION BY symbol, year(date) ORDER BY ts), d AS (PARTITION BY symbol, date ORDER BY ts),
  w AS (PARTITION BY symbol, date)"""


def _rows(k: int) -> str:
    return f"(PARTITION BY symbol, year(date) ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _select(items: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), 8) AS {k}" for k, v in items.items())


PRICE = {
    "pf_open_return": "(close - o) / o",
    **{f"pf_return_{k}m": f"close / lag(close, {k}) OVER s - 1" for k in (1, 2, 3, 5, 10)},
    "pf_range_position": "CASE WHEN dh > dl THEN (close - dl) / (dh - dl) ELSE 0.5 END",
    "pf_cum_range": "(dh - dl) / o",
    "pf_bar_range": "(high - low) / o",
    "pf_body_ratio": "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END",
    "pf_upper_shadow": "CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END",
    "pf_lower_shadow": "CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END",
    "pf_bar_direction": "dir",
    "pf_consec_direction": "dir * row_number() OVER (PARTITION BY symbol, year(date), run ORDER BY ts)",
    "pf_momentum_5": f"CASE WHEN rn >= 5 THEN close / avg(close) OVER {_rows(5)} - 1 END",
    "pf_momentum_10": f"CASE WHEN rn >= 10 THEN close / avg(close) OVER {_rows(10)} - 1 END",
    "pf_acceleration": "(close / lag(close, 1) OVER s - 1) - (lag(close, 1) OVER s / lag(close, 2) OVER s - 1)",
}
PRICE_SRC = f"""p1 AS (SELECT *, first_value(open) OVER d AS o, max(high) OVER d AS dh, min(low) OVER d AS dl, sign(close - open) AS dir,
    row_number() OVER s AS rn FROM sess {WINDOWS}),
  p2 AS (SELECT *, CASE WHEN dir IS DISTINCT FROM lag(dir) OVER s THEN 1 ELSE 0 END AS chg FROM p1 {WINDOWS}),
  p3 AS (SELECT *, sum(chg) OVER s AS run FROM p2 {WINDOWS})"""
PRICE_SQL = with_tables(f"SELECT symbol, ts, {_select(PRICE)} FROM p3 {WINDOWS}", "sess", extra=PRICE_SRC)


def _features(df):
    return rounded(df, X.feature_columns(df)).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in X.feature_columns(df)])


@query("W-01 W-02 W-03 W-04 W-05 W-06 W-07 W-08 W-09 F-11", PRICE_SQL)
def price_features(spark, folder):
    return _features(X.price_features(session(spark, folder)))


VOLUME = {
    **{f"vf_vol_ma{k}_ratio": f"CASE WHEN avg(v) OVER {_rows(k)} > 0 THEN v / avg(v) OVER {_rows(k)} ELSE 1 END" for k in (5, 10, 20)},
    "vf_cum_vol_share": "sum(v) OVER d / sum(v) OVER w",
    "vf_vol_change": "greatest(least(coalesce(v / lag(v) OVER s - 1, 0), 10), -10)",
    "vf_vol_spike": f"CASE WHEN avg(v) OVER {_rows(20)} > 0 THEN v / avg(v) OVER {_rows(20)} ELSE 1 END",
    "vf_obv": "sum(v * dir) OVER d",
    "vf_obv_norm": "sum(v * dir) OVER d / sum(v) OVER w",
    "vf_vwap_dev": "(close - sum(close * v) OVER d / sum(v) OVER d) / first_value(open) OVER d",
}
VOLUME_SRC = f"v1 AS (SELECT *, CAST(volume AS DOUBLE) AS v, coalesce(sign(close - lag(close) OVER s), 0) AS dir FROM sess {WINDOWS})"


@query("W-10 W-11 W-12 W-13 W-14", with_tables(f"SELECT symbol, ts, {_select(VOLUME)} FROM v1 {WINDOWS}", "sess", extra=VOLUME_SRC))
def volume_features(spark, folder):
    return _features(X.volume_features(session(spark, folder)))


CAUSAL = VOLUME | {"vf_cum_vol_share": "1.0", "vf_obv_norm": "sum(v * dir) OVER d / sum(v) OVER d"}


@query("W-11 W-13", with_tables(f"SELECT symbol, ts, {_select(CAUSAL)} FROM v1 {WINDOWS}", "sess", extra=VOLUME_SRC))
def volume_features_causal(spark, folder):
    return _features(X.volume_features(session(spark, folder), causal=True))


# The SQL twins smooth row by row with a recursive query, independent of the block form.
EWM = {"fast": ("close", 12), "slow": ("close", 26), "g7": ("gain", 7), "l7": ("loss", 7), "g14": ("gain", 14), "l14": ("loss", 14)}


def _ewm(cols: dict[str, tuple[str, int]]) -> str:
    return ", ".join(
        f"coalesce(e.{n} + (b.{x} - e.{n}) * CAST({2 / (k + 1)!r} AS DOUBLE), b.{x}) AS {n}" for n, (x, k) in cols.items()
    )


EWM_SRC = f"""t1 AS MATERIALIZED (SELECT *, row_number() OVER s AS rn, first_value(open) OVER d AS o,
    greatest(close - lag(close) OVER s, 0) AS g0, greatest(lag(close) OVER s - close, 0) AS l0, lag(close) OVER s AS c1,
    avg(close) OVER {_rows(5)} AS m5, avg(close) OVER {_rows(10)} AS m10, avg(close) OVER {_rows(20)} AS m20,
    coalesce(stddev_samp(close) OVER {_rows(20)}, 0) AS sd, max(high) OVER {_rows(14)} AS hh, min(low) OVER {_rows(14)} AS ll
    FROM sess {WINDOWS}),
  t2 AS MATERIALIZED (SELECT *, CASE WHEN c1 IS NULL THEN CAST(NULL AS DOUBLE) ELSE g0 END AS gain,
    CASE WHEN c1 IS NULL THEN CAST(NULL AS DOUBLE) ELSE l0 END AS loss FROM t1),
  e AS (SELECT symbol, rn, {", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (x, _) in EWM.items())}, CAST(0 AS DOUBLE) AS sig FROM t2 WHERE rn = 1
    UNION ALL SELECT b.symbol, b.rn, {_ewm(EWM)},
      e.sig + ((coalesce(e.fast + (b.close - e.fast) * CAST({2 / 13!r} AS DOUBLE), b.close)
        - coalesce(e.slow + (b.close - e.slow) * CAST({2 / 27!r} AS DOUBLE), b.close)) - e.sig) * CAST(0.2 AS DOUBLE) AS sig
    FROM e JOIN t2 b ON b.symbol = e.symbol AND b.rn = e.rn + 1),
  t3 AS (SELECT t2.*, e.fast, e.slow, e.g7, e.l7, e.g14, e.l14, e.sig FROM t2 JOIN e ON t2.symbol = e.symbol AND t2.rn = e.rn)"""
TECHNICAL = {
    "tf_ma5_ratio": "close / m5 - 1",
    "tf_ma10_ratio": "close / m10 - 1",
    "tf_ma20_ratio": "close / m20 - 1",
    "tf_ma5_10_cross": "(m5 - m10) / o",
    "tf_ma5_20_cross": "(m5 - m20) / o",
    "tf_rsi7": "1 - 1 / (1 + CASE WHEN l7 > 0 THEN g7 / l7 ELSE CAST(100 AS DOUBLE) END)",
    "tf_rsi14": "1 - 1 / (1 + CASE WHEN l14 > 0 THEN g14 / l14 ELSE CAST(100 AS DOUBLE) END)",
    "tf_macd": "(fast - slow) / o",
    "tf_macd_signal": "sig / o",
    "tf_macd_hist": "((fast - slow) - sig) / o",
    "tf_bb_position": "CASE WHEN sd > 0 THEN (close - (m20 - 2 * sd)) / (4 * sd) ELSE 0.5 END",
    "tf_bb_width": "4 * sd / o",
    "tf_stoch": "CASE WHEN hh > ll THEN (close - ll) / (hh - ll) ELSE 0.5 END",
}


@query(
    "W-15 W-16 W-17 W-18 W-19 X-03",
    with_tables(f"SELECT symbol, ts, {_select(TECHNICAL)} FROM t3", "sess", recursive=True, extra=EWM_SRC),
)
def technical_features(spark, folder):
    return _features(X.technical_features(session(spark, folder)))


TIME = {
    "tmf_elapsed_norm": "m / 390.0",
    "tmf_progress_sq": "(m / CAST(390 AS DOUBLE)) * (m / CAST(390 AS DOUBLE))",
    "tmf_minutes_from_open": "m",
    "tmf_dow_sin": "sin(2 * pi() * (isodow(ts) - 1) / 5)",
    "tmf_dow_cos": "cos(2 * pi() * (isodow(ts) - 1) / 5)",
    "tmf_month_sin": "sin(2 * pi() * month(ts) / 12)",
    "tmf_month_cos": "cos(2 * pi() * month(ts) / 12)",
    "tmf_elapsed_sin": "sin(2 * pi() * m / 390)",
    "tmf_elapsed_cos": "cos(2 * pi() * m / 390)",
    "tmf_session_phase": "floor(m / 65)",
    "tmf_is_first_hour": "CASE WHEN m < 60 THEN 1 ELSE 0 END",
    "tmf_is_last_hour": "CASE WHEN m >= 330 THEN 1 ELSE 0 END",
}


@query(
    "T-01 T-02 T-03 T-04 T-05 T-06",
    with_tables(
        f"SELECT symbol, ts, {_select(TIME)} FROM (SELECT *, CAST(minutes_from_open AS DOUBLE) AS m FROM sess)".replace("390.0", "CAST(390 AS DOUBLE)"),
        "sess",
    ),
)
def time_features(spark, folder):
    return _features(X.time_features(session(spark, folder)))


@query(
    "T-01",
    with_tables(
        """SELECT symbol, ts, round((epoch_us(ts) - epoch_us(min(ts) OVER w)) / CAST(60000000 AS DOUBLE) / 390, 8) AS tmf_elapsed_norm
        FROM sess WINDOW w AS (PARTITION BY symbol, date)""",
        "sess",
    ),
)
def time_features_from_first_bar(spark, folder):
    out = X.time_features(session(spark, folder).drop("minutes_from_open"))
    return rounded(out, ["tmf_elapsed_norm"]).select("symbol", "ts", "tmf_elapsed_norm")


LAGGED = ("pf_bar_direction", "pf_body_ratio", "pf_momentum_5", "pf_acceleration")
LAG_SQL = ", ".join(
    f"round(coalesce(lag({c}, {n}) OVER s, 0), 8) AS {c}_lag{n}" for c in LAGGED for n in range(1, 4)
)


def _some(df):
    return df.select("symbol", "year", "date", "ts", *LAGGED)


@query(
    "W-22",
    with_tables(
        f"""SELECT symbol, ts, {", ".join(f"round({c}, 8) AS {c}" for c in LAGGED)}, {LAG_SQL} FROM
          (SELECT symbol, date, ts, {", ".join(f"CAST({PRICE[c]} AS DOUBLE) AS {c}" for c in LAGGED)} FROM p3 {WINDOWS}) {WINDOWS}""",
        "sess",
        extra=PRICE_SRC,
    ),
)
def lag_features(spark, folder):
    return _features(X.add_lags(_some(X.price_features(session(spark, folder))), 3))


DROP_SQL = ", ".join(f"round(lag({c}, {n}) OVER s, 8) AS {c}_lag{n}" for c in LAGGED for n in range(1, 4))


@query(
    "W-22",
    with_tables(
        f"""SELECT * FROM (SELECT symbol, ts, {", ".join(f"round({c}, 8) AS {c}" for c in LAGGED)}, {DROP_SQL} FROM
          (SELECT symbol, date, ts, {", ".join(f"CAST({PRICE[c]} AS DOUBLE) AS {c}" for c in LAGGED)} FROM p3 {WINDOWS}) {WINDOWS})
        WHERE pf_acceleration_lag3 IS NOT NULL""",
        "sess",
        extra=PRICE_SRC,
    ),
)
def lag_features_dropped(spark, folder):
    return _features(X.add_lags(_some(X.price_features(session(spark, folder))), 3, fill="drop"))


CLEAN = ", ".join(
    f"round(coalesce(last_value({c} IGNORE NULLS) OVER d, 0), 8) AS {c}" for c in LAGGED
)


@query(
    "P-14 P-11",
    with_tables(
        f"""SELECT symbol, ts, {CLEAN} FROM (SELECT symbol, date, ts,
            {", ".join(f"CASE WHEN volume % 5 > 0 AND isfinite(CAST({PRICE[c]} AS DOUBLE)) THEN CAST({PRICE[c]} AS DOUBLE) END AS {c}" for c in LAGGED)} FROM p3 {WINDOWS}) {WINDOWS}""",
        "sess",
        extra=PRICE_SRC,
    ),
)
def cleaned_features(spark, folder):
    # Every fifth volume class is blanked: nulls for even volumes, infinities for odd ones.
    inf = F.lit(float("inf"))
    df = X.price_features(session(spark, folder))
    gap = F.when(F.col("volume") % 2 == 0, F.lit(None).cast("double")).otherwise(inf)
    df = df.select("symbol", "year", "date", "ts", *[F.when(F.col("volume") % 5 > 0, F.col(c)).otherwise(gap).alias(c) for c in LAGGED])
    return _features(X.clean_features(df))


SEQ = "[CAST(open AS FLOAT), CAST(close AS FLOAT)]"


@query(
    "W-23 P-17 M-13",
    with_tables(
        f"""SELECT symbol, ts, len(seq) AS steps, round(CAST(list_sum(list_transform(seq, lambda r: CAST(r[1] AS DOUBLE))) AS DOUBLE), 4) AS sum_open,
          round(CAST(seq[1][2] AS DOUBLE), 4) AS oldest_close, round(CAST(seq[-1][2] AS DOUBLE), 4) AS newest_close
        FROM (SELECT symbol, ts, list({SEQ}) OVER (PARTITION BY symbol, date ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS seq FROM sess)
        WHERE len(seq) = 5""",
        "sess",
    ),
)
def sequence_windows(spark, folder):
    return _sequence_facts(X.sequences(session(spark, folder), 5, "drop", ["open", "close"]))


@query(
    "W-23",
    with_tables(
        f"""SELECT symbol, ts, CAST(5 AS BIGINT) AS steps, round(CAST(list_sum(list_transform(seq, lambda r: CAST(r[1] AS DOUBLE))) AS DOUBLE), 4) AS sum_open,
          round(CAST(CASE WHEN len(seq) = 5 THEN seq[1][2] ELSE 0 END AS DOUBLE), 4) AS oldest_close, round(CAST(seq[-1][2] AS DOUBLE), 4) AS newest_close
        FROM (SELECT symbol, ts, list({SEQ}) OVER (PARTITION BY symbol, date ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS seq FROM sess)""",
        "sess",
    ),
)
def sequence_windows_padded(spark, folder):
    return _sequence_facts(X.sequences(session(spark, folder), 5, "0fill", ["open", "close"]))


def _sequence_facts(df):
    first = F.aggregate("seq", F.lit(0.0), lambda acc, r: acc + r[0].cast("double"))
    return df.select(
        "symbol", "ts", F.size("seq").cast("long").alias("steps"), F.round(first, 4).alias("sum_open"),
        F.round(F.col("seq")[0][1].cast("double"), 4).alias("oldest_close"),
        F.round(F.element_at("seq", -1)[1].cast("double"), 4).alias("newest_close"),
    )


@query("P-17", with_tables("SELECT symbol, ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts) AS n FROM sess) WHERE n >= 5", "sess"))
def bars_with_history(spark, folder):
    return X.drop_early_bars(session(spark, folder), 5).select("symbol", "ts")


@query("P-20 P-09 W-22 P-14 S-23")
def feature_matrix(spark, folder):
    """The whole chain: 51 base features, five lags each, cleaned."""
    return X.clean_features(X.add_lags(X.build_features(session(spark, folder)), 5))


SUMMED = ("pf_open_return", "pf_range_position", "pf_return_1m")


@query(
    "A-13",
    with_tables(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS std, round(min({c}), 8) AS min,
              round(max({c}), 8) AS max, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 8) AS null_pct,
              count(*) FILTER (isinf({c})) AS inf_count, round(quantile_cont({c}, 0.25), 8) AS p25, round(quantile_cont({c}, 0.5), 8) AS p50,
              round(quantile_cont({c}, 0.75), 8) AS p75 FROM f"""
            for c in SUMMED
        ),
        "sess",
        extra=PRICE_SRC + f", f AS MATERIALIZED (SELECT symbol, ts, {', '.join(f'CAST({PRICE[c]} AS DOUBLE) AS {c}' for c in SUMMED)} FROM p3 {WINDOWS})",
    ),
)
def feature_statistics(spark, folder):
    out = feature_summary(X.price_features(session(spark, folder)), SUMMED)
    return rounded(out, ["mean", "std", "min", "max", "null_pct", "p25", "p50", "p75"])


CORR = ("open", "high", "low", "close", "volume")


@query(
    "A-14",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 7) AS r FROM sess" for a in CORR for b in CORR
        ),
        "sess",
    ),
)
def feature_correlations(spark, folder):
    return rounded(correlations(session(spark, folder), CORR), ["r"], 7)


@query(
    "A-15",
    with_tables(
        """SELECT CAST(least(floor((close - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n
        FROM sess, (SELECT min(close) AS lo, max(close) AS hi FROM sess) GROUP BY 1""",
        "sess",
    ),
)
def close_histogram(spark, folder):
    return histogram(session(spark, folder), "close", 50)


@query(
    "A-16",
    with_tables(
        " UNION ALL ".join(
            f"""SELECT label, '{c}' AS feature, count(*) AS n, round(avg({c}), 8) AS mean, round(min({c}), 8) AS min, round(max({c}), 8) AS max,
              round(quantile_cont({c}, 0.25), 8) AS p25, round(quantile_cont({c}, 0.5), 8) AS p50, round(quantile_cont({c}, 0.75), 8) AS p75
              FROM (SELECT label, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume FROM scored) GROUP BY 1"""
            for c in ("close", "volume")
        ),
        "scored",
    ),
)
def boxes_by_label(spark, folder):
    out = box_summary(scored(spark, folder), ["close", "volume"], ["label"])
    return rounded(out, ["mean", "min", "max", "p25", "p50", "p75"])


@query("S-06 K-01", with_tables("SELECT * FROM sess ORDER BY md5(symbol || '|' || CAST(epoch_us(ts) AS VARCHAR) || '|42'), symbol, ts LIMIT 200", "sess"))
def seeded_bar_sample(spark, folder):
    """A sampling operator: 200 bars, the same on every run, in time order."""
    return seeded_sample(session(spark, folder), ["symbol", "ts"], 200).orderBy("symbol", "ts")
