"""Queries on option contracts and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import contracts as C
from tapewright.functions import pricing as P
from tapewright.operators import options as O
from tapewright.operators.bars import merge_venues
from tapewright.operators.joins import rounded
from tapewright.plans import inputs as I
from tapewright.plans.inputs import FRIDAY, with_tables
from tapewright.plans.registry import query

CHAIN = "underlying, expiry, cp, strike, period_start, round(stock_close, 8) AS stock_close, contract"


@query("F-01 F-02 F-03 F-06 S-17", with_tables(f"SELECT {CHAIN} FROM contracts", "contracts"))
def contracts_listed(spark, folder):
    return rounded(I.contracts(spark, folder), ["stock_close"])


@query(
    "F-01",
    with_tables(
        r"""SELECT raw, regexp_extract(raw, '^(\S+?)\s+(\d{6})([CP])(\d{8})$', 1) AS underlying,
          CAST(strptime('20' || regexp_extract(raw, '^(\S+?)\s+(\d{6})([CP])(\d{8})$', 2), '%Y%m%d') AS DATE) AS expiry,
          regexp_extract(raw, '^(\S+?)\s+(\d{6})([CP])(\d{8})$', 3) AS cp,
          CAST(regexp_extract(raw, '^(\S+?)\s+(\d{6})([CP])(\d{8})$', 4) AS BIGINT) / 1000 AS strike
        FROM (SELECT contract AS raw FROM contracts)""",
        "contracts",
    ),
)
def contract_symbols_parsed(spark, folder):
    valid = I.contracts(spark, folder).select(F.col("contract").alias("raw"))
    # The bare underlying is no option symbol and drops out.
    noise = I.contracts(spark, folder).select(F.col("underlying").alias("raw"))
    return C.with_contract(valid.union(noise), "raw")


@query(
    "F-02",
    with_tables(
        "SELECT contract, underlying || '_' || cp || '_' || printf('%.0f', strike * 1000) || '_' || strftime(expiry, '%Y%m%d') AS contract_id FROM contracts",
        "contracts",
    ),
)
def contract_ids(spark, folder):
    c = I.contracts(spark, folder)
    made = C.contract_id(F.col("underlying"), F.col("cp"), F.col("strike") * 1000, F.col("expiry"))
    return c.select("contract", made.alias("contract_id"))


@query(
    "F-03 F-04",
    f"""SELECT o_orderkey, {FRIDAY.format(d="CAST(o_orderdate AS DATE)")} AS next_friday,
      CAST(b + CAST(((4 - (isodow(b) - 1)) % 7 + 7) % 7 AS INTEGER) AS DATE) AS friday_after
    FROM (SELECT *, CAST(o_orderdate AS DATE) + 7 AS b FROM orders)""",
)
def expiry_fridays(spark, folder):
    day = F.to_date("o_orderdate")
    return I.table(spark, folder, "orders").select(
        "o_orderkey", C.next_week_friday(day).alias("next_friday"), C.friday_after(day, 7).alias("friday_after")
    )


WEEKS = """spans AS (SELECT symbol, min(date) AS a, max(date) AS b FROM sess GROUP BY 1),
  weeks AS (SELECT symbol, CAST(g.g AS DATE) AS period_start, least(CAST(g.g AS DATE) + 7, b) AS period_end
    FROM spans, generate_series(DATE '2023-12-25', DATE '2024-12-30', INTERVAL 7 DAY) g(g)
    WHERE g.g >= date_trunc('week', a) AND g.g < b)"""


def _weeks(spark, folder):
    s = I.session(spark, folder)
    spans = s.groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return C.weekly_periods(spans)


@query("F-05", with_tables("SELECT symbol, period_start, period_end FROM weeks", "sess", extra=WEEKS))
def weekly_periods(spark, folder):
    return _weeks(spark, folder)


@query(
    "J-06",
    with_tables(
        "SELECT d.symbol, d.date, period_start, period_end FROM daily d JOIN weeks w ON d.symbol = w.symbol AND period_start <= date AND date < period_end",
        "sess", "daily", extra=WEEKS,
    ),
)
def week_of_day(spark, folder):
    return O.for_day(I.daily(spark, folder).select("symbol", "date"), _weeks(spark, folder))


@query(
    "F-12",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN CAST(strptime(CAST(20200101 + p_partkey % 28 AS VARCHAR), '%Y%m%d') AS DATE) END AS end_date
    FROM part""",
)
def file_end_dates(spark, folder):
    stamp = (F.lit(20200101) + F.col("p_partkey") % 28).cast("string")
    name = F.concat(F.lit("ABC_XNAS.ITCH_ohlcv-1m_20190101_"), stamp, F.when(F.col("p_partkey") % 4 > 0, ".dbn.zst").otherwise(".csv"))
    return I.table(spark, folder, "part").select("p_partkey", C.file_end_date(name).alias("end_date"))


@query(
    "F-06",
    f"""SELECT p_partkey, unnest(list_distinct(list_filter(list_transform({I._STEPS}, lambda s: round_even(round_even(x / tick, 0) * tick * s / tick, 0) * tick),
      lambda s: s > 0))) AS strike
    FROM (SELECT p_partkey, p_retailprice * p_size AS x, CAST({I._TICK.format(p="(p_retailprice * p_size)")} AS DOUBLE) AS tick FROM part)""",
)
def strike_ladders(spark, folder):
    spot = F.col("p_retailprice") * F.col("p_size")
    return I.table(spark, folder, "part").select("p_partkey", F.explode(P.strike_ladder(spot)).alias("strike"))


@query("A-04 S-16", with_tables("SELECT contract, symbol, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM option_bars", "option_bars"))
def option_bars(spark, folder):
    return rounded(I.option_bars(spark, folder), ["open", "high", "low", "close"])


@query(
    "A-04 P-04",
    with_tables(
        """SELECT contract, date_trunc('minute', ts) AS ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
          CAST(sum(volume) AS BIGINT) AS volume
        FROM (SELECT *, (event_id % 2) * 1000000000000 + epoch_us(ts) % 60000000 AS k FROM option_ticks WHERE volume > 0)
        GROUP BY 1, date_trunc('minute', ts)""",
        "option_ticks",
    ),
)
def option_bars_of_publishers(spark, folder):
    rows = I.option_ticks(spark, folder).select(
        "contract", "ts", (F.col("event_id") % 2).cast("string").alias("venue"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume"
    )
    return merge_venues(rows, keys=("contract",), ranks=("0", "1"))


@query(
    "J-05 P-08",
    with_tables(
        "SELECT s.symbol, s.ts, a.contract, a.strike FROM sess s JOIN active a ON s.symbol = a.underlying AND s.date = a.date WHERE a.cp = 'P'",
        "sess", "active",
    ),
)
def option_chain(spark, folder):
    return O.chain(I.session(spark, folder), I.contracts(spark, folder), "P").select("symbol", "ts", "contract", "strike")


ATM = """atm AS MATERIALIZED (SELECT symbol, date, ts, close, contract, strike, expiry FROM (
    SELECT s.symbol, s.date, s.ts, s.close, a.contract, a.strike, a.expiry,
      row_number() OVER (PARTITION BY s.symbol, s.ts ORDER BY abs(a.strike - s.close), a.contract) AS rn
    FROM sess s LEFT JOIN active a ON s.symbol = a.underlying AND s.date = a.date AND a.cp = 'P') WHERE rn = 1)"""


@query("J-04", with_tables("SELECT * FROM atm", "sess", "active", extra=ATM))
def at_the_money(spark, folder):
    bars = I.session(spark, folder).select("symbol", "date", "ts", "close")
    return O.at_the_money(bars, I.contracts(spark, folder), "P")


FILLS = """round((q.close + greatest((q.high - q.low) / 2, 0.01)) * 1.005, 8) AS buy_fill, round((q.close - greatest((q.high - q.low) / 2, 0.01)) * 0.995, 8) AS sell_fill"""


@query(
    "J-03 F-07 B-02 S-08",
    with_tables(
        f"""SELECT a.symbol, a.ts, a.contract, q.ts AS q_ts, round(q.close, 8) AS q_close, q.volume AS q_volume, {FILLS},
          CASE WHEN a.contract IS NULL THEN 'NO_CHAIN' WHEN q.ts IS NULL OR q.volume = 0 THEN 'NO_LIQUIDITY' ELSE '' END AS reject
        FROM atm a ASOF LEFT JOIN option_bars q ON a.contract = q.contract AND a.ts >= q.ts""",
        "sess", "active", "option_bars", extra=ATM,
    ),
)
def entry_quotes(spark, folder):
    bars = I.session(spark, folder).select("symbol", "date", "ts", "close")
    atm = O.at_the_money(bars, I.contracts(spark, folder), "P")
    q = O.quotes_at(atm, I.option_bars(spark, folder))
    cols = [F.col(f"q_{c}") for c in ("close", "high", "low")]
    reject = F.when(F.col("contract").isNull(), "NO_CHAIN").when(F.col("q_ts").isNull() | (F.col("q_volume") == 0), "NO_LIQUIDITY").otherwise("")
    out = q.select(
        "symbol", "ts", "contract", "q_ts", "q_close", "q_volume", P.buy_fill(*cols).alias("buy_fill"), P.sell_fill(*cols).alias("sell_fill"), reject.alias("reject")
    )
    return rounded(out, ["q_close", "buy_fill", "sell_fill"])


SELECTION = """sel AS MATERIALIZED (SELECT d.symbol, d.date, d.avg_price AS price, a.contract, a.strike, a.expiry FROM daily d
    JOIN active a ON d.symbol = a.underlying AND d.date = a.date
    WHERE a.cp = 'P' AND abs(a.strike - d.avg_price) <= 15 AND a.expiry > d.date AND a.expiry <= d.date + 14)"""


def _selection(spark, folder):
    days = I.daily(spark, folder).select("symbol", "date", F.col("avg_price").alias("price"))
    return O.daily_selection(days, I.contracts(spark, folder), 15.0, 14)


@query("P-07", with_tables("SELECT symbol, date, contract, strike, expiry FROM sel", "daily", "active", extra=SELECTION))
def contracts_near_price(spark, folder):
    return _selection(spark, folder).select("symbol", "date", "contract", "strike", "expiry")


@query(
    "K-05",
    with_tables(
        f"""SELECT symbol, date, contract, expiry, strike FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY
            abs(date_diff('day', {FRIDAY.format(d='date')}, expiry)), abs(strike - price), contract) AS rn FROM sel) WHERE rn = 1""",
        "daily", "active", extra=SELECTION,
    ),
)
def contract_of_the_day(spark, folder):
    return O.pick_one(_selection(spark, folder))


CACHE = "cache AS (SELECT contract, period_start, stock_close FROM contracts WHERE strike * 8 % 2 = 0)"


@query(
    "J-07 S-11",
    with_tables(
        r"""SELECT o.contract, regexp_extract(o.contract, '^(\S+?)\s+', 1) AS underlying, x.expiry, x.cp, x.strike, c.period_start,
          round(c.stock_close, 8) AS stock_close
        FROM (SELECT DISTINCT contract FROM option_bars) o JOIN contracts x ON o.contract = x.contract LEFT JOIN cache c ON o.contract = c.contract""",
        "option_bars", extra=CACHE,
    ),
)
def contract_metadata(spark, folder):
    cache = I.contracts(spark, folder).filter(F.col("strike") * 8 % 2 == 0).select("contract", "period_start", "stock_close")
    return rounded(O.contract_metadata(I.option_bars(spark, folder), cache), ["stock_close"])


TRADED = "traded AS (SELECT contract, CAST(ts AS DATE) AS date, count(*) AS n_bars FROM option_bars GROUP BY 1, 2)"


@query(
    "J-12",
    with_tables(
        """SELECT symbol, date, contract, strike, n_bars FROM (SELECT d.symbol, d.date, t.contract, c.strike, t.n_bars,
            row_number() OVER (PARTITION BY d.symbol, d.date ORDER BY abs(c.strike - d.close), t.contract) AS rn
          FROM daily d JOIN contracts c ON c.underlying = d.symbol AND c.cp = 'P' JOIN traded t ON t.contract = c.contract AND t.date = d.date) WHERE rn = 1""",
        "daily", "contracts", "option_bars", extra=TRADED,
    ),
)
def nearest_traded_contract(spark, folder):
    days = I.daily(spark, folder).select("symbol", "date", F.col("close").alias("price"))
    return O.nearest_traded(days, I.contracts(spark, folder), I.option_bars(spark, folder))


@query(
    "J-13 S-09",
    with_tables(
        """SELECT symbol, date, contract, strike, n_bars FROM (SELECT d.symbol, d.date, t.contract, a.strike, t.n_bars,
            row_number() OVER (PARTITION BY d.symbol, d.date ORDER BY abs(a.strike - a.stock_close), t.contract) AS rn
          FROM daily d JOIN active a ON a.underlying = d.symbol AND a.date = d.date AND a.cp = 'P'
          JOIN traded t ON t.contract = a.contract AND t.date = d.date) WHERE rn = 1""",
        "daily", "active", "option_bars", extra=TRADED,
    ),
)
def first_contract_with_data(spark, folder):
    days = I.daily(spark, folder).select("symbol", "date")
    return O.first_with_data(days, I.contracts(spark, folder), I.option_bars(spark, folder))


@query(
    "J-14 S-09",
    with_tables(
        """SELECT m.symbol, m.date, m.strike, b.contract, b.ts, round(b.close, 8) AS close FROM
          (SELECT d.symbol, d.date, a.strike, min(a.contract) AS contract FROM
             (SELECT symbol, date, round_even(close * 8 / t, 0) * t / 8 AS strike FROM
                (SELECT *, CASE WHEN close * 8 >= 1000 THEN CAST(100 AS DOUBLE) WHEN close * 8 >= 100 THEN 5 ELSE 1 END AS t FROM daily)) d
           JOIN active a ON a.underlying = d.symbol AND a.date = d.date AND a.cp = 'P' AND a.strike = d.strike GROUP BY 1, 2, 3) m
        JOIN option_bars b ON b.contract = m.contract AND CAST(b.ts AS DATE) = m.date""",
        "daily", "active", "option_bars",
    ),
)
def bars_by_strike(spark, folder):
    spot = F.col("close") * 8
    days = I.daily(spark, folder).select("symbol", "date", (P._to_tick(spot, P.strike_tick(spot)) / 8).alias("strike"))
    out = O.by_strike(days, I.contracts(spark, folder), I.option_bars(spark, folder))
    return rounded(out.select("symbol", "date", "strike", "contract", "ts", "close"), ["close"])


@query(
    "A-34",
    with_tables(
        """SELECT DISTINCT d.symbol, d.date FROM daily d JOIN active a ON a.underlying = d.symbol AND a.date = d.date
        WHERE NOT EXISTS (SELECT 1 FROM option_bars b WHERE b.symbol = d.symbol AND CAST(b.ts AS DATE) = d.date AND b.volume > 40)""",
        "daily", "active", "option_bars",
    ),
)
def days_without_option_bars(spark, folder):
    busy = I.option_bars(spark, folder).filter(F.col("volume") > 40)
    return O.days_without_bars(I.daily(spark, folder), I.contracts(spark, folder), busy)


# Same series as the Spark expression, summed from the other end.
PHI = """CASE WHEN abs({x}) < 8 THEN 0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) *
  list_reduce(list_transform(range(150, 0, -1), lambda k: CAST(2 * k + 1 AS DOUBLE)), lambda acc, k: acc * abs({x}) * abs({x}) / k + 1, CAST(1 AS DOUBLE)) * abs({x})
  WHEN {x} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"""


@query(
    "F-08 F-15",
    with_tables(
        f"""SELECT symbol, ts, contract, round(v, 6) AS put_value, round(greatest(v - h, 0), 6) AS bid, round(v + h, 6) AS ask
        FROM (SELECT *, greatest(v * 0.01, CAST(1 AS DOUBLE)) AS h FROM (
          SELECT *, greatest(strike * exp(-0.035 * t) * ({PHI.format(x="-d2")}) - close * ({PHI.format(x="-d1")}), 0) AS v
          FROM (SELECT *, d1 - 0.25 * sqrt(t) AS d2 FROM (SELECT *, (ln(close / strike) + (0.035 + 0.5 * 0.25 * 0.25) * t) / (0.25 * sqrt(t)) AS d1
            FROM (SELECT symbol, ts, contract, close, strike, date_diff('day', date, expiry) / CAST(365 AS DOUBLE) AS t FROM atm WHERE contract IS NOT NULL)))))""",
        "sess", "active", extra=ATM,
    ),
)
def put_values(spark, folder):
    bars = I.session(spark, folder).select("symbol", "date", "ts", "close")
    atm = O.at_the_money(bars, I.contracts(spark, folder), "P").filter(F.col("contract").isNotNull())
    value = P.put_value(F.col("close"), F.col("strike"), F.date_diff("expiry", "date").cast("double"))
    out = atm.withColumn("put_value", value).withColumn("_q", P.model_quote(F.col("put_value")))
    return rounded(out.select("symbol", "ts", "contract", "put_value", "_q.bid", "_q.ask"), ["put_value", "bid", "ask"], 6)


@query(
    "F-16",
    with_tables(
        "SELECT contract, round(sum((close + greatest((high - low) / 2, 0.01)) * 1.005 * volume) / sum(volume), 11) AS avg_entry FROM option_bars WHERE volume > 0 GROUP BY 1",
        "option_bars",
    ),
)
def average_entries(spark, folder):
    b = I.option_bars(spark, folder).filter(F.col("volume") > 0)
    fill = P.buy_fill(F.col("close"), F.col("high"), F.col("low"))
    return rounded(b.groupBy("contract").agg(P.average_entry(fill, F.col("volume")).alias("avg_entry")), ["avg_entry"], 11)
