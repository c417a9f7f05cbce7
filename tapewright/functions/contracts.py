"""Option contract symbols and expiry calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- Fixed values: layout of an exchange option symbol, e.g. "AAPL  260109P00270000" ---
ROOT_WIDTH, DATE_WIDTH, STRIKE_WIDTH = 6, 6, 8
TAIL_WIDTH = DATE_WIDTH + 1 + STRIKE_WIDTH


def parse_symbol(symbol: Column) -> Column:
    """Struct of underlying, expiry, cp and strike; null when the text is no option symbol.

    Read from the right, where the widths are fixed: what is left of the tail is the root, of any length.
    """
    text = F.trim(symbol)
    head = F.substring(text, F.lit(1), F.length(text) - TAIL_WIDTH)
    root = F.rtrim(head)
    date = F.substring(text, -TAIL_WIDTH, DATE_WIDTH)
    cp = F.substring(text, -(STRIKE_WIDTH + 1), 1)
    strike = F.substring(text, -STRIKE_WIDTH, STRIKE_WIDTH)
    digits = F.concat(date, strike)
    valid = (
        (F.length(root) > 0) & (F.length(head) > F.length(root)) & ~F.contains(root, F.lit(" "))
        & cp.isin("C", "P") & (F.length(digits) == DATE_WIDTH + STRIKE_WIDTH) & digits.rlike("^[0-9]+$")
    )
    parsed = F.struct(
        root.alias("underlying"),
        F.try_to_date(F.concat(F.lit("20"), date), "yyyyMMdd").alias("expiry"),
        cp.alias("cp"),
        (F.expr("0D") + F.try_to_number(strike, F.lit("9" * STRIKE_WIDTH)).cast("double") / 1000).alias("strike"),
    )
    return F.when(valid, parsed)


def with_contract(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Add the parsed parts as columns; rows that are no option symbol are dropped."""
    parsed = df.withColumn("_c", parse_symbol(F.col(symbol))).filter(F.col("_c").isNotNull())
    return parsed.select(*df.columns, "_c.underlying", "_c.expiry", "_c.cp", "_c.strike")


def make_symbol(underlying: Column, expiry: Column, cp: Column, strike: Column) -> Column:
    """Symbol with the whole root: padded when short, never cut, so that no two roots share a symbol."""
    root = F.upper(underlying)
    return F.concat(
        F.rpad(root, F.greatest(F.length(root), F.lit(ROOT_WIDTH)) + 1, F.lit(" ")),
        F.date_format(expiry, "yyMMdd"),
        cp,
        F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"),
    )


def contract_id(underlying: Column, cp: Column, strike: Column, expiry: Column) -> Column:
    """Readable identifier ``SYM_P_strike_yyyymmdd``."""
    return F.concat_ws(
        "_", underlying, cp, F.format_string("%.0f", strike.cast("double")), F.date_format(expiry, "yyyyMMdd")
    )


def next_week_friday(day: Column) -> Column:
    """Friday at least seven days ahead."""
    return F.date_add(day, (F.pmod(F.lit(4) - F.weekday(day), F.lit(7)) + 7).cast("int"))


def friday_after(day: Column, min_days: int) -> Column:
    """First Friday that is ``min_days`` or more away."""
    base = F.date_add(day, min_days)
    return F.date_add(base, F.pmod(F.lit(4) - F.weekday(base), F.lit(7)).cast("int"))


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def weekly_periods(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Monday-aligned periods that cover [start, end); the last one stops at ``end``."""
    first = week_start(F.col(start))
    weeks = F.sequence(first, F.date_sub(F.col(end), 1), F.expr("INTERVAL 7 DAYS"))
    keys = [c for c in spans.columns if c not in (start, end)]
    return (
        spans.filter(F.col(start) < F.col(end))
        .select(*keys, F.col(end).alias("_end"), F.explode(weeks).alias("period_start"))
        .select(*keys, "period_start", F.least(F.date_add("period_start", 7), F.col("_end")).alias("period_end"))
    )


def file_end_date(name: Column) -> Column:
    """Last date of a vendor file name such as ``ABC_VENUE_ohlcv-1m_20200101_20260224.dbn.zst``."""
    digits = F.regexp_extract(name, r"_(\d{8})\.dbn\.zst$", 1)
    return F.try_to_date(digits, "yyyyMMdd")
