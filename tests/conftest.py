from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tapewright.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def bars(spark):
    """Minute bars of two symbols over two days and a year's end, as (DataFrame, pandas)."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    parts = []
    for symbol, days in (("AAA", ["2024-12-30", "2024-12-31", "2025-01-02"]), ("BBB", ["2024-12-31"])):
        for day in days:
            n = 390
            ts = pd.date_range(f"{day} 09:30", periods=n, freq="min")
            close = np.round(100 + np.cumsum(rng.normal(0, 0.3, n)), 2)
            opened = np.round(close + rng.normal(0, 0.2, n), 2)
            parts.append(
                pd.DataFrame(
                    {
                        "symbol": symbol, "ts": ts, "open": opened,
                        "high": np.maximum(opened, close) + np.round(rng.random(n), 2),
                        "low": np.minimum(opened, close) - np.round(rng.random(n), 2),
                        "close": close, "volume": rng.integers(0, 500, n),
                    }
                )
            )
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), pdf
