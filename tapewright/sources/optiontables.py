"""Stored option bars and contracts: partitioned by underlying and day, bucketed by contract.

Both tables deal contracts into the same number of buckets by the same hash, so a join or an aggregate by contract needs no shuffle. A
filter or a join on underlying and day prunes folders, at run time too where the wanted days come from another table. Merging
a load rewrites the days it touches and no others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapewright.operators.bars import merge_loads, normalise
from tapewright.session import stage
from tapewright.sources.tables import exists

BUCKETS = 16
BARS = "contract STRING, ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, source STRING, underlying STRING, day DATE"
CONTRACTS = "contract STRING, expiry DATE, cp STRING, strike DOUBLE, period_start DATE, stock_close DOUBLE, underlying STRING"


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


@dataclass(frozen=True)
class OptionStore:
    """Two tables below ``path``. ``buckets`` is fixed when they are first written: a bucket of a day should fill a file."""

    path: str
    buckets: int = BUCKETS

    def _table(self, spark: SparkSession, kind: str) -> str:
        """Name of the table in the session's catalogue, which is told of it, and of the folders it has, when first asked."""
        name = f"options_{kind}_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not spark.catalog.tableExists(name):
            columns, folders, order = (BARS, "underlying, day", "contract, ts") if kind == "bars" else (CONTRACTS, "underlying", "contract")
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({folders}) CLUSTERED BY (contract) SORTED BY ({order}) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'"
            )
            if exists(spark, f"{self.path}/{kind}"):
                spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def _replace(self, rows: DataFrame, kind: str, folders: Sequence[str]) -> None:
        """Write folders anew. Rows are dealt by folder and bucket, so that each bucket of a folder is one file."""
        name = self._table(rows.sparkSession, kind)
        dealt = rows.repartition(*folders, F.pmod(F.hash("contract"), F.lit(self.buckets)))
        dealt.write.option("partitionOverwriteMode", "dynamic").insertInto(name, overwrite=True)

    def save_bars(self, new: DataFrame, source: str = "", order: Sequence[str] = ()) -> None:
        """Merge option bars (contract, ts, prices, volume; underlying or symbol) by contract and time.

        The new load wins over what is stored; inside it, the row that is last by ``order``, which stands for its place in the file.
        """
        spark = new.sparkSession
        owner = "underlying" if "underlying" in new.columns else "symbol"
        keyed = new.withColumnRenamed(owner, "_owner") if owner != "_owner" else new
        load = normalise(keyed, source, ("contract", "_owner", *order)).withColumnRenamed("_owner", "underlying").withColumn("day", F.to_date("ts"))
        load = stage(merge_loads(load.limit(0), load, ("contract", "ts", "underlying", "day"), order).select(*_names(BARS)), "option-load")
        touched = load.select("underlying", "day").distinct()
        stored = spark.table(self._table(spark, "bars")).join(touched, ["underlying", "day"], "left_semi")
        # Staged first: the folders that are replaced are read as well.
        merged = stage(merge_loads(stored, load, ("contract", "ts", "underlying", "day")).select(*_names(BARS)), "option-merged")
        self._replace(merged, "bars", ["underlying", "day"])

    def save_contracts(self, new: DataFrame, order: Sequence[str] = ()) -> None:
        """Merge contracts by their symbol; the last one wins, as in ``save_bars``."""
        spark = new.sparkSession
        load = new.select(*_names(CONTRACTS), *order)
        load = stage(merge_loads(load.limit(0), load, ("contract", "underlying"), order).select(*_names(CONTRACTS)), "contract-load")
        stored = spark.table(self._table(spark, "contracts")).join(load.select("underlying").distinct(), "underlying", "left_semi")
        merged = stage(merge_loads(stored, load, ("contract", "underlying")).select(*_names(CONTRACTS)), "contract-merged")
        self._replace(merged, "contracts", ["underlying"])

    def bars(self, spark: SparkSession, underlyings: Sequence[str] | None = None, start: str | None = None, end: str | None = None, contracts: Sequence[str] | None = None) -> DataFrame:
        """Stored bars; underlyings and days prune folders, contracts reach the Parquet filter, by which their files are sorted."""
        df = spark.table(self._table(spark, "bars"))
        if underlyings is not None:
            df = df.filter(F.col("underlying").isin(*underlyings))
        if start is not None:
            df = df.filter(F.col("day") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.filter(F.col("day") <= F.lit(end).cast("date"))
        return df if contracts is None else df.filter(F.col("contract").isin(*contracts))

    def contracts(self, spark: SparkSession, underlyings: Sequence[str] | None = None) -> DataFrame:
        df = spark.table(self._table(spark, "contracts"))
        return df if underlyings is None else df.filter(F.col("underlying").isin(*underlyings))

    def bars_with_contracts(self, spark: SparkSession, underlyings: Sequence[str] | None = None) -> DataFrame:
        """Bars beside their contract's terms, joined bucket by bucket."""
        terms = self.contracts(spark, underlyings).drop("underlying")
        return self.bars(spark, underlyings).join(terms.hint("merge"), "contract")

    def bars_of_days(self, days: DataFrame) -> DataFrame:
        """Bars of the (underlying, day) pairs of a table; only the folders of days in it are read."""
        spark = days.sparkSession
        return self.bars(spark).join(days.select("underlying", "day").distinct(), ["underlying", "day"])

    def traded_days(self, spark: SparkSession) -> DataFrame:
        """Bars per contract and day, counted where they lie."""
        return self.bars(spark).groupBy("contract", "day").agg(F.count(F.lit(1)).alias("n_bars"))

    def underlyings(self, spark: SparkSession) -> DataFrame:
        """Underlyings that have bars, and on how many days: from the names of the folders, no file is opened."""
        days = spark.sql(f"SHOW PARTITIONS {self._table(spark, 'bars')}").select(F.split("partition", "/").alias("_p"))
        value = lambda i: F.url_decode(F.substring_index(F.col("_p")[i], "=", -1))
        return days.groupBy(value(0).alias("underlying")).agg(F.count(F.lit(1)).alias("n_days"), F.min(value(1).cast("date")).alias("first_day"), F.max(value(1).cast("date")).alias("last_day"))
