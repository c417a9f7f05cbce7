"""Small joins and table helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 8) -> DataFrame:
    """Doubles rounded for comparison or display; infinities and nulls stay."""
    names = set(columns)
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def with_rows_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def with_names(df: DataFrame, names: DataFrame, key: str = "symbol", name: str = "name") -> DataFrame:
    """Left join to the non-empty names of an instrument table."""
    known = names.filter(F.trim(F.col(name)) != "").select(key, name)
    return df.join(known, key, "left")


def truth_beside_predictions(predictions: DataFrame, labelled: DataFrame) -> DataFrame:
    """Predicted bars that also carry a label, side by side."""
    truth = labelled.select("symbol", "ts", F.col("label").alias("true_label"))
    return predictions.join(truth, ["symbol", "ts"])


def by_split_dates(df: DataFrame, split_dates: DataFrame) -> DataFrame:
    """Rows tagged with the split their date belongs to."""
    return df.join(split_dates.select("date", "split").distinct(), "date")
