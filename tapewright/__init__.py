"""Intraday market-data analytics written as Spark DataFrame operators."""

from tapewright.session import build_session

__all__ = ["build_session"]
