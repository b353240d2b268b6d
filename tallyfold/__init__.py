"""Spark-native SQL over self-describing CSV folders and Parquet tables."""

from tallyfold.engine import Engine

__all__ = ["Engine"]
