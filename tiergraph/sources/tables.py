"""Readers of study tables: calls, flags, prices, run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.sources import schemas
from tiergraph.sources.documents import exists


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Earnings calls; a byte-order mark before the header is tolerated."""
    return spark.read.schema(schemas.CALLS).option("header", True).csv(path)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Distinct companies whose flag is ``1``."""
    rows = spark.read.schema(schemas.FLAGS).option("header", True).csv(path)
    return rows.filter(F.col("flag") == "1").select("company").distinct()


def long_prices(wide: DataFrame, date: str, tickers: Sequence[str]) -> DataFrame:
    """Wide closes (one column per ticker) as ``(date, ticker, close)``.

    NaN becomes null; rows stay, since a date without a close is a trading day.
    """
    closes = wide.select(date, *[F.col(f"`{t}`").cast("double").alias(t) for t in tickers])
    melted = closes.unpivot([date], [F.col(f"`{t}`") for t in tickers], "ticker", "close")
    return melted.select(
        F.col(date).cast("date").alias("date"),
        "ticker",
        F.nanvl("close", F.lit(None).cast("double")).alias("close"),
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Wide price file: a date column, then one column of closes per ticker."""
    header = spark.read.option("header", True).csv(path).columns
    fields = [T.StructField(header[0], T.DateType())]
    fields += [T.StructField(t, T.DoubleType()) for t in header[1:]]
    wide = spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
    return long_prices(wide, header[0], header[1:])


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Run history, oldest first; empty before the first run."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.HISTORY)
    return spark.read.schema(schemas.HISTORY).parquet(path).orderBy("written_at", "note")
