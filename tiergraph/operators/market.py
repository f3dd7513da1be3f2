"""Price ranges, quotes and symbols shared by several companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.functions.market import half_up, market_symbol
from tiergraph.operators.ordering import first_rows

DAY = 86400


def symbol_fanout(companies: DataFrame, feed: DataFrame) -> DataFrame:
    """Give every company the feed row of its symbol; several may share one."""
    symbol = market_symbol(F.col("ticker"), F.col("exchange"))
    return companies.withColumn("symbol", symbol).filter(F.col("symbol").isNotNull()).join(
        feed, "symbol"
    )


def price_ranges(bars: DataFrame, now_seconds: int, year_start_seconds: int) -> DataFrame:
    """Points of each display range; ranges with fewer than two points are dropped.

    ``bars`` are ``(symbol, interval, ts, close)`` with epoch seconds and the
    intervals 5m, 30m, 1d and 1wk.
    """
    interval, ts = F.col("interval"), F.col("ts")

    def span(name: str, of: str, since: int | None = None) -> Column:
        inside = interval == of
        return F.when(inside if since is None else inside & (ts >= since), F.lit(name))

    spans = [
        span("1D", "5m"),
        span("1W", "30m"),
        span("1M", "1d", now_seconds - 31 * DAY),
        span("YTD", "1d", year_start_seconds),
        span("1Y", "1d"),
        span("5Y", "1wk", now_seconds - 5 * 365 * DAY),
        span("All", "1wk"),
    ]
    points = (
        bars.filter(F.col("close").isNotNull() & ~F.isnan("close"))
        .select(
            "symbol",
            F.explode(F.array_compact(F.array(*spans))).alias("range"),
            "ts",
            half_up(F.col("close"), 2).alias("close"),
        )
    )
    full = points.groupBy("symbol", "range").count().filter(F.col("count") >= 2)
    return points.join(full.select("symbol", "range"), ["symbol", "range"], "left_semi")


def series_extent(points: DataFrame) -> DataFrame:
    """First and last time, lowest and highest close of every range."""
    return points.groupBy("symbol", "range").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("close").alias("low"),
        F.max("close").alias("high"),
    )


def quote_snapshot(bars: DataFrame, now_seconds: int) -> DataFrame:
    """Last price, change against the day before, and the range of 365 days.

    ``bars`` are ``(symbol, ts, close)``. Closes collapse to one per day first,
    which bounds what the ranking of days sees.
    """
    stated = bars.filter(F.col("close").isNotNull() & ~F.isnan("close"))
    daily = stated.groupBy("symbol", F.floor(F.col("ts") / DAY).alias("day")).agg(
        F.max_by("close", F.struct("ts", "close")).alias("close")
    )
    two = first_rows(daily, ["symbol"], [F.col("day").desc()], 2).groupBy("symbol").agg(
        F.max(F.when(F.col("rank") == 1, F.col("close"))).alias("last"),
        F.max(F.when(F.col("rank") == 2, F.col("close"))).alias("prev"),
    )
    year = stated.filter(F.col("ts") >= now_seconds - 365 * DAY).groupBy("symbol").agg(
        F.max("close").alias("high"), F.min("close").alias("low")
    )
    prev = F.nullif("prev", F.lit(0.0))
    change = F.floor((F.col("last") - prev) / prev * 10000 + 0.5) / F.lit(100.0)
    return two.join(year, "symbol", "left").select(
        "symbol",
        half_up(F.col("last"), 2).alias("price"),
        change.alias("change_pct"),
        half_up(F.col("high"), 2).alias("year_high"),
        half_up(F.col("low"), 2).alias("year_low"),
    )
