"""The coverage queue: earnings dates against the freshness of a company's data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.functions import labels

# Rank of each status in the queue.
PRIORITY = ("due", "upcoming", "covered", "unknown")


def nodes_earnings(nodes: DataFrame, earnings: DataFrame) -> DataFrame:
    """Listed nodes with their call time; a time of zero counts as missing."""
    dates = earnings.select("id", F.coalesce("ts", "start").alias("_at"))
    return (
        nodes.filter(F.coalesce("ticker", F.lit("")) != "")
        .join(dates, "id", "left")
        .withColumn("call_seconds", F.nullif("_at", F.lit(0)))
        .drop("_at")
    )


def coverage(listed: DataFrame, now_seconds: int) -> DataFrame:
    """Add status, days and staleness; ``listed`` has last_data and n_signals."""
    state = labels.call_status(
        F.col("call_seconds"), F.col("last_data"), F.lit(now_seconds)
    )
    now = F.timestamp_seconds(F.lit(now_seconds))
    return listed.withColumn("_s", state).select(
        *listed.columns,
        F.col("_s.status").alias("status"),
        F.col("_s.days").alias("days"),
        labels.is_stale(F.col("last_data"), now).alias("stale"),
    )


def _upcoming_soon():
    return (F.col("status") == "upcoming") & (F.col("days") <= fixed.UPCOMING_DAYS)


def coverage_counts(rows: DataFrame) -> DataFrame:
    """Calls due, upcoming within two weeks, stale companies, companies without signals."""
    return rows.agg(
        F.count_if(F.col("status") == "due").alias("due"),
        F.count_if(_upcoming_soon()).alias("upcoming"),
        F.count_if("stale").alias("stale"),
        F.count_if(F.col("n_signals") == 0).alias("no_data"),
    )


def coverage_filter(rows: DataFrame, mode: str = "all", query: str = "") -> DataFrame:
    """Rows of one mode whose id or ticker contains the query, ignoring case."""
    wanted = {
        "all": F.lit(True),
        "due": F.col("status") == "due",
        "upcoming": _upcoming_soon(),
        "stale": F.col("stale"),
        "no-data": F.col("n_signals") == 0,
    }[mode]
    text = query.strip().lower()
    named = F.contains(F.lower("id"), F.lit(text)) | F.contains(F.lower("ticker"), F.lit(text))
    return rows.filter(wanted & (named if text else F.lit(True)))


def coverage_sort(rows: DataFrame, key: str = "priority", descending: bool = False) -> DataFrame:
    """Queue order (due, upcoming, covered, unknown; days inside) or one column."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("status"))
    by_name = F.when(F.col("status") == "unknown", F.collate("id", "UNICODE"))
    order = {
        "priority": [place, F.when(F.col("status") != "unknown", F.col("days")), by_name],
        "company": [F.collate("id", "UNICODE")],
        "call": [F.coalesce("call_seconds", F.lit(9223372036854775807))],
        "last_data": [F.coalesce(F.col("last_data").cast("string"), F.lit(""))],
        "signals": [F.col("n_signals")],
    }[key]
    return rows.orderBy(*[c.desc() if descending else c.asc() for c in order], "id")
