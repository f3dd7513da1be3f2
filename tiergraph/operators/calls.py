"""The universe of earnings calls found among company signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import labels
from tiergraph.functions.market import us_listed


def candidate_calls(signals: DataFrame, metadata: DataFrame) -> DataFrame:
    """Signals that are a US-listed company's own, dated earnings call."""
    listed = metadata.filter(us_listed(F.col("ticker"), F.col("exchange"))).select(
        "company", "ticker"
    )
    label = F.coalesce("quarter", F.lit(""))
    return (
        signals.select("company", label.alias("source_label"), "ord")
        .filter(labels.earnings_label(F.col("source_label")))
        .filter(labels.own_call(F.col("company"), F.col("source_label")))
        .withColumn("date", labels.label_date(F.col("source_label")))
        .filter(F.col("date").isNotNull())
        .join(listed, "company")
    )


def dedupe_calls(candidates: DataFrame) -> DataFrame:
    """One call per (ticker, date): the shortest company name, then the first seen."""
    kept = F.min_by(
        F.struct("company", F.trim("source_label").alias("source_label")),
        F.struct(F.length("company"), F.col("ord")),
    )
    return (
        candidates.groupBy("ticker", "date")
        .agg(kept.alias("k"))
        .select("k.company", "ticker", "date", "k.source_label")
    )


def call_range(calls: DataFrame) -> DataFrame:
    """Number of calls and companies, first and last date."""
    return calls.agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.countDistinct("company").alias("n_companies"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def calls_sorted(calls: DataFrame) -> DataFrame:
    """Calls by company name regardless of case."""
    return calls.orderBy(F.lower("company"), "ticker", "date")
