"""Add-only merging, replace-latest and price top-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _absent(new: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``base``; null keys match each other."""
    known = base.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return new.join(known, match, "left_anti")


def additions(base: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of every key of ``new`` that ``base`` lacks."""
    others = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_v"))
    return _absent(first, base, keys).select(*keys, "_v.*").select(*new.columns)


def merge_additions(base: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Base rows untouched, plus the first new row of every key they lack."""
    return base.unionByName(additions(base, new.select(*base.columns), keys, order))


def lost_rows(base: DataFrame, merged: DataFrame) -> DataFrame:
    """Base rows a merge failed to keep; empty when it only added."""
    return base.exceptAll(merged)


def merge_contracts(base: DataFrame, new: DataFrame) -> DataFrame:
    """Append contracts to edges: rows of ``explode_contracts`` shape, exact repeats ignored."""
    keys = ["source", "target", "chain", "contract"]
    return merge_additions(base, new, keys, "ord")


def replace_latest(
    table: DataFrame, new: DataFrame, keys: Sequence[str], asof: str
) -> DataFrame:
    """Newest row per key of both tables; on a tie the new table's row wins."""
    others = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).unionByName(
        new.select(*table.columns).withColumn("_new", F.lit(1))
    )
    latest: Column = F.max_by(F.struct(*others), F.struct(F.coalesce(asof, F.lit("")), "_new"))
    return both.groupBy(*keys).agg(latest.alias("_v")).select(*keys, "_v.*")


def add_price_columns(prices: DataFrame, fetched: DataFrame) -> DataFrame:
    """Long prices plus the rows of tickers that are not present yet."""
    present = prices.select("ticker").distinct()
    return prices.unionByName(
        fetched.join(present, "ticker", "left_anti").select(*prices.columns)
    )


def missing_tickers(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """Wanted tickers without any price row."""
    return wanted.select("ticker").distinct().join(
        prices.select("ticker"), "ticker", "left_anti"
    )


def segment_totals_check(
    segments: DataFrame, totals: DataFrame, key: str, tolerance: float = 0.005
) -> DataFrame:
    """Stated totals against the sum of their segments."""
    sums = segments.groupBy(key).agg(F.sum("value").alias("segment_sum"))
    gap = F.abs(F.col("segment_sum") - F.col("total"))
    return totals.join(sums, key, "left").withColumn(
        "consistent", F.coalesce(gap <= tolerance * F.abs(F.col("total")), F.lit(False))
    )
