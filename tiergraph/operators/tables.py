"""Display tables: timelines, capex and backlog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.sources.dims import ranks


def tidy_timelines(timelines: DataFrame) -> DataFrame:
    """One row per table cell; ragged rows keep the cells they have.

    A cell beyond the stated columns has a null column name.
    """
    return (
        timelines.select("id", F.posexplode("tables").alias("table_no", "t"))
        .select(
            "id", "table_no", F.col("t.title").alias("title"), F.col("t.columns").alias("_cols"),
            F.posexplode("t.rows").alias("row_no", "r"),
        )
        .select("id", "table_no", "title", "row_no", "_cols",
                F.posexplode("r").alias("col_no", "value"))
        .select(
            "id", "table_no", "title", "row_no", "col_no",
            F.get("_cols", F.col("col_no")).alias("column"), "value",
        )
    )


def timeline_order(
    timelines: DataFrame, order: Sequence[str] = fixed.TIMELINE_ORDER
) -> DataFrame:
    """Timelines of the fixed list first (``rank`` 999 for the others), ties by id."""
    known = F.broadcast(ranks(timelines.sparkSession, order, "id"))
    return (
        timelines.join(known, "id", "left")
        .withColumn("rank", F.coalesce("rank", F.lit(999)))
        .orderBy("rank", "id")
    )


def timelines_by_category(
    ordered: DataFrame, order: Sequence[str] = fixed.CATEGORY_ORDER
) -> DataFrame:
    """Categories (``other`` when blank) with their number of timelines, in tab order.

    Listed categories come first, the others in the order their first timeline
    appears.
    """
    known = F.broadcast(ranks(ordered.sparkSession, order, "category"))
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("other"))
    return (
        ordered.withColumn("category", category)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "id")).alias("_first"))
        .join(known.withColumnRenamed("rank", "_known"), "category", "left")
        .orderBy(F.coalesce("_known", F.lit(999)), "_first")
        .select("category", "n", F.coalesce("_known", F.lit(999)).alias("place"))
    )


def capex_tables(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tiles, bars of both blocks and group rows of the nested document."""
    tiles = document.select(F.inline("tiles"))
    blocks = F.array(
        F.struct(F.lit("capex").alias("block"), F.col("capex_bars").alias("b")),
        F.struct(F.lit("backlog").alias("block"), F.col("backlog_bars").alias("b")),
    )
    bars = (
        document.select(F.inline(blocks))
        .select("block", F.col("b.title").alias("title"), F.col("b.unit").alias("unit"),
                F.posexplode("b.bars").alias("bar_no", "bar"))
        .select("block", "title", "unit", "bar_no", "bar.*")
    )
    rows = (
        document.select(F.posexplode("groups").alias("group_no", "g"))
        .select("group_no", F.col("g.title").alias("title"),
                F.posexplode("g.rows").alias("row_no", "r"))
        .select("group_no", "title", "row_no", "r.*")
    )
    return tiles, bars, rows


def bar_fraction(bars: DataFrame, block: str = "block", value: str = "busd") -> DataFrame:
    """Each bar as a share of its block's largest, four decimals."""
    largest = bars.groupBy(block).agg(F.max(value).alias("_max"))
    return (
        bars.join(largest, block)
        .withColumn("fraction", F.round(F.col(value) / F.nullif("_max", F.lit(0.0)), 4))
        .drop("_max")
    )
