"""The metrics table with its facets, filters and sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions.display import DASH

COLUMNS = {
    "revenue_growth": "growth",
    "guidance": "guidance",
    "backlog_or_b2b": "backlog",
    "supply_status": "supply",
    "next_catalyst": "catalyst",
    "asof": "asof",
}


def metrics_nodes(metrics: DataFrame, nodes: DataFrame) -> DataFrame:
    """Metric rows with their node's ticker; ``known`` tells whether there is a node."""
    found = nodes.select(F.col("id").alias("company"), "ticker", F.lit(True).alias("known"))
    return metrics.join(found, "company", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def screener(
    metrics: DataFrame,
    nodes: DataFrame,
    members: DataFrame,
    group: str | None = None,
    sector: str | None = None,
    chain: str | None = None,
) -> DataFrame:
    """Screener rows that pass the chosen facets.

    A group matches layers and domains. Companies without a node drop out only
    when some facet is chosen. Blanks become ``''`` and a missing ticker a dash.
    """
    rows = metrics_nodes(metrics, nodes)
    for facets, value in ((("layer", "domain"), group), (("sector",), sector), (("chain",), chain)):
        if value is not None:
            hit = members.filter(F.col("facet").isin(*facets) & (F.col("value") == value))
            rows = rows.join(
                hit.select(F.col("id").alias("company")).distinct(), "company", "left_semi"
            )
    if (group, sector, chain) != (None, None, None):
        rows = rows.filter("known")
    return rows.select(
        "company",
        F.coalesce(F.nullif("ticker", F.lit("")), F.lit(DASH)).alias("ticker"),
        *[F.coalesce(old, F.lit("")).alias(new) for old, new in COLUMNS.items()],
    )


def screener_facets(metrics: DataFrame, members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Distinct groups, sectors and chains of nodes with metrics, with a sort place.

    Groups sort canonically (layers, then domains from 100; unknown slugs with
    the first domain), sectors and chains in locale order.
    """
    order = F.broadcast(group_order(taxonomy, 100).withColumnRenamed("slug", "value"))
    kind = F.when(F.col("facet").isin("layer", "domain"), "group").otherwise(F.col("facet"))
    options = (
        members.join(metrics.select(F.col("company").alias("id")), "id", "left_semi")
        .select(kind.alias("facet"), "value")
        .distinct()
        .join(order, "value", "left")
    )
    place = F.when(F.col("facet") == "group", F.coalesce("group_order", F.lit(100)))
    return options.select("facet", "value", place.alias("place")).orderBy(
        "facet", "place", F.collate("value", "UNICODE")
    )


def group_order(taxonomy: DataFrame, unknown: int) -> DataFrame:
    """Sort key of every known slug: layers by place, domains from 100.

    Callers choose the key of unknown slugs: 150 among generations, 100 in the
    screener, 999 in a chain listing; it is carried along as ``unknown_order``.
    """
    key = F.col("place") + F.when(F.col("kind") == "domain", 100).otherwise(0)
    return taxonomy.select("slug", key.alias("group_order"), F.lit(unknown).alias("unknown_order"))


def screener_sort(rows: DataFrame, key: str = "asof", descending: bool = True) -> DataFrame:
    """Rows by one column in code-unit order, blanks as ``''``, ties by company."""
    value = F.coalesce(key, F.lit(""))
    return rows.orderBy(value.desc() if descending else value.asc(), "company")
