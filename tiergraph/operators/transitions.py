"""Who keeps, gains or loses a place between two generations of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions.display import DOT
from tiergraph.operators.ordering import positions


def transition_status(members: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Status of every company in every transition it takes part in.

    In both = retained, only in the new chains = gained, only in the old =
    lost. ``to_chains`` lists its successor chains in catalogue order.
    """
    chains = members.filter(F.col("facet") == "chain").select("id", F.col("value").alias("chain"))
    seen = chains.join(F.broadcast(catalogue), "chain").groupBy("transition", "id").agg(
        F.bool_or(F.col("side") == "from").alias("_from"),
        F.bool_or(F.col("side") == "to").alias("_to"),
        F.array_sort(
            F.collect_set(F.when(F.col("side") == "to", F.struct("place", "chain")))
        ).alias("_successors"),
    )
    status = F.when(F.col("_from") & F.col("_to"), "retained").when(F.col("_to"), "gained")
    return seen.select(
        "transition",
        "id",
        status.otherwise("lost").alias("status"),
        F.transform("_successors", lambda s: s["chain"]).alias("to_chains"),
    )


def side_products(roles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct products of a company on each side of each transition, first seen first."""
    return (
        roles.filter(F.col("product") != "")
        .join(catalogue.select("transition", "side", "chain"), "chain")
        .groupBy("transition", "side", F.col("company").alias("id"), "product")
        .agg(F.min("ord").alias("ord"))
    )


def product_rows(roles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``side_products`` numbered in order inside (transition, side, company)."""
    keys = ["transition", "side", "id"]
    return positions(side_products(roles, catalogue), keys, [F.col("ord")])


def changed_products(rows: DataFrame) -> DataFrame:
    """``(transition, id, differs)`` for companies with products on both sides.

    The lists are compared place by place, so a hub's list is never one cell.
    """
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("product")))
    places = rows.groupBy("transition", "id", "position").agg(side("from").alias("a"), side("to").alias("b"))
    return (
        places.groupBy("transition", "id")
        .agg(
            F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"),
            F.count("a").alias("_a"), F.count("b").alias("_b"),
        )
        .filter("_a > 0 and _b > 0")
        .select("transition", "id", "differs")
    )


def transition(
    members: DataFrame,
    roles: DataFrame,
    catalogue: DataFrame,
    groups: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
) -> DataFrame:
    """Status rows with the products of both sides and whether they differ.

    The products of a side are joined whole, in order. With ``groups`` (``id``,
    ``primary``) and ``taxonomy`` every row also has its company's primary group and
    ``group_place``: layers in their order, then domains, then unknown groups; rows
    are listed by it and the name.
    """
    items = F.array_sort(F.collect_list(F.struct("ord", "product")))
    joined = F.array_join(F.transform(items, lambda x: x["product"]), DOT)
    lists = side_products(roles, catalogue).groupBy("transition", "id", "side").agg(
        joined.alias("products")
    )
    sides = lists.groupBy("transition", "id").agg(
        F.max(F.when(F.col("side") == "from", F.col("products"))).alias("product_from"),
        F.max(F.when(F.col("side") == "to", F.col("products"))).alias("product_to"),
    )
    changed = changed_products(product_rows(roles, catalogue))
    differs = (F.col("status") == "retained") & F.col("differs")
    rows = (
        transition_status(members, catalogue)
        .join(sides, ["transition", "id"], "left")
        .join(changed, ["transition", "id"], "left")
        .withColumn("product_changed", F.coalesce(differs, F.lit(False)))
        .drop("differs")
    )
    if groups is None:
        return rows
    place = F.when(F.col("kind") == "layer", F.col("place")).when(
        F.col("kind") == "domain", F.col("place") + 100
    )
    order = taxonomy.select(F.col("slug").alias("primary"), place.alias("_place"))
    return (
        rows.join(groups, "id", "left")
        .join(order, "primary", "left")
        .withColumn("group_place", F.coalesce("_place", F.lit(150)))
        .drop("_place")
    )


def transition_counts(status: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Retained, gained and lost companies per transition, zero-filled."""
    counts = status.groupBy("transition").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("retained", "gained", "lost")]
    )
    return (
        catalogue.select("transition").distinct()
        .join(counts, "transition", "left")
        .na.fill(0, ["retained", "gained", "lost"])
    )


def node_exposure(status: DataFrame, company: str) -> DataFrame:
    """One company over all transitions it takes part in, with the columns of ``status``."""
    return status.filter(F.col("id") == company)
