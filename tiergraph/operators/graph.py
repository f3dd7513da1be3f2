"""The merged company graph, kept in normal form.

Nodes, memberships, roles, signals and edges are separate tables with one row
per fact. A company that occurs in a large share of all rows therefore never
becomes one large row; ordered lists are made by sorting ``ord`` where a view
asks for them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.functions.market import node_size
from tiergraph.operators.ordering import first_rows, positions

FACETS = ("layer", "domain", "sector", "chain")


@dataclass
class Graph:
    """The tables of one merged graph."""

    nodes: DataFrame
    memberships: DataFrame
    roles: DataFrame
    signals: DataFrame
    edges: DataFrame


# --- merging ---------------------------------------------------------------------


def memberships(players: DataFrame) -> DataFrame:
    """Distinct (company, facet, value) with the place it was first seen.

    A company's players come together as one row each, before they become a row per facet; a
    hub is split over tasks, and each sends one row per distinct value on. Blank sectors are
    left out.
    """
    facet = lambda name, value: F.struct(
        F.lit(name).alias("facet"), value.alias("value")
    )
    layer = F.when(F.col("kind") == "layer", F.col("slug"))
    domain = F.when(F.col("kind") == "domain", F.col("slug"))
    sector = F.nullif(F.col("sector"), F.lit(""))
    pairs = F.array(
        facet("layer", layer), facet("domain", domain), facet("sector", sector),
        facet("chain", F.col("chain")),
    )
    return (
        players.select("company", "ord", "kind", "slug", "sector", "chain")
        .hint("rebalance", "company")
        .select("company", "ord", F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("company", "facet", "value")
        .agg(F.min("ord").alias("ord"))
        .withColumnRenamed("company", "id")
    )


def ordered_memberships(members: DataFrame) -> DataFrame:
    """Memberships with their place in the company's first-seen list of that facet."""
    return positions(members, ["id", "facet"], [F.col("ord")], "place")


def company_nodes(players: DataFrame) -> DataFrame:
    """One row per company with the place it was first seen."""
    return players.groupBy(F.col("company").alias("id")).agg(F.min("ord").alias("ord"))


def attach_metadata(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add ticker, exchange and country (null without metadata) and status (``public``)."""
    meta = metadata.select(
        F.col("company").alias("id"), "ticker", "exchange", "country", "status"
    )
    return nodes.join(meta, "id", "left").withColumn(
        "status", F.coalesce("status", F.lit("public"))
    )


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """First statement of every (company, quarter, signal); nulls are equal."""
    return (
        signals.groupBy("company", "quarter", "signal")
        .agg(F.min_by(F.struct("figure", "chain", "ord"), "ord").alias("kept"))
        .select("company", "quarter", "signal", "kept.*")
    )


# --- shape of the graph ----------------------------------------------------------


def primary_group(members: DataFrame, default: str) -> DataFrame:
    """First layer, else first domain, else ``default``, per company."""
    first = lambda facet: F.min_by(
        F.when(F.col("facet") == facet, F.col("value")),
        F.when(F.col("facet") == facet, F.col("ord")),
    )
    return members.groupBy("id").agg(
        F.coalesce(first("layer"), first("domain"), F.lit(default)).alias("primary")
    )


def first_groups(players: DataFrame, default: str) -> DataFrame:
    """One row per company: ``primary`` as by ``primary_group``, and the first ``sector``.

    The same as from ``memberships``, read off the players by one aggregation.
    """
    def first(value: Column) -> Column:
        return F.min(F.when(value.isNotNull(), F.struct("ord", value.alias("value"))))["value"]

    of_kind = lambda kind: first(F.when(F.col("kind") == kind, F.col("slug")))
    return players.groupBy(F.col("company").alias("id")).agg(
        F.coalesce(of_kind("layer"), of_kind("domain"), F.lit(default)).alias("primary"),
        first(F.nullif(F.col("sector"), F.lit(""))).alias("sector"),
    )


def degree(edges: DataFrame) -> DataFrame:
    """Edges in and out of every endpoint; parallel edges count each."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(members: DataFrame, least: int = 2) -> DataFrame:
    """Companies in at least ``least`` chains, most chains first."""
    chains = members.filter(F.col("facet") == "chain").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_chains"), F.min("ord").alias("ord")
    )
    return chains.filter(F.col("n_chains") >= least).orderBy(F.col("n_chains").desc(), "ord")


def graph_summary(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of nodes, edges and visible links as (measure, n)."""
    counted = [
        t.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
        for name, t in (("nodes", nodes), ("edges", edges), ("visible_links", links))
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def counterparties(edges: DataFrame, side: str) -> DataFrame:
    """Customers (``side='out'``) or suppliers (``'in'``) of every company.

    Parallel edges merge: the first relationship is kept and contracts are
    counted. ``ord`` is the first edge; customers are read by ``-n_contracts,
    ord``. The contracts themselves stay rows (``explode_contracts``).
    """
    me, other = ("source", "target") if side == "out" else ("target", "source")
    return edges.groupBy(F.col(me).alias("id"), F.col(other).alias("other")).agg(
        F.min_by("relationship", "ord").alias("relationship"),
        F.sum(F.size("contracts").cast("bigint")).alias("n_contracts"),
        F.count(F.lit(1)).alias("n_edges"),
        F.min("ord").alias("ord"),
    )


def counterparty_contracts(edges: DataFrame, side: str) -> DataFrame:
    """Contracts with every counterparty as rows, numbered in the order of the edges.

    Contracts of parallel edges follow each other, as if their lists were put together.
    """
    me, other = ("source", "target") if side == "out" else ("target", "source")
    rows = edges.select(
        F.col(me).alias("id"), F.col(other).alias("other"), "ord",
        F.posexplode("contracts").alias("_at", "contract"),
    )
    return positions(rows, ["id", "other"], [F.col("ord"), F.col("_at")], "position").select(
        "id", "other", "position", "contract"
    )


def supplier_split(parties: DataFrame, k: int = 18) -> DataFrame:
    """All counterparties with contracts, and the first ``k`` without any."""
    deals = parties.filter(F.col("n_contracts") > 0).withColumn("rank", F.lit(None).cast("int"))
    plain = first_rows(parties.filter(F.col("n_contracts") == 0), ["id"], [F.col("ord")], k)
    return deals.unionByName(plain)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both views of every edge, one row per (company, side), in edge order by ``ord``."""
    sides = F.array(
        F.struct(F.lit("out").alias("side"), F.col("source").alias("id"),
                 F.col("target").alias("other")),
        F.struct(F.lit("in").alias("side"), F.col("target").alias("id"),
                 F.col("source").alias("other")),
    )
    return edges.select("relationship", "contracts", "chain", "ord", F.inline(sides))


def edges_between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges a -> b (way 0), then b -> a (way 1)."""
    way = F.when((F.col("source") == a) & (F.col("target") == b), 0).when(
        (F.col("source") == b) & (F.col("target") == a), 1
    )
    return edges.withColumn("way", way).filter(F.col("way").isNotNull()).orderBy("way", "ord")


def broken_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is not a player."""
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


def isolated_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that are neither source nor target; a self-loop in ``links`` connects."""
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_anti")


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are known."""
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(
        known.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def external_targets(edges: DataFrame, players: DataFrame) -> DataFrame:
    """Targets that are no player of the edge's own chain, numbered by appearance."""
    inside = players.select("chain", F.col("company").alias("target")).distinct()
    outside = (
        edges.groupBy("chain", "target")
        .agg(F.min("ord").alias("ord"))
        .join(inside, ["chain", "target"], "left_anti")
    )
    return positions(outside, ["chain"], [F.col("ord")], "number")


# --- filters ---------------------------------------------------------------------


def visible_nodes(
    nodes: DataFrame,
    members: DataFrame,
    chains: Iterable[str],
    layers: Iterable[str],
    domains: Iterable[str],
) -> DataFrame:
    """Nodes in a selected chain (or in none) and in a selected group (or in none)."""
    facet, value = F.col("facet"), F.col("value")

    def hit(name: str, wanted: Iterable[str]) -> Column:
        wanted = list(wanted)
        return (facet == name) & (value.isin(*wanted) if wanted else F.lit(False))

    flags = members.groupBy("id").agg(
        F.bool_or(facet == "chain").alias("_in_chain"),
        F.bool_or(hit("chain", chains)).alias("_chain_hit"),
        F.bool_or(facet.isin("layer", "domain")).alias("_in_group"),
        F.bool_or(hit("layer", layers) | hit("domain", domains)).alias("_group_hit"),
    )
    off = F.lit(False)
    return (
        nodes.join(flags, "id", "left")
        .filter(~F.coalesce("_in_chain", off) | F.coalesce("_chain_hit", off))
        .filter(~F.coalesce("_in_group", off) | F.coalesce("_group_hit", off))
        .select(*nodes.columns)
    )


def visible_links(edges: DataFrame, visible: DataFrame, chains: Iterable[str]) -> DataFrame:
    """Edges of a selected chain between two visible nodes."""
    return resolved_edges(edges.filter(F.col("chain").isin(*chains)), visible)


def search_names(visible: DataFrame) -> DataFrame:
    """Names of visible nodes in locale order."""
    return visible.select("id").orderBy(F.collate("id", "UNICODE"))


# --- views -----------------------------------------------------------------------


def attach_group_dims(nodes: DataFrame, taxonomy: DataFrame, slug: str = "primary") -> DataFrame:
    """Name, colour and place of a group; unknown slugs keep their slug and a grey."""
    dims = F.broadcast(
        taxonomy.select(
            F.col("slug").alias(slug),
            F.col("name").alias("group_name"),
            F.col("color").alias("group_color"),
        )
    )
    return (
        nodes.join(dims, slug, "left")
        .withColumn("group_name", F.coalesce("group_name", slug))
        .withColumn("group_color", F.coalesce("group_color", F.lit(fixed.DEFAULT_GROUP_COLOR)))
    )


def has_report(nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """Flag nodes that some report is about."""
    keys = reports.select(F.col("node").alias("id")).distinct().withColumn("_r", F.lit(True))
    return nodes.join(keys, "id", "left").withColumn(
        "has_report", F.coalesce("_r", F.lit(False))
    ).drop("_r")


def report_for(nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """Each node with its report, or null."""
    return nodes.join(
        reports.select(F.col("node").alias("id"), "report"), "id", "left"
    )


def top_contracts(edges: DataFrame, k: int = 3) -> DataFrame:
    """Edges with only their first ``k`` contracts."""
    return edges.withColumn("contracts", F.slice("contracts", 1, k))


def view_links(edges: DataFrame, chain_colors: DataFrame) -> DataFrame:
    """Links as drawn: three contracts and the colour of their chain."""
    colors = F.broadcast(chain_colors.select("chain", F.col("color").alias("_c")))
    return (
        top_contracts(edges)
        .join(colors, "chain", "left")
        .withColumn("color", F.coalesce("_c", F.lit(fixed.DEFAULT_CHAIN_COLOR)))
        .drop("_c")
    )


def sized_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree (0 when unconnected) and drawn size."""
    return (
        nodes.join(degree(edges), "id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("size", node_size(F.col("degree")))
    )


# --- inventories -----------------------------------------------------------------


def name_inventory(players: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (name, chain) over every player and every target."""
    named = players.select(F.col("company").alias("name"), "chain")
    return named.unionByName(edges.select(F.col("target").alias("name"), "chain")).distinct()


def shared_names(inventory: DataFrame, least: int = 2) -> DataFrame:
    """Names found in at least ``least`` chains."""
    return (
        inventory.groupBy("name")
        .agg(F.count(F.lit(1)).alias("n_chains"))
        .filter(F.col("n_chains") >= least)
    )


def metadata_gaps(nodes: DataFrame) -> DataFrame:
    """Nodes without a country."""
    return nodes.filter(F.coalesce("country", F.lit("")) == "")
