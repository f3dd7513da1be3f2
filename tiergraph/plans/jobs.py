"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.functions import labels
from tiergraph.operators import calls as call_ops
from tiergraph.operators import coverage as cov
from tiergraph.operators import eventstudy as es
from tiergraph.operators import flatten, graph, signals, transitions
from tiergraph.operators.graph import Graph
from tiergraph.operators.ordering import first_rows
from tiergraph.session import cut


def build_graph(chains: DataFrame, metadata: DataFrame) -> Graph:
    """Chain documents and metadata -> merged graph."""
    return merge_players(flatten.explode_players(chains), metadata)


def merge_players(players: DataFrame, metadata: DataFrame) -> Graph:
    """Flattened players and metadata -> merged graph."""
    return Graph(
        nodes=graph.attach_metadata(graph.company_nodes(players), metadata),
        memberships=graph.memberships(players),
        roles=flatten.product_roles(players),
        signals=graph.dedupe_signals(flatten.explode_signals(players)),
        edges=flatten.explode_edges(players),
    )


def node_table(
    g: Graph, taxonomy: DataFrame, reports: DataFrame, now: str, statements: DataFrame | None = None
) -> DataFrame:
    """Nodes with group, degree, size, badges, freshness and report flag.

    ``now`` is a timestamp literal; nothing reads the wall clock. Badges are read from the
    graph's signals, of which repeated ones keep their first figure, or from all ``statements``.
    A company that the metadata list repeatedly is one node.
    """
    fresh = signals.last_data(g.signals).withColumnRenamed("company", "id")
    said = g.signals if statements is None else statements
    badges = signals.node_badges(said).withColumnRenamed("company", "id")
    counts = g.signals.groupBy(F.col("company").alias("id")).agg(
        F.count(F.lit(1)).alias("n_signals")
    )
    known = F.struct(*[c for c in g.nodes.columns if c != "id"])
    nodes = (
        g.nodes.groupBy("id").agg(F.min(known).alias("known")).select("id", "known.*")
        .join(graph.primary_group(g.memberships, "unknown"), "id", "left")
        .withColumn("primary", F.coalesce("primary", F.lit("unknown")))
        .join(fresh, "id", "left")
        .join(badges, "id", "left")
        .join(counts, "id", "left")
    )
    nodes = graph.sized_nodes(nodes, g.edges)
    nodes = graph.has_report(graph.attach_group_dims(nodes, taxonomy), reports)
    moment = F.lit(now).cast("timestamp_ntz")
    return (
        nodes.withColumn("badges", F.coalesce("badges", F.array().cast("array<string>")))
        .withColumn("n_signals", F.coalesce("n_signals", F.lit(0)))
        .withColumn("stale", labels.is_stale(F.col("last_data"), moment))
    )


def enrich_graph(
    g: Graph, taxonomy: DataFrame, chain_colors: DataFrame, reports: DataFrame, now: str
) -> dict[str, DataFrame]:
    """The views a reader draws from: nodes, links and adjacency."""
    return {
        "nodes": node_table(g, taxonomy, reports, now),
        "links": graph.view_links(g.edges, chain_colors),
        "adjacency": graph.adjacency(g.edges),
    }


def top_counterparties(edges: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` customers of every company by contracts, with the company's degree.

    Edges are read once: both results come from the merged counterparties.
    """
    parties = cut(graph.counterparties(edges, "out"))
    ends = parties.select(F.explode(F.array("id", "other")).alias("id"), "n_edges")
    degrees = ends.groupBy("id").agg(F.sum("n_edges").alias("degree"))
    order = [F.col("n_contracts").desc(), F.col("ord")]
    return first_rows(parties, ["id"], order, k).join(degrees, "id")


def extract_calls(sig: DataFrame, metadata: DataFrame) -> DataFrame:
    """The call universe: listed companies' own dated calls, one per ticker and day."""
    return call_ops.dedupe_calls(call_ops.candidate_calls(sig, metadata))


def event_study(
    calls: DataFrame,
    flagged: DataFrame,
    prices: DataFrame,
    benchmarks: Sequence[str] = fixed.BENCHMARKS,
    windows: Sequence[int] = fixed.WINDOWS,
) -> es.Study:
    """Abnormal returns after calls, by group, against benchmarks and the universe."""
    # All result tables come from the calls with the closes they need (one row a call) and
    # from the values laid out of them, which the statistics read several times.
    calendar = cut(es.trading_calendar(prices))
    closes = es.indexed_prices(prices, calendar)
    placed = es.placed_calls(es.assign_group(calls, flagged), prices, calendar)
    quoted = cut(es.quoted_calls(placed, closes, benchmarks, windows))
    returns = es.call_returns(quoted, windows)
    values = cut(es.abnormal_returns(quoted, windows))
    events = es.wide_events(quoted, values, benchmarks, windows)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    values = values.withColumn("copy", copies).drop("copies")
    both = values.unionByName(es.excess_over_universe(values))
    return es.Study(
        events=events,
        values=both,
        universe=es.universe_average(values).withColumn("mean", F.bround("mean", 5)),
        stats=es.group_stats(both),
        excluded=es.exclusions(quoted, returns),
        members=es.window_members(returns),
    )


def coverage_queue(nodes: DataFrame, earnings: DataFrame, now_seconds: int) -> DataFrame:
    """Listed nodes with call status, in queue order."""
    return cov.coverage_sort(cov.coverage(cov.nodes_earnings(nodes, earnings), now_seconds))


def dossiers(
    g: Graph, nodes: DataFrame, catalogue: DataFrame, recent: int = 8, facts: int = 10
) -> dict[str, DataFrame]:
    """Everything a company page shows, for all companies, as one table per section.

    Sections stay rows keyed by company: lists of a hub would not fit one row.
    """
    status = transitions.transition_status(g.memberships, catalogue)
    return {
        "overview": nodes,
        "badges": signals.signal_badges(g.signals),
        "products": g.roles,
        "exposure": status,
        "timeline": signals.company_timeline(g.signals, facts),
        "signals": signals.recent_signals(g.signals, recent),
        "customers": graph.counterparties(g.edges, "out"),
        "suppliers": graph.supplier_split(graph.counterparties(g.edges, "in")),
    }
