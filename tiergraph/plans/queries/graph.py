"""Queries over the merged graph, its filters, views and reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.functions.display import contract_summary
from tiergraph.functions.market import node_size
from tiergraph.operators import flatten, graph, listing, reach, screener, transitions
from tiergraph.operators.ordering import positions
from tiergraph.plans import jobs
from tiergraph.plans import projections as pj
from tiergraph.plans.projections import (
    COMPANIES, EDGES, FEEDS, LINKS, MEMBERS, METADATA, PLAYERS, REACH, REPLY_LINKS, SIGNALS, with_ctes,
)
from tiergraph.plans.registry import query
from tiergraph.session import cut
from tiergraph.sources import dims

TAXONOMY = f"""taxonomy(slug, kind, name, color, place) AS (VALUES {pj.sql_rows(
    [(s, "layer", n, c, i) for i, (s, n, c) in enumerate(fixed.LAYERS)]
    + [(s, "domain", n, c, i) for i, (s, n, c) in enumerate(fixed.DOMAINS)])})"""
PRIMARY = """prim AS (
  SELECT id, coalesce(arg_min(value, ord) FILTER (WHERE facet = 'layer'),
                      arg_min(value, ord) FILTER (WHERE facet = 'domain'), 'unknown') AS "primary"
  FROM members GROUP BY id)"""
DEGREE = """deg AS (
  SELECT id, count(*) AS degree FROM (
    SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"""
CHAINS = ["1-URGENT", "2-HIGH"]
LAYERS = ["memory", "foundry", "minerals"]
DOMAINS = ["power"]
# Two brands against one, one against two, and a successor that does not exist.
GENERATIONS = (
    ("first", ("Brand#1 7", "Brand#2 7"), ("Brand#3 7",)),
    ("second", ("Brand#4 11",), ("Brand#5 11", "Brand#6 11")),
    ("third", ("Brand#7 30",), ("Brand#99 30",)),
)
CATALOGUE = f"""catalogue(transition, side, chain, place) AS (VALUES {pj.sql_rows(
    [(k, s, c, i) for k, old, new in GENERATIONS for s, cs in (("from", old), ("to", new))
     for i, c in enumerate(cs)])})"""
FINE = """fine AS (SELECT company, chain || ' ' || size AS chain, product, ord FROM players)"""


def flat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.memberships(pj.players(spark, sf_dir))


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted rows with their position, so that the check sees their order."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    return positions(placed, [], [F.col("_at")]).drop("_at")


# --- merge ---------------------------------------------------------------------------


@query(with_ctes(PLAYERS, MEMBERS, """
SELECT id, facet, value,
       row_number() OVER (PARTITION BY id, facet ORDER BY ord) - 1 AS place FROM members"""))
def merge_nodes(spark, sf_dir):
    return graph.ordered_memberships(flat_members(spark, sf_dir)).select(
        "id", "facet", "value", "place"
    )


@query(with_ctes(METADATA, PLAYERS, """
SELECT id, nullif(ticker, '') AS ticker, exchange, country, coalesce(status, 'public') AS status
FROM (SELECT DISTINCT company AS id FROM players) LEFT JOIN metadata ON company = id"""))
def attach_metadata(spark, sf_dir):
    nodes = graph.company_nodes(pj.players(spark, sf_dir))
    known = graph.attach_metadata(nodes, pj.metadata(spark, sf_dir))
    return known.select(
        "id", F.nullif("ticker", F.lit("")).alias("ticker"), "exchange", "country", "status"
    )


@query(with_ctes(PLAYERS, """
SELECT company, chain, CASE WHEN kind = 'layer' THEN slug END AS layer,
       CASE WHEN kind = 'domain' THEN slug END AS domain, sector, product, count(*) AS n
FROM players GROUP BY ALL"""))
def product_roles(spark, sf_dir):
    roles = flatten.product_roles(pj.players(spark, sf_dir))
    return roles.groupBy("company", "chain", "layer", "domain", "sector", "product").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(with_ctes(EDGES, """
SELECT source, target, chain, c_source, c_signal, c_units, c_date,
       concat_ws(' · ', c_units, c_date) AS summary
FROM edges WHERE n_contracts > 0"""))
def contracts(spark, sf_dir):
    c = flatten.explode_contracts(pj.edges(spark, sf_dir))
    part = lambda n: F.col(f"contract.{n}")
    return c.select(
        "source", "target", "chain",
        part("source").alias("c_source"), part("signal").alias("c_signal"),
        part("units").alias("c_units"), part("date_signed").alias("c_date"),
        contract_summary(part("units"), part("value"), part("date_signed"), part("type")).alias(
            "summary"
        ),
    )


@query(with_ctes(PLAYERS, """
SELECT company AS id, chain, min(product) AS product, count(*) AS n FROM players
WHERE slug = 'legacy' GROUP BY 1, 2"""))
def unknown_slug_players(spark, sf_dir):
    odd = pj.players(spark, sf_dir).join(
        F.broadcast(dims.taxonomy(spark).select("kind", "slug")), ["kind", "slug"], "left_anti"
    )
    return odd.groupBy(F.col("company").alias("id"), "chain").agg(
        F.min("product").alias("product"), F.count(F.lit(1)).alias("n")
    )


# --- shape ---------------------------------------------------------------------------


@query(with_ctes(EDGES, DEGREE, """
SELECT id, degree, CAST(greatest(4, floor(pow(degree, 1.5))) AS BIGINT) AS size FROM deg"""))
def degree(spark, sf_dir):
    counted = graph.degree(pj.edges(spark, sf_dir))
    return counted.withColumn("size", node_size(F.col("degree")))


@query(with_ctes(PLAYERS, MEMBERS, """
SELECT id, count(*) AS n_chains, row_number() OVER (ORDER BY count(*) DESC, min(ord)) - 1 AS position
FROM members WHERE facet = 'chain' GROUP BY id HAVING count(*) >= 20"""))
def hubs(spark, sf_dir):
    return in_order(graph.hubs(flat_members(spark, sf_dir), 20).select("id", "n_chains"))


@query(with_ctes(EDGES, """
SELECT * FROM (
  SELECT 'out' AS side, source AS id, target AS other, arg_min(relationship, ord) AS relationship,
         sum(n_contracts) AS n_contracts, count(*) AS n_edges FROM edges GROUP BY 2, 3
  UNION ALL
  SELECT 'in', target, source, arg_min(relationship, ord), sum(n_contracts), count(*)
  FROM edges GROUP BY 2, 3)"""))
def counterparties(spark, sf_dir):
    edges = pj.edges(spark, sf_dir)
    sides = [
        graph.counterparties(edges, side).withColumn("side", F.lit(side)) for side in ("out", "in")
    ]
    return sides[0].unionByName(sides[1]).select(
        "side", "id", "other", "relationship", "n_contracts", "n_edges"
    )


@query(with_ctes(EDGES, """
SELECT * FROM (
  SELECT 'out' AS side, source AS id, target AS other, c_source, c_units, c_date,
         row_number() OVER (PARTITION BY source, target ORDER BY ord) - 1 AS position
  FROM edges WHERE n_contracts > 0
  UNION ALL
  SELECT 'in', target, source, c_source, c_units, c_date,
         row_number() OVER (PARTITION BY source, target ORDER BY ord) - 1
  FROM edges WHERE n_contracts > 0)"""))
def counterparty_contracts(spark, sf_dir):
    """The contracts with every counterparty, in the order of the merged edges."""
    edges = pj.edges(spark, sf_dir)
    sides = [
        graph.counterparty_contracts(edges, side).withColumn("side", F.lit(side))
        for side in ("out", "in")
    ]
    return sides[0].unionByName(sides[1]).select(
        "side", "id", "other", F.col("contract.source").alias("c_source"),
        F.col("contract.units").alias("c_units"), F.col("contract.date_signed").alias("c_date"),
        "position",
    )


@query("""
WITH lines AS (
  SELECT o_orderkey, c_name, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY """
       + ", ".join(pj.LINE_ORDER) + """) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT c_name AS source, CAST(o_orderkey AS VARCHAR) AS target, r - 1 AS position,
       CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS units FROM lines WHERE r <= 3""")
def top_contracts(spark, sf_dir):
    """Customer -> order edges whose contracts are the order's lines; three of them are shown."""
    lines = pj.table(spark, sf_dir, "lineitem").select(*pj.LINE_ORDER)
    orders = pj.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = pj.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    # The lines of one order, as long as its document.
    of_order = lines.groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(*pj.LINE_ORDER))),
        lambda line: F.struct(line["l_quantity"].cast("bigint").cast("string").alias("units")),
    ).alias("contracts"))
    edges = of_order.join(orders, "l_orderkey").join(customers, "o_custkey").select(
        F.col("c_name").alias("source"), F.col("l_orderkey").cast("string").alias("target"), "contracts"
    )
    shown = graph.top_contracts(edges).select(
        "source", "target", F.posexplode("contracts").alias("position", "c")
    )
    return shown.select("source", "target", F.col("position").cast("bigint").alias("position"), "c.units")


TOP_PARTIES = with_ctes(EDGES, DEGREE, """
parties AS (
  SELECT source AS id, target AS other, arg_min(relationship, ord) AS relationship,
         sum(n_contracts) AS n_contracts, min(ord) AS ord FROM edges GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY n_contracts DESC, ord) AS rank
  FROM parties)""", """
SELECT r.id, degree, rank, other, relationship, n_contracts
FROM ranked r JOIN deg USING (id) WHERE rank <= 5""")


@query(TOP_PARTIES)
def top_counterparties(spark, sf_dir):
    """The flagship: best counterparties of every supplier, with its degree."""
    return jobs.top_counterparties(pj.edges(spark, sf_dir), 5).select(
        "id", "degree", F.col("rank").cast("bigint").alias("rank"), "other", "relationship",
        "n_contracts",
    )


@query(with_ctes(EDGES, """
parties AS (
  SELECT target AS id, source AS other, sum(n_contracts) AS n_contracts, min(ord) AS ord
  FROM edges GROUP BY 1, 2)""", """
SELECT id, other, n_contracts, CAST(NULL AS BIGINT) AS rank FROM parties WHERE n_contracts > 0
UNION ALL
SELECT id, other, n_contracts, r FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM parties
  WHERE n_contracts = 0) WHERE r <= 18"""))
def supplier_split(spark, sf_dir):
    parties = graph.counterparties(pj.edges(spark, sf_dir), "in")
    return graph.supplier_split(parties).select(
        "id", "other", "n_contracts", F.col("rank").cast("bigint").alias("rank")
    )


@query(with_ctes(EDGES, """
SELECT id, side, count(*) AS n_edges, count(DISTINCT other) AS n_others,
       sum(n_contracts) AS n_contracts FROM (
  SELECT source AS id, 'out' AS side, target AS other, n_contracts FROM edges
  UNION ALL SELECT target, 'in', source, n_contracts FROM edges) GROUP BY id, side"""))
def adjacency_size(spark, sf_dir):
    both = graph.adjacency(pj.edges(spark, sf_dir))
    return both.groupBy("id", "side").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.countDistinct("other").alias("n_others"),
        F.sum(F.size("contracts").cast("bigint")).alias("n_contracts"),
    )


# The first two suppliers, by name, that feed each other.
MUTUAL = """pair AS (
  SELECT min((a.source, a.target)) AS p FROM links a
  JOIN links b ON a.source = b.target AND a.target = b.source)"""


@query(with_ctes(LINKS, MUTUAL, """
SELECT way, source, target, relationship, chain,
       row_number() OVER (PARTITION BY way ORDER BY ord) - 1 AS position FROM (
  SELECT CASE WHEN source = struct_extract(p, 1) THEN 0 ELSE 1 END AS way, feeds.* FROM feeds, pair
  WHERE (source, target) = p OR (target, source) = p)"""))
def edges_between(spark, sf_dir):
    edges = pj.feeds(spark, sf_dir)
    links = cut(reach.distinct_links(edges))
    both = links.join(reach.reversed_edges(links), ["source", "target"])
    a, b = both.agg(F.min(F.struct("source", "target")).alias("p")).first()["p"]
    order = Window.partitionBy("way").orderBy("ord")
    return graph.edges_between(edges, a, b).select(
        F.col("way").cast("bigint").alias("way"), "source", "target", "relationship", "chain",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
    )


@query(with_ctes(FEEDS, """
SELECT source, target, count(*) AS n FROM feeds WHERE target NOT IN (SELECT s_name FROM supplier)
GROUP BY 1, 2"""))
def broken_edges(spark, sf_dir):
    """Only suppliers play a part of their own, so customers are unknown targets."""
    broken = graph.broken_edges(pj.feeds(spark, sf_dir), pj.sellers(spark, sf_dir))
    return broken.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(COMPANIES, EDGES, """
SELECT id FROM (SELECT id FROM companies UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders)
WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges
                 UNION SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem)"""))
def isolated_nodes(spark, sf_dir):
    """Every line links its supplier with its customer and with its order; the rest stands alone."""
    ends = pj.edges(spark, sf_dir).select("source", "target")
    lines = pj.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"),
        F.col("l_orderkey").cast("string").alias("target"),
    )
    orders = pj.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    nodes = pj.companies(spark, sf_dir).unionByName(orders)
    return graph.isolated_nodes(nodes, ends.unionByName(lines))


@query(with_ctes(EDGES, """
outside AS (SELECT chain, target, min(ord) AS ord FROM edges e
  WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey
                    WHERE o_orderpriority = e.chain AND o_orderstatus = 'P'
                      AND c_name = e.target)
  GROUP BY chain, target)""", """
SELECT chain, target, row_number() OVER (PARTITION BY chain ORDER BY ord) - 1 AS number
FROM outside"""))
def external_targets(spark, sf_dir):
    orders = pj.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    customers = pj.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("company")
    )
    inside = orders.join(customers, "o_custkey").select(
        F.col("o_orderpriority").alias("chain"), "company"
    )
    return graph.external_targets(pj.edges(spark, sf_dir), inside).select(
        "chain", "target", "number"
    )




def customer_members(spark, sf_dir):
    return pj.metric_members(spark, sf_dir)


CUSTOMER_VISIBLE = f"""visible AS (
  SELECT c_name AS id FROM customer WHERE
    (c_name NOT IN (SELECT id FROM metric_members WHERE facet = 'chain') OR c_name IN
       (SELECT id FROM metric_members WHERE facet = 'chain' AND value IN ('1-URGENT', '2-HIGH')))
    AND (c_name NOT IN (SELECT id FROM metric_members WHERE facet IN ('layer', 'domain'))
      OR c_name IN (SELECT id FROM metric_members WHERE
        (facet = 'layer' AND list_contains({pj.sql_list(LAYERS)}, value)) OR
        (facet = 'domain' AND list_contains({pj.sql_list(DOMAINS)}, value)))))"""


@query(with_ctes(pj.SCREENER, CUSTOMER_VISIBLE, "SELECT id FROM visible"))
def visible_nodes(spark, sf_dir):
    nodes = pj.table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    return graph.visible_nodes(nodes, customer_members(spark, sf_dir), CHAINS, LAYERS, DOMAINS)


@query(with_ctes(pj.SCREENER, CUSTOMER_VISIBLE, """
SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM visible"""))
def search_names(spark, sf_dir):
    nodes = pj.table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    return in_order(graph.search_names(
        graph.visible_nodes(nodes, customer_members(spark, sf_dir), CHAINS, LAYERS, DOMAINS)
    ))


LINK_VISIBLE = """seen AS (SELECT id FROM visible UNION SELECT s_name FROM supplier)"""


@query(with_ctes(pj.SCREENER, CUSTOMER_VISIBLE, EDGES, LINK_VISIBLE, """
SELECT source, target, chain, count(*) AS n FROM edges
WHERE chain IN ('1-URGENT', '2-HIGH') AND source IN (SELECT id FROM seen)
  AND target IN (SELECT id FROM seen) GROUP BY ALL"""))
def visible_links(spark, sf_dir):
    return _visible_links(spark, sf_dir).groupBy("source", "target", "chain").agg(
        F.count(F.lit(1)).alias("n")
    )


def _visible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = pj.table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    nodes = nodes.unionByName(
        pj.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"))
    )
    visible = graph.visible_nodes(
        nodes, customer_members(spark, sf_dir), CHAINS, LAYERS, DOMAINS
    )
    return graph.visible_links(pj.edges(spark, sf_dir), visible, CHAINS)


@query(with_ctes(pj.SCREENER, CUSTOMER_VISIBLE, EDGES, LINK_VISIBLE, """
SELECT 'nodes' AS measure, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n
UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'visible_links', count(*) FROM edges
WHERE chain IN ('1-URGENT', '2-HIGH') AND source IN (SELECT id FROM seen)
  AND target IN (SELECT id FROM seen)"""))
def graph_summary(spark, sf_dir):
    nodes = pj.table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    nodes = nodes.unionByName(
        pj.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"))
    )
    return graph.graph_summary(nodes, pj.edges(spark, sf_dir), _visible_links(spark, sf_dir))


@query(with_ctes(PLAYERS, MEMBERS, PRIMARY, TAXONOMY, """
SELECT id, p."primary", coalesce(t.name, p."primary") AS group_name,
       coalesce(t.color, '#94a3b8') AS group_color
FROM prim p LEFT JOIN taxonomy t ON t.slug = p."primary" """))
def attach_group_dims(spark, sf_dir):
    primary = graph.first_groups(pj.players(spark, sf_dir), "unknown")
    return graph.attach_group_dims(primary, dims.taxonomy(spark)).select(
        "id", "primary", "group_name", "group_color"
    )


@query(with_ctes(EDGES, """
SELECT source, target, chain, CASE chain WHEN '1-URGENT' THEN '#b91c1c' WHEN '5-LOW' THEN '#34a853'
       ELSE '#8b949e' END AS color, sum(n_contracts) AS n_contracts FROM edges GROUP BY ALL"""))
def view_links(spark, sf_dir):
    colors = spark.createDataFrame(
        [("1-URGENT", "#b91c1c"), ("5-LOW", "#34a853")], "chain string, color string"
    )
    links = graph.view_links(pj.edges(spark, sf_dir), colors)
    return links.groupBy("source", "target", "chain", "color").agg(
        F.sum(F.size("contracts").cast("bigint")).alias("n_contracts")
    )


@query(with_ctes(PLAYERS, EDGES, """
SELECT DISTINCT name, chain FROM (
  SELECT company AS name, chain FROM players UNION ALL SELECT target, chain FROM edges)"""))
def name_inventory(spark, sf_dir):
    return graph.name_inventory(pj.players(spark, sf_dir), pj.edges(spark, sf_dir))


@query(with_ctes(PLAYERS, EDGES, """
SELECT name, count(DISTINCT chain) AS n_chains FROM (
  SELECT company AS name, chain FROM players UNION ALL SELECT target, chain FROM edges)
GROUP BY name HAVING count(DISTINCT chain) >= 5"""))
def shared_names(spark, sf_dir):
    inventory = graph.name_inventory(pj.players(spark, sf_dir), pj.edges(spark, sf_dir))
    return graph.shared_names(inventory, 5)


@query(with_ctes(METADATA, """
SELECT company AS id, status FROM (SELECT *, coalesce(country, '') AS c FROM metadata)
WHERE c = ''"""))
def metadata_gaps(spark, sf_dir):
    meta = pj.metadata(spark, sf_dir).withColumnRenamed("company", "id")
    return graph.metadata_gaps(meta).select("id", "status")


# --- generations -----------------------------------------------------------------------


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = F.concat_ws(" ", "chain", F.col("size").cast("string"))
    return pj.players(spark, sf_dir).withColumn("chain", chain)


def _named(players: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Players of the chains that a catalogue names; no other takes part in its transitions."""
    return players.join(F.broadcast(catalogue.select("chain").distinct()), "chain", "left_semi")


STATUS = """sided AS (
  SELECT transition, company AS id, bool_or(side = 'from') AS f, bool_or(side = 'to') AS t
  FROM fine JOIN catalogue USING (chain) GROUP BY 1, 2),
status AS (
  SELECT transition, id, CASE WHEN f AND t THEN 'retained' WHEN t THEN 'gained' ELSE 'lost' END
    AS status FROM sided)"""
SIDE_PRODUCTS = """prods AS (
  SELECT transition, id, side, string_agg(product, ' · ' ORDER BY ord) AS products FROM (
    SELECT transition, company AS id, side, product, min(ord) AS ord
    FROM fine JOIN catalogue USING (chain) GROUP BY ALL) GROUP BY 1, 2, 3)"""


@query(with_ctes(PLAYERS, MEMBERS, PRIMARY, TAXONOMY, FINE, CATALOGUE, STATUS, SIDE_PRODUCTS, """
SELECT s.transition, s.id, s.status, a.products AS product_from, b.products AS product_to,
       coalesce(s.status = 'retained' AND a.products <> b.products, false) AS product_changed,
       p."primary", row_number() OVER (PARTITION BY s.transition ORDER BY coalesce(
         g.place + CASE g.kind WHEN 'domain' THEN 100 ELSE 0 END, 150), s.id) - 1 AS position,
       coalesce((SELECT string_agg(chain, ',' ORDER BY place) FROM (
          SELECT DISTINCT c.chain, c.place FROM fine f JOIN catalogue c ON f.chain = c.chain
          WHERE c.transition = s.transition AND c.side = 'to' AND f.company = s.id)), '')
         AS to_chains
FROM status s
LEFT JOIN prods a ON a.transition = s.transition AND a.id = s.id AND a.side = 'from'
LEFT JOIN prods b ON b.transition = s.transition AND b.id = s.id AND b.side = 'to'
LEFT JOIN prim p ON p.id = s.id LEFT JOIN taxonomy g ON g.slug = p."primary" """))
def transition(spark, sf_dir):
    catalogue = dims.transitions(spark, GENERATIONS)
    fine = _named(_fine(spark, sf_dir), catalogue)
    rows = transitions.transition(
        graph.memberships(fine), flatten.product_roles(fine), catalogue,
        graph.first_groups(pj.players(spark, sf_dir), "unknown").drop("sector"), dims.taxonomy(spark),
    )
    order = Window.partitionBy("transition").orderBy("group_place", F.collate("id", "UNICODE"), "id")
    return rows.select(
        "transition", "id", "status", "product_from", "product_to", "product_changed", "primary",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        F.array_join("to_chains", ",").alias("to_chains"),
    )


@query(with_ctes(PLAYERS, FINE, CATALOGUE, """
firsts AS (
  SELECT transition, company AS id, side, product, min(ord) AS ord
  FROM fine JOIN catalogue USING (chain) WHERE product <> '' GROUP BY ALL)""", """
SELECT transition, id, side, product,
       row_number() OVER (PARTITION BY transition, id, side ORDER BY ord) - 1 AS position FROM firsts"""))
def transition_products(spark, sf_dir):
    """The products of both sides as rows, in the order they are first named."""
    roles, catalogue = flatten.product_roles(_fine(spark, sf_dir)), dims.transitions(spark, GENERATIONS)
    return transitions.product_rows(roles, catalogue).select(
        "transition", "id", "side", "product", "position"
    )


@query(with_ctes(PLAYERS, FINE, CATALOGUE, STATUS, """
SELECT c.transition, count(*) FILTER (WHERE status = 'retained') AS retained,
       count(*) FILTER (WHERE status = 'gained') AS gained,
       count(*) FILTER (WHERE status = 'lost') AS lost
FROM (SELECT DISTINCT transition FROM catalogue) c LEFT JOIN status USING (transition)
GROUP BY 1"""))
def transition_counts(spark, sf_dir):
    catalogue = dims.transitions(spark, GENERATIONS)
    fine = _named(_fine(spark, sf_dir), catalogue)
    status = transitions.transition_status(graph.memberships(fine), catalogue)
    return transitions.transition_counts(status, catalogue)


@query(with_ctes(PLAYERS, FINE, CATALOGUE, STATUS, SIDE_PRODUCTS, """
SELECT s.transition, s.status, a.products AS product_from, b.products AS product_to
FROM status s
LEFT JOIN prods a ON a.transition = s.transition AND a.id = s.id AND a.side = 'from'
LEFT JOIN prods b ON b.transition = s.transition AND b.id = s.id AND b.side = 'to'
WHERE s.id = 'Supplier#000000001'"""))
def node_exposure(spark, sf_dir):
    fine, catalogue = _fine(spark, sf_dir), dims.transitions(spark, GENERATIONS)
    rows = transitions.transition(graph.memberships(fine), flatten.product_roles(fine), catalogue)
    return transitions.node_exposure(rows, "Supplier#000000001").select(
        "transition", "status", "product_from", "product_to"
    )


# --- reach -----------------------------------------------------------------------------


@query(with_ctes(LINKS, COMPANIES, """
SELECT id AS seed, id AS node, 'self' AS side FROM companies
UNION SELECT source, target, 'out' FROM links UNION SELECT target, source, 'in' FROM links"""))
def neighbours(spark, sf_dir):
    links = reach.distinct_links(pj.feeds(spark, sf_dir))
    return reach.neighbours(links, pj.companies(spark, sf_dir), distinct=True)


#: Companies that a reader has chosen.
CHOSEN = ("Supplier#000000001", "Supplier#000000002")


def _chosen(spark):
    return spark.createDataFrame([(c,) for c in CHOSEN], "id string")


@query(with_ctes(FEEDS, f"""
SELECT source, target, count(*) AS n FROM feeds
WHERE source IN {CHOSEN} OR target IN {CHOSEN} GROUP BY 1, 2"""))
def touching_edges(spark, sf_dir):
    touching = reach.touching_edges(pj.feeds(spark, sf_dir), _chosen(spark))
    return touching.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(LINKS, REACH, "SELECT seed, node FROM down"))
def downstream(spark, sf_dir):
    return reach.reached(pj.ways(spark, sf_dir), pj.sellers(spark, sf_dir))


@query(with_ctes(LINKS, REACH, "SELECT seed, node FROM up"))
def upstream(spark, sf_dir):
    return reach.reached(pj.ways(spark, sf_dir), pj.companies(spark, sf_dir), up=True)


@query(with_ctes(LINKS, """hop1 AS (SELECT source AS seed, target AS node FROM links),
hop2 AS (SELECT DISTINCT h.seed, l.target AS node FROM hop1 h JOIN links l ON h.node = l.source)""", """
SELECT seed, node, CAST(min(hops) AS BIGINT) AS hops FROM (
  SELECT seed, node, 1 AS hops FROM hop1 UNION ALL SELECT seed, node, 2 FROM hop2)
WHERE seed <> node GROUP BY 1, 2"""))
def downstream_hops(spark, sf_dir):
    """What each supplier reaches within two hops."""
    found = pj.within_two_hops(spark, sf_dir)
    return found.withColumn("hops", F.col("hops").cast("bigint"))


@query(with_ctes(REPLY_LINKS, """reach AS (
  SELECT source AS seed, target AS node, 1 AS hops FROM links
  UNION
  SELECT r.seed, l.target, r.hops + 1 FROM reach r JOIN links l ON r.node = l.source)""",
                 "SELECT seed, node, CAST(hops AS BIGINT) AS hops FROM reach"))
def reply_reach(spark, sf_dir):
    links = pj.reply_links(spark, sf_dir)
    seeds = links.select(F.col("source").alias("id"))
    return reach.downstream(links, seeds).withColumn("hops", F.col("hops").cast("bigint"))


RIPPLE = """ripple AS (
  SELECT seed, node, min(rank) AS rank FROM (
    SELECT s_name AS seed, s_name AS node, 0 AS rank FROM supplier
    UNION ALL SELECT seed, node, 1 FROM down
    UNION ALL SELECT u.seed, u.node, 2 FROM up u JOIN supplier ON s_name = u.seed)
  GROUP BY seed, node)"""


@query(with_ctes(LINKS, REACH, RIPPLE, """
SELECT seed, node, CASE rank WHEN 0 THEN 'self' WHEN 1 THEN 'down' ELSE 'up' END AS status
FROM ripple"""))
def ripple(spark, sf_dir):
    seeds = pj.sellers(spark, sf_dir)
    return reach.ripple_pairs(pj.ways(spark, sf_dir), pj.companies(spark, sf_dir), seeds)


@query(with_ctes(LINKS, REACH, RIPPLE, COMPANIES, f"""
SELECT id, CASE rank WHEN 0 THEN 'self' WHEN 1 THEN 'down' WHEN 2 THEN 'up'
                     ELSE 'unrelated' END AS status
FROM companies LEFT JOIN ripple ON node = id AND seed = '{CHOSEN[0]}'"""))
def ripple_for(spark, sf_dir):
    links, nodes = cut(reach.distinct_links(pj.feeds(spark, sf_dir))), pj.companies(spark, sf_dir)
    seed = _chosen(spark).filter(F.col("id") == CHOSEN[0])
    down, up = reach.downstream(links, seed, distinct=True), reach.upstream(links, seed, distinct=True)
    return reach.ripple_for(nodes, reach.ripple(nodes, down, up, seed), CHOSEN[0])


@query(with_ctes(LINKS, REACH, f"""seeds AS (SELECT s_name AS seed FROM supplier WHERE s_name IN {CHOSEN}),
d AS (SELECT * FROM down UNION ALL SELECT seed, seed FROM seeds),
u AS (SELECT * FROM up UNION ALL SELECT seed, seed FROM seeds),
ways AS (
  SELECT s.seed, l.source, l.target, 'down' AS status FROM seeds s JOIN d ON d.seed = s.seed
  JOIN links l ON l.source = d.node JOIN down e ON e.seed = s.seed AND e.node = l.target
  UNION ALL
  SELECT s.seed, l.source, l.target, 'up' FROM seeds s JOIN up e ON e.seed = s.seed
  JOIN links l ON l.source = e.node JOIN u ON u.seed = s.seed AND u.node = l.target)""", """
SELECT seed, source, target, min(status) AS status FROM ways GROUP BY 1, 2, 3"""))
def ripple_edges(spark, sf_dir):
    links = cut(reach.distinct_links(pj.feeds(spark, sf_dir)))
    seeds = pj.sellers(spark, sf_dir).join(_chosen(spark), "id", "left_semi")
    down, up = reach.downstream(links, seeds, distinct=True), reach.upstream(links, seeds, distinct=True)
    return reach.ripple_edges(links, down, up, seeds)


@query(with_ctes(LINKS, REACH, COMPANIES, """
SELECT id, coalesce(d.n, 0) AS downstream, coalesce(u.n, 0) AS upstream FROM companies
LEFT JOIN (SELECT seed, count(*) AS n FROM down GROUP BY 1) d ON d.seed = id
LEFT JOIN (SELECT node, count(*) AS n FROM down GROUP BY 1) u ON u.node = id"""))
def reach_counts(spark, sf_dir):
    return reach.reach_counts(pj.feeds(spark, sf_dir), pj.companies(spark, sf_dir))


# --- listings ---------------------------------------------------------------------------


LISTED = """listed AS (
  SELECT p.id, p."primary" AS slug, coalesce(s.sector, '') AS sector FROM prim p
  LEFT JOIN (SELECT id, arg_min(value, ord) AS sector FROM members WHERE facet = 'sector'
             GROUP BY id) s ON s.id = p.id
  WHERE p."primary" IN (SELECT slug FROM taxonomy) OR p."primary" = 'other'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY slug ORDER BY sector, id) - 1 AS pos,
         dense_rank() OVER (PARTITION BY slug ORDER BY sector) AS heads FROM listed),
shown AS (
  SELECT slug, row_number() OVER (ORDER BY min(kind) DESC, min(place)) - 1 AS col
  FROM placed JOIN taxonomy USING (slug) GROUP BY slug)"""
PRIMARY_OR_OTHER = PRIMARY.replace("'unknown'", "'other'")


def _group_listing(spark, sf_dir):
    players = pj.players(spark, sf_dir)
    return listing.listed_groups(
        graph.first_groups(players, "other"), dims.taxonomy(spark),
        roles=flatten.product_roles(players), signals=pj.signals(spark, sf_dir),
    )


@query(with_ctes(SIGNALS, PLAYERS, MEMBERS, PRIMARY_OR_OTHER, TAXONOMY, LISTED, """
first AS (SELECT company, arg_min(product, ord) AS product FROM players GROUP BY 1),
said AS (SELECT company, count(*) AS n FROM signals GROUP BY 1)""", """
SELECT slug, col, is_header, label, sector, "row", product, n_signals FROM (
  SELECT slug, false AS is_header, id AS label, sector, pos + heads AS "row",
         coalesce(product, '') AS product, coalesce(n, 0) AS n_signals
  FROM placed LEFT JOIN first f ON f.company = id LEFT JOIN said s ON s.company = id
  UNION ALL
  SELECT slug, true, sector, sector, min(pos) + min(heads) - 1, NULL, NULL FROM placed
  GROUP BY slug, sector)
JOIN shown USING (slug)"""))
def group_listing(spark, sf_dir):
    return _group_listing(spark, sf_dir)


@query(with_ctes(FEEDS, PLAYERS, MEMBERS, PRIMARY_OR_OTHER, TAXONOMY, LISTED, """
spots AS (SELECT id, col, pos + heads AS "row" FROM placed JOIN shown USING (slug))""", """
SELECT source, target, a.col AS from_col, a."row" AS from_row, b.col AS to_col, b."row" AS to_row,
       count(*) AS n
FROM feeds JOIN spots a ON a.id = source JOIN spots b ON b.id = target GROUP BY ALL"""))
def resolved_edges(spark, sf_dir):
    """Edges of the merged listing: both ends have a place there."""
    players = pj.players(spark, sf_dir)
    places = listing.listed_groups(graph.first_groups(players, "other"), dims.taxonomy(spark))
    return listing.linked_places(pj.feeds(spark, sf_dir), places)


@query(with_ctes(PLAYERS, MEMBERS, TAXONOMY, """
SELECT DISTINCT value AS slug, coalesce(place + CASE t.kind WHEN 'domain' THEN 100 ELSE 0 END, 150)
  AS group_order FROM members LEFT JOIN taxonomy t ON t.slug = value
WHERE facet IN ('layer', 'domain')"""))
def group_order(spark, sf_dir):
    used = flat_members(spark, sf_dir).filter("facet in ('layer', 'domain')").select(
        F.col("value").alias("slug")
    ).distinct()
    order = F.broadcast(screener.group_order(dims.taxonomy(spark), 150))
    return used.join(order, "slug", "left").select(
        "slug", F.coalesce("group_order", F.lit(150)).cast("bigint").alias("group_order")
    )
