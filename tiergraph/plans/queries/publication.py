"""Queries that write files and read them back: study, views, history, timelines, capex."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiergraph.operators import graph, tables
from tiergraph.plans import projections as pj
from tiergraph.plans.projections import CALLS, EDGES, PRICES, RETURNS, with_ctes
from tiergraph.plans.queries.documents import scratch
from tiergraph.plans.queries.study import _study
from tiergraph.plans.registry import query
from tiergraph.sources import documents, publication, sinks
from tiergraph.sources import tables as table_files


@query(with_ctes(PRICES, CALLS, RETURNS, """
SELECT metric, round_even(avg(value), 5) AS mean, count(*) AS n FROM plain GROUP BY metric"""))
def write_study(spark, sf_dir):
    """A study published twice under one run id, its means and events read back."""
    path, study = scratch(spark, "study"), _study(spark, sf_dir)
    for _ in range(2):
        sinks.write_study(study, path, "run-1")
    events = publication.published(spark, path, "events")
    metrics = [c for c in events.columns if "_vs_" in c]
    known = events.select([F.count(F.col(f"`{m}`")).alias(m) for m in metrics])
    counts = known.unpivot([], [F.col(f"`{m}`") for m in metrics], "metric", "n")
    return publication.published(spark, path, "universe").join(counts, "metric")


@query(with_ctes(EDGES, """
SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges)
GROUP BY id"""))
def publish_views(spark, sf_dir):
    """Degrees published as a view; an older run and a repeated one change nothing."""
    path, edges = scratch(spark, "views"), pj.edges(spark, sf_dir)
    degrees = graph.degree(edges)
    sinks.publish_views({"degrees": degrees.limit(0)}, path, "old")
    sinks.publish_views({"degrees": degrees, "links": graph.top_contracts(edges)}, path, "new")
    sinks.publish_views({"degrees": degrees.limit(0)}, path, "new")
    return publication.published(spark, path, "degrees")


@query("""
SELECT '2026-06-09 22:20' AS written_at, count(*) || ' orders' AS note, 0 AS place FROM orders
UNION ALL SELECT '2026-06-10 08:00', count(*) || ' lines', 1 FROM lineitem""")
def run_history(spark, sf_dir):
    path = scratch(spark, "history")
    for name, moment, word in (("orders", "2026-06-09 22:20", "orders"), ("lineitem", "2026-06-10 08:00", "lines")):
        note = f"{pj.table(spark, sf_dir, name).count()} {word}"
        for _ in range(2):  # a repeated run is noted once
            sinks.append_history(spark, path, moment, note)
    rows = table_files.load_history(spark, path)
    return rows.withColumn("place", F.when(F.endswith("note", F.lit("orders")), 0).otherwise(1).cast("bigint"))


@query("""
SELECT o_orderpriority || '/' || o_orderstatus AS id, strftime(o_orderdate, '%Y-%m-%d') AS day,
       CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY ALL""")
def timeline_files(spark, sf_dir):
    """One timeline document per priority and status, a row a day; written, read and tidied."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    days = pj.table(spark, sf_dir, "orders").groupBy(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("id"), day
    ).agg(F.count(F.lit(1)).cast("string").alias("n"))
    table = F.struct(
        F.lit("orders").alias("title"), F.array(F.lit("day"), F.lit("n")).alias("columns"),
        F.array_sort(F.collect_list(F.array("day", "n"))).alias("rows"),
    )
    path = scratch(spark, "timelines")
    # A document has at most one row a calendar day.
    days.groupBy("id").agg(F.array(table).alias("tables")).write.partitionBy("id").json(path)
    cells = tables.tidy_timelines(documents.read_timelines(spark, path))
    return cells.groupBy("id", "row_no").agg(
        F.max(F.when(F.col("column") == "day", F.col("value"))).alias("day"),
        F.max(F.when(F.col("column") == "n", F.col("value"))).alias("n"),
    ).drop("row_no")


@query("""
WITH t AS (
  SELECT r_name, n_name, c_mktsegment, CAST(o_totalprice AS DECIMAL(15,2)) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
bars AS (
  SELECT 'capex' AS part, n_name AS name, CAST(sum(v) AS DOUBLE) AS busd FROM t GROUP BY 2
  UNION ALL SELECT 'backlog', c_mktsegment, CAST(sum(v) AS DOUBLE) FROM t GROUP BY 2)
SELECT part, name, CAST(round(busd / max(busd) OVER (PARTITION BY part), 4) AS VARCHAR) AS value FROM bars
UNION ALL SELECT 'tile', r_name, CAST(count(*) AS VARCHAR) FROM t GROUP BY 2
UNION ALL SELECT 'group ' || r_name, n_name, CAST(count(*) AS VARCHAR) FROM t GROUP BY 1, 2""")
def capex_backlog(spark, sf_dir):
    """The nested document of tiles, two bar blocks and groups; written, read and laid flat."""
    places = pj._order_places(spark, sf_dir).withColumn("v", F.col("o_totalprice").cast("decimal(15,2)"))

    def bars(name: str):
        rows = places.groupBy(F.col(name).alias("name")).agg(F.sum("v").cast("double").alias("busd"))
        return rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("name", "busd"))).alias("bars")).select(
            F.struct(F.lit(name).alias("title"), F.lit("usd").alias("unit"), "bars").alias("b"))

    nations = places.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))
    regions = nations.groupBy("r_name").agg(
        F.sum("n").cast("string").alias("value"),
        F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n").cast("string").alias("backlog")))).alias("rows"),
    )
    rest = regions.groupBy().agg(
        F.collect_list(F.struct(F.col("r_name").alias("label"), "value")).alias("tiles"),
        F.collect_list(F.struct(F.col("r_name").alias("title"), "rows")).alias("groups"),
    )
    # Single rows over nations, segments and regions.
    capex, backlog = (bars(n).withColumnRenamed("b", x) for n, x in (("n_name", "capex_bars"), ("c_mktsegment", "backlog_bars")))
    path = scratch(spark, "capex")
    one = F.lit(1).alias("one")
    rest.select("*", one).join(capex.select("*", one), "one").join(backlog.select("*", one), "one").drop("one").write.json(path)
    tiles, found, rows = tables.capex_tables(documents.read_capex_backlog(spark, path))
    shares = tables.bar_fraction(found).select(
        F.col("block").alias("part"), "name", F.col("fraction").cast("string").alias("value"))
    return shares.unionByName(
        tiles.select(F.lit("tile").alias("part"), F.col("label").alias("name"), "value")
    ).unionByName(rows.select(F.concat(F.lit("group "), "title").alias("part"), "name", F.col("backlog").alias("value")))
