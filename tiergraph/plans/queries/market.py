"""Queries of the coverage queue, the screener, price ranges and quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiergraph.operators import coverage as cov
from tiergraph.operators import market, screener
from tiergraph.plans import jobs
from tiergraph.plans import projections as pj
from tiergraph.plans.projections import (
    BARS, BARS_NOW, BARS_YEAR_START, COVERAGE, COVERAGE_NOW, METADATA, SCREENER, with_ctes,
)
from tiergraph.plans.queries.graph import TAXONOMY
from tiergraph.plans.registry import query
from tiergraph.sources import dims


def _queue(spark, sf_dir):
    return jobs.coverage_queue(
        pj.customer_nodes(spark, sf_dir), pj.earnings(spark, sf_dir), COVERAGE_NOW
    )


@query(with_ctes(COVERAGE, """
SELECT id, ticker, call_seconds, strftime(last_data, '%Y-%m-%d') AS last_data, n_signals, status,
       CAST(days AS BIGINT) AS days, stale FROM queue"""))
def coverage(spark, sf_dir):
    return _queue(spark, sf_dir).select(
        "id", "ticker", "call_seconds",
        F.date_format("last_data", "yyyy-MM-dd").alias("last_data"), "n_signals", "status",
        "days", "stale",
    )


@query(with_ctes(COVERAGE, """
SELECT count(*) FILTER (WHERE status = 'due') AS due,
       count(*) FILTER (WHERE status = 'upcoming' AND days <= 14) AS upcoming,
       count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE n_signals = 0) AS no_data
FROM queue"""))
def coverage_counts(spark, sf_dir):
    return cov.coverage_counts(_queue(spark, sf_dir))


@query(with_ctes(COVERAGE, """
SELECT mode, id FROM (
  SELECT 'due' AS mode, id, ticker FROM queue WHERE status = 'due'
  UNION ALL SELECT 'upcoming', id, ticker FROM queue WHERE status = 'upcoming' AND days <= 14
  UNION ALL SELECT 'stale', id, ticker FROM queue WHERE stale
  UNION ALL SELECT 'no-data', id, ticker FROM queue WHERE n_signals = 0)
WHERE contains(lower(id), 'nation_1') OR contains(lower(ticker), 'nation_1')"""))
def coverage_filter(spark, sf_dir):
    rows = _queue(spark, sf_dir)
    out = None
    for mode in ("due", "upcoming", "stale", "no-data"):
        part = cov.coverage_filter(rows, mode, " Nation_1").select(F.lit(mode).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(with_ctes(SCREENER, """
SELECT company, coalesce(nullif(n.ticker, ''), '—') AS ticker, coalesce(growth, '') AS growth,
       coalesce(guidance, '') AS guidance, coalesce(backlog, '') AS backlog,
       coalesce(supply, '') AS supply, coalesce(catalyst, '') AS catalyst,
       coalesce("asof", '') AS "asof"
FROM metrics LEFT JOIN (SELECT c_name AS id, n_name AS ticker FROM customer
  JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0) n ON n.id = company"""))
def screener_all(spark, sf_dir):
    return screener.screener_sort(
        screener.screener(pj.metrics(spark, sf_dir), _nodes(spark, sf_dir),
                          pj.metric_members(spark, sf_dir))
    )


def _nodes(spark, sf_dir):
    listed = pj.customer_nodes(spark, sf_dir).select("id", "ticker")
    return listed.filter("ticker is not null")


@query(with_ctes(SCREENER, """
SELECT company, coalesce(growth, '') AS growth, coalesce("asof", '') AS "asof" FROM metrics
WHERE company IN (SELECT c_name FROM customer WHERE c_acctbal >= 0)
  AND company IN (SELECT id FROM metric_members WHERE facet IN ('layer', 'domain') AND value = 'power')
  AND company IN (SELECT id FROM metric_members WHERE facet = 'sector' AND value = 'BUILDING')
  AND company IN (SELECT id FROM metric_members WHERE facet = 'chain' AND value = '2-HIGH')"""))
def screener_facet(spark, sf_dir):
    rows = screener.screener(
        pj.metrics(spark, sf_dir), _nodes(spark, sf_dir), pj.metric_members(spark, sf_dir),
        group="power", sector="BUILDING", chain="2-HIGH",
    )
    return screener.screener_sort(rows).select("company", "growth", "asof")


@query(with_ctes(SCREENER, TAXONOMY, """
SELECT CASE WHEN facet IN ('layer', 'domain') THEN 'group' ELSE facet END AS facet, value,
       CASE WHEN facet IN ('layer', 'domain') THEN
         coalesce(place + CASE t.kind WHEN 'domain' THEN 100 ELSE 0 END, 100) END AS place
FROM metric_members JOIN metrics ON company = id LEFT JOIN taxonomy t ON t.slug = value
GROUP BY ALL"""))
def screener_facets(spark, sf_dir):
    facets = screener.screener_facets(
        pj.metrics(spark, sf_dir), pj.metric_members(spark, sf_dir), dims.taxonomy(spark)
    )
    return facets.withColumn("place", F.col("place").cast("bigint"))


RANGES = f"""ranged AS (
  SELECT symbol, "range", ts, floor(close * 100.0 + 0.5) / 100.0 AS close FROM (
    SELECT *, unnest(CASE interval WHEN '5m' THEN ['1D'] WHEN '30m' THEN ['1W']
      WHEN '1d' THEN list_filter([CASE WHEN ts >= {BARS_NOW - 31 * 86400} THEN '1M' END,
        CASE WHEN ts >= {BARS_YEAR_START} THEN 'YTD' END, '1Y'], lambda x: x IS NOT NULL)
      WHEN '1wk' THEN list_filter([CASE WHEN ts >= {BARS_NOW - 5 * 365 * 86400} THEN '5Y' END,
        'All'], lambda x: x IS NOT NULL) END) AS "range" FROM bars)),
points AS (
  SELECT * FROM ranged QUALIFY count(*) OVER (PARTITION BY symbol, "range") >= 2)"""


@query(with_ctes(BARS, RANGES, 'SELECT symbol, "range", ts, close FROM points'))
def price_ranges(spark, sf_dir):
    return market.price_ranges(pj.bars(spark, sf_dir), BARS_NOW, BARS_YEAR_START)


@query(with_ctes(BARS, RANGES, """
SELECT symbol, "range", min(ts) AS first_ts, max(ts) AS last_ts, min(close) AS low,
       max(close) AS high FROM points GROUP BY ALL"""))
def series_extent(spark, sf_dir):
    return market.series_extent(
        market.price_ranges(pj.bars(spark, sf_dir), BARS_NOW, BARS_YEAR_START)
    )


@query(with_ctes(BARS, """
daily AS (
  SELECT symbol, ts // 86400 AS day, arg_max(close, (ts, close)) AS close FROM bars GROUP BY 1, 2),
two AS (
  SELECT symbol, max(close) FILTER (WHERE r = 1) AS last, max(close) FILTER (WHERE r = 2) AS prev
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM daily)
  GROUP BY symbol)""", f"""
SELECT t.symbol, floor(last * 100.0 + 0.5) / 100.0 AS price,
       floor((last - nullif(prev, 0)) / nullif(prev, 0) * 10000 + 0.5) / 100.0 AS change_pct,
       floor(high * 100.0 + 0.5) / 100.0 AS year_high, floor(low * 100.0 + 0.5) / 100.0 AS year_low
FROM two t LEFT JOIN (
  SELECT symbol, max(close) AS high, min(close) AS low FROM bars
  WHERE ts >= {BARS_NOW - 365 * 86400} GROUP BY symbol) y USING (symbol)"""))
def quote_snapshot(spark, sf_dir):
    return market.quote_snapshot(pj.bars(spark, sf_dir), BARS_NOW)


@query(with_ctes(METADATA, """
feed AS (
  SELECT n_name || CASE r_name WHEN 'EUROPE' THEN '.DE' ELSE '' END AS symbol,
         count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1)""", """
SELECT company, symbol, n_orders FROM (
  SELECT company, ticker || CASE exchange WHEN 'XETRA' THEN '.DE' ELSE '' END AS symbol
  FROM metadata WHERE ticker <> '') JOIN feed USING (symbol)"""))
def symbol_fanout(spark, sf_dir):
    places = pj._order_places(spark, sf_dir)
    symbol = F.concat(
        "n_name", F.when(F.col("r_name") == "EUROPE", ".DE").otherwise("")
    ).alias("symbol")
    feed = places.groupBy(symbol).agg(F.count(F.lit(1)).alias("n_orders"))
    return market.symbol_fanout(pj.metadata(spark, sf_dir), feed).select(
        "company", "symbol", "n_orders"
    )
