"""Queries of the call universe and the event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiergraph.functions.display import pct
from tiergraph.operators import calls as call_ops
from tiergraph.operators import eventstudy as es
from tiergraph.operators import merge
from tiergraph.plans import jobs
from tiergraph.plans import projections as pj
from tiergraph.plans.projections import (
    BENCHMARKS, CALLS, METADATA, PRICES, RETURNS, SIGNALS, WINDOWS, with_ctes,
)
from tiergraph.plans.registry import query
from tiergraph.session import cut
from tiergraph.sources import tables

ISO = "yyyy-MM-dd"


def _calls(spark, sf_dir):
    return call_ops.dedupe_calls(pj.calls(spark, sf_dir))


def _grouped(spark, sf_dir):
    return es.assign_group(_calls(spark, sf_dir), pj.flagged(spark, sf_dir))


def _study(spark, sf_dir):
    # A study reads a price table; here one is first derived from the orders.
    prices = cut(pj.prices(spark, sf_dir))
    return jobs.event_study(
        _calls(spark, sf_dir), pj.flagged(spark, sf_dir), prices, BENCHMARKS, WINDOWS
    )


CALL_SQL = with_ctes(SIGNALS, METADATA, r"""cand AS (
  SELECT d.company, m.ticker, day, trim(quarter) AS source_label, ord FROM dated d
  JOIN metadata m USING (company)
  WHERE m.ticker <> '' AND m.exchange IN ('NYSE', 'NASDAQ') AND day IS NOT NULL
    AND regexp_matches(quarter, '(?i)Q\d\s*FY\s*\d{4}') AND regexp_matches(quarter, '\sQ\d')
    AND (starts_with(lower(d.company), lower(trim(regexp_replace(quarter, '\sQ\d.*$', ''))))
      OR starts_with(lower(trim(regexp_replace(quarter, '\sQ\d.*$', ''))), lower(d.company))))""",
    """
SELECT company, ticker, strftime(day, '%Y-%m-%d') AS date, source_label FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY length(company), ord) AS r
  FROM cand) WHERE r = 1""")


@query(CALL_SQL)
def call_extraction(spark, sf_dir):
    found = jobs.extract_calls(pj.signals(spark, sf_dir), pj.metadata(spark, sf_dir))
    return found.withColumn("date", F.date_format("date", ISO))


@query(with_ctes(PRICES, CALLS, """
SELECT company, ticker, strftime(date, '%Y-%m-%d') AS date, source_label FROM calls"""))
def dedupe_calls(spark, sf_dir):
    return _calls(spark, sf_dir).withColumn("date", F.date_format("date", ISO))


@query(with_ctes(PRICES, CALLS, """
SELECT count(*) AS n_calls, count(DISTINCT company) AS n_companies,
       strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date
FROM calls"""))
def call_range(spark, sf_dir):
    return call_ops.call_range(_calls(spark, sf_dir)).withColumns(
        {c: F.date_format(c, ISO) for c in ("first_date", "last_date")}
    )


@query(with_ctes(PRICES, CALLS, """
SELECT company, ticker, strftime(date, '%Y-%m-%d') AS date FROM calls ORDER BY lower(company)"""))
def calls_sorted(spark, sf_dir):
    ordered = call_ops.calls_sorted(_calls(spark, sf_dir))
    return ordered.select("company", "ticker", F.date_format("date", ISO).alias("date"))


@query(with_ctes(PRICES, "SELECT strftime(date, '%Y-%m-%d') AS date, idx FROM calendar"))
def trading_calendar(spark, sf_dir):
    days = es.trading_calendar(pj.prices(spark, sf_dir))
    return days.select(
        F.date_format("date", ISO).alias("date"), F.col("day_idx").cast("bigint").alias("idx")
    )


@query(with_ctes(PRICES, """open_days AS (SELECT DISTINCT date FROM prices WHERE dayofweek(date) BETWEEN 1 AND 5),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM open_days)""", """
SELECT o_orderkey, (SELECT max(idx) FROM cal WHERE cal.date <= CAST(o_orderdate AS DATE)) AS t0
FROM orders"""))
def asof_day(spark, sf_dir):
    """As-of against weekdays only, so that weekend orders look back."""
    weekdays = pj.prices(spark, sf_dir).filter(F.dayofweek("date").between(2, 6))
    asked = pj.calls_dates(spark, sf_dir)
    return es.asof_trading_day(asked, es.trading_calendar(weekdays)).select(
        "o_orderkey", F.col("t0_idx").cast("bigint").alias("t0")
    )


@query(with_ctes(PRICES, """
SELECT a.ticker, a.idx, n AS days, round(b.close / a.close - 1, 9) AS ret
FROM closes a CROSS JOIN (VALUES (1), (5), (20)) w(n)
JOIN closes b ON b.ticker = a.ticker AND b.idx = a.idx + n WHERE a.close <> 0"""))
def window_return(spark, sf_dir):
    prices = pj.prices(spark, sf_dir)
    closes = es.indexed_prices(prices, es.trading_calendar(prices))
    return es.window_returns(closes, (1, 5, 20)).select(
        "ticker", F.col("idx").cast("bigint").alias("idx"),
        F.col("days").cast("bigint").alias("days"), F.round("ret", 9).alias("ret"),
    )


@query(with_ctes(PRICES, CALLS, "SELECT company, ticker, grp AS \"group\", count(*) AS n FROM calls GROUP BY ALL"))
def assign_group(spark, sf_dir):
    return _grouped(spark, sf_dir).groupBy("company", "ticker", "group").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(with_ctes(PRICES, CALLS, RETURNS, """
SELECT company, ticker, strftime(date, '%Y-%m-%d') AS date, grp AS "group", metric,
       round(value, 9) AS value FROM plain"""))
def abnormal(spark, sf_dir):
    values = _study(spark, sf_dir).values
    plain = values.filter(~F.endswith("metric", F.lit("_minus_univ")))
    return plain.select(
        "company", "ticker", F.date_format("date", ISO).alias("date"), "group", "metric",
        F.round("value", 9).alias("value"),
    )


@query(with_ctes(PRICES, CALLS, RETURNS, """
SELECT grp AS "group", metric, count(*) AS n, round(sum(value), 6) AS total FROM vals
WHERE metric LIKE '%_minus_univ' GROUP BY ALL"""))
def universe_excess(spark, sf_dir):
    values = _study(spark, sf_dir).values
    return values.filter(F.endswith("metric", F.lit("_minus_univ"))).groupBy(
        "group", "metric"
    ).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 6) + 0.0).alias("total"))


@query(with_ctes(PRICES, CALLS, RETURNS, """
SELECT metric, round(mean, 5) AS mean FROM universe"""))
def universe_average(spark, sf_dir):
    return _study(spark, sf_dir).universe


# Student-t in closed form through gamma functions, independent of the running product.
STATS = r"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp, metric ORDER BY value) - 1 AS r,
         count(*) OVER (PARTITION BY grp, metric) AS c FROM vals),
base AS (
  SELECT grp, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
         avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS hit,
         max(value) FILTER (WHERE r = c // 2) AS median FROM ranked GROUP BY grp, metric),
theta AS (
  SELECT *, n - 1 AS nu, atan(abs(mean) / (sd / sqrt(n)) / sqrt(n - 1)) AS th FROM base),
tails AS (
  SELECT *, CASE WHEN n < 2 THEN NULL WHEN sd = 0 THEN CASE WHEN mean <> 0 THEN 0.0 END
    WHEN nu = 1 THEN 1 - 2 * th / pi()
    WHEN nu % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * list_sum(list_transform(
      range((nu - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5))
        * pow(cos(th), 2 * k + 1))))
    ELSE 1 - sin(th) * list_sum(list_transform(range(nu // 2),
      lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(th), 2 * k)))
    END AS p FROM theta)"""


@query(with_ctes(PRICES, CALLS, RETURNS, STATS, """
SELECT grp AS "group", metric, n, round_even(mean, 5) AS mean, round_even(median, 5) AS median,
       round_even(hit, 3) AS hit_rate, round_even(p, 4) AS p_value FROM tails"""))
def group_stats(spark, sf_dir):
    return _study(spark, sf_dir).stats


# The report shows the statistics as stored: the hit rate is rounded to three places first.
@query(with_ctes(PRICES, CALLS, RETURNS, STATS, """
SELECT regexp_extract(metric, 'drift[0-9]+_vs_(.*)', 1) AS benchmark, grp AS "group",
       '+' || regexp_extract(metric, 'drift([0-9]+)_vs_', 1) || 'd' AS "window", n,
       CAST(round_even(100 * round_even(hit, 3), 0) AS BIGINT) || '%' AS hit_rate
FROM tails WHERE metric LIKE 'drift%'"""))
def study_report(spark, sf_dir):
    report = es.study_report(_study(spark, sf_dir).stats, WINDOWS)
    return report.select("benchmark", "group", "window", "n", "hit_rate")


@query(with_ctes(PRICES, CALLS, RETURNS, """
members AS (SELECT days AS "window", grp AS "group", company FROM returns
            WHERE measure <> 'jump' AND ret IS NOT NULL)""", """
SELECT w."window", g."group", count(company) AS n_companies,
       coalesce(string_agg(company, '; ' ORDER BY company), '') AS companies
FROM (VALUES (5), (10), (20)) w("window") CROSS JOIN (VALUES ('full_capacity'), ('rest')) g("group")
LEFT JOIN members m ON m."window" = w."window" AND m."group" = g."group" GROUP BY ALL"""))
def window_members(spark, sf_dir):
    # One row a pair, as in SQL, at any size; window_member_rows has no joined cell.
    names = F.array_join(F.sort_array(F.collect_list("company")), "; ")
    lists = es.member_rows(_study(spark, sf_dir).members).groupBy("window", "group", "n_companies")
    return lists.agg(names.alias("companies")).select(
        F.col("window").cast("bigint").alias("window"), "group", "n_companies", "companies"
    )


@query(with_ctes(PRICES, CALLS, RETURNS, """
members AS (SELECT days AS "window", grp AS "group", company FROM returns
            WHERE measure <> 'jump' AND ret IS NOT NULL)""", """
SELECT w."window", g."group", company, count(company) OVER (PARTITION BY w."window", g."group") AS n_companies,
       CASE WHEN company IS NOT NULL
         THEN row_number() OVER (PARTITION BY w."window", g."group" ORDER BY company) - 1 END AS position
FROM (VALUES (5), (10), (20)) w("window") CROSS JOIN (VALUES ('full_capacity'), ('rest')) g("group")
LEFT JOIN members m ON m."group" = g."group" AND m."window" = w."window" """))
def window_member_rows(spark, sf_dir):
    rows = es.member_rows(_study(spark, sf_dir).members)
    return rows.withColumn("window", F.col("window").cast("bigint"))


@query(with_ctes(PRICES, CALLS, RETURNS, """
SELECT '+' || days || 'd window not complete yet' AS reason, count(*) AS n FROM returns
WHERE measure <> 'jump' AND ret IS NULL GROUP BY days
UNION ALL
SELECT 'no entry day yet', count(*) FROM placed
WHERE t0 + 1 > (SELECT max(idx) FROM calendar) HAVING count(*) > 0"""))
def exclusions(spark, sf_dir):
    return _study(spark, sf_dir).excluded


@query(with_ctes(PRICES, CALLS, RETURNS, """
SELECT i.company, i.ticker, strftime(i.date, '%Y-%m-%d') AS date,
  CASE i.grp WHEN 'full_capacity' THEN 1 ELSE 0 END AS flag,
  round(max(value) FILTER (WHERE metric = 'jump_vs_ASIA'), 5) AS jump_vs_ASIA,
  round(max(value) FILTER (WHERE metric = 'drift5_vs_ASIA'), 5) AS drift5_vs_ASIA,
  round(max(value) FILTER (WHERE metric = 'drift20_vs_EUROPE'), 5) AS drift20_vs_EUROPE
FROM included i LEFT JOIN plain p ON p.company = i.company AND p.ticker = i.ticker
  AND p.date = i.date GROUP BY i.company, i.ticker, i.date, i.grp"""))
def wide_events(spark, sf_dir):
    events = _study(spark, sf_dir).events
    return events.select(
        "company", "ticker", F.date_format("date", ISO).alias("date"), "flag", "jump_vs_ASIA",
        "drift5_vs_ASIA", "drift20_vs_EUROPE",
    )


@query(with_ctes(PRICES, """
days AS (SELECT DISTINCT date FROM prices)""", """
SELECT strftime(d.date, '%Y-%m-%d') AS date, t.ticker, round(p.close, 6) AS close
FROM days d CROSS JOIN (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST')) t(ticker)
LEFT JOIN prices p ON p.date = d.date AND p.ticker = t.ticker"""))
def long_prices(spark, sf_dir):
    wide = pj.prices(spark, sf_dir).groupBy("date").pivot("ticker", list(BENCHMARKS)).agg(
        F.first("close")
    )
    holes = wide.select(
        "date", *[F.coalesce(b, F.lit(float("nan"))).alias(b) for b in BENCHMARKS]
    )
    return tables.long_prices(holes, "date", BENCHMARKS).select(
        F.date_format("date", ISO).alias("date"), "ticker", F.round("close", 6).alias("close")
    )


@query(with_ctes(PRICES, """
SELECT ticker, count(*) AS n, round(min(close), 6) AS low, round(max(close), 6) AS high
FROM prices GROUP BY ticker"""))
def add_price_columns(spark, sf_dir):
    prices = pj.prices(spark, sf_dir)
    known = prices.filter(~F.col("ticker").isin(*BENCHMARKS))
    # The fetched side repeats known tickers with other values; they must not win.
    fetched = prices.withColumn(
        "close", F.when(F.col("ticker").isin(*BENCHMARKS), F.col("close")).otherwise(F.lit(-1.0))
    )
    return merge.add_price_columns(known, fetched).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("close"), 6).alias("low"),
        F.round(F.max("close"), 6).alias("high"),
    )


@query(with_ctes(PRICES, """
SELECT ticker, format('{:+.1f}%', 100 * (arg_max(close, idx) / arg_min(close, idx) - 1)) AS change
FROM closes GROUP BY ticker"""))
def price_change(spark, sf_dir):
    prices = pj.prices(spark, sf_dir)
    closes = es.indexed_prices(prices, es.trading_calendar(prices))
    ends = closes.groupBy("ticker").agg(
        F.max_by("close", "idx").alias("last"), F.min_by("close", "idx").alias("first")
    )
    return ends.select("ticker", pct(es.change(F.col("first"), F.col("last"))).alias("change"))
