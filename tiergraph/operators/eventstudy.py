"""Abnormal returns around dated events.

Prices are long ``(date, ticker, close)``. Trading days are positions on one
calendar shared by all tickers, so a gap in a ticker's closes gives no return
instead of shifting the window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.functions.display import DASH, pct
from tiergraph.functions.stats import t_test_p
from tiergraph.operators.ordering import positions, upper_median

CALL = ("company", "ticker", "date")
#: Positions of one block of closes.
BLOCK_DAYS = 256


@dataclass
class Study:
    """Result tables of one study."""

    events: DataFrame
    values: DataFrame
    universe: DataFrame
    stats: DataFrame
    excluded: DataFrame
    members: DataFrame


# --- calendar --------------------------------------------------------------------


def trading_calendar(prices: DataFrame) -> DataFrame:
    """Distinct dates of all tickers with their position.

    The unpartitioned window runs over distinct dates only: at most 366 rows a
    year however many tickers there are.
    """
    position = F.row_number().over(Window.orderBy("date")) - 1
    return prices.select("date").distinct().withColumn("day_idx", position)


def civil_calendar(calendar: DataFrame) -> DataFrame:
    """Every civil day from the first to the last trading day with the position in force."""
    following = F.lead("date").over(Window.orderBy("date"))
    spans = calendar.withColumn("_until", F.coalesce(F.date_sub(following, 1), F.col("date")))
    return spans.select(
        F.explode(F.sequence("date", "_until", F.expr("interval 1 day"))).alias("day"), "day_idx"
    )


def asof_trading_day(calls: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add ``t0_idx``: the last trading day up to the call date; null before history.

    The as-of lookup is an equi-join on the civil day. Days are few (see
    ``trading_calendar``), so they are broadcast.
    """
    last_day = calendar.agg(F.max("date").alias("d")).scalar()
    days = F.broadcast(
        civil_calendar(calendar).select(F.col("day").alias("_day"),
                                        F.col("day_idx").alias("t0_idx"))
    )
    return (
        calls.withColumn("_day", F.least(F.col("date"), last_day))
        .join(days, "_day", "left")
        .drop("_day")
    )


def indexed_prices(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stated closes as ``(ticker, idx, close)``."""
    days = F.broadcast(calendar.select("date", F.col("day_idx").alias("idx")))
    return prices.filter(F.col("close").isNotNull()).join(days, "date").select(
        "ticker", "idx", "close"
    )


# --- returns ---------------------------------------------------------------------


def change(start: Column, end: Column) -> Column:
    """Relative change; null when an end is missing or the start is zero."""
    return F.when((start != 0.0) & end.isNotNull(), end / F.nullif(start, F.lit(0.0)) - 1.0)


def window_returns(closes: DataFrame, days: Sequence[int]) -> DataFrame:
    """``(ticker, idx, days, ret)`` from every stated close over each window length.

    Positions meet by an equi-join on ``(ticker, idx)``; the pair spreads one
    ticker's rows over all tasks.
    """
    starts = closes.withColumn("days", F.explode(F.array(*[F.lit(d) for d in days])))
    ends = closes.select("ticker", F.col("idx").alias("_end"), F.col("close").alias("_close"))
    starts = starts.withColumn("_end", F.col("idx") + F.col("days"))
    return (
        starts.join(ends, ["ticker", "_end"])
        .select("ticker", "idx", "days", change(F.col("close"), F.col("_close")).alias("ret"))
        .filter(F.col("ret").isNotNull())
    )


def assign_group(calls: DataFrame, flagged: DataFrame) -> DataFrame:
    """``full_capacity`` for calls of flagged companies, ``rest`` for the others."""
    flags = flagged.select("company").distinct().withColumn("_f", F.lit(True))
    return calls.join(flags, "company", "left").withColumn(
        "group", F.when(F.col("_f"), fixed.GROUPS[0]).otherwise(fixed.GROUPS[1])
    ).drop("_f")


def placed_calls(calls: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Distinct calls with their number of copies, t0 position and reason of exclusion."""
    copies = calls.groupBy(*CALL, "group").agg(F.count(F.lit(1)).alias("copies"))
    priced = (
        prices.filter(F.col("close").isNotNull()).select("ticker").distinct()
        .withColumn("_priced", F.lit(True))
    )
    last = calendar.agg(F.max("day_idx").alias("i")).scalar()
    reason = (
        F.when(F.col("_priced").isNull(), "no price data")
        .when(F.col("t0_idx").isNull(), "call before price history")
        .when(F.col("t0_idx") + 1 > last, "no entry day yet")
    )
    return (
        asof_trading_day(copies.join(priced, "ticker", "left"), calendar)
        .withColumn("reason", reason)
        .drop("_priced")
    )


def price_blocks(closes: DataFrame, reach: int) -> DataFrame:
    """``(ticker, block, by_day)``: closes of 256 positions and the ``reach`` that follow.

    ``by_day`` maps the place in the block to the close; a gap has no entry. The rows are
    dealt once, by (ticker, block), so a busy ticker is spread by its blocks.
    """
    at, place = F.floor(F.col("idx") / BLOCK_DAYS), F.col("idx") % BLOCK_DAYS
    homes = F.array(
        F.struct(at.alias("block"), place.alias("place")),
        F.when(place < reach, F.struct((at - 1).alias("block"), (place + BLOCK_DAYS).alias("place"))),
    )
    dealt = closes.select("ticker", "close", F.inline(F.array_compact(homes))).repartition("ticker", "block")
    return (
        dealt.groupBy("ticker", "block", "place").agg(F.max("close").alias("close"))
        .groupBy("ticker", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", "close"))).alias("by_day"))
    )


def quoted_calls(
    placed: DataFrame, closes: DataFrame, benchmarks: Sequence[str], windows: Sequence[int]
) -> DataFrame:
    """Every call with the closes its measures need: its own and those of the benchmarks.

    A call meets one block of its ticker, which holds all days it may ask for, and one row
    with the same days of all benchmarks. ``own`` has a close (or null) per offset of
    ``offsets_of``, ``marks`` the same list per benchmark. The rows of benchmarks number
    the calendar's blocks, at most two a year, and are broadcast.
    """
    offsets = offsets_of(windows)
    blocks = price_blocks(closes, offsets[-1] + 1)
    marks = blocks.filter(F.col("ticker").isin(*benchmarks)).groupBy("block").agg(
        F.collect_list(F.struct("ticker", "by_day")).alias("_marks")
    )
    day = F.col("t0_idx") % BLOCK_DAYS
    at = lambda by_day: F.array(*[F.try_element_at(by_day, day + o) for o in offsets])
    return (
        placed.withColumn("block", F.floor(F.col("t0_idx") / BLOCK_DAYS))
        .join(blocks, ["ticker", "block"], "left")
        .join(F.broadcast(marks), "block", "left")
        .select(
            *CALL, "group", "copies", "t0_idx", "reason", at(F.col("by_day")).alias("own"),
            F.transform(
                "_marks", lambda m: F.struct(m["ticker"].alias("benchmark"), at(m["by_day"]).alias("closes"))
            ).alias("marks"),
        )
    )


def offsets_of(windows: Sequence[int]) -> list[int]:
    """Days after t0 whose closes a call's measures read."""
    return sorted({0, 1, *(1 + w for w in windows)})


def _measures(windows: Sequence[int]) -> list[tuple[str, int, int]]:
    return [("jump", 0, 1)] + [(f"drift{w}", 1, w) for w in windows]


def _change_over(closes: Column, offsets: list[int], start: int, days: int) -> Column:
    close = lambda o: F.get(closes, offsets.index(o))
    return change(close(start), close(start + days))


def call_returns(quoted: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Stock return of every included call per measure (``jump``, ``drift<w>``).

    ``ret`` is null where the window is incomplete.
    """
    offsets = offsets_of(windows)
    made = [
        F.struct(
            F.lit(name).alias("measure"), (F.col("t0_idx") + start).alias("idx"), F.lit(days).alias("days"),
            _change_over(F.col("own"), offsets, start, days).alias("ret"),
        )
        for name, start, days in _measures(windows)
    ]
    return quoted.filter(F.col("reason").isNull()).select(*CALL, "group", "copies", F.inline(F.array(*made)))


def abnormal_returns(quoted: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Stock return minus each benchmark's over the same days, where both are known."""
    offsets = offsets_of(windows)

    def against(mark: Column) -> Column:
        return F.array(*[
            F.struct(
                F.concat(F.lit(f"{name}_vs_"), mark["benchmark"]).alias("metric"),
                (
                    _change_over(F.col("own"), offsets, start, days)
                    - _change_over(mark["closes"], offsets, start, days)
                ).alias("value"),
            )
            for name, start, days in _measures(windows)
        ])

    return (
        quoted.filter(F.col("reason").isNull())
        .select(*CALL, "group", "copies", F.inline(F.flatten(F.transform("marks", against))))
        .filter(F.col("value").isNotNull())
    )


def exclusions(placed: DataFrame, returns: DataFrame) -> DataFrame:
    """Number of calls left out per reason, whole or for one window."""
    whole = placed.filter(F.col("reason").isNotNull()).select("reason", "copies")
    days = F.regexp_extract("measure", r"^drift(\d+)$", 1)
    windowed = returns.filter((days != "") & F.col("ret").isNull()).select(
        F.concat(F.lit("+"), days, F.lit("d window not complete yet")).alias("reason"), "copies"
    )
    return whole.unionByName(windowed).groupBy("reason").agg(F.sum("copies").alias("n"))


def window_members(returns: DataFrame) -> DataFrame:
    """Companies inside each (window, group); the stock's own return decides."""
    days = F.regexp_extract("measure", r"^drift(\d+)$", 1)
    return (
        returns.filter((days != "") & F.col("ret").isNotNull())
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(days.cast("int").alias("window"), "group", "company", "ticker", "date", "copy")
    )


def member_rows(
    members: DataFrame,
    windows: Sequence[int] = fixed.WINDOWS,
    groups: Sequence[str] = fixed.GROUPS,
) -> DataFrame:
    """One row per member with its position in (window, group) and the pair's count.

    An empty pair has one row without position and company.
    """
    spark = members.sparkSession
    keys = ["window", "group"]
    pairs = F.broadcast(
        spark.createDataFrame([(w, g) for w in windows for g in groups], "window int, group string")
    )
    order = [F.col(c) for c in ("company", "ticker", "date", "copy")]
    rows = positions(members, keys, order).select(*keys, "position", "company")
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_companies"))
    sized = F.broadcast(pairs.join(counts, keys, "left").na.fill(0, ["n_companies"]))
    empty = sized.filter("n_companies = 0").select(
        *keys, F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("company"),
        "n_companies",
    )
    return rows.join(sized, keys).select(*keys, "position", "company", "n_companies").unionByName(empty)


# --- statistics ------------------------------------------------------------------


def universe_average(values: DataFrame) -> DataFrame:
    """Mean of every metric over all groups."""
    return values.groupBy("metric").agg(F.avg("value").alias("mean"))


def excess_over_universe(values: DataFrame) -> DataFrame:
    """Values minus their metric's mean, as ``<metric>_minus_univ``.

    There is one mean per metric, so it is joined back by broadcast; a window
    would gather each metric in one task.
    """
    means = F.broadcast(universe_average(values))
    return values.join(means, "metric").select(
        *[c for c in values.columns if c not in ("metric", "value")],
        F.concat("metric", F.lit("_minus_univ")).alias("metric"),
        (F.col("value") - F.col("mean")).alias("value"),
    )


def group_stats(values: DataFrame, keys: Sequence[str] = ("group", "metric")) -> DataFrame:
    """n, mean, upper median, hit rate and p-value of the mean against zero."""
    keys = list(keys)
    base = values.filter(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("_mean"),
        F.stddev_samp("value").alias("_sd"),
        F.avg((F.col("value") > 0).cast("int")).alias("_hit"),
    )
    middle = upper_median(values, keys, "value", "_median", few_groups=True)
    p = t_test_p(F.col("n"), F.col("_mean"), F.col("_sd"))
    return base.join(middle, keys).select(
        *keys,
        "n",
        F.bround("_mean", 5).alias("mean"),
        F.bround("_median", 5).alias("median"),
        F.bround("_hit", 3).alias("hit_rate"),
        F.bround(p, 4).alias("p_value"),
    )


def wide_events(
    placed: DataFrame, values: DataFrame, benchmarks: Sequence[str], windows: Sequence[int]
) -> DataFrame:
    """One row per included call with every metric as a column (5 decimals)."""
    metrics = [f"jump_vs_{b}" for b in benchmarks]
    metrics += [f"drift{w}_vs_{b}" for w in windows for b in benchmarks]
    pivoted = values.groupBy(*CALL).pivot("metric", metrics).agg(F.bround(F.first("value"), 5))
    flag = F.when(F.col("group") == fixed.GROUPS[0], 1).otherwise(0)
    kept = placed.filter(F.col("reason").isNull()).select(*CALL, flag.alias("flag"), "copies")
    return kept.join(pivoted, list(CALL), "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).drop("copies", "copy")


def study_report(stats: DataFrame, windows: Sequence[int] = fixed.WINDOWS) -> DataFrame:
    """Readable rows per benchmark, group and window."""
    parts = F.regexp_extract("metric", r"^drift(\d+)_vs_(.*)$", 1)
    return (
        stats.withColumn("window", parts)
        .withColumn("benchmark", F.regexp_extract("metric", r"^drift(\d+)_vs_(.*)$", 2))
        .filter(F.col("window").isin(*[str(w) for w in windows]))
        .select(
            "benchmark",
            "group",
            F.concat(F.lit("+"), "window", F.lit("d")).alias("window"),
            "n",
            pct(F.col("mean")).alias("mean"),
            pct(F.col("median")).alias("median"),
            F.format_string("%d%%", F.bround(F.col("hit_rate") * 100).cast("int")).alias(
                "hit_rate"
            ),
            F.coalesce(F.col("p_value").cast("string"), F.lit(DASH)).alias("p_value"),
        )
    )
