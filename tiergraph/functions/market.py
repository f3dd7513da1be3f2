"""Market symbols and node sizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def market_symbol(ticker: Column, exchange: Column) -> Column:
    """Feed symbol of a listing; null for a blank ticker.

    Overrides first, then tickers that already carry a suffix, then the suffix
    of the exchange, then the suffix of bare numbers.
    """
    t = F.trim(F.coalesce(ticker, F.lit("")))
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(_lookup(fixed.SYMBOL_OVERRIDE, t).isNotNull(), _lookup(fixed.SYMBOL_OVERRIDE, t))
        .when(F.contains(t, F.lit(".")), t)
        .when(
            _lookup(fixed.EXCHANGE_SUFFIX, exchange).isNotNull(),
            F.concat(t, _lookup(fixed.EXCHANGE_SUFFIX, exchange)),
        )
        .when(t.rlike(r"^[0-9]+$"), F.concat(t, F.lit(fixed.NUMERIC_TICKER_SUFFIX)))
        .otherwise(t)
    )


def us_listed(ticker: Column, exchange: Column) -> Column:
    """Has a ticker and trades on one of the two US exchanges."""
    listed = (ticker != "") & exchange.isin(*fixed.US_EXCHANGES)
    return F.coalesce(listed, F.lit(False))


def node_size(degree: Column) -> Column:
    """Drawn size of a node: degree to the 1.5, at least four."""
    return F.greatest(F.lit(4), F.floor(F.pow(degree.cast("double"), F.lit(1.5)))).cast("bigint")


def half_up(value: Column, places: int) -> Column:
    """Round half towards plus infinity at ``places`` decimals."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / F.lit(scale)
