"""Short text forms of contracts, figures, slugs and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed

DASH = "—"
DOT = " · "


def contract_summary(units: Column, value: Column, date_signed: Column, kind: Column) -> Column:
    """Stated parts of a contract joined by a middle dot; placeholders dropped."""
    stated = F.filter(
        F.array(units, value, date_signed, kind),
        lambda x: x.isNotNull() & ~x.isin("", *fixed.PLACEHOLDERS),
    )
    return F.array_join(stated, DOT)


def figure_or_null(figure: Column) -> Column:
    """Null for an empty or placeholder figure."""
    return F.nullif(F.nullif(figure, F.lit("")), F.lit(fixed.PLACEHOLDERS[0]))


def slug_label(slug: Column) -> Column:
    """A slug with blanks for underscores."""
    return F.replace(slug, F.lit("_"), F.lit(" "))


def pct(share: Column) -> Column:
    """Signed percentage with one decimal, rounded half-even; a dash for null."""
    rounded = F.bround(share * 100.0, 1)
    shown = F.when((share < 0) & (rounded == 0), F.lit("-0.0%")).otherwise(
        F.format_string("%+.1f%%", rounded)
    )
    return F.when(share.isNull(), F.lit(DASH)).otherwise(shown)
