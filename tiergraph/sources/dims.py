"""Small literal dimensions: groups, chain colours, transitions, ranks.

Their sizes are fixed by the vocabularies, which is why callers may broadcast
them without measuring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tiergraph.functions import fixed_values as fixed


def taxonomy(spark: SparkSession) -> DataFrame:
    """The 13 layers and 4 domains: slug, kind, name, colour and place in their list."""
    rows = [(s, "layer", n, c, i) for i, (s, n, c) in enumerate(fixed.LAYERS)]
    rows += [(s, "domain", n, c, i) for i, (s, n, c) in enumerate(fixed.DOMAINS)]
    return spark.createDataFrame(
        rows, "slug string, kind string, name string, color string, place int"
    )


def chain_colors(spark: SparkSession) -> DataFrame:
    """Colour of each known chain."""
    return spark.createDataFrame(list(fixed.CHAIN_COLORS.items()), "chain string, color string")


def transitions(
    spark: SparkSession,
    catalogue: Sequence[tuple[str, Sequence[str], Sequence[str]]] = fixed.TRANSITIONS,
) -> DataFrame:
    """One row per (transition, side, chain); a side may hold several chains."""
    rows = [
        (key, side, chain, place)
        for key, old, new in catalogue
        for side, chains in (("from", old), ("to", new))
        for place, chain in enumerate(chains)
    ]
    return spark.createDataFrame(rows, "transition string, side string, chain string, place int")


def ranks(spark: SparkSession, names: Sequence[str], key: str) -> DataFrame:
    """A fixed list as ``(key, rank)`` rows."""
    rows = [(name, place) for place, name in enumerate(names)]
    return spark.createDataFrame(rows, f"{key} string, rank int")
