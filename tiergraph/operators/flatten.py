"""Chain documents -> one row per player, edge, contract, signal and role.

``ord`` is a struct that sorts rows in document walk order. Every later rule
about what was seen first reads it, so nothing relies on physical row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.operators.ordering import earlier, null_safe_join, ranged_rows, running_sum
from tiergraph.session import cut
from tiergraph.sources import schemas

PART_SIZE = 100_000


def _empty(column: Column, item_type: str) -> Column:
    return F.coalesce(column, F.array().cast(f"array<{item_type}>"))


def _groups(chains: DataFrame) -> Column:
    """Layer groups followed by domain groups, in one shape."""
    def shaped(column: str, kind: str) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.array().cast(chains.schema[column].dataType)),
            lambda g: F.struct(
                F.lit(kind).alias("kind"), g[kind].alias("slug"), g["sectors"].alias("sectors")
            ),
        )

    return F.concat(shaped("flow", "layer"), shaped("domains", "domain"))


def sector_members(sector: Column) -> Column:
    """Players of a sector: those of its sub-sectors first, then its own."""
    player = schemas.PLAYER.simpleString()

    def placed(players: Column, sub: Column) -> Column:
        return F.transform(
            _empty(players, player),
            lambda p: F.struct(p.alias("player"), sub.alias("sub_sector")),
        )

    nested = F.flatten(
        F.transform(
            _empty(sector["sub_sectors"], schemas.SUB_SECTOR.simpleString()),
            lambda s: placed(s["players"], s["sub_sector"]),
        )
    )
    return F.concat(nested, placed(sector["players"], F.lit(None).cast("string")))


def explode_players(chains: DataFrame) -> DataFrame:
    """One row per player with its group, sector, sub-sector and walk order.

    Every array stands in a column of its own before it is exploded, with what else is needed of
    its parent beside it. Otherwise each row carries a copy of all the rows that it came from.
    """
    return (
        chains.select("chain", "path", "part", _groups(chains).alias("_groups"))
        .select("chain", "path", "part", F.posexplode("_groups").alias("_g", "g"))
        .select("chain", "path", "part", "_g", "g.kind", "g.slug", F.col("g.sectors").alias("_sectors"))
        .select(
            "chain", "path", "part", "_g", "kind", "slug", F.posexplode("_sectors").alias("_s", "s")
        )
        .select(
            "chain", "path", "part", "_g", "kind", "slug", "_s", F.col("s.sector").alias("sector"),
            sector_members(F.col("s")).alias("_members"),
        )
        .select(
            "chain", "path", "part", "_g", "kind", "slug", "_s", "sector",
            F.posexplode("_members").alias("_m", "m"),
        )
        .select(
            "chain", "kind", "slug", "sector", "m.sub_sector",
            "m.player.company", "m.player.product", "m.player.connects_to",
            "m.player.quarterly_data",
            F.struct("path", "part", "_g", "_s", "_m").alias("ord"),
        )
    )


def explode_edges(players: DataFrame) -> DataFrame:
    """One row per stated connection; connections of a company to itself are dropped."""
    contract = schemas.CONTRACT.simpleString()
    return (
        players.select(
            F.col("company").alias("source"), "chain", "ord",
            F.posexplode("connects_to").alias("_e", "e"),
        )
        .filter(F.col("e.company") != F.col("source"))
        .select(
            "source",
            F.col("e.company").alias("target"),
            F.col("e.relationship").alias("relationship"),
            _empty(F.col("e.contracts"), contract).alias("contracts"),
            "chain",
            F.struct(F.col("ord").alias("player"), F.col("_e").alias("edge")).alias("ord"),
        )
    )


def explode_contracts(edges: DataFrame) -> DataFrame:
    """One row per contract of every edge."""
    return edges.select(
        F.col("source"), F.col("target"), "relationship", "chain", "ord",
        F.posexplode("contracts").alias("_c", "contract"),
    ).select(
        "source", "target", "relationship", "chain", "contract",
        F.struct(F.col("ord").alias("edge"), F.col("_c").alias("contract")).alias("ord"),
    )


def explode_signals(players: DataFrame) -> DataFrame:
    """One row per quarterly datum, tagged with the chain it was stated in."""
    return players.select(
        "company", "chain", "ord", F.posexplode("quarterly_data").alias("_q", "q")
    ).select(
        "company", "q.quarter", "q.signal", "q.figure", "chain",
        F.struct(F.col("ord").alias("player"), F.col("_q").alias("signal")).alias("ord"),
    )


def product_roles(players: DataFrame) -> DataFrame:
    """What each company does where; exactly one of layer and domain is set."""
    return players.select(
        "company",
        "chain",
        F.when(F.col("kind") == "layer", F.col("slug")).alias("layer"),
        F.when(F.col("kind") == "domain", F.col("slug")).alias("domain"),
        "sector",
        "sub_sector",
        "product",
        "ord",
    )


def renest_chains(
    players: DataFrame, taxonomy: DataFrame, part_size: int = PART_SIZE, bounded: bool = False
) -> DataFrame:
    """Players -> chain documents, the inverse of ``explode_players``.

    Layers and domains come in canonical order (unknown slugs last), sectors in
    the order they were first seen, players in walk order. Sub-sectors are not
    rebuilt. A chain continues in a further document every ``part_size`` players, so no
    document has to hold a whole huge chain; ``bounded`` says that every chain fits in one.
    ``players`` needs chain, kind, slug, sector, company, product, connects_to,
    quarterly_data and ord.
    """
    if bounded:
        parted = _grouped(players, taxonomy).select(
            "*", F.lit(0).cast("bigint").alias("part"), F.col("ord").alias("_at"),
            F.lit(False).alias("_continues"),
        )
    else:
        # A part is bounded, so its rows may meet once and be nested without more shuffles.
        parted = _parts(players, taxonomy, part_size).repartition("chain", "part")
    player = F.struct("company", "product", "connects_to", "quarterly_data").alias("p")
    sectors = parted.groupBy("chain", "part", "kind", "slug", "_group", "sector").agg(
        F.min("_at").alias("_sector_at"),
        F.sort_array(F.collect_list(F.struct("_at", player))).alias("_players"),
        F.bool_or("_continues").alias("_continues"),
    )
    sector = F.struct(
        "sector",
        F.transform("_players", lambda x: x["p"]).alias("players"),
        F.lit(None).cast(schemas.SECTOR["sub_sectors"].dataType).alias("sub_sectors"),
    )
    placed = F.struct("_group", "_sector_at", "kind", "slug", sector.alias("s"))
    documents = sectors.groupBy("chain", "part").agg(
        F.array_sort(F.collect_list(placed)).alias("_sectors"),
        F.bool_or("_continues").alias("continues"),
    )

    def groups(kind: str) -> Column:
        """Distinct slugs of a kind in canonical, then first-seen order, with their sectors."""
        mine = F.filter("_sectors", lambda x: x["kind"] == kind)
        slugs = F.array_distinct(F.transform(mine, lambda x: x["slug"]))
        return F.transform(
            slugs,
            lambda slug: F.struct(
                slug.alias(kind),
                F.transform(
                    F.filter(mine, lambda x: x["slug"].eqNullSafe(slug)), lambda x: x["s"]
                ).alias("sectors"),
            ),
        )

    return documents.select(
        "chain", "part", groups("layer").alias("flow"), groups("domain").alias("domains"),
        "continues",
    )


def _grouped(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Add ``_group``, the canonical place of a row's layer or domain."""
    order = F.broadcast(taxonomy.select("kind", "slug", F.col("place").alias("_place")))
    return rows.join(order, ["kind", "slug"], "left").withColumn(
        "_group",
        F.struct(
            F.when(F.col("kind") == "layer", 0).otherwise(1).alias("side"),
            F.coalesce("_place", F.lit(999)).alias("place"),
        ),
    ).drop("_place")


def _parts(players: DataFrame, taxonomy: DataFrame, part_size: int) -> DataFrame:
    """Number players in nested order and cut every chain into parts.

    Players are read and sorted once, by sector. What a chain holds before a sector comes from
    sums of the sectors' sizes, so no player is moved to be numbered. ``_continues`` marks the
    first player of a part whose sector began earlier.
    """
    keys = ["chain", "kind", "slug", "sector"]
    rows = ranged_rows(players, [F.col(k) for k in (*keys, "ord")])
    runs = cut(
        rows.groupBy("_slice", *keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"), F.min("ord").alias("_seen")
        )
    )
    sectors = runs.groupBy(*keys).agg(F.sum("_n").alias("_size"), F.min("_seen").alias("_sector_at"))
    slugs = runs.groupBy("chain", "kind", "slug").agg(F.min("_seen").alias("_slug_at"))
    sectors = _grouped(null_safe_join(sectors, slugs, ["chain", "kind", "slug"]), taxonomy)
    order = [F.col(c) for c in ("_group", "_slug_at", "_sector_at", "kind", "slug", "sector")]
    sectors = running_sum(sectors, ["chain"], order, "_size", "_start").select(*keys, "_group", "_start")
    known = null_safe_join(earlier(runs, keys, "_n", "_earlier"), sectors, keys)
    # Kept, so that the optimizer knows how small the table of sectors is.
    known = cut(
        known.select(
            "_slice", *keys, "_group", "_start",
            (F.col("_start") + F.col("_earlier") - F.col("_first")).alias("_shift"),
        )
    )
    placed = null_safe_join(rows, known, ["_slice", *keys]).withColumn(
        "_at", F.col("_row") + F.col("_shift")
    )
    opens_part = (F.col("_at") > 0) & (F.col("_at") % part_size == 0)
    return placed.select(
        *keys, "_group", "company", "product", "connects_to", "quarterly_data", "_at",
        F.floor(F.col("_at") / part_size).alias("part"),
        (opens_part & (F.col("_at") != F.col("_start"))).alias("_continues"),
    )
