"""Ordered listings of a chain or of all companies, and role-level edges.

A listing has one column per group in canonical order; rows count headers and
players in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergraph.operators.flatten import _groups
from tiergraph.operators.graph import primary_group
from tiergraph.operators.ordering import positions
from tiergraph.sources import schemas

UNKNOWN_PLACE = 999
ITEM = (
    "array<struct<header:int,label:string,sub_sector:string,"
    f"player:{schemas.PLAYER.simpleString()}>>"
)


def _last_of_each_slug(groups: Column) -> Column:
    """Groups with a slug; where a slug repeats only its last group stays."""
    def final(g: Column, i: Column) -> Column:
        later = F.slice(groups, i + 2, F.greatest(F.size(groups) - i - 1, F.lit(0)))
        again = F.exists(later, lambda h: (h["kind"] == g["kind"]) & (h["slug"] == g["slug"]))
        return (F.coalesce(g["slug"], F.lit("")) != "") & ~again

    return F.filter(groups, final)


def _items(sector: Column) -> Column:
    """Header, then every sub-sector's header and players, then direct players."""
    blank, nothing = F.lit(""), F.lit(None)

    def header(level: int, label: Column) -> Column:
        return F.array(
            F.struct(F.lit(level), F.coalesce(label, blank), nothing, nothing)
        ).cast(ITEM)

    def rows(players: Column, sub: Column) -> Column:
        typed = F.coalesce(players, F.array().cast(schemas.SECTOR["players"].dataType))
        return F.transform(
            typed, lambda p: F.struct(nothing, nothing, F.coalesce(sub, blank), p)
        ).cast(ITEM)

    subs = F.coalesce(
        sector["sub_sectors"], F.array().cast(schemas.SECTOR["sub_sectors"].dataType)
    )
    nested = F.flatten(
        F.transform(
            subs,
            lambda s: F.concat(header(1, s["sub_sector"]), rows(s["players"], s["sub_sector"])),
        )
    )
    return F.concat(header(0, sector["sector"]), nested, rows(sector["players"], blank))


def _item_columns() -> list[Column]:
    """The columns of a listed item ``i`` of ``sector``."""
    blank = F.lit("")
    return [
        F.coalesce("sector", blank).alias("sector"),
        F.coalesce("i.sub_sector", blank).alias("sub_sector"),
        F.col("i.header").alias("header"), F.col("i.label").alias("label"),
        F.col("i.player.company").alias("company"),
        F.when(F.col("i.header").isNull(), F.coalesce("i.player.product", blank)).alias("product"),
        F.coalesce(F.size("i.player.quarterly_data"), F.lit(0)).alias("n_signals"),
        F.col("i.player.connects_to").alias("connects_to"),
    ]


def _whole_listing(chains: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``chain_listing`` of chains that are one document each, read off every document."""
    known = taxonomy.agg(F.map_from_entries(F.collect_list(
        F.struct(F.struct("kind", "slug"), "place")
    )).alias("_known"))
    key = lambda g: F.struct(g["kind"].alias("kind"), g["slug"].alias("slug"))
    named = F.filter(_groups(chains), lambda g: F.coalesce(g["slug"], F.lit("")) != "")
    placed = lambda k, i: F.struct(
        F.when(k["kind"] == "layer", 0).otherwise(1).alias("side"),
        F.coalesce(F.try_element_at(F.col("_known"), k), F.lit(UNKNOWN_PLACE)).alias("place"),
        i.alias("at"), k.alias("key"),
    )
    order = F.array_sort(F.transform(F.array_distinct(F.transform(named, key)), placed))
    groups = chains.crossJoin(F.broadcast(known)).select(
        "chain", F.transform(order, lambda x: x["key"]).alias("_order"),
        F.posexplode(_last_of_each_slug(_groups(chains))).alias("_g", "g"),
    )
    items = F.flatten(F.transform("g.sectors", lambda s: F.transform(
        _items(s), lambda i: F.struct(s["sector"].alias("sector"), i.alias("i"))
    )))
    col = F.array_position("_order", F.struct("g.kind", "g.slug")) - 1
    rows = groups.select(
        "chain", "g.kind", "g.slug", col.cast("bigint").alias("col"), "_g",
        F.posexplode(items).alias("_i", "_item"),
    )
    return rows.select("*", "_item.sector", "_item.i").select(
        "chain", "kind", "slug", *_item_columns(), F.struct("_g", "_i").alias("ord"),
        F.col("_i").cast("bigint").alias("row"), "col",
    )


def chain_listing(chains: DataFrame, taxonomy: DataFrame, bounded: bool = False) -> DataFrame:
    """Headers and players of every chain with their column and row.

    Columns are layers, then domains, in canonical order with unknown slugs last;
    rows start at 0 in each column. Where a slug occurs in two groups of a
    document the last one is listed. ``connects_to`` is kept for ``role_edges``.
    ``bounded`` says that every chain is one document, whose rows need no shuffle.
    """
    if bounded:
        return _whole_listing(chains, taxonomy)
    groups = chains.select(
        "chain", "part", "continues",
        F.posexplode(_last_of_each_slug(_groups(chains))).alias("_g", "g"),
    ).select("chain", "part", "continues", "_g", "g.kind", "g.slug", "g.sectors")
    every = (
        chains.select("chain", "part", F.posexplode(_groups(chains)).alias("_at", "g"))
        .select("chain", "part", "_at", "g.kind", "g.slug")
        .filter(F.coalesce("slug", F.lit("")) != "")
    )
    place = F.broadcast(taxonomy.select("kind", "slug", "place"))
    columns = (
        every.groupBy("chain", "kind", "slug")
        .agg(F.min(F.struct("part", "_at")).alias("_first"))
        .join(place, ["kind", "slug"], "left")
        .withColumn(
            "col",
            F.row_number().over(
                Window.partitionBy("chain").orderBy(
                    F.when(F.col("kind") == "layer", 0).otherwise(1),
                    F.coalesce("place", F.lit(UNKNOWN_PLACE)),
                    "_first",
                )
            ) - 1,
        )
        .select("chain", "kind", "slug", F.col("col").cast("bigint").alias("col"))
    )
    # The header of a sector that continues from the part before was listed there.
    again = F.coalesce("continues", F.lit(False)) & (F.col("_g") == 0) & (F.col("_s") == 0)
    items = (
        groups.select(
            "chain", "part", "continues", "_g", "kind", "slug",
            F.posexplode("sectors").alias("_s", "s"),
        )
        .select(
            "chain", "part", "kind", "slug", "_g", "_s", again.alias("_again"),
            F.col("s.sector").alias("sector"), F.posexplode(_items(F.col("s"))).alias("_i", "i"),
        )
        .filter(~F.col("_again") | (F.col("_i") > 0))
        .select(
            "chain", "kind", "slug", *_item_columns(),
            F.struct("part", "_g", "_s", "_i").alias("ord"),
        )
    )
    rowed = positions(items, ["chain", "kind", "slug"], [F.col("ord")], "row")
    return rowed.join(columns, ["chain", "kind", "slug"])


def first_positions(listing: DataFrame) -> DataFrame:
    """First (col, row) of every company in each chain."""
    return (
        listing.filter(F.col("company").isNotNull())
        .groupBy("chain", "company")
        .agg(F.min(F.struct("col", "row")).alias("at"))
        .select("chain", "company", "at.col", "at.row")
    )


def _whole_role_edges(listing: DataFrame) -> DataFrame:
    """``role_edges`` of chains that fit a window: a place and what it states share a name."""
    at, edges = F.struct("col", "row"), F.col("connects_to")
    size = lambda e: F.greatest(F.coalesce(F.size(e["contracts"]), F.lit(0)), F.lit(0))
    stated = F.transform(
        F.filter(
            F.transform(edges, lambda e, i: F.struct(i.alias("i"), e.alias("e"))),
            lambda x: F.coalesce(x["e"]["company"] != F.col("company"), F.lit(False)),
        ),
        lambda x: F.struct(
            x["e"]["company"].alias("name"),
            F.struct(
                F.col("col").alias("from_col"), F.col("row").alias("from_row"), x["i"].alias("_e")
            ).alias("ord"),
            F.coalesce(x["e"]["relationship"], F.lit("")).alias("relationship"),
            size(x["e"]).alias("n_contracts"),
        ),
    )
    kind = (
        "array<struct<name:string,ord:struct<from_col:bigint,from_row:bigint,_e:int>,"
        "relationship:string,n_contracts:int>>"
    )
    here = F.array(F.struct("company", F.lit(None), F.lit(None), F.lit(None))).cast(kind)
    rows = listing.select(
        "chain", F.col("company").alias("source"), at.alias("_at"),
        F.inline(F.concat(here, F.coalesce(stated.cast(kind), F.array().cast(kind)))),
    )
    whole, named = Window.partitionBy("chain"), Window.partitionBy("chain", "name")
    place = F.col("ord").isNull() & F.col("name").isNotNull()
    rows = rows.select(
        "*", (F.max("_at.col").over(whole) + 1).alias("_width"),
        F.min(F.when(place, F.col("_at"))).over(named).alias("_to"),
        F.min("ord").over(named).alias("_named"),
    ).filter(F.col("ord").isNotNull())
    order = Window.partitionBy("chain", F.col("_to").isNull()).orderBy("_named")
    outer = (F.dense_rank().over(order) - 1).cast("bigint")
    return rows.withColumn("_outer", outer).select(
        "chain", "source", F.col("name").alias("target"), "ord.from_col", "ord.from_row",
        F.coalesce("_to.col", "_width").alias("to_col"), F.coalesce("_to.row", "_outer").alias("to_row"),
        "relationship", "n_contracts", F.col("_to").isNull().alias("external"), "ord",
    )


def role_edges(listing: DataFrame, bounded: bool = False) -> DataFrame:
    """Edges between places: from this very role to the target's first place.

    Targets that are not listed in the chain stand in one more column, External,
    in the order they are first named. ``bounded`` says that a chain fits one task.
    """
    if bounded:
        return _whole_role_edges(listing)
    stated = (
        listing.select(
            "chain", F.col("col").alias("from_col"), F.col("row").alias("from_row"),
            F.col("company").alias("source"), F.posexplode("connects_to").alias("_e", "e"),
        )
        .filter(F.col("e.company") != F.col("source"))
        .select(
            "chain", "from_col", "from_row", "source", F.col("e.company").alias("target"),
            F.coalesce("e.relationship", F.lit("")).alias("relationship"),
            F.greatest(F.coalesce(F.size("e.contracts"), F.lit(0)), F.lit(0)).alias("n_contracts"),
            F.struct("from_col", "from_row", "_e").alias("ord"),
        )
    )
    at = first_positions(listing).select(
        "chain", F.col("company").alias("target"), F.col("col").alias("_col"),
        F.col("row").alias("_row"),
    )
    outside = (
        stated.groupBy("chain", "target").agg(F.min("ord").alias("ord"))
        .join(at, ["chain", "target"], "left_anti")
    )
    width = listing.groupBy("chain").agg((F.max("col") + 1).alias("_width"))
    external = (
        positions(outside, ["chain"], [F.col("ord")], "_row")
        .join(width, "chain")
        .select("chain", "target", F.col("_width").alias("_col"), "_row")
    )
    place = at.withColumn("external", F.lit(False)).unionByName(
        external.withColumn("external", F.lit(True))
    )
    return stated.join(place, ["chain", "target"]).select(
        "chain", "source", "target", "from_col", "from_row",
        F.col("_col").alias("to_col"), F.col("_row").alias("to_row"),
        "relationship", "n_contracts", "external", "ord",
    )


def group_listing(
    nodes: DataFrame,
    members: DataFrame,
    taxonomy: DataFrame,
    roles: DataFrame | None = None,
    signals: DataFrame | None = None,
) -> DataFrame:
    """All companies by primary group: headers and companies with column and row.

    Inside a column companies sort by first sector, then name, both in locale
    order; each new non-blank sector opens with a header row. Groups outside the
    vocabulary are not listed, companies without any group stand under ``other``.
    With ``roles`` companies show their first product, with ``signals`` how many they have.
    """
    sector = members.filter(F.col("facet") == "sector").groupBy("id").agg(
        F.min_by("value", "ord").alias("sector")
    )
    grouped = nodes.select("id").join(primary_group(members, "other"), "id", "left").join(
        sector, "id", "left"
    )
    return listed_groups(grouped, taxonomy, roles, signals)


def listed_groups(
    grouped: DataFrame,
    taxonomy: DataFrame,
    roles: DataFrame | None = None,
    signals: DataFrame | None = None,
) -> DataFrame:
    """``group_listing`` of companies with their ``primary`` group and first ``sector``."""
    spark = grouped.sparkSession
    shown = taxonomy.select(
        "slug", (F.col("place") + F.when(F.col("kind") == "domain", 100).otherwise(0)).alias("at")
    ).unionByName(spark.createDataFrame([("other", 1000)], "slug string, at int"))
    listed = (
        grouped.withColumn("slug", F.coalesce("primary", F.lit("other")))
        .join(F.broadcast(shown), "slug")
        .select("slug", "at", "id", F.coalesce("sector", F.lit("")).alias("sector"))
    )
    locale = [F.collate("sector", "UNICODE"), F.collate("id", "UNICODE"), F.col("id")]
    placed = positions(listed, ["slug"], locale, "_pos")
    by_sector = Window.partitionBy("slug").orderBy(F.collate("sector", "UNICODE"), "sector")
    heads = (
        placed.filter(F.col("sector") != "")
        .groupBy("slug", "sector")
        .agg(F.min("_pos").alias("_first"))
        .withColumn("_heads", F.row_number().over(by_sector).cast("bigint"))
    )
    columns = (
        placed.groupBy("slug", "at").count()
        .withColumn("col", (F.row_number().over(Window.orderBy("at")) - 1).cast("bigint"))
        .select("slug", "col")
    )
    players = placed.join(heads, ["slug", "sector"], "left").select(
        "slug", F.lit(False).alias("is_header"), F.col("id").alias("label"), "sector",
        (F.col("_pos") + F.coalesce("_heads", F.lit(0))).alias("row"),
    )
    headers = heads.select(
        "slug", F.lit(True).alias("is_header"), F.col("sector").alias("label"), "sector",
        (F.col("_first") + F.col("_heads") - 1).alias("row"),
    )
    if roles is not None:
        first = roles.groupBy(F.col("company").alias("label")).agg(
            F.coalesce(F.min_by("product", "ord"), F.lit("")).alias("product")
        )
        players = players.join(first, "label", "left").na.fill("", ["product"])
        headers = headers.withColumn("product", F.lit(None).cast("string"))
    if signals is not None:
        said = signals.groupBy(F.col("company").alias("label")).agg(F.count(F.lit(1)).alias("n_signals"))
        players = players.join(said, "label", "left").na.fill(0, ["n_signals"])
        headers = headers.withColumn("n_signals", F.lit(None).cast("bigint"))
    # One row per group of the fixed vocabulary.
    return players.unionByName(headers).join(F.broadcast(columns), "slug")


def placed_edges(edges: DataFrame, listing: DataFrame) -> DataFrame:
    """Edges from (col, row) to (col, row) of a merged listing; both ends must be listed."""
    at = lambda end, side: listing.filter(~F.col("is_header")).select(
        F.col("label").alias(end), F.col("col").alias(f"{side}_col"), F.col("row").alias(f"{side}_row")
    )
    return edges.join(at("source", "from"), "source").join(at("target", "to"), "target")


def linked_places(edges: DataFrame, listing: DataFrame) -> DataFrame:
    """``placed_edges`` counted by their ends.

    Edges meet the target's place first, which leaves out those that lead nowhere, and are
    counted there, so only different pairs go on to the source's place.
    """
    at = lambda end, side: listing.filter(~F.col("is_header")).select(
        F.col("label").alias(end), F.col("col").alias(f"{side}_col"), F.col("row").alias(f"{side}_row")
    )
    ends = edges.select("source", "target").join(at("target", "to"), "target")
    counted = ends.groupBy("source", "target", "to_col", "to_row").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(at("source", "from"), "source").select(
        "source", "target", "from_col", "from_row", "to_col", "to_row", "n"
    )
