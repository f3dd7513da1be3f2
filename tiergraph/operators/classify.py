"""Place players of the older tier shape by ordered keyword rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.functions import placement_rules as pr
from tiergraph.functions.text import contains_any
from tiergraph.session import cut
from tiergraph.sources import schemas

MIRROR_NOTE = "dual placement — mirror of primary"


def explode_tier_players(chains: DataFrame) -> DataFrame:
    """One row per (tier, player) of a document in the older shape."""
    return (
        chains.select("chain", "path", F.posexplode("flow").alias("_t", "t"))
        .select("chain", "path", "_t", "t.tier", F.posexplode("t.players").alias("_p", "p"))
        .select("chain", "tier", "p.*", F.struct("path", "_t", "_p").alias("ord"))
    )


def _fits(rule: pr.Rule, product: Column, company: Column) -> Column:
    fit = F.lit(True)
    if rule.any_of:
        fit = fit & contains_any(product, rule.any_of)
    if rule.also_any_of:
        fit = fit & contains_any(product, rule.also_any_of)
    if rule.none_of:
        fit = fit & ~contains_any(product, rule.none_of)
    if rule.company:
        fit = fit & company.isin(*rule.company)
    return fit


def _first_sector(
    product: Column, table: Sequence[tuple[str, tuple[str, ...]]], default: str
) -> Column:
    choice = F.when(contains_any(product, table[0][1]), table[0][0])
    for sector, words in table[1:]:
        choice = choice.when(contains_any(product, words), sector)
    return choice.otherwise(default)


def rule_number(tier: Column, product: Column, company: Column, rules: Sequence[pr.Rule]) -> Column:
    """Number of the first fitting rule of the tier; null for an unknown tier."""
    by_tier: dict[str, Column] = {}
    for number, rule in enumerate(rules):
        fit = _fits(rule, product, company)
        known = by_tier.get(rule.tier)
        by_tier[rule.tier] = (
            F.when(fit, number) if known is None else known.when(fit, number)
        )
    (first, choice), *rest = by_tier.items()
    number = F.when(tier == first, choice)
    for name, choice in rest:
        number = number.when(tier == name, choice)
    return number


def classify_players(players: DataFrame, rules: Sequence[pr.Rule] = pr.RULES) -> DataFrame:
    """Add kind, slug, sector, flagged, note and mirror (second placement) to players.

    The rules are a literal table of fixed size. They are tried once for every different tier,
    product and company, and players take the outcome of theirs.
    """
    spark = players.sparkSession
    mirror = "struct<kind:string,slug:string,sector:string>"
    outcomes = spark.createDataFrame(
        [
            (i, r.kind, r.slug, r.sector, bool(r.note), r.note, r.mirror)
            for i, r in enumerate(rules)
        ],
        f"_rule int, kind string, slug string, _sector string, flagged boolean, note string, "
        f"mirror {mirror}",
    )
    kind, slug, sector = pr.UNKNOWN_TIER
    unknown = F.concat(
        F.lit("unknown old tier '"), F.coalesce("tier", F.lit("None")), F.lit("'")
    )
    own = (
        F.when(F.col("_rule").isNull(), sector)
        .when(F.col("_sector").isNotNull(), F.col("_sector"))
        .when(F.col("slug") == "thermal",
              _first_sector(F.col("_product"), pr.THERMAL_SECTORS, pr.THERMAL_DEFAULT))
        .otherwise(_first_sector(F.col("_product"), pr.POWER_SECTORS, pr.POWER_DEFAULT))
    )
    lowered = lambda name: F.lower(F.coalesce(name, F.lit("")))
    # As one array the three are a key in which nulls are equal.
    keyed = players.withColumn("_key", F.array("tier", lowered("product"), lowered("company")))
    tier, product, company = (F.col("_key")[i] for i in range(3))
    numbered = keyed.select("_key").distinct().select(
        "_key", tier.alias("tier"), product.alias("_product"), company.alias("_company")
    ).withColumn("_rule", rule_number(F.col("tier"), F.col("_product"), F.col("_company"), rules))
    placed = cut(numbered.join(F.broadcast(outcomes), "_rule", "left").select(
        "_key", F.coalesce("kind", F.lit(kind)).alias("kind"), F.coalesce("slug", F.lit(slug)).alias("slug"),
        F.coalesce("flagged", F.lit(True)).alias("flagged"), F.coalesce("note", unknown).alias("note"),
        "mirror", own.alias("sector"),
    ))
    return keyed.join(placed, "_key").drop("_key")


def add_stubs(placed: DataFrame) -> DataFrame:
    """Players plus a thin stub (no edges, no data) for every second placement."""
    empty = lambda name: F.array().cast(schemas.PLAYER[name].dataType)
    second = F.when(F.col("mirror").isNotNull(), F.array(F.lit(False), F.lit(True)))
    both = placed.withColumn("stub", F.explode(F.coalesce(second, F.array(F.lit(False)))))
    of_stub = {
        "kind": F.col("mirror.kind"), "slug": F.col("mirror.slug"), "sector": F.col("mirror.sector"),
        "connects_to": empty("connects_to"), "quarterly_data": empty("quarterly_data"),
        "flagged": F.lit(False), "note": F.lit(MIRROR_NOTE),
        "mirror": F.lit(None).cast(placed.schema["mirror"].dataType),
    }
    return both.select(*[
        F.struct(F.col("ord").alias("player"), "stub").alias("ord") if c == "ord"
        else F.when(F.col("stub"), of_stub[c]).otherwise(F.col(c)).alias(c) if c in of_stub else c
        for c in both.columns
    ])


def review_table(placements: DataFrame) -> DataFrame:
    """Every placement with flag and note, flagged ones first, then in order."""
    name = F.when(F.col("stub"), F.concat("company", F.lit(" (also)"))).otherwise(F.col("company"))
    return placements.select(
        "chain", name.alias("company"), "tier", "kind", "slug", "sector", "flagged", "note", "ord"
    ).orderBy(F.col("flagged").desc(), "chain", "ord")


def flag_counts(placements: DataFrame) -> DataFrame:
    """Flagged and clean placements per chain."""
    return placements.groupBy("chain", "flagged").agg(F.count(F.lit(1)).alias("n"))


def preservation_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per chain: players before, stubs added, players after, and whether they agree."""
    old = before.groupBy("chain").agg(F.count(F.lit(1)).alias("n_before"))
    new = after.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n_after"), F.count_if("stub").alias("n_stubs")
    )
    counts = old.join(new, "chain", "full").na.fill(0, ["n_before", "n_after", "n_stubs"])
    return counts.withColumn(
        "preserved", F.col("n_before") + F.col("n_stubs") == F.col("n_after")
    )


def require_preserved(checked: DataFrame) -> None:
    """Fail when some chain lost or gained players."""
    lost = checked.filter(~F.col("preserved")).limit(5).collect()
    if lost:
        raise ValueError(f"player counts differ: {lost}")
