"""Queries of placement rules, renames, add-only merges and the additions stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.functions import placement_rules as pr
from tiergraph.operators import classify, clean, merge
from tiergraph.operators.ordering import positions
from tiergraph.plans import projections as pj
from tiergraph.plans.projections import SIGNALS, with_ctes
from tiergraph.plans.queries.documents import scratch
from tiergraph.plans.registry import query
from tiergraph.streaming import additions

# --- placement -----------------------------------------------------------------------------

# Products of the kinds the rules tell apart, spread over the line items.
PRODUCTS = (
    "HBM4 stacks", "1.6T PAM4 DSP", "ABF build-up film", "EUV lithography scanner",
    "liquid cooling CDU", "busbar and rack power", "Ethernet switch systems", "TC bonder tools",
    "InP epiwafer", "N3 logic wafers", "CoWoS interposer", "glass-core substrate panel",
    "GaN power module", "silicon photonics foundry", "server rack systems with thermal design",
    "MOCVD reactor", "organic polymer", "NVMe SSD controller", "CPO switch silicon", "BaTiO3 paste",
    "grain-oriented electrical steel", "immersion coolant", "Trainium UltraServer", "CPU and GPU mix",
)
TIERS = (
    "ai_lab", "hyperscaler", "power", "software", "equipment", "epiwafer", "packaging",
    "switch_system", "oem", "component", "raw_material", "retired_tier",
)
COMPANIES = ("Vertiv", "Asetek", "Broadcom", "MediaTek", "Google", "Cursor", "Quanta", "Plain Co")


def tier_players(spark, sf_dir, ord=None):
    """One player per line item; part and supplier numbers choose tier, product and company."""
    pick = lambda values, n: F.element_at(
        F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int")
    )
    return pj.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("chain"),
        pick(TIERS, F.col("l_partkey")).alias("tier"),
        pick(COMPANIES, F.col("l_orderkey")).alias("company"),
        pick(PRODUCTS, F.col("l_partkey") + F.col("l_linenumber")).alias("product"),
        F.array().cast("array<struct<company:string,relationship:string,contracts:array<struct<"
                       "source:string,signal:string,units:string,value:string,date_signed:string,"
                       "type:string>>>>").alias("connects_to"),
        F.array().cast("array<struct<quarter:string,signal:string,figure:string>>").alias(
            "quarterly_data"
        ),
        pj.line_order().alias("ord") if ord is None else ord,
    )


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(p, '{w}')" for w in words) + ")"


def _rule_sql(rule: pr.Rule) -> str:
    tests = [f"tier = '{rule.tier}'"]
    if rule.any_of:
        tests.append(_any(rule.any_of))
    if rule.also_any_of:
        tests.append(_any(rule.also_any_of))
    if rule.none_of:
        tests.append("NOT " + _any(rule.none_of))
    if rule.company:
        tests.append("c IN (" + ", ".join(f"'{x}'" for x in rule.company) + ")")
    return " AND ".join(tests)


def _sector_sql(table, default: str) -> str:
    cases = " ".join(f"WHEN {_any(words)} THEN '{sector}'" for sector, words in table)
    return f"CASE {cases} ELSE '{default}' END"


def _outcome(pick) -> str:
    cases = " ".join(f"WHEN {_rule_sql(r)} THEN {pick(r)}" for r in pr.RULES)
    return cases


_QUOTE = lambda v: "'" + v.replace("'", "''") + "'"
_SECTOR = lambda r: (
    _QUOTE(r.sector) if r.sector else
    _sector_sql(pr.THERMAL_SECTORS, pr.THERMAL_DEFAULT) if r.slug == "thermal"
    else _sector_sql(pr.POWER_SECTORS, pr.POWER_DEFAULT)
)
PLACED = f"""tier_players AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS chain, {pj.sql_list(TIERS)}[l_partkey % {len(TIERS)} + 1] AS tier,
         {pj.sql_list(COMPANIES)}[l_orderkey % {len(COMPANIES)} + 1] AS company,
         {pj.sql_list(PRODUCTS)}[(l_partkey + l_linenumber) % {len(PRODUCTS)} + 1] AS product
  FROM lineitem),
kinds AS (
  SELECT *, lower(product) AS p, lower(company) AS c, count(*) AS n FROM tier_players GROUP BY ALL),
placed AS (
  SELECT chain, tier, company, product, n,
    CASE {_outcome(lambda r: _QUOTE(r.slug))} ELSE 'compute_hardware' END AS slug,
    CASE {_outcome(_SECTOR)} ELSE 'Networking ASIC' END AS sector,
    CASE {_outcome(lambda r: _QUOTE(r.note))}
      ELSE 'unknown old tier ''' || tier || '''' END AS note,
    tier = 'oem' AND c = 'mediatek' AND slug = 'interconnect' AND note = '' AS mirrored FROM kinds)"""


@query(with_ctes(PLACED, """
SELECT tier, company, product, slug, sector, note, note <> '' AS flagged, sum(n) AS n
FROM placed GROUP BY ALL"""))
def classify_players(spark, sf_dir):
    placed = classify.classify_players(tier_players(spark, sf_dir))
    return placed.groupBy(
        "tier", "company", "product", "slug", "sector", "note", "flagged"
    ).agg(F.count(F.lit(1)).alias("n"))


REVIEWED = f"""told AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS chain, {pj.sql_list(TIERS)}[l_partkey % {len(TIERS)} + 1] AS tier,
         {pj.sql_list(COMPANIES)}[l_orderkey % {len(COMPANIES)} + 1] AS company,
         {pj.sql_list(PRODUCTS)}[(l_partkey + l_linenumber) % {len(PRODUCTS)} + 1] AS product,
         (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord
  FROM lineitem),
rev AS (
  SELECT chain, company, tier, slug, sector, note, false AS stub, ord
  FROM told JOIN placed USING (chain, tier, company, product)
  UNION ALL SELECT chain, company || ' (also)', tier, 'compute_hardware', 'Networking ASIC',
         'dual placement — mirror of primary', true, ord
  FROM told JOIN placed USING (chain, tier, company, product) WHERE mirrored),
review AS (
  SELECT *, note <> '' AND NOT stub AS flagged,
         CASE WHEN list_contains({pj.sql_list([s for s, _, _ in fixed.DOMAINS])}, slug)
              THEN 'domain' ELSE 'layer' END AS kind FROM rev)"""


@query(with_ctes(PLACED, REVIEWED, """
SELECT chain, company, tier, kind, slug, sector, flagged, note,
       row_number() OVER (ORDER BY flagged DESC, chain, ord, stub) - 1 AS position FROM review"""))
def review_table(spark, sf_dir):
    """Every placement as a row of the review, flagged ones first."""
    # Lines alike in these four are alike in all that the review shows.
    ord = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord")
    rows = classify.review_table(
        classify.add_stubs(classify.classify_players(tier_players(spark, sf_dir, ord)))
    )
    order = [F.col("flagged").desc(), F.col("chain"), F.col("ord")]
    return positions(rows, [], order).drop("ord")


@query(with_ctes(PLACED, """
SELECT chain, flagged, sum(n) AS n FROM (
  SELECT chain, note <> '' AS flagged, n FROM placed
  UNION ALL SELECT chain, false, n FROM placed WHERE mirrored) GROUP BY ALL"""))
def flag_counts(spark, sf_dir):
    return classify.flag_counts(
        classify.add_stubs(classify.classify_players(tier_players(spark, sf_dir)))
    )


@query(with_ctes(PLACED, """
SELECT chain, sum(n) AS n_before, coalesce(sum(n) FILTER (WHERE mirrored), 0) AS n_stubs
FROM placed GROUP BY chain"""))
def preservation_check(spark, sf_dir):
    players = tier_players(spark, sf_dir)
    after = classify.add_stubs(classify.classify_players(players))
    return classify.preservation_check(players, after).filter("preserved").select(
        "chain", "n_before", "n_stubs"
    )


# --- cleaning --------------------------------------------------------------------------------

NAMES = {"Supplier#000000001": "First Supplier", "Supplier#000000002": "Supplier#000000001"}
WORDS = {"the": "the the", "der": "die", "tion": "TION"}
LABELS = {f"src{i} Q{i % 4 + 1} FY2023": f"source {i} (01-01-2023)" for i in range(20)}


@query(with_ctes(SIGNALS, """
SELECT ord, CASE company WHEN 'Supplier#000000001' THEN 'First Supplier'
  WHEN 'Supplier#000000002' THEN 'Supplier#000000001' ELSE company END AS company,
  replace(replace(replace(signal, 'the', 'the the'), 'der', 'die'), 'tion', 'TION') AS signal
FROM signals"""))
def rename_entities(spark, sf_dir):
    renamed = clean.rename_entities(pj.signals(spark, sf_dir), ["company"], (), NAMES)
    renamed = clean.rename_entities(renamed, (), ["signal"], WORDS)
    return renamed.select("ord", "company", "signal")


@query(with_ctes(SIGNALS, f"""
fixes(old, new) AS (VALUES {pj.sql_rows(LABELS.items())})""", """
SELECT ord, coalesce(new, quarter) AS quarter FROM signals LEFT JOIN fixes ON old = quarter"""))
def normalise_labels(spark, sf_dir):
    fixed = clean.normalise_labels(pj.signals(spark, sf_dir), ("quarter",), LABELS)
    return fixed.select("ord", "quarter")


# --- merging ---------------------------------------------------------------------------------


@query("""
WITH base AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'),
fresh AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT user_id, event_type, props, value, event_id FROM base
UNION ALL
SELECT user_id, event_type, props, arg_min(value, event_id), min(event_id) FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.user_id = f.user_id
  AND b.event_type = f.event_type AND b.props = f.props)
GROUP BY user_id, event_type, props""")
def merge_additions(spark, sf_dir):
    events = pj.table(spark, sf_dir, "events")
    columns = ["user_id", "event_type", "props", "value", "event_id"]
    base = events.filter("ts < timestamp_ntz'2024-01-15 00:00:00'").select(*columns)
    new = events.filter("ts >= timestamp_ntz'2024-01-15 00:00:00'").select(*columns)
    return merge.merge_additions(base, new, ["user_id", "event_type", "props"], "event_id")


@query("""
SELECT user_id, event_type, arg_max(value, (strftime(ts, '%Y-%m-%d'), event_id)) AS value,
       strftime(max(ts), '%Y-%m-%d') AS asof FROM events GROUP BY 1, 2""")
def replace_latest(spark, sf_dir):
    rows = pj.table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("asof"),
        "event_id",
    )
    # One row per key and day first, so that a newer day is what decides.
    daily = rows.groupBy("user_id", "event_type", "asof").agg(
        F.max_by("value", "event_id").alias("value")
    )
    table = daily.filter("asof < '2024-01-20'")
    return merge.replace_latest(
        table, daily.filter("asof >= '2024-01-10'"), ["user_id", "event_type"], "asof"
    )


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS total, s.parts AS segment_sum,
       coalesce(abs(s.parts - o_totalprice) <= 0.5 * abs(o_totalprice), false) AS consistent
FROM orders LEFT JOIN (
  SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS parts
  FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey""")
def segment_totals(spark, sf_dir):
    parts = pj.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("value"),
    )
    totals = pj.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("total")
    )
    checked = merge.segment_totals_check(parts, totals, "o_orderkey", 0.5)
    return checked.select(
        "o_orderkey", F.round("total", 2).alias("total"),
        F.col("segment_sum").cast("double").alias("segment_sum"), "consistent",
    )


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def stream_additions(spark, sf_dir):
    """Events as a file stream, merged add-only by (user, type, properties)."""
    keys = ["user_id", "event_type", "props"]
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        sf_dir
    )
    stream = additions.distinct_additions(source.select(*keys, "event_id"), keys)
    target, state = scratch(spark, "additions"), scratch(spark, "additions-state")
    additions.stream_additions(stream, target, state, keys, "event_id").awaitTermination()
    return additions.stored_additions(spark, target).select(*keys)
