"""Engine inputs projected from the star-schema tables, as DataFrames and as SQL.

Each projection reads its tables whole. The SQL twin is a common table
expression of the same name, written on its own so that it can check the
DataFrame form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed
from tiergraph.operators.flatten import renest_chains
from tiergraph.operators.reach import downstream, thinned, two_hops
from tiergraph.session import cut
from tiergraph.sources.dims import taxonomy

# Slugs by ``size mod 18``: 13 layers, 4 domains and one slug outside the vocabulary.
SLUGS = [s for s, _, _ in fixed.LAYERS] + [s for s, _, _ in fixed.DOMAINS] + ["legacy"]
BENCHMARKS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
WINDOWS = (5, 10, 20)
# 2001-06-15 12:00:00 and 2024-02-20 00:00:00, 2024-01-01 00:00:00 in epoch seconds.
COVERAGE_NOW = 992606400
BARS_NOW, BARS_YEAR_START = 1708387200, 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    days = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    return days * 86400 + clock.cast("bigint")


def slug_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SLUGS]), (number % 18 + 1).cast("int"))


def kind_of(number: Column) -> Column:
    return F.when((number % 18).between(13, 16), "domain").otherwise("layer")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_rows(rows) -> str:
    def cell(v) -> str:
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def with_ctes(*parts: str) -> str:
    """``WITH`` the given tables; the last part is the query."""
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


# --- line items as players and edges ---------------------------------------------

# Two lines may share all four keys; the rest of their columns then decides.
LINE_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate",
)
SQL_ORD = f"({', '.join(LINE_ORDER)})"


def line_order() -> Column:
    return F.struct(*LINE_ORDER)


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One player per line item: the supplier in its part's brand."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size"
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name"
    )
    return lines.join(parts, "l_partkey").join(suppliers, "l_suppkey").select(
        F.col("s_name").alias("company"),
        F.col("p_brand").alias("chain"),
        kind_of(F.col("p_size")).alias("kind"),
        slug_of(F.col("p_size")).alias("slug"),
        F.col("p_type").alias("sector"),
        F.lit(None).cast("string").alias("sub_sector"),
        F.col("p_name").alias("product"),
        F.col("p_size").alias("size"),
        line_order().alias("ord"),
    )


PLAYERS = f"""players AS (
  SELECT s_name AS company, p_brand AS chain,
         CASE WHEN p_size % 18 BETWEEN 13 AND 16 THEN 'domain' ELSE 'layer' END AS kind,
         {sql_list(SLUGS)}[p_size % 18 + 1] AS slug,
         p_type AS sector, p_name AS product, p_size AS size,
         {SQL_ORD} AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

MEMBERS = """members AS (
  SELECT company AS id, facet, value, min(ord) AS ord FROM (
    SELECT company, 'layer' AS facet, slug AS value, ord FROM players WHERE kind = 'layer'
    UNION ALL SELECT company, 'domain', slug, ord FROM players WHERE kind = 'domain'
    UNION ALL SELECT company, 'sector', sector, ord FROM players
    UNION ALL SELECT company, 'chain', chain, ord FROM players)
  GROUP BY company, facet, value)"""


def contract() -> Column:
    """The terms of a line as contract texts."""
    return F.struct(
        F.col("l_orderkey").cast("string").alias("source"),
        F.col("l_linestatus").alias("signal"),
        F.col("l_quantity").cast("bigint").cast("string").alias("units"),
        F.lit("no specific figure").alias("value"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_signed"),
        F.lit("").alias("type"),
    )


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's name, joined before lines meet them: lines outnumber orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name"
    )
    return orders.join(customers, "o_custkey").select("l_orderkey", "o_orderpriority", "c_name")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per line item: supplier -> customer; open lines carry a contract."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name"
    )
    none = F.array().cast("array<struct<source:string,signal:string,units:string,value:string,"
                          "date_signed:string,type:string>>")
    return (
        lines.join(customer_orders(spark, sf_dir), "l_orderkey").join(suppliers, "l_suppkey")
        .select(
            F.col("s_name").alias("source"),
            F.col("c_name").alias("target"),
            F.col("l_returnflag").alias("relationship"),
            F.when(F.col("l_linestatus") == "O", F.array(contract())).otherwise(none).alias(
                "contracts"
            ),
            F.col("o_orderpriority").alias("chain"),
            line_order().alias("ord"),
        )
    )


EDGES = f"""edges AS (
  SELECT s_name AS source, c_name AS target, l_returnflag AS relationship,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS n_contracts,
         CAST(l_orderkey AS VARCHAR) AS c_source, l_linestatus AS c_signal,
         CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS c_units,
         strftime(l_shipdate, '%Y-%m-%d') AS c_date,
         o_orderpriority AS chain, {SQL_ORD} AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


# Figures of a few parts hold a phrase of a built-in badge.
FIGURES = {1: "sold out", 2: "guidance raised", 3: "supply agreement", 4: "broke ground"}


def figure_of(part: Column) -> Column:
    figure = F.lit("no specific figure")
    for rest, phrase in FIGURES.items():
        figure = F.when(part % 997 == rest, phrase).otherwise(figure)
    return figure


def order_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as players of a chain that is their order.

    A line feeds the supplier of the next line of its order and the customer. Rows come
    together by ``chain``, and all that follows inside an order needs no other shuffle.
    """
    chain = lambda key: F.concat(F.lit("O"), F.lpad(F.col(key).cast("string"), 12, "0"))
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size"
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name"
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(
        customers, "o_custkey"
    ).select(chain("o_orderkey").alias("chain"), "o_orderkey", "c_name")
    # Keys beyond 12 digits share a chain; as a range this test is no further join key.
    own = F.col("l_orderkey").between(F.col("o_orderkey"), F.col("o_orderkey"))
    # An order is a document of its own size, so its lines may share a window.
    following = F.lead("s_name").over(
        Window.partitionBy("chain", "l_orderkey").orderBy(*LINE_ORDER)
    )
    contracts = F.when(F.col("l_linestatus") == "O", F.array(contract())).otherwise(
        F.filter(F.array(contract()), lambda c: F.lit(False))
    )
    stub = lambda company, contracts: F.struct(
        company.alias("company"), F.col("l_returnflag").alias("relationship"),
        contracts.alias("contracts"),
    )
    nothing = F.filter(F.array(contract()), lambda c: F.lit(False))
    return (
        lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")
        .withColumn("chain", chain("l_orderkey"))
        .join(orders.withColumnRenamed("chain", "_chain"), (F.col("chain") == F.col("_chain")) & own)
        .withColumn("_next", following)
        .select(
            "chain",
            kind_of(F.col("p_size")).alias("kind"),
            slug_of(F.col("p_size")).alias("slug"),
            F.col("p_type").alias("sector"),
            F.col("s_name").alias("company"),
            F.col("p_name").alias("product"),
            F.filter(
                F.array(stub(F.col("_next"), nothing), stub(F.col("c_name"), contracts)),
                lambda e: e["company"].isNotNull(),
            ).alias("connects_to"),
            F.array(
                F.struct(
                    F.date_format("l_shipdate", "'Q1 FY'yyyy (MM-dd-yyyy)").alias("quarter"),
                    F.col("p_name").alias("signal"),
                    figure_of(F.col("l_partkey")).alias("figure"),
                )
            ).alias("quarterly_data"),
            line_order().alias("ord"),
        )
    )


ORDER_PLAYERS = f"""order_players AS (
  SELECT 'O' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS chain,
         CASE WHEN p_size % 18 BETWEEN 13 AND 16 THEN 'domain' ELSE 'layer' END AS kind,
         {sql_list(SLUGS)}[p_size % 18 + 1] AS slug,
         p_size % 18 AS place, p_type AS sector, s_name AS company, p_name AS product,
         c_name AS customer, l_returnflag AS relationship,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS n_contracts,
         strftime(l_shipdate, 'Q1 FY%Y (%m-%d-%Y)') AS quarter, l_partkey % 997 AS figure,
         lead(s_name) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS following,
         {SQL_ORD} AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def order_documents(spark: SparkSession, sf_dir: str, kept: bool = False) -> DataFrame:
    """One nested chain document per order; ``kept`` for operators that read it repeatedly."""
    nested = renest_chains(order_players(spark, sf_dir), taxonomy(spark), bounded=True)
    documents = nested.withColumn("path", F.col("chain"))
    return cut(documents) if kept else documents


# --- all lines as links of companies ------------------------------------------------


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all lines: to the supplier of the order's next line and to the customer."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name"
    )
    following = F.lead("s_name").over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    ends = F.array(
        F.struct(F.col("following").alias("target"), F.lit(0).alias("e")),
        F.struct(F.col("c_name").alias("target"), F.lit(1).alias("e")),
    )
    return (
        lines.join(suppliers, "l_suppkey")
        .withColumn("following", following)
        .join(customer_orders(spark, sf_dir), "l_orderkey")
        .select(
            F.col("s_name").alias("source"), F.col("l_returnflag").alias("relationship"),
            F.col("o_orderpriority").alias("chain"), line_order().alias("line"), F.inline(ends),
        )
        .filter(F.col("target").isNotNull())
        .withColumn("ord", F.struct("line", "e"))
        .drop("line", "e")
    )


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame] | None:
    """``feeds`` by numbers, and ``(id, name)``: a row a line with ``source``, ``following``, ``customer``.

    Suppliers have their key as a number, customers one below zero; companies of one name share
    one. None where a key names no supplier, or two; lines then have to meet names first.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (-1 - F.col("c_custkey")).alias("id"), F.col("c_name").alias("name")
    )
    strange = lines.select(F.col("l_suppkey").alias("id")).distinct().join(
        suppliers.filter(F.col("name").isNotNull()), "id", "left_anti"
    )
    named = suppliers.unionByName(customers.select("id", "name"))
    odd = named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    below = suppliers.filter("id < 0").select("id").unionByName(customers.filter("id >= 0").select("id"))
    if not (strange.isEmpty() and odd.isEmpty() and below.isEmpty()):
        return None
    buyers = customers.select("o_custkey", F.col("id").alias("customer"))
    # Of companies of one name the supplier with the largest key stands for all.
    shared = named.groupBy("name").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter(
        F.col("name").isNotNull() & (F.col("n") > 1)
    )
    same = None
    if not shared.isEmpty():
        same = cut(named.join(shared, "name").filter(F.col("id") != F.col("first")).select("id", "first"))
        buyers = buyers.join(same.withColumnRenamed("id", "customer"), "customer", "left").select(
            "o_custkey", F.coalesce("first", "customer").alias("customer")
        )
        named = named.join(same, "id", "left_anti")
    # Lines alike in these columns have the same supplier.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        buyers, "o_custkey"
    ).select("l_orderkey", "customer")
    source = "l_suppkey"
    if same is not None:
        source = "own"
        lines = lines.join(same.withColumnRenamed("id", "l_suppkey"), "l_suppkey", "left").withColumn(
            source, F.coalesce("first", "l_suppkey")
        )
    steps = lines.withColumn("following", F.lead(source).over(order)).join(orders, "l_orderkey")
    return steps.select(F.col(source).alias("source"), "following", "customer"), named


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all lines from which the same companies are reached as over ``feeds``, in other hops.

    A line leads to the next one of its order and the last one to the customer, so the others
    reach the customer as well. Numbers stand for names until few links are left.
    """
    found = _steps(spark, sf_dir)
    if found is None:
        return thinned(feeds(spark, sf_dir).select("source", "target"))
    steps, named = found
    links = thinned(steps.select("source", F.coalesce("following", "customer").alias("target")))
    at = lambda end: named.select(F.col("id").alias(end), F.col("name").alias(f"_{end}"))
    return links.join(at("source"), "source").join(at("target"), "target").select(
        F.col("_source").alias("source"), F.col("_target").alias("target")
    )


def within_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seed, node, hops)``: what each supplier reaches over at most two of ``feeds``."""
    found = _steps(spark, sf_dir)
    if found is None:
        return downstream(feeds(spark, sf_dir), sellers(spark, sf_dir), 2)
    steps, named = found
    ends = F.array("following", "customer")
    return two_hops(steps.select("source", F.explode(ends).alias("target")), named)


FEEDS = f"""followed AS (
  SELECT *, lead(s_name) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS following
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
feeds AS (
  SELECT s_name AS source, CASE e WHEN 0 THEN following ELSE c_name END AS target,
         l_returnflag AS relationship, o_orderpriority AS chain, ({SQL_ORD}, e) AS ord
  FROM followed JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  CROSS JOIN (VALUES (0), (1)) v(e) WHERE e = 1 OR following IS NOT NULL)"""
LINKS = FEEDS + """,
links AS MATERIALIZED (SELECT DISTINCT source, target FROM feeds WHERE source <> target)"""
REACH = """reach AS (
  SELECT source AS seed, target AS node FROM links
  UNION
  SELECT r.seed, l.target FROM reach r JOIN links l ON r.node = l.source),
down AS MATERIALIZED (SELECT seed, node FROM reach WHERE seed <> node),
up AS (SELECT node AS seed, seed AS node FROM down)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers and customers."""
    return sellers(spark, sf_dir).unionByName(
        table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    )


COMPANIES = """companies AS (SELECT s_name AS id FROM supplier UNION ALL SELECT c_name FROM customer)"""


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"))


def reply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation leads to the next one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return turns.join(nexts, ["conv_id", "turn"]).select(
        name(F.col("turn")).alias("source"), name(F.col("turn") + 1).alias("target")
    )


REPLY_LINKS = """links AS (
  SELECT a.conv_id || ':' || a.turn AS source, b.conv_id || ':' || b.turn AS target
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


# --- documents as signals ----------------------------------------------------------


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as signals of suppliers, with labels of several shapes."""
    docs = table(spark, sf_dir, "documents")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = sup.agg(F.count(F.lit(1)).alias("n")).scalar()
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (doc * 37 % 1000).cast("int"))
    suffix = (
        F.when(doc % 11 == 0, "")
        .when(doc % 13 == 0, " (13-45-2025)")
        .otherwise(F.concat(F.lit(" ("), F.date_format(day, "MM-dd-yyyy"), F.lit(")")))
    )
    speaker = F.when(doc % 3 == 0, F.col("source")).otherwise(F.col("s_name"))
    quarter = F.concat(
        speaker, F.lit(" Q"), (doc % 4 + 1).cast("string"), F.lit(" FY"),
        (doc % 3 + 2023).cast("string"), suffix,
    )
    return docs.join(sup, F.col("s_suppkey") == doc % n).select(
        F.col("s_name").alias("company"),
        quarter.alias("quarter"),
        F.col("text").alias("signal"),
        F.col("source").alias("figure"),
        F.col("lang").alias("chain"),
        F.col("doc_id").alias("ord"),
    )


SIGNALS = r"""signals AS (
  SELECT s_name AS company,
         (CASE WHEN doc_id % 3 = 0 THEN source ELSE s_name END) || ' Q' || (doc_id % 4 + 1)
           || ' FY' || (doc_id % 3 + 2023)
           || CASE WHEN doc_id % 11 = 0 THEN ''
                   WHEN doc_id % 13 = 0 THEN ' (13-45-2025)'
                   ELSE ' (' || strftime(DATE '2023-01-01' + CAST(doc_id * 37 % 1000 AS INTEGER),
                                         '%m-%d-%Y') || ')' END AS quarter,
         text AS signal, source AS figure, lang AS chain, doc_id AS ord
  FROM documents JOIN supplier ON s_suppkey = doc_id % (SELECT count(*) FROM supplier)),
dated AS (
  SELECT *, CAST(try_strptime(nullif(regexp_extract(quarter, '\((\d{2}-\d{2}-\d{4})\)', 1), ''),
                              '%m-%d-%Y') AS DATE) AS day FROM signals)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as listed companies: nation and region give ticker and exchange."""
    sup = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey")
    )
    region = table(spark, sf_dir, "region")
    exchange = (
        F.when(F.col("r_name") == "AMERICA", "NYSE")
        .when(F.col("r_name") == "ASIA", "NASDAQ")
        .when(F.col("r_name") == "EUROPE", "XETRA")
        .otherwise(F.col("r_name"))
    )
    return sup.join(nation, "s_nationkey").join(region, "r_regionkey").select(
        F.col("s_name").alias("company"),
        F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("n_name")).alias("ticker"),
        exchange.alias("exchange"),
        F.when(F.col("s_acctbal") >= 500, F.col("n_name")).alias("country"),
        F.when(F.col("s_acctbal") < 0, "private").alias("status"),
    )


METADATA = """metadata AS (
  SELECT s_name AS company, CASE WHEN s_acctbal < 0 THEN '' ELSE n_name END AS ticker,
         CASE r_name WHEN 'AMERICA' THEN 'NYSE' WHEN 'ASIA' THEN 'NASDAQ'
                     WHEN 'EUROPE' THEN 'XETRA' ELSE r_name END AS exchange,
         CASE WHEN s_acctbal >= 500 THEN n_name END AS country,
         CASE WHEN s_acctbal < 0 THEN 'private' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --- orders as prices and calls ------------------------------------------------------


def _order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey")
    )
    customers = (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .join(table(spark, sf_dir, "region"), "r_regionkey")
        .select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "n_name", "r_name")
    )
    return table(spark, sf_dir, "orders").join(customers, "o_custkey")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per day of every nation and, as benchmarks, every region."""
    places = F.explode(F.array("n_name", "r_name")).alias("ticker")
    amount = F.col("o_totalprice").cast("decimal(15,2)").alias("amount")
    return (
        _order_places(spark, sf_dir)
        .select(F.col("o_orderdate").cast("date").alias("date"), places, amount)
        .groupBy("date", "ticker")
        .agg((F.sum("amount").cast("double") / F.count(F.lit(1))).alias("close"))
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as dated calls of their customer."""
    return (
        _order_places(spark, sf_dir)
        .select(
            F.col("c_name").alias("company"),
            F.col("n_name").alias("ticker"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("source_label"),
            F.col("o_orderkey").alias("ord"),
        )
    )


def calls_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of all orders."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date")
    )


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two market segments."""
    return table(spark, sf_dir, "customer").filter(
        F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE")
    ).select(F.col("c_name").alias("company"))


PRICES = """order_places AS (
  SELECT * FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
prices AS (
  SELECT CAST(o_orderdate AS DATE) AS date, ticker,
         CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS close
  FROM (SELECT o_orderdate, o_totalprice, n_name AS ticker FROM order_places
        UNION ALL SELECT o_orderdate, o_totalprice, r_name FROM order_places)
  GROUP BY 1, 2),
calendar AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM prices)),
closes AS (SELECT ticker, idx, close FROM prices JOIN calendar USING (date))"""
CALLS = """candidates AS (
  SELECT c_name AS company, n_name AS ticker, CAST(o_orderdate AS DATE) AS date,
         'order ' || o_orderkey AS source_label, o_orderkey AS ord
  FROM order_places),
calls AS (
  SELECT company, ticker, date, source_label,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'full_capacity' ELSE 'rest' END
           AS grp
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date
                                     ORDER BY length(company), ord) AS r FROM candidates)
  JOIN customer ON c_name = company WHERE r = 1)"""
RETURNS = """placed AS (
  SELECT c.company, c.ticker, c.date, c.grp,
         (SELECT max(idx) FROM calendar k WHERE k.date <= c.date) AS t0 FROM calls c),
measures AS (
  SELECT * FROM (VALUES ('jump', 0, 1), ('drift5', 1, 5), ('drift10', 1, 10), ('drift20', 1, 20))
    t(measure, start, days)),
included AS (
  SELECT * FROM placed WHERE t0 IS NOT NULL AND t0 + 1 <= (SELECT max(idx) FROM calendar)),
returns AS (
  SELECT p.company, p.ticker, p.date, p.grp, m.measure, m.days, p.t0 + m.start AS idx,
         b.close / a.close - 1 AS ret
  FROM included p CROSS JOIN measures m
  LEFT JOIN closes a ON a.ticker = p.ticker AND a.idx = p.t0 + m.start
  LEFT JOIN closes b ON b.ticker = p.ticker AND b.idx = p.t0 + m.start + m.days),
plain AS (
  SELECT r.company, r.ticker, r.date, r.grp, r.measure || '_vs_' || a.ticker AS metric,
         r.ret - (b.close / a.close - 1) AS value
  FROM returns r
  JOIN closes a ON a.idx = r.idx
   AND a.ticker IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')
  JOIN closes b ON b.ticker = a.ticker AND b.idx = r.idx + r.days
  WHERE r.ret IS NOT NULL),
universe AS (SELECT metric, avg(value) AS mean FROM plain GROUP BY metric),
vals AS (
  SELECT grp, metric, value FROM plain
  UNION ALL SELECT grp, metric || '_minus_univ', value - mean FROM plain JOIN universe USING (metric))"""


# --- customers as listed companies ---------------------------------------------------


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with ticker, freshness (last shipment) and returned lines as signals."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")
    )
    shipped = lines.join(orders, "l_orderkey").groupBy("c_custkey").agg(
        F.max(F.col("l_shipdate").cast("date")).alias("last_data"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_signals"),
    )
    return (
        table(spark, sf_dir, "customer").join(nation, "c_nationkey")
        .join(shipped, "c_custkey", "left")
        .select(
            F.col("c_name").alias("id"),
            F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("ticker"),
            "last_data",
            F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
        )
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order of each customer as its call, the earliest as a fallback."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").alias("_last"), F.min("o_orderdate").alias("_first")
    )
    return customers.join(spans, "c_custkey").select(
        F.col("c_name").alias("id"),
        F.when(F.col("c_mktsegment") != "BUILDING", epoch_seconds(F.col("_last"))).alias("ts"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", epoch_seconds(F.col("_first"))).alias("start"),
    )


COVERAGE = f"""customer_nodes AS (
  SELECT c_name AS id, CASE WHEN c_acctbal >= 0 THEN n_name END AS ticker, last_data,
         coalesce(n_signals, 0) AS n_signals
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, max(CAST(l_shipdate AS DATE)) AS last_data,
                    count(*) FILTER (WHERE l_returnflag = 'R') AS n_signals
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) s
    ON s.o_custkey = c_custkey),
earnings AS (
  SELECT c_name AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN epoch(max(o_orderdate)) END AS ts,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN epoch(min(o_orderdate)) END AS start
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name, c_mktsegment),
listed AS (
  SELECT n.*, CAST(nullif(coalesce(e.ts, e.start), 0) AS BIGINT) AS call_seconds
  FROM customer_nodes n LEFT JOIN earnings e USING (id) WHERE coalesce(n.ticker, '') <> ''),
queue AS (
  SELECT *, CASE WHEN call_seconds IS NULL THEN 'unknown' WHEN diff >= 0 THEN 'upcoming'
                 WHEN last_data >= DATE '1970-01-01' + CAST(floor(call_seconds / 86400) AS INTEGER)
                 THEN 'covered' ELSE 'due' END AS status,
         CASE WHEN call_seconds IS NULL THEN -1 ELSE abs(diff) END AS days,
         last_data IS NULL OR ({COVERAGE_NOW} - epoch(CAST(last_data AS TIMESTAMP))) / 86400.0 > 180
           AS stale
  FROM (SELECT *, floor((call_seconds - {COVERAGE_NOW}) / 86400.0 + 0.5) AS diff FROM listed))"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row per customer, as texts, from its orders."""
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
    )
    return table(spark, sf_dir, "customer").join(spans, "c_custkey", "left").select(
        F.col("c_name").alias("company"),
        F.col("n").cast("string").alias("revenue_growth"),
        F.col("c_mktsegment").alias("guidance"),
        F.col("open").cast("string").alias("backlog_or_b2b"),
        F.lit(None).cast("string").alias("supply_status"),
        F.when(F.col("open") > 3, "open orders").alias("next_catalyst"),
        F.date_format("last", "yyyy-MM-dd").alias("asof"),
    )


def metric_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of customers that ever ordered."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey"
    )
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct().join(
        customers, "o_custkey"
    )
    facet = lambda name, v: F.struct(name.alias("facet"), v.alias("value"))
    return rows.select(
        F.col("c_name").alias("id"),
        F.inline(
            F.array(
                facet(kind_of(F.col("c_nationkey")), slug_of(F.col("c_nationkey"))),
                facet(F.lit("sector"), F.col("c_mktsegment")),
                facet(F.lit("chain"), F.col("o_orderpriority")),
            )
        ),
    ).distinct()


SCREENER = f"""spans AS (
  SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY o_custkey),
metrics AS (
  SELECT c_name AS company, CAST(n AS VARCHAR) AS growth, c_mktsegment AS guidance,
         CAST(open AS VARCHAR) AS backlog, CAST(NULL AS VARCHAR) AS supply,
         CASE WHEN open > 3 THEN 'open orders' END AS catalyst, strftime(last, '%Y-%m-%d') AS "asof"
  FROM customer LEFT JOIN spans ON o_custkey = c_custkey),
metric_members AS (
  SELECT DISTINCT c_name AS id, facet, value FROM (
    SELECT c_name, CASE WHEN c_nationkey % 18 BETWEEN 13 AND 16 THEN 'domain' ELSE 'layer' END
             AS facet, {sql_list(SLUGS)}[c_nationkey % 18 + 1] AS value
    FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT c_name, 'sector', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT c_name, 'chain', o_orderpriority
    FROM orders JOIN customer ON o_custkey = c_custkey))"""


# --- events as price bars ------------------------------------------------------------

INTERVALS = {"click": "5m", "view": "30m", "purchase": "1d", "signup": "1wk", "error": "1d"}


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bars of their user; the event type stands for the interval."""
    table_of = F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.try_element_at(table_of, F.col("event_type")).alias("interval"),
        epoch_seconds(F.col("ts")).alias("ts"),
        F.col("value").alias("close"),
        "event_id",
    )


BARS = """bars AS (
  SELECT 'U' || user_id AS symbol,
         CASE event_type WHEN 'click' THEN '5m' WHEN 'view' THEN '30m' WHEN 'purchase' THEN '1d'
                         WHEN 'signup' THEN '1wk' WHEN 'error' THEN '1d' END AS interval,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts, value AS close FROM events)"""
