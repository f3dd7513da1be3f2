"""Steps that must not move or keep more than they need."""

import os
import random

import pytest
from pyspark.sql import functions as F

import compare
import samples
from tiergraph.operators import flatten, graph, listing, ordering, reach
from tiergraph.plans import projections as pj
from tiergraph.plans.queries import REGISTRY
from tiergraph.session import cut
from tiergraph.sources import dims, documents

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def exchanges(df) -> list[str]:
    """Shuffles of the plan by their partitioning."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@needs_tables
def test_documents_of_orders_shuffle_every_line_once_by_its_chain(spark):
    docs = pj.order_documents(spark, SF_DIR)
    edges = flatten.explode_edges(flatten.explode_players(docs))
    counted = edges.groupBy("chain", "source", "target").agg(F.count(F.lit(1)).alias("n"))
    assert len(exchanges(counted)) == len(exchanges(pj.order_players(spark, SF_DIR)))
    rows = listing.chain_listing(docs, dims.taxonomy(spark), bounded=True)
    assert len(exchanges(listing.role_edges(rows, bounded=True))) == len(exchanges(docs))


@needs_tables
def test_whole_documents_are_listed_like_parts(spark):
    docs = pj.order_documents(spark, SF_DIR, kept=True)
    columns = ["chain", "kind", "slug", "sector", "sub_sector", "header", "label", "company", "row", "col"]
    known = dims.taxonomy(spark)
    one, two = listing.chain_listing(docs, known, bounded=True), listing.chain_listing(docs, known)
    a, b = one.select(*columns), two.select(*columns)
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    a, b = (listing.role_edges(x, bounded=x is one).drop("ord") for x in (one, two))
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_whole_listing_of_odd_documents(spark, tmp_path):
    chains = documents.read_chains(spark, samples.write_chains(str(tmp_path)))
    known = dims.taxonomy(spark)
    drop = lambda df: df.drop("ord", "connects_to").select(sorted(df.drop("ord", "connects_to").columns))
    a, b = drop(listing.chain_listing(chains, known, bounded=True)), drop(listing.chain_listing(chains, known))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_cut_tables_are_compressed_and_sized(spark):
    rows = spark.range(200_000).select(F.lit("the same words again and again").alias("text"), "id")
    kept = cut(rows)
    assert kept.schema == rows.schema or kept.columns == rows.columns
    size = kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 2_000_000 and kept.count() == 200_000


def test_reach_over_components_keeps_pairs_in_place(spark):
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "b")]
    edges = spark.createDataFrame([*ring, ("c", "t"), ("t", "u"), ("s", "a"), ("x", "y")], "source string, target string")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    seeds, nodes = ids("a", "b", "s", "u", "lone"), ids(*"abcstuxy", "lone")
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    down, up = reach.downstream(edges, seeds), reach.upstream(edges, seeds)
    assert rows(reach.reached(edges, seeds), "seed", "node") == rows(down, "seed", "node")
    assert rows(reach.reached(edges, seeds, up=True), "seed", "node") == rows(up, "seed", "node")
    want = rows(reach.ripple(nodes, down, up, seeds), "seed", "node", "status")
    got = reach.ripple_pairs(edges, nodes, seeds)
    assert rows(got, "seed", "node", "status") == want and len(want) > 15
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [seed" not in plan


@needs_tables
def test_isolated_nodes_are_sought_among_companies_and_orders(spark, tmp_path):
    name = pj.table(spark, SF_DIR, "customer").select("c_name").first()[0]
    for table in ("supplier", "orders", "lineitem"):
        pj.table(spark, SF_DIR, table).write.parquet(f"{tmp_path}/{table}.parquet")
    alone = pj.table(spark, SF_DIR, "customer")
    more = alone.limit(1).withColumn("c_custkey", F.lit(-1).cast(alone.schema["c_custkey"].dataType))
    alone.unionByName(more.withColumn("c_name", F.lit("Nobody"))).write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.id for r in REGISTRY["isolated_nodes"].run(spark, str(tmp_path)).collect()}
    assert "Nobody" in found and name not in found


@needs_tables
def test_lines_are_not_joined_with_customers(spark):
    for rows in (pj.edges(spark, SF_DIR), pj.feeds(spark, SF_DIR)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(plan) if "Join Inner, (o_custkey" in line)
        depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
        below = []
        for line in plan[at + 1 :]:
            if len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            below.append(line)
        assert below and not any("l_linenumber" in line for line in below)


@needs_tables
def test_first_groups_are_read_off_players_at_once(spark):
    players = pj.players(spark, SF_DIR)
    extra = spark.createDataFrame(
        [("A", "c", "domain", "power", "", 2), ("A", "c", "layer", None, "s", 1), ("A", "c", "layer", "memory", "t", 3),
         ("B", "c", "other", "x", None, 1)],
        "company string, chain string, kind string, slug string, sector string, ord long",
    )
    for rows in (players, extra):
        members = graph.memberships(rows)
        sector = members.filter("facet = 'sector'").groupBy("id").agg(F.min_by("value", "ord").alias("sector"))
        want = graph.primary_group(members, "none").join(sector, "id", "left")
        got = graph.first_groups(rows, "none")
        assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = graph.first_groups(players, "none")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


@needs_tables
def test_linked_places_count_placed_edges(spark):
    players, edges = pj.players(spark, SF_DIR), pj.feeds(spark, SF_DIR)
    places = listing.listed_groups(graph.first_groups(players, "other"), dims.taxonomy(spark))
    columns = ["source", "target", "from_col", "from_row", "to_col", "to_row"]
    want = listing.placed_edges(edges, places).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    got = listing.linked_places(edges, places)
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def nodes_of(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes_of(plan.children().apply(i))


def test_players_carry_no_copy_of_their_sector(spark, tmp_path):
    chains = documents.read_chains(spark, samples.write_chains(str(tmp_path)))
    players = flatten.explode_players(chains)
    found = [n for n in nodes_of(players._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Generate"]
    carried = [n.requiredChildOutput() for n in found]
    types = {c.apply(i).dataType().typeName() for c in carried for i in range(c.size())}
    assert len(found) == 3 and types and not types & {"struct", "array"}


@needs_tables
def test_players_are_read_once_to_be_cut_into_parts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ordering, "cut", lambda df: kept.append(df) or cut(df))
    players = pj.players(spark, SF_DIR).withColumns(
        {c: F.array().cast("array<string>") for c in ("connects_to", "quarterly_data")}
    )
    flatten.renest_chains(players, dims.taxonomy(spark), 100)
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") > 0 and plan.count("Relation [l_orderkey") == 1


def test_parts_follow_the_nested_order_over_many_ranges(spark):
    slugs = [("layer", "memory"), ("layer", "odd"), ("layer", "older"), ("domain", "power"), ("layer", None), (None, "x")]
    rows = []
    for i in range(4000):
        # One sector holds most rows of a chain, so it goes through several ranges.
        kind, slug = slugs[(i * 7) % 11 % 6] if i % 3 == 0 else slugs[0]
        rows.append(("big" if i % 5 else None, kind, slug, None if i % 9 == 0 else f"s{i % 3 and i % 4}", (i * 1237) % 4001))
    schema = "chain string, kind string, slug string, sector string, ord long"
    players = spark.createDataFrame(rows, schema).repartition(7).withColumns(
        {"company": F.col("ord").cast("string"), "product": F.lit("p"), "connects_to": F.array().cast("array<string>"),
         "quarterly_data": F.array().cast("array<string>")}
    )
    places = {(r.kind, r.slug): r.place for r in dims.taxonomy(spark).collect()}
    first = lambda n: {k: min(r[4] for r in rows if r[:n] == k) for k in {r[:n] for r in rows}}
    slug_at, sector_at, want = first(3), first(4), {}
    for chain in ("big", None):
        group = lambda r: (r[1] != "layer", places.get((r[1], r[2]), 999), slug_at[r[:3]], sector_at[r[:4]], r[4])
        for at, r in enumerate(sorted((r for r in rows if r[0] == chain), key=group)):
            want[chain, r[4]] = (at, at // 30, at > 0 and at % 30 == 0 and r[4] != sector_at[r[:4]])
    got = flatten._parts(players, dims.taxonomy(spark), 30).collect()
    assert len(got) == len(rows) == len(want)
    assert {(r.chain, int(r.company)): (r._at, r.part, r._continues) for r in got} == want


def altered(folder, **tables):
    """The smallest tables in ``folder``; those named are written anew by the given SQL."""
    con = compare.database(SF_DIR)
    for table in compare.TABLES:
        if table in tables:
            con.execute(f"COPY ({tables[table]}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF_DIR}/{table}.parquet", f"{folder}/{table}.parquet")
    return compare.database(str(folder))


@needs_tables
def test_node_view_reads_every_statement_and_lists_a_company_once(spark, tmp_path):
    """Two parts of one name state one signal with two figures; a name is registered twice."""
    line = "FROM (FROM lineitem WHERE l_partkey > 4 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1)"
    con = altered(
        tmp_path,
        part=f"SELECT * FROM part UNION ALL SELECT * REPLACE (997004 AS p_partkey) FROM part "
             f"WHERE p_partkey = (SELECT l_partkey {line})",
        lineitem=f"SELECT * FROM lineitem WHERE l_partkey <> 4 UNION ALL (SELECT * REPLACE (997004 AS l_partkey, 99 AS l_linenumber) {line})",
        supplier="SELECT * FROM supplier UNION ALL SELECT * REPLACE (999999 AS s_suppkey, -1 AS s_acctbal) "
                 "FROM supplier WHERE s_suppkey = 1",
    )
    outcome = compare.compare(spark, con, str(tmp_path), "enrich_graph", REGISTRY["enrich_graph"])
    assert outcome.startswith("ok"), outcome


@needs_tables
def test_review_lists_every_placement_in_its_order(spark):
    rows = sorted(REGISTRY["review_table"].run(spark, SF_DIR).collect(), key=lambda r: r.position)
    lines = pj.table(spark, SF_DIR, "lineitem").count()
    stubs = sum(r.company.endswith(" (also)") for r in rows)
    assert stubs > 0 and len(rows) == lines + stubs
    assert [r.position for r in rows] == list(range(len(rows)))
    assert [(not r.flagged, r.chain) for r in rows] == sorted((not r.flagged, r.chain) for r in rows)


def test_thinned_links_reach_the_same(spark):
    for n, m, seed in ((40, 30, 1), (40, 70, 2), (60, 400, 3), (9, 0, 4)):
        rng = random.Random(seed)
        rows = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("n1", None), (None, "n2")]
        links = spark.createDataFrame(rows, "source string, target string").repartition(3)
        thin = reach.thinned(links, 50)
        ids = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
        pairs = lambda df: {tuple(r) for r in reach.downstream(df, ids).select("seed", "node").collect()}
        assert pairs(thin) == pairs(links) and thin.count() <= len(set(rows))
    assert reach.thinned(links.filter("source = 'none'")).isEmpty()
    ring = spark.range(2000).select(F.col("id").alias("source"), ((F.col("id") * 7 + 1) % 2000).alias("target"))
    many = ring.unionByName(ring.select("target", "source").toDF("source", "target"))
    assert reach.thinned(many).count() < many.distinct().count()


@needs_tables
@pytest.mark.parametrize("lost", ["l_suppkey = 1", "l_suppkey IS NULL", None])
def test_ways_reach_what_feeds_reach(spark, tmp_path, lost):
    """Also over lines of unknown suppliers, names of two keys and orders of unknown customers."""
    gone = "true" if lost == "l_suppkey IS NULL" else "s_suppkey <> 1" if lost else "true"
    lines = "SELECT * REPLACE (CASE WHEN l_suppkey = 2 THEN NULL ELSE l_suppkey END AS l_suppkey) FROM lineitem"
    altered(
        tmp_path,
        lineitem=f"{lines if lost == 'l_suppkey IS NULL' else 'SELECT * FROM lineitem'} WHERE l_orderkey % 150 = 0",
        supplier=f"SELECT * REPLACE (CASE s_suppkey WHEN 3 THEN 'Supplier#000000004' ELSE s_name END AS s_name) "
                 f"FROM supplier WHERE {gone}",
        customer="SELECT * FROM customer WHERE c_custkey % 7 > 0",
    )
    folder = str(tmp_path)
    ids = pj.companies(spark, folder).distinct()
    pairs = lambda df: {tuple(r) for r in reach.downstream(df, ids).select("seed", "node").collect()}
    ways = pj.ways(spark, folder)
    assert pairs(ways) == pairs(pj.feeds(spark, folder)) and pairs(ways)
    if lost is None:
        # Names come last, so lines move by keys alone.
        assert ways.count() < reach.distinct_links(pj.feeds(spark, folder)).count()


def test_two_hops_over_numbers(spark):
    rng = random.Random(5)
    # More than one group of sources, a hub, loops, repeats and ends that lead nowhere.
    rows = [(rng.randrange(1400), rng.choice([rng.randrange(1400), -1 - rng.randrange(50)])) for _ in range(4000)]
    rows += [(7, n) for n in range(0, 1400, 3)] + [(8, 8), (8, 7), (8, 7)]
    links = spark.createDataFrame(rows, "source long, target long").repartition(5)
    named = spark.createDataFrame([(n, f"n{n}") for n in range(-50, 1400)], "id long, name string")
    name = lambda end: F.concat(F.lit("n"), F.col(end).cast("string")).alias(end)
    seeds = named.filter("id >= 0").select(F.col("name").alias("id"))
    want = reach.downstream(links.select(name("source"), name("target")), seeds, 2)
    got = reach.two_hops(links, named)
    assert got.count() > 5000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@needs_tables
def test_two_hops_move_links_once_and_by_numbers(spark):
    plan = REGISTRY["downstream_hops"].run(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    below = [b for a, b in zip(lines, lines[2:]) if "RepartitionByExpression [slot" in a]
    # Nothing but the test for loops, so that the shuffle is one and the same wherever it is read.
    assert len(below) > 1 and all("Filter" in b and ">= 0" not in b for b in below)
    assert not any("Filter" in line and "l_quantity" in line for line in lines)


@needs_tables
def test_names_of_two_keys_are_one_company(spark, tmp_path):
    con = altered(
        tmp_path,
        lineitem="SELECT * FROM lineitem WHERE l_orderkey % 100 = 0",
        supplier="SELECT * REPLACE (CASE s_suppkey WHEN 3 THEN 'Supplier#000000004' ELSE s_name END AS s_name) FROM supplier",
        customer="SELECT * REPLACE (CASE c_custkey % 9 WHEN 1 THEN 'Supplier#000000005' WHEN 2 THEN 'Twin' ELSE c_name END "
                 "AS c_name) FROM customer",
    )
    outcome = compare.compare(spark, con, str(tmp_path), "downstream_hops", REGISTRY["downstream_hops"])
    assert outcome.startswith("ok"), outcome
