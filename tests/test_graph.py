import dataclasses
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import samples
from tiergraph.operators import components, flatten, graph, listing, reach
from tiergraph.plans import jobs
from tiergraph.sources import dims, documents, schemas, sinks


@pytest.fixture(scope="module")
def chains(spark, tmp_path_factory):
    path = samples.write_chains(str(tmp_path_factory.mktemp("chains")))
    return documents.read_chains(spark, path)


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(
        [("Micro", "MU", "NASDAQ", "US", None), ("Fab", "", "", "", "private")],
        "company string, ticker string, exchange string, country string, status string")


@pytest.fixture(scope="module")
def g(chains, meta):
    return jobs.build_graph(chains.repartition(3), meta)


def lists(g):
    out = {}
    for r in graph.ordered_memberships(g.memberships).orderBy("place").collect():
        out.setdefault((r.id, r.facet), []).append(r.value)
    return out


def test_walk_takes_sub_sectors_first_and_full_path_order(chains):
    walk = [(r.chain, r.company, r.sub_sector) for r in
            flatten.explode_players(chains).orderBy("ord").collect()]
    assert walk == [
        ("b_beta", "Cloud", None), ("b_beta", "Micro", None), ("b_beta", "Hynix", None),
        ("a_alpha", "Hynix", "Stacks"), ("a_alpha", "Micro", None), ("a_alpha", "Nameless", None),
        ("a_alpha", "Fab", None), ("a_alpha", "Oddity", None), ("a_alpha", "Volt", None),
    ]


def test_merge_keeps_first_seen_order_and_drops_blank_sectors(g):
    got = lists(g)
    assert got[("Micro", "sector")] == ["DRAM", "HBM"]
    assert got[("Micro", "chain")] == ["b_beta", "a_alpha"]
    assert got[("Volt", "domain")] == ["power"]
    assert ("Nameless", "sector") not in got


def test_signals_dedupe_with_null_labels_and_keep_the_first_chain(g):
    got = {(r.quarter, r.signal): (r.figure, r.chain) for r in g.signals.collect()}
    assert got == {
        ("Micro Q1 FY2026 (05-01-2026)", "sold"): ("second", "b_beta"),
        (None, "out of"): ("range", "b_beta"),
    }


def test_edges_skip_self_loops_and_keep_parallel_ones(g):
    got = sorted((r.source, r.target, r.relationship) for r in g.edges.collect())
    assert ("Micro", "Micro", "self") not in got
    assert [e for e in got if e[:2] == ("Hynix", "Fab")] == [
        ("Hynix", "Fab", "dies"), ("Hynix", "Fab", "stacks")]
    degrees = {r.id: r.degree for r in graph.degree(g.edges).collect()}
    assert degrees["Fab"] == 6 and degrees["Hynix"] == 2


def test_metadata_and_gaps(g):
    nodes = {r.id: r for r in g.nodes.collect()}
    assert nodes["Micro"].status == "public" and nodes["Fab"].status == "private"
    assert nodes["Volt"].ticker is None
    assert "Micro" not in {r.id for r in graph.metadata_gaps(g.nodes).collect()}


def test_hubs_and_summary(g):
    assert [r.id for r in graph.hubs(g.memberships).collect()] == ["Micro", "Hynix"]
    counts = {r.measure: r.n for r in graph.graph_summary(g.nodes, g.edges, g.edges.limit(0)).collect()}
    assert counts == {"nodes": 7, "edges": 7, "visible_links": 0}


def test_counterparties_merge_parallel_edges(g):
    r = graph.counterparties(g.edges, "out").filter("id = 'Hynix'").first()
    assert (r.other, r.relationship, r.n_contracts, r.n_edges) == ("Fab", "stacks", 2, 2)
    suppliers = graph.supplier_split(graph.counterparties(g.edges, "in"), 1).filter("id = 'Fab'")
    assert sorted((r.other, r.rank) for r in suppliers.collect()) == [("Hynix", None), ("Micro", 1)]


def test_counterparty_contracts_follow_the_edges(spark):
    deal = lambda *s: [(x, None, None, None, None, None) for x in s]
    shape = ("source string, target string, ord int, contracts array<struct<source:string,signal:string,"
             "units:string,value:string,date_signed:string,type:string>>")
    e = spark.createDataFrame(
        [("a", "b", 3, deal("z", "y")), ("a", "b", 1, deal("k")), ("a", "c", 2, []), ("d", "b", 0, None)], shape)
    got = graph.counterparty_contracts(e, "out").orderBy("position").collect()
    assert [(r.id, r.other, r.position, r.contract.source) for r in got] == [
        ("a", "b", 0, "k"), ("a", "b", 1, "z"), ("a", "b", 2, "y")]
    assert {(r.id, r.other) for r in graph.counterparty_contracts(e, "in").collect()} == {("b", "a")}


def test_edges_of_the_merged_listing(spark, g):
    rows = listing.group_listing(g.nodes, g.memberships, dims.taxonomy(spark), roles=g.roles, signals=g.signals)
    micro = rows.filter("label = 'Micro' and not is_header").first()
    assert micro.n_signals == 2 and micro.product is not None
    placed = listing.placed_edges(g.edges, rows).filter("source = 'Micro'").first()
    assert (placed.from_col, placed.from_row) == (micro.col, micro.row)
    assert "Stranger" not in {r.target for r in listing.placed_edges(g.edges, rows).collect()}


def test_broken_isolated_and_external(g, chains):
    assert [r.target for r in graph.broken_edges(g.edges, g.nodes).collect()] == ["Stranger"]
    assert {r.id for r in graph.isolated_nodes(g.nodes, g.edges).collect()} == {"Nameless", "Oddity"}
    loop = g.edges.select("source", "target").union(
        g.edges.sparkSession.createDataFrame([("Oddity", "Oddity")], "source string, target string"))
    assert {r.id for r in graph.isolated_nodes(g.nodes, loop).collect()} == {"Nameless"}
    ext = graph.external_targets(g.edges, flatten.explode_players(chains)).orderBy("number")
    assert [(r.chain, r.target, r.number) for r in ext.collect()] == [
        ("a_alpha", "Cloud", 0), ("a_alpha", "Stranger", 1)]


def test_visibility(g):
    see = lambda c, l, d: {
        r.id for r in graph.visible_nodes(g.nodes, g.memberships, c, l, d).collect()}
    assert see(["a_alpha"], ["memory"], ["power"]) == {"Hynix", "Micro", "Nameless", "Volt"}
    assert see([], ["memory"], []) == set()
    free = g.memberships.filter("facet <> 'chain'")
    ids = graph.visible_nodes(g.nodes, free, [], ["foundry"], [])
    assert {r.id for r in ids.collect()} == {"Fab"}


def test_view_of_nodes_and_links(spark, g):
    reports = spark.createDataFrame([("Fab",)], "node string")
    views = jobs.enrich_graph(g, dims.taxonomy(spark), dims.chain_colors(spark), reports,
                              "2026-12-01 00:00:00")
    nodes = {r.id: r for r in views["nodes"].collect()}
    assert nodes["Fab"].has_report and nodes["Fab"].size == 14 and nodes["Volt"].size == 4
    assert nodes["Volt"].primary == "power" and nodes["Oddity"].group_color == "#94a3b8"
    assert nodes["Micro"].stale and str(nodes["Micro"].last_data) == "2026-05-01"
    assert {r.color for r in views["links"].collect()} == {"#8b949e"}
    assert views["adjacency"].count() == 2 * g.edges.count()


def test_nesting_is_the_inverse_of_the_walk_whole_and_in_parts(spark, chains, tmp_path):
    flat = flatten.explode_players(chains).filter("sector <> ''")
    facts = lambda df: sorted(
        (r.chain, r.kind, r.slug, r.sector, r.company, r.product, len(r.connects_to))
        for r in df.collect())
    for size in (100, 2):
        docs = flatten.renest_chains(flat, dims.taxonomy(spark), size)
        assert docs.selectExpr("max(part)").first()[0] == (0 if size == 100 else 2)
        path = str(tmp_path / f"nested{size}")
        sinks.write_chains(docs, path)
        back = documents.read_chains(spark, path)
        assert facts(flatten.explode_players(back)) == facts(flat)
        walk = [r.slug for r in flatten.explode_players(back).filter("chain = 'a_alpha'").orderBy("ord").collect()]
        assert walk == ["memory", "memory", "foundry", "odd_slug", "power"]


def test_listing_counts_headers_and_takes_the_last_group_of_a_slug(spark, chains):
    rows = listing.chain_listing(chains, dims.taxonomy(spark))
    at = lambda chain: [
        (r.col, r.row, r.company if r.label is None else r.label) for r in
        rows.filter(F.col("chain") == chain).orderBy("col", "row").collect()]
    assert at("b_beta") == [(0, 0, "Cloud"), (0, 1, "Cloud"), (1, 0, "HBM"), (1, 1, "Hynix")]
    assert at("a_alpha")[:6] == [(0, 0, "HBM"), (0, 1, "Stacks"), (0, 2, "Hynix"), (0, 3, "Micro"),
                                 (0, 4, ""), (0, 5, "Nameless")]
    assert [x for x in at("a_alpha") if x[0] == 2] == [(2, 0, "Odd"), (2, 1, "Oddity")]


def test_listing_of_parts_equals_the_whole(spark, chains):
    flat = flatten.explode_players(chains).filter("sector <> ''").drop("sub_sector")
    shown = []
    for size in (100, 1):
        docs = flatten.renest_chains(flat, dims.taxonomy(spark), size).withColumn("path", F.col("chain"))
        rows = listing.chain_listing(docs, dims.taxonomy(spark))
        shown.append(sorted((r.chain, r.col, r.row, r.label or r.company) for r in rows.collect()))
    assert shown[0] == shown[1]


def test_role_edges_reach_first_places_and_externals(spark, chains):
    rows = listing.chain_listing(chains, dims.taxonomy(spark))
    got = {(r.source, r.target, r.relationship): (r.from_col, r.from_row, r.to_col, r.to_row, r.external)
           for r in listing.role_edges(rows).filter("chain = 'a_alpha'").collect()}
    assert got[("Hynix", "Fab", "stacks")] == (0, 2, 1, 1, False)
    assert got[("Fab", "Cloud", "wafers")] == (1, 1, 4, 0, True)
    assert got[("Fab", "Stranger", "wafers")] == (1, 1, 4, 1, True)


def test_group_listing_orders_by_sector_then_name(spark, g):
    rows = listing.group_listing(g.nodes, g.memberships, dims.taxonomy(spark))
    memory = [(r.row, r.label, r.is_header) for r in
              rows.filter("slug = 'memory'").orderBy("row").collect()]
    assert memory == [(0, "Nameless", False), (1, "DRAM", True), (2, "Micro", False),
                      (3, "HBM", True), (4, "Hynix", False)]
    assert rows.filter("slug = 'odd_slug'").count() == 0


def test_graph_survives_writing(spark, g, tmp_path):
    sinks.write_graph(g, str(tmp_path / "g"))
    back = sinks.read_graph(spark, str(tmp_path / "g"))
    assert back.edges.count() == g.edges.count() and back.nodes.count() == g.nodes.count()
    assert back.edges.filter("chain = 'b_beta'").count() == 1


def test_chain_ids_of_digits_stay_texts(spark, g, tmp_path):
    many = g.edges.limit(1).withColumn("chain", F.explode(F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: F.lpad(i.cast("string"), 4, "0"))))
    sinks.write_graph(dataclasses.replace(g, edges=many), str(tmp_path / "g"))
    back = sinks.read_graph(spark, str(tmp_path / "g")).edges
    assert back.columns == many.columns and back.schema["chain"].dataType.typeName() == "string"
    assert back.filter("chain = '0007'").count() == 1 and back.select("chain").distinct().count() == 1200


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_reach_on_a_cycle_with_a_tail(spark, monkeypatch):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a"), ("x", "a"), ("a", "b")])
    nodes = ids(spark, "abcdx")
    for limit in (100_000, 0):
        monkeypatch.setattr(reach, "BROADCAST_FRONTIER", limit)
        down = reach.downstream(e, ids(spark, ["a", "d"]))
        assert sorted(map(tuple, down.collect())) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert sorted(r.node for r in reach.upstream(e, ids(spark, ["d"])).collect()) == ["a", "b", "c", "x"]
    assert sorted(r.node for r in reach.downstream(e, ids(spark, ["a"]), 2).collect()) == ["b", "c"]
    counts = {r.id: (r.downstream, r.upstream) for r in reach.reach_counts(e, nodes).collect()}
    assert counts == {"a": (3, 3), "b": (3, 3), "c": (3, 3), "d": (0, 4), "x": (4, 0)}


def closure(pairs, hops=None):
    """Everything each node reaches, with its distance."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for seed in {x for p in pairs for x in p}:
        seen, front, d = {seed: 0}, {seed}, 0
        while front and (hops is None or d < hops):
            d += 1
            front = {b for a in front for b in after.get(a, ())} - set(seen)
            seen |= {n: d for n in front}
        out[seed] = seen
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 90, 110), (2, 50, 130)])
def test_reach_of_random_graphs(spark, seed, n, m):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
    pairs += [(f"chain{i}", f"chain{i + 1}") for i in range(4)] + [("n1", "chain0"), ("hub", "hub")]
    e = edges(spark, pairs)
    names = sorted({x for p in pairs for x in p}) + ["alone"]
    want = closure(pairs) | {"alone": {"alone": 0}}
    down = reach.downstream(e, ids(spark, names))
    assert {tuple(x) for x in down.collect()} == {
        (s, t, d) for s, to in want.items() for t, d in to.items() if d}
    near = {(s, t) for s, to in want.items() for t, d in to.items() if 0 < d <= 3}
    assert {(x.seed, x.node) for x in reach.downstream(e, ids(spark, names), 3).collect()} == near
    above = Counter(t for s, to in want.items() for t in to if s != t)
    for block in (65_536, 64):
        got = reach.reach_counts(e, ids(spark, names), block_seeds=block).collect()
        assert {x.id: (x.downstream, x.upstream) for x in got} == {s: (len(want[s]) - 1, above[s]) for s in names}
    got = reach.reach_counts(e, ids(spark, names), max_hops=3).collect()
    assert {x.id: x.downstream for x in got} == Counter(s for s, _ in near) | {s: 0 for s in names if s not in dict(near)}
    links = reach.distinct_links(e)
    found = components.strong_components(links, ids(spark, names)).collect()
    assert {x.id: x.component for x in found} == {
        s: min(t for t in want[s] if s in want[t]) for s in names}


def test_ends_with_equal_predecessors_are_one_goal(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "a")] + [("a", f"end{i}") for i in range(150)] + [(f"start{i}", "b") for i in range(150)]
    passes = []
    spread = reach.propagate
    monkeypatch.setattr(reach, "propagate", lambda *a: passes.append(1) or spread(*a))
    names = sorted({x for p in pairs for x in p})
    got = reach.reach_counts(edges(spark, pairs), ids(spark, names), block_seeds=64).collect()
    want = {"a": (151, 151), "b": (151, 151)}
    want |= {f"end{i}": (0, 152) for i in range(150)} | {f"start{i}": (152, 0) for i in range(150)}
    assert {r.id: (r.downstream, r.upstream) for r in got} == want
    assert len(passes) == 2


def test_reach_without_edges_or_seeds(spark):
    e, none = edges(spark, [("a", "b")]), ids(spark, [])
    assert reach.downstream(e, none).count() == 0 and reach.reach_counts(e, none).count() == 0
    got = reach.reach_counts(edges(spark, []), ids(spark, ["a"])).collect()
    assert [tuple(r) for r in got] == [("a", 0, 0)]


def test_ripple_prefers_down(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("z", "a"), ("b", "d"), ("q", "r")])
    nodes, seed = ids(spark, "abdzqr"), ids(spark, ["a"])
    down, up = reach.downstream(e, seed), reach.upstream(e, seed)
    status = {r.id: r.status for r in
              reach.ripple_for(nodes, reach.ripple(nodes, down, up, seed), "a").collect()}
    assert status == {"a": "self", "b": "down", "d": "down", "z": "up", "q": "unrelated", "r": "unrelated"}
    ways = {(r.source, r.target): r.status for r in reach.ripple_edges(e, down, up, seed).collect()}
    assert ways == {("a", "b"): "down", ("b", "d"): "down", ("b", "a"): "up", ("z", "a"): "up"}


def test_neighbours_and_edges_between(spark, g):
    near = reach.neighbours(g.edges, ids(spark, ["Fab"]))
    assert {(r.node, r.side) for r in near.collect()} == {
        ("Fab", "self"), ("Cloud", "out"), ("Stranger", "out"), ("Hynix", "in"), ("Micro", "in"), ("Volt", "in")}
    assert reach.touching_edges(g.edges, ids(spark, ["Fab"])).count() == 6
    both = graph.edges_between(g.edges, "Fab", "Hynix")
    assert [r.way for r in both.collect()] == [1, 1]


def test_empty_metadata_schema(spark):
    assert schemas.METADATA.fieldNames() == ["ticker", "exchange", "country", "status"]


def test_players_meet_before_they_become_a_row_per_facet(spark):
    players = spark.createDataFrame([("A", 1, "layer", "memory", "s", "c")], "company string, ord int, kind string, slug string, sector string, chain string")
    plan = graph.memberships(players)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Generate") < plan.index("RebalancePartitions [company")
