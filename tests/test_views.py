import datetime

import pytest
from pyspark.sql import functions as F

import samples
from tiergraph.functions import placement_rules as pr
from tiergraph.operators import classify, clean, coverage as cov, flatten, market, merge, screener
from tiergraph.operators import tables, transitions
from tiergraph.plans import jobs
from tiergraph.sources import dims, documents
from tiergraph.streaming import additions

NOW = 1_780_000_000


def test_coverage_statuses(spark):
    day = 86400
    calls = {"soon": NOW + 3 * day, "today": NOW - day // 3, "due": NOW - 5 * day, "covered": NOW - 5 * day,
             "zero": 0, "none": None, "half": NOW - int(2.5 * day)}
    nodes = spark.createDataFrame(
        [(n, "T", datetime.date(2026, 6, 30) if n == "covered" else None, 0) for n in calls]
        + [("unlisted", "", None, 1)], "id string, ticker string, last_data date, n_signals bigint")
    earn = spark.createDataFrame([(n, s, None) for n, s in calls.items()], "id string, ts bigint, start bigint")
    rows = jobs.coverage_queue(nodes, earn, NOW)
    got = {r.id: (r.status, r.days) for r in rows.collect()}
    assert got == {"soon": ("upcoming", 3), "today": ("upcoming", 0), "due": ("due", 5), "covered": ("covered", 5),
                   "zero": ("unknown", -1), "none": ("unknown", -1), "half": ("due", 2)}
    assert [r.id for r in rows.collect()] == ["half", "due", "today", "soon", "covered", "none", "zero"]
    c = cov.coverage_counts(rows).first()
    assert (c.due, c.upcoming, c.no_data) == (2, 2, 7)
    assert [r.id for r in cov.coverage_filter(rows, "due", " DU").collect()] == ["due"]
    assert cov.coverage_filter(rows, "stale").count() == 6
    assert [r.id for r in cov.coverage_sort(rows, "call", True).limit(2).collect()] == ["none", "zero"]


def test_screener_rules(spark):
    metrics = spark.createDataFrame(
        [("A", "10%", None, "2026"), ("B", None, "up", None), ("Ghost", "1%", "", "2025")],
        "company string, revenue_growth string, guidance string, asof string")
    for c in ("backlog_or_b2b", "supply_status", "next_catalyst"):
        metrics = metrics.withColumn(c, F.lit(None).cast("string"))
    nodes = spark.createDataFrame([("A", "AA"), ("B", "")], "id string, ticker string")
    members = spark.createDataFrame(
        [("A", "layer", "memory"), ("B", "domain", "power"), ("A", "sector", "HBM"), ("B", "chain", "c1")],
        "id string, facet string, value string")
    every = screener.screener_sort(screener.screener(metrics, nodes, members))
    assert [(r.company, r.ticker, r.guidance) for r in every.collect()] == [
        ("A", "AA", ""), ("Ghost", "—", ""), ("B", "—", "up")]
    named = lambda **k: [r.company for r in screener.screener(metrics, nodes, members, **k).collect()]
    assert named(group="power") == ["B"] and named(sector="HBM") == ["A"] and named(chain="zz") == []
    facets = [(r.facet, r.value, r.place) for r in
              screener.screener_facets(metrics, members, dims.taxonomy(spark)).collect()]
    assert facets == [("chain", "c1", None), ("group", "memory", 6), ("group", "power", 100), ("sector", "HBM", None)]


def test_price_ranges_and_quotes(spark):
    day = 86400
    rows = [("S", "1d", NOW - i * day, 10.0 + i) for i in range(3)] + [
        ("S", "1d", NOW - 40 * day, 5.0), ("S", "5m", NOW, 1.005), ("S", "1wk", NOW, float("nan")),
        ("S", "1wk", NOW - 9 * day, 2.345), ("S", "1wk", NOW - 2000 * day, 2.0)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, ts bigint, close double")
    points = market.price_ranges(bars, NOW, NOW - 30 * day)
    counts = {r["range"]: r["count"] for r in points.groupBy("range").count().collect()}
    assert counts == {"1M": 3, "YTD": 3, "1Y": 4, "All": 2}
    assert points.filter("range = 'All'").agg(F.max("close")).first()[0] == 2.35
    q = market.quote_snapshot(bars.filter("interval = '1d'").select("symbol", "ts", "close"), NOW).first()
    assert (q.price, q.change_pct, q.year_high, q.year_low) == (10.0, -9.09, 12.0, 5.0)


def test_companies_share_a_symbol(spark):
    companies = spark.createDataFrame([("A", "005930", None), ("B", "005930", "KRX"), ("C", "", None)],
                                      "id string, ticker string, exchange string")
    feed = spark.createDataFrame([("005930.KS", 7)], "symbol string, v int")
    assert sorted((r.id, r.v) for r in market.symbol_fanout(companies, feed).collect()) == [("A", 7), ("B", 7)]


def test_transitions(spark):
    members = spark.createDataFrame(
        [("Keep", "chain", "old"), ("Keep", "chain", "new1"), ("Win", "chain", "new2"), ("Win", "chain", "new1"),
         ("Lose", "chain", "old"), ("Off", "chain", "else")], "id string, facet string, value string")
    roles = spark.createDataFrame(
        [("Keep", "old", "P1", 1), ("Keep", "old", "P1", 2), ("Keep", "old", "P0", 3), ("Keep", "new1", "P2", 4),
         ("Win", "new2", "W2", 6), ("Win", "new1", "W1", 5), ("Lose", "old", "", 7)],
        "company string, chain string, product string, ord int")
    cat = dims.transitions(spark, [("t", ("old",), ("new1", "new2")), ("empty", ("x",), ("y",))])
    got = {r.id: (r.status, r.product_from, r.product_to, r.to_chains, r.product_changed)
           for r in transitions.transition(members, roles, cat).collect()}
    assert got == {"Keep": ("retained", "P1 · P0", "P2", ["new1"], True),
                   "Win": ("gained", None, "W1 · W2", ["new1", "new2"], False),
                   "Lose": ("lost", None, None, [], False)}
    rows = transitions.side_products(roles, cat).filter("id = 'Keep' and side = 'from'")
    assert [r["product"] for r in rows.orderBy("ord").collect()] == ["P1", "P0"]
    counts = {r.transition: (r.retained, r.gained, r.lost) for r in transitions.transition_counts(
        transitions.transition_status(members, cat), cat).collect()}
    assert counts == {"t": (1, 1, 1), "empty": (0, 0, 0)}


def test_products_that_differ_in_the_tail_only(spark):
    members = spark.createDataFrame([("A", "chain", c) for c in ("o", "n")], "id string, facet string, value string")
    roles = spark.createDataFrame(
        [("A", "o", f"P{i}", i) for i in range(4)] + [("A", "n", f"P{i}", 10 + i) for i in range(2)],
        "company string, chain string, product string, ord int")
    cat = dims.transitions(spark, [("t", ("o",), ("n",))])
    groups = spark.createDataFrame([("A", "power")], "id string, primary string")
    row = transitions.transition(members, roles, cat, groups, dims.taxonomy(spark)).first()
    assert row.product_changed and (row.product_from, row.product_to) == ("P0 · P1 · P2 · P3", "P0 · P1")
    assert (row.primary, row.group_place >= 100) == ("power", True)


@pytest.mark.parametrize("tier,company,product,want", [
    ("ai_lab", "Cursor", "editor", ("application", "AI-Native Vertical Apps", True)),
    ("hyperscaler", "Oracle", "cloud", ("cloud_infra", "Hyperscaler Cloud", False)),
    ("hyperscaler", "CoreWeave", "cloud", ("cloud_infra", "Neocloud (GPU-specialized)", False)),
    ("power", "X", "organic things", ("power", "Power Semiconductors", False)),
    ("component", "X", "organic polymer multimode", ("compute_hardware", "(unclassified)", True)),
    ("switch_system", "Nidec", "multimode parts", ("thermal", "TIM", False)),
    ("component", "AMD", "EPYC CPU with GPU", ("compute_hardware", "Server CPU", False)),
    ("component", "AMD", "cpu plus gpu", ("compute_hardware", "Training GPU", False)),
    ("oem", "Broadcom", "custom XPU", ("compute_hardware", "Custom AI ASIC (hyperscaler silicon)", False)),
    ("oem", "NVIDIA", "accelerator", ("compute_hardware", "Training GPU", False)),
    ("oem", "Vertiv", "anything", ("power", "Datacenter Power", False)),
    ("oem", "Quanta", "rack systems with thermal", ("system_integration", "Server ODM", False)),
    ("raw_material", "Asetek", "immersion fluid", ("thermal", "Immersion", False)),
    ("raw_material", "X", "novec coolant", ("thermal", "Coolants & Fluids", False)),
    ("raw_material", "X", "Ni powder", ("materials", "Passive Component Materials", True)),
    ("epiwafer", "X", "GaN foundry", ("foundry", "Compound Semi Foundry (GaN/SiC/InP)", False)),
    ("packaging", "X", "NVMe SSD", ("memory", "NAND Flash", False)),
    ("packaging", "X", "NVMe SSD controller", ("advanced_packaging", "Wafer-Level Packaging (CoWoS, SoIC)", True)),
    ("equipment", "Aixtron", None, ("equipment", "Compound Semi Equipment", False)),
    (None, "X", "HBM", ("compute_hardware", "Networking ASIC", True)),
])
def test_placement(spark, tier, company, product, want):
    df = spark.createDataFrame([(tier, company, product)], "tier string, company string, product string")
    r = classify.classify_players(df).first()
    assert (r.slug, r.sector, r.flagged) == want


def test_second_placement_adds_a_stub_and_keeps_every_player(spark):
    doc = {"flow": [{"tier": "oem", "players": [
        samples.player("MediaTek", "CPO ASIC", [("X", "r", ["c"])], [("q", "s", "f")]),
        samples.player("Dell", "servers")]}, {"tier": "gone", "players": [samples.player("Y")]}]}
    df = spark.createDataFrame([("c", "p")], "chain string, path string").join(
        spark.read.schema("flow array<struct<tier:string,players:array<struct<company:string,product:string,"
                          "connects_to:array<struct<company:string,relationship:string,contracts:array<struct<"
                          "source:string,signal:string,units:string,value:string,date_signed:string,type:string>>>>,"
                          "quarterly_data:array<struct<quarter:string,signal:string,figure:string>>>>>>").json(
            spark.sparkContext.parallelize([__import__("json").dumps(doc)])))
    before = classify.explode_tier_players(df)
    after = classify.add_stubs(classify.classify_players(before))
    rows = {(r.company, r.stub): r for r in after.collect()}
    assert len(rows) == 4 and rows[("MediaTek", True)].sector == "Networking ASIC"
    assert rows[("MediaTek", True)].connects_to == [] and len(rows[("MediaTek", False)].connects_to) == 1
    check = classify.preservation_check(before, after)
    classify.require_preserved(check)
    with pytest.raises(ValueError):
        classify.require_preserved(classify.preservation_check(before, after.filter("company <> 'Dell'")))
    review = classify.review_table(after).collect()
    assert review[0].company == "Y" and review[0].note == "unknown old tier 'gone'"
    assert "MediaTek (also)" in {r.company for r in review}
    assert len(pr.RULES) < 200


def test_rules_are_tried_once_for_equal_players_and_read_them_once(spark):
    rows = [("A", "oem", "mediatek", "CPO ASIC", 1), ("A", "oem", "MediaTek", "CPO asic", 2),
            ("B", None, None, None, 3), ("B", "oem", None, "servers", 4), ("B", None, None, None, 5)]
    players = spark.createDataFrame(rows, "chain string, tier string, company string, product string, ord int")
    bare = classify.schemas.PLAYER
    for name in ("connects_to", "quarterly_data"):
        players = players.withColumn(name, F.array().cast(bare[name].dataType))
    both = classify.add_stubs(classify.classify_players(players))
    assert sorted((r.ord.player, r.ord.stub) for r in both.collect()) == [
        (1, False), (1, True), (2, False), (2, True), (3, False), (4, False), (5, False)]
    assert {r.note for r in both.filter("ord.player in (3, 5)").collect()} == {"unknown old tier 'None'"}
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "Contains" not in plan and "Union" not in plan and plan.count("LogicalRDD") == 1


def test_renames_grow_when_repeated_unless_word_safe(spark):
    df = spark.createDataFrame([("Amkor", "Amkor and Google Cloud"), ("Amkor Technology", None)],
                               "company string, signal string")
    twice = clean.rename_entities(clean.rename_entities(df, ["company"], ["signal"]), ["company"], ["signal"])
    assert [r.company for r in twice.collect()] == ["Amkor Technology"] * 2
    assert twice.first().signal == "Amkor Technology Technology and Google"
    safe = lambda d: clean.rename_entities(d, (), ["signal"], word_safe=True)
    assert safe(safe(df)).first().signal == "Amkor Technology and Google"


def test_renames_and_labels_inside_documents(spark, tmp_path):
    chains = documents.read_chains(spark, samples.write_chains(str(tmp_path)))
    renamed = clean.rename_chains(chains, {"Fab": "Fabric", "sold": "SOLD"})
    players = flatten.explode_players(renamed)
    assert {r.company for r in players.collect()} >= {"Fabric"}
    assert "Fabric" in {r.target for r in flatten.explode_edges(players).collect()}
    assert "SOLD" in {r.signal for r in flatten.explode_signals(players).collect()}
    fixed = clean.normalise_chain_labels(chains, {"Micro Q1 FY2026 (05-01-2026)": "new"})
    labels = {r.quarter for r in flatten.explode_signals(flatten.explode_players(fixed)).collect()}
    assert labels == {"new", None}


def test_vocabulary_check(spark, tmp_path):
    players = flatten.explode_players(documents.read_chains(spark, samples.write_chains(str(tmp_path))))
    bad = clean.vocabulary_check(players, dims.taxonomy(spark))
    assert [(r.slug, r.n) for r in bad.collect()] == [("odd_slug", 1)]


def facts(spark, rows):
    return spark.createDataFrame(rows, "company string, quarter string, signal string, figure string, ord int")


def test_merging_only_adds_and_repeats_are_ignored(spark):
    base = facts(spark, [("A", "q", "s", "old", 1), ("A", None, "t", "x", 2)])
    new = facts(spark, [("A", "q", "s", "changed", 3), ("A", None, "t", "y", 4), ("B", None, "t", "first", 5),
                        ("B", None, "t", "later", 6)])
    keys = ["company", "quarter", "signal"]
    once = merge.merge_additions(base, new, keys, "ord")
    assert sorted(r.figure for r in once.collect()) == ["first", "old", "x"]
    again = merge.merge_additions(once, new, keys, "ord")
    assert again.count() == 3 and merge.lost_rows(base, again).count() == 0


def test_contracts_are_appended_once(spark, tmp_path):
    chains = documents.read_chains(spark, samples.write_chains(str(tmp_path)))
    stated = flatten.explode_contracts(flatten.explode_edges(flatten.explode_players(chains)))
    base = stated.filter("contract.signal <> 'b'")
    merged = merge.merge_contracts(base, stated)
    assert sorted(r.contract.signal for r in merged.collect()) == ["a", "b", "c"]
    assert merge.merge_contracts(merged, stated).count() == 3


def test_latest_row_replaces(spark):
    kind = "company string, v int, asof string"
    old = spark.createDataFrame([("A", 1, "2026-01"), ("B", 1, "2026-05"), ("C", 1, None)], kind)
    new = spark.createDataFrame([("A", 2, "2026-02"), ("B", 2, "2026-04"), ("C", 2, None)], kind)
    got = {r.company: r.v for r in merge.replace_latest(old, new, ["company"], "asof").collect()}
    assert got == {"A": 2, "B": 1, "C": 2}


def test_segment_totals(spark):
    seg = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 1.0)], "k string, value double")
    tot = spark.createDataFrame([("A", 3.0), ("B", 2.0), ("C", 1.0)], "k string, total double")
    got = {r.k: r.consistent for r in merge.segment_totals_check(seg, tot, "k").collect()}
    assert got == {"A": True, "B": False, "C": False}


def test_stream_adds_each_key_once_and_reruns_safely(spark, tmp_path):
    schema = "company string, quarter string, signal string, figure string, ord int"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    keys = ["company", "quarter", "signal"]

    def run():
        stream = additions.signal_stream(spark, source, facts(spark, []).schema, "json")
        additions.stream_additions(additions.distinct_additions(stream, keys), target, state, keys,
                                   "ord").awaitTermination()
        return sorted((r.company, r.signal) for r in additions.stored_additions(spark, target).collect())

    facts(spark, [("A", "q", "s", "1", 1), ("A", "q", "s", "2", 2)]).write.json(source)
    assert run() == [("A", "s")]
    facts(spark, [("A", "q", "s", "3", 3), ("B", "q", "s", "4", 4)]).write.mode("append").json(source)
    assert run() == [("A", "s"), ("B", "s")]
    additions.add_batch(facts(spark, [("B", "q", "s", "4", 4), ("A", "q", "s", "3", 3)]), 1, target, keys, "ord")
    assert sorted(r.company for r in additions.stored_additions(spark, target).collect()) == ["A", "B"]
    assert schema


def test_timelines_and_bars(spark):
    kind = ("id string, category string, tables array<struct<title:string,columns:array<string>,"
            "rows:array<array<string>>>>")
    t = spark.createDataFrame([
        ("hbm", "memory", [("t", ["a", "b"], [["1", "2", "3"], ["4"]])]), ("zzz", None, []), ("cpo", "optical", []),
        ("aaa", "odd", [])], kind)
    cells = [(r.row_no, r.col_no, r.column, r.value) for r in tables.tidy_timelines(t).collect()]
    assert sorted(cells) == [(0, 0, "a", "1"), (0, 1, "b", "2"), (0, 2, None, "3"), (1, 0, "a", "4")]
    ordered = tables.timeline_order(t)
    assert [r.id for r in ordered.collect()] == ["cpo", "hbm", "aaa", "zzz"]
    assert [r.category for r in tables.timelines_by_category(ordered).collect()] == [
        "optical", "memory", "odd", "other"]
    bars = spark.createDataFrame([("x", 3.0), ("x", 1.0), ("y", 2.0)], "block string, busd double")
    assert sorted(r.fraction for r in tables.bar_fraction(bars).collect()) == [0.3333, 1.0, 1.0]


def test_dossiers_have_every_section(spark, tmp_path):
    chains = documents.read_chains(spark, samples.write_chains(str(tmp_path)))
    meta = spark.createDataFrame([], "company string, ticker string, exchange string, country string, status string")
    g = jobs.build_graph(chains, meta)
    parts = jobs.dossiers(g, g.nodes, dims.transitions(spark, [("t", ("b_beta",), ("a_alpha",))]))
    assert set(parts) == {"overview", "badges", "products", "exposure", "timeline", "signals", "customers", "suppliers"}
    assert {r.id: r.status for r in parts["exposure"].collect()}["Micro"] == "retained"
    assert parts["signals"].filter("company = 'Micro'").count() == 2
