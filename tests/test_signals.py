import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tiergraph.functions.automata import Automaton
from tiergraph.functions import automata, display, fixed_values as fixed, labels, market
from tiergraph.functions import text as tx
from tiergraph.operators import components, signals
from tiergraph.operators.facts import _Facts, linked_rows

SCHEMA = "company string, quarter string, signal string, figure string, chain string, ord int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def said(texts, company="A"):
    return [(company, None, t, None, "c", i) for i, t in enumerate(texts)]


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_label_dates(spark):
    day = lambda s: one(spark, labels.label_date, s)
    assert day("A Q1 (05-28-2026) x (01-01-2020)") == datetime.date(2026, 5, 28)
    assert day("A (13-45-2025)") is None and day("A Q1") is None and day(None) is None
    key = lambda s: one(spark, labels.label_date_key, s)
    assert key("(05-28-2026)") == 20260528 and key("none") == -1


def test_staleness_is_fractional(spark):
    stale = lambda d, now: one(
        spark, lambda v: labels.is_stale(v.cast("date"), F.lit(now).cast("timestamp_ntz")), d)
    assert not stale("2026-01-01", "2026-06-30 00:00:00")
    assert stale("2026-01-01", "2026-06-30 00:00:01")
    assert stale(None, "2026-06-30 00:00:00")


@pytest.mark.parametrize("company,label,want", [
    ("Google", "Google Q1 FY2026 (04-29-2026)", True),
    ("Google", "Lumentum Q3 FY2026 (05-05-2026)", False),
    ("Intel Foundry", "Intel Q1 FY2026", True), ("Intel", "intel foundry Q1", True),
    ("Any", " Q1 FY2026", True), ("Any", "Any keynote 2026", False), ("Any", "AnyQ1", False),
])
def test_own_call(spark, company, label, want):
    df = spark.createDataFrame([(company, label)], "c string, l string")
    assert df.select(labels.own_call(F.col("c"), F.col("l"))).first()[0] is want


@pytest.mark.parametrize("text,mention,key", [
    ("ramps in Q3 2026 and 2027", "Q3 2026", 20266), ("in H2 2026", "H2 2026", 20268),
    ("in h2 2026", "h2 2026", 20268), ("in h1 2026", "h1 2026", 20262), ("in 1H 2027", "1H 2027", 20274),
    ("early 2027", "early 2027", 20272), ("Mid 2027 it", "Mid 2027", 20275),
    ("by end of 2026", "end of 2026", 20268), ("FY2026 guide", "FY2026", 20260),
    ("exiting CY 2026", "exiting CY 2026", 20268), ("x20261", None, None), ("é2026 soon", "2026", 20260),
    ("nothing", None, None),
])
def test_periods(spark, text, mention, key):
    df = spark.createDataFrame([(text,)], "t string").select(
        labels.period_mention(F.col("t")).alias("m"))
    r = df.select("m", F.when(F.col("m").isNotNull(), labels.period_key(F.col("m"))).alias("k")).first()
    assert (r.m, r.k) == (mention, key)


def test_sentences_and_tokens(spark):
    text = "Short. " + "x" * 25 + ";  " + "y" * 241 + ". " + "\U0001F600" * 13 + "."
    got = one(spark, tx.sentences, text)
    assert got == ["x" * 25 + ";", "\U0001F600" * 13 + "."]
    assert one(spark, tx.token_set, "The é50% of 3.5x the; ab abc") == ["the", "50%", "3.5x", "abc"]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "x array<string>, y array<string>, z array<string>")
    r = df.select(tx.jaccard(F.col("x"), F.col("y")), tx.jaccard(F.col("z"), F.col("z"))).first()
    assert r[0] == pytest.approx(1 / 3) and r[1] == 0.0


def test_badges_of_single_and_joined_signals(spark):
    rows = said(["demand will", "exceed supply"]) + said(["we raised our full-year guidance", "SCA signed"], "B")
    got = {r.company: r.badges for r in signals.signal_badges(table(spark, rows)).collect()}
    assert got == {"A": [], "B": ["guideup", "lta"]}
    joined = {r.company: r.badges for r in signals.node_badges(table(spark, rows)).collect()}
    assert joined == {"A": ["tight"], "B": ["guideup", "lta"]}


def test_seams_equal_the_whole_text(spark):
    rng = random.Random(11)
    words = ["sold", "out", "raising", "the", "guide", "capacity", "tight", "x" * 40, "", "; end."]
    rules = (("a", r"sold {1,4}out"), ("b", r"raising\s[^.;]{0,12}guide"), ("c", r"capacity.{0,6}tight"),
             ("d", r"\btight {1,3}sold\b"), ("e", r"raising.{0,500}tight.*guide"), ("f", r"tight.*sold.*x{30,}.*end"),
             ("g", r"end\. +$"), ("h", r"(guide|out)\b\s+[^a-z ]{1,3}"))
    rows = []
    for company in range(60):
        n = rng.choice([1, 3, 30, 200])
        rows += said([" ".join(rng.choices(words, k=rng.randrange(3))) for _ in range(n)], f"C{company}")
    whole = {}
    for company, _, text, _, _, _ in rows:
        whole.setdefault(company, []).append(text + " ")
    want = {c: [k for k, p in rules if re.search(p, " ".join(t), re.I)] for c, t in whole.items()}
    got = signals.node_badges(table(spark, rows).repartition(5), rules)
    assert {r.company: r.badges for r in got.collect()} == want
    single = {r.company: set(r.badges) for r in signals.signal_badges(table(spark, rows), rules).collect()}
    assert all(single[c] - {"g"} <= set(want[c]) for c in want)


def test_long_texts_are_looked_ahead_in():
    prose = " ".join(random.Random(3).choices(["lorem", "ipsum", "src", "dolor", "at\n"], k=20_000))
    machine = Automaton(r"src1 [\s\S]*src2 [\s\S]*src3 ")
    read = []
    step = machine._step
    machine._step = lambda number, c: read.append(c) or step(number, c)

    class Counted(str):
        def __getitem__(self, at):
            read.append(at)
            return str.__getitem__(self, at)

    classed = machine._classed
    machine._classed = lambda text: Counted(classed(text))
    whole = machine.summary(f"{prose} src1 {prose} src2 {prose}")
    assert len(read) < len(prose) / 10
    assert whole.alive and whole.then(machine.summary("src3 a")).tail_found
    assert not machine.summary(prose).then(machine.summary("src3 a")).tail_found


def test_last_and_recent(spark):
    rows = [("A", q, f"s{i}", "", "c", i) for i, q in enumerate(
        ["(01-01-2026)", None, "(03-01-2026)", "(03-01-2026)", "(13-01-2026)"])]
    df = table(spark, rows)
    assert str(signals.last_data(df).first().last_data) == "2026-03-01"
    assert [r.signal for r in signals.recent_signals(df, 4).orderBy("rank").collect()] == ["s2", "s3", "s0", "s1"]


def replay(sentences):
    """Plain reading of the merge rule over (text, when, year, tokens) in order."""
    kept = []
    for text, when, year, tokens in sentences:
        at = next((i for i, k in enumerate(kept) if k[2] == year and
                   len(k[3] & tokens) / len(k[3] | tokens) >= fixed.DUPLICATE_SIMILARITY), None)
        if at is None:
            kept.append((text, when, year, tokens))
        elif len(text) > len(kept[at][0]):
            kept[at] = (text, when, year, tokens)
    return kept


def test_timeline_replays_the_order_dependent_merge(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(9)]
    rows, want = [], {}
    for company in ("A", "B", "C"):
        items = []
        for i in range(120):
            pick = rng.sample(words, rng.randrange(4, 8))
            when = rng.choice(["Q1 2026", "Q3 2026", "2027", "early 2028"])
            text = f"{' '.join(pick)} in {when} now."
            rows.append((company, None, text, None, "c", i))
            tokens = {w for w in re.sub(r"[^a-z0-9%. ]", " ", text.lower()).split() if len(w) > 2}
            items.append((text, when, re.search(r"20\d\d", text).group(), tokens))
        key = {"Q1 2026": 20262, "Q3 2026": 20266, "2027": 20270, "early 2028": 20282}
        kept = sorted(replay(items), key=lambda k: key[k[1]])[:10]
        want[company] = [(k[1], k[0]) for k in kept]
    got = {}
    for r in signals.company_timeline(table(spark, rows)).orderBy("company", "rank").collect():
        got.setdefault(r.company, []).append((r.when, r.text))
    assert got == want


def test_longer_wording_replaces_in_place():
    facts = _Facts(0.6)
    short, long = frozenset("abc"), frozenset("abcd")
    facts.add({"text": "s", "units": 3, "place": 1}, short)
    facts.add({"text": "other", "units": 5, "place": 2}, frozenset("xyz"))
    facts.add({"text": "long", "units": 9, "place": 3}, long)
    assert [(k["text"], k["place"]) for k in facts.kept] == [("long", 1), ("other", 2)]


def test_display(spark):
    df = spark.createDataFrame([("5 units", "no specific figure", "not stated", "deal"), (None, "", "", None)],
                               "u string, v string, d string, k string")
    cols = [F.col(c) for c in "uvdk"]
    assert [r[0] for r in df.select(display.contract_summary(*cols)).collect()] == ["5 units · deal", ""]
    figures = spark.createDataFrame([("",), ("no specific figure",), ("$3B",)], "f string")
    assert [r[0] for r in figures.select(display.figure_or_null(F.col("f"))).collect()] == [None, None, "$3B"]
    shares = spark.createDataFrame([(-0.09405,), (0.14181,), (None,), (-0.0001,), (0.0225,)], "x double")
    assert [r[0] for r in shares.select(display.pct(F.col("x"))).collect()] == [
        "-9.4%", "+14.2%", "—", "-0.0%", "+2.2%"]


@pytest.mark.parametrize("ticker,exchange,want", [
    ("", "NYSE", None), (None, None, None), ("BESI", "AMS", "BESI.AS"), ("2330.TW", "TWSE", "2330.TW"),
    ("000660", "KRX", "000660.KS"), ("005930", None, "005930.KS"), ("247540", "KOSDAQ", "247540.KQ"),
    ("MU", "NASDAQ", "MU"), (" AIR ", "Euronext Paris", "AIR.PA"),
])
def test_symbols(spark, ticker, exchange, want):
    df = spark.createDataFrame([(ticker, exchange)], "t string, e string")
    assert df.select(market.market_symbol(F.col("t"), F.col("e"))).first()[0] == want


def test_automata_equal_whole_texts():
    rng = random.Random(4)
    patterns = [p for _, p in fixed.BADGE_RULES] + [
        r"aaa.{0,500}bbb", r"a.*b", r"\bab\b", r"a\s+b", r"[^a ]{3}", r"(ab|ba){2,}", r"b$", r"a\B", r"\d\W", r"x?a{2}\b.b"]
    words = ["a", "b", "ab", "aaa", "bbb", "", " ", "\n", "1", "A", ".", "sold", "out", "raised", "to", "capacity", "é",
             "tight", "raising", "the guide", "LTA", "multi", "year supply", "SCA", "demand", "exceed"]
    for pattern in patterns:
        machine = automata.Automaton(pattern)
        for _ in range(150):
            pieces = ["".join(rng.choices(words, k=rng.randrange(4))) for _ in range(rng.randrange(1, 7))]
            parts = [machine.summary(p) for p in pieces]
            # The end is the very end, also where the text ends with a line feed.
            want = bool(re.search(pattern.replace("$", r"\Z"), " ".join(pieces), re.I | re.A))
            while len(parts) > 1:  # in any grouping
                k = rng.randrange(len(parts) - 1)
                parts[k : k + 2] = [automata.Summary.load(parts[k].then(parts[k + 1]).dump())]
            assert parts[0].tail_found == want, (pattern, pieces)
    for pattern in (r"^a", r"(a)\1", r"(?=a)b"):
        with pytest.raises(ValueError):
            automata.Automaton(pattern)


def test_components_of_wordings(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = components.connected(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.wording: r.component for r in got.collect()} == root
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_company_is_replayed_in_many_parts(spark):
    rows = [("A", None, f"item{i // 3} ships part{i // 3} in Q1 2026 by hand.", None, "c", i) for i in range(300)]
    told = signals.dated_sentences(table(spark, rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    try:
        facts = signals.merged_facts(told).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(facts) == 100 and len({r.p for r in facts}) > 1


def test_timeline_links_small_groups_in_a_task_and_large_ones_by_token(spark):
    rng = random.Random(5)
    rows = []
    for company, n in (("A", 90), ("B", 40), (None, 25)):
        for i in range(n):
            pick = rng.sample([f"word{k}" for k in range(12)], rng.randrange(4, 9))
            rows.append((company, None, f"{' '.join(pick)} in {rng.choice([2026, 2027])} now.", None, "c", i))
    told = signals.dated_sentences(table(spark, rows))
    of = lambda **kw: sorted(map(repr, signals.merged_facts(told, **kw).collect()))
    whole = of()
    assert of(most_rows=30) == whole and of(most_rows=1) == whole


def test_linked_rows_are_components_of_alike_wordings():
    rng = random.Random(6)
    sets = [frozenset(rng.sample("abcdefghijkl", rng.randrange(1, 8))) for _ in range(60)] + [frozenset()] * 2
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a == b or len(a & b) / len(a | b) >= 0.6:
                    root[i] = root[j] = min(root[i], root[j])
    want = [r if root.count(r) > 1 else None for r in root]
    assert linked_rows([" ".join(s) for s in sets], 0.6) == want


def test_a_sentence_alike_to_no_other_is_not_shuffled_again(spark):
    rows = [("A", None, f"item{i} ships part{i} to site{i} in Q1 2026.", None, "c", i) for i in range(40)]
    rows += [("A", None, "one line ships twice in Q1 2026.", None, "c", 40 + i) for i in range(2)]
    facts = signals.merged_facts(signals.dated_sentences(table(spark, rows)))
    assert facts.count() == 41
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(component" in plan and plan.count("RepartitionByExpression") == 1
