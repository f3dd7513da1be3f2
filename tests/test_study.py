import csv
import datetime
import os

import pytest
from pyspark.sql import functions as F

from tiergraph.functions.stats import t_test_p
from tiergraph.operators import calls as call_ops
from tiergraph.operators import eventstudy as es
from tiergraph.operators import merge
from tiergraph.plans import jobs
from tiergraph.sources import publication, sinks

DAY = datetime.date


def test_published_statistics(spark, fixtures):
    values = spark.read.csv(os.path.join(fixtures, "abnormal_returns.csv"), header=True,
                            schema="`group` string, metric string, value double")
    both = values.unionByName(es.excess_over_universe(values).select(*values.columns))
    got = {(r["group"], r.metric): r for r in es.group_stats(both).collect()}
    with open(os.path.join(fixtures, "expected_stats.csv"), encoding="utf-8") as f:
        want = list(csv.DictReader(f))
    assert len(got) == len(want) == 48
    for w in want:
        r = got[(w["group"], w["metric"])]
        assert r.n == int(w["n"]) and r.hit_rate == float(w["hit_rate"])
        assert r["mean"] == pytest.approx(float(w["mean"]), abs=2e-5)
        assert r["median"] == pytest.approx(float(w["median"]), abs=2e-5)
        assert r.p_value == pytest.approx(float(w["p_value"]), abs=5e-4)
    report = es.study_report(es.group_stats(both)).filter(
        "benchmark = 'SOXX' and window = '+20d' and `group` = 'full_capacity'").first()
    assert (report.n, report["mean"], report["median"], report.hit_rate) == (15, "-9.4%", "-13.2%", "13%")


@pytest.mark.parametrize("t,df,p", [
    (2.262, 9, 0.05), (12.706, 1, 0.05), (4.303, 2, 0.05), (2.042, 30, 0.05), (1.984, 100, 0.05),
    (2.576, 100_000, 0.01), (1.96, 10_000_000, 0.05), (0.0, 7, 1.0),
])
def test_student_quantiles(spark, t, df, p):
    row = spark.createDataFrame([(df + 1, t, (df + 1) ** 0.5)], "n bigint, m double, s double")
    got = row.select(t_test_p(F.col("n"), F.col("m"), F.col("s"))).first()[0]
    assert got == pytest.approx(p, abs=2e-4)


def test_tail_formulas_meet(spark):
    rows = [(n, t, float(n) ** 0.5) for n in (400, 401, 402, 403) for t in (0.3, 1.0, 2.5, 4.0)]
    df = spark.createDataFrame(rows, "n bigint, m double, s double")
    got = {}
    for r in df.withColumn("p", t_test_p(F.col("n"), F.col("m"), F.col("s"))).collect():
        got.setdefault(r.m, []).append(r.p)
    assert all(max(ps) - min(ps) < 2e-5 for ps in got.values())


def test_degenerate_groups(spark):
    values = spark.createDataFrame(
        [("a", "m", 1.0), ("b", "m", 2.0), ("b", "m", 2.0), ("c", "m", 0.0), ("c", "m", 0.0)],
        "`group` string, metric string, value double")
    got = {r["group"]: r.p_value for r in es.group_stats(values).collect()}
    assert got == {"a": None, "b": 0.0, "c": None}


def prices(spark, closes):
    rows = [(DAY(2026, 1, 5) + datetime.timedelta(days=d + 2 * (d // 5)), t, c)
            for t, cs in closes.items() for d, c in enumerate(cs)]
    return spark.createDataFrame(rows, "date date, ticker string, close double")


@pytest.fixture(scope="module")
def study(spark):
    n = 12
    closes = {
        "AA": [10.0 + i for i in range(n)],
        "GAP": [10.0 if i != 3 else None for i in range(n)],
        "IDX": [100.0 if i != 7 else None for i in range(n)],
        "NONE": [None] * n,
    }
    calls = [
        ("Alpha", "AA", DAY(2026, 1, 5)), ("Alpha", "AA", DAY(2026, 1, 5)),
        ("Weekend", "AA", DAY(2026, 1, 10)), ("Early", "AA", DAY(2026, 1, 4)),
        ("Late", "AA", DAY(2026, 3, 1)), ("Gap", "GAP", DAY(2026, 1, 5)),
        ("Unpriced", "NONE", DAY(2026, 1, 5)), ("Absent", "ZZ", DAY(2026, 1, 5)),
    ]
    calls = spark.createDataFrame(calls, "company string, ticker string, date date")
    flags = spark.createDataFrame([("Alpha",), ("Gap",)], "company string")
    return jobs.event_study(calls, flags, prices(spark, closes), ("IDX",), (2, 6))


def test_exclusions(study):
    got = {r.reason: r.n for r in study.excluded.collect()}
    assert got == {"no price data": 2, "call before price history": 1, "no entry day yet": 1,
                   "+2d window not complete yet": 1}


def test_values_need_the_benchmark_but_membership_does_not(study):
    members = {(r.window, r.company) for r in study.members.collect()}
    assert members == {(2, "Alpha"), (2, "Weekend"), (6, "Alpha"), (6, "Weekend"),
                       (6, "Gap")}
    assert study.members.filter("window = 6 and company = 'Alpha'").count() == 2
    plain = {(r.company, r.metric): r.value for r in study.values.collect() if "univ" not in r.metric}
    # Alpha enters at position 1; the index has no close at position 7.
    assert ("Alpha", "drift6_vs_IDX") not in plain and ("Gap", "drift6_vs_IDX") not in plain
    assert plain[("Alpha", "drift2_vs_IDX")] == pytest.approx(13 / 11 - 1)
    assert plain[("Alpha", "jump_vs_IDX")] == pytest.approx(0.1)
    # The weekend call counts from Friday, position 4.
    assert plain[("Weekend", "jump_vs_IDX")] == pytest.approx(1 / 14)
    # A gap inside the ticker's own rows gives no return instead of a shifted one.
    assert ("Gap", "drift2_vs_IDX") not in plain and plain[("Gap", "jump_vs_IDX")] == 0.0


def test_copies_count_and_events_are_wide(study):
    stats = {(r["group"], r.metric): r.n for r in study.stats.collect()}
    assert stats[("full_capacity", "drift2_vs_IDX")] == 2
    events = study.events.filter("company = 'Alpha'").collect()
    assert len(events) == 2 and events[0].flag == 1
    assert events[0].drift2_vs_IDX == pytest.approx(0.18182) and events[0].drift6_vs_IDX is None


def test_member_rows_have_positions_and_no_pages(study):
    rows = es.member_rows(study.members, (6, 9)).collect()
    full = sorted((r.position, r.company, r.n_companies) for r in rows if (r.window, r["group"]) == (6, "full_capacity"))
    assert full == [(0, "Alpha", 3), (1, "Alpha", 3), (2, "Gap", 3)]
    assert [(r.position, r.company, r.n_companies) for r in rows if (r.window, r["group"]) == (9, "rest")] == [(None, None, 0)]


def test_members_of_a_pair_are_one_row_at_any_size(study, monkeypatch):
    from types import SimpleNamespace

    from tiergraph.plans.queries import study as queries

    monkeypatch.setattr(queries, "_study", lambda spark, sf_dir: SimpleNamespace(
        members=study.members.withColumn("window", F.lit(5))))
    rows = queries.window_members(study.members.sparkSession, "").collect()
    assert len({(r.window, r["group"]) for r in rows}) == len(rows) == 6
    assert all(len([c for c in r.companies.split("; ") if c]) == r.n_companies for r in rows)


def test_windows_cross_the_blocks_of_closes(spark):
    n = 2 * es.BLOCK_DAYS + 40
    closes = [(t, i, 100.0 + (i * k) % 83) for k, t in ((7, "AA"), (5, "IDX")) for i in range(n) if (i + k) % 19]
    at = {(t, i): c for t, i, c in closes}
    calls = [("A", "AA", DAY(2026, 1, 1), "rest", 1, i, None) for i in range(0, n, 3)]
    shape = "company string, ticker string, date date, `group` string, copies long, t0_idx int, reason string"
    quoted = es.quoted_calls(
        spark.createDataFrame(calls, shape).withColumn("date", F.date_add("date", F.col("t0_idx"))),
        spark.createDataFrame(closes + closes[:5], "ticker string, idx int, close double"), ("IDX",), (5, 20))
    want = {}
    for i in range(0, n, 3):
        for name, a, d in (("jump", 0, 1), ("drift5", 1, 5), ("drift20", 1, 20)):
            ends = [at.get((t, i + o)) for t in ("AA", "IDX") for o in (a, a + d)]
            if None not in ends:
                want[(i, f"{name}_vs_IDX")] = ends[1] / ends[0] - ends[3] / ends[2]
    got = {((r.date - DAY(2026, 1, 1)).days, r.metric): r.value for r in es.abnormal_returns(quoted, (5, 20)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_study_is_written_whole(spark, study, tmp_path):
    path = str(tmp_path)
    assert sinks.write_study(study, path, "r1") and not sinks.write_study(study, path, "r1")
    for name in sinks.STUDY_TABLES:
        assert publication.published(spark, path, name).count() == getattr(study, name).count()


def test_call_universe(spark):
    rows = [
        ("Intel Foundry", "Intel Q1 FY2026 (04-23-2026)", 0), ("Intel", "Intel Q1 FY2026 (04-23-2026) ", 1),
        ("Google", "Lumentum Q3 FY2026 (05-05-2026)", 2), ("Google", "Google keynote (05-05-2026)", 3),
        ("Google", "Google Q1 FY2026 (04-29-2026)", 4), ("Google", "Google Q2 FY2026", 5),
        ("Foreign", "Foreign Q1 FY2026 (04-29-2026)", 6), ("Google", None, 7),
    ]
    sig = spark.createDataFrame(rows, "company string, quarter string, ord int")
    meta = spark.createDataFrame(
        [("Intel Foundry", "INTC", "NASDAQ"), ("Intel", "INTC", "NASDAQ"), ("Google", "GOOG", "NASDAQ"),
         ("Foreign", "FF", "TSE")], "company string, ticker string, exchange string")
    found = jobs.extract_calls(sig, meta)
    assert sorted((r.company, r.ticker, str(r.date), r.source_label) for r in found.collect()) == [
        ("Google", "GOOG", "2026-04-29", "Google Q1 FY2026 (04-29-2026)"),
        ("Intel", "INTC", "2026-04-23", "Intel Q1 FY2026 (04-23-2026)")]
    r = call_ops.call_range(found).first()
    assert (r.n_calls, r.n_companies, str(r.first_date)) == (2, 2, "2026-04-23")


def test_price_top_up_adds_missing_tickers_only(spark):
    base = prices(spark, {"AA": [1.0]})
    more = merge.add_price_columns(base, prices(spark, {"AA": [9.0], "BB": [2.0]}))
    assert sorted((r.ticker, r.close) for r in more.collect()) == [("AA", 1.0), ("BB", 2.0)]
