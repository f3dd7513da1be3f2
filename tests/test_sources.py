import json

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

import samples
from tiergraph.functions import text as tx
from tiergraph.sources import documents, publication, schemas, sinks, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_chains_and_index(spark, tmp_path):
    chains = documents.read_chains(spark, samples.write_chains(str(tmp_path)))
    assert sorted(r.chain for r in chains.collect()) == ["a_alpha", "b_beta"]
    assert rows(documents.chain_index(chains)) == [
        ("a_alpha", "Maker", "first"), ("b_beta", "b_beta", "")
    ]


def test_keyed_json(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text(json.dumps({"_schema": {"ticker": "doc"}, "A": {"ticker": "X"}, "B": {}}))
    read = lambda p: documents.read_keyed_json(spark, str(p), schemas.METADATA)
    assert sorted(rows(read(path).select("company", "ticker"))) == [("A", "X"), ("B", None)]
    missing = read(tmp_path / "none.json")
    assert missing.count() == 0 and missing.columns[0] == "company"


def test_calls_with_byte_order_mark_round_trip(spark, tmp_path):
    path = tmp_path / "calls.csv"
    path.write_text("﻿company,ticker,date,source_label\nA,AA,2026-05-05,A Q1\n", "utf-8")
    calls = tables.read_calls(spark, str(path))
    assert [(r.company, str(r.date)) for r in calls.collect()] == [("A", "2026-05-05")]
    sinks.write_calls(calls, str(tmp_path / "out"))
    assert rows(tables.read_calls(spark, str(tmp_path / "out"))) == rows(calls)


def test_flags(spark, tmp_path):
    path = tmp_path / "flags.csv"
    path.write_text("company,flag,evidence,source,owner_ruling\nA,1,x,s,ok\nA,1,y,s,ok\nB,0,z,s,no\n")
    assert rows(tables.read_flags(spark, str(path))) == [("A",)]


def test_prices_keep_days_without_a_close(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("Date,AA,BRK.B\n2026-01-02,1.5,NaN\n2026-01-05,,2.5\n")
    got = {(str(r.date), r.ticker): r.close for r in tables.read_prices(spark, str(path)).collect()}
    assert got == {("2026-01-02", "AA"): 1.5, ("2026-01-02", "BRK.B"): None,
                   ("2026-01-05", "AA"): None, ("2026-01-05", "BRK.B"): 2.5}


def test_reports_last_path_wins(spark, tmp_path):
    for name, body in (("a", {"node_name": "X", "v": 1}), ("b", {"node_name": "X", "v": 2}),
                       ("c", {"v": 3}), ("_skip", {"node_name": "Y"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    got = documents.read_reports(spark, str(tmp_path)).select(
        "node", F.try_variant_get("report", "$.v", "int").alias("v"))
    assert sorted(rows(got)) == [("X", 2), ("c", 3)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "memory").mkdir()
    (tmp_path / "memory" / "micro_q1.txt").write_text("SOURCE: x\nline")
    assert rows(documents.read_transcripts(spark, str(tmp_path))) == [
        ("memory", "micro_q1", "SOURCE: x\nline")
    ]


def test_paragraphs(spark):
    html = (
        "<html><script>var t='<p>no</p>'</script><!-- <p>no</p> --><nav>menu</nav>"
        "<p class='x'>One <b>bold</b> &amp;lt; &#233;&#x20AC;&eacute; &unknown; &</p>"
        "<P>open<p>next</p> tail <p>last<footer>foot</footer><pre>code</pre>"
    )
    df = spark.createDataFrame([(1, html), (2, "no paragraph"), (3, "")], "id int, html string")
    got = {r.id: r.text for r in documents.extract_paragraphs(df).collect()}
    assert got[1] == "One bold &lt; é€é &unknown; &\n\nopen\n\nnext\n\nlast"
    assert got[2] == "" and got[3] == ""


def test_entities_beyond_the_base_plane(spark):
    df = spark.createDataFrame([("&#128512;&#xD800;&#99999999999;",)], "t string")
    assert df.select(tx.unescape_entities(F.col("t"))).first()[0] == "\U0001F600��"


def test_replies(spark):
    raw = ['```json\n{"k": 1}\n```', 'text {"k": 2} more', '{"k": ', "none", '  {"k": {"a": 3}} ']
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    good, bad = documents.parse_replies(
        df, "raw", T.StructType([T.StructField("k", T.StringType())]))
    assert sorted((r.id, r.parsed.k) for r in good.collect()) == [(0, "1"), (1, "2"), (4, '{"a":3}')]
    assert sorted(r.id for r in bad.collect()) == [2, 3]


def test_history_appends(spark, tmp_path):
    path = str(tmp_path / "history")
    assert tables.load_history(spark, path).count() == 0
    sinks.append_history(spark, path, "2026-06-09 22:20", "first")
    sinks.append_history(spark, path, "2026-06-09 22:36", "second")
    assert [r.note for r in tables.load_history(spark, path).collect()] == ["first", "second"]


def test_runs_are_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "views")
    read = lambda name, run=None: publication.published(spark, path, name, run).count()
    with pytest.raises(ValueError):
        read("v")
    assert sinks.publish_views({"v": spark.range(3), "w": spark.range(1)}, path, "one")
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_views({"v": spark.range(7), "w": broken}, path, "two")
    assert read("v") == 3 and read("w") == 1
    assert sinks.publish_views({"v": spark.range(8), "w": spark.range(2)}, path, "two")
    assert read("v") == 8 and read("v", "one") == 3
    assert not sinks.publish_views({"v": spark.range(99)}, path, "one") and read("v", "one") == 3
    assert [r.run_id for r in publication.manifest(spark, path).orderBy("number").collect()] == ["one", "two"]


def test_history_takes_a_row_once(spark, tmp_path):
    path = str(tmp_path / "history")
    for _ in range(2):
        sinks.append_history(spark, path, "2026-06-09 22:20", "first")
    assert tables.load_history(spark, path).count() == 1
