"""The registered corpus queries against their SQL, and the pipeline against brute force."""

import os
from collections import defaultdict

import pytest

import compare
from pyspark.sql import functions as F

import corpus_pipeline
from llm.test_decontaminate_and_pack import expected as contamination
from llm.test_exact_and_shards import lowered
from llm.test_jaccard_join import expected as groups
from tiergraph.llm import quality
from tiergraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    outcome = compare.compare(spark, compare.database(SF), SF, name, QUERIES[name])
    assert outcome.startswith("ok" if QUERIES[name].sql else "rows only"), outcome


def test_every_operator_is_registered_once():
    import __spark_entry__ as contract

    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["id"] for r in quality.score(docs, model).collect() if r["score"] >= quality.GOOD}
    largest = defaultdict(int)
    for i in kept:
        largest[lowered(text[i])] = max(i, largest[lowered(text[i])])
    kept = set(largest.values())
    kept = {c for _, _, c in groups([(i, text[i]) for i in sorted(kept)])}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i in list(kept):
        n, hit, _ = contamination(text[i], items)
        if hit and 20 * hit >= n:
            kept.remove(i)
    got = corpus_pipeline.run(spark, SF).collect()
    pieces = defaultdict(dict)
    for r in got:
        pieces[r["doc_id"]][r["start"]] = r["n_chars"]
    assert set(pieces) == kept
    for i, own in pieces.items():
        assert sum(own.values()) == len(text[i] or "")
        assert all(a + own[a] == b for a, b in zip(sorted(own), sorted(own)[1:]))
    bins = defaultdict(int)
    for r in got:
        bins[r["bin"]] += r["n_chars"] + 1
    assert max(bins.values()) <= 16_384


def test_stages_pass_on_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_columns_of_any_name(spark):
    names = ["_id", "_full", "_s", "_row", "_bits", "_maybe", "id", "component", "row", "spans", "doc"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, more, SF)
        assert kept.columns == more.columns, name
        same = stage(spark, docs, SF).select("doc_id").exceptAll(kept.select("doc_id"))
        assert same.count() == 0 and kept.where("_row <> 3 OR _maybe <> 5").count() == 0, name
