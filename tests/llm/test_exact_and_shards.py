import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.samples import docs, prose
from tiergraph.llm import exact_dedup, shard


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


ROWS = [
    (1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, "É Same"), (4, "é same"), (5, None),
    (6, ""), (7, "x" * 70 + "a"), (8, "x" * 70 + "b"), (10, "x" * 70 + "A"), (11, "same text "),
    (None, "Same text"), (None, "alone"), (12, prose(1, 30_000)), (13, prose(1, 30_000).upper()),
    (9, "other text of a repeated id"), (9, "SAME text"),
]


def test_groups_match_brute_force(spark):
    got = exact_dedup.exact_groups(docs(spark, ROWS), hash_all=True).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lowered(t)].append(i)
    want = Counter()
    for i, t in ROWS:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        digest = hashlib.sha256(lowered(t).encode()).hexdigest()
        want[(i, keep, len(ids), i == keep, digest)] += 1
    assert Counter(map(tuple, got)) == want


def test_full_hash_is_left_to_survivors(spark):
    got = {r["id"]: r["full_hash"] for r in exact_dedup.exact_groups(docs(spark, [(1, "a"), (2, "bb"), (3, "A")])).collect()}
    assert got[2] is None and got[1] == got[3] == hashlib.sha256(b"a").hexdigest()


def test_drop_keeps_columns_and_rows_of_other_texts(spark):
    source = docs(spark, ROWS)
    kept = exact_dedup.drop_exact_copies(source)
    assert kept.columns == source.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got[(9, "other text of a repeated id")] == 1 and got[(None, "alone")] == 1
    assert got[(9, "SAME TEXT")] == 1 and not got[(1, "Same Text")] and not got[(None, "Same text")]


def test_other_columns_may_have_any_names(spark):
    names = ["_id", "_full", "_s", "_ROW", "_bits", "_maybe", "_s_", "flag", "a.b"]
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          *(T.StructField(n, T.LongType()) for n in names)])
    values = list(range(10, 10 + len(names)))
    source = spark.createDataFrame([(1, "A b", *values), (2, "a B", *values), (3, None, *values)], shape)
    kept = exact_dedup.drop_exact_copies(source)
    assert kept.columns == source.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "a B", *values), (3, None, *values)]


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(docs(spark, [])).count() == 0
    assert shard.place(docs(spark, []), ["a"]).count() == 0


def test_lookup_table_is_fair_and_steady():
    names = [f"n{i}" for i in range(20)]
    table = shard.lookup_table(names, 2_003)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1 and len(shares) == 20
    assert [names[i] for i in table] == [sorted(names)[i] for i in shard.lookup_table(sorted(names), 2_003)]
    fewer = shard.lookup_table(names[:-1], 2_003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.25 * 2_003
    with pytest.raises(ValueError):
        shard.lookup_table(names, 2_000)
    with pytest.raises(ValueError):
        shard.lookup_table(["a", "a"], 7)


def test_turns_claim_the_first_free_slot():
    names, slots = ["b", "a", "c"], 13
    want = [None] * slots
    walks = {}
    for name in sorted(names):
        d = hashlib.md5(name.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        walks[name] = iter([(start + j * step) % slots for j in range(slots)])
    turn = 0
    while None in want:
        name = sorted(names)[turn % 3]
        want[next(s for s in walks[name] if want[s] is None)] = name
        turn += 1
    assert [names[i] for i in shard.lookup_table(names, slots)] == want


def test_place_is_the_hash_of_the_id(spark):
    names = ["s0", "s1", "s2"]
    rows = [(1, "a"), (2, "b"), (2, "c"), (None, "d")]
    got = shard.place(docs(spark, rows), names, slots=101).collect()
    table = shard.lookup_table(names, 101)
    for r in got:
        slot = int(hashlib.md5(("" if r["id"] is None else str(r["id"])).encode()).hexdigest()[:12], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert len(got) == 4
    assert shard.place(docs(spark, rows).withColumn("shard", F.lit(1)), names).count() == 4
