import random

from pyspark.sql import functions as F

from tiergraph.operators import ordering


def skewed(spark, n=4000):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{i % 40}", rng.randrange(10**6), i)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, v int, id int").repartition(7)


def expected(rows):
    seen, out = {}, {}
    for key, v, i in sorted(rows):
        out[i] = seen.get(key, 0)
        seen[key] = out[i] + 1
    return out


def test_positions_by_window_and_by_range_agree(spark):
    rows, df = skewed(spark)
    order = [F.col("v"), F.col("id")]
    want = expected(rows)
    for bounded in (True, False):
        got = ordering.positions(df, ["key"], order, bounded=bounded)
        assert {r.id: r.position for r in got.collect()} == want


def test_ranges_number_groups_of_all_sizes(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 30 + [f"k{i}" for i in range(40)]), None if rng.random() < 0.1 else rng.randrange(3), i)
            for i in range(3_000)] + [(None, 0, 3_000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "a string, b int, id int").repartition(6)
    for keys in ([], ["a"], ["a", "b"]):
        groups = {}
        for a, b, i in rows:
            groups.setdefault(tuple({"a": a, "b": b}[k] for k in keys), []).append(i)
        want = {i: n for ids in groups.values() for n, i in enumerate(sorted(ids))}
        got = ordering.ranged_positions(df, keys, [F.col("id")])
        assert {r.id: r.position for r in got.collect()} == want
    assert ordering.ranged_positions(df.limit(0), ["a"], [F.col("id")]).count() == 0


def test_first_rows_limits_before_the_shuffle(spark):
    _, df = skewed(spark)
    top = ordering.first_rows(df, ["key"], [F.col("v"), F.col("id")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("key").count().agg(F.max("count")).first()[0] == 3


def test_upper_median_is_exact(spark):
    rng = random.Random(3)
    groups = {
        "even": [1.0, 2.0, 3.0, 4.0], "one": [7.0], "odd": [3.0, 1.0, 2.0],
        "ties": [5.0] * 3000 + [1.0] * 10, "wide": [rng.gauss(0, 1) for _ in range(3001)],
        "big": [float(rng.randrange(40)) for _ in range(5000)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}
    for accuracy in (10_000, 200):
        got = ordering.upper_median(df, ["g"], "v", accuracy=accuracy, few_groups=True)
        assert {r.g: r.median for r in got.collect()} == want
