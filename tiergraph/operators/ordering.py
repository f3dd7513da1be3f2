"""Dense positions and exact medians that survive a dominant key.

A window function puts a whole group into one task. That is right for groups whose size
is bounded by what they are (the lines of one order) and wrong for a key that may own a
large share of all rows. Callers say which groups are bounded; all others are numbered
over a range sort, which spreads one key over many tasks. Nothing is measured first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.session import cut


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
    bounded: bool = False,
) -> DataFrame:
    """Add the zero-based rank of every row inside its group.

    ``order`` has to be total inside a group. ``bounded`` says that no group can outgrow
    one task.
    """
    if bounded:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    return ranged_positions(df, keys, order, name)


def ranged_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """``positions`` by a range sort and a segmented prefix sum, for groups of any size.

    Every range numbers its groups in one stream. Only a range's first group may go on from
    earlier ranges; one row per range tells how many of its rows came before.
    """
    if not keys:
        return _numbered_rows(df, order, name)
    by = [F.col(k) for k in keys] + list(order)
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[F.col(k).alias(n) for k, n in zip(keys, names)])
    schema = T.StructType([
        *keyed.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_row", T.LongType()),
        T.StructField("_head", T.BooleanType()), T.StructField("_slice", T.IntegerType()),
    ])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_no, last, carried, row, head = TaskContext.get().partitionId(), None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c) for c in names]
            new = np.zeros(n, bool)
            for column in columns:
                a, b = column.slice(1), column.slice(0, n - 1)
                differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
                new[1:] |= differs.to_numpy(zero_copy_only=False)
            new[0] = last is not None and [c[0].as_py() for c in columns] != last
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            here = np.where(start < 0, at + carried, at - start)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(here), pa.array(at + row), pa.array(head & (start < 0)),
                    pa.array(np.full(n, slice_no, np.int32)),
                ],
                names=schema.fieldNames(),
            )
            last, carried, row = [c[n - 1].as_py() for c in columns], int(here[-1]) + 1, row + n
            head = head and not new.any()

    ranked = cut(keyed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, schema))
    key = F.array(*[F.to_json(F.struct(F.col(n).alias("k"))) for n in names])
    # One row a range; there are as many as shuffle partitions.
    ranges = ranked.groupBy("_slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_head").alias("n_head"),
        F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"),
        F.max_by("_n", "_row").alias("last_n"),
    ).collect()
    before, key_before, rows_before = [], None, 0
    for r in sorted(ranges, key=lambda r: r["_slice"]):
        goes_on = rows_before if r["first"] == key_before else 0
        before.append((r["_slice"], goes_on))
        rows_before = goes_on + r["n"] if r["n_head"] == r["n"] else r["last_n"] + 1
        key_before = r["last"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_slice int, _before long"))
    place = F.col("_n") + F.when(F.col("_head"), F.col("_before")).otherwise(0)
    return ranked.join(offsets, "_slice").select(*df.columns, place.alias(name))


def _numbered_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``ranged_positions`` of one group: a range starts after the rows of all earlier ones."""
    rows = ranged_rows(df, order)
    # One row a range; there are as many as shuffle partitions.
    sizes = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).collect()
    shifts, before = [], 0
    for r in sorted(sizes, key=lambda r: r["_slice"]):
        shifts.append((r["_slice"], before - r["first"]))
        before += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(shifts, "_slice int, _shift long"))
    return rows.withColumn("_slice", F.col("_slice").cast("int")).join(offsets, "_slice").select(
        *df.columns, (F.col("_row") + F.col("_shift")).alias(name)
    )


def ranged_rows(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """The rows in order, kept; ``_row`` counts them inside their range, ``_slice`` is the range."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = cut(ordered.withColumn("_row", F.monotonically_increasing_id()))
    return kept.withColumn("_slice", F.shiftright("_row", 33))


def earlier(runs: DataFrame, keys: Sequence[str], total: str, name: str) -> DataFrame:
    """Add the sum of ``total`` over a group's earlier ranges; ``runs`` has a row a range and group."""
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn(name, F.coalesce(F.sum(total).over(before), F.lit(0)))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the group, however large it is.

    Sums inside a range and sums of whole ranges are put together, so a task holds one range
    or one row a range. ``order`` has to be total inside a group.
    """
    rows = ranged_rows(df, [F.col(k) for k in keys] + list(order))
    here = Window.partitionBy("_slice", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    totals = rows.groupBy("_slice", *keys).agg(F.sum(value).alias("_total"))
    placed = null_safe_join(summed, earlier(totals, keys, "_total", "_earlier"), ["_slice", *keys])
    return placed.select(*df.columns, (F.col("_here") + F.col("_earlier")).alias(name))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, match).drop(*[f"_r_{k}" for k in keys])


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group with their one-based rank.

    Spark applies the limit before the shuffle as well, so a dominant key sends
    at most ``k`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def upper_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "median",
    accuracy: int = 10_000,
    few_groups: bool = False,
) -> DataFrame:
    """Exact upper median (the upper middle value of an even count) per group.

    A mergeable quantile sketch brackets the middle; one aggregation counts what
    lies below the bracket and the copies of each value inside it, and the exact
    rank is then found among that narrow band. No group is ever gathered whole.
    ``few_groups`` says that the caller's parameters bound the number of groups,
    so the one-row-per-group brackets are broadcast and the values stay in place.
    """
    margin = 4.0 / accuracy
    clean = df.filter(F.col(value).isNotNull())
    brackets = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.percentile_approx(value, [0.5 - margin, 0.5 + margin], accuracy).alias("_band"),
    )
    small = F.col("_n") <= accuracy
    brackets = brackets.select(
        *keys,
        "_n",
        F.when(small, F.col("_min")).otherwise(F.col("_band")[0]).alias("_low"),
        F.when(small, F.col("_max")).otherwise(F.col("_band")[1]).alias("_high"),
    )
    if few_groups:
        brackets = F.broadcast(brackets)
    banded = (
        clean.select(*keys, value)
        .join(brackets, list(keys))
        .filter(F.col(value) <= F.col("_high"))
        .withColumn("_v", F.when(F.col(value) >= F.col("_low"), F.col(value)))
        .groupBy(*keys, "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        banded.withColumn("_upto", F.sum("_copies").over(upto))
        .filter(F.col("_upto") > F.floor(F.col("_n") / 2))
        .groupBy(*keys)
        .agg(F.min("_v").alias(name))
    )
