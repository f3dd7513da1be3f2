"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tiergraph.llm
from tiergraph.session import checkpoint_root

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[tiergraph.llm.__name__])

#: log2 of the slots of a key filter: 8 million bits, one megabyte at any input size.
FILTER_BITS = 23
#: Bits of one row of the filter table (the width of Spark's bitmap aggregate).
ROW_BITS = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files outlive executors, are compressed and tell the optimizer their size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def maybe_in(rows: DataFrame, keys: DataFrame, on: dict[str, Column], flag: str) -> DataFrame:
    """Mark the rows whose key may be among ``keys``; never misses one that is.

    ``on`` maps the key columns of ``keys`` to expressions over ``rows``. The keys are
    folded to a bitmap of fixed size, the only thing that is broadcast, so the filter
    needs no shuffle of ``rows``. More keys mean more false marks, never wrong ones:
    callers follow with an exact join of the marked rows. Columns of ``rows`` may have
    any names but ``flag``.
    """
    slot, row, held = unused(rows, "_s", "_row", "_bits")
    marks = keys.select(_slot(*(F.col(k) for k in on)).alias(slot))
    bits = marks.groupBy(F.shiftright(slot, ROW_BITS).cast("int").alias(row)).agg(
        F.bitmap_construct_agg(F.col(slot).bitwiseAND((1 << ROW_BITS) - 1)).alias(held)
    )
    at = F.col(slot).bitwiseAND((1 << ROW_BITS) - 1).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10)
    one = F.call_function("shiftright", byte.cast("int"), at.bitwiseAND(7)).bitwiseAND(1)
    return (
        rows.withColumn(slot, _slot(*on.values()))
        .withColumn(row, F.shiftright(slot, ROW_BITS).cast("int"))
        .join(F.broadcast(bits), row, "left")
        .withColumn(flag, F.coalesce(one == 1, F.lit(False)))
        .drop(slot, row, held)
    )


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a text column without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)
