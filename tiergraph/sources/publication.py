"""Tables published together: all of them or none.

A run writes its tables to a folder of its own and names them in the manifest last. Readers
follow the manifest, so a run that broke between two tables leaves the earlier one in place,
and a run that is repeated under its id does nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.sources.documents import exists

MANIFEST = "number long, run_id string, names array<string>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per complete run; empty before the first."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def publish(tables: Mapping[str, DataFrame], path: str, run_id: str) -> bool:
    """Write ``tables`` as run ``run_id``; false if that run is complete already."""
    spark = next(iter(tables.values())).sparkSession
    known = manifest(spark, path)
    if not known.filter(F.col("run_id") == run_id).isEmpty():
        return False
    for name, table in tables.items():
        # What a broken attempt left is written anew.
        table.write.mode("overwrite").parquet(f"{path}/runs/{run_id}/{name}")
    number = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    row = spark.createDataFrame([(number, run_id, list(tables))], MANIFEST)
    # One row is one file, which the committer moves into place as a whole.
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def published(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of the newest complete run, or of the one asked for."""
    runs = manifest(spark, path).filter(F.array_contains("names", name))
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    newest = runs.orderBy(F.desc("number"), F.desc("run_id")).first()
    if newest is None:
        raise ValueError(f"no complete run holds {name!r}")
    return spark.read.parquet(f"{path}/runs/{newest['run_id']}/{name}")
