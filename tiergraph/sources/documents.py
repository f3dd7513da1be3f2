"""Readers of JSON documents and texts: chains, keyed objects, timelines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.functions import text as tx
from tiergraph.sources import schemas


def file_path() -> Column:
    """Decoded path of the file a row came from."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("path", file_path())
    )


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Chain documents of a folder tree, keyed by file stem; ``path`` orders them.

    A chain that was written in several parts carries a ``part`` number in its
    file's folder name; its parts keep one chain id. In ``path`` the number is padded,
    so part 10 comes after part 2.
    """
    part = F.regexp_extract("path", r"/part=(\d+)/", 1)
    named = F.regexp_extract("path", r"/chain=([^/]*)/", 1)
    padded = F.regexp_replace("path", F.lit(r"/part=\d+/"), F.concat(F.lit("/part="), F.lpad(part, 19, "0"), F.lit("/")))
    return (
        _json_documents(spark, path, schemas.CHAIN)
        .withColumn("chain", F.when(named != "", F.url_decode(named)).otherwise(file_stem(F.col("path"))))
        .withColumn("part", F.coalesce(F.nullif(part, F.lit("")).cast("bigint"), F.lit(0)))
        .withColumn("path", padded)
    )


def read_tier_chains(spark: SparkSession, path: str) -> DataFrame:
    """Chain documents in the older tier shape, the input of classification."""
    return _json_documents(spark, path, schemas.TIER_CHAIN).withColumn(
        "chain", file_stem(F.col("path"))
    )


def keyed_rows(raw: DataFrame, column: str, value_schema: T.StructType, key: str) -> DataFrame:
    """Rows of JSON objects keyed by name; the ``_schema`` entry is documentation."""
    entries = F.from_json(column, T.MapType(T.StringType(), value_schema))
    return (
        raw.select(F.explode(entries).alias(key, "_value"))
        .filter(F.col(key) != "_schema")
        .select(key, "_value.*")
    )


def read_keyed_json(
    spark: SparkSession, path: str, value_schema: T.StructType, key: str = "company"
) -> DataFrame:
    """``keyed_rows`` of a file or folder; no rows when it is missing."""
    if not exists(spark, path):
        fields = [T.StructField(key, T.StringType()), *value_schema.fields]
        return spark.createDataFrame([], T.StructType(fields))
    return keyed_rows(spark.read.text(path, wholetext=True), "value", value_schema, key)


def chain_index(chains: DataFrame) -> DataFrame:
    """Id, company (the id when blank) and focus of every chain, in id order."""
    return (
        chains.groupBy("chain")
        .agg(F.min_by(F.struct("company", "chain_focus"), F.struct("path", "part")).alias("d"))
        .select(
            F.col("chain").alias("id"),
            F.coalesce(F.nullif("d.company", F.lit("")), F.col("chain")).alias("company"),
            F.coalesce("d.chain_focus", F.lit("")).alias("chain_focus"),
        )
        .orderBy("id")
    )


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """Timeline documents with their file stem as ``id``.

    Documents that Spark wrote by ``id`` carry it in the name of their folder.
    """
    folder = F.regexp_extract("path", r"/id=([^/]*)/", 1)
    return _json_documents(spark, path, schemas.TIMELINE).withColumn(
        "id", F.when(folder != "", F.url_decode(folder)).otherwise(file_stem(F.col("path")))
    )


def read_capex_backlog(spark: SparkSession, path: str) -> DataFrame:
    """The capex and backlog document as one nested row."""
    return spark.read.schema(schemas.CAPEX_BACKLOG).option("multiLine", True).json(path)


def latest_reports(raw: DataFrame) -> DataFrame:
    """Reports from ``(path, value)`` texts keyed by their ``node_name``, else file stem.

    Files whose name starts with an underscore are skipped. Where two files share
    a key the later path wins. ``report`` is a variant.
    """
    name = F.try_variant_get(F.try_parse_json("value"), "$.node_name", "string")
    return (
        raw.withColumn("_stem", file_stem(F.col("path")))
        .filter(~F.startswith("_stem", F.lit("_")) & F.endswith("path", F.lit(".json")))
        .withColumn("node", F.coalesce(F.nullif(name, F.lit("")), F.col("_stem")))
        .groupBy("node")
        .agg(F.max_by("value", "path").alias("value"), F.max("path").alias("path"))
        .select("node", "path", F.try_parse_json("value").alias("report"))
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``latest_reports`` of a folder."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(file_path().alias("path"), "value")
    )
    return latest_reports(raw)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: sector (its folder), stem and text."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(path, wholetext=True)
        .select(file_path().alias("path"), F.col("value").alias("text"))
        .select(
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sector"),
            file_stem(F.col("path")).alias("stem"),
            "text",
        )
    )


def extract_paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace raw markup by ``text``: its paragraphs joined by a blank line."""
    return pages.withColumn(
        "text", F.array_join(tx.paragraphs(F.col(html)), "\n\n")
    ).drop(html)


def parse_replies(
    replies: DataFrame, raw: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Parsed model replies and the quarantined rows that hold no valid object."""
    staged = replies.withColumn("_body", tx.reply_object(F.col(raw)))
    valid = F.try_parse_json("_body").isNotNull()
    parsed = staged.filter(valid).withColumn("parsed", F.from_json("_body", schema))
    return parsed.drop("_body"), staged.filter(F.coalesce(~valid, F.lit(True))).drop("_body")
