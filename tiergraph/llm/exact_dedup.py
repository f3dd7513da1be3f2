"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.llm.common import ascii_lower, maybe_in, stored, unused


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    hash_all: bool = False,
) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z.

    One scan counts (length, hash of the first characters); a pair that occurs once
    proves its row unique, as does a length that occurs once. The second scan hashes
    the full text of the other rows only, and those hashes decide. Nothing but ids and
    hashes is shuffled. A hot group meets as partial counts and, when the rows look up
    their group, in a join whose large partitions Spark splits.

    Returns one row per input row: ``id``, ``keep_id`` (largest id of the equal texts),
    ``group_size``, ``kept``, ``full_hash`` (SHA-256, null where refinement ended
    earlier; for every row with ``hash_all``).

    A null text counts as empty. Ids may be null or repeated: null is smaller than any
    id, and rows that repeat the kept id with an equal text are all kept. Other columns
    are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        "text",
        F.octet_length("text").alias("n"),
        F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars))).alias("prefix"),
    )
    pairs = rows.groupBy("n", "prefix").count().where("count > 1")
    refined = maybe_in(rows, pairs, {"n": F.col("n"), "prefix": F.col("prefix")}, "shared")
    digest = F.unhex(F.sha2(ascii_lower(F.col("text")), 256))
    hashes = stored(
        refined.select(
            "id",
            "n",
            "shared",
            (digest if hash_all else F.when(F.col("shared"), digest)).alias("full"),
        )
    )
    shared = hashes.where("shared")
    # Written first: a side that still aggregates would keep Spark from splitting the other.
    groups = stored(
        shared.groupBy("n", "full").agg(
            F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
    )
    out = ["id", "keep_id", "group_size", "full"]
    return (
        shared.join(groups, ["n", "full"])
        .select(*out)
        .unionByName(
            hashes.where("not shared").select(
                "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "full"
            )
        )
        .select(
            "id",
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("full")).alias("full_hash"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep; all columns stay.

    Only rows whose id may be among the dropped ones are joined, by id and full hash;
    the rest pass where they are read.
    """
    gone = (
        exact_groups(docs, id_col, text_col)
        .where("not kept")
        .select(F.col("id").alias("_id"), F.col("full_hash").alias("_full"))
    )
    full = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    return without(docs, gone, {"_id": F.col(id_col)}, {"_full": full})


def without(
    docs: DataFrame, gone: DataFrame, on: dict[str, Column], also: dict[str, Column] | None = None
) -> DataFrame:
    """Rows of ``docs`` that ``gone`` does not name; a null matches a null.

    ``on`` and ``also`` map columns of ``gone`` to expressions over ``docs``; those of
    ``also`` are evaluated only for rows that pass the filter made of ``on``. Columns of
    ``docs`` may have any names.
    """
    wanted = {**on, **(also or {})}
    flag, *names = unused(docs, "_maybe", *wanted)
    gone = stored(gone.select(*(F.col(old).alias(new) for old, new in zip(wanted, names))))
    marked = maybe_in(docs, gone, dict(zip(names, on.values())), flag)
    same = F.lit(True)
    for name, value in zip(names, wanted.values()):
        same = same & value.eqNullSafe(F.col(name))
    return marked.where(F.col(flag)).join(gone, same, "left_anti").union(marked.where(~F.col(flag))).drop(flag)
