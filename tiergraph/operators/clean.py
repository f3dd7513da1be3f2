"""Renames, label corrections and the vocabulary check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.functions import fixed_values as fixed


def exact_replace(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace whole values by a small literal map."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def rename_entities(
    df: DataFrame,
    names: Sequence[str] = (),
    texts: Sequence[str] = (),
    mapping: Mapping[str, str] = fixed.RENAMES,
    word_safe: bool = False,
) -> DataFrame:
    """Rename whole values of name columns and substrings of text columns.

    Substrings are replaced one rule after the other, so a rule whose result
    contains its own left side grows the text each time it is applied.
    ``word_safe`` replaces whole words only and skips what is already renamed.
    """
    for column in names:
        df = df.withColumn(column, exact_replace(F.col(column), mapping))
    for column in texts:
        value = F.col(column)
        for old, new in mapping.items():
            if word_safe:
                tail = new[len(old):] if new.startswith(old) else ""
                guard = rf"(?!\Q{tail}\E)" if tail else ""
                value = F.regexp_replace(
                    value, rf"\b\Q{old}\E\b{guard}", new.replace("\\", "\\\\").replace("$", "\\$")
                )
            else:
                value = F.replace(value, F.lit(old), F.lit(new))
        df = df.withColumn(column, value)
    return df


def rename_chains(
    chains: DataFrame, mapping: Mapping[str, str] = fixed.RENAMES
) -> DataFrame:
    """``rename_entities`` inside nested chain documents, at every depth."""
    def text(value: Column) -> Column:
        for old, new in mapping.items():
            value = F.replace(value, F.lit(old), F.lit(new))
        return value

    return _rebuild(chains, lambda name, v: {
        "company": lambda: exact_replace(v, mapping),
        "signal": lambda: text(v),
        "source": lambda: text(v),
    }.get(name, lambda: v)())


def normalise_labels(
    df: DataFrame,
    columns: Sequence[str] = ("quarter",),
    mapping: Mapping[str, str] = fixed.LABEL_FIXES,
) -> DataFrame:
    """Exact corrections of label columns."""
    for column in columns:
        df = df.withColumn(column, exact_replace(F.col(column), mapping))
    return df


def normalise_chain_labels(
    chains: DataFrame, mapping: Mapping[str, str] = fixed.LABEL_FIXES
) -> DataFrame:
    """``normalise_labels`` of quarter and source inside nested chain documents."""
    return _rebuild(
        chains, lambda n, v: exact_replace(v, mapping) if n in ("quarter", "source") else v
    )


def _rebuild(df: DataFrame, change) -> DataFrame:
    """Apply ``change(field name, value)`` to every string leaf of every column."""
    def visit(name: str, value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return change(name, value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: visit(name, x, kind.elementType))
        if isinstance(kind, T.StructType):
            fields = [visit(f.name, value[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        return value

    keep = ("chain", "path", "part", "continues")
    return df.select(
        *[
            F.col(f.name) if f.name in keep
            else visit(f.name, F.col(f.name), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def vocabulary_check(players: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Slugs used by players that are not in the vocabulary, with their use count."""
    used = players.groupBy("kind", "slug").agg(F.count(F.lit(1)).alias("n"))
    return used.join(F.broadcast(taxonomy.select("kind", "slug")), ["kind", "slug"], "left_anti")
