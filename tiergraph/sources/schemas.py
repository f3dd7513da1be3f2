"""Explicit schemas of every input document and table."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CONTRACT = T.StructType(_strings("source", "signal", "units", "value", "date_signed", "type"))
EDGE_STUB = T.StructType(
    [*_strings("company", "relationship"), T.StructField("contracts", T.ArrayType(CONTRACT))]
)
QUARTERLY = T.StructType(_strings("quarter", "signal", "figure"))
PLAYER = T.StructType(
    [
        *_strings("company", "product"),
        T.StructField("connects_to", T.ArrayType(EDGE_STUB)),
        T.StructField("quarterly_data", T.ArrayType(QUARTERLY)),
    ]
)
SUB_SECTOR = T.StructType(
    [*_strings("sub_sector"), T.StructField("players", T.ArrayType(PLAYER))]
)
SECTOR = T.StructType(
    [
        *_strings("sector"),
        T.StructField("players", T.ArrayType(PLAYER)),
        T.StructField("sub_sectors", T.ArrayType(SUB_SECTOR)),
    ]
)
LAYER_GROUP = T.StructType([*_strings("layer"), T.StructField("sectors", T.ArrayType(SECTOR))])
DOMAIN_GROUP = T.StructType([*_strings("domain"), T.StructField("sectors", T.ArrayType(SECTOR))])
CHAIN = T.StructType(
    [
        *_strings("company", "chain_focus"),
        T.StructField("flow", T.ArrayType(LAYER_GROUP)),
        T.StructField("domains", T.ArrayType(DOMAIN_GROUP)),
        # Set on a further part of a long chain whose first sector began in the part before.
        T.StructField("continues", T.BooleanType()),
    ]
)
TIER_CHAIN = T.StructType(
    [
        *_strings("company", "chain_focus"),
        T.StructField(
            "flow",
            T.ArrayType(
                T.StructType([*_strings("tier"), T.StructField("players", T.ArrayType(PLAYER))])
            ),
        ),
    ]
)

METADATA = T.StructType(_strings("ticker", "exchange", "country", "status"))
METRICS = T.StructType(
    _strings(
        "revenue_growth", "guidance", "backlog_or_b2b", "supply_status", "next_catalyst", "asof"
    )
)
LOGO = T.StructType(_strings("file", "bg"))

CALLS = T.StructType(
    [
        *_strings("company", "ticker"),
        T.StructField("date", T.DateType()),
        *_strings("source_label"),
    ]
)
FLAGS = T.StructType(_strings("company", "flag", "evidence", "source", "owner_ruling"))
HISTORY = T.StructType(_strings("written_at", "note"))

TIMELINE = T.StructType(
    [
        *_strings("name", "category", "source", "note"),
        T.StructField(
            "tables",
            T.ArrayType(
                T.StructType(
                    [
                        *_strings("title"),
                        T.StructField("columns", T.ArrayType(T.StringType())),
                        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
                        *_strings("note"),
                    ]
                )
            ),
        ),
    ]
)

BAR = T.StructType(
    [
        *_strings("name"),
        T.StructField("busd", T.DoubleType()),
        *_strings("display", "period", "metric", "growth", "detail", "source"),
    ]
)
BAR_BLOCK = T.StructType(
    [*_strings("title", "unit", "note"), T.StructField("bars", T.ArrayType(BAR))]
)
CAPEX_BACKLOG = T.StructType(
    [
        *_strings("updated", "note"),
        T.StructField(
            "tiles",
            T.ArrayType(T.StructType(_strings("label", "value", "delta", "detail", "source"))),
        ),
        T.StructField("capex_bars", BAR_BLOCK),
        T.StructField("backlog_bars", BAR_BLOCK),
        T.StructField(
            "groups",
            T.ArrayType(
                T.StructType(
                    [
                        *_strings("title"),
                        T.StructField(
                            "rows",
                            T.ArrayType(
                                T.StructType(
                                    _strings(
                                        "name", "capex_q", "capex_year", "backlog", "signal",
                                        "source",
                                    )
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
        *_strings("footnote"),
    ]
)
