"""URL filters by a temporal join of captures with dated block lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tiergraph.llm.common import maybe_in, stored

HOST = r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^(?:[^:/?#]+:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    return F.regexp_replace(host, r"\.+$", "")


def lookup_keys(url: Column) -> Column:
    """What a list may name to hit the URL: its host, every parent domain, and the host with
    every leading part of the path (``host/a``, ``host/a/b``)."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")),
    )
    paths = F.when(F.size(parts) > 0, prefixes).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(domains, paths))
    )


def intervals(
    entries: DataFrame,
    pattern_col: str = "pattern",
    date_col: str = "listed_on",
    action_col: str = "action",
    list_col: str = "list",
    path_case: bool = False,
) -> DataFrame:
    """``list``, ``pattern``, ``valid_from``, ``valid_to``: when each pattern is listed.

    An ``add`` opens an interval that the next ``remove`` closes (end exclusive; null
    while open). A second ``add`` or ``remove`` changes nothing; of both on one date the
    removal counts. Patterns are lower-cased; with ``path_case`` only their hosts, for
    paths differ by case. Entries without pattern, date or a known action are ignored. Days
    are collapsed before rows are dealt out, so even a pattern that most entries name
    brings one row a day.
    """
    named = F.trim(F.col(pattern_col))
    host = F.substring_index(named, "/", 1)
    path = F.substring(named, F.length(host) + 1, F.length(named))
    days = (
        entries.select(
            F.col(list_col).alias("list"),
            (F.concat(F.lower(host), path) if path_case else F.lower(named)).alias("pattern"),
            F.col(date_col).alias("day"),
            F.col(action_col).alias("action"),
        )
        .where("pattern <> '' AND day IS NOT NULL AND action IN ('add', 'remove')")
        .groupBy("list", "pattern", "day")
        .agg(F.min(F.col("action") == "add").alias("on"))
    )
    w = W.partitionBy("list", "pattern").orderBy("day")
    changes = (
        days.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False)))
        .where("on <> was")
        .withColumn("until", F.lead("day").over(w))
    )
    return changes.where("on").select(
        "list", "pattern", F.col("day").alias("valid_from"), F.col("until").alias("valid_to")
    )


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched_at",
) -> DataFrame:
    """Judge every capture by the list entries that were active when it was fetched.

    Returns one row per input row: ``id``, ``url``, ``fetched_at``, ``blocked``,
    ``n_active`` (entries that hit), and the most specific of them (longest pattern, then
    first list by name): ``pattern``, ``list``, ``valid_from``. Hosts meet in any case,
    paths in their own.

    The join is as of the fetch: a pattern of a list is one row with the sorted starts and
    ends of its intervals, at most one a day, and a capture takes the last that started
    no later and tests its end. So a capture meets a pattern once, however often that was
    listed. Keys of captures pass a fixed-size filter of all patterns before they are
    joined, so only possible hits are shuffled; the busy key of a large host is a join
    partition that Spark splits. A null URL, a URL without a host and a capture without a time hit
    nothing. Ids may be null or repeated: equal rows get equal results. Other columns
    are not read. Empty lists block nothing, an empty table gives an empty result.
    """
    rows = captures.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at")
    )
    span = F.struct(F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))
    spans = stored(
        intervals(entries, path_case=True)
        .groupBy("list", "pattern")
        .agg(F.sort_array(F.collect_list(span)).alias("spans"))
        .select("list", "pattern", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    )
    keys = rows.where("url IS NOT NULL AND fetched_at IS NOT NULL").distinct().withColumn(
        "pattern", F.explode(lookup_keys(F.col("url")))
    )
    near = maybe_in(keys, spans.select("pattern"), {"pattern": F.col("pattern")}, "_maybe")
    last = F.size(F.filter("starts", lambda s: s <= F.col("fetched_at"))) - 1
    active = F.col("valid_from").isNotNull() & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))
    )
    first = F.min_by(
        F.struct("pattern", "list", "valid_from"),
        F.struct(-F.length("pattern"), "pattern", "list", "valid_from"),
    )
    hits = stored(
        near.where("_maybe").drop("_maybe").join(spans, "pattern")
        .select("id", "url", "fetched_at", "pattern", "list", F.get("starts", last).alias("valid_from"),
                F.get("ends", last).alias("valid_to"))
        .where(active)
        .groupBy("id", "url", "fetched_at")
        .agg(F.count(F.lit(1)).alias("n_active"), first.alias("hit"))
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("id", "url", "fetched_at")]
    return (
        rows.alias("r")
        .join(hits.alias("h"), same[0] & same[1] & same[2], "left")
        .select(
            "r.*",
            F.col("h.n_active").isNotNull().alias("blocked"),
            F.coalesce("h.n_active", F.lit(0)).cast("long").alias("n_active"),
            "h.hit.pattern",
            "h.hit.list",
            "h.hit.valid_from",
        )
    )
