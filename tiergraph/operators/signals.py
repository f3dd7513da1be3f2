"""Badges, freshness, recent signals and the company timeline."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.functions import labels
from tiergraph.functions import fixed_values as fixed
from tiergraph.functions import text as tx
from tiergraph.functions.automata import SHORT_PIECE, Automaton, Summary
from tiergraph.operators.facts import link_groups, merge_facts
from tiergraph.operators.components import connected
from tiergraph.operators.ordering import first_rows
from tiergraph.session import cut

Rules = Sequence[tuple[str, str]]
#: Steps of composing summaries that a task remembers.
MOST_STEPS = 200_000
#: Sentences of a company and year that one task links; larger groups are joined by token.
MOST_GROUP_ROWS = 50_000


def _spoken() -> Column:
    blank = F.lit("")
    return F.concat(F.coalesce("signal", blank), F.lit(" "), F.coalesce("figure", blank))


def _hits(text: Column, rules: Rules) -> list[Column]:
    return [
        F.bool_or(text.rlike(f"(?i){tx.ascii_borders(pattern)}")).alias(f"_b{i}")
        for i, (_, pattern) in enumerate(rules)
    ]


def _as_list(flags: DataFrame, rules: Rules) -> DataFrame:
    found = F.array(*[F.when(F.col(f"_b{i}"), F.lit(key)) for i, (key, _) in enumerate(rules)])
    return flags.select("company", F.array_compact(found).alias("badges"))


def signal_badges(signals: DataFrame, rules: Rules = fixed.BADGE_RULES) -> DataFrame:
    """Badges that any single signal with its figure earns, in rule order."""
    return _as_list(signals.groupBy("company").agg(*_hits(_spoken(), rules)), rules)


def node_badges(signals: DataFrame, rules: Rules = fixed.BADGE_RULES) -> DataFrame:
    """Badges of a company's signals read as one text in order.

    A match may run across any number of signals and have any length. Every signal is
    summed up as what it does to the automaton of each rule; the summaries of a range of
    signals compose inside its task, and only those of companies at the ends of ranges are
    put together after one small shuffle. Texts are never put together, and a company may fill many ranges.
    """
    patterns = [pattern for _, pattern in rules]
    for pattern in patterns:
        Automaton(pattern)  # refuses what cannot be read in pieces

    keys = [key for key, _ in rules]

    def of_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Compose the summaries of neighbouring rows of one company, in the order they come.

        Only a range's first and last company may go on elsewhere and keep their summaries.
        """
        machines = [Automaton(p) for p in patterns]
        memory: dict[tuple, tuple[Summary, ...]] = {}
        kept: dict[tuple, tuple[Summary, ...]] = {}

        def moved(so_far: tuple[Summary, ...] | None, text: str) -> tuple[Summary, ...]:
            step = (opening if so_far is None else id(so_far), text)
            found = memory.get(step)
            if found is None:
                here = [m.summary(text) for m in machines]
                if so_far is None:
                    found = tuple(here if opening else [s.opened() for s in here])
                else:
                    found = tuple(a.then(b) for a, b in zip(so_far, here))
                if len(text) <= SHORT_PIECE and (so_far is None or id(so_far) in known):
                    if len(memory) > MOST_STEPS:
                        memory.clear(), kept.clear(), known.clear()
                    else:
                        # Equal summaries are one object, which lives as long as it is remembered.
                        found = kept.setdefault(tuple(s.dump() for s in found), found)
                        known.add(id(found))
                        memory[step] = found
            return found

        known: set[int] = set()
        company, first, so_far, opening = None, 0, None, True
        columns = ["company", "at", "badges", "parts"]

        def row(ends: bool) -> tuple:
            if ends or opening:
                return company, first, None, [s.dump() for s in so_far]
            return company, first, [key for key, s in zip(keys, so_far) if s.tail_found], None

        for batch in batches:
            out = []
            for name, at, text in zip(batch["company"], batch["at"], batch["text"]):
                if so_far is not None and name == company:
                    so_far = moved(so_far, text)
                    continue
                if so_far is not None:
                    out.append(row(False))
                    opening = False
                company, first, so_far = name, at, moved(None, text)
            yield pd.DataFrame(out, columns=columns)
        if so_far is not None:
            yield pd.DataFrame([row(True)], columns=columns)

    def of_companies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        company, so_far = None, None
        found = lambda: (company, [key for key, s in zip(keys, so_far) if s.tail_found])
        for batch in batches:
            out = []
            for name, parts in zip(batch["company"], batch["parts"]):
                here = [Summary.load(p) for p in parts]
                if so_far is not None and name == company:
                    so_far = [a.then(b) for a, b in zip(so_far, here)]
                    continue
                if so_far is not None:
                    out.append(found())
                company, so_far = name, here
            yield pd.DataFrame(out, columns=["company", "badges"])
        if so_far is not None:
            yield pd.DataFrame([found()], columns=["company", "badges"])

    ranges = cut(
        signals.select("company", "ord", _spoken().alias("text"))
        .repartitionByRange("company", "ord")
        .sortWithinPartitions("company", "ord")
        .select("company", F.monotonically_increasing_id().alias("at"), "text")
        .mapInPandas(of_ranges, "company string, at long, badges array<string>, parts array<string>")
    )
    # At most two rows a range.
    open_ended = (
        ranges.filter(F.col("parts").isNotNull()).select("company", "at", "parts")
        .repartition("company")
        .sortWithinPartitions("company", "at")
        .mapInPandas(of_companies, "company string, badges array<string>")
    )
    return ranges.filter(F.col("parts").isNull()).select("company", "badges").unionByName(open_ended)


def last_data(signals: DataFrame) -> DataFrame:
    """Newest label date of every company."""
    return signals.groupBy("company").agg(
        F.max(labels.label_date(F.col("quarter"))).alias("last_data")
    )


def recent_signals(signals: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` newest signals per company, undated ones last, ties in order."""
    keyed = signals.withColumn("date_key", labels.label_date_key(F.col("quarter")))
    return first_rows(keyed, ["company"], [F.col("date_key").desc(), F.col("ord")], k)


def dated_sentences(signals: DataFrame) -> DataFrame:
    """Sentences that mention a period, with period, year, tokens and place.

    Cheap tests come first: the length, then any year at all (every period names
    one), and only then the period pattern.
    """
    pieces = signals.select(
        "company", "ord",
        F.posexplode(tx.split_sentences(F.coalesce("signal", F.lit("")))).alias("at", "_piece"),
    )
    year = lambda c: F.nullif(F.regexp_extract(c, r"20\d\d", 0), F.lit(""))
    return (
        pieces.select("company", "ord", "at", tx.trimmed(F.col("_piece")).alias("text"))
        .withColumn("units", tx.utf16_length(F.col("text")))
        .filter(tx.sentence_sized(F.col("units")) & F.col("text").rlike(r"20\d\d"))
        .withColumn("when", labels.period_mention(F.col("text")))
        .filter(F.col("when").isNotNull())
        .withColumn("year", F.coalesce(year(F.col("text")), year(F.col("when"))))
        .withColumn("tokens", tx.token_set(F.col("text")))
        .withColumn("place", F.struct("ord", "at"))
    )


def merged_facts(
    sentences: DataFrame,
    similarity: float = fixed.DUPLICATE_SIMILARITY,
    most_rows: int = MOST_GROUP_ROWS,
) -> DataFrame:
    """Greedy near-duplicate merge of dated sentences in order.

    A sentence joins the first kept fact of the same company and year whose
    current wording shares enough tokens; the longer wording stays and decides
    later comparisons. A kept fact always carries the wording of some sentence, so
    only sentences whose own wordings are alike, or linked by a chain of such, can
    meet: each connected component of alike wordings is replayed by itself, as a
    stream sorted by place whose memory holds the distinct facts.

    Groups of at most ``most_rows`` sentences meet in one task, which links them; larger ones
    are joined by token. A sentence that is alike to no other is a fact and moves no further.
    """
    group = ["company", "year"]
    rows = cut(sentences.select(
        *group, "when", "text", "units", F.array_join("tokens", " ").alias("tokens"), "place"
    ))
    # At most one group for every most_rows sentences.
    large = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_rows).select(
        F.col("company").alias("_company"), F.col("year").alias("_year")
    ))
    small, any_large = rows, not large.isEmpty()
    inside = F.col("company").eqNullSafe(F.col("_company")) & F.col("year").eqNullSafe(F.col("_year"))
    if any_large:
        small = rows.join(F.broadcast(large), inside, "left_anti")
    schema = T.StructType([*rows.schema.fields, T.StructField("component", T.LongType())])
    placed = cut(
        small.repartition(*group).sortWithinPartitions(*group)
        .mapInArrow(lambda it: link_groups(it, similarity), schema)
    )
    if any_large:
        wording = F.xxhash64("company", "year", F.array_sort("words")).alias("wording")
        worded = (
            rows.join(F.broadcast(large), inside, "left_semi")
            .withColumn("words", F.filter(F.split("tokens", " "), lambda t: t != ""))
            .select("*", wording)
        )
        components = connected(alike_wordings(worded.drop("tokens").withColumnRenamed("words", "tokens"), similarity))
        placed = placed.unionByName(
            worded.join(components, "wording", "left")
            .withColumn("component", F.coalesce("component", "wording")).select(*placed.columns)
        )
    columns = ["company", "year", "when", "text", "units", "place"]
    keys = [*group, "component"]
    stream = placed.filter(F.col("component").isNotNull()).repartition(*keys).sortWithinPartitions(*keys, "place")
    merged = stream.mapInPandas(
        lambda it: merge_facts(it, similarity, columns), T.StructType([rows.schema[c] for c in columns])
    )
    return placed.filter(F.col("component").isNull()).select(*columns).unionByName(merged)


def alike_wordings(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different wordings of a company and year that share enough tokens.

    Two alike sets share one of their rarest tokens: of n tokens in a common order the
    first ``n - ceil(similarity * n) + 1`` are enough, so only those are joined.
    """
    # Hashes stand for tokens; equal ones would only put more sentences into one component.
    sets = cut(rows.groupBy("wording").agg(
        F.first("company").alias("company"), F.first("year").alias("year"),
        F.transform(F.first("tokens"), lambda t: F.xxhash64(t)).alias("tokens"),
    ))
    each = sets.select("wording", F.explode("tokens").alias("token"))
    ranks = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(ranks, "token").groupBy("wording").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked")
    )
    size = F.size("ranked")
    # A hair less than exact keeps rounding from shortening the prefix.
    prefix = F.slice("ranked", 1, (size - F.ceil(size * similarity - 1e-9) + 1).cast("int"))
    # Nulls belong together; groups that share a hash would only put more sentences into one component.
    firsts = sets.join(ordered, "wording").select(
        F.xxhash64("company", "year").alias("group"), "wording", "tokens", F.explode(prefix).alias("p")
    ).withColumn("token", F.col("p.token")).drop("p")
    left = firsts.select("group", "token", F.col("wording").alias("a"), F.col("tokens").alias("ta"))
    right = firsts.select("group", "token", F.col("wording").alias("b"), F.col("tokens").alias("tb"))
    small, large = F.least(F.size("ta"), F.size("tb")), F.greatest(F.size("ta"), F.size("tb"))
    return (
        left.join(right, ["group", "token"])
        .filter((F.col("a") < F.col("b")) & (small >= large * similarity - 1e-9))
        .filter(tx.jaccard(F.col("ta"), F.col("tb")) >= similarity)
        .select("a", "b")
        .distinct()
    )


def company_timeline(signals: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` facts of every company by period, ties in order."""
    keyed = merged_facts(dated_sentences(signals)).withColumn(
        "key", labels.period_key(F.col("when"))
    )
    ranked = first_rows(keyed, ["company"], [F.col("key"), F.col("place")], k)
    return ranked.select("company", "rank", "when", "key", "text")
