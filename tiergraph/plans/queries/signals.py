"""Queries over company signals: labels, badges, freshness, sentences, timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiergraph.functions import display, labels
from tiergraph.functions import fixed_values as fixed
from tiergraph.functions import text as tx
from tiergraph.operators import graph, signals
from tiergraph.plans import projections as pj
from tiergraph.plans.projections import SIGNALS, with_ctes
from tiergraph.plans.registry import query

# The invented prose holds none of the built-in phrases, so these patterns of the
# same kinds (words, bounded gaps, word borders) stand in for them.
RULES = (
    ("article", r"\bthe (of|and)\b|that.{0,12}tion\b"),
    ("german", r"der [^.;]{0,20}(und|von)\b"),
    ("source", r"src1[0-9]?\b"),
    ("seam", r"\.\s{0,3}src[0-9]{1,2} [a-z]"),
    ("far", r"src1[0-9]? [^0-9]{0,90}src2[0-9]? "),
    ("across", r"src1 [\s\S]*src2 [\s\S]*src3 "),
)


def _rule_list(text: str, rules=RULES) -> str:
    hits = ", ".join(
        f"CASE WHEN bool_or(regexp_matches({text}, '(?i){p}')) THEN '{k}' END" for k, p in rules
    )
    return f"array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',')"


@query(with_ctes(SIGNALS, """
SELECT company, quarter, signal, arg_min(figure, ord) AS figure, arg_min(chain, ord) AS chain,
       min(ord) AS ord FROM signals GROUP BY company, quarter, signal"""))
def dedupe_signals(spark, sf_dir):
    return graph.dedupe_signals(pj.signals(spark, sf_dir))


@query(with_ctes(SIGNALS, """
SELECT ord, strftime(day, '%Y-%m-%d') AS day,
       coalesce(CAST(strftime(day, '%Y%m%d') AS BIGINT), -1) AS date_key,
       day IS NULL OR epoch(TIMESTAMP '2025-01-15 18:00:00' - CAST(day AS TIMESTAMP)) / 86400.0
         > 180 AS stale
FROM dated"""))
def label_date(spark, sf_dir):
    day = labels.label_date(F.col("quarter"))
    now = F.lit("2025-01-15 18:00:00").cast("timestamp_ntz")
    return pj.signals(spark, sf_dir).select(
        "ord",
        F.date_format(day, "yyyy-MM-dd").alias("day"),
        labels.label_date_key(F.col("quarter")).alias("date_key"),
        labels.is_stale(day, now).alias("stale"),
    )


@query(with_ctes(SIGNALS, """
SELECT ord, regexp_matches(quarter, '(?i)Q\\d\\s*FY\\s*\\d{4}') AS earnings,
       regexp_matches(quarter, '\\sQ\\d') AND (
         starts_with(lower(company), lower(trim(regexp_replace(quarter, '\\sQ\\d.*$', ''))))
         OR starts_with(lower(trim(regexp_replace(quarter, '\\sQ\\d.*$', ''))), lower(company)))
         AS own
FROM signals"""))
def own_calls(spark, sf_dir):
    return pj.signals(spark, sf_dir).select(
        "ord",
        labels.earnings_label(F.col("quarter")).alias("earnings"),
        labels.own_call(F.col("company"), F.col("quarter")).alias("own"),
    )


@query(with_ctes(SIGNALS, f"""
SELECT company, {_rule_list("signal || ' ' || figure")} AS badges FROM signals GROUP BY company"""))
def signal_badges(spark, sf_dir):
    found = signals.signal_badges(pj.signals(spark, sf_dir), RULES)
    return found.select("company", F.array_join("badges", ",").alias("badges"))


@query(with_ctes(SIGNALS, """whole AS (
  SELECT company, string_agg(signal || ' ' || figure, ' ' ORDER BY ord) AS t FROM signals
  GROUP BY company)""", f"SELECT company, {_rule_list('t')} AS badges FROM whole GROUP BY company"))
def node_badges(spark, sf_dir):
    found = signals.node_badges(pj.signals(spark, sf_dir), RULES)
    return found.select("company", F.array_join("badges", ",").alias("badges"))


# Halves of the built-in phrases; which ones follow each other depends on an order's lines.
SAID = ("sold", "demand will", "long-term", "raising the", "new", "multi-year", "capacity", "we",
        "increased our", "supply is", "broke", "")
NOTED = ("out", "exceed supply", "agreement", "guidance", "fab", "commitment", "expansion", "full-year",
         "tight", "ground", "; noted")


@query(f"""
WITH said AS (
  SELECT l_orderkey, {", ".join(c for c in pj.LINE_ORDER if c != "l_orderkey")},
         {pj.sql_list(SAID)}[CAST(l_quantity AS BIGINT) % {len(SAID)} + 1] || ' '
           || {pj.sql_list(NOTED)}[l_suppkey % {len(NOTED)} + 1] AS t FROM lineitem),
whole AS (
  SELECT l_orderkey AS "order", string_agg(t, ' ' ORDER BY {", ".join(pj.LINE_ORDER)}) AS t
  FROM said GROUP BY 1)
SELECT "order", {_rule_list('t', fixed.BADGE_RULES)} AS badges FROM whole GROUP BY "order" """)
def order_badges(spark, sf_dir):
    """The built-in badges of every order, read as one text over its lines."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    said = pj.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("company"),
        pick(SAID, F.col("l_quantity").cast("bigint")).alias("signal"),
        pick(NOTED, F.col("l_suppkey")).alias("figure"),
        pj.line_order().alias("ord"),
    )
    named = said.withColumn("company", F.col("company").cast("string"))
    return signals.node_badges(named).select(
        F.col("company").cast("bigint").alias("order"), F.array_join("badges", ",").alias("badges")
    )


@query(with_ctes(SIGNALS, """
SELECT company, strftime(max(day), '%Y-%m-%d') AS last_data FROM dated GROUP BY company"""))
def last_data(spark, sf_dir):
    newest = signals.last_data(pj.signals(spark, sf_dir))
    return newest.select("company", F.date_format("last_data", "yyyy-MM-dd").alias("last_data"))


@query(with_ctes(SIGNALS, """
SELECT company, rank, ord, date_key FROM (
  SELECT *, row_number() OVER (PARTITION BY company ORDER BY date_key DESC, ord) AS rank FROM (
    SELECT *, coalesce(CAST(strftime(day, '%Y%m%d') AS BIGINT), -1) AS date_key FROM dated))
WHERE rank <= 8"""))
def recent_signals(spark, sf_dir):
    top = signals.recent_signals(pj.signals(spark, sf_dir))
    return top.select("company", F.col("rank").cast("bigint").alias("rank"), "ord", "date_key")


@query(r"""
SELECT doc_id, i AS at, s AS sentence FROM (
  SELECT doc_id, unnest(list_filter(list_transform(
           string_split_regex(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)),
           lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))),
         lambda x: length(x) BETWEEN 25 AND 240)) AS s,
         generate_subscripts(list_filter(list_transform(
           string_split_regex(regexp_replace(text, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)),
           lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))),
         lambda x: length(x) BETWEEN 25 AND 240), 1) - 1 AS i
  FROM documents)""")
def sentences(spark, sf_dir):
    docs = pj.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("at", "sentence")
    ).withColumn("at", F.col("at").cast("bigint"))


TOKENS = r"""list_distinct(list_filter(string_split_regex(
  regexp_replace(lower({0}), '[^a-z0-9%. ]', ' ', 'g'), '\s+'), lambda w: length(w) > 2))"""


@query(f"""
WITH t AS (SELECT b.conv_id, b.turn, {TOKENS.format('a.text')} AS x, {TOKENS.format('b.text')} AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(x) AS n_left, len(y) AS n_right,
       round(CASE WHEN len(x) + len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) /
         (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS similarity FROM t""")
def turn_similarity(spark, sf_dir):
    turns = pj.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.token_set(F.col("text")).alias("tokens")
    )
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("x"))
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.size("x").cast("bigint").alias("n_left"),
        F.size("tokens").cast("bigint").alias("n_right"),
        F.round(tx.jaccard(F.col("x"), F.col("tokens")), 6).alias("similarity"),
    )


PERIODS = ("Q{q} {y}", "H{h} {y}", "{h}H {y}", "early {y}", "mid {y}", "late {y}", "FY{y}",
           "end of fiscal {y}", "CY{y}", "{y}", "someday", "Q{q} FY {y}", "exiting {y}", "h{h} {y}")


def _mention_column():
    """Period wordings spread over the events by their property number."""
    k = F.get_json_object("props", "$.k").cast("int")
    number = lambda n, base: (k % n + base).cast("string")
    shapes = []
    for shape in PERIODS:
        text = F.lit(f"ships {shape} at scale")
        for slot, value in (("q", number(4, 1)), ("h", number(2, 1)), ("y", number(9, 2024))):
            text = F.replace(text, F.lit("{" + slot + "}"), value)
        shapes.append(text)
    return F.element_at(F.array(*shapes), (F.col("event_id") % len(PERIODS) + 1).cast("int"))


@query(f"""
WITH said AS (
  SELECT event_id, 'ships ' || replace(replace(replace(
    {pj.sql_list(PERIODS)}[event_id % {len(PERIODS)} + 1],
    '{{q}}', CAST(k % 4 + 1 AS VARCHAR)), '{{h}}', CAST(k % 2 + 1 AS VARCHAR)),
    '{{y}}', CAST(k % 9 + 2024 AS VARCHAR)) || ' at scale' AS t
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
found AS (SELECT event_id, nullif(regexp_extract(t, '{fixed.PERIOD}', 1), '') AS mention FROM said)
SELECT event_id, mention, CASE WHEN mention IS NULL THEN NULL
  WHEN NOT regexp_matches(mention, '20\\d\\d') THEN 99999
  ELSE CAST(regexp_extract(mention, '20\\d\\d') AS BIGINT) * 10 + CASE
    WHEN regexp_matches(mention, '(?i)Q[1-4]')
      THEN CAST(regexp_extract(mention, '(?i)Q([1-4])', 1) AS INTEGER) * 2
    WHEN regexp_matches(mention, '[12]H|H[12]')
      THEN CAST(replace(regexp_extract(mention, '[12]H|H[12]'), 'H', '') AS INTEGER) * 4
    WHEN regexp_matches(mention, '(?i)late|end|exiting|H2') THEN 8
    WHEN regexp_matches(mention, '(?i)mid') THEN 5
    WHEN regexp_matches(mention, '(?i)early|H1') THEN 2 ELSE 0 END END AS key
FROM found""")
def period_keys(spark, sf_dir):
    said = pj.table(spark, sf_dir, "events").withColumn("t", _mention_column())
    mention = labels.period_mention(F.col("t"))
    return said.select("event_id", mention.alias("mention")).withColumn(
        "key", F.when(F.col("mention").isNotNull(), labels.period_key(F.col("mention")))
    )


def dated_prose(spark, sf_dir):
    """Signals whose every sentence names a period, so that all of them are dated."""
    sig = pj.signals(spark, sf_dir)
    year = (F.col("ord") % 3 + 2025).cast("string")
    quarter = (F.col("ord") % 4 + 1).cast("string")
    stamp = F.concat(F.lit(" in Q"), quarter, F.lit(" "), year, F.lit("."))
    return sig.withColumn("signal", F.replace("signal", F.lit("."), stamp))


@query(with_ctes(SIGNALS, r"""
stamped AS (
  SELECT company, ord, string_split_regex(regexp_replace(
    replace(signal, '.', ' in Q' || (ord % 4 + 1) || ' ' || (ord % 3 + 2025) || '.'),
    '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM signals),
bits AS (
  SELECT company, ord, generate_subscripts(l, 1) - 1 AS pos,
         trim(unnest(l), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM stamped),
told AS (
  SELECT company, ord, pos, t, length(t) AS units, regexp_extract(t, '20\d\d') AS year,
         regexp_extract(t, 'Q[1-4] 20\d\d|20\d\d') AS mention,
         """ + TOKENS.format("t") + r""" AS tokens
  FROM bits WHERE length(t) BETWEEN 25 AND 240 AND regexp_matches(t, '\b(Q[1-4] 20\d\d|20\d\d)\b')),
grouped AS (
  SELECT company, year, list({'ord': ord, 'pos': pos, 't': t, 'units': units, 'mention': mention,
                              'tokens': tokens} ORDER BY ord, pos) AS said
  FROM told GROUP BY company, year),
merged AS (
  SELECT company, unnest(list_reduce(said[2:], lambda kept, x:
    CASE WHEN len(list_filter(kept, lambda f: len(list_intersect(f.tokens, x.tokens))
              / (len(f.tokens) + len(x.tokens) - len(list_intersect(f.tokens, x.tokens))) >= 0.6)) = 0
    THEN list_append(kept, x)
    ELSE list_transform(kept, lambda f, i: CASE
      WHEN x.units > f.units AND i = list_position(list_transform(kept, lambda g:
             len(list_intersect(g.tokens, x.tokens))
             / (len(g.tokens) + len(x.tokens) - len(list_intersect(g.tokens, x.tokens))) >= 0.6), true)
      THEN {'ord': f.ord, 'pos': f.pos, 't': x.t, 'units': x.units, 'mention': x.mention,
            'tokens': x.tokens}
      ELSE f END) END, said[1:1])) AS f FROM grouped),
keyed AS (
  SELECT company, f.ord AS ord, f.pos AS pos, f.t AS t, f.mention AS mention,
         CAST(regexp_extract(f.mention, '20\d\d') AS BIGINT) * 10
           + coalesce(CAST(nullif(regexp_extract(f.mention, 'Q([1-4])', 1), '') AS INTEGER) * 2, 0)
           AS key FROM merged),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY company ORDER BY key, ord, pos) AS rank FROM keyed)""", """
SELECT company, rank, mention AS "when", key, t AS text FROM ranked WHERE rank <= 10"""))
def company_timeline(spark, sf_dir):
    """All sentences carry one kind of period, so the SQL needs only that kind."""
    top = signals.company_timeline(dated_prose(spark, sf_dir))
    return top.select("company", "rank", "when", "key", "text")


@query(with_ctes(SIGNALS, """
stamped AS (
  SELECT company, ord, replace(signal, '.', ' in Q' || (ord % 4 + 1) || ' ' || (ord % 3 + 2025)
    || '.') AS s FROM signals)""", r"""
SELECT company, ord, count(*) AS n, sum(length(x)) AS chars FROM (
  SELECT company, ord, unnest(list_filter(list_transform(
           string_split_regex(regexp_replace(s, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)),
           lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))),
         lambda x: length(x) BETWEEN 25 AND 240)) AS x FROM stamped)
WHERE regexp_matches(x, '\b(Q[1-4] 20\d\d|20\d\d)\b') GROUP BY company, ord"""))
def dated_sentences(spark, sf_dir):
    found = signals.dated_sentences(dated_prose(spark, sf_dir))
    return found.groupBy("company", "ord").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("chars")
    )


@query(with_ctes(SIGNALS, """
SELECT ord, CASE WHEN figure IN ('src1', 'src2', '') THEN NULL ELSE figure END AS figure,
       replace(chain || '_' || figure, '_', ' ') AS label FROM signals"""))
def figures_and_labels(spark, sf_dir):
    held = F.when(F.col("figure").isin("src1", "src2"), "no specific figure").otherwise(
        F.col("figure")
    )
    return pj.signals(spark, sf_dir).select(
        "ord",
        display.figure_or_null(held).alias("figure"),
        display.slug_label(F.concat_ws("_", "chain", "figure")).alias("label"),
    )
