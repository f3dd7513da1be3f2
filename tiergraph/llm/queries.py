"""The corpus operators applied to the whole synthetic tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergraph.llm import (
    chat,
    decontaminate,
    exact_dedup,
    hard_negatives,
    html_extract,
    jaccard_join,
    line_dedup,
    lm_score,
    pack,
    quality,
    shard,
    token_align,
    url_filter,
)
from tiergraph.llm.common import stored, table
from tiergraph.plans.registry import Query

QUERIES: dict[str, Query] = {}

LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


@query(f"""
    WITH t AS (SELECT doc_id, {LOWERED.format('text')} AS txt FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(txt) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY txt)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), hash_all=True)
    return groups.withColumnsRenamed({"id": "doc_id", "full_hash": "text_sha256"})


WORDS = f"regexp_extract_all({LOWERED.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


@query(f"""
    WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(len(w), 13) AS m FROM items WHERE len(w) > 0),
    wins AS (
        SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
        FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
    docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
    spots AS (
        SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
              FROM docs, (SELECT DISTINCT m FROM sized))),
    found AS (SELECT doc_id, item_id, i, m FROM spots JOIN wins USING (m, win)),
    hits AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
    names AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack.pack(table(spark, sf_dir, "documents"))
    return packed.withColumnsRenamed({"id": "doc_id", "length": "n_chars"})


@query(f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all({LOWERED.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
              FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
        FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
    r AS (
        SELECT doc_id AS x, doc_id AS y FROM d
        UNION SELECT r.x, links.y FROM r JOIN links ON r.y = links.x)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
""")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.near_groups(table(spark, sf_dir, "documents"))
    return groups.withColumnsRenamed({"id": "doc_id", "component": "component_id"})


@query()
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"),
        quality.held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.GOOD, 1).otherwise(0).alias("predicted"),
        "passage",
        "attention",
    )


@query()
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"))
    text = F.array_join("blocks", "\n")
    return pages.select(
        F.col("id").alias("page_id"),
        "url",
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
    )


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:03d}" for i in range(256)]
    return shard.place(table(spark, sf_dir, "documents"), shards).withColumnRenamed("id", "doc_id")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query(rf"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
        UNION ALL SELECT -7, t, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
    marked AS (
        SELECT *,
            CASE role WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '<s> '
                WHEN 'system' THEN '<<SYS>> ' ELSE '[ROLE] ' || role || ' [/ROLE][TEXT] ' END AS o,
            CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN ' </s>'
                WHEN 'system' THEN ' <</SYS>>' ELSE ' [/TEXT]' END AS c,
            regexp_replace(regexp_replace(txt, '\[(\\*/?(?:INST|ROLE|TEXT)\])', '[\\\1', 'g'),
                '<(\\*(?:/?s>|</?SYS>>))', '<\\\1', 'g') AS esc,
            regexp_matches(txt, '\[\\+/?(?:INST|ROLE|TEXT)\]|<\\+(?:/?s>|</?SYS>>)') AS looks
        FROM rows),
    placed AS (
        SELECT *, length(o) + length(c) + length(CASE
            WHEN looks OR strpos(txt || c, c) <> length(txt) + 1 THEN esc ELSE txt END) AS size
        FROM marked)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
        CAST(coalesce(sum(length(txt)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(txt, '' ORDER BY turn, txt) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(size) AS BIGINT) AS formatted_chars
    FROM placed GROUP BY conv_id
""")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    chats = chat.format_chats(rows.unionByName(control))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return chats.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _number(text: Column, most: int) -> Column:
    """A fixed pseudo-random number below ``most``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int") % most


def dated_entries(spark: SparkSession, sf_dir: str):
    """Block lists with dates, derived from the hosts and sections of the pages.

    A third of all hosts is listed for some weeks, some again later; a quarter of all
    sections (host and first part of the path) on a second list. Captures get a day of
    the year 2024 by their id.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = url_filter.host_of(F.col("url"))
    section = F.regexp_extract("url", r"//[^/?#]*/([^/?#]+)", 1)
    named = pages.select(F.lit("hosts").alias("list"), host.alias("pattern")).unionByName(
        pages.where(section != "").select(
            F.lit("sections").alias("list"), F.concat(host, F.lit("/"), section).alias("pattern")
        )
    ).where("pattern <> ''").distinct()
    n = _number(F.col("pattern"), 1 << 24)
    chosen = named.where(
        F.when(F.col("list") == "hosts", n % 3 == 0).otherwise(n % 4 == 0)
    ).withColumn("n", n)
    start = F.lit("2024-01-01").cast("date")
    first = F.date_add(start, F.col("n") % 200)
    events = F.array(
        F.struct(first.alias("listed_on"), F.lit("add").alias("action")),
        F.struct(F.date_add(first, 30 + F.col("n") % 90).alias("listed_on"), F.lit("remove").alias("action")),
        F.when(F.col("n") % 5 == 0, F.struct(
            F.date_add(first, 150).alias("listed_on"), F.lit("add").alias("action"))),
    )
    entries = chosen.select("list", "pattern", F.inline(F.filter(events, lambda e: e.isNotNull())))
    captures = pages.withColumn("fetched_at", F.date_add(start, (F.col("page_id") % 366).cast("int")))
    return captures, entries


@query(r"""
    WITH p AS (
        SELECT page_id, url, lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host,
               regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path,
               regexp_extract(url, '//[^/?#]*/([^/?#]+)', 1) AS section,
               DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched_at
        FROM pages),
    named AS (
        SELECT DISTINCT 'hosts' AS list, host AS pattern FROM p WHERE host <> ''
        UNION SELECT DISTINCT 'sections', host || '/' || section FROM p WHERE section <> '' AND host <> ''),
    numbered AS (SELECT *, CAST('0x' || substr(md5(pattern), 1, 6) AS INT) AS n FROM named),
    chosen AS (
        SELECT *, DATE '2024-01-01' + n % 200 AS day FROM numbered
        WHERE CASE list WHEN 'hosts' THEN n % 3 = 0 ELSE n % 4 = 0 END),
    spans AS (
        SELECT list, pattern, day AS a, day + (30 + n % 90) AS b FROM chosen
        UNION ALL SELECT list, pattern, day + 150, NULL FROM chosen WHERE n % 5 = 0),
    labels AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM p),
    keys AS (
        SELECT page_id, array_to_string(l[i:], '.') AS pattern
        FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels)
        UNION SELECT page_id, host || '/' || array_to_string(s[1:i], '/')
        FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM labels)),
    hits AS (
        SELECT page_id, pattern, list, a, row_number() OVER w AS rank, count(*) OVER (PARTITION BY page_id) AS n
        FROM keys JOIN spans USING (pattern) JOIN p USING (page_id)
        WHERE fetched_at >= a AND (b IS NULL OR fetched_at < b)
        WINDOW w AS (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern, list, a))
    SELECT p.page_id, p.url, p.fetched_at, h.n IS NOT NULL AS blocked, coalesce(h.n, 0) AS n_active,
           h.pattern, h.list, h.a AS valid_from
    FROM p LEFT JOIN hits h ON h.page_id = p.page_id AND h.rank = 1
""")
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = dated_entries(spark, sf_dir)
    return url_filter.filter_urls(captures, entries).withColumnRenamed("id", "page_id")


@query()
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, rates = lm_score.fit(table(spark, sf_dir, "conversations"), docs)
    return lm_score.score(docs, model, rates).withColumnRenamed("id", "doc_id")


@query("""
    WITH raw AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
    q AS (
        SELECT id, label, list_transform(v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM raw WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(
            range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
        FROM q a JOIN q b ON a.id % 50 = 0 AND a.id <> b.id),
    positives AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w AS rank, other AS negative_id, positive_score,
           score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
    QUALIFY row_number() OVER w <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = token_align.align(table(spark, sf_dir, "documents"))
    aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups"))
    counts = stored(token_align.link_counts(aligned, token_align.link_size()))
    # Every common end closes one group and links the two tokens that end there.
    rows = token_align.scored(aligned, counts).withColumn("n_links", F.col("n_groups"))
    return rows.withColumnRenamed("id", "doc_id")


LINE_KEY = """translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


@query(f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (
        SELECT r, i, line, {LINE_KEY} AS key
        FROM (SELECT r, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d)),
    shared AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
    kept AS (
        SELECT r, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n
        FROM lines ANTI JOIN shared USING (key) GROUP BY r)
    SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)
""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
