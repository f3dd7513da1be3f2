"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm.common import slices, stored

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q "
    "ruby rb rp rt s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary "
    "table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NOISE_TAGS = frozenset(
    "head nav footer header aside form button select menu dialog object applet audio video canvas "
    "map frameset".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar".split()
)
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion "
    "banner nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside "
    "rail widget cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus respond reply replies "
    "discussion share sharing social related recommended pagination pager toolbar copyright legal "
    "disclaimer skip".split()
)
#: Parts of a compound name that only say a noise name holds something, or belongs to something else.
CONTAINERS = frozenset(
    "area bar block blocks body box button buttons container content group icons inner item items "
    "link links list outer panel section slot text title top bottom unit wrap wrapper".split()
)
OTHERS = frozenset("has with without no not is cat category categories tag tags type format topic".split())
MAIN_TAGS = frozenset(["article", "main"])
MAIN_NAMES = frozenset(
    "article-body articlebody article-content article-text post-body post-content entry-content "
    "story-body main-content page-content content-body maincontent".split()
)
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

#: Weight of a node's own presentation falls by this factor with its number of children.
DAMPING = 0.9
#: A branch is noise below this importance, on sites with enough pages to tell.
LEAST_IMPORTANCE, LEAST_PAGES, DIVERSE = 0.2, 8, 0.5

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*)>",
    re.S,
)
#: The next attribute, name and value; quoted text without a name is passed over.
ATTR = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
ATTRS = frozenset("class id role itemprop hidden aria-hidden".split())
DIGITS = re.compile(r"\d+")
NAME = re.compile(r"[a-z]+")


def noise_name(word: str) -> bool:
    """Whether a class or id declares noise: it is a noise name, ends in one, or is one with words for
    its box (``ad-slot``); what a page has or is filed under (``has-nav``) and modifiers do not."""
    parts = NAME.findall(word.split("--")[0])
    if not parts or not OTHERS.isdisjoint(parts[:-1]):
        return False
    return parts[-1] in NOISE_NAMES or parts[0] in NOISE_NAMES and CONTAINERS.issuperset(parts[1:])


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Element:
    __slots__ = ("tag", "path", "noise", "main", "branch", "kids", "named")

    def __init__(
        self, tag: str, path: str, noise: bool, main: bool, branch: tuple[str, ...], named: int | None = None
    ) -> None:
        self.tag, self.path, self.noise, self.main, self.branch = tag, path, noise, main, branch
        #: Where the element begins if a class or id declares it as noise.
        self.named = named
        self.kids: list[str] = []


class Page:
    """One pass over a page: its blocks of text with the branches they hang on.

    ``blocks`` holds (text, inside a main element, removable branches); ``nodes`` the
    site-tree nodes of the page: path to [styles of its occurrences, texts below].
    Elements that HTML or their names declare as navigation, advert, form and the like
    have no importance and do not enter the tree. End tags may be missing, and a page
    may break off anywhere.

    Class and id names never declare a main element or what is around it as noise: such
    elements are added to ``spared`` (by where they begin), for a second pass. Articles
    inside of an article are its comments or teasers and spare nothing.
    """

    def __init__(self, source: str, spared: frozenset[int] = frozenset()) -> None:
        self.known, self.spared = spared, set(spared)
        self.blocks: list[tuple[str, bool, tuple[str, ...]]] = []
        self.nodes: dict[str, tuple[list[str], set[str]]] = {}
        self.stack = [_Element("", "", False, False, ())]
        self.words: list[str] = []
        at = 0
        while True:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(tag)
                continue
            self._open(tag, m["attrs"], m.start())
            if tag in RAW and not m["attrs"].endswith("/"):
                ends = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = ends.end() if ends else len(source)
                self._close(tag)
        self._flush()
        while len(self.stack) > 1:
            self._leave()
        for texts, _, branch in self.blocks:
            for path in branch:
                self.nodes[path][1].add(texts)

    def _text(self, raw: str) -> None:
        if raw and not self.stack[-1].noise:
            self.words.append(raw)

    def _flush(self) -> None:
        if self.words:
            text = " ".join(html.unescape("".join(self.words)).split())
            self.words = []
            if text:
                top = self.stack[-1]
                self.blocks.append((text, top.main, top.branch))

    def _open(self, tag: str, attrs: str, at: int) -> None:
        noise, main, name, doubtful = self._named(attrs)
        if tag in INLINE:
            if not (noise or doubtful and at not in self.known):
                return
        elif tag in ("br", "wbr", "img"):
            self.words.append(" " if tag == "br" else "")
            return
        else:
            self._flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close_within({"p"}, {"table", "td", "th", "button"})
        if tag in SIBLINGS:
            self._close_within(*SIBLINGS[tag])
        top = self.stack[-1]
        inside_main = top.main
        named = at if doubtful else None
        if tag in MAIN_TAGS and all(e.tag != "article" for e in self.stack) or main and not inside_main:
            self.spared.update(e.named for e in self.stack if e.named is not None)
            if doubtful:
                self.spared.add(at)
        noise = noise or doubtful and at not in self.known
        # Inside the main text a header is its heading, not the site's.
        noise = noise or tag in RAW or (tag in NOISE_TAGS and not (tag == "header" and inside_main))
        noise = top.noise or noise and tag not in ("html", "body")
        key = tag + (f".{name}" if name else "")
        path = f"{top.path}>{key}"
        top.kids.append(key)
        branch = top.branch if noise or (tag in RUNNING and inside_main) else (*top.branch, path)
        self.stack.append(
            _Element(tag, path, noise, inside_main or tag in MAIN_TAGS or main, branch, named)
        )

    def _named(self, attrs: str) -> tuple[bool, bool, str, bool]:
        """Noise by its attributes, main by its attributes, the class for the path, noise by class or id."""
        if not attrs or attrs.isspace():
            return False, False, "", False
        noise, main, name, doubtful = False, False, "", False
        seen: set[str] = set()
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.lower()
            # Of a repeated attribute the first counts.
            if key not in ATTRS or key in seen:
                continue
            seen.add(key)
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            value = value.strip()
            if key == "role":
                noise, main = noise or value in NOISE_ROLES, main or value == "main"
            elif key == "itemprop":
                main, noise = main or value == "articlebody", noise or value == "comment"
            elif key == "hidden":
                noise = True
            elif key == "aria-hidden":
                noise = noise or value == "true"
            else:
                for word in value.split():
                    main = main or word in MAIN_NAMES
                    doubtful = doubtful or noise_name(word)
                if key == "class" or not name:
                    name = DIGITS.sub("0", value)[:60]
        return noise, main, name, doubtful and not main

    def _close_within(self, tags: set[str], stops: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in stops:
                return
            if tag in tags:
                while len(self.stack) > i:
                    self._leave()
                return

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if tag not in INLINE:
                    self._flush()
                while len(self.stack) > i:
                    self._leave()
                return
        if tag not in INLINE and tag not in VOID:
            self._flush()

    def _leave(self) -> None:
        if self.stack[-1].noise or self.stack[-1].tag not in INLINE:
            self._flush()
        gone = self.stack.pop()
        if gone.branch and gone.branch[-1] == gone.path:
            style = ",".join(k for i, k in enumerate(gone.kids) if not i or k != gone.kids[i - 1])
            self.nodes.setdefault(gone.path, ([], set()))[0].append(style)


def parsed(source: str | None) -> tuple[list[dict], list[dict]]:
    """Candidate blocks and site-tree nodes of a page as plain rows."""
    page = Page(source or "")
    if page.spared:
        page = Page(source or "", frozenset(page.spared))
    has_main = any(main for _, main, _ in page.blocks)
    known: dict[str, int] = {}

    def hashed(text: str) -> int:
        if text not in known:
            known[text] = _hash(text)
        return known[text]

    blocks = [
        {"text": text, "branch": [hashed(p) for p in branch]}
        for text, main, branch in page.blocks
        if main or not has_main
    ]
    nodes = [
        {
            "path": hashed(path),
            "style": hashed("|".join(sorted(set(styles)))),
            "kids": max(s.count(",") + 1 if s else 0 for s in styles),
            "texts": sorted(hashed(t) for t in texts),
        }
        for path, (styles, texts) in page.nodes.items()
    ]
    return blocks, nodes


BLOCKS = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("branch", T.ArrayType(T.LongType())),
]))
NODES = T.ArrayType(T.StructType([
    T.StructField("path", T.LongType()), T.StructField("style", T.LongType()),
    T.StructField("kids", T.LongType()), T.StructField("texts", T.ArrayType(T.LongType())),
]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.list_(pa.struct([("text", pa.string()), ("branch", pa.list_(pa.int64()))]))
    node = pa.list_(pa.struct([
        ("path", pa.int64()), ("style", pa.int64()), ("kids", pa.int64()),
        ("texts", pa.list_(pa.int64())),
    ]))
    for batch in batches:
        for part in slices(batch, "html"):
            rows = [parsed(x) for x in part["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "id": part["id"], "url": part["url"],
                "blocks": pa.array([r[0] for r in rows], block),
                "nodes": pa.array([r[1] for r in rows], node),
            })


def branch_importance(pages: DataFrame) -> DataFrame:
    """Importance of every branch of every site: ``host``, ``path``, ``pages``, ``importance``.

    A branch that occurs on m pages is presented in styles (sequences of children) whose
    entropy to the base m is 0 if all pages agree and 1 if none do. A text below it that
    k pages carry has the entropy log_m k; one minus their mean is the importance of the
    content. The importance of a branch weighs both by its number of children. Sums are
    formed before rows are shuffled, so a site with most of the pages is no large group.
    """
    nodes = pages.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    styles = nodes.groupBy("host", "path", "style").agg(
        F.count(F.lit(1)).alias("c"), F.max("kids").alias("kids")
    )
    shown = styles.groupBy("host", "path").agg(
        F.sum("c").alias("pages"),
        F.sum(F.col("c") * F.log("c")).alias("clogc"),
        F.max("kids").alias("kids"),
    )
    texts = nodes.select("host", "path", F.explode("texts").alias("t")).groupBy("host", "path", "t").count()
    shared = texts.groupBy("host", "path").agg(F.avg(F.log("count")).alias("logk"))
    m = F.greatest(F.log("pages"), F.lit(1e-9))
    style = F.when(F.col("pages") > 1, (F.log("pages") - F.col("clogc") / F.col("pages")) / m).otherwise(1.0)
    content = 1 - F.coalesce(F.col("logk"), F.lit(0.0)) / m
    damp = F.pow(F.lit(DAMPING), "kids")
    return shown.join(shared, ["host", "path"], "left").select(
        "host", "path", "pages",
        ((1 - damp) * style + damp * F.when(F.col("pages") > 1, content).otherwise(1.0)).alias("importance"),
        F.when(F.col("pages") > 1, content).otherwise(1.0).alias("content"),
    )


def _distinct_pages(parsed_pages: DataFrame) -> DataFrame:
    """One page of each group of copies on a site; only the numbers of copies are shuffled."""
    copied = stored(
        parsed_pages.groupBy("host", "same")
        .agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c"))
        .where("c > 1")
        .drop("c")
    )
    met = parsed_pages.join(copied, ["host", "same"], "left")
    return met.where(F.coalesce("first", "row") == F.col("row")).drop("first")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id``, ``url`` and ``blocks`` (texts in page order) of each page's main content.

    Pages are parsed once, to blocks of text and to the nodes of their site's style tree
    (the DOMs of one host merged along equal paths). Blocks below navigation, adverts,
    forms and the like are gone by name, but names spare main elements and what is around
    them, and a name that only mentions noise leaves it to importance; if a page has a main element, blocks outside of
    it as well. Branches of low importance on a site of at least ``LEAST_PAGES`` pages,
    whose content as a whole differs from page to page, are removed from each page.

    Copies of a page count once in its site's tree, so a page that was fetched many times
    is not mistaken for what all pages share.

    A null html has no blocks; pages without a host form one site. Ids may be null or
    repeated. Other columns are not read. An empty table gives an empty result.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    shape = T.StructType([
        rows.schema["id"], rows.schema["url"], T.StructField("blocks", BLOCKS),
        T.StructField("nodes", NODES),
    ])
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    # Equal pages have equal blocks and nodes, so those tell copies of a page.
    parsed_pages = stored(
        rows.mapInArrow(_parse, shape)
        .withColumn("host", site)
        .withColumn("same", F.xxhash64("blocks", "nodes"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    branches = stored(branch_importance(_distinct_pages(parsed_pages)))
    whole = branches.groupBy("host").agg(F.max("content").alias("whole"))
    low = stored(
        branches.where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
        .join(whole.where(F.col("whole") >= DIVERSE), "host")
        .groupBy("host")
        .agg(F.collect_set("path").alias("low"))
    )
    kept = F.filter(
        "blocks",
        lambda b: ~F.arrays_overlap(b["branch"], F.coalesce("low", F.array().cast("array<bigint>"))),
    )
    return parsed_pages.drop("nodes", "same", "row").join(low, "host", "left").select(
        "id", "url", F.transform(kept, lambda b: b["text"]).alias("blocks")
    )
