import bisect
import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from tiergraph.llm import chat, html_extract, url_filter

PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]",
         "\\", " ", "\n", "ok", "[", "<", "/", "é", "$1", "[\\INST]", "<\\</SYS>>", " [/INST]", " </s>"]
CHAT = "conv_id long, turn long, role string, text string, turns string, source string"


def chats():
    r = random.Random(8)
    rows = []
    for c in range(120):
        for t in range(r.randrange(1, 6)):
            role = r.choice(["user", "assistant", "system", "tool", "", None, "x[/ROLE]"])
            rows.append((c, t, role, "".join(r.choice(PARTS) for _ in range(r.randrange(8)))))
    rows += [(900, 1, "user", None), (900, None, "user", "first"), (900, 1, "assistant", "b"), (900, 1, "assistant", "b"),
             (None, 0, "user", "no id"), (901, 0, "assistant", "word " * 20_000)]
    return rows


def test_every_conversation_survives_the_round_trip(spark):
    rows = chats()
    r = random.Random(1)
    shuffled = rows[:]
    r.shuffle(shuffled)
    got = chat.format_chats(spark.createDataFrame([(*x, "x", "x") for x in shuffled], CHAT)).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(got) == len(want)
    for row in got:
        turns = [(role, text) for _, role, text in sorted(want[row["id"]])]
        assert [tuple(t) for t in row["turns"]] == turns
        assert row["loss_text"] == "".join(x for role, x in turns if role == "assistant")
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_harmless_texts_stay_as_they_are(spark):
    text = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text), (1, 0, "user", "hi"), (1, 1, "assistant", "[INST] is fine")]
    got = dict(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("id", "formatted").collect())
    assert got[1] == "[INST] hi [/INST]<s> [INST] is fine </s>"
    assert got[-7] == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]<s> </s>[INST] ok [/INST] </s>"


ENTRIES = [("a", "example.com", "2024-01-10", "add"), ("a", "example.com", "2024-02-01", "remove"),
           ("a", "example.com", "2024-01-15", "add"), ("a", "example.com", "2024-03-01", "add"),
           ("b", "www.example.com/bad", "2024-01-01", "add"), ("b", "Www.example.com/BAD", "2024-01-01", "add"),
           ("b", "gone.org", "2024-01-05", "add"), ("b", "gone.org", "2024-01-05", "remove"),
           ("b", None, "2024-01-05", "add"), ("b", "x.org", None, "add"), ("b", "y.org", "2024-01-01", "typo"),
           ("c", "example.com", "2024-01-20", "add")]


def entries(spark, rows=ENTRIES):
    rows = [(a, b, c and dt.date.fromisoformat(c), d) for a, b, c, d in rows]
    return spark.createDataFrame(rows, "list string, pattern string, listed_on date, action string")


def test_intervals(spark):
    got = {(r["list"], r["pattern"], str(r["valid_from"]), str(r["valid_to"])) for r in url_filter.intervals(entries(spark)).collect()}
    assert got == {("a", "example.com", "2024-01-10", "2024-02-01"), ("a", "example.com", "2024-03-01", "None"),
                   ("b", "www.example.com/bad", "2024-01-01", "None"), ("c", "example.com", "2024-01-20", "None")}


def test_captures_are_judged_at_fetch_time(spark):
    cases = [
        (1, "http://example.com/", "2024-01-09", 0, None), (2, "http://example.com/", "2024-01-10", 1, "example.com"),
        (3, "https://u:p@WWW.Example.com:80/x?y=/bad", "2024-01-31", 2, "example.com"),
        (4, "http://www.example.com/bad/page#f", "2024-02-01", 2, "www.example.com/bad"),
        (5, "http://notexample.com/", "2024-03-02", 0, None), (6, "http://gone.org", "2024-01-06", 0, None),
        (7, None, "2024-03-02", 0, None), (8, "no url", "2024-03-02", 0, None), (9, "http://example.com", None, 0, None),
        (None, "//example.com./", "2024-03-02", 2, "example.com"), (2, "http://example.com/", "2024-01-10", 1, "example.com"),
        (10, "http://www.example.com/badly", "2024-01-02", 0, None),
    ]
    rows = [(i, u, d and dt.date.fromisoformat(d), "x", "x") for i, u, d, _, _ in cases]
    shape = "page_id long, url string, fetched_at date, pattern string, list string"
    captures = spark.createDataFrame(rows, shape)
    got = url_filter.filter_urls(captures, entries(spark)).collect()
    assert Counter((r["id"], r["url"], r["n_active"], r["pattern"]) for r in got) == Counter((i, u, n, p) for i, u, _, n, p in cases)
    assert all(r["blocked"] == (r["n_active"] > 0) for r in got)
    none = url_filter.filter_urls(captures, entries(spark, [])).collect()
    assert len(none) == len(cases) and not any(r["blocked"] for r in none)
    assert url_filter.filter_urls(spark.createDataFrame([], shape), entries(spark)).count() == 0


def test_paths_of_entries_keep_their_case(spark):
    listed = [("s", " Example.COM/Ads/Spring ", "2024-01-01", "add"), ("s", "example.com/News", "2024-01-01", "add"),
              ("s", "example.com/news", "2024-01-03", "add"), ("h", "UPPER.org", "2024-01-01", "add")]
    day = dt.date(2024, 1, 2)
    urls = {"http://EXAMPLE.com/Ads/Spring/x": "example.com/Ads/Spring", "http://example.com/ads/spring": None,
            "http://example.com/News": "example.com/News", "http://example.com/news": None, "http://Upper.org/A": "upper.org"}
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched_at date")
    got = {r["url"]: r["pattern"] for r in url_filter.filter_urls(captures, entries(spark, listed)).collect()}
    assert got == urls


def test_a_pattern_with_a_thousand_intervals_on_a_busy_host(spark):
    r = random.Random(6)
    first = dt.date(2020, 1, 1)
    days = sorted(r.sample(range(4_000), 2_001))
    listed = [(name, "busy.org", str(first + dt.timedelta(d)), ("add", "remove")[i % 2])
              for name in ("a", "b") for i, d in enumerate(days[name == "b" :])]
    when = [r.randrange(-50, 4_100) for _ in range(600)] + days[:40]
    captures = spark.createDataFrame(
        [(i, "http://busy.org/" if i % 2 else f"http://h{i}.net/", first + dt.timedelta(d)) for i, d in enumerate(when)],
        "page_id long, url string, fetched_at date",
    )
    got = {r["id"]: (r["n_active"], r["list"], r["valid_from"]) for r in url_filter.filter_urls(captures, entries(spark, listed)).collect()}
    assert len(got) == len(when)
    for i, d in enumerate(when):
        hits = []
        for name, own in (("a", days), ("b", days[1:])):
            at = bisect.bisect_right(own, d) - 1
            if i % 2 and at >= 0 and at % 2 == 0:
                hits.append((name, first + dt.timedelta(own[at])))
        assert got[i] == ((len(hits), *hits[0]) if hits else (0, None, None))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>side</p></div><main><article><header><h1>Title &amp; more</h1></header>
<p>One<br>two &nbsp; <b>three</b></p><form><input><button>go</button></form><aside>see also</aside>
<div class="ad-slot"><p>buy</p></div><ul><li>a<li>b</ul><table><tr><td>x<td>y</table><p title="a>b">last
 &lt;tag&gt;<script>var a="</p>"</script></article><section id="comments"><p>nice!</p></section></main><footer>f</footer>"""


def blocks(source):
    return [b["text"] for b in html_extract.parsed(source)[0]]


def test_blocks_of_a_page():
    assert blocks(PAGE) == ["Title & more", "One two three", "a", "b", "x", "y", "last <tag>"]
    assert blocks(None) == blocks("") == blocks("<!-- x") == []
    assert blocks("plain <b>text") == ["plain text"]
    assert blocks("<div>a<p>b</div>c<p>d<div>e</p>") == ["a", "b", "c", "d", "e"]
    assert blocks("<article><p>" + "w " * 50_000) == [("w " * 50_000).strip()]
    assert blocks("<article>1 < 2 &amp; 3 &am <unclosed") == ["1 < 2 & 3 &am <unclosed"]


def test_only_whole_attributes_declare_noise():
    assert blocks('<p>See <a href="/hidden-falls">Hidden Falls</a></p>') == ["See Hidden Falls"]
    assert blocks("<p>some <b title='hidden gems'>gems</b> <i data-role=\"search\" data-id=ad x:class='nav'>stay</i>") == ["some gems stay"]
    assert blocks('<div style="overflow:hidden"><article><p>whole</article></div>') == ["whole"]
    assert blocks('<div data-x=\'class="ad"\' title="a id=nav b"><p>kept</div><p \'hidden\'>too') == ["kept", "too"]
    gone = ("hidden", "HIDDEN=''", "x=1 hidden", 'a="b"hidden', "class = ad", "class='ad'", "role=search", "href=/a/ id=nav", "aria-hidden='true'")
    assert [blocks(f"<div {a}>x</div><p>y") for a in gone] == [["y"]] * len(gone)
    assert blocks("<div id=x id=nav>kept</div>") == ["kept"]


def test_names_that_only_mention_noise_keep_the_text():
    for around in ('div class="layout with-sidebar"', 'div id="page" class="has-nav"', 'div class="x share-enabled"',
                   'div class="page--sidebar"', 'div class="post tag-notices category-legal"', 'div class="sidebar widget"'):
        assert blocks(f"<{around}><article><p>whole</article><p>more</{around.split()[0]}>") == ["whole"]
        if "widget" not in around:
            assert blocks(f"<{around}><p>whole</div><p>more") == ["whole", "more"]
    for tag in ("article", "main"):
        for name in ("post category-legal", "tag-notices", "promo", "comments"):
            assert blocks(f'<{tag} class="{name}"><p>whole</{tag}>') == ["whole"]
    assert blocks('<div class="sidebar"><div role="main"><p>whole</div></div>') == ["whole"]
    assert blocks('<span class="widget"><article><p>whole</article></span>') == ["whole"]
    assert blocks('<div class="notice"><p>no</div><div class="widget"><main><div class="ad">no</div><p>whole</main></div>') == ["whole"]
    assert blocks('<article><p>whole<div class="comments"><article class="comment"><p>nice</article></div></article>') == ["whole"]
    gone = ("nav", "main-nav", "cookie-notice", "ad-slot", "ad_1", "sidebar-inner", "menu__item", "nav--main", "x share")
    assert [blocks(f'<div class="{g}">x</div><p>y') for g in gone] == [["y"]] * len(gone)


def test_branches_that_a_site_repeats_are_removed(spark):
    def page(host, i, k=0):
        return (f"http://{host}/{i}", f"<body><div class='x7'><p>Same words here</p></div><div class='c'><p>Text {i}.{k}</p>"
                f"<p>More {i} of it</p></div><div class='z'>Again {i % 2}</div></body>")  # fmt: skip

    rows = [(i, *page("big.org", i)) for i in range(40)] + [(100 + i, *page("small.org", i)) for i in range(3)]
    rows += [(200, None, None), (201, "http://big.org/none", None), (202, "no host", "<p>text</p>"), (None, *page("big.org", 50)), (3, *page("big.org", 3, 1))]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, blocks string, host string")
    got = Counter((r["id"], "\n".join(r["blocks"])) for r in html_extract.extract(pages).collect())
    assert got[(5, "Text 5.0\nMore 5 of it")] == 1 and got[(3, "Text 3.1\nMore 3 of it")] == 1
    assert got[(None, "Text 50.0\nMore 50 of it")] == 1
    assert got[(101, "Same words here\nText 1.0\nMore 1 of it\nAgain 1")] == 1
    assert got[(200, "")] == got[(201, "")] == got[(202, "text")] == 1 and sum(got.values()) == len(rows)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    def page(i):
        return f"<div class='menu0'><p>All pages say this</p></div><div class='c'><p>Own text {i}</p></div>"

    other = "<div class='k'><h2>Other form</h2><p>Its only text</p></div>"
    for copies in (1, 8, 100):
        rows = [(i, f"http://h.org/{i}", page(i)) for i in range(12)]
        rows += [(100 + i, f"http://h.org/o{i}", other) for i in range(copies)]
        # Two forms of pages on one site, each with a part of its own that all its pages share.
        rows += [(300 + i, f"http://h.org/t{i}", f"<div class='s'><b>Shared</b></div><div class='t'><i>Text {i}</i></div>") for i in range(10)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {r["id"]: r["blocks"] for r in html_extract.extract(pages).collect()}
        assert all(got[100 + i] == ["Other form", "Its only text"] for i in range(copies))
        assert got[3] == ["Own text 3"] and got[305] == ["Text 5"]


def test_importance_is_low_where_pages_agree(spark):
    rows = [(i, f"http://h.org/{i}", f"<div class='a'><p>same</p></div><div class='b'><p>own {i}</p></div>") for i in range(9)]
    shape = html_extract.T.StructType([
        html_extract.T.StructField("id", html_extract.T.LongType()), html_extract.T.StructField("url", html_extract.T.StringType()),
        html_extract.T.StructField("blocks", html_extract.BLOCKS), html_extract.T.StructField("nodes", html_extract.NODES)])
    pages = spark.createDataFrame(rows, "id long, url string, html string").mapInArrow(html_extract._parse, shape).withColumn("host", F.lit("h"))
    got = {r["path"]: r for r in html_extract.branch_importance(pages).collect()}
    same, own = (got[html_extract._hash(f">div.{c}>p")] for c in "ab")
    assert same["pages"] == own["pages"] == 9
    assert abs(same["importance"]) < 1e-9 and abs(own["importance"] - 1) < 1e-9
