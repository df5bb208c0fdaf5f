from __future__ import annotations

import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelf.functions import chunking, text, urls
from shelf.sources import html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def chunks_py(s: str) -> list[str]:
    """Chunking again, in plain Python."""
    units = lambda x: len(x.encode("utf-16-le")) // 2

    def pack(pieces, joint, split=None):
        out, buf = [], ""
        for p in pieces:
            if split and units(p) > 1400:
                out += [buf] if text.strip_py(buf) else []
                out += split(p)
                buf = ""
            elif units(buf) + units(p) + len(joint) > 1400 and units(buf) >= 400:
                out.append(buf)
                buf = p
            else:
                buf = buf + joint + p if buf else p
        return [y for x in [*out, buf] if (y := text.strip_py(x))]

    sentences = lambda p: pack(re.split(r"(?<=[.!?])\s+(?=[A-Z])", p), " ")
    return pack([y for x in re.split(r"\n{2,}", s) if (y := text.strip_py(x))], "\n\n", sentences)


LONG = "Nine herons stood along the weir at dawn. Did any of them move? " * 60
PARAGRAPH = ("river gravel " * 55).strip()


@pytest.mark.parametrize("s", ["", " \n\n ", "A first line.\n\nA second one.", "\n\n".join([PARAGRAPH] * 5), LONG, PARAGRAPH + "\n\n" + LONG + "\n\n\ntail", "x" * 5_000, "🙂 Word. " * 400, "a" * 399 + "\n\n" + "b" * 1_400, "No end here.  Next one. " * 60])
def test_chunks_match_plain_python(spark, s):
    assert one(spark, chunking.chunk_text(F.lit(s))) == chunks_py(s)


def test_chunks_of_documents_match_plain_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", chunking.chunk_text("text").alias("c")).collect()
    assert all(r.c == chunks_py(r.text) for r in rows)
    assert all(1 <= len(r.c) for r in rows)


def test_short_text_is_one_chunk_and_long_ones_are_split(spark):
    cut = lambda s: one(spark, chunking.chunk_text(F.lit(s)))
    assert cut("Herons fish.\n\nOtters do, too.") == ["Herons fish.\n\nOtters do, too."]
    pair = PARAGRAPH + "\n\n" + PARAGRAPH
    assert len(pair) > 1_400 and cut("\n\n".join([PARAGRAPH] * 5)) == [PARAGRAPH] * 5
    assert len(cut(LONG)) == 3 and all(c.endswith(("dawn.", "move?")) for c in cut(LONG))


def test_build_chunks_leads_with_the_path(spark):
    sections = F.array(F.struct(F.array(F.lit("Weirs"), F.lit(None).cast("string"), F.lit("Fish passes")).alias("path"), F.lit("Built of boulders.").alias("text")), F.struct(F.array().cast("array<string>").alias("path"), F.lit("bare").alias("text")))
    got = one(spark, chunking.build_chunks(sections))
    assert [(c["text"], c["section_path"]) for c in got] == [("Weirs > Fish passes\n\nBuilt of boulders.", "Weirs > Fish passes"), ("bare", None)]


@pytest.mark.parametrize("s", ["a\r\nb\rc", " x \t\t y ", "a\n\n\n\nb\n\nc", "  lead﻿", "", "\n \n\n\n \n"])
def test_normalized_white_space(spark, s):
    assert one(spark, text.normalize_whitespace(F.lit(s))) == text.normalize_whitespace_py(s)


def test_normalized_white_space_by_example(spark):
    assert text.normalize_whitespace_py(" a \t b\r\n\r\n\r\n\r\nc ") == "a b\n\nc"


def test_snippet_cuts_before_it_collapses(spark):
    assert one(spark, text.snippet(F.lit("a  b " + "x" * 400))) == "a b " + "x" * 255 + "…"


@pytest.mark.parametrize(("query", "match"), [("heron weir", '"heron"* OR "weir"*'), ("why do all otters swim", '"otters"* OR "swim"*'), ("\"gravel\" `bars` “shift”", '"gravel"* OR "bars"* OR "shift"*'), ("up to it", ""), ("  ", ""), ("fish-pass 1987", '"fish-pass"* OR "1987"*')])
def test_fts_queries(spark, query, match):
    assert text.to_fts_query(query) == match
    assert one(spark, text.to_fts_query_col(F.lit(query))) == match


def test_tokens_are_folded(spark):
    assert one(spark, text.tokens(F.lit("Éclair_naïve, 42x ÜBER-Straße"))) == ["eclair", "naive", "42x", "uber", "straße"]
    assert text.fold_py("ÀÉñ") == "aen"


URLS = [
    ("/gauges/7", "https://weir.test/rivers?by=name", "https://weir.test/gauges/7"),
    ("http://weir.test/map#lock-3", "http://weir.test/", "http://weir.test/map"),
    ("https://WEIR.Test/Map", "https://weir.test/", "https://weir.test/Map"),
    ("tel:+3512345", "https://weir.test/", None),
    ("data:text/html,x", "https://weir.test/", None),
    ("sftp://weir.test/log", "https://weir.test/", None),
    ("/photos/heron.jpeg", "https://weir.test/", None),
    ("https://weir.test/levels.CSS?v=2", "https://weir.test/", None),
    ("nowhere", "not a page's address", None),
    ("//Other.weir.test/a?b=c/d.png", "http://weir.test/x", "http://other.weir.test/a?b=c/d.png"),
    ("https://weir.test", "https://weir.test/", "https://weir.test/"),
    ("https://weir.test:443/a/", "https://weir.test/", "https://weir.test/a/"),
    ("/a.b/c", "https://weir.test/", "https://weir.test/a.b/c"),
    ("../up", "https://weir.test/a/b?x=y", "https://weir.test/up"),
    ("next", "https://weir.test/a/b?x=y", "https://weir.test/a/next"),
    ("next", "https://weir.test", "https://weir.test/next"),
    ("?q=1", "https://weir.test/a/b?x=y", "https://weir.test/a/b?q=1"),
    ("#top", "https://weir.test/a/b?x=y#z", "https://weir.test/a/b?x=y"),
    ("", "https://weir.test/a/b?x=y", "https://weir.test/a/b?x=y"),
    ("a b", "https://weir.test/a/b", "https://weir.test/a/a%20b"),
    ("./x/../y/", "https://weir.test/a/b", "https://weir.test/a/y/"),
    ("../../../..", "https://weir.test/a/b/c", "https://weir.test/"),
    ("x/./..", "https://weir.test/a/b", "https://weir.test/a/"),
    ("straße?ö=ü", "https://weir.test/a/", "https://weir.test/a/stra%C3%9Fe?%C3%B6=%C3%BC"),
    (None, "https://weir.test/", None),
]


@pytest.mark.parametrize(("href", "base", "url"), URLS)
def test_urls(spark, href, base, url):
    assert urls.resolve(href, base) == url
    assert one(spark, urls.normalize_url(F.lit(href), F.lit(base))) == url


@pytest.mark.parametrize(("href", "url"), [("\\win\\path", "https://weir.test/win/path"), ("http://bücher.example/", "http://xn--bcher-kva.example/"), ("http://[bad", None), ("http://a b/", None), ("http://x:99999/", None), ("https:lock", "https://weir.test/a/lock")])
def test_urls_that_only_full_resolution_knows(href, url):
    assert urls.resolve(href, "https://weir.test/a/b?x=y") == url


def test_links_keep_document_order_and_first_occurrences(spark):
    page = """<a href="/b">x</a><!-- <a href="/no"> --><A class=x HREF='/a#f'>y</A><a href=/b>z</a><a href="/p.png"></a><a name=q></a><a href="/c?x=1&amp;y=2"></a>"""
    want = ["https://e.com/b", "https://e.com/a", "https://e.com/c?x=1&y=2"]
    assert one(spark, urls.extract_links(F.lit(page), F.lit("https://e.com/"))) == want
    assert html.links(html.parse(page), "https://e.com/") == want


def test_page_titles(spark):
    assert one(spark, urls.page_title(F.lit("<head><TITLE lang=x> A &amp; B\n c </TITLE>"))) == "A & B c"
    assert one(spark, urls.page_title(F.lit("<p>no title"))) is None


def test_sections_follow_headings():
    markup = "<p>Before any heading.</p><h2>Floods</h2><p>Of 1909.</p><p>Of 1954.</p><h4>Marks</h4><ul><li>On the mill</ul><h1>Droughts</h1><blockquote>None.</blockquote><h2></h2><p>Untitled.</p>"
    got = html.walk_sections(markup, "Rivers")
    assert [(" > ".join(filter(None, s["path"])), s["text"]) for s in got] == [
        ("Rivers", "Before any heading."), ("Rivers > Floods", "Of 1909.\n\nOf 1954."), ("Rivers > Floods > Marks", "On the mill"), ("Rivers > Droughts", "None."), ("Rivers > Droughts", "Untitled."),
    ]


def test_sections_of_odd_markup():
    walk = html.walk_sections
    assert walk("<div>lost<p>kept</p></div>", "") == [{"path": [], "text": "kept"}]
    assert walk("<div>only bare text</div>", "T") == [{"path": ["T"], "text": "only bare text"}]
    assert walk("<p>one<p>two<ul><li>a<li>b</ul>", "T") == [{"path": ["T"], "text": "one\n\ntwo\n\na\n\nb"}]
    assert walk("<h3>Deep</h3><p>x</p>", "T")[0]["path"] == ["T", None, None, "Deep"]
    assert walk("<nav><a>n1</a> <a>n2</a></nav><table><tr><td>c1<td>c2</table>", "") == [{"path": [], "text": "n1 n2\n\nc1\n\nc2"}]
    assert walk("", "T") == []


def test_articles():
    page = """<html><head><title>T &amp; x</title><meta name="author" content=" Ann "><meta property="og:site_name" content="Site"><script>var t="</p>";</script></head>
    <body><nav><a href="/n">nav</a></nav><article><h1>H</h1><p>Text <b>bold<p>More<div class="ad">buy</div><style>p{}</style></article><footer>foot</footer></body></html>"""
    got = html.read_article("https://e.com/x", page)
    assert (got["title"], got["byline"], got["site_name"], got["links"], got["error"]) == ("T & x", "Ann", "Site", ["https://e.com/n"], None)
    assert "buy" not in got["text_content"] and "nav" not in got["text_content"] and "More" in got["text_content"]
    assert [s["text"] for s in html.walk_sections(got["content_html"], got["title"])] == ["Text bold\n\nMore"]
    for nothing in (None, "", "<body><nav>x</nav></body>"):
        assert html.read_article("https://e.com/x", nothing)["error"]
    assert html.read_article("https://e.com/x", "<p>bare</p>")["title"] == "https://e.com/x"


LINKS = [
    "\n /foo", "\\win\\path", "http://BÜCHER.example/x", "https://u:p@host/x", "/x?a=1&b=2", "//Other.example:80/x", "https:foo", "http:foo", "http:///x//y", "?q", "", "#f", "..", "../../..", "./a/../b/", "a b", "HTTP://EX.com:443/", "http://ex.com:99999/",
    "mailto:x@y", "javascript:void(0)", "/pic.PNG", "/a.b/c", "http://[::1]:8080/x", "http://exa mple.com/", "/é?ü='\"", "/%41%zz", "http://faß.de/", "http://日本語.jp/", "http://a.bücher.日本.example/", "http://ünï-çödé.example", "http://пример.испытание/", "x?y?z#q#r", "http://h:0080/x",
    "http://h:080/", "ftp://x/", "http://", "//", "///x", "/..", "/a/./b/../c/.", "http://user@ex.com", "http://ex.com?x=1", "http://ex.com#f", "\\\\h\\x", "http://ex.com/a\tb\nc", "data:text/html,x", "/tilde~[x]|^{y}`", "http://h:", "http://h:x/", "http://a@b@c/", "?", "x?", "a:b", "1:2", "http://ex%41mple.com/",
]


def test_native_links_equal_the_plain_resolver(spark):
    bases = ["http://weir.test/a/b?z=1#f", "https://Weir.test", "https://u:p@weir.test:8443/x/y/", "mailto:x", ""]
    rows = spark.createDataFrame([(h, b) for h in LINKS for b in bases], "h string, b string")
    got = rows.select("h", "b", urls.normalize_url("h", "b").alias("u")).collect()
    # User names of the base go to its links; the plain resolver is told them by the base as well.
    assert {(r.h, r.b): (r.u, w) for r in got if r.u != (w := urls.resolve(r.h, r.b))} == {}


def test_punycode_of_random_labels(spark):
    import random

    rng = random.Random(6)
    labels = ["".join(rng.choice("abz09-äöü日本éßжя𝒳") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    labels = [x for x in labels if not x.isascii()]
    rows = spark.createDataFrame([(x,) for x in labels], "h string").select("h", urls._host(F.col("h")).alias("p")).collect()
    assert {r.h: r.p for r in rows} == {x: "xn--" + x.encode("punycode").decode() for x in labels}


def test_a_link_plan_names_each_part_once(spark):
    plan = spark.createDataFrame([("", "")], "h string, u string").select(urls.extract_links("h", "u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp") < 100


def test_character_references(spark):
    cases = {"a&amp;b": "a&b", "&#38;&#x26;&#X26;": "&&&", "&copy=1&copy;&copyx": "&copy=1©&copyx", "&eacute;&nosuch;&": "é&nosuch;&", "&#0;&#xD800;&#1114112;": "&#0;&#xD800;&#1114112;", "&#128578;&amp;amp;": "🙂&amp;", "x&lt": "x<", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", urls.unescaped(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_a_very_long_page(spark):
    page = "<p title='" + "x" * 200_000 + "'>" + "".join(f'<a class="c{k}" href="/{k}">{"word " * 20}</a>' for k in range(3_000)) + "<!-- " + "<a href=/no>" * 1_000
    got = one(spark, urls.extract_links(F.lit(page), F.lit("https://e.com/")))
    assert got == [f"https://e.com/{k}" for k in range(3_000)]


SAMPLES = [
    "Café cafe\u0301s CAFE\u0301 naïve nai\u0308ve", "İstanbul I\u0307stanbul ISTANBUL ıstanbul ÇAĞRI Çağrı", "हिन्दी भाषा देवनागरी १२३", "Ελλάδα ΕΛΛΆΔΑ ΌΣΟΣ όσος µm", "Йод йод и\u0306од ёлка", "ﬁn ǖ u\u0308\u0304 Ǖ ǘ ệ e\u0323\u0302 ﬀ",
    "\u0301start a\u0301-\u0301b e\u0335x o\u0338 ſtraße STRASSE ẛ", "日本語 テスト 한국어 ２３ x² ½", "rate-limit don't a_b c.d 3,14",
]


def test_tokens_equal_fts5(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("sqlite without fts5")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    letters = [chr(c) for c in range(0xC0, 0x530) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and chr(c) not in "ǠǡͿԨԪԬԮ" and unicodedata.normalize("NFD", chr(c))[0] != "\u0378"]
    every = [*SAMPLES, *(f"a{c}b {unicodedata.normalize('NFD', c)}x" for c in letters if unicodedata.normalize("NFD", c)[0].isascii() or unicodedata.normalize("NFD", c) == c)]
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(every)))
    want = {k: [r[0] for r in db.execute("select term from v where doc = ? order by offset", (k,))] for k in range(len(every))}
    rows = spark.createDataFrame(list(enumerate(every)), "k int, x string").select("k", text.tokens("x").alias("t"))
    got = {r.k: r.t for r in rows.collect()}
    assert {every[k]: got[k] for k in got if got[k] != want[k]} == {}
    assert [text.fold_py(x) for x in SAMPLES] == [r.f for r in spark.createDataFrame(list(enumerate(SAMPLES)), "k int, x string").orderBy("k").select(text.fold("x").alias("f")).collect()]


READING = "This paragraph goes on for a while, as those of articles do, and says one thing after the other until it has said enough of it to be read by someone who has the time to read what is written here, line by line. "
LINKS_OF = "".join(f'<li><a href="/{k}">A link with a rather long text that leads to page number {k}, and on</a></li>' for k in range(40))


@pytest.mark.parametrize(
    ("markup", "mark"),
    [
        (f'<div id="x"><ul>{LINKS_OF}</ul></div><div id="y"><p>{READING}</p><p>{READING}</p></div>', "y"),
        (f'<div><div id="x"><p>{READING}</p><p>{READING}</p><p>{READING}</p></div></div><div id="y">' + "".join(f"<div><p>Well said, number {k}, and I agree with it.</p></div>" for k in range(60)) + "</div>", "x"),
        (f'<div id="w"><p>{READING}</p></div><section id="y">' + "".join(f"<div><p>{READING}</p><p>{READING}</p></div>" for _ in range(4)) + "</section>", "y"),
        (f'<table><tr><td id="x">{"<a href=/a>link after link</a> " * 30}</td><td id="y"><p>{READING}</p><p>{READING}</p></td></tr></table>', None),
        (f'<div id="x"><p>{READING[:90]}<a href="/more">{READING[:80]}</a></p></div><div id="y">{READING}<b>{READING}</b>{READING}</div>', "y"),
        ('<div id="x"><p>tiny</p></div><div id="y"></div>', None),
    ],
)
def test_the_best_block_of_pages_that_do_not_name_it(markup, mark):
    body = html.find(html.parse(f"<html><body>{markup}</body></html>"), "body")
    best = html.best_block(body)
    if mark is None:
        assert best.tag in ("tr", "body", "td")
    else:
        assert best.attrs.get("id") == mark
    read = html.read_article("https://e.com/", f"<html><body>{markup}</body></html>")
    assert "Well said" not in (read["text_content"] or "") and "A link with" not in (read["text_content"] or "")


def test_a_very_deep_page_has_a_best_block():
    deep = "<div>" * 3_000 + f"<p>{READING}</p>" + "</div>" * 3_000
    assert READING.strip() in html.read_article("u", f"<body>{deep}</body>")["text_content"]
