"""Expressions against Python's own functions and hand-derived values."""
import html
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, Phase, settings, strategies as st
from pyspark.sql import functions as F

from sitelode.functions import html as H, text as T, urls as U

TEXTS = [
    "", "  a b ", "web2lead they're", " Größe & Co. — x_y!! ", "a b　c", "x\x1cy", "!!!", "x" * 60, "a-" * 40,
    "no-break space", "&amp;lt; &copy; &#39;&#x27; &bogus; a & b &#0; &#xD800; &#1114112; &nbsp;x", "A B",
]


def python_slug(text):
    text = re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", text))
    return text[:50].strip("-").lower() or "untitled"


def test_text_matches_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", T.words("t").alias("w"), T.word_count("t").alias("n"), T.title_case("t").alias("title"),
                     T.slug("t").alias("slug"), T.trim_space("t").alias("trim"), T.unescape("t").alias("u"),
                     T.unescape("t").alias("full")).collect()
    for r in rows:
        t = r["t"]
        assert (r["w"], r["n"], r["title"], r["slug"], r["trim"]) == (
            t.split(), len(t.split()), t.title(), python_slug(t), t.strip()), t
        assert r["full"] == html.unescape(t)
        assert r["u"] == html.unescape(t)


def test_null_text(frame):
    row = frame("t string", (None,)).select(T.word_count("t"), T.unescape("t"), T.ellipsis("t"), T.join_list(
        F.lit(None).cast("array<string>")), T.or_default("t", "client")).first()
    assert tuple(row) == (0, None, "No title", "", "client")


@settings(max_examples=6, phases=[Phase.generate], deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abc./?#=:&%-_ ", max_size=14), min_size=60, max_size=60))
def test_url_join_property(spark, refs):
    bases = ["https://h.com/a/b?x=1", "http://h.com", "https://h.com/a/b/", "http://h.com/a//b/../c#f"]
    rows = [(b, r, urljoin(b, r)) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "b string, r string, want string").withColumn("got", U.url_join("b", "r"))
    assert [tuple(x) for x in df.filter("not (want <=> got)").collect()] == []


@pytest.mark.parametrize("ref,want", [
    ("../c", "https://h.com/c"), ("?y=2", "https://h.com/a/b?y=2"), ("#z", "https://h.com/a/b?x=1#z"),
    ("//o.com/z", "https://o.com/z"), ("/../b/./c", "https://h.com/b/c"), ("mailto:x@y", "mailto:x@y"),
    ("", "https://h.com/a/b?x=1"), ("javascript:void(0)", "javascript:void(0)"), ("/a//b", "https://h.com/a//b"),
])
def test_url_join_cases(frame, ref, want):
    assert frame("b string, r string", ("https://h.com/a/b?x=1", ref)).select(U.url_join("b", "r")).first()[0] == want


def test_links_and_names(frame):
    df = frame("t string", ("https://h.com:81/",), ("http://h.com/x",), ("mailto:a@h.com",), ("https://h.com",))
    got = [r[0] for r in df.select(U.link_class("t", F.lit("https://h.com/p"))).collect()]
    assert got == ["external", "internal", None, "internal"]
    names = frame("u string", ("https://www.my-site.co.uk/a",)).select(
        U.business_name("u"), U.business_name("u", True, True), U.normalize_url("u"),
        U.last_segment_phrase(F.lit("https://h/web-design_x")), U.last_segment_phrase(F.lit("https://h/a/"))).first()
    assert tuple(names) == ("Www", "My Site", "https://www.my-site.co.uk/a", "Web Design X", None)
    norm = frame("u string", ("Example.COM",), ("HTTPS://A.com?q=1",)).select(U.normalize_url("u")).collect()
    assert [r[0] for r in norm] == ["https://example.com/", "https://a.com/?q=1"]


def test_context_window_is_clipped(frame):
    df = frame("t string", ("a b c d e f",)).select(T.words("t").alias("w"))
    got = df.select(*[T.context_window(F.col("w"), F.lit(i)) for i in (1, 3, 6)]).first()
    assert tuple(got) == ("a b c", "a b c d e", "d e f")


def test_formats(frame):
    df = frame("v double, s timestamp", (46.55, None))
    row = df.select(T.fmt("v", ".1f"), T.fmt("v", ".2f"), T.fmt(F.lit(7), "03d"),
                    T.fmt(F.lit("2024-01-02 03:04:05").cast("timestamp"), "iso"),
                    T.fmt(F.lit("2024-01-02 03:04:05").cast("timestamp"), "stamp")).first()
    assert tuple(row) == (f"{46.55:.1f}", "46.55", "007", "2024-01-02T03:04:05", "20240102_030405")


PAGE = """<html><!-- <title>no</title> --><head><title>T &amp; x</title><meta content="d > e" name="description">
<meta name=description content=x></head><body><h1> Hello <b>World</b> </h1><script>var a="<h1>z</h1>";</script>
<h2>A</h2><h3 class=x>B<i>c</i></h3><a href="/q?a=1&amp;b=2">l</a><a>no</a><a href>bare</a>
<a title="href=no" HREF='x'>m</a><img src=i.png><img alt=">" src="/j.png"><p>a < b &copy; 2024 <b>bold</b>tail</p></body></html>"""


def test_html(frame):
    df = frame("h string", (PAGE,), ("<p>none",))
    full, bare = df.select(
        H.page_title("h"), H.meta_description("h"), H.first_h1("h"),
        H.attribute_values(H.link_tags("h"), "href"), H.attribute_values(H.image_tags("h"), "src"),
        H.visible_text("h"), H.main_blocks("h")).collect()
    assert tuple(full) == (
        "T & x", "d > e", "HelloWorld", ["/q?a=1&b=2", "", "x"], ["i.png", "/j.png"],
        "T & x Hello World A B c l no bare m a < b © 2024 bold tail", ["Hello World", "A", "B c", "a < b © 2024 bold tail"])
    assert tuple(bare) == (None, None, None, [], [], "none", ["none"])


def test_main_blocks_drop_furniture(frame):
    page = ('<body><nav><a href="/">x</a></nav><div class="ad">buy</div><p>keep me</p><p>keep me</p>'
            '<p><a href="/a">only a link</a></p><table><tr><td>cell</td></tr></table><footer>end</footer></body>')
    assert frame("h string", (page,)).select(H.main_blocks("h")).first()[0] == ["keep me", "cell"]


class Reader(HTMLParser):
    """Text blocks outside furniture, by a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks.append("")
            return
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self.open.pop()
        self.open.append((tag, tag in H.FURNITURE or ("class", "ad") in attrs))
        if tag != "span":
            self.blocks.append("")

    def handle_endtag(self, tag):
        names = [n for n, _ in self.open]
        if tag in H.FURNITURE and tag not in names:
            return
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]
        if tag != "span":
            self.blocks.append("")

    def handle_data(self, data):
        if not any(bad for _, bad in self.open):
            self.blocks[-1] += data

    def result(self):
        return list(dict.fromkeys(b for b in (" ".join(x.split()) for x in self.blocks) if b))


def random_page(rng, tags=60):
    """Nested, unclosed and stray tags around numbered words."""
    names, out = ["div", "div", "nav", "aside", "ul", "li", "section", "form", "footer", "p"], []
    for k in range(tags):
        tag = rng.choice(names)
        out.append(rng.choice([f"<{tag}>", f"<{tag}>", f'<{tag} class="ad">', f"</{tag}>", f"</{tag}>", "<br>", ""]) + f" w{k} ")
    return "".join(out).replace("<p", "<section").replace("</p", "</section")


def test_furniture_goes_with_all_it_holds(frame):
    pages = ['<div class="ad"><div>x</div>y</div><p>kept</p>', "<nav><nav>a</nav>b</nav>c", "<nav>a<div>b</div>", "<div><aside>a</div>b",
             "</div>a</nav>b", "<ul><li class=\"ad\">a<li>b</ul>c", "<NAV>a</nav >b", "", "text only", "a < b <c", "<nav title='>'>x</nav>y",
             "<div id='ad'>" * 300 + "deep" + "</div>" * 300 + "out"]
    want = [["kept"], ["c"], [], ["b"], ["a b"], ["b", "c"], ["b"], [], ["text only"], ["a < b <c"], ["y"], ["out"]]
    got = [r[0] for r in frame("i int, h string", *enumerate(pages), (99, None)).orderBy("i").select(H.main_blocks("h")).collect()]
    assert got[:-1] == want and not got[-1]


def test_furniture_against_a_stack(frame):
    pages = [random_page(random.Random(seed)) for seed in range(300)]
    for row in frame("h string", *[(p,) for p in pages]).select("h", H.main_blocks("h").alias("b")).collect():
        reader = Reader()
        reader.feed(row["h"])
        assert row["b"] == reader.result(), row["h"]
