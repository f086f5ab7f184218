import html
import re
import time

from helpers import no_rows, table
from oracle import compare
from pyspark.sql import functions as F

from heddle.llm import html_main
from heddle.llm.queries import ORACLES, QUERIES

P1 = "The first paragraph of the story is about the town and its people, and it is long enough to be told apart from a menu by the words that are in it, as it has many of them."
P2 = "On the next day, the council was to meet at the hall, but not all of them had come, so that it was put off for a week. It is said that they will be there by then, with or without the others."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>'
LINKS = "".join(f'<li><a href="/{k}">Story number {k} of the week</a></li>' for k in range(9))
COOKIES = "We use cookies on this site so that it is of use to you and to all of our partners, and by the use of it you agree to that, as it is said in the policy that we have on the page of the policy, which is at the end of it."


def text(page):
    return "\n".join(b.text for b in html_main.judged(page) if b.label == "good")


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>{COOKIES}</p></header>{NAV}
    <div class="cookie-notice"><p>{COOKIES}</p></div><article class="post category-social"><header><h1><a href="/x">Title</a></h1><p class="byline">By A. Writer</p></header>
    <p>{P1}</p><aside><p>{P2}</p></aside><p>Short.</p><form><p>{COOKIES}</p><input><button>Go</button></form><script>var a = "<p>no</p>"; /* <!-- */</script>
    <p>{P2[:61]}<br>{P2[61:]}</p><footer>Shared {P1}</footer></article>
    <section id="comments"><article class="comment"><p>{P1}</p></article><div>{P2}</div></section><div id="sidebar"><ul>{LINKS}</ul></div><footer>&copy; {P2}</footer></body></html>"""
    assert text(page) == "\n".join(["Title", P1, "Short.", P2])


def test_pages_that_say_nothing_of_their_regions():
    page = f"<body><div><a href=/>Home</a> | <a href=/n>News</a></div><div><h1>Title</h1><div>{P1}</div><div>Said so.</div><div>{P2}</div></div><h3>Read more</h3><ul>{LINKS}</ul><div>Contact us</div></body>"
    assert text(page) == "\n".join(["Title", P1, "Said so.", P2])
    labels = {b.text: b.label for b in html_main.judged(page)}
    assert labels["Read more"] == labels["Contact us"] == "bad"
    few = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua. " * 3
    assert text(f"<div>{P1}{P1}</div><div>{few}</div>") == P1 + P1
    assert text(f"<article><p>{few}</p></article>") == few.strip()


def test_open_blocks_inherit_from_the_nearest():
    good, bad = f"<p>{P1} {P2}</p>", "<p>" + '<a href="/x">linked words in a row here</a> ' * 3 + "</p>"
    kept = lambda page: [x for x in text(page).split("\n") if len(x) < 50]
    assert kept(f"{good}<p>one</p><p>two</p><p>three</p><p>four</p><p>five</p>{bad}") == ["one", "two", "three"]
    assert kept(f"{bad}<p>one</p>{bad}{good}<p>two</p>{good}") == ["two"]
    assert kept("<p>only</p><p>these</p>") == ["only", "these"]
    assert kept(f"{good}<h2>more links</h2>{bad}") == [] and kept(f"{bad}<h2>a story</h2>{good}") == ["a story"]


def test_regions_by_class():
    for name, stays in [("ad", 0), ("ad-slot", 0), ("topSidebar", 0), ("related-posts", 0), ("main-menu", 0), ("reader-comments", 0), ("content-with-sidebar", 1), ("no-ad", 1), ("shadow", 1), ("advance", 1), ("content banner-left", 1)]:
        assert text(f'<div class="{name}"><p>{P1} {P2}</p></div><div><p>{P2} {P1}</p></div>').startswith(P1) == bool(stays), name
    assert text(f'<div role="complementary">{P1}{P1}</div><div hidden>{P1}{P1}</div><div style="display: none">{P1}{P1}</div><p>{P2}{P2}</p>') == P2 + P2
    # teasers that are articles are not the article, and a form may frame the page
    teasers = "".join(f"<article><a href=/{k}>Short {k}</a></article>" for k in range(3))
    assert text(f"<div><p>{P1} {P2}</p>{teasers}</div>") == f"{P1} {P2}"
    assert text(f"<form id=f><div>{P1} {P2}</div><select><option>No</select></form>") == f"{P1} {P2}"


def test_markup_and_references():
    assert text("<p>a &amp; b&nbsp;c &lt;p&gt; &eacute;&#233;&#xe9; &am &amp") == "a & b c <p> ééé &am &"
    assert text("<p>x<b>y</b>z\n\t w<!-- <p>no --> v</p>") == "xyz w v"
    assert text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("<P CLASS=x>a<P>b<LI>c<li>d</ul>e<hr/>f") == "a\nb\nc\nd\ne\nf"
    assert text('<p title="a > b">x</p><p title="open>y</p><p>z</p>').split("\n")[0] == "x"
    assert text("<article><p>all<p>of it<p cla") == "all\nof it"
    assert text("<article>before<script>if (a) { '</p>' }") == "before"
    assert text("<p><span class=ad>buy<p>kept") == "kept"
    assert text("日本語の記事です。" * 30) == "日本語の記事です。" * 30


def test_long_and_hostile_pages_take_linear_time():
    for part in ("<p>word ", "<div>", "<a href='x'>", "<a b='>' ", "<", "&amp;", "<!--", "<span a=1><p>", "</section><div>", "<script>", "</", "<a =\"", "<p a=b"):
        began = time.perf_counter()
        html_main.judged(part * 40_000)
        assert time.perf_counter() - began < 10, part
    page = "<article>" + "".join(f"<p>{k} {P1}</p>" for k in range(20_000)) + "</article>"
    assert text(page) == "\n".join(f"{k} {P1}" for k in range(20_000))


def by_structure(page):
    """The given pages have all of their main text in one article of plain blocks."""
    found = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.DOTALL)
    inner = re.sub(r"<[^>]*\Z", "", found[1]) if found else ""
    inner = re.sub(r"</?(?:p|h1)>", "\x00", inner).replace("<br>", " ").replace("<b>", "")
    lines = [" ".join(html.unescape(x).split()) for x in inner.split("\x00")]
    return "\n".join(x for x in lines if x)


def test_whole_table(spark, small):
    pages = table(spark, small, "pages").collect()
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in QUERIES["op13_main_text"](spark, small).collect()}
    assert got == {(r.page_id, r.url, by_structure(r.html), len(by_structure(r.html))) for r in pages} and len(pages) == len(got)
    got, expected = compare(QUERIES["op13_main_text"](spark, small), ORACLES["op13_main_text"], small)
    assert got == expected


def test_odd_rows(spark):
    rows = [(1, "u", f"<p>{P1}</p>"), (1, "u", f"<p>{P1}</p>"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "the word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_kept", "label", "tag")})
    out = html_main.main_text(df)
    assert out.columns == ["page_id", "url", "label", "tag", "text", "n_blocks", "n_kept"]
    got = sorted(((r.page_id, r.url, r.text, r.n_kept) for r in out.collect()), key=repr)
    assert got == sorted([(1, "u", P1, 1), (1, "u", P1, 1), (2, None, "", 0), (None, "v", "", 0), (3, "w", ("the word " * 100_000).strip(), 1)], key=repr)
    assert html_main.main_text(no_rows(spark).withColumnRenamed("text", "html")).count() == 0
