import html
import re

from faultline.llm import html_pages
from faultline.llm.html_pages import Wrapper

PAGES = "page_id long, url string, html string"

LAYOUT = """<!doctype html><html><head><title>{n}</title><style>p{{}}</style><script>var x="</p><article>";</script></head><body class=home>
<header><a href=/>Site name</a></header><div id="top-nav"><ul><li>Home<li>News {n}</ul></div>
<div class="cookie-notice">We use cookies</div><div class=layout><div class="sidebar">Popular {n} posts and more</div>
<div class="post"><h1>Title {n} &amp; more</h1><p>First <b>bold</b>er&nbsp;text {n}, a<br>b<p>Second &lt;{n}&gt; <!-- note > --> paragraph
<ul><li>one {n}<li>two</ul><div class="ad">Buy {n}</div><form>Name <input></form><aside>More {n}</aside>
<div class=tail>Follow this blog every day</div></div><div class="comments"><p>Nice {n}!</p></div></div>
<footer>&copy; {n}</footer></body></html>"""
WANT = "Title {n} & more First bolder text {n}, a b Second <{n}> paragraph one {n} two"


def text_of(df):
    return {r.page_id: r.main_text for r in df.collect()}


def test_whole_table_against_its_article_markup(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = text_of(html_pages.extract_text(pages))
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


def test_layout_without_article_tags(make):
    """Several pages: the wrapper finds the slots and drops the block that repeats; a lone page keeps it."""
    rows = [(i, f"http://a.org:80/{i}", LAYOUT.format(n=i)) for i in range(6)] + [(9, "https://B.org/x", LAYOUT.format(n=9))]
    got = text_of(html_pages.extract_text(make(rows, PAGES).repartition(3)))
    for i in range(6):
        assert got[i] == WANT.format(n=i)
    assert got[9] == WANT.format(n=9) + " Follow this blog every day"


def test_copies_of_one_page_keep_their_text(make):
    rows = [(i, "http://a.org/", LAYOUT.format(n=1)) for i in range(8)]
    assert set(text_of(html_pages.extract_text(make(rows, PAGES))).values()) == {WANT.format(n=1) + " Follow this blog every day"}


def test_odd_pages(make):
    page = "<article><p>kept {n}</article>"
    rows = [(1, "http://h/1", None), (2, "http://h/2", ""), (3, "http://h/3", "no markup & text"), (4, None, page.format(n=4)),
            (5, "nonsense", page.format(n=5)), (6, "http://h/6", "<p>a</p>" * 20_000), (7, "http://h/7", "<b>" * 3000 + "deep" + "<div>" * 3000 + "er"),
            (8, "http://h/8", "<script>never closed <p>x"), (9, "http://h/9", "<!-- open <p>x"), (10, "http://h/10", "a < b <p"),
            (4, None, page.format(n=4)), (11, "http://h/11", "<div><p>x</p><ul><li>y</ul></div>" * 500), (12, "http://h/12", "<article></article>")]
    pages = make([(*r, "c", "t") for r in rows], PAGES + ", _host string, main_text string")
    found = html_pages.extract_text(pages).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r.main_text for r in found}
    assert got[1] == got[2] == got[8] == got[9] == got[12] == "" and got[3] == "no markup & text" and got[4] == "kept 4" and got[5] == "kept 5"
    assert got[6] == " ".join(["a"] * 20_000) and got[7] == "deep er" and got[10].startswith("a < b") and got[11].count("x y") == 500
    assert html_pages.extract_text(make([], PAGES)).collect() == []


def test_templates_do_not_depend_on_the_way_pages_meet():
    pages = [Wrapper.of(LAYOUT.format(n=i)) for i in range(7)]
    ahead = pages[0]
    for p in pages[1:]:
        ahead = ahead.add(p)
    parts = pages[6].add(pages[2].add(pages[4])).add(pages[5].add(pages[1]).add(pages[3].add(pages[0])))
    assert ahead.dump() == parts.dump() and len(ahead.dump()) < 2 * len(pages[0].dump())


def test_templates_joined_by_host(make):
    rows = [(i, f"http://h{i % 3}.org/{i}", LAYOUT.format(n=i)) for i in range(12)]
    one, other = (text_of(html_pages.extract_text(make(rows, PAGES), broadcast_bytes=b)) for b in (1 << 26, 0))
    assert one == other == {i: WANT.format(n=i) for i in range(12)}


def test_copies_among_other_pages_keep_their_own_blocks(make):
    own = {"article": "<article><h1>T {n}</h1><p>Text {n}</p>{x}</article>", "div": "<div class=post><h1>T {n}</h1><p>Text {n}</p>{x}</div>"}
    for page in own.values():
        texts = [page.format(n=i, x="") for i in range(5)] + [page.format(n=9, x="<blockquote>Only here</blockquote>")] * 4
        got = text_of(html_pages.extract_text(make([(i, f"http://a.org/{i}", "<body><div>Same line</div>" + t) for i, t in enumerate(texts)], PAGES).repartition(3)))
        assert all(got[i].endswith("T 9 Text 9 Only here") for i in range(5, 9)) and got[0].endswith("T 0 Text 0")


def test_blocks_that_all_articles_share_stay_in_them(make):
    rows = [(i, f"http://a.org/{i}", f"<body><article><p>Text {i}</p><pre>same code</pre></article>") for i in range(6)]
    assert text_of(html_pages.extract_text(make(rows, PAGES))) == {i: f"Text {i} same code" for i in range(6)}


def test_names_count_as_whole_tokens(make):
    page = '<body><nav>Menu</nav><div class="content with-sidebar"><h2 id="social-effects">Effects {n}</h2><section id="related-work">Work {n}</section><p class="notice">Note {n}</p></div><div class="sidebar-left">Side {n}</div>'
    named = '<body><nav>Menu</nav><div class="share"><p>All the text {n}</p></div>'
    rows = [(i, f"http://a.org/{i}", page.format(n=i)) for i in range(5)] + [(i, f"http://b.org/{i}", named.format(n=i)) for i in range(5, 9)]
    got = text_of(html_pages.extract_text(make(rows, PAGES)))
    assert got == {i: f"Effects {i} Work {i} Note {i}" if i < 5 else f"All the text {i}" for i in range(9)}
