import html
import re

import pytest

from tessara.llm.html_extraction import align, blocks, extract_text, fold, host_of, infer_wrappers, rendered, skeleton, slot_rank
from tessara.llm.queries import op3_html

FOLDER = "/root/testdata/sf0.01"

FULL = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="post-template">
<div class="cookie-banner">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<main><article id="post-12"><header><h1>The  Title</h1><p>by someone</p></header><p>First &amp; <b>bold</b>er,&nbsp;x&#233;<br>next
 line<p>Second <a href="#">link</a>.<div class="ad-slot"><p>Buy</p></div><ul><li>one<li>two</ul><!-- hidden --><form><p>sign</p></form>
<aside><p>side</p></aside><table><tr><td>c1<td>c2</table><noscript>js</noscript><section id="comments"><article class="comment"><p>reader</p></article></section><p hidden>no</p><p>Last</article></main>
<div id="sidebar">more</div><footer>end</footer></body></html>"""


def pages(frame, rows):
    return frame("page_id long, url string, html string, text string, host int", [(*r, "clash", 1) for r in rows])


def texts(frame, rows):
    return [(r.page_id, r.url, r.text, r.n_chars) for r in extract_text(pages(frame, rows)).orderBy("page_id", "text").collect()]


def test_full_page(frame):
    want = "The Title First & bolder, xé next line Second link. one two c1 c2 Last"
    assert texts(frame, [(1, "http://a.example/x", FULL)]) == [(1, "http://a.example/x", want, len(want))]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<article>open <p>a<p>b", "open a b"), ('<div class="ad">x<article><p>y</p></article>', "y"), ("<article>1 < 2 &lt; 3 &copy</article>", "1 < 2 < 3 ©"),
        ("<article><p title=\"a > b\">q</p><p x='", "q"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article>a<script>no", "a"), ("<nav>only</nav>", ""), ("<main><p>crumbs</p><article><div class='entry-header'><h2>T</h2><p>by</p></div><p>x</p></article></main>", "T x"), ("<main><p>m</p></main><p>o</p>", "m"), ("<body class=post><p>b</p><ins class=adsbygoogle>ad</ins></body>", "b"), ('<div role="main" class="content"><p>c</p></div><p>out</p>', "c"),
        ("<article>" + "<p>w</p>" * 5000 + "</article>", " ".join(["w"] * 5000)), ("<article>" + "x" * 500_000 + "</article>", "x" * 500_000), ("<div>" * 2000 + "deep", "deep"), ("<div><section>" * 2000 + "deep", "deep"), ("<article>" + "<div class=a><section>" * 500 + "<nav>" + "<div><section>" * 500 + "deep", ""), ("<article>\U0001f600&#x1F600;</article>", "\U0001f600\U0001f600"),
    ],
)
def test_odd_pages(frame, page, want):
    assert texts(frame, [(1, None, page)]) == [(1, None, want, len(want))]


def test_repeats_nulls_and_empty_tables(frame):
    rows = [(1, "http://a.example/", FULL), (1, "http://a.example/", FULL), (None, None, None)]
    assert len(texts(frame, rows)) == 3 and texts(frame, []) == []


def test_slots_that_never_change_are_the_hosts_own(frame):
    rows = [(i, f"https://b.example/{i}", f"<div class=x1>Welcome here</div><div class=x2><p>Story {i} begins.</p><p>It ends {i * 7}.</p></div>") for i in range(5)]
    assert [t for _, _, t, _ in texts(frame, rows)] == [f"Story {i} begins. It ends {i * 7}." for i in range(5)]
    wrapper = infer_wrappers(pages(frame, rows)).first()
    assert wrapper.host == "b.example" and wrapper.constant == ["div.x"]


def test_article_text_is_not_lost(frame):
    given = [
        ('<body class="single has-sidebar"><div class="entry-content"><p>Main text', "Main text"), ('<article class="post no-sidebar"><p>Main text', "Main text"), ('<article class="long-form"><p>Text</p></article><div><p>tail junk', "Text"),
        ('<article><p title="a hidden gem">First.</p><p>Second.', "First. Second."), ('<article><section id="side-effects"><p>First.</p></section><p>Second.', "First. Second."), ("<article><p>First.</p><svg><path/><p>Second.", "First. Second."), ("<article><p>First.</p><button><p>Second.", "First. Second."),
        ("<p>Let <math><mi>x</mi></math> be.", "Let x be."), ("<div class=content><p>story</p></div><aside><article class=teaser>x</article></aside>", "story"), ("<main><p>story</p><section class=comments><article>reader</article></section></main>", "story"),
        ("<article>story<section class=comments><article>reader</article></section></article>", "story"), ('<div class="sidebar-box"><article><p>Text</p></article></div>', "Text"), ("<article><p>a</p><button>no</button><svg><g>no</g></svg><p style='display: none'>no</p><p>b", "a b"),
    ]
    for k, (page, want) in enumerate(given):
        assert [(k, r.text) for r in extract_text(pages(frame, [(1, None, page)])).collect()] == [(k, want)]


def test_repeated_links_are_menus_by_the_wrapper(frame, monkeypatch):
    """Neutral names: that a page's one link is of a menu shows on the host's other pages only."""
    def page(k):
        links = "".join(f"<div class=k><a href=/{k}/{i}>Go {k} {i}</a></div>" for i in range(1 if k == 0 else 2 + k % 3))
        return f"<div class=j>{links}</div><div class=q><p>Story {k} goes <a href=x>on</a> here.</p></div>"

    rows = [(k, f"https://m.example/{k}", page(k)) for k in range(5)]
    want = [f"Story {k} goes on here." for k in range(5)]
    assert [t for _, _, t, _ in texts(frame, rows)] == want
    renamed = [(k, u, p.replace("class=k", "class=zz").replace("class=q", "class=yy")) for k, u, p in rows]
    assert [t for _, _, t, _ in texts(frame, renamed)] == want
    alone = [(k, f"https://m{k}.example/", p) for k, _, p in rows]  # no other pages to align with
    assert [t for _, _, t, _ in texts(frame, alone)] == ["Go 0 0 " + want[0], *want[1:]]


def test_wrappers_are_regular_expressions_without_unions(frame):
    a, b = (skeleton(blocks(p)) for p in ("<article><h1>t</h1><p>x</p><p>y</p></article>", "<nav>n</nav><article><h1>t</h1><p>z</p></article>"))
    assert rendered(a) == "(+article: (h1: #text) (p: #text)+)"
    assert rendered(align(a, b)) == rendered(align(b, a)) == "(-nav: #text)? (+article: (h1: #text) (p: #text)+)"
    pairs = fold([["dt", "", []], ["dd", "", []]] * 3)
    assert [(n, t) for n, t, _ in pairs] == [("dt", "+"), ("dd", "+")]
    assert slot_rank("body/+article/p") == 0 and slot_rank("body/-nav/li") is None and slot_rank("body/+main/p") == 1 and slot_rank("body/*div.content/p") == 2 and slot_rank("body/div/p") == 3


def test_hosts(frame):
    urls = ["http://A.example:80/x", "https://u:p@b.example?q", "nothing", None, "https://c.example#f"]
    assert [r[0] for r in frame("i int, url string", list(enumerate(urls))).orderBy("i").select(host_of(__import__("pyspark").sql.functions.col("url"))).collect()] == ["a.example", "b.example", "", "", "c.example"]


def test_query(spark):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = op3_html(spark, FOLDER).collect()
    assert len(rows) == len(raw)
    for r in rows:
        page = raw[r.page_id]
        parts = re.split(r"</?(?:p|h1)>", page[page.index("<article>") + 9 : page.index("</article>")])
        said = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p.replace("<b>", "").replace("</b>", ""))).split()) for p in parts]
        assert r.text == " ".join(x for x in said if x) and r.n_chars == len(r.text)
