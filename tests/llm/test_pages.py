import html
import re
import time

import pytest
from cases import given

from armarium.llm import pages, queries


def article_of(page):
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf):
    want = {i: (u, article_of(h)) for i, u, h in given(sf, "pages", "page_id, url, html")}
    rows = queries.op9_html_extraction(spark, sf).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<nav>menu</nav>", ""),
    ("<p>one<p>two</b></p>", "one\ntwo"), ("<article><p>x &lt; y &#233;&hellip;</p></article>", "x < y é…"),
    ("<article><p>a < b and c</p></article>", "a < b and c"),
    ("<div id=content><h1>T</h1><p>One, two.<aside>x</aside> More.</p><div class='comments'>hi, there.</div><p>b<br>c</p></div><div class='sidebar'>s</div>", "T\nOne, two.\nMore.\nb c"),
    ("<main><p>Hello, world.</p><form><p>x</p></form></main><footer>f</footer>", "Hello, world."),
    ("<article><p>Some text, here.</p><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>End.</p></article>", "Some text, here.\nEnd."),
    ("<div class=cookie-notice>We use cookies.</div><article><ul><li>one<li>two</ul></article>", "one\ntwo"),
    ("<article><p>cut off here, in the mid", "cut off here, in the mid"), ("<article><p>a\n\t b&nbsp;c</p></article>", "a b c"),
    ("<div hidden>no</div><p>Yes, it is.</p><div style='display: none'>no</div><div role=navigation>no</div>", "Yes, it is."),
])
def test_pages(page, text):
    assert pages.main_text(page) == text


def test_edges(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (2, None, "", 2), (None, "v", "<article>" + "<p>word, word.</p>" * 20_000 + "</article>", 3), (4, "w", "<" * 5000, 4), (5, "w", "<div>" * 3000 + "deep", 5)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in pages.extract(frame).collect()}
    assert got == {1: "", 2: "", None: "\n".join(["word, word."] * 20_000), 4: "<" * 5000, 5: "deep"}
    assert pages.extract(frame.limit(0)).collect() == []


def test_short_boilerplate_outside_the_container_goes():
    page = "<body><div class=top>Log in</div><div class=story>" + "<p>A long paragraph, with some punctuation; and words enough to read.</p>" * 5 + "</div><div class=end>All rights</div></body>"
    assert pages.main_text(page) == "\n".join(["A long paragraph, with some punctuation; and words enough to read."] * 5)


@pytest.mark.parametrize("page, text", [
    ("<article><p>one <svg class='i'/> two</p><p>three</p></article>", "one two\nthree"),
    ("<article><p>one <svg><title>x</title><text>no</text></svg> two <svg class=i> three</p><p>four</p></article>", "one two\nfour"),
    ("<article><title-x>one</title-x><p>two</p><select-box></select-box><style-guide>three</style-guide></article>", "one\ntwo\nthree"),
    ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, then <math/> so.</p><object data=a><p>A fallback.</p></object></article>", "If x=2, then so.\nA fallback."),
    ("<article><p>a<select><option>b<option>c</select><canvas><p>d</p></canvas> e</p><title >f</title></article>", "a\ne"),
    ("<article><div><svg class=i><path><p>one</p></div><p>two</p></article>", "one\ntwo"),
])
def test_elements_without_an_end_tag_and_with_longer_names(page, text):
    assert pages.main_text(page) == text


STORY = "<article><h1>T</h1><p>A long paragraph, with some punctuation; and words enough to read.</p></article>"
PLAIN = STORY.replace("<article>", "<div>").replace("</article>", "</div>")
SAID = "T\nA long paragraph, with some punctuation; and words enough to read."


@pytest.mark.parametrize("page", [
    f"<body><nav>menu</nav><{wrap}>{story}</{wrap.split()[0]}><footer>f</footer></body>" for story in (STORY, PLAIN) for wrap in (
        "div class='layout with-sidebar'", "div class='content no-sidebar'", "div class='elementor-widget elementor-widget-theme-post-content'", "div class=widget",
        "div class='sidebar-left layout'", "form id=page action='/'", "form", "div class=modal role=dialog")
] + [
    "<article><header><h1>T</h1></header><p>A long paragraph, with some punctuation; and words enough to read.</p></article>",
    "<article><div class='post-header'><h1>T</h1></div><p>A long paragraph, with some punctuation; and words enough to read.</p></article>",
    f"<form><div class=sidebar><div class='layout widget'>{STORY}</div></div><div class=search>Find it</div></form>",
    f"<header class=site>Site name</header>{STORY}<div class=sidebar><article><p>Another story, in short.</p></article></div>",
    f"{PLAIN}<div class=sidebar><article><p>Another.</p></article></div>",
    f"{STORY}<div id=comments>{'<article><p>I think, it is so.</p></article>' * 40}</div>",
    f"<div class=cookie-notice>{'We use cookies, and more of them. ' * 9}</div>{STORY}<div class='widget'>{'Other words, and more. ' * 9}</div>",
])
def test_named_wrappers_stay_and_named_parts_go(page):
    assert pages.main_text(page) == SAID


@pytest.mark.parametrize("part", [
    "<section class='reader-comments'><p>I think, it is so.</p></section>", "<div class='post-comments'>Hi, there.</div>", "<div class='user-comments'>Hi, there.</div>", "<div id='entry-comments'>Hi.</div>",
    "<div class='left-sidebar'>Other, things.</div>", "<div class='site-footer'>All rights, reserved.</div>", "<div class='article-ads'>Buy, now.</div>", "<div class='main-nav'>Home, About.</div>", "<div class='top-banner'>New.</div>"])
def test_named_parts_go_inside_and_beside_the_article(part):
    for story in (STORY, PLAIN):
        inside = story[:story.rindex("</")] + part + story[story.rindex("</"):]
        assert pages.main_text(f"<body>{inside}</body>") == SAID
        assert pages.main_text(f"<body>{part}{story}{part}</body>") == SAID


def test_a_title_beside_the_text():
    body = "<p>A long paragraph, with some punctuation; and words enough to read.</p>" * 4
    assert pages.main_text(f"<body><div class=top><h1>T</h1></div><div class=text>{body}</div></body>").split("\n")[0] == "T"
    assert pages.main_text(f"<body><header><h1>Site</h1></header><div class=text>{body}</div></body>").split("\n")[0] != "Site"


N = 1_000_000


@pytest.mark.parametrize("page", [
    '<a b="' * (N // 6), "<a b='" * (N // 6), "<a \"' " * (N // 6), "<" * N, "<!" * (N // 2), "<!--" * (N // 4), "<script " * (N // 8), "<title>" * (N // 7), "<a " * (N // 3), "</a" * (N // 3), "<x y='>" * (N // 7),
    "<div><span>" * 50_000 + "deep", "<div class=sidebar>x" * 20_000, "<div class='menu'><span>y</span>" * 20_000 + "</div>" * 20_000, "".join(f"<p class=c{i}>word, word." for i in range(50_000)), "".join(f"<div class=c{i}>w" for i in range(20_000)),
    "<p><object>" + "<span>" * 20_000 + "<div></div>" * 20_000, "<svg>" + "<g>" * 20_000 + "</x>" * 20_000, "<ul>" + "<li><ul>" * 20_000 + "<li>" * 20_000, "&amp;" * (N // 5), "<article>" * 20_000 + "x", "<script>a</script>" * 30_000, "<script>a</" * 90_000])
def test_time_grows_with_the_page_only(page):
    start = time.process_time()
    pages.main_text(page)
    assert time.process_time() - start < 4
