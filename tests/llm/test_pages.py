"""Main texts of usual page layouts, word for word."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import html_extract

P = "One sentence of prose stands here, as long as a usual one. " * 4
P = P.strip()
LAYOUTS = {
    "omitted head": (f"<html><head><title>t</title><meta charset=x><p>{P}</p>", P),
    "omitted head body": (f"<html><head><title>t</title><body><article><p>{P}</p></article></body>", P),
    "has-sidebar": (f'<body><div class="has-sidebar"><div class="content"><p>{P}</p></div><div class="sidebar">x y</div></div>', P),
    "elementor": (f'<body><div class="elementor-widget-container"><p>{P}</p></div><footer>f</footer></body>', P),
    "art header": (f'<article><header><h1>Title</h1><p>lead</p></header><p>{P}</p></article>', "Title lead "+P),
    "div.article-header": (f'<article><div class="article-header"><h1>Title</h1></div><p>{P}</p><p class="legal">L text.</p><p class="search-results">S text.</p></article>', "Title "+P+" L text. S text."),
    "math": (f'<article><p>a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> b</p><p>{P}</p></article>', "a x+1 b "+P),
    "img": (f'<article><p>foo<img src=x>bar</p><p>{P}</p></article>', "foobar "+P),
    "aspnet": (f'<body><form id="aspnetForm"><div id=main><h1>T</h1><p>{P}</p></div></form></body>', "T "+P),
    "comments": (f'<body><article><p>{P}</p></article><div id="comments"><article class="comment"><p>{P*3}</p></article></div></body>', P),
    "comments no article": (f'<body><div class="post"><p>{P}</p></div><div class="comments"><p>{P*3}</p></div></body>', P),
    "sidebar layout": (f'<body class="sidebar"><div id="page"><div class="sidebar-left"><div class="main-col"><p>{P}</p></div><div class="sidebar"><p>side</p></div></div></div></body>', P),
    "only header": (f'<header><p>{P}</p></header>', P),
    "text in head": (f'<head>hello {P}', "hello "+P),
    "table": (f'<body><table class="layout"><tr><td class="menu"><a href=x>m</a></td><td><p>{P}</p></td></tr></table></body>', P),
    "site header h1": (f'<body><div class="header"><h1>Site</h1></div><div class="entry"><h2>T</h2><p>{P}</p></div></body>', "T "+P),
    "newsletter in article": (f'<article><p>{P}</p><div class="newsletter-signup">Join</div><aside>a</aside><nav>n</nav></article>', P),
    "nav only": ('<nav>a b c</nav>', ''),
    "cookie": (f'<body><div id="cookie-banner">We use cookies.</div><main><p>{P}</p></main></body>', P),
    "wp": (f'<body class="page has-header"><div id="page" class="site"><header class="site-header">S</header><div class="site-content-contain no-sidebar"><div id="primary" class="content-area"><main id="main"><article class="post-1 post type-post has-post-thumbnail"><header class="entry-header"><h1>T</h1></header><div class="entry-content"><p>{P}</p></div><footer class="entry-footer">tags</footer></article><div id="comments" class="comments-area"><h2>c</h2><p>{P}</p></div></main></div><aside id="secondary" class="widget-area">w</aside></div></div></body>', "T "+P),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, want = LAYOUTS[name]
    assert html_extract.extract(page, None) == want


def test_layout_on_its_hosts_path(spark):
    """The same texts where a host's pages vote."""
    rows = [(i, f"http://h{i}.example/{k}", page) for i, (page, _) in enumerate(LAYOUTS.values()) for k in range(3)]
    got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(i, u): list(LAYOUTS.values())[i][1] for i, u, _ in rows}


NAMES = "has-sidebar sidebar elementor-widget-container menu header comments content no-ads page footer ad cookie-notice".split()


@st.composite
def markup(draw, depth=3):
    """Nested parts of any class, one of which somewhere has prose."""
    inner = draw(markup(depth - 1)) if depth else "<p>prose of the page</p>"
    tag = draw(st.sampled_from("div section header footer form aside td main article".split()))
    end = f"</{tag}>" if draw(st.booleans()) else ""
    side = draw(st.sampled_from(["", "<nav>menu</nav>", "<img src=a>", "<script>x</script>", "<a href=b>link</a>"]))
    return f'<{tag} class="{draw(st.sampled_from(NAMES))}" id="{draw(st.sampled_from(NAMES))}">{side}{inner}{end}'


@settings(max_examples=300, deadline=None)
@given(markup(), st.sampled_from(["", "<html><head><title>t</title>", "<head><meta charset=utf-8></head><body>", "<head>"]))
def test_prose_is_never_lost(inner, start):
    assert "prose of the page" in html_extract.extract(start + inner, None)


def test_deep_suspect_parts_take_linear_time():
    deep = '<div class="sidebar">' * 20000 + "<p>prose</p>"
    assert html_extract.extract(deep, None) == "prose"
