"""Classes on wrappers of a whole page drop no article."""

import pytest

from linkwright.llm import html_extract as H

from test_html_extract import TEXT, pages, wrap

STORY = f"<p>{TEXT}</p><p>{TEXT} two</p>"
WANT = f"{TEXT} {TEXT} two"


@pytest.mark.parametrize("label", ["site has-sidebar", "no-sidebar", "overflow-hidden", "with-header", "page--has-sidebar", "sidebar-layout", "widgets"])
@pytest.mark.parametrize("story", [f"<article>{STORY}</article>", f"<main>{STORY}</main>", f'<div class="x">{STORY}</div>'])
def test_wrapper(label, story):
    for rest in ("", '<div class="sidebar">Other things that one may read.</div><ul class="menu"><li><a href=x>Home</a></ul>'):
        assert H.extract(wrap(f'<div class="{label}">{story}{rest}</div><footer>{TEXT}</footer>'), None) == WANT


def test_what_stays_marked():
    for label in ("comments", "ad", "sidebar", "no-print", "related has-image"):
        assert H.extract(wrap(f'<article>{STORY}<div class="{label}"><article><p>{TEXT} no</p></article></div></article>'), None) == WANT
    assert H.extract(wrap(f'<div class="wrap-hidden" hidden><article>{STORY}</article></div>'), None) == ""
    assert H.extract(wrap(f'<article>{STORY}</article><div class="comments"><article><p>{TEXT} {TEXT} {TEXT} no</p></article></div>'), None) == WANT


def test_a_page_of_marked_parts_only():
    assert H.extract(wrap(f'<div class="widget"><p>{TEXT}</p></div><div class="widget"><p>{TEXT} two</p></div><nav>{TEXT}</nav>'), None) == f"{TEXT} two"


def test_host_of_such_pages_votes(spark):
    rows = [(i, f"http://h.example/{i}", wrap(f'<div class="sidebar-layout"><div class="x">{STORY}</div><div class="sidebar">side</div></div>')) for i in range(3)]
    assert {r["text"] for r in H.main_text(spark, pages(spark, rows)).collect()} == {WANT}
    assert [r["path"] for r in H.winners(spark, pages(spark, rows)).collect()] == ["body>div.sidebar-layout>div.x"]
