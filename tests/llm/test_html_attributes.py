"""Marks are read from whole attributes only."""

import pytest

from linkwright.llm import html_extract as H

from test_html_extract import TEXT, wrap

INSIDE = ['title="the hidden cost"', 'data-hidden="false"', 'data-class="sidebar"', "data-x='id=search'", "title='class=ad role=menu'", 'data-role="menu" x-style="display:none"', "data-u=/a?hidden"]


@pytest.mark.parametrize("attribute", INSIDE)
def test_names_inside_other_attributes_mark_nothing(attribute):
    assert H.extract(wrap(f"<article><p>{TEXT}</p><p {attribute}>{TEXT} two</p><p>{TEXT} three</p></article>"), None) == f"{TEXT} {TEXT} two {TEXT} three"


def test_links_inside_paragraphs():
    body = f'<article><p>{TEXT} <a href="/hidden-valley">valley</a> <a href="?id=search">found</a></p></article>'
    assert H.extract(wrap(body), None) == f"{TEXT} valley found"


@pytest.mark.parametrize("attribute", ["hidden", 'HIDDEN=""', "class=sidebar", "class = 'ad'", 'data-x="1"hidden', 'role="menu" role="main"'])
def test_whole_attributes_mark(attribute):
    assert H.extract(wrap(f"<article><p>{TEXT}</p><div {attribute}>{TEXT} no</div></article>"), None) == TEXT
