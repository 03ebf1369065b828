"""No part of an article is lost to its siblings."""

import pytest

from linkwright.llm import html_extract as H

from test_html_extract import TEXT, pages, wrap

BODY = f"<p>{TEXT}</p>" * 10
ALL = " ".join([f"{TEXT} lead", *[TEXT] * 10])


@pytest.mark.parametrize(
    "story",
    [
        f'<div id=story><div class=lead><p>{TEXT} lead</p></div><div class=body>{BODY}</div><div class=sidebar>{TEXT}</div></div>',
        f'<div id=story><div class=row><div class=cell><p>{TEXT} lead</p></div></div><div class=body><div>{BODY}</div></div></div>',
        f'<div class=wrap><div id=story><section class=lead><p>{TEXT} lead</p></section><section>{BODY}</section></div><div class=footer>{TEXT}</div></div>',
    ],
)
def test_siblings(spark, story):
    assert H.extract(wrap(story), None) == ALL
    rows = [(i, f"http://h.example/{i}", wrap(story)) for i in range(3)]
    assert {r["text"] for r in H.main_text(spark, pages(spark, rows)).collect()} == {ALL}
