"""Elements that are never closed take no article text with them."""

import pytest

from linkwright.llm import html_extract as H

from test_html_extract import TEXT, wrap


@pytest.mark.parametrize("odd", ["<svg width='1'/>", "<math/>", "<svg viewBox='0 0 1 1'><path d='M0'/></svg>", "<select>", "<object data=x>", "<video src=x>", "<select><option>no</option></select>", "<object><object>no</object>no</object>", "<script>no</script>"])
@pytest.mark.parametrize("later", ["", "<svg><text>no</text></svg><select><option>no</option></select><object>no</object>"])
def test_skipped_elements(odd, later):
    assert H.extract(wrap(f"<article><p>{TEXT}</p>{odd}<p>{TEXT} two</p>{later}<p>{TEXT} three</p></article>"), None) == f"{TEXT} {TEXT} two {TEXT} three"


def test_many_unclosed_elements_take_no_square_time():
    assert H.extract("<article>" + "<object><svg/><select>" * 50_000 + f"<p>{TEXT}</p></article>", None) == TEXT
