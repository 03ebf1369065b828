import pytest

from linkwright.llm import html_extract as H

TEXT = "This paragraph of the article is long enough to count as running text, with commas, and more."


def wrap(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>{body}</body></html>'


CASES = {
    "article": (f'<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy this now, it is cheap.</div><article><h1>Head</h1><p><b>{TEXT}<br><p>Second &amp; last&nbsp;one.</p></article><footer>&copy; foot</footer>', f"Head {TEXT} Second & last one."),
    "div": (f'<div id="header"><p>{TEXT} header</p></div><div class="wrap"><div class="post-content"><h2>Head</h2><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><div class="sidebar">{TEXT}</div></div>', f"Head {TEXT} {TEXT} {TEXT}"),
    "comments": (f'<main><article><p>{TEXT}</p><p>{TEXT}</p><div class="comments"><article class="comment"><p>{TEXT} said a reader</p></article></div><form><p>{TEXT} in a form</p></form><div role="alert">{TEXT} note</div></article></main>', f"{TEXT} {TEXT}"),
    "comment tags": (f"<article><!-- <p>hidden</p> --><p>{TEXT}</p><script>if (a < b) {{ x('<p>no</p>') }}</script><p>a &lt; b &#38; c &#x27;d&#x27; 1 < 2</p></article>", f"{TEXT} a < b & c 'd' 1 < 2"),
    "attributes": (f'<article data-x="a > b"><p title=\'x > y\'>{TEXT}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>', f"{TEXT} one two a b"),
    "inline": (f"<article><p>{TEXT} wo<b>r</b>d <a href=x>link</a>.</p></article>", f"{TEXT} word link."),
    "plain": (TEXT, TEXT),
    "hidden": (f'<article><p>{TEXT}</p><div style="display: none">{TEXT} no</div><div aria-hidden="true">{TEXT} no</div><aside>{TEXT} no</aside></article>', TEXT),
    "cookie": (f'<div class="cookie-notice"><p>{TEXT} {TEXT} {TEXT}</p></div><div class="text"><p>{TEXT}</p><p>{TEXT}</p></div>', f"{TEXT} {TEXT}"),
    "unclosed": (f"<article><div><p>{TEXT}<div><p>{TEXT}", f"{TEXT} {TEXT}"),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    body, want = CASES[name]
    assert H.extract(wrap(body), None) == want


def test_odd_input():
    assert H.extract(None, None) == H.extract("", None) == "" and H.extract("<", None) == "<" and H.extract("<p", None) == "<p"
    assert H.extract("<!-- never closed <p>x</p>", None) == "" and H.extract("<script>never closed", None) == ""
    assert H.extract("<p a='x>" + TEXT, None).endswith(TEXT)
    deep = "<div>" * 3000 + f"<p>{TEXT}</p>"
    assert H.extract(deep, None) == TEXT
    assert len(H.extract(wrap("<article>" + f"<p>{TEXT}</p>" * 3000 + "</article>"), None)) == 3000 * (len(TEXT) + 1) - 1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_the_host_decides(spark, cluttered):
    """A page whose sidebar outweighs its article follows the path that its host's other pages agree on."""
    good = [(i, f"http://h.example/{i}", wrap(f'<div class="story{i}"><p>{TEXT}</p><p>{TEXT} {i}</p></div><div class="box"><p>short</p></div>')) for i in range(5)]
    odd = (9, "http://H.example/9", wrap(f'<div class="story9"><p>{TEXT} nine</p></div><div class="box"><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div>'))
    other = (10, "http://other.example/", odd[2])
    rows = [*good, odd, other, (11, None, None), (12, "http://h.example/", ""), (None, "http://h.example/", good[0][2]), (13, "http://h.example/", f"<p>{TEXT} elsewhere</p>"), good[1]]
    got = {}
    for r in H.main_text(spark, cluttered(pages(spark, rows))).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[9] == [f"{TEXT} nine"] and got[10] == [f"{TEXT} {TEXT} {TEXT}"] and got[11] == got[12] == [""] and got[None] == [f"{TEXT} {TEXT} 0"] and got[13] == [f"{TEXT} elsewhere"] and len(got[1]) == 2
    assert H.main_text(spark, pages(spark, [])).collect() == []
