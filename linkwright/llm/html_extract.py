"""Main text of pages by consensus host paths.

Every page votes, with the score of its best container, for that container's path of tags and classes (numbers
generalised). Spark sums the votes of each host, whatever share of the pages it has, by partial aggregation; the pages
are then extracted again with their host's winning path. A page without such a container uses its own best one.

Containers score by the running text in the blocks below them, less what stands in links. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are told by their tags, roles and classes, and
count for nothing. Classes of a wrapper of nearly the whole page, or around an article or main element, mark nothing below. Within an article or main element the whole element is the container; its headings count as text. Elsewhere the
container is widened to the element, below the page itself, that holds the running text of its siblings too.

Defined results: null or empty html has an empty text; a null url belongs to the host without a name; a null page_id is
kept; repeated rows get a row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, table, tune
from .url_filter import host_of

#: Elements of a path, counted from the container.
PATH_LENGTH = 8

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>
    |<[!?/][^>]*>""",
    re.S | re.I | re.X,
)
#: A whole attribute with its value, so that names are not looked for inside other names and values.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_READ = {"class", "id", "role", "style", "aria-hidden", "hidden"}
#: Elements without article text. Those of _RAW hold no elements, and run to the end of the page if they are not closed.
_RAW = {"script", "style", "textarea", "title"}
_SKIPPED = _RAW | {"noscript", "template", "svg", "iframe", "select", "object", "math", "audio", "video", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {"article", "body", "center", "div", "html", "main", "section", "td"}
_BLOCKS = _CONTAINERS | {
    "address", "aside", "blockquote", "caption", "dd", "details", "dialog", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "legend", "li", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "summary", "table", "tbody", "tfoot", "th", "thead", "tr", "ul",
}
_BAD_TAGS = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "label", "menu", "nav", "optgroup", "option"}
_BAD_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Parts of classes and ids that mark what is not the article; and those that speak for text all the same.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banners?|sponsor\w*|promo\w*|navs?|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|footers?|foot|headers?|masthead|topbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|cookies?|consent|gdpr|notices?|notification|popups?|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|pagination|pager|widgets?|toolbar|skip|hidden|print|outbrain|taboola)\d*(?=$|[\s_-])",
    re.I,
)
#: Classes that tell what a page's layout has or lacks, not what the element is; no-print is said of the element.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without|overflow)[_-](?!print)\S+", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|story|entry|post|main|text)(?:[\s_-]?(?:body|content|text|main))?(?=$|[\s_-])", re.I)
_NEVER = re.compile(r"comment|repl(?:y|ies)|sidebar|(?:^|[\s_-])ads?(?=$|[\s_-])|advert|footer|menu|nav", re.I)
#: Marked classes whose elements stay marked in any wrapper and around any article.
_FIRM = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|repl(?:y|ies))\d*(?=$|[\s_-])", re.I)
#: Share of a page's running text from which a marked class is that of a wrapper of the whole page.
WRAPPER_PERCENT = 90
#: An open element that a new one of these ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body"}


@dataclass
class Page:
    """Elements as parallel lists, and the text blocks (element, text, characters in links)."""

    tag: list[str] = field(default_factory=lambda: ["body"])
    name: list[str] = field(default_factory=lambda: ["body"])
    parent: list[int] = field(default_factory=lambda: [-1])
    bad: list[bool] = field(default_factory=lambda: [False])
    firm: list[bool] = field(default_factory=lambda: [False])
    soft: list[bool] = field(default_factory=lambda: [False])
    inside: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path(self, node: int) -> str:
        names: list[str] = []
        while node >= 0 and len(names) < PATH_LENGTH:
            names.append(self.name[node])
            node = self.parent[node]
        return ">".join(reversed(names))


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in paths, and whether its state or role, or its classes alone, mark it as no article."""
    found: dict[str, str] = {}
    if attributes and not attributes.isspace():
        for k, v in _ATTRIBUTE.findall(attributes):
            if (k := k.lower()) in _READ:
                found.setdefault(k, v.strip("\"' "))
    if not found:
        return tag, False, False
    label, own = found.get("class", ""), found.get("id", "")
    both = _LAYOUT.sub(" ", f"{label} {own}")
    soft = bool(_BAD.search(both)) and not (_GOOD.search(both) and not _NEVER.search(both))
    firm = soft and bool(_FIRM.search(both))
    firm |= found.get("role", "").lower() in _BAD_ROLES or found.get("aria-hidden", "").lower() == "true" or "hidden" in found
    firm |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    first = label.split()[0] if label.split() else ""
    general = re.sub(r"\d+", "N", first or (f"#{own}" if own else ""))
    return (f"{tag}.{general}" if general else tag), firm, soft


def _closings(html: str, tag: str) -> dict[int, int]:
    """Where each closed element of a tag ends, by the end of its start tag. A closing tag closes the last open one."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(/?){tag}(?![a-z0-9:-])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>", html, re.I):
        if not m[1]:
            if not (tag in ("svg", "math") and m[0].endswith("/>")):
                opened.append(m.end())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def parse(html: str) -> Page:
    page = Page()
    closings: dict[str, dict[int, int]] = {}
    stack = [0]
    words: list[str] = []
    link_chars, in_link = 0, False

    def flush() -> None:
        nonlocal link_chars
        if words:
            text = " ".join("".join(words).split())
            if text:
                page.blocks.append((stack[-1], text, link_chars))
            words.clear()
        link_chars = 0

    def end(tags: set[str], scope: set[str] = frozenset()) -> None:
        for at in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[at]]
            if tag in tags:
                flush()
                del stack[at:]
                return
            if tag in scope:
                return

    def skipped(tag: str, at: int) -> int:
        """Where an element whose start tag ends at at is over; a start tag alone if it is not closed."""
        if tag in _RAW:
            m = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            return m.end() if m else len(html)
        if tag not in closings:
            closings[tag] = _closings(html, tag)
        return closings[tag].get(at, at)

    last = 0
    while m := _TOKEN.search(html, last):
        if m.start() > last:
            text = entities.unescape(html[last : m.start()])
            words.append(text)
            if in_link:
                link_chars += len(text)
        last = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in _SKIPPED:
            if not closing:
                last = skipped(tag, last)
        elif tag in _VOID:
            if tag == "br":
                words.append(" ")
            elif tag == "hr":
                flush()
        elif closing:
            if tag == "a":
                in_link = False
            end({tag})
        else:
            if tag == "a":
                in_link = True
            name, firm, soft = _marks(tag, attributes)
            firm |= tag in _BAD_TAGS
            if tag in ("html", "body"):
                if tag == "body":
                    end({"head"})
                continue
            if tag not in _BLOCKS and not firm and not soft:
                continue
            if tag in _BLOCKS and tag != "p":
                end({"p"}, _SCOPE)
            if tag == "p":
                end({"p"}, _SCOPE)
            if tag in _ENDS:
                end(_ENDS[tag], _SCOPE)
            flush()
            above = stack[-1]
            inside = page.inside[above] or tag in ("article", "main")
            if tag == "header" and not page.inside[above]:
                firm = True
            stack.append(len(page.tag))
            page.tag.append(tag)
            page.name.append(name)
            page.parent.append(above)
            page.firm.append(firm or page.firm[above])
            page.soft.append(soft)
            page.inside.append(inside)
    if last < len(html):
        words.append(entities.unescape(html[last:]))
    flush()
    _settle(page)
    return page


def _running(text: str, links: int) -> bool:
    return 2 * links <= len(text)


def _settle(page: Page) -> None:
    """Whether each element is marked: by its own state or classes, or by what it stands in.

    A class does not mark a wrapper of nearly all running text, and an outermost article or main element stands by itself.
    Where classes leave no running text at all, they count for nothing.
    """
    void = set()
    if any(page.soft):
        held = [0] * len(page.tag)
        for node, text, links in page.blocks:
            if not page.firm[node] and _running(text, links):
                held[node] += len(text)
        for node in range(len(held) - 1, 0, -1):
            held[page.parent[node]] += held[node]
        void = {n for n, soft in enumerate(page.soft) if soft and held[0] and 100 * held[n] >= WRAPPER_PERCENT * held[0]}
    for node in range(1, len(page.tag)):
        above = page.parent[node]
        alone = page.tag[node] in ("article", "main") and not page.inside[above]
        page.bad.append(page.firm[node] or (page.soft[node] and node not in void) or (page.bad[above] and not alone))
    if any(page.soft):
        running = [node for node, text, links in page.blocks if _running(text, links)]
        if all(page.bad[n] for n in running) and not all(page.firm[n] for n in running):
            page.bad = list(page.firm)


def container(page: Page, node: int) -> int:
    while node > 0 and page.tag[node] not in _CONTAINERS:
        node = page.parent[node]
    return max(node, 0)


def best_container(page: Page) -> tuple[int, float]:
    """The element that holds the article, and its score."""
    score: dict[int, float] = {}
    for node, text, links in page.blocks:
        if page.bad[node] or not _running(text, links):
            continue
        weight = 1 + min((len(text) - links) / 100, 10)
        at = container(page, node)
        score[at] = score.get(at, 0) + weight
        if at:
            above = container(page, page.parent[at])
            score[above] = score.get(above, 0) + weight / 2
    if not score:
        return 0, 0.0
    best = max(score, key=lambda n: (score[n], -n))
    total = score[best]
    for tag in ("article", "main"):
        found, at = None, best
        while at >= 0:
            if page.tag[at] == tag:
                found = at
            at = page.parent[at]
        if found is not None:
            return found, total
    return _with_siblings(page, best), total


def _with_siblings(page: Page, best: int) -> int:
    """The lowest ancestor of best, below the page itself, that holds all unmarked running text around it."""
    held = [0] * len(page.tag)
    for node, text, links in page.blocks:
        if not page.bad[node] and _running(text, links):
            held[node] += len(text)
    for node in range(len(held) - 1, 0, -1):
        held[page.parent[node]] += held[node]
    outer, at = best, best
    while (at := page.parent[at]) > 0:
        if held[at] > held[outer] and page.tag[at] in _CONTAINERS:
            outer = at
    return outer


def text_below(page: Page, nodes: set[int]) -> str:
    """The blocks below any of nodes that are not marked, in page order."""
    inside: dict[int, bool] = {}

    def below(node: int) -> bool:
        trail = []
        while node >= 0 and node not in nodes and node not in inside:
            trail.append(node)
            node = page.parent[node]
        value = node in nodes or inside.get(node, False)
        inside.update((n, value) for n in trail)
        return value

    return " ".join(text for node, text, _ in page.blocks if not page.bad[node] and below(node))


def extract(html: str | None, path: str | None) -> str:
    """The text in the containers at path, or in the page's own best container."""
    if not html:
        return ""
    page = parse(html)
    last = path.rsplit(">", 1)[-1] if path else None
    nodes = {n for n, name in enumerate(page.name) if name == last and not page.bad[n] and page.path(n) == path}
    text = text_below(page, nodes) if nodes else ""
    return text or text_below(page, {best_container(page)[0]})


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): each page's best container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    page = parse(text)
                    node, score = best_container(page)
                    if score:
                        rows.append((host, page.path(node), score))
            hosts, paths, scores = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, score double")


def winners(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host. Votes are whole hundredths, so that no order of sums matters."""
    total = votes(pages).groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 100).cast("bigint")).alias("votes"))
    return materialise(spark, total.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best")).select("host", "best.path"), "host-paths")


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    tune(spark)
    best = winners(spark, pages)
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(best, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark, table(spark, sf_dir, "pages"))


#: For pages of the shape of the synthetic table, whose article is one element without nested markup of other kinds.
#: References that lack their semicolon, where a title was cut, are references all the same.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1|br)>', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(replace(t, '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, t AS text, length(t) AS n_chars FROM c
"""
