"""Main text of web pages by tag-path ratios.

A page is read once into blocks: the text between two block-level tags, with the path of block tags above it; outside
articles a tag's class is part of the path. Per path, text length and punctuation are added up and divided by the number of
blocks; both ratios are smoothed over neighbouring paths and fused into one score, and paths under a threshold are not content. Paths
are then joined by container: headings, list items and short paragraphs belong to the container of their
neighbours, and a container is content if its content paths hold a good part of the text outside links, or if they
score and stand like those of such a container. A heading right before content belongs to it. Lists of links go from content containers.

What an element says of itself is a factor of its paths' scores. An article or main element raises them; elements
that are made for menus, footers, forms and the like have none; a class, id or role that names such a part as a
whole (`sidebar`, `site-footer`, not `has-sidebar`) lowers them, unless the element is the page's body, an article, or
holds most of the page's free text as prose. So no page is lost to a name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.words import pieces

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element kinds of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "select", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "button", "label"}
#: Innermost open blocks that a start tag closes.
CLOSES = {t: {"p"} for t in BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "label", "legend", "summary"}}
CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Tags that hold text within a container and are no containers themselves.
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "address", "details", "summary"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "button", "fieldset", "header"}
#: Words that name boilerplate, and words that may stand beside them in such a name.
BOILERPLATE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "sidebar", "widget", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "reply", "replies", "disqus", "respond", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header", "masthead", "login", "signup", "signin", "search", "contentinfo", "complementary", "skip"}
BESIDE = {"site", "main", "page", "global", "top", "bottom", "left", "right", "primary", "secondary", "upper", "lower", "first", "second", "wrapper", "wrap", "container", "box", "area", "section", "block", "bar", "list", "item", "items", "links", "link", "form", "content", "inner", "outer", "panel", "row", "col", "column", "region", "zone", "slot", "unit", "module", "group", "posts", "articles", "stories", "reader", "user", "buttons", "icons", "media", "text", "to", "the", "wp", "js"}
#: Elements that no name lowers.
NEVER_NAMED = {"html", "body", "main", "article"}
#: The factor of a name. An element keeps its score if it holds over half of the free text, in so many characters and marks at least.
NAMED_FACTOR, PROSE, PROSE_MARKS = 0.1, 140, 2
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

#: A content path scores at least this share of the page's best path; a content container holds at least this share of the best container's text.
PATH_SHARE, CONTAINER_SHARE = 0.15, 0.3
#: Factor of scores and texts within an article or main.
ARTICLE_BONUS = 2
#: A container of the same tags as a content container, or within an article like it, is content too if its blocks are this long against the other's.
ALIKE_LENGTH = 0.3
#: Stands for all containers within articles among the numbers of paths.
IN_ARTICLE = -1


def _names(attributes: str, which: str = "") -> list[str]:
    """Names in class, id and role attributes, or in one of them."""
    return [n for m in _NAMED.finditer(attributes) if m[0].lower().startswith(which) for n in (m[1] or m[2] or m[3] or "").split()]


def _says_boilerplate(attributes: str) -> bool:
    """Whether a name as a whole is that of a part which is no content."""
    for name in _names(attributes):
        words = {w.lower() for w in _NAME_WORD.findall(name)}
        if words & BOILERPLATE_WORDS and words <= BOILERPLATE_WORDS | BESIDE:
            return True
    return False


@dataclass(frozen=True)
class Block:
    """`path` and `container` are numbers, equal for equal tag paths (`tags` without classes); `mark` is the innermost
    element around the block that says it is boilerplate, or -1; `linked` counts characters in links."""

    path: int
    container: int
    in_article: bool
    text: str
    linked: int
    mark: int
    heading: bool
    tags: int

    @property
    def free(self) -> int:
        return max(len(self.text) - self.linked, 0)


def blocks(page: str) -> tuple[list[Block], list[tuple[int, bool]]]:
    """(blocks with text in page order, marks: the mark around each marked element and whether it is one by its tag)."""
    paths: dict[tuple, int] = {}
    marks: list[tuple[int, bool]] = []
    # open elements: tag, path, container, mark, article, link, path of bare tags of the container
    root = ("", 0, 0, -1, False, False, 0)
    stack, out, held, linked, at = [root], [], [], 0, 0
    # where the open block elements lie in the stack, how many there are of each tag, and of each inline tag since the last one
    blocks_at, open_blocks, open_inline = [0], Counter(), [Counter()]

    def close_block():
        nonlocal linked
        text = " ".join("".join(held).split())
        top = stack[-1]
        if text:
            out.append(Block(top[1], top[2], top[4], text, linked, top[3], stack[blocks_at[-1]][0] in HEADINGS, top[6]))
        held.clear()
        linked = 0

    def read_text(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            held.append(text)
            if stack[-1][5]:
                linked += len(text)

    def pop_to(depth: int):
        if blocks_at[-1] >= depth:
            close_block()
        while len(stack) > depth:
            tag = stack.pop()[0]
            if tag in BLOCK:
                blocks_at.pop()
                open_inline.pop()
                open_blocks[tag] -= 1
            else:
                open_inline[-1][tag] -= 1

    while (m := _TOKEN.search(page, at)) is not None:
        read_text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            # an inline element ends within its block only; without an open one nothing is searched
            if (open_blocks if tag in BLOCK else open_inline[-1])[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                pop_to(depth)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            elif tag == "br":
                held.append(" ")
            continue
        if stack[blocks_at[-1]][0] in CLOSES.get(tag, ()):
            pop_to(blocks_at[-1])
        if tag in BLOCK:
            close_block()
        _, path, container, mark, article, link, tags = stack[-1]
        by_tag = tag in BOILERPLATE_TAGS and not (tag == "header" and article)
        by_name = not by_tag and tag not in NEVER_NAMED and _says_boilerplate(m[3])
        if by_tag or by_name:
            marks.append((mark, by_tag))
            mark = len(marks) - 1
        if tag in BLOCK:
            label = "" if article or tag in LEAVES else " ".join(_names(m[3], "class")[:1])
            path = paths.setdefault((path, tag, label, by_tag or by_name), len(paths) + 1)
            if not (tag in LEAVES or (tag == "header" and article)):
                container, tags = path, paths.setdefault((tags, tag), len(paths) + 1)
            blocks_at.append(len(stack))
            open_inline.append(Counter())
            open_blocks[tag] += 1
        else:
            open_inline[-1][tag] += 1
        stack.append((tag, path, container, mark, article or tag in ("article", "main"), link or tag == "a", tags))
    read_text(page[at:])
    close_block()
    return out, marks


def _factors(found: list[Block], marks: list[tuple[int, bool]]) -> list[float]:
    """The factor of each mark: 0 within an element that is boilerplate by its tag, NAMED_FACTOR by a name."""
    size, points = [0] * len(marks), [0] * len(marks)
    whole = 0
    for b in found:
        if b.mark >= 0:
            size[b.mark] += b.free
            points[b.mark] += len(PUNCTUATION.findall(b.text))
        else:
            whole += b.free
    # inner marks come behind outer ones
    for i in reversed(range(len(marks))):
        if marks[i][0] >= 0:
            size[marks[i][0]] += size[i]
            points[marks[i][0]] += points[i]
    whole += sum(size[i] for i, (outer, _) in enumerate(marks) if outer < 0)
    out: list[float] = []
    for i, (outer, by_tag) in enumerate(marks):
        prose = 2 * size[i] > whole and size[i] >= PROSE and points[i] >= PROSE_MARKS
        own = 0.0 if by_tag else 1.0 if prose else NAMED_FACTOR
        out.append(min(own, out[outer]) if outer >= 0 else own)
    return out


def chosen_blocks(found: list[Block], factor: list[float]) -> list[bool]:
    """Which blocks are the main text; `factor` is that of each block for what the elements around it say."""
    where = [(b.path, f) for b, f in zip(found, factor, strict=True)]
    order = list(dict.fromkeys(where))
    sums = {p: [0, 0, 0] for p in order}
    for b, p in zip(found, where, strict=True):
        s = sums[p]
        s[0] += b.free
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
    length, points = ([sums[p][k] / sums[p][2] for p in order] for k in (0, 1))

    def smooth(x: list[float]) -> list[float]:
        return [max(v, sum(x[max(i - 1, 0) : i + 2]) / len(x[max(i - 1, 0) : i + 2])) for i, v in enumerate(x)]

    length, points = smooth(length), smooth(points)
    bonus: dict = {}
    for b, p in zip(found, where, strict=True):
        bonus[p] = bonus[b.container] = ARTICLE_BONUS if b.in_article else 1
    # what says it is boilerplate sets no scale for the others
    top = [max((x * (p[1] > 0) for x, p in zip(values, order, strict=True)), default=0) for values in (length, points)]
    score = {p: bonus[p] * p[1] * ((1 + min(a / max(top[0], 1), 1)) * (1 + min(c / max(top[1], 1), 1)) - 1) for p, a, c in zip(order, length, points, strict=True)}
    # a page of nothing but what says it is boilerplate has no main text
    plain = any(p[1] == 1 for p in order)
    content = {p for p in order if plain and p[1] > 0 and score[p] >= PATH_SHARE * max(score.values())}
    weight: dict[int, list] = {}
    for b, p in zip(found, where, strict=True):
        if p in content:
            w = weight.setdefault(b.container, [0.0, 0, b.tags, p[1]])
            w[0] += b.free * p[1]
            w[1] += 1
    best, raised = max((w[0] for w in weight.values()), default=0), max((bonus[c] * w[0] for c, w in weight.items()), default=0)
    chosen = {c for c, w in weight.items() if bonus[c] * w[0] >= CONTAINER_SHARE * (best if bonus[c] > 1 else raised)}
    # mean lengths of the blocks of chosen containers, by their tags, and within articles
    alike: dict[int, float] = {}
    for c in chosen:
        w = weight[c]
        for key in (w[2], IN_ARTICLE) if bonus[c] > 1 else (w[2],):
            alike[key] = max(alike.get(key, 0), w[0] / w[1])
    near = lambda c, w: min((alike[k] for k in ((w[2], IN_ARTICLE) if bonus[c] > 1 else (w[2],)) if k in alike), default=math.inf)
    chosen |= {c for c, w in weight.items() if w[3] == 1 and w[0] / w[1] >= ALIKE_LENGTH * near(c, w)}
    kept = [b.container in chosen and f > 0 for b, f in zip(found, factor, strict=True)]
    if best:
        for run in _runs([i for i, k in enumerate(kept) if k], found):
            for i in run:
                kept[i] = not _links(found[i]) or (len(run) == 1 and where[i] in content)
    for i in reversed(range(len(found) - 1)):
        if found[i].heading and factor[i] == 1 and kept[i + 1] and not _links(found[i]):
            kept[i] = True
    return kept


def main_text(page: str | None, by_names: bool = True) -> str:
    """Blocks of the main text in page order, joined by an empty line; '' if there is none.

    Without `by_names`, only ratios, containers and links choose, whatever elements say of themselves.
    """
    found, marks = blocks(page or "")
    factors = _factors(found, marks)
    factor = [factors[b.mark] if by_names and b.mark >= 0 else 1.0 for b in found]
    return "\n\n".join(b.text for b, k in zip(found, chosen_blocks(found, factor), strict=True) if k)


def _links(block: Block) -> bool:
    return 2 * block.linked > len(block.text)


def _runs(kept: list[int], found: list[Block]) -> list[list[int]]:
    """Neighbouring kept blocks of one path, all of them mostly links or none."""
    return [list(run) for _, run in groupby(kept, lambda i: (found[i].path, _links(found[i])))]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: (id, url, text, n_chars). A null or empty page has the empty text.

    Character references are decoded, white space within a block becomes one space, blocks are joined by two
    line feeds. Unclosed, wrongly nested and cut-off markup is read as browsers do, as far as it matters to
    blocks. Other columns are ignored.
    """

    def apply(batches):
        for batch in batches:
            for part in pieces(batch, html_col):
                texts = [main_text(h) for h in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    chosen = pages.select(id_col, url_col, F.col(html_col).cast("string").alias(html_col))
    return chosen.mapInArrow(apply, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
