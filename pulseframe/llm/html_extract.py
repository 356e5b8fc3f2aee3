"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its path of open elements from the root; elements in a path carry their class and id, so that a
`div` of adverts and a `div` of text differ. For each path the page's blocks are aggregated: characters of text outside links and
punctuation marks, each per block. The two ratios are scaled to the page's greatest, smoothed over neighbouring paths (near in page
order, and alike in their first elements) and fused by their geometric mean. Paths whose fused score reaches a share of the scores'
standard deviation are content. The content root is the deepest element that holds all content; blocks below it belong to the
article even where they are short (a heading, a one-word paragraph). If the root is the whole page, the blocks from the first
content to the last belong to the article, with the headings right before the first.

Elements that by name or role are menus, headers, footers, sidebars, notices, adverts, forms or comments get no score and are never
part of the text; scripts, styles, templates and markup comments are not read as text at all. A `header` inside an `article` or `main`
is the article's own and stays. Words in a class or id that name such parts lower the score of the paths below; where these still reach the
threshold they are content, and where not their blocks don't belong to the article, but for headings under words for a head. The words
don't count on an element that holds most of the page's text outside links. Only an attribute `hidden`, or `aria-hidden` set to true,
makes an element silent.

Inside a block white space becomes one space; blocks are joined by a line feed in page order; character references are decoded. Block
boundaries are the start and end tags of block elements; a `br` is white space. Missing end tags are supplied as browsers do for
paragraphs, list items, table cells and at the end of a parent. A null or empty page has an empty text, as has one without
text. Pages are read in whole; each is handled by itself, so equal pages get equal texts.
"""

from __future__ import annotations

import html
import math
import os
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag, elements whose content is no markup, elements that are not shown as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SILENT = frozenset("head script style title template noscript svg math canvas object audio video iframe select option datalist textarea button noembed noframes map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag in the value's set ends an open element of the key.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
SCOPES = frozenset("ul ol dl table html body article section main div td th blockquote".split())
#: Names that mark an element as no part of an article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup privacy promo promoted promotion recommended related respond search share sharing "
    "sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)

#: Those that may also name the head of an article.
HEAD_WORDS = frozenset("banner header masthead topbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_PART = re.compile(r"[a-z]+|\d+")
_HEADING = re.compile(r"h[1-6](?:\.|\Z)")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


@dataclass(frozen=True)
class RatioSettings:
    #: Width of smoothing in blocks, and share of the standard deviation that content reaches.
    width: float = 2.0
    threshold: float = 0.5
    #: What the score of a path with words for boilerplate is multiplied by.
    lowered: float = 0.05


@dataclass
class _Element:
    tag: str
    label: str
    aside: bool
    words: frozenset[str]
    silent: bool
    number: int


@dataclass
class _Block:
    path: tuple[str, ...]
    numbers: tuple[int, ...]
    aside: bool
    words: list[tuple[int, frozenset[str]]]  # numbers and words of the open elements with words for boilerplate
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _marks(attributes: str) -> tuple[str, frozenset[str], bool, bool]:
    """(class and id for the label, their words for boilerplate, whether the role is such, whether hidden)."""
    names, aside, hidden = [], False, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role":
            aside |= value.strip() in ASIDE_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.strip() == "true"):
            hidden = True
        elif key in ("class", "id"):
            names.append(value)
    label = ".".join(names)
    return label, ASIDE_WORDS.intersection(_PART.findall(label)), aside, hidden


def blocks(page: str) -> list[_Block]:
    """Text blocks of a page in order."""
    stack = [_Element("", "", False, frozenset(), False, 0)]
    out: list[_Block] = []
    current: _Block | None = None
    links, number, at = 0, 0, 0

    def text(value: str) -> None:
        nonlocal current
        if stack[-1].silent:
            return
        if current is None:
            if not value.strip():
                return
            shown = [e for e in stack if e.tag not in INLINE]
            current = _Block(tuple(e.label for e in shown), tuple(e.number for e in shown), stack[-1].aside, [(e.number, e.words) for e in stack if e.words])
            out.append(current)
        current.parts.append(value)
        if links:
            current.linked += len(value.strip())

    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # a tag whose quotes never end
            text("<")
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            text(m[4])
            continue
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            current = None
        if closing:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end tag doesn't end a block
            links = sum(e.tag == "a" for e in stack)
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:  # paragraphs, items and cells that this tag ends
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or tag in ENDED_BY.get(stack[i].tag, ()):
                    del stack[i:]
                elif stack[i].tag in SCOPES and tag not in ENDED_BY.get(stack[i].tag, ()):
                    break
        label, words, aside, hidden = _marks(m[3]) if m[3].strip() else ("", frozenset(), False, False)
        if tag in ("html", "body", "main", "article"):
            aside, words = False, frozenset()
        inside = any(e.tag in ("article", "main") for e in stack)
        aside |= tag in ASIDE_TAGS or (tag == "header" and not inside)
        number += 1
        top = stack[-1]
        stack.append(_Element(tag, f"{tag}.{label}" if label else tag, top.aside or aside, words, top.silent or tag in SILENT or hidden, number))
        links += tag == "a"
        if tag in RAW:  # no markup up to its end tag
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()
        elif m[3].rstrip().endswith("/") and tag in INLINE:
            stack.pop()
            links -= tag == "a"
    return out


def _alike(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of two paths' elements that they begin with in common."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same / max(len(a), len(b))


def boilerplate_words(found: list[_Block], sizes: list[int]) -> list[frozenset[str]]:
    """The words for boilerplate that count for each block, without those of elements that hold most of the page's text outside links."""
    held: dict[int, int] = {}
    plain = [0 if b.aside else max(0, size - b.linked) for b, size in zip(found, sizes, strict=True)]
    for block, n in zip(found, plain, strict=True):
        for number, _ in block.words:
            held[number] = held.get(number, 0) + n
    most = sum(plain) / 2
    return [frozenset().union(*(w for n, w in b.words if held[n] <= most)) for b in found]


def content_paths(found: list[_Block], sizes: list[int], marks: list[int], words: list[frozenset[str]], settings: RatioSettings) -> set[tuple[str, ...]]:
    """Paths that hold content."""
    totals: dict[tuple[str, ...], list[float]] = {}
    places: dict[tuple[str, ...], float] = {}
    named: dict[tuple[str, ...], int] = {}
    for i, block in enumerate(found):
        if not block.aside:
            row = totals.setdefault(block.path, [0.0, 0.0, 0.0])
            row[0] += max(0, sizes[i] - block.linked)
            row[1] += marks[i]
            row[2] += 1
            places[block.path] = places.get(block.path, 0.0) + i
            named[block.path] = named.get(block.path, 0) + bool(words[i])
    if not totals:
        return set()
    paths = list(totals)
    middle = [places[p] / totals[p][2] for p in paths]
    ratios = [[totals[p][0] / totals[p][2], totals[p][1] / totals[p][2]] for p in paths]
    tops = [max(r[k] for r in ratios) or 1.0 for k in (0, 1)]
    smooth = []
    for i, p in enumerate(paths):
        near = [(_alike(p, q) ** 2 * math.exp(-(((middle[i] - middle[j]) / settings.width) ** 2) / 2) if i != j else 1.0) for j, q in enumerate(paths)]
        smooth.append([sum(w * r[k] for w, r in zip(near, ratios, strict=True)) / sum(near) / tops[k] for k in (0, 1)])
    fused = [(math.sqrt(a * b) if b else a / 2) * (1 - (1 - settings.lowered) * named[p] / totals[p][2]) for p, (a, b) in zip(paths, smooth, strict=True)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    least = max(settings.threshold * spread, 0.1 * max(fused))
    return {p for p, f in zip(paths, fused, strict=True) if f >= least and f > 0}


def main_text(page: str | None, settings: RatioSettings = RatioSettings()) -> str:
    """The article of a page."""
    if not page:
        return ""
    found = blocks(page)
    texts = [" ".join(html.unescape("".join(b.parts)).split()) for b in found]
    sizes = [len(t) for t in texts]
    words = boilerplate_words(found, sizes)
    paths = content_paths(found, sizes, [len(_PUNCTUATION.findall(t)) for t in texts], words, settings)
    content = [i for i, b in enumerate(found) if not b.aside and b.path in paths]
    if not content:
        return ""
    # The deepest element with all content; the parent of the only block.
    shared = len(os.path.commonprefix([found[i].numbers for i in content]))
    at = max(0, shared - (2 if len(content) == 1 else 1))
    holder = found[content[0]]
    root, label = holder.numbers[at], holder.path[at]
    first, last = content[0], content[-1]
    heading = [any(map(_HEADING.match, b.path)) for b in found]
    own = [not b.aside and (b.path in paths or not w or (h and w <= HEAD_WORDS)) for b, w, h in zip(found, words, heading, strict=True)]
    if label.split(".")[0] in ("", "html", "body"):
        while first and (texts[first - 1] == "" or (own[first - 1] and heading[first - 1])):
            first -= 1
        kept = range(first, last + 1)
    else:
        kept = [i for i, b in enumerate(found) if root in b.numbers]
    return "\n".join(texts[i] for i in kept if texts[i] and own[i])


def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], type=pa.string())


def extracted(page: Column) -> Column:
    """The main text of a column of pages."""
    return F.arrow_udf(_main_texts, "string")(page)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
