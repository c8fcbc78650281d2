"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_UNSEEN = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style noscript template svg textarea title".split()}
_ZEROS, _HUGE = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")
_BLOCKS = frozenset("html head body p div section article main aside header footer nav form ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption hr address fieldset legend details summary dialog menu center".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_FENCES = frozenset("div article section main ul ol table body".split())
_ONE_DEEP = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Tags, roles, and words of a class or id that mark what isn't the article.
_ASIDE_TAGS = frozenset("head nav footer aside form header button select iframe object dialog menu label fieldset".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar note status".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments commentlist discussion disqus respond reply replies"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended widget login signup search skip copyright legal pagination pager toolbar form".split()
)
_MAIN_ROLES, _MAIN_TAGS = frozenset({"main", "article"}), frozenset({"article", "main"})
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Lines in a window, and the characters with which one surges: the usual values of line-block distribution.
WINDOW, SURGE = 3, 86
#: What a character counts in a part that the page marks as article or main.
MARKED = 3


def _kind(tag: str, attrs: str, inside: bool) -> str:
    """``aside``, ``main`` or empty. ``inside``: within an article, whose header is its own."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip() else {}
    words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    role = found.get("role", "").lower()
    if tag in ("html", "body"):
        return ""
    if tag in _MAIN_TAGS or role in _MAIN_ROLES:
        return "aside" if words & {"comment", "comments", "reply"} or "hidden" in found else "main"
    if tag in _ASIDE_TAGS and not (tag == "header" and inside) or role in _ASIDE_ROLES or words & _ASIDE_WORDS:
        return "aside"
    if words & {"article", "story", "entry"} or words >= {"main", "content"} or words >= {"post", "content"} or words >= {"post", "body"}:
        return "main"
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "aside"
    return ""


def _tokens(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, whether it closes, attributes) for each tag, and the rest of the text with an empty tag.

    Comments, declarations and elements without visible text give an empty tag too. Every character is looked at a
    bounded number of times: a page on which the quotes of one tag never end has its quotes ignored from there on, and
    behind the last ``>`` nothing is a tag.
    """
    begin = at = 0
    last, in_quotes = html.rfind(">"), True
    while (start := html.find("<", at)) >= 0:
        name = None
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4) + 3
            if end < 3:  # a comment that never ends hides the rest
                yield html[begin:start], "", False, ""
                return
        elif start > last:
            break
        elif html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start) + 1
        elif name := _NAME.match(html, start):
            quoted = _QUOTED.match(html, name.end()) if in_quotes else None
            in_quotes = in_quotes and quoted is not None
            end = quoted.end() if quoted else html.find(">", name.end()) + 1
        else:
            at = start + 1
            continue
        text, tag = html[begin:start], name.group(2).lower() if name else ""
        if tag in _UNSEEN and not name.group(1):
            shut = _UNSEEN[tag].search(html, end)
            end, name = shut.end() if shut else len(html), None
        yield (text, tag, bool(name.group(1)), html[name.end() : end - 1]) if name else (text, "", False, "")
        begin = at = end
    yield html[begin:], "", False, ""


def _decoded(text: str) -> str:
    """Character references decoded; numbers too large for any character become the replacement character."""
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub("&#", text))
    return unescape(text)


def lines_of(html: str) -> list[tuple[str, bool, bool, int]]:
    """Blocks in page order as (text, in an aside, in a main, characters of links)."""
    lines: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, str]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag, on the stack
    fences: list[int] = []
    blocks: list[int] = []
    parts: list[str] = []
    aside = main = linked = 0
    in_link = False

    def push(tag: str, kind: str) -> None:
        nonlocal aside, main
        places.setdefault(tag, []).append(len(stack))
        if tag in _FENCES:
            fences.append(len(stack))
        if tag in _BLOCKS:
            blocks.append(len(stack))
        stack.append((tag, kind))
        aside, main = aside + (kind == "aside"), main + (kind == "main")

    def pop() -> None:
        nonlocal aside, main
        tag, kind = stack.pop()
        places[tag].pop()
        if tag in _FENCES:
            fences.pop()
        if tag in _BLOCKS:
            blocks.pop()
        aside, main = aside - (kind == "aside"), main - (kind == "main")

    def end_line() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(_decoded("".join(parts)).split()):
                lines.append((text, aside > 0, main > 0, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text.strip()) * in_link

    for text, tag, closing, attrs in _tokens(html):
        if text:
            add(text)
        if not tag:
            continue
        if tag == "a":
            in_link = not closing
        if tag in _BLOCKS:
            end_line()
            in_link = False
        elif tag == "br":
            add(" ")
        if closing:
            walls = blocks if tag not in _BLOCKS else fences if tag in _ONE_DEEP else ()  # an end tag doesn't reach out of its container
            if (mine := places.get(tag)) and not (walls and walls[-1] > mine[-1]):
                for _ in range(len(stack) - mine[-1]):
                    pop()
        elif tag not in _VOID:
            shut = _ONE_DEEP.get(tag, {"p"} if tag in _BLOCKS else ())
            while stack and stack[-1][0] in shut:
                pop()
            kind = _kind(tag, attrs, main > 0)
            if tag in _BLOCKS or kind:
                push(tag, kind)
    end_line()
    return lines


def _between(weight: list[int], sums: list[int], least: float) -> list[int]:
    """Places of the lines from each surge to its dive, with the weighty lines right before a surge; both ends weigh something."""
    kept: list[int] = []
    i = 0
    while i < len(weight):
        if sums[i] <= least:
            i += 1
            continue
        first = i
        while first > (kept[-1] + 1 if kept else 0) and weight[first - 1]:
            first -= 1
        while not weight[first]:
            first += 1
        while i < len(weight) and sums[i]:
            i += 1
        kept += range(first, i)
    return kept


def kept_lines(lines: list[tuple[str, bool, int]], aside: list[bool] | None = None) -> list[int]:
    """Places of the lines (text, in a main, characters of links) that stand between surge and dive points.

    All lines of the page are measured, asides too. A line weighs its length less that of its links twice, in a part
    that is marked as article or main MARKED times that. Weights are summed over windows of WINDOW lines that don't cross the border of such a part. Text begins where
    a window surges over a threshold, or with the weighty lines right before it, and ends before the first window without
    weight; between them every line stays, whatever its share of links. The threshold is SURGE or half of the page's
    largest window, in which lines marked as ``aside`` count nothing, the lesser of them; on a page with marked lines, lines outside need the greater of them.
    """
    parts = [list(part) for _, part in groupby(range(len(lines)), key=lambda i: lines[i][1])]
    weights = [[(MARKED if lines[i][1] else 1) * max(0, len(lines[i][0]) - 2 * lines[i][2]) for i in part] for part in parts]
    sums = [[sum(weight[i : i + WINDOW]) for i in range(len(weight))] for weight in weights]
    own = [[0 if aside and aside[i] else w for i, w in zip(part, weight, strict=True)] for part, weight in zip(parts, weights, strict=True)]
    bounds = SURGE, max((sum(weight[i : i + WINDOW]) for weight in own for i in range(len(weight))), default=0) / 2
    some = any(inside for _, inside, _ in lines)
    return [part[i] for part, weight, near in zip(parts, weights, sums, strict=True) for i in _between(weight, near, max(bounds) if some and not lines[part[0]][1] else min(bounds))]


def main_text(html: str | None) -> str:
    """The text between surge and dive points, lines joined by one newline; of what is left there, lines of menus and other asides go."""
    lines = lines_of(html or "")
    return "\n".join(lines[i][0] for i in kept_lines([(text, inside, links) for text, _, inside, links in lines], [off for _, off, _, _ in lines]) if not lines[i][1])


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each page in ``out``, which replaces a column of that name.

    Null and empty pages, and pages with no text outside menus and the like, give an empty string; an empty table
    gives an empty one. Each row is read alone and whole, in time that grows with its length, however long or broken
    it is; rows that repeat stay and other columns pass.
    """
    return df.withColumn(out, _extract(F.col(html)))


def digest(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
