"""Operator 1: main text of web pages by tag-path ratios.

A page is read once into blocks, runs of text between block-level tags. Elements
that never hold an article (navigation, header and footer of the page, asides,
controls, scripts and the like) are passed over. Every other block belongs to the
root-to-leaf path of its block-level tags; an element whose class, id or role says
boilerplate, or a form, carries a mark in the path.

Each path collects text length, punctuation, link text and nodes. The logarithms of
length and punctuation per node are smoothed along the page, averaged again by path,
scaled, and fused. A path is then mixed half and half with its support: the better
of the fused ratios of its container's own blocks and of the article or main
elements around it. Marked paths count a quarter, those outside an article that
holds most of the text a half, and all by the share of their text that is no link.
Paths whose result reaches THRESHOLD of the page's best are content, and just
their blocks are returned.

A null or empty page has an empty text, so has a page without text; unclosed tags
and comments are closed by the page's end, a quote that is never closed is an
ordinary character. Of equally good paths all are content. Repeated rows get equal
answers, pages of any length are read whole, an empty table gives an empty
result, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, tidied

SMOOTH = (0.06, 0.24, 0.4, 0.24, 0.06)
THRESHOLD = 0.4
MARKED = 0.25
OUTSIDE = 0.5
BARE = 0.3  # what a node without punctuation counts

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var nobr blink".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
_DROP = frozenset("head script style noscript template nav footer aside button select option textarea iframe object svg canvas dialog menu audio video map noframes applet title".split())
_KEEP = frozenset("html body article main".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "p": ("p", "td th li div article section body")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "social share sharing shares related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond disqus reply replies toolbar widget widgets "
    "pagination pager skip login search copyright tagcloud hidden".split()
)
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
# Attributes by the rules of HTML: a name, then perhaps a value in quotes or up to white space; other quotes are part of a name or value.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
_TAG = re.compile(rf"""<!--(?:.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?""", re.S)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。，、！？]")


class Block:
    """Text of one node: its path, the paths of the article and main elements around it, and how much of it is link text."""

    __slots__ = ("links", "mains", "path", "text")

    def __init__(self, path: str, mains: tuple[str, ...], text: str, links: int):
        self.path, self.mains, self.text, self.links = path, mains, text, links


def _says(tag: str, attrs: str, inside: bool) -> str:
    """drop, mark or nothing, by an element's name and attributes."""
    if tag in _DROP or (tag == "header" and not inside):
        return "drop"
    mark = "mark" if tag == "form" else ""
    if not attrs or tag in _KEEP:
        return mark
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return "drop"
        if name == "role" and _ROLES & set(value.lower().split()):
            mark = "mark"
        if name in ("class", "id"):
            words = {w.lower() for w in _SPLIT.split(value)}
            if words & _WORDS or ("header" in words and not inside):
                mark = "mark"
    return mark


def blocks(page: str) -> list[Block]:
    """Blocks outside dropped elements, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, str]] = []  # tag, dropped, path
    parts: list[str] = []
    links = inside = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1][2] if stack else "", tuple(x[2] for x in stack if x[0] in ("article", "main")), text, min(links, len(text))))
            parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal inside
        if any(x[0] not in _INLINE for x in stack[depth:]):
            flush()
        for x in stack[depth:]:
            inside -= x[0] in ("article", "main")
        del stack[depth:]

    def say(raw: str) -> None:
        nonlocal links
        if raw and not (stack and stack[-1][1]):
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(x[0] == "a" for x in stack[-4:]):
                links += len(text.strip())

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close(depth)
            elif tag not in _INLINE:
                flush()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and parts:
                parts.append(" ")
            continue
        ends, within = _CLOSES.get(tag, (frozenset(), frozenset()))
        if tag in _CLOSES_P and tag != "p":
            ends, within = frozenset(["p"]), frozenset(["td", "th", "li", "div", "article", "section", "body", "button"])
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                close(i)
                break
            if stack[i][0] in within:
                break
        said = _says(tag, m[3], inside > 0)
        dropped = bool(stack and stack[-1][1]) or said == "drop"
        if tag not in _INLINE:
            flush()
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].endswith("/") and tag in ("path", "circle", "rect", "use"):
            continue
        above = stack[-1][2] if stack else ""
        own = f"/{tag}" if tag not in _INLINE else ""
        stack.append((tag, dropped, f"{above}{own}{'!' if said == 'mark' else ''}"))
        inside += tag in ("article", "main")
    say(page[at:])
    flush()
    return out


def _ratio(found: list[Block], length: dict[str, float], marks: dict[str, float], key) -> dict[str, float]:
    """Fused ratio of each group of blocks by key: the mean of the smoothed ratios of its blocks, scaled by the page's best."""
    sums: dict[str, list[float]] = {}
    for i, b in enumerate(found):
        for name in key(b):
            x = sums.setdefault(name, [0.0, 0.0, 0.0])
            x[0] += length[i]
            x[1] += marks[i]
            x[2] += 1
    best, most = max(length.values()), max(marks.values())
    return {k: math.sqrt((a / n / best if best else 0.0) * (BARE + (1 - BARE) * (c / n / most if most else 0.0))) for k, (a, c, n) in sums.items()}


def _smoothed(line: list[float]) -> dict[int, float]:
    half = len(SMOOTH) // 2
    return {i: sum(w * line[min(max(i + k - half, 0), len(line) - 1)] for k, w in enumerate(SMOOTH)) for i in range(len(line))}


def path_scores(found: list[Block]) -> dict[str, float]:
    """Score of each path of a page."""
    size, marks, link, nodes = Counter(), Counter(), Counter(), Counter()
    for b in found:
        size[b.path] += len(b.text)
        marks[b.path] += len(_PUNCT.findall(b.text))
        link[b.path] += b.links
        nodes[b.path] += 1
    length = _smoothed([math.log1p(size[b.path] / nodes[b.path]) for b in found])
    punct = _smoothed([math.log1p(marks[b.path] / nodes[b.path]) for b in found])
    own = _ratio(found, length, punct, lambda b: (b.path,))
    container = _ratio(found, length, punct, lambda b: (b.path.rpartition("/")[0],))
    around = _ratio(found, length, punct, lambda b: b.mains if "!" not in b.path else ())
    mains = {b.path: b.mains for b in found}
    held = sum(len(b.text) for b in found if b.mains and "!" not in b.path)
    landmark = 2 * held >= sum(len(b.text) for b in found if "!" not in b.path) > 0
    out = {}
    for p in size:
        support = max([container[p.rpartition("/")[0]], *(around.get(m, 0.0) for m in mains[p])])
        score = (own[p] + support) / 2 * (1 - link[p] / max(1, size[p]))
        score *= MARKED if "!" in p else 1.0
        out[p] = score * (OUTSIDE if landmark and not mains[p] else 1.0)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    score = path_scores(found)
    least = THRESHOLD * max(score.values())
    return "\n\n".join(b.text for b in found if score[b.path] >= least)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""
    given = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(map(len, said), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(tidied(run), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_tag_path_ratios": op1}
