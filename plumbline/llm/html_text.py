"""Main text of web pages by tag-path ratios.

Every piece of text has the path of tags from the root to it. Per path of a page, text length and
punctuation are divided by the number of pieces; the two ratios are smoothed over the pieces in
page order, multiplied, and cut at a share of their standard deviation. The smallest element that
holds all that passes, widened to the article around it, is the main text. Short pieces inside, such
as headings, stay; menus, forms and the like go, unless they turn out to hold most of what passes.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, with raw content, without text of their own
# to show, and those that end the text block before them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select|xmp"
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# Start tags that close an open element of their kind.
ALONE = {"p": "p", "li": "li", "dt": "dd|dt", "dd": "dd|dt", "tr": "tr", "td": "td|th", "th": "td|th", "option": "option"}
CLOSES_P = BLOCK - {"br", "button", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
ASIDE = frozenset("nav footer aside form head menu dialog button fieldset".split())
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|banner|promo|cookies?|consent|gdpr|notice|popup|modal|"
    r"overlay|subscribe|newsletter|sidebar|side-?bar|widget|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|"
    r"footer|site-?header|masthead|comments?|commentlist|disqus|replies|respond|related|share|sharing|social|login|"
    r"search|toolbar)(?:$|[\s_-]|\d)",
    re.I,
)
ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = frozenset(("article", "main"))
PUNCTUATION = re.compile(r"[.,;:!?¿¡…、。，；：！？]")

TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({RAW})(?=[\s/>])(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

# A piece passes from this share of the standard deviation of the fused ratios.
CUT = 0.5
SMOOTH = np.array([1.0, 2.0, 1.0]) / 4
# What asides may be: not shown at all, or named or tagged so, or named so by a part of a longer name only.
HIDDEN, NAMED_SO, PARTLY = 3, 2, 1


def _aside(tag: str, attributes: str, inside_main: bool) -> int:
    """How surely an element is an aside: 0 if it is none."""
    if tag == "head":
        return HIDDEN
    found = NAMED_SO if tag in ASIDE or tag == "header" and not inside_main else 0
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return found
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and ASIDE_NAME.search(value):
            whole = any(all(map(ASIDE_NAME.fullmatch, re.split("[_-]", v))) or ASIDE_NAME.fullmatch(v) for v in value.split())
            found = max(found, NAMED_SO if whole else PARTLY)
        if name == "role" and value.lower() in ASIDE_ROLE:
            found = max(found, NAMED_SO)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HIDDEN
    return found


def pieces(source: str) -> tuple[list[tuple[str, int, tuple[int, ...], tuple[str, ...], bool]], dict[int, int]]:
    """(text, block, elements from the root, their tags, inside a link) of all text that is not hidden,
    and the elements that may be asides."""
    out: list = []
    asides: dict[int, int] = {}
    stack: list[tuple[str, int, bool]] = []  # tag, element, hidden
    element = block = at = 0
    for token in TOKEN.finditer(source):
        if token.start() > at and not (stack and stack[-1][2]):
            tags = tuple(s[0] for s in stack)
            out.append((source[at : token.start()], block, tuple(s[1] for s in stack), tags, "a" in tags))
        at = token.end()
        closing, tag = token.group(2), token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in VOID or token.group(4).endswith("/") and tag not in BLOCK:
            continue
        closes = ALONE.get(tag, "p" if tag in CLOSES_P else None)
        if closes:
            names = closes.split("|")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in names:
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCK:
                    break
        element += 1
        aside = _aside(tag, token.group(4), any(s[0] in MAIN for s in stack))
        if aside:
            asides[element] = aside
        stack.append((tag, element, aside == HIDDEN or bool(stack and stack[-1][2])))
    if at < len(source) and not (stack and stack[-1][2]):
        tags = tuple(s[0] for s in stack)
        out.append((source[at:], block, tuple(s[1] for s in stack), tags, "a" in tags))
    return out, asides


def _passing(found: list) -> np.ndarray:
    fused = _fused(found)
    return fused >= CUT * fused.std()


def _outside(everything: list, asides: dict[int, int]) -> list:
    """The pieces outside asides. What holds most of the text that passes is no aside, if only a part
    of its name says so, or if there is no article outside."""
    rest = [p for p in everything if asides.keys().isdisjoint(p[2])]
    if len(rest) == len(everything):
        return rest
    weight: dict[int, int] = defaultdict(int)
    found, total = [p for p in everything if not p[0].isspace()], 0
    for piece, good in zip(found, _passing(found) if found else (), strict=True):
        if good and not piece[4]:
            total += len(piece[0])
            for e in piece[2]:
                weight[e] += len(piece[0])
    has_article = any(not MAIN.isdisjoint(p[3]) and not p[0].isspace() for p in rest)
    wrong = {e for e, sure in asides.items() if 2 * weight[e] > total and (sure == PARTLY or not has_article)}
    if not wrong:
        return rest
    return [p for p in everything if not any(e in asides and e not in wrong for e in p[2])]


def _fused(found: list) -> np.ndarray:
    """The smoothed product of the two ratios of every piece's path."""
    paths: dict = defaultdict(lambda: [0, 0, 0])
    for text, _, _, tags, linked in found:
        sums = paths[tags]
        sums[0] += 0 if linked else len(text.strip())
        sums[1] += 0 if linked else len(PUNCTUATION.findall(text))
        sums[2] += 1
    ratios = np.array([[paths[p[3]][0] / paths[p[3]][2], paths[p[3]][1] / paths[p[3]][2]] for p in found])
    padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = sum(w * padded[i : i + len(ratios)] for i, w in enumerate(SMOOTH))
    return smooth[:, 0] * (1 + smooth[:, 1])


def main_text(source: str | None) -> str:
    """The main text of one page; empty for null, empty and textless pages.

    White space inside a block is one space, blocks are joined by one space, character references
    are decoded. Nothing is cut, however long.
    """
    everything = _outside(*pieces(source or ""))
    found = [p for p in everything if not p[0].isspace()]
    if not found:
        return ""
    passes = _passing(found)
    content = [p for p, good in zip(found, passes, strict=True) if good]
    # The elements around all of it, and the innermost of them that can be an article or a box.
    line = content[0][2] if content else ()
    for piece in content:
        if piece[2][: len(line)] != line:
            same = [a == b for a, b in zip(line, piece[2], strict=False)]
            line = line[: (same + [False]).index(False)]
    tags = content[0][3][: len(line)] if content else ()
    around = [e for e, tag in zip(line, tags, strict=True) if tag in MAIN]
    boxes = [e for e, tag in zip(line, tags, strict=True) if tag in ("div", "section", "td", "body", "html")]
    chosen = around[-1] if around else boxes[-1] if boxes else None
    in_main = bool(around)
    low = {id(p) for p, good in zip(found, passes, strict=True) if p[4] and not good and not in_main}
    blocks: dict[int, list[str]] = defaultdict(list)
    for piece in everything:
        if (chosen is None or chosen in piece[2]) and id(piece) not in low:
            blocks[piece[1]].append(piece[0])
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
