"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element's text. A line weighs what its text is long; its tags and
classes change that. Lines inside elements that never hold the article (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments, told by element, role, class or id) and lines that are mostly links weigh nothing.
Where the page marks its article (article or main), a line inside it weighs LEAST more, and one outside it a quarter.
Over the weights a window of lines slides. A surge point is where the window's sum rises to the surge threshold: LEAST,
or less where the page's own largest window is small, so short pages have a text too. A dive point is where the sum
falls to nothing, on pages that mark their article under half the threshold. Between a surge and the next dive point the
lines that weigh something are kept, from the first one to the last one that weighs as much as a surging window's mean.

A null or empty page, and one without such text, has the empty text. Character references are decoded; white space
inside a block becomes one space; blocks are joined by an empty line. Unclosed and stray tags do no harm; the work is
linear in the page's length, and a page is handled alone, whatever its size, so repeated rows give repeated results and
an empty table an empty one. A column of the result's name is replaced; all others stay.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST, SHARE = 3, 80, 0.2
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Their content is no text.
RAW = frozenset("script style noscript template textarea iframe svg object canvas title select option video audio".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Those that may hold other blocks; p and headings end by themselves.
HOLDS = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr dt dd tr td th tbody thead tfoot caption summary legend".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog fieldset search button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
#: Words of a class or id that name what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adunit adsense sponsor sponsored promo promotion banner"
    " sidebar side widget widgets related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs"
    " header masthead topbar footer bottombar cookie cookies consent gdpr notice notices notification alert newsletter subscribe"
    " subscription signup login share sharing social popup modal overlay pagination pager toolbar copyright disclaimer comment"
    " comments commentlist respond replies disqus form search paywall".split()
)
#: Words that may stand beside them in a class or id. A name with any other word (`author-side-note`) is the page's own.
BESIDE = frozenset(
    "a area bar block body bottom box btn button buttons card col column container content first fixed foot group header heading home inline inner item items js last layer left"
    " line link links list local main mini mobile note outer page panel post posts primary right row secondary section sections site slot small sticky sub text the title to top"
    " unit us wide wrap wrapper you your".split()
)


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE:
        return True
    if name == "header":
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in ROLES:
            return True
        if key == "itemprop" and value == "comment":
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            if any(_names_outside(token) for token in value.split()):
                return True
    return False


def _names_outside(token: str) -> bool:
    """Is a class or id made of hints and words beside them only?"""
    words = re.findall("[a-z]+", token)
    return any(w in HINTS for w in words) and all(w in HINTS or w in BESIDE for w in words)


def lines_of(page: str) -> list[tuple[str, bool, bool, int]]:
    """(text, outside the article by its element, inside article or main, characters in links) for each block of text."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, outside, article
    parts: list[str] = []
    link, links, at, heading = 0, 0, 0, ""
    inline_off: list[str] = []  # open inline elements that are outside by their attributes

    def end_line() -> None:
        nonlocal links
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                off, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                if off and heading and article and all(name in ("header", "hgroup") for name, o, a in stack if o and a):
                    off = False  # a heading in the article's own header
                out.append((text, off, article, links))
            parts.clear()
        links = 0

    while m := _TAG.search(page, at):
        if m.start() > at and not inline_off:
            piece = page[at : m.start()]
            parts.append(piece)
            links += len(piece) if link else 0
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page) if name in ("script", "style") else at
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = 0 if closing else 1
        elif name in BLOCK:
            end_line()
            heading = name if name in HEADINGS and not closing else ""
            if name not in HOLDS and not closing:
                if m[3] and name == "p" and _outside(name, m[3], False):
                    stack.append((name, True, stack[-1][2] if stack else False))
                elif stack and stack[-1][0] == "p":
                    stack.pop()
            elif not closing:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                off, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                own = name in ("article", "main")
                stack.append((name, off or _outside(name, m[3], article), article or own))
            elif any(name == x[0] for x in stack):
                while stack.pop()[0] != name:
                    pass
        elif closing:
            if inline_off and inline_off[-1] == name:
                inline_off.pop()
        elif name == "button" or m[3] and not m[3].rstrip().endswith("/") and name in ("span", "small", "label") and (inline_off or _outside(name, m[3], False)):
            inline_off.append(name)
    parts.append(page[at:])
    end_line()
    return out


def weights_of(lines: list[tuple[str, bool, bool, int]], least: int) -> tuple[list[float], bool]:
    """What each line weighs, and whether the page marks its article."""
    marked = any(article and not off for _, off, article, _ in lines)

    def weight(line: tuple[str, bool, bool, int]) -> float:
        text, off, article, links = line
        if off:
            return 0.0
        if marked and article:
            return float(len(text) + least)
        if 2 * links > len(text):
            return 0.0
        return len(text) / 4 if marked else float(len(text))

    return [weight(x) for x in lines], marked


def kept_lines(weights: list[float], marked: bool, window: int, least: int, share: float) -> list[int]:
    """The lines between surge and dive points."""
    sums = [sum(weights[k : k + window]) for k in range(len(weights))]
    surge = max(1.0, min(float(least), share * max(sums, default=0.0)))
    dive = surge / 2 if marked else 0.0
    spans, start = [], None
    for k, total in enumerate([*sums, -1.0]):
        if start is None:
            start = k if total >= surge else None
        elif total <= dive:
            spans.append((start, k))
            start = None
    kept: list[int] = []
    for a, b in spans:
        edges = [k for k in range(a, b) if weights[k] >= (surge / window if marked else 1)]
        kept += [k for k in range(edges[0], edges[-1] + 1) if weights[k] > 0] if edges else []
    return kept


def main_text(page: str | None, window: int = WINDOW, least: int = LEAST, share: float = SHARE) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    weights, marked = weights_of(lines, least)
    return "\n\n".join(lines[k][0] for k in kept_lines(weights, marked, window, least, share))


def extract_text(df: DataFrame, page: str = "html", into: str = "main_text") -> DataFrame:
    """df with the main text of column `page` in column `into`."""

    def extract(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(x.as_py()) for x in pages), pa.string())

    return df.withColumn(into, F.arrow_udf(extract, "string").asNondeterministic()(df[page]))


def query(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    pages = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
