"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines: a line is what stands between two tags of block
elements.  Each line weighs its characters outside links, or nothing where the
markup says that it is no article (``NO_TEXT``, ``FURNITURE`` elements, class, id
or role words of ``FURNITURE_WORDS``, hidden elements) or, on a page that marks an
article, where it stands outside of it.  Weights are summed over ``WINDOW`` lines from each
line on.  Text surges where a sum rises above the threshold at a line that weighs
something, and dives where the sum falls to nothing; what lies between is kept.
The threshold is one character where the page marks its article, as all weight is then in it,
and ``SURGE`` else; a page whose sums all stay below ``SURGE`` keeps its heaviest
surge above one character, so short pages are not empty.

Defined results: a null or empty page has an empty text; broken markup (unclosed
or crossed tags, an unclosed comment, script or attribute) is read as far as it
goes; character references are decoded once, after the tags are cut; white space is
what ``str.split`` takes for it, no-break spaces included; ``<br>`` is white
space inside a line; a page of any length is read whole; repeated rows are read each for
itself; null ids and urls pass through; an empty table gives an empty one; other
columns pass through, but for one of the output's name, which is replaced.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: Lines that one sum spans, and characters above which a sum is a surge of text.
WINDOW, SURGE = 3, 86

#: Elements whose content is never text.
NO_TEXT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "title")
#: Elements that hold menus, headers, footers, sidebars and forms.
FURNITURE = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset")
#: Page headers; inside an article the element holds its title.
HEADER = "header"
#: Elements that end a line; others stand inside one.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark what is no article.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs menu navbar navigation nav topbar "
    "masthead footer footnav sidebar widget widgets related recommended share sharing social comment comments disqus replies respond reply cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search pagination pager toolbar complementary contentinfo".split()
)
#: Tokens of those attributes that hold a furniture word and still mark an article.
ARTICLE_WORDS = frozenset("article article-body articlebody post-content entry-content story-body main-content".split())

#: Words before a mark that turn it into a statement on the layout, like ``has-sidebar``.
LAYOUT_WORDS = frozenset("has with no without is".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>)", re.S)
_MARKS = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements that an element's start closes.
_CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


@dataclass
class Line:
    """A line: its text, the characters of it inside links, and where it stands."""

    text: str
    linked: int
    furniture: bool
    article: int

    @property
    def weight(self) -> int:
        return 0 if self.furniture else max(0, len(self.text) - self.linked)


class _Open(NamedTuple):
    """An open element, and what it and its parents say of the text inside."""

    name: str
    furniture: bool
    muted: bool
    article: int
    link: bool


_PAGE = _Open("", False, False, 0, False)


def _marked(attributes: str) -> bool:
    """Whether class, id, role or a hidden state say that the element is no article."""
    for name, double, single, bare in _MARKS.findall(attributes):
        value, name = (double or single or bare).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            return True
        if name in ("class", "id", "role"):
            for token in value.split():
                words = re.split(r"[-_:]+|\d+", token)
                if token not in ARTICLE_WORDS and words[0] not in LAYOUT_WORDS and not FURNITURE_WORDS.isdisjoint(words):
                    return True
    return False


def lines_of(page: str) -> tuple[list[Line], int]:
    """The page's lines, and the strongest mark of an article that it has: 2 for the element, 1 for the main part, 0 for none."""
    lines: list[Line] = []
    parts: list[str] = []
    linked: list[str] = []
    stack = [_PAGE]
    strongest = 0

    def add(text: str) -> None:
        if not stack[-1].muted:
            parts.append(text)
            if stack[-1].link:
                linked.append(text)

    def end_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, len(" ".join(html.unescape("".join(linked)).split())), stack[-1].furniture, stack[-1].article))
        parts.clear()
        linked.clear()

    at, end = 0, len(page)
    while at < end:
        tag = _TOKEN.search(page, at)
        add(page[at : tag.start() if tag else end])
        if not tag:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        attributes = tag[4] or "" if tag[3] is None else tag[3]
        if tag[1]:
            here = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if name in BLOCKS or any(x.name in BLOCKS for x in stack[here:] if here):
                end_line()
            if here:
                del stack[here:]
        elif name in NO_TEXT:
            ended = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = ended.end() if ended else end
        elif name in BLOCKS:
            end_line()
            here = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in BLOCKS), 0)
            if name in _CLOSED_BY.get(stack[here].name, ()):
                del stack[here:]  # with what is open inside it
            if name in VOID:
                continue
            top = stack[-1]
            furniture = top.furniture or name in FURNITURE or name == HEADER and not top.article or name not in ("html", "body", "main") and _marked(attributes)
            article = max(top.article, 0 if furniture else 2 if name == "article" else 1 if name == "main" else 0)
            strongest = max(strongest, article)
            stack.append(_Open(name, furniture, top.muted, article, top.link))
        elif name == "br":
            add(" ")
        elif name and name not in VOID and not attributes.endswith("/"):
            top = stack[-1]
            stack.append(_Open(name, top.furniture, top.muted or name in FURNITURE or _marked(attributes), top.article, top.link or name == "a"))
    end_line()
    return lines, strongest


def surges(weights: list[int], threshold: int) -> list[tuple[int, int]]:
    """Ranges [surge, dive) of lines: a window's sum rises above the threshold at a line of some weight; the sums fall to nothing."""
    n, out, i = len(weights), [], 0
    before = [0]
    for w in weights:
        before.append(before[-1] + w)
    sums = [before[min(n, j + WINDOW)] - before[j] for j in range(n)]
    while i < n:
        if weights[i] and sums[i] >= threshold:
            dive = i + 1
            while dive < n and sums[dive]:
                dive += 1
            while not weights[dive - 1]:
                dive -= 1
            out.append((i, dive))
            i = dive
        i += 1
    return out


def main_text(page: str | None) -> str:
    """The article of one page: lines between surges and dives, but for furniture, joined by one newline."""
    lines, mark = lines_of(page or "")
    if mark:  # all weight is in the article
        kept = surges([(x.article == mark and not x.furniture) * len(x.text) for x in lines], 1)
    else:
        weights = [0 if x.text.startswith("©") else x.weight for x in lines]
        kept = surges(weights, SURGE) or sorted(surges(weights, 1), key=lambda s: -sum(weights[slice(*s)]))[:1]
    return "\n".join(x.text for low, high in kept for x in lines[low:high] if not x.furniture and x.article == mark)


def _texts(column: pa.Array) -> pa.Array:
    out = [pa.array([main_text(x) for x in part.to_pylist()], pa.string()) for part in slices(column)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def extract_text(pages: DataFrame, column: str = "html", output: str = "text") -> DataFrame:
    """Adds the main text of every page; no shuffle, a batch is read slice by slice."""
    extract = F.arrow_udf(_texts, "string")
    plain = [F.col(f"`{c}`") for c in pages.columns if c.lower() != output.lower()]
    return pages.select(*plain, extract(F.col(f"`{column}`")).alias(output))
