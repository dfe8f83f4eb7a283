"""Main text of web pages: markup stripped into lines, and the line-block distribution of their text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, forget, small_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template iframe textarea title svg select option".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = frozenset("head nav footer aside form button dialog menu".split())
_ENDS_P = _BLOCK - {"body", "html", "head"}
#: Class, id and role names that mark what isn't the article, whole or as the parts of a name such as cookie-notice.
_MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo"
    " cookie cookies copyright disclaimer disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification pager"
    " pagination popup promo promotion promoted recommended related respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription toolbar topbar widget".split()
)
#: Parts that may stand beside a mark without changing what it says: sidebar-right, ad_slot_2, but not ad-hoc or section-legal.
_NEUTRAL = frozenset("area bar block body bottom box button container content group inner item items left link links list main outer overlay page panel posts primary right secondary site slot text top unit wrap wrapper".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: Lines of a block of the distribution; a block with so many characters outside links is a surge.
LINES, SURGE = 3, 80


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't part of the article, by its name or its attributes. inside: of an article or main element.

    Class, id and role never mark a main element itself, and an article only if it lies in another one, as comments do.
    """
    if name in _DROPPED or name in ("header", "noscript") and not inside:
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key in ("class", "id", "role") and name != "main" and (name != "article" or inside):
            for token in value.split():
                words = _WORD.findall(token)
                if _MARKS.intersection(words) and all(w in _MARKS or w in _NEUTRAL or w.isdigit() for w in words) or words == ["header"] and not inside and name not in ("h1", "h2"):
                    return True
    return False


class Line(NamedTuple):
    """A line's text, its characters outside links (0 in marked elements), 2 in article and 1 in main only, and which article."""

    text: str
    plain: int
    level: int
    article: int
    in_main: bool


def _lines(page: str, marks: bool, exempt: frozenset[int] | set[int] = frozenset()) -> tuple[list[Line], set[int]]:
    """The page's lines in order, and the starts of holders.

    Lines of marked elements stay, as text-free ones: they are dips of the distribution. Text of marked elements inside a
    line is left out. An article inside another that has text already is a comment on it, or a teaser, and is marked. An
    element that holds main isn't marked from there on; neither is one that starts at a place in ``exempt``. Holders are
    the article and main elements and those that hold one, for a reading that exempts them; asides and the like are
    never among them.
    """
    lines: list[Line] = []
    holders: set[int] = set()
    stack: list[tuple[str, bool, int, int]] = []  # name, marked, article 2 or main 1, start
    text: list[str] = []
    plain = number = own = 0
    dropped = False
    skipped = within = articles = links = 0

    def flush() -> None:
        nonlocal plain, dropped, own
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip() if text else ""
        if line or dropped:
            lines.append(Line(line, plain if line else 0, 2 if articles else 1 if within else 0, number, within > articles))
            own += plain if articles else 0
        text.clear()
        plain, dropped = 0, False

    def add(part: str) -> None:
        nonlocal plain, dropped
        if not part:
            return
        if skipped:
            dropped = dropped or not part.isspace()
            return
        text.append(part)
        if not links:
            plain += len(part.strip())

    def close(upto: int) -> None:
        nonlocal skipped, within, articles, links
        for name, marked, article, _ in reversed(stack[upto:]):
            skipped -= marked
            within -= article > 0
            articles -= article == 2
            links -= name == "a"
        del stack[upto:]

    at, lower = 0, None
    while True:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, start)
        if not m:
            add("<")
            at = start + 1
            continue
        at = m.end()
        ending, name, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if name in _BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in _RAW and not attributes.endswith("/"):
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at)
            if end < 0 and name not in ("script", "style"):
                continue  # never closed: its text counts
            at = len(page) if end < 0 else (lower.find(">", end) + 1 or len(page))
            continue
        if name in _VOID:
            continue
        if name in _ENDS_P or name in ("li", "dt", "dd", "tr", "td", "th"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or name in ("li", "tr") and stack[i][0] == name or name in ("td", "th") and stack[i][0] in ("td", "th") or name in ("dt", "dd") and stack[i][0] in ("dt", "dd"):
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        article = 2 if name == "article" else 1 if name == "main" else 0
        if article == 2 and not articles:
            number, own = number + 1, 0
        comment = article == 2 and articles and own >= SURGE
        marked = marks and name not in ("html", "body") and start not in exempt and (comment or _marked(name, attributes, (within if article == 2 else within + article) > 0))
        if article and not marked:
            for holder, _, _, place in reversed(stack):
                if place in holders:
                    break  # so are those around it
                if holder == "form" or holder not in _DROPPED:
                    holders.add(place)
            holders.add(start)
            if article == 1 and not marked and skipped:
                stack = [(holder, False, level, place) for holder, _, level, place in stack]
                skipped = 0
        stack.append((name, marked, article, start))
        skipped += marked
        within += article > 0
        articles += article == 2
        links += name == "a"
    flush()
    return lines, holders


def _own(lines: list[Line], level: int) -> int | None:
    """Characters of the lines inside article (2), or article or main (1); None if there are no such lines."""
    sizes = [x.plain for x in lines if x.level >= level]
    return sum(sizes) if sizes else None


def _weights(lines: list[Line]) -> list[int]:
    """Each line's length in the distribution.

    A page that names its article says where text counts: there, a line with text has SURGE more and so surges by
    itself, however short it is, and elsewhere it has nothing. If articles of main have text, those outside main are
    teasers; else every article counts, whatever its length.
    """
    if not _own(lines, 1):
        return [x.plain for x in lines]
    only_main = any(x.level == 2 and x.in_main and x.plain for x in lines)
    named = [x.level == 1 or x.level == 2 and (x.in_main or not only_main) for x in lines]
    return [(x.plain + SURGE if x.text else 0) if own else 0 for x, own in zip(lines, named, strict=True)]


def _between(lines: list[Line], sizes: list[int], surge: int) -> list[str]:
    """Lines from where blocks of LINES lines surge to where they dive to nothing.

    A region starts at a line with text whose block has ``surge`` characters at least, and ends where a block has none.
    Where the page names its article, only lines inside it are in a region.
    """
    blocks = [sum(sizes[i : i + LINES]) for i in range(len(sizes))]
    named = bool(_own(lines, 1))
    kept, inside = [], False
    for i, line in enumerate(lines):
        if not inside and sizes[i] and blocks[i] >= surge:
            inside = True
        elif inside and not blocks[i]:
            inside = False
        if inside and line.text and (sizes[i] or not named):
            kept.append(line.text)
    return kept


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, joined by two newlines; empty if there is none."""
    if not page:
        return ""
    for marks in (True, False):
        lines, holders = _lines(page, marks)
        if marks and 0 in (_own(lines, 2), _own(lines, 1)):
            # A named article gave no text: what marks it, or an element around it, is a mistake.
            again = _lines(page, True, holders)[0]
            if (_own(again, 2) or 0) > (_own(lines, 2) or 0) or not _own(lines, 1) and _own(again, 1):
                lines = again
        sizes = _weights(lines)
        if kept := _between(lines, sizes, SURGE) or _between(lines, sizes, 1):
            return "\n\n".join(kept)
    return ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches_of(batches):
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points). Other columns are ignored.

    Markup is stripped into lines, one a block element. Elements that are navigation, adverts, forms, comments and the
    like by name, class, id or role, and hidden ones, become lines without text; so do scripts and styles, without
    lines. Text of links doesn't count towards a line's length. Sums of lengths over three lines in turn surge where
    the article starts and dive to nothing where it ends; lines between are kept whole. If the page names its article
    (article or main), its lines weigh more and those outside nothing. Classes, ids and roles never mark these two, nor
    what holds main; if no article gives text, nor what holds one, so that a class on a container loses none, while
    comments and teasers beside or in an article stay out. A page on which this leaves nothing is read once more without
    heed to classes and names. A null or empty page has an empty text; a page of another form is read as it is. Repeated
    rows are rows of their own; very long pages are read whole.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
