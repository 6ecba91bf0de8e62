"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block of the page. Each line has a weight:
the length of its text that is not link text, and nothing for blocks that are
chrome by their element or their names. Weights are summed over a sliding window
of lines. Text is a run of windows with any weight, from where the sums rise to
where they dive to nothing, if somewhere between they surge; other runs are
left out. Short headings and last lines beside a text are in its run.

A name alone does not make a block chrome that holds the article or most of the
text: wrappers of whole pages have names of what is beside or below the text.
The scanner reads a page once, whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines a window sums, and the sum that is a surge; on a page of short lines, half its largest sum is.
WINDOW, SURGE, SURGE_SHARE = 3, 80, 0.5

TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_PART = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACE = re.compile(r"\s+")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template iframe textarea svg math xmp noembed noframes title".split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CHROME = set("nav footer aside form head dialog menu button select option fieldset search canvas object audio video map datalist".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CHROME_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup overlay modal newsletter subscribe subscription signup sidebar rail nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist respond replies disqus share sharing social related recommended widget login search pagination pager skip".split()
)
#: Names of lists whose entries may be articles of their own, and of what may be longer than the text beside it.
COMMENT_NAMES = set("comment comments commentlist respond replies disqus".split())
AD_NAMES = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored".split())
#: A name that begins so tells what a block has beside it: `with-sidebar`, `no-comments`.
STATES = set("no not non without with has have is hide disable disabled".split())
#: A named block is not chrome if its articles have this share of the text of the page.
ARTICLE_SHARE = 0.25
ARTICLE_ROLES = {"article", "main"}
NAME = re.compile(r"[a-z]+")


def _names(text: str) -> set[str]:
    """Words of a class or id: `cookie-notice_box adSlot with-menu` is cookie, notice, box, ad, slot."""
    parts = [NAME.findall(x) for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", text).lower().split()]
    return {word for words in parts if words and words[0] not in STATES for word in words}


@dataclass
class _Named:
    """A block that is chrome by its names alone, unless what it holds says otherwise."""

    parent: int  # the named block around it, or -1
    names: set[str]
    text: int = 0
    article_text: int = 0
    lines: int = 0
    is_page: bool = False  # it holds a main element or a first heading

    def is_chrome(self, total: int) -> bool:
        if self.is_page and self.article_text >= total * ARTICLE_SHARE:
            return False
        if self.names & COMMENT_NAMES:
            return not (self.is_page and self.text * 2 > total)
        if self.names & AD_NAMES:
            return not self.article_text * 2 > total
        return self.article_text < max(1, total * ARTICLE_SHARE) and not (self.lines > 1 and self.text * 2 > total)


class _Scanner:
    """Tags of a page from left to right, in time that grows with its length."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last_end = page.rfind(">")
        self.lost: set[int] = set()  # quotes from which no tag ends

    def _tag_end(self, at: int) -> int:
        """Place of the `>` that ends a tag: the first outside quotes or, if there is none, the first."""
        opened: list[int] = []
        place = at
        while part := TAG_PART.search(self.page, place):
            if part[0] == ">":
                return part.start()
            close = -1 if part.start() in self.lost else self.page.find(part[0], part.end())
            opened.append(part.start())
            if close < 0:
                break
            place = close + 1
        self.lost.update(opened)
        return self.page.find(">", at)

    def next(self) -> tuple[str, str, bool, str] | None:
        """(text before, element, whether it closes, attributes); the element is empty for a comment or the like. None at the end."""
        page, start, look = self.page, self.at, self.at
        while 0 <= (at := page.find("<", look)) < self.last_end:
            tag = TAG.match(page, at)
            if tag:
                end = self._tag_end(tag.end())
                self.at = end + 1
                return page[start:at], tag[1].lower(), page[at + 1] == "/", page[tag.end() : end]
            if page[at + 1] in "!?":
                # A comment or section that is not closed takes the rest of the page.
                mark = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
                end = page.find(mark, at + 2)
                self.at = end + len(mark) if end >= 0 else len(page)
                return page[start:at], "", False, ""
            look = at + 1
        for mark in ("<!--", "<![CDATA["):
            if 0 <= (at := page.find(mark, look)):
                self.at = len(page)
                return page[start:at], "", False, ""
        return None

    def rest(self) -> str:
        return self.page[self.at :]


def page_lines(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """The lines of a page as (text, length of its link text, is chrome, is in an article, is chrome by names alone)."""
    lines: list[tuple[str, int, bool, bool, int]] = []
    blocks: list[_Named] = []
    parts: list[str] = []
    links = 0
    stack: list[tuple[str, bool, bool, int, int]] = []  # element, is chrome, is in an article, its named block, the outermost article's
    chrome = article = False
    named = outer = -1
    in_link = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            parts.append(raw)
            if in_link:
                links += len(raw.strip())

    def end_line() -> None:
        nonlocal links
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append((text, min(links, len(text)), chrome, article, named))
                own = 0 if chrome else len(text) - min(links, len(text))
                if named >= 0:
                    blocks[named].text += own
                    blocks[named].lines += 1
                # An article counts for the named blocks around it, not for those it holds.
                if article and outer >= 0:
                    blocks[outer].article_text += own
            parts.clear()
        links = 0

    def pop() -> None:
        nonlocal chrome, article, named, outer, in_link
        name = stack.pop()[0]
        opened[name] -= 1
        in_link -= name == "a"
        chrome, article, named, outer = stack[-1][1:] if stack else (False, False, -1, -1)

    scanner = _Scanner(page)
    opened: Counter = Counter()  # how many of each element are open
    while True:
        token = scanner.next()
        if token is None:
            add(scanner.rest())
            break
        before, name, closing, attributes = token
        add(before)
        if not name:
            continue
        if name in BLOCK:
            end_line()
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW and not attributes.endswith("/"):
            end = RAW[name].search(page, scanner.at)
            scanner.at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        # A block ends an open paragraph, an item an open item.
        if name in BLOCK and opened["p"]:
            above = list(takewhile(lambda x: x[0] not in BLOCK, reversed(stack[-4:])))
            if len(above) < min(len(stack), 4) and stack[-1 - len(above)][0] == "p":
                for _ in range(len(above) + 1):
                    pop()
        if name in ("li", "option", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop()
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        role = given.get("role", "").lower()
        is_article = name in ("article", "main") or role in ARTICLE_ROLES or given.get("itemprop", "").lower() == "articlebody"
        is_chrome = (
            name in CHROME
            or (name == "header" and not article)
            or role in CHROME_ROLES
            or "hidden" in given
            or given.get("aria-hidden", "").lower() == "true"
        )
        names = set()
        if name not in ("html", "body", "article", "main", "h1"):
            names = _names(given.get("class", "") if name == "p" else f"{given.get('class', '')} {given.get('id', '')}") & CHROME_NAMES
        if names:
            blocks.append(_Named(named, names))
            named = len(blocks) - 1
        if named >= 0 and (name in ("main", "h1") or role == "main") and not (chrome or is_chrome):
            blocks[named].is_page = True
        # A comment may be an article of its own inside what is chrome already.
        stack.append((name, chrome or is_chrome, article or is_article, named, named if is_article and not article else outer))
        opened[name] += 1
        chrome, article, named, outer = stack[-1][1:]
        in_link += name == "a"
    end_line()
    total = sum(len(text) - links for text, links, is_chrome, *_ in lines if not is_chrome)
    for block in reversed(blocks):
        if block.parent >= 0:
            around = blocks[block.parent]
            around.text += block.text
            around.lines += block.lines
            around.article_text += block.article_text
            around.is_page |= block.is_page
    by_name: list[bool] = []
    for block in blocks:
        by_name.append((block.parent >= 0 and by_name[block.parent]) or block.is_chrome(total))
    return [(text, links, is_chrome or (k >= 0 and by_name[k]), in_article, not is_chrome and k >= 0 and by_name[k]) for text, links, is_chrome, in_article, k in lines]


def main_text(page: str | None) -> str:
    """The kept lines joined by one newline; empty if there is none."""
    lines = page_lines(page or "")
    out = text_lines([x[:4] for x in lines])
    if not out and any(x[4] for x in lines):
        # All was judged chrome: what names alone condemn is kept where it is as dense as a text.
        out = text_lines([(text, links, chrome and not named, False) for text, links, chrome, _, named in lines], share=1.0)
    return "\n".join(out)


def line_weights(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    """How much each line speaks for text.

    Chrome weighs nothing. Elsewhere it is the length without link text. Lines
    of marked articles count in full; where these have a good part of the page's
    text, lines beside them weigh nothing.
    """
    own = [0 if chrome else len(text) - links for text, links, chrome, _ in lines]
    in_article = sum(w for w, (*_, article) in zip(own, lines) if article)
    marked = in_article > 0 and in_article >= sum(own) * ARTICLE_SHARE
    return [(0 if chrome else len(text)) if article else (0 if marked else w) for w, (text, _, chrome, article) in zip(own, lines)]


def text_lines(lines: list[tuple[str, int, bool, bool]], window: int = WINDOW, surge: int = SURGE, share: float = SURGE_SHARE) -> list[str]:
    """The lines of the runs that surge.

    A run begins and ends with a line of some weight, and no window inside it
    weighs nothing. Lines without weight stay in it if they are not chrome.
    Chrome inside an article is taken out first and parts no text.
    """
    lines = [x for x in lines if not (x[2] and x[3])]
    weights = line_weights(lines)
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    least = min(surge, share * max(sums, default=0)) if share < 1 else surge
    beside = any(w > 0 and article for w, (*_, article) in zip(weights, lines))
    out: list[str] = []
    start = None
    for i in range(len(lines) + 1):
        if start is None:
            if i < len(lines) and weights[i] > 0:
                start = end = i  # rise
                surged = False
        elif i == len(lines) or (weights[i] == 0 and sums[i] == 0):
            if surged:  # dive
                out += [text for k, (text, _, chrome, article) in enumerate(lines[start : end + 1], start) if weights[k] > 0 or not (chrome or (beside and not article))]
            start = None
        if start is not None and i < len(lines):
            surged |= sums[i] >= least
            if weights[i] > 0:
                end = i
    return out


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of text).

    A null or empty page has an empty text. Keys and urls pass as they are,
    null or repeated. Other columns are not read. An empty table gives no rows.
    A page of any length is read whole, by one task.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(batches, schema)
