"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into one line for each block element.  A line weighs its
characters outside links; a line inside a menu, header, footer, sidebar,
notice, advert, form or comment section, by element, role, class or id, weighs
nothing.  Where main and article elements together hold at least as much text as
the lines outside them and outside links, all of them are the article and what lies
outside weighs nothing; where they hold less, as teaser cards do, they weigh like any
line.  Weights are summed over a sliding window of ``LINES`` lines.
Inside an article, a block whose only such names are also headings of prose (``PROSE``) is
dropped only if its lines are short or hold many links; one whose names may be its topic
(``TOPIC``) is kept if it holds most of the article.  A form that holds most of the
page's text is the page.
Where the sum surges above ``SURGE`` a stretch begins, at the first line with
weight in that window; it ends where the sum dives to nothing.  The lines of all
stretches that aren't weightless are the text.

Defined cases: null or empty HTML gives an empty text; broken markup closes as
a browser would close it; an unclosed comment or script runs to the end; a page of any
length is scanned once, without backtracking; repeated
rows give repeated results; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import map_slices

LINES = 3
#: Characters in a window that begin a stretch where no element marks the article.
SURGE = 80
#: Share of a line's characters in links above which it is a menu line outside marked articles.
LINKED = 0.6

# HTML element names by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("audio button canvas datalist head iframe input math-template meter noembed noframes noscript object picture-template progress select svg template textarea title video".split())
AROUND = frozenset("aside dialog footer menu nav search fieldset".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    """ad ads adbox adsense adslot advert advertisement adverts advertising adwrap banner banners breadcrumb breadcrumbs colophon comment commentary commentlist
    comments consent cookie cookiebar cookies copyright disqus discussion follow footer footnav form gdpr header login masthead menu menus modal nav navbar navigation newsletter
    notice notices notification notifications overlay pager pagination popup privacy promo promoted promotion promotions related recommended recommendations
    replies reply respond responses search share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription
    toolbar topbar trending widget widgets""".split()
)
#: Those of the names that also name sections of an article: such a block's lines have so many characters on average, and at most this share in links.
PROSE = frozenset("commentary discussion navigation promotion promotions recommendations related response responses search sharing social".split())
PROSE_LINE, PROSE_LINKED = 60, 0.25
#: Those that may also be what a whole article is about: inside an article such a block is the body if it holds more than half of it, at most that share in links.
TOPIC = PROSE | frozenset("follow login notice notices notification notifications privacy share signin signup skip subscribe subscription trending".split())
#: A header of one of these belongs to the article.
OWN = frozenset("article content entry main page post story".split())
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
RAW = "script|style|xmp|noscript|iframe|noembed|noframes|textarea|title|svg|template"
#: A block that opens closes an open one of the same set, up to one of the bounds.
IMPLIED = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "tr": ("tr td th", ("table",)), "option": ("option", ("select", "datalist"))}

#: Elements whose content is no markup.
RAW_TAGS = frozenset(RAW.split("|"))
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def tokens(source: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, tag, rest, closes) of everything that is no text, in one pass; comments and the like have no tag.

    Quotes hide a ``>`` in attribute values.  Once a value runs to the end of the page,
    as in one that was cut off, quotes no longer count, so that no page is scanned twice.
    """
    at, quotes = 0, True
    lower = source.lower() if len(source.lower()) == len(source) else source
    while (start := source.find("<", at)) >= 0:
        named = _TAG.match(source, start + 1)
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = len(source) if end < 0 else end + 3
            yield start, end, "", "", False
        elif source.startswith(("<!", "<?"), start):
            end = source.find(">", start) + 1
            if not end:
                return
            yield start, end, "", "", False
        elif not named:
            at = start + 1
            continue
        else:
            stop, place = -1, named.end()
            while quotes:
                found = _STOP.search(source, place)
                if not found or not found[1]:
                    stop = found.start() if found else -1
                    quotes = found is not None
                    break
                place = source.find(found[1], found.end()) + 1
                quotes = place > 0
            if stop < 0:
                stop = source.find(">", named.end())
                if stop < 0:
                    return
            end, tag, closes = stop + 1, named[2].lower(), bool(named[1])
            if tag in RAW_TAGS and not closes:
                close = lower.find(f"</{tag}", end)
                over = source.find(">", close) if close >= 0 else -1
                end = over + 1 if over >= 0 else len(source)
                yield start, end, "", "", False
            else:
                yield start, end, tag, source[named.end() : stop], closes
        at = end


INSIDE, AWAY, NAMED, UNSURE, PROSED, FORM, LINK, HIDDEN = "inside", "away", "named", "unsure", "prosed", "form", "link", "hidden"


def _meaning(tag: str, rest: str, in_article: bool) -> tuple[str, ...]:
    """What an element makes of what it holds."""
    out = []
    if tag in UNSEEN:
        out.append(HIDDEN)
    if tag in ("main", "article"):
        out.append(INSIDE)
    if tag in AROUND or tag == "header" and not in_article:
        out.append(AWAY)
    if tag == "form":
        out.append(FORM)
    if tag == "a":
        out.append(LINK)
    if rest and not rest.isspace():
        for name, *values in _MARK.findall(rest):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append(HIDDEN)
            elif name == "role" and value.lower() in ROLES and tag not in ("html", "body"):
                out.append(AWAY)
            elif name in ("class", "id") and tag not in KEPT:
                names = {x.lower() for x in _NAME.findall(value)}
                if names & NAMES and not (names & NAMES == {"header"} and (in_article or names & OWN)):
                    out.append((PROSED if names & NAMES <= PROSE else UNSURE) if in_article and names & NAMES <= TOPIC else NAMED)
    return tuple(out)


#: Text, characters in links, marks, the article, and the open blocks of unsure names with whether prose excuses them.
Line = tuple[str, int, frozenset[str], int, tuple[tuple[int, bool], ...]]
#: Blocks of unsure names, one in another, that are told apart.
DEEP = 32


class _Page:
    """Lines of a page: text, characters in links, and the marks of where it lies."""

    def __init__(self, source: str):
        self.lines: list[Line] = []
        self.stack: list[tuple[str, tuple[str, ...], int, tuple[tuple[int, bool], ...]]] = []
        self.count = dict.fromkeys((INSIDE, AWAY, NAMED, UNSURE, PROSED, FORM, LINK, HIDDEN), 0)
        self.opened: Counter[str] = Counter()
        self.article, self.articles = 0, 0
        self.unsure: tuple[tuple[int, bool], ...] = ()  # the open blocks of unsure names, and whether prose excuses them
        self.blocks = 0
        self.parts: list[str] = []
        self.linked = 0
        at = 0
        for start, end, tag, rest, closes in tokens(source):
            if start > at:
                self.say(source[at:start])
            at = end
            if closes:
                self.close(tag)
            elif tag:
                self.open(tag, rest)
        if at < len(source):
            self.say(source[at:])
        self.flush()

    def say(self, text: str) -> None:
        if not self.count[HIDDEN]:
            self.parts.append(text)
            if self.count[LINK]:
                self.linked += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.lines.append((text, self.linked, frozenset(k for k in (INSIDE, AWAY, NAMED, FORM) if self.count[k]), self.article, self.unsure))
            self.parts, self.linked = [], 0

    def open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            if tag in IMPLIED:
                self.imply(IMPLIED[tag][0].split(), IMPLIED[tag][1])
            else:
                self.imply(["p"], ("table", "td", "th", "button", "article", "section", "div", "li", "body"))
        if tag in VOID:
            return
        meaning = _meaning(tag, rest, bool(self.count[INSIDE]))
        self.stack.append((tag, meaning, self.article, self.unsure))
        self.opened[tag] += 1
        for m in meaning:
            self.count[m] += 1
        if (UNSURE in meaning or PROSED in meaning) and len(self.unsure) < DEEP:
            self.blocks += 1
            self.unsure += ((self.blocks, UNSURE not in meaning),)
        if INSIDE in meaning and self.count[INSIDE] == 1:
            self.articles += 1
            self.article = self.articles

    def pop(self) -> None:
        tag, meaning, self.article, self.unsure = self.stack.pop()
        self.opened[tag] -= 1
        for m in meaning:
            self.count[m] -= 1

    def imply(self, tags: list[str], bounds: tuple[str, ...]) -> None:
        if not any(self.opened[tag] for tag in tags):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in tags:
                while len(self.stack) > depth:
                    self.pop()
                return
            if self.stack[depth][0] in bounds:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for depth in range(len(self.stack) - 1, -1, -1) if self.opened[tag] else ():
            if self.stack[depth][0] == tag:
                while len(self.stack) > depth:
                    self.pop()
                return
            if self.stack[depth][0] in BLOCK and tag not in BLOCK:
                return  # an inline end tag doesn't close blocks


def stretches(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """Half-open ranges of lines between surge and dive points."""
    sums = [sum(weights[i : i + LINES]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(sums):
        if sums[i] < surge or not sums[i]:
            i += 1
            continue
        start = i
        while start and weights[start - 1]:
            start -= 1  # short lines that lead up to the surge
        while not weights[start]:
            start += 1
        end = i
        while end < len(sums) and sums[end]:
            end += 1
        out.append((start, end))
        i = end
    return out


def _settled(lines: list[Line]) -> list[tuple[str, int, frozenset[str], int]]:
    """The lines with their blocks of unsure names and forms told apart by text and links."""
    blocks: dict[int, list[int]] = {}
    whole = form = inside = 0
    for text, linked, marks, article, named in lines:
        for block, _ in named:
            sums = blocks.setdefault(block, [0, 0, 0])
            for i, n in enumerate((1, len(text), linked)):
                sums[i] += n
        if AWAY not in marks and NAMED not in marks:
            whole += len(text)
            form += len(text) * (FORM in marks)
            inside += len(text) * bool(article)
    few = {k for k, (_, size, linked) in blocks.items() if linked <= PROSE_LINKED * size}
    prose = {k for k in few if blocks[k][1] >= PROSE_LINE * blocks[k][0]}
    body = {k for k in few if 2 * blocks[k][1] > inside}
    out = []
    for text, linked, marks, article, named in lines:
        if any(k not in body and not (excused and k in prose) for k, excused in named):
            marks |= {NAMED}
        if FORM in marks and 2 * form <= whole:
            marks |= {AWAY}
        out.append((text, linked, marks, article))
    return out


def main_text(source: str) -> str:
    """The page's article, a line for each block."""
    lines = _settled(_Page(source).lines)
    for ignored in (frozenset((AWAY, NAMED)), frozenset((AWAY,))):
        open_ = [not (marks & ignored) for _, _, marks, _ in lines]
        plain = [len(text) if ok and linked <= LINKED * len(text) else 0 for ok, (text, linked, _, _) in zip(open_, lines)]
        inside = sum(len(text) for ok, (text, _, _, article) in zip(open_, lines) if ok and article)
        if inside and inside >= sum(n for n, (_, _, _, article) in zip(plain, lines) if not article):
            weights = [len(text) if ok and article else 0 for ok, (text, _, _, article) in zip(open_, lines)]
            surge = 1
        else:
            weights = plain
            surge = min(SURGE, max([1, *weights]))
        if any(weights):
            return "\n".join(lines[i][0] for start, end in stretches(weights, surge) for i in range(start, end) if weights[i])
    return ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page.  Rows are independent: no shuffle."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x or "") for x in batch.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

        return each

    return map_slices(df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")), make, "page_id long, url string, text string")
