"""HTML extraction: main text by two-pass block rules.

A page becomes a list of blocks (runs of text between block-level tags). Pass 1 decides blocks by stop-word
density, length and link density, and decides against blocks inside navigation, forms, notices and the like.
Pass 2 gives each undecided block (short, or of middling stop-word density) the label of its nearest decided
neighbour. Where the page marks its article (<article> or <main>) and half of its long text is inside, the rules run on these
blocks only; a mark around a teaser decides nothing.

Stop words are those of six languages. A page whose long blocks hold few of them is judged by its own frequent short words, scripts
without spaces by their sentence marks. Long blocks with few stop words (tables, code, lists of names) are undecided, and on a page
without any decided prose the long blocks are the text; so no long block is lost for its language.

Defined cases: null, empty or text-free html gives ''. Broken markup never fails, and time is linear in the page's
length. Text after an unclosed tag still counts: a skipped element that is never closed is ignored (a raw one, such as
<script> or <title>, ends at the next tag), an unclosed comment ends at its first `>`, and a `<` that no `>` follows
is text. Quotes count after `=` only; once a page has a value whose quote never closes before a tag's end, its tags
end at their first `>`. Ties: a block between a kept and a dropped neighbour at equal distances stays inside a marked
article; elsewhere it stays if its stop words are of middling density, and goes if it is short. Repeated rows give equal
results, and empty tables give empty ones. Pages of any length are read whole. Other columns of the input pass through; columns named `text` or `n_chars` are replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import by_parts

#: Frequent function words of six languages; a block of prose holds many of them. Fixed values.
STOP_WORDS = frozenset(
    """a about after all an and any are as at be been but by can do for from had has have he her his how i if in
    into is it its more my no not of on one or our out she so than that the their them then there they this to up
    was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et eux il ils la le les leur lui mais ne nous on ou par pas
    plus pour que qui sa se ses son sur un une vous y
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    im in ist mit nach nicht noch nur oder sein sich sie sind so über um und unter von vor war wie wir zu zum zur
    al como con cuando del desde el ella ellos entre era es esta este fue ha hay las lo los más me muy o para pero
    por se si sin sobre su sus también todo una uno ya
    che di e gli ho i non per più questo sono uma em não os às das dos het een van niet zijn""".split()
)
#: Tags whose content is never text of the article. Fixed values.
SKIPPED = frozenset("script style head title noscript template svg math canvas object iframe audio video map select option optgroup datalist textarea button input".split())
#: Of these, the ones whose content is not markup: it ends at the matching end tag only. Fixed values.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Sections that hold no article text. Fixed values.
ASIDES = frozenset("nav footer aside form fieldset dialog menu".split())
#: Tags that end the current block. Fixed values.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot
    th thead tr ul""".split()
)
#: Tags without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A word of an element's class or id that marks what isn't article text. Fixed values.
HINTS = frozenset(
    """ad ads adv advert advertisement adverts adbox adsense banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disqus dfp footer login masthead menu menubar modal nav navbar navigation navmenu newsletter notice
    notification overlay pager pagination paywall popup promo promoted promotion related replies respond share sharing
    sidebar sidenav signup skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split()
)
#: ARIA roles of the same kind. Fixed values.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

LONG_CHARS, HIGH_STOP, LOW_STOP, LINKED = 70, 0.2, 0.1, 0.5
#: Letters of a page's own stop words at most; letters a word on average from which a script has no spaces between words.
OWN_LETTERS, UNSPACED = 4, 12
#: Sentence marks of scripts without spaces.
MARKS = re.compile("[。、！？，；：．।။។]")
BAD, SHORT, NEAR, GOOD = 0, 1, 2, 3

#: A tag. Quotes open a value only after `=`; an apostrophe elsewhere is a letter like others. No part gives back what it has
#: taken, so a failing match takes time in proportion to what it has read.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
#: The same up to the first `>`, for pages with a quote that no tag end follows.
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)([^>]*+)>")
START = re.compile(r"</?[A-Za-z]")
END_TAG = re.compile(r"</([A-Za-z][^\s/<>]*+)")
ATTRIBUTE = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
LETTERS = re.compile(r"[^\W\d_]+")
HINT_WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _aside(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element holds navigation, notices, adverts and the like."""
    if name in ASIDES or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and not HINTS.isdisjoint(HINT_WORDS.findall(value)):
            return True
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)))


class EndTags:
    """Where the end tags of skipped elements are, found in one pass."""

    def __init__(self, page: str) -> None:
        self.at: dict[str, list[int]] = {}
        for m in END_TAG.finditer(page):
            name = m[1].lower()
            if name in SKIPPED:
                self.at.setdefault(name, []).append(m.start())

    def after(self, name: str, at: int) -> list[int]:
        """The first end tag from `at` on, and how many there are; -1 and 0 for none."""
        own = self.at.get(name, ())
        k = bisect_left(own, at)
        return [own[k], len(own) - k] if k < len(own) else [-1, 0]


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, share of it in links, in an aside, in the marked article, heading) of each block with text."""
    out: list[tuple[str, float, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, in an aside, in an article, skipped
    open_names: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    links = 0  # open <a>
    at, end, last_gt = 0, len(page), page.rfind(">")
    last_comment = page.rfind("-->")
    tag, ends = TAG, EndTags(page)
    heading = False

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                total = sum(map(len, parts))
                aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((text, linked / total, aside, article, heading))
            parts.clear()
        linked = 0

    def push(name: str, aside: bool, article: bool, skipped: bool) -> None:
        stack.append((name, aside, article, skipped))
        open_names[name] = open_names.get(name, 0) + 1

    def pop() -> str:
        name = stack.pop()[0]
        open_names[name] -= 1
        return name

    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt > last_gt:
            lt = end
        if lt != at:
            if not (stack and stack[-1][3]):
                piece = page[at:lt]
                parts.append(piece)
                if links:
                    linked += len(piece)
            at = lt
            continue
        if page.startswith("<!--", lt) and lt + 4 <= last_comment:
            at = page.find("-->", lt + 4) + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            at = page.find(">", lt) + 1
            continue
        m = tag.match(page, lt)
        if not m and tag is TAG and START.match(page, lt):
            tag = PLAIN_TAG  # this scan has read the page to its end; no other will
            m = tag.match(page, lt)
        if not m:
            if not (stack and stack[-1][3]):
                parts.append("<")
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
                continue
            if open_names.get(name):
                close_block()
                while pop() != name:
                    pass
            if name in BLOCK_TAGS:
                close_block()
                heading = False
            continue
        if name == "body" and open_names.get("head"):
            while pop() != "head":
                pass
        above = stack[-1] if stack else ("", False, False, False)
        if name in SKIPPED:
            if name in RAW and not m[3].endswith("/"):
                stop = ends.after(name, at)[0]
                if stop >= 0:
                    gt = page.find(">", stop)
                    at = end if gt < 0 else gt + 1
                else:  # never closed: it holds what comes before the next tag
                    stop = page.find("<", at)
                    at = end if stop < 0 else stop
            elif name not in VOID and not m[3].endswith("/") and ends.after(name, at)[1] > open_names.get(name, 0):
                push(name, above[1], above[2], True)
            continue
        if above[3]:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            links += 1
            continue
        aside = above[1] or _aside(name, m[3], above[2])
        if name in BLOCK_TAGS:
            close_block()
            links = 0
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if above[0] == name and name in ("p", "li", "dt", "dd"):
                pop()
                above = stack[-1] if stack else ("", False, False, False)
                aside = above[1] or _aside(name, m[3], above[2])
            if name != "hr" and not m[3].endswith("/"):
                push(name, aside, above[2] or name in ("article", "main"), False)
        elif aside != above[1] and name not in VOID and not m[3].endswith("/"):
            close_block()
            push(name, aside, above[2], False)
    close_block()
    return out


def is_long(block: tuple) -> bool:
    """Whether a block is long, no heading, not in an aside and not mostly links."""
    text, linked, aside, _, heading = block
    return not aside and not heading and linked <= LINKED and len(text) >= LONG_CHARS


def page_stop_words(words: list[list[str]]) -> frozenset[str]:
    """The stop words a page is judged by, from the words of its long blocks: the fixed ones if these are enough of them, else the page's own, words
    of at most OWN_LETTERS letters that occur twice or more."""
    total = sum(map(len, words))
    if sum(w in STOP_WORDS for block in words for w in block) >= LOW_STOP * total:
        return STOP_WORDS
    return frozenset(w for w, n in Counter(w for block in words for w in block if len(w) <= OWN_LETTERS).items() if n > 1)


def first_pass(block: tuple, words: list[str], stop_words: frozenset[str]) -> int:
    """The label of a block by itself. Long blocks with few stop words are undecided; those of a script that has no spaces between words
    are judged by its sentence marks."""
    if not is_long(block):
        return BAD if block[2] or block[1] > LINKED else SHORT
    if sum(w in stop_words for w in words) >= HIGH_STOP * len(words) > 0:
        return GOOD
    return GOOD if words and sum(map(len, words)) > UNSPACED * len(words) and len(MARKS.findall(block[0])) > 1 else NEAR


def decided(found: list[tuple]) -> list[int]:
    """The labels of all blocks after the first pass. Where no block is GOOD, length and link density decide: long undecided blocks are."""
    words = [LETTERS.findall(b[0].lower()) if is_long(b) else [] for b in found]
    stop_words = page_stop_words(words)
    labels = [first_pass(b, w, stop_words) for b, w in zip(found, words, strict=True)]
    return labels if GOOD in labels else [GOOD if label == NEAR else label for label in labels]


def holds_the_article(found: list[tuple]) -> bool:
    """Whether the marked blocks hold half of the page's long text or more, and if there is none, half of its short text."""
    for size in (lambda b: len(b[0]) if is_long(b) else 0, lambda b: len(b[0]) if not b[2] and b[1] <= LINKED else 0):
        inside, all_ = (sum(size(b) for b in found if b[3] or every) for every in (False, True))
        if all_:
            return 2 * inside >= all_
    return False


def second_pass(labels: list[int], asides: list[bool], marked: bool) -> list[bool]:
    """Whether each block stays: undecided ones inherit from the nearest decided block on either side, asides left
    out. Where nothing is decided they stay; a tie goes for the text inside a marked article, else for NEAR only."""
    before, after = [None] * len(labels), [None] * len(labels)
    for seen, order in ((before, range(len(labels))), (after, range(len(labels) - 1, -1, -1))):
        last = None
        for i in order:
            if labels[i] in (BAD, GOOD) and not asides[i]:
                last = i
            seen[i] = last
    keep = []
    for i, label in enumerate(labels):
        if label in (BAD, GOOD):
            keep.append(label == GOOD)
            continue
        a, b = before[i], after[i]
        if a is None and b is None:
            keep.append(True)
        elif a is None or b is None or labels[a] == labels[b]:
            keep.append(labels[b if a is None else a] == GOOD)
        elif i - a != b - i:
            keep.append(labels[a if i - a < b - i else b] == GOOD)
        else:
            keep.append(marked or label == NEAR)
    return keep


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    found = blocks(page or "")
    marked = holds_the_article(found)
    if marked:
        found = [b for b in found if b[3]]
    return " ".join(b[0] for b, stay in zip(found, second_pass(decided(found), [b[2] for b in found], marked), strict=True) if stay)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with `text` (the main text) and `n_chars` (its code points)."""

    @F.pandas_udf("string")
    def text_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from by_parts(lambda part: part.map(main_text, na_action=None))(pages)

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(*kept, text_of(F.col(f"`{html_col}`")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
