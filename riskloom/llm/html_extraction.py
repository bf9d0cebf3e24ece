"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides each block by
itself from its length, the share of its characters inside links and the share of
its words that are stop words, and from what encloses it: blocks inside menus,
headers, footers, sidebars, notices, adverts, forms and comments are out. Short and
middling blocks and those with few stop words stay undecided; in the second pass
they take the label of the nearest decided neighbours on either side, within the
same article if there is one. The stop words are those of seven western languages:
on pages where they hardly occur, length and links decide alone.

Defined cases: null and empty pages give an empty text; unclosed tags end with the
page or with the block that encloses them; after a quote that is never closed tags end
at the next ``>``; very long pages take time in proportion to their length; repeated rows
give repeated rows; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.tables import small_batches

#: Tags that begin and end blocks, whose content is no text, and that hold boilerplate.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p"
    " pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template textarea select svg math iframe object head title".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A new paragraph or item ends an open one.
ENDS_ITSELF = frozenset("p li dd dt option tr td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent"
    " cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice"
    " notification pager pagination paywall popup promo promoted promotion related reply replies respond responses"
    " share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: A name that begins with one of these states something about its element, such as ``no-sidebar``.
STATES = frozenset("no not has have with without is".split())
#: The header of one of these holds a title.
TITLED = frozenset("page post entry article section content main".split())
#: Frequent function words of several languages.
STOP_WORDS = frozenset(
    """the of and to in a is that for it was as with be by on not he i this are or his from at which but have an had they
    you were their one all we can her has there been if more when will would who so no she my out up into do any your what
    than its about them then only other time could these two may first some like our over now such how also after most
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
    le de la et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ont ou son aux
    d'un mais comme cette tout nous sa fait été aussi leur bien peut ces y deux si même sans ils elle était on
    el la de que y a en un ser se no haber por con su para como estar tener le lo todo pero más hacer o este ir otro ese
    los las del una al es son fue ha sus entre cuando muy sin sobre también me hasta hay donde quien desde nos todos uno
    il di che è la non per un una in si con del da sono come ma anche più alla dei nel o os as um uma não dos das ao het
    een van dat zijn op te met voor niet aan""".split()
)

#: A comment or declaration begins, or a whole tag. Its quoted values may hold ``>``; where a quote is never closed the
#: tag ends at the next ``>`` (group ``broken``). No part can match in two ways, so a search is linear.
TOKEN = re.compile(
    r"<!--|<!\[CDATA\[|<[!?][^>]*+>"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|(?P<broken>)[^>]*+>)"
)
#: The same without quotes.
PLAIN = re.compile(r"<!--|<!\[CDATA\[|<[!?][^>]*+>|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?P<broken>)[^>]*+>)")
UNTIL = {"<!--": "-->", "<![CDATA[": "]]>"}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.DOTALL)
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)", re.IGNORECASE)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Kana, ideographs and Hangul.
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]+")


@dataclass(frozen=True)
class Rules:
    max_link_density: float = 0.35
    short: int = 70
    long: int = 200
    low_stop: float = 0.12
    high_stop: float = 0.25


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    out: bool = False
    article: bool = False
    heading: bool = False


def _hinted(names: str) -> bool:
    """Whether one of the class names or ids says boilerplate: a word of it is a hint, unless it states
    that something is there or not, or names the header of a text."""
    for name in names.lower().split():
        parts = re.split("[_-]+", name)
        hints = {x for part in parts for x in (part, part.removesuffix("s")) if x in HINTS}
        if hints and parts[0] not in STATES and not (hints == {"header"} and parts[0] in TITLED):
            return True
    return False


def _encloses_boilerplate(tag: str, rest: str, in_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS:
        # The header of an article holds its title.
        return not (tag == "header" and in_article)
    if "=" not in rest and "hidden" not in rest:
        return False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    if values.get("role", "").lower() in ROLES or values.get("aria-hidden") == "true":
        return True
    if HIDDEN.search(values.get("style", "")) or "hidden" in values or BARE_HIDDEN.search(ATTRIBUTE.sub(" ", rest)):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return _hinted(values.get("class", "")) or _hinted(values.get("id", ""))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with their text, the text of links in them, and what encloses them."""
    found = [Block()]
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it makes its content out, whether it is silent
    open_tags: Counter[str] = Counter()
    opened: list[int] = []  # places of the block tags in the stack
    out = silent = article = links = 0

    def fresh(heading: bool = False) -> None:
        found.append(Block(out=out > 0, article=article > 0, heading=heading))

    def pop() -> None:
        nonlocal out, silent, article, links
        tag, made_out, made_silent = stack.pop()
        open_tags[tag] -= 1
        if opened and opened[-1] == len(stack):
            opened.pop()
        out -= made_out
        silent -= made_silent
        article -= tag in ("article", "main")
        links -= tag == "a"
        if tag in BLOCK_TAGS or made_out:
            fresh()

    def text(piece: str) -> None:
        if silent or not piece:
            return
        block = found[-1]
        block.parts.append(piece)
        if links:
            block.link_parts.append(piece)

    at, token = 0, TOKEN
    closed = page.rfind(">") + 1  # no tag ends beyond
    while at < len(page):
        match = token.search(page, at, closed)
        if match is None:
            # What is left has no tag; a comment that is not closed goes on to the end.
            text(re.split("<[!?]", page[at:], maxsplit=1)[0])
            break
        text(page[at : match.start()])
        at = match.end()
        if match[0] in UNTIL:
            end = page.find(UNTIL[match[0]], at)
            at = end + len(UNTIL[match[0]]) if end >= 0 else len(page)
            continue
        tag = (match["tag"] or "").lower()
        if not tag:
            continue
        if match["broken"] is not None:
            token = PLAIN
        rest = match["rest"][:-1]
        ends_here = rest.endswith("/")
        if match["close"]:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in BLOCK_TAGS:
                fresh()
            continue
        if tag in VOID_TAGS:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                fresh()
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if ends_here and tag not in BLOCK_TAGS:
            continue
        if tag in ENDS_ITSELF or (tag in BLOCK_TAGS and stack and stack[-1][0] == "p"):
            # An open paragraph, with inline tags left open in it, ends here.
            ends = tag if tag in ENDS_ITSELF else "p"
            if opened and stack[opened[-1]][0] == ends:
                bottom = opened[-1]
                while len(stack) > bottom:
                    pop()
        makes_out = _encloses_boilerplate(tag, rest.removesuffix("/"), article > 0)
        makes_silent = tag in SILENT_TAGS
        if tag in BLOCK_TAGS:
            opened.append(len(stack))
        open_tags[tag] += 1
        stack.append((tag, makes_out, makes_silent))
        out += makes_out
        silent += makes_silent
        article += tag in ("article", "main")
        links += tag == "a"
        if tag in BLOCK_TAGS or makes_out:
            fresh(tag in HEADINGS)
    return found


def _clean(parts: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(parts))).strip()


def stop_share(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def reach(text: str) -> int:
    """Length in letters of an alphabet; a character that stands for a syllable or a word counts as three."""
    return len(text) + 2 * sum(map(len, WIDE.findall(text)))


def classify(text: str, link_text: str, block: Block, rules: Rules, listed: bool = True) -> bool | None:
    """First pass: whether the block is main text; None where it can't tell alone.

    ``listed`` says whether the stop words are those of the page's language."""
    if block.out:
        return False
    if "\xa9" in text[:2] and not block.article:
        return False
    density = len(link_text) / len(text)
    if density > rules.max_link_density:
        return False
    length = reach(text)
    if length < rules.short:
        return None
    if not listed:
        return True if length > rules.long or block.article else None
    stops, words = stop_share(text)
    stop = stops / max(1, words)
    if stop >= rules.high_stop:
        return True if length > rules.long or block.article else None
    if stop >= rules.low_stop:
        return True if length > rules.long and block.article else None
    # Code, tables, lists and quotations in another language have few stop words too.
    return None


def _listed(found: list[tuple[str, str, Block]], rules: Rules) -> bool:
    """Whether the stop words occur in what can be main text of the page as in the languages they are from."""
    stops = words = 0
    for text, link_text, block in found:
        if not block.out and len(link_text) <= rules.max_link_density * len(text):
            more = stop_share(text)
            stops, words = stops + more[0], words + more[1]
    return stops >= rules.low_stop * words


def extract(page: str | None, rules: Rules = Rules()) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    if not page:
        return ""
    found = [(_clean(b.parts), _clean(b.link_parts), b) for b in blocks(page)]
    found = [x for x in found if x[0]]
    listed = _listed(found, rules)
    kept = [(text, block, classify(text, links, block, rules, listed)) for text, links, block in found]
    # Where the page marks an article, only that can be main text.
    marked = any(b.article and not b.out for _, b, _ in kept)
    first = [False if marked and not b.article else label for _, b, label in kept]
    final = _inherit(first, [b for _, b, _ in kept], marked)
    return "\n\n".join(text for (text, _, _), label in zip(kept, final) if label)


def _nearest(labels: list[bool | None], found: list[Block], marked: bool) -> list[tuple[int, bool] | None]:
    """For every block the place and label of the last decided one before it, in one scan."""
    last, result = None, []
    for j, (label, block) in enumerate(zip(labels, found)):
        result.append(last)
        if marked and not block.article:
            last = None
        elif label is not None and not block.out:
            last = j, label
    return result


def _inherit(labels: list[bool | None], found: list[Block], marked: bool) -> list[bool]:
    """Second pass: the label both neighbours agree on; else a heading follows the block after it, and other
    blocks follow the nearer neighbour. Blocks that are out by what encloses them say nothing about others,
    and inside a marked article only its own blocks are neighbours. Without any decided neighbour the block
    is main text."""

    def decide(i: int, before: tuple[int, bool] | None, after: tuple[int, bool] | None) -> bool:
        if before is None and after is None:
            return found[i].article or not marked
        if before is None or after is None:
            return (before or after)[1]
        if before[1] == after[1] or found[i].heading:
            return after[1]
        ahead, behind = len(labels) - 1 - after[0] - i, i - before[0]
        return before[1] if behind < ahead else after[1] if ahead < behind else True

    # Seen from the end, the neighbour after a block is the one before it.
    behind = _nearest(labels, found, marked)
    ahead = _nearest(labels[::-1], found[::-1], marked)[::-1]
    return [decide(i, behind[i], ahead[i]) if label is None else label for i, label in enumerate(labels)]


def main_texts(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, rules) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint"
    )
