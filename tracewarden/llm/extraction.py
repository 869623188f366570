"""Main text of web pages by two passes over text blocks.

Pass one labels blocks by themselves: link density, length and stop-word density, and the element they stand in.  Pass two
gives each ambiguous short block the label of its nearest decided neighbours.  A page is read once, tag by tag; tags
need not be closed.

Outside of an article link density may tell a block from text; inside one, a block with words around its links is never a menu.
There a block of links alone is dropped in a run of ``LINK_RUN`` or more, and open otherwise.  Text of a button goes with the
sentence it stands in, a block of buttons alone goes.  Dropped whole, with all they hold: the elements of ``FURNITURE``,
elements with a word of ``HINTS`` (or one that begins like ``HINT_STARTS``) in class or id, a role of ``HINT_ROLES``, ``hidden`` or
``aria-hidden="true"``; a class such as ``has-sidebar`` does not count.  So an article's own paragraph of class ``notice`` goes too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import rows_in_chunks

# Elements by what they mean for a reader of the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template textarea title select option iframe object svg canvas audio video head datalist annotation annotation-xml".split())
RAW = set("script style textarea title iframe noscript template".split())
FURNITURE = set("nav header footer aside form menu dialog".split())
MAIN = {"article", "main"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = BLOCKS - set("p li dd dt h1 h2 h3 h4 h5 h6 td th tr caption summary legend".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
HINTS = set(
    "ad ads adv advert advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup "
    "promo promotion promoted recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar topbar widget widgets".split())
BESIDE = {"has", "with", "no", "without", "not"}  # "has-sidebar" is said of what stands beside a sidebar
HINT_STARTS = ("advert", "comment", "sidebar", "navbar", "newsletter", "breadcrumb")
HINT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Frequent function words of each language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she "
          "there would their we him been has when who will no more if out so".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um "
          "am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il ce avec sont son aux ou mais comme cette ses été être "
          "nous vous leur ont elle tout fait sans même".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta "
          "ser son dos también fue".split(),
}
MAX_LINK_DENSITY, SHORT, LONG, LINK_RUN = 0.34, 70, 200, 3
STOPS_LOW, STOPS_HIGH = 0.12, 0.25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?|\"[^\"]*\"|'[^']*'", re.S)  # name and value, or a stray quoted text
WORD = re.compile(r"\w+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


@dataclass
class Block:
    text: str
    linked: int  # characters inside links and buttons
    bare: str  # "link" or "button" if all its words are inside such elements, else empty
    furniture: bool  # inside an element that is not the article
    inside: int  # number of the article or main element it stands in, 0 outside


def _is_furniture(tag: str, attributes: str, inside: int) -> bool:
    if tag in FURNITURE and not (tag == "header" and inside):
        return True
    if tag in MAIN or tag in ("html", "body") or not attributes:
        return False
    seen = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if name in seen:  # of repeated attributes the first holds
            continue
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in HINT_ROLES):
            return True
        if name in ("class", "id"):
            words = re.split(r"[^a-z0-9]+", value)
            if any((w in HINTS or w.startswith(HINT_STARTS)) and before not in BESIDE for before, w in zip(["", *words], words)):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in their order, white space folded, character references decoded."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, hidden
    furniture = hidden = links = buttons = linked = pressed = 0
    mains: list[int] = []
    n_mains, parts, free, at = 0, [], [], 0

    def flush() -> None:
        nonlocal parts, free, linked, pressed
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                alone = linked and not WORD.search(html.unescape("".join(free)))
                blocks.append(Block(text, linked, ("link" if pressed < linked else "button") if alone else "", furniture > 0, mains[-1] if mains else 0))
            parts, free, linked, pressed = [], [], 0, 0

    def close(place: int) -> None:
        nonlocal furniture, hidden, links, buttons
        while len(stack) > place:
            tag, bad, unseen = stack.pop()
            furniture -= bad
            hidden -= unseen
            links -= tag == "a"
            buttons -= tag == "button"
            if tag in MAIN and mains:
                mains.pop()

    def say(text: str) -> None:
        nonlocal linked, pressed
        if text and not hidden:
            parts.append(text)
            if links or buttons:
                linked += len(text.strip())
                pressed += len(text.strip()) if buttons else 0
            else:
                free.append(text)

    size = len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                say(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            say(" ")
        if found[1]:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == tag:
                    close(place)
                    break
                if stack[place][0] in CONTAINERS and tag not in CONTAINERS:
                    break
            continue
        if tag in VOID or (found[3] or "").endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "body":
            close(0)
        elif tag in MAIN:  # an article ends furniture that was left open before it
            for place, (_, bad, _) in enumerate(stack):
                if bad and stack[place][0] in FURNITURE:
                    close(place)
                    break
        elif tag in SELF_CLOSING:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] in SELF_CLOSING[tag]:
                    close(place)
                    break
                if stack[place][0] in CONTAINERS:
                    break
        elif tag == "a" and links:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == "a":
                    close(place)
                    break
        if tag in MAIN:
            n_mains += 1
            mains.append(n_mains)
        bad, unseen = _is_furniture(tag, found[3] or "", len(mains)), tag in HIDDEN
        stack.append((tag, bad, unseen))
        furniture += bad
        hidden += unseen
        links += tag == "a"
        buttons += tag == "button"
    flush()
    return blocks


def stop_density(words: list[str], stops: frozenset[str]) -> float:
    return sum(w in stops for w in words) / len(words) if words else 0.0


def first_labels(blocks: list[Block]) -> list[bool | None]:
    """Pass one: True for text of the article, False for the rest, None where a block alone does not tell."""
    words = [WORD.findall(b.text.lower()) for b in blocks]
    free = [w for b, ws in zip(blocks, words) if not b.furniture for w in ws]
    stops = max((frozenset(s) for s in STOP_WORDS.values()), key=lambda s: stop_density(free, s))
    known = stop_density(free, stops) >= STOPS_LOW / 2  # else a language without a list: length decides
    has_main = any(b.inside and not b.furniture for b in blocks)
    labels: list[bool | None] = []
    run = [0] * len(blocks)  # how many blocks of links alone stand together around each
    for at in range(len(blocks)):
        if blocks[at].bare == "link" and not run[at]:
            end = at
            while end < len(blocks) and blocks[end].bare == "link" and blocks[end].inside == blocks[at].inside:
                end += 1
            run[at:end] = [end - at] * (end - at)
    for block, own, together in zip(blocks, words, run):
        links, size, density = block.linked / max(1, len(block.text)), len(block.text), stop_density(own, stops)
        if block.furniture or block.bare == "button" or has_main and not block.inside:
            labels.append(False)
        elif block.inside and block.bare:
            labels.append(False if together >= LINK_RUN else None)
        elif not block.inside and links > MAX_LINK_DENSITY:
            labels.append(False)
        elif block.inside:
            labels.append(True if size >= LONG or size >= SHORT and (density >= STOPS_LOW or not known) else None)
        elif size < SHORT:
            labels.append(None)
        elif not known or density >= STOPS_HIGH and size >= LONG:
            labels.append(True)
        else:
            labels.append(None if density >= STOPS_LOW else False)
    return labels


def settle(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Pass two: open blocks take the label of the nearest decided block, an earlier and a later one at equal distance must agree.

    Neighbours count only inside the same article; an article without any decided block is text as a whole.  Outside
    articles a page without decided blocks has none.
    """
    out: list[bool] = []
    n = len(blocks)
    before, after, last = [None] * n, [None] * n, {}
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = {}
        for i in order:
            if labels[i] is not None and (not blocks[i].inside or labels[i] or not blocks[i].furniture):
                last[blocks[i].inside] = i
            side[i] = last.get(blocks[i].inside)
    for i, label in enumerate(labels):
        if label is None:
            near = sorted((abs(j - i), labels[j]) for j in (before[i], after[i]) if j is not None)
            if not near:
                label = bool(blocks[i].inside)
            elif len(near) == 2 and near[0][0] == near[1][0]:
                label = near[0][1] and near[1][1] or bool(blocks[i].inside) and (near[0][1] or near[1][1])
            else:
                label = near[0][1]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by line breaks; empty for null, empty or article-free pages."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, settle(blocks, first_labels(blocks))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html), repeated rows included.

    A page without main text, also a null one, has the empty text.  Each page is worked on alone, whatever its length.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_in_chunks([batch]):
                texts = [main_text(p.as_py()) for p in part.column(2)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
