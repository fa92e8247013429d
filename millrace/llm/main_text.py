"""The main text of web pages by two passes over their blocks.

A page is cut into blocks, each with its length, its density of stop words and of links, and what its containers say about it. The first
pass decides blocks by these alone: a menu's links and a notice's container are boilerplate, a long block of prose is text. Short blocks,
and those of middling density, stay open. In the second pass an open block inherits the label of its nearest decided
neighbours. Pages are handled alone, so nothing is shuffled, and no page can hold up others.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import small_batches

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = """
a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you
als am auch auf aus bei das dass dem den der des die ein eine einen einer es für hat ich im ist mit nach nicht sich sie sind und von war wie wird zu zum zur
al como con de del el en entre es esta la las lo los más no para pero por que se ser sin sobre su sus un una y
au aux avec ce ces dans des du elle est et il je le les leur mais ne nous on ou par pas plus pour qui sa se ses son sont sur une vous
"""
#: HTML elements that are blocks.
BLOCK_TAGS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
#: HTML elements without content, and those whose content is never text of the page.
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr"
RAW_TAGS = "script style textarea title xmp iframe noembed noframes"
UNREAD_TAGS = "head button select option datalist template noscript svg math object canvas audio video map"
#: Containers that hold no main text, by element, by role and by words of class and id.
NOISE_TAGS = "nav aside footer form menu dialog"
NOISE_ROLES = "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog"
NOISE_WORDS = """
ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist cookie cookies consent copyright disqus footer gdpr
login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies respond
share sharing sidebar signup skip social sponsor sponsored subscribe subscription syndicated toolbar topbar widget widgets
"""
#: Blocks that hold text and no further blocks of a container.
TEXT_BLOCKS = "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote"
#: Containers of the main text; a page header inside one of them is part of it.
TEXT_TAGS, TEXT_ROLES = "article main", "article main"

#: Code points up to which a block is short, and from which one with many stop words is text for certain.
SHORT, LONG = 70, 200
#: Share of stop words of a block that is text perhaps, and of one that is likely text; share of characters in links of boilerplate.
SOME_STOPS, MANY_STOPS, MOST_LINKS = 0.12, 0.28, 0.4

WORDS = {name: frozenset(text.split()) for name, text in globals().copy().items() if name in ("STOP_WORDS", "BLOCK_TAGS", "VOID_TAGS", "RAW_TAGS", "UNREAD_TAGS", "NOISE_TAGS", "NOISE_ROLES", "NOISE_WORDS", "TEXT_BLOCKS", "TEXT_TAGS", "TEXT_ROLES")}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: Where quotes don't close, a tag ends at the first bracket.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TOKEN = re.compile(r"\w+")

GOOD, BAD, NEAR, OPEN = "text", "boilerplate", "near", "open"


@dataclass
class Block:
    """A stretch of text between block tags: its container, and what the first pass needs."""

    zone: int
    parent: int
    noise: bool
    inside: bool
    heading: bool
    text: str = ""
    links: int = 0
    label: str = OPEN
    kept: bool = False


@dataclass
class Container:
    """An open element that matters to the blocks in it."""

    tag: str
    zone: int
    parent: int
    noise: bool
    inside: bool
    unread: bool
    heading: bool


@dataclass
class Page:
    """The walk over a page's tags."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Container] = field(default_factory=lambda: [Container("", 0, 0, False, False, False, False)])
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)
    serial: int = 0
    anchors: int = 0

    def flush(self) -> None:
        """End the block that is open, if it has text."""
        pieces, self.pieces = self.pieces, []
        text = " ".join("".join([p for p, _ in pieces]).split())
        if text:
            at = self.stack[-1]
            linked = [p for p, linked in pieces if linked]
            links = len(" ".join("".join(linked).split())) if linked else 0
            self.blocks.append(Block(at.zone, at.parent, at.noise, at.inside, at.heading, text, links))

    def open(self, tag: str, attributes: str) -> None:
        block = tag in WORDS["BLOCK_TAGS"]
        if block:
            self.flush()
            if tag == "li":
                self.leave("li", "ul ol menu dir")
            elif tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                self.leave("p", "")  # a paragraph ends where another block begins
        elif tag == "br":
            self.pieces.append((" ", self.anchors > 0))
        elif tag == "a":
            self.anchors = 1  # links don't nest
        if tag in WORDS["VOID_TAGS"] or not (block or tag in WORDS["UNREAD_TAGS"] or tag in ("a", "span") and attributes):
            return
        above = self.stack[-1]
        noise, inside, hidden = judged(tag, attributes, above.inside)
        if not block:
            if not (hidden or tag in WORDS["UNREAD_TAGS"]):
                return
            self.push(Container(tag, above.zone, above.parent, above.noise, above.inside, True, above.heading))
            return
        self.serial += 1
        zone = self.serial if inside and not above.inside or noise and not above.noise else above.zone
        parent = above.parent if tag in WORDS["TEXT_BLOCKS"] else self.serial
        self.push(Container(tag, zone, parent, above.noise or noise, above.inside or inside, above.unread or hidden, tag[0] == "h" and tag[1:].isdigit()))

    def push(self, container: Container) -> None:
        self.stack.append(container)
        self.opened[container.tag] += 1

    def drop(self, k: int) -> None:
        """Close all that is open from place k of the stack on."""
        self.opened.subtract(c.tag for c in self.stack[k:])
        del self.stack[k:]

    def leave(self, tag: str, stops: str) -> None:
        """Close the innermost element of this name, and what is open in it, if it isn't outside one of stops; without stops it has to be the innermost block."""
        if not self.opened[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.drop(k)
                return
            if not stops or self.stack[k].tag in stops.split():
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.anchors = 0
        block = tag in WORDS["BLOCK_TAGS"]
        if block:
            self.flush()
        if self.opened[tag]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self.drop(k)
                    return
                if not block and self.stack[k].tag in WORDS["BLOCK_TAGS"]:
                    return

    def add(self, text: str) -> None:
        if text and not self.stack[-1].unread:
            self.pieces.append((html.unescape(text) if "&" in text else text, self.anchors > 0))


def judged(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is a container of noise, one of text, and hidden."""
    noise = tag in WORDS["NOISE_TAGS"] or tag == "header" and not inside
    text, hidden = tag in WORDS["TEXT_TAGS"], False
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                # a page's own frame may be called page-with-sidebar, so elements of text and the body are not judged by names
                noise = noise or not text and tag not in ("body", "html") and not WORDS["NOISE_WORDS"].isdisjoint(w.lower() for w in PART.findall(html.unescape(value)))
            elif name == "role":
                roles = value.lower().split()
                noise = noise or not WORDS["NOISE_ROLES"].isdisjoint(roles)
                text = text or not WORDS["TEXT_ROLES"].isdisjoint(roles)
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value.lower() == "true":
                hidden = True
    return noise, text and not noise, hidden


def cut(source: str) -> list[Block]:
    """The blocks of a page in their order; broken markup is read as far as it goes, in linear time."""
    page, at, quotes_until, n = Page(), 0, 0, len(source)
    lower = source.lower() if source.isascii() else None
    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            page.add(source[at:])
            break
        page.add(source[at:begin])
        follows = source[begin + 1 : begin + 2]
        if follows == "!" or follows == "?":
            end = source.find("-->", begin + 4) if source.startswith("<!--", begin) else source.find(">", begin)
            if end < 0:
                break
            at = end + (3 if source.startswith("<!--", begin) else 1)
            continue
        found = TAG.match(source, begin) if begin >= quotes_until else LOOSE.match(source, begin)
        if found is None and begin >= quotes_until and (follows.isalpha() or follows == "/"):
            # a quote in here doesn't close before the end, so no tag up to the last quote can be read with quotes
            quotes_until = max(source.rfind('"'), source.rfind("'")) + 1
            found = LOOSE.match(source, begin)
        if found is None:
            if follows.isascii() and follows.isalpha() or follows == "/" and source[begin + 2 : begin + 3].isalpha():
                break  # a tag that the page's end cuts off
            if follows == "/":
                end = source.find(">", begin)
                at = n if end < 0 else end + 1
                continue
            page.add("<")
            at = begin + 1
            continue
        closing, tag, attributes = found.groups()
        tag, at = tag.lower(), found.end()
        if closing:
            page.close(tag)
        elif tag in WORDS["RAW_TAGS"]:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(source, at) if lower is None else None
            stop = end.start() if end else (raw_end(lower, tag, at) if lower is not None else -1)
            if stop < 0:
                break
            at = source.find(">", stop)
            if at < 0:
                break
            at += 1
        else:
            page.open(tag, attributes)
    page.flush()
    return page.blocks


def raw_end(lower: str, tag: str, at: int) -> int:
    """Where the end tag of a raw element begins, or -1."""
    end = lower.find(f"</{tag}", at)
    while end >= 0 and lower[end + len(tag) + 2 : end + len(tag) + 3] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
        end = lower.find(f"</{tag}", end + 1)
    return end


def first_pass(block: Block, stop_words: frozenset[str]) -> str:
    """The label that a block has by itself."""
    size = len(block.text)
    density = block.links / size
    if block.noise or density > MOST_LINKS:
        return BAD
    if size < SHORT:
        return BAD if "©" in block.text and not block.inside else OPEN
    words = TOKEN.findall(block.text.lower())
    stops = sum(w in stop_words for w in words) / len(words) if words else 0.0
    if stops >= MANY_STOPS:
        return GOOD if size >= LONG or block.inside else NEAR
    if stops >= SOME_STOPS or block.inside:
        return NEAR
    return BAD


def second_pass(blocks: list[Block]) -> None:
    """Labels for all blocks: open and near ones have those of their nearest decided neighbours.

    Near blocks of one container that are LONG together are text as one long block is. Neighbours in the same container come before
    others. An open block is text if both neighbours are, or if they differ and it is a heading before text; a near block is text
    if one of them is. In a container of text, where only neighbours in it count, near blocks are text always, open ones unless both
    neighbours are boilerplate.
    """
    together = Counter()
    for block in blocks:
        together[block.parent] += len(block.text) * (block.label in (GOOD, NEAR))
    for block in blocks:
        if block.label == NEAR and together[block.parent] >= LONG:
            block.label = GOOD
    forward, backward = neighbours(blocks, range(len(blocks))), neighbours(blocks, range(len(blocks) - 1, -1, -1))
    for block, before, after in zip(blocks, forward, backward):
        found = [n for n in (before, after) if n]
        labels = {label for label, own in found if own} or {label for label, _ in found}
        if block.label in (GOOD, BAD):
            block.kept = block.label == GOOD
        elif block.label == NEAR:
            block.kept = block.inside or GOOD in labels
        elif block.inside:
            block.kept = len(found) < 2 or GOOD in labels
        else:
            block.kept = labels == {GOOD} or block.heading and after is not None and after[0] == GOOD


def neighbours(blocks: list[Block], order: range) -> list[tuple[str, bool] | None]:
    """For each block the label of the last decided one before it in order, and whether both stand in the same container.

    That is one of its container, or one of its zone, or else, outside of containers of text, any that isn't in a noisy one, or else any.
    """
    last: dict[object, str] = {}
    out: list[tuple[str, bool] | None] = [None] * len(blocks)
    for k in order:
        block = blocks[k]
        for key in (("container", block.parent), ("zone", block.zone), *(() if block.inside else ("plain", "any"))):
            if key in last:
                out[k] = last[key], key[0] == "container"
                break
        # blocks near text inside a container of text stand for it
        label = GOOD if block.label == NEAR and block.inside else block.label
        if label in (GOOD, BAD):
            last["container", block.parent] = last["zone", block.zone] = last["any"] = label
            if not block.noise:
                last["plain"] = label
    return out


def classified(source: str | None, stop_words: frozenset[str]) -> list[Block]:
    """The blocks of a page with the label of the first pass and the verdict of the second."""
    blocks = cut(source or "")
    for block in blocks:
        block.label = first_pass(block, stop_words)
    second_pass(blocks)
    return blocks


def main_text(pages: DataFrame, stop_words: frozenset[str] = WORDS["STOP_WORDS"], html_col: str = "html") -> DataFrame:
    """pages with the columns text, n_chars (code points), n_blocks and n_kept instead of the html; one row per row.

    The text is the kept blocks in the page's order, joined by one space; in a block character references are decoded and white space is
    one space. Null, empty and text-free html give an empty text. Repeated rows and ids are rows of their own, the
    other columns may hold anything, nulls too; those with the names of the new ones are replaced. Broken markup is read as
    browsers do, roughly: a tag that isn't closed ends with its container, what an unclosed comment, script or tag holds is lost. The whole page is
    read, of any length, in time that is linear in it. An empty table gives no rows.
    """
    return worked(pages, html_col, "text string, n_chars long, n_blocks long, n_kept long", lambda source: [page_row(classified(source, stop_words))])


def page_row(blocks: list[Block]) -> tuple[str, int, int, int]:
    kept = [b.text for b in blocks if b.kept]
    text = " ".join(kept)
    return text, len(text), len(blocks), len(kept)


def page_blocks(pages: DataFrame, stop_words: frozenset[str] = WORDS["STOP_WORDS"], html_col: str = "html") -> DataFrame:
    """One row per block of pages: the columns of pages but html, with block (from 0), block_text, link_chars, label (of the first pass) and kept."""
    fields = "block long, block_text string, link_chars long, label string, kept boolean"
    return worked(pages, html_col, fields, lambda source: [(k, b.text, b.links, b.label, b.kept) for k, b in enumerate(classified(source, stop_words))])


def worked(pages: DataFrame, html_col: str, fields: str, rows_of) -> DataFrame:
    """pages without html_col, and for each row of rows_of(html) one row with these further fields."""
    small_batches(pages.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]
    others = [c for c in pages.columns if c not in (html_col, *names)]
    source = pages.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.col(html_col).cast("string").alias("html"))
    schema = ", ".join([f"c{k} {source.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(others))] + [fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        for batch in batches:
            found = [rows_of(x) for x in batch.column("html").to_pylist()]
            at = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64())
            columns = list(zip(*[r for rows in found for r in rows])) or [()] * len(names)
            new = [pa.array(list(c), kinds[f.split()[1]]) for c, f in zip(columns, fields.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(len(others))] + new, [*[f"c{k}" for k in range(len(others))], *names])

    out = source.mapInArrow(work, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(others)], *names)
