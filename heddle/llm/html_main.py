"""The main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags. What no reader takes for text (scripts, styles, comments of the markup) and
regions that say what they are, by element (nav, header, footer, aside, form), role or class (``NOT_MAIN``), are no
blocks. The others are judged twice:

1. By themselves: blocks mostly of links are bad. Long blocks with many stop words are good; with few stop words they are
   bad, or open within a region that says that it is the article. Short ones, and those with a middling share, are open.
2. Open blocks inherit from the nearest decided blocks: of two that differ, from the nearer one, and a heading from what
   follows it. The borders of an article's region count as good. If no block is good by itself, the longer
   open ones are; if none is decided at all, the open ones stay.

If a page has regions that say they are the article (``article``, ``main``, or such a role or class), blocks outside of
them are bad, unless these regions hold too little of the page's text to be it (``LEAST_SHARE``). Reader comments are often
articles in their markup; a region of comments is not main text, whatever it holds. A form is none either, but where it frames the page.

Blocks that stay are joined by line feeds in page order; in them character references are decoded and white space
becomes single spaces. Nothing is cut off: a tag that the page's end cuts is no text, what comes before it is. A null page is an
empty one and has an empty text, ids may be null or repeat, and each page is judged alone, so no rows give no rows. Columns but the
html and those that are added (``text``, ``n_blocks``, ``n_kept``) pass through. A page of any length is read in one piece, in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from heddle.llm.common import map_batches

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it for on with as was be by at this are or an from have has not but his her they we you i he she"
    " der die das und ist von zu den mit auf für ein eine im nicht dem des sich auch es an als bei aus nach wird war sind oder"
    " le la les de des du et un une est en que qui dans pour pas sur au aux avec par plus ce il elle sont ne se"
    " el los las del y una por con para al lo como su más o pero sus fue".split()
)
# Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements whose contents are no markup, and those that are no text of the page.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NO_TEXT = frozenset("head template svg math object audio video canvas map select datalist button dialog nav footer aside menu search".split())
# Roles, and words in classes and ids, of regions that are not the article; of the last ones only whole names.
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOT_MAIN = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners sidebar sidebars rail widget widgets"
    " nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification"
    " notifications popup modal disclaimer newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular copyright".split()
)
NOT_MAIN_NAMES = frozenset("hidden legal search alert skip tags overlay register foot paging".split())
COMMENTS = frozenset("comment comments commentlist disqus discussion respond reply replies responses".split())
MAIN = frozenset("article articlebody articletext content maincontent main post postbody entry story storybody".split())
#: What may stand before a word of NOT_MAIN in a class that says something about the page, not of the region.
ABOUT = frozenset("with has have no is without not show hide layout page type format category tag".split())

#: Lengths in characters, shares of linked letters, shares of stop words that tell blocks apart.
SHORT, LONG, LINKED, LINKED_LONG, FEW_STOPS, MANY_STOPS = 70, 120, 0.2, 0.5, 0.1, 0.2
#: The share of the page's text that regions must hold to be taken for the article: by class, main, article.
LEAST_SHARE = {1: 0.5, 2: 0.25, 3: 0.25}
#: The share of the page's text from which a form is its frame.
FRAME_SHARE = 0.75

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?+)*+)(?:>|\Z)|</(?:[^a-zA-Z>][^>]*+)?(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|))?""")
LINK_TAG = re.compile(r"</?a(?=[\s/>])", re.IGNORECASE)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.IGNORECASE) for tag in RAW}
WORD = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Elements that end an open one of the same kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class Region:
    """An open element, and what those around it say."""

    tag: str
    block: str = ""  # the innermost element of BLOCK
    out: str = ""  # why it is not main text: "region", "comments", "header" of an article
    main: int = 0  # the innermost region that says it is the article, 0 is none
    level: int = 0  # how plainly the regions around say so: 1 by class, 2 main, 3 article
    form: int = 0
    heading: bool = False
    in_p: bool = False


@dataclass
class Block:
    region: Region
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _called(names: str, words: frozenset[str]) -> bool:
    """Whether one of the classes or ids is one of the words."""
    return any("".join(PARTS.findall(x)).lower() in words for x in names.split())


def _partly_called(names: str, words: frozenset[str]) -> bool:
    """Whether one of the classes or ids begins or ends with one of the words."""
    for name in names.split():
        parts = [x.lower() for x in PARTS.findall(name)]
        if parts and not ABOUT.intersection(parts[:-1]) and (parts[0] in words or parts[-1] in words):
            return True
    return False


def _opened(tag: str, attributes: dict[str, str], around: Region, number: int) -> Region:
    """The region that a start tag opens."""
    block = tag in BLOCK
    here = Region(tag, tag if block else around.block, around.out, around.main, around.level, around.form, around.heading or tag in HEADING, tag == "p" or (around.in_p and not block))
    if tag in ("html", "body"):
        return here
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    role, style = attributes.get("role", "").lower(), attributes.get("style", "").replace(" ", "").lower()
    if here.out == "comments" or (tag != "main" and (_called(names, COMMENTS) or _partly_called(names, COMMENTS))):
        here.out = "comments"
    elif tag == "main" or role == "main":
        here.out, here.main, here.level = "", number, max(here.level, 2)
    elif here.out == "region" or tag in NO_TEXT or role in NOT_MAIN_ROLES or "hidden" in attributes or "display:none" in style or _called(names, NOT_MAIN_NAMES):
        here.out = "region"
    elif tag == "header":
        here.out = "header" if around.main else "region"
    elif _called(names, NOT_MAIN) or (tag != "article" and not _called(names, MAIN) and _partly_called(names, NOT_MAIN)):
        here.out = "region"
    elif tag == "article" or role == "article" or attributes.get("itemprop") == "articleBody":
        here.main, here.level = number, 3
    elif tag in ("div", "section", "td") and (_called(names, MAIN) or _partly_called(names, MAIN)):
        here.main, here.level = number, max(here.level, 1)
    if tag == "form":
        here.form = number
    return here


def blocks(page: str) -> list[Block]:
    """The page's blocks but those of regions that are not main text, in order."""
    found: list[Block] = []
    stack, opened = [Region("")], Counter()
    current: Block | None = None
    link = ""  # "ended" or "open" in a link, the latter if it has no end of its own and so ends with its block

    def take(text: str) -> None:
        nonlocal current
        here = stack[-1]
        if not text or here.out in ("region", "comments") or (here.out == "header" and not here.heading):
            return
        if current is None:
            current = Block(here)
            found.append(current)
        text = html.unescape(text)
        current.parts.append(text)
        if link:
            current.linked += sum(map(len, text.split()))

    def close() -> None:
        opened[stack.pop().tag] -= 1

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        take(page[at : m.start() if m else size])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK
        if block:
            current, link = None, "" if link == "open" else link
        if m[1]:
            if tag == "a":
                link = ""
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
        elif tag == "br":
            take(" ")
        elif tag in RAW:
            at = RAW_END[tag].search(page, at).end()
        elif tag == "a":
            after = LINK_TAG.search(page, at)
            link = "ended" if after and after[0][1] == "/" else "open"
        elif tag not in VOID:
            while block and stack[-1].in_p:
                close()
            if stack[-1].tag in CLOSES.get(tag, ()):
                close()
            attributes = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
            if block or attributes or tag in NO_TEXT:
                if not (m[3].endswith("/") and not block):
                    stack.append(_opened(tag, attributes, stack[-1], m.start() + 1))
                    opened[tag] += 1
    for b in found:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in found if b.text]


def _first_pass(b: Block) -> str:
    size = len(b.text)
    linked = b.linked / max(1, sum(map(len, b.text.split())))
    if linked > (LINKED if size < LONG and not b.region.main else LINKED_LONG) and b.region.block != "h1":
        return "bad"
    if size < SHORT:
        return ""
    words = WORD.findall(b.text.lower())
    if 2 * sum(w[0] < "\u0250" for w in words) < len(words):
        return "good" if size >= LONG else ""  # scripts that the stop words don't have
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if stops >= MANY_STOPS and size >= LONG:
        return "good"
    return "bad" if stops < FEW_STOPS and not b.region.main else ""


def _nearest(found: list[Block]) -> list[tuple[int, str]]:
    """The distance and label of the nearest decided block before each; within the article, at most up to its region's border."""
    out, distance, label, main = [], 0, "", 0
    for b in found:
        if b.region.main != main or not out:
            distance, label, main = 0, "good" if b.region.main else "", b.region.main
        distance += 1
        out.append((distance, label))
        if b.label:
            distance, label = 0, b.label
    return out


def _second_pass(found: list[Block]) -> list[str]:
    """The label of each block, of open ones from the nearest decided blocks."""
    labels = []
    for b, (i, left), (j, right) in zip(found, _nearest(found), reversed(_nearest(found[::-1])), strict=True):
        if b.label:
            labels.append(b.label)
        elif left and right and left != right and b.region.block not in HEADING:
            labels.append("good" if i == j else left if i < j else right)
        else:
            labels.append(right or left or "good")
    return labels


def judged(page: str) -> list[Block]:
    """The blocks of a page with their labels, good or bad."""
    found = blocks(page)
    for b in found:
        b.label = _first_pass(b)
    if not any(b.label == "good" for b in found):
        for b in found:
            b.label = b.label or ("good" if len(b.text) >= SHORT else "")
    weight = lambda bs: sum(len(b.text) for b in bs if b.label != "bad")
    framed = [b for b in found if b.region.form]
    if weight(framed) < FRAME_SHARE * weight(found):
        found = [b for b in found if not b.region.form]
    for level in (3, 2, 1):
        inside = [b for b in found if b.region.level >= level]
        if inside and weight(inside) >= LEAST_SHARE[level] * weight(found):
            found = inside
            break
    for b, label in zip(found, _second_pass(found), strict=True):
        b.label = label
    return found


def main_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` with, in place of its html, the page's main text and the number of blocks that were judged and kept."""
    names = [c for c in df.columns if c not in (html_col, text_col, "n_blocks", "n_kept")]

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, seen, kept = [], [], []
            for page in batch.column(html_col).to_pylist():
                found = judged(page or "")
                good = [b.text for b in found if b.label == "good"]
                texts.append("\n".join(good))
                seen.append(len(found))
                kept.append(len(good))
            added = [pa.array(texts, pa.string()), pa.array(seen, pa.int64()), pa.array(kept, pa.int64())]
            return pa.record_batch([*(batch.column(c) for c in names), *added], [*names, text_col, "n_blocks", "n_kept"])

        return one

    fields = [df.schema[c] for c in names]
    schema = StructType([*fields, StructField(text_col, StringType()), StructField("n_blocks", LongType()), StructField("n_kept", LongType())])
    return map_batches(df.select(*names, html_col), make, schema)


#: For pages of one template, as the test tables have them: their main text is all in one article of plain paragraphs. It is cut
#: out by its tags there, with nothing said of blocks.
ORACLE = r"""
with found as (
  select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*$', '') as inside from pages
), parts as (
  select page_id, url, list_transform(string_split_regex(inside, '</?(?:p|h1)>'), lambda x: replace(replace(x, '<br>', ' '), '<b>', '')) as parts from found
), plain as (
  select page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(replace(replace(x, '&quot;', '"'), '&amp;', '&'), '&quot$', '"'), '&amp$', '&')) as parts from parts
), clean as (
  select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(x, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) as parts from plain
), kept as (
  select page_id, url, list_filter(parts, lambda x: x <> '') as parts from clean
)
select page_id, url, array_to_string(parts, chr(10)) as text, cast(length(array_to_string(parts, chr(10))) as bigint) as n_chars, len(parts) as n_blocks, len(parts) as n_kept from kept
"""
