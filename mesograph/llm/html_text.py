"""Main text of web pages by block rules in two passes.

A page is cut into blocks (paragraphs, headings, list items, cells).  The first pass looks at a block alone: share of stop words, length,
share of linked text, and the elements it stands in.  It says good, bad, or leaves short and middling blocks open; the second pass
gives open blocks the label of the nearest decided block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mesograph.llm.common import own_name

# Frequent function words of the languages that the default covers.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you",
    "fr": "au aux avec ce ces dans de des du elle en est et eux il je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht sich sie und von war wie zu zum",
    "es": "al como con de del el ella en entre es esta este fue ha la las lo los más me mi no o para pero por que se ser sin sobre su sus un una y ya",
}
# HTML elements by what they mean for the main text.
DROPPED = frozenset("nav footer aside form button select option menu dialog noscript template svg math iframe object audio video canvas head title label fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words in class names and ids of elements that hold no article text.
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr newsletter subscribe subscription signup "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies related recommended share sharing social "
    "widget popup modal overlay notice notices alert login pagination pager toolbar copyright disclaimer".split())
OUTER_WORDS = frozenset("header search top bottom".split())
LEADING = frozenset("has with no is not".split())

TAG = re.compile(
    r"<!--(?:.*?--!?>|.*)"
    r"|<(?P<raw>script|style|textarea|xmp|noembed|noframes|plaintext)(?=[\s/>])(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class BlockRules:
    """Limits of the first pass: characters of a short and of a long block, shares of stop words, share of linked characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.2
    stop_high: float = 0.3
    links: float = 0.33


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    region: int = 0
    dropped: bool = False
    hinted: bool = False
    text: str = ""


def _aside(names: str, inside: bool) -> bool:
    """Whether a class or id names something beside the article: its first or last part says so."""
    for name in names.split():
        parts = [p.lower() for p in PARTS.findall(name)]
        if parts and parts[0] not in LEADING:
            ends = {parts[0], parts[-1]}
            if ends & ASIDE_WORDS or not inside and len(parts) == 1 and ends & OUTER_WORDS:
                return True
    return False


def _meaning(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """(dropped for its element or attributes, beside the article by its class or id)."""
    dropped = name in DROPPED or name == "header" and not inside
    hinted = False
    if rest and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if key in ("class", "id"):
                hinted |= name != "main" and _aside(value, inside)
            elif key == "role":
                dropped |= value.lower() in ROLES
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                dropped = True
            elif key == "style" and "display:none" in value.replace(" ", "").lower():
                dropped = True
    return dropped, hinted


def cut_blocks(page: str) -> list[Block]:
    """Blocks of a page in order, each with the elements around it told by its flags; markup, comments, scripts and styles are gone.

    `region` numbers the outermost article or main element around the block, 0 outside of all.  Time and memory are linear in the page.
    """
    blocks, stack, opened = [], [], {}
    now = Block()
    links = at = region = regions = 0
    dropped = hinted = 0

    def close() -> None:
        nonlocal now
        now.text = " ".join(html.unescape("".join(now.parts)).split())
        if now.text:
            blocks.append(now)
        now = Block(region=region, dropped=dropped > 0, hinted=hinted > 0)

    def pop() -> str:
        nonlocal region, dropped, hinted
        name, was_dropped, was_hinted, was_region = stack.pop()
        opened[name] -= 1
        dropped, hinted, region = dropped - was_dropped, hinted - was_hinted, was_region
        return name

    for m in TAG.finditer(page):
        if m.start() > at:
            text = page[at:m.start()]
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            links = 0 if m["end"] else 1
        elif name == "br":
            now.parts.append(" ")
        elif name in VOID and name not in BLOCKS:
            continue
        elif name in BLOCKS or name in DROPPED:
            close()
            if m["end"]:
                if opened.get(name):
                    while pop() != name:
                        pass
            elif name not in VOID:
                if name in ("article", "main"):  # a menu that was never closed ends here
                    while opened.get("nav"):
                        pop()
                elif name in ("p", "li", "td", "th", "dd", "dt", "option") and stack and stack[-1][0] == name:
                    pop()
                elif opened.get("p") and stack[-1][0] == "p":
                    pop()
                is_dropped, is_hinted = _meaning(name, m["rest"], region > 0)
                stack.append((name, is_dropped, is_hinted, region))
                opened[name] = opened.get(name, 0) + 1
                dropped, hinted = dropped + is_dropped, hinted + is_hinted
                if name in ("article", "main") and not region and not dropped and not hinted:
                    regions += 1
                    region = regions
            now = Block(region=region, dropped=dropped > 0, hinted=hinted > 0, heading=not m["end"] and name in HEADINGS)
    now.parts.append(page[at:])
    close()
    return blocks


def _first_pass(block: Block, stop_words: Collection[str], rules: BlockRules) -> str:
    """good, bad, near (middling) or short (open) for a block by itself; few stop words leave an unlinked block open, for many languages have other ones."""
    size = len(block.text)
    if block.linked > rules.links * size:
        return "bad"
    if not block.region and "\xa9" in block.text:
        return "bad"
    if block.heading:
        return "short"
    if size < rules.short:
        return "short" if block.region or not block.linked else "bad"
    words = WORD.findall(block.text.lower())
    share = sum(w in stop_words for w in words) / len(words) if words else 0.0
    if share >= rules.stop_high:
        return "good" if size > rules.long else "near"
    if share >= rules.stop_low or block.region:
        return "near"
    return "bad" if block.linked else "short"


def _second_pass(labels: list[str], inside: bool) -> list[bool]:
    """Labels of open blocks from the nearest decided one; at equal distance a middling block is good, a short one only between two good ones.

    Where nothing is decided as good, an article or main element is evidence enough for its open blocks; elsewhere middling blocks count as good, or short ones if there are no others.
    """
    if "good" not in labels:
        best = "near" if "near" in labels and not inside else "short"
        labels = ["good" if x in (best, "near") else x for x in labels]
    n = len(labels)
    before, after, seen = [None] * n, [None] * n, None
    for i, x in enumerate(labels):
        before[i] = seen
        seen = i if x in ("good", "bad") else seen
    seen = None
    for i in range(n - 1, -1, -1):
        after[i] = seen
        seen = i if labels[i] in ("good", "bad") else seen
    out = []
    for i, x in enumerate(labels):
        if x in ("good", "bad"):
            out.append(x == "good")
            continue
        near = {labels[k] for k in (before[i], after[i]) if k is not None and abs(k - i) == min(abs(j - i) for j in (before[i], after[i]) if j is not None)}
        out.append(near == {"good"} or len(near) == 2 and x == "near")
    return out


def main_text(page: str | None, stop_words: Collection[str], rules: BlockRules = BlockRules()) -> str:
    """The article of a page: its blocks in page order, joined by one space; empty for a null page or one without article text."""
    blocks = [b for b in cut_blocks(page or "") if not b.dropped]
    for pool in ([b for b in blocks if not b.hinted], blocks):  # class names are believed unless nothing would be left
        taken = [b for b in pool if b.region] or pool
        inside = bool(taken) and taken[0].region > 0
        kept = _second_pass([_first_pass(b, stop_words, rules) for b in taken], inside)
        text = " ".join(b.text for b, good in zip(taken, kept) if good)
        if text:
            return text
    return ""


def extract_text(pages: DataFrame, page: str = "html", stop_words: Collection[str] | None = None, rules: BlockRules = BlockRules()) -> DataFrame:
    """Add `text`, the main text of the page, and `n_chars`, its code points, to pages (html).

    The project has no web pages among its records; any table with a column of HTML will do.  `stop_words` are the function words of
    the pages' languages, by default those of English, French, German and Spanish together.  Blocks in menus, page headers, footers,
    asides, forms, hidden elements and elements named after adverts, notices or comments are no article text.  If the page has an
    article or main element, only blocks in it are looked at; there, few stop words alone do not make a block bad.

    A null or empty page, and one of markup only, has an empty text.  Pages are read whole, however long, in linear time; unclosed
    tags, comments and quotes end at the next tag or the end of the page.  Each row stands for itself and there is no shuffle: repeated rows repeat, an empty
    table gives an empty one, all columns of `pages` stay (`text` and `n_chars` are replaced if present).
    """
    words = frozenset(stop_words if stop_words is not None else " ".join(STOP_WORDS.values()).split())
    schema = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])

    @F.pandas_udf(schema)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p, words, rules) for p in batch]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    (found,) = own_name(pages, "_extracted")
    return (pages.withColumn(found, extract(F.col(page).cast("string")))
            .withColumns({"text": F.col(f"{found}.text"), "n_chars": F.col(f"{found}.n_chars")}).drop(found))
