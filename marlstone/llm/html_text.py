"""Main text of web pages by two passes over their blocks.

A page becomes blocks of text, each with its length, its share of text in
links and its share of stop words. The first pass calls a block good, bad or,
if it is too short to tell, short. The second pass gives short blocks the
label of the nearest decided neighbours. Where no block has stop words, the
page is in a language that the list lacks: length and links decide alone.
Elements that never hold main text
(menus, headers, footers, sidebars, forms, scripts, adverts, notices,
comments) are left out before; where the page marks its article, blocks
outside it are bad and those inside need no stop words to be good.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose text is never main text.
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas select button textarea input dialog menu head title audio video datalist option".split())
#: Elements that no class drops: the page itself, and what says that it is the main text.
ROOTS = frozenset("html body main".split())
#: Elements whose whole content is raw text.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Last words of names in class, id or role that mark what isn't main text.
BOILER = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices popup modal overlay subscribe newsletter signup login share sharing social related recommended comment comments disqus respond reply replies complementary contentinfo search toolbar pagination pager hidden".split())
#: Words that may follow such a word in a name, as in "related-posts".
CARRIERS = frozenset("area bar block blocks body bottom box button buttons card cards container content form group info inner item items label law left link links list main message meta module panel policy post posts primary region right row secondary section settings slot stories text thread title top unit wrap wrapper zone".split())
#: Words before such a word that turn it round, as in "has-sidebar".
DENIED = frozenset("has is no non not with without anti".split())
#: Such words say little beside a word for the main text, as in "article-header".
WEAK = frozenset("header banner masthead widget pagination pager search login toolbar share sharing social hidden".split())
#: Names of an article's class that say it is a reader's, or leads to another article.
READERS = frozenset("comment comments reply replies".split())
TEASERS = READERS | frozenset("related recommended promo promos promoted sponsor sponsored teaser teasers advert advertisement".split())
#: Words that mark what isn't main text wherever they stand in a name, unless a word for the main text ends it.
STRONG = READERS | frozenset("related recommended sidebar nav navbar navigation breadcrumb breadcrumbs footer advert adverts advertisement advertisements advertising adsense sponsor sponsored newsletter disqus pagination".split())
LEADING = READERS | frozenset("related recommended".split())
#: Words after such a word that turn it round, as in "ad-free".
REFUTED = frozenset("free less off".split())
#: Names of services that place adverts.
PLACERS = frozenset("adsbygoogle doubleclick googleads outbrain taboola".split())
#: What is written together with such a word, as in "commentlist" or "pagefooter".
BEFORE, AFTER = "site page main left right top bottom sub global".split(), "list box area form wrapper container section thread left right bar block menu".split()
#: Words in class or id that mark the main text.
MAIN = frozenset("article main content post entry story body maincontent articlebody".split())
#: Frequent short words of English, French, German and Spanish.
STOP = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "als am auch auf aus bei das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht sich sie sind so um und von war wie wird zu zum zur "
    "al como con del el ella era esta este fue ha hay las lo los me mi muy no nos para pero por sin su sus también una uno y ya".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)|[^<]+|<", re.S)
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=\"'/]+)")
NAMES = re.compile(r"[a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no spaces between words.
WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")


@dataclass
class Block:
    text: str
    linked: int
    inside: bool
    heading: bool
    listed: bool
    article: int = 0
    label: str = field(default="")


COMPOUNDS = {a + b: [a, b] for w in BOILER if len(w) > 5 for a, b in [*((w, x) for x in AFTER), *((x, w) for x in BEFORE)]}


def _names(value: str) -> list[list[str]]:
    """The words of each name of a class or id: "site-header", "siteHeader", "site_header" and "siteheader" have two."""
    return [[x for w in NAMES.findall(HUMP.sub("-", n).lower()) for x in COMPOUNDS.get(w, (w,))] for n in value.split()]


def _bare(name: list[str]) -> str:
    """A name's last word that isn't one for a holder."""
    k = len(name)
    while k > 1 and (name[k - 1] in CARRIERS or name[k - 1].isdigit()) and name[k - 1] not in BOILER:
        k -= 1
    return name[k - 1]


def _unwanted(name: list[str]) -> bool:
    """Whether a name stands for what isn't main text.

    Such a word ends it, or only words for a holder follow one; or a strong
    one stands anywhere before a last word that isn't one for the main text;
    readers' words and those that lead elsewhere count before such a word too.
    """
    if not name or name[0] in DENIED or name[-1] in REFUTED:
        return False
    if not LEADING.isdisjoint(name):
        return True
    return _bare(name) in BOILER or not PLACERS.isdisjoint(name) or name[-1] not in MAIN and not STRONG.isdisjoint(name)


def _is_boiler(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it marks the main text."""
    drop, main = tag in DROPPED, tag in ("article", "main")
    if not attrs.strip():
        return drop, main
    for name, value, alone in ATTRIBUTE.findall(attrs):
        name, value = (name or alone).lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDING.search(value):
            drop = True
        elif name in ("class", "id", "role"):
            names = _names(value)
            words = {w for n in names for w in n}
            if tag == "article":
                drop |= any(n and n[0] not in DENIED and _bare(n) in TEASERS for n in names)
            elif tag not in ROOTS:
                marked = bool(words & MAIN)
                drop |= any(_unwanted(n) and not (marked and set(n) & BOILER <= WEAK) for n in names)
            main |= bool(words & MAIN)
        elif name == "itemprop" and value.lower() == "articlebody":
            main = True
    if tag in ("html", "body"):
        return False, False
    return drop, main and not drop


class _Open:
    """The open elements, with where each name, each block and each scope was opened last."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # name, left out, marks the main text
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.dropped = self.inside = self.links = self.heads = self.items = 0
        self.articles: list[int] = [0]  # numbers of the open article elements
        self.known = 0

    def push(self, tag: str, drop: bool, main: bool) -> None:
        k = len(self.stack)
        self.stack.append((tag, drop, main))
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCKS:
            self.blocks.append(k)
        if tag in SCOPES:
            self.scopes.append(k)
        if tag == "article":
            self.known += 1
            self.articles.append(self.known)
        self._count(tag, drop, main, 1)

    def _count(self, tag: str, drop: bool, main: bool, n: int) -> None:
        self.dropped += n * drop
        self.inside += n * main
        self.links += n * (tag == "a")
        self.heads += n * (tag in HEADS)
        self.items += n * (tag == "li")

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, drop, main = self.stack.pop()
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag == "article":
                self.articles.pop()
            self._count(tag, drop, main, -1)

    def last(self, tag: str) -> int:
        """Where the innermost element of this name was opened; -1 if none is open."""
        at = self.at.get(tag)
        return at[-1] if at else -1

    def end(self, tag: str) -> None:
        k = self.last(tag)
        # An inline end tag doesn't close a block.
        if k >= 0 and (tag in BLOCKS or not self.blocks or self.blocks[-1] <= k):
            self.pop_to(k)

    def end_within_scope(self, tag: str) -> None:
        k = self.last(tag)
        if k >= 0 and (not self.scopes or self.scopes[-1] <= k):
            self.pop_to(k)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without what is never main text; in time that grows with the page alone."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    el = _Open()
    at, n = 0, len(page)
    loose = 0  # up to here tags end at the next ">", quoted or not

    def close() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, el.inside > 0, el.heads > 0, el.items > 0, el.articles[-1]))
            parts.clear()
            linked = 0

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag, attrs = m[3], ""
        if tag is not None:
            end = -1
            if at >= loose:
                end = INSIDE.match(page, at).end()
                if end < n and page[end] != ">":  # a quote that nothing closes: it is the last of its sign, so this happens twice at most
                    loose, end = end, -1
            if end < 0:
                end = page.find(">", at)
                if end < 0:  # no tag ends any more
                    tag, loose, at = None, n, n
                    m = re.compile(".*", re.S).match(page, m.start())
            if tag is not None:
                attrs, at = page[at:end], end + 1
        if tag is None:
            text = entities.unescape(m[0]) if m.re is not TOKEN or m[1] is None else m[1]
            if el.dropped or m[0][:2] in ("<!", "<?") and m[0][:9] != "<![CDATA[":
                continue
            parts.append(text)
            if el.links:
                linked += len(text.strip())
            continue
        tag = tag.lower()
        if m[2]:
            if tag in BLOCKS:
                close()
            el.end(tag)
            continue
        if tag in BLOCKS:
            close()
        if tag == "p" or tag in BLOCKS and tag not in ("br", "hr"):
            el.end_within_scope("p")  # a new block ends an open paragraph
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            el.end_within_scope(tag)
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        drop, main = _is_boiler(tag, attrs)
        if tag == "header" and not el.inside:
            drop = True
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        el.push(tag, drop, main)
    close()
    return out


HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("ul ol dl table div article section main body td th blockquote aside nav footer header form".split())


def _teasers(blocks: list[Block], link_limit: float) -> set[int]:
    """Articles that are mostly links, beside one that isn't and is longer."""
    size: dict[int, list[int]] = {}
    for b in blocks:
        if b.article:
            s = size.setdefault(b.article, [0, 0])
            s[0] += len(b.text)
            s[1] += b.linked
    longest = max((n for n, linked in size.values() if linked <= link_limit * n), default=0)
    return {k for k, (n, linked) in size.items() if 2 * linked > n and longest > n}


def classify(blocks: list[Block], *, short: int = 60, long: int = 180, stop_low: float = 0.10, stop_high: float = 0.20, link_limit: float = 0.33) -> None:
    """Label every block good or bad. Lengths are in characters; one of a script without spaces counts three times."""
    marked = any(b.inside for b in blocks)
    teasers = _teasers(blocks, link_limit)
    measured = []
    for b in blocks:
        words = LETTERS.findall(b.text.lower())
        stops = sum(w in STOP for w in words) / max(1, len(words))
        measured.append((stops, b.linked / max(1, len(b.text)), len(b.text) + 2 * len(WIDE.findall(b.text))))
    # The list has words of this page's language if a block of some length says so.
    listed = any(stops >= stop_low and size >= short and density <= link_limit for stops, density, size in measured)
    for b, (stops, density, size) in zip(blocks, measured):
        if marked and not b.inside or b.article in teasers or density > link_limit and (b.listed or not marked):
            # Inside a marked article links speak against lists alone.
            b.label = "bad"
        elif marked:
            # Inside a marked article a block of some length needs no stop words.
            b.label = "good" if size > short else "short"
        elif size < short or b.heading:
            b.label = "short"
        elif not listed or stops >= stop_high:
            b.label = "good" if size > long else "near"
        elif stops >= stop_low:
            b.label = "near"
        else:
            b.label = "bad"
    if not any(b.label == "good" for b in blocks):
        for b in blocks:  # the nearest to main text that there is
            b.label = "good" if b.label == "near" else b.label
    decided = [i for i, b in enumerate(blocks) if b.label in ("good", "bad")]
    if not decided:  # nothing but short blocks: they are the page's text
        for b in blocks:
            b.label = "good"
        return
    labels = [b.label for b in blocks]
    before, last = [None] * len(blocks), None
    for i, v in enumerate(labels):
        before[i] = last
        last = i if v in ("good", "bad") else last
    after, last = [None] * len(blocks), None
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in ("good", "bad") else last
    for i, b in enumerate(blocks):
        if labels[i] in ("good", "bad"):
            continue
        near = [(abs(i - j), labels[j] != "good", j) for j in (before[i], after[i]) if j is not None and (not marked or blocks[j].inside == b.inside)]
        if not near:
            b.label = "good" if marked else "bad"
        elif labels[i] == "near" and any(labels[j] == "good" for _, _, j in near):
            b.label = "good"
        else:
            b.label = labels[min(near)[2]]


def main_text(page: str | None) -> str:
    """The page's main text; blocks are joined by one space."""
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null, empty or markup-only page gives an empty text. Repeated rows each
    give a row; further columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) if isinstance(h, str) else "" for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
