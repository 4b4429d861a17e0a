"""Main text of web pages by two passes over text blocks.

Pass 1 judges a block by itself: text in menus, forms, notices and the like is boilerplate, so is text of mostly links; long blocks
with many stop words, or long ones inside an article, are main text. Pass 2: short or doubtful blocks take the label of their nearest decided neighbours.
Where a page's long blocks have few known stop words, length and links decide. Articles set the bounds of main text if most running text is in them.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts

#: Function words of English, French, German and Spanish, by which running text is told from lists and menus.
STOP_WORDS = frozenset("""
the of and to in a is it that for on with as was are be by this from at or an not have he they you which his her but we
le la les de des du et un une en est que qui dans pour pas sur au aux avec ce il elle se sont par plus ne ou son sa
der die das und ist zu den von mit sich des auf für nicht ein eine als auch es an dem im er sie aus bei nach wie oder
el los las y que en un una por con para es del se no al lo como más su sus o este ha fue son entre cuando muy sin
""".split())
#: Characters of a short block, share of stop words in doubtful and in running text, share of link text that makes a block boilerplate.
SHORT, STOP_LOW, STOP_HIGH, LINKS = 70, 0.10, 0.18, 0.5
# Ideographs, syllables and kana, which say as much as three letters.
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")

_INSIDE = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|object|svg|canvas|audio|video|textarea|select|datalist|annotation|annotation-xml)"
                   rf"(?=[\s/>])({_INSIDE})>", re.I | re.S)
# Elements whose content is no markup: without an end tag they go on to the end of the page.
_RAW = frozenset("script style textarea iframe".split())
_OPEN_VALUE = re.compile(r"=\s*[^\s\"'>]*\Z")  # a slash after it belongs to an unquoted value
_IN_HEAD = re.compile(rf"(?:\s+|</?(?:meta|link|base|basefont|bgsound)(?=[\s/>]){_INSIDE}>|<title(?=[\s/>]){_INSIDE}>.*?(?:</title\s*>|\Z))*+", re.I | re.S)
_HEAD = re.compile(rf"<head(?=[\s/>]){_INSIDE}>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*>")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?]")  # a tag that the page ends in
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAMED = ("class", "id", "role", "itemprop")  # aria-label is free text
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Names, or parts of names, of classes, ids and roles around text that isn't the article's.
_BOILER = frozenset("""
ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs
sidebar aside rail widget widgets complementary footer foot contentinfo header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay dialog
newsletter subscribe subscription signup login paywall form search share sharing social comment comments commentlist disqus reply replies respond discussion related recommended
recommendations recirculation trending popular outbrain taboola pagination pager copyright legal disclaimer skip toc tags tagcloud
""".split())
_MAIN = frozenset("article articlebody main maincontent entrycontent postcontent postbody storybody".split())
_SKIPPED = frozenset("nav footer aside form button dialog menu fieldset".split())
# Parts that make a name speak of the page's layout or state, as in no-sidebar or comments-open.
_STATES = frozenset("with has no without open closed".split())
_BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html
legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Whole names that may as well name what an article's section is about: as ids, as classes of a section, and (the first ones) as any class.
_SUBJECTS = frozenset("discussion disclaimer legal tags".split())
_TOPICS = _SUBJECTS | frozenset("alert form notice notices popular related search social trending".split())
# Parts of names that tell by themselves also in an article.
_STRICT = frozenset("""ad ads advert adverts advertisement adsense adslot sponsored promo cookie cookies consent gdpr sidebar widget widgets newsletter subscribe subscription signup login paywall
navbar breadcrumb breadcrumbs pagination pager comment comments commentlist respond disqus outbrain taboola popup""".split())
# Parts that tell when a part of the layout is named with them, as in share-buttons or related-posts.
_LAYOUT = frozenset("""area articles bar bars block blocks bottom box boxes button buttons container content embed grid group icon icons item items left link links list lists module panel panels posts
right row site stories strip top unit wrap wrapper""".split())
# Ids that tell even where the section has a heading of its own.
_PLAIN = frozenset("comments comment commentlist respond disqus disqusthread sidebar nav navigation navbar footer breadcrumbs newsletter signup".split())
_HEADED = re.compile(rf"\s*(?:<header{_INSIDE}>\s*)?<h[1-6](?=[\s/>])", re.I)
# A new one of these ends an open one of the same kind.
_SELF = frozenset("p li dt dd option tr td th".split())
_EDGES = re.compile(r"[^\w]+|_+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in
         "script style noscript template iframe object svg canvas audio video textarea select datalist annotation annotation-xml".split()}
# What unclosed elements end at: an opening block.
_OPENS_BLOCK = re.compile(rf"<(?:{'|'.join(sorted(_BLOCKS - {'html', 'option', 'optgroup'}))})(?=[\s/>])", re.I)
_HEAD_END = re.compile(rf"</head\s*>|{_OPENS_BLOCK.pattern}", re.I)


class Doubt:
    """An element whose names suggest boilerplate, and what stands in it: (stop words, words, characters of links, of text)."""

    def __init__(self, number: int, parent: Doubt | None):
        self.number, self.parent, self.sums, self.unwanted = number, parent, [0, 0, 0, 0], False


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    boiler: bool
    area: int  # number of the article it stands in; 0: none
    doubt: Doubt | None = None  # innermost element of an article around it whose names only suggest boilerplate
    label: str = ""

    @cached_property
    def stops(self) -> tuple[int, int]:
        """(stop words, words)"""
        words = [w for w in (_EDGES.sub("", x) for x in self.text.lower().split()) if w]
        return sum(w in STOP_WORDS for w in words), len(words)

    @cached_property
    def solid(self) -> int:
        return max(1, len(self.text.replace(" ", "")))

    @cached_property
    def size(self) -> int:
        return len(self.text) if self.text.isascii() else len(self.text) + 2 * len(_WIDE.findall(self.text))


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of a name given twice the first counts, as in browsers."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _hidden(given: dict[str, str]) -> bool:
    """Whether attributes hide an element: ``hidden`` itself, aria-hidden=true, or display:none or visibility:hidden as a whole declaration of its style."""
    return (given.get("hidden", "false").strip().lower() != "false" or given.get("aria-hidden", "").strip().lower() == "true"
            or "style" in given and bool(_UNSEEN.search(html.unescape(given["style"]))))


def _says(tag: str, k: str, whole: str, parts: list[str], headed: bool) -> str:
    """What a name says of an element inside an article: boiler, doubt or nothing.

    Names on the lists decide, as do parts that only layouts have. What may be a section's subject (an id above a heading, a topic) only makes doubtful.
    """
    known, plain = whole in _BOILER, _STATES.isdisjoint(parts)
    if tag == "article" and not known:
        return "boiler" if plain and not {"comment", "comments"}.isdisjoint(parts) else ""
    if known:
        spared = whole in _TOPICS if k == "id" else k == "class" and whole in (_TOPICS if tag == "section" else _SUBJECTS)
        return "doubt" if spared or k == "id" and headed and whole not in _PLAIN else "boiler"
    if not plain or _BOILER.isdisjoint(parts):
        return ""
    sure = tag in _BLOCKS and not (k == "id" and headed) and (not _STRICT.isdisjoint(parts) or not _LAYOUT.isdisjoint(parts))
    return "boiler" if sure else "doubt"


def _kind(tag: str, attributes: str, inside: bool, headed: bool) -> tuple[bool, bool, bool]:
    """(boilerplate, article, doubtful) that an opening tag says of what it holds.

    ``inside``: in an article. ``headed``: the element begins with a heading. A heading's id says nothing anywhere.
    """
    boiler, main, doubt = tag in _SKIPPED or tag == "header" and not inside, tag in ("article", "main"), False
    if attributes:
        given = _attributes(attributes)
        if _hidden(given):
            boiler = True
        heading = tag[0] == "h" and tag[1:].isdigit()
        for k in _NAMED:
            for name in given.get(k, "").split():
                parts = [p.lower() for p in _PARTS.findall(name)]
                whole = "".join(parts)
                if whole in _MAIN:
                    main = True
                elif heading and (k == "id" or inside and whole not in _BOILER):
                    continue
                elif inside:
                    said = _says(tag, k, whole, parts, headed)
                    boiler, doubt = boiler or said == "boiler", doubt or said == "doubt"
                elif whole in _BOILER or tag != "article" and _STATES.isdisjoint(parts) and not _BOILER.isdisjoint(parts):
                    boiler = True
    holder = tag in ("html", "body", "main")
    return boiler and not holder, main and not boiler, doubt and not boiler and not holder


def _self_closed(attributes: str) -> bool:
    return attributes.endswith("/") and not _OPEN_VALUE.search(attributes)


def _gone(page: str) -> str:
    """``page`` without comments, scripts, drawings, media and the like, and without its head.

    Self-closed elements are empty. Without an end tag, elements of raw text go on to the end of the page, others to the next block.
    A head without one ends at the first thing that can't stand in a head.
    """
    out, at = [], 0
    never: set[str] = set()  # names without an end tag from here on
    while m := _GONE.search(page, at):
        out += page[at: m.start()], " "
        at, tag = m.end(), (m[1] or "").lower()
        if not tag or _self_closed(m[2]) and not (tag in _RAW and _ENDS[tag].match(page, at)):
            continue
        end = None if tag in never else _ENDS[tag].search(page, at)
        if end:
            at = end.end()
        elif tag in _RAW:
            at = len(page)
        else:
            never.add(tag)
            block = _OPENS_BLOCK.search(page, at)
            at = block.start() if block else len(page)
    out.append(page[at:])
    page = "".join(out)
    head = _HEAD.search(page)
    if head:
        cut = _IN_HEAD.match(page, head.end()).end()
        end = _HEAD_END.search(page, cut)
        if end and end[0][1] == "/":
            cut = end.end()
        page = page[: head.start()] + " " + page[cut:]
    return page


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, with what the elements around them say."""
    page = _gone(page)
    out: list[Block] = []
    stack: list[tuple[str, bool, int, Doubt | None]] = []  # tag, boilerplate, article, doubt
    opened: Counter[str] = Counter()  # how many of each tag the stack holds
    text: list[str] = []
    links = areas = in_link = doubtful = 0
    heading = False

    def flush():
        nonlocal links, heading
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            boiler, area, doubt = stack[-1][1:] if stack else (False, 0, None)
            out.append(Block(joined, links, heading, boiler, area, doubt))
        text.clear()
        links, heading = 0, False

    def say(raw):
        nonlocal links
        if raw:
            text.append(raw)
            if in_link:
                links += len("".join(html.unescape(raw).split()))

    at = 0
    for m in _TAG.finditer(page):
        say(page[at: m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 0 if m[1] else 1
        if m[1]:
            if tag in _BLOCKS:
                flush()
            if opened[tag]:
                flush()
                while opened[tag]:
                    name = stack.pop()[0]
                    opened[name] -= 1
                    if name == tag:
                        break
        elif tag in _BLOCKS or m[3] and tag not in _VOID and tag != "a":
            if tag in _BLOCKS:
                flush()
                if tag in _SELF and stack and stack[-1][0] == tag or stack and stack[-1][0] == "p":
                    opened[stack.pop()[0]] -= 1
            boiler, main, doubt = _kind(tag, m[3] or "", bool(stack and stack[-1][2]), bool(m[3]) and bool(_HEADED.match(page, at)))
            doubt = doubt and (tag in _BLOCKS or not any(map(str.strip, text)))  # words within a sentence stay in it
            if tag in _BLOCKS and tag not in _VOID or boiler or doubt:
                if (boiler or doubt) and tag not in _BLOCKS:
                    flush()
                areas += main
                doubtful += doubt
                held = stack[-1] if stack else ("", False, 0, None)
                stack.append((tag, held[1] or boiler, areas if main else held[2], Doubt(doubtful, held[3]) if doubt else held[3]))
                opened[tag] += 1
            if tag[0] == "h" and tag[1:].isdigit():
                heading = True
    cut = _CUT_OFF.search(page, max(at, page.rfind(">") + 1))
    say(page[at: cut.start() if cut else len(page)])
    flush()
    return out


def _weigh(blocks: list[Block], served: bool) -> None:
    """Mark the doubtful elements that, as a whole and without headings, have few stop words (of a language ``served``) or many links, and what is in them."""
    found: dict[int, Doubt] = {}
    for b in blocks:
        d = b.doubt
        while d is not None and d.number not in found:
            found[d.number] = d
            d.sums = [0, 0, 0, 0]
            d = d.parent
        if b.doubt and not b.boiler and not b.heading:
            b.doubt.sums = [x + y for x, y in zip(b.doubt.sums, (*b.stops, b.link_chars, b.solid))]
    for n in sorted(found, reverse=True):  # inner elements have larger numbers
        d = found[n]
        if d.parent:
            d.parent.sums = [x + y for x, y in zip(d.parent.sums, d.sums)]
    for n in sorted(found):
        d = found[n]
        hits, words, links, solid = d.sums
        d.unwanted = bool(solid) and (served and hits < STOP_LOW * words or links > LINKS / 2 * solid) or bool(d.parent and d.parent.unwanted)


def _served(blocks: list[Block]) -> bool:
    """Whether the long blocks of few links have as many stop words as running text of the known languages; also without any such block."""
    hits = words = 0
    for b in blocks:
        if not b.boiler and b.size >= SHORT and b.link_chars <= LINKS / 2 * b.solid:
            h, w = b.stops
            hits, words = hits + h, words + w
    return not words or hits >= STOP_HIGH * words


def _judge(b: Block, served: bool, area: bool) -> str:
    """Pass 1: good, bad, near (looks like text), low (long, few links, few stop words) or short. In an article links are text: such blocks are short ones."""
    if b.boiler or b.doubt and b.doubt.unwanted or b.text[0] in "©®" and b.size < 3 * SHORT:
        return "bad"
    if b.link_chars / b.solid > LINKS:
        return "short" if area else "bad"
    size, solid, (hits, words) = b.size, b.solid, b.stops
    share = hits / words if words else 0.0
    if size >= SHORT and (area or share >= STOP_HIGH or not served and b.link_chars <= LINKS / 2 * solid):
        return "good"
    if area or size < SHORT and not b.link_chars:
        return "near" if share >= STOP_LOW else "short"
    if share >= STOP_LOW:
        return "near"
    return "low" if size >= SHORT and b.link_chars <= LINKS / 2 * solid else "bad"


def classify(blocks: list[Block]) -> None:
    """Set ``label`` of each block to good or bad."""
    served = _served(blocks)
    _weigh(blocks, served)
    for b in blocks:
        b.label = _judge(b, served, bool(b.area))
    if any(b.area and b.label != "bad" for b in blocks):  # the page says where its article is, if most running text is there
        inside = sum(b.size for b in blocks if b.area and b.label != "bad")
        outside = sum(b.size for b in blocks if not b.area and b.label == "good")
        for b in blocks:
            if inside < outside:
                b.label, b.area = _judge(b, served, False), 0
            elif not b.area:
                b.label = "bad"
    first = [b.label for b in blocks]
    # what menus, adverts and the like hold says nothing about the text around it
    decided: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if first[i] in ("good", "bad") and not b.boiler and not (b.doubt and b.doubt.unwanted):
            decided.setdefault(b.area, []).append(i)
    bare = not decided  # only short blocks besides what names tell: they are the page's text
    for i, b in enumerate(blocks):  # pass 2
        if first[i] in ("good", "bad"):
            continue
        near = decided.get(b.area, [])
        at = bisect.bisect(near, i)
        before, after = first[near[at - 1]] if at else None, first[near[at]] if at < len(near) else None
        if first[i] == "low":  # a table, list or piece of code belongs to the text on both of its sides
            b.label = "good" if before == after == "good" else "bad"
        elif b.heading and after:
            b.label = after
        elif before == after or before is None or after is None:
            b.label = before or after or ("good" if b.area or first[i] == "near" or bare else "bad")
        else:
            b.label = "good" if b.area or first[i] == "near" else "bad"


def main_text(page: str | None) -> tuple[str, int, int]:
    """(main text, good blocks, all blocks) of a page."""
    blocks = blocks_of(page or "")
    classify(blocks)
    good = [b.text for b in blocks if b.label == "good"]
    return "\n".join(good), len(good), len(blocks)


def extract(df: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """``keep`` with the main ``text`` of each page, its length ``n_chars`` in code points, and ``n_blocks`` kept of ``n_seen``.

    A heading outside of the article, also right before it, belongs to the page. Pages of short blocks only keep those that no name or link marks as something else.
    Null and empty pages, and pages without main text, have an empty text. Added columns replace none: clashing names in the table don't matter unless kept. Whole pages of any length; repeated rows repeat; broken markup is read as far as it goes.
    """
    def make():
        def fn(pages):
            got = [main_text(p) for p in pages]
            return [[g[0] for g in got], [len(g[0]) for g in got], [g[1] for g in got], [g[2] for g in got]]
        return fn

    return map_texts(df, keep, page, make, "text string, n_chars long, n_blocks int, n_seen int").select(*map(F.col, keep), "text", "n_chars", "n_blocks", "n_seen")
