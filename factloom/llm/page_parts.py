"""A page's text in blocks, and its token stream, for the extraction of main texts.

Tags are read by one pattern, in linear time; scripts, styles and other raw elements are skipped up to their end.  An
element is chrome if it is a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment by
its name, its role, or a word of one of its classes or its id; a header is one only outside the main element.  An article (else a main element) is the page's main
element; a page that has neither has none.  A menu that no name tells, inside the main element, is a list of links that
other articles hold too: the stream has what links of the main element say, for the array to find it.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

# The element names of HTML by their kinds, and the words by which sites name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form head button select option menu dialog template svg canvas object audio video noscript iframe script style title textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
PART_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertisements banner sponsor sponsored promo promotion "
    "cookie cookies notice notices consent popup modal newsletter subscribe subscription comment comments disqus related recommended teaser share sharing social login signup search form".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[A-Za-z/!?][^>]*+\Z", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>|\Z", re.I) for n in RAW}
_CUT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """Text between two block borders: inside the main element or not, and where its words stand in the stream."""

    text: str
    main: bool
    first: int
    end: int
    #: In the main element: how many links hold its words, if every word of it stands in one and none in a heading.
    links: int | None = None


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Tags and words; a named part's text outside the main element is one "#".  Inside it tags and words of links are
    #: signs of their own, and None stands for where it begins and for all other text, with the tags in it.
    stream: list[str | None] = field(default_factory=list)
    #: The first block of the main element with words outside of links; pages that share it hold one article.
    lead: str | None = None


#: Elements that hold the text itself: a class that only mentions a part does not make them one.
_SOLID = frozenset("html body main article".split())
#: A compound that ends in one of these names the text of a part that its own element names, or none.
_CONTENT = frozenset("content body text article story entry copy".split())
_HEADERS = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HREF = re.compile(r"\bhref\b", re.I)
_WORD = re.compile(r"[^\W_]")
#: Begins the signs of the main element, which are like none outside of it.
INSIDE = "\2"


def is_part(name: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether attributes name a part that is not main text, or a header (which is one only outside the main element), and the classes as a mark for the stream."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, False, ""
    mark, part, header = "", False, False
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden":
            part = True
        elif key == "role":
            part |= value.strip() in ROLES
        else:
            mark += "." + value
            for told in value.split():
                words = [w for w in _CUT.split(told) if w]
                if not words or words[0] in ("has", "with", "no") or (name in _SOLID and len(words) > 1) or (len(words) > 1 and words[-1] in _CONTENT):
                    continue
                hits = PART_NAMES.intersection(words)
                header |= bool(hits)
                part |= bool(hits - _HEADERS)
    return part, header and not part, mark


def read_page(source: str, main_names: tuple[str, ...]) -> Page:
    """The blocks and stream of a page whose main elements have one of the names."""
    page = Page()
    stack: list[tuple[str, bool, bool]] = []  # name, part, main
    parts = mains = 0
    words: list[str] = []  # of the block at hand
    block_main, first = False, 0
    link = heading = loose = False  # inside of a link or heading; whether the block has words outside of links
    opened = told_of = links = 0  # links so far, the last that said a word, and those that did in the block
    bare = 0  # in the main element: where the last None ends, if only tags have followed
    stream = page.stream

    def flush() -> None:
        nonlocal words
        if words:
            told = block_main and loose
            page.blocks.append(Block(" ".join(words), block_main, first, first if told else len(stream), links if block_main and links and not loose else None))
            if told and page.lead is None:
                page.lead = page.blocks[-1].text
            words = []

    def close(down_to: int) -> None:
        nonlocal parts, mains
        while len(stack) > down_to:
            _, part, main = stack.pop()
            parts -= part
            mains -= main

    glue = False  # whether the next text goes on without white space after the last

    def text(raw: str) -> None:
        nonlocal block_main, first, glue, loose, links, told_of, bare
        if not raw:
            return
        told = entities.unescape(raw) if "&" in raw else raw
        own = told.split()
        if parts:
            if own and not mains:
                stream.append("#")
            glue = False
            return
        if not own:
            glue = False
            return
        if not words:
            block_main, first, loose, links = mains > 0, len(stream), False, 0
        if words and glue and not told[0].isspace():
            words[-1] += own[0]
            if len(own) > 1:
                words.append(" ".join(own[1:]))
        else:
            words.append(" ".join(own))
        glue = not told[-1].isspace()
        if not mains:
            stream.extend(own)
            loose = True
        elif (link and not heading) or not _WORD.search(told):
            stream.extend(INSIDE + w for w in own)
            bare = 0
            if link and told_of != opened:
                links, told_of = links + 1, opened
        else:
            loose = True
            if bare:
                del stream[bare:]
                first = min(first, bare)
            else:
                stream.append(None)
                bare = len(stream)

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        inline = name in INLINE
        if not inline:
            flush()
            glue = link = False
            if name in _HEADINGS:
                heading = not ends
        elif name == "br":
            glue = False
        elif name == "a":
            link = not ends and bool(_HREF.search(attributes))
            opened += link
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            if not mains:
                stream.append(f"</{name}>")
            elif not parts:
                stream.append(f"{INSIDE}</{name}>")
            continue
        if not inline:
            _close_implied(stack, name, close)
        part, header, mark = is_part(name, attributes)
        part |= name in CHROME or ((header or name == "header") and not mains)
        main = not part and not parts and (name in main_names or ("main" in main_names and bool(re.search(r"\brole\s*=\s*[\"']?main\b", attributes, re.I))))
        if main or not mains:
            stream.append(None if main else f"<{name}{mark}>")
            bare = len(stream)
        elif not parts:
            stream.append(f"{INSIDE}<{name}{mark}>")
        if name in RAW:
            at = _RAW_END[name].search(source, at).end()
        elif name not in VOID:
            stack.append((name, part, main))
            parts += part
            mains += main
    flush()
    return page


#: An element that ends where another of these begins, up to the nearest container.
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CONTAINERS = frozenset("ul ol menu dl table select div section article main body aside nav form header footer blockquote".split())


def _close_implied(stack: list[tuple[str, bool, bool]], name: str, close) -> None:
    ended = _ENDED_BY.get(name, ())
    for i in range(len(stack) - 1, -1, -1):
        open_name = stack[i][0]
        if open_name == "p" or open_name in ended:
            close(i)
            if open_name == "p" and not ended:
                return
        elif open_name in _CONTAINERS:
            return


def page_parts(source: str) -> tuple[Page, bool]:
    """The page, and whether it has a main element with text."""
    low = source.lower()
    for names, sign in ((("article",), "<article"), (("main",), "main")):
        if sign in low:
            page = read_page(source, names)
            if any(b.main for b in page.blocks):
                return page, True
    return read_page(source, ()), False
