"""A linear scan of HTML into containers and blocks of text.

Containers are the elements that lay out a page; each knows its chain, a hash of
the names on the way down to it, so that depth costs nothing. A block is the text
between two block-level tags; inline elements, known or not, stay in it.

No input makes the scan quadratic: a tag is searched for its end with quotes in
mind until ``QUOTES`` such searches have run off the page, then without.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

QUOTES = 8
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?]))")
_REST = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>""")
_NAME = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Element names of HTML.
_RAW = frozenset("script style noscript template textarea title iframe select option button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_TEXTS = frozenset("address caption dt h1 h2 h3 h4 h5 h6 hgroup hr legend optgroup p pre summary".split())
_FRAMES = _BLOCKS - _TEXTS
#: Menus, footers, sidebars, forms and the head, by the meaning HTML gives these elements.
_OFF = frozenset("nav footer aside form menu dialog head search".split())
_MAIN = frozenset("article main".split())
#: What an opening tag ends, as HTML lets these end tags be left out.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Whole class, id and role names by which layout containers tell what they are.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header "
    "masthead cookie cookies cookie-banner consent gdpr notice notices alert newsletter subscribe signup login popup modal overlay share sharing social related recommended "
    "recommendations comment comments disqus disqus_thread replies pagination pager toolbar contentinfo complementary search".split()
)
_NAMED = frozenset("div section ul ol dl table td figure details center".split())


@dataclass(slots=True)
class Region:
    """A container; ``off``: boilerplate by its element, ``named``: by its name, ``main``: the element says article."""

    chain: int
    parent: int
    tag: str
    name: str
    off: bool
    named: bool
    main: bool
    text: int = 0
    link: int = 0
    direct: int = 0


@dataclass(slots=True)
class TextBlock:
    region: int
    parts: list[str] = field(default_factory=list)
    size: int = 0
    link: int = 0

    def words(self) -> str:
        return " ".join("".join(self.parts).split())


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def _end_of_tag(page: str, at: int, failed: list[int]) -> int:
    """The place after a tag's ``>``, or -1."""
    if failed[0] < QUOTES:
        m = _REST.match(page, at)
        if m:
            return m.end()
        failed[0] += 1
    return page.find(">", at) + 1 or -1


def parsed(page: str) -> tuple[list[Region], list[TextBlock], Counter]:
    """Containers and blocks in page order, and how often each block-level element stands in each container.

    Sizes of a region count characters without blanks: ``direct`` its own blocks, ``text`` and ``link`` all it encloses."""
    regions = [Region(0, -1, "", "", False, False, False)]
    blocks: list[TextBlock] = []
    elements: Counter = Counter()
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    failed, fresh, links, at, n = [0], True, 0, 0, len(page)
    last = page.rfind(">")

    def text(t: str) -> None:
        nonlocal fresh
        here = stack[-1][1]
        if fresh:
            blocks.append(TextBlock(here))
            fresh = False
        b = blocks[-1]
        b.parts.append(t)
        size = len("".join(t.split()))
        b.size += size
        if links:
            b.link += size

    while at < n:
        m = _OPEN.search(page, at)
        if not m or m.start() > last:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        if m[3]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else n
            continue
        if m[4]:
            at = page.find(">", m.end()) + 1 or n
            continue
        after = _end_of_tag(page, m.end(), failed)
        if after < 0:
            text(page[m.start() :])
            break
        tag, closing, inner = m[2].lower(), bool(m[1]), page[m.end() : after - 1]
        at = after
        if tag == "br":
            text(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag in _BLOCKS:
            fresh = True
        if not closing and tag in _RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or n) if end else n
            continue
        if tag not in _BLOCKS or tag in _VOID:
            continue
        while stack[-1][0] == "p" or not closing and stack[-1][0] in _ENDS.get(tag, ()):  # a paragraph ends where the next block begins
            opened[stack.pop()[0]] -= 1
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    opened[stack.pop()[0]] -= 1
                stack.pop()
                opened[tag] -= 1
            continue
        up = regions[stack[-1][1]]
        if tag in _FRAMES:
            links = 0 if tag not in ("li", "ul", "ol") else links
            names = [(k.lower(), x.lower()) for k, *v in _NAME.findall(inner) for x in v if x] if inner else []
            words = {w for _, x in names for w in x.split()}
            main = tag in _MAIN or ("role", "main") in names or ("itemprop", "articlebody") in names
            off = tag in _OFF or tag == "header" and not up.main
            label = ".".join([tag, *sorted(w for w in words if sum(c.isdigit() for c in w) < 2)])
            regions.append(Region(hashed(f"{up.chain}/{label}"), stack[-1][1], tag, label, off, not off and tag in _NAMED and not main and bool(words & _NAMES), main or up.main))
            stack.append((tag, len(regions) - 1))
        else:
            elements[up.chain, tag] += 1
            stack.append((tag, stack[-1][1]))
        opened[tag] += 1
    for b in blocks:
        regions[b.region].direct += b.size
        regions[b.region].link += b.link
    for r in regions:
        r.text += r.direct
    for r in reversed(regions[1:]):
        regions[r.parent].text += r.text
        regions[r.parent].link += r.link
    return regions, blocks, elements
