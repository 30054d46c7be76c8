"""Main text of web pages by templates deduced from equivalence classes.

Tokens are the opening and closing tags of a page's elements, each with its chain
of containers, and its texts, a block being one token with its chain (a block is
what stands between two block-level tags). A token's occurrence vector over the
pages of its host is known by two linear digests: each page has a random number,
and a token sums those of its pages as often as it occurs on them. Sums go through
one aggregation, however many pages a host has. Tokens of one digest are an
equivalence class.

A class is valid if it is large (``LARGE`` tokens) and frequent (``SUPPORT`` of the
host's pages). Valid classes nest into the template: a class stands in the slot of
the innermost container that encloses it; one whose tokens stand in several slots
is split by slot, and each part must be large by itself. A text joins the class of
its container if it stands on ``NEARLY`` all of the container's pages, so that one odd
page doesn't hide it. What is left around the template's tokens is in its slots. The slots of the article are those inside one
container of the template, found from the root down as long as one container holds
``MOST`` of what varies from page to page and isn't links; an ``article`` or
``main`` element ends the descent, and so does a container with text of its own.

From these slots, the template's texts go, and so do containers of the template that hold hardly anything but links. What HTML itself
gives another meaning (nav, footer, aside, form ...) is outside, and layout
containers (div, section, list, table; never a paragraph or heading) whose whole
class name says advert, comments and the like, unless they hold most of the page's
text. Pages of hosts with fewer than ``LEAST`` pages, or without their host's slot,
are judged alone by the same descent; nothing of theirs is dropped as repeated. Nor
is it where most of the article would go: such a host holds copies of one article.

Edge cases: null or empty html gives an empty text; unclosed and stray tags,
comments, and tag-like strings in scripts do no harm, and no page takes more than
linear time (`markup`); a null or odd url falls to an empty host; repeated rows are
pages of their own; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import html as markup_text
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import Region, hashed, parsed
from .store import small_batches, written

LARGE, SUPPORT, NEARLY, LEAST = 3, 0.3, 0.9, 4
#: Share of a level's text that a slot must hold to be descended into, and link text of a menu's text.
MOST, MENU = 0.7, 0.8
#: Bytes of all hosts' templates that may be sent to every task; beyond, only those of hosts with more than a ``HEAVY``-th of all pages are.
SENT, HEAVY = 16 << 20, 1000
_SPACE = re.compile(r"\s+")
CONTAINER, ELEMENT, TEXT = 0, 1, 2


@dataclass(slots=True)
class Node:
    """A container on the pages of a host, or on one page."""

    chain: int
    up: int
    tag: str
    off: bool
    named: bool
    main: bool
    text: int
    link: int
    direct: int
    template: bool = True
    constant: int = 0


def children(nodes: dict[int, Node]) -> dict[int, list[Node]]:
    """Below each container of the template the next ones; other containers are passed through."""
    out: dict[int, list[Node]] = defaultdict(list)
    above: dict[int, int] = {0: 0}

    def kept(chain: int) -> int:
        path = []
        while chain not in above:
            path.append(chain)
            chain = nodes[chain].up if chain in nodes else 0
        at = above[chain]
        for c in reversed(path):
            at = c if c in nodes and nodes[c].template else at
            above[c] = at
        return at

    for node in nodes.values():
        if node.chain and node.template:
            out[kept(node.up)].append(node)
    return out


def article_slot(nodes: dict[int, Node]) -> tuple[int, frozenset[int]]:
    """The container of the article's slots, and the named containers that stay since they hold most of the text."""
    below = children(nodes)
    order, stack = [], [nodes[0]]
    while stack:
        here = stack.pop()
        order.append(here)
        stack += below[here.chain]
    stay = frozenset(x.chain for x in order if x.named and x.text - x.link > MOST * (nodes[0].text - nodes[0].link))
    mass: dict[int, int] = {}
    for x in reversed(order):
        gone = sum(y.text - y.link - y.constant - mass[y.chain] for y in below[x.chain])
        mass[x.chain] = 0 if x.off or x.named and x.chain not in stay else max(0, x.text - x.link - x.constant - gone)
    here = nodes[0]
    while True:
        inner = [x for x in below[here.chain] if mass[x.chain]]
        best = max(inner, default=None, key=lambda x: (mass[x.chain], x.main, -x.chain))
        bears = here.tag not in ("", "html", "body") and here.direct > here.constant
        if best is None or bears or here.main or mass[best.chain] < MOST * mass[here.chain] or best.tag == "section" and sum(x.tag == "section" for x in inner) > 1:
            return here.chain, stay
        here = best


def nodes_of(regions: list[Region]) -> dict[int, Node]:
    """The containers of one page, those with one chain taken together."""
    nodes: dict[int, Node] = {}
    for r in regions:
        got = nodes.get(r.chain)
        if got is None:
            nodes[r.chain] = Node(r.chain, regions[r.parent].chain if r.parent >= 0 else 0, r.tag, r.off, r.named, r.main, r.text, r.link, r.direct)
        else:
            got.text += r.text
            got.link += r.link
            got.direct += r.direct
    return nodes


@dataclass(frozen=True)
class Template:
    """What is extracted on a host's pages: the container of the article's slots, the named containers that stay, the menus and the texts to leave out."""

    slot: int
    stay: frozenset[int]
    menus: frozenset[int]
    texts: frozenset[int]


def main_text(page: str | None, template: Template | None = None) -> str:
    """The blocks of the article's slots on a page."""
    regions, blocks, _ = parsed(page or "")
    if template is None or all(r.chain != template.slot for r in regions):
        slot, stay = article_slot(nodes_of(regions))
        template = Template(slot, stay, frozenset(), frozenset())
    inside = [False] * len(regions)
    for i, r in enumerate(regions):
        if r.chain == template.slot:
            inside[i] = True
        elif r.parent >= 0 and inside[r.parent]:
            inside[i] = not (r.off or r.named and r.chain not in template.stay or r.chain in template.menus)
    lines = []
    for b in blocks:
        if inside[b.region] and not (template.texts and text_key(regions[b.region].chain, b.words()) in template.texts):
            lines.append(_SPACE.sub(" ", markup_text.unescape("".join(b.parts))).strip())
    return "\n".join(x for x in lines if x)


def text_key(chain: int, words: str) -> int:
    return hashed(f"{chain} {words}")


def host_of(column: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(column, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


_TOKEN = (
    "host string, key long, up long, kind int, tag string, off boolean, named boolean, main boolean, pages long, v1 long, v2 long, text long, link long, direct long"
)
_KEYS = ["host", "key", "up", "kind", "tag", "off", "named", "main"]
_SUMS = ["pages", "v1", "v2", "text", "link", "direct"]


def tokens(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, the two digests of its occurrence vector, and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}

            def add(key: tuple, n: int, one: int, two: int, text: int = 0, link: int = 0, direct: int = 0, sums: dict = sums) -> None:
                got = sums.get(key)
                if got is None:
                    sums[key] = [1, n * one, n * two, text, link, direct]
                else:
                    got[0] += 1
                    got[1] += n * one
                    got[2] += n * two
                    got[3] += text
                    got[4] += link
                    got[5] += direct

            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                regions, blocks, elements = parsed(page or "")
                vector = hashed(page or "")
                one, two = vector & 0x7FFFFFFF, vector >> 31 & 0x7FFFFFFF
                times: dict[int, int] = defaultdict(int)
                for r in regions:
                    times[r.chain] += 1
                for x in nodes_of(regions).values():
                    add((host, x.chain, x.up, CONTAINER, x.tag, x.off, x.named, x.main), times[x.chain], one, two, x.text, x.link, x.direct)
                for (chain, tag), n in elements.items():
                    add((host, hashed(f"{chain}#{tag}"), chain, ELEMENT, tag, False, False, False), n, one, two)
                texts: dict[tuple[int, int], list[int]] = {}
                for b in blocks:
                    if b.size:
                        chain = regions[b.region].chain
                        got = texts.setdefault((text_key(chain, b.words()), chain), [0, 0])
                        got[0] += 1
                        got[1] += b.size - b.link
                for (key, chain), (n, size) in texts.items():
                    add((host, key, chain, TEXT, None, False, False, False), n, one, two, size)
            cols = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) or [()] * 14
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.bool_()] * 3, *[pa.int64()] * 6)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip([*_KEYS, *_SUMS], cols, kinds, strict=True)})

    return pages.select("host", "html").mapInArrow(run, _TOKEN).groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS])


def deduced(rows: list[dict], n: int) -> Template:
    """The template of a host with n pages from its frequent tokens."""
    containers = {r["key"]: r for r in rows if r["kind"] == CONTAINER}
    classes: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for r in rows:
        classes[r["v1"], r["v2"]].append(r)
    weight = lambda part: sum(2 - (r["kind"] == TEXT) for r in part)
    accepted: set[int] = {0}
    # Wider classes come first, so what encloses a class is known when its slot is looked for.
    for members in sorted(classes.values(), key=lambda m: (-m[0]["pages"], min(r["key"] for r in m))):
        if weight(members) < LARGE:
            continue
        own = {r["key"] for r in members if r["kind"] == CONTAINER}
        slots: dict[int, list[dict]] = defaultdict(list)
        for r in members:
            at = r["up"]
            while at in own and at or at and at not in accepted:
                at = containers[at]["up"] if at in containers else 0
            slots[at].append(r)
        for part in slots.values():
            if weight(part) >= LARGE:
                accepted |= {r["key"] for r in part if r["kind"] == CONTAINER}
    texts = [r for r in rows if r["kind"] == TEXT and r["up"] in accepted and r["pages"] >= NEARLY * (containers[r["up"]]["pages"] if r["up"] in containers else n)]
    root = containers.get(0)
    nodes = {0: Node(0, 0, "", False, False, False, root["text"] if root else 0, root["link"] if root else 0, root["direct"] if root else 0)}
    for key, r in containers.items():
        if key:
            nodes[key] = Node(key, r["up"], r["tag"], r["off"], r["named"], r["main"], r["text"], r["link"], r["direct"], key in accepted)

    def enclosing(chain: int) -> Iterator[Node]:
        while True:
            yield nodes[chain if chain in nodes else 0]
            if chain == 0 or chain not in nodes:
                return
            chain = nodes[chain].up

    known = sum(r["text"] for r in texts)
    if known <= NEARLY * (nodes[0].text - nodes[0].link):
        for r in texts:
            for x in enclosing(r["up"]):
                x.constant += r["text"]
    slot, stay = article_slot(nodes)
    within = {r["key"]: r["text"] for r in texts if any(x.chain == slot for x in enclosing(r["up"]))}
    if 2 * sum(within.values()) > nodes[slot].text - nodes[slot].link:
        within = {}
    menus = frozenset(x.chain for x in nodes.values() if x.template and x.chain != slot and x.text and x.link >= MENU * x.text and any(y.chain == slot for y in enclosing(x.up)))
    return Template(slot, stay, menus, frozenset(within))


def templates(pages: DataFrame) -> DataFrame:
    """Per host of ``LEAST`` pages with html or more: pages and the parts of its `Template`."""
    pages = pages.where("html is not null and html != ''")
    of_host = written(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    # Tokens on too few pages for any host go before the join, and so nearly all.
    some = written(tokens(pages).where(F.col("pages") >= SUPPORT * LEAST), "tokens")
    frequent = some.join(of_host.where(F.col("n") >= LEAST), "host").where(F.col("pages") >= SUPPORT * F.col("n"))
    listed = frequent.groupBy("host", "n").agg(F.collect_list(F.struct("key", "up", "kind", "tag", "off", "named", "main", *_SUMS)).alias("tokens"))  # at most 1 / SUPPORT times the tokens of a page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [deduced(rows, n) for rows, n in zip(batch.column("tokens").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "host": batch.column("host"),
                    "n": batch.column("n"),
                    "slot": pa.array([t.slot for t in made], pa.int64()),
                    **{c: pa.array([sorted(getattr(t, c)) for t in made], lists) for c in ("stay", "menus", "texts")},
                }
            )

    return written(listed.mapInArrow(run, "host string, n long, slot long, stay array<long>, menus array<long>, texts array<long>"), "templates")


def _with_templates(pages: DataFrame, made: DataFrame) -> DataFrame:
    """Each page with its host's template; the html of a host with many pages is never gathered."""
    size = F.octet_length("host") + 64 + 8 * (F.size("stay") + F.size("menus") + F.size("texts"))
    row = made.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if row["bytes"] <= SENT:
        return pages.join(F.broadcast(made.drop("n")), "host", "left")
    heavy = F.broadcast(made.where(F.col("n") * HEAVY > row["n"]).drop("n"))  # fewer than HEAVY rows
    rest = pages.join(heavy.select("host"), "host", "left_anti").join(made.where(F.col("n") * HEAVY <= row["n"]).drop("n"), "host", "left")
    return pages.join(heavy, "host").unionByName(rest)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    hosted = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    joined = _with_templates(hosted, templates(hosted)).select("page_id", "url", "html", "host", "slot", "stay", "menus", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for batch in batches:
            texts = []
            slot, *lists = (batch.column(c) for c in ("slot", "stay", "menus", "texts"))
            for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = Template(slot[i].as_py(), *(frozenset(x[i].as_py()) for x in lists)) if slot[i].is_valid else None
                texts.append(main_text(page, known[host]))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url").cast(pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
