"""Main text of web pages by consensus of host paths.

Each page's containers are scored and vote for their generalised path (tags with their class words,
digits and positions left out). Votes are summed per host in Spark, and every page is extracted with
the paths that win on its host, which saves pages whose own markup would mislead; a page without any
of them is extracted from its own best container.

What is hidden, marked as noise or lies in a navigation, form or the like is a zone apart: its text is
in no container around it. A zone that holds most of the page's text is a candidate all the same.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.session import materialize

MIN_SHARE = 0.2  # of a host's votes that a path needs to be one of its winners
MAX_PATHS = 4  # winners of a host, the best first
_SLICE = 256
# --- fixed values: HTML elements ------------------------------------------------------------------
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset(
    "script style textarea title noscript template iframe svg object annotation annotation-xml".split()
)  # no math: its text is read; annotations say it once more in another notation
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset(
    "nav header footer aside form button select menu dialog input".split()
) | RAW  # no head: its elements are raw or void, and any text or block ends it
CONTROLS = frozenset("nav button select menu".split())  # hold labels; no text by themselves
CONTAINERS = frozenset("article body div main section td center blockquote".split())
CLOSED_BY_BLOCK = frozenset(["p"])  # an open paragraph ends where another block begins
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# tokens of a class, id or role that mark what is not the article
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
    "navbar navigation menu breadcrumb breadcrumbs header footer sidebar side aside widget comment "
    "comments reply replies respond disqus cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login search share sharing social related "
    "recommended recommendations more tags pagination pager toolbar masthead topbar copyright legal "
    "disclaimer hidden rail outbrain taboola contentinfo complementary".split()
)
GOOD = frozenset(
    "article articlebody body content entry main post story text prose page markdown".split()
)
# words that a token of noise may hold besides: kinds and places of boxes
PARTS = NOISE | GOOD | frozenset(
    "area articles bar block bottom box button buttons col column container form global group "
    "heading holder icon icons inner is item items label left link links list message module outer "
    "panel placeholder posts primary results right row secondary section site slot space stories "
    "thread title top trail unit visually widgets wrap wrapper zone".split()
)
LEVELS = 64  # a block adds to the value of so many containers around it, the innermost first
NOISE_WEIGHT = 0.25  # of a zone that holds most of the text, against containers outside of zones
# a quotation mark opens a value directly behind the equals sign alone; nothing is matched twice
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+)"""
_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|"
    rf"(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{_VALUE})?|=)*+)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[a-z]+")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r\xa0]+")


class Node:
    """An element that holds blocks: its path, its text, how much of it is link text, and its value:
    characters that are no links, whole from blocks in it, a half, a third ... from further below.

    ``path`` is the number of the page's path; ``first`` and ``last`` bound the blocks in it.
    ``zone`` is the innermost element around it, or itself, that is set apart; None outside of all.
    ``weight`` is 0 in zones that are no candidates. ``own`` counts what is no link in a zone itself.
    """

    __slots__ = (
        "tag", "path", "zone", "parent", "chars", "links", "value", "good", "first", "last", "weight",
        "own", "hidden",
    )

    def __init__(self, tag: str, path: int, parent: "Node | None", good: bool, first: int):
        self.tag, self.path, self.parent, self.good = tag, path, parent, good
        self.zone: Node | None = None
        self.chars = self.links = self.own = 0
        self.value = 0.0
        self.weight = 1.0
        self.hidden = False
        self.first = self.last = first


class Page:
    """The containers of a page in order, its blocks of text, and its paths, each kept once.

    A path is a pair of the path above and a step, so that deep pages take no more than their length.
    """

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.blocks: list[tuple[str, Node | None]] = []  # text and its zone
        self._steps: list[tuple[int, str]] = [(-1, "")]
        self._numbers: dict[tuple[int, str], int] = {}

    def path_below(self, above: int, step: str) -> int:
        number = self._numbers.setdefault((above, step), len(self._steps))
        if number == len(self._steps):
            self._steps.append((above, step))
        return number

    def path_text(self, number: int) -> str:
        steps: list[str] = []
        while number >= 0:
            number, step = self._steps[number]
            steps.append(step)
        return "/".join(reversed(steps))

    def path_number(self, text: str) -> int | None:
        """The number of a path of this page; None of any other."""
        number: int | None = 0
        for step in text.split("/")[1:]:
            number = self._numbers.get((number, step))
            if number is None:
                return None
        return number

    def text(self, nodes: list[Node]) -> str:
        """Blocks of containers, those of other zones left out, each block once, in page order."""
        places = {
            place
            for node in nodes
            for place in range(node.first, node.last)
            if self.blocks[place][1] is node.zone
        }
        return "\n".join(self.blocks[place][0] for place in sorted(places))


def _attributes(raw: str) -> tuple[list[list[str]], bool]:
    """Tokens of class, id and role, each as its words, lower-cased and without digits; whether it is
    hidden. The first attribute of a name counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), value.strip("\"'"))
    tokens = [
        words
        for name in ("class", "id", "role")
        for token in found.get(name, "").lower().split()
        if (words := _WORDS.findall(token))
    ]
    hidden = (
        "hidden" in found
        or found.get("aria-hidden", "").lower() == "true"
        or _HIDDEN.search(found.get("style", "")) is not None
    )
    return tokens, hidden


def _is_noise(words: list[str]) -> bool:
    """Whether a token names noise as a whole: ``ad-slot`` does, ``no-ads`` and ``has-sidebar`` do
    not. Single letters, as between the digits of a size, say nothing."""
    return any(w in NOISE for w in words) and all(w in PARTS or len(w) == 1 for w in words)


def parse(page: str) -> Page:
    """Containers and blocks of a page.

    A block's white space is one blank each, its references are decoded. Elements that are not closed
    end with what they lie in; the page may break off anywhere. Containers of zones hold the text of
    their zone alone. The time is linear in the page, however deep it is: a block counts in at most
    LEVELS containers around it, and characters are added up once, when an element ends.
    """
    out = Page()
    nodes, blocks = out.nodes, out.blocks
    root = Node("", 0, None, False, 0)
    nodes.append(root)
    zones: list[Node] = []
    total = 0
    stack: list[Node] = [root]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    in_link = 0
    linked = 0

    def flush() -> None:
        nonlocal pieces, linked, total
        if pieces:
            text = _BLANKS.sub(" ", html.unescape("".join(pieces))).strip()
            pieces = []
            if text:
                share = min(linked, len(text))
                node, level = stack[-1], 0
                zone = node.zone
                blocks.append((text, zone))
                node.chars += len(text)
                node.links += share
                if zone is not None:
                    zone.own += len(text) - share
                if zone is None or zone.tag not in CONTROLS:
                    total += len(text) - share
                while node is not None and node.zone is zone and level < LEVELS:
                    if node.tag in CONTAINERS or node is root or node is zone:
                        level += 1
                        node.value += (len(text) - share) / level
                    node = node.parent
        linked = 0

    def pop() -> None:
        node = stack.pop()
        opened[node.tag] -= 1
        node.last = len(blocks)
        above = node.parent
        if above is not None and above.zone is node.zone:
            above.chars += node.chars
            above.links += node.links

    at = 0
    size = len(page)
    while at < size:
        found = _TAG.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            text = page[at:begin]
            pieces.append(text)
            if in_link:
                linked += len(text.strip())
        if found is None:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCKS or name in SKIPPED:
                flush()
                if opened[name] > 0:
                    while stack[-1].tag != name:
                        pop()
                    pop()
            continue
        attributes = found[3] or ""
        if name in RAW:
            if not attributes.endswith("/"):
                at = _raw_end(name).search(page, at).end()
            continue
        if name == "br" or name == "wbr":
            pieces.append(" " if name == "br" else "")
            continue
        if name == "a":
            in_link += 1
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in BLOCKS and name not in SKIPPED:
            continue
        flush()
        in_link = 0 if name in CONTAINERS else in_link
        while stack[-1].tag in CLOSED_BY_BLOCK or (name == "li" and stack[-1].tag == "li"):
            pop()
        tokens, hidden = _attributes(attributes) if attributes else ([], False)
        above = stack[-1]
        mark = ".".join(sorted({w for words in tokens for w in words}))
        path = out.path_below(above.path, name + (f".{mark}" if mark else ""))
        noise = [_is_noise(words) for words in tokens]
        good = name in ("article", "main") or any(
            not bad and any(w in GOOD for w in words) for words, bad in zip(tokens, noise)
        )
        spared = good or name in HEADINGS or name in ("html", "body")
        node = Node(name, path, above, good, len(blocks))
        node.zone, node.hidden = above.zone, above.hidden or hidden
        if hidden or name in SKIPPED or (any(noise) and not spared):
            node.zone = node
            zones.append(node)
        stack.append(node)
        opened[name] += 1
        if name in CONTAINERS or (node.zone is node and name not in CONTROLS):
            nodes.append(node)
    flush()
    while stack:
        pop()
    for node in nodes:
        if node.zone is not None:
            most = node.zone.own * 2 > total
            node.weight = 0.0 if not most else 1.0 if _wraps(node.zone) else NOISE_WEIGHT
    return out


@lru_cache(maxsize=None)  # one per name in RAW
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>|\Z", re.I)


def _wraps(zone: Node) -> bool:
    """A form around most of a page's text is a way to build pages and no noise."""
    return zone.tag == "form" and not zone.hidden


def score(node: Node) -> float:
    """The value of a container, less for many links; articles count more, the whole page less."""
    if node.chars == 0:
        return 0.0
    value = node.value * (1.0 - node.links / node.chars) * node.weight
    if node.good:
        value *= 2.0
    elif node.tag in ("", "body"):
        value *= 0.5
    return value


def best_path(page: str | None) -> tuple[str, float] | None:
    """The path with the highest score; of equals the outermost, which comes first."""
    best: tuple[int, float] | None = None
    parsed = parse(page or "")
    for node in parsed.nodes:
        value = score(node)
        if value > 0 and (best is None or value > best[1]):
            best = node.path, value
    return None if best is None else (parsed.path_text(best[0]), best[1])


def extract(page: str | None, paths: list[str] | None) -> str:
    """Text of the containers on the first of ``paths`` that the page has text on; else of its own
    best container. Blocks are joined by line feeds; what lies in two containers is taken once.

    A path that its host agrees on is followed into zones, too, but not to what is hidden."""
    parsed = parse(page or "")
    full = [n for n in parsed.nodes if n.chars]
    chosen: list[Node] = []
    for path in paths or ():
        number = parsed.path_number(path)
        there = [n for n in full if n.path == number]
        chosen = [n for n in there if n.weight] or [n for n in there if not n.hidden]
        if chosen:
            break
    if not chosen:
        ranked = [(score(n), -i, n) for i, n in enumerate(full) if n.weight]
        chosen = [max(ranked, key=lambda x: x[:2])[2]] if ranked else []
    return parsed.text(chosen)


def host_of(url: Column) -> Column:
    """Lower-case host without port and user; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            best = best_path(page.as_py())
            if best is not None:
                hosts.append(host)
                paths.append(best[0])
        columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "path"])


def host_paths(pages: DataFrame, url: str = "url", html_column: str = "html") -> DataFrame:
    """``(host, paths)``: the winning paths of each host, most votes first.

    Each page has one vote, for its best container. Votes are summed on the map side, so a host with
    most pages costs no more than its number of paths.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html_column).alias("page"))
    votes = rows.filter("host IS NOT NULL").mapInArrow(_votes, "host string, path string")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "path-votes")
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    won = counted.join(totals, "host").filter(F.col("n") >= MIN_SHARE * F.col("total"))
    # at most 1 / MIN_SHARE rows per host
    listed = won.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("all")
    )
    return listed.select("host", F.slice("all", 1, MAX_PATHS)["path"].alias("paths"))


def _extractor() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                rows = batch.slice(at, _SLICE)
                pages, paths = rows.column("page"), rows.column("paths")
                texts = [extract(p.as_py(), x.as_py()) for p, x in zip(pages, paths)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), rows.column("url"), pa.array(texts, pa.string())],
                    ["key", "url", "text"],
                )

    return run


def extract_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html"
) -> DataFrame:
    """``(key, url, text, n_chars)`` per page.

    NULL or empty html, or a page of noise alone, has an empty text. Pages without a host are taken
    by their own best container. Every row is there once, whatever its key and url. Other columns
    are not looked at.
    """
    kind = pages.schema[key].dataType.simpleString()
    winners = materialize(host_paths(pages, url, html_column), "host-paths")
    winners = winners.withColumnRenamed("host", "_host")
    rows = pages.select(
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        F.col(html_column).alias("page"),
        host_of(F.col(url)).alias("host"),
    )
    joined = rows.join(winners, F.col("host") == F.col("_host"), "left")
    found = joined.select("key", "url", "page", "paths").mapInArrow(
        _extractor(), f"key {kind}, url string, text string"
    )
    return found.select(
        F.col("key").alias(key),
        F.col("url").alias(url),
        "text",
        F.char_length("text").cast("bigint").alias("n_chars"),
    )
