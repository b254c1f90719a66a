"""Main text of pages: what must not be lost, depth, and a plain extractor written apart."""

from __future__ import annotations

import random
import time

import pytest

from rolloom.llm import html_text

LONG = "This is the article itself, with enough words to stand out from all the rest of the page."


@pytest.mark.parametrize("tag", ["svg", "object", "iframe", "script", "template"])
def test_a_closed_element_hides_nothing_behind_it(tag):
    page = f"<article><p>{LONG}</p><{tag}/><p>after</p><{tag} class='x' /><p>end</p></article>"
    assert html_text.extract(page, None) == f"{LONG}\nafter\nend"


@pytest.mark.parametrize(
    "attributes",
    ["title=it's", "href=/o'brien", 'title=6"', "it's", "a='x' b'", "a = 'x>y'", "=' x", "a=b/"],
)
def test_apostrophes_open_no_quotation(attributes):
    page = f"<article><p {attributes}>{LONG}</p><p>it's two</p><p>don't</p></article>"
    assert html_text.extract(page, None) == f"{LONG}\nit's two\ndon't"


def test_quotations_hold_signs():
    page = f"<article><p title='a > b' data-x=\"</p>\">{LONG}</p></article>"
    assert html_text.extract(page, None) == LONG


def test_formulas_are_text():
    page = (
        f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn>"
        "<annotation encoding='tex'>x=2</annotation></math> holds.</p></article>"
    )
    assert html_text.extract(page, None) == f"{LONG} x=2 holds."


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 100_000,
        "<div>x" * 100_000 + "</p>" * 100_000,
        "<div class=c1>x" * 50_000 + "</div>" * 50_000,
        "<section><div>x</section>" * 50_000,
        "<nav><div>x" * 50_000,
        "<p a='" * 50_000,
        "<p =" * 100_000,
        "<b a b c d e" * 50_000,
        "</div>" * 200_000,
    ],
    ids=lambda page: page[:12],
)
def test_deep_and_broken_pages_take_linear_time(page):
    start = time.process_time()
    html_text.extract(page, None)
    html_text.best_path(page)
    assert time.process_time() - start < 25


def test_a_deep_page_keeps_its_text():
    depth = 20_000
    page = "<div>" * depth + f"<p>{LONG}</p>" + "</div>" * depth
    assert html_text.extract(page, None) == LONG
    path, _ = html_text.best_path(page)
    assert path == "/div" * depth
    assert html_text.extract(page, [path]) == LONG


# --- a plain extractor on trees ------------------------------------------------------------------

WORDS = "lorem ipsum dolor sit amet it's 5 < 6 & more".split()


def grow(rng, depth=0):
    """(tag, class, children) or text; well-formed, so that the tree is the page."""
    if depth > 6 or rng.random() < 0.3:
        return " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))
    tag = rng.choice(
        ["div"] * 6 + ["section", "article", "nav", "header", "aside", "form", "ul", "blockquote"]
        + ["a", "b", "span", "td", "main", "h2"] * 2
    )
    mark = rng.choice(["", "", "", "content", "sidebar", "ad-slot", "c7", "story", "no-ads"])
    return tag, mark, [grow(rng, depth + 1) for _ in range(rng.randrange(4))]


def render(node):
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;")
    tag, mark, children = node
    kind = f' class="{mark}"' if mark else ""
    return f"<{tag}{kind}>" + "".join(map(render, children)) + f"</{tag}>"


class Element:
    def __init__(self, tag, mark, above):
        self.tag, self.above = tag, above
        words = html_text._WORDS.findall(mark)
        noise = bool(words) and html_text._is_noise(words)
        self.good = tag in ("article", "main") or (
            bool(words) and not noise and any(w in html_text.GOOD for w in words)
        )
        spared = self.good or tag in html_text.HEADINGS
        self.apart = tag in html_text.SKIPPED or (noise and not spared)
        step = tag + ("." + ".".join(sorted(set(words))) if words else "")
        self.path = "" if above is None else f"{above.path}/{step}"
        self.zone = self if self.apart else above.zone if above else None


def listed(tree):
    """Elements in order, and blocks as (text, link characters, innermost element)."""
    root = Element("", "", None)
    elements, blocks = [root], []
    run: list[tuple[str, bool]] = []

    def end(element):
        text = " ".join("".join(t for t, _ in run).split())
        if text:
            linked = sum(len(t.strip()) for t, is_link in run if is_link)
            blocks.append((text, min(linked, len(text)), element))
        run.clear()

    def walk(node, element, in_link):
        if isinstance(node, str):
            run.append((node, in_link[0] > 0))
            return
        tag, mark, children = node
        if tag in html_text.BLOCKS or tag in html_text.SKIPPED:
            end(element)
            if tag in html_text.CONTAINERS:
                in_link[0] = 0
            below = Element(tag, mark, element)
            elements.append(below)
            for child in children:
                walk(child, below, in_link)
            end(below)
        else:
            in_link[0] += tag == "a"
            for child in children:
                walk(child, element, in_link)
            if tag == "a":
                in_link[0] = max(0, in_link[0] - 1)

    walk(tree, root, [0])
    end(root)
    return elements, blocks


def plain_extract(tree):
    elements, blocks = listed(tree)
    total = sum(len(t) - n for t, n, e in blocks if not (e.zone and e.zone.tag in html_text.CONTROLS))

    def counts(e):
        return e.above is None or e.tag in html_text.CONTAINERS or e.apart

    best, text = None, ""
    for e in elements:
        if not (e.above is None or e.tag in html_text.CONTAINERS
                or (e.apart and e.tag not in html_text.CONTROLS)):
            continue
        chars = links = value = 0
        mine = []
        for words, linked, inner in blocks:
            level, at = 0, inner
            if inner.zone is not e.zone:
                continue
            while at is not None and at is not e:
                level += counts(at) and at.zone is e.zone
                at = at.above
            if at is None:
                continue
            mine.append(words)
            chars += len(words)
            links += linked
            value += (len(words) - linked) / (level + 1)
        if not mine:
            continue
        weight = 1.0
        if e.zone is not None:
            own = sum(len(t) - n for t, n, x in blocks if x.zone is e.zone)
            weight = 0.0 if own * 2 <= total else 1.0 if e.zone.tag == "form" else html_text.NOISE_WEIGHT
        score = value * (1 - links / chars) * weight
        score *= 2 if e.good else 0.5 if e.tag in ("", "body") else 1
        if weight and (best is None or score > best + 1e-9):
            best, text = score, "\n".join(mine)
    return text


def test_equals_the_plain_extractor():
    rng = random.Random(11)
    different = 0
    for _ in range(1500):
        tree = ("div", "", [grow(rng) for _ in range(rng.randrange(1, 5))])
        page = render(tree).replace("&lt;", "&#60;") if rng.random() < 0.3 else render(tree)
        if "<a" in page and "&" in page:
            continue  # link characters are counted before references are decoded
        assert html_text.extract(page, None) == plain_extract(tree)
        different += 1
    assert different > 600
