"""Main text of web pages by a tree-structured graphical model.

Block elements of a page form a tree; inline elements melt into the block
around them.  Each node is content or not: its potentials come from its tag,
the words of its class, id and role, its text and its share of links, and
parent-child potentials tie neighbours in the tree.  Sum-product messages, first
upward and then downward, give every node's marginal.  The weights maximise the
conditional likelihood of labelled pages written by a seeded generator.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, table

# Kinds of elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q s samp small "
    "source span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag, or to the end of the page.
RAW = frozenset("script style textarea title iframe".split())
SKIPPED = RAW | frozenset("noscript template object svg head select option button canvas video audio".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_TAGS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th blockquote pre "
    "figure figcaption nav header footer aside form fieldset menu dialog address details hr".split()
)
_LEXICON = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs skip pagination pager",
    "head": "header masthead topbar banner logo branding site-header toolbar",
    "foot": "footer foot copyright colophon bottom legal imprint",
    "side": "sidebar aside side rail widget complementary secondary column-right",
    "note": "notice cookie cookies consent alert popup modal overlay warning gdpr announcement paywall dialog",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner-ad adsense commercial",
    "form": "form newsletter subscribe signup search login contactform",
    "talk": "comment comments disqus respond discussion replies reply reviews thread commentlist",
    "share": "share social related recommended trending popular more",
    "main": "content article post story entry main body text article-body post-content entry-content prose",
}
_WORD_OF = {w: k for k, ws in _LEXICON.items() for w in ws.split()}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)


class Node:
    """A block element: its parent's index, tag, words of its names, and lengths of its own text and link text."""

    __slots__ = ("parent", "depth", "tag", "names", "chars", "links", "below", "below_links")

    def __init__(self, parent: int, depth: int, tag: str, names: frozenset):
        self.parent, self.depth, self.tag, self.names = parent, depth, tag, names
        self.chars = self.links = self.below = self.below_links = 0


#: Skipped elements that can't hold one another: a second one ends the first.
_ALONE = frozenset("noscript head select option button".split())


def _raw_end(page: str, tag: str, at: int) -> int:
    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
    return stop.end() if stop else len(page)


def _closed(page: str) -> dict[int, int]:
    """Ends of the skipped elements that have an end tag of their own, before their parent's, by the place after their start tag."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}
    at = 0
    while m := _MARKUP.search(page, at):
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag in INLINE or tag in VOID or not page.endswith(">", m.start(), m.end()):
            continue
        mine = places.setdefault(tag, [])
        if m[1] or m[4]:
            if mine:
                place, start = mine[-1], stack[mine[-1]][1]
                while len(stack) > place:
                    name, _ = stack.pop()
                    if places[name] and places[name][-1] == len(stack):
                        places[name].pop()
                if tag in SKIPPED:
                    ends[start] = at
        elif not (m[3] or m[6] or "").endswith("/"):
            if tag in RAW:
                at = _raw_end(page, tag, at)
                continue
            if tag in _ALONE:
                mine.clear()
            mine.append(len(stack))
            stack.append((tag, at))
    return ends


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order, the root first, and blocks of text as (node, text).

    Skipped elements go with what they hold if they have an end tag of their own.
    Of those without one, options end at the next block element or end tag, and
    the others melt into the element around them, so that no article is lost.
    """
    stops = _closed(page)
    quiet = False
    nodes = [Node(-1, 0, "html", frozenset())]
    blocks: list[tuple[int, str]] = []
    stack = [0]
    pending: list[str] = []
    anchors = 0
    at, end = 0, len(page)

    def text(piece: str) -> None:
        if piece and not quiet:
            piece = html.unescape(piece)
            pending.append(piece)
            if anchors:
                nodes[stack[-1]].links += len(piece.split()) and len(piece)

    def flush() -> None:
        if pending:
            joined = " ".join("".join(pending).split())
            pending.clear()
            if joined:
                blocks.append((stack[-1], joined))
                nodes[stack[-1]].chars += len(joined)

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not page.endswith(">", m.start(), m.end()):
            continue
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
            elif tag == "a":
                anchors = 0 if closing else 1
            continue
        quiet = False
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                if tag in RAW:
                    at = _raw_end(page, tag, at)
                elif at in stops:
                    at = stops[at]
                else:
                    quiet = tag == "option"
            flush()
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    del stack[depth:]
                    anchors = 0
                    break
            continue
        if tag in ("html", "body") and len(stack) > 1 or tag == "html":
            continue
        if tag in VOID:
            continue
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        ends = _CLOSED_BY.get(tag)
        while ends and len(stack) > 1 and nodes[stack[-1]].tag in ends:
            stack.pop()
        names = set()
        for x in _NAMES.finditer(attributes):
            for word in (x[1] or x[2] or x[3] or "").lower().split():
                names.add(word)
                names.update(re.split(r"[-_]", word))
        nodes.append(Node(stack[-1], nodes[stack[-1]].depth + 1, tag, frozenset(_WORD_OF[w] for w in names if w in _WORD_OF)))
        if not attributes.endswith("/"):
            stack.append(len(nodes) - 1)
    flush()
    for node in nodes:
        node.below, node.below_links = node.chars, node.links
    for node in reversed(nodes[1:]):
        nodes[node.parent].below += node.below
        nodes[node.parent].below_links += node.below_links
    return nodes, blocks


def _band(n: int) -> int:
    return min(n, 1) if n < 20 else 2 if n < 60 else 3 if n < 200 else 4


def node_features(node: Node) -> list[str]:
    tag = node.tag if node.tag in _TAGS else "other"
    share = node.below_links / node.below if node.below else 0.0
    return [
        "bias",
        f"tag={tag}",
        f"own={_band(node.chars)}",
        f"below={_band(node.below)}",
        f"links={min(3, int(4 * min(share, 0.99)))}",
        *[f"name={k}" for k in node.names],
        *([f"tag+name={tag}+{k}" for k in node.names]),
    ]


def edge_kind(node: Node) -> int:
    """Parent-child potentials differ by whether the child is named as boilerplate, as content, or not at all."""
    if node.tag in ("nav", "header", "footer", "aside", "form", "menu", "dialog") or node.names - {"main"}:
        return 1
    return 2 if node.tag in ("article", "main") or "main" in node.names else 0


class Trees:
    """Pages laid end to end for message passing by depth."""

    def __init__(self, pages: list[list[Node]], index: dict[str, int], grow: bool = False):
        flat = [n for p in pages for n in p]
        starts = np.cumsum([0, *[len(p) for p in pages[:-1]]]) if pages else np.zeros(0, np.int64)
        base = np.repeat(starts, [len(p) for p in pages]) if pages else np.zeros(0, np.int64)
        own = np.array([n.parent for n in flat], np.int64)
        self.parent = np.where(own >= 0, own + base, -1)
        self.kind = np.array([edge_kind(n) for n in flat], np.int64)
        depth = np.array([n.depth for n in flat], np.int64)
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(1, depth.max() + 2 if len(flat) else 1))
        self.levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ids, owner = [], []
        for i, n in enumerate(flat):
            for f in node_features(n):
                k = index.setdefault(f, len(index)) if grow else index.get(f)
                if k is not None:
                    ids.append(k)
                    owner.append(i)
        self.ids, self.owner, self.n = np.array(ids, np.int64), np.array(owner, np.int64), len(flat)

    def marginals(self, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content marginal of each node, and pairwise marginals of (parent state, child state) of each child."""
        up = np.zeros((self.n, 2))
        np.add.at(up[:, 1], self.owner, weight[self.ids])
        pot = pair[self.kind]
        message = np.zeros((self.n, 2))
        for nodes in reversed(self.levels):
            m = np.logaddexp(pot[nodes, :, 0] + up[nodes, 0:1], pot[nodes, :, 1] + up[nodes, 1:2])
            message[nodes] = m
            np.add.at(up, self.parent[nodes], m)
        down = np.zeros((self.n, 2))
        both = np.zeros((self.n, 2, 2))
        for nodes in self.levels:
            p = self.parent[nodes]
            outer = down[p] + up[p] - message[nodes]
            joint = outer[:, :, None] + pot[nodes]
            down[nodes] = np.logaddexp(joint[:, 0], joint[:, 1])
            joint = joint + up[nodes][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            both[nodes] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), both


class Model:
    def __init__(self, index: dict[str, int], weight: np.ndarray, pair: np.ndarray):
        self.index, self.weight, self.pair = index, weight, pair

    def extract(self, pages: list[str], threshold: float = 0.5) -> list[str]:
        """Main text of each page: content blocks joined by line feeds."""
        parsed = [parse(p) for p in pages]
        trees = Trees([p[0] for p in parsed], self.index)
        content = trees.marginals(self.weight, self.pair)[0] >= threshold if trees.n else np.zeros(0, bool)
        out, at = [], 0
        for nodes, blocks in parsed:
            out.append("\n".join([t for i, t in blocks if content[at + i]]))
            at += len(nodes)
        return out


def labelled_pages(n: int, seed: int = 5, unknown: float = 0.0) -> list[tuple[list[Node], np.ndarray]]:
    """Parsed pages and which nodes are content, in layouts of many kinds.

    The generator marks content elements with an attribute that the parser's
    features don't see.  A share ``unknown`` of the names is invented, so that
    tags, links and lengths must tell what the lexicon can't.
    """
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 4, b: int = 30) -> str:
        return words(a, b).capitalize() + rng.choice([".", ".", "?", ""])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def element(tag: str, names: str, body: str, content: bool = False) -> str:
        attribute = f' {rng.choice(["class", "id"])}="{names}"' if names else ""
        return f"<{tag}{attribute}{' data-content' if content else ''}>{body}</{tag}>"

    def paragraphs(k: int, content: bool = False) -> str:
        return "".join(element("p", "", rng.choice(["", "<b>"]) + sentence(rng.choice([1, 2, 5]), rng.choice([5, 60, 150] if content else [5, 40, 60])), content) for _ in range(k))

    def named(kind: str) -> str:
        if unknown and rng.random() < unknown:
            return words(1, 1) + rng.choice(["", "-x1", "__wrap", " c12"])
        return rng.choice(_LEXICON[kind].split())

    def boilerplate() -> str:
        kind = rng.choice(["menu", "head", "foot", "side", "note", "ad", "ad", "form", "talk", "talk", "share"])
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        plain = tag != "div" and rng.random() < 0.5
        if not plain and rng.random() < 0.6:
            tag = rng.choice(["div", "section"])
        body = {
            "menu": lambda: links(rng.randint(2, 8)),
            "head": lambda: rng.choice([words(1, 4), element("h1", "", words(1, 3)), links(3), paragraphs(1)]),
            "foot": lambda: "&copy; " + rng.choice([words(2, 9), sentence(), paragraphs(1), links(3)]),
            "side": lambda: rng.choice([links(4), paragraphs(2), element("h3", "", words(1, 3)) + paragraphs(1)]),
            "note": lambda: rng.choice([sentence(), paragraphs(1)]),
            "ad": lambda: rng.choice([sentence(), paragraphs(1), f'<a href="/x">{words(2, 6)}</a>']),
            "form": lambda: rng.choice([sentence(), paragraphs(1)]) + "<input>",
            "talk": lambda: element("h3", "", words(1, 2)) * rng.randint(0, 1) + rng.choice(
                [paragraphs(rng.choice([1, 2, 4, 20])), "".join(element("div", named("talk"), paragraphs(rng.randint(1, 2))) for _ in range(3)), "<ul>" + "".join(element("li", "", sentence()) for _ in range(3)) + "</ul>"]
            ),
            "share": lambda: rng.choice([links(3), words(2, 5)]),
        }[kind]()
        return element(tag, "" if plain else named(kind), body)

    def article() -> str:
        parts = []
        if rng.random() < 0.8:
            title = element("h1", "", words(2, 9), True)
            parts.append(element("header", "", title, True) if rng.random() < 0.1 else title)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            r = rng.random()
            if r < 0.75:
                parts.append(paragraphs(rng.randint(1, 2), True))
            elif r < 0.82:
                parts.append(element(rng.choice(["h2", "h3"]), "", words(1, 6), True))
            elif r < 0.88:
                parts.append(element("ul", "", "".join(element("li", "", sentence(), True) for _ in range(3)), True))
            elif r < 0.92:
                parts.append(element("blockquote", "", paragraphs(1, True), True))
            elif r < 0.95:
                parts.append(element("table", "", element("tr", "", element("td", "", words(1, 4), True) * 2, True), True))
            else:
                parts.append(element(rng.choice(["div", "section"]), "", paragraphs(2, True), True))
            if rng.random() < 0.12:
                parts.append(boilerplate())
        if rng.random() < 0.15:
            length = rng.choice([3, 40, 100])
            parts += [element("p", "", words(1, length) + ".", True) for _ in range(rng.choice([20, 60, 200]))]
        if not parts:
            parts.append(sentence())
        tag, names = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", named("main")), ("section", named("main")), ("article", named("main"))])
        body = element(tag, names, "".join(parts), True)
        if rng.random() < 0.2:
            body = element("main" if tag != "main" else "div", "", body, rng.random() < 2)
        return body

    out = []
    for _ in range(n):
        before = "".join(boilerplate() for _ in range(rng.randint(1, 4)))
        after = "".join(boilerplate() for _ in range(rng.randint(0, 4)))
        body = before + article() + after
        if rng.random() < 0.3:
            body = f"<div>{body}</div>"
        page = f"<html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>"
        if rng.random() < 0.2:
            page = re.sub(r"</p>|</li>", "", page)
        marked = _marks(page)
        nodes, _ = parse(page)
        out.append((nodes, marked))
    return out


def _marks(page: str) -> np.ndarray:
    """Which nodes carry the generator's mark, in the order in which parse() makes them."""
    marks = [False]
    skip = INLINE | VOID | SKIPPED | {"html"}
    for m in re.finditer(r"<([a-z][a-z0-9]*)([^>]*)>", page):
        if m[1] not in skip:
            marks.append("data-content" in m[2])
    return np.array(marks, float)


@lru_cache(maxsize=2)
def trained(pages: int = 600, rounds: int = 150, seed: int = 5, unknown: float = 0.2) -> Model:
    """Weights by gradient ascent on the penalised conditional likelihood of generated pages."""
    data = labelled_pages(pages, seed, unknown)
    index: dict[str, int] = {}
    trees = Trees([d[0] for d in data], index, grow=True)
    truth = np.concatenate([d[1] for d in data])
    child = trees.parent >= 0
    p, c = truth[trees.parent[child]].astype(int), truth[child].astype(int)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (trees.kind[child], p, c), 1)
    weight, pair = np.zeros(len(index)), np.zeros((3, 2, 2))
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(pair), np.zeros_like(pair)]
    for t in range(1, rounds + 1):
        content, both = trees.marginals(weight, pair)
        g = -weight
        np.add.at(g, trees.ids, (truth - content)[trees.owner])
        h = seen - pair
        np.add.at(h, trees.kind[child], -both[child])
        for x, grad, m, v in ((weight, g, 0, 1), (pair, h, 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * grad
            state[v] = 0.99 * state[v] + 0.01 * grad**2
            x += 0.1 * (state[m] / (1 - 0.9**t)) / (np.sqrt(state[v] / (1 - 0.99**t)) + 1e-8)
    return Model(index, weight, pair)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html", model: Model | None = None) -> DataFrame:
    """One row per page: the columns ``keep``, text and n_chars (code points).

    A null page counts as empty; a page without content gives an empty text;
    repeated rows give repeated results; an empty table gives an empty result.
    """
    model = model or trained()

    def make():
        def run(texts: list[str]) -> dict[str, list]:
            out = model.extract(texts)
            return {"text": out, "n_chars": [len(t) for t in out]}

        return run

    return map_texts(pages, list(keep), html_column, make, "text string, n_chars long")


def op10_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page; see extract() for nulls, empty pages and repeats."""
    return extract(table(spark, sf_dir, "pages"))
