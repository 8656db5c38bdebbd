"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word count and link density, those of the
blocks before and after it, and by what encloses it. A decision tree grown in numpy on a small labelled table, built
from the example pages below, says which blocks belong to the article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block, that enclose something, and whose content is never text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("a article aside blockquote body button details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 head header html li main menu nav ol p section select span table td th title tr ul".split())
HIDDEN = "canvas|iframe|noscript|object|script|style|svg|template|textarea|title"
#: Words that begin or end the class, id or role of what is not the article, those that do so whatever
#: follows, those that say nothing of their own element, and words that end the names of what is the article.
ASIDE = frozenset("ad ads advert adverts advertisement advertising alert banner bar bio breadcrumb breadcrumbs byline cite comment commentlist comments consent contentinfo cookie cookies copyright disclaimer discussion disqus dropdown foot footer form gdpr header login masthead menu meta modal nav navbar navbox navigation newsletter notice notices notification pager pagination popular popup privacy promo promoted promotion rail recommended related replies reply respond search share sharing shop side sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar tracking trending warning widget widgets".split())
STRONG = frozenset("ad ads advert comment comments cookie disqus footer form header menu modal nav navbar newsletter promo reply sidebar widget".split())
ABOUT = frozenset("category has is no not tag type with without".split())
ARTICLE = frozenset("article articlebody body content entry main maincontent post prose richtext single story text".split())
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({HIDDEN})\b(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+))>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
HINT = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SIDES = frozenset("nav aside form button select menu dialog option".split())
ENDS = frozenset("header footer".split())
WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    side: int  # enclosed in a tag that is not for articles
    hint: int  # enclosed in something named as not the article
    within: int  # enclosed in what is or is named as the article
    heading: int
    item: int


def named(name: str) -> int:
    """1 if a class, id or role names the article, -1 if something beside it, else 0."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    if not parts or parts[0] in ABOUT:
        return 0
    if parts[0] in STRONG:
        return -1
    if parts[-1] in ARTICLE:
        return 1
    return -1 if parts[0] in ASIDE or parts[-1] in ASIDE else 0


@lru_cache(maxsize=4096)
def hints(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name something beside the article; the article."""
    found = {named(n) for m in HINT.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()}
    return -1 in found, 1 in found and -1 not in found


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Malformed markup is read as far as it goes; a lone '<' is text.

    What encloses a block is kept in running counts, so that the cost is linear in the page however deep it nests.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []  # tag; what it adds to the counts
    counts = [0, 0, 0, 0, 0, 0]  # open links, sides, hints, within, headings, items
    opened: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    at = 0

    def flush() -> None:
        if not parts:
            return
        text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        linked = sum(len(p.split()) for p, a in parts if a)
        parts.clear()
        if text:
            words = len(text.split())
            out.append(Block(text, words, min(linked, words), *(int(c > 0) for c in counts[1:])))

    def push(tag: str, adds: tuple[int, ...]) -> None:
        stack.append((tag, adds))
        opened[tag] = opened.get(tag, 0) + 1
        for i, v in enumerate(adds):
            counts[i] += v

    def pop() -> str:
        tag, adds = stack.pop()
        opened[tag] -= 1
        for i, v in enumerate(adds):
            counts[i] -= v
        return tag

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], counts[0] > 0))
        at = m.end()
        close, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if tag is None:
            if m[1] and m[1].lower() not in ("script", "style", "template"):  # those leave no gap
                parts.append((" ", False))
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append((" ", False))
        if tag not in CONTAINER:
            continue
        if close:
            if opened.get(tag):
                while pop() != tag:
                    pass
        elif not attributes.endswith("/"):
            if tag in BLOCK:  # a new paragraph or item ends an open one
                while stack and stack[-1][0] in ("p", "span", "a"):
                    pop()
                if tag == "li" and stack and stack[-1][0] == "li":
                    pop()
            aside, article = hints(attributes) if attributes and "=" in attributes and tag != "html" else (False, False)
            side = tag in SIDES or tag == "footer" or (tag == "header" and not counts[3])
            within = tag in ("article", "main") or (article and tag not in ("body", "a", "span"))
            push(tag, (int(tag == "a"), int(side), int(aside and tag not in WHOLE), int(within), int(tag in HEADINGS), int(tag == "li")))
    if at < len(page):
        parts.append((page[at:], counts[0] > 0))
    flush()
    return out


#: The names of table()'s columns.
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "side", "hint", "within", "heading", "item", "page has an article")


def table(found: list[Block]) -> np.ndarray:
    """The features of each block: its own and its neighbours' word counts and link densities, and what encloses it."""
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / max(1, b.words) for b in found])
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    inside = np.array([b.within for b in found], float)
    any_inside = np.full(len(found), float(inside.any()))
    rest = [[b.side, b.hint, b.within, b.heading, b.item] for b in found]
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), np.array(rest, float).reshape(-1, 5), any_inside])


def grown(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 3):
    """A classification tree by Gini impurity: (feature, cut, low branch, high branch) or the majority label."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return int(2 * y.sum() > len(y))
    best = (1e-9, None, None)
    gini = lambda n, k: 2 * k * (n - k) / n
    whole = gini(len(y), y.sum())
    for f in reversed(range(x.shape[1])):  # of equal splits, the one by what encloses a block
        order = np.argsort(x[:, f], kind="stable")
        v, k = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        gain = whole - gini(n, k[:-1]) - gini(len(y) - n, k[-1] - k[:-1])
        gain[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = 0
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], f, (v[i] + v[i + 1]) / 2)
    if best[1] is None:
        return int(2 * y.sum() > len(y))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grown(x[low], y[low], depth - 1, least), grown(x[~low], y[~low], depth - 1, least)


def decided(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    feature, cut, low, high = tree
    return np.where(x[:, feature] <= cut, decided(low, x), decided(high, x))


def examples() -> list[str]:
    """Small pages in common shapes. Blocks of the article begin with 'K', the others with 'D'.

    Half of the pages name and tag nothing: there only word counts and link densities tell menus, link lists and lone
    short texts among them from paragraphs, short paragraphs among long ones, and paragraphs that are one link.
    """
    rng = np.random.default_rng(3)
    words = lambda k, n: k + "".join(f" w{i}" for i in range(int(n) - 1))
    link = lambda k, n: f"<a href='/x'>{words(k, n)}</a>"
    menu = lambda n: "<ul>" + "".join(f"<li>{link('D', 1 + i % 3)}</li>" for i in range(n)) + "</ul>"
    some = lambda text, share=0.6: text if rng.random() < share else ""
    pages = [f"<p>{words('K', n)}</p>" * k for n in (1, 3, 8, 30) for k in (1, 2, 3)]  # nothing but text
    for at in range(1200):
        body = [f"<p>{words('K', n)}</p>" for n in rng.choice([1, 3, 6, 12, 25, 60, 140], rng.integers(1, 7))]
        if at % 3 == 1:
            body.insert(1, f"<p>{words('K', 30)} {link('a', 3)} more of it</p>")
        if at % 5 == 1:  # a paragraph that is one link, between paragraphs
            body = [*body, f"<p>{words('K', rng.integers(5, 60))}</p>", f"<p>{link('K', rng.integers(2, 15))}</p>", f"<p>{words('K', rng.integers(5, 60))}</p>"]
        if at % 4 == 2:
            body.insert(len(body) // 2, f"<ul><li>{words('K', 5)}</li><li>{words('K', 9)}</li></ul><blockquote>{words('K', 20)}</blockquote>")
        title = f"<h1>{words('K', rng.integers(1, 9))}</h1>"
        if at % 2:  # nothing is named: no tags or classes that tell the parts
            body = [f"<p>{words('K', rng.integers(12, 60))}</p>", *body, f"<p>{words('K', rng.integers(12, 60))}</p>"]
            short = lambda: f"<div>{words('D', rng.integers(1, 9))}</div>"  # noqa: E731  a notice or advert among link lists
            pages.append(f"<body><div>{menu(3 + at % 5)}</div>{short()}<div>{menu(4)}</div><div>{title}{''.join(body)}</div><div>{menu(3 + at % 4)}</div>{short()}<div>{menu(3)}</div><div>{words('D', 3 + at % 6)} {link('D', 3)}</div></body>")
            continue
        asides = ["<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<div class='cookie-notice'><p>{}</p></div>", "<form><label>{}</label></form>", "<div id='sidebar'><p>{}</p></div>", "<section class='comments'><div class='comment-body'><p>{}</p></div></section>"]
        aside = lambda: "".join(asides[rng.integers(6)].format(words("D", rng.choice([1, 4, 9, 30, 90]))) for _ in range(rng.integers(1, 3)))
        plain = lambda: f"<div>{words('D', rng.choice([1, 4, 9, 30, 90]))}</div>"  # noqa: E731  outside the article, not named
        related = f"<div class='related'>{menu(3)}</div>"
        shells = ["<article><header>{t}</header>{b}{x}</article>", "<main class='shop-article'>{t}{b}</main>", "<article class='post category-news'>{t}{b}{r}</article>", "<div class='post-content'>{t}{b}</div>", "<article>{t}{b}{x}<footer><p>{d}</p></footer></article>"]
        inner = shells[rng.integers(5)].format(t=some(title), b="".join(body), x=some(aside()), r=some(related), d=words("D", rng.integers(1, 20)))
        head = f"<header>{link('D', 2)}<p>{words('D', 7)}</p></header>" if at % 3 == 0 else f"<nav>{menu(5)}</nav>"
        foot = f"<footer><p>{words('D', rng.choice([1, 3, 20]))}</p></footer>"
        pages.append(f"<body class='single has-sidebar'>{some(head)}{some(aside())}{some(plain())}{inner}{some(plain(), 0.4)}{some(aside())}{some(foot)}</body>")
    return pages


@lru_cache(maxsize=1)
def trained():
    found = [blocks(p) for p in examples()]
    return grown(np.vstack([table(f) for f in found]), np.array([b.text.startswith("K") for f in found for b in f], int))


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = decided(tree, table(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every row: its id, url, text (blocks joined by a line feed) and n_chars (code points).

    A null or empty page, or one without text, has an empty text. Repeated rows stay; no rows give no rows; other
    columns of pages play no part.
    """
    tree = trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    base = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"))
    kinds = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return base.mapInArrow(read, f"{kinds}, text string, n_chars bigint")
