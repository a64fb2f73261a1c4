"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is read as a vector
of its tag path (hashed names of elements, classes, ids and roles), its hashed
words, its link share and length. A bidirectional LSTM over the whole page
labels every block as content or not; content blocks are joined in page order.

The labeller is trained here, on two kinds of examples: pages of the table,
where elements of known meaning (``article``, ``nav``, ``footer``, ...) label
the blocks below them and all other blocks are context, and pages put together
from templates of the usual page parts, with words of the former.

Bound: ``TRAIN_PAGES`` pages (the first by a hash of the id) of at most
``TRAIN_CHARS`` characters are examples. All pages are extracted whole.

Defined results: a null or empty page, or one without content, gives the empty
text. White space is what ``str.split`` takes for it: Unicode's, with no-break
spaces, and U+001C to U+001F. Broken markup is read as far as it goes. Repeated rows are extracted
each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.llm.bilstm import BiLstm
from loresift.llm.common import filled, slices, small_batches
from loresift.llm.html_blocks import FEATURES, Block, blocks, features

TRAIN_PAGES = 200
TRAIN_CHARS = 60_000
TEMPLATE_PAGES = 500
#: Examples are cut into runs of so many blocks.
RUN = 120

#: Names that mark content and names that mark everything else (fixed values).
CONTENT = frozenset({"article", "main"})
BOILERPLATE = frozenset(
    "nav footer aside form head button select label menu dialog .ad .ads .advert .advertisement .banner .breadcrumb "
    ".breadcrumbs .comment .comments .cookie .cookies .footer .header .login .menu .nav .navbar .navigation .newsletter "
    ".notice .popup .promo .related .share .sidebar .social .sponsored .subscribe .toolbar .widget".split()
)

#: Page parts for the templates: opening and closing markup, and how the text comes (fixed values).
_AROUND = (
    ("<nav>", "</nav>", "links"), ('<div class="menu">', "</div>", "links"), ('<ul class="nav">', "</ul>", "links"),
    ("<header>", "</header>", "short"), ('<div class="header">', "</div>", "short"), ("<aside>", "</aside>", "text"),
    ('<div class="sidebar">', "</div>", "links"), ('<div id="sidebar">', "</div>", "text"),
    ('<div class="cookie-notice">', "</div>", "text"), ('<div class="notice">', "</div>", "text"),
    ('<div class="ad">', "</div>", "text"), ('<div class="ads">', "</div>", "text"),
    ('<div class="advert">', "</div>", "short"), ('<section class="advertisement">', "</section>", "text"),
    ('<form action="/s">', "</form>", "form"), ('<div class="newsletter"><form>', "</form></div>", "form"),
    ('<div class="related">', "</div>", "links"), ('<div class="share">', "</div>", "links"),
    ('<div class="promo">', "</div>", "text"), ('<div class="banner" role="banner">', "</div>", "short"),
    ('<div class="breadcrumbs">', "</div>", "links"), ('<div role="navigation">', "</div>", "links"),
)
_AFTER = (
    ("<footer>", "</footer>", "text"), ('<div class="footer">', "</div>", "short"),
    ('<section class="comments"><h2>{}</h2>', "</section>", "text"), ('<div id="comments">', "</div>", "text"),
    ('<div class="comment">', "</div>", "text"), ('<ol class="comment-list">', "</ol>", "items"),
)
_BODY = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post">', "</div>"),
    ('<article class="post">', "</article>"), ('<div class="entry-content">', "</div>"), ('<div class="story">', "</div>"),
    ('<div role="main">', "</div>"), ("<article><div>", "</div></article>"), ("<div>", "</div>"),
)


def known_label(block: Block) -> int:
    """1 for content, 0 for the rest, -1 where the markup doesn't say."""
    if block.path & BOILERPLATE:
        return 0
    return 1 if block.path & CONTENT else -1


def template_page(draw: np.random.Generator, words: list[str]) -> tuple[list[Block], np.ndarray]:
    """A page of random parts, and its labels. Content blocks carry a mark while the page is read."""

    def text(low: int, high: int) -> str:
        if draw.random() < 0.06:  # one word over and over, in any part
            return " ".join([words[draw.integers(len(words))]] * int(draw.integers(low, 5 * high)))
        return " ".join(words[i] for i in draw.integers(len(words), size=draw.integers(low, high)))

    def part(opening: str, closing: str, kind: str) -> str:
        inner = {
            "links": lambda: "<ul>" + "".join(f'<li><a href="/">{text(1, 3)}</a></li>' for _ in range(draw.integers(2, 8))) + "</ul>",
            "short": lambda: text(1, 8),
            "text": lambda: "".join(f"<p>{text(2, 40)}</p>" for _ in range(draw.integers(1, 4))) if draw.random() < 0.6 else text(2, 25),
            "form": lambda: f"<label>{text(1, 3)}</label><input name=q><button>{text(1, 2)}</button>",
            "items": lambda: "".join(f"<li>{text(3, 30)}</li>" for _ in range(draw.integers(1, 5))),
        }[kind]()
        return opening.replace("{}", text(1, 3)) + inner + closing

    def some(parts: tuple, most: int) -> list[str]:
        return [part(*parts[i]) for i in draw.integers(len(parts), size=draw.integers(0, most + 1))]

    def content() -> str:
        out = [f"<h1>\x01{text(2, 10)}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.integers(1, 14)):
            kind = draw.random()
            if kind < 0.7:
                out.append(f"<p>\x01{text(1, 80)}</p>")
            elif kind < 0.78:
                out.append(f"<h2>\x01{text(1, 6)}</h2>")
            elif kind < 0.86:
                out.append(f"<p><b>\x01{text(2, 10)}<br>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>\x01{text(1, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                out.append(f'<p>\x01{text(2, 20)} <a href="/x">{text(1, 3)}</a> {text(2, 20)}</p>')
            elif kind < 0.97:
                out.append(f"<blockquote>\x01{text(3, 30)}</blockquote>")
            else:
                out.append(part(*_AROUND[draw.integers(len(_AROUND))]))
        if draw.random() < 0.2:
            out.append(part(*_AFTER[2 + draw.integers(len(_AFTER) - 2)]))
        return "".join(out)

    opening, closing = _BODY[draw.integers(len(_BODY))]
    page = "".join(
        [f"<html><head><title>{text(2, 10)}</title></head><body>", *some(_AROUND, 4), opening, content(), closing,
         *some(_AROUND, 2), *some(_AFTER, 2), "</body></html>"]
    )
    rows = blocks(page)
    labels = np.array([b.text.startswith("\x01") for b in rows], np.int8)
    for b in rows:
        b.text = b.text.removeprefix("\x01")
    return rows, labels


def train(pages: list[str], seed: int = 11) -> BiLstm:
    """Fit the labeller on example pages and templates."""
    draw = np.random.default_rng(seed)
    examples = [(rows, np.array([known_label(b) for b in rows], np.int8)) for rows in map(blocks, pages) if rows]
    words = [w for rows, _ in examples for b in rows for w in b.text.split()[:40]] or ["word"]
    examples += [template_page(draw, words) for _ in range(TEMPLATE_PAGES)]
    sequences, labels = [], []
    for rows, known in examples:
        vectors = features(rows)
        for at in range(0, len(rows), RUN):
            sequences.append(vectors[at : at + RUN])
            labels.append(known[at : at + RUN])
    return BiLstm(FEATURES).fit(sequences, labels)


def main_texts(labeller: BiLstm, pages: list[str]) -> list[str]:
    """The content blocks of each page, one per line."""
    parsed = [blocks(page) for page in pages]
    flat = features([b for rows in parsed for b in rows])
    # place on the page is by page
    ends = np.cumsum([0, *map(len, parsed)])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        flat[a:b, -2] = np.arange(b - a) / max(1, b - a)
    chances = labeller.probabilities([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    return [
        "\n".join(b.text for b, p in zip(rows, page, strict=True) if p >= 0.5)
        for rows, page in zip(parsed, chances, strict=True)
    ]


def _extractor(labeller: BiLstm) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            texts = main_texts(labeller, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), filled(F.col("html")).alias("html")
    )
    # a bound on the hash leaves about ten times as many pages as are wanted, so
    # that no more reach the driver, however many tasks there are
    number = F.xxhash64("page_id")
    share = min(1.0, 10 * TRAIN_PAGES / max(1, rows.count()))
    few = rows.where(number <= F.lit(int((share - 0.5) * 2.0**64) if share < 1 else 2**63 - 1))
    examples = (
        few.where(F.length("html").between(1, TRAIN_CHARS))
        .orderBy(number, "page_id")
        .limit(TRAIN_PAGES)
        .select("html")
        .collect()
    )
    labeller = train(sorted(r.html for r in examples))
    return rows.mapInArrow(_extractor(labeller), "page_id long, url string, text string, n_chars long")
