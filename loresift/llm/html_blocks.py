"""Leaf blocks of web pages, with the features the block labeller reads."""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from loresift.llm.shingles import word_hashes

PATH_SIZE = 64
WORD_SIZE = 16
FEATURES = PATH_SIZE + WORD_SIZE + 4

#: Elements that end the block before them (fixed values).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content (fixed values).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: scripts, styles, inert markup and form input (fixed values).
RAW_TAGS = frozenset("script style template textarea".split())
#: A start tag that closes an open element of the same kind, up to the container named (fixed values).
CLOSES = {
    "p": ("p",),
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_CONTAINERS = frozenset("ul ol dl table select div section article main body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    """One leaf block: its text, the names on the path above it, its link share, and the path's feature vector."""

    text: str
    path: frozenset[str]
    links: float
    vector: np.ndarray


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH_SIZE


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; text of raw elements and comments is left out.

    An element's names are its tag and the words of its class, id and role.
    """
    root = ("", frozenset(), np.zeros(PATH_SIZE, np.float32))
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack each tag is
    out: list[Block] = []
    held: list[str] = []
    size = linked = anchors = 0

    def close(depth: int) -> None:
        for tag, _, _ in stack[depth:]:
            places[tag].pop()
        del stack[depth:]

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush() -> None:
        nonlocal size, linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(Block(text, stack[-1][1], min(1.0, linked / max(1, size)), stack[-1][2]))
        held.clear()
        size = linked = 0

    def add(text: str) -> None:
        nonlocal size, linked
        held.append(text)
        size += len(text)
        linked += len(text) if anchors else 0

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if not found:
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag in RAW_TAGS:
            if not found[1] and not found[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        # the title of a drawing is part of the line it stands in
        block = tag in BLOCK_TAGS and not (tag == "title" and places.get("svg"))
        if block:
            flush()
        if found[1]:
            depth = innermost([tag])
            if depth:
                close(depth)
        elif tag not in VOID_TAGS:
            if tag in CLOSES:
                depth = innermost(CLOSES[tag])
                if depth > innermost(_CONTAINERS):
                    close(depth)
            places[tag].append(len(stack))
            if not block:
                stack.append((tag, stack[-1][1], stack[-1][2]))
            else:
                names = {tag}
                if found[3]:
                    for mark in _MARK.finditer(found[3]):
                        names.update("." + n for n in _NAME.findall((mark[1] or mark[2] or mark[3] or "").lower()))
                vector = stack[-1][2] * np.float32(0.9)
                for name in names:
                    vector[_bucket(name)] += 1.0
                stack.append((tag, stack[-1][1] | names if len(stack[-1][1]) < 200 else stack[-1][1], vector))
        if tag == "a":
            anchors = not found[1]
    add(page[at:])
    flush()
    return out


def features(rows: list[Block]) -> np.ndarray:
    """One row per block: path vector, hashed words, link share, length, and place on the page."""
    out = np.zeros((len(rows), FEATURES), np.float32)
    if not rows:
        return out
    hashes, begin = word_hashes(pa.array([b.text for b in rows], pa.string()))
    sizes = np.diff(begin)
    owner = np.repeat(np.arange(len(rows)), sizes)
    np.add.at(out, (owner, PATH_SIZE + (hashes % np.uint64(WORD_SIZE)).astype(np.int64)), 1.0)
    # shares of the words, bounded so that a word said over and over weighs little more than others
    share = out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / np.maximum(sizes, 1)[:, None]
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.minimum(share, 0.25)
    out[:, :PATH_SIZE] = np.minimum([b.vector for b in rows], 2.0)
    out[:, -4] = [b.links for b in rows]
    out[:, -3] = np.minimum(np.log1p(sizes), 6) / 4
    out[:, -2] = np.arange(len(rows)) / len(rows)
    out[:, -1] = 1.0
    return out
