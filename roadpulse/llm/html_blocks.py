"""Main text of web pages from flat text blocks and a decision tree.

A page is a sequence of text blocks; block-level tags and the bounds of containers end one, other
tags and ``br`` do not. Scripts, styles, comments and the head are no text, and neither is what
stands in boilerplate (navigation, footer, aside, form, or a container named as menu, advert,
notice, reader comments and the like). A block is described by its words and link density, those
of its neighbours, whether it is a heading and whether an article is marked around it. A small
labelled table of such blocks trains a decision tree, which says of each block whether it is
content; where no article is marked, the neighbours' words and links decide on short blocks.

White space is what Python's ``str.split`` takes for it, no-break spaces included.

Defined results: null or empty html, and pages without content, have the empty text; unclosed tags
end with their container or the page; unknown or broken character references stay as they are;
repeated rows are done each. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas select option button textarea".split())
RAW = frozenset("script style textarea title".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
CONTAINERS = frozenset("article main section div header body html ul ol dl table tbody tr td th figure blockquote details fieldset".split()) | BOILERPLATE | SILENT
VOID = frozenset("br hr img input meta link source area base col embed track wbr".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption address summary caption hr option legend center thead tfoot".split())
#: Names of boilerplate, alone or with what may stand before and after them in a class or id.
HINTS = re.compile(
    r"(?:(?!(?:no|non|not|has|have|with|without|hide|hidden|show|is|page)[_-])[a-z0-9]+[_-])*?"
    r"(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscri\w*|menu|nav\w*|breadcrumb\w*|sidebar|side|footer|"
    r"comment\w*|disqus|repl(?:y|ies)|respond|related|recommend\w*|share|sharing|social|widget|login|signup|search)"
    r"(?:[_-](?:ads?|area|bar|block|body|box|btn|buttons?|col|column|container|content|feed|form|grid|group|header|icons?|inner|items?|left|links?|list|main|menu|message|nav|outer|"
    r"panel|posts?|right|row|section|slot|strip|text|thread|title|top|bottom|widgets?|wrap|wrapper|\d+))*",
    re.IGNORECASE,
)
#: Names of containers whose articles are readers', or other pages'.
OTHERS = re.compile(r"comment|repl|respond|disqus|related|recommend", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

# A quote opens a value only after an equals sign; a value without one ends at white space.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)?|[^=>])*+)(?:>|\Z)""",
    re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)

ARTICLE, NEITHER, BOILER, ALIEN = 1, 0, -1, -2
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article")

# Labelled blocks: FEATURES, then 1 for content. Fixed values, made for this table.
LABELLED = (
    # Short lines among long text are content, among other short lines or links they are not.
    (4, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1), (3, 0.0, 70, 0.0, 60, 0.0, 0, 0, 1), (5, 0.0, 30, 0.0, 45, 0.0, 0, 0, 1),
    (2, 0.0, 44, 0.0, 38, 0.0, 0, 0, 1), (1, 0.0, 52, 0.0, 61, 0.0, 0, 0, 1), (8, 0.0, 33, 0.0, 29, 0.0, 0, 0, 1),
    (6, 0.0, 90, 0.0, 24, 0.0, 0, 0, 1), (12, 0.0, 41, 0.0, 70, 0.0, 0, 0, 1), (10, 0.1, 80, 0.0, 35, 0.0, 0, 0, 1),
    (4, 0.0, 60, 0.0, 2, 0.0, 0, 0, 1), (5, 0.0, 55, 0.0, 3, 1.0, 0, 0, 1), (7, 0.0, 40, 0.1, 2, 1.0, 0, 0, 1),
    (3, 0.0, 2, 1.0, 48, 0.0, 1, 0, 1), (6, 0.0, 1, 1.0, 66, 0.0, 1, 0, 1), (2, 0.0, 3, 0.0, 35, 0.0, 1, 0, 1),
    (8, 0.0, 2, 0.5, 80, 0.0, 1, 0, 1), (5, 0.0, 1, 0.0, 30, 0.1, 0, 0, 1), (7, 0.0, 0, 0.0, 28, 0.0, 1, 0, 1),
    (4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0), (5, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0),
    (3, 0.0, 5, 0.0, 2, 1.0, 0, 0, 0), (8, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (6, 0.0, 4, 0.5, 5, 0.6, 0, 0, 0),
    (2, 0.0, 1, 1.0, 6, 0.0, 1, 0, 0), (4, 0.0, 6, 0.0, 3, 1.0, 1, 0, 0), (7, 0.0, 5, 1.0, 4, 0.0, 0, 0, 0),
    (10, 0.1, 3, 1.0, 4, 1.0, 0, 0, 0), (2, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0), (12, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0),
    (3, 0.0, 8, 0.3, 0, 0.0, 0, 0, 0), (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0), (1, 0.0, 2, 0.0, 1, 0.0, 0, 0, 0),
    # A run of short sentences without links is text too.
    (9, 0.0, 8, 0.0, 7, 0.0, 0, 0, 1), (7, 0.0, 10, 0.0, 9, 0.0, 0, 0, 1), (6, 0.0, 0, 0.0, 9, 0.0, 0, 0, 1),
    (9, 0.0, 12, 0.0, 0, 0.0, 0, 0, 1), (4, 0.0, 9, 0.0, 8, 0.0, 0, 0, 1), (6, 0.0, 7, 0.0, 0, 0.0, 0, 0, 1),
    (10, 0.0, 4, 0.0, 11, 0.0, 0, 0, 1), (8, 0.0, 14, 0.0, 4, 0.0, 0, 0, 1), (5, 0.0, 13, 0.0, 12, 0.0, 0, 0, 1),
    (11, 0.0, 0, 0.0, 6, 0.0, 0, 0, 1), (7, 0.0, 6, 0.0, 5, 0.0, 0, 0, 1), (4, 0.0, 7, 0.0, 0, 0.0, 0, 0, 1),
    (3, 0.0, 10, 0.0, 6, 0.0, 0, 0, 1), (3, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0), (4, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0),
    (3, 0.0, 3, 1.0, 3, 0.0, 0, 0, 0), (6, 0.0, 4, 1.0, 6, 1.0, 0, 0, 0), (7, 0.0, 8, 1.0, 2, 0.0, 0, 0, 0),
    # Long text is content, also alone between menus; with links in it the neighbours tell.
    (40, 0.0, 30, 0.0, 55, 0.0, 0, 0, 1), (85, 0.05, 7, 0.0, 60, 0.0, 0, 0, 1), (22, 0.0, 45, 0.0, 38, 0.0, 0, 0, 1),
    (18, 0.1, 50, 0.0, 2, 1.0, 0, 0, 1), (30, 0.0, 3, 1.0, 28, 0.0, 0, 0, 1), (110, 0.2, 12, 0.0, 5, 0.0, 0, 0, 1),
    (16, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (30, 0.0, 40, 0.0, 2, 1.0, 0, 0, 1), (55, 0.0, 20, 0.0, 1, 1.0, 0, 0, 1),
    (18, 0.0, 1, 1.0, 17, 0.0, 0, 0, 1), (16, 0.0, 2, 1.0, 10, 0.0, 0, 0, 1), (20, 0.0, 3, 1.0, 4, 0.0, 0, 0, 1),
    (26, 0.1, 3, 1.0, 1, 1.0, 0, 0, 1), (24, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1), (70, 0.0, 1, 1.0, 0, 0.0, 0, 0, 1),
    (20, 0.5, 60, 0.0, 45, 0.0, 0, 0, 1), (14, 0.5, 38, 0.0, 50, 0.1, 0, 0, 1), (28, 0.45, 70, 0.0, 30, 0.0, 0, 0, 1),
    (14, 0.6, 8, 0.5, 3, 1.0, 0, 0, 0), (20, 0.5, 4, 1.0, 6, 1.0, 0, 0, 0), (28, 0.45, 5, 0.8, 9, 0.7, 0, 0, 0),
    (30, 0.9, 3, 1.0, 12, 0.8, 0, 0, 0), (9, 0.8, 60, 0.0, 4, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0),
    (1, 1.0, 80, 0.0, 1, 1.0, 0, 0, 0), (12, 1.0, 2, 1.0, 50, 0.0, 0, 0, 0), (40, 0.95, 30, 0.0, 25, 0.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0), (2, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0), (1, 1.0, 2, 1.0, 90, 0.0, 0, 0, 0),
    (1, 1.0, 70, 0.0, 3, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 0, 0.0, 0, 0, 0), (2, 1.0, 30, 0.0, 2, 1.0, 0, 0, 0),
    (3, 1.0, 60, 0.0, 55, 0.0, 0, 0, 0), (25, 0.85, 4, 1.0, 3, 1.0, 0, 0, 0), (6, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0),
    # Where an article is marked, its blocks are content; see ``default_tree`` for more of these.
    (8, 0.0, 5, 0.0, 60, 0.0, 1, 1, 1), (60, 0.0, 8, 0.0, 75, 0.0, 0, 1, 1), (1, 0.0, 60, 0.0, 44, 0.0, 0, 1, 1),
    (3, 0.0, 1, 1.0, 2, 0.0, 0, 1, 1), (150, 0.1, 40, 0.0, 9, 0.0, 0, 1, 1), (12, 0.5, 80, 0.0, 70, 0.0, 0, 1, 1),
    (2, 1.0, 50, 0.0, 50, 0.0, 0, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1), (1, 0.0, 2, 0.0, 1, 1.0, 0, 1, 1),
    (25, 0.2, 1, 1.0, 6, 0.5, 0, 1, 1), (4, 0.0, 9, 0.0, 2, 0.0, 0, 1, 1), (3, 0.7, 45, 0.0, 2, 1.0, 0, 1, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 1), (6, 0.9, 4, 0.8, 3, 0.9, 0, 1, 1), (9, 0.0, 3, 1.0, 1, 0.0, 1, 1, 1),
    (2, 0.0, 14, 0.0, 2, 0.0, 0, 1, 1), (7, 0.0, 7, 0.0, 4, 1.0, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1),
    (1, 1.0, 1, 1.0, 0, 0.0, 0, 1, 1), (14, 0.8, 6, 1.0, 5, 1.0, 0, 1, 1), (2, 0.0, 0, 0.0, 4, 1.0, 0, 1, 1),
)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple | float:
    """A tree of (feature, limit, low side, high side) by Gini splits; a leaf is the share of content."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, limit, low)
    if best is None:
        return float(y.mean())
    _, f, limit, low = best
    return f, float(limit), train_tree(x[low], y[low], depth - 1), train_tree(x[~low], y[~low], depth - 1)


def is_content(tree: tuple | float, x: tuple) -> bool:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if x[f] <= limit else high
    return tree >= 0.5


def _kind(name: str, attributes: str) -> int | None:
    """What a container says of its text; None if nothing."""
    if name in BOILERPLATE:
        return BOILER
    # Names of the page itself say what it has, not what it is.
    if name not in ("html", "body"):
        for key, *values in _NAMED.findall(attributes):
            value = "".join(values)
            if key.lower() == "role":
                if value.lower() in ROLES:
                    return BOILER
                continue
            for word in value.split():
                if HINTS.fullmatch(word):
                    return ALIEN if OTHERS.search(word) else BOILER
    return ARTICLE if name in ("article", "main") else BOILER if name == "header" else None


def blocks_of(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, words, words in links, place, heading) of each block that is not empty and not in boilerplate."""
    out, parts, linked = [], [], []
    #: Open containers: (name, place, silent).
    stack: list[tuple[str, int, bool]] = []
    place, silent, link, heading = NEITHER, False, 0, False

    def end() -> None:
        nonlocal heading
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text and place >= NEITHER:
            words = len(text.split(" "))
            inside = len(" ".join(html.unescape("".join(linked)).split()).split()) if linked else 0
            out.append((text, words, min(inside, words), place, heading))
        parts.clear()
        linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not silent and (m is None or m.start() > at):
            piece = page[at : m.start() if m else n]
            parts.append(piece)
            if link:
                linked.append(piece + " ")
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = m[1] == "/"
        if name in RAW and not closing:
            # Its content is no markup; without an end it reaches to the page's.
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else n
            if name == "title":
                end()
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            end()
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit() and not closing
            if name in CONTAINERS and name not in VOID:
                link = 0
                if not closing and not m[3].endswith("/"):
                    kind = _kind(name, m[3])
                    if name == "header" and place == ARTICLE:
                        kind = None
                    # A marked article is one also within a container that only its name makes boilerplate.
                    freed = kind == ARTICLE and place == BOILER and not any(open_[0] in BOILERPLATE for open_ in stack)
                    inner = place if (place < NEITHER and not freed) or kind is None else kind
                    stack.append((name, place, silent))
                    place, silent = inner, silent or name in SILENT
                elif closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            _, place, silent = stack[k]
                            del stack[k:]
                            break
    end()
    return out


def main_text(page: str | None, tree: tuple | float) -> tuple[str, int]:
    """The page's content blocks joined by an empty line, and how many blocks it has."""
    blocks = blocks_of(page or "")
    density = [(b[1], b[2] / b[1]) for b in blocks]
    padded = [(0, 0.0), *density, (0, 0.0)]
    kept = []
    for i, b in enumerate(blocks):
        (w0, l0), (w1, l1), (w2, l2) = padded[i : i + 3]
        if is_content(tree, (w1, l1, w0, l0, w2, l2, int(b[4]), b[3])):
            kept.append(b[0])
    return "\n\n".join(kept), len(blocks)


def default_tree() -> tuple | float:
    """The tree of the labelled table, in which every block also stands with an article marked around it, as content."""
    marked = [(*row[:-2], 1, 1) for row in LABELLED if not row[-2]]
    table = np.array([*LABELLED, *marked], float)
    return train_tree(table[:, :-1], table[:, -1])


def _extract(tree: tuple | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            text = [t for t, _ in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([n for _, n in done], pa.int32())],
                ["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    return run


def extract_pages(pages: DataFrame, tree: tuple | float | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(default_tree() if tree is None else tree), "page_id long, url string, text string, n_chars long, n_blocks int")
