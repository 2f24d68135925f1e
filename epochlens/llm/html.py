"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epochlens.llm.common import map_batches

#: Elements whose content is no text, elements that end a block, and void elements.
SILENT = frozenset("script style title noscript template svg math iframe object canvas select textarea".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that mark what surrounds an article.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer form header "
    "login menu modal nav navbar navigation newsletter notice pagination popup promo promotion related search share sharing sidebar signup "
    "social sponsor sponsored subscribe tags toolbar widget reply replies discussion respond consent gdpr banner complementary contentinfo".split()
)
BODY_TAGS = frozenset("article main".split())
#: Names that inside an article mark its own head.
HEAD_WORDS = frozenset(["header"])
#: Parts of a class that deny its mark, or say that the element only has what the mark names.
NO_MARKS = frozenset("no non not without has have with hide is".split())
#: Silent elements that can't hold one of their own kind, and those whose content holds no tags.
_FLAT = frozenset("title noscript iframe canvas select textarea".split())
_RAW = frozenset("script style title textarea".split())

# A quotation mark opens a value only after an equals sign; elsewhere it is a character like others.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CLOSED = re.compile(r"""(?:^|[\s"'])/$|^[^=]*/$""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SPLIT_MARK = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_WORDS = re.compile(r"\S+")


@dataclass
class Block:
    """A run of text between block-level tags, and what stands around it."""

    parts: list[str] = field(default_factory=list)
    link_words: int = 0
    aside: bool = False
    body: bool = False
    heading: bool = False
    item: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), a or b or c)
    return found


def hidden(given: dict[str, str]) -> bool:
    """Whether attributes, by their whole names, hide the element."""
    if given.get("hidden", "until-found").strip().lower() != "until-found":
        return True
    return given.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(given.get("style", "")))


def names_aside(given: dict[str, str], inside: bool = False) -> bool:
    """Whether a class, the id or the role names surroundings, by a whole name or the first or last part of one.

    `inside` an article the names of a head mark the article's own.
    """
    marks = ASIDE_WORDS - HEAD_WORDS if inside else ASIDE_WORDS
    for token in " ".join(given.get(n, "") for n in ("class", "id", "role")).lower().split():
        parts = [p for p in _SPLIT_MARK.split(token) if p and not p.isdigit()]
        if parts and not NO_MARKS.intersection(parts) and not marks.isdisjoint((parts[0], parts[-1])):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The text before each tag, and the tag, without the content of silent elements; at last the rest and None.

    A silent element without an end tag ends at its own tag, one of raw text at the next tag, so that the page goes on.
    """
    at, endless = 0, set()
    while m := _TOKEN.search(page, at):
        yield page[at : m.start()], m
        at = m.end()
        name = (m.group(2) or "").lower()
        if m.group(1) or name not in SILENT or _CLOSED.search(m.group(3)):
            continue
        end = None
        if name not in endless:
            end = re.compile(rf"<{'/?' if name in _FLAT else '/'}{name}\b[^>]*>", re.I).search(page, at)
            if end is None:
                endless.add(name)
        if end is not None and end[0][1] == "/":
            at = end.end()
        elif name in _RAW:
            after = _TOKEN.search(page, at)
            at = after.start() if after else len(page)
    yield page[at:], None


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. Unclosed and crossing tags are taken as they come; a missing end closes all."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool]] = []  # name, whether it marks surroundings
    current, links = Block(), 0
    tags = list(_tags(page))
    article = any(m is not None and m.group(2) and m.group(2).lower() in BODY_TAGS for _, m in tags)

    def say(raw: str) -> None:
        nonlocal links
        if not raw:
            return
        text = entities.unescape(raw)
        current.parts.append(text)
        if links:
            current.link_words += len(_WORDS.findall(text))

    def close() -> None:
        nonlocal current
        if current.text:
            names = [n for n, _ in open_tags]
            current.aside = any(marked for _, marked in open_tags)
            current.body = not article or any(n in BODY_TAGS for n in names)
            current.heading = any(re.fullmatch("h[1-6]", n) for n in names)
            current.item = "li" in names
            out.append(current)
        current = Block()

    for before, m in tags:
        say(before)
        if m is None:
            break
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name in BREAKS:
                close()
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    # Inline elements left open inside end with it.
                    links -= sum(n == "a" for n, _ in open_tags[i:])
                    del open_tags[i:]
                    break
            continue
        if name in SILENT:
            continue
        if name in BREAKS:
            close()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th"):
                # A new one ends an open one of its kind.
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] == name:
                        links -= sum(n == "a" for n, _ in open_tags[i:])
                        del open_tags[i:]
                        break
                    if open_tags[i][0] in BREAKS and open_tags[i][0] != "p":
                        break
        elif name == "br":
            current.parts.append(" ")
        if name in VOID or m.group(3).endswith("/"):
            continue
        given = attributes(m.group(3))
        unseen = hidden(given)
        inside = any(n in BODY_TAGS for n, _ in open_tags)
        # A header inside an article is its own head line.
        marked = unseen or not (inside and name == "header") and (name in ASIDE_TAGS or names_aside(given, inside))
        if name in ("body", "html", *BODY_TAGS):
            marked = False
        open_tags.append((name, marked))
        links += name == "a"
    close()
    return out


#: Features of a block: its words and link density, those of its neighbours, and where it stands.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "body", "heading", "item")


def features(found: list[Block]) -> np.ndarray:
    words = np.array([len(_WORDS.findall(b.text)) for b in found], float)
    density = np.array([b.link_words for b in found], float) / np.maximum(words, 1)
    shift = lambda x, by: np.concatenate([[0.0], x[:-1]]) if by else np.concatenate([x[1:], [0.0]])
    flags = [np.array([getattr(b, f) for b in found], float) for f in ("aside", "body", "heading", "item")]
    return np.column_stack([words, density, shift(words, 1), shift(density, 1), shift(words, 0), shift(density, 0), *flags])


#: The labelled table. Features of blocks as above, and whether the block is main text.
LABELLED = (
    # words, links, before (words, links), after (words, links), aside, body, heading, item; main text?
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 5, 0.0, 1, 0, 0, 1, 0),
    (3, 1.0, 2, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (6, 0.0, 1, 1.0, 7, 0.0, 1, 0, 0, 0, 0), (12, 0.1, 4, 1.0, 6, 0.0, 1, 0, 0, 0, 0),
    (7, 0.0, 6, 0.0, 24, 0.0, 0, 1, 1, 0, 1), (4, 0.0, 12, 0.0, 3, 0.0, 0, 1, 1, 0, 1), (1, 0.0, 8, 0.0, 1, 0.0, 0, 1, 1, 0, 1),
    (24, 0.0, 7, 0.0, 80, 0.0, 0, 1, 0, 0, 1), (80, 0.0, 24, 0.0, 3, 0.0, 0, 1, 0, 0, 1), (3, 0.0, 80, 0.0, 1, 0.0, 0, 1, 0, 0, 1),
    (1, 0.0, 3, 0.0, 140, 0.0, 0, 1, 0, 0, 1), (140, 0.02, 1, 0.0, 9, 0.0, 0, 1, 0, 0, 1), (9, 0.0, 140, 0.02, 8, 0.0, 0, 1, 0, 0, 1),
    (300, 0.0, 10, 0.0, 250, 0.0, 0, 1, 0, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 0, 1, 0, 0, 1), (18, 0.2, 60, 0.0, 45, 0.1, 0, 1, 0, 0, 1),
    (6, 0.5, 40, 0.0, 30, 0.0, 0, 1, 0, 0, 1), (11, 0.0, 9, 0.0, 12, 0.0, 0, 1, 0, 1, 1), (5, 0.0, 11, 0.0, 6, 0.0, 0, 1, 0, 1, 1),
    (4, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (8, 1.0, 50, 0.0, 9, 1.0, 0, 1, 0, 1, 0), (5, 1.0, 8, 1.0, 6, 1.0, 0, 1, 0, 1, 0),
    (9, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (8, 0.0, 120, 0.0, 4, 1.0, 1, 0, 0, 0, 0), (15, 0.0, 10, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (40, 0.0, 70, 0.0, 35, 0.0, 1, 1, 0, 0, 0), (35, 0.0, 40, 0.0, 50, 0.0, 1, 1, 0, 0, 0), (3, 0.0, 60, 0.0, 40, 0.0, 1, 1, 1, 0, 0),
    (60, 0.0, 30, 0.0, 22, 0.0, 1, 0, 0, 0, 0), (22, 0.3, 60, 0.0, 9, 0.0, 1, 0, 0, 0, 0), (5, 0.0, 25, 0.0, 30, 0.0, 1, 0, 1, 0, 0),
    (2, 0.0, 100, 0.0, 1, 0.0, 1, 0, 0, 0, 0), (90, 0.0, 4, 0.0, 70, 0.0, 0, 0, 0, 0, 0), (10, 0.0, 70, 0.0, 12, 0.0, 0, 0, 0, 0, 0),
    (4, 0.0, 6, 0.0, 5, 0.0, 0, 0, 1, 0, 0), (7, 1.0, 5, 0.0, 8, 1.0, 0, 0, 0, 1, 0), (25, 0.9, 30, 0.0, 10, 1.0, 0, 1, 0, 0, 0),
    (30, 0.95, 40, 0.1, 25, 0.9, 0, 1, 0, 0, 0), (6, 1.0, 120, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (14, 0.8, 90, 0.0, 7, 1.0, 0, 1, 0, 0, 0),
    (50, 0.3, 45, 0.1, 60, 0.0, 0, 1, 0, 0, 1), (200, 0.1, 3, 0.0, 150, 0.0, 0, 1, 0, 0, 1), (16, 0.0, 0, 0.0, 20, 0.0, 0, 1, 0, 0, 1),
    (2, 0.0, 3, 1.0, 4, 1.0, 0, 1, 0, 0, 0), (1, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 0, 0), (4, 0.0, 6, 1.0, 5, 1.0, 0, 1, 1, 0, 0), (3, 0.0, 9, 0.9, 4, 1.0, 0, 1, 0, 1, 0),
    (45, 0.1, 3, 1.0, 4, 1.0, 0, 1, 0, 0, 1), (30, 0.0, 8, 1.0, 7, 1.0, 0, 1, 0, 0, 1), (6, 0.0, 3, 1.0, 60, 0.0, 0, 1, 1, 0, 1), (5, 0.0, 70, 0.0, 3, 1.0, 0, 1, 0, 0, 1), (1, 0.0, 70, 0.0, 3, 1.0, 0, 1, 0, 0, 1), (2, 0.0, 40, 0.0, 8, 1.0, 0, 1, 0, 0, 1),
    (3, 0.0, 3, 1.0, 60, 0.0, 0, 1, 1, 0, 1), (1, 0.0, 2, 1.0, 1, 0.0, 0, 1, 0, 0, 1),
    # A link on a line of its own is main text between blocks of prose, not at an end and not beside other links.
    (8, 1.0, 40, 0.0, 35, 0.0, 0, 1, 0, 0, 1), (5, 1.0, 20, 0.0, 15, 0.0, 0, 1, 0, 1, 1), (12, 0.9, 60, 0.1, 50, 0.0, 0, 1, 0, 0, 1), (4, 1.0, 12, 0.0, 25, 0.0, 0, 1, 0, 1, 1), (3, 1.0, 90, 0.0, 80, 0.1, 0, 1, 0, 0, 1),
    (2, 1.0, 0, 0.0, 6, 0.0, 0, 1, 0, 0, 0), (3, 1.0, 4, 0.0, 40, 0.0, 0, 1, 0, 0, 0), (2, 1.0, 80, 0.0, 3, 0.0, 0, 1, 0, 0, 0), (9, 1.0, 60, 0.0, 40, 1.0, 0, 1, 0, 0, 0), (6, 1.0, 50, 1.0, 60, 0.0, 0, 1, 0, 1, 0),
    # Long blocks of few links are main text wherever they stand.
    (150, 0.0, 120, 0.0, 140, 0.0, 1, 1, 0, 0, 1), (200, 0.02, 6, 0.0, 180, 0.0, 1, 0, 0, 0, 1), (130, 0.05, 160, 0.0, 0, 0.0, 1, 1, 0, 0, 1), (300, 0.0, 10, 0.0, 4, 0.0, 1, 0, 0, 0, 1),
    (150, 0.0, 120, 0.0, 140, 0.0, 0, 0, 0, 0, 1), (200, 0.02, 6, 0.0, 180, 0.0, 0, 0, 0, 0, 1), (130, 0.05, 160, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (300, 0.0, 10, 0.0, 4, 0.0, 0, 0, 0, 0, 1),
    (160, 0.8, 40, 0.9, 30, 0.9, 1, 1, 0, 0, 0), (220, 0.7, 10, 1.0, 20, 1.0, 0, 0, 0, 0, 0), (140, 0.9, 5, 1.0, 5, 1.0, 1, 0, 0, 1, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (20, 0.0, 16, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (6, 0.0, 1, 1.0, 0, 0.0, 0, 1, 0, 0, 1),
)


@dataclass(frozen=True)
class Leaf:
    positive: bool


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Leaf | Split:
    """A decision tree by the smallest Gini impurity; ties go to the first feature and the smallest value."""
    if depth == 0 or len(set(y.tolist())) < 2 or len(y) < 2 * least:
        return Leaf(bool(y.mean() >= 0.5))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= at
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(side.sum() * y[side].mean() * (1 - y[side].mean()) for side in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(at)
    if best is None:
        return Leaf(bool(y.mean() >= 0.5))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.positive)
    low = x[:, tree.feature] <= tree.at
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(tree.low, x[low]), classify(tree.high, x[~low])
    return out


def trained(labelled: tuple = LABELLED) -> Leaf | Split:
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1])


def main_text(page: str, tree: Leaf | Split) -> str:
    """Main blocks of a page, one to a line."""
    found = blocks(page)
    if not found:
        return ""
    keep = classify(tree, features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A page is cut at block-level tags; each block gets its words and link density, those of its neighbours, and
    whether it stands in an article, a heading, a list or surroundings named by tag, class, id or role. A decision
    tree trained on the labelled table tells main text. Null and empty pages have empty texts; repeated rows get a
    row each; only page_id, url and html are read. Very long pages and blocks are read whole; tags without an end are text.
    """
    tree = trained(labelled)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(h or "", tree) for h in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        return each

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(source, make, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
