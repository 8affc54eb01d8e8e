"""Main text of web pages: gradient-boosted trees over the nodes of a page, decoded along the tree.

A page becomes a tree of blocks (``html_tree``).  Every node gets columns: its element and those around it, the names on it
and on its ancestors, depth, text and tags of its subtree and their density, links, punctuation, and the same of its
neighbours.  Boosted trees give each node the odds that its subtree holds main text.  Taken alone these answers can
contradict each other, so the page is decoded as a whole: a closed node closes all its descendants, an open element has at
least one open child, and among all labellings that obey this the likeliest is taken, by one pass up the tree and one down.
Runs of text that stay open are the blocks of the article.

The model is fitted on ``TRAINING_PAGES`` generated labelled pages (``html_pages``), a bounded number whatever the corpus.
Pages are extracted one by one and whole; nothing is shuffled.

Edge cases: null or empty html gives an empty text; markup without an end is read as far as it can be; a page without
anything likely gives an empty text; repeated pages are extracted again; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import column, prepare, read_table
from .html_pages import MAIN, OTHER, labelled_pages
from .html_tree import RUN, Page, parse

TRAINING_PAGES = 700
SEED = 12
#: Kinds of elements the trees can ask for, on a node, its parent or any ancestor.
KINDS = (
    ("run", RUN), ("paragraph", "p pre blockquote"), ("heading", "h1 h2 h3 h4 h5 h6 hgroup"), ("list", "ul ol menu dl"), ("item", "li dt dd"), ("article", "article main"),
    ("menu", "nav"), ("top", "header"), ("bottom", "footer address"), ("side", "aside"), ("form", "form fieldset search dialog"), ("control", "button label select option legend caption summary"),
    ("table", "table tbody thead tfoot tr td th"), ("figure", "figure figcaption"), ("plain", "div section center details"), ("page", "html body"),
)
_KIND = {tag: 1 << n for n, (_, tags) in enumerate(KINDS) for tag in tags.split()}
LEAST_NAMED = 8


def _links_between(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place among its siblings, their number, and the node before and after (-1: none)."""
    order = np.argsort(parent, kind="stable")
    family = parent[order]
    starts = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1])))
    sizes = np.diff(np.append(starts, len(parent)))
    place, size, before, after = (np.empty(len(parent), np.int64) for _ in range(4))
    rank = np.arange(len(parent)) - np.repeat(starts, sizes)
    place[order], size[order] = rank, np.repeat(sizes, sizes)
    before[order] = np.where(rank > 0, np.concatenate(([-1], order[:-1])), -1)
    after[order] = np.where(rank + 1 < np.repeat(sizes, sizes), np.append(order[1:], -1), -1)
    return place, size, before, after


def features(page: Page, names: dict[str, float]) -> np.ndarray:
    """One row of columns per node; ``names`` holds the log odds of a main part for the names on elements."""
    count = len(page.tag)
    parent, end, depth = (np.array(x, np.int64) for x in (page.parent, page.end, page.depth))
    mine = np.array([_KIND.get(t, 0) for t in page.tag], np.int64)
    named = np.array([min((names[t] for t in tokens if t in names), key=lambda x: -abs(x), default=0.0) if tokens else 0.0 for tokens in page.tokens])
    above, lowest, highest = np.zeros(count, np.int64), np.zeros(count), np.zeros(count)
    for i in range(1, count):  # parents come first
        p = page.parent[i]
        above[i] = above[p] | mine[p]
        lowest[i] = min(lowest[p], named[p])
        highest[i] = max(highest[p], named[p])

    texts = page.text
    chars = np.array([len(t) for t in texts], np.float64)
    own = {
        "chars": chars, "linked": np.array(page.linked, np.float64), "words": np.array([t.count(" ") + 1 if t else 0 for t in texts], np.float64),
        "stops": np.array([t.count(".") + t.count(",") + t.count("?") + t.count("!") for t in texts], np.float64), "runs": np.array([t == RUN for t in page.tag], np.float64),
        "elements": np.array([t != RUN for t in page.tag], np.float64), "paragraphs": (mine & _KIND["p"] != 0).astype(float), "items": (mine & _KIND["li"] != 0).astype(float),
        "controls": (mine & (_KIND["button"] | _KIND["form"]) != 0).astype(float), "headings": (mine & _KIND["h1"] != 0).astype(float),
    }
    start = np.arange(count)
    total, sums = {}, {}
    for name, values in own.items():
        sums[name] = np.concatenate(([0.0], np.cumsum(values)))
        total[name] = sums[name][end] - sums[name][start]
    whole = max(float(chars.sum()), 1.0)
    place, family, before, after = _links_between(parent)
    density, link_share = total["chars"] / total["elements"].clip(1), total["linked"] / total["chars"].clip(1)
    p = parent.clip(0)

    def beside(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, values[at], -1.0)

    siblings = np.bincount(p, total["chars"], count)[p] - total["chars"]
    bits = [(flags >> n & 1).astype(float) for flags in (mine, mine[p] * (parent >= 0), above) for n in range(len(KINDS))]
    columns = [
        *bits, named, lowest, highest, named[p], np.minimum(lowest, named), np.maximum(highest, named), depth, place, place / family, family,
        np.log1p(total["chars"]), np.log1p(total["words"]), total["chars"] / whole, np.log1p(density), link_share, total["stops"] / total["words"].clip(1), total["words"] / total["runs"].clip(1),
        np.log1p(total["runs"]), total["paragraphs"], total["items"], total["controls"], total["headings"], total["chars"] / total["words"].clip(1),
        sums["chars"][start] / whole, sums["headings"][start], np.log1p(siblings), beside(np.log1p(total["chars"]), before), beside(np.log1p(total["chars"]), after),
        beside(link_share, before), beside(link_share, after), beside(named, before), beside(named, after), link_share[p], np.log1p(density)[p],
    ]
    return np.stack(columns, axis=1)


def name_odds(pages: Iterable[tuple[Page, np.ndarray]]) -> dict[str, float]:
    """Smoothed log odds that an element with a name holds main text."""
    seen: dict[str, list[int]] = {}
    for page, labels in pages:
        for tokens, label in zip(page.tokens, labels):
            for token in set(tokens):
                seen.setdefault(token, [0, 0])[int(label)] += 1
    return {t: float(np.log((yes + 1) / (no + 1))) for t, (no, yes) in sorted(seen.items()) if yes + no >= LEAST_NAMED}


def labelled(marked: str) -> tuple[Page, np.ndarray]:
    """A marked page without its marks, and whether each subtree holds main text."""
    page = parse(marked)
    main = np.array([MAIN in t for t in page.text])
    page.text = [t.replace(MAIN, "").replace(OTHER, "").strip() for t in page.text]
    held = np.concatenate(([0], np.cumsum(main)))
    return page, held[page.end] > held[np.arange(len(main))]


class Extractor:
    """A fitted model: names and trees; small, and the same for every page."""

    def __init__(self, marked: Iterable[str]) -> None:
        pages = [labelled(html) for html in marked]
        self.names = name_odds(pages)
        rows = np.concatenate([features(page, self.names) for page, _ in pages])
        self.trees: Trees = fit(rows, np.concatenate([labels for _, labels in pages]).astype(float))

    def texts(self, htmls: list[str | None]) -> list[str]:
        """Main text per page; the trees descend all nodes of the batch at once."""
        pages = [parse(html or "") for html in htmls]
        odds = self.trees.log_odds(np.concatenate([features(page, self.names) for page in pages]))
        out, at = [], 0
        for page in pages:
            keep = decode(page, odds[at : at + len(page.tag)])
            at += len(page.tag)
            out.append("\n\n".join(text for text, kept in zip(page.text, keep) if kept and text))
        return out


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The likeliest labelling in which an open element has an open child and nothing below a closed one is open."""
    count = len(page.tag)
    shut_cost = np.logaddexp(0, odds)
    sums = np.concatenate(([0.0], np.cumsum(shut_cost)))
    shut = (sums[np.array(page.end)] - sums[:count]).tolist()
    best, parent = np.logaddexp(0, -odds).tolist(), page.parent
    # Of a node's children: the least price of opening one instead of closing it, and which one that is.
    price, cheapest = [0.0 if tag == RUN else np.inf for tag in page.tag], [-1] * count
    for i in range(count - 1, -1, -1):  # children come after their parents
        best[i] += max(price[i], 0.0)
        p = parent[i]
        if p >= 0:
            best[p] += min(best[i], shut[i])
            if best[i] - shut[i] < price[p]:
                price[p], cheapest[p] = best[i] - shut[i], i
    keep = [best[0] < shut[0]] * count
    for i in range(1, count):
        keep[i] = keep[parent[i]] and (best[i] < shut[i] or cheapest[parent[i]] == i)
    return keep


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> Extractor:
    return Extractor(labelled_pages(pages, seed))


def extract(pages: DataFrame, model: Extractor | None = None, html_column: str = "html", keys: dict[str, str] | None = None) -> DataFrame:
    """The key columns (name -> type) and ``text`` per row."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(model or train())
    keys = keys or {"page_id": "bigint", "url": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = shared.value.texts(batch.column("html").to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], [*keys, "text"])

    source = pages.select(*(column(pages, k, kind).alias(k) for k, kind in keys.items()), column(pages, html_column, "string").alias("html"))
    return source.mapInArrow(run, ", ".join(f"{k} {kind}" for k, kind in keys.items()) + ", text string")


def op12_html_extract(spark, sf_dir: str) -> DataFrame:
    found = extract(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op12_html_extract": op12_html_extract}
ORACLES: dict[str, str] = {}
