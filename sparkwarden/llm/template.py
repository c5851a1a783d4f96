"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens of a page are its block tags with their path, and its blocks of text with
their path. Over the pages of a host a token has an occurrence vector: how often it
stands in each page. Tokens with the same vector form an equivalence class; classes
that are large and frequent enough and nest properly in page order make the host's
template. What a page has besides its template are the template's slots, named by
the path around them. Slots of the article are extracted, block by block.

Which slots are the article's: those inside an article or main element, or else an
element named so; a host that marks none has the slot that holds most of its text
outside links. Elements that are never the article (menus, footers, adverts,
comments and so on) hold none. The template holds at every level: a notice that stands in
the articles of a host is dropped from them. Pages of the same content are one page
to the template, and where it would take more than half of an article, that is no template
but a copy, and the article stays whole.

A vector is never brought together: it is represented by the number of its pages,
the sum of its counts, and sums of hashes of its (page, count) pairs, all
of which aggregate partially. So a host with a third of all pages needs no large group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import IN_ARTICLE, NOWHERE, Block, read_page
from .tables import small_batches, stored

# A host with fewer pages has no template; its pages are read by their markup alone.
MIN_PAGES = 3
# A class's tokens stand in at least this share of the host's pages, and are at least so many.
MIN_SHARE = 0.6
MIN_TOKENS = 2

# A template that takes more of an article is a copy.
MOST = 0.5

_TAG, _TEXT, _BOX = 0, 1, 2

TOKEN_SCHEMA = "host string, kind int, token long, label string, page long, n long, chars long, place double"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


def text_token(block: Block) -> int:
    return _hash(f"{block.path}\n{block.text}")


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in TOKEN_SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    for batch in batches:
        rows = []
        for host, html in zip(*(c.to_pylist() for c in batch.columns)):
            tags, blocks = read_page(html or "")
            page = _hash("\n".join(b.text for b in blocks if not b.outside))
            found: dict[tuple[int, int], list] = {}
            for label, place in tags:
                entry = found.setdefault((_TAG, _hash(label)), [label, 0, 0, 0])
                entry[1] += 1
                entry[3] += place
            for b in blocks:
                entry = found.setdefault((_TEXT, text_token(b)), [None, 0, 0, 0])
                entry[1] += 1
                entry[3] += b.place
                if not b.outside:
                    box = found.setdefault((_BOX, _hash(b.path)), [b.path, 0, 0, 0])
                    box[1] += 1
                    box[2] += len(b.text) - min(b.link_chars, len(b.text))
            for (kind, token), (label, n, chars, place) in found.items():
                rows.append((host, kind, token, label, page, n, chars, place / n))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def page_tokens(pages: DataFrame) -> DataFrame:
    """Tokens of every page with host: how often each stands there, and where on average.

    `page` stands for the page's content without what is never an article's. Besides tags (kind 0) and texts (1), boxes (2): the paths around text, with its characters outside links.
    """
    small_batches(pages.sparkSession)
    named = pages.select(host_of(F.col("url")).alias("host"), F.col("html"))
    return named.where("host <> ''").mapInArrow(_page_tokens, TOKEN_SCHEMA)


def token_classes(tokens: DataFrame) -> DataFrame:
    """Tokens in classes: (host, pages_of_host, class, kind, token, label, pages, occurrences, place, chars).

    `class` stands for the occurrence vector. Kept are tokens of enough of their host's
    pages (at most as many as the tokens of 1 / MIN_SHARE pages) and all boxes' totals.
    """
    # Pages of the same content count once. The two halves of a hash add up without overflow.
    once = tokens.groupBy("host", "kind", "token", "page").agg(*[F.max(c).alias(c) for c in ("label", "n", "place", "chars")])
    pair = F.xxhash64("page", "n")
    vectors = once.groupBy("host", "kind", "token").agg(
        F.max("label").alias("label"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("n").alias("occurrences"),
        F.sum(F.shiftright(pair, 32)).alias("high"),
        F.sum(pair.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"),
        F.avg("place").alias("place"),
        F.sum("chars").alias("chars"),
    )
    # A page counts once for its host: the pages of the most frequent token.
    # What stands in one page only is in no template, and is most of all tokens: it goes before rows meet by host.
    vectors = vectors.where((F.col("kind") == _BOX) | (F.col("pages") >= math.ceil(MIN_PAGES * MIN_SHARE)))
    hosts = vectors.groupBy("host").agg(F.max("pages").alias("pages_of_host"))
    frequent = vectors.join(hosts, "host").where(
        (F.col("pages_of_host") >= MIN_PAGES) & ((F.col("kind") == _BOX) | (F.col("pages") >= F.col("pages_of_host") * MIN_SHARE))
    )
    return frequent.withColumn("class", F.xxhash64("pages", "occurrences", "high", "low")).drop("high", "low")


TEMPLATE_SCHEMA = "host string, pages_of_host long, texts array<long>, tags array<long>, classes int, depth int, main_path string"


def _template(rows: pd.DataFrame) -> pd.DataFrame:
    """One host's template from its classes: valid classes nested by place; and the box with most text."""
    tokens = rows[rows["kind"] != _BOX]
    spans = []
    for _, group in tokens.groupby("class", sort=True):
        if len(group) >= MIN_TOKENS:
            places = sorted(group["place"])
            spans.append((places[0], places[-1], places, group))
    # Outer classes first. A class is valid if it lies within one gap of every class around it.
    spans.sort(key=lambda s: (s[0] - s[1], s[0]))
    valid: list[tuple] = []
    depth = 0
    for low, high, places, group in spans:
        around, crossing = 0, False
        for v_low, v_high, v_places, _ in valid:
            if high < v_low or low > v_high:
                continue
            inner = [p for p in v_places if low <= p <= high]
            if inner:
                crossing = crossing or not set(inner) <= set(places)
            else:
                around += 1
        if not crossing:
            valid.append((low, high, places, group))
            depth = max(depth, around + 1)
    kept = [group for *_, group in valid]
    merged = pd.concat(kept).sort_values(["place", "token"]) if kept else tokens.iloc[:0]
    boxes = rows[(rows["kind"] == _BOX) & (rows["chars"] > 0)].sort_values(["chars", "label"], ascending=[False, True])
    return pd.DataFrame(
        {
            "host": [rows["host"].iloc[0]],
            "pages_of_host": [int(rows["pages_of_host"].iloc[0])],
            "texts": [merged.loc[merged["kind"] == _TEXT, "token"].tolist()],
            "tags": [merged.loc[merged["kind"] == _TAG, "token"].tolist()],
            "classes": [len(kept)],
            "depth": [depth],
            "main_path": [boxes["label"].iloc[0] if len(boxes) else None],
        }
    )


def host_templates(pages: DataFrame) -> DataFrame:
    """One row per host with enough pages of different content (repeated rows and pages without host add nothing): the template's text and tag tokens in page order, its number of classes and
    levels of nesting, and the path of the slot that holds most text outside links.

    What meets per host are its frequent tokens and its largest box, whose number
    follows the length of its pages and not how many there are.
    """
    classes = stored(token_classes(page_tokens(pages)), "classes")
    columns = [c for c in classes.columns if c != "host"]
    largest = F.max_by(F.struct(*columns), F.struct("chars", "token"))
    main = classes.where(F.col("kind") == _BOX).groupBy("host").agg(largest.alias("_box")).select("host", "_box.*")
    ranked = classes.where(F.col("kind") != _BOX).unionByName(main)
    return ranked.groupBy("host").applyInPandas(_template, TEMPLATE_SCHEMA)


def article(blocks: list[Block], texts: frozenset[int], main_path: str | None) -> list[Block]:
    """The blocks of the article's slots in page order.

    The page's own marks tell where the article is, else the slot of the host's template
    with most text. What the template has is no slot's, unless it has most of the article.
    """
    inside = [b for b in blocks if not b.outside]
    level = max((b.level for b in inside), default=NOWHERE)
    rest = [b for b in inside if text_token(b) not in texts] if texts else inside
    if level > NOWHERE:
        chosen, kept = ([b for b in some if b.level == level] for some in (inside, rest))
    else:

        def below(some: list[Block]) -> list[Block]:
            slot = [b for b in some if main_path and (b.path == main_path or b.path.startswith(main_path + "/"))]
            return slot or some

        chosen, kept = below(inside), below(rest)
    left, whole = (sum(len(b.text) for b in some) for some in (kept, chosen))
    return kept if left >= (1 - MOST) * whole else chosen


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for html, texts, main_path in zip(*(c.to_pylist() for c in batch.columns[2:])):
            _, blocks = read_page(html or "")
            found.append("\n".join(b.text for b in article(blocks, frozenset(texts or ()), main_path)))
        counts = pa.array([len(t) for t in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), counts], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Blocks of the article in page order, one line each. A null or empty html, and a page
    without article text, give an empty text. A page without host, or of a host with
    fewer than MIN_PAGES pages of different content, is read by its markup alone. Pages of
    any length are read whole; repeated rows are all returned and change no template.
    """
    templates = stored(host_templates(pages).select("host", "texts", "main_path"), "templates")
    small_batches(pages.sparkSession)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    # Split by the skew join where a host has many pages.
    joined = named.join(templates, "host", "left").select("page_id", "url", "html", "texts", "main_path")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
