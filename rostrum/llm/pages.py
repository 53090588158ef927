"""Operator 1, HTML extraction with a host suffix array.

The pages of a host are parsed into blocks of words, and the token streams of its pages are
concatenated. A suffix array, sorted by prefix doubling as far as the least length of a repeat,
brings equal runs together: every run of ``RUN`` words or more that occurs on two distinct
pages is found. Blocks covered by such runs are boilerplate and go; unique runs stay.

Markup says where a run may be boilerplate:

* Blocks inside menus, headers, footers, sidebars, notices, adverts, forms and comments never
  belong to the article. They take part in the suffix array as evidence.
* Blocks of an article or main element go only if they have ``NOTICE`` words or more, all in
  runs that occur in the articles of two pages and beside the article on some page: a notice.
  That articles repeat each other (copies, licences, stock lines), or that a menu quotes one of
  them, is no reason to cut them.
* Where a page has no article element, every covered block goes. If one covered stretch is
  most of such a page, the page is a copy of another, and that stretch stays.

Hosts are dealt into shards of about ``SHARD`` bytes of html by a hash of the page, so that a
host with a third of all pages is spread. Evidence counts over the whole host: the runs of the
pages of a host of several shards are handed on as sorted arrays of eight bytes a run, by the
first bits of their hash; each shard is given those of its runs that two pages have, and which of
them are notices. Every page is returned; nothing is cut short.

Defined results: null html is an empty page with empty text; a null url makes a host of its
own; repeated rows of one page id are one page for the evidence, and each is returned; blocks
without words are left out; unclosed and crossed tags are closed as browsers do, markup that
never closes is text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow, folder

RUN = 8
NOTICE = 25
SHARD = 1_000_000
MOST = 0.5
# Shards whose runs of one bucket are looked at together.
BUCKET = 64

MAIN, OTHER, OUTSIDE = 0, 1, 2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMES = re.compile(r"[a-z0-9]+")

_UNREAD = frozenset("script style noscript template svg math iframe object canvas audio video select textarea".split())
_OUTSIDE = frozenset("nav header footer aside form dialog menu button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head title body article section main div p ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary fieldset legend hr h1 h2 h3 h4 h5 h6 hgroup center "
    "nav header footer aside form dialog menu option".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of a class or id that name something beside the article.
_BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments disqus reply replies respond nav navbar navigation menu breadcrumb breadcrumbs sidebar widget "
    "widgets related recommended footer masthead toolbar pagination pager search paywall alert banner".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_ARTICLE_PARTS = ("article-body", "article-content", "entry-content", "post-content", "post-body", "articlebody")
# A start tag of the first kind closes open elements of the second, up to the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(text)}


def _beside(name: str, attributes: dict[str, str]) -> bool:
    if "hidden" in attributes.get("style", "").replace(" ", "").partition("visibility:")[2][:6]:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    if attributes.get("role") in _ROLES or attributes.get("aria-hidden") == "true":
        return True
    parts = set(_NAMES.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}"))
    return bool(parts & _BESIDE)


def _header(page: str, at: int) -> tuple[int, bool]:
    """Where the first end of a header or start of an h1 after ``at`` is, and whether it is an h1."""
    while (m := _TAG.search(page, at)) is not None:
        name = (m[2] or "").lower()
        if name == ("header" if m[1] else "h1"):
            return m.start(), not m[1]
        at = m.end()
        if not m[1] and name in _UNREAD and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
    return len(page), False


def blocks(page: str) -> list[tuple[int, str]]:
    """``(zone, text)`` of the blocks of a page, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, beside the article, article
    # How many elements of a name are open: an end tag of none needs no search.
    opened: Counter[str] = Counter()
    outside = articles = 0
    parts: list[str] = []
    aside: list[str] = []
    heading = 0
    header = (-1, False)

    def flush() -> None:
        for zone, some in ((MAIN if articles else OTHER, parts), (OUTSIDE, aside)):
            if some:
                text = " ".join(entities.unescape("".join(some)).split())
                if text:
                    out.append((zone, text))
                some.clear()

    def pop(to: int) -> None:
        nonlocal outside, articles
        while len(stack) > to:
            name, beside, article = stack.pop()
            opened[name] -= 1
            outside -= beside
            articles -= article

    def say(text: str) -> None:
        if text:
            (aside if outside else parts).append(text)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                say(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if name in _BLOCK:
            flush()
        elif name == "br":
            say(" ")
        if m[1]:
            if name in _HEADING:
                heading = max(0, heading - 1)
            if opened[name]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in _VOID:
            continue
        if name in _UNREAD or name == "title":
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _CLOSES:
            closed, limit = _CLOSES[name]
            for k in range(len(stack) - 1, -1, -1) if any(opened[c] for c in closed) else ():
                if stack[k][0] in limit:
                    break
                if stack[k][0] in closed:
                    pop(k)
                    break
        elif name in _BLOCK and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        attributes = _attributes(m[3]) if m[3] else {}
        article = name in ("article", "main") or attributes.get("role") in ("main", "article")
        article = article or any(x in attributes.get("class", "") or x in attributes.get("id", "") for x in _ARTICLE_PARTS)
        beside = name in _OUTSIDE
        if name == "header" and articles:
            if header[0] < at:  # else the one looked up for an earlier header is next
                header = _header(page, at)
            beside = not header[1]
        if attributes and name not in ("html", "body", "main") and _beside(name, attributes):
            beside = True
        if name == "head":
            beside = True
        article = article and not beside and not outside
        if name in _BLOCK or beside or article:
            stack.append((name, beside, article))
            opened[name] += 1
            outside += beside
            articles += article
    flush()
    return out


# --- the suffix array ------------------------------------------------------------------


def ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each place by its first ``length`` tokens, by prefix doubling.

    Equal ranks are equal runs; a run that would pass the end has a rank of its own.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < length:
        step = min(have, length - have)
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1]
        have += step
    return rank


def _spread(group: np.ndarray, order: np.ndarray, cuts: np.ndarray, page: np.ndarray, at: np.ndarray):
    """Least and greatest page among the places ``at`` of each group, spread over its places."""
    far = np.iinfo(np.int64).max
    low = np.minimum.reduceat(np.where(at, page, far)[order], cuts)[group]
    high = np.maximum.reduceat(np.where(at, page, -1)[order], cuts)[group]
    return low, high


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Tokens in runs of ``length`` that begin at ``starts``."""
    edge = np.zeros(len(starts) + length + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + length] -= 1
    return np.cumsum(edge)[: len(starts)] > 0


_RUN = arrow.mix(np.arange(1, RUN + 1, dtype=np.uint64)) | np.uint64(1)


def run_keys(tokens: np.ndarray, real: np.ndarray, site: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where runs of ``RUN`` words start that lie in one page, and hashes of host and run."""
    m = len(tokens) - RUN + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for k in range(RUN):
        total += tokens[k : k + m] * _RUN[k]
    marks = np.concatenate([[0], np.cumsum(~real)])
    at = np.flatnonzero(marks[RUN:] == marks[:-RUN])
    salt = arrow.mix(np.array([site], np.int64).view(np.uint64))
    return at, arrow.mix(total[at] ^ salt).view(np.int64)


def repeats(
    tokens: np.ndarray, page: np.ndarray, zone: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens lie in runs of two pages, and in those that are boilerplate even in an article.

    ``tokens`` holds all pages; a separator of its own follows each, so no run crosses pages.
    The latter are in the articles of two pages and beside the article on some page. ``known``
    says of each place whether a run of either kind starts there by evidence of other shards.
    """
    if not len(tokens):
        return np.zeros(0, bool), np.zeros(0, bool)
    group = ranks(tokens, RUN)
    order = np.argsort(group, kind="stable")  # the suffix array, by runs of ``RUN``
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    low, high = _spread(group, order, cuts, page, zone >= 0)
    inner_low, inner_high = _spread(group, order, cuts, page, zone == MAIN)
    _, outer = _spread(group, order, cuts, page, zone == OUTSIDE)
    notice = (inner_low < inner_high) & (outer >= 0)
    shared = low < high
    if known is not None:
        shared, notice = shared | known[0], notice | known[1]
    return _covered(shared, RUN), _covered(notice, RUN)


def _line(pages: list[list[tuple[int, str]]], numbers: np.ndarray):
    """Texts and zones of blocks; words of all pages, with a separator after each, their block, page and zone."""
    zones = np.array([z for p in pages for z, _ in p], np.int64)
    owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    texts = [t for p in pages for _, t in p]
    hashes, block = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in arrow.words(pa.array(texts, pa.large_string()), fold=False):
        hashes.append(w.hashes)
        block.append(w.rows + w.first)
    hashes, block = np.concatenate(hashes), np.concatenate(block)
    # A separator after each page: a number no word has in practice, another for each page.
    change = np.flatnonzero(np.diff(owner[block])) + 1
    marks = arrow.mix(np.arange(len(change), dtype=np.uint64) + np.uint64(0xA11CE))
    tokens = np.insert(hashes, change, marks)
    block = np.insert(block, change, -1)
    real = block >= 0
    page = -1 - np.arange(len(block))
    page[real] = numbers[owner[block[real]]]
    zone = np.full(len(block), -1)
    zone[real] = zones[block[real]]
    return texts, zones, tokens, block, page, zone


def articles(
    pages: list[list[tuple[int, str]]], numbers: np.ndarray, site: int = 0,
    evidence: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[str]:
    """Main text of each page of a shard; ``numbers`` tells distinct pages apart.

    ``evidence`` holds sorted keys of runs of the host on two pages and which of them are notices.
    """
    texts, zones, tokens, block, page, zone = _line(pages, numbers)
    if not texts:
        return [""] * len(pages)
    real = block >= 0
    known = None
    if evidence is not None and len(evidence[0]):
        at, key = run_keys(tokens, real, site)
        spot = np.minimum(np.searchsorted(evidence[0], key), len(evidence[0]) - 1)
        same = evidence[0][spot] == key
        known = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
        known[0][at], known[1][at] = same, same & evidence[1][spot]
    shared, told = repeats(tokens, page, zone, known)
    block, shared, told = block[real], shared[real], told[real]
    size = np.maximum(np.bincount(block, minlength=len(texts)), 1)
    shared = np.bincount(block, shared, len(texts)) >= size
    told = (np.bincount(block, told, len(texts)) >= size) & (size >= NOTICE)
    out, a = [], 0
    for blocks_of_page in pages:
        b = a + len(blocks_of_page)
        zone = zones[a:b]
        if (zone == MAIN).any():
            keep = (zone == MAIN) & ~told[a:b]
        else:
            keep = (zone == OTHER) & ~shared[a:b]
            keep |= _copied(zone == OTHER, shared[a:b], size[a:b])
        out.append("\n\n".join(t for t, k in zip(texts[a:b], keep, strict=True) if k))
        a = b
    return out


def _copied(inside: np.ndarray, shared: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The longest stretch of covered blocks, if it holds most words of the page."""
    keep = np.zeros(len(inside), bool)
    spots = np.flatnonzero(inside)
    runs = np.split(spots, np.flatnonzero(np.diff(shared[spots].astype(int))) + 1) if len(spots) else []
    runs = [r for r in runs if len(r) and shared[r[0]]]
    if runs:
        best = max(runs, key=lambda r: size[r].sum())
        if size[best].sum() > MOST * size[spots].sum():
            keep[best] = True
    return keep


# Flags of a run, in the high bits of its packed key.
TWO, INNER, INNER_TWO, OUTER = (np.uint64(1 << k) for k in (60, 61, 62, 63))
_LOW = np.uint64((1 << 60) - 1)
_BLOCKS = "site bigint, part bigint, bits int, number bigint, page_id {}, url string, zones binary, texts array<string>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of pages in place of their html."""
    for batch in batches:
        kept = batch.drop_columns(["html"])
        for k in range(0, len(batch), 64):
            pages = [blocks(h or "") for h in batch.column("html").slice(k, 64).to_pylist()]
            zones = pa.array([bytes(z for z, _ in p) for p in pages], pa.binary())
            texts = pa.array([[t for _, t in p] for p in pages], pa.list_(pa.string()))
            some = kept.slice(k, 64)
            yield pa.RecordBatch.from_arrays([*some.columns, zones, texts], [*some.schema.names, "zones", "texts"])


def _pages(batch, rows) -> list[list[tuple[int, str]]]:
    zones, texts = batch["zones"], batch["texts"]
    return [list(zip(zones[r].as_py(), texts[r].as_py(), strict=True)) for r in rows]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of pages as packed keys, by shard and by the first bits of the key.

    A key holds 60 bits of the hash and the flags; the first ``bits`` (4 or more) are the bucket.
    """
    for batch in batches:
        site, part, bits, number = (batch.column(c).to_numpy() for c in ("site", "part", "bits", "number"))
        for p in np.unique(part).tolist():
            rows = np.flatnonzero(part == p)
            _, _, tokens, block, page, zone = _line(_pages(batch, rows), number[rows])
            at, key = run_keys(tokens, block >= 0, int(site[rows[0]]))
            if not len(at):
                continue
            key = key.view(np.uint64)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            page, zone, key = page[at], zone[at], key[cuts]
            inner = zone == MAIN
            far = np.iinfo(np.int64).max
            low = np.minimum.reduceat(np.where(inner, page, far), cuts)
            high = np.maximum.reduceat(np.where(inner, page, -1), cuts)
            packed = key & _LOW
            packed[np.minimum.reduceat(page, cuts) < np.maximum.reduceat(page, cuts)] |= TWO
            packed[high >= 0] |= INNER
            packed[low < high] |= INNER_TWO
            packed[np.logical_or.reduceat(zone == OUTSIDE, cuts)] |= OUTER
            width = int(bits[rows[0]])
            bucket = (key >> np.uint64(64 - width)).astype(np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(edges) - 1, site[rows[0]])), pa.array(bucket[edges[:-1]]),
                pa.array(np.full(len(edges) - 1, p, np.int64)), pa.array(np.full(len(edges) - 1, width, np.int32)),
                pa.array([packed[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
            ], ["site", "bucket", "part", "bits", "keys"])


_KEYS = "site bigint, bucket bigint, part bigint, bits int, keys binary"


def _shared_runs(rows: pa.Table) -> pa.Table:
    """Of the runs of a host in one bucket, those of two pages, packed by shard with their verdict.

    Different rows are of different pages, as a page's rows were brought together before.
    """
    keys = [np.frombuffer(k, np.uint64) for k in rows["keys"].to_pylist()]
    part = np.repeat(rows["part"].to_numpy(), [len(k) for k in keys])
    packed = np.concatenate(keys)
    order = np.argsort(packed & _LOW, kind="stable")
    packed, part = packed[order], part[order]
    low = packed & _LOW
    cuts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.concatenate([cuts, [len(low)]]))
    flags = np.bitwise_or.reduceat(packed, cuts)
    inner = np.add.reduceat(((packed & INNER) > 0).astype(np.int64), cuts)
    two = (size > 1) | ((flags & TWO) > 0)
    told = ((inner > 1) | ((flags & INNER_TWO) > 0)) & ((flags & OUTER) > 0)
    two, told = np.repeat(two, size), np.repeat(told, size)
    part, low, told = part[two], low[two], told[two]
    width = int(rows["bits"][0].as_py())
    # The bits of the bucket that the packed key does not hold (the first four).
    top = np.uint64(int(rows["bucket"][0].as_py()) >> (width - 4) << 60)
    order = np.argsort(part, kind="stable")
    part, low, told = part[order], low[order] | top, told[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table({
        "part": pa.array(part[edges[:-1]] if spans else [], pa.int64()),
        "keys": pa.array([np.unique(low[x:y]).tobytes() for x, y in spans], pa.binary()),
        "told": pa.array([np.unique(low[x:y][told[x:y]]).tobytes() for x, y in spans], pa.binary()),
    })


def _evidence(rows: DataFrame) -> DataFrame:
    """``(part, keys, told)``: runs of each shard that two pages of its host have, and the notices of them."""
    rows = rows.filter("bits is not null").drop("page_id", "url")
    twice = folder.written(rows.groupBy("number").count().filter("count > 1").select("number"), "twice")
    # Rows of one page are put together as one; hardly any page has two.
    once = rows.join(twice, "number", "left_anti")
    names = ["zones", "texts"]
    # Copies go first, before the shuffle.
    again = rows.join(twice, "number", "left_semi").distinct().groupBy("site", "part", "bits", "number").agg(
        F.sort_array(F.collect_list(F.struct(*names))).alias("rows")
    )
    zones = F.aggregate("rows", F.lit(b""), lambda z, r: F.concat(z, r["zones"]))
    texts = F.flatten(F.transform("rows", lambda r: r["texts"]))
    again = again.select("site", "part", "bits", "number", zones.alias("zones"), texts.alias("texts"))
    seen = once.select(again.columns).unionByName(again).mapInArrow(_seen, _KEYS)
    runs = seen.groupBy("site", "bucket").applyInArrow(_shared_runs, "part bigint, keys binary, told binary")
    return runs


def _extract(pages: pa.Table, runs: pa.Table) -> pa.Table:
    evidence = None
    if len(runs):
        keys, told = (np.frombuffer(b"".join(runs[c].to_pylist()), np.int64) for c in ("keys", "told"))
        keys = np.sort(keys)
        evidence = keys, np.isin(keys, told)
    site = pages["site"][0].as_py() if len(pages) else 0
    texts = articles(_pages(pages, range(len(pages))), pages["number"].to_numpy(), site, evidence)
    return pa.table({
        "page_id": pages["page_id"], "url": pages["url"], "text": pa.array(texts, pa.string()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
    })


def extract(pages: DataFrame, id="page_id", url="url", html="html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    rows = pages.select(
        F.col(id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    ).withColumn("host", host)
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    # Written first, so that its size is known: a small one is broadcast and the pages are then
    # shuffled once, by host and shard.
    shards = sizes.select("host", F.greatest(F.ceil(F.col("bytes") / SHARD), F.lit(1)).alias("shards"))
    shards = folder.written(shards, "shards")
    number = F.xxhash64("page_id", "url")
    rows = rows.join(shards, "host").withColumn("number", F.shiftrightunsigned(number, 1))
    rows = rows.withColumn("shard", F.pmod("number", "shards"))
    kind = rows.schema["page_id"].dataType.simpleString()
    bits = F.greatest(F.lit(4), F.ceil(F.log2(F.col("shards") / BUCKET)).cast("int"))
    rows = rows.select(
        F.xxhash64("host").alias("site"), F.xxhash64("host", "shard").alias("part"),
        F.when(F.col("shards") > 1, bits).alias("bits"), "number", "page_id", "url", "html",
    )
    # Parsed once: both the evidence and the shards read the blocks, which are smaller than the html.
    rows = folder.written(rows.mapInArrow(_parsed, _BLOCKS.format(kind)), "blocks")
    runs = _evidence(rows)
    out = rows.drop("bits").groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars bigint"
    )
    return out.withColumnsRenamed({"page_id": id, "url": url})


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
