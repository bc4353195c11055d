"""Main text of web pages: structure, and differences between neighbours.

Pages are paired by URL path within each host: each page with the nearest one of
other text that precedes it in the order of (path, page_id), the first with the
nearest that follows.  The text lines of both, those of menus and footers included,
are aligned by their longest common subsequence.  This is done for every page.

A line goes if the structure shows it to be boilerplate, or if it is shared with the
neighbour, is the site's (on at least ``SITE_PAGES`` of the host's distinct pages, and
on half of them) and isn't of the marked article (<article>, <main>, role=main).  The
first condition keeps what two pages happen to share, the last what an article quotes:
neither copies of a page nor near copies of it delete its text, and lines outside a
marked article stay unless they are the site's."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import plain, staged
from .urlfilter import split_url

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_DROP = _RAW | {"head", "nav", "footer", "aside", "form", "svg", "canvas", "object", "select", "button", "menu", "dialog", "map", "audio", "video", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "dialog", "form"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side-bar|aside|footer|masthead|site-?header|page-?header|topbar|toolbar|ads?|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner"
    r"|cookies?|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommended|pagination|pager|widget|skip-?link)(?:$|[\s_-])",
    re.I,
)
SITE_PAGES = 3  # distinct pages of a host that a line is on at least, and half of all, to be boilerplate
_CLOSES_P = _BLOCK - {"br", "body", "html", "head"}
_NO_ARTICLE = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "advertisement", "promo", "sponsored", "related", "recommended", "teaser"}
_LOOSE = {"form", "fieldset"}  # some sites wrap the whole page in one

#: Kinds of line: boilerplate by structure, of the marked article, any other.
GONE, OWN, OPEN = 0, 1, 2


def _names(attrs: str) -> Iterator[tuple[str, str]]:
    for name, a, b, c in _ATTR.findall(attrs):
        yield name.lower(), a or b or c


def _main(tag: str, attrs: str) -> bool:
    if tag in ("article", "main"):
        return not attrs or not any(n in ("class", "id") and _NO_ARTICLE & set(v.lower().split()) for n, v in _names(attrs))
    return "role" in attrs and re.search(r"\brole\s*=\s*[\"']?(?:main|article)\b", attrs) is not None


def _boilerplate(tag: str, attrs: str, inside: bool) -> int:
    """0: no; 1: yes, but for a marked article in it; 2: yes.  A name that is only
    part of a class's (has-sidebar) may well be a wrapper's."""
    if tag in _LOOSE:
        return 1
    if tag in _DROP or (tag == "header" and not inside):
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    found = 2 if tag in ("article", "main") and not _main(tag, attrs) else 0
    for name, value in _names(attrs):
        if tag not in ("article", "main") and name in ("class", "id") and _NAMES.search(value):
            found = max(found, 2 if any((m := _NAMES.search(w)) and m[0] == w for w in value.split()) else 1)
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            found = 2
    return 2 if "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) is not None else found


def blocks(html: str | None) -> tuple[list[str], list[int]]:
    """(lines, their kinds): a page's text blocks in order.

    Character references are decoded, white space is one space, empty blocks are
    left out.  Unclosed elements end with the page, or with the element that they
    are in; text cut off within a tag is no text, nor are scripts and styles."""
    lines: list[str] = []
    kinds: list[int] = []
    kept: list[str] = []
    dropped: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, adds to hard, loose, main
    hard = loose = main = 0
    text = html or ""

    def flush() -> None:
        for buf, kind in ((kept, OWN if main else OPEN), (dropped, GONE)):
            if buf:
                line = _SPACE.sub(" ", unescape("".join(buf))).strip()
                buf.clear()
                if line:
                    lines.append(line)
                    kinds.append(kind)

    def pop(down_to: int) -> None:
        nonlocal hard, loose, main
        for _, h, s, m in stack[down_to:]:
            hard -= h
            loose -= s
            main -= m
        del stack[down_to:]

    at, end = 0, len(text)
    while at < end:
        m = _TOKEN.search(text, at)
        buf = dropped if hard or loose else kept
        if m is None:
            rest = text[at:]
            cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)
            buf.append(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            buf.append(text[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1]:
                buf.append(m[1])
            continue
        closing, attrs = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag in _BLOCK:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in _BLOCK or stack[k][3] or (stack[k][1] + stack[k][2] > 0 and stack[k][0] in _BLOCK and tag in ("p", "li", "b", "i", "span", "div")):
                    break  # a stray end tag closes nothing outside the element it is in
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            at = stop.end() if stop else end
            continue
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        if stack and (stack[-1][0] == "p" and tag in _CLOSES_P or stack[-1][0] == tag == "li"):
            pop(len(stack) - 1)
        is_main = not hard and _main(tag, attrs)
        level = 0 if is_main else _boilerplate(tag, attrs, main > 0)
        # An article sets aside what is loosely boilerplate around it.
        adds = (int(level == 2), -loose if is_main else int(level == 1), int(is_main))
        hard, loose, main = hard + adds[0], loose + adds[1], main + adds[2]
        stack.append((tag, *adds))
    flush()
    return lines, kinds


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - 2**63


def shared(a: list[int], b: list[int]) -> list[bool]:
    """Which of ``a`` a longest common subsequence with ``b`` takes: the first
    found from the end, which prefers late lines of ``a``.  Hunt-Szymanski: the
    cost follows the matches, not the product of the lengths."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect.bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out = [False] * len(a)
    node = nodes[-1] if nodes else None
    while node is not None:
        out[node[0]] = True
        node = node[1]
    return out


def _outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page the hashes of its lines, their kinds, and a digest of its text."""
    for pdf in batches:
        hashes, marks, digests = [], [], []
        for h in pdf["html"]:
            lines, kinds = blocks(h)
            own = np.array([line_hash(x) for x in lines], np.int64)
            marks.append(bytes(kinds))
            hashes.append(own)
            digests.append(xxhash.xxh3_64_intdigest(own[np.array(kinds, np.int8) != GONE].tobytes()) - 2**63)
        out = pdf[["k1", "k2", "page_id", "host", "path"]].copy()
        out["hashes"], out["kinds"], out["digest"] = hashes, marks, pd.Series(digests, dtype="int64", index=out.index)
        yield plain(out)


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each page how many lines its neighbour has too, and which of its text's go."""
    for pdf in batches:
        many, gone = [], []
        for own, kinds, other, common in zip(pdf["hashes"], pdf["kinds"], pdf["other"], pdf["common"], strict=True):
            own = own.tolist()
            both = shared(own, other.tolist()) if other is not None else [False] * len(own)
            site = set(common.tolist()) if common is not None else ()
            many.append(sum(both))
            text = [i for i, k in enumerate(kinds) if k != GONE]
            gone.append([n for n, i in enumerate(text) if both[i] and kinds[i] == OPEN and own[i] in site])
        yield pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "n_shared": pd.Series(many, dtype="int64", index=pdf.index), "gone": pd.Series(gone, index=pdf.index, dtype=object)})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text that structure leaves, compressed: it is about to be shuffled."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for pdf in batches:
        out = pdf[["k1", "k2", "page_id", "url"]].copy()
        out["packed"] = [pack("\n".join(x for x, k in zip(*blocks(h), strict=True) if k != GONE).encode("utf-8", "surrogatepass")) for h in pdf["html"]]
        yield plain(out)


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor().decompress
    for pdf in batches:
        texts, cut = [], []
        for packed, gone in zip(pdf["packed"], pdf["gone"], strict=True):
            text = unpack(packed).decode("utf-8", "surrogatepass")
            without = set(gone.tolist()) if gone is not None else ()
            if without:
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in without)
            texts.append(text)
            cut.append(len(without))
        out = pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_shared": pdf["n_shared"].fillna(0).astype("int64")})
        out["n_removed"] = pd.Series(cut, dtype="int64", index=out.index)
        yield plain(out)


def site_lines(pages: DataFrame) -> DataFrame:
    """pages(host, digest, hashes) -> (host, common): the lines that are boilerplate
    by their frequency.  Pages of the same text count once; a host has at most twice
    as many such lines as a page has on average."""
    pages = pages.groupBy("host", "digest").agg(F.first("hashes").alias("hashes"))
    size = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = lines.where(F.col("n") >= SITE_PAGES).join(size, "host").where("2 * n >= pages")
    return often.groupBy("host").agg(F.collect_list("line").alias("common"))


def neighbours(pages: DataFrame) -> DataFrame:
    """pages(k1, k2, page_id, host, path, digest, hashes, ...) with other (the lines of
    the nearest page of another digest before it on its host, or else after it) and
    common (the host's boilerplate).  Hosts are cut into ranges, so that no host is
    one task's; the ends of ranges are joined across, over any number of ranges that
    hold copies of one page only."""
    order = ["path", "page_id", "k1", "k2"]
    ranged = staged(pages.repartitionByRange("host", *order).withColumn("cell", F.spark_partition_id()), "html-ranges")
    w = Window.partitionBy("host", "cell").orderBy(*order)
    back = Window.partitionBy("host", "cell").orderBy(*[F.desc(c) for c in order])
    other = lambda step: F.when(step("digest").over(w) != F.col("digest"), step("hashes").over(w))
    near = ranged.withColumn("b", other(F.lag)).withColumn("a", other(F.lead))
    # What lies before or after a run of copies holds for all of the run.
    latest = lambda c, over, end: F.last(c, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, end))
    near = near.withColumn("before", latest("b", w, 0)).withColumn("after", latest("a", back, 0)).drop("a", "b")
    key, page = F.struct(*order), F.struct("hashes", "digest", "before", "after")
    ends = near.groupBy("host", "cell").agg(F.max_by(page, key).alias("last"), F.min_by(page, key).alias("first"))
    h, hback = Window.partitionBy("host").orderBy("cell"), Window.partitionBy("host").orderBy(F.desc("cell"))
    ends = ends.withColumn("l", F.lag("last").over(h)).withColumn("r", F.lead("first").over(h))
    ends = ends.withColumn("l", F.when(F.col("l.digest") != F.col("first.digest"), F.col("l.hashes"))).withColumn("r", F.when(F.col("r.digest") != F.col("last.digest"), F.col("r.hashes")))
    left = F.coalesce("l", latest(F.coalesce("last.before", "l"), h, -1))
    right = F.coalesce("r", latest(F.coalesce("first.after", "r"), hback, -1))
    ends = ends.select("host", "cell", left.alias("left"), right.alias("right")).join(site_lines(ranged), "host", "left")
    ends = ends.select(F.col("host").alias("h2"), F.col("cell").alias("c2"), "left", "right", "common")
    joined = near.join(ends, (near["host"] == ends["h2"]) & (near["cell"] == ends["c2"]), "left")
    return joined.select(*pages.columns, F.coalesce("before", "left", "after", "right").alias("other"), "common")


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of ``pages(page_id, url, html)``: page_id, url, text (blocks
    joined by line feeds, empty if none), n_chars (its code points), n_shared (lines of
    the page, boilerplate included, that the alignment with its neighbour takes) and
    n_removed (lines of the text that go by it), a row for each row.

    A null html is an empty page; a null or odd url has an empty host and path
    and its neighbours there.  Pages of a host with the same path are ordered by
    page_id; rows that repeat all three columns share their result.  A page whose
    host has fewer than ``SITE_PAGES`` distinct pages loses no line to differences.
    Other columns are ignored.

    The lines travel as hashes; pages are read twice, and their texts shuffled once,
    compressed, to meet what the alignment says of them."""
    ship(pages.sparkSession)
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    whole = [x for c in ("page_id", "url", "html") for x in (F.col(c).isNull(), F.col(c))]
    p = p.withColumn("k1", F.xxhash64(F.lit(1), *whole)).withColumn("k2", F.xxhash64(F.lit(2), *whole))
    host, path = split_url(F.col("url"))
    lines = p.withColumn("host", host).withColumn("path", path).select("k1", "k2", "page_id", "host", "path", "html")
    lines = lines.mapInPandas(_outline, "k1 long, k2 long, page_id long, host string, path string, hashes array<long>, kinds binary, digest long")
    # Written first: dealing into ranges reads its input twice.
    near = neighbours(staged(lines, "html-lines")).select("k1", "k2", "hashes", "kinds", "other", "common")
    said = near.mapInPandas(_align, "k1 long, k2 long, n_shared long, gone array<int>")
    said = said.groupBy("k1", "k2").agg(F.first("n_shared").alias("n_shared"), F.first("gone").alias("gone"))
    # Never a broadcast: what is said grows with the pages.
    packed = p.mapInPandas(_texts, "k1 long, k2 long, page_id long, url string, packed binary")
    out = packed.join(said.hint("merge"), ["k1", "k2"], "left").select("page_id", "url", "packed", "n_shared", "gone")
    out = out.mapInPandas(_rebuild, "page_id long, url string, text string, n_shared long, n_removed long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_removed")
