"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path and dealt by ranges of that order (so one host may hold any share of the pages);
the first and last page of each range go to the adjoining range too, so every page meets both its neighbours however
the pages are dealt. A page is paired with the neighbour of its host whose path shares the longer prefix, and that is
no copy of it (a page that holds all the same lines tells nothing about the site's template). The text lines of both (a
line is the text of one block) are aligned by longest common subsequence, and shared lines are deleted as template.

Differencing decides about every line outside ``article`` elements, and which of these elements are the page's own: one
whose lines are all shared (a teaser on every page) goes as template if another one has lines of its own. An own article
is kept whole, shared lines included: it is what is asked for, and pages of one host do share passages of articles.
Menus, page headers, footers, sidebars, notices, adverts, forms and comments that no neighbour shares word for word
are recognised by element, role, class or id, and where a page has an ``article``, or else a ``main``, what stands
outside it goes.

Repeated lines are told apart by their occurrence (the n-th "x" of one page can only meet the n-th "x" of the other),
which makes every line distinct and the longest common subsequence an increasing subsequence, O(n log n).

Defined results: null, empty or text-free html gives an empty text; a page without a neighbour, or whose neighbours
are copies of it, keeps what the structural rules leave; a null url is a host of its own; rows that repeat a page each
give a row; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ordered_buckets, small_batches, sortable
from .text import chunks

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = re.compile(r"</(script|style|textarea|title|noscript|template|iframe|svg)\s*>", re.I)

# Elements by their meaning in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("head nav footer aside form menu dialog button select fieldset object canvas audio video map".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
MARKS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer gdpr header"
    " masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion related replies reply respond"
    " share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split()
)


@dataclass
class Page:
    """A page's lines in order; per line whether it is boilerplate by structure, in an article (and which), in a main element."""

    lines: list[str] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    zone: list[str] = field(default_factory=list)
    article: list[int] = field(default_factory=list)  # the number of the outermost article element, from 1


def _marked(tag: str, attributes: str, inside: str) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        names = ("class", "id") if tag == "article" else ()
    else:
        names = ("class", "id", "role", "hidden", "aria-hidden", "style")
    for m in _ATTRIBUTE.finditer(attributes) if names else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name not in names:
            continue
        if name in ("class", "id"):
            if any(part in MARKS for part in re.split(r"[^a-z0-9]+", value)):
                return True
        elif name == "role":
            if value in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def parse(source: str) -> Page:
    """The text lines of a page: markup removed, character references decoded, white space made one space."""
    page, text = Page(), []
    stack: list[tuple[str, bool, str]] = []  # tag, boilerplate from here on, zone
    drop, zone, at, articles = False, "", 0, 0

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            page.lines.append(line)
            page.dropped.append(drop)
            page.zone.append(zone)
            page.article.append(articles)

    def leave(n: int) -> None:
        nonlocal drop, zone
        del stack[n:]
        drop, zone = (stack[-1][1], stack[-1][2]) if stack else (False, "")

    while m := _TOKEN.search(source, at):
        text.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    leave(n)
                    break
                if stack[n][0] in ("article", "main", "body") and tag not in ("body", "html", "main"):
                    break  # a stray end tag doesn't reach beyond these
            continue
        if tag in RAW:
            end = next((e for e in _RAW.finditer(source, at) if e[1].lower() == tag), None)
            at = end.end() if end else len(source)
            continue
        if tag in BLOCK:
            flush()
            closes = CLOSES.get(tag, ())
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == "p" or stack[n][0] in closes:
                    leave(n)
                    break
                if stack[n][0] in BLOCK:
                    break
            if tag == "body":  # ends a head that was left open
                leave(0)
        if tag in VOID or m[3].endswith("/"):
            continue
        drop = drop or _marked(tag, m[3], zone)
        if tag in ("article", "main") and zone != "article":
            zone = tag
            articles += tag == "article"
        stack.append((tag, drop, zone))
    text.append(source[at:])
    flush()
    return page


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of a's lines in a longest common subsequence with b, repeated lines told apart by occurrence."""
    seen: dict[str, int] = {}
    place: dict[tuple[str, int], int] = {}
    for i, x in enumerate(b):
        seen[x] = seen.get(x, 0) + 1
        place[x, seen[x]] = i
    seen.clear()
    tails: list[int] = []
    ends: list[int] = []  # index into chain of each tail
    chain: list[tuple[int, int]] = []  # line of a, index of the one before
    for i, x in enumerate(a):
        seen[x] = seen.get(x, 0) + 1
        j = place.get((x, seen[x]))
        if j is None:
            continue
        k = bisect_left(tails, j)
        chain.append((i, ends[k - 1] if k else -1))
        if k == len(tails):
            tails.append(j)
            ends.append(len(chain) - 1)
        else:
            tails[k], ends[k] = j, len(chain) - 1
    out, at = set(), ends[-1] if ends else -1
    while at >= 0:
        out.add(chain[at][0])
        at = chain[at][1]
    return out


def main_text(page: Page, other: Page | None) -> str:
    """The page's lines that neither the neighbour shares nor the structure marks, joined by a space."""
    zones = {z for z, d in zip(page.zone, page.dropped) if z and not d}
    zone = "article" if "article" in zones else "main" if "main" in zones else ""
    inside = {"article": ("article",), "main": ("article", "main"), "": ("", "article", "main")}[zone]
    shared = shared_lines(page.lines, other.lines) if other is not None else ()
    every = {n for n, z, d in zip(page.article, page.zone, page.dropped) if z == "article" and not d}
    own = {n for i, (n, z, d) in enumerate(zip(page.article, page.zone, page.dropped)) if z == "article" and not d and i not in shared} or every
    return " ".join(
        line
        for i, (line, dropped, z) in enumerate(zip(page.lines, page.dropped, page.zone))
        if not dropped and z in inside and (page.article[i] in own if z == "article" else i not in shared)
    )


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def partner(here: Row, before: Row | None, after: Row | None) -> Page | None:
    """The neighbour to compare with: of the same host, the longer common path first, and no copy of the page."""
    near = [x for x in (before, after) if x is not None and x.host == here.host]
    near.sort(key=lambda x: -_common_prefix(here.path, x.path))
    return next((x.page for x in near if x.page.lines != here.page.lines), None)


@dataclass
class Row:
    bucket: int
    own: bool
    page_id: int | None
    url: str | None
    host: str
    path: str
    page: Page


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    host = F.regexp_extract("u", r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract("u", r"^(?:(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1), r"(\.html?|/)$", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.lower(F.coalesce("url", F.lit(""))).alias("u"))
    rows = rows.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    key = F.concat_ws("\0", "host", "path", F.coalesce(sortable(F.col("page_id")), F.lit("")))
    rows, firsts, lasts = ordered_buckets(rows.withColumn("key", key), "key")
    # A range's first page goes to the range before as well, its last one to the range after.
    last = F.from_json(F.lit(json.dumps(lasts)), "array<string>")[F.col("bucket")]
    first = F.from_json(F.lit(json.dumps(firsts)), "array<string>")[F.col("bucket")]
    at = F.array_compact(
        F.array(
            F.col("bucket"),
            F.when((F.col("key") == first) & (F.col("bucket") > 0), F.col("bucket") - 1),
            F.when((F.col("key") == last) & (F.col("bucket") < len(lasts) - 1), F.col("bucket") + 1),
        )
    )
    dealt = rows.withColumn("at", F.explode(at)).withColumn("own", F.col("at") == F.col("bucket"))
    dealt = dealt.repartition(max(1, len(firsts)), "at").sortWithinPartitions("at", "key", "own", F.xxhash64("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed() -> Iterator[Row]:
            for batch in chunks(batches, "html"):
                for at, own, page_id, url, host, path, source in zip(*(batch.column(i).to_pylist() for i in range(7))):
                    yield Row(at, own, page_id, url, host, path, parse(source or ""))

        def output(out):
            ids, urls, texts = ([r[i] for r in out] for i in range(3))
            columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

        out, size = [], 0
        source = parsed()
        before, here = None, next(source, None)
        while here is not None:
            after = next(source, None)
            if here.own:
                near = [x if x is not None and x.bucket == here.bucket else None for x in (before, after)]
                text = main_text(here.page, partner(here, *near))
                out.append((here.page_id, here.url, text))
                size += len(text)
                if size > 4 << 20 or len(out) >= 2000:
                    yield output(out)
                    out, size = [], 0
            before, here = here, after
        if out:
            yield output(out)

    return small_batches(dealt.select("at", "own", "page_id", "url", "host", "path", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
