"""Main text of web pages: differencing against the nearest URLs of the same host, then markup rules.

``parse_page`` turns html into text lines, one per block element, each with its zone: content (in an ``article`` or
``main`` element, in a paragraph or loose), neutral, or a part that the markup names as menu, header, footer, sidebar, notice, advert, form or reader
comment. Pages are ordered by host and URL path; the lines of whole pages, named parts too, are aligned with those of
both neighbours by the longest common subsequence, and shared lines are deleted (``removed_lines`` has the rules). What
then is left in named parts goes by the markup: a menu that no neighbour shares.

Pairing shuffles 64-bit line hashes and marks only.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize
from .url_filter import url_host, url_path

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title|object|canvas|math)\b[^>]*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Elements of the HTML standard, and words that pages use to name their parts.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form head button select menu dialog audio video".split())
OPEN_ENDED = frozenset("p li dt dd td th tr option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PART_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments respond disqus pagination pager toolbar search login widget skip copyright disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments respond disqus".split())
CONTENT_WORDS = frozenset("content article main post entry body page wrapper container wrap layout has with no text story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())


def _part_of(name: str, attributes: str) -> str | None:
    """``part`` or ``comment`` if the attributes name the element as no content, else None."""
    if not attributes or name in ("html", "body", "main"):
        return None
    found = None
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" and (m[2] is None or value in ("", "hidden", "true")) or key == "aria-hidden" and value == "true":
            found = found or "part"
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found = found or "part"
        elif key == "role" and value in ROLES:
            found = found or "part"
        elif key in ("class", "id"):
            for token in value.split():
                words = [w for w in re.split(r"[-_:]+", token) if w]
                if words and not CONTENT_WORDS & set(words) - {"post", "text", "body"} and (words[0] in PART_WORDS or words[-1] in PART_WORDS):
                    found = "comment" if COMMENT_WORDS & set(words) else found or "part"
    return found


#: Zones of a line: a paragraph, heading or the like inside an article or main element; outside of them; in a part that the
#: markup names as no content; text inside an article or main element that stands in no paragraph.
CONTENT, NEUTRAL, PART, LOOSE = 0, 1, 2, 3
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())


def parse_page(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every line of the whole page; only scripts, styles, comments and the like are left out.

    Null and empty pages have no lines.
    """
    lines: list[tuple[int, str]] = []
    part: list[str] = []
    inside = {"article": 0, "main": 0}
    drop, depth, kind = None, 0, None  # the open element that is no content, how deep in elements of its name, why
    at, page, paragraph = 0, page or "", False

    def flush() -> None:
        if part:
            text = " ".join(htmllib.unescape("".join(part)).split())
            part.clear()
            if text:
                zone = NEUTRAL if not inside["article"] and not inside["main"] else CONTENT if paragraph else LOOSE
                lines.append((zone if drop is None else PART, text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            part.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if name in BLOCKS or drop is not None and name == drop:
            flush()
            if name not in ("br", "hr"):
                paragraph = not closing and name in PARAGRAPHS
        if drop is not None:
            if drop in OPEN_ENDED and name in BLOCKS and name != "br" and (not closing or name != drop) and depth <= 1 and (drop == "p" or closing or name == drop):
                drop = None
            elif name == drop:
                depth += -1 if closing else 1
                if depth == 0:
                    drop = None
                    continue
            elif kind == "part" and not closing and name in ("article", "main"):
                drop = None
            if drop is not None:
                continue
        if closing:
            if name in inside and inside[name]:
                inside[name] -= 1
            continue
        if name not in VOID and not attributes.endswith("/"):
            why = "tag" if name in DROPPED or name == "header" and not inside["article"] else _part_of(name, attributes)
            if why:
                flush()
                drop, depth, kind = name, 1, why
                continue
        if name in inside:
            inside[name] += 1
    part.append(page[at:])
    flush()
    return lines


def _prefix_lengths(a: Sequence, b: Sequence) -> list[int]:
    """LCS lengths of ``a`` with every prefix of ``b``, by bit-parallel rows."""
    v = _rows(a, b)[-1] if a else (1 << len(b)) - 1
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (~v >> j & 1))
    return out


def _rows(a: Sequence, b: Sequence) -> list[int]:
    full, where = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    return rows


_MOST_BITS = 1 << 27


def common_lines(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x, y = [i for i in range(lo, len(a) - hi) if a[i] in both], [j for j in range(lo, len(b) - hi) if b[j] in both]
    out += [(x[i], y[j]) for i, j in _aligned([a[i] for i in x], [b[j] for j in y])]
    return out + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > _MOST_BITS and len(a) > 1:  # halve a (Hirschberg), so that memory stays linear
        h = len(a) // 2
        left, right = _prefix_lengths(a[:h], b), _prefix_lengths(a[h:][::-1], b[::-1])
        k = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _aligned(a[:h], b[:k]) + [(i + h, j + k) for i, j in _aligned(a[h:], b[k:])]
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    i, j, out = len(a), len(b), []
    while i and j:  # bit j-1 of a row is 0 where the length rises at j
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


#: A line of more words is taken for boilerplate only if both neighbours share it, and inside article or main never.
LONG_LINE = 15


def _shared(a: Sequence, b: Sequence) -> tuple[list[int], list[int]]:
    pairs = common_lines(a, b)
    return [i for i, _ in pairs], [j for _, j in pairs]


def removed_lines(marks: Sequence[int], before: Sequence[int] | None, after: Sequence[int] | None) -> list[int]:
    """Which lines go, given each line's mark (4 * words + zone) and the lines shared with the page before and after.

    A neighbour that shares more than half of the words in a page's long content lines is a copy of the page (content
    lines are those inside article or main, or NEUTRAL ones where there are none). What only copies share proves nothing.

    * Outside article and main a short line goes if a neighbour shares it, a long one if both do, one of them no copy.
    * Inside, a short line that is LOOSE goes if two neighbours that are no copies share it. Paragraphs and headings
      stay: one that neighbours share is a passage that several articles quote.
    * If nothing but named parts would be left, all other lines stay.
    """
    zones, words = [m & 3 for m in marks], [m >> 2 for m in marks]
    main = (CONTENT, LOOSE) if CONTENT in zones or LOOSE in zones else (NEUTRAL,)
    long = [w if z in main and w > LONG_LINE else 0 for z, w in zip(zones, words, strict=True)]
    near = [set(s) for s in (before, after) if s is not None]
    proof = [s for s in near if not 2 * sum(long[i] for i in s) > sum(long)]
    both = near[0] & near[1] if len(near) == 2 else set()
    gone = {i for i in set().union(*proof) if zones[i] in (NEUTRAL, PART) and (words[i] <= LONG_LINE or i in both)}
    if len(proof) == 2:
        gone |= {i for i in both if zones[i] == LOOSE and words[i] <= LONG_LINE}
    if all(i in gone for i, z in enumerate(zones) if z != PART):
        gone = {i for i in gone if zones[i] == PART}
    return sorted(gone)


@F.pandas_udf(T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.IntegerType()))]))
def _outline(pages: pd.Series) -> pd.DataFrame:
    rows = [parse_page(p) for p in pages]
    hashes = [[int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for _, t in r] for r in rows]
    return pd.DataFrame({"hashes": hashes, "marks": [[4 * (t.count(" ") + 1) + z for z, t in r] for r in rows]})


@F.pandas_udf(T.BinaryType())
def _packed(pages: pd.Series) -> pd.Series:
    """The lines outside named parts, each after its place, compressed, so that a shuffle carries less than the html."""
    return pd.Series([zlib.compress("\n".join(f"{i} {t}" for i, (z, t) in enumerate(parse_page(p)) if z != PART).encode("utf-8", "surrogatepass"), 3) for p in pages], dtype=object)


@F.pandas_udf(T.StringType())
def _unpacked(packed: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for p, r in zip(packed, removed, strict=True):
        gone = set() if r is None else set(map(int, r))
        lines = [x.partition(" ") for x in zlib.decompress(p).decode("utf-8", "surrogatepass").split("\n")]
        out.append(" ".join(t for i, _, t in lines if t and int(i) not in gone))
    return pd.Series(out, dtype=object)


_EDGES = "host string, path string, page long, hashes array<long>, marks array<int>, before array<int>, after array<int>, edge int, part int, removed array<int>"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int32())]
_NAMES = [x.split()[0] for x in _EDGES.split(", ")]


@dataclass
class _Page:
    """A page of the order, with the lines that it shares with the page before and after it (None: no page, or not known)."""

    host: str
    path: str
    page: int
    hashes: list[int]
    marks: list[int]
    before: list[int] | None = None
    after: list[int] | None = None
    edge: int | None = None  # 1: the first of its range, 2: the last, 3: both

    def meet(self, other: _Page) -> None:
        if self.host == other.host:
            self.after, other.before = _shared(self.hashes, other.hashes)

    def row(self, part: int) -> tuple:
        if self.edge:
            return (self.host, self.path, self.page, self.hashes, self.marks, self.before, self.after, self.edge, part, None)
        return (self.host, self.path, self.page, None, None, None, None, None, part, removed_lines(self.marks, self.before, self.after))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each page of a sorted range with the next. The pages at the range's ends are passed on with their outlines."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            page = _Page(**r)
            if last is None:
                page.edge = 1
            else:
                last.meet(page)
                rows.append(last.row(part))
            last = page
        if rows:
            yield _batch(rows)
    if last is not None:
        last.edge = 3 if last.edge else 2
        yield _batch([last.row(part)])


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of all ranges in order: the last page of one is the neighbour of the first page of the next."""
    last = None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            page = _Page(**{k: r[k] for k in ("host", "path", "page", "hashes", "marks", "before", "after", "edge")})
            if last is not None:
                if last.edge & 2:  # else both are in the same range, where they may have other pages between them
                    last.meet(page)
                last.edge = None
                rows.append(last.row(0))
            last = page
        if rows:
            yield _batch(rows)
    if last is not None:
        last.edge = None
        yield _batch([last.row(0)])


def differences(outlines: DataFrame) -> DataFrame:
    """``outlines``: host, path, page, hashes, marks, once for each page. Returns (host, path, page, removed).

    Pages are dealt by range of (host, path, page), so that a large host spreads over tasks. Two outlines for each range
    go to one task that pairs the ends.
    """
    keys = ["host", "path", "page"]
    ordered = outlines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = materialize(ordered.select(*keys, "hashes", "marks").mapInArrow(_walk, _EDGES), "differences")
    ends = found.filter("edge is not null").repartition(1).sortWithinPartitions("part", "edge").mapInArrow(_join_ends, _EDGES)
    inner = found.filter("edge is null")
    return inner.unionByName(ends).filter("size(removed) > 0").select(*keys, "removed")


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", column: str = "text") -> DataFrame:
    """Add ``column`` with each page's main text, its lines joined by one space; empty if there is none.

    Null and empty html gives an empty text, and a null url has empty host and path. Equal pages at one path count once
    when neighbours are paired and get equal texts. A column of that name is replaced, others stay whatever their
    names. An empty table gives an empty result.

    A page is parsed twice, once for its outline and once for its lines: storing the lines of all pages for the time
    between would cost more than the second parse. The lines travel compressed, once, to the join with the differences.
    """
    rest = [c for c in pages.columns if c.lower() != column.lower() or c in (url, html)]
    keep = [c for c in rest if c != html] if column == html else rest
    h, p, n, k = (fresh(pages, x) for x in ("host", "path", "page", "packed"))
    at = [url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`")), F.xxhash64(F.col(f"`{html}`"))]
    some = F.coalesce(F.length(F.col(f"`{html}`")) > 0, F.lit(False))
    outlines = pages.filter(some).select(*[c.alias(x) for c, x in zip(at, ("host", "path", "page"), strict=True)], _outline(F.col(f"`{html}`")).alias("o"))
    outlines = outlines.select("host", "path", "page", "o.hashes", "o.marks").filter("size(hashes) > 0").dropDuplicates(["host", "path", "page"])
    gone = materialize(differences(outlines), "removed").toDF(f"{h}_", f"{p}_", f"{n}_", f"{k}_")
    full = pages.filter(some).select(*[F.col(f"`{c}`") for c in keep], *[c.alias(x) for c, x in zip(at, (h, p, n), strict=True)], _packed(F.col(f"`{html}`")).alias(k))
    on = (F.col(h) == F.col(f"{h}_")) & (F.col(p) == F.col(f"{p}_")) & (F.col(n) == F.col(f"{n}_"))
    full = full.join(gone.hint("shuffle_merge"), on, "left")
    out = full.select(*[F.col(f"`{c}`") for c in keep], _unpacked(F.col(k), F.col(f"{k}_")).alias(column))
    return out.unionByName(pages.filter(~some).select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias(column)))
