"""Main text of web pages by differencing each page with its nearest-URL neighbour.

A page is parsed into text lines, one per block, each with the zone it stands in: inside the
article or in the chrome around it (menus, headers, footers, sidebars, notices, adverts,
forms, comments). Pages are sorted by host and URL path; each is paired with the neighbour
of its host whose path shares the longer beginning. The lines of the two are aligned by
longest common subsequence, and shared lines are deleted:

- outside an article every shared line is site furniture and goes;
- inside an article a shared line goes if either page also shows it in its chrome, so that
  copies of an article do not delete each other.

Lines of the chrome that are marked as such go in any case. On pages that mark no article
all unmarked lines are candidates, and there differencing alone decides.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from batchwright.llm.common import map_batches

# What HTML elements are.
SILENT = frozenset("script style template noscript svg math iframe object canvas select option datalist head title".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
CHROME = frozenset("nav header footer aside form menu dialog button".split())
ARTICLE = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "dd", "dt", "li"}
ENDS_WITH_SAME = frozenset("li dt dd tr td th option".split())
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar|footer|header|"
    r"masthead|cookie\w*|consent|notice\w*|newsletter|subscribe|share|social|related|comment\w*|disqus|popup|modal|"
    r"login|search\w*|pagination|pager|toolbar|widget\w*)(?:$|[\s_-])"
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_SPACE = re.compile(r"\s+")

#: Html of a block, in bytes: blocks are as many as the input needs, and each is one task.
BLOCK_BYTES = 64 * 1024 * 1024

#: Zones of a line.
FURNITURE, BODY, PLAIN = 0, 1, 2


class _Lines(HTMLParser):
    """Text lines with their zone: FURNITURE, BODY (in an article) or PLAIN."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # element and the zone outside it
        self.zone = PLAIN
        self.silent = 0
        self.parts: list[str] = []
        self.lines: list[tuple[int, str]] = []

    def _end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((self.zone, text))
            self.parts = []

    def handle_starttag(self, tag, attrs):
        if self.silent == 1 and tag not in HEAD_ONLY and any(name == "head" for name, _ in self.open):
            # The end tag of a head may be left out: what cannot stand there ends it.
            self.open = [x for x in self.open if x[0] != "head"]
            self.silent = 0
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self.open.append((tag, self.zone))
                self.silent += 1
            return
        if tag in SILENT:
            if tag == "head":
                self._end_line()
            self.open.append((tag, self.zone))
            self.silent += 1
            return
        if tag in ENDS_WITH_SAME:
            self._close_to(tag, within=BLOCKS - {tag, "p"})
        if tag in CLOSES_P:
            self._close_to("p", within=frozenset(("td", "th", "li", "div", "article", "section", "body")))
        if tag in BLOCKS or tag == "br":
            self._end_line() if tag != "br" else self.parts.append(" ")
        if tag in VOID:
            return
        self.open.append((tag, self.zone))
        if self.zone != FURNITURE:
            names = dict(attrs)
            named = f"{names.get('class') or ''} {names.get('id') or ''}".lower()
            role = (names.get("role") or "").lower()
            hidden = "hidden" in names or (names.get("aria-hidden") or "").lower() == "true"
            furniture = tag in CHROME and not (tag == "header" and self.zone == BODY)
            if furniture or hidden or role in _CHROME_ROLES or (named.strip() and _CHROME_NAME.search(named)):
                if tag not in ("html", "body") and tag not in ARTICLE:
                    self.zone = FURNITURE
            elif tag in ARTICLE or role in ("main", "article"):
                self.zone = BODY

    def _close_to(self, tag: str, within: frozenset) -> None:
        """Close an open `tag` and what is in it, unless an element of `within` is in between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._end_line()
                self.zone = self.open[k][1]
                del self.open[k:]
                return
            if self.open[k][0] in within:
                return

    def handle_endtag(self, tag):
        if self.silent:
            names = [name for name, _ in self.open]
            if tag in SILENT and tag in names:
                while self.open:
                    name, self.zone = self.open.pop()
                    self.silent -= name in SILENT
                    if name == tag:
                        break
            elif tag in ("body", "html"):
                self.silent = 0
                self.open = [x for x in self.open if x[0] not in SILENT]
            return
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self._end_line()
            if any(name == tag for name, _ in self.open):
                self._close_to(tag, within=frozenset())
        else:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    zone = self.open[k][1]
                    if zone != self.zone:
                        self._end_line()
                        self.zone = zone
                    del self.open[k]
                    return
                if self.open[k][0] in BLOCKS:
                    return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def text_lines(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page in order; character references are decoded."""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser._end_line()
    return parser.lines


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path) that pages are sorted by; a URL that cannot be read is a path without host."""
    try:
        parts = urlsplit(html.unescape(url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        return host, unquote(parts.path).rstrip("/") if host else (url or "")
    except ValueError:
        return "", url or ""


def shared_path(a: str, b: str) -> int:
    """Length of the common beginning of two paths."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def common_lines(a: list[int], b: list[int]) -> tuple[set[int], set[int]]:
    """Places of one longest common subsequence in a and b.

    Only lines that both pages have take part. Equal beginnings and ends are matched first;
    the rest is aligned by the rule of Hunt and Szymanski, from the matches alone, so that
    the work follows the shared lines and not the product of the lengths.
    """
    left, right = 0, 0
    while left < min(len(a), len(b)) and a[left] == b[left]:
        left += 1
    while right < min(len(a), len(b)) - left and a[-1 - right] == b[-1 - right]:
        right += 1
    in_a = {*range(left), *range(len(a) - right, len(a))}
    in_b = {*range(left), *range(len(b) - right, len(b))}
    places: dict[int, list[int]] = {}
    for j in range(len(b) - right - 1, left - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # smallest end in b of a common subsequence of each length
    chains: list[tuple] = []
    for i in range(left, len(a) - right):
        for j in places.get(a[i], ()):
            low, high = 0, len(ends)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if ends[mid] < j else (low, mid)
            chain = (i, j, chains[low - 1] if low else None)
            if low == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[low], chains[low] = j, chain
    chain = chains[-1] if chains else None
    while chain:
        in_a.add(chain[0])
        in_b.add(chain[1])
        chain = chain[2]
    return in_a, in_b


def main_text(zones: list[int], lines: list[str], keys: list[int], other: tuple[list[int], list[int]] | None) -> str:
    """The page's lines without furniture and without lines shared with the other page."""
    shared: set[int] = set()
    chrome = {k for z, k in zip(zones, keys) if z == FURNITURE}
    if other is not None:
        other_zones, other_keys = other
        shared, _ = common_lines(keys, other_keys)
        chrome |= {k for z, k in zip(other_zones, other_keys) if z == FURNITURE}
    has_body = BODY in zones
    kept = []
    for place, (zone, line, key) in enumerate(zip(zones, lines, keys)):
        if zone == FURNITURE or (has_body and zone != BODY):
            continue
        if place in shared and (zone != BODY or key in chrome):
            continue
        kept.append(line)
    return "\n".join(kept)


#: Order of pages: equal keys are equal pages.
ORDER = ("host", "path", "known", "number", "digest")


def page_keys(pages: DataFrame) -> DataFrame:
    """The sort key of each page: host, path, page_id (a null id first) and a hash of the html."""

    def run(batch):
        keys = [url_key(url) for url in batch["url"]]
        return {
            "host": [h for h, _ in keys],
            "path": [p for _, p in keys],
            "known": [i is not None for i in batch["page_id"]],
            "number": [i or 0 for i in batch["page_id"]],
            "digest": batch["digest"],
        }

    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.xxhash64("html").alias("digest"))
    return map_batches(base, run, "host string, path string, known boolean, number bigint, digest bigint")


def block_ends(pages: DataFrame, n: int) -> list[tuple[tuple, tuple]]:
    """First and last key of each of about `n` consecutive blocks of the sorted pages.

    Two rows per block reach the driver; the keys themselves are sorted by Spark.
    """
    keys = page_keys(pages)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first if first is not None else batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield first
            yield last

    rows = keys.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(ends, keys.schema).collect()
    found = sorted(tuple(r) for r in rows)
    return list(zip(found[::2], found[1::2]))


def in_blocks(pages: DataFrame, blocks: list[tuple[tuple, tuple]]) -> DataFrame:
    """The pages with their block; the pages at both ends of a block go to the next block too, as context."""
    sent = pages.sparkSession.sparkContext.broadcast(blocks)
    names = ["page_id", "url", "html"]

    def run(batch):
        firsts = [first for first, _ in sent.value]
        lasts = {last: i for i, (_, last) in enumerate(sent.value)}
        out = {n: [] for n in [*names, *ORDER, "block", "context"]}
        for page_id, url, page, digest in zip(*(batch[n] for n in (*names, "digest"))):
            key = (*url_key(url), page_id is not None, page_id or 0, digest)
            own = bisect_right(firsts, key) - 1
            targets = [(own, False)]
            if key == firsts[own] and own > 0:
                targets.append((own - 1, True))
            if key in lasts and lasts[key] + 1 < len(firsts):
                targets.append((lasts[key] + 1, True))
            for block, context in targets:
                for name, value in zip(out, (page_id, url, page, *key, block, context)):
                    out[name].append(value)
        return out

    base = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.xxhash64("html").alias("digest"))
    kind = base.schema["page_id"].dataType.simpleString()
    return map_batches(
        base, run,
        f"page_id {kind}, url string, html string, host string, path string, known boolean, number bigint, "
        "digest bigint, block int, context boolean",
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row.

    Sorted pages are cut into blocks, so a host with a third of all pages is many blocks; a
    block also gets the last page before it and the first after it, so a page's partner does
    not depend on the cuts. Of two neighbours with equally long shared paths the one before
    is the partner; a host's only page has none. Null html, and pages without text, give the
    empty text. Rows that repeat a page_id are answered one by one; copies of an article do
    not delete each other's text. A null page_id sorts before all others of its path.
    """
    configured = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    blocks = block_ends(pages, max(configured, -(-size // BLOCK_BYTES)))
    schema = pages.select("page_id", F.col("url").cast("string").alias("url")).schema
    spec = StructType([*schema.fields, *StructType.fromDDL("text string, n_chars bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(spec)
        before = waiting = None  # the page answered last, and the one whose next neighbour is not known yet
        done: list[tuple] = []

        def answer(page, after):
            if page["context"]:
                return
            choice = None
            for near in (before, after):
                if near is not None and near["host"] == page["host"] and page["host"]:
                    score = shared_path(near["path"], page["path"])
                    if choice is None or score > choice[0]:
                        choice = score, near
            other = (choice[1]["zones"], choice[1]["keys"]) if choice else None
            text = main_text(page["zones"], page["lines"], page["keys"], other)
            done.append((page["page_id"], page["url"], text, len(text)))

        def flush():
            columns = list(zip(*done)) or [[]] * len(target)
            done.clear()
            arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, target)]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        for batch in batches:
            columns = batch.to_pydict()
            for values in zip(*columns.values()):
                page = dict(zip(columns, values))
                found = text_lines(page.pop("html") or "")
                page["zones"], page["lines"] = [z for z, _ in found], [line for _, line in found]
                page["keys"] = [xxhash.xxh3_64_intdigest(line) for line in page["lines"]]
                if waiting is not None and waiting["block"] != page["block"]:
                    answer(waiting, None)
                    before = waiting = None
                if waiting is not None:
                    answer(waiting, page)
                    before = waiting
                waiting = page
            yield flush()
        if waiting is not None:
            answer(waiting, None)
            yield flush()

    ordered = in_blocks(pages, blocks).repartitionById(max(1, len(blocks)), F.col("block")).sortWithinPartitions("block", *ORDER)
    return ordered.mapInArrow(run, spec)
