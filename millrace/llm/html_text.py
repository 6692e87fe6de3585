"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path, so that neighbours are the pages of a host whose paths are
nearest. A page is read into lines, one per block. What the page itself marks as no article
(menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts) is left out. Pages
of a host with the same lines are one page. Each is aligned with the NEAR nearest different pages
before and after it by longest common subsequences of lines. Neighbours that are copies of the
page are set apart: what is left of each beside the shared lines is hardly anything or an edited
form of the other's, or the page shares nearly all it has beside the lines that recur on third
pages. Lines shared with the other neighbours are *suspects*, inside what the page marks as its
article only if SURE of them share it, and never the article's own headline.

Whether suspects go is decided once for each line and host, by counting: a line that is suspect
on HOST_SHARE of the host's different pages is part
of its template and goes from all its pages; any other stays on all. A page that marks an article
gives what is left of that; one that marks none gives every line left. A host's template has at
most 1 / HOST_SHARE as many lines as its pages have on average, so it is a short list.

Sorting deals even one host of a third of all pages over tasks. The cut points are found first, on
keys and hashes of the lines alone, and with them the different pages next to each cut, however
far away equal pages push them; those go to the tasks on both sides. A task holds a few pages.
Pages are read three times: for the cuts, for the alignment, and for the result.

Defined results: a null or empty html has an empty text; a null url counts as an empty one;
repeated rows are repeated in the result; other columns are ignored. A quote opens a value only
behind an equals sign; where an open quote leaves no end for many tags, tags end at the next `>`.
On a host with two different pages nothing tells a short article in a long template from an edit,
but the rest of the lines, and marked articles are kept whole. A page with NEAR or more copies
next to it on both sides, all of them different, makes no line suspect.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import stored
from millrace.llm.words import slices

#: Different pages before and after a page that it is compared with.
NEAR = 3
#: Different pages, no copies, that share a line before it goes from a marked article.
SURE = 2
#: A host's different pages on which a line has to be suspect.
HOST_SHARE = 0.5
#: Pages that share so large a part of their characters may be copies.
COPY_SHARE = 0.8
#: They are if the rest is so small a part of them, or shares so large a part of its word pairs.
EDIT_SHARE, EDIT_WORDS = 0.02, 0.5

#: Elements whose text is never shown or never part of an article.
LEFT_OUT = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea "
    "iframe svg canvas object menu audio video map".split()
)
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Elements inside a line; all others begin and end one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words, and parts of them between hyphens, in class, id or role that mark what is
#: no article.
MARKS = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|footer|masthead|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommended|comments?|replies|reply|discussion|"
    r"disqus|widget|toolbar|pagination|pager|search|contentinfo|complementary|disclaimer|copyright)\d*",
    re.IGNORECASE,
)
#: Names that sections of an article have as well; they mark nothing inside one.
SECTIONS = frozenset(("related", "discussion"))
#: First parts of words that say what a page has, and last parts that say a word is
#: about the page or its article.
ABOUT = frozenset("has have no not non with without is hide show".split())
WHOLE = frozenset("page layout main article content body document".split())
TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<rest>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?][^>]*+>""",
    re.DOTALL,
)
#: What ends at the next `>`, whatever its quotes.
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>|<[!?][^>]*+>", re.DOTALL)
TAG_START = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
#: Tags without an end after which quotes are no longer looked at.
PATIENCE = 16
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Page:
    """Lines of a page that it does not mark as no article; own: whether it marks them as one;
    heads: whether they are headlines of that."""

    lines: list[str] = field(default_factory=list)
    own: list[bool] = field(default_factory=list)
    heads: list[bool] = field(default_factory=list)

    def marks(self) -> str:
        return "".join("012"[own + head] for own, head in zip(self.own, self.heads, strict=True))

    @staticmethod
    def of(lines: str, marks: str) -> Page:
        return Page(lines.split("\n") if lines else [], [m != "0" for m in marks], [m == "2" for m in marks])

    def size(self) -> int:
        return sum(map(len, self.lines))

    def digest(self) -> str:
        return blake2b("\n".join([self.marks(), *self.lines]).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def mark_word(word: str, within: bool) -> bool:
    parts = [part for part in re.split(r"[_-]+", word.lower()) if part]
    if not parts or (len(parts) > 1 and (parts[0] in ABOUT or parts[-1] in WHOLE)):
        return False
    return any(MARKS.fullmatch(part) and not (within and part in SECTIONS) for part in parts)


def marked(name: str, rest: str, within: bool) -> bool:
    if name in LEFT_OUT or (name == "header" and not within):
        return True
    if name == "dialog" and not re.search(r"(?:^|\s)open(?:$|[\s=])", rest):
        return True
    if not rest.strip() or name in ("html", "body"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    words = " ".join(found.get(k, "") for k in ("class", "id", "role")).split()
    shown = not HIDDEN.search(found.get("style", "")) and not re.search(r"(?:^|\s)hidden(?:$|[\s=])", rest)
    return any(mark_word(word, within) for word in words) or not shown


def read_page(html: str) -> Page:
    """If all articles of a page lie in elements that it marks as none, those are read."""
    page, held = _read(html, False)
    return _read(html, True)[0] if held and not any(page.own) else page


def _read(html: str, inside: bool) -> tuple[Page, bool]:
    """The page, and whether what was left out holds an article; inside: that is not left out."""
    page = Page()
    held = False
    parts: list[str] = []
    within = skip_depth = articles = headline = failed = 0
    skipped = ""

    def close() -> None:
        line = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if line:
            page.lines.append(line)
            page.own.append(within > 0)
            page.heads.append(within > 0 and headline > 0)

    at = 0
    while True:
        start = TAG_START.search(html, at)
        if start is None or html.find(">", start.start()) < 0 and not html.startswith("<!--", start.start()):
            if not skipped:
                parts.append(html[at:])
            break
        tag = (TAG if failed < PATIENCE else PLAIN_TAG).match(html, start.start())
        if not skipped:
            parts.append(html[at : start.start() if tag else start.end()])
        if tag is None:
            failed += 1
            at = start.end()
            continue
        at = tag.end()
        if tag["name"] is None:
            continue
        name, ends = tag["name"].lower(), bool(tag["end"])
        if skipped == "p" and not ends and name not in INLINE | VOID:
            # A paragraph without an end tag ends where the next block begins.
            skipped = ""
        if skipped:
            # The main part is never left out; an article is, like one of the comments, if there
            # are others. An end tag of what holds the skipped element ends it too, if its own is
            # missing.
            opens = not ends and within == 0 and name in ("article", "main")
            held |= opens
            if opens and (inside or name == "main"):
                skip_depth = 0
            elif name in ("article", "main") and (not ends or articles):
                articles += -1 if ends else 1
                continue
            elif name == skipped and not tag["rest"].endswith("/"):
                skip_depth += -1 if ends else 1
            if not skip_depth or (ends and name in ("article", "main", "body", "html")):
                skipped = ""
            else:
                continue
            if name not in ("article", "main"):
                continue
        if name not in INLINE:
            close()
        if name == "h1":
            headline = max(headline - 1, 0) if ends else headline + 1
        elif headline and name in ("article", "main", "p", "section", "div", "h2", "h3"):
            # A headline without an end tag ends where the next block begins.
            headline = 0
        if ends:
            if name in ("article", "main"):
                within = max(within - 1, 0)
            continue
        if name in VOID:
            continue
        if marked(name, tag["rest"], within > 0):
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            elif not tag["rest"].endswith("/"):
                skipped, skip_depth, articles = name, 1, 0
        elif name in ("article", "main"):
            within += 1
    close()
    return page, held


#: Bits of the rows that an alignment keeps at once; longer pages are cut in two first.
ROW_BITS = 1 << 26


def aligned_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence of the two, the last first."""
    both = set(a) & set(b)
    at_a = [i for i, line in enumerate(a) if line in both]
    at_b = [j for j, line in enumerate(b) if line in both]
    names: dict[str, int] = {}
    one = [names.setdefault(a[i], len(names)) for i in at_a]
    two = [names.setdefault(b[j], len(names)) for j in at_b]
    return [(at_a[i], at_b[j]) for i, j in reversed(alignment(one, two))]


def alignment(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order. Pages whose rows would take more than
    ROW_BITS are cut where two shorter alignments make up a longest one (Hirschberg, 1975)."""
    found, tail = [], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            tail.append((k, m))
        if i == k or j == m:
            continue
        if (k - i) * (m - j) <= ROW_BITS or k - i == 1:
            found += ((i + x, j + y) for x, y in by_rows(a[i:k], b[j:m]))
            continue
        half = (i + k) // 2
        ahead = lengths(a[i:half], b[j:m])
        behind = lengths(a[half:k][::-1], b[j:m][::-1])[::-1]
        sums = [x + y for x, y in zip(ahead, behind, strict=True)]
        cut = j + sums.index(max(sums))
        todo += [(half, k, cut, m), (i, half, j, cut)]
    return sorted(found + tail)


def bit_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For every start of a, a number whose bit j is unset where b's first j + 1 lines add one to
    the length of the longest common subsequence."""
    places: dict[int, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    masks = {line: sum_of_bits(own, len(b)) for line, own in places.items()}
    full = (1 << len(b)) - 1
    row = full
    yield row
    for line in a:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row & ~hit)) & full
        yield row


def sum_of_bits(places: list[int], n: int) -> int:
    raw = bytearray(n // 8 + 1)
    for j in places:
        raw[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(raw, "little")


def lengths(a: list[int], b: list[int]) -> list[int]:
    """The lengths of longest common subsequences of a and all starts of b."""
    for row in bit_rows(a, b):
        last = row
    bits = bin(last | 1 << len(b))[3:][::-1]
    out = [0]
    for bit in bits:
        out.append(out[-1] + (bit == "0"))
    return out


def by_rows(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    rows = list(bit_rows(a, b))
    found = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def shared_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence of the two."""
    return [i for i, _ in aligned_lines(a, b)]


def word_pairs(lines: list[str]) -> set[tuple[str, str]]:
    words = " ".join(lines).split()
    return set(zip(["", *words], [*words, ""], strict=True)) if words else set()


def edited(page: Page, other: Page, pairs: list[tuple[int, int]]) -> bool:
    """Whether one is the other but for small changes: lines beside the shared ones decide."""
    most = max(page.size(), other.size())
    common = sum(len(page.lines[i]) for i, _ in pairs)
    if common < COPY_SHARE * most:
        return False
    here, there = {i for i, _ in pairs}, {j for _, j in pairs}
    rest = [line for i, line in enumerate(page.lines) if i not in here]
    others = [line for j, line in enumerate(other.lines) if j not in there]
    if max(sum(map(len, rest)), sum(map(len, others))) <= EDIT_SHARE * most:
        return True
    one, two = word_pairs(rest), word_pairs(others)
    return len(one & two) >= EDIT_WORDS * max(min(len(one), len(two)), 1)


def copied_in(page: Page, other: Page, pairs: list[tuple[int, int]], recurring: set[str]) -> bool:
    """Whether nearly all of either, beside recurring lines, is in the other too."""
    sizes = [sum(len(x) for x in p.lines if x not in recurring) for p in (page, other)]
    common = sum(len(page.lines[i]) for i, _ in pairs if page.lines[i] not in recurring)
    return common > 0 and common >= COPY_SHARE * min(sizes)


def suspects(page: Page, neighbours: list[Page]) -> list[bool]:
    """Which lines the page shares with enough neighbours that are no copies of it."""
    pairs = [aligned_lines(page.lines, other.lines) for other in neighbours]
    others = [k for k, other in enumerate(neighbours) if not edited(page, other, pairs[k])]
    times = [0] * len(page.lines)
    for k in others:
        third = [set(neighbours[x].lines) for x in others if x != k]
        if third and copied_in(page, neighbours[k], pairs[k], set().union(*third)):
            continue
        for i, _ in pairs[k]:
            times[i] += 1
    return [
        n >= (SURE if own else 1) and not head
        for n, own, head in zip(times, page.own, page.heads, strict=True)
    ]


def kept_text(page: Page, gone: list[bool]) -> str:
    """The lines that are not gone, of the marked article if there is one."""
    marks = any(page.own)
    return "\n".join(
        line for line, own, out in zip(page.lines, page.own, gone, strict=True) if not out and (own or not marks)
    )


def article(page: Page, neighbours: list[Page]) -> str:
    """A page's text by its neighbours alone: all suspects go."""
    return kept_text(page, suspects(page, neighbours))


def line_key(own: bool, line: str) -> int:
    """A line's number on its host, another one inside articles."""
    raw = blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8, person=b"own" if own else b"").digest()
    return int.from_bytes(raw, "little", signed=True)


def _placed(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[tuple]]:
    """Lists of (key, page, row): a key orders as Spark orders host, path and page_id."""
    for batch in (part for whole in batches for part in slices(whole, column)):
        rows = zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id", "url", column)), strict=True)
        yield [((h, p, i is not None, i or 0), read_page(x or ""), (i, u)) for h, p, i, u, x in rows]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "path", "page_id", "digest"]
    for rows in _placed(batches, "html"):
        found = [(key[0], key[1], row[0], page.digest()) for key, page, row in rows]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted stretch: its first key, and the first and last NEAR different pages, each with
    its key, of the first and last host."""
    first = last = None
    head: OrderedDict[str, tuple] = OrderedDict()
    tail: OrderedDict[str, tuple] = OrderedDict()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("host", "path", "page_id", "digest"))
        for host, path, page_id, digest in zip(*columns, strict=True):
            key = (host, path, page_id is not None, page_id or 0)
            first = first or key
            if host == first[0] and len(head) < NEAR:
                head.setdefault(digest, key)
            if host != last:
                tail.clear()
            last = host
            tail[digest] = key
            tail.move_to_end(digest)
            if len(tail) > NEAR:
                tail.popitem(last=False)
    if first is not None:
        edges = json.dumps([first, last, list(head.items()), list(tail.items())])
        yield pa.RecordBatch.from_arrays([pa.array([edges])], ["edges"])


def cuts_of(edges: list[str]) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first keys of all stretches in order, and the stretches that need a page of another,
    by its key."""
    parts = sorted(
        (tuple(first), last, [(d, tuple(k)) for d, k in head], [(d, tuple(k)) for d, k in tail])
        for first, last, head, tail in map(json.loads, edges)
    )
    wanted: dict[tuple, list[int]] = {}

    def lead(n: int, host: str, way: int) -> None:
        have: dict[str, tuple] = {}
        x = n + way
        while 0 <= x < len(parts) and len(have) < NEAR:
            first, last, head, tail = parts[x]
            if host != (last if way < 0 else first[0]):
                break
            for digest, key in reversed(tail) if way < 0 else head:
                if len(have) < NEAR:
                    have.setdefault(digest, key)
            if first[0] != last:
                break
            x += way
        for key in have.values():
            wanted.setdefault(key, []).append(n)

    for n, (first, last, _, _) in enumerate(parts):
        lead(n, first[0], -1)
        lead(n, last, 1)
    return [p[0] for p in parts], wanted


DEALT = "stretch int, host string, path string, page_id long, url string, lines string, own string, asked boolean"


def _dealt(firsts: list[tuple], wanted: dict[tuple, list[int]]):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in DEALT.split(", ")]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        for rows in _placed(batches, "html"):
            out = []
            for key, page, (page_id, url) in rows:
                given = (key[0], key[1], page_id, url, "\n".join(page.lines), page.marks())
                home = max(bisect_right(firsts, key) - 1, 0)
                out.append((home, *given, True))
                out += [(n, *given, False) for n in wanted.get(key, ())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return deal


@dataclass
class Waiting:
    """A page whose later neighbours are still to come; asked: it lies in this stretch itself."""

    page: Page
    near: dict[str, Page]
    asked: bool = False
    later: int = 0


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, line, digest) of every suspect line that may still be part of its page's text; rows
    come sorted within their stretch."""
    here: tuple | None = None
    recent: OrderedDict[str, Page] = OrderedDict()
    waiting: OrderedDict[str, Waiting] = OrderedDict()
    out: list[tuple[str, int, str]] = []

    def judge(done: list[tuple[str, Waiting]]) -> None:
        for digest, one in done:
            if one.asked:
                page, marks = one.page, any(one.page.own)
                found = suspects(page, list(one.near.values()))
                keys = {
                    line_key(own, line)
                    for line, own, hit in zip(page.lines, page.own, found, strict=True) if hit and (own or not marks)
                }
                out.extend((here[1], key, digest) for key in keys)

    def handed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "line", "digest"]
        )
        out.clear()
        return batch

    for batch in (part for whole in batches for part in slices(whole, "lines")):
        names = ("stretch", "host", "lines", "own", "asked")
        for stretch, host, lines, own, asked in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if here != (stretch, host):
                judge(list(waiting.items()))
                waiting.clear()
                recent.clear()
                here = (stretch, host)
            page = Page.of(lines, own)
            digest = page.digest()
            if digest not in waiting:
                for one in waiting.values():
                    one.near[digest] = page
                    one.later += 1
                for key in [k for k, one in waiting.items() if one.later >= NEAR]:
                    judge([(key, waiting.pop(key))])
                before = [k for k in recent if k != digest][-NEAR:]
                waiting[digest] = Waiting(page, {k: recent[k] for k in before})
            recent[digest] = page
            recent.move_to_end(digest)
            if len(recent) > NEAR + 1:
                recent.popitem(last=False)
            waiting[digest].asked |= asked
        yield handed()
    judge(list(waiting.items()))
    yield handed()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages without the lines of their host's template."""
    for batch in (part for whole in batches for part in slices(whole, "html")):
        texts = []
        for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
            page = read_page(html or "")
            known = set(template or ())
            gone = [
                bool(known) and not head and line_key(own, line) in known
                for line, own, head in zip(page.lines, page.own, page.heads, strict=True)
            ]
            texts.append(kept_text(page, gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def main_texts(pages: DataFrame, stretches: int | None = None) -> DataFrame:
    """(page_id, url, text) of every row of pages(page_id, url, html).

    stretches: parts that the sorted pages are cut into; as many as shuffles have by default.
    """
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    placed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "").alias("path"),
    )
    order = ["host", "path", "page_id"]
    stretches = stretches or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = placed.mapInArrow(_keys, "host string, path string, page_id long, digest string")
    keys = stored(keys, "page-keys")
    edges = keys.repartitionByRange(stretches, *order).sortWithinPartitions(*order).mapInArrow(_edges, "edges string")
    firsts, wanted = cuts_of([r.edges for r in edges.collect()])
    found = (
        placed.mapInArrow(_dealt(firsts, wanted), DEALT)
        .repartitionById(max(len(firsts), 1), F.col("stretch"))
        .sortWithinPartitions("stretch", *order)
        .mapInArrow(_suspects, "host string, line long, digest string")
    )
    sizes = keys.groupBy("host").agg(F.count_distinct("digest").alias("pages"))
    lines = found.groupBy("host", "line").agg(F.count_distinct("digest").alias("times"))
    template = stored(
        lines.join(sizes, "host").where(F.col("times") >= F.col("pages") * HOST_SHARE)
        .groupBy("host").agg(F.collect_list("line").alias("template")),
        "page-templates",
    )
    return (
        placed.select("host", "page_id", "url", "html").join(template, "host", "left")
        .mapInArrow(_texts, "page_id long, url string, text string")
    )
