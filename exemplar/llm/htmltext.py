"""Main text of web pages by differencing pages of near URLs.

1. A page is read into lines: runs of text between block borders, without comments,
   scripts, styles and other raw elements, character references decoded, white space
   made single.  A line also keeps where it stood: inside the main content (article or
   main element), inside furniture (navigation, header, footer, sidebar, form, advert,
   notice, reader comments; by element, role, class or id), or neither.
2. Pages are range-partitioned and sorted by host and URL path, so the nearest URLs of a
   host are neighbours.  A run of pages nearly the same as its first one (``ALIKE`` of the
   text) is a class; each page is aligned with the first page of the class before and
   after its own by the longest common subsequence of its lines (64-bit line hashes);
   aligned lines are shared.  Copies are never aligned with each other.  Classes that
   reach or cross partition borders meet in a second pass: the class to meet is found
   from at most four rows per partition and broadcast, two rows per partition.
3. The text is the lines in order without furniture and without shared lines.  A shared
   line of the main content stays: neighbours may quote or repeat parts of one article,
   and differencing alone would then delete the article itself.

Only line hashes are written and shuffled for the alignment, never the lines, so a hot host
is spread over many partitions and copies of it cost a few bytes a line.  The pages are read
twice: parsing again costs less than keeping the lines.

Defined results: null or empty html gives an empty text; a null or odd URL has an empty
host and its own text as path; equal URLs are neighbours in page_id order; repeated
rows are treated as pages of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bytewords as bw
from .workers import ready

MAIN, FURNITURE, NEITHER = 1, 2, 0
#: Pages that share this part of their text (bytes of the article, or of all but furniture) are nearly the same.
ALIKE = 0.9

_RAW = frozenset("script style noscript template iframe svg math object canvas audio video title head textarea select button datalist".split())
_TEXT_ONLY = frozenset("script style title head textarea iframe noscript".split())
_NESTING = frozenset("svg math object template".split())
_BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr label strike big acronym nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended comment comments disqus respond replies pagination pager toolbar widget skip".split()
)
_MAIN_WORDS = frozenset("article articlebody".split())
_COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
_LIST_WORDS = frozenset("related recommended".split())
#: Words that name furniture whatever follows them, unless that tells a state of the page (sidebar-layout, nav-open).
_PLAIN_WORDS = frozenset("ad ads advert nav navbar sidebar footer masthead topbar breadcrumb breadcrumbs cookie gdpr newsletter disqus pagination pager toolbar".split())
_STATE_WORDS = frozenset("layout open opened closed collapsed expanded active enabled disabled fixed visible hidden page body theme template on off content".split())
#: Other words of a furniture name, before and after the one that names it.
_PLACE_WORDS = frozenset("site page main top bottom left right primary secondary global local user post entry article header head mobile desktop sub inner outer the js wp fb google sticky fixed floating side email".split())
_PART_WORDS = frozenset(
    "area author authors bar bars block blocks body bottom box boxes btn button buttons card cards center close col column container content desktop footer form "
    "frame group head header heading icon icons inline inner item items label large left link links list lists main meta mobile module panel post posts article "
    "articles primary right row secondary section sections settings slot small space stories story text title top ul unit units wrap wrapper zone".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


# zones while reading: furniture by class or id, which an article or main element inside it ends; the same for lists
# of other articles, whose articles are the main content only of a page that has no other
_SOFT, _LISTED, _LISTED_MAIN = 3, 4, 5


@lru_cache(1 << 14)
def _furniture_words(token: str) -> frozenset[str]:
    """Words by which a class or id names furniture: the token has them, and its other words tell only place, part or number."""
    words = [w for w in re.split(r"[_-]+", token) if w]
    hits = [i for i, w in enumerate(words) if w in _FURNITURE_WORDS]
    if not hits or any(w not in _PLACE_WORDS for w in words[: hits[0]]):
        return frozenset()
    rest = [w for w in words[hits[0] :] if w not in _FURNITURE_WORDS and not any(c.isdigit() for c in w)]
    if not all(w in _PART_WORDS for w in rest) and (words[hits[0]] not in _PLAIN_WORDS or any(w in _STATE_WORDS for w in rest)):
        return frozenset()
    if words[0] in ("sidebar", "nav", "navbar") and words[-1] in ("content", "body"):  # layouts: sidebar-content
        return frozenset()
    return frozenset(words[i] for i in hits)


def _zone(tag: str, attrs: str, inside: int) -> int:
    """Zone of an element opened inside zone ``inside``; furniture holds whatever is in it, but see _SOFT."""
    if inside == FURNITURE:
        return FURNITURE
    within = inside in (MAIN, _LISTED_MAIN)
    if tag in _FURNITURE_TAGS or (tag == "header" and not within):
        return FURNITURE
    names: set[str] = set()
    furniture: set[str] = set()
    main = tag in ("article", "main")
    if attrs:
        for key, *values in _ATTR.findall(attrs):
            words = "".join(values).lower()
            if key.lower() == "role":
                if words in _FURNITURE_ROLES:
                    return FURNITURE
                main |= words in ("main", "article")
            else:
                names.update(re.split(r"[\s_-]+", words))
                for token in words.split():
                    furniture |= _furniture_words(token)
    if furniture & _COMMENT_WORDS and not (main and tag != "article"):
        return FURNITURE
    if main:
        return _LISTED_MAIN if inside in (_LISTED, _LISTED_MAIN) and tag == "article" else MAIN
    if tag not in ("body", "html") and furniture:
        return _LISTED if furniture & _LIST_WORDS or inside in (_LISTED, _LISTED_MAIN) else _SOFT
    if inside in (_SOFT, _LISTED) or within:
        return inside
    return MAIN if names & _MAIN_WORDS else NEITHER


def _raw_ends(page: str, tag: str) -> dict[int, int]:
    """End of each closed element of a raw kind by the end of its start tag."""
    ends: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", page, re.I):
        if m.group(1):
            if open_:
                ends[open_.pop()] = m.end()
        elif not m.group(2).endswith("/"):
            if tag not in _NESTING:  # a second start ends the first
                open_.clear()
            open_.append(m.end())
    return ends


def read_lines(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of the lines of a page, in order."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = NEITHER
    raw: int | None = None  # place in the stack of an unclosed raw element
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        if parts:
            line = " ".join(htmllib.unescape("".join(parts)).split())
            parts.clear()
            if line:
                out.append((line, zone))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:  # comment or declaration
            continue
        tag, attrs = m.group(2).lower(), m.group(3)
        if m.group(1):
            if tag in _INLINE and not (stack and stack[-1][0] == tag):
                continue
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    zone = stack[-1][1] if stack else NEITHER
                    if raw is not None and i <= raw:
                        raw = None
                    break
            continue
        if tag in _RAW:
            flush()
            if attrs.endswith("/"):
                continue
            if tag in _TEXT_ONLY:
                end = None
                if tag not in ends:
                    end = re.compile(rf"</{tag}\s*>|</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    if end is None:
                        ends[tag] = {}
                to = end.end() if end else -1
            else:
                if tag not in ends:
                    ends[tag] = _raw_ends(page, tag)
                to = ends[tag].get(at, -1)
            if to >= 0:
                at = to
            elif tag in ("script", "style"):
                break
            elif tag != "head":  # not closed: up to the next block or the end of its parent
                raw = len(stack) if raw is None else raw
                stack.append((tag, FURNITURE))
                zone = FURNITURE
            continue
        if raw is not None and tag in _BLOCKS:
            flush()
            del stack[raw:]
            raw, zone = None, stack[-1][1] if stack else NEITHER
        if tag in _INLINE:
            if not _hidden_inline(attrs):
                continue
        flush()
        if tag in _VOID or attrs.endswith("/"):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # closed by the next of its kind
            if stack and stack[-1][0] == tag:
                stack.pop()
                zone = stack[-1][1] if stack else NEITHER
        inner = _zone(tag, attrs, zone)
        stack.append((tag, inner))
        zone = inner
    flush()
    listed = FURNITURE if any(z == MAIN for _, z in out) else MAIN
    return [(t, z if z <= FURNITURE else listed if z == _LISTED_MAIN else FURNITURE) for t, z in out]


def _hidden_inline(attrs: str) -> bool:
    """An inline element whose class or id names furniture opens a zone of its own."""
    return bool(attrs) and any(_furniture_words(t) for k, *v in _ATTR.findall(attrs) if k.lower() != "role" for t in "".join(v).lower().split())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path without query, fragment and ending slash)."""
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)([^?#]*)", url or "")
    return (m.group(1).lower(), m.group(2).rstrip("/")) if m else ("", url or "")


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Booleans over ``a``: the places of one longest common subsequence with ``b``."""
    out = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    head = int((np.append(a[:n] == b[:n], False)).argmin())
    tail = int((np.append(a[::-1][: n - head] == b[::-1][: n - head], False)).argmin())
    out[:head] = True
    if tail:
        out[len(a) - tail :] = True
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    keep = np.flatnonzero(np.isin(x, y))  # other lines can't be common
    y = y[np.isin(y, x)]
    if len(keep):
        out[head + keep[_lcs(x[keep].tolist(), y.tolist())]] = True
    return out


def _lcs(a: list, b: list) -> list[int]:
    """Places in ``a`` of an LCS: bit-parallel rows with trace-back, halving ``a`` (Hirschberg) beyond 64 MB of rows."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > 1 << 29:
        half = len(a) // 2
        left = _lengths(a[:half], b)
        right = _lengths(a[half:][::-1], b[::-1])
        cut = int((left + right[::-1]).argmax())
        return _lcs(a[:half], b[:cut]) + [half + i for i in _lcs(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    out, j = [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # bits that are 0 mark places where the length grows; a[i] is used if row i has one at or below j that row i-1 lacks
        now = ~rows[i] & ((1 << (j + 1)) - 1)
        before = ~rows[i - 1] & ((1 << (j + 1)) - 1) if i else 0
        if now.bit_count() > before.bit_count():
            out.append(i)
            j = now.bit_length() - 1
            while j >= 0 and b[j] != a[i]:
                j -= 1
            j -= 1
            if j < 0:
                break
    return out[::-1]


def _rows(a: list, b: list) -> Iterator[int]:
    masks: dict = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """LCS lengths of ``a`` with every beginning of ``b`` (len(b) + 1 values)."""
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the alignment needs of each page: its place in URL order, the hashes of its lines and their weights."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            hashes, weights, urls = [], [], [split_url(u) for u in part.column("url").to_pylist()]
            for page in part.column("html"):
                lines = read_lines(page.as_py())
                raw = [t.encode() for t, _ in lines]
                size = np.array([len(r) for r in raw], dtype=np.int64)
                ends = np.cumsum(size)
                sums = bw.prefix_sums(bw.BYTE_CODES[np.frombuffer(b"".join(raw), np.uint8)])
                hashes.append(bw.span_hashes(sums, ends - size, ends).tobytes())
                zones = np.array([z for _, z in lines], np.int8)
                # pages with an article are told apart by it alone (negative: main content)
                weights.append(np.where(zones == FURNITURE, 0, np.where(zones == MAIN, -size, size)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in ("uid", "page_id")],
                    *[pa.array([u[i] for u in urls], pa.string()) for i in (0, 1)],
                    *[pa.array(x, pa.binary()) for x in (hashes, weights)],
                ],
                names=["uid", "page_id", "host", "path", "hashes", "weights"],
            )


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines' zones, and the lines that may be kept, compressed for the shuffle to the alignment's result."""
    pack = zstandard.ZstdCompressor(level=6)
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            lines = [read_lines(page.as_py()) for page in part.column("html")]
            zones = [bytes(z for _, z in page) for page in lines]
            kept = [pack.compress("\n".join(t for t, z in page if z != FURNITURE).encode()) for page in lines]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("uid", "page_id", "url")], pa.array(zones, pa.binary()), pa.array(kept, pa.binary())],
                names=["uid", "page_id", "url", "zones", "body"],
            )


class Skeleton:
    """A page's host, line hashes and line weights."""

    def __init__(self, host: str, hashes: bytes, weights: bytes) -> None:
        self.host, self.hashes, self.weights = host, hashes, weights
        self.h, self.w = np.frombuffer(hashes, np.uint64), np.frombuffer(weights, np.int32).astype(np.int64)

    def against(self, other: Skeleton | None) -> tuple[np.ndarray | None, bool]:
        """(places in this page of the lines it shares with ``other``, whether the two are nearly the same page)."""
        if other is None or other.host != self.host:
            return None, False
        if other.hashes == self.hashes:
            return None, True
        marks = common_lines(self.h, other.h)
        x, y = self.w, other.w
        if (x < 0).any() and (y < 0).any():
            x, y = np.minimum(x, 0), np.minimum(y, 0)
        x, y = np.abs(x), np.abs(y)
        alike = int(x[marks].sum()) >= ALIKE * max(int(x.sum()), int(y.sum()))
        return np.flatnonzero(marks).astype(np.int32), alike

    def shared(self, other: Skeleton | None) -> np.ndarray:
        """Places of the lines shared with ``other``; none if it is nearly the same page, whose text would go with them."""
        places, alike = self.against(other)
        return _NONE if places is None or alike else places


_NONE = np.zeros(0, np.int32)
_LEAD, _TRAIL = 1, 2  # a page's class is the first or last of its partition


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in URL order: the places each shares with the class of pages before or after its own.

    A class is a run of pages nearly the same as its first one.  Pages of a partition's first and last class
    carry their skeleton, and up to four rows without uid tell the first pages of the classes at either end.
    """
    rows: list[tuple] = []
    before: Skeleton | None = None  # first page of the class before the open one
    first: Skeleton | None = None  # of the open class
    members: dict[bytes, tuple[Skeleton, set[int]]] = {}  # of the open class, one entry for equal pages
    ends: dict[int, Skeleton] = {}
    part, n_classes = 0, 0

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.binary(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_ALIGNED)
        rows.clear()
        return out

    def close(after: Skeleton | None) -> Iterator[pa.RecordBatch]:
        edge = (_LEAD if n_classes == 1 else 0) | (_TRAIL if after is None else 0)
        for page, uids in members.values():
            places = np.union1d(page.shared(before), page.shared(after)).astype(np.int32).tolist()
            kept = (page.host, page.hashes, page.weights) if edge else (None, None, None)
            for uid in uids:
                rows.append((uid, part, places, edge, *kept))
                if len(rows) >= 1000:
                    yield batch()
        members.clear()

    for b in batches:
        for row in b.to_pylist():
            page, part = Skeleton(row["host"], row["hashes"], row["weights"]), row["part"]
            if first is None or not ((page.host, page.hashes) == (first.host, first.hashes) or page.hashes in members and page.host == first.host or page.against(first)[1]):
                if first is not None:
                    yield from close(page)
                before, first = first, page
                n_classes += 1
                if n_classes <= 2:
                    ends[n_classes - 1] = page
            members.setdefault(page.hashes, (page, set()))[1].add(row["uid"])
    if first is not None:
        yield from close(None)
        if n_classes > 1:
            ends |= {2: before, 3: first}
        rows.extend((None, part, [], kind, s.host, s.hashes, s.weights) for kind, s in ends.items())
        yield batch()


_ALIGNED = ["uid", "part", "shared", "edge", "host", "hashes", "weights"]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the ends of all partitions in order: the page that a partition's first (last) class meets before (after) it."""
    ends: dict[int, dict[int, Skeleton]] = {}
    for b in batches:
        for row in b.to_pylist():
            ends.setdefault(row["part"], {})[row["edge"]] = Skeleton(row["host"], row["hashes"], row["weights"])
    found: list[tuple] = []
    # kinds: 0 first class, 1 the one after it, 2 the one before the last, 3 last class; a partition of one class has 0 only
    for side, near, far, beyond in ((_LEAD, 0, 3, 2), (_TRAIL, 3, 0, 1)):
        first: Skeleton | None = None  # class open at the border, and the one beyond it
        other: Skeleton | None = None
        for part in sorted(ends, reverse=side == _TRAIL):
            e = ends[part]
            here = e.get(near, e[0])
            same = first is not None and here.against(first)[1]
            target = other if same else first
            if target is not None and target.host == here.host:
                found.append((part, side, target.host, target.hashes, target.weights))
            if 3 in e:
                first, other = e[far], e[beyond]
            elif not same:
                first, other = here, first
    types = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=["part", "side", "m_host", "m_hashes", "m_weights"]
    )


def _align_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages at partition borders share with the class they meet in another partition."""
    for b in batches:
        done: dict[tuple, list[int]] = {}
        shared = []
        for r in b.to_pylist():
            key = (r["hashes"], r["m_hashes"], r["host"])
            if key not in done:
                met = Skeleton(r["m_host"], r["m_hashes"], r["m_weights"])
                done[key] = Skeleton(r["host"], r["hashes"], r["weights"]).shared(met).tolist()
            shared.append(done[key])
        yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(shared, pa.list_(pa.int32()))], names=["uid", "shared"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        unpack = zstandard.ZstdDecompressor()
        texts, gone = [], []
        for zones, body, shared in zip(b.column("zones"), b.column("body"), b.column("shared")):
            places = [i for i, z in enumerate(zones.as_py()) if z != FURNITURE]
            lines = unpack.decompress(body.as_py()).decode().split("\n") if places else []
            cut = set(shared.as_py() or ())
            kept = [t for i, t in zip(places, lines) if i not in cut or zones.as_py()[i] == MAIN]
            texts.append(" ".join(kept))
            gone.append(len(zones.as_py()) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(gone, pa.int64())],
            names=["page_id", "url", "text", "lines_cut"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, lines_cut of every page."""
    spark = pages.sparkSession
    ready(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    # a key that a second reading of the pages gives again; equal rows share it and what they share with neighbours
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("uid"), "page_id", "url", "html")
    skeletons = written(
        keyed.mapInArrow(_skeletons, f"uid long, page_id {kind}, host string, path string, hashes binary, weights binary"), "page-skeletons"
    )
    ordered = (
        skeletons.repartitionByRange("host", "path", "page_id", "uid")
        .sortWithinPartitions("host", "path", "page_id", "uid")
        .select("uid", "host", "hashes", "weights", F.spark_partition_id().alias("part"))
    )
    aligned = written(
        ordered.mapInArrow(_align, "uid long, part int, shared array<int>, edge int, host string, hashes binary, weights binary"), "page-shared"
    )
    met = (
        aligned.where("uid IS NULL")
        .select("part", "edge", "host", "hashes", "weights")
        .coalesce(1)  # at most four rows per partition
        .mapInArrow(_meet, "part int, side int, m_host string, m_hashes binary, m_weights binary")
    )
    edges = (
        aligned.where("uid IS NOT NULL AND edge > 0")
        .select("uid", "part", "edge", "host", "hashes", "weights")
        .join(F.broadcast(met), "part")  # at most two rows per partition
        .where(F.col("edge").bitwiseAND(F.col("side")) > 0)
        .select("uid", "host", "hashes", "weights", "m_host", "m_hashes", "m_weights")
        .mapInArrow(_align_edges, "uid long, shared array<int>")
    )
    aligned = aligned.where("uid IS NOT NULL")
    shared = aligned.select("uid", "shared").unionByName(edges).where(F.size("shared") > 0)
    shared = shared.groupBy("uid").agg(F.flatten(F.collect_list("shared")).alias("shared"))
    bodies = keyed.mapInArrow(_bodies, f"uid long, page_id {kind}, url string, zones binary, body binary")
    joined = bodies.join(shared, "uid", "left")
    return joined.select("page_id", "url", "zones", "body", "shared").mapInArrow(
        _assemble, f"page_id {kind}, url string, text string, lines_cut long"
    )
