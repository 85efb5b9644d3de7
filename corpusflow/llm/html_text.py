"""Main text of web pages by structure and by what a host's pages repeat.

A page is cut into blocks in page order, and the blocks of all pages of a host are one stream of
tokens. Its suffixes are sorted by prefix doubling, which shows every substring of `depth` tokens or
more that several distinct pages share, at full length. What such substrings cover is boilerplate and
is removed, runs that are unique stay. Structure says where to look: blocks inside an article (or,
without one, a main element) are the text of a page that marks it, but for menus, headers, footers,
sidebars, notices, adverts, forms and comments, which tags, roles and class names tell; there only
blocks that are on most pages of the host go. On a page without a landmark repetition alone decides,
but a long run that is most of its page's text, in blocks of prose, stays: an article that several pages carry.

A host's stream is sorted in one task. A host too large for that is split by ranges of prefixes:
each task gets, of every page, the places whose prefix of `depth` tokens is in its range. Adjacent
places join to runs, so the runs covered are the same as those of the whole array.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin

DEPTH, LEAST_PAGES = 8, 3
#: A block inside an article is boilerplate if it is on so many pages and on this share of a host's rows.
MOST_PAGES, MOST_SHARE = 10, 0.5
#: Tokens of a block, on average, by which a run is prose and no menu, and of a run that can be an article.
PROSE, LONG = 20, 100
#: Characters of html of which one task sorts the suffixes, about three million tokens.
PART_CHARS = 20_000_000
#: Large hosts, and bytes of covered runs, up to which they are broadcast; more are joined by shuffle.
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 16_000_000
#: What a token is to its page: no part of its text, text that repetition decides on, text of a landmark.
ANY, OPEN, INSIDE = 0, 1, 2
#: Query parameters that do not change the page.
TRACKING = r"utm_[a-z]+|fbclid|gclid|msclkid|mc_[ce]id|ref|referrer|session_?id|phpsessid|jsessionid"
#: Elements without text of their own, that end or begin a block, that hold others.
SILENT = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|video|audio|title|button"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = frozenset(
    "address article aside blockquote body center details dialog div dl fieldset figure footer form head header hgroup h1 h2 h3 h4 h5 h6 html"
    " main menu nav ol search section table ul".split()
)
OUTSIDE = frozenset("nav footer aside form head menu dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related respond"
    " share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<silent>{SILENT})\b(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
#: Parts of class names that tell what a page or wrapper has, rather than what an element is.
STATES = frozenset("has have with without no not is".split())
REST, OTHER, MAIN, ARTICLE = 0, 1, 2, 3


def _named(value: str) -> bool:
    """Whether a class name or id is one of NAMES, or begins or ends in one, as in site-footer or ad-box."""
    for name in value.split():
        words = WORDS.findall(name)
        if words and (words[0] in NAMES or words[-1] in NAMES) and not STATES.intersection(words):
            return True
    return False


def _traits(tag: str, attrs: str) -> tuple[bool, bool, int]:
    """Whether an element is outside the main text by what it is, or by its name only, and the landmark that it begins."""
    outside, named, landmark = tag in OUTSIDE, False, {"article": ARTICLE, "main": MAIN}.get(tag, OTHER)
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                outside = True
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main") and _named(value):
                named = True
            elif name == "role" and value == "main":
                landmark = max(landmark, MAIN)
            elif name == "role" and value == "article" or name == "itemprop" and value == "articlebody":
                landmark = ARTICLE
    return outside, named, landmark


def blocks_of(html: str | None) -> list[tuple[str, int]]:
    """(text, region) of each block in page order; region is REST, OTHER, MAIN or ARTICLE.

    A name (class or id) closes an element, but not the landmarks inside it if all landmarks with
    text are inside as many such elements: so a wrapper named after its sidebar does not hide the
    article, and articles that are comments stay outside.
    """
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    # Tag, outside by what it is, names around it, region, names around its landmark.
    stack: list[tuple[str, bool, int, int, int]] = [("", False, 0, OTHER, 0)]
    source, at = html or "", 0

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, off, names, region, base = stack[-1]
                out.append((text, REST if off or names > base else region, base))

    for m in TOKEN.finditer(source):
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            if tag not in HOLDERS:
                if not m["end"] and stack[-1][0] == tag:
                    stack.pop()  # the next paragraph or item ends the one before
                if not m["end"] and m["attrs"] and any((traits := _traits(tag, m["attrs"]))[:2]):
                    _, off, names, region, base = stack[-1]
                    stack.append((tag, off or traits[0], names + traits[1], region, base))
                elif m["end"] and stack[-1][0] == tag:
                    stack.pop()
                continue
            if m["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif not m["attrs"].endswith("/"):
                outside, named, landmark = _traits(tag, m["attrs"])
                _, off, names, region, base = stack[-1]
                if tag == "header" and not off and (region < ARTICLE or outside or named):
                    outside = True
                elif tag == "header" and not off:
                    region = -ARTICLE  # of an article's own header only the headings are text
                if tag[0] == "h" and len(tag) == 2 and region < 0:
                    region = ARTICLE
                if landmark > OTHER and region > 0 and not named:
                    base = names
                stack.append((tag, off or outside, names + named, max(region, landmark) if region > 0 else region, base))
    if at < len(source):
        parts.append(source[at:])
    close()
    least = min((base for _, r, base in out if r > OTHER), default=0)
    return [(t, r if r == OTHER or r > OTHER and base == least else REST) for t, r, base in out]


def settled_text(blocks: list[tuple[str, int]]) -> str | None:
    """Text of a page with a landmark; None if there is none, and repetition has to decide."""
    top = max((r for _, r in blocks), default=REST)
    return None if top == OTHER else "\n".join(t for t, r in blocks if r == top and r > OTHER)


def token_hashes(text: str) -> list[int]:
    return [xxhash.xxh32_intdigest(t) for t in text.split()]


def page_stream(blocks: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all blocks of a page, as 16-bit hashes, and what each of them is to the page.

    Eight hashes in a row are 128 bits, so equal substrings of the least length are equal texts.
    """
    top = max((r for _, r in blocks), default=REST)
    tokens, kinds = [], []
    for text, region in blocks:
        found = token_hashes(text)
        tokens += found
        kind = ANY if region != top or region < OTHER else OPEN if top == OTHER else INSIDE
        kinds += [kind] * len(found)
    return (np.array(tokens, np.uint64) & np.uint64(0xFFFF)).astype(np.uint16), np.array(kinds, np.uint8)


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Bucket of each suffix among all, sorted to `depth` (a power of two) tokens by prefix doubling."""
    ranks = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth:
        after = np.full(len(ranks), -1, np.int64)
        after[:-width] = ranks[width:]
        ranks = np.unique(ranks * (len(ranks) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return ranks


def bucket_pages(ranks: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Of each suffix, how many distinct pages its bucket has suffixes of."""
    pairs = np.unique(ranks * (int(pages.max()) + 1) + pages)
    return np.bincount(pairs // (int(pages.max()) + 1), minlength=int(ranks.max()) + 1)[ranks]


def repeated_lengths(tokens: np.ndarray, pages: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, a length of its prefix that `least` pages share, and the pages that share `depth` tokens.

    The length is the largest of depth, 2 * depth, 4 * depth ... that is shared, or 0. Each start
    inside a longer repeat has a length of its own, so together they cover repeats at full length.
    Sorting goes on in shared buckets only: what follows a shared prefix of twice the width is itself shared.
    """
    ranks = suffix_ranks(tokens, depth)
    counts = bucket_pages(ranks, pages)
    live = counts >= least
    lengths = np.where(live, depth, 0)
    width = depth
    while live.any():
        at = np.flatnonzero(live[:-width] & live[width:]) if width < len(live) else np.empty(0, np.int64)
        live = np.zeros(len(tokens), bool)
        if len(at):
            wider = np.unique(ranks[at] * len(ranks) + ranks[at + width], return_inverse=True)[1].astype(np.int64)
            shared = bucket_pages(wider, pages[at]) >= least
            ranks[at] = wider
            live[at[shared]] = True
            width *= 2
            lengths[at[shared]] = width
    return lengths, counts


def runs_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ordered intervals (from, to) that the spans cover together."""
    if not len(starts):
        return np.empty((0, 2), np.int32)
    ends = np.maximum.accumulate(starts + lengths)
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)
    return np.stack([starts[first], ends[last]], axis=1).astype(np.int32)


def _streams(depth: int):
    """A row per page with its stream, or, on a host of several parts, a row per page and range of prefixes."""
    roll = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF for i in range(depth)], np.uint64)

    def prefixes(tokens: np.ndarray) -> np.ndarray:
        window = np.lib.stride_tricks.sliding_window_view(tokens.astype(np.uint64) + np.uint64(1), depth)
        with np.errstate(over="ignore"):
            out = np.zeros(len(window), np.uint64)
            for i in range(depth):
                out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + window[:, i] * roll[i]
            out ^= out >> np.uint64(32)
            return out * np.uint64(0x94D049BB133111EB)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, key, page, parts, n, html in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "page", "parts", "n", "html")), strict=True):
                tokens, kinds = page_stream(blocks_of(html))
                digest = xxhash.xxh64_intdigest(tokens.tobytes() + kinds.tobytes()) - (1 << 63)
                if parts <= 1:
                    rows.append((host, 0, key, page, digest, n, tokens.tobytes(), None, kinds.tobytes()))
                elif len(tokens) >= depth:
                    hashes = prefixes(tokens)
                    range_of = ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                    for part in np.unique(range_of).tolist():
                        at = np.flatnonzero(range_of == part)
                        places = np.diff(at, prepend=0).astype(np.uint32)
                        rows.append((host, part, key, page, digest, n, hashes[at].tobytes(), places.tobytes(), kinds[at].tobytes()))
            if rows:
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                names = ["host", "part", "key", "page", "digest", "n", "tokens", "places", "kinds"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return build


def _array_of_part(rows: list[dict], depth: int, least: int) -> list[tuple[str, int, bytes]]:
    """(host, key, covered runs) of the pages of one part of a host that repetition changes."""
    by_digest: dict[int, list[dict]] = {}
    for r in rows:
        by_digest.setdefault(r["digest"], []).append(r)
    groups = [by_digest[d] for d in sorted(by_digest)]  # pages of one content are one page
    whole = rows[0]["n"] or len(rows)
    most = max(MOST_PAGES, math.ceil(MOST_SHARE * whole))
    names = {p: i for i, p in enumerate(sorted({min(r["page"] for r in g) for g in groups}))}
    page = [names[min(r["page"] for r in g)] for g in groups]
    kinds = [np.frombuffer(g[0]["kinds"], np.uint8) for g in groups]
    if len(names) < least or not (len(names) >= most or any((k == OPEN).any() for k in kinds)):
        return []
    sizes = np.array([len(k) for k in kinds])
    if rows[0]["places"] is None:
        # Pages are divided by tokens that occur once, so no shared prefix spans two.
        parts = [x for i, g in enumerate(groups) for x in (np.frombuffer(g[0]["tokens"], np.uint16).astype(np.int64), np.array([65536 + i]))]
        owner = np.repeat(np.arange(len(groups)), sizes + 1)
        kind = np.concatenate([np.append(k, np.uint8(ANY)) for k in kinds])
        starts = np.concatenate([np.arange(n + 1) for n in sizes])
        lengths, counts = repeated_lengths(np.concatenate(parts), np.array(page)[owner], depth, least)
    else:
        hashes = np.concatenate([np.frombuffer(g[0]["tokens"], np.uint64) for g in groups])
        owner = np.repeat(np.arange(len(groups)), sizes)
        kind = np.concatenate(kinds)
        starts = np.concatenate([np.cumsum(np.frombuffer(g[0]["places"], np.uint32).astype(np.int64)) for g in groups])
        counts = bucket_pages(np.unique(hashes, return_inverse=True)[1].astype(np.int64), np.array(page)[owner])
        lengths = np.where(counts >= least, depth, 0)
    wanted = np.flatnonzero((kind == OPEN) & (counts >= least) | (kind == INSIDE) & (counts >= most))
    out = []
    for part in np.split(wanted, np.flatnonzero(np.diff(owner[wanted])) + 1) if len(wanted) else []:
        # Inside a landmark only prefixes of `depth` are known to be on most pages.
        reach = np.where(kind[part] == OPEN, lengths[part], depth)
        runs = runs_of(starts[part], reach).tobytes()
        out += [(r["host"], k, runs) for k, r in {r["key"]: r for r in groups[owner[part[0]]]}.items()]
    return out


def _covers(depth: int, least: int):
    def cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by host and part."""
        held: list[dict] = []

        def settle() -> pa.RecordBatch:
            found = _array_of_part(held, depth, least)
            return pa.record_batch(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())],
                names=["host", "key", "runs"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["host"], row["part"]) != (held[0]["host"], held[0]["part"]):
                    yield settle()
                    held = []
                held.append(row)
        if held:
            yield settle()

    return cover


def _own_tokens(tokens: list[str], covered: np.ndarray, depth: int) -> list[str]:
    """A block without covered runs of full depth; a shorter run goes only if it is the whole block."""
    own: list[str] = []
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and covered[j]:
            j += 1
        if j - i < depth and j - i < len(tokens):
            j = max(j, i + 1)
            own += tokens[i:j]
        i = j
    return own


def _keep_prose(blocks: list[tuple[str, int]], covered: np.ndarray, top: int) -> None:
    """Uncovers a run that is most of its page's text and reads as prose: an article that several pages carry."""
    sizes = np.array([len(t.split()) for t, _ in blocks])
    block = np.repeat(np.arange(len(blocks)), sizes)
    own = np.flatnonzero(np.array([r == top for _, r in blocks])[block])
    flags = np.concatenate(([False], covered[own], [False])).astype(np.int8)
    for a, b in zip(np.flatnonzero(np.diff(flags) == 1), np.flatnonzero(np.diff(flags) == -1), strict=True):
        if 2 * (b - a) > len(own) and b - a >= max(LONG, PROSE * len(np.unique(block[own[a:b]]))):
            covered[own[a:b]] = False


def page_text(blocks: list[tuple[str, int]], runs: list[bytes] | None, depth: int) -> str:
    """Text of a page, given the runs of its stream that repetition covers.

    On a page without a landmark covered runs go and unique ones stay. Inside a landmark a block goes
    if all of it is covered; what is outside goes anyway.
    """
    top = max((r for _, r in blocks), default=REST)
    if top < OTHER:
        return ""
    if not runs:
        return "\n".join(t for t, r in blocks if r == top)
    spans = np.concatenate([np.frombuffer(r, np.int32).reshape(-1, 2) for r in runs])
    covered = np.zeros(sum(len(t.split()) for t, _ in blocks), bool)
    for a, b in spans:
        covered[a:b] = True
    if top == OTHER:
        _keep_prose(blocks, covered, top)
    kept, at = [], 0
    for text, region in blocks:
        tokens = text.split()
        here = covered[at : at + len(tokens)]
        at += len(tokens)
        if region == top:
            own = _own_tokens(tokens, here, depth) if top == OTHER else [] if here.all() else tokens
            if own:
                kept.append(" ".join(own))
    return "\n".join(kept)


def _texts(depth: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, runs = batch.column("html").to_pylist(), batch.column("runs").to_pylist()
            texts = [page_text(blocks_of(h), r, depth) for h, r in zip(pages, runs, strict=True)]
            yield pa.record_batch({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})

    return cut


def page_identity(url: Column) -> Column:
    """Hash of a URL without fragment, tracking parameters, a slash or .html at its end: addresses of one page."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "#.*$", "")
    bare = F.regexp_replace(bare, rf"(?<=[?&])(?:{TRACKING})=[^&]*(?:&|$)", "")
    return F.xxhash64(F.regexp_replace(F.regexp_replace(bare, "[?&]+$", ""), r"(?:/index)?(?:\.html?|/+)$", ""))


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    depth: int = DEPTH,
    least_pages: int = LEAST_PAGES,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """One row per row of `pages`: id_col, url_col, text.

    Character references are decoded, white space in a block becomes one space (as <br> does),
    blocks are joined by a line feed. Null or empty html gives an empty text; a null url has host "".
    Boilerplate of a host is every substring of `depth` tokens (a power of two) or more that
    `least_pages` distinct pages share: rows of one content count as one page, and so do those of one
    address (see page_identity). On pages without a landmark it is removed, unless one run of it has
    100 tokens and over half of the page's text, in blocks of 20 tokens on average. Inside an article a
    block goes if all of it is shared by half of the host's rows, and by ten pages at least. Hosts of over
    `part_chars` characters are split by ranges of prefixes, which are 64-bit hashes there. An empty table
    gives an empty result. No other columns are read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"),
        F.xxhash64(html_col).alias("key"), page_identity(F.col(url_col)).alias("page"),
    )
    sizes = rows.groupBy("host").agg(F.sum(F.length("html")).alias("chars"), F.count(F.lit(1)).alias("n"))
    large = pin(sizes.where(F.col("chars") > part_chars).select("host", F.ceil(F.col("chars") / part_chars).cast("int").alias("parts"), "n"))
    few = large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    dealt = rows.join(F.broadcast(large) if few else large, "host", "left").select("host", "key", "page", F.coalesce("parts", F.lit(1)).alias("parts"), "n", "html")
    schema = "host string, part int, key long, page long, digest long, n long, tokens binary, places binary, kinds binary"
    streams = dealt.mapInArrow(_streams(depth), schema).repartition("host", "part").sortWithinPartitions("host", "part", "digest")
    found = pin(streams.mapInArrow(_covers(depth, least_pages), "host string, key long, runs binary"))
    covers = found.groupBy("host", "key").agg(F.collect_list("runs").alias("runs"))
    size = found.agg(F.coalesce(F.sum(F.length("runs") + F.length("host") + 16), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(covers) if size <= BROADCAST_BYTES else covers, ["host", "key"], "left").select("id", "url", "html", "runs")
    return joined.mapInArrow(_texts(depth), "id long, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
