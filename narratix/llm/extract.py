"""Main text of web pages: structure first, then repeated passages by suffix arrays over a host's pages.

A page is read tag by tag into blocks of text. Blocks in menus, page headers, footers, sidebars, notices, adverts, forms, comments
and hidden or unseen elements are left out; where there is an article (or main) element, only its blocks are candidates. The
candidates of a host's pages are concatenated as token streams, with a sign between blocks, and sorted by suffix: a stretch of at
least ``RUN`` tokens that occurs on enough distinct pages is boilerplate, and blocks that such stretches cover go. Outside
articles ``LOOSE`` of the host's pages (3 at least) are enough; inside an article it takes ``STRICT`` of them (10 at least), since
articles may be copied or quoted on many pages and are not to be cut. Pages whose candidates are equal are one page here, so
copies and repeated rows are no evidence, and count once in the host's pages.

A host's pages are dealt by a hash of their candidates into shards of about ``shard_bytes`` of html, and of ``PAGES`` pages where those are larger, so
a host that holds a third of all pages is spread over many tasks. The decision is the host's: a stretch on a share of all pages is
on that share of some shard's, so each shard hands on the counts of those on ``LOOSE`` of its own pages. Their sums and the most
that the other shards may add settle most stretches; the rest are counted once more over the host's pages. Then every page
is read again and judged by the stretches found, which are broadcast where they are few.

Null or empty html gives an empty text, a null url belongs to the host with the empty name, malformed or cut-off markup is read
as far as it goes. Repeated rows come out repeatedly, an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACED, joined_apart, materialize, span_hashes, text_chunks, word_spans

RUN, LOOSE, STRICT, COVER = 8, 0.1, 0.5, 0.8
#: The most hosts whose names and sizes (about 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST = 50_000
#: The fewest pages of a shard, on average; the most stretches (8 bytes each) that are broadcast, more are dealt by host and shard.
PAGES, STRETCHES = 40, 2_000_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|select|object|canvas|video|audio|math)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SCOPE = frozenset(("article", "main"))
NEVER = frozenset("head nav footer aside form button dialog menu".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments disqus reply replies widget pagination pager toolbar copyright disclaimer skip".split()
)
CONTENT = frozenset("content article main post entry story body text".split())


def blocks(page: str) -> tuple[list[str], bool]:
    """The page's candidate blocks in order, and whether they stand in an article or main element."""
    found: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements: tag, left out
    depth: dict[str, int] = {}  # open elements of each tag
    out, scope, seen_scope = 0, 0, False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((text, scope > 0))

    def close() -> None:
        nonlocal out, scope
        tag, left = stack.pop()
        depth[tag] -= 1
        out -= left
        scope -= tag in SCOPE and not out

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if not out and not m[1]:
                text = m[0]
                if text[0] != "<" or text == "<":
                    parts.append(text)
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if block:
            flush()
        elif tag in ("br", "td", "th", "wbr") and parts:
            parts.append(" ")
        if m[2]:
            if depth.get(tag):
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in VOID or m[4].endswith("/"):
            continue
        if block and stack and stack[-1][0] in ("p", "li", "dt", "dd") and (stack[-1][0] == "p" or stack[-1][0] == tag):
            close()
        left = tag in NEVER or (tag == "header" and not scope)
        if not left and m[4] and tag not in ("html", "body", *SCOPE):
            names = {y for x in NAMES.findall(m[4]) for y in re.split(r"[^a-z0-9]+", "".join(x).lower())}
            left = bool(names & FURNITURE and not names & CONTENT) or (not scope and "header" in names) or bool(HIDDEN.search(m[4]))
        if left or block:
            if tag in SCOPE and not out and not left:
                scope += 1
                seen_scope = True
            stack.append((tag, left))
            depth[tag] = depth.get(tag, 0) + 1
            out += left
    flush()
    inside = [t for t, s in found if s]
    return (inside, True) if seen_scope and inside else ([t for t, _ in found], False)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate blocks of each host's pages, equal ones once in a task and all in one shard."""
    seen = set()
    for batch in batches:
        out = []
        for host, n, x in zip(*(batch.column(c).to_pylist() for c in ("host", "n", "html")), strict=True):
            text = "\n".join(blocks(x)[0]) if x else ""
            content = _hash(f"{host}\n{text}")
            if content not in seen:
                seen.add(content)
                out.append((host, n, content % n, text))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["host", "n", "shard", "blocks"])


def repeated(tokens: np.ndarray, page: np.ndarray, least: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `run` tokens on at least so many distinct pages: where each stands first, and its number of pages.

    Ranks of prefixes double until they tell stretches of `run` tokens apart; positions in order of rank are the suffix array
    to that depth, and neighbours of equal rank share such a stretch.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, k = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while k < run:
        step = min(k, run - k)
        nxt = np.zeros(n, np.int64)
        nxt[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64)
        k += step
    order = np.argsort(rank, kind="stable")
    order = order[(order + run <= n) & (page[np.minimum(order + run - 1, n - 1)] == page[order])]
    r, p = rank[order], page[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    fresh = new.copy()
    fresh[1:] |= p[1:] != p[:-1]  # positions rise within a rank, so pages do
    pages = np.bincount(np.cumsum(new) - 1, weights=fresh).astype(np.int64)
    return order[new][pages >= least], pages[pages >= least]


def stream(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """The tokens of the rows' blocks with a sign before every block and the row of each; of each word its place there and its block."""
    ((_, buf, offsets),) = text_chunks(texts, 1 << 40)
    s, e, at = word_spans(buf, offsets, SPACED)
    if not len(s):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    breaks = np.cumsum(buf == 10)
    block = breaks[s] + row  # a new number for every block of every row
    block = np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))
    place = np.arange(len(s)) + block + 1  # a sign stands before every block
    tokens = np.full(int(place[-1]) + 1, 1, np.uint64)
    tokens[place] = span_hashes(buf, s, e)
    rows = np.zeros(len(tokens), np.int64)
    rows[place] = row
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    rows[place[first] - 1] = row[first]
    return tokens, rows, place, block


def stretch_keys(tokens: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of the stretches that begin at these places, seeded by the hash of their hosts."""
    key = seeds.astype(np.uint64)
    for j in range(RUN):
        key = (key ^ tokens[at + j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _least(share: float, pages: int) -> int:
    return int(np.ceil(share * pages - 1e-9))


def _shard(t: pa.Table) -> pa.Table:
    """Stretches on LOOSE of the shard's pages with their numbers of pages, and how many more pages an unlisted one may have; a row without key has the pages of the shard."""
    host, texts = t.column("host")[0].as_py(), t.column("blocks").combine_chunks().unique()
    rows = len(texts)
    alone = t.column("n")[0].as_py() == 1
    least = max(3, _least(LOOSE, rows)) if alone else _least(LOOSE, rows)
    tokens, page, _, _ = stream(texts)
    at, pages = repeated(tokens, page, least)
    keys = stretch_keys(tokens, at, np.full(len(at), _hash(host), np.int64))
    n = len(keys) + 1
    return pa.table({"host": pa.array([host] * n, pa.string()), "key": pa.array([None, *keys.tolist()], pa.int64()), "pages": pa.array([rows, *pages.tolist()], pa.int64()), "more": pa.array([0 if alone else least - 1] * n, pa.int64())})


def _hits(tokens: np.ndarray, rows: np.ndarray, seeds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where one of the (sorted) stretches begins, and its index."""
    if len(tokens) < RUN or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - RUN + 1] == rows[RUN - 1 :])
    key = stretch_keys(tokens, at, seeds[rows[at]])
    i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[i] == key
    return at[hit], i[hit]


def _slices(batch, step: int = 4_000_000) -> Iterator:
    """Rows of about so many bytes of html; a larger page is a slice of its own."""
    ends, lo = np.cumsum([len(x or "") for x in batch.column("html").to_pylist()]), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _parsed(batch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    got = [blocks(x) if x else ([], False) for x in batch.column("html").to_pylist()]
    return pa.array(["\n".join(t) for t, _ in got], pa.string()), np.array([s for _, s in got]), np.array([_hash(h) for h in batch.column("host").to_pylist()], np.int64)


def _recount(batch, keys: np.ndarray, kinds: np.ndarray):
    """Which of the stretches each different page of a host has."""
    seen = set()
    for part in _slices(batch):
        texts, _, seeds = _parsed(part)
        content = [_hash(f"{h}\n{x}") for h, x in zip(part.column("host").to_pylist(), texts.to_pylist(), strict=True)]
        tokens, rows, _, _ = stream(texts)
        at, i = _hits(tokens, rows, seeds, keys)
        row, i = np.divmod(np.unique(rows[at] * len(keys) + i), max(1, len(keys)))
        own = np.searchsorted(row, np.arange(len(content) + 1))
        new = [k for k, c in enumerate(content) if own[k] < own[k + 1] and c not in seen and not seen.add(c)]
        yield pa.RecordBatch.from_arrays([pa.array([content[k] for k in new], pa.int64()), pa.array([keys[i[own[k] : own[k + 1]]] for k in new], pa.list_(pa.int64()))], ["content", "keys"])


def _clean(batch, keys: np.ndarray, kinds: np.ndarray):
    """The pages without the blocks that stretches cover; those of kind 2 count inside articles too."""
    for part in _slices(batch):
        texts, scoped, seeds = _parsed(part)
        out = [x.replace("\n", "\n\n") for x in texts.to_pylist()]
        tokens, rows, place, block = stream(texts) if len(keys) else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        at, i = _hits(tokens, rows, seeds, keys)
        at = at[(kinds[i] == 2) | ~scoped[rows[at]]]
        if len(at):
            covered = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + RUN, -1)
            cover = (np.cumsum(covered)[:-1] > 0)[place]
            gone = np.bincount(block, weights=cover) >= COVER * np.bincount(block)
            owner = rows[place[np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))]]
            for p in np.unique(owner[gone]):
                out[p] = "\n\n".join(x for x, g in zip(out[p].split("\n\n"), gone[owner == p], strict=True) if not g)
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c := part.column(n), pa.ChunkedArray) else c for n in ("page_id", "url")), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _with_stretches(rows: DataFrame, found: DataFrame, shards: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(rows, keys, kinds) over all rows, where keys hold all the stretches (host, key, kind) of the rows' hosts."""
    if found.count() <= STRETCHES:
        table = found.select("key", "kind").toArrow().sort_by("key")
        keys, kinds = table.column("key").to_numpy(), table.column("kind").to_numpy()

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from run(batch, keys, kinds)

        return rows.mapInArrow(mapped, schema)

    empty = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema).empty_table()

    def grouped(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("key")
        got = list(run(left, right.column("key").to_numpy(), right.column("kind").to_numpy()))
        return pa.Table.from_batches(got) if got else empty

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), F.col("n")))
    spread = found.join(shards, F.col("host") == F.col("_host")).select("host", "key", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("shard"))
    return dealt.groupBy("host", "shard").cogroup(spread.groupBy("host", "shard")).applyInArrow(grouped, schema)


def _kind(pages, total):
    """2: boilerplate anywhere; 1: outside articles; 0: not."""
    enough = lambda least, share: (pages >= least) & (pages >= F.lit(share) * total - F.lit(1e-9))
    return F.when(enough(10, STRICT), 2).when(enough(3, LOOSE), 1).otherwise(0).cast("int")


def stretches(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """host, key and kind of every stretch that is boilerplate on its host."""
    few = F.broadcast if shards.count() <= BROADCAST else lambda x: x
    parsed = rows.select("html", "host", "n").mapInArrow(_contents, "host string, n long, shard long, blocks string")
    counts = materialize(parsed.groupBy("host", "shard").applyInArrow(_shard, "host string, key long, pages long, more long"), "stretches")
    totals = counts.where("key is null").groupBy(F.col("host").alias("_host")).agg(F.sum("pages").alias("total"), F.sum("more").alias("most"))
    listed = counts.where("key is not null").groupBy("host", "key").agg(F.sum("pages").alias("low"), F.sum("more").alias("less"))
    judged = listed.join(few(totals), F.col("host") == F.col("_host")).withColumn("kind", _kind(F.col("low"), F.col("total")))
    judged = judged.withColumn("high", _kind(F.col("low") + F.col("most") - F.col("less"), F.col("total"))).where("high > 0")
    judged = materialize(judged.select("host", "key", "kind", "high", "total"), "judged")
    open_ = judged.where("kind < high")
    sure = judged.where("kind = high").select("host", "key", "kind")
    if open_.isEmpty():
        return sure
    again = _with_stretches(rows.where("n > 1"), open_, shards, _recount, "content long, keys array<long>").groupBy("content").agg(F.first("keys").alias("keys"))
    again = again.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("pages"))
    settled = open_.drop("kind").join(again, "key").select("host", "key", _kind(F.col("pages"), F.col("total")).alias("kind")).where("kind > 0")
    return sure.unionByName(materialize(settled, "settled"))


def extract(pages: DataFrame, shard_bytes: int = 400_000) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"))
    sizes = rows.groupBy(F.col("host").alias("_host")).agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("size"), F.count("*").alias("pages"))
    shards = materialize(sizes.select("_host", "pages", F.least(F.ceil((F.col("size") + 1) / F.lit(shard_bytes)), F.ceil(F.col("pages") / F.lit(PAGES))).alias("n")), "hosts")
    # hosts of one shard need no join; the others are few, or dealt apart
    several = shards.where("n > 1").select(F.col("_host").alias("host"), "n", "pages")
    dealt = rows.join(F.broadcast(several.drop("pages")), "host", "left") if several.count() <= BROADCAST else joined_apart(rows, several.drop("pages"), "host", several.select("host", F.col("pages").alias("n")), "left")
    dealt = dealt.select("page_id", "url", "html", "host", F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    kind = pages.schema["page_id"].dataType.simpleString()
    out = _with_stretches(dealt, stretches(dealt, shards), shards, _clean, f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
