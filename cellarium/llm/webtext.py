"""Main text of HTML pages by structure and the suffix array of each host.

Pages are parsed once into blocks of text. Structure says what may be main text: the article (else main,
else body) without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments. The blocks that it leaves, as token streams one after the other, are a host's text. Of its suffix
array the ranges matter whose suffixes have a common prefix of DEPTH tokens or more and come from enough
distinct pages: MIN_PAGES, and SHARE of the host's. No task could hold the array of a hot host. But all
tokens of such a prefix occur on as many pages, so tokens are counted first (in BUCKETS a host, which lets a few more through), then the suffixes are ranked, by hashes of
their first DEPTH tokens, that begin with frequent tokens only: few of all. Both counts are
distributed sums; what is frequent on a host is bounded by a page's tokens over SHARE. On each page
neighbouring positions in frequent ranges join to maximal repeated substrings; a block covered by them
goes, unique runs stay. A page whose article or main would lose most of its text to repeats is a copy of other
pages, not boilerplate, and keeps it.

Defined results: null or empty html, and pages without text, give an empty string. Repeated rows are
extracted one by one; pages of the same text count as one. A null url belongs to the host with no name. Very
long pages are read whole; an empty table stays empty. No result depends on the partitioning.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import table, written

DEPTH = 8
SHARE = 0.3
MIN_PAGES = 5
COVERED = 0.8
BUCKETS = 1 << 13
#: Hashes that are broadcast (8 bytes each); more are joined.
MAX_RANGES = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option".split())
RAW = frozenset("script style noscript template textarea svg iframe object canvas math".split())
DROPPED = frozenset("nav footer aside form button select dialog menu title head".split())
#: Elements that are never left out for their class.
HOLDING = frozenset("html body".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words that mark what is not the article, as class, id and role values or parts of them.
MARKS = frozenset("ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert newsletter subscribe sidebar menu nav navigation navbar breadcrumb breadcrumbs footer comment comments reply replies respond social share sharing related popup modal login search pagination complementary contentinfo".split())
#: Parts of a value that say an element holds the page, and only has a marked part beside it.
HOLDERS = frozenset("with has no without layout page site-wrapper wrap wrapper container content body main article post entry".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[_-]+")


def _marks(attributes: str) -> set[str]:
    """What class, id and role say of an element: their values, and the parts of hyphened ones that don't name a holder."""
    found: set[str] = set()
    if "=" in attributes:
        for m in _ATTR.finditer(attributes):
            for value in (m[2] or m[3] or m[4] or "").lower().split():
                parts = set(_PART.split(value))
                found.add(value)
                if not parts & HOLDERS:
                    found |= parts
    return found


def blocks_of(page: str) -> list[tuple[str, int]]:
    """Blocks of text in page order, white space made one: (text, zone). Zones: 0 dropped by structure, 1 body, 2 main, 3 article."""
    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    zone_now = 1
    depth = {"article": 0, "main": 0}
    skip, skip_depth, by_mark = "", 0, False
    seen = False
    at, n = 0, len(page)

    def close() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, 0 if skip else zone_now))
            pieces.clear()

    def take(raw: str) -> None:
        pieces.append(entities.unescape(raw) if "&" in raw else raw)

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in BLOCKS and name not in DROPPED:
            if not m[1] and not skip and name not in VOID and _marks(m[3]) & MARKS:
                close()
                skip, skip_depth, by_mark = name, 1, True
            elif skip == name:
                skip_depth += -1 if m[1] else 1
                if not skip_depth:
                    close()
                    skip = ""
            continue
        close()
        if skip and (by_mark or skip == "form") and name in depth and not m[1] and not seen:
            skip = ""  # what holds the page's first article is not beside it, whatever it is called
        if skip:
            if name == skip:
                skip_depth += -1 if m[1] else 1
            if not skip_depth or skip in ("p", "li", "dt", "dd") and name != skip or skip == "head" and name == "body":
                skip = ""
            elif skip_depth > 1 and skip == "p":
                skip, skip_depth = "", 0
            if skip or m[1]:
                continue
        if m[1]:
            if name in depth and depth[name]:
                depth[name] -= 1
        else:
            marks = _marks(m[3])
            inside = depth["article"] or depth["main"]
            marked = name not in HOLDING and not (name in depth and not seen) and bool(marks & MARKS or "header" in marks and not inside)
            if name in DROPPED or marked or name == "header" and not inside:
                if name not in VOID:
                    skip, skip_depth, by_mark = name, 1, name not in DROPPED and name != "header"
            elif name in depth:
                depth[name] += 1
                seen = True
            elif "main" in marks and name in ("div", "section") and not inside:
                zone_now = 1
        zone_now = 3 if depth["article"] else 2 if depth["main"] else 1
    close()
    return out


def best_blocks(blocks: list[tuple[str, int]]) -> tuple[list[str], int]:
    """The blocks of the page's best zone, and that zone."""
    zone = max((z for _, z in blocks), default=0)
    return [t for t, z in blocks if z == zone and z], zone


def parsed(pages: DataFrame) -> DataFrame:
    """(rid, page_id, url, host, blocks, zone, stream) of each row; stream is a hash of its tokens, null for less than DEPTH of them. rid numbers the rows."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = [best_blocks(blocks_of(h) if h else []) for h in b.column("html").to_pylist()]
            words = [" ".join(t).split() for t, _ in rows]
            streams = [xxhash.xxh3_64_intdigest("\n".join(w)) >> 1 if len(w) >= DEPTH else None for w in words]
            columns = [b.column(c) for c in ("rid", "page_id", "url", "host")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in rows], pa.list_(pa.string())), pa.array([z for _, z in rows], pa.int32()), pa.array(streams, pa.int64())], names=["rid", "page_id", "url", "host", "blocks", "zone", "stream"])

    host = F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", host.alias("host"), "html")
    return written(rows.mapInArrow(parse, f"rid bigint, page_id {kind}, url string, host string, blocks array<string>, zone int, stream bigint"), "parsed", "zstd")


def _sum_by_host(rows: DataFrame, own) -> DataFrame:
    """(host, h, n): the rows of each host that have a hash h, from batches of rows by a function to (host, hashes) pairs. Tasks sum first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for host, each in seen.items():
                h, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(h), pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["host", "h", "n"])

        for b in batches:
            for host, h in own(b):
                if len(h):
                    seen.setdefault(host, []).append(np.unique(h))
                    size += len(h)
            if size > 4_000_000:
                yield from flushed()
                seen, size = {}, 0
        yield from flushed()

    return rows.mapInArrow(counted, "host string, h bigint, n bigint").groupBy("host", "h").agg(F.sum("n").alias("n"))


def _of_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows with their host's columns; hosts is broadcast where it holds MAX_RANGES hashes at most."""
    small = (hosts.agg(F.sum(F.size("hs"))).first()[0] or 0) <= MAX_RANGES
    return rows.join(F.broadcast(hosts) if small else hosts, "host")


def _tokens(blocks: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for t in blocks for w in t.split()], np.uint64)


def prefixes(h: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Hashes of the first `depth` tokens of every suffix of a stream of token hashes that has so many."""
    if len(h) < depth:
        return np.zeros(0, np.int64)
    out = np.zeros(len(h) - depth + 1, np.uint64)
    for k in range(depth):
        out = (out ^ h[k : k + len(out)]) * _STEP
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def frequent(rows: DataFrame, least: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hs): the prefix hashes of the ranges of each host's suffix array that enough distinct pages have, from rows of parsed()."""
    each = rows.filter("stream is not null").groupBy("host", "stream").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n"))
    each = written(each, "streams")
    need = F.greatest(F.lit(least), F.ceil(share * F.count(F.lit(1)))).cast("bigint")
    hosts = written(each.groupBy("host").agg(need.alias("need"), F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least).select("host", "need"), "hosts")
    again = each.filter("n > 1")
    copies = written(rows.select("rid", "host", "stream").join(again, ["host", "stream"]).filter("rid <> first").select("rid"), "copies")
    few = copies.limit(MAX_RANGES + 1).count() <= MAX_RANGES
    once = rows.filter("stream is not null").join(F.broadcast(copies) if few else copies, "rid", "left_anti").select("host", "blocks")

    def chosen(counts: DataFrame) -> DataFrame:
        return counts.join(hosts, "host").filter("n >= need").groupBy("host").agg(F.collect_list("h").alias("hs"))

    def words(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        for host, blocks in zip(b.column("host").to_pylist(), b.column("blocks").to_pylist(), strict=True):
            yield host, (_tokens(blocks) % np.uint64(BUCKETS)).astype(np.int64)

    tokens = written(chosen(_sum_by_host(once.join(hosts.select("host"), "host", "left_semi"), words)), "tokens")

    def suffixes(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        for host, blocks, hs in zip(b.column("host").to_pylist(), b.column("blocks").to_pylist(), b.column("hs"), strict=True):
            h = _tokens(blocks)
            common = np.isin((h % np.uint64(BUCKETS)).astype(np.int64), hs.values.to_numpy(zero_copy_only=False))
            run = np.convolve(common, np.ones(DEPTH, np.int64), "valid") == DEPTH
            yield host, prefixes(h)[run]

    return written(chosen(_sum_by_host(_of_hosts(once, tokens), suffixes)), "ranges")


def main_text(blocks: list[str], zone: int, starts: np.ndarray, depth: int = DEPTH) -> str:
    """The blocks that repeats don't cover, joined by line ends. starts: the prefix hashes of the repeats of the page's host."""
    ends = np.cumsum([0, *(len(t.split()) for t in blocks)])
    hits = np.flatnonzero(np.isin(prefixes(_tokens(blocks), depth), starts))
    cover = np.zeros(int(ends[-1]) + depth + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + depth, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: int(ends[-1])] > 0)])
    kept = [t for t, a, b in zip(blocks, ends[:-1], ends[1:], strict=True) if covered[b] - covered[a] < COVERED * (b - a)]
    if zone > 1 and 2 * sum(map(len, kept)) < sum(map(len, blocks)):
        kept = blocks
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of rows of page_id, url and html."""
    rows = parsed(pages)
    repeats = frequent(rows)

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for blocks, zone, hs in batches:
            yield pa.array([main_text(b, z, h.values.to_numpy(zero_copy_only=False)) for b, z, h in zip(blocks.to_pylist(), zone.to_pylist(), hs, strict=True)], pa.string())

    whole = rows.join(repeats.select("host"), "host", "left_anti").select("page_id", "url", F.array_join("blocks", "\n").alias("text"))
    cut = _of_hosts(rows, repeats).select("page_id", "url", cleaned(F.col("blocks"), F.col("zone"), F.col("hs")).alias("text"))
    return whole.unionByName(cut).withColumn("n_chars", F.length("text").cast("bigint"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extracted(table(spark, sf_dir, "pages"))
