"""SimHash near-duplicates by anchor-point covering.

near_duplicates links texts whose 64-bit fingerprints of three-word shingles differ in DISTANCE bits
or fewer; no link is lost. similar links texts whose sets of five-word shingles (as 32-bit hashes) are
SIMILARITY alike or more; no link is lost and none is below. Texts of one set are one from the start.
It searches twice, and the sets decide what passes of both searches.

The first search finds most links. At that similarity an eighth of all fingerprint bits differ, so it has a
fingerprint of two-word shingles, in which two like texts differ less: where one of its 32-bit parts differs
in two bits or fewer, both texts meet at an anchor of that part. Texts also meet where both least hashes of
their five-word shingles agree in one of MIN_BANDS bands: 0.64 a band at similarity 0.8, whatever the edit,
which all bands miss in one case of 3,500. Pairs that meet are compared by 128 bits of five-word shingles and
thinned to a forest, and the links left are compared by 640 bits. A longer fingerprint (SEARCH_LANES) would
change the work only: every part puts each text at 33 anchors, and with more texts more of them are shared
by chance, while the second search finds what the first does not.

The second search is exact and finds what the first lost: no meeting, a test by bits that failed, a link
that was thinned out for one that the sets refuse. All shingles have one order, rarest first. A set of n
has its first n - ceil(0.8 n) + 1 as prefix, and two sets 0.8 alike share their first common shingle in both
prefixes. There they meet, if their classes still differ and the sizes and the places of that
shingle leave room for 0.8. The order goes by counts in TALLIES ranges of hashes, so common passages
come last; what it is changes the work only.

Pairs of either search are first held against parities: each element of a set flips one bit of as many bits
as the set has elements, or more, so two sets differ in as many elements as bits at least, and those that differ in more bits than
sets of SIMILARITY may in elements are not read. No pair of SIMILARITY is lost by that. The second search
does so with PARITIES lanes before it makes rows of pairs, so that families of texts just under 0.8 make few.

Two fingerprints of 64 bits that differ in DISTANCE bits or fewer differ in at most half of that in one
of their 32-bit halves. In a half the anchors are a covering code: the Hamming code of length 31 with
one free bit, covering radius 1. Every fingerprint has its nearest anchor as home and is replicated to
each anchor within covering radius plus threshold (1 + 1), so that a close pair meets at the home of
either. Fingerprints are compared per anchor; equal ones are one class from the start, and each
anchor yields a spanning forest of its links, not all pairs. Anchors with more than CHUNK fingerprints
are dealt out as pairs of chunks, which together compare all that the anchor holds.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; texts
of one or two words are one shingle. Repeated rows share a class. A class whose ids are all null has a
null component. Very long texts are hashed whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import begun, fresh, hex64, released, settled, table, written
from cellarium.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
CHUNK = 4096
#: Anchors that are counted at once.
TALLY = 1 << 18
#: Search by two-word shingles in 64-bit lanes of two parts each; comparison by the first lanes of five-word shingles, then by all.
SEARCH_SHINGLE, SEARCH_LANES = 2, 1
CHECK_SHINGLE, CHECK_LANES, COMPARED_LANES = 5, 10, 2
#: Anchors by two least hashes each.
MIN_BANDS = 8
#: Of 128 bits. Texts of five-word similarity 0.8 differ in 19 on average (standard deviation 4).
COMPARED_DISTANCE = 34
#: Of 640 bits. Texts of five-word similarity 0.8 differ in 97 on average (standard deviation 9); the sets decide.
CHECK_DISTANCE = 128
SIMILARITY = 0.8
#: The same in whole numbers; ranges of hashes in which shingles are counted, of BLOCK each in a row.
ALIKE, TALLIES, BLOCK = (4, 5), 1 << 16, 1 << 12
#: Of a sketch: the place of its set's name, and how many 64-bit lanes of parities follow, before the set's size and the lanes of longer sets. Shingles of prefixes that are dealt out at once.
NAMED = CHECK_LANES + SEARCH_LANES + MIN_BANDS
PARITIES = 8
DEALT = 1 << 18
_LANE, _STEP = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
BITS = 31
_POSITIONS = 4096


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one whole text in UTF-8."""
    import xxhash

    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(64, np.int64)
    for at in range(0, n, _POSITIONS):
        h = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(at + _POSITIONS, n))], np.uint64)
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text column."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t.as_py()) for t in texts.cast(pa.binary())], pa.int64())

    return simhash(text)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of one lane."""
    x = h + np.uint64((lane + 1) * _LANE % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _least(h: np.ndarray, lane: int) -> int:
    """The least upper and the least lower half of one lane's hashes, as a negative number, so that it is no anchor of a part."""
    x = _mixed(h, lane)
    return (int((x >> np.uint64(32)).min()) << 32 | int((x & np.uint64(0xFFFFFFFF)).min())) - (1 << 64) | -(1 << 63)


def _bits(h: np.ndarray, lane: int) -> int:
    """The signed 64 majority bits of one lane over distinct shingle hashes."""
    totals = np.zeros(64, np.int64)
    for at in range(0, len(h), _POSITIONS):  # bytes of 0 or 1, eight to a number, hold sums of up to 255
        x = _mixed(h[at : at + _POSITIONS], lane)
        ones = np.unpackbits(x.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        totals += np.add.reduceat(ones, np.arange(0, len(x), 255), axis=0).view(np.uint8).sum(0, np.int64)
    return int(np.packbits(totals * 2 > len(h), bitorder="little").view(np.int64)[0])


def _shingles(own: np.ndarray, shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text of word hashes."""
    width = min(shingle, len(own))
    n = len(own) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(_STEP) + own[j : j + n]
    return np.unique(h)


def _set(h: np.ndarray) -> np.ndarray:
    """The upper halves of sorted hashes, sorted, each once."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    return x[np.r_[True, x[1:] != x[:-1]]]


def _name(own: np.ndarray) -> int:
    """The signed 64-bit name of a shingle set."""
    import xxhash

    digest = xxhash.xxh64_intdigest(own.astype("<u4").tobytes(), SEED)
    return digest - (digest >> 63 << 64)


def _parities(own: np.ndarray) -> tuple[list[int], list[int]]:
    """Signed lanes of bits, each whether an odd number of a set's shingles fall on it: folded to PARITIES, and doubled till there is a bit a shingle (none where PARITIES are enough)."""
    lanes = PARITIES
    while 64 * lanes < len(own):
        lanes *= 2
    bit = own * np.uint32(0x9E3779B1) >> np.uint32(8) & np.uint32(min(64 * lanes, 1 << 24) - 1)
    wide = np.packbits((np.bincount(bit, minlength=64 * lanes) & 1).astype(np.uint8), bitorder="little").view(np.int64)
    return np.bitwise_xor.reduce(wide.reshape(-1, PARITIES), axis=0).tolist(), wide.tolist() if lanes > PARITIES else []


def sketch(raw: bytes | None) -> list[int]:
    """The check lanes, the search lanes, the least hashes, and the name, the parities, the size and the wide parities of the shingle set of one whole text in UTF-8; zeros where it has no words."""
    import xxhash

    words = (raw or b"").lower().split()
    if not words:
        return [0] * (NAMED + PARITIES + 2)
    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    out, sets = [], []
    for shingle, lanes in ((CHECK_SHINGLE, CHECK_LANES), (SEARCH_SHINGLE, SEARCH_LANES)):
        h = _shingles(own, shingle)
        sets.append(h)
        out += [_bits(h, len(out) + i) for i in range(lanes)]
    whole = _set(sets[0])
    parity, wide = _parities(whole)
    return out + [_least(sets[0], len(out) + i) for i in range(MIN_BANDS)] + [_name(whole), *parity, len(whole), *wide]


def sketch_of(text: Column) -> Column:
    """The sketch of a text column."""

    @F.arrow_udf("array<bigint>")
    def lanes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begun()
        for texts in batches:
            yield pa.array([sketch(t.as_py()) for t in texts.cast(pa.binary())], pa.list_(pa.int64()))

    return lanes(text)


def shingle_set(raw: bytes | None) -> np.ndarray:
    """The distinct five-word shingles of one whole text in UTF-8, as 32-bit hashes."""
    import xxhash

    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in (raw or b"").lower().split()], np.uint64)
    return _set(_shingles(own, CHECK_SHINGLE)).view(np.int32) if len(own) else np.zeros(0, np.int32)


def shingle_set_of(text: Column) -> Column:
    """The shingle set of a text column."""

    @F.arrow_udf("array<int>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begun()
        for texts in batches:
            yield pa.array([shingle_set(t.as_py()) for t in texts.cast(pa.binary())], pa.list_(pa.int32()))

    return sets(text)


def _syndrome(x: Column) -> Column:
    """Hamming syndrome of the low 31 bits: the xor of the positions (1 to 31) of its ones."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> k & 1)
        out = out + F.when(F.bit_count(x.bitwiseAND(F.lit(mask))) % 2 == 1, 1 << k).otherwise(0)
    return out.cast("int")


def _flip(position: Column) -> Column:
    """The bit at a position from 1; no bit at position 0."""
    return F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), position - 1)).otherwise(F.lit(0).cast("bigint"))


def anchored(prints: DataFrame, lanes: list[Column], keep: list[str]) -> DataFrame:
    """(anchor, *keep, home) for each row: its home and all other anchors within radius plus threshold, of both 32-bit halves of each lane."""
    whole = F.lit(0xFFFFFFFF)
    parts = [v for lane in lanes for v in (lane.bitwiseAND(whole), F.shiftrightunsigned(lane, 32))]
    halves = F.array(*(F.struct(F.lit(i).alias("half"), v.alias("v")) for i, v in enumerate(parts)))
    rows = prints.select(*keep, F.explode(halves).alias("h")).select(*keep, "h.half", "h.v").withColumn("s", _syndrome(F.col("v"))).withColumn("base", F.col("v").bitwiseXOR(_flip(F.col("s"))))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(BITS)), lambda i: (F.col("s") > 0) & (i < i.bitwiseXOR(F.col("s"))))
    near = F.transform(pairs, lambda i: F.struct(F.col("v").bitwiseXOR(_flip(i)).bitwiseXOR(_flip(i.bitwiseXOR(F.col("s")))).alias("anchor"), F.lit(False).alias("home")))
    own = F.array(F.struct(F.col("base").alias("anchor"), F.lit(True).alias("home")), F.struct(F.col("base").bitwiseXOR(F.lit(1 << BITS)).alias("anchor"), F.lit(False).alias("home")))
    return rows.select(*keep, "half", F.explode(F.concat(own, near)).alias("a")).select((F.col("a.anchor") * len(parts) + F.col("half")).alias("anchor"), *keep, "a.home")


def _limits(distance: int) -> list[int]:
    """Distances by which a forest grows, so that its links are close ones."""
    return [distance] if distance <= 8 else [distance * k // 8 for k in (4, 5, 6, 7, 8)]


def _thinned(left: np.ndarray, right: np.ndarray, bits: np.ndarray, n: int, distance: int) -> np.ndarray:
    """Indices of links between rows 0 to n - 1 that span what all of them join, the closest first and then those to the least row."""
    root = np.arange(n)
    out = []
    for limit in _limits(distance):
        own = np.flatnonzero(bits <= limit)
        while len(own):
            ends = np.sort(np.column_stack([root[left[own]], root[right[own]]]), axis=1)
            own, ends = own[ends[:, 0] != ends[:, 1]], ends[ends[:, 0] != ends[:, 1]]
            order = np.lexsort((ends[:, 0], ends[:, 1]))
            high, first = np.unique(ends[order, 1], return_index=True)
            out.append(own[order[first]])
            root[high] = ends[order[first], 0]
            while (root != root[root]).any():
                root = root[root]
    return np.concatenate([np.zeros(0, np.int64), *out])


def _forest(fps: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between fingerprints (rows of lanes) of which one is at home, the closest first."""
    root = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    for limit in _limits(distance):
        for i in np.flatnonzero(home):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]).sum(1) <= limit)
            roots, first = np.unique(root[near], return_index=True)
            if len(roots) > 1:
                out += [(i, j) for j in near[first[roots != root[i]]]]
                root[np.isin(root, roots)] = roots[0]
        if not root.any():
            break
    ends = fps[:, 0].view(np.int64)
    return [(int(ends[i]), int(ends[j])) for i, j in out if ends[i] != ends[j]]


def _linker(lanes: list[str], distance: int, at_home: bool):
    """A function from batches of rows (key, part, *lanes, home), sorted by key, part and first lane, to links that span theirs."""
    names = ["key", "part", *lanes, *(["home"] if at_home else [])]

    def edges(key: np.ndarray, part: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        fp = np.column_stack(rest[: len(lanes)]).view(np.uint64)
        home = rest[-1].astype(bool) if at_home else np.ones(len(key), bool)
        change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[change, len(key)])
        lefts, rights, bits = [], [], []
        small = np.repeat(size <= 32, size)
        run = np.repeat(np.arange(len(size)), size)
        for s in range(1, min(32, int(size.max()))):
            hit = np.flatnonzero((run[s:] == run[:-s]) & small[s:] & (home[s:] | home[:-s]))
            differ = np.bitwise_count(fp[hit + s] ^ fp[hit]).sum(1)
            close = differ <= distance
            lefts.append(hit[close] + s)
            rights.append(hit[close])
            bits.append(differ[close])
        none = np.zeros(0, np.int64)
        left, right = np.concatenate([none, *lefts]), np.concatenate([none, *rights])
        kept = _thinned(left, right, np.concatenate([none, *bits]), len(key), distance)
        left, right = fp[left[kept], 0], fp[right[kept], 0]
        big = [e for r in np.flatnonzero(size > 32) for e in _forest(fp[change[r] : change[r] + size[r]], home[change[r] : change[r] + size[r]], distance)]
        a = np.concatenate([left, np.array([x for x, _ in big], np.int64).view(np.uint64)]).view(np.int64)
        b = np.concatenate([right, np.array([x for _, x in big], np.int64).view(np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["src", "dst"])

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        rest = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            if batch.num_rows:
                now = [np.concatenate([r, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)]) for r, n in zip(rest, names, strict=True)]
                last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
                cut = last[-1] + 1 if len(last) else 0
                rest = [x[cut:] for x in now]
                if cut:
                    yield edges(*(x[:cut] for x in now))
        if len(rest[0]):
            yield edges(*rest)

    return links_of


def tallied(rows: DataFrame) -> DataFrame:
    """(anchor, n): the rows of each anchor. Most anchors of a task have one row there, so a hash table before the shuffle would hold nearly all of them: every TALLY rows are counted by themselves instead."""

    def tally(held: list[np.ndarray]) -> pa.RecordBatch:
        anchor, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size >= TALLY:
                yield tally(held)
                held, size = [], 0
        if size:
            yield tally(held)

    return rows.select("anchor").mapInArrow(tallies, "anchor bigint, n bigint").repartition("anchor").groupBy("anchor").agg(F.sum("n").alias("n"))


def links(rows: DataFrame, lanes: list[str], distance: int, at_home: bool, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) edges that join the first lane into components, from rows of anchored()."""
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("met")).filter("met") if at_home else tallied(rows)
    busy = written(counts.filter("n > 1").select("anchor", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "anchors")
    own = F.pmod(F.xxhash64(lanes[0]), F.col("parts")).cast("int")
    part = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (F.least(j, own) * F.col("parts") + F.greatest(j, own)).cast("bigint")))
    dealt = rows.join(busy, "anchor").select(F.col("anchor").alias("key"), F.explode(part).alias("part"), *lanes, *(["home"] if at_home else []))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", lanes[0]).mapInArrow(_linker(lanes, distance, at_home), "src bigint, dst bigint")


def exact_links(each: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links of the distinct column fp at DISTANCE bits or fewer."""
    return links(written(anchored(each, [F.col("fp")], ["fp"]), "anchored"), ["fp"], DISTANCE, True, chunk)


def similar_links(each: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links of rows (fp, check, search) at CHECK_DISTANCE bits or fewer of all check lanes, among those that meet at an anchor and pass COMPARED_DISTANCE."""
    shown = each.select("fp", F.col("check")[1].alias("more"), "search")
    rows = anchored(shown, [F.col("search")[i] for i in range(SEARCH_LANES)], ["fp", "more"]).drop("home")
    rows = rows.unionByName(shown.select(F.explode(F.array_distinct(F.slice("search", SEARCH_LANES + 1, MIN_BANDS))).alias("anchor"), "fp", "more"))
    pairs = links(written(rows, "anchored"), ["fp", "more"], COMPARED_DISTANCE, False, chunk)
    pairs = written(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    one, other = (each.select(F.col("fp").alias(end), F.col("check").alias(f"{end}_check")) for end in ("src", "dst"))
    return pairs.join(one, "src").join(other, "dst").filter(_differ("src_check", "dst_check") <= CHECK_DISTANCE).select("src", "dst")


def _differ(one: str | Column, other: str | Column) -> Column:
    """The bits in which two columns of lanes differ."""
    return F.aggregate(F.zip_with(one, other, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def not_apart(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """The (src, dst) pairs whose sizes and wide parities leave room for ALIKE; each has fp, size and wide."""
    one, other = (each.select(F.col("fp").alias(end), F.col("wide").alias(f"{end}_wide"), F.col("size").alias(f"{end}_size")) for end in ("src", "dst"))
    least, most = F.least("src_size", "dst_size"), F.greatest("src_size", "dst_size")
    n = F.least(F.size("src_wide"), F.size("dst_wide"))  # sizes that may be ALIKE have as many lanes, or one has twice as many
    folded = [F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x)) for x in ("src_wide", "dst_wide")]
    near = sum(ALIKE) * _differ(*folded) <= (ALIKE[1] - ALIKE[0]) * (least + most)
    return pairs.join(one, "src").join(other, "dst").filter((ALIKE[1] * least >= ALIKE[0] * most) & near).select("src", "dst")


def alike(pairs: DataFrame, each: DataFrame, docs: DataFrame) -> DataFrame:
    """The (src, dst) pairs whose shingle sets are SIMILARITY alike or more; each has fp and the key (hash of the text) of one text of docs."""
    pairs = written(pairs, "near_pairs")
    released(docs.sparkSession)
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("fp")).distinct().join(each.select("fp", "key"), "fp")
    ends = written(ends, "ends")
    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(ends, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = written(texts.select("key", shingle_set_of(F.col("text")).alias("set")).join(ends, "key").select("fp", "set"), "sets")
    released(docs.sparkSession)
    one, other = (sets.select(F.col("fp").alias(end), F.col("set").alias(f"{end}_set")) for end in ("src", "dst"))
    both = F.size(F.array_intersect("src_set", "dst_set"))
    return pairs.join(one, "src").join(other, "dst").filter(both >= SIMILARITY * (F.size("src_set") + F.size("dst_set") - both)).select("src", "dst")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The shingle sets of batches of texts, of those repeated within a batch one."""
    begun()
    for batch in batches:
        for t in batch.column(0).cast(pa.binary()).unique():
            own = shingle_set(t.as_py()).view(np.uint32)
            if len(own):
                yield own


def counted(docs: DataFrame) -> np.ndarray:
    """How many shingles of all texts have their hash in each of TALLIES ranges."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TALLIES, np.int64)
        for own in _sets(batches):
            np.add.at(n, own >> np.uint32(16), 1)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(TALLIES // BLOCK), pa.int32()), pa.array(list(n.reshape(-1, BLOCK)), pa.list_(pa.int64()))], names=["block", "n"])

    def summed(rows: pa.Table) -> pa.Table:
        n = np.concatenate([c.flatten().to_numpy() for c in rows.column("n").chunks]).reshape(-1, BLOCK).sum(0)
        return pa.table({"block": rows.column("block")[:1].cast(pa.int32()), "n": pa.array([n], pa.list_(pa.int64()))})

    out = np.zeros((TALLIES // BLOCK, BLOCK), np.int64)
    parts = docs.select("text").mapInArrow(tally, "block int, n array<bigint>")
    for r in parts.groupBy("block").applyInArrow(summed, "block int, n array<bigint>").collect():
        out[r["block"]] = r["n"]
    return out.ravel()


def prefix(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all: one of them is in each set that is ALIKE."""
    n = len(own) - -(-ALIKE[0] * len(own) // ALIKE[1]) + 1
    key = counts[own >> np.uint32(16)].astype(np.uint64) << np.uint64(32) | own * np.uint32(0x9E3779B1)
    return own[np.argsort(key)[:n]]


def shared(docs: DataFrame) -> DataFrame:
    """(token, fp, place, size): the shingles that prefixes of two sets or more share. Most prefixes share nothing, so all are dealt out in arrays, and rows are made of what is shared only."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = 4 * n
    sent = spark.sparkContext.broadcast(np.minimum(counted(docs), (1 << 32) - 1).astype(np.uint32))
    kind = np.dtype([("token", "<u4"), ("fp", "<i8"), ("place", "<i4"), ("size", "<i4")])

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        at = rows["token"] % slices
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[first[1:], len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(at[first], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["slice", "rows"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = sent.value, [], 0
        for own in _sets(batches):
            token = prefix(own, counts)
            rows = np.empty(len(token), kind)
            rows["token"], rows["fp"], rows["place"], rows["size"] = token, _name(own), np.arange(len(token)), len(own)
            held.append(rows)
            size += len(rows)
            if size >= DEALT:
                yield deal(held)
                held, size = [], 0
        if size:
            yield deal(held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        held = [np.frombuffer(x.as_py(), kind) for batch in batches for x in batch.column("rows")]
        if not held:
            return
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["fp"], rows["token"]))]
        same = rows["token"][1:] == rows["token"][:-1]
        rows = rows[np.r_[True, ~(same & (rows["fp"][1:] == rows["fp"][:-1]))]]
        same = rows["token"][1:] == rows["token"][:-1]
        rows = rows[np.r_[False, same] | np.r_[same, False]]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part["token"], pa.int64()), *(pa.array(np.ascontiguousarray(part[c])) for c in ("fp", "place", "size"))], names=["token", "fp", "place", "size"])

    return docs.select("text").mapInArrow(dealt, "slice int, rows binary").repartition(n, "slice").mapInArrow(met, "token bigint, fp bigint, place int, size int")


def _room(place: np.ndarray, size: np.ndarray, other_place: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle is at these places may be ALIKE."""
    both = np.minimum(size - place, other_size - other_place)
    return (ALIKE[0] + ALIKE[1]) * both >= ALIKE[0] * (size + other_size)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of different roots that have _room and parities near enough, from rows (key, part, across, own, fp, root, place, size, p0, p1, ...) sorted by key, part and size; across: only with other own."""
    begun()
    names = ["key", "part", "across", "own", "fp", "root", "place", "size", *(f"p{i}" for i in range(PARITIES))]

    def pairs(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, across, own, fp, root, place, size, *lanes = x
        parity = np.column_stack(lanes).view(np.uint64)

        def fit(a, b):
            """Of index b (and of a, where it is as long) those that fit."""
            ok = np.flatnonzero((root[a] != root[b]) & ((across[a] == 0) | (own[a] != own[b])) & _room(place[a], size[a], place[b], size[b]))
            a, b = a if np.ndim(a) == 0 else a[ok], b[ok]
            differ = np.bitwise_count(parity[a] ^ parity[b]).sum(1, np.int64)
            return ok[sum(ALIKE) * differ <= (ALIKE[1] - ALIKE[0]) * (size[a] + size[b])]

        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        length = np.diff(np.r_[first, len(key)])
        run, small = np.repeat(np.arange(len(first)), length), np.repeat(length <= 32, length)
        lefts, rights, held = [], [], 0

        def found():
            a, b = fp[np.concatenate(lefts)], fp[np.concatenate(rights)]
            ends = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], names=["src", "dst"])

        for s in range(1, min(32, int(length.max()))):
            a = np.flatnonzero((run[s:] == run[:-s]) & small[s:])
            a = a[fit(a, a + s)]
            lefts.append(a)
            rights.append(a + s)
        for r in np.flatnonzero(length > 32):
            for a in range(first[r], first[r] + length[r] - 1):
                b = np.arange(a + 1, first[r] + np.searchsorted(size[first[r] : first[r] + length[r]], size[a] * ALIKE[1] // ALIKE[0], "right"))
                b = b[fit(a, b)]
                if len(b):
                    lefts.append(np.full(len(b), a))
                    rights.append(b)
                    held += len(b)
                if held >= TALLY:
                    yield found()
                    lefts, rights, held = [], [], 0
        if any(map(len, lefts)):
            yield found()

    rest = [np.zeros(0, np.int64)] * len(names)
    for batch in batches:
        if batch.num_rows:
            now = [np.concatenate([r, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)]) for r, n in zip(rest, names, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield from pairs([x[:cut] for x in now])
    if len(rest[0]):
        yield from pairs(rest)


def missed(docs: DataFrame, roots: DataFrame, chunk: int = CHUNK, parities: DataFrame | None = None) -> DataFrame:
    """(src, dst): all pairs of sets of docs that may be ALIKE, by their parities (fp, parity) too where these are given, and have different roots; a node that roots (node, root) lacks is its own."""
    known = roots.withColumnRenamed("node", "fp")
    known = known.withColumn("parity", F.lit(None).cast("array<bigint>")) if parities is None else parities.select("fp", "parity").join(known, "fp", "left")
    rows = shared(docs).join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = written(rows, "shared")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    busy = written(counts.select("token", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "tokens")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    part = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct((F.least(j, own) * F.col("parts") + F.greatest(j, own)).cast("bigint").alias("part"), (j != own).alias("across")))
    lanes = [F.coalesce(F.get("parity", F.lit(i)), F.lit(0).cast("bigint")).alias(f"p{i}") for i in range(PARITIES)]
    dealt = rows.join(busy, "token").select(F.col("token").alias("key"), F.explode(part).alias("p"), own.alias("own"), "fp", "root", "place", "size", *lanes)
    dealt = dealt.select("key", "p.*", *dealt.columns[2:])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", "size").mapInArrow(_apart, "src bigint, dst bigint").distinct()


def classes(prints: DataFrame, link=exact_links) -> DataFrame:
    """(fp, component_id) from rows of doc_id, fp and what else link takes (the least of it per fp)."""
    other = [c for c in prints.columns if c not in ("doc_id", "fp")]
    least_other = [F.min(F.struct(*other)).alias("o")] if other else []
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), *least_other), "prints")
    roots = components(link(each.select("fp", *(["o.*"] if other else []))))
    joined = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(joined.join(written(least, "least"), "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs, by fingerprints of three-word shingles at DISTANCE."""
    prints = written(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "fingerprints")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id")


def similar_pairs(each: DataFrame) -> DataFrame:
    """(src, dst) of rows (fp, check, search), fp the name of a set: what similar_links finds, and rows that agree in all of the first lane."""
    lane = F.col("check")[0].alias("lane")
    one = written(each.groupBy(lane).agg(F.min(F.struct("fp", "check", "search")).alias("o")).select("lane", F.col("o.fp").alias("least"), "o.check", "o.search"), "lanes")
    found = similar_links(one.select(F.col("lane").alias("fp"), "check", "search"))
    src, dst = (one.select(F.col("lane").alias(end), F.col("least").alias(f"{end}_fp")) for end in ("src", "dst"))
    found = found.join(src, "src").join(dst, "dst").select(F.col("src_fp").alias("src"), F.col("dst_fp").alias("dst"))
    return found.unionByName(each.select("fp", lane).join(one.select("lane", "least"), "lane").filter("fp <> least").select(F.col("least").alias("src"), F.col("fp").alias("dst")))


def similar_sets(each: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst) that join all sets of SIMILARITY or more; each has fp (the name of a set), check, search, parity, size, wide and the key of one text of docs."""
    spark = docs.sparkSession
    near = settled(spark, "near_links", lambda: alike(not_apart(settled(spark, "first", lambda: similar_pairs(each)), each), each, docs))
    return near.unionByName(settled(spark, "lost_links", lambda: alike(not_apart(settled(spark, "second", lambda: missed(docs, components(near), parities=each)), each), each, docs)))


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs, joined by pairs of SIMILARITY of their five-word shingles or more; fp is the name of the set."""
    lanes = docs.select("doc_id", F.xxhash64("text").alias("key"), sketch_of(F.col("text")).alias("l"))
    parity, size, start = F.slice("l", NAMED + 2, PARITIES), F.col("l")[NAMED + PARITIES + 1], NAMED + PARITIES + 2
    prints = written(lanes.select("doc_id", F.col("l")[NAMED].alias("fp"), F.slice("l", 1, CHECK_LANES).alias("check"), F.slice("l", CHECK_LANES + 1, SEARCH_LANES + MIN_BANDS).alias("search"), parity.alias("parity"), size.alias("size"), F.when(F.size("l") > start, F.slice("l", F.lit(start + 1), F.size("l"))).otherwise(parity).alias("wide"), "key"), "sketches")
    return prints.join(classes(prints, lambda each: similar_sets(each, docs)), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Of rows that share this id one stays; rows without an id stay only where their group has no id at all."""
    found = settled(spark, "near", lambda: similar(docs.select("doc_id", "text")))
    own, times, fp = fresh(docs, "own_id", "times", "fp")
    ids = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias(times))
    kept = docs.join(ids, F.col("doc_id") == F.col(own), "inner")
    once = kept.filter(F.col(times) == 1).select(*docs.columns)
    if not found.filter("doc_id is null or component_id is null").isEmpty():
        alone = found.filter("component_id is null").select(F.col("fp").alias(fp)).distinct()
        once = once.unionByName(docs.filter("doc_id is null").join(alone, sketch_of(F.col("text"))[NAMED] == F.col(fp), "left_semi").dropDuplicates(["text"]))
    if ids.filter(F.col(times) > 1).isEmpty():
        return once
    return once.unionByName(kept.filter(F.col(times) > 1).select(*docs.columns).dropDuplicates(["doc_id"]))
