"""Benchmark decontamination by latent semantic retrieval.

Passages are the texts cut every WINDOW words. A first pass over the whole corpus counts words, in SLOTS
hashed slots, for their inverse frequencies. TF-IDF passages have hashed features: each word stands for
SIGNS signed places among FEATURES. The products of all passages' features, one distributed sum over the whole
corpus, give the latent space by a randomised SVD with power iterations: every passage counts, and items take
no part in it. The words with a place in it are the VOCABULARY most frequent of the whole corpus, of MIN_COUNT
occurrences or more, and the items' own; others say nothing of what a text is about. Items are cut into pieces of WINDOW words at most, and projected. The last pass slides windows over every whole text,
projects them, and takes windows close to a piece in cosine as candidates for its item. Candidates are checked in place:
the answer, the item's rarest words that are not common to many items, of which half must be there, then the longest common subsequence
with the item's words. Beside it all items are searched as exact word sequences, since the latent
search does not take items of fewer than MIN_ITEM_WORDS words: their verbatim copies are found, changed ones
are not.

Defined results: null and empty texts match nothing; neither do items that are null or have no words. An
item of one word matches every text with that word. Items of the same words are searched once and give a
pair for each item_id, null ones too; repeated rows give one pair. The cosine of an exact match is null where the
latent search has no hit of the same lcs. Very long texts and items are searched whole, in slices that
overlap windows, not documents. An empty corpus or benchmark gives no pairs. Benchmarks of more than
BLOCK_ITEMS texts are searched block by block, so no task or driver holds more of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import begun, table, written

RANK = 128
OVERSAMPLE = 10
POWER_ITERATIONS = 2
FEATURES, SIGNS = 1024, 4
SLOTS = 1 << 16
#: Passages whose products are summed in a task, at least about: a sum takes 2 MB, these 5 MB of text.
PASSAGES_A_SUM = 25_000
WINDOW, STRIDE = 32, 16  # two strides a window
COSINE = 0.36
LCS_SHARE = 0.7
ANSWER_WORDS, ANSWER_SHARE = 6, 0.5
#: Words in more items than this number and this part of them are the items' template, not an answer.
SHARED, SHARED_PART = 3, 0.04
MIN_ITEM_WORDS = 8
BLOCK_ITEMS = 20_000
ROWS_A_BLOCK = 4
VOCABULARY, MIN_COUNT = 100_000, 4
#: Bytes of text that are taken apart and words that are counted at once, and strides and passages whose vectors are held at once.
SLICE, ROUND, PASSAGES = 1 << 20, 1024, 2048
#: Bytes that are hashed and passages whose words get their features at once, so that the arrays for it stay in the cache.
STRETCH, FEW = 1 << 16, 256
SEED = 7
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and anything outside ASCII."""
    return (raw or b"").decode("utf-8", "replace").lower().encode().translate(_KEEP).split()


def pieces_of(words: list[bytes]) -> list[list[bytes]]:
    """The stretches of an item that are searched: equal parts of at most WINDOW words."""
    k = -(-len(words) // WINDOW)
    return [words[len(words) * i // k : len(words) * (i + 1) // k] for i in range(k)]


def _powers(p: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(p, len(out), 1 << 64))])
    return out[:n]


_P = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_P, STRETCH), _powers(pow(_P, -1, 1 << 64), STRETCH)


def edges(line: bytes) -> np.ndarray:
    """Where the words between the spaces of a line start and end, in turn."""
    space = np.frombuffer(b" %b " % line, np.uint8) == 32
    return np.flatnonzero(space[1:] != space[:-1])


def hashed(line: bytes, edge: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the words between the spaces of a line: a polynomial of their bytes, mixed, found by running sums over the bytes of many words at once. edge is edges(line), where that is at hand."""
    start, end = (edges(line) if edge is None else edge).reshape(-1, 2).T
    raw, held, out, first = np.frombuffer(line, np.uint8), np.zeros(STRETCH + 1, np.uint64), np.empty(len(start), np.uint64), 0
    while first < len(start):
        at = int(start[first])
        last = max(int(np.searchsorted(end, at + STRETCH, side="right")), first + 1)
        b = raw[at : end[last - 1]]
        up, down, sums = _UP, _DOWN, held[: len(b) + 1]
        if len(b) > STRETCH:  # one word
            up, down, sums = _powers(_P, len(b)), _DOWN, np.zeros(len(b) + 1, np.uint64)
        np.multiply(b, up[: len(b)], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        own = start[first:last] - at
        h = (sums[end[first:last] - at] - sums[own]) * down[own]
        for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(m)
        out[first:last] = h ^ (h >> np.uint64(31))
        first = last
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return hashed(b" ".join(words))


def line_of(raw: bytes | None) -> bytes:
    """A text's words between spaces, as words_of() takes them."""
    raw = raw or b""
    return (raw if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()).translate(_KEEP)


class Run:
    """Some texts: their lines, the hashes of all their words, and for each word its text and its number there."""

    def __init__(self, rows: list[int], lines: list[bytes]):
        self.rows, self.lines = rows, lines
        flat = b" ".join(lines)
        edge = edges(flat)
        self.hash = hashed(flat, edge)
        before = np.searchsorted(edge[::2], np.cumsum([0, *(len(x) + 1 for x in lines)]))
        self.count = np.diff(before)
        self.text = np.repeat(np.arange(len(lines)), self.count)
        self.number = np.arange(len(self.hash)) - np.repeat(before[:-1], self.count)
        self._words: dict[int, list[bytes]] = {}

    def words(self, text: int) -> list[bytes]:
        if text not in self._words:
            self._words[text] = self.lines[text].split()
        return self._words[text]


def runs(texts: pa.Array) -> Iterator[Run]:
    rows, lines, size = [], [], 0
    for row, t in enumerate(texts):
        line = line_of(t.as_py())
        rows.append(row)
        lines.append(line)
        size += len(line) + 1
        if size >= SLICE // 2:
            yield Run(rows, lines)
            rows, lines, size = [], [], 0
    if rows:
        yield Run(rows, lines)


class Lookup:
    """Numbers of word hashes, by an open hash table."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, value, at = keys, np.arange(len(keys), dtype=np.int32), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.to[at] < 0
            self.keys[at[free]], self.to[at[free]] = left[free], value[free]
            own = (self.keys[at] == left) & (self.to[at] >= 0)
            left, value, at = left[~own], value[~own], at[~own] + 1 & self.mask

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 for those it does not have."""
        at = (h >> self.shift).astype(np.int64)
        out, other = self.to[at], np.flatnonzero((self.keys[at] != h) & (self.to[at] >= 0))
        while len(other):
            at[other] = at[other] + 1 & self.mask
            out[other] = self.to[at[other]]
            other = other[(out[other] >= 0) & (self.keys[at[other]] != h[other])]
        return out


_SIGN = np.array([-1, 1], np.float32)


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SIGNS places of each word hash among FEATURES, and their signs."""
    bits = (FEATURES - 1).bit_length()
    shift = np.arange(SIGNS, dtype=np.uint64) * np.uint64(bits + 1) + np.uint64(16)
    own = (h[:, None] >> shift).view(np.int64)
    return own & FEATURES - 1, _SIGN.take(own >> bits & 1)


class Sequences:
    """Exact search for items as word sequences. Each is looked up at its anchor, the pair of neighbouring words that fewest items have (or its only word)."""

    def __init__(self, items: list[list[bytes]]):
        often = Counter(p for words in items for p in set(zip(words, words[1:], strict=False)))
        pairs: dict[tuple[bytes, ...], dict[tuple[int, int], dict[tuple[bytes, ...], int]]] = {}
        for i, words in enumerate(items):
            at = min(range(len(words) - 1), key=lambda k: often[words[k], words[k + 1]], default=0)
            pairs.setdefault(tuple(words[at : at + 2]), {}).setdefault((at, len(words)), {})[tuple(words)] = i
        self.places = list(pairs.values())
        codes = [self._code(*([x] for x in _hashes(list(anchor)))) if len(anchor) > 1 else _hashes(list(anchor)) for anchor in pairs]
        self.find = Lookup(np.concatenate([np.zeros(0, np.uint64), *codes]))
        self.single = any(len(anchor) == 1 for anchor in pairs)

    @staticmethod
    def _code(a, b) -> np.ndarray:
        return (np.asarray(a, np.uint64) * np.uint64(_P)) ^ (np.asarray(b, np.uint64) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1))

    def search(self, run: Run, out: list[list[dict]]) -> None:
        """Adds the items that texts hold, each once a text."""
        seen: set[tuple[int, int]] = set()
        codes = [self._code(run.hash[:-1], run.hash[1:]), *([run.hash] if self.single else [])]
        for code in codes:
            found = self.find(code)
            for k in np.flatnonzero(found >= 0):
                text, number = int(run.text[k]), int(run.number[k])
                words = run.words(text)
                for (before, size), items in self.places[found[k]].items():
                    begin = number - before
                    item = items.get(tuple(words[begin : begin + size])) if begin >= 0 else None
                    if item is not None and (text, item) not in seen:
                        seen.add((text, item))
                        out[run.rows[text]].append({"item": item, "cosine": None, "lcs": 1.0, "answer": 1.0, "start": begin})


def _partial(total: np.ndarray) -> pa.RecordBatch:
    """Rows of a matrix as (block, row, v)."""
    row = np.arange(len(total))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(row // ROWS_A_BLOCK, pa.int64()), pa.array(row, pa.int64()), flat], names=["block", "row", "v"])


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that tasks emitted by _partial()."""

    def summed(rows: pa.Table) -> pa.Table:
        row = rows.column("row").to_numpy()
        order = np.argsort(row, kind="stable")
        own, start = np.unique(row[order], return_index=True)
        v = np.concatenate([c.flatten().to_numpy() for c in rows.column("v").chunks]).reshape(len(row), -1)
        v = np.add.reduceat(v[order], start, axis=0, dtype=np.float64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
        return pa.table({"row": pa.array(own, pa.int64()), "v": flat})

    out = np.zeros(shape)
    for r in parts.groupBy("block").applyInArrow(summed, "row bigint, v array<double>").collect():
        out[r["row"]] = r["v"]
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(h, n), written: the occurrences of each word hash in the whole column text, and under null the number of passages."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        held, size, passages = [], 0, 0
        for batch in batches:
            for run in runs(batch.column(0).cast(pa.binary())):
                held.append(run.hash.view(np.int64))
                size += len(run.hash)
                passages += int((-(-run.count // WINDOW)).sum())
                if size >= SLICE:
                    yield from emitted(held)
                    held, size = [], 0
        yield from emitted(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([passages], pa.int64())], names=["h", "n"])

    def emitted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return written(docs.select("text").mapInArrow(counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "words")


def frequencies(docs: DataFrame, counts: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """Occurrences by slot, and passages, of the whole column text; counts is counted(docs), where that is at hand."""
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
    rows = (counted(docs) if counts is None else counts).groupBy(slot).agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("slot").fill_null(SLOTS).to_numpy(), rows.column("n").to_numpy()
    total = np.zeros(SLOTS + 1, np.int64)
    total[at] = n
    return total[:SLOTS], int(total[SLOTS])


def weights(n: np.ndarray, passages: int) -> np.ndarray:
    """Inverse frequencies by slot."""
    return np.log1p(passages / (1.0 + n)).astype(np.float32)


def gram(texts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """T'T of the TF-IDF passages T (of length 1) of all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(idf)
    upper = ~np.tri(FEATURES, k=-1, dtype=bool)
    shape = (FEATURES // 2, FEATURES + 1)  # of as many numbers

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        idf = sent.value
        total, x, used = np.zeros((FEATURES, FEATURES)), np.zeros((PASSAGES, FEATURES), np.float32), 0
        product = np.empty((FEATURES, FEATURES), np.float32)

        def add() -> None:
            own = x[:used]
            np.add(total, np.matmul(own.T, own, out=product), out=total)
            own[:] = 0

        for batch in batches:
            for run in runs(batch.column(0).cast(pa.binary())):
                passages = -(-run.count // WINDOW)
                own, first, end = (np.cumsum(passages) - passages)[run.text] + run.number // WINDOW, 0, int(passages.sum())
                while first < end:
                    size = min(end - first, PASSAGES - used, FEW)
                    part = slice(*np.searchsorted(own, (first, first + size)))
                    at, sign = places(run.hash[part])
                    at += (own[part] - first)[:, None] * FEATURES
                    sign *= idf[run.hash[part] % np.uint64(SLOTS)][:, None]
                    rows = x[used : used + size]
                    np.add.at(rows.reshape(-1), at.ravel(), sign.ravel())
                    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
                    first, used = first + size, used + size
                    if used == PASSAGES:
                        add()
                        used = 0
        add()
        yield _partial(total.astype(np.float32)[upper].reshape(shape))

    out = np.zeros((FEATURES, FEATURES))
    out[upper] = _added(texts.mapInArrow(products, "block bigint, row bigint, v array<float>"), shape).ravel()
    return out + np.triu(out, 1).T


def drawn(docs: DataFrame, passages: int, least: int = PASSAGES_A_SUM) -> DataFrame:
    """The texts that the latent space is fitted on: all of docs, in tasks of about `least` of the passages or more."""
    return docs.select("text").coalesce(max(1, passages // least))


def _taken(groups: DataFrame, most: int) -> tuple[int | None, int]:
    """The last of the groups (key, in their order, and size) of which those up to it reach `most` rows, and the rows before it; null where all are fewer."""
    total = 0
    for r in groups.collect():
        if total + r["size"] >= most:
            return r["key"], total
        total += r["size"]
    return None, total


def vocabulary(counts: DataFrame, most: int = VOCABULARY, least: int = MIN_COUNT) -> np.ndarray:
    """Hashes of the most frequent words of counted(), of equals those with the least hashes. No more than these and a small part of the equals at the cut leave the executors."""
    often = counts.filter(F.col("h").isNotNull() & (F.col("n") >= least))
    cut, more = _taken(often.groupBy(F.col("n").alias("key")).agg(F.count("*").alias("size")).orderBy(F.desc("key")), most)
    if cut is not None:
        part = F.shiftright("h", 48)
        last, _ = _taken(often.filter(F.col("n") == cut).groupBy(part.alias("key")).agg(F.count("*").alias("size")).orderBy("key"), most - more)
        often = often.filter((F.col("n") > cut) | (F.col("n") == cut) & (part <= last))
    rows = often.toArrow()
    h, n = rows.column("h").to_numpy(), rows.column("n").to_numpy()
    return h[np.lexsort((h, -n))][:most].view(np.uint64)


def latent_basis(texts: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """(FEATURES, rank at most): the first right singular vectors of the passages of all texts, each over its singular value, by a randomised SVD."""
    g = gram(texts, idf)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((FEATURES, min(rank + OVERSAMPLE, FEATURES))))[0]
    for _ in range(POWER_ITERATIONS):
        q = np.linalg.qr(g @ q)[0]
    values, vectors = np.linalg.eigh((s := q.T @ g @ q) + s.T)
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-5 * max(values.max(), 1e-30)]
    return (q @ vectors[:, best]) / np.sqrt(values[best] / values[best].mean()) if len(best) else np.zeros((FEATURES, 0))


class Space:
    """The latent space, a block of items in it, and what their checks need."""

    def __init__(self, ids: list, items: list[list[bytes]], idf: np.ndarray, basis: np.ndarray, words: np.ndarray):
        self.ids, self.items, self.idf, self.basis = ids, items, idf, basis.astype(np.float32)
        self.exact = Sequences(items)
        self.known = np.unique(np.concatenate([words, *(_hashes(w) for w in items)]))
        self._ready()
        pieces = [(i, piece) for i, words in enumerate(items) if len(words) >= MIN_ITEM_WORDS and self.basis.shape[1] for piece in pieces_of(words)]
        latent = [self.vectors(_hashes(piece)).sum(0) for _, piece in pieces]
        size = [np.linalg.norm(v) for v in latent]
        kept = [k for k, n in enumerate(size) if n > 1e-6]
        self.owner = np.array([pieces[k][0] for k in kept], np.int64)
        self.latent = np.array([latent[k] / size[k] for k in kept], np.float32).reshape(len(kept), self.basis.shape[1])
        self.answers, self.masks = [], []
        often = Counter(w for words in items for w in set(words))
        for words in items:
            own = sorted(w for w in set(words) if often[w] <= max(SHARED, SHARED_PART * len(items)))
            weight = dict(zip(own, idf[_hashes(own) % np.uint64(SLOTS)].tolist(), strict=True))
            self.answers.append(set(sorted(own, key=lambda w: (-weight[w], w))[:ANSWER_WORDS]))
            masks: dict[bytes, int] = {}
            for k, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)

    def vectors(self, h: np.ndarray) -> np.ndarray:
        """The weighted latent vectors of word hashes."""
        at, sign = places(h)
        out = np.zeros((len(h), self.basis.shape[1]), np.float32)
        for k in range(SIGNS):
            out += sign[:, k, None] * self.basis[at[:, k]]
        return out * self.idf[h % np.uint64(SLOTS)][:, None]

    def _ready(self) -> None:
        self.find = Lookup(self.known)
        self.table = np.zeros((len(self.known) + 1, self.basis.shape[1]), np.float32)
        rows = self.table[:-1]
        for at in range(0, len(rows), ROUND):
            rows[at : at + ROUND] = self.vectors(self.known[at : at + ROUND])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def lcs(self, item: int, words: list[bytes]) -> int:
        """Length of the longest common subsequence, bit-parallel over the item's words."""
        n = len(self.items[item])
        full, get = (1 << n) - 1, self.masks[item].get
        v = full
        for w in words:
            u = v & get(w, 0)
            v = ((v + u) | (v - u)) & full
        return n - v.bit_count()

    def search(self, texts: pa.Array) -> list[list[dict]]:
        """For each text its verified hits: item, cosine, lcs, answer, start."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        sums, words = np.empty((2, ROUND + 1, self.table.shape[1]), np.float32)
        cosines = np.empty((ROUND, len(self.owner)), np.float32)
        for run in runs(texts):
            self.exact.search(run, out)
            if not len(self.owner):
                continue
            ids = self.find(run.hash)
            own = np.flatnonzero(ids >= 0)
            # Texts start WINDOW apart, so no window spans two.
            room = run.count + WINDOW + (-run.count) % WINDOW
            base = np.cumsum(room) - room
            at = base[run.text[own]] + run.number[own]
            stride = at // STRIDE
            fresh = np.diff(stride, prepend=-1) != 0
            strides = stride[fresh]
            grid = np.full((STRIDE, len(strides)), len(self.table) - 1, np.intp)  # where no known word stands, the last row: zeros
            grid[at % STRIDE, np.cumsum(fresh) - 1] = ids[own]
            seen: dict[tuple[int, int], int] = {}
            for at in range(0, len(strides), ROUND):
                # The stride after the last is summed with it, and starts the next round again.
                part = grid[:, at : at + ROUND + 1]
                z, word = sums[: part.shape[1]], words[: part.shape[1]]
                self.table.take(part[0], 0, out=z, mode="clip")  # no row is outside; without a mode, out is filled from a copy
                for row in part[1:]:
                    z += self.table.take(row, 0, out=word, mode="clip")
                joined = np.flatnonzero(np.diff(strides[at : at + ROUND + 1]) == 1)
                z[joined] += z[joined + 1]
                z = z[:ROUND]
                near = np.matmul(z, self.latent.T, out=cosines[: len(z)])
                norm = np.sqrt(np.einsum("ij,ij->i", z, z))[:, None]
                for hit in np.flatnonzero(near >= COSINE * np.maximum(norm, 1e-9)).tolist():
                    k, piece = divmod(hit, len(self.owner))
                    text = int(np.searchsorted(base, strides[at + k] * STRIDE, side="right")) - 1
                    self._check(run, text, int(strides[at + k] * STRIDE - base[text]), int(self.owner[piece]), float(near[k, piece] / norm[k, 0]), seen, out)
        return out

    def _check(self, run: Run, text: int, at: int, item: int, cosine: float, seen: dict[tuple[int, int], int], out: list[list[dict]]) -> None:
        if at < seen.get((text, item), -1):
            return
        words, size = run.words(text), len(self.items[item])
        begin = max(at - size, 0)
        region = words[begin : at + WINDOW + size]
        answer = self.answers[item]
        share = len(answer.intersection(region)) / max(len(answer), 1)
        if share < ANSWER_SHARE:
            return
        common = self.lcs(item, region) / size
        if common >= LCS_SHARE:
            seen[text, item] = at + WINDOW + size
            out[run.rows[text]].append({"item": item, "cosine": cosine, "lcs": common, "answer": share, "start": begin})


def fit(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block: int = BLOCK_ITEMS) -> list[Space]:
    """The latent space of docs (column text) with the items of benchmark (item_id, text), a Space for every `block` texts or fewer; none without items. Their ids are lists, one for each distinct item."""
    rows = benchmark.filter("text is not null").select("item_id", "text").distinct()
    blocks = -(-rows.count() // block)
    if not blocks:
        return []
    counts = counted(docs)
    n, passages = frequencies(docs, counts)
    idf = weights(n, passages)
    known, basis = vocabulary(counts), latent_basis(drawn(docs, passages), idf, rank)
    out = []
    for b in range(blocks):
        same: dict[tuple[bytes, ...], list] = {}
        for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect():
            words = tuple(words_of(r["text"].encode()))
            if words and r["item_id"] not in (own := same.setdefault(words, [])):
                own.append(r["item_id"])
        if same:
            out.append(Space(list(same.values()), list(map(list, same)), idf, basis, known))
    return out


HITS = "array<struct<item:bigint,cosine:double,lcs:double,answer:double,start:bigint>>"


def hits_of(spark: SparkSession, space: Space, text: Column) -> Column:
    """The verified hits of a text column; item is the place in space.ids."""
    sent = spark.sparkContext.broadcast(space)
    kind = pa.list_(pa.struct([("item", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("start", pa.int64())]))

    @F.arrow_udf(HITS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begun()
        for texts in batches:
            yield pa.array(sent.value.search(texts.cast(pa.binary())), kind)

    return found(text)


def leaks(docs: DataFrame, spaces: list[Space], benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, start) of each item that a document holds, once."""
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    found = None
    for space in spaces:
        names = spark.createDataFrame([(k, i) for k, own in enumerate(space.ids) for i in own], f"item bigint, item_id {kind}")
        hits = written(docs.select("doc_id", F.explode(hits_of(spark, space, F.col("text"))).alias("h")).select("doc_id", "h.*"), "leaks")
        part = hits.join(F.broadcast(names), "item").drop("item")  # at most BLOCK_ITEMS names
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}, cosine double, lcs double, answer double, start bigint")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", "answer", "start")).alias("b"))
    return best.select("doc_id", "item_id", "b.cosine", "b.lcs", "b.answer", "b.start")


def op1_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer and start (word) of every document that holds a benchmark item."""
    docs = table(spark, sf_dir, "documents")
    benchmark = table(spark, sf_dir, "benchmark")
    return leaks(docs, fit(docs, benchmark), benchmark)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    kept = docs
    for space in fit(docs, table(spark, sf_dir, "benchmark")):
        kept = kept.filter(F.size(hits_of(spark, space, F.col("text"))) == 0)
    return kept
