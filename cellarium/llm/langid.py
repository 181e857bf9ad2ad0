"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
against each automaton into longest matches (a phrase ends at the first character with which it no
longer occurs in the sample). Phrase counts are normalised by the logarithm of the sample's length; the
language that needs fewest wins. Texts are parsed whole: blocks of BLOCK characters run through the
automata side by side, each as if a phrase began with it; then the phrase that really reaches into a block is
followed until it ends where one of the block's phrases ends too, from where on both agree. Languages are searched
LANGUAGES_AT_ONCE at a time, so no task holds more automata, and none is left out.

Defined results: null texts and texts without a letter give `und` with score 0. Without any labelled
row every text is `und`. Ties go to the language first in alphabetical order. Repeated rows are
predicted one by one, an empty table stays empty, and other columns are neither read nor changed. Labelled
texts longer than SAMPLE_LONGEST give their first SAMPLE_LONGEST characters to the sample.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.llm.common import table, written

SAMPLE_CHARS = 40_000
SAMPLE_DOCS = 120
SAMPLE_LONGEST = 20_000
LANGUAGES_AT_ONCE = 200
BLOCK = 2048
#: Characters times languages that are parsed at once.
GRID = 16_000_000
UNKNOWN = 0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, by state and code."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class Edges:
    """Transitions as an open hash table from (state, code) to state: 12 bytes a slot, four slots or more an edge."""

    def __init__(self, states: list[dict[int, int]], alphabet: int):
        self.alphabet = alphabet
        pairs = [(s * alphabet + c, t) for s, edges in enumerate(states) for c, t in edges.items()]
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left = np.array([k for k, _ in pairs], np.int64)
        value = np.array([t for _, t in pairs], np.int32)
        at = self._slot(left)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]
            own = self.keys[at] == left
            self.to[at[own]] = value[own]
            left, value, at = left[~own], value[~own], at[~own] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that follow, -1 for none."""
        key = (state * self.alphabet + code).astype(np.int64)
        at = self._slot(key)
        found = self.keys[at]
        out = self.to[at]
        other = np.flatnonzero(found != key)
        out[other] = -1
        other = other[found[other] >= 0]
        while len(other):
            at[other] = at[other] + 1 & self.mask
            here = self.keys[at[other]]
            hit = here == key[other]
            out[other[hit]] = self.to[at[other[hit]]]
            other = other[~hit & (here >= 0)]
        return out


def letters_only(text: str) -> str:
    """Lower-cased letters, runs of anything else as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Parser:
    """The automata of some languages in one table, and the codes of the characters they know."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        known = sorted({c for _, s in samples for c in s} | {" "})
        self.lookup = np.full(0x110000, -1, np.int32)
        for i, c in enumerate(known):
            self.lookup[ord(c)] = i + 1
            up = c.upper()
            if len(up) == 1 and up.lower() == c:
                self.lookup[ord(up)] = i + 1
        self.space = int(self.lookup[32])
        states: list[dict[int, int]] = []
        roots = []
        for _, s in samples:
            base = len(states)
            roots.append(base)
            states += [{c: t + base for c, t in edges.items()} for edges in suffix_automaton([int(self.lookup[ord(c)]) for c in s])]
        self.edges = Edges(states, len(known) + 1)
        self.roots = np.array(roots, np.int64)
        self.norm = np.array([math.log2(max(len(s), 2)) for _, s in samples])

    def codes(self, text: str) -> np.ndarray:
        """Codes of the text: letters as they are known or UNKNOWN, runs of anything else as one space; empty without a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        out = self.lookup[points]
        strange = np.flatnonzero(out < 0)
        if len(strange):
            kinds, where = np.unique(points[strange], return_inverse=True)
            out[strange] = np.array([UNKNOWN if chr(k).isalpha() else self.space for k in kinds.tolist()], np.int32)[where]
        gap = out == self.space
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        return out[keep] if (~gap).any() else out[:0]

    def phrases(self, texts: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
        """Phrases of each text's codes under each language, (language, text)."""
        k = len(self.langs)
        owner = [i for i, codes in enumerate(texts) for _ in range(0, len(codes), block)]
        blocks = [codes[at : at + block] for codes in texts for at in range(0, len(codes), block)]
        n = len(blocks)
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        sizes = np.array([len(blocks[i]) for i in order], np.int64)
        grid = np.zeros((int(sizes[0]) if n else 0, n), np.int64)
        for column, i in enumerate(order):
            grid[: len(blocks[i]), column] = blocks[i]
        root = np.repeat(self.roots[:, None], n, axis=1)
        state = root.copy()
        begins = np.zeros((len(grid), k, n), bool)
        # The heads of all blocks advance together, longest blocks first, so those that have ended drop off the end.
        live = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
        for t in range(len(grid)):
            m = live[t]
            now, c, own = state[:, :m].ravel(), np.tile(grid[t, :m], k), root[:, :m].ravel()
            at = self.edges.step(now, c)
            lost = at < 0
            # A phrase begins at a root, where the one before ended with an unknown character, and at each mismatch.
            begins[t, :, :m] = (lost | (now == own)).reshape(k, m)
            if lost.any():
                miss = np.flatnonzero(lost)
                again = self.edges.step(own[miss], c[miss])
                at[miss] = np.where(again < 0, own[miss], again)
            state[:, :m] = at.reshape(k, m)
        column = np.empty(n, np.int64)
        column[order] = np.arange(n)
        after = np.full(n, -1, np.int64)  # by column: the column of the text's next block
        for b in range(1, n):
            if owner[b] == owner[b - 1]:
                after[column[b - 1]] = column[b]
        count = self._joined(grid, sizes, begins, state, after)
        out = np.zeros((k, len(texts)), np.int64)
        np.add.at(out, (slice(None), np.array(owner, np.int64)[order]), count)
        return out

    def _joined(self, grid: np.ndarray, sizes: np.ndarray, begins: np.ndarray, state: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases of each block, (language, column), given the states in which its text really enters it.

        All blocks are followed together from the ends of those before. Where one never agrees with its own phrases, as in
        a match longer than a block, its end changes, and the block after it is followed again.
        """
        whole, ends = begins.sum(0), state.copy()
        count = whole.copy()
        before = np.flatnonzero(after >= 0)
        lang, prev = (x.ravel() for x in np.meshgrid(np.arange(len(self.langs)), before, indexing="ij"))
        while len(lang):
            own = after[prev]
            now, total, end = ends[lang, prev].astype(np.int64), whole[lang, own].astype(np.int64), state[lang, own].astype(np.int64)
            left = np.flatnonzero(now != self.roots[lang])
            counted = np.zeros(len(lang), np.int64)  # phrases that begin, less those of the block's own parse
            t = 0
            while len(left):
                over = sizes[own[left]] <= t
                if over.any():
                    gone = left[over]
                    total[gone], end[gone] = counted[gone] + whole[lang[gone], own[gone]], now[gone]
                    left = left[~over]
                    if not len(left):
                        break
                c, root, alone = grid[t, own[left]], self.roots[lang[left]], begins[t, lang[left], own[left]]
                at = self.edges.step(now[left], c).astype(np.int64)
                lost = at < 0
                begun = lost | (now[left] == root)
                agreed = begun & alone
                total[left[agreed]] = counted[left[agreed]] + whole[lang[left[agreed]], own[left[agreed]]]
                counted[left] += begun.astype(np.int64) - alone
                if lost.any():
                    miss = np.flatnonzero(lost)
                    again = self.edges.step(root[miss], c[miss])
                    at[miss] = np.where(again < 0, root[miss], again)
                now[left] = at
                left = left[~agreed]
                t += 1
            moved = end != ends[lang, own]
            count[lang, own], ends[lang, own] = total, end
            lang, prev = lang[moved & (after[own] >= 0)], own[moved & (after[own] >= 0)]
        return count

    def costs(self, texts: list[str | None]) -> np.ndarray:
        """(text, language): phrases times the logarithm of the sample's length; infinite for texts without a letter."""
        out = np.full((len(texts), len(self.langs)), np.inf)
        each = [self.codes(t) if t else np.zeros(0, np.int32) for t in texts]
        own, size = [], 0
        for i, codes in enumerate(each):
            if len(codes):
                own.append(i)
                size += len(codes) * len(self.langs)
            if own and (size > GRID or i == len(each) - 1):
                out[own] = self.phrases([each[j] for j in own]).T * self.norm
                own, size = [], 0
        if own:
            out[own] = self.phrases([each[j] for j in own]).T * self.norm
        return out


@functools.lru_cache(1)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def learn(labelled: DataFrame, chars: int = SAMPLE_CHARS, docs: int = SAMPLE_DOCS, at_once: int = LANGUAGES_AT_ONCE) -> list[tuple[tuple[str, str], ...]]:
    """(language, sample) pairs from columns doc_id, text and lang, `at_once` languages at a time.

    Per language the `docs` documents first by a seeded hash, cut at SAMPLE_LONGEST characters, until twice
    `chars` are reached, joined and cut at `chars`: the bounded sample that the automata are fitted on.
    """
    own = F.substring("text", 1, SAMPLE_LONGEST)
    fit = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", own.alias("text"), F.xxhash64(F.lit(20), "doc_id", "text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    first = fit.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= docs)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = written(first.withColumn("before", before).filter(F.col("before") < 2 * chars).select("lang", "r", "text"), "samples")
    langs = sorted(r["lang"] for r in first.select("lang").distinct().collect())
    out = []
    for at in range(0, len(langs), at_once):
        found: dict[str, list[str]] = {}
        for row in first.filter(F.col("lang").isin(langs[at : at + at_once])).orderBy("lang", "r").collect():
            found.setdefault(row["lang"], []).append(letters_only(row["text"]))
        samples = {lang: " ".join(filter(None, texts))[:chars] for lang, texts in found.items()}
        if any(samples.values()):
            out.append(tuple((lang, s) for lang, s in sorted(samples.items()) if s))
    return out


def cheapest_of(spark: SparkSession, samples: tuple[tuple[str, str], ...], text: F.Column) -> F.Column:
    """(cost, lang, second) of a text column among some languages: the least cost, its language and the next cost; null without a letter."""
    sent = spark.sparkContext.broadcast(samples)

    @F.arrow_udf("struct<cost:double,lang:string,second:double>")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = _parser(sent.value)
        for texts in batches:
            costs = parser.costs([t.as_py() for t in texts])
            best = costs.argmin(1) if len(texts) else np.zeros(0, np.int64)
            rows = np.arange(len(costs))
            least = costs[rows, best]
            costs[rows, best] = np.inf
            second = costs.min(1) if len(texts) else least
            none = ~np.isfinite(least)
            kinds = [pa.array(least, pa.float64(), mask=none), pa.array([parser.langs[i] for i in best], pa.string(), mask=none), pa.array(second, pa.float64(), mask=none)]
            yield pa.StructArray.from_arrays(kinds, names=["cost", "lang", "second"], mask=pa.array(none))

    return language(text)


def predicted(rows: DataFrame, parts: list[tuple[tuple[str, str], ...]], text: str = "text") -> DataFrame:
    """rows, without the column text, with `p`: (lang_pred, score)."""
    kept = [c for c in rows.columns if c != text]
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not parts:
        return rows.select(*kept, none.alias("p"))
    each = rows.select(*kept, F.array_compact(F.array(*(cheapest_of(rows.sparkSession, samples, F.col(text)) for samples in parts))).alias("each"))
    ranked = each.withColumn("each", F.array_sort("each"))
    best = F.col("each")[0]
    second = F.array_min(F.concat(F.array(best["second"]), F.transform(F.slice("each", 2, 1 << 30), lambda x: x["cost"])))
    score = F.when(second < float("inf"), 1 - best["cost"] / second).otherwise(1.0)
    return ranked.select(*kept, F.when(F.size("each") > 0, F.struct(best["lang"].alias("lang_pred"), score.alias("score"))).otherwise(none).alias("p"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents")
    parts = learn(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), parts).select("doc_id", "held_out", "p.lang_pred", "p.score")
