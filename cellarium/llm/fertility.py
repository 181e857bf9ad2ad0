"""Quality rules from tokeniser fertility.

Two public vocabularies encode every word of a text: a piece vocabulary with byte fallback and a
byte-level one. Characters per token under either, the share of byte-fallback tokens and the entropy
of the token distribution are compared with rejection bands per language (and length class), fitted on
labelled good documents; languages without labels use the wide bands of their script.

Defined results: null or empty texts have no words, all measures 0, and fail the base rule. Repeated
rows are judged one by one. Very long texts are measured whole. An empty table gives an empty table.
Input columns other than the ones named are neither read nor changed.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import held, table, written

TOKENIZERS = "/opt/tokenizers"
SYMBOLS = b"#*$%&|<>"
WORD_CACHE = 1 << 19
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BAND_WIDTH = 4.0
MIN_LABELLED = 100
MAX_BANDS = 100_000
#: Decimal places that bands are fitted with, so that quartiles are exact and still need few distinct values in memory.
PLACES = 4
#: Bands where no labelled rows exist: characters per token (both vocabularies) by script, then bounds for all scripts.
SCRIPT_BANDS = {"latin": (1.2, 8.0), "cyrillic": (1.0, 8.0), "greek": (0.8, 6.0), "arabic": (0.6, 6.0), "han": (0.3, 3.0), "other": (0.2, 8.0)}
MAX_BYTE_SHARE = 0.6
MIN_ENTROPY = 0.2
METRICS = ("cpt_piece", "cpt_byte", "byte_share", "entropy")
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, cpt_piece double, cpt_byte double, byte_share double, entropy double, script string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_TYPES = [{"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]] for f in FIELDS.split(", ")]
_DIGIT = re.compile(rb"[0-9]")
_SCRIPT_STARTS = np.array([0, 0x250, 0x370, 0x400, 0x530, 0x600, 0x780, 0x3040, 0xA000])
_SCRIPTS = ("latin", "other", "greek", "cyrillic", "other", "arabic", "other", "han", "other")


class Vocabularies:
    """Per-word token ids of both vocabularies, kept for the words seen last."""

    def __init__(self, piece_model: bytes, byte_ranks: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, byte_ranks.splitlines())}
        self.byte = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = self.piece.vocab_size()
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.size)])
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.other = np.zeros(1 << 14, np.int64)
        self.chars = np.zeros(1 << 14, np.int64)

    def add(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        pieces = self.piece.encode(texts, num_threads=1)
        for w, text, own in zip(words, texts, pieces, strict=True):
            i = len(self.ids)
            if i == len(self.start):
                self.start, self.count, self.other, self.chars = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.other, self.chars))
            while self.used + len(own) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.ids[w] = i
            self.flat[self.used : self.used + len(own)] = own
            self.start[i], self.count[i], self.other[i] = self.used, len(own), len(self.byte.encode_ordinary(" " + text))
            self.chars[i] = -len(text) if _DIGIT.search(w) else len(text)
            self.used += len(own)

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        found = [get(w) for w in words]
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None))
            if len(self.ids) + len(new) > WORD_CACHE:
                self.forget()
                new = list(dict.fromkeys(words))
            self.add(new)
            get = self.ids.get
            found = [get(w) for w in words]
        return np.array(found, np.int64)

    def tokens(self, ids: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Piece tokens of the words without a digit, number of their byte tokens, and their characters. Numbers, keys and addresses say nothing about a text's language."""
        ids = ids[self.chars[ids] > 0]
        if not len(ids):
            return np.zeros(0, np.int32), 0, 0
        n = self.count[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - n), n)
        return self.flat[at], int(self.other[ids].sum()), int(self.chars[ids].sum())


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    span = int(ids.max()) + 1
    if span < 1 << 21:
        key = (ids[:-2] * span + ids[1:-1]) * span + ids[2:]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[where] > 1
    else:
        windows = list(zip(ids.tolist(), ids[1:].tolist(), ids[2:].tolist(), strict=False))
        seen = Counter(windows)
        again = np.array([seen[w] > 1 for w in windows])
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def script_of(text: str) -> str:
    """The script of most of the letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = codes[((codes | 32) >= 97) & ((codes | 32) <= 122) | (codes >= 0xC0)]
    if not len(letters):
        return "other"
    kinds = np.bincount(np.searchsorted(_SCRIPT_STARTS, letters, side="right") - 1, minlength=len(_SCRIPTS))
    votes: dict[str, int] = {}
    for name, k in zip(_SCRIPTS, kinds.tolist(), strict=True):
        votes[name] = votes.get(name, 0) + k
    return max(votes, key=votes.get)


def measures(raw: bytes | None, v: Vocabularies) -> tuple:
    """The fields of FIELDS for one whole text in UTF-8."""
    raw = raw or b""
    words = raw.split()
    symbols = sum(raw.count(c) for c in SYMBOLS)
    if not words:
        return 0, 0, symbols, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, "other"
    chars = len(b"".join(words).decode("utf-8", "replace"))
    seen: set[bytes] = set()
    duplicates = 0
    for line in raw.split(b"\n"):
        if line.strip():
            duplicates += line in seen
            seen.add(line)
    ids = v.word_ids(words)
    tokens, other, plain = v.tokens(ids)
    n = len(tokens)
    times = np.bincount(tokens, minlength=v.size)
    fallback = int(times[v.is_byte].sum())
    p = times[times > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum()) / np.log2(min(n, v.size)) if n > 1 else 0.0
    return len(words), chars, symbols, duplicates, repeated_words(ids), n, plain / max(n, 1), plain / max(other, 1), fallback / max(n, 1), entropy, script_of(raw.decode("utf-8", "replace"))


def measure_udf(spark: SparkSession, tokenizers: str = TOKENIZERS):
    """An Arrow function from a text to its measures. The two vocabulary files (1.4 MB) are broadcast."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("vocabulary_files", f"{tokenizers}/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    files = spark.sparkContext.broadcast((Path(tokenizers, "piece_bpe_32k.model").read_bytes(), Path(tokenizers, "byte_bpe_50k.tiktoken").read_bytes(), public.PATTERN))

    @F.arrow_udf(f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def fertility(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held(Vocabularies, *files.value)
        for texts in batches:
            rows = [measures(t.as_py(), v) for t in texts.cast(pa.binary())]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    return fertility


def measured(docs: DataFrame, to: str, text: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """docs with the measures of its texts as a struct column."""
    return docs.withColumn(to, measure_udf(docs.sparkSession, tokenizers)(F.col(text)))


def length_class(n_words: Column) -> Column:
    return F.floor(F.log2(F.greatest(n_words, F.lit(1)).cast("double"))).cast("int")


def fit_bands(good: DataFrame, width: float = BAND_WIDTH, least: int = MIN_LABELLED) -> DataFrame:
    """Bands (lang, size, and low and high per metric) from good documents' columns lang, n_words and METRICS.

    Exact median and quartiles over all labelled rows, whatever their partitions; a band is the median plus and minus width robust
    deviations. size is the length class, or null in the band for the language as a whole.
    """
    sized = good.select(F.col("lang").alias("b_lang"), F.explode(F.array(length_class(F.col("n_words")), F.lit(None).cast("int"))).alias("b_size"), *METRICS)
    quartiles = sized.groupBy("b_lang", "b_size").agg(F.count(F.lit(1)).alias("b_n"), *(F.percentile(F.round(m, PLACES), F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75)))).alias(m) for m in METRICS))
    spread = lambda m: (F.col(m)[2] - F.col(m)[0]) / F.lit(1.349) * F.lit(width) + F.lit(0.01)
    return quartiles.filter(F.col("b_n") >= least).select("b_lang", "b_size", *(F.struct((F.col(m)[1] - spread(m)).alias("low"), (F.col(m)[1] + spread(m)).alias("high")).alias(f"b_{m}") for m in METRICS))


def judged(rows: DataFrame, bands: DataFrame, lang: str, q: str, to: str) -> DataFrame:
    """rows with a struct column of base_failed and kept. bands, a row per language and length class, is broadcast up to MAX_BANDS rows, and joined beyond."""
    small = bands.limit(MAX_BANDS + 1).count() <= MAX_BANDS
    near = F.broadcast if small else lambda df: df
    own = rows.select(F.struct(*rows.columns).alias("row"), F.col(lang).alias("lang"), length_class(F.col(f"{q}.n_words")).alias("size"))
    bound = F.struct(*(F.col(f"b_{x}").alias(x) for x in METRICS))
    sized = near(bands.filter("b_size is not null").select(F.col("b_lang").alias("lang"), F.col("b_size").alias("size"), bound.alias("s_band")))
    whole = near(bands.filter("b_size is null").select(F.col("b_lang").alias("lang"), bound.alias("w_band")))
    joined = own.join(sized, ["lang", "size"], "left").join(whole, "lang", "left")
    m = lambda f: F.col("row")[q][f]
    default = F.create_map(*(F.lit(x) for s, (low, high) in SCRIPT_BANDS.items() for x in (s, f"{low},{high}")))
    low, high = (F.split(default[m("script")], ",")[i].cast("double") for i in (0, 1))
    plain = {"cpt_piece": (low, high), "cpt_byte": (low, high), "byte_share": (F.lit(0.0), F.lit(MAX_BYTE_SHARE)), "entropy": (F.lit(MIN_ENTROPY), F.lit(1.0))}
    inside = F.lit(True)
    for x in METRICS:
        band = F.coalesce(F.col("s_band")[x], F.col("w_band")[x])
        inside &= m(x).between(F.coalesce(band["low"], plain[x][0]) if x != "byte_share" else F.lit(0.0), F.coalesce(band["high"], plain[x][1]))
    failed = (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"))
    return joined.select("row.*", F.struct(failed.alias("base_failed"), (~failed & inside).alias("kept")).alias(to))


def good_rows(rows: DataFrame, labels: DataFrame, q: str) -> DataFrame:
    """Measures of the rows with a quality label of 1."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("g_id")).distinct()
    return rows.select("doc_id", "lang", f"{q}.n_words", *(f"{q}.{x}" for x in METRICS)).join(good, F.col("doc_id") == F.col("g_id"), "left_semi")


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base measures, base_failed, kept and the method's measures of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = written(measured(docs, "q").select("doc_id", "lang", "q"), "fertility")
    bands = written(fit_bands(good_rows(rows, table(spark, sf_dir, "labels"), "q")), "bands")
    return judged(rows, bands, "lang", "q", "v").select("doc_id", "q.*", "v.base_failed", "v.kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    rows = written(measured(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "lang", "text"), "q").drop("text"), "measured")
    bands = written(fit_bands(good_rows(rows, table(spark, sf_dir, "labels"), "q")), "bands")
    return judged(rows, bands, "lang", "q", "v").filter("v.kept").select("doc.*")
