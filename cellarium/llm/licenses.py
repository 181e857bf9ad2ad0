"""License scans by diagonal voting.

All rolling hashes of K words of every text are joined, in Spark, to the positions of the same hashes in
a set of license templates. A hit votes for the diagonal (position in text minus position in template).
Votes are counted per text, template and diagonal. A span is a stretch of text as long as the template and one
word in LACK_ONE_IN more, that has all of the template's words in order but one in LACK_ONE_IN. In such a span hits lie on
neighbouring diagonals (three such shares of the template apart at most) and are not fewer than those shares can spoil, so
neighbouring diagonals are merged that far and no further, however many pieces of a template a text holds.
Spans with enough votes are verified by the longest common subsequence of their words and the template's. A
verified span adds the template's label.

Three fixed phrases form the base labels, which stay whatever the method finds.

Defined results: null texts are empty: no words, no labels, null first and last word. Rows are told apart
by id and text; repeated rows get equal results. Texts of fewer than K words have no hash and only base
labels. Very long texts are scanned whole. An empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.llm.common import table, written

K = 3
#: Words of a template that a verified span may lack, and have besides: one in so many, rounded down, so short notices must match in full.
LACK_ONE_IN = 10
MAX_TEMPLATE_WORDS = 2_000_000
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: Label and wording of common license notices; words are all that counts.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_PHRASES = re.compile(rb"(?<![^ ])(" + b"|".join(BASE) + rb")(?![^ ])")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and anything outside ASCII."""
    return (raw or b"").translate(_KEEP).split()


def rolling(words: list[bytes], k: int = K) -> np.ndarray:
    """Signed 64-bit hashes of every k consecutive words."""
    import xxhash

    if len(words) < k:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * _P + h[i : len(words) - k + 1 + i]
    out ^= out >> np.uint64(29)
    return (out * _P).view(np.int64)


def common_words(template: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the template's words."""
    masks: dict[bytes, int] = {}
    for k, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << k
    v = full = (1 << len(template)) - 1
    for w in words:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(template) - v.bit_count()


def base_of(words: list[bytes]) -> tuple[int, int, int | None, int | None, str]:
    """n_words, places of the phrases, first and last of them, and the phrases' labels."""
    line = b" ".join(words)
    starts, labels = [], set()
    at, spaces = 0, 0
    for m in _PHRASES.finditer(line):
        spaces += line.count(b" ", at, m.start())
        at = m.start()
        starts.append(spaces)
        labels.add(BASE[m[1]])
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def with_base(text: Column) -> Column:
    """n_words, n_base, first_word, last_word and base_labels as a struct."""

    @F.arrow_udf("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string>")
    def base(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
        for texts in batches:
            rows = [base_of(words_of(t.as_py())) for t in texts.cast(pa.binary())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.StructArray.from_arrays([pa.array(c, pa.string() if n == "base_labels" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    return base(text)


def hashes(text: Column) -> Column:
    """The rolling hashes of a text column."""

    @F.arrow_udf("array<bigint>")
    def kgrams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            each = [rolling(words_of(t.as_py())) for t in texts.cast(pa.binary())]
            ends = np.cumsum([0, *(len(h) for h in each)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*each, np.zeros(0, np.int64)])))

    return kgrams(text)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(hash, tpl, label, at, size): the positions of all rolling hashes of the templates, broadcast up to MAX_TEMPLATE_WORDS of them."""
    rows = []
    for i, (label, text) in enumerate(templates):
        words = words_of(text.encode())
        rows += [(h, i, label, at, len(words)) for at, h in enumerate(rolling(words).tolist())]
    out = spark.createDataFrame(rows, "hash bigint, tpl int, label string, at int, size int")
    return F.broadcast(out) if len(rows) <= MAX_TEMPLATE_WORDS else out


def verified(text: Column, found: Column, templates, lack: int) -> Column:
    """The best spans near found, (tpl, diagonal) of one text: (tpl, start, end, common), common being the words in common with the template."""
    own = [words_of(t.encode()) for _, t in templates]

    @F.arrow_udf("array<struct<tpl:int,start:int,end:int,common:int>>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for t, each in zip(texts.cast(pa.binary()), spans.to_pylist(), strict=True):
                words, rows = words_of(t.as_py()), []
                for s in each:
                    x = own[s["tpl"]]
                    spare = len(x) // lack
                    starts = range(max(s["diagonal"] - 2 * spare, 0), max(s["diagonal"] + spare, 0) + 1)
                    common, start = max((common_words(x, words[i : i + len(x) + spare]), -i) for i in starts)
                    rows.append({"tpl": s["tpl"], "start": -start, "end": min(len(x) + spare - start, len(words)), "common": common})
                out.append(rows)
            yield pa.array(out, pa.list_(pa.struct([(n, pa.int32()) for n in ("tpl", "start", "end", "common")])))

    return best(text, found)


def voted(docs: DataFrame, templates=TEMPLATES, lack: int = LACK_ONE_IN) -> DataFrame:
    """(t, tpl, diagonal) where the hits of a text, of hash t, on a diagonal and those next to it are enough for a span."""
    grams = docs.select(F.xxhash64("text").alias("t"), F.posexplode(hashes(F.col("text"))).alias("pos", "hash"))
    hits = grams.join(template_table(docs.sparkSession, templates), "hash").select("t", "tpl", "size", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    by = ["t", "tpl", "size"]
    # A diagonal's hits are bounded by the template's length, and so are the diagonals that are merged.
    each = hits.groupBy(*by, "diagonal").agg(F.collect_set("at").alias("ats"))
    widest = 3 * max((len(words_of(t.encode())) // lack for _, t in templates), default=0)
    near = F.collect_list(F.struct("diagonal", "ats")).over(Window.partitionBy(*by).orderBy("diagonal").rangeBetween(0, widest))
    spare = F.floor(F.col("size") / lack)
    votes = F.size(F.array_distinct(F.flatten(F.transform(F.filter("near", lambda d: d["diagonal"] <= F.col("diagonal") + 3 * spare), lambda d: d["ats"]))))
    return each.withColumn("near", near).filter(votes >= F.greatest(F.lit(1), F.col("size") - (K - 1) - 7 * spare)).select("t", "tpl", "diagonal")


def spans(docs: DataFrame, templates=TEMPLATES, lack: int = LACK_ONE_IN) -> DataFrame:
    """(t, label, start, end, score) of each verified span of the texts of docs; t is the hash of the text, score the share of the template's words in common."""
    found = written(voted(docs, templates, lack).groupBy("t").agg(F.sort_array(F.collect_set(F.struct("tpl", "diagonal"))).alias("found")), "voted")
    texts = docs.select(F.xxhash64("text").alias("t"), "text").join(found, "t").groupBy("t").agg(F.first("text").alias("text"), F.first("found").alias("found"))
    best = texts.select("t", F.explode(verified(F.col("text"), F.col("found"), templates, lack)).alias("s")).select("t", "s.*").distinct()
    labels = F.array(*(F.lit(label) for label, _ in templates))
    sizes = F.array(*(F.lit(len(words_of(t.encode()))) for _, t in templates))
    rows = best.withColumn("label", F.element_at(labels, F.col("tpl") + 1)).withColumn("size", F.element_at(sizes, F.col("tpl") + 1))
    return rows.filter(F.col("common") >= F.col("size") - F.floor(F.col("size") / lack)).select("t", "label", "start", "end", (F.col("common") / F.col("size")).alias("score"))


def op5_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, base columns, labels and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = written(spans(docs).groupBy("t").agg(F.collect_set("label").alias("more"), F.max("score").alias("best")), "licenses")
    base = written(docs.select("doc_id", F.xxhash64("text").alias("t"), with_base(F.col("text")).alias("b")).select("doc_id", "t", "b.*"), "license_base")
    rows = base.join(found, "t", "left")
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.sort_array(F.array_distinct(F.concat(own, F.coalesce("more", F.array().cast("array<string>"))))), ",")
    score = F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
