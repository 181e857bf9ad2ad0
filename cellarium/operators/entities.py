"""Entity linking: labels of a dictionary found inside texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a task searches at once; larger dictionaries are searched in as many parts as they need.
PART_LABELS = 1_000_000
FOUND = "array<struct<start:int,size:int,iri:string,label:string>>"


def _parts(dictionary: DataFrame, most: int) -> list[DataFrame]:
    rows = dictionary.select("label", "iri").filter("label <> ''").distinct()
    n = max(1, -(-rows.count() // most))
    return [rows.filter(F.pmod(F.xxhash64("label"), F.lit(n)) == i) for i in range(n)]


def occurrences(texts: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found): all places of labels in each text, overlapping ones too."""
    words = [(r["label"], r["iri"]) for r in labels.orderBy("label", "iri").collect()]
    sent = texts.sparkSession.sparkContext.broadcast(words)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("iri", pa.string()), ("label", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        search = ahocorasick.Automaton()
        for label, iri in sent.value:
            search.add_word(label, (label, iri))
        search.make_automaton()
        for b in batches:
            found = [[] if not t or not sent.value else [{"start": end - len(label) + 1, "size": len(label), "iri": iri, "label": label} for end, (label, iri) in search.iter(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[key, "found"])

    return texts.select(key, text).mapInArrow(find, f"{key} {dict(texts.dtypes)[key]}, found {FOUND}")


def resolved(found: Column) -> Column:
    """The places that count: leftmost first, of those the longest, none overlapping another."""
    order = F.array_sort(F.transform(found, lambda f: F.struct(f["start"].alias("start"), (-f["size"]).alias("back"), f["iri"].alias("iri"))))
    zero = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start:int,iri:string>>").alias("out"))
    step = lambda a, f: F.when(f["start"] >= a["free"], F.struct((f["start"] - f["back"]).alias("free"), F.concat(a["out"], F.array(F.struct(f["start"].alias("start"), f["iri"].alias("iri")))).alias("out"))).otherwise(a)
    return F.aggregate(order, zero, step)["out"]


def all_occurrences(texts: DataFrame, dictionary: DataFrame, key: str, text: str, most: int = PART_LABELS) -> DataFrame:
    """(key, found) over the whole dictionary. Its parts are joined by key, which then has to tell rows apart."""
    parts = [occurrences(texts, p, key, text) for p in _parts(dictionary, most)]
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.flatten(F.collect_list("found")).alias("found"))


def linked(texts: DataFrame, dictionary: DataFrame, key: str, text: str, most: int = PART_LABELS) -> DataFrame:
    """(key, iri, n, first): entities per text, with their count and first place, from a dictionary of label and iri."""
    each = all_occurrences(texts, dictionary, key, text, most).select(key, F.explode(resolved(F.col("found"))).alias("f"))
    return each.groupBy(key, "f.iri").agg(F.count(F.lit(1)).alias("n"), F.min("f.start").cast("bigint").alias("first"))


def linked_with_delimiters(texts: DataFrame, dictionary: DataFrame, key: str, text: str, delimiters: list[str]) -> DataFrame:
    """The same: delimiters do not change what is linked."""
    return linked(texts, dictionary, key, text)


def contained(texts: DataFrame, dictionary: DataFrame, key: str, text: str, most: int = PART_LABELS) -> DataFrame:
    """(key, label) of every label that a text contains, wherever it stands."""
    found = None
    for p in _parts(dictionary, most):
        one = occurrences(texts, p, key, text).select(key, F.explode(F.array_distinct(F.transform("found", lambda f: f["label"]))).alias("label"))
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def ranked(found: DataFrame, key: str) -> DataFrame:
    """Entities of each text with their place by count, equal ones by iri."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "iri")).cast("bigint"))
