"""Comparison of produced and expected cells: property names are matched first, in the header row, then each cell."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.operators import match as M
from cellarium.operators.graph import micro_totals


def graphs(triples: DataFrame, key: list[str]) -> DataFrame:
    """(key, graph): the triples of each cell, sorted."""
    one = F.struct("s", "p", "o", (F.col("o_kind") == "literal").alias("literal"))
    return triples.groupBy(*key).agg(F.sort_array(F.collect_set(one)).alias("graph"))


def property_matches(paired: DataFrame) -> DataFrame:
    """(sheet, known): the pairs that header cells agree on. A cell counts if it has exactly one solution; of columns that differ, the first wins."""
    head = paired.filter("row = 0").withColumn("m", M.matched(F.col("actual"), F.col("expected")))
    only = head.filter(F.size("m.solutions") == 1).select("sheet", "col", F.explode(F.map_entries(F.col("m.solutions")[0])).alias("e"))
    first = only.groupBy("sheet", "e.key").agg(F.min_by("e.value", "col").alias("value"))
    return first.groupBy("sheet").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("known"))


def compared(actual: DataFrame, expected: DataFrame, tries: int = M.MAX_TRIES) -> DataFrame:
    """(sheet, row, col, tp, fn, fp, truncated) of every expected cell, under its best mapping.

    Both are triples with sheet, row and col. Cells that only actual has are left out; missing ones are
    empty. Cells are matched in parallel; the header's mapping, one small map per sheet, is joined to them.
    """
    key = ["sheet", "row", "col"]
    none = F.array().cast(M.GRAPH)
    paired = graphs(expected, key).withColumnRenamed("graph", "expected").join(graphs(actual, key).withColumnRenamed("graph", "actual"), key, "left").withColumn("actual", F.coalesce("actual", none))
    known = property_matches(paired)

    def under(a: list[M.Triple], e: list[M.Triple], start: M.Mapping) -> tuple[int, int, int, bool]:
        budget = M.Budget(tries)
        found = M.match(a, e, start, budget) or [start]
        return (*max((M.counts_under(a, e, m) for m in found), key=lambda c: (c[0], -c[1] - c[2])), budget.spent)

    @F.arrow_udf("struct<tp:bigint,fn:bigint,fp:bigint,truncated:boolean>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kinds = (("tp", pa.int64()), ("fn", pa.int64()), ("fp", pa.int64()), ("truncated", pa.bool_()))
        for columns in batches:
            rows = [under(M.triples_of(a), M.triples_of(e), dict(start or [])) for a, e, start in zip(*(c.to_pylist() for c in columns), strict=True)]
            each = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(each, kinds, strict=True)], names=[n for n, _ in kinds])

    rows = paired.join(known, "sheet", "left").withColumn("known", F.when(F.col("row") > 0, F.col("known")))
    return rows.select(*key, best(F.col("actual"), F.col("expected"), F.col("known")).alias("b")).select(*key, "b.*")


def evaluated(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Micro totals per sheet."""
    return micro_totals(compared(actual, expected), ["sheet"])


def absolute_cell(table: DataFrame, col: int, row: int, to: str) -> DataFrame:
    """table with the text of one cell of the same sheet in every row."""
    fixed = table.filter((F.col("col") == col) & (F.col("row") == row)).select("sheet", F.col("value_string").alias(to)).dropDuplicates(["sheet"])
    return table.join(fixed, "sheet", "left")


def filtered(table: DataFrame, predicate: str) -> DataFrame:
    """Rows for which an SQL predicate over the cell columns holds."""
    return table.filter(F.expr(predicate))
