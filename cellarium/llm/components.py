"""Connected components over an edge table, without gathering anything on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import written

#: Links that one task joins in memory (16 bytes each).
FOREST = 1 << 20


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that the links reach from it) of the nodes that are not the least themselves."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while len(left):
        low, high = np.minimum(left, right), np.maximum(left, right)
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        left, right = root[left], root[right]
        left, right = left[left != right], right[left != right]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def thinned(edges: DataFrame, forest: int = FOREST) -> DataFrame:
    """Links (a, b) that join what those of edges (a, b) join: every `forest` links become stars around their least nodes."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
        if a:
            high, low = joined_up(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    return edges.repartition(max(1, -(-edges.count() // forest))).mapInArrow(stars, "a bigint, b bigint")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60, forest: int = FOREST) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    Each round thins the links to stars in parts that fit a task, hooks every node to its least neighbour,
    follows these hooks to their ends, and goes on with the links between the ends only: loops and
    repeats go, so the graph shrinks to nothing. All steps are written as tables, so that lost executors
    cost one step at most, and joins read written tables, so that adaptive execution may split hot nodes.
    """
    every = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    alone = every.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    links = written(every.filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(rounds):
        if links.isEmpty():
            break
        links = written(thinned(links, forest).distinct(), "stars")
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("root")), F.struct(F.col("b").alias("node"), F.col("a").alias("root")))).alias("e")).select("e.*")
        hooks = written(ends.groupBy("node").agg(F.min("root").alias("root")), "hooks")
        for _ in range(rounds):
            up = hooks.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("up"))
            if hooks.join(up, "root", "left_semi").isEmpty():
                break
            hooks = written(hooks.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "hooks")
        maps.append(hooks)
        low, high = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
        moved = links.join(low, "a").join(high, "b").filter("a_root <> b_root")
        links = written(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not maps:
        return alone.distinct()
    out = maps[0]
    for more in maps[1:]:
        out = written(out.join(more.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
    return out.unionByName(alone.join(out, "node", "left_anti").distinct())
