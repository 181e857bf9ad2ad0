"""Matching challenges: small graphs by system, their renamed copies, and the evaluation of matchers on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators import match as M
from cellarium.operators.graph import sets_of


def grown(graphs: DataFrame) -> DataFrame:
    """Each graph with each statement that can follow: of a new subject, or of one that it holds as object or as subject, with a new predicate or (for known subjects) one that it holds, and a new resource or literal as object."""
    g = F.col("graph")
    n = F.size(g).cast("string")
    objects = F.array_distinct(F.transform(F.filter(g, lambda t: ~t["literal"]), lambda t: t["o"]))
    subjects = F.array_distinct(F.transform(g, lambda t: t["s"]))
    predicates = F.array_distinct(F.transform(g, lambda t: t["p"]))
    new = lambda kind: F.concat(F.lit(f"urn:{kind}:"), n)
    subject = graphs.select("graph", F.explode(F.concat(F.array(new("s")), objects, subjects)).alias("s"))
    of_new = F.col("s") == new("s")
    predicate = subject.select("graph", "s", F.explode(F.concat(F.array(new("p")), F.when(of_new, F.array().cast("array<string>")).otherwise(predicates))).alias("p"))
    both = F.array(F.struct(new("o").alias("o"), F.lit(False).alias("literal")), F.struct(F.concat(F.lit("text"), n).alias("o"), F.lit(True).alias("literal")))
    object_ = predicate.select("graph", "s", "p", F.explode(both).alias("x"))
    return object_.select(F.concat("graph", F.array(F.struct("s", "p", "x.o", "x.literal"))).alias("graph"))


def enumerated(spark: SparkSession, depth: int) -> DataFrame:
    """(graph) for all graphs of one to `depth` statements, as they grow; ways that lead to one graph each count."""
    now = spark.range(1).select(F.array().cast(M.GRAPH).alias("graph"))
    out = None
    for _ in range(depth):
        now = grown(now)
        out = now if out is None else out.unionByName(now)
    return out


def renamed_copy(graph: Column, mark: str = "x") -> Column:
    """The graph with every resource under another name."""
    other = lambda r: F.concat(r, F.lit(f":{mark}"))
    return F.transform(graph, lambda t: F.struct(other(t["s"]).alias("s"), other(t["p"]).alias("p"), F.when(t["literal"], t["o"]).otherwise(other(t["o"])).alias("o"), t["literal"].alias("literal")))


def challenges(graphs: DataFrame, dropped: int = 0) -> DataFrame:
    """(graph, actual, expected, truth): each graph, without its first `dropped` statements, against a renamed copy of the whole; truth has the pairs of the resources that are left."""
    rows = graphs.filter(F.size("graph") > dropped)
    actual = F.slice("graph", dropped + 1, 1 << 20)
    names = F.array_distinct(F.flatten(F.transform("actual", lambda t: F.when(t["literal"], F.array(t["s"], t["p"])).otherwise(F.array(t["s"], t["p"], t["o"])))))
    made = rows.select("graph", actual.alias("actual"), renamed_copy(F.col("graph")).alias("expected"))
    return made.withColumn("truth", F.transform(names, lambda r: F.concat(r, F.lit(" "), r, F.lit(":x"))))


def from_cells(matrix: DataFrame, least: int = 10, most: int = 26) -> DataFrame:
    """(graph) of the first `most` cells (sheet, row, col, graph) that hold `least` statements or more."""
    return matrix.filter(F.size("graph") >= least).orderBy("sheet", "row", "col").limit(most).select("graph")


def evaluated(rows: DataFrame, matchers: list[str] = sorted(M.MATCHERS), tries: int = M.MAX_TRIES) -> DataFrame:
    """(matcher, challenges, solved, mean F, truncated): over the challenges of rows, the best suggestion's agreement with the truth."""
    out = None
    for name in matchers:
        found = rows.select("truth", M.matched(F.col("actual"), F.col("expected"), name, tries).alias("m"))
        pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))
        f = F.transform("m.solutions", lambda m: 2 * F.size(sets_of(pairs(m), F.col("truth"))["both"]) / (F.size(m) + F.size("truth")))
        best = found.select("m.truncated", F.coalesce(F.array_max(f), F.lit(0.0)).alias("f"))
        one = best.agg(F.count(F.lit(1)).alias("challenges"), F.count_if(F.col("f") == 1).alias("solved"), F.round(F.avg("f"), 6).alias("mean_f"), F.count_if("truncated").alias("truncated")).select(F.lit(name).alias("matcher"), "*")
        out = one if out is None else out.unionByName(one)
    return out
