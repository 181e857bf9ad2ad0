"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A tree of columns (domain, language, source) splits a total token budget by weights. At each node the
children share the node's budget in proportion to their weights, none above its capacity (tokens of
its leaves times max_epochs); what a child cannot use goes to its siblings first, and only what a
whole subtree cannot use had already been left to its own siblings one level up. Each leaf then takes
whole epochs of its documents and, in the last epoch, the shortest prefix in an order seeded by epoch
that reaches its budget. The prefix is found by summing tokens per hash range first; only the documents
of the one range in which the budget ends are put in order, so no leaf is ever gathered in one task.

Defined results: null tree values form a node of their own (named by an empty string); null or empty
texts have no tokens and are taken with the epoch ranges they fall into; equal hashes tie by doc_id and
text; repeated rows count each; a tree without tokens, or an empty table, selects nothing. Missing or
negative weights count as 1 and 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.llm.common import fresh, table, written

LEVELS = ("domain", "lang", "source")
#: Weight by path of node names; nodes that are not named weigh 1.
WEIGHTS = {("web",): 2.0, ("books",): 1.0, ("web", "en"): 3.0, ("web", "fr"): 2.0, ("web", "de"): 2.0, ("books", "en"): 3.0, ("books", "es"): 2.0}
#: The domain of each source; others are in the domain "other".
DOMAINS = {
    "web": "src0 src2 src4 src6 src8 src10 src12 src14 src16 src18".split(),
    "books": "src1 src3 src5 src7 src9 src11 src13 src15 src17 src19".split(),
}
SHARE = 0.6
MAX_EPOCHS = 2
SEED = 17
RANGE_BITS = 12
MAX_LEAVES = 100_000


def domain_of(source: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    """The domain that lists a source."""
    out = F.lit("other")
    for domain, own in domains.items():
        out = F.when(source.isin(*own), domain).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words between spaces, tabs and line ends."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def weight_of(path: list[Column], weights: dict[tuple[str, ...], float]) -> Column:
    """The weight of a node, by its path."""
    named = {"\x1f".join(k): float(max(w, 0)) for k, w in weights.items() if len(k) == len(path)}
    if not named:
        return F.lit(1.0)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), F.concat_ws("\x1f", *path)), F.lit(1.0))


def shared_out(children: DataFrame, parent: list[str], budget: str, to: str) -> DataFrame:
    """children with their shares of the column budget: min(capacity, weight x level), the level being such that all is used or all are full.

    Columns cap and weight are read. Children fill up in order of cap / weight, so the level follows from sums over those before.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("__ratio", *(c for c in children.columns if c in LEVELS or c.startswith("l_")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rows = children.withColumn("__ratio", ratio).withColumn("__full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("__rest", F.sum("weight").over(after))
    level = F.when(F.col("__rest") > 0, (F.col(budget) - F.col("__full")) / F.col("__rest")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__level", level).withColumn("__fits", F.col("__ratio") <= F.col("__level"))
    final = F.min(F.when(~F.col("__fits"), F.struct("__ratio", F.col("__level").alias("l")))).over(Window.partitionBy(*parent))["l"]
    share = F.when(F.col("__fits"), F.col("cap")).otherwise(F.greatest(F.least(F.col("weight") * final, F.col("cap")), F.lit(0.0)))
    return rows.withColumn(to, share).drop("__ratio", "__full", "__rest", "__level", "__fits")


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict, total: Column, max_epochs: int) -> DataFrame:
    """(levels, tokens, budget) of each leaf, from levels and tokens. One row per leaf comes in; the tree is that small."""
    # Nothing is taken below a node of weight zero, so it has no capacity, and its tokens go to siblings.
    open_to = F.lit(True)
    for depth in range(1, len(levels) + 1):
        open_to &= weight_of([F.col(c) for c in levels[:depth]], weights) > 0
    caps = leaves.withColumn("cap", F.when(open_to, F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    top = caps.agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(F.lit(0).alias("__top"), F.least(total, F.col("cap")).alias("budget"))
    parent = ["__top"]
    for depth in range(1, len(levels) + 1):
        here = list(levels[:depth])
        nodes = caps.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("__top", F.lit(0)).withColumn("weight", weight_of([F.col(c) for c in here], weights))
        top = shared_out(nodes.join(top, parent), parent, "budget", "__share").select("__top", *here, F.col("__share").alias("budget"))
        parent = ["__top", *here]
    return leaves.join(top.drop("__top"), list(levels))


def place_of(epoch: Column, seed: int) -> Column:
    """A row's place in an epoch's order: 63 bits of a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("text")), 1)


def mixed(docs: DataFrame, levels: dict[str, Column], weights: dict = WEIGHTS, share: float = SHARE, total: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows chosen from docs (doc_id, text and any others), once for each epoch, as `doc`, a struct of their columns, and `mix`: (epoch, tokens).

    levels: name and column of each level of the tree, from the top. The budget is `total` tokens, or the
    given share of all tokens.
    """
    names = tuple(f"l_{c}" for c in levels)
    leaf = [F.coalesce(e.cast("string"), F.lit("")).alias(n) for n, e in zip(names, levels.values(), strict=True)]
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    keyed = docs.select(*leaf, tokens_of(F.col("text")).alias("n"), F.transform(epochs, lambda e: F.struct(e.alias("epoch"), place_of(e, seed).alias("h"))).alias("es"))
    keyed = written(keyed.select(*names, "n", F.explode("es").alias("e")).select(*names, "n", "e.epoch", "e.h"), "keyed")
    range_of = F.shiftright("h", 63 - RANGE_BITS).cast("int")
    ranges = written(keyed.groupBy(*names, "epoch", range_of.alias("range")).agg(F.sum("n").alias("tokens")), "ranges")
    leaves = written(ranges.filter("epoch = 0").groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    plan = written(budgets(leaves, names, weights, F.lit(float(total if total is not None else share * whole)), max_epochs).select(*names, "budget"), "budgets")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*names).orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ranges.withColumn("left", before).join(plan, list(names)).withColumn("left", F.col("budget") - F.col("left")).filter("left > 0 and left <= tokens")
    edge = written(ends.select(*names, "epoch", "range", "left"), "edges")
    rows = keyed.withColumn("range", range_of).join(edge, [*names, "epoch", "range"])
    passed = F.coalesce(F.sum("n").over(Window.partitionBy(*names, "epoch", "range").orderBy("h").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stops = written(rows.withColumn("passed", passed).filter("passed < left").groupBy(*names).agg(F.max("epoch").alias("__stop"), F.max("h").alias("__h")), "stops")
    small = stops.limit(MAX_LEAVES + 1).count() <= MAX_LEAVES
    chosen = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", *leaf).join(F.broadcast(stops) if small else stops, list(names))
    taken = F.filter(F.sequence(F.lit(0), F.col("__stop")), lambda e: (e < F.col("__stop")) | (place_of(e, seed) <= F.col("__h")))
    return chosen.select("doc", F.explode(taken).alias("epoch"), tokens_of(F.col("text")).alias("tokens")).select("doc", F.struct("epoch", "tokens").alias("mix"))


def tree() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op9_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, epoch and n_tokens of every chosen document, a row for each epoch it is in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixed(docs, tree()).select("doc.doc_id", domain_of(F.col("doc.source")).alias("domain"), "doc.lang", "doc.source", F.col("mix.epoch").alias("epoch"), F.col("mix.tokens").alias("n_tokens"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen documents with their columns, and epoch and n_tokens (with an underscore before them where docs has such columns)."""
    epoch, tokens = fresh(docs, "epoch", "n_tokens")
    return mixed(docs, tree()).select("doc.*", F.col("mix.epoch").alias(epoch), F.col("mix.tokens").alias(tokens))
