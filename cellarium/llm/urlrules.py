"""URL filters by association rules.

A fixed rule list (host and path prefix) judges the URLs it covers. Their verdicts are labels: FP-growth
mines combinations of URL tokens (host labels and their hyphened parts, path parts, query names) that go with `block`. All URLs
are baskets, those that the list does not cover as not blocked, so a combination needs more than to occur
among blocked URLs: MIN_CONFIDENCE of all URLs with it must be blocked ones. Rules are pruned by support
and confidence, and match the remaining URLs by an inverted index from a rule's rarest token to the
rule. A URL that no list rule fits is blocked if it holds all tokens of a mined rule.

Items of the baskets are the tokens of at least MIN_SUPPORT that occur among blocked URLs, as no other can be in
a rule; there are at most (mean tokens of a URL) / MIN_SUPPORT. Tokens that occur in exactly the same
URLs are one item, so that tokens which always come together do not multiply the itemsets.

Defined results: a null URL, or one without `://`, has empty host and path, no rule, and no token, so it
is allowed; equal URLs are judged alike; repeated rows are judged one by one; an empty table stays empty.
Without blocked URLs no rule is mined and all others are allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import table, written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.9
MAX_TOKENS = 3
MAX_RULES = 100_000
MARK = "\x00block"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains if the path starts with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for own, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, the parts of hyphened ones, path parts that are not numbers, names of query fields."""
    labels = F.split(host, r"\.")
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    words = F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(hyphened, lambda x: F.concat(F.lit("w:"), x)))
    parts = F.transform(F.filter(F.split(F.lower(path), r"[/._-]"), lambda x: ~x.rlike("^[0-9]*$")), lambda x: F.concat(F.lit("p:"), x))
    fields = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(words, parts, fields)))


def items_of(baskets: DataFrame, least: float) -> DataFrame:
    """(token, item) of the tokens in `least` baskets or more of which one is blocked; tokens of the same baskets have the same item."""
    each = baskets.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("h"), "blocked")
    sums = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("h", 20)).alias("s"), F.bit_xor("h").alias("x"), F.max("blocked").alias("b"))
    often = written(sums.filter((F.col("n") >= least) & F.col("b")), "often")
    return often.join(often.groupBy("n", "s", "x").agg(F.min("token").alias("item")), ["n", "s", "x"]).select("token", "item")


def mine(pages: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, longest: int = MAX_TOKENS) -> DataFrame:
    """(tokens, confidence) of the rules for block, from columns tokens and verdict; verdicts other than block, null too, are background.

    support is the least share of all rows that have a rule's tokens and are blocked. A rule is pruned if a part of it is a rule as well.
    """
    spark = pages.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, confidence double")
    baskets = written(pages.select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked")), "baskets")
    least = support * baskets.count()
    items = written(items_of(baskets, least), "items")
    named = baskets.select("id", "blocked", F.explode("tokens").alias("token")).join(items, "token").groupBy("id").agg(F.collect_set("item").alias("items"), F.max("blocked").alias("blocked"))
    named = written(named.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(MARK)))).otherwise(F.col("items")).alias("items")), "named")
    rows = named.count()
    if not rows:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / rows), minConfidence=confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(named)
    found = written(model.freqItemsets.filter(F.size("items") <= longest + 1), "itemsets")
    sides = found.select(F.sort_array("items").alias("items"), "freq")
    hit = sides.filter(F.array_contains("items", MARK) & (F.size("items") > 1)).select(F.array_remove("items", MARK).alias("tokens"), F.col("freq").alias("both"))
    rules = hit.join(sides.withColumnRenamed("items", "tokens"), "tokens").select("tokens", (F.col("both") / F.col("freq")).alias("confidence")).filter(F.col("confidence") >= confidence)
    rules = written(rules, "rules")
    parts = rules.select("tokens", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.shiftleft(F.lit(1), longest) - 2), lambda m: F.filter("tokens", lambda x, i: F.call_function("getbit", m, i) == 1)), lambda s: (F.size(s) > 0) & (F.size(s) < F.size("tokens")))).alias("part"))
    covered = parts.join(rules.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct()
    return written(rules.join(covered, "tokens", "left_anti"), "pruned")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct values of column key (with tokens) that hold all tokens of a rule.

    Inverted index: a rule is filed under its rarest token, looked up by the tokens of each key, and checked
    against the rest. The index is broadcast up to MAX_RULES rules, and joined by token beyond.
    """
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = each.join(often, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    posted = urls.select("key", F.col("tokens").alias("own"), F.explode("tokens").alias("token"))
    small = rules.limit(MAX_RULES + 1).count() <= MAX_RULES
    return posted.join(F.broadcast(index) if small else index, "token").filter(F.size(F.array_except("tokens", "own")) == 0).select("key").distinct()


def op7_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = written(pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("l", listed(F.col("host"), F.col("path"))).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path"))), "urls")
    rules = mine(rows.select("tokens", F.col("l.verdict").alias("verdict")))
    open_rows = rows.filter("l is null").select(F.xxhash64("tokens").alias("key"), "tokens").distinct()
    blocked = written(matched(open_rows, rules).withColumn("hit", F.lit(True)), "blocked")
    judged = rows.withColumn("key", F.when(F.col("l").isNull(), F.xxhash64("tokens"))).join(blocked, "key", "left")
    return judged.select("page_id", "host", "path", F.col("l.rule").alias("rule"), F.coalesce(F.col("l.verdict"), F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))
