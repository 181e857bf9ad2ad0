"""Column profiles over the cell table. Everything is one or two levels of partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions.text import is_formatted, is_uri, jtrim, separators, tokens

KEY = ["sheet", "col", "header"]
#: Rows of a per-column table that are broadcast.
MAX_COLUMNS = 200_000


def near(df: DataFrame) -> DataFrame:
    """df, a table of a row per column, kept, and broadcast if it has MAX_COLUMNS rows at most."""
    df = df.persist()
    return F.broadcast(df) if df.count() <= MAX_COLUMNS else df


def plain_string() -> Column:
    """Whether a cell is a text that profiles count: unformatted and not blank."""
    return (F.col("cell_type") == "string") & ~is_formatted(F.col("value_rich_text")) & F.coalesce(jtrim(F.col("value_string")) != "", F.lit(False))


def counted(item: Column) -> Column:
    """Whether a cell enters the item list: texts that count, and one unique place for all that is no text or is formatted."""
    return item.isNotNull() | (F.col("cell_type") != "string") | is_formatted(F.col("value_rich_text"))


def dup_score(n: Column, unique: Column, parts: Column) -> Column:
    """0 where every item is unique, 1 where all are one."""
    return F.when(n <= 1, F.lit(0.0)).otherwise((2 * n - unique - parts + 1) / (2 * n).cast("double"))


def duplication(table: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, n, n_unique, n_parts, dup) over each column's items. Items are counted per value before the columns are summed, so hot values shrink first."""
    item = F.when(plain_string(), F.col("value_string"))
    rows = table.select(*key, item.alias("item"), counted(item).alias("ok")).filter("ok")
    each = rows.groupBy(*key, "item").agg(F.count(F.lit(1)).alias("c"))
    alone = F.when(F.col("item").isNull(), F.col("c"))
    sums = each.groupBy(*key).agg(
        F.sum("c").alias("n"),
        F.sum(F.coalesce(alone, F.when(F.col("c") == 1, 1).otherwise(0))).cast("bigint").alias("n_unique"),
        F.sum(F.coalesce(alone, F.lit(1))).cast("bigint").alias("n_parts"),
    )
    return sums.withColumn("dup", dup_score(F.col("n"), F.col("n_unique"), F.col("n_parts")))


def type_histogram(table: DataFrame) -> DataFrame:
    """(key, cells of each type, those with a number format, those with formatted text)."""
    is_type = lambda t: F.count_if(F.col("cell_type") == t).alias(f"n_{t}")
    shown = (F.col("cell_type") == "numeric") & F.coalesce(jtrim(F.col("data_format")) != "", F.lit(False))
    return table.groupBy(*KEY).agg(is_type("string"), is_type("numeric"), is_type("boolean"), F.count_if(shown).alias("n_formats"), F.count_if(is_formatted(F.col("value_rich_text"))).alias("n_formatted"))


def content_diversity(table: DataFrame) -> DataFrame:
    """(key, distinct cells over cells, distinct strings over strings)."""
    value = F.coalesce("value_string", F.col("value_numeric").cast("string"), F.col("value_boolean").cast("string"))
    rows = table.select(*KEY, value.alias("v"), F.when(plain_string(), F.col("value_string")).alias("s"))
    return rows.groupBy(*KEY).agg((F.count_distinct("v") / F.count("v")).alias("cell_diversity"), F.try_divide(F.count_distinct("s"), F.count("s")).alias("string_diversity"))


def token_diversity(table: DataFrame) -> DataFrame:
    """(key, n_tokens, distinct tokens over tokens)."""
    each = table.filter(plain_string()).select(*KEY, F.explode(tokens(F.col("value_string"))).alias("t")).groupBy(*KEY, "t").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(*KEY).agg(F.sum("c").alias("n_tokens"), (F.count(F.lit(1)) / F.sum("c")).alias("token_diversity"))


def char_diversity(table: DataFrame) -> DataFrame:
    """(key, n_chars distinct printable ASCII, whole part of their share of the 95 there are)."""
    each = table.filter(plain_string()).select(*KEY, F.explode(F.split("value_string", "")).alias("c")).filter(F.col("c").rlike("^[\\x20-\\x7e]$")).distinct()
    return each.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_chars")).withColumn("char_diversity", F.floor(F.col("n_chars") / 95).cast("bigint"))


def uri_ratio(table: DataFrame) -> DataFrame:
    return table.filter(plain_string()).groupBy(*KEY).agg(F.avg(is_uri(F.col("value_string")).cast("int")).alias("uri_ratio"))


def length_stats(table: DataFrame) -> DataFrame:
    """(key, min, average, max and deviation of text lengths, blank ones included, and the number of blank ones)."""
    size = F.length("value_string")
    return table.filter("cell_type = 'string'").groupBy(*KEY).agg(F.min(size).cast("bigint").alias("len_min"), F.round(F.avg(size), 6).alias("len_avg"), F.max(size).cast("bigint").alias("len_max"), F.round(F.stddev_pop(size), 6).alias("len_sd"), F.count_if(jtrim(F.col("value_string")) == "").alias("n_blank"))


def number_stats(table: DataFrame) -> DataFrame:
    """(key, min, average, max and deviation of whole numbers, and whether they read as years)."""
    x = F.col("value_numeric")
    ok = table.filter((F.col("cell_type") == "numeric") & (x == F.floor(x)))
    return ok.groupBy(*KEY).agg(F.min(x).alias("num_min"), F.round(F.avg(x), 6).alias("num_avg"), F.max(x).alias("num_max"), F.round(F.stddev_pop(x), 4).alias("num_sd"), ((F.min(x) >= 1900) & (F.max(x) <= 2030)).alias("g_year"))


def separator_counts(table: DataFrame) -> DataFrame:
    """(key, separator, n), formatted texts included."""
    each = table.filter("cell_type = 'string'").select(*KEY, F.explode(separators(F.col("value_string"))).alias("separator"))
    return each.groupBy(*KEY, "separator").agg(F.count(F.lit(1)).alias("n"))


def entity_numbers(table: DataFrame, known: DataFrame) -> DataFrame:
    """(key, n_entities): the distinct trimmed texts of a column that are labels of known."""
    labels = known.select("label").distinct()
    texts = table.filter(plain_string()).select(*KEY, jtrim(F.col("value_string")).alias("label")).distinct()
    return texts.join(labels, "label", "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_entities"))
