"""Semantic types of columns: every hypothesis is scored in one pass, a window picks the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.functions.parse import DOUBLE, INT, parse_dates
from cellarium.functions.text import jtrim
from cellarium.operators.profile import KEY, counted, dup_score, near, plain_string, separator_counts, type_histogram

#: Hypotheses in order of insertion, with their ranks.
HYPOTHESES = (
    ("bool", 0),
    ("num_int", 3),
    ("num_decimal", 4),
    ("format_date", 5),
    ("format_datetime", 5),
    ("str_bool", 4),
    ("str_literal", 0),
    ("str_int", 2),
    ("str_decimal_en", 1),
    ("str_decimal_de", 1),
    ("str_resource", 3),
    ("str_date", 2),
    ("str_datetime", 3),
    ("multi_resources", 4),
    ("multi_int", 0),
)
#: Number formats that show dates, and those that show dates with times or times.
DATE_FORMATS = (
    "TT.MM.JJ", "TT.MM.JJJJ", "T. MMM JJ", "T. MMM JJJJ", "T. MMM. JJJJ", "T. MMMM JJJJ", "NN, T. MMM JJ", "NN TT.MMM JJ", "NN, T. MMMM JJJJ",
    "yy\\-mm\\-d;@", "yyyy\\-mm\\-d;@", "m/dd/yyyy;@", "M/DD/YYYY;@", "d/m/yyyy;@", "mm/dd/yyyy;@", "dd/mm/yyyy;@", "dd/m/yyyy;@", "yy/mm/dd;@", "d/mm/yyyy;@",
    "mm/dd/yy;@", "m/dd/yy;@", "d/m/yy;@", "d/mm/yy;@", "m/d/yy", "MM/DD/YY", "MM/DD/YYYY", "MMM D, YY", "MMM D, YYYY", "D. MMM. YYYY", "MMMM D, YYYY", "D. MMMM YYYY", "NN, MMM D, YY",
)
DATETIME_FORMATS = (
    "HH:MM", "HH:MM:SS", "HH:MM AM/PM", "HH:MM:SS AM/PM", "[HH]:MM:SS", "MM:SS,00", "[HH]:MM:SS,00", "TT.MM.JJJJ HH:MM", "TT.MM.JJ HH:MM", "TT.MM.JJJJ HH:MM:SS", "JJJJ-MM-TT HH:MM:SS", "JJJJ-MM-TT\"T\"HH:MM:SS",
    "m/d/yy\\ h:mm;@", "m/d/yy h:mm", "MM:SS.00", "[HH]:MM:SS.00", "MM/DD/YYYY HH:MM AM/PM", "MM/DD/YY HH:MM AM/PM", "MM/DD/YYYY HH:MM:SS", "YYYY-MM-DD HH:MM:SS", "YYYY-MM-DD\"T\"HH:MM:SS",
)
NAN = float("nan")


def integral(x: Column) -> Column:
    return x == F.floor(x)


def int_text(s: Column) -> Column:
    """No leading zero, and 32 bits after trimming."""
    t = jtrim(s)
    value = F.when(t.rlike(INT) & (F.length(t) <= 18), t).try_cast("bigint")
    return ~s.startswith("0") & F.coalesce(value.between(-2147483648, 2147483647), F.lit(False))


def decimal_text(s: Column) -> Column:
    return ~s.startswith("0") & jtrim(s).rlike(DOUBLE)


def _swapped(s: Column) -> Column:
    return F.translate(s, ".,", ",.")


def cell_tests(dates: Column | None = None) -> dict[str, Column]:
    """Whether a cell speaks for each hypothesis that counts cells. dates: the dates of its text, if they are a column already."""
    kind, s, x, fmt = F.col("cell_type"), F.col("value_string"), F.col("value_numeric"), F.upper("data_format")
    text, number = (kind == "string") & ~F.coalesce(F.col("value_rich_text") != "", F.lit(False)), kind == "numeric"
    dates = parse_dates(s) if dates is None else dates
    day = F.exists(dates, lambda d: (F.length(d) == 10) & ~F.exists(dates, lambda t: (F.length(t) > 10) & t.startswith(d)))
    return {
        "bool": kind == "boolean",
        "num_int": number & integral(x),
        "num_decimal": number & (~integral(x) | (x == 0)),
        "format_date": number & fmt.isin(*sorted({f.upper() for f in DATE_FORMATS})),
        "format_datetime": number & fmt.isin(*sorted({f.upper() for f in DATETIME_FORMATS})),
        "str_int": (text & int_text(s)) | (number & integral(x)),
        "str_decimal_en": (text & decimal_text(s)) | (number & ~integral(x)),
        "str_decimal_de": (text & decimal_text(_swapped(s))) | (number & ~integral(x)),
        "str_date": (text & day) | number,
        "str_datetime": (text & F.exists(dates, lambda d: F.length(d) > 10)) | number,
    }


def bool_score(dup: Column, average: Column) -> Column:
    """Two symbols or fewer: the shorter they are on average, the likelier flags."""
    return dup + (1 - dup) * (1 - (average - 1) / 2.5)


def string_items(table: DataFrame) -> DataFrame:
    """Per column and value: count, from which all string scores follow."""
    item = F.when(plain_string(), F.col("value_string"))
    return table.select(*KEY, item.alias("item"), counted(item).alias("ok")).filter("ok").groupBy(*KEY, "item").agg(F.count(F.lit(1)).alias("c"))


def string_scores(items: DataFrame) -> DataFrame:
    """(key, dup, symbols, bool): symbols is the number of distinct lower-case texts, up to 3."""
    none = F.col("item").isNull()
    sums = items.groupBy(*KEY).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(none, F.col("c")).when(F.col("c") == 1, 1).otherwise(0)).cast("bigint").alias("u"),
        F.sum(F.when(none, F.col("c")).otherwise(1)).cast("bigint").alias("p"),
        F.count_distinct(F.lower(jtrim(F.col("item")))).alias("symbols"),
        (F.sum(F.when(~none, F.col("c") * F.length("item"))) / F.sum(F.when(~none, F.col("c")))).alias("average"),
    )
    dup = dup_score(F.col("n"), F.col("u"), F.col("p"))
    return sums.select(*KEY, dup.alias("dup"), "symbols", F.when(F.col("symbols").between(1, 2), bool_score(dup, F.col("average"))).alias("str_bool"))


def segments(table: DataFrame) -> DataFrame:
    """(key, segment, c): pieces of texts between their column's separators, trimmed; trailing empty pieces are none."""
    found = separator_counts(table).groupBy(*KEY).agg(F.sort_array(F.collect_list("separator")).alias("chars"))
    # One row per column: the separators of a column are a set of characters, not of rows.
    rows = table.filter(plain_string()).join(near(found), KEY)
    last = lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    pieces = rows.select(*KEY, F.split(F.aggregate("chars", F.col("value_string"), lambda s, c: F.replace(F.replace(s, c, F.lit("\x00")), F.upper(c), F.lit("\x00"))), "\x00", -1).alias("p"))
    return pieces.select(*KEY, F.explode(F.slice("p", F.lit(1), last(F.col("p")))).alias("segment")).select(*KEY, jtrim(F.col("segment")).alias("segment")).groupBy(*KEY, "segment").agg(F.count(F.lit(1)).alias("c"))


def multi_scores(table: DataFrame) -> DataFrame:
    """(key, multi_resources, multi_int) of the columns that have separators."""
    full = F.col("segment") != ""
    sums = segments(table).groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(full, F.col("c"))), F.lit(0)).alias("n"),
        F.count_if(full & (F.col("c") == 1)).alias("u"),
        F.count_if(full).alias("p"),
        F.count_if(F.col("segment").rlike(r"^[+-]?\d+$")).alias("ints"),
    )
    ratio = F.coalesce(F.try_divide(F.col("ints"), F.col("p")), F.lit(NAN))
    return sums.select(*KEY, dup_score(F.col("n"), F.col("u"), F.col("p")).alias("multi_resources"), ratio.alias("multi_int"))


def scores(table: DataFrame) -> DataFrame:
    """(key, hypothesis, score, rank, ordinal) of every hypothesis that a column's cells admit."""
    share = {n: F.avg(F.coalesce(t, F.lit(False)).cast("double")).alias(n) for n, t in cell_tests(F.col("__dates")).items()}
    kinds = {k: F.max(F.coalesce(c, F.lit(False))).alias(f"has_{k}") for k, c in {"string": F.col("cell_type") == "string", "numeric": F.col("cell_type") == "numeric", "boolean": F.col("cell_type") == "boolean", "format": F.coalesce(jtrim(F.col("data_format")) != "", F.lit(False))}.items()}
    dated = table.withColumn("__dates", F.when(F.col("cell_type") == "string", parse_dates(F.col("value_string"))))
    shares = dated.groupBy(*KEY).agg(*share.values(), *kinds.values())
    wide = shares.join(string_scores(string_items(table)), KEY, "left").join(multi_scores(table), KEY, "left")
    value = {n: F.col(n) for n, _ in HYPOTHESES if n in share or n in ("str_bool", "multi_resources", "multi_int")} | {"str_literal": 1 - F.col("dup"), "str_resource": F.col("dup")}
    gate = lambda n: F.col("has_boolean") if n == "bool" else F.col("has_numeric") if n.startswith("num_") else F.col("has_format") if n.startswith("format_") else F.col("has_string")
    rows = F.array_compact(F.array(*(F.when(gate(n) & value[n].isNotNull(), F.struct(F.lit(n).alias("hypothesis"), value[n].alias("score"), F.lit(r).alias("rank"), F.lit(i).alias("ordinal"))) for i, (n, r) in enumerate(HYPOTHESES))))
    return wide.select(*KEY, F.explode(rows).alias("h")).select(*KEY, "h.*")


def best(scored: DataFrame) -> DataFrame:
    """One hypothesis per column: highest score (NaN above all), then rank, then order of insertion."""
    order = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), F.col("rank").desc(), "ordinal")
    return scored.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def infer(table: DataFrame) -> DataFrame:
    """(key, hypothesis, score) of each column."""
    return best(scores(table)).select(*KEY, "hypothesis", F.round("score", 9).alias("score"))


def infer_styles(styled: DataFrame) -> DataFrame:
    """(key, style, hypothesis, score) of each style of formatted texts in each column, as cells of its own (from richtext.styled_cells)."""
    joined = F.concat_ws("\x1f", F.coalesce("header", F.lit("")), F.col("style"))
    found = infer(styled.withColumn("header", joined).withColumn("sheet", F.concat_ws("\x1f", "sheet", "style")))
    part = lambda c, i: F.split(c, "\x1f")[i]
    return found.select(part("sheet", 0).alias("sheet"), "col", part("header", 0).alias("header"), part("header", 1).alias("style"), "hypothesis", "score")


def bool_symbols(symbols: list[str]) -> tuple[list[str], list[str]]:
    """(true, false) symbols among two or fewer: x and y make true, `-` and n false and win; of two the order is lexicographic unless the first is false and the second true."""
    polarity = lambda s: not ("-" in s.lower() or "n" in s.lower())
    own = sorted(symbols)
    if len(own) == 1:
        return ([own[0]], []) if polarity(own[0]) else ([], [own[0]])
    first, second = own[:2]
    return ([second], [first]) if not polarity(first) and polarity(second) else ([first], [second])


__all__ = ["best", "bool_symbols", "infer", "scores", "type_histogram"]
