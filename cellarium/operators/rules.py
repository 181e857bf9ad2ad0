"""Output rules of columns: what the cells of a column become beyond its hypothesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions.parse import parse_ints
from cellarium.functions.text import is_uri, jtrim, property_iri
from cellarium.operators.infer import int_text, integral
from cellarium.operators.profile import near, plain_string, separator_counts

COLUMN = ["sheet", "col"]
#: First and last year that a column of years holds, the share of links from which a column is one of links, and characters that make a symbol true or false.
YEARS = (1900, 2030)
LINK_SHARE = 0.75
TRUE_MARKS, FALSE_MARKS = ("x", "y"), ("-", "n")


def is_true_symbol(symbol: Column, default: bool) -> Column:
    """What a symbol's characters say; false ones win, and without either the default holds."""
    has = lambda marks: F.greatest(*(symbol.contains(m) for m in marks))
    return F.when(has(FALSE_MARKS), False).when(has(TRUE_MARKS), True).otherwise(default)


def flag_symbols(symbols: Column) -> Column:
    """(trues, falses) of a sorted array of one or two lower-case symbols: the first is true unless it says false, alone or with a true one beside it."""
    one, two = F.get(symbols, F.lit(0)), F.get(symbols, F.lit(1))
    first, second = is_true_symbol(one, True), is_true_symbol(two, False)
    pair = lambda a, b: F.struct(F.array_compact(F.array(a)).alias("trues"), F.array_compact(F.array(b)).alias("falses"))
    none = F.lit(None).cast("string")
    alone = F.when(first, pair(one, none)).otherwise(pair(none, one))
    return F.when(F.size(symbols) == 1, alone).when(F.size(symbols) == 2, F.when(~first & second, pair(two, one)).otherwise(pair(one, two)))


def parse_flag(cell_type: Column, text: Column, number: Column, boolean: Column, trues: Column, falses: Column) -> Column:
    """As parse_boolean, with symbols in columns."""
    count = lambda symbols: F.size(F.filter(symbols, lambda s: text.contains(s)))
    fuzzy = F.when(count(trues) > count(falses), True).when(count(trues) < count(falses), False)
    of_text = F.when(F.array_contains(trues, text), True).when(F.array_contains(falses, text), False).otherwise(fuzzy)
    return F.when(cell_type == "string", of_text).when(cell_type == "boolean", boolean).when(number == 1, True).when(number == 0, False)


def column_rules(table: DataFrame, winners: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(sheet, col, hypothesis, years, links, trues, falses, chars) of each column of winners.

    years: its whole numbers all read as years. links: more than LINK_SHARE of its texts are links. trues and
    falses: its flag symbols, null beyond two; labels of known are entities, no symbols. chars: its separators.
    """
    own = table.join(near(winners.select(*COLUMN, "hypothesis")), COLUMN)
    s, x, h = F.col("value_string"), F.col("value_numeric"), F.col("hypothesis")
    whole = F.when(integral(x), F.array(x.try_cast("int"))).when(h == "multi_int", parse_ints(s)).when((h != "num_int") & int_text(s), F.array(jtrim(s).try_cast("int")))
    item = F.when(plain_string(), s)
    sums = own.groupBy(*COLUMN, "hypothesis").agg(F.min(F.array_min(whole)).alias("least"), F.max(F.array_max(whole)).alias("most"), F.avg(is_uri(item).cast("int")).alias("uris"))
    symbols = own.filter(h.isin("bool", "str_bool") & item.isNotNull())
    if known is not None:
        symbols = symbols.join(known.select(F.col("label").alias("value_string")), "value_string", "left_anti")
    # A column with this hypothesis has two symbols at most.
    symbols = symbols.groupBy(*COLUMN, F.lower(jtrim(s)).alias("low")).agg(F.max(s).alias("symbol")).groupBy(*COLUMN).agg(F.sort_array(F.collect_list(F.struct("low", "symbol"))).alias("all"))
    lows = F.transform("all", lambda a: a["low"])
    spelt = lambda part: F.transform(part, lambda v: F.filter("all", lambda a: a["low"] == v)[0]["symbol"])
    flags = symbols.filter(F.size("all") <= 2).withColumn("f", flag_symbols(lows)).select(*COLUMN, spelt(F.col("f.trues")).alias("trues"), spelt(F.col("f.falses")).alias("falses"))
    lists = own.filter(h.isin("multi_resources", "multi_int"))
    chars = separator_counts(lists).groupBy(*COLUMN).agg(F.sort_array(F.collect_set("separator")).alias("chars"))
    years = F.coalesce((F.col("least") >= YEARS[0]) & (F.col("most") <= YEARS[1]), F.lit(False))
    links = F.coalesce(F.col("uris") > LINK_SHARE, F.lit(False))
    rules = sums.join(flags, COLUMN, "left").join(chars, COLUMN, "left")
    return rules.select(*COLUMN, "hypothesis", years.alias("years"), links.alias("links"), "trues", "falses", "chars")


def pieces(text: Column, chars: Column) -> Column:
    """Trimmed pieces of a text between separator characters, in either case; empty ones are none."""
    marked = F.aggregate(chars, text, lambda s, c: F.replace(F.replace(s, c, F.lit("\x00")), F.upper(c), F.lit("\x00")))
    return F.filter(F.transform(F.split(marked, "\x00", -1), lambda p: jtrim(p)), lambda p: p != "")


#: Function, term type and datatype of each hypothesis, as mapping documents name them.
OUTPUT = {
    "bool": ("parseBoolean", "Literal", "boolean"),
    "str_bool": ("parseBoolean", "Literal", "boolean"),
    "num_int": ("parseNumber", "Literal", "integer"),
    "str_int": ("parseNumber", "Literal", "integer"),
    "multi_int": ("parseNumber", "Literal", "integer"),
    "num_decimal": ("parseNumber", "Literal", "decimal"),
    "str_decimal_en": ("parseNumber", "Literal", "decimal"),
    "str_decimal_de": ("parseNumber", "Literal", "decimal"),
    "format_date": ("parseDate", "Literal", "date"),
    "str_date": ("parseDate", "Literal", "date"),
    "format_datetime": ("parseDateTime", "Literal", "dateTime"),
    "str_datetime": ("parseDateTime", "Literal", "dateTime"),
    "str_resource": ("entityLinking", "IRI", ""),
    "multi_resources": ("entityLinking", "IRI", ""),
    "str_literal": ("value", "Literal", "string"),
}
_RR, _RML, _FNML, _XSD = "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#", "http://semweb.mmlab.be/ns/fnml#", "http://www.w3.org/2001/XMLSchema#"


def mapping_rows(table: DataFrame, rules: DataFrame) -> DataFrame:
    """The mapping as data: (sheet, col, predicate, function, term_type, datatype, trues, falses, chars) of each column with rules."""
    headers = table.groupBy(*COLUMN).agg(F.min("header").alias("header"))
    known = F.create_map(*(F.lit(x) for h, o in OUTPUT.items() for x in (h, "|".join(o))))
    part = lambda i: F.split(known[F.col("hypothesis")], r"\|")[i]
    linked = F.col("links") & (F.col("hypothesis") == "str_literal")
    datatype = F.when(linked, "").when((part(2) == "integer") & F.col("years"), "gYear").otherwise(part(2))
    return rules.join(headers, COLUMN).select(*COLUMN, property_iri(F.col("sheet"), F.col("col"), F.col("header")).alias("predicate"), part(0).alias("function"), F.when(linked, "IRI").otherwise(part(1)).alias("term_type"), datatype.alias("datatype"), "trues", "falses", "chars")


def mapping_triples(mapping: DataFrame) -> DataFrame:
    """(s, p, o, o_kind, o_type) of the mapping document of mapping_rows()."""
    s = F.concat(F.lit("urn:map:"), F.xxhash64("sheet").cast("string"), F.lit(":"), F.col("col").cast("string"))
    row = lambda p, o, kind: F.when(o.isNotNull() & (o != ""), F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit("" if kind == "iri" else _XSD + "string").alias("o_type")))
    symbols = lambda c: F.array_join(c, " ")
    rows = F.array_compact(
        F.array(
            row(_RML + "reference", F.concat_ws("/", "sheet", F.col("col").cast("string")), "literal"),
            row(_RR + "predicate", F.col("predicate"), "iri"),
            row(_RR + "termType", F.concat(F.lit(_RR), F.col("term_type")), "iri"),
            row(_RR + "datatype", F.when(F.col("datatype") != "", F.concat(F.lit(_XSD), F.col("datatype"))), "iri"),
            row(_FNML + "functionValue", F.concat(F.lit("urn:function:"), F.col("function")), "iri"),
            row("urn:parameter:trueSymbols", symbols("trues"), "literal"),
            row("urn:parameter:falseSymbols", symbols("falses"), "literal"),
            row("urn:parameter:separators", symbols("chars"), "literal"),
        )
    )
    return mapping.select(s.alias("s"), F.explode(rows).alias("t")).select("s", "t.*")
