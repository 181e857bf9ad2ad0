"""Functions by name, with what mapping documents need to know about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions import parse, text
from cellarium.operators import richtext

XSD = "http://www.w3.org/2001/XMLSchema#"


def split_index(s: Column, pattern: str, index: int) -> Column:
    """The trimmed piece at an index between separators, null beyond the last."""
    return F.get(text.split_trimmed(s, pattern), F.lit(index))


def if_regex_else(s: Column, pattern: str, yes: Column, no: Column) -> Column:
    return F.when(s.rlike(pattern), yes).otherwise(no)


def regex_groups(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of every match."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def zipped(left: Column, right: Column) -> Column:
    """Pairs of two lists, the shorter one filled with nulls."""
    return F.arrays_zip(left, right)


def camel_words(s: Column) -> Column:
    """CamelCase with spaces."""
    return F.regexp_replace(s, "(?<=[a-z])(?=[A-Z])", " ")


def equal_pairs(mapping: Column) -> Column:
    """Pairs of a map whose key and value are equal."""
    return F.size(F.map_filter(mapping, lambda k, v: k == v))


def locale_numbers(s: Column, locale: str = "en") -> Column:
    """Numbers with grouping and decimal marks of a locale (en: 1,234.5; de: 1.234,5)."""
    group, mark = (",", ".") if locale == "en" else (".", ",")
    found = F.regexp_extract_all(s, F.lit(rf"[+-]?\d[\d\{group}]*(?:\{mark}\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(F.replace(x, F.lit(group), F.lit("")), F.lit(mark), F.lit(".")).try_cast("double"))


RR = "http://www.w3.org/ns/r2rml#"


def terms_of(texts: Column, term_type: str | None = None, datatype: str | None = None, entity: Column | None = None) -> Column:
    """The terms of a list of texts: entities for IRIs (entity: a map from text to IRI), values of a datatype for literals, whatever is found first without a term type."""
    link = lambda t: F.element_at(entity, t) if entity is not None else F.lit(None).cast("string")
    strings = lambda values: F.transform(values, lambda v: v.cast("string"))
    if not term_type:
        return F.transform(texts, lambda t: parse.autodetect(t, link(t)))
    if term_type == RR + "IRI":
        return F.array_compact(F.transform(texts, link))
    of_type = {"date": parse.dates_only, "dateTime": parse.datetimes_only, "integer": parse.parse_ints, "decimal": parse.parse_decimals}
    own = of_type.get((datatype or "").removeprefix(XSD))
    return F.flatten(F.transform(texts, lambda t: strings(own(t)))) if own else texts


def flag(s: Column, trues: tuple[str, ...] = ("true", "yes", "y", "x"), falses: tuple[str, ...] = ("false", "no", "n", "-")) -> Column:
    """The flag that a text is, by common symbols."""
    return parse.parse_boolean(F.lit("string"), F.lower(text.jtrim(s)), F.lit(None).cast("double"), F.lit(None).cast("boolean"), list(trues), list(falses))


#: Name, function of one text column, and the type of its values; lists are marked.
FUNCTIONS: dict[str, tuple[Callable[[Column], Column], str, bool]] = {
    "parseDate": (parse.dates_only, XSD + "date", True),
    "parseDateTime": (parse.datetimes_only, XSD + "dateTime", True),
    "parseBoolean": (flag, XSD + "boolean", False),
    "autodetect": (lambda s: parse.autodetect(s, F.lit(None).cast("string")), XSD + "string", False),
    "getEntitiesByBold": (lambda s: richtext.by_tag(s, "b"), XSD + "string", True),
    "getEntitiesByUnformatted": (richtext.unformatted, XSD + "string", True),
    "getEntitiesByBlack": (lambda s: richtext.by_color(s, richtext.BLACK), XSD + "string", True),
    "parseInts": (parse.parse_ints, XSD + "integer", True),
    "parseDecimals": (parse.parse_decimals, XSD + "decimal", True),
    "localeNumbers": (locale_numbers, XSD + "decimal", True),
    "propertyName": (text.property_name, XSD + "string", False),
    "sheetName": (text.sheet_name, XSD + "string", False),
    "camelWords": (camel_words, XSD + "string", False),
    "separators": (text.separators, XSD + "string", True),
    "isUri": (text.is_uri, XSD + "boolean", False),
    "isDateFormat": (parse.is_date_format, XSD + "boolean", False),
    "convertTime": (parse.convert_time, XSD + "decimal", False),
}


def apply(name: str, column: Column) -> Column:
    """A registered function of a column; KeyError names one that is missing."""
    return FUNCTIONS[name][0](column)


def descriptions(spark: SparkSession) -> DataFrame:
    """(s, p, o) descriptions of all functions: type, name, parameter and return."""
    rows = []
    for name, (_, kind, many) in sorted(FUNCTIONS.items()):
        s = f"urn:function:{name}"
        rows += [(s, "type", "Function"), (s, "name", name), (s, "expects", XSD + "string"), (s, "returns", "List" if many else kind), (s, "values", kind)]
    return spark.createDataFrame(rows, "s string, p string, o string")
