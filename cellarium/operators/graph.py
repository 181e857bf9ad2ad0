"""Triples: generation from cells, sets of them, substitution, comparison and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarium.functions.parse import parse_decimals, parse_ints, serial_to_date, serial_to_timestamp
from cellarium.functions.parse import dates_only as parse_date_texts
from cellarium.functions.parse import datetimes_only as parse_datetime_texts
from cellarium.functions.text import a1_address, class_iri, jtrim, property_iri, property_name, subject_iri
from cellarium.operators.profile import near
from cellarium.operators.rules import column_rules, parse_flag, pieces

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDF_PROPERTY = "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD = "http://www.w3.org/2001/XMLSchema#"
TRIPLE = ["s", "p", "o", "o_kind", "o_type"]


def _subject() -> Column:
    return subject_iri(F.col("sheet"), a1_address(F.lit(0), F.col("row")))


def type_triples(table: DataFrame) -> DataFrame:
    """A type for the subject of each row, at its row and column 0."""
    rows = table.select("sheet", "row").distinct()
    return rows.select(_subject().alias("s"), F.lit(RDF_TYPE).alias("p"), class_iri(F.col("sheet")).alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_type"), "sheet", "row", F.lit(0).alias("col"))


def property_triples(table: DataFrame) -> DataFrame:
    """Type and label of each column's property."""
    iri = property_iri(F.col("sheet"), F.col("col"), F.col("header"))
    each = table.select("sheet", "col", "header").distinct().select(iri.alias("s"), "header")
    rows = F.array(F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(RDF_PROPERTY).alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_type")), F.struct(F.lit(RDFS_LABEL).alias("p"), F.col("header").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD + "string").alias("o_type")))
    return each.select("s", F.explode(rows).alias("t")).select("s", "t.*")


def values_of() -> Column:
    """(o, o_kind, o_type) values of a cell under the rules of its column, as column_rules() gives them."""
    s, x, kind, h = F.col("value_string"), F.col("value_numeric"), F.col("cell_type"), F.col("hypothesis")
    lit = lambda t: lambda v: F.struct(v.cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.concat(F.lit(XSD), t if isinstance(t, Column) else F.lit(t)).alias("o_type"))
    node = lambda v: F.struct(v.alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_type"))
    entity = lambda v: node(entity_iri(v))
    one = lambda v: F.array_compact(F.array(v))
    of_list = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    flag = parse_flag(kind, s, x, F.col("value_boolean"), of_list(F.col("trues")), of_list(F.col("falses")))
    number = F.when(kind == "numeric", one(x.try_cast("int"))).otherwise(parse_ints(s))
    text = F.coalesce(s, x.cast("string"), F.col("value_boolean").cast("string"))
    return (
        F.when(h.isin("bool", "str_bool"), F.transform(one(flag), lit("boolean")))
        .when(h.isin("num_int", "str_int", "multi_int"), F.transform(number, lit(F.when(F.col("years"), "gYear").otherwise("integer"))))
        .when(h.isin("num_decimal", "str_decimal_en"), F.transform(F.when(kind == "numeric", one(x)).otherwise(parse_decimals(s)), lit("decimal")))
        .when(h == "str_decimal_de", F.transform(F.when(kind == "numeric", one(x)).otherwise(parse_decimals(s, "de")), lit("decimal")))
        .when(h.isin("format_date", "str_date"), F.transform(F.when(kind == "numeric", one(serial_to_date(x).cast("string"))).otherwise(parse_date_texts(s)), lit("date")))
        .when(h.isin("format_datetime", "str_datetime"), F.transform(F.when(kind == "numeric", one(F.date_format(serial_to_timestamp(x), "yyyy-MM-dd'T'HH:mm:ss"))).otherwise(parse_datetime_texts(s)), lit("dateTime")))
        .when(h == "str_resource", F.transform(one(F.when(jtrim(s) != "", jtrim(s))), entity))
        .when(h == "multi_resources", F.transform(F.array_distinct(pieces(s, of_list(F.col("chars")))), entity))
        .when(F.col("links") & s.isNotNull(), F.transform(one(jtrim(s)), node))
        .otherwise(F.transform(one(text), lit("string")))
    )


def value_triples(table: DataFrame, winners: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A triple for each value of each cell, with its place. winners: (sheet, col, hypothesis), one row per column; known: labels of entities."""
    rows = table.join(near(column_rules(table, winners, known)), ["sheet", "col"])
    predicate = property_iri(F.col("sheet"), F.col("col"), F.col("header"))
    return rows.select(_subject().alias("s"), predicate.alias("p"), F.explode(values_of()).alias("v"), "sheet", "row", "col").select("s", "p", "v.*", "sheet", "row", "col")


def styled_triples(table: DataFrame, winners: DataFrame) -> DataFrame:
    """The same for formatted texts, from styled cells and winners by (sheet, col, style); each style has a property of its own."""
    key = F.struct("sheet", "col", "style")
    flat = lambda df: df.withColumn("place", F.struct("sheet", "col")).withColumn("sheet", F.to_json(key))
    rules = column_rules(flat(table), flat(winners)).drop("col").withColumnRenamed("sheet", "key")
    rows = table.withColumn("key", F.to_json(key)).join(near(rules), "key")
    predicate = property_iri(F.col("sheet"), F.col("col"), F.col("header"), F.regexp_replace("style", "[^A-Za-z0-9]+", "_"))
    return rows.select(_subject().alias("s"), predicate.alias("p"), F.explode(values_of()).alias("v"), "sheet", "row", "col").select("s", "p", "v.*", "sheet", "row", "col")


def entity_iri(label: Column) -> Column:
    return F.concat(F.lit("urn:entity:"), F.substring(F.sha2(label, 256), 1, 32))


def entity_triples(labels: DataFrame, known: DataFrame | None = None, kind: str = "urn:type:entity") -> DataFrame:
    """Type and label of each distinct trimmed label that is not yet known (column label in both)."""
    new = labels.select(jtrim(F.col("label")).alias("label")).filter("label <> ''").distinct()
    if known is not None:
        new = new.join(known.select("label"), "label", "left_anti")
    rows = F.array(F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(kind).alias("o"), F.lit("iri").alias("o_kind")), F.struct(F.lit(RDFS_LABEL).alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind")))
    return new.select(entity_iri(F.col("label")).alias("s"), F.explode(rows).alias("t")).select("s", "t.*")


def described(triples: DataFrame, more: DataFrame, properties: str | None = None, hops: int = 1) -> DataFrame:
    """triples with all statements of more about their objects and predicates, placed where those occur.

    properties: a prefix that predicates need to be described. hops: how far statements about the objects of added statements follow.
    """
    place = ["sheet", "row", "col"]
    out = new = triples.select(*TRIPLE, *place)
    for hop in range(hops):
        about = new.filter("o_kind = 'iri'").select(*place, F.col("o").alias("s"))
        if hop == 0:
            named = triples if properties is None else triples.filter(F.col("p").startswith(properties))
            about = about.unionByName(named.select(*place, F.col("p").alias("s")))
        new = about.distinct().join(more, "s").select(*TRIPLE, *place)
        out = out.unionByName(new)
    return out.distinct()


def model_matrix(triples: DataFrame) -> DataFrame:
    """Cells of the matrix as text: the triples of each (sheet, row, col), sorted, one a line."""
    line = F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), F.col("o"), F.lit('"'))), F.lit(" ."))
    return triples.select("sheet", "row", "col", line.alias("line")).groupBy("sheet", "row", "col").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("model"))


def grid(matrix: DataFrame, columns: list[int]) -> DataFrame:
    """The dense grid of a matrix: a row per row, a column c<i> per column number listed."""
    return matrix.groupBy("sheet", "row").pivot("col", columns).agg(F.first("model")).select("sheet", "row", *(F.col(str(c)).alias(f"c{c}") for c in columns))


def plain_triples(table: DataFrame, base: str = "http://example.org/csv/") -> DataFrame:
    """What an extractor without any inference makes of a table: a literal for each cell, of its row's subject and its column's predicate, and a label for each column."""
    column = F.concat(F.lit(base), F.lit("column/"), property_name(F.col("header")))
    value = F.coalesce("value_string", F.col("value_numeric").cast("string"), F.col("value_boolean").cast("string"))
    cells = table.select(F.concat(F.lit(base), F.lit("row/"), F.col("row").cast("string")).alias("s"), column.alias("p"), value.alias("o"), F.lit("literal").alias("o_kind"), "row", "col")
    labels = table.select("header", "col").distinct().select(column.alias("s"), F.lit(RDFS_LABEL).alias("p"), F.col("header").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("bigint").alias("row"), "col")
    return cells.unionByName(labels)


def row_column_matrix(triples: DataFrame, rows: DataFrame, predicates: DataFrame, subjects: DataFrame) -> DataFrame:
    """Places of triples that a row and column extractor made: by row number of the subject and column of the predicate to (col, row + 1), by column of the subject to (col, 0)."""
    joined = triples.join(rows, "s", "left").join(predicates, "p", "left").join(subjects, "s", "left")
    col = F.when(F.col("row_no").isNotNull() & F.col("p_col").isNotNull(), F.col("p_col")).otherwise(F.col("s_col"))
    row = F.when(F.col("row_no").isNotNull() & F.col("p_col").isNotNull(), F.col("row_no") + 1).when(F.col("s_col").isNotNull(), F.lit(0))
    return joined.withColumn("col", col).withColumn("row", row).filter("col is not null and row is not null").select(*triples.columns, "row", "col")


def substituted(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """triples with subjects, predicates and resource objects replaced by a mapping (a to b)."""
    out = triples
    for c, only in (("s", F.lit(True)), ("p", F.lit(True)), ("o", F.col("o_kind") == "iri")):
        to = mapping.select(F.col("a").alias(f"__{c}"), F.col("b").alias(f"__to_{c}"))
        out = out.join(to, (F.col(c) == F.col(f"__{c}")) & only, "left").withColumn(c, F.coalesce(f"__to_{c}", c)).drop(f"__{c}", f"__to_{c}")
    return out.select(*triples.columns)


def renamed(triples: DataFrame, salt: str) -> DataFrame:
    """triples with every resource under a new name, for checks that evaluation does not depend on names."""
    new = lambda c: F.concat(F.lit("urn:x:"), F.sha2(F.concat(F.lit(salt), F.col(c)), 256))
    return triples.withColumn("o", F.when(F.col("o_kind") == "iri", new("o")).otherwise(F.col("o"))).withColumn("s", new("s")).withColumn("p", new("p"))


def with_header_row(matrix: DataFrame, properties: DataFrame, first_row: int = 0) -> DataFrame:
    """matrix with the properties' models (sheet, col, model) in the row before first_row; that row must be empty."""
    taken = matrix.filter(F.col("row") == first_row - 1)
    if not taken.isEmpty():
        raise ValueError(f"row {first_row - 1} already holds cells")
    return matrix.unionByName(properties.select("sheet", F.lit(first_row - 1).cast(matrix.schema["row"].dataType).alias("row"), "col", "model"))


def resources(triples: DataFrame) -> DataFrame:
    """(kind, iri): distinct subjects and resource objects, and properties."""
    nodes = triples.select(F.col("s").alias("iri")).unionByName(triples.filter("o_kind = 'iri'").select(F.col("o").alias("iri"))).distinct()
    return nodes.select(F.lit("node").alias("kind"), "iri").unionByName(triples.select(F.lit("property").alias("kind"), F.col("p").alias("iri")).distinct())


def confusion(actual: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """(key, tp, fn, fp) of the triple sets of each key of expected; one full join of distinct triples instead of three set operations."""
    on = [*key, "s", "p", "o", "o_kind"]
    a = actual.select(*on).distinct().withColumn("a", F.lit(1))
    e = expected.select(*on).distinct().withColumn("e", F.lit(1))
    both = a.join(e, on, "full")
    count = lambda c: F.count_if(c)
    sums = both.groupBy(*key).agg(count(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("tp"), count(F.col("a").isNull()).alias("fn"), count(F.col("e").isNull()).alias("fp"), F.max("e").alias("asked"))
    return sums.filter("asked = 1").drop("asked")


def f_score(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where precision and recall are 0, NaN where nothing was found."""
    nan = F.lit(float("nan"))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), nan), F.coalesce(F.try_divide(tp, tp + fn), nan)
    return F.when(p + r == 0, 0.0).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), nan))


def best_solution(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Per key the row with the highest F, to nine places; of equal ones, and where there is no F, the last by order wins. One aggregate, no sort."""
    f = F.round(f_score(F.col("tp"), F.col("fp"), F.col("fn")), 9)
    top = rows.groupBy(*key).agg(F.max(F.struct(f.alias("f"), F.struct(*order).alias("order"), F.struct(*rows.columns).alias("row"))).alias("best"))
    return top.select("best.row.*", "best.f")


def micro_totals(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, tp, fp, fn, accuracy, precision, recall, f) over all cells."""
    sums = rows.groupBy(*key).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return sums.select(*key, "tp", "fp", "fn", r.alias("accuracy"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f_score"))


def suggestion_maxima(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each measure's maximum over suggestions, independently."""
    return rows.groupBy(*key).agg(*(F.max(c).alias(c) for c in ("tp", "fp", "fn")), F.max(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), F.max(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), F.count(F.lit(1)).alias("suggestions"))


def mode_summary(rows: DataFrame, mode: str, value: str) -> DataFrame:
    """(mode, n, mean, deviation)."""
    return rows.groupBy(mode).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev(value), 6).alias("sd"))


def power_set(items: Column) -> Column:
    """All subsets of an array, by the bits of their number."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(items)) - 1), lambda m: F.filter(items, lambda x, i: F.call_function("getbit", m, i) == 1))


def applicable(approaches: DataFrame, datasets: DataFrame) -> DataFrame:
    """(approach, dataset) pairs that share a tag, by a join on tags."""
    a = approaches.select("approach", F.explode("tags").alias("tag"))
    d = datasets.select("dataset", F.explode("tags").alias("tag"))
    return a.join(d, "tag").select("approach", "dataset").distinct()




def named(rows: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """Rows whose name matches a pattern."""
    return rows.filter(F.col(name).rlike(pattern))


def paired_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, expected, actual): files of the same name, from rows of path; of several actual ones the first path counts."""
    by_name = lambda df, to: df.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.min("path").alias(to))
    return by_name(expected, "expected").join(by_name(actual, "actual"), "name")


def against_baseline(approach: DataFrame, baseline: DataFrame, on: str, value: str) -> DataFrame:
    """(on, approach, baseline, gain) of the mean value by mode."""
    mean = lambda df, to: df.groupBy(on).agg(F.avg(value).alias(to))
    both = mean(approach, "approach").join(mean(baseline, "baseline"), on)
    return both.withColumn("gain", F.col("approach") - F.col("baseline"))


def sets_of(a: Column, b: Column) -> Column:
    """(both, only_a, either) of two arrays as sets, sorted."""
    return F.struct(F.sort_array(F.array_intersect(a, b)).alias("both"), F.sort_array(F.array_except(a, b)).alias("only_a"), F.sort_array(F.array_union(a, b)).alias("either"))
