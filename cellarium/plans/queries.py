"""The registered queries, each with the SQL that states its result independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions import parse, text
from cellarium.functions.registry import descriptions, if_regex_else, split_index
from cellarium.operators import cells as C
from cellarium.operators import entities as N
from cellarium.operators import graph as G
from cellarium.operators import infer as I
from cellarium.operators import challenges as H
from cellarium.operators import match as M
from cellarium.operators import profile as P
from cellarium.operators import richtext as R
from cellarium.operators import rules as U
from cellarium.operators.compare import evaluated
from cellarium.plans.tables import JTRIM, read, sheets, sql_sheets
from cellarium.sources.tables import EVALUATION, evaluation_table
from cellarium.streaming.watch import inferred_files

QUERIES: dict = {}
SQL: dict[str, str] = {}
STRINGS = {"customer": ["c_name", "c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_brand", "p_type"], "events": ["event_type", "props"], "pages": ["url"]}
MIXED = {"customer": None, "orders": None, "part": None, "events": None}
NUMBERS = {"customer": ["c_nationkey", "c_acctbal"], "part": ["p_size", "p_retailprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _j(c: str) -> str:
    return JTRIM.format(c)


_ITEMS = f"items AS (SELECT sheet, col, header, CASE WHEN kind = 'string' AND {_j('vs')} <> '' THEN vs END AS item, count(*) AS c FROM cells WHERE kind <> 'string' OR {_j('vs')} <> '' GROUP BY ALL)"
_SUMS = "sum(c) AS n, sum(CASE WHEN item IS NULL THEN c WHEN c = 1 THEN 1 ELSE 0 END) AS u, sum(CASE WHEN item IS NULL THEN c ELSE 1 END) AS p"


def _dup(n: str = "n", u: str = "u", p: str = "p") -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE ELSE (2 * {n} - {u} - {p} + 1)::DOUBLE / (2 * {n})::DOUBLE END"


@query(f"WITH {sql_sheets(STRINGS)}, {_ITEMS}, s AS (SELECT sheet, col, header, {_SUMS} FROM items GROUP BY ALL) SELECT sheet, col, header, n::BIGINT AS n, u::BIGINT AS n_unique, p::BIGINT AS n_parts, {_dup()} AS dup FROM s")
def column_duplication(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplication(sheets(spark, sf, STRINGS))


@query(f"WITH {sql_sheets(MIXED)} SELECT sheet, max(\"row\") AS max_row, max(col)::BIGINT AS max_col, count(*) AS n_cells FROM cells GROUP BY sheet")
def cell_table_dims(spark: SparkSession, sf: str) -> DataFrame:
    return C.dimensions(sheets(spark, sf, MIXED))


@query(f"WITH {sql_sheets(MIXED)} SELECT sheet, col, header, count(*) FILTER (kind = 'string') AS n_string, count(*) FILTER (kind = 'numeric') AS n_numeric, 0::BIGINT AS n_boolean, count(fmt) AS n_formats, 0::BIGINT AS n_formatted FROM cells GROUP BY ALL")
def cell_type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.type_histogram(sheets(spark, sf, MIXED))


@query(f"WITH {sql_sheets(STRINGS)} SELECT sheet, col, header, count(DISTINCT vs) / count(vs)::DOUBLE AS cell_diversity, count(DISTINCT vs) FILTER ({_j('vs')} <> '') / (count(vs) FILTER ({_j('vs')} <> ''))::DOUBLE AS string_diversity FROM cells GROUP BY ALL")
def content_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return P.content_diversity(sheets(spark, sf, STRINGS))


_PARTS = {"part": ["p_name", "p_brand", "p_type"]}


@query(f"WITH {sql_sheets(_PARTS)}, t AS (SELECT sheet, col, header, unnest(regexp_extract_all(vs, '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9\\s]+')) AS t FROM cells WHERE {_j('vs')} <> '') SELECT sheet, col, header, count(*) AS n_tokens, count(DISTINCT t) / count(*)::DOUBLE AS token_diversity FROM t GROUP BY ALL")
def token_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return P.token_diversity(sheets(spark, sf, _PARTS))


@query(f"WITH {sql_sheets(_PARTS)}, t AS (SELECT DISTINCT sheet, col, header, unnest(string_split(vs, '')) AS t FROM cells WHERE {_j('vs')} <> '') SELECT sheet, col, header, count(*) AS n_chars, floor(count(*) / 95)::BIGINT AS char_diversity FROM t WHERE regexp_matches(t, '^[\\x20-\\x7e]$') GROUP BY ALL")
def char_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return P.char_diversity(sheets(spark, sf, _PARTS))


_URIS = {"pages": ["url"], "documents": ["text"]}


@query(f"WITH {sql_sheets(_URIS)} SELECT sheet, col, header, avg(CASE WHEN starts_with({_j('vs')}, 'http://') OR starts_with({_j('vs')}, 'https://') THEN 1 ELSE 0 END) AS uri_ratio FROM cells WHERE {_j('vs')} <> '' GROUP BY ALL")
def uri_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return P.uri_ratio(sheets(spark, sf, _URIS))


_TEXTS = {"documents": ["text", "lang", "source"], "conversations": ["role", "text"]}


@query(f"WITH {sql_sheets(_TEXTS)} SELECT sheet, col, header, min(length(vs))::BIGINT AS len_min, round(avg(length(vs)), 6) AS len_avg, max(length(vs))::BIGINT AS len_max, round(stddev_pop(length(vs)), 6) AS len_sd, count(*) FILTER ({_j('vs')} = '') AS n_blank FROM cells WHERE kind = 'string' GROUP BY ALL")
def string_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.length_stats(sheets(spark, sf, _TEXTS))


@query(f"WITH {sql_sheets(NUMBERS)} SELECT sheet, col, header, min(vn) AS num_min, round(avg(vn), 6) AS num_avg, max(vn) AS num_max, round(stddev_pop(vn), 4) AS num_sd, min(vn) >= 1900 AND max(vn) <= 2030 AS g_year FROM cells WHERE vn = floor(vn) GROUP BY ALL")
def numeric_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return P.number_stats(sheets(spark, sf, NUMBERS))


_SEPARATED = {"part": ["p_name", "p_type"], "orders": ["o_orderpriority"], "events": ["props"], "documents": ["text"]}


def _sql_chars() -> str:
    return r"""chars AS (SELECT sheet, col, header, c, p FROM (SELECT sheet, col, header, unnest(string_split(lower(vs), '')) AS c, unnest(list_prepend('^', string_split(lower(vs), ''))) AS p FROM cells WHERE kind = 'string') WHERE c IS NOT NULL AND c <> '' AND NOT regexp_matches(c, '^[a-z0-9_ íáôéóúýù]$') AND (contains(chr(10) || chr(9) || ',;:)]>}', c) OR p = ' '))"""


@query(f"WITH {sql_sheets(_SEPARATED)}, {_sql_chars()} SELECT sheet, col, header, c AS separator, count(*) AS n FROM chars GROUP BY ALL")
def separator_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.separator_counts(sheets(spark, sf, _SEPARATED))


def _sql_small(x: str) -> str:
    return f"CASE WHEN length(ltrim({x}, '0')) <= 6 AND {x} <> '' THEN CAST(coalesce(nullif(ltrim({x}, '0'), ''), '0') AS INTEGER) END"


def sql_dates(c: str) -> str:
    """A list of the dates of a text."""
    lists = []
    for p, g in parse.DATE_SHAPES:
        f = [_sql_small(f"regexp_extract(m, '{p}', {k})") for k in g]
        y0, mo, d = f"({f[0]})", f"({f[1]})", f"({f[2]})"
        y = f"(CASE WHEN {y0} < 30 THEN {y0} + 2000 WHEN {y0} < 100 THEN {y0} + 1900 ELSE {y0} END)"
        longest = f"(CASE WHEN {mo} IN (4, 6, 9, 11) THEN 30 WHEN {mo} = 2 THEN CASE WHEN ({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0 THEN 29 ELSE 28 END ELSE 31 END)"
        ok = f"{y} BETWEEN 0 AND 9999 AND {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND {longest}"
        out = f"printf('%04d-%02d-%02d', {y}, {mo}, {d})"
        if len(g) == 6:
            ok += f" AND ({f[3]}) BETWEEN 0 AND 23 AND ({f[4]}) BETWEEN 0 AND 59 AND ({f[5]}) BETWEEN 0 AND 59"
            out += f" || printf('T%02d:%02d:%02d', {f[3]}, {f[4]}, {f[5]})"
        lists.append(f"list_transform(regexp_extract_all({c}, '{p}'), lambda m: CASE WHEN {ok} THEN {out} END)")
    joined = lists[0]
    for x in lists[1:]:
        joined = f"list_concat({joined}, {x})"
    return f"list_filter(list_distinct({joined}), lambda x: x IS NOT NULL)"


def _share(name: str, tests: dict[str, str], wanted: dict) -> str:
    where = "" if name != "num" else " WHERE kind = 'numeric'"
    cols = ", ".join(f"avg(CASE WHEN {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {n}" for n, t in tests.items())
    return f"WITH {sql_sheets(wanted)}, d AS (SELECT *, {sql_dates('vs')} AS ds FROM cells{where}) SELECT sheet, col, header, {cols} FROM d GROUP BY ALL"


def _sql_int(v: str) -> str:
    t = _j(v)
    return f"(NOT starts_with({v}, '0') AND regexp_matches({t}, '{parse.INT}') AND length({t}) <= 18 AND coalesce(try_cast({t} AS BIGINT), 9999999999) BETWEEN -2147483648 AND 2147483647)"


def _sql_decimal(v: str) -> str:
    return f"(NOT starts_with({v}, '0') AND regexp_matches({_j(v)}, '{parse.DOUBLE}'))"


_WHOLE = "(kind = 'numeric' AND vn = floor(vn))"
_BROKEN = "(kind = 'numeric' AND vn <> floor(vn))"
_UPPER = lambda fs: ", ".join(f"'{f}'" for f in sorted({f.upper() for f in fs}))
TESTS = {
    "bool": "FALSE",
    "num_int": _WHOLE,
    "num_decimal": f"({_BROKEN} OR (kind = 'numeric' AND vn = 0))",
    "format_date": f"(kind = 'numeric' AND upper(fmt) IN ({_UPPER(I.DATE_FORMATS)}))",
    "format_datetime": f"(kind = 'numeric' AND upper(fmt) IN ({_UPPER(I.DATETIME_FORMATS)}))",
    "str_int": f"(kind = 'string' AND {_sql_int('vs')} OR {_WHOLE})",
    "str_decimal_en": f"(kind = 'string' AND {_sql_decimal('vs')} OR {_BROKEN})",
    "str_decimal_de": f"(kind = 'string' AND NOT starts_with(vs, '0') AND {_sql_decimal(chr(39).join(['translate(vs, ', '.,', ', ', ',.', ')']))} OR {_BROKEN})",
    "str_date": "(kind = 'numeric' OR len(list_filter(ds, lambda x: length(x) = 10 AND len(list_filter(ds, lambda y: length(y) > 10 AND starts_with(y, x))) = 0)) > 0)",
    "str_datetime": "(kind = 'numeric' OR len(list_filter(ds, lambda x: length(x) > 10)) > 0)",
}


def _tests(spark: SparkSession, sf: str, names: list[str], wanted: dict) -> DataFrame:
    own = I.cell_tests()
    return sheets(spark, sf, wanted).groupBy(*P.KEY).agg(*(F.avg(F.coalesce(own[n], F.lit(False)).cast("double")).alias(n) for n in names))


def _share_query(name: str, names: list[str], wanted: dict) -> None:
    f = lambda spark, sf: _tests(spark, sf, names, wanted)
    f.__name__ = name
    query(_share(name, {n: TESTS[n] for n in names}, wanted))(f)


_share_query("score_num_int", ["num_int"], NUMBERS)
_share_query("score_num_decimal", ["num_decimal"], NUMBERS)
_share_query("score_num_format", ["format_date", "format_datetime"], {"orders": None, "events": ["ts", "value"]})
_share_query("score_str_int", ["str_int"], {"orders": None, "documents": ["lang", "n_chars"]})
_share_query("score_str_decimal_en", ["str_decimal_en"], {"orders": None, "customer": None})
_share_query("score_str_decimal_de", ["str_decimal_de"], {"orders": None, "customer": None})
_share_query("score_str_date", ["str_date"], {"documents": ["text", "source"], "orders": ["o_orderdate", "o_orderpriority"]})
_share_query("score_str_datetime", ["str_datetime"], {"documents": ["text", "source"], "orders": ["o_orderdate", "o_orderpriority"]})

_STRS = f"strs AS (SELECT sheet, col, header, {_SUMS}, count(DISTINCT lower({_j('item')})) AS symbols, sum(c * length(item))::DOUBLE / sum(CASE WHEN item IS NOT NULL THEN c END)::DOUBLE AS average FROM items GROUP BY ALL)"
_BOOL = f"CASE WHEN symbols BETWEEN 1 AND 2 THEN {_dup()} + (1 - {_dup()}) * (1 - (average - 1) / 2.5::DOUBLE) END"
_FLAGS = {"lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderstatus"], "conversations": ["role"]}


@query(f"WITH {sql_sheets(_FLAGS)}, {_ITEMS}, {_STRS} SELECT sheet, col, header, {_dup()} AS dup, symbols, round({_BOOL}, 9) AS str_bool FROM strs")
def score_str_bool(spark: SparkSession, sf: str) -> DataFrame:
    return I.string_scores(I.string_items(sheets(spark, sf, _FLAGS))).withColumn("str_bool", F.round("str_bool", 9))


@query(f"WITH {sql_sheets(STRINGS)}, {_ITEMS}, {_STRS} SELECT sheet, col, header, {_dup()} AS str_resource, 1 - {_dup()} AS str_literal FROM strs")
def score_str_literal_resource(spark: SparkSession, sf: str) -> DataFrame:
    return I.string_scores(I.string_items(sheets(spark, sf, STRINGS))).select(*P.KEY, F.col("dup").alias("str_resource"), (1 - F.col("dup")).alias("str_literal"))


_SEGMENTS = f"""{_sql_chars()}, seps AS (SELECT sheet, col, header, string_agg(DISTINCT c, '') AS cs FROM chars GROUP BY ALL),
segs AS (SELECT sheet, col, header, {_j('x')} AS segment, count(*) AS c FROM (SELECT cells.sheet, cells.col, cells.header, unnest(string_split(translate(vs, cs || upper(cs), repeat(chr(1), length(cs || upper(cs)))), chr(1))) AS x FROM cells JOIN seps ON cells.sheet = seps.sheet AND cells.col = seps.col WHERE {_j('vs')} <> '') GROUP BY ALL),
multi AS (SELECT *, {_dup()} AS multi_resources, CASE WHEN p = 0 THEN 'NaN'::DOUBLE ELSE ints::DOUBLE / p::DOUBLE END AS multi_int FROM (SELECT sheet, col, header, coalesce(sum(CASE WHEN segment <> '' THEN c END), 0) AS n, count(*) FILTER (segment <> '' AND c = 1) AS u, count(*) FILTER (segment <> '') AS p, count(*) FILTER (regexp_matches(segment, '^[+-]?[0-9]+$')) AS ints FROM segs GROUP BY ALL))"""
_MULTI = {"events": ["props"], "part": ["p_name", "p_type"], "orders": ["o_orderpriority"], "pages": ["url"]}


@query(f"WITH {sql_sheets(_MULTI)}, {_SEGMENTS} SELECT sheet, col, header, multi_resources, multi_int FROM multi")
def score_multi(spark: SparkSession, sf: str) -> DataFrame:
    return I.multi_scores(sheets(spark, sf, _MULTI))


def _sql_hypotheses() -> str:
    value = {n: n for n, _ in I.HYPOTHESES} | {"str_literal": f"1 - {_dup('strs.n', 'strs.u', 'strs.p')}", "str_resource": _dup("strs.n", "strs.u", "strs.p"), "str_bool": _BOOL.replace("n <=", "strs.n <=").replace("2 * n - u - p", "2 * strs.n - strs.u - strs.p").replace("(2 * n)", "(2 * strs.n)")}
    gate = lambda n: "FALSE" if n == "bool" else "has_numeric" if n.startswith("num_") else "has_format" if n.startswith("format_") else "has_string"
    rows = " UNION ALL ".join(f"SELECT shares.sheet, shares.col, shares.header, '{n}' AS hypothesis, {value[n]} AS score, {r} AS rank, {i} AS ordinal FROM shares LEFT JOIN strs ON shares.sheet = strs.sheet AND shares.col = strs.col LEFT JOIN multi ON shares.sheet = multi.sheet AND shares.col = multi.col WHERE {gate(n)}" for i, (n, r) in enumerate(I.HYPOTHESES))
    shares = ", ".join(f"avg(CASE WHEN {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {n}" for n, t in TESTS.items())
    return f"""WITH {sql_sheets(MIXED)}, d AS (SELECT *, {sql_dates('vs')} AS ds FROM cells), shares AS (SELECT sheet, col, header, {shares}, bool_or(kind = 'string') AS has_string, bool_or(kind = 'numeric') AS has_numeric, bool_or(fmt IS NOT NULL) AS has_format FROM d GROUP BY ALL),
{_ITEMS}, {_STRS}, {_SEGMENTS}, h AS ({rows}),
b AS (SELECT *, row_number() OVER (PARTITION BY sheet, col ORDER BY score DESC, rank DESC, ordinal) AS n FROM h WHERE score IS NOT NULL) SELECT sheet, col, header, hypothesis, round(score, 9) AS score FROM b WHERE n = 1"""


@query(_sql_hypotheses())
def infer_column_types(spark: SparkSession, sf: str) -> DataFrame:
    return I.infer(sheets(spark, sf, MIXED))


@query("SELECT doc_id, CAST(len(l) AS BIGINT) AS n, CAST(coalesce(list_sum(l), 0) AS BIGINT) AS total FROM (SELECT doc_id, list_transform(list_filter(list_transform(regexp_extract_all(text, '[+-]?[0-9]+'), lambda s: CASE WHEN length(s) <= 18 THEN CAST(s AS BIGINT) END), lambda v: v BETWEEN -2147483648 AND 2147483647), lambda v: CASE WHEN v BETWEEN -2020 AND -1960 THEN -v ELSE v END) AS l FROM documents WHERE text IS NOT NULL)")
def parse_numbers_int(spark: SparkSession, sf: str) -> DataFrame:
    found = read(spark, sf, "documents").filter("text is not null").select("doc_id", parse.parse_ints(F.col("text")).alias("l"))
    return found.select("doc_id", F.size("l").cast("bigint").alias("n"), F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"SELECT doc_id, unnest(list_transform(list_filter(regexp_extract_all(text, '[+-]?[0-9]+.[0-9]+'), lambda x: regexp_matches(x, '{parse.DOUBLE}')), lambda x: CAST(x AS DOUBLE))) AS value FROM documents")
def parse_numbers_decimal(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.explode(parse.parse_decimals(F.col("text"))).alias("value"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'A' THEN TRUE WHEN l_returnflag = 'N' THEN FALSE END AS flag, count(*) AS n FROM lineitem GROUP BY ALL")
def parse_boolean_flags(spark: SparkSession, sf: str) -> DataFrame:
    flag = parse.parse_boolean(F.lit("string"), F.col("l_returnflag"), F.lit(None).cast("double"), F.lit(None).cast("boolean"), ["A"], ["N"])
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, unnest(list_filter({sql_dates('text')}, lambda x: NOT contains(x, ':'))) AS d FROM documents")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.explode(parse.dates_only(F.col("text"))).alias("d"))


@query(f"SELECT o_orderkey, unnest(list_filter({sql_dates('t')}, lambda x: contains(x, ':'))) AS d FROM (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') AS t FROM orders)")
def parse_datetimes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", F.explode(parse.datetimes_only(F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss"))).alias("d"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def excel_serial_to_date(spark: SparkSession, sf: str) -> DataFrame:
    serial = parse.date_to_serial(F.col("o_orderdate"))
    return read(spark, sf, "orders").select("o_orderkey", parse.serial_to_date(serial).cast("string").alias("d"))


@query("SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) + (hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate)) / 86400.0::DOUBLE AS serial FROM orders")
def date_to_excel_serial(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", parse.date_to_serial(F.col("o_orderdate")).alias("serial"))


@query(f"WITH {sql_sheets(MIXED)} SELECT DISTINCT sheet, col, 'http://example.org/' || sheet || '-' || col || '-' || regexp_replace(lower(header), '[^a-z]+', '_', 'g') AS iri FROM cells")
def property_names(spark: SparkSession, sf: str) -> DataFrame:
    return sheets(spark, sf, MIXED).select("sheet", "col", text.property_iri(F.col("sheet"), F.col("col"), F.col("header")).alias("iri")).distinct()


@query("SELECT n_nationkey, 'inst://nation/A' || (n_nationkey + 1) AS iri, 'type://nation' AS class FROM nation")
def subject_iris(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", text.subject_iri(F.lit("nation"), text.a1_address(F.lit(0), F.col("n_nationkey"))).alias("iri"), text.class_iri(F.lit("nation")).alias("class"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 18278 < 26 THEN '' WHEN p_partkey % 18278 < 702 THEN '' ELSE chr(CAST(65 + (p_partkey % 18278 - 702) // 676 % 26 AS INTEGER)) END || CASE WHEN p_partkey % 18278 < 26 THEN '' ELSE chr(CAST(65 + ((p_partkey % 18278 - 26) // 26) % 26 AS INTEGER)) END || chr(CAST(65 + p_partkey % 18278 % 26 AS INTEGER)) || (p_size + 1) AS address, CAST(p_partkey % 18278 AS INTEGER) AS col, p_size AS \"row\" FROM part")
def a1_addresses(spark: SparkSession, sf: str) -> DataFrame:
    at = read(spark, sf, "part").select("p_partkey", text.a1_address(F.col("p_partkey") % 18278, F.col("p_size")).alias("address"))
    return at.select("p_partkey", "address", text.a1_column(F.col("address")).alias("col"), text.a1_row(F.col("address")).alias("row"))


@query("SELECT l AS label, 'urn:entity:' || substring(sha256(l), 1, 32) AS iri FROM (SELECT DISTINCT trim(p_brand) AS l FROM part) WHERE l NOT IN (SELECT p_brand FROM part WHERE p_partkey <= 3)")
def entity_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    known = part.filter("p_partkey <= 3").select(F.col("p_brand").alias("label"))
    made = G.entity_triples(part.select(F.col("p_brand").alias("label")), known)
    return made.filter(F.col("p") == G.RDFS_LABEL).select(F.col("o").alias("label"), F.col("s").alias("iri"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    words = read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("label")).distinct()
    return words.select("label", G.entity_iri(F.col("label")).alias("iri"))


@query("WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS label FROM benchmark) SELECT DISTINCT conv_id, label FROM conversations, l WHERE contains(text, label)")
def entity_containment(spark: SparkSession, sf: str) -> DataFrame:
    return N.contained(read(spark, sf, "conversations"), _words(spark, sf), "conv_id", "text")


@query(r"""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS label FROM benchmark), p AS (SELECT string_agg(label, '|' ORDER BY length(label) DESC, label) AS p FROM l),
f AS (SELECT doc_id, m, min(place) AS fst, count(*) AS n FROM (SELECT doc_id, m, sum(length(g) + CASE WHEN i > 1 THEN length(before) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (SELECT doc_id, i, ms[i] AS m, gs[i] AS g, CASE WHEN i > 1 THEN ms[i - 1] ELSE '' END AS before FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, p) AS ms, regexp_split_to_array(text, p) AS gs FROM documents, p)))) GROUP BY doc_id, m)
SELECT doc_id, 'urn:entity:' || substring(sha256(m), 1, 32) AS iri, n, fst::BIGINT AS "first", row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, 'urn:entity:' || substring(sha256(m), 1, 32)) AS place FROM f""")
def entity_linking(spark: SparkSession, sf: str) -> DataFrame:
    return N.ranked(N.linked(read(spark, sf, "documents"), _words(spark, sf), "doc_id", "text"), "doc_id")


_GEO = {"nation": None, "region": None}


def _geo(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    table = sheets(spark, sf, _GEO)
    return table, I.infer(table)


_X = "http://www.w3.org/2001/XMLSchema#"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@query(f"""SELECT 'inst://nation/A' || (n_nationkey + 1) AS s, '{_TYPE}' AS p, 'type://nation' AS o, 'iri' AS o_kind, '' AS o_type, 'nation' AS sheet, n_nationkey::BIGINT AS "row", 0 AS col FROM nation
UNION ALL SELECT 'inst://region/A' || (r_regionkey + 1), '{_TYPE}', 'type://region', 'iri', '', 'region', r_regionkey, 0 FROM region
UNION ALL SELECT 'inst://nation/A' || (n_nationkey + 1), 'http://example.org/nation-0-n_name', n_name, 'literal', '{_X}string', 'nation', n_nationkey, 0 FROM nation
UNION ALL SELECT 'inst://nation/A' || (n_nationkey + 1), 'http://example.org/nation-1-n_regionkey', n_regionkey::VARCHAR, 'literal', '{_X}integer', 'nation', n_nationkey, 1 FROM nation
UNION ALL SELECT 'inst://region/A' || (r_regionkey + 1), 'http://example.org/region-0-r_name', r_name, 'literal', '{_X}string', 'region', r_regionkey, 0 FROM region""")
def table_to_triples(spark: SparkSession, sf: str) -> DataFrame:
    table, winners = _geo(spark, sf)
    return G.type_triples(table).unionByName(G.value_triples(table, winners))


_RULED = "SELECT o_orderkey AS k, year(o_orderdate) AS y, ' ' || year(o_orderdate) AS ys, 'http://example.com/' || o_custkey AS url, CASE o_orderstatus WHEN 'F' THEN 'X' ELSE '-' END AS flag, o_orderstatus || '; ' || o_orderpriority AS list, o_orderpriority AS one FROM orders"
_RULED_COLUMNS = ("num_int", "str_int", "str_literal", "str_bool", "multi_resources", "str_resource")


def _sql_ruled() -> str:
    entity = "'urn:entity:' || substring(sha256({}), 1, 32)"
    one = lambda i, c, o, kind, t: f"SELECT 'inst://ruled/A' || (k + 1) AS s, 'http://example.org/ruled-{i}-{c}' AS p, {o} AS o, '{kind}' AS o_kind, '{t and _X + t}' AS o_type, k::BIGINT AS \"row\" FROM r"
    parts = [one(0, "y", "y::VARCHAR", "literal", "gYear"), one(1, "ys", "trim(ys)", "literal", "gYear"), one(2, "url", "url", "iri", ""), one(3, "flag", "CASE WHEN flag = 'X' THEN 'true' ELSE 'false' END", "literal", "boolean")]
    # The list's separator is the semicolon; hyphens do not follow a space.
    parts += [one(4, "list", f"unnest(list_transform(list_distinct(list_transform(string_split(list, ';'), lambda x: trim(x))), lambda x: {entity.format('x')}))", "iri", ""), one(5, "one", entity.format("one"), "iri", "")]
    return f"WITH r AS ({_RULED}) " + " UNION ALL ".join(parts)


@query(_sql_ruled())
def triples_by_column_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Years, links, flags and lists, by what their columns hold."""
    orders = read(spark, sf, "orders")
    year = F.year("o_orderdate")
    rows = orders.select(F.col("o_orderkey").alias("k"), year.alias("y"), F.concat(F.lit(" "), year).alias("ys"), F.concat(F.lit("http://example.com/"), "o_custkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "X").otherwise("-").alias("flag"), F.concat_ws("; ", "o_orderstatus", "o_orderpriority").alias("list"), F.col("o_orderpriority").alias("one"))
    table = C.cells(rows, "ruled", "k")
    winners = spark.createDataFrame([("ruled", i, h) for i, h in enumerate(_RULED_COLUMNS)], "sheet string, col int, hypothesis string")
    return G.value_triples(table, winners).select(*G.TRIPLE, "row")


@query(f"SELECT 'ruled' AS sheet, col, 'http://example.org/ruled-' || col || '-' || header AS predicate, fn AS \"function\", term AS term_type, dt AS datatype, symbols FROM (VALUES (0, 'y', 'parseNumber', 'Literal', 'gYear', ''), (1, 'ys', 'parseNumber', 'Literal', 'gYear', ''), (2, 'url', 'value', 'IRI', '', ''), (3, 'flag', 'parseBoolean', 'Literal', 'boolean', 'X/-'), (4, 'list', 'entityLinking', 'IRI', '', ''), (5, 'one', 'entityLinking', 'IRI', '', '')) t(col, header, fn, term, dt, symbols)")
def mapping_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The mapping of the same columns as data."""
    orders = read(spark, sf, "orders")
    year = F.year("o_orderdate")
    rows = orders.select(F.col("o_orderkey").alias("k"), year.alias("y"), F.concat(F.lit(" "), year).alias("ys"), F.concat(F.lit("http://example.com/"), "o_custkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "X").otherwise("-").alias("flag"), F.concat_ws("; ", "o_orderstatus", "o_orderpriority").alias("list"), F.col("o_orderpriority").alias("one"))
    table = C.cells(rows, "ruled", "k")
    winners = spark.createDataFrame([("ruled", i, h) for i, h in enumerate(_RULED_COLUMNS)], "sheet string, col int, hypothesis string")
    made = U.mapping_rows(table, U.column_rules(table, winners))
    symbols = F.when(F.col("trues").isNotNull(), F.concat_ws("/", F.array_join("trues", ""), F.array_join("falses", ""))).otherwise("")
    return made.select("sheet", "col", "predicate", "function", "term_type", "datatype", symbols.alias("symbols"))


_STYLED = {"part": ["p_name", "p_size", "p_brand"]}


def _sql_styled() -> str:
    sub = lambda i, style, c: f"SELECT 'part' AS sheet, CAST(p_partkey AS BIGINT) AS \"row\", {i} AS col, '{style}' AS header, 'string' AS kind, {c} AS vs, NULL::DOUBLE AS vn, NULL AS fmt FROM part"
    cells = "cells AS (" + " UNION ALL ".join([sub(0, "b", "regexp_replace(trim(p_name), '\\s+', ' ', 'g')"), sub(1, "font #ff0000", "p_size::VARCHAR"), sub(2, "unformatted", "p_brand")]) + ")"
    sql = _sql_hypotheses().replace(sql_sheets(MIXED), cells)
    return f"SELECT sheet, 0 AS col, 'rich' AS header, header AS style, hypothesis, score FROM ({sql})"


@query(_sql_styled())
def infer_styles(spark: SparkSession, sf: str) -> DataFrame:
    """Formatted texts, a bold, a red and an unformatted part each, typed by style."""
    part = read(spark, sf, "part")
    escaped = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rich = F.concat(F.lit("<b>"), escaped("p_name"), F.lit("</b> "), escaped("p_brand"), F.lit(" <font color='#ff0000'>"), F.col("p_size").cast("string"), F.lit("</font>"))
    plain = C.cells(part.select("p_partkey", rich.alias("rich")), "part", "p_partkey")
    return I.infer_styles(R.styled_cells(plain.withColumn("value_rich_text", F.col("value_string"))))


@query("SELECT 6990::BIGINT AS graphs, 2 AS smallest, 4 AS largest".replace("2 AS smallest", "1 AS smallest"))
def challenge_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """All graphs of up to four statements; their number is published."""
    graphs = H.enumerated(spark, 4)
    return graphs.agg(F.count(F.lit(1)).alias("graphs"), F.min(F.size("graph")).alias("smallest"), F.max(F.size("graph")).alias("largest"))


@query()
def matching_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """All matchers on the graphs of up to two statements and renamed copies of them."""
    return H.evaluated(H.challenges(H.enumerated(spark, 2)))


_STREAM = {"customer": None}


@query(_sql_hypotheses().replace(sql_sheets(MIXED), sql_sheets(_STREAM)))
def streaming_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Column types of customer, read as a stream."""
    return inferred_files(spark, f"{sf}/customer.parquet", "customer", "c_custkey")


@query("SELECT n_nationkey::BIGINT AS \"row\", n_name AS own, (n_regionkey)::DOUBLE AS number FROM nation")
def cell_offset_reference(spark: SparkSession, sf: str) -> DataFrame:
    table = sheets(spark, sf, {"nation": None})
    right = table.withColumn("value_string", F.col("value_numeric").cast("string"))
    both = C.beside(table.filter("col = 0").unionByName(right.filter("col = 1")), 1)
    return both.select("row", F.col("value_string").alias("own"), F.col("beside").cast("double").alias("number"))


_CSV = "http://example.org/csv/"


@query(f"""SELECT '{_CSV}row/' || n_nationkey AS s, '{_CSV}column/n_name' AS p, n_name AS o, n_nationkey + 1 AS "row", 0 AS col FROM nation
UNION ALL SELECT '{_CSV}row/' || n_nationkey, '{_CSV}column/n_regionkey', CAST(n_regionkey::DOUBLE AS VARCHAR), n_nationkey + 1, 1 FROM nation
UNION ALL SELECT '{_CSV}column/' || x, 'http://www.w3.org/2000/01/rdf-schema#label', x, 0, i FROM (VALUES ('n_name', 0), ('n_regionkey', 1)) t(x, i)""")
def row_column_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Triples without inference, put back at the cells they came from by what they say."""
    made = G.plain_triples(sheets(spark, sf, {"nation": None}))
    rows = made.filter("row is not null").select("s", F.col("row").alias("row_no")).distinct()
    predicates = made.filter("row is not null").select("p", F.col("col").alias("p_col")).distinct()
    subjects = made.filter("row is null").select("s", F.col("col").alias("s_col")).distinct()
    return G.row_column_matrix(made.select("s", "p", "o", "o_kind"), rows, predicates, subjects).select("s", "p", "o", "row", "col")


@query(f"WITH {sql_sheets(_PARTS)} SELECT sheet, col, header, count(DISTINCT vs) AS n_entities FROM cells WHERE vs IN (SELECT p_brand FROM part WHERE p_size > 20) GROUP BY ALL")
def entity_numbers(spark: SparkSession, sf: str) -> DataFrame:
    known = read(spark, sf, "part").filter("p_size > 20").select(F.col("p_brand").alias("label"))
    return P.entity_numbers(sheets(spark, sf, _PARTS), known)


def _perturbed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nation = read(spark, sf, "nation")
    one = lambda o: nation.select(F.col("n_regionkey").alias("cell"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("s"), F.lit("name").alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"))
    return one(F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name"))), one(F.col("n_name"))


_EVALUATED = {"name": "'nation'", "tp": "tp", "fp": "fp", "fn": "fn", "accuracy": "tp::DOUBLE / (tp + fn)", "precision": "tp::DOUBLE / (tp + fp)", "recall": "tp::DOUBLE / (tp + fn)", "f-score": "round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9)"}
_TP = "SELECT n_regionkey AS cell, count(*) FILTER (n_nationkey % 3 <> 0 OR lower(n_name) = n_name) AS tp, count(*) FILTER (n_nationkey % 3 = 0 AND lower(n_name) <> n_name) AS fn, count(*) FILTER (n_nationkey % 3 = 0 AND lower(n_name) <> n_name) AS fp FROM nation GROUP BY n_regionkey"


@query(_TP)
def triple_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return G.confusion(*_perturbed(spark, sf), ["cell"])


@query(f"SELECT 1 AS run, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::DOUBLE / (sum(tp) + sum(fn))::DOUBLE AS accuracy, sum(tp)::DOUBLE / (sum(tp) + sum(fp))::DOUBLE AS \"precision\", sum(tp)::DOUBLE / (sum(tp) + sum(fn))::DOUBLE AS recall, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f_score FROM ({_TP})")
def evaluation_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = G.micro_totals(G.confusion(*_perturbed(spark, sf), ["cell"]).withColumn("run", F.lit(1)), ["run"])
    return totals.withColumn("f_score", F.round("f_score", 9))


@query(f"SELECT 1 AS challenge, max(tp) AS tp, max(fp) AS fp, max(fn) AS fn, max(tp::DOUBLE / (tp + fp)) AS \"precision\", max(tp::DOUBLE / (tp + fn)) AS recall, count(*) AS suggestions FROM ({_TP})")
def suggestion_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return G.suggestion_maxima(G.confusion(*_perturbed(spark, sf), ["cell"]).withColumn("challenge", F.lit(1)), ["challenge"])


@query("SELECT 'inst://nation/A' || (n_nationkey + 1) AS s, CASE WHEN n_regionkey % 2 = 0 THEN 'even' ELSE 'in' END AS p, CASE WHEN n_regionkey % 2 = 0 THEN 'region:even' ELSE 'region:' || n_regionkey END AS o, 'iri' AS o_kind FROM nation WHERE n_regionkey % 2 = 1 UNION ALL SELECT 'inst://nation/A' || (n_nationkey + 1), 'in', 'region:even' || n_regionkey, 'iri' FROM nation WHERE n_regionkey % 2 = 0")
def substitute_terms(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation")
    triples = nation.select(text.subject_iri(F.lit("nation"), text.a1_address(F.lit(0), F.col("n_nationkey"))).alias("s"), F.lit("in").alias("p"), F.concat(F.lit("region:"), F.col("n_regionkey")).alias("o"), F.lit("iri").alias("o_kind"))
    mapping = nation.filter("n_regionkey % 2 = 0").select(F.concat(F.lit("region:"), F.col("n_regionkey")).alias("a"), F.concat(F.lit("region:even"), F.col("n_regionkey")).alias("b")).distinct()
    return G.substituted(triples, mapping)


@query("SELECT kind, cast(iri as VARCHAR) AS iri FROM (SELECT 'node' AS kind, 'n' || n_nationkey AS iri FROM nation UNION SELECT 'property', 'name')")
def distinct_resources(spark: SparkSession, sf: str) -> DataFrame:
    return G.resources(_perturbed(spark, sf)[1])


@query("WITH f AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity::BIGINT AS tp, (l_discount * 100)::BIGINT AS fp, (l_tax * 100)::BIGINT AS fn FROM lineitem), s AS (SELECT *, CASE WHEN tp = 0 AND (fp > 0 AND fn > 0) THEN 0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 'NaN'::DOUBLE ELSE 2.0::DOUBLE * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) END AS f FROM f) SELECT k, tp, fp, fn, round(f, 9) AS f FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(f, 9) DESC, i DESC, tp DESC, fp, fn) AS n FROM s) WHERE n = 1")
def best_solution(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_quantity").cast("bigint").alias("tp"), F.round(F.col("l_discount") * 100).cast("bigint").alias("fp"), F.round(F.col("l_tax") * 100).cast("bigint").alias("fn"))
    return G.best_solution(rows, ["k"], ["l_linenumber", "tp", -F.col("fp"), -F.col("fn")]).select("k", "tp", "fp", "fn", "f")


@query("WITH a(approach, tags) AS (VALUES ('predictor', ['excel', 'csv']), ('baseline', ['csv']), ('renaming', ['graph'])), d(dataset, tags) AS (VALUES ('DS0', ['excel']), ('DS0-x2c', ['csv']), ('DS1', ['excel', 'graph'])) SELECT approach, dataset FROM a, d WHERE list_has_any(a.tags, d.tags)")
def approach_dataset_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.sql("SELECT * FROM VALUES ('predictor', array('excel', 'csv')), ('baseline', array('csv')), ('renaming', array('graph')) AS t(approach, tags)")
    d = spark.sql("SELECT * FROM VALUES ('DS0', array('excel')), ('DS0-x2c', array('csv')), ('DS1', array('excel', 'graph')) AS t(dataset, tags)")
    return G.applicable(a, d)


@query("SELECT i::BIGINT AS subset, array_to_string(list_filter(['a', 'b', 'c', 'd'], lambda x: (i >> (ascii(x) - 97)) & 1 = 1), ',') AS members FROM range(16) t(i)")
def powerset(spark: SparkSession, sf: str) -> DataFrame:
    items = F.array(*(F.lit(x) for x in "abcd"))
    return spark.range(1).select(F.posexplode(G.power_set(items)).alias("subset", "m")).select(F.col("subset").cast("bigint").alias("subset"), F.array_join("m", ",").alias("members"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS sd FROM events GROUP BY event_type")
def mode_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.mode_summary(read(spark, sf, "events"), "event_type", "value")


@query("""SELECT 'nation' AS sheet, n_nationkey::BIGINT AS "row", '<inst://nation/A' || (n_nationkey + 1) || '> <http://example.org/nation-0-n_name> "' || n_name || '" .' || chr(10) || '<inst://nation/A' || (n_nationkey + 1) || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <type://nation> .' AS c0, '<inst://nation/A' || (n_nationkey + 1) || '> <http://example.org/nation-1-n_regionkey> "' || n_regionkey || '" .' AS c1 FROM nation""")
def model_matrix_pivot(spark: SparkSession, sf: str) -> DataFrame:
    table = sheets(spark, sf, {"nation": None})
    return G.grid(G.model_matrix(G.type_triples(table).unionByName(G.value_triples(table, I.infer(table)))), [0, 1])


@query("SELECT count(*) AS n, count(DISTINCT json_extract_string(j, '$.cellType')) AS kinds, sum(CASE WHEN json_extract_string(j, '$.valueString') IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS strings FROM (SELECT to_json({'cellType': 'string', 'valueString': n_name}) AS j FROM nation UNION ALL SELECT to_json({'cellType': 'numeric', 'valueNumeric': n_regionkey}) FROM nation)")
def cell_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    made = C.cell_json(sheets(spark, sf, {"nation": None}))
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get_json_object("json", "$.cellType")).alias("kinds"), F.count(F.get_json_object("json", "$.valueString")).alias("strings"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) WHERE i <= 5 GROUP BY n_regionkey")
def first_of_column(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the first five names of each region."""
    return C.first_of(read(spark, sf, "nation"), ["n_regionkey"], "n_nationkey", "n_name", 5).select(F.col("n_regionkey").alias("region"), F.array_join("values", ",").alias("names"))


@query("SELECT min(o_orderkey) AS first_row, count(*) - 1 AS data_cells, arg_min(o_orderstatus, o_orderkey) AS header FROM orders")
def header_split(spark: SparkSession, sf: str) -> DataFrame:
    raw = sheets(spark, sf, {"orders": ["o_orderstatus"]}).drop("header")
    split = C.with_headers(raw)
    return split.groupBy("header").agg(F.count(F.lit(1)).alias("data_cells")).crossJoin(raw.agg(F.min("row").alias("first_row"))).select("first_row", "data_cells", "header")


@query(f"WITH {sql_sheets({'orders': None, 'customer': None})} SELECT sheet, count(*) AS n FROM cells WHERE sheet = 'orders' AND col >= 1 AND \"row\" BETWEEN 10 AND 500 GROUP BY sheet")
def selected_range(spark: SparkSession, sf: str) -> DataFrame:
    """Sheet list, start column and row range, which are the feature here."""
    return C.selected(sheets(spark, sf, {"orders": None, "customer": None}), ["orders"], 1, (10, 500)).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"))


def _graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Per region two graphs of its nations, the expected one with other names: a name and a place for each, ten statements and more."""
    first = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    row = lambda s, p, o, literal: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))
    own = lambda mark: lambda r: F.array(row(F.concat(F.lit(mark), r["n_nationkey"]), f"{mark}:name", r["n_name"], True), row(F.concat(F.lit(mark), r["n_nationkey"]), f"{mark}:in", F.concat(F.lit(f"{mark}:r"), F.col("n_regionkey")), False))
    graph = lambda mark: F.flatten(F.transform("x", own(mark)))
    return first.select(F.col("n_regionkey").alias("region"), graph("a").alias("actual"), graph("e").alias("expected"))


def _match_query(name: str, matcher: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        found = _graphs(spark, sf).select("region", M.matched(F.col("actual"), F.col("expected"), matcher).alias("m"))
        return found.select("region", F.size("m.solutions").cast("bigint").alias("solutions"), F.size(F.get("m.solutions", F.lit(0))).cast("bigint").alias("pairs"), "m.truncated")

    f.__name__ = name
    query("SELECT n_regionkey AS region, 1::BIGINT AS solutions, count(*) + 3 AS pairs, FALSE AS truncated FROM nation GROUP BY n_regionkey")(f)


for _name, _matcher in (("graph_match_partial", "partial"), ("graph_match_complete", "complete"), ("graph_match_random", "random"), ("graph_match_isomorphism", "isomorphism")):
    _match_query(_name, _matcher)


def _rich(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("<b>"), F.col("n_name"), F.lit("</b> and <font color='#ff0000'>"), F.col("n_regionkey"), F.lit("</font><font>black</font>")).alias("rich"))


@query("SELECT n_nationkey, n_name AS bold FROM nation")
def rich_text_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return _rich(spark, sf).select("n_nationkey", F.explode(R.by_tag(F.col("rich"), "b")).alias("bold"))


@query("SELECT n_nationkey, n_regionkey::VARCHAR AS red FROM nation")
def rich_text_by_color(spark: SparkSession, sf: str) -> DataFrame:
    return _rich(spark, sf).select("n_nationkey", F.explode(R.by_color(F.col("rich"), "#ff0000")).alias("red"))


@query("SELECT n_nationkey, 'and black' AS plain FROM nation")
def rich_text_unformatted(spark: SparkSession, sf: str) -> DataFrame:
    return _rich(spark, sf).select("n_nationkey", F.explode(R.unformatted(F.col("rich"))).alias("plain"))


@query("SELECT " + ", ".join(f"({_EVALUATED.get(c, 'NULL')})::VARCHAR AS \"{c}\"" for c in EVALUATION) + f" FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_TP}))")
def evaluation_rows(spark: SparkSession, sf: str) -> DataFrame:
    totals = G.micro_totals(G.confusion(*_perturbed(spark, sf), ["cell"]).withColumn("name", F.lit("nation")), ["name"])
    return evaluation_table(totals.withColumn("f-score", F.round("f_score", 9)))


@query("""SELECT sheet, tp, fp, fn, tp / (tp + fn)::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS "precision", tp / (tp + fn)::DOUBLE AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f_score FROM (SELECT 'nation' AS sheet, 3 * count(*) - 2 * count(*) FILTER (changed) AS tp, 2 * count(*) FILTER (changed) AS fp, 2 * count(*) FILTER (changed) AS fn FROM (SELECT n_nationkey % 3 = 0 AND lower(n_name) <> n_name AS changed FROM nation))""")
def compared_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Produced triples under other names, a third of the nations' names spelt otherwise, against the expected ones. Statements are aligned from the last one, so a name that differs leaves its cell without a mapping."""
    table, winners = _geo(spark, sf)
    own = table.filter("sheet = 'nation'")
    triples = G.type_triples(own).unionByName(G.value_triples(own, winners)).filter("sheet = 'nation'")
    changed = F.col("p").endswith("-n_name") & (F.col("row") % 3 == 0)
    made = triples.withColumn("o", F.when(changed, F.lower("o")).otherwise(F.col("o")))
    return evaluated(G.renamed(made, "x"), triples).withColumn("f_score", F.round("f_score", 9))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, CASE WHEN regexp_matches(p_brand, '[0-4]$') THEN 'low' ELSE 'high' END AS half FROM part")
def conditional_values(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", split_index(F.col("p_name"), " ", 0).alias("first"), if_regex_else(F.col("p_brand"), "[0-4]$", F.lit("low"), F.lit("high")).alias("half"))


_FUNCTIONS = "autodetect string 0, camelWords string 0, convertTime decimal 0, getEntitiesByBlack string 1, getEntitiesByBold string 1, getEntitiesByUnformatted string 1, isDateFormat boolean 0, isUri boolean 0, localeNumbers decimal 1, parseBoolean boolean 0, parseDate date 1, parseDateTime dateTime 1, parseDecimals decimal 1, parseInts integer 1, propertyName string 0, separators string 1, sheetName string 0"


@query(f"WITH f AS (SELECT unnest(list_transform(string_split('{_FUNCTIONS}', ', '), lambda x: string_split(x, ' '))) AS f) SELECT 'urn:function:' || f[1] AS s, p, CASE p WHEN 'type' THEN 'Function' WHEN 'name' THEN f[1] WHEN 'expects' THEN '{_X}string' WHEN 'returns' THEN CASE f[3] WHEN '1' THEN 'List' ELSE '{_X}' || f[2] END ELSE '{_X}' || f[2] END AS o FROM f, (VALUES ('type'), ('name'), ('expects'), ('returns'), ('values')) v(p)")
def function_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return descriptions(spark)
