"""Unit vectors of functions, profiles, matching and rich text."""

import pytest
from pyspark.sql import functions as F

from cellarium.functions import parse, text
from cellarium.operators import entities, graph, infer, match, profile, richtext


def one(spark, rows, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expr.alias("x")).collect()]


def cell_rows(spark, values):
    rows = [("s", i, 0, "h", "string" if isinstance(v, str) else "numeric", v if isinstance(v, str) else None, None if isinstance(v, str) else float(v), None, None, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sheet string, row bigint, col int, header string, cell_type string, value_string string, value_numeric double, value_boolean boolean, value_rich_text string, data_format string")


@pytest.mark.parametrize(("values", "dup"), [("aa", 1.0), ("ab", 0.25), ("aab", 2 / 3), (("a", 0, 0), 1 / 6), ("a", 0.0)])
def test_duplication(spark, values, dup):
    assert profile.duplication(cell_rows(spark, values)).first()["dup"] == pytest.approx(dup)


def test_names(spark):
    assert one(spark, ["Ab  C1-x9"], text.property_name(F.col("v"))) == ["ab_c_x_"]
    assert one(spark, ["A (b)+c"], text.sheet_name(F.col("v"))) == ["Ab_c"]
    assert one(spark, ["\t a\n "], text.jtrim(F.col("v"))) == ["a"]
    assert one(spark, [" http://x", "ftp://x"], text.is_uri(F.col("v"))) == [True, False]
    assert one(spark, ["A1", "AB12", "AAA1"], F.concat_ws(",", text.a1_column(F.col("v")), text.a1_row(F.col("v")))) == ["0,0", "27,11", "702,0"]
    assert one(spark, ["a,b,,", ""], text.split_trimmed(F.col("v"), ",")) == [["a", "b"], []]
    assert one(spark, ["fooBar HTTPServer 12ab"], text.tokens(F.col("v"))) == [["foo", "Bar", "HTTP", "Server", "12", "ab"]]


@pytest.mark.parametrize(("s", "want"), [("ABCD, EFGH", {",": 1}), ("AB 5-CDE11.2", {}), ("a + b", {"+": 1})])
def test_separators(spark, s, want):
    found = {r["separator"]: r["n"] for r in profile.separator_counts(cell_rows(spark, [s])).collect()}
    assert found == want


def test_dates(spark):
    got = one(spark, ["1.7.18", "13/1/2020", "00.00.0000", "20200131", "12.05.2020 10:11:12", "31.12.99 and 2020-02-30", None], parse.parse_dates(F.col("v")))
    assert got == [["2018-07-01"], [], [], ["2020-01-31"], ["2020-05-12", "2020-05-12T10:11:12"], ["1999-12-31"], None]


def test_numbers(spark):
    assert one(spark, ["1999-2003", "a -5 b", "99999999999"], parse.parse_ints(F.col("v"))) == [[1999, 2003], [-5], []]
    assert one(spark, ["1234", "12", "1.5", "12-34"], parse.parse_decimals(F.col("v"))) == [[1234.0], [], [1.5], []]
    assert one(spark, ["1,5"], parse.parse_decimals(F.col("v"), "de")) == [[1.5]]
    assert one(spark, ["0", "05", " 12 ", "99999999999"], infer.int_text(F.col("v"))) == [False, False, True, False]


def test_booleans(spark):
    number = parse.parse_boolean(F.lit("numeric"), F.lit(None).cast("string"), F.col("v"), F.lit(None).cast("boolean"), ["y"], ["n"])
    assert one(spark, [1.0, 0.0, 2.0], number, "v double") == [True, False, None]
    words = parse.parse_boolean(F.lit("string"), F.col("v"), F.lit(None).cast("double"), F.lit(None).cast("boolean"), ["y"], ["n"])
    assert one(spark, ["y", "n", "yn", "yes"], words) == [True, False, None, True]
    assert infer.bool_symbols(["yes", "no"]) == (["yes"], ["no"]) and infer.bool_symbols(["x"]) == (["x"], []) and infer.bool_symbols(["-"]) == ([], ["-"])


def test_serials(spark):
    assert [str(d) for d in one(spark, [60.0, 61.0, 43831.0, -1.0], parse.serial_to_date(F.col("v")), "v double")] == ["1900-03-01", "1900-03-01", "2020-01-01", "None"]
    assert [str(d) for d in one(spark, [43831.5], parse.serial_to_timestamp(F.col("v")), "v double")] == ["2020-01-01 12:00:00"]
    assert one(spark, ["12:00", "06:00:00", "25:00"], parse.convert_time(F.col("v"))) == [0.5, 0.25, None]
    assert one(spark, ["yyyy\\-mm\\-d;@", "0.00", "HH:MM AM/PM", None], parse.is_date_format(F.col("v"))) == [True, False, True, False]


def test_inference(spark):
    best = lambda values: infer.infer(cell_rows(spark, values)).first()["hypothesis"]
    assert best([1, 2, 3]) == "num_int" and best([1.5, 2.5]) == "num_decimal" and best(["12", "13", "14", "15"]) == "str_int"
    assert best(["x", "x", "x"]) == "str_bool" and best(["1.2.2020", "3.4.2021"]) == "str_date"


def test_matching():
    a = [("a", "p", "x", True), ("a", "q", "b", False)]
    e = [("A", "P", "x", True), ("A", "Q", "B", False)]
    want = {"a": "A", "p": "P", "q": "Q", "b": "B"}
    assert match.match(a, e) == match.match_complete(a, e) == match.isomorphic(a, e) == [want]
    assert match.match(a, []) == [] and match.isomorphic(a, a[:1]) == []
    assert match.match(a[:1], e)[0] == {"a": "A", "p": "P"}
    assert match.match(a, e, {"a": "Z"}) != [want]
    assert match.counts_under(a, e, want) == (2, 0, 0) and match.complexity(4, 2) == 12
    assert set(match.match_random(a, e)[0]) == {"a", "p", "q", "b"}


def test_matching_is_invariant_under_renaming():
    import itertools

    for objects in itertools.product("xy", repeat=3):
        g = [("s", f"p{i}", o, True) for i, o in enumerate(objects)]
        h = [("S", f"q{i}", o, True) for i, o in enumerate(objects)]
        assert any(match.counts_under(g, h, m) == (3, 0, 0) for m in match.match(g, h))


def test_rich_text():
    m = "x <b>bold</b><font color='#ff0000'>red</font><font>black</font> y"
    assert richtext.texts_by_tag(m, "b") == ["bold"] and richtext.texts_by_color(m, "#ff0000") == ["red"] and richtext.texts_by_color(m, "") == ["black"]
    assert richtext.unformatted_text(m) == "x y black" and richtext.styles(m) == ["b", "font #000000", "font #ff0000", "unformatted"]


def test_mentions(spark):
    labels = spark.createDataFrame([("new york", "u:ny"), ("york", "u:y"), ("new", "u:n")], "label string, iri string")
    texts = spark.createDataFrame([(1, "in new york, old york"), (2, ""), (3, None)], "k int, t string")
    found = lambda d: {tuple(r) for r in entities.linked(texts, d, "k", "t").collect()}
    assert found(labels) == {(1, "u:ny", 1, 3), (1, "u:y", 1, 17)} and found(labels.limit(0)) == set()


def test_renaming_keeps_confusion(spark):
    t = spark.createDataFrame([(1, "s", "p", "o", "iri"), (1, "s", "q", "x", "literal")], "cell int, s string, p string, o string, o_kind string")
    r = graph.renamed(t, "z")
    mapping = t.select(F.explode(F.array("s", "p", F.lit("o"))).alias("b")).distinct().select(F.concat(F.lit("urn:x:"), F.sha2(F.concat(F.lit("z"), "b"), 256)).alias("a"), "b")
    assert tuple(graph.confusion(graph.substituted(r, mapping), t, ["cell"]).first()) == (1, 2, 0, 0)


def test_header_and_described(spark):
    t = spark.createDataFrame([("s", "p", "o", "iri", "", "t", 1, 2)], "s string, p string, o string, o_kind string, o_type string, sheet string, row int, col int")
    more = spark.createDataFrame([("o", "label", "O", "literal", "")], "s string, p string, o string, o_kind string, o_type string")
    assert graph.described(t, more).count() == 2


def test_human_bytes():
    assert text.human_bytes(10) == "10 B" and text.human_bytes(1536) == "1.5 KiB"


def test_flag_symbols_and_rules(spark):
    from pyspark.sql import functions as F

    from cellarium.operators import rules

    rows = spark.createDataFrame([(["no", "yes"],), (["x"],), (["-"],), (["f", "m"],), (["-", "n"],)], "s array<string>")
    got = [(list(r["f"]["trues"]), list(r["f"]["falses"])) for r in rows.select(rules.flag_symbols(F.col("s")).alias("f")).collect()]
    assert got == [(["yes"], ["no"]), (["x"], []), ([], ["-"]), (["f"], ["m"]), (["-"], ["n"])]
    assert [infer.bool_symbols(s) for s in (["yes", "no"], ["x"], ["-"])] == got[:3]
    text = spark.createDataFrame([("a; b,,B ",)], "t string")
    assert text.select(rules.pieces(F.col("t"), F.array(F.lit(";"), F.lit(","))).alias("p")).first()["p"] == ["a", "b", "B"]


def test_known_entities_are_no_symbols(spark):
    from cellarium.operators import rules
    from cellarium.operators.cells import cells

    table = cells(spark.createDataFrame([(i, "Ann" if i % 2 else "yes") for i in range(6)], "k int, v string"), "s", "k")
    winners = spark.createDataFrame([("s", 0, "str_bool")], "sheet string, col int, hypothesis string")
    known = spark.createDataFrame([("Ann", "urn:a")], "label string, iri string")
    assert rules.column_rules(table, winners).first()["trues"] == ["Ann"] or rules.column_rules(table, winners).first()["falses"]
    r = rules.column_rules(table, winners, known).first()
    assert (r["trues"], r["falses"]) == (["yes"], [])


def test_terms_by_type(spark):
    from pyspark.sql import functions as F

    from cellarium.functions import registry as fr

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    texts = F.array(F.lit("on 1.2.2020"), F.lit("Ann 7"), F.lit('say "x"'))
    entity = F.create_map(F.lit("Ann 7"), F.lit("urn:ann"))
    assert one(fr.terms_of(texts, fr.RR + "IRI", entity=entity)) == ["urn:ann"]
    assert one(fr.terms_of(texts, fr.RR + "Literal", fr.XSD + "date")) == ["2020-02-01"]
    assert one(fr.terms_of(texts, fr.RR + "Literal", fr.XSD + "integer"))[-1] == "7"
    assert one(fr.terms_of(texts, fr.RR + "Literal", fr.XSD + "string")) == ["on 1.2.2020", "Ann 7", 'say "x"']
    assert one(fr.terms_of(texts, entity=entity)) == ["2020-02-01", "urn:ann", 'say "x"']


def test_long_columns_and_days(spark):
    from pyspark.sql import functions as F

    from cellarium.functions import parse, text

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    letters = lambda n: ("" if n < 26 else letters(n // 26 - 1)) + chr(65 + n % 26)
    for n in (0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 2**31 - 1):
        assert one(text.column_letters(F.lit(n))) == letters(n)
    assert str(one(parse.parse_day(F.lit("2020/2/29")))) == "2020-02-29" and one(parse.parse_day(F.lit("2021/2/29"))) is None
    assert one(parse.is_internal_date_format(F.lit(14))) and not one(parse.is_internal_date_format(F.lit(1)))


def test_linking_in_parts(spark):
    """A dictionary searched in parts gives what it gives at once, overlaps resolved across parts."""
    import random

    from pyspark.sql import functions as F

    from cellarium.operators import entities

    rng = random.Random(2)
    labels = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)})
    texts = [(i, "".join(rng.choice("abcd ") for _ in range(60))) for i in range(40)] + [(90, None), (91, "")]
    want = set()
    for k, t in texts:
        at, seen = 0, {}
        while t and at < len(t):
            fit = max((w for w in labels if t.startswith(w, at)), key=len, default="")
            if fit:
                seen.setdefault(fit, []).append(at)
            at += max(len(fit), 1)
        want |= {(k, w, len(p), p[0]) for w, p in seen.items()}
    docs = spark.createDataFrame(texts, "k int, t string")
    dictionary = spark.createDataFrame([(w, w) for w in labels], "label string, iri string")
    for most in (5, 1000):
        assert {tuple(r) for r in entities.linked(docs, dictionary, "k", "t", most).select("k", "iri", "n", "first").collect()} == want
        got = {tuple(r) for r in entities.contained(docs, dictionary, "k", "t", most).collect()}
        assert got == {(k, w) for k, t in texts for w in labels if t and w in t}


def test_matching_beyond_its_tries():
    from cellarium.operators import match

    graph = lambda m, n: [(f"{m}{i}", f"{m}p", f"v{i}", True) for i in range(n)] + [(f"{m}{i}", f"{m}q", f"{m}{(i + 1) % n}", False) for i in range(n)]
    found = match.match(graph("a", 20), graph("e", 20))
    assert len(found) == 1 and found[0] == {**{f"a{i}": f"e{i}" for i in range(20)}, "ap": "ep", "aq": "eq"}
    budget = match.Budget(100)
    assert match.match(graph("a", 20), graph("e", 20), budget=budget) and budget.spent
    assert match.match_complete(graph("a", 6), graph("e", 6)) == [{**{f"a{i}": f"e{i}" for i in range(6)}, "ap": "ep", "aq": "eq"}]
    assert match.match_turtle('<urn:a> <urn:p> "v" .', '<urn:b> <urn:q> "v" .') == [[("urn:a", "urn:b"), ("urn:p", "urn:q")]]
