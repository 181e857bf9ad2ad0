from pyspark.sql import functions as F

from cellarium.functions import registry as fr
from cellarium.operators.compare import absolute_cell, compared, filtered


def test_property_names_carry_over(spark):
    rows = lambda p, q, v: [("s", 0, 0, f"{p}", "label", "Name", "literal"), ("s", 0, 1, f"{q}", "label", "Age", "literal"), ("s", 1, 0, "x", p, "Ann", "literal"), ("s", 1, 1, "x", q, v, "literal")]
    schema = "sheet string, row int, col int, s string, p string, o string, o_kind string"
    a = spark.createDataFrame(rows("p1", "q1", "7"), schema)
    e = spark.createDataFrame([*rows("P", "Q", "8"), ("s", 9, 9, "y", "P", "z", "literal")], schema)
    got = {(r["row"], r["col"]): (r["tp"], r["fn"], r["fp"]) for r in compared(a, e).collect()}
    assert got == {(0, 0): (1, 0, 0), (0, 1): (1, 0, 0), (1, 0): (1, 0, 0), (1, 1): (0, 1, 1), (9, 9): (0, 1, 0)}


def test_small_functions(spark):
    df = spark.createDataFrame([("a, b,,",)], "v string")
    pick = lambda c: df.select(c.alias("x")).first()["x"]
    assert pick(fr.split_index(F.col("v"), ",", 1)) == "b" and pick(fr.split_index(F.col("v"), ",", 5)) is None
    assert pick(fr.regex_groups(F.lit("k1=a k2=b"), r"\w+=(\w)")) == ["a", "b"]
    assert pick(fr.locale_numbers(F.lit("1,234.5 and 7"))) == [1234.5, 7.0] and pick(fr.locale_numbers(F.lit("1.234,5"), "de")) == [1234.5]
    assert pick(fr.camel_words(F.lit("someMixedName"))) == "some Mixed Name"
    assert pick(fr.equal_pairs(F.create_map(F.lit("a"), F.lit("a"), F.lit("b"), F.lit("c")))) == 1
    assert pick(fr.apply("parseDate", F.lit("1.2.2020"))) == ["2020-02-01"]
    assert len(pick(fr.zipped(F.array(F.lit(1), F.lit(2)), F.array(F.lit("a"))))) == 2


def test_references(spark):
    t = spark.createDataFrame([("s", 0, 0, "title"), ("s", 1, 0, "a"), ("t", 0, 0, "other")], "sheet string, row int, col int, value_string string")
    assert {(r["value_string"], r["x"]) for r in absolute_cell(t, 0, 0, "x").collect()} == {("title", "title"), ("a", "title"), ("other", "other")}
    assert filtered(t, "row > 0 and value_string like 'a%'").count() == 1
