"""Files: workbooks, Turtle, matrices, provenance, contexts, streams."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellarium.operators import challenges, graph, richtext, rules
from cellarium.operators.cells import cells, with_headers
from cellarium.operators.infer import infer, infer_styles
from cellarium.sources import tables, turtle, xlsx
from cellarium.streaming.watch import watch


def test_workbook_to_types(spark, tmp_path):
    rows = [["Name", "Count", "Flag", "When"], *([f"n{i}", i + 0.0, bool(i % 2), f"{i + 1}.3.2020"] for i in range(5))]
    (tmp_path / "a.xlsx").write_bytes(xlsx.workbook_bytes({"One": rows, "Two": [["x"], [None, "y"]]}))
    loaded = xlsx.read_xlsx(spark, str(tmp_path))
    assert {(r["sheet"], r["count"]) for r in loaded.groupBy("sheet").count().collect()} == {("One", 24), ("Two", 2)}
    table = with_headers(loaded.filter("sheet = 'One'").drop("path", "sheet_id", "address", "formula", "background_color"))
    assert {r["header"]: r["hypothesis"] for r in infer(table).collect()} == {"Name": "str_literal", "Count": "num_int", "Flag": "bool", "When": "str_date"}


def test_formulas_and_fills(spark, tmp_path):
    import io
    import zipfile

    data = xlsx.workbook_bytes({"One": [[1.5, "x"]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n).replace(b'<c r="A1"><v>', b'<c r="A1" s="1"><f>SUM(B1:B2)</f><v>'))
        new.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fills><fill><patternFill/></fill><fill><patternFill><fgColor rgb="FFFFCC00"/></patternFill></fill></fills><cellXfs><xf numFmtId="0" fillId="0"/><xf numFmtId="14" fillId="1"/></cellXfs></styleSheet>')
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    got = {r["address"]: (r["value_numeric"], r["formula"], r["background_color"], r["data_format"]) for r in xlsx.read_xlsx(spark, str(tmp_path)).collect()}
    assert got == {"A1": (1.5, "SUM(B1:B2)", "#ffcc00", "mm/dd/yyyy;@"), "B1": (None, None, None, None)}


def test_turtle_round_trip(spark, tmp_path):
    ttl = '@prefix ex: <http://example.org/> .\nex:a a ex:T ; ex:p "x \\"q\\"\\n"@en , 5 , 1.5 ; ex:q [ ex:r true ] .\n# end\n<http://x/y> ex:p """long "one" """ .\n'
    with gzip.open(tmp_path / "a.ttl.gz", "wt") as f:
        f.write(ttl)
    (tmp_path / "b.nt").write_text('<http://x/s> <http://x/p> "v"^^<http://x/t> .\n')
    got = turtle.read_turtle(spark, str(tmp_path))
    assert got.count() == 8
    assert {r["o"] for r in got.filter("p = 'http://example.org/p'").collect()} == {'x "q"\n', "5", "1.5", 'long "one" '}
    turtle.write_n_triples(got, str(tmp_path / "out"))
    lines = [line for p in Path(tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    again = [t for line in lines for t in turtle.parse(line)]
    assert len(again) == 8 and {t[2] for t in again} == {r["o"] for r in got.collect()}


def test_matrix_and_provenance(spark, tmp_path):
    grid = spark.createDataFrame([(0, "a\nb", None), (1, 'say "x"', "c")], "row int, c0 string, c1 string")
    tables.write_matrix(grid, str(tmp_path / "m"))
    assert {(r["row"], r["col"], r["model"]) for r in tables.read_matrix(spark, str(tmp_path / "m")).collect()} == {(0, 0, "a\nb"), (1, 0, 'say "x"'), (1, 1, "c")}
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write("sheet,address,statements\nS,A1,one\nS,B3,two\nS,A1,last\n")
    p = tables.read_provenance(spark, str(tmp_path / "p.csv.gz"))
    assert {tuple(r)[1:] for r in p.collect()} == {("S", 0, 0, "last"), ("S", 2, 1, "two")}
    assert tuple(tables.provenance_range(p).first()) == ("S", 0, 2, 0, 1)
    assert tuple(tables.provenance_dimensions(p).first()) == ("S", 3, 2)


def test_contexts_and_reports():
    found = tables.discover(["/d/b.xlsx", "/d/a.xlsx"])
    assert [d["abbrev"] for d in found] == ["DS0", "DS0-x2c", "DS0-ssc", "DS1", "DS1-x2c", "DS1-ssc"]
    again = tables.load_context(tables.save_context({"dataset": found[1]}))
    assert tables.root_dataset(again["dataset"])["abbrev"] == "DS0"
    assert "<td>&lt;s&gt;</td>" in tables.report([{"sheet": "<s>", "row": 1, "col": 2, "tp": 1, "fn": 0, "fp": 0}])


def test_evaluation_sink(spark, tmp_path):
    rows = spark.createDataFrame([("n", 1.0, 2)], "name string, precision double, tp int")
    tables.write_evaluation(rows, str(tmp_path / "e"))
    back = spark.read.csv(str(tmp_path / "e"), header=True)
    assert back.columns == list(tables.EVALUATION) and back.first()["tp"] == "2"


def test_stream(spark, tmp_path):
    df = spark.range(20).select(F.col("id"), (F.col("id") * 2).alias("even"), F.lit("x").alias("flag"))
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch(spark, str(tmp_path / "in"), df.schema, "s", "id", lambda out, n: seen.extend(out.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["header"]: r["hypothesis"] for r in seen} == {"even": "num_int", "flag": "str_bool"}


def test_discovery_and_pairs(spark, tmp_path):
    for name in ("x/a.xlsx", "y/b.xlsx", "y/All_ProvenanceAsCellComment.xlsx", "y/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    paths = tables.workbook_paths(spark, str(tmp_path))
    found = tables.discover(paths, "DG", start_columns={"b.xlsx": 2})
    assert [(d["abbrev"], d["name"], d["start_column"]) for d in found if not d["parent"]] == [("DG0", "a.xlsx", 0), ("DG1", "b.xlsx", 2)]
    pairs = graph.paired_files(*(spark.createDataFrame([(p,) for p in own], "path string") for own in (["/e/a", "/e/b"], ["/z/a", "/f/a", "/f/c"])))
    assert [tuple(r) for r in pairs.collect()] == [("a", "/e/a", "/f/a")]
    names = spark.createDataFrame([("one.xlsx",), ("two.csv",)], "name string")
    assert [r["name"] for r in graph.named(names, r"\.csv$").collect()] == ["two.csv"]


def test_several_matrix_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"m{i}.csv").write_text("".join(f'"{i}-{r}",\n' for r in range(4)))
    got = tables.read_matrix(spark, str(tmp_path)).collect()
    assert {(r["path"][-5], r["row"], r["model"]) for r in got} == {(str(i), r, f"{i}-{r}") for i in range(3) for r in range(4)}


def test_sets_baseline_and_lines(spark):
    one = spark.range(1).select(graph.sets_of(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("b"), F.lit("c"))).alias("s")).first()["s"]
    assert (one["both"], one["only_a"], one["either"]) == (["b"], ["a"], ["a", "b", "c"])
    mode = lambda v: spark.createDataFrame([("m", x) for x in v] + [("n", 1.0)], "mode string, f double")
    got = {r["mode"]: (r["approach"], r["baseline"], r["gain"]) for r in graph.against_baseline(mode([1.0, 0.5]), mode([0.5]), "mode", "f").collect()}
    assert got == {"m": (0.75, 0.5, 0.25), "n": (1.0, 1.0, 0.0)}
    lines = spark.createDataFrame([("z", "s"), ("a", "t")], "line string, sheet string")
    assert tables.sorted_lines(lines, "line") == ["a", "z"] and {(r["sheet"], r["place"]) for r in tables.sheets_by_name(lines).collect()} == {("s", 0), ("t", 1)}
    assert "<br>" in tables.report([{"sheet": "s", "row": 1, "col": 2, "tp": 2, "fn": 0, "fp": 0}], {("s", 1, 2): {"tp": ["x", "y"]}})


def test_mapping_document_and_run_files(spark, tmp_path):
    table = cells(spark.createDataFrame([(i, 1990 + i, "x" if i % 2 else "-", f"http://a/{i}") for i in range(6)], "k int, year int, flag string, link string"), "s", "k")
    winners = spark.createDataFrame([("s", 0, "num_int"), ("s", 1, "str_bool"), ("s", 2, "str_literal")], "sheet string, col int, hypothesis string")
    mapping = rules.mapping_rows(table, rules.column_rules(table, winners))
    assert {(r["col"], r["function"], r["term_type"], r["datatype"]) for r in mapping.collect()} == {(0, "parseNumber", "Literal", "gYear"), (1, "parseBoolean", "Literal", "boolean"), (2, "value", "IRI", "")}
    turtle.write_n_triples(rules.mapping_triples(mapping), str(tmp_path / "map"))
    lines = [line for p in Path(tmp_path / "map").glob("part-*") for line in p.read_text().splitlines()]
    assert len([t for line in lines for t in turtle.parse(line)]) == len(lines) == 16
    triples = graph.value_triples(table, winners)
    tables.write_provenance(triples, str(tmp_path / "prov"))
    back = tables.read_provenance(spark, str(tmp_path / "prov"))
    assert back.count() == 18 and all("inst://s/A" in r["statements"] for r in back.collect())
    df = spark.createDataFrame([("<http://a/b> <http://a/c> <http://z/d> .",)], "t string")
    assert df.select(turtle.prefixed(F.col("t"), {"a": "http://a/"}).alias("x")).first()["x"] == "a:b a:c <http://z/d> ."
    assert turtle.prefix_header({"a": "http://a/"}) == "@prefix a: <http://a/> .\n"


def test_header_row_of_a_matrix(spark):
    matrix = spark.createDataFrame([("s", 1, 0, "m")], "sheet string, row int, col int, model string")
    head = spark.createDataFrame([("s", 0, "p")], "sheet string, col int, model string")
    assert {tuple(r) for r in graph.with_header_row(matrix, head, 1).collect()} == {("s", 1, 0, "m"), ("s", 0, 0, "p")}
    with pytest.raises(ValueError):
        graph.with_header_row(matrix, head, 2)


def test_formatted_cells_of_a_workbook(spark):
    """Each style of a column of formatted texts is typed alone and gets a property of its own."""
    rows = [(i, f"<b>n{i}</b> {1950 + i} <font color='#ff0000'>{i + 1}.5</font>") for i in range(12)]
    plain = cells(spark.createDataFrame(rows, "k int, v string"), "s", "k")
    styled = richtext.styled_cells(plain.withColumn("value_rich_text", F.col("value_string")))
    types = infer_styles(styled)
    assert {r["style"]: r["hypothesis"] for r in types.collect()} == {"b": "str_literal", "unformatted": "str_int", "font #ff0000": "str_decimal_en"}
    got = graph.styled_triples(styled, types)
    assert {(r["p"].split("/")[-1], r["o_type"].split("#")[-1]) for r in got.collect()} == {("s-0-b-v", "string"), ("s-0-unformatted-v", "gYear"), ("s-0-font_ff0000-v", "decimal")}
    assert got.count() == 36


def test_challenges(spark):
    graphs = challenges.enumerated(spark, 2)
    first = challenges.enumerated(spark, 1).count()
    assert first == 2 and graphs.count() > first
    rows = {r["matcher"]: r for r in challenges.evaluated(challenges.challenges(graphs), ["partial", "complete", "isomorphism"]).collect()}
    assert all(r["challenges"] == graphs.count() and r["truncated"] == 0 for r in rows.values()) and rows["isomorphism"]["mean_f"] > 0.5
    assert challenges.challenges(graphs, 1).count() == graphs.count() - first
    assert challenges.from_cells(graphs.select(F.lit("s").alias("sheet"), F.lit(1).alias("row"), F.lit(1).alias("col"), "graph"), 2, 3).count() == 3
