"""CSV model matrices, provenance files, run contexts, evaluation tables and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.functions.text import a1_address, a1_column, a1_row

#: Columns of the evaluation table.
EVALUATION = ("name", "abbrev", "generator", "source", "mode", "preprocessing", "approach", "accuracy", "precision", "recall", "f-score", "tp", "fp", "fn", "relevant", "retrieved", "file-comp", "mod-comp", "approach duration", "evaluation duration", "approach exception", "evaluation exception")


def _numbered(raw: DataFrame) -> DataFrame:
    """raw with the path of each record's file and its number in it. Such files are not split, so a file's records lie in order in one partition."""
    rows = raw.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("__id"))
    first = rows.groupBy("path").agg(F.min("__id").alias("__first"))
    return rows.join(first, "path").withColumn("row", F.col("__id") - F.col("__first")).drop("__id", "__first")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, model) of matrix files without header: their cells that are not empty, by file."""
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"')
    cells = F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).alias("model")) for i, c in enumerate(raw.columns)))
    return _numbered(raw).select("path", "row", F.explode(cells).alias("c")).select("path", "row", "c.*").filter("model is not null and model <> ''")


def write_matrix(grid: DataFrame, path: str) -> None:
    """A dense grid (row and columns c0, c1, ...) without header, rows in order."""
    columns = [c for c in grid.columns if c.startswith("c") and c[1:].isdigit()]
    grid.orderBy("row").select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=False, escape='"')


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, statements) of provenance files; the last statement of an address in its file wins."""
    rows = _numbered(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    last = rows.groupBy("path", "sheet", "address").agg(F.max_by("statements", "row").alias("statements"))
    return last.select("path", "sheet", a1_row(F.col("address")).alias("row"), a1_column(F.col("address")).alias("col"), "statements")


def write_provenance(triples: DataFrame, path: str) -> None:
    """The statements of each cell (sheet, address, statements) as gzipped CSV."""
    from cellarium.operators.graph import model_matrix

    cells = model_matrix(triples).select("sheet", a1_address(F.col("col"), F.col("row")).alias("address"), F.col("model").alias("statements"))
    cells.write.mode("overwrite").option("compression", "gzip").csv(path, header=True, escape='"')


def provenance_range(table: DataFrame) -> DataFrame:
    """(sheet, min_row, max_row, min_col, max_col)."""
    return table.groupBy("sheet").agg(*(f(c).cast("bigint").alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))))


def provenance_dimensions(table: DataFrame) -> DataFrame:
    """(sheet, rows, cols)."""
    return table.groupBy("sheet").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def ragged_dimension(lines: DataFrame, record: str) -> DataFrame:
    """(width, height) of records of unequal size."""
    return lines.agg(F.max(F.size(record)).cast("bigint").alias("width"), F.count(F.lit(1)).alias("height"))


def evaluation_table(rows: DataFrame) -> DataFrame:
    """rows with all columns of the evaluation table, missing ones null."""
    return rows.select(*(F.col(f"`{c}`").cast("string") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EVALUATION))


def write_evaluation(rows: DataFrame, path: str) -> None:
    evaluation_table(rows).coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_context(context: dict) -> str:
    """A run's context, with its dataset and that one's parents, as JSON."""
    return json.dumps(context, indent=1, sort_keys=True, default=str)


def load_context(text: str) -> dict:
    return json.loads(text)


def root_dataset(dataset: dict) -> dict:
    while dataset.get("parent"):
        dataset = dataset["parent"]
    return dataset


#: Marks of the two corpora, variants of a workbook, and files that are no dataset.
CORPORA = {"DS": "workbooks", "DG": "open data"}
VARIANTS = ("x2c", "ssc")
SKIPPED = ("All_ProvenanceAsCellComment",)


def workbook_paths(spark: SparkSession, root: str) -> list[str]:
    """The workbooks under a folder, at any depth; names only, no contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(root)
    return sorted(r["path"] for r in files.select("path").collect())


def discover(paths: list[str], corpus: str = "DS", skipped: tuple[str, ...] = SKIPPED, start_columns: dict[str, int] | None = None) -> list[dict]:
    """Datasets of workbook paths, named in order by their corpus, each with its two converted variants as children. start_columns: of names that do not start at 0."""
    out = []
    own = [p for p in sorted(paths) if not any(x in p for x in skipped)]
    for i, p in enumerate(own):
        name = p.rsplit("/", 1)[-1]
        start = next((n for part, n in (start_columns or {}).items() if part in p), 0)
        root = {"name": name, "abbrev": f"{corpus}{i}", "folder": p, "tags": ["excel"], "parent": None, "start_column": start}
        out.append(root)
        out += [{**root, "abbrev": f"{corpus}{i}-{v}", "tags": ["csv"], "parent": root} for v in VARIANTS]
    return out


def report(confusion: list[dict], triples: dict[tuple, dict[str, list[str]]] | None = None) -> str:
    """An HTML table of compared cells, with the triples found, missed and wrong of each (sheet, row, col); for people, so the rows are few."""
    head = ("sheet", "row", "col", "tp", "fn", "fp")
    cells = lambda own: "".join(f"<td>{'<br>'.join(html.escape(t) for t in sorted(own.get(k, [])))}</td>" for k in ("tp", "fn", "fp"))
    more = lambda r: cells(triples.get((r["sheet"], r["row"], r["col"]), {})) if triples is not None else ""
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in head) + more(r) + "</tr>" for r in confusion)
    names = (*head, "found", "missed", "wrong") if triples is not None else head
    return "<table><tr>" + "".join(f"<th>{c}</th>" for c in names) + f"</tr>{body}</table>"


def sorted_lines(rows: DataFrame, line: str) -> list[str]:
    """The lines of a report in order."""
    return [r[line] for r in rows.select(line).orderBy(line).collect()]


def sheets_by_name(table: DataFrame) -> DataFrame:
    """(sheet, place): the sheets in order of their names."""
    return table.select("sheet").distinct().withColumn("place", F.row_number().over(Window.orderBy("sheet")) - 1)


def score_log(scored: DataFrame) -> DataFrame:
    """The hypotheses of each column, best first, as lines of a log."""
    order = Window.partitionBy("sheet", "col").orderBy(F.col("score").desc(), F.col("rank").desc(), "ordinal")
    return scored.select("sheet", "col", F.row_number().over(order).alias("place"), F.concat_ws(" ", "header", "hypothesis", F.round("score", 6).cast("string")).alias("line"))
