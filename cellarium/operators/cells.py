"""The cell table: one row for each cell that holds something.

Columns: sheet, row, col, header, cell_type (string, numeric, boolean), value_string, value_numeric,
value_boolean, value_rich_text, data_format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarium.functions.parse import date_to_serial

TIMESTAMP_FORMAT = "YYYY-MM-DD HH:MM:SS"
VALUES = "cell_type string, value_string string, value_numeric double, value_boolean boolean, value_rich_text string, data_format string"


def _cell(field: T.StructField, col: int) -> Column | None:
    x, kind = F.col(field.name), field.dataType
    none = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in VALUES.split(", ")}
    if isinstance(kind, T.StringType):
        own = {"cell_type": F.lit("string"), "value_string": x}
    elif isinstance(kind, T.BooleanType):
        own = {"cell_type": F.lit("boolean"), "value_boolean": x}
    elif isinstance(kind, T.NumericType):
        own = {"cell_type": F.lit("numeric"), "value_numeric": x.cast("double")}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        own = {"cell_type": F.lit("numeric"), "value_numeric": date_to_serial(x), "data_format": F.lit(TIMESTAMP_FORMAT)}
    else:
        return None
    values = none | own
    return F.when(x.isNotNull(), F.struct(F.lit(col).alias("col"), F.lit(field.name).alias("header"), *(values[n].alias(n) for n in none)))


def cells(df: DataFrame, sheet: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """The cells of a table: its columns but key, which numbers the rows. Nulls are no cells; nested columns are left out."""
    fields = [(i, f) for i, f in enumerate(f for f in df.schema.fields if f.name != key) if columns is None or f.name in columns]
    made = [c for i, f in fields if (c := _cell(f, i)) is not None]
    each = df.select(F.col(key).cast("bigint").alias("row"), F.explode(F.array_compact(F.array(*made))).alias("c"))
    return each.select(F.lit(sheet).alias("sheet"), "row", "c.*")


def union_cells(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_headers(raw: DataFrame) -> DataFrame:
    """Cells as loaded (sheet, row, col and values), each column's first cell turned into header. One aggregate and a join, so no column is sorted in one task."""
    text = F.coalesce("value_string", F.col("value_numeric").cast("string"), F.col("value_boolean").cast("string"))
    headers = raw.groupBy("sheet", "col").agg(F.min(F.struct(F.col("row").alias("first"), text.alias("header"))).alias("h")).select("sheet", "col", "h.*")
    return raw.join(headers, ["sheet", "col"]).filter(F.col("row") > F.col("first")).drop("first")


def first_of(table: DataFrame, key: list[str], order: str, value: str, n: int) -> DataFrame:
    """(key, values): the first n values of each key by order. Partitions keep n rows of a key before they are shuffled."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order, value))
    top = table.select(*key, order, value).withColumn("place", place).filter(F.col("place") <= n)
    return top.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", value))), lambda r: r[value]).alias("values"))


def dimensions(table: DataFrame) -> DataFrame:
    """(sheet, max_row, max_col, n_cells)."""
    return table.groupBy("sheet").agg(F.max("row").alias("max_row"), F.max("col").cast("bigint").alias("max_col"), F.count(F.lit(1)).alias("n_cells"))


def selected(table: DataFrame, sheets: list[str] | None = None, start_col: int = 0, rows: tuple[int, int] | None = None) -> DataFrame:
    """Cells of the sheets listed (all if none are), from a column on, within a range of rows."""
    out = table.filter(F.col("col") >= start_col)
    if sheets:
        out = out.filter(F.col("sheet").isin(*sheets))
    return out.filter(F.col("row").between(*rows)) if rows else out


#: Fields of a cell by name; valueInt is the whole part of a number.
FIELDS = {"value": "coalesce(value_string, cast(value_numeric as string), cast(value_boolean as string))", "valueString": "value_string", "valueInt": "try_cast(value_numeric as int)", "valueNumeric": "value_numeric", "valueBoolean": "value_boolean", "valueRichText": "value_rich_text", "backgroundColor": "background_color"}


def beside(table: DataFrame, dx: int, dy: int = 0, field: str = "valueString", to: str = "beside") -> DataFrame:
    """Each cell with a field of the cell dx columns to its right and dy rows below, where there is one."""
    other = table.select("sheet", (F.col("row") - dy).alias("row"), (F.col("col") - dx).alias("col"), F.expr(FIELDS[field]).alias(to))
    return table.join(other, ["sheet", "row", "col"])


def cell_json(table: DataFrame, to: str = "json") -> DataFrame:
    """Cells with their JSON form: the type and the one value that is set."""
    names = {"cell_type": "cellType", "value_string": "valueString", "value_numeric": "valueNumeric", "value_boolean": "valueBoolean"}
    return table.withColumn(to, F.to_json(F.struct(*(F.col(a).alias(b) for a, b in names.items()))))
