"""Input tables as cells, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellarium.operators.cells import TIMESTAMP_FORMAT, cells, union_cells

#: Key and columns (s text, n number, t timestamp) of the tables that are read as sheets.
TABLES = {
    "nation": ("n_nationkey", "n_name:s n_regionkey:n"),
    "region": ("r_regionkey", "r_name:s"),
    "customer": ("c_custkey", "c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s"),
    "orders": ("o_orderkey", "o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s"),
    "part": ("p_partkey", "p_name:s p_brand:s p_type:s p_size:n p_retailprice:n"),
    "events": ("event_id", "ts:t user_id:n event_type:s value:n props:s"),
    "lineitem": ("l_orderkey", "l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:s l_linestatus:s l_shipdate:t"),
    "pages": ("page_id", "url:s html:s"),
    "documents": ("doc_id", "text:s lang:s source:s n_chars:n"),
    "conversations": ("conv_id", "turn:n role:s text:s"),
}
JTRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheets(spark: SparkSession, sf_dir: str, wanted: dict[str, list[str] | None]) -> DataFrame:
    """The cells of some columns (all, if None) of some tables."""
    return union_cells([cells(read(spark, sf_dir, t), t, TABLES[t][0], columns) for t, columns in wanted.items()])


def sql_serial(c: str) -> str:
    return f"(date_diff('day', DATE '1899-12-30', CAST({c} AS DATE)) + (hour({c}) * 3600 + minute({c}) * 60 + second({c})) / 86400.0::DOUBLE)"


def sql_sheets(wanted: dict[str, list[str] | None]) -> str:
    """A CTE `cells` of the same."""
    parts = []
    for t, columns in wanted.items():
        key, fields = TABLES[t]
        for i, f in enumerate(fields.split()):
            c, kind = f.split(":")
            if columns is None or c in columns:
                vs = c if kind == "s" else "NULL"
                vn = f"CAST({c} AS DOUBLE)" if kind == "n" else sql_serial(c) if kind == "t" else "NULL::DOUBLE"
                fmt = f"'{TIMESTAMP_FORMAT}'" if kind == "t" else "NULL"
                parts.append(f"SELECT '{t}' AS sheet, CAST({key} AS BIGINT) AS \"row\", {i} AS col, '{c}' AS header, '{'string' if kind == 's' else 'numeric'}' AS kind, {vs} AS vs, {vn} AS vn, {fmt} AS fmt FROM {t} WHERE {c} IS NOT NULL")
    return "cells AS (" + " UNION ALL ".join(parts) + ")"
