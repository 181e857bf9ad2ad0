"""XLSX workbooks as cell tables, and a small writer. Files are read by Spark; one task reads one workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, sheet_id int, sheet string, row bigint, col int, address string, cell_type string, value_string string, value_numeric double, value_boolean boolean, value_rich_text string, data_format string, formula string, background_color string"
#: Built-in number formats that show dates or times.
BUILT_IN = {14: "mm/dd/yyyy;@", 15: "D. MMM. YYYY", 16: "d-mmm", 17: "mmm-yy", 18: "HH:MM AM/PM", 19: "HH:MM:SS AM/PM", 20: "HH:MM", 21: "HH:MM:SS", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[HH]:MM:SS", 47: "MM:SS.00"}
_NS = re.compile(r"\{.*?\}")


def _name(e) -> str:
    return _NS.sub("", e.tag)


def _kids(e, name: str) -> list:
    return [x for x in e if _name(x) == name] if e is not None else []


def _string(e) -> tuple[str, str | None]:
    """Plain text of a string item, and markup if it has runs with formats."""
    runs = _kids(e, "r")
    if not runs:
        return "".join(t.text or "" for t in _kids(e, "t")), None
    plain, rich = [], []
    for r in runs:
        text = "".join(t.text or "" for t in _kids(r, "t"))
        props = {_name(p): p for pr in _kids(r, "rPr") for p in pr}
        color = props.get("color")
        rgb = "#" + color.get("rgb")[-6:].lower() if color is not None and color.get("rgb") else None
        out = escape(text)
        if "rFont" in props or rgb:
            out = f"<font{f' color="{rgb}"' if rgb else ''}>{out}</font>"
        for key, tag in (("b", "b"), ("i", "i"), ("u", "u"), ("strike", "strike")):
            if key in props:
                out = f"<{tag}>{out}</{tag}>"
        plain.append(text)
        rich.append(out)
    return "".join(plain), "".join(rich)


def _place(address: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", address).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def read_workbook(data: bytes) -> Iterator[tuple]:
    """(sheet_id, sheet, row, col, address and values) of every cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        part = lambda n: ElementTree.fromstring(z.read(n)) if n in names else None
        shared = [_string(e) for e in _kids(part("xl/sharedStrings.xml"), "si")]
        style = part("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode") for g in _kids(style, "numFmts") for f in g}
        formats = [(i := int(x.get("numFmtId", 0))) and (own.get(i) or BUILT_IN.get(i)) or None for g in _kids(style, "cellXfs") for x in g]
        fills = [next(("#" + c.get("rgb")[-6:].lower() for pattern in fill for c in _kids(pattern, "fgColor") if c.get("rgb")), None) for g in _kids(style, "fills") for fill in g]
        colors = [fills[i] if (i := int(x.get("fillId", 0))) < len(fills) else None for g in _kids(style, "cellXfs") for x in g]
        links = {r.get("Id"): r.get("Target").lstrip("/") for r in part("xl/_rels/workbook.xml.rels")}
        sheets = [s for g in _kids(part("xl/workbook.xml"), "sheets") for s in g]
        for number, s in enumerate(sheets):
            target = links[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            sheet = part(target if target.startswith("xl/") else f"xl/{target}")
            for row in (r for d in _kids(sheet, "sheetData") for r in d):
                for c in row:
                    address, kind = c.get("r"), c.get("t", "n")
                    value = next((v.text for v in _kids(c, "v")), None)
                    text, rich, num, flag, fmt = None, None, None, None, None
                    formula = next((f.text for f in _kids(c, "f")), None)
                    style_id = int(c.get("s", 0))
                    color = colors[style_id] if style_id < len(colors) else None
                    if kind == "s" and value is not None:
                        text, rich = shared[int(value)]
                    elif kind == "inlineStr":
                        text, rich = next(map(_string, _kids(c, "is")), ("", None))
                    elif kind in ("str", "e"):
                        text = value
                    elif kind == "b" and value is not None:
                        flag = value == "1"
                    elif value is not None:
                        num = float(value)
                        fmt = formats[style_id] if style_id < len(formats) else None
                    if text is None and num is None and flag is None:
                        continue
                    r, col = _place(address)
                    yield number, s.get("name"), r, col, address, "boolean" if flag is not None else "numeric" if num is not None else "string", text, num, flag, rich, fmt, formula, color


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all workbooks under a path."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            for where, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(where, *r) for r in read_workbook(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(cells, SCHEMA)


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of rows of strings, numbers, booleans and None."""
    out = io.BytesIO()
    letters = lambda n: (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def cell(r: int, c: int, v) -> str:
        at = f"{letters(c)}{r + 1}"
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
