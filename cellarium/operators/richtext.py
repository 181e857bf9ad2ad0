"""Texts of formatted cells by tag, colour or lack of format. Markup is read leniently."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions.text import is_formatted

BLACK = "#000000"


class _Tree(HTMLParser):
    """Elements in document order: [tag, colour, depth, texts]; texts outside any element apart."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.open: list[list] = []
        self.own: list[str] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        e = [tag, dict(attrs).get("color", BLACK if tag == "font" else None), len(self.open), []]
        self.elements.append(e)
        self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.open.pop()

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for e in self.open:
            e[3].append(data)
        if not self.open:
            self.own.append(data)


def _text(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def texts_by_tag(markup: str, tag: str) -> list[str]:
    """Texts of the top-level elements of a tag."""
    return [t for e in _Tree(markup).elements if e[0] == tag and e[2] == 0 and (t := _text(e[3]))]


def texts_by_color(markup: str, color: str) -> list[str]:
    """Texts of the elements of a colour; fonts without one are black, which no colour asks for too."""
    found = _Tree(markup).elements
    return [t for e in found if (e[1] == color if color else e[0] == "font" and e[1] == BLACK) and (t := _text(e[3]))]


def unformatted_text(markup: str) -> str:
    """Text outside all elements, then that of black ones."""
    tree = _Tree(markup)
    return " ".join([_text(tree.own), *(_text(e[3]) for e in tree.elements if e[1] == BLACK)]).strip()


def styles(markup: str) -> list[str]:
    """Styles that occur, as tag or tag and colour, sorted; `unformatted` if text stands outside all elements."""
    tree = _Tree(markup)
    own = {e[0] if e[1] is None else f"{e[0]} {e[1]}" for e in tree.elements if _text(e[3])}
    return sorted(own | ({"unformatted"} if _text(tree.own) else set()))


def _column(rich: Column, of) -> Column:
    @F.arrow_udf("array<string>")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if (v := x.as_py()) is None else of(v) for x in b], pa.list_(pa.string()))

    return texts(rich)


def by_tag(rich: Column, tag: str) -> Column:
    return _column(rich, lambda v: texts_by_tag(v, tag))


def by_color(rich: Column, color: str) -> Column:
    return _column(rich, lambda v: texts_by_color(v, color))


def unformatted(rich: Column) -> Column:
    return _column(rich, lambda v: [t] if (t := unformatted_text(v)) else [])


def styles_of(rich: Column) -> Column:
    return _column(rich, styles)


def styled_texts(markup: str) -> list[tuple[str, str]]:
    """(style, text) of each style that occurs: the texts of its elements, joined by spaces."""
    tree = _Tree(markup)
    out: dict[str, list[str]] = {}
    for e in tree.elements:
        if t := _text(e[3]):
            out.setdefault(e[0] if e[1] is None else f"{e[0]} {e[1]}", []).append(t)
    if t := _text(tree.own):
        out["unformatted"] = [t]
    return sorted((k, " ".join(v)) for k, v in out.items())


def styled_cells(table: DataFrame) -> DataFrame:
    """The formatted texts of a cell table as plain text cells, one for each style, with a column style."""

    @F.arrow_udf("array<struct<style:string,text:string>>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("style", pa.string()), ("text", pa.string())]))
        for b in batches:
            yield pa.array([[{"style": k, "text": t} for k, t in styled_texts(v)] if (v := x.as_py()) else [] for x in b], kind)

    rows = table.filter((F.col("cell_type") == "string") & is_formatted(F.col("value_rich_text")))
    each = rows.withColumn("one", F.explode(split(F.col("value_rich_text"))))
    none = F.lit(None).cast("string")
    return each.withColumn("value_string", F.col("one.text")).withColumn("style", F.col("one.style")).withColumn("value_rich_text", none).drop("one")
