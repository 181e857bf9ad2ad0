"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXAMPLE = "http://example.org/"
#: Characters attached to the word before them, and letters beyond a-z that never separate.
ATTACHED = "\n\t,;:)]>}"
WORD_LETTERS = "íáôéóúýù"


def jtrim(s: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_uri(s: Column) -> Column:
    t = jtrim(s)
    return t.startswith("http://") | t.startswith("https://")


def is_formatted(rich: Column) -> Column:
    return F.coalesce(jtrim(rich) != "", F.lit(False))


def property_name(header: Column) -> Column:
    """Lower case, runs of anything but a-z as one underscore."""
    return F.regexp_replace(F.lower(header), "[^a-z]+", "_")


def property_iri(table: Column, col: Column, header: Column, fmt: Column | None = None) -> Column:
    middle = [F.lit("-"), fmt] if fmt is not None else []
    return F.concat(F.lit(EXAMPLE), table.cast("string"), F.lit("-"), col.cast("string"), *middle, F.lit("-"), property_name(header))


def sheet_name(s: Column) -> Column:
    """Without spaces and parentheses, plus signs as underscores."""
    return F.translate(s, "+ ()", "_")


def subject_iri(sheet: Column, address: Column) -> Column:
    return F.concat(F.lit("inst://"), sheet_name(sheet), F.lit("/"), address)


def class_iri(sheet: Column) -> Column:
    return F.concat(F.lit("type://"), sheet_name(sheet))


def column_letters(col: Column) -> Column:
    """Spreadsheet letters of a column number from 0; six letters reach beyond any int."""
    step = lambda a, _: F.when(a["n"] < 0, a).otherwise(F.struct((F.floor(a["n"] / 26) - 1).cast("bigint").alias("n"), F.concat(F.chr(F.lit(65) + a["n"] % 26), a["s"]).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(col.cast("bigint").alias("n"), F.lit("").alias("s")), step)["s"]


def a1_address(col: Column, row: Column) -> Column:
    """Address of a cell, both numbers from 0."""
    return F.concat(column_letters(col), (row + 1).cast("string"))


def a1_column(address: Column) -> Column:
    """Column number from 0 of an address."""
    letters = F.split(F.regexp_extract(address, "^([A-Z]+)", 1), "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def a1_row(address: Column) -> Column:
    return F.regexp_extract(address, "([0-9]+)$", 1).cast("int") - 1


def split_trimmed(s: Column, pattern: str) -> Column:
    """Pieces between matches, trailing empty ones dropped, then trimmed."""
    parts = F.split(s, pattern, -1)
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.transform(F.slice(parts, F.lit(1), last), lambda x: jtrim(x))


def tokens(s: Column) -> Column:
    """Runs of one kind of character; a capital belongs to the lower-case run after it. White space is dropped."""
    return F.regexp_extract_all(s, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9\s]+"), F.lit(0))


def separators(s: Column) -> Column:
    """Separator characters of a text, in order, repeats included: attached ones, and whatever else is no letter or digit and follows a space."""
    attached = "".join("\\" + c if c in ")]}" else c for c in ATTACHED)
    return F.regexp_extract_all(F.lower(s), F.lit(f"[{attached}]|(?<= )[^a-z0-9_ {WORD_LETTERS}]"), F.lit(0))


def human_bytes(n: float) -> str:
    """A byte count in units of 1024."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB", "PiB"):
        if abs(n) < 1024 or unit == "PiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError
