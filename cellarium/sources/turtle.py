"""Turtle (its common subset) and N-Triples: reader and writer."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, s string, p string, o string, o_kind string, o_type string, o_lang string"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3})|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z-]+)|(?P<type>\^\^)"""
    r"""|(?P<num>[+-]?(?:\d+\.\d+|\.?\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w-]+)|(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*:[\w%.-]*[\w%-]|[A-Za-z_][\w-]*:|:[\w%-]*)|(?P<word>a\b|true\b|false\b|PREFIX\b|BASE\b)|(?P<mark>[.;,\[\]])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unquoted(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


def parse(text: str) -> list[tuple[str, str, str, str, str, str]]:
    """(s, p, o, o_kind, o_type, o_lang) of the statements. Kinds: iri, blank, literal."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood at {at}: {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}
    base, out, i, fresh = "", [], 0, 0

    def term() -> tuple[str, str, str, str]:
        nonlocal i, fresh
        kind, s = tokens[i]
        i += 1
        if kind == "iri":
            iri = s[1:-1]
            return (iri if re.match(r"[a-zA-Z][\w+.-]*:", iri) else base + iri), "iri", "", ""
        if kind == "name":
            p, _, local = s.partition(":")
            return prefixes.get(p, p + ":") + local, "iri", "", ""
        if kind == "blank":
            return s, "blank", "", ""
        if kind == "num":
            return s, "literal", _XSD + ("double" if "e" in s.lower() else "decimal" if "." in s else "integer"), ""
        if kind == "word":
            return ("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", "", "") if s == "a" else (s, "literal", _XSD + "boolean", "")
        if kind in ("text", "long"):
            value = _unquoted(s[3:-3] if kind == "long" else s[1:-1])
            if i < len(tokens) and tokens[i][0] == "lang":
                i += 1
                return value, "literal", "", tokens[i - 1][1][1:]
            if i < len(tokens) and tokens[i][0] == "type":
                i += 1
                return value, "literal", term()[0], ""
            return value, "literal", _XSD + "string", ""
        if s == "[":
            fresh += 1
            node = f"_:b{fresh}"
            statements(node)
            if tokens[i][1] != "]":
                raise ValueError("] expected")
            i += 1
            return node, "blank", "", ""
        raise ValueError(f"unexpected {s!r}")

    def statements(subject: str) -> None:
        nonlocal i
        while i < len(tokens) and tokens[i][1] not in (".", "]"):
            p = term()[0]
            while True:
                out.append((subject, p, *term()))
                if i < len(tokens) and tokens[i][1] == ",":
                    i += 1
                    continue
                break
            while i < len(tokens) and tokens[i][1] == ";":
                i += 1

    while i < len(tokens):
        kind, s = tokens[i]
        if kind == "lang" and s == "@prefix" or s == "PREFIX":
            prefixes[tokens[i + 1][1][:-1]] = tokens[i + 2][1][1:-1]
            i += 3
        elif kind == "lang" and s == "@base" or s == "BASE":
            base = tokens[i + 1][1][1:-1]
            i += 2
        else:
            statements(term()[0])
        if i < len(tokens) and tokens[i][1] == ".":
            i += 1
    return list(dict.fromkeys(out))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The triples of all .ttl, .nt and .ttl.gz files under a path. One task reads one file, as prefixes hold for a file."""

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for b in batches:
            for where, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(where, *t) for t in parse((gzip.decompress(data) if where.endswith(".gz") else data).decode())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ttl,nt,ttl.gz}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(triples, SCHEMA)


def n_triples(o_type: bool = True) -> Column:
    """A triple's N-Triples line, from columns s, p, o, o_kind and o_type."""
    quote = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([\\\"])", r"\\$1"), "\n", r"\\n"), "\r", r"\\r")
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    typed = F.when(F.col("o_type") != "", F.concat(F.lit("^^<"), F.col("o_type"), F.lit(">"))).otherwise(F.lit("")) if o_type else F.lit("")
    return F.concat(node("s"), F.lit(" "), F.concat(F.lit("<"), F.col("p"), F.lit("> ")), F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), quote("o"), F.lit('"'), typed)).otherwise(node("o")), F.lit(" ."))


def write_n_triples(triples: DataFrame, path: str) -> None:
    triples.select(n_triples().alias("value")).write.mode("overwrite").text(path)


def prefixed(line: Column, prefixes: dict[str, str]) -> Column:
    """N-Triples lines with their IRIs shortened by prefixes."""
    for name, iri in sorted(prefixes.items(), key=lambda p: -len(p[1])):
        line = F.regexp_replace(line, "<" + re.escape(iri) + r"([A-Za-z_][\w-]*)>", f"{name}:$1")
    return line


def prefix_header(prefixes: dict[str, str]) -> str:
    return "".join(f"@prefix {name}: <{iri}> .\n" for name, iri in sorted(prefixes.items()))
