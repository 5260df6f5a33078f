"""Ontology files in Turtle.

A file is read as a whole by one task, since prefixes and abbreviations reach over all of it;
large graphs belong in N-Triples or Parquet.  A file that is no Turtle gives no statements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratalog.functions import vocabulary as V
from stratalog.sources.log import ESCAPES, LANG_STRING, read_triples

_NAME = r"[\w\-%·À-￿]"
_TOKENS = re.compile(
    r"(?P<skip>\s+|#[^\n]*)"
    r'|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')'
    r'|(?P<string>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
    r'|(?P<iri><[^<>"{}|^`\s]*>)'
    r"|(?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s+[^\s:]*:?\s*<))"
    r"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)"
    r"|(?P<blank>_:" + _NAME + r"(?:[\w\-.]*" + _NAME + r")?)"
    r"|(?P<double>[+-]?(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)"
    r"|(?P<boolean>(?:true|false)(?![\w:\-]))"
    r"|(?P<name>(?:[A-Za-zÀ-￿](?:[\w\-.]*" + _NAME + r")?)?:(?:(?:" + _NAME + r"|:|\\.)(?:(?:" + _NAME + r"|[.:]|\\.)*(?:" + _NAME + r"|:|\\.))?)?)"
    r"|(?P<a>a(?![\w:\-]))|(?P<typed>\^\^)|(?P<sign>[.;,\[\]()])",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_NUMBERS = {"double": "double", "decimal": "decimal", "integer": "integer", "boolean": "boolean"}
Statement = tuple[str, str, str, str | None]


def _plain(text: str, signs: dict[str, str] = ESCAPES) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else signs.get(m[3], m[3]), text)


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if m is None:
                raise ValueError(f"no Turtle at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.base, self.prefixes, self.blanks = 0, "", {}, 0
        self.out: list[Statement] = []

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in signs and self.tokens[self.at][0] in ("sign", "typed", "a", "directive")

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("the file ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, sign: str) -> None:
        if self.next()[1] != sign:
            raise ValueError(f"{sign} expected")

    def read(self) -> list[Statement]:
        while self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if kind == "directive":
                self.at += 1
                name = "" if text.lower().endswith("base") else self.next()[1]
                target = self.resource(*self.next())
                if name:
                    self.prefixes[name[:-1]] = target
                else:
                    self.base = target
                if text.startswith("@"):
                    self.take(".")
                continue
            subject = self.node()
            if not (text == "[" and self.peek(".")):
                self.properties(subject)
            self.take(".")
        return self.out

    def properties(self, subject: str) -> None:
        while True:
            kind, text = self.next()
            predicate = V.TYPE if kind == "a" else self.resource(kind, text)
            while True:
                self.out.append((subject, predicate, *self.object()))
                if not self.peek(","):
                    break
                self.at += 1
            if not self.peek(";"):
                return
            while self.peek(";"):
                self.at += 1
            if self.peek(".", "]"):
                return

    def resource(self, kind: str, text: str) -> str:
        if kind == "iri":
            iri = _plain(text[1:-1])
            if not self.base or re.match(r"[A-Za-z][\w+.\-]*:", iri):
                return iri
            return urljoin(self.base, iri) + ("#" if iri.endswith("#") else "")  # an empty fragment is part of a prefix
        if kind == "name":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix}")
            return self.prefixes[prefix] + _plain(local, {})
        raise ValueError(f"no resource: {text}")

    def fresh(self) -> str:
        self.blanks += 1
        return f"genid{self.blanks}"

    def node(self) -> str:
        """A subject, or an object that is a resource; what blank nodes and collections say goes before."""
        kind, text = self.next()
        if kind == "blank":
            return text[2:]
        if text == "[":
            node = self.fresh()
            if not self.peek("]"):
                self.properties(node)
            self.take("]")
            return node
        if text == "(":
            items = []
            while not self.peek(")"):
                items.append(self.object())
            self.take(")")
            nodes = [self.fresh() for _ in items] + [V.RDF + "nil"]
            for node, item, rest in zip(nodes, items, nodes[1:], strict=False):
                self.out += [(node, V.RDF + "first", *item), (node, V.RDF + "rest", rest, None)]
            return nodes[0]
        return self.resource(kind, text)

    def object(self) -> tuple[str, str | None]:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind in _NUMBERS:
            self.at += 1
            return text, V.XSD + _NUMBERS[kind]
        if kind in ("string", "long"):
            self.at += 1
            value = _plain(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek("^^"):
                self.at += 1
                return value, self.resource(*self.next())
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                return value, LANG_STRING + self.next()[1]
            return value, V.XSD + "string"
        return self.node(), None


def parse(text: str) -> list[Statement]:
    """The statements of a Turtle text, in order; ValueError if it is none."""
    return _Reader(text).read()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Statements of Turtle files; a missing file, or one that cannot be read, has none."""
    kinds = "subject string, predicate string, object string, datatype string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    rows = parse(text or "")
                except ValueError:
                    rows = []
                columns = list(zip(*dict.fromkeys(rows), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["subject", "predicate", "object", "datatype"])

    try:
        files = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kinds)
    return files.mapInArrow(run, kinds)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Statements of a file by its ending: .nt is N-Triples, anything else Turtle."""
    return read_triples(spark, path) if path.endswith(".nt") else read_turtle(spark, path)
