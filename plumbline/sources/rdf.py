"""Triples of RDF files: Turtle (prefixes, bases, lists of predicates and objects, blank nodes, collections) and N-Triples.

A Turtle file has its prefixes at its head and is read by one task; N-Triples are read by lines. IRIs are shown whole, blank
nodes as ``_:`` names of their file, literals as their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the vocabularies.
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
TYPE, SUBCLASS, LABEL = RDF + "type", RDFS + "subClassOf", RDFS + "label"
TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>\s]*>)|(?P<text>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<at>@[A-Za-z][A-Za-z0-9-]*)|(?P<kind>\^\^)|(?P<mark>[;,.\[\]()](?!\d)|[;,\[\]()])|(?P<name>(?:[^\s;,\[\]()<>"'\\]|\\.)*(?:[^\s;,.\[\]()<>"'\\]|\\.))""",
    re.S,
)
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"\S*)\s*\.'


def resolved(base: str, iri: str) -> str:
    """Relative IRIs against the base; an empty fragment stays."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    return urljoin(base, iri) + ("#" if iri.endswith("#") else "")


def plain(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else PLAIN.get(m[3], m[3]), text)


class Turtle:
    """Reads one document; ``triples`` are (subject, predicate, object, kind of the object: iri, blank or literal)."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.blanks, self.base, self.prefixes = 0, 0, "", {}
        self.triples: list[tuple[str, str, str, str]] = []
        while self.at < len(self.tokens):
            self.statement()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        found = self.peek()
        if found[0] == "end" or (mark is not None and found != ("mark", mark)):
            raise ValueError(f"expected {mark or 'more'}, found {found[1] or 'the end'!r}")
        self.at += 1
        return found

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def statement(self) -> None:
        kind, word = self.peek()
        order = word.lstrip("@").lower()
        if (kind == "at" or kind == "name") and order in ("prefix", "base"):
            self.take()
            name = self.take()[1].removesuffix(":") if order == "prefix" else None
            iri = resolved(self.base, plain(self.take()[1][1:-1]))
            if name is None:
                self.base = iri
            else:
                self.prefixes[name] = iri
            if kind == "at":
                self.take(".")
            return
        subject, what = self.term()
        if not (what == "blank" and self.peek() == ("mark", ".")):  # a blank node may be all there is
            self.about(subject)
        self.take(".")

    def about(self, subject: str) -> None:
        """Predicates and objects up to what ends them."""
        while True:
            predicate = TYPE if self.peek() == ("name", "a") else None
            predicate = self.take() and predicate if predicate else self.term()[0]
            while True:
                self.triples.append((subject, predicate, *self.term()))
                if self.peek() != ("mark", ","):
                    break
                self.take()
            while self.peek() == ("mark", ";"):
                self.take()
            if self.peek() in (("mark", "."), ("mark", "]"), ("end", "")):
                return

    def term(self) -> tuple[str, str]:
        kind, word = self.take()
        if kind == "iri":
            return resolved(self.base, plain(word[1:-1])), "iri"
        if kind == "text":
            quotes = 3 if word[:3] in ('"""', "\'\'\'") and len(word) >= 6 else 1
            if self.peek()[0] == "at":
                self.take()
            elif self.peek()[0] == "kind":
                self.take()
                self.term()
            return plain(word[quotes:-quotes]), "literal"
        if (kind, word) == ("mark", "["):
            node = self.fresh()
            if self.peek() != ("mark", "]"):
                self.about(node)
            self.take("]")
            return node, "blank"
        if (kind, word) == ("mark", "("):
            head = before = None
            while self.peek() != ("mark", ")"):
                node = self.fresh()
                self.triples.append((node, RDF + "first", *self.term()))
                if before:
                    self.triples.append((before, RDF + "rest", node, "blank"))
                head, before = head or node, node
            self.take(")")
            if before:
                self.triples.append((before, RDF + "rest", RDF + "nil", "iri"))
            return (head, "blank") if head else (RDF + "nil", "iri")
        if kind != "name":
            raise ValueError(f"unexpected {word!r}")
        if word.startswith("_:"):
            return f"_:n{word[2:]}", "blank"
        prefix, colon, rest = word.partition(":")
        if colon:
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + plain(rest), "iri"
        return word, "literal"  # numbers and truth values


SCHEMA = "s string, p string, o string, kind string"


def triples(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, kind`` of a file or folder: Turtle by its suffix (.ttl), else N-Triples."""
    if not path.rstrip("/").endswith(".ttl"):
        part = lambda i: F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
        rows = spark.read.text(path).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("iri"), part(4).alias("blank"), F.regexp_extract("value", LINE, 5).alias("text")).filter("s is not null")
        kind = F.when(F.col("iri").isNotNull(), "iri").when(F.col("blank").isNotNull(), "blank").otherwise("literal")
        return rows.select(F.regexp_replace("s", "^<|>$", "").alias("s"), "p", F.coalesce("iri", "blank", "text").alias("o"), kind.alias("kind"))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text in part["value"]:
                yield pd.DataFrame(Turtle(text).triples, columns=["s", "p", "o", "kind"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, SCHEMA)


def local(iri: str):
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]+)/?$", 1)


def hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges ``child, parent`` of subclasses that have names, and ``concept, label``: what each is called, in all its labels
    and by its own name where it has none."""
    rows = triples(spark, path).checkpoint()
    edges = rows.filter((F.col("p") == SUBCLASS) & (F.col("kind") == "iri") & ~F.col("s").startswith("_:")).select(local("s").alias("child"), local("o").alias("parent")).distinct()
    named = rows.filter((F.col("p") == LABEL) & ~F.col("s").startswith("_:")).select(local("s").alias("concept"), F.col("o").alias("label")).distinct()
    nodes = edges.select(F.col("child").alias("concept")).union(edges.select("parent")).distinct()
    unnamed = nodes.join(named.select("concept"), "concept", "left_anti").withColumn("label", F.col("concept"))
    return edges, named.unionByName(unnamed)
