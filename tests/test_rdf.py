import pytest

from plumbline.operators import ontology
from plumbline.plans import config as c
from plumbline.plans.workflows import WORKFLOWS, Result
from plumbline.sources import rdf
from plumbline.sources.datasets import SourceFrames

TURTLE = r'''@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@base <http://example.org/zoo/> .
PREFIX ex: <http://example.org/zoo#>
PREFIX owl: <http://www.w3.org/2002/07/owl#>
# a comment; with marks, and [brackets]
ex:animal a owl:Class ; rdfs:label "animal"@en , "bête"@fr ; .
ex:cat rdfs:subClassOf ex:animal , [ a owl:Restriction ; owl:onProperty ex:has.tail ; owl:hasValue 1.5 ] ;
    rdfs:label """cat
or "tom\""""^^<http://www.w3.org/2001/XMLSchema#string> .
<dog> rdfs:subClassOf <#animal>, ex:animal; rdfs:label 'dog' .
ex:bat1 rdfs:subClassOf ex:animal ; rdfs:label "bat" . ex:bat2 rdfs:subClassOf ex:animal; rdfs:label "bat".
ex:frog rdfs:subClassOf ex:animal .
[ rdfs:subClassOf ex:animal ] .
_:x rdfs:subClassOf ex:cat ; ex:parts ( ex:leg true () ) .
'''


def test_turtle_and_triples_give_the_same(spark, tmp_path):
    (tmp_path / "zoo.ttl").write_text(TURTLE)
    found = [tuple(r) for r in rdf.triples(spark, str(tmp_path / "zoo.ttl")).collect()]
    zoo = "http://example.org/zoo#"
    assert (zoo + "cat", rdf.LABEL, 'cat\nor "tom"', "literal") in found and (zoo + "animal", rdf.LABEL, "bête", "literal") in found
    assert ("http://example.org/zoo/dog", rdf.SUBCLASS, "http://example.org/zoo/#animal", "iri") in found
    inner = {s for s, p, o, _ in found if p.endswith("onProperty") and o == zoo + "has.tail"}
    assert len(inner) == 1 and (zoo + "cat", rdf.SUBCLASS, *inner, "blank") in found and (*inner, "http://www.w3.org/2002/07/owl#hasValue", "1.5", "literal") in found
    firsts = [o for s, p, o, _ in found if p == rdf.RDF + "first"]
    assert firsts == [zoo + "leg", "true", rdf.RDF + "nil"]
    lines = [f"<{s}> <{p}> " + (f"<{o}> ." if k == "iri" else '"' + o.replace("\n", " ").replace('"', '\\"') + '"@en .') for s, p, o, k in found if k != "blank" and not s.startswith("_:")]
    (tmp_path / "zoo.nt").write_text("\n".join(["# nothing", *lines]) + "\n_:n1 <http://x/y> _:n2 .\n")
    one, two = (rdf.hierarchy(spark, str(tmp_path / f"zoo.{x}")) for x in ("ttl", "nt"))
    edges = {tuple(r) for r in one[0].collect()}
    assert edges == {tuple(r) for r in two[0].collect()} == {("cat", "animal"), ("dog", "animal"), ("bat1", "animal"), ("bat2", "animal"), ("frog", "animal")}
    assert {tuple(r) for r in ontology.from_ntriples(spark, str(tmp_path / "zoo.nt")).distinct().collect()} == edges
    assert ("frog", "frog") in {tuple(r) for r in one[1].collect()} and ("bat2", "bat") in {tuple(r) for r in two[1].collect()}


def test_conformance_tells_ambiguous_labels(spark, tmp_path):
    (tmp_path / "zoo.ttl").write_text(TURTLE)
    rows = [(i, name, k) for k, (name, n) in enumerate((("dog", 30), ("bat", 10), ("frog", 10), ("axolotl", 1))) for i in range(n)]
    items = spark.createDataFrame([(i, k, [float(i)]) for i, (_, _, k) in enumerate(rows)], "item_index long, class_label int, embedding array<double>")
    classes = spark.createDataFrame([(0, "dog"), (1, "bat"), (2, "frog"), (3, "axolotl")], "class_label int, class_name string")
    out = Result("data-coverage", ["a"])
    p = c.Coverage(name="x", type="data-coverage", ontology=str(tmp_path / "zoo.ttl"), run_completeness=False, balance=False, run_gap_analysis=False)
    WORKFLOWS["data-coverage"]({"a": SourceFrames(items, None, classes)}, p, out)
    assert {r.class_name: r.verdict for r in out.tables["label_names"].collect()} == {"dog": "one", "bat": "ambiguous", "frog": "one", "axolotl": "none"}
    todo = {r.node: r.n for r in out.tables["label_worklist"].collect()}
    assert todo["cat"] == 0 and "dog" not in todo and out.scalars.get("ontology_skipped") is None


@pytest.mark.parametrize("text", ["ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", '<a> <b> "x', "<a> <b> ( <c> ."])
def test_what_is_no_turtle_is_refused(text):
    with pytest.raises(ValueError):
        rdf.Turtle(text)


def test_deep_hierarchies_are_closed(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "child string, parent string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert ontology.closure(edges).filter("node = 'n0'").agg({"depth": "max"}).first()[0] == 70
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
