"""SPARQL over small graphs."""

import xml.etree.ElementTree as ET

import pytest

from quadrille import terms
from quadrille.plans import graphs  # noqa: F401
from quadrille.plans import sparql
from quadrille.plans.data import Dataset
from quadrille.sources import n3, writers

DATA = """@prefix : <urn:t#>. @prefix xsd: <http://www.w3.org/2001/XMLSchema#>.
:a :name "A"; :age 3; :mbox <mailto:a>; :date "2001-01-01T00:00:00Z"^^xsd:dateTime.
:b :name "B"@en; :age 4.5; :knows :a, [ :name "anon" ].
:c :age "x"; :flag true.
:d :n [ :given "G"; :family "F" ]."""
HEAD = "PREFIX : <urn:t#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "


@pytest.fixture(scope="module")
def ds(spark):
    return Dataset.of(spark, n3.parse(DATA))


def ask(ds, text):
    rows = sparql.select(ds, HEAD + text, native=False).collect()
    show = lambda k: None if k is None else k if isinstance(k, bool) else terms.text(k).removeprefix("urn:t#")
    return sorted((tuple(show(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT ?x WHERE { ?x :age ?g FILTER (?g > 3) }", [("b",)]),
        ("SELECT ?x WHERE { ?x :age ?g FILTER (?g > 3 || ?x = :a) }", [("a",), ("b",)]),
        ("SELECT ?x WHERE { ?x :age ?g FILTER (!(?g > 3)) }", [("a",)]),
        ("SELECT ?x ?n WHERE { ?x :age ?g OPTIONAL { ?x :name ?n } }", [("a", "A"), ("b", "B"), ("c", None)]),
        ("SELECT ?x ?m WHERE { ?x :age ?g OPTIONAL { ?x :name ?n OPTIONAL { ?x :mbox ?m } } }", [("a", "mailto:a"), ("b", None), ("c", None)]),
        ("SELECT ?x WHERE { ?x :age ?g OPTIONAL { ?x :name ?n FILTER (?g < 4) } FILTER (bound(?n)) }", [("a",)]),
        ("SELECT ?v WHERE { { :a :name ?v } UNION { :b :name ?v } }", [("A",), ("B",)]),
        ("SELECT ?x WHERE { ?x :name ?n FILTER (lang(?n) = \"en\") }", [("b",)]),
        ("SELECT ?x WHERE { ?x :age ?g FILTER (datatype(?g) = xsd:integer) }", [("a",)]),
        ("SELECT ?o WHERE { ?x ?p ?o FILTER (isURI(?o) && ?p != :knows) }", [("mailto:a",)]),
        ("SELECT ?n WHERE { ?x :knows ?y . ?y :name ?n FILTER (isBLANK(?y)) }", [("anon",)]),
        ("SELECT ?x WHERE { ?x :name ?n FILTER regex(?n, \"^a\", \"i\") }", [("_",)]),
        ("SELECT ?g WHERE { ?x :n [ :given ?g ; :family \"F\" ] }", [("G",)]),
        ("SELECT ?x WHERE { ?x :age ?g FILTER (10 - ?g - 2 = 5) }", [("a",)]),
        ("SELECT ?x WHERE { ?x :age ?g FILTER (-?g < -4) }", [("b",)]),
        ("SELECT ?x WHERE { ?x :flag ?f FILTER (?f) }", [("c",)]),
        ("SELECT ?x WHERE { ?x :date ?d FILTER (?d < \"2002-01-01T00:00:00Z\"^^xsd:dateTime) }", [("a",)]),
        ("SELECT ?x WHERE { ?x :age ?g FILTER (xsd:integer(?g) = 4) }", [("b",)]),
        ("ASK { ?x :name \"A\" }", [(True,)]),
        ("ASK { ?x :name \"Z\" }", [(False,)]),
    ],
)
def test_select(ds, text, want):
    got = ask(ds, text)
    if want == [("_",)]:
        assert len(got) == 2 and ("a",) in got
    else:
        assert got == sorted(want, key=repr)


def test_order(ds):
    text = HEAD + "SELECT ?x WHERE { ?x :age ?g } ORDER BY DESC(?x) LIMIT 2 OFFSET 1"
    assert [terms.text(r[0])[-1] for r in sparql.select(ds, text, native=False).collect()] == ["b", "a"]


def test_construct_and_describe(ds):
    rows = sparql.run(ds, HEAD + "CONSTRUCT { ?x :older [ :than ?g ] } WHERE { ?x :age ?g FILTER (?g > 2) }").collect()
    assert len(rows) == 4 and sum(r["o"].startswith("_:") for r in rows) == 2
    assert {r["s"] for r in sparql.run(ds, HEAD + "DESCRIBE :a").collect()} == {"<urn:t#a>"}


def test_graph_and_from(spark, tmp_path):
    (tmp_path / "f.n3").write_text(DATA)
    empty = Dataset(spark)
    text = f"SELECT ?x FROM <{(tmp_path / 'f.n3').as_uri()}> WHERE {{ ?x :mbox ?m }}"
    assert ask(empty, text) == [("a",)]
    named = Dataset.of(spark, n3.parse(DATA), "<urn:g>")
    assert ask(named, "SELECT ?g ?x WHERE { GRAPH ?g { ?x :mbox ?m } }") == [("urn:g", "a")]
    assert ask(named, "SELECT ?x WHERE { GRAPH <urn:g> { ?x :mbox ?m } }") == [("a",)] and ask(named, "SELECT ?x WHERE { ?x :mbox ?m }") == []


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x", "SELECT ?x WHERE { ?x }", "SELECT ?x WHERE { ?x :p ?y", "SELECT ?x WHERE { ?x nope:p ?y }", "SELECT ?x WHERE { ?x :p ?y FILTER }", "ASK { ?x :p ?y } trailing"])
def test_rejects(text):
    with pytest.raises(n3.SyntaxProblem):
        sparql.parse(HEAD + text)


def test_results_xml(ds):
    q = sparql.parse(HEAD + "SELECT ?x ?n WHERE { ?x :age ?g OPTIONAL { ?x :name ?n } }")
    root = ET.fromstring(writers.results_xml(sparql.select(ds, q, native=False), q))
    assert len(root[0]) == 2 and len(root[1]) == 3
    q = sparql.parse(HEAD + "ASK { ?x :age ?g }")
    assert "<boolean>true</boolean>" in writers.results_xml(sparql.select(ds, q), q)
