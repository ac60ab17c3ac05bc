"""The graph calls, the command line and streams."""

import pytest

from quadrille import names as N
from quadrille.__main__ import run
from quadrille.graph import Graph, Namespace
from quadrille.plans.rules import rules_of
from quadrille.sources import n3
from quadrille.streaming.triples import read_stream, reason_over

T = Namespace("urn:t#")
DATA = "@prefix : <urn:t#>. :a :p :b, :c. :b :p :c. :b :q 1."
RULE = "@prefix : <urn:t#>. { ?x :p ?y } => { ?y :r ?x }."


def test_calls(spark):
    g = Graph.parse(spark, DATA)
    assert g.size() == 4 and g.contains(T.a, T.p, T.b) and not g.contains(T.c)
    assert g.any(T.a, T.p) == T.b and g.the(T.b, T["p"]) == T.c and g.the(T.c, T.p) is None
    with pytest.raises(ValueError, match="more than one"):
        g.the(T.a, T.p)
    assert {r["value"] for r in g.each(p=T.p, o=T.c).collect()} == {T.a, T.b}
    h = g.add((T.x, T.p, T.y)).remove((T.a, T.p, T.b)).substitute({T.c: T.z})
    assert h.contains(T.x) and not h.contains(T.a, T.p, T.b) and h.contains(T.a, T.p, T.z)
    assert g.filter(RULE).size() == 3 and g.apply(RULE).size() == 7 and g.merge(h).size() == 7
    assert g.sparql("PREFIX : <urn:t#> SELECT ?x { ?x :q 1 }", native=False).first()[0] == T.b
    assert g.select_where("@prefix : <urn:t#>. @prefix ql: <http://www.w3.org/2004/ql#>. [] ql:select { ?x :s ?y }; ql:where { ?x :p ?y. ?y :p ?z }.").size() == 1
    assert g.why(RULE).count() == 3
    assert "digraph" in g.dot() and Graph.parse(spark, g.n3()).size() == 4


def test_command_line(spark, tmp_path):
    (tmp_path / "d.n3").write_text(DATA)
    (tmp_path / "r.n3").write_text(RULE)
    (tmp_path / "q.rq").write_text("PREFIX : <urn:t#> SELECT ?x WHERE { ?x :p ?y }")
    (tmp_path / "s.n3").write_text(f'@prefix : <urn:t#>. @prefix log: <{N.LOG}>. {{ ?x :q ?v }} => {{ ?x log:outputString "found" }}.')
    d, r, q, s = (str(tmp_path / f) for f in ("d.n3", "r.n3", "q.rq", "s.n3"))
    assert run(spark, [d, f"--filter={r}", "--ntriples"]).count("\n") == 3
    assert run(spark, [d, f"--think={r}", "--size"]) == "7" and run(spark, [d, f"--think={r}", f"--filter={s}", "--strings"]) == "found"
    assert run(spark, [d, f"--sparql={q}"]).count("<result>") == 2
    assert run(spark, [d, "--reify", "--dereify", "--size"]) == "4" and run(spark, [d, "--rdf"]).startswith("<?xml")
    assert run(spark, [d, f"--diff={d}"]) == ""


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    rules = rules_of(n3.parse("@prefix : <urn:t#>. { ?x :p ?y. ?y :p ?z } => { ?x :p ?z }."))
    for i, line in enumerate(["<urn:t#a> <urn:t#p> <urn:t#b> .\n", "<urn:t#b> <urn:t#p> <urn:t#c> .\n"]):
        (source / f"{i}.nt").write_text(line)
        reason_over(read_stream(spark, str(source)), rules, str(out), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 3
