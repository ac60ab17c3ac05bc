"""More registered queries with SQL: readers and writers, rule commands, graphs as terms, SPARQL forms."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille import terms
from quadrille.functions.registry import named, register
from quadrille.graph import Graph
from quadrille.operators.lists import fold_lists
from quadrille.operators.reify import dereify, flatten, reify, unflatten
from quadrille.plans import rules as R
from quadrille.plans import sparql
from quadrille.plans.data import Dataset, constant_quads, unfold
from quadrille.plans.formula import Formula, isomorphic
from quadrille.plans.match import Matcher, outputs
from quadrille.plans.values import Val
from quadrille.queries import HEAD, SPARQL_HEAD, Query, ask, cells, dataset, facts_of, rule, table
from quadrille.sources import n3, rdfxml, triples, writers
from quadrille.sources.documents import load

NAME = "<table:nation#n_name>"
register("urn:q#shout", forward=lambda v: Val.text(F.concat(F.upper(v.lex()), F.lit("!"))))


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unfold(table(spark, sf_dir, "nation"))


def _nation_rows(spark: SparkSession, sf_dir: str) -> list:
    """The 25 nations, for parsers that take a document as one text."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()


def _names(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == NAME).select("s", terms.string_of(F.col("o")).alias("name"))


NAMES_SQL = "select '<table:nation/' || n_nationkey || '>' as s, n_name as name from nation"


def _from(spark: SparkSession, text: str) -> DataFrame:
    rows = sparql.run(Dataset(spark), "PREFIX : <urn:q#> " + text)
    return rows.select(terms.string_of(F.col("k")).cast("long").alias("k"))


def _rows(spark: SparkSession, f: Formula) -> DataFrame:
    return constant_quads(spark, n3.rows(f))


def _selected(spark: SparkSession, f: Formula, text: str, **kinds: str) -> DataFrame:
    """Solutions over a document, each variable as the given type."""
    rows = sparql.run(Dataset.of(spark, f), "PREFIX : <urn:q#> " + text)
    return rows.select(*[terms.string_of(F.col(v)).cast(k).alias(v) for v, k in kinds.items()])


# --- readers and writers ---------------------------------------------------------------------------------------------


def n3_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with prefixes, lists of objects, blank nodes in brackets and comments."""
    lines = [f':n{r["n_nationkey"]} a :Nation; :name "{r["n_name"]}"; :in [ :region {r["n_regionkey"]} ]. # one' for r in _nation_rows(spark, sf_dir)]
    return _selected(spark, n3.parse("@prefix : <urn:q#>.\n" + "\n".join(lines)), "SELECT ?n ?r WHERE { ?x a :Nation ; :name ?n ; :in [ :region ?r ] }", n="string", r="long")


def n3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and backward paths."""
    lines = [f':n{r["n_nationkey"]}!:region :key {r["n_regionkey"]}. "{r["n_name"]}"^:name :is :n{r["n_nationkey"]}.' for r in _nation_rows(spark, sf_dir)]
    text = "SELECT ?m ?k WHERE { ?x :region ?r . ?r :key ?k . ?b :name ?m ; :is ?x }"
    return _selected(spark, n3.parse("@prefix : <urn:q#>.\n" + "\n".join(lines)), text, m="string", k="long")


def n3_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as N3 and read back."""
    return _names(Graph.parse(spark, Graph.of(_nation(spark, sf_dir)).n3()).quads)


def xml_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as RDF/XML and read back."""
    return _names(_rows(spark, rdfxml.parse(writers.rdfxml_of(_nation(spark, sf_dir)))))


def xml_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RDF/XML with typed nodes, nested nodes and typed literals."""
    inner = "".join(
        f'<q:Nation rdf:about="#n{r["n_nationkey"]}"><q:name>{r["n_name"]}</q:name><q:in rdf:parseType="Resource"><q:key rdf:datatype="{N.XSD}integer">{r["n_regionkey"]}</q:key></q:in></q:Nation>'
        for r in _nation_rows(spark, sf_dir)
    )
    text = f'<rdf:RDF xmlns:rdf="{N.RDF}" xmlns:q="urn:q#" xml:base="http://ex.org/d">{inner}</rdf:RDF>'
    return _selected(spark, rdfxml.parse(text), "SELECT ?n ?r WHERE { ?x a :Nation ; :name ?n ; :in ?i . ?i :key ?r }", n="string", r="long")


def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as XML, read with an XML parser."""
    text = Graph(Dataset(spark, _nation(spark, sf_dir))).sparql_xml(SPARQL_HEAD + "SELECT ?n ?k WHERE { ?x n:n_name ?n ; n:n_nationkey ?k FILTER (?k < 20) }")
    space = "{http://www.w3.org/2005/sparql-results#}"
    rows = [{b.get("name"): "".join(b.itertext()).strip() for b in r.iter(f"{space}binding")} for r in ET.fromstring(text).iter(f"{space}result")]
    return spark.createDataFrame([(r["n"], int(r["k"])) for r in rows], "n string, k long")


def data_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document at a data: address."""
    text = "@prefix : <urn:q#>. " + " ".join(f':n{r["n_nationkey"]} :name "{r["n_name"]}".' for r in _nation_rows(spark, sf_dir))
    return _selected(spark, load("data:text/n3," + quote(text)), "SELECT ?n WHERE { ?x :name ?n }", n="string")


def dot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = writers.dot_of(_nation(spark, sf_dir))
    return spark.createDataFrame([(text.count("->"),)], "edges long")


def lines_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a written graph parsed again, with a graph name and without."""
    lines = writers.ntriples(_nation(spark, sf_dir)).select(F.regexp_replace("value", r" \.$", " <urn:g> .").alias("value"))
    back = triples.parse_lines(lines).where((F.col("g") == "<urn:g>") & (F.col("p") == NAME))
    return back.select("s", terms.string_of(F.col("o")).alias("name"))


# --- commands --------------------------------------------------------------------------------------------------------

CALLED = "@prefix : <urn:q#>. @prefix n: <table:nation#>. { ?x n:n_name ?m } => { ?x :called ?m }."


def _called(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == "<urn:q#called>").select("s", terms.string_of(F.col("o")).alias("name"))


def think_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from another document, to a fixpoint."""
    return _called(Graph.of(_nation(spark, sf_dir)).think(CALLED).quads)


def apply_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called(Graph.of(_nation(spark, sf_dir)).apply(CALLED).quads)


def filter_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what the rules conclude."""
    return Graph.of(_nation(spark, sf_dir)).filter(CALLED).quads.groupBy("p").agg(F.count("*").alias("n"))


def solve_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's own rules to a fixpoint, then only what the given ones conclude."""
    lines = " ".join(f':n{r["n_nationkey"]} :in :r{r["n_regionkey"]}; :name "{r["n_name"]}".' for r in _nation_rows(spark, sf_dir))
    g = Graph.parse(spark, "@prefix : <urn:q#>. " + lines + " { ?x :in ?r. ?y :in ?r } => { ?x :near ?y }.")
    out = g.solve("@prefix : <urn:q#>. { ?x :near ?y. ?x :name ?a. ?y :name ?b } => { ?a :by ?b }.").quads
    return facts_of(out, "by", "string", "string")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs with statements in common as one."""
    quads = _nation(spark, sf_dir)
    a, b = (Graph.of(quads.where(F.col("s").isin(*[f"<table:nation/{i}>" for i in keys]))) for keys in (range(15), range(10, 25)))
    return _names(a.merge(b).quads)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(Graph.of(_nation(spark, sf_dir)).size(),)], "size long")


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons whose evidence is there, and the same reasons over data that lost some."""
    text = "{ ?x n:n_name ?m. ?x n:n_regionkey ?r } => { ?r :holds ?m }."
    ds = Dataset(spark, _nation(spark, sf_dir))
    why = R.explained(ds, R.rules_of(n3.parse(HEAD + text)))
    lost = Dataset(spark, ds.quads.where(~((F.col("s") == "<table:nation/3>") & (F.col("p") == NAME))))
    bad = lambda d, kind: R.check_evidence(d, why).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return bad(ds, "whole").unionByName(bad(lost, "one name lost"))


def reified_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph described as statements about statements, and back."""
    f = n3.parse("@prefix : <urn:q#>. " + " ".join(f':n{r["n_nationkey"]} :name "{r["n_name"]}"; :tags ("t" {r["n_regionkey"]}).' for r in _nation_rows(spark, sf_dir)))
    (back,) = dereify(reify(f)[0])
    return _selected(spark, back, "SELECT ?n WHERE { ?x :name ?n }", n="string")


def flattened_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted graphs flattened to descriptions, and back: what each says of nations."""
    f = n3.parse("@prefix : <urn:q#>. " + " ".join(f':n{r["n_nationkey"]} :says {{ :it :name "{r["n_name"]}" }}.' for r in _nation_rows(spark, sf_dir)))
    back = unflatten(flatten(f))
    rows = [(s, inner[2][1:-1]) for s, _, g in back.statements if isinstance(g, Formula) for inner in g.statements]
    return spark.createDataFrame(rows, "s string, name string")


def same_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs equal up to the names of their blank nodes, and graphs that are not."""
    by_region: dict[int, list[str]] = {}
    for r in _nation_rows(spark, sf_dir):
        by_region.setdefault(r["n_regionkey"], []).append(r["n_name"])
    out = []
    for k, found in by_region.items():
        chain = lambda names, p: n3.parse("@prefix : <urn:q#>. " + " ".join(f'_:{p}{i} :name "{m}"; :next _:{p}{i + 1}.' for i, m in enumerate(names)))
        out.append((k, isomorphic(chain(found, "a"), chain(found, "zz")), isomorphic(chain(found, "a"), chain(found[::-1], "a"))))
    return spark.createDataFrame(out, "region long, renamed boolean, reversed boolean")


def cells_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists nested in lists, written as cells in a document, folded to terms."""
    lines = " ".join(f':n{r["n_nationkey"]} :has ("{r["n_name"]}" ({r["n_regionkey"]} "x")).' for r in _nation_rows(spark, sf_dir))
    quads = triples.parse_lines(writers.ntriples(Dataset.of(spark, n3.parse("@prefix : <urn:q#>. " + lines)).quads))
    out = fold_lists(quads).where(F.col("p") == "<urn:q#has>")
    items = terms.items_of(F.col("o"))
    return out.select(terms.string_of(F.get(items, F.lit(0))).alias("name"), F.size(terms.items_of(F.get(items, F.lit(1)))).cast("long").alias("n"))


# --- graphs as terms -------------------------------------------------------------------------------------------------


def concluded(text: str, p: str, *kinds: str) -> Query:
    """What one pass of rules over the tables concludes about a predicate."""
    return lambda spark, d: facts_of(R.apply_once(dataset(spark, d, text), R.rules_of(n3.parse(HEAD + text))), p, *kinds)


def _region(condition: str, seen: str = "?k") -> str:
    """A rule whose condition gives a region's key."""
    return f"{{ {condition} ?r r:r_regionkey {seen}; r:r_name ?m }} => {{ {seen} :saw ?m }}."


def _always(condition: str) -> str:
    return f"{{ {condition} ?r r:r_regionkey ?k; r:r_name ?m }} => {{ ?k :saw ?m }}."


def saw(text: str) -> Query:
    return concluded(text, "saw", "long", "string")


def regions(*keys: int) -> str:
    return f"select r_regionkey as a, r_name as b from region where r_regionkey in ({', '.join(map(str, keys))})"


ALL = "select r_regionkey as a, r_name as b from region"


def quoted_nations(text: str) -> Callable:
    return lambda spark, d: sparql.run(Dataset(spark, _nation(spark, d)), text).select(terms.string_of(F.col("m")).alias("m"))


def equal_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted graphs that are equal up to order and blank node names are one term: nations of one region say the same."""
    lines = " ".join(f':n{r["n_nationkey"]} :name "{r["n_name"]}"; :says {{ _:b{r["n_nationkey"]} :in {r["n_regionkey"]}. :x :y :z }}.' for r in _nation_rows(spark, sf_dir))
    text = lines + " { ?a :says ?g; :name ?m. ?b :says ?g; :name ?o } => { ?m :agrees ?o }."
    f = n3.parse("@prefix : <urn:q#>. " + text)
    return facts_of(R.apply_once(Dataset.of(spark, f), R.rules_of(f)), "agrees", "string", "string")


def one_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region say the same graph; one name is let through for each graph."""
    lines = " ".join(f':n{r["n_nationkey"]} :name "{r["n_name"]}"; :says {{ :x :in {r["n_regionkey"]} }}.' for r in _nation_rows(spark, sf_dir))
    f = n3.parse(HEAD + lines + " { ?a :says ?g; :name ?m. ?g log:enforceUniqueBinding ?m. ?g log:includes { :x :in ?k } } => { ?k :named ?m }.")
    return facts_of(R.apply_once(Dataset.of(spark, f), R.rules_of(f)), "named", "long", "string")


def deep_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns inside nested lists, with a variable met twice."""
    lines = " ".join(f':n{r["n_nationkey"]} :l ("{r["n_name"]}" ({r["n_regionkey"]} {r["n_nationkey"] % 5})).' for r in _nation_rows(spark, sf_dir))
    f = n3.parse("@prefix : <urn:q#>. " + lines + " { ?x :l (?m (?k ?k)) } => { ?k :twice ?m }.")
    return facts_of(R.apply_once(Dataset.of(spark, f), R.rules_of(f)), "twice", "long", "string")


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of built-in predicates as facts, where built-ins are switched off."""
    lines = " ".join(f':n{r["n_nationkey"]} string:startsWith "{r["n_name"]}".' for r in _nation_rows(spark, sf_dir))
    f = n3.parse(HEAD + lines + " { ?a string:startsWith ?b } => { ?a :s ?b }.")
    (r,) = R.rules_of(f)
    b = Matcher(Dataset.of(spark, f), builtins=False).solve(r.body)
    return outputs(b, {"a": "?a", "b": "?b"}, native=False).select("a", terms.string_of(F.col("b")).alias("b"))


XML_ROW = lambda row: Val.text(F.concat(F.lit('<p:n xmlns:p="urn:s#">'), row["n_name"].lex(), F.lit("</p:n>")))
SIGNED = '?key crypto:keyLength 256. ("hello" ?key) crypto:sign ?s. ?key crypto:publicKey ?pub.'

REGISTERED: dict[str, tuple[Query, str]] = {
    "s01_n3_document": (n3_document, "select n_name as n, n_regionkey as r from nation"),
    "s04_paths": (n3_paths, "select n_name as m, n_regionkey as k from nation"),
    "s07_rdfxml_document": (xml_document, "select n_name as n, n_regionkey as r from nation"),
    "s10_named_lines": (lines_in_order, NAMES_SQL),
    "s11_n3_round_trip": (n3_rewritten, NAMES_SQL),
    "s12_rdfxml_round_trip": (xml_rewritten, NAMES_SQL),
    "s15_results_xml": (result_document, "select n_name as n, n_nationkey as k from nation where n_nationkey < 20"),
    "s17_data_address": (data_address, "select n_name as n from nation"),
    "s26_dot": (dot_edges, "select count(*) * 3 as edges from nation"),
    "r02_think_with": (think_with, NAMES_SQL),
    "r04_apply_with": (apply_with, NAMES_SQL),
    "r05_filter": (filter_with, "select '<urn:q#called>' as p, count(*) as n from nation"),
    "r06_solve": (solve_with, "select a.n_name as a, b.n_name as b from nation a join nation b using (n_regionkey)"),
    "r13_reify": (reified_back, "select n_name as n from nation"),
    "r14_flatten": (flattened_back, "select '<urn:q#n' || n_nationkey || '>' as s, n_name as name from nation"),
    "r19_nested_cells": (cells_folded, "select n_name as name, 2 as n from nation"),
    "r20_merge": (merged, NAMES_SQL),
    "r24_isomorphism": (same_shapes, "select n_regionkey as region, true as renamed, count(*) = 1 as reversed from nation group by 1"),
    "r27_proof_check": (proofs, "select 'whole' as kind, 0 as n union all select 'one name lost', 1"),
    "r28_size": (sizes, "select count(*) * 3 as size from nation"),
    "p11_stated": (stated, "select '<urn:q#n' || n_nationkey || '>' as a, n_name as b from nation"),
    "p12_deep_match": (deep_lists, "select n_regionkey as a, n_name as b from nation where n_regionkey = n_nationkey % 5"),
    "p13_equal_graphs": (equal_graphs, "select a.n_name as a, b.n_name as b from nation a join nation b using (n_regionkey)"),
    "a04_subjects": (saw(_region("{ 0 :k :a. 1 :k :b. 3 :k :a } set:subjects ?s. ?s set:member ?k.")), regions(0, 1, 3)),
    "a04_predicates": (saw(_always("{ :a :k :b. :c :k :d } set:predicates ?s. ?s set:member ?p. ?p log:uri ?u. ?u string:endsWith \"k\".")), ALL),
    "a04_objects": (saw(_region("{ :a :k 0. :b :k 2. :c :k 3 } set:objects ?s. ?s set:member ?k.")), regions(0, 2, 3)),
    "b044_triples": (saw(_region("{ :a :k 1. :b :k 4 } set:triples ?s. ?s set:member ?t. ?t log:includes { ?x :k ?k }.")), regions(1, 4)),
    "b010_not_includes": (saw(_always("{ :a :k 1 } log:notIncludesWithBuiltins { :a :k ?v. ?v math:greaterThan 5 }.")), ALL),
    "b011_semantics": (saw(_region(f"<data:text/n3,{quote('@prefix : <urn:q#>. :a :k 2, 3.')}> log:semantics ?f. ?f log:includes {{ :a :k ?k }}.")), regions(2, 3)),
    "b013_semantics_or_error": (saw(_always("<file:///no/such> log:semanticsOrError ?e. ?e log:rawType log:Literal.")), ALL),
    "b014_content": (saw(_always("<data:text/plain,some%20text> log:content ?t. ?t string:contains \"me te\".")), ALL),
    "b016_parsed": (saw('{ ?r r:r_name ?m; r:r_regionkey ?k. ("@prefix : <urn:q#>. :x :named \\"" ?m "\\".") string:concatenation ?t. ?t log:parsedAsN3 ?f. ?f log:includes { ?a :named ?n } } => { ?k :saw ?n }.'), ALL),
    "b018_supports": (saw(_always("{ :a :p :b. { ?x :p ?y } => { ?y :p ?x } } log:supports { :b :p :a }.")), ALL),
    "b019_filter": (saw(_region("({ :a :k 1. :b :k 2 } { { ?x :k ?y } => { ?y :of ?x } }) log:filter ?h. ?h log:includes { ?k :of ?q }.")), regions(1, 2)),
    "b023_unique_binding": (one_name, "select n_regionkey as a, min(n_name) as b from nation group by 1"),
    "b024_conjunction": (saw(_region("({ :a :p 1 } { :b :p 2 }) log:conjunction ?g. ?g log:includes { ?x :p ?k }.")), regions(1, 2)),
    "b025_n3_string": (saw(_always('{ :a :k 1 } log:n3String ?s. ?s string:contains "urn:q#".')), ALL),
    "b026_reification": (saw(_region('{ :a :b ("x" 3) } log:reification ?d. ?q log:reification ?d. ?q log:includes { :a :b ?l }. ?l list:last ?k.')), regions(3)),
    "b142_gm_time": (saw(_always('"" time:gmTime ?t. ?t time:year ?y. ?y math:greaterThan 2000.')), ALL),
    "b143_local_time": (saw(_always('"" time:localTime ?t. ?t time:year ?y. ?y math:greaterThan 2000.')), ALL),
    "b159_gm_times": (saw(_always('"" times:gmTime ?t. ?t string:startsWith "2".')), ALL),
    "b160_local_times": (saw(_always('"" times:localTime ?t. ?t string:startsWith "2".')), ALL),
    "b163_environ": (saw(_always('"PATH" os:environ ?p. ?p string:contains "/".')), ALL),
    "b164_base_absolute": (saw(_always('"some/file" os:baseAbsolute ?u. ?u string:endsWith "/some/file".')), ALL),
    "b176_key_length": (saw(_always(f"{SIGNED} ?pub crypto:keyLength ?n. ?n math:equalTo 256.")), ALL),
    "b177_sign": (saw(_always(f"{SIGNED} ?pub crypto:verify ({{}} ?s).".replace("({} ?s)", '("hello" ?s)'))), ALL),
    "b179_verify": (saw(_always(f'{SIGNED} ("hello" ?s ?pub) crypto:verifyBoolean ?v. ?v log:equalTo "True".')), ALL),
    "b193_query": (saw(_region('({ :a :k 1. :b :k 3 } "CONSTRUCT { ?x <urn:q#n> ?k } WHERE { ?x <urn:q#k> ?k }") sparql:query ?g. ?g log:includes { ?x :n ?k }.')), regions(1, 3)),
    "b194_semantics": (saw(_region(f"<data:text/n3,{quote('@prefix : <urn:q#>. :a :k 4.')}> sparql:semantics ?f. ?f log:includes {{ :a :k ?k }}.")), regions(4)),
    "b204_dom_names": (
        cells("nation", k=lambda r: r["n_nationkey"].col, prefix=lambda r: named("dom:prefix").forward(XML_ROW(r)).lex(), space=lambda r: named("dom:namespaceURI").forward(XML_ROW(r)).lex()),
        "select n_nationkey as k, 'p' as prefix, 'urn:s#' as space from nation",
    ),
    "t02_own_builtin": (rule("{ ?x n:n_name ?n. ?n :shout ?m } => {}.", "n", "m"), "select n_name as n, upper(n_name) || '!' as m from nation"),
    "q05_describe": (
        lambda spark, d: sparql.run(Dataset(spark, _nation(spark, d)), SPARQL_HEAD + 'DESCRIBE ?x WHERE { ?x n:n_name "NATION_3" }').select("s").distinct(),
        "select '<table:nation/' || n_nationkey || '>' as s from nation where n_name = 'NATION_3'",
    ),
    "q11_from": (lambda spark, d: _from(spark, f"SELECT ?k FROM <data:text/n3,{quote('@prefix : <urn:q#>. :a :k 1, 2.')}> WHERE {{ :a :k ?k }}"), "select * from (values (1), (2)) v(k)"),
    "q12_from_named": (
        lambda spark, d: _from(spark, f"SELECT ?k FROM NAMED <data:text/n3,{quote('@prefix : <urn:q#>. :a :k 1, 2.')}> WHERE {{ GRAPH ?g {{ :a :k ?k }} }}"),
        "select * from (values (1), (2)) v(k)",
    ),
    "q17_unary_sign": (ask("SELECT ?k WHERE { ?n n:n_nationkey ?k FILTER (-?k < -20 || +?k = 3) }"), "select n_nationkey as k from nation where -n_nationkey < -20 or n_nationkey = 3"),
    "q25_numbers": (ask("SELECT ?k WHERE { ?n n:n_nationkey ?k FILTER (?k > 1.5e0 && ?k < 4.5 && ?k != 3 || ?k = 0.7E1) }"), "select n_nationkey as k from nation where n_nationkey in (2, 4, 7)"),
    "q26_base": (quoted_nations("BASE <table:nation> SELECT ?m WHERE { ?x <#n_name> ?m }"), "select n_name as m from nation"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items()}
