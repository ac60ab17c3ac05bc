"""Queries over the relational tables, each with the same query in SQL.

The tables are seen as triples (``quadrille.plans.data``); a query is rule text,
SPARQL text or calls of operators and built-ins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import names as N
from quadrille import terms
from quadrille.functions.registry import named
from quadrille.operators import graphs as G
from quadrille.operators.lists import fold_lists, unfold_lists
from quadrille.plans import graphs as _graph_builtins  # noqa: F401
from quadrille.plans import rules as R
from quadrille.plans import sparql
from quadrille.plans.data import Dataset, Table, constant_quads, unfold
from quadrille.plans.match import Matcher, outputs
from quadrille.plans.values import Val
from quadrille.sources import n3, triples, writers

Query = Callable[[SparkSession, str], DataFrame]
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
}
POINTS_AT = {
    "nation": {"n_regionkey": "region"}, "supplier": {"s_nationkey": "nation"}, "customer": {"c_nationkey": "nation"},
    "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
}
SHORT = {"r": "region", "n": "nation", "s": "supplier", "c": "customer", "p": "part", "o": "orders", "l": "lineitem", "ev": "events", "d": "documents", "e": "embeddings"}
HEAD = "".join(f"@prefix {k}: <table:{v}#>.\n" for k, v in SHORT.items()) + "@prefix : <urn:q#>.\n" + "".join(
    f"@prefix {k}: <{v}>.\n" for k, v in N.PREFIXES.items()
)
SPARQL_HEAD = "".join(f"PREFIX {k}: <table:{v}#>\n" for k, v in SHORT.items()) + "PREFIX : <urn:q#>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name], POINTS_AT.get(name, {}))


def dataset(spark: SparkSession, sf_dir: str, text: str = "") -> Dataset:
    """The tables that a text mentions."""
    used = [v for k, v in SHORT.items() if f"{k}:{v[0]}" in text or f" {k}:" in text or f"({k}:" in text]
    return Dataset(spark, None, {v: table(spark, sf_dir, v) for v in used})


def finish(df: DataFrame) -> DataFrame:
    """Plain types: whole numbers as long, decimals as double."""
    cells = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint" if f.dataType.scale == 0 else "double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cells.append(c.alias(f.name))
    return df.select(*cells)


def rule(text: str, *select: str) -> Query:
    """Solutions of one rule's body: its variables ``select``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        (r,) = R.rules_of(n3.parse(HEAD + text))
        b = Matcher(dataset(spark, sf_dir, text)).solve(r.body, needed={f"?{v}" for v in select})
        return finish(outputs(b.project({f"?{v}" for v in select}), {v: f"?{v}" for v in select}))

    return run


def ask(text: str) -> Query:
    """A SPARQL query."""
    return lambda spark, sf_dir: finish(sparql.run(dataset(spark, sf_dir, text), SPARQL_HEAD + text))


def facts_of(quads: DataFrame, p: str, *kinds: str) -> DataFrame:
    """Subject and object of a predicate, read as long, double or string."""
    def read(c: str, kind: str):
        k = F.col(c)
        return k if kind == "key" else terms.string_of(k).cast(kind)

    rows = quads.where((F.col("g") == "") & (F.col("p") == f"<urn:q#{p}>"))
    return rows.select(read("s", kinds[0]).alias("a"), read("o", kinds[1]).alias("b")).distinct()


def thought(text: str, p: str, *kinds: str) -> Query:
    """What rules conclude about a predicate, to a fixpoint."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = R.think(dataset(spark, sf_dir, text), R.rules_of(n3.parse(HEAD + text)))
        return facts_of(done.quads, p, *kinds)

    return run


def cells(name: str, /, **exprs) -> Query:
    """One output column for each built-in, over the rows of a table; k is its key, if it has one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = table(spark, sf_dir, name)
        row = {c: t.object(c) if c not in t.points_at else Val("int", F.col(c)) for c in t.df.columns}
        columns = []
        for out, e in exprs.items():
            x = e(row)
            c = x if not isinstance(x, Val) else x.element_keys() if x.kind == "list" else x.col
            columns.append(c.alias(out))
        out = finish(t.df.select(*columns))
        return out if KEYS[name] else out.distinct()

    return run


def _arg(row, a):
    return row[a] if isinstance(a, str) else a(row) if callable(a) else a


def _f(name: str, *args: str | Val) -> Callable:
    """forward of a built-in on columns (one value, or a list of several)."""
    def call(row):
        vals = [_arg(row, a) for a in args]
        return named(name).forward(vals[0] if len(vals) == 1 else Val.list_of(vals))

    return call


def _r(name: str, *args: str | Val) -> Callable:
    def call(row):
        vals = [_arg(row, a) for a in args]
        return named(name).reverse(vals[0] if len(vals) == 1 else Val.list_of(vals))

    return call


def _t(name: str, a: str | Val, b: str | Val) -> Callable:
    return lambda row: named(name).test(_arg(row, a), _arg(row, b))


def num(x: int | float) -> Val:
    return Val.constant(terms.value(x))


def txt(x: str) -> Val:
    return Val.constant(terms.literal(x))


def rounded(call: Callable, digits: int = 6) -> Callable:
    return lambda row: F.round(call(row).double(), digits)


def as_text(call: Callable) -> Callable:
    return lambda row: call(row).lex()


def key(call: Callable) -> Callable:
    return lambda row: call(row).key()


def _nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unfold(table(spark, sf_dir, "nation"))


def _pairs(quads: DataFrame) -> DataFrame:
    return quads.select("s", "p", "o").distinct()


# --- operators over quads --------------------------------------------------------------------------------------------


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename the nations of region 1 by a patch that deletes and inserts."""
    ds = Dataset(spark, _nation_quads(spark, sf_dir))
    text = HEAD + """@forAll :x, :m.
        { :x n:n_regionkey <table:region/1>. :x n:n_name :m } delta:deletion { :x n:n_name :m }; delta:insertion { :x n:n_name "renamed" } ."""
    out = G.patch(ds, n3.parse(text)).quads
    return out.where(F.col("p") == "<table:nation#n_name>").select(F.col("s").alias("nation"), terms.string_of(F.col("o")).alias("name"))


def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = unfold(table(spark, sf_dir, "customer"))
    poor = quads.where((F.col("p") == "<table:customer#c_acctbal>") & (terms.string_of(F.col("o")).cast("double") < 0))
    chaff = poor.select("g", "s", F.lit(N.TYPE).alias("p"), F.lit(N.CHAFF).alias("o"))
    return G.purge(quads.unionByName(chaff)).groupBy("p").agg(F.count("*").alias("n"))


def smushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one nation are equal: each gets the smallest name.

    Each is declared equal to a blank node of its nation, one statement a
    supplier, as pairs would grow with the square of a nation's suppliers. Each
    supplier's name is a graph of its own, so equal names stay apart.
    """
    text = "{ ?a s:s_nationkey ?n } => { ?a = ?n }."
    ds = dataset(spark, sf_dir, text)
    same = R.apply_once(ds, R.rules_of(n3.parse(HEAD + text))).withColumn("o", F.concat(F.lit("_:n"), F.md5("o")))
    names = unfold(table(spark, sf_dir, "supplier")).where(F.col("p") == "<table:supplier#s_name>").withColumn("g", F.col("s"))
    out = G.smush(same.unionByName(names)).where(F.col("p") == "<table:supplier#s_name>")
    return out.select("s", terms.string_of(F.col("o")).alias("name"))


def differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of regions 0 to 2 against those of 1 to 3, as quads."""
    t = table(spark, sf_dir, "nation")
    a, b = (unfold(Table("nation", t.df.where(F.col("n_regionkey").between(lo, lo + 2)), t.key, t.points_at)) for lo in (0, 1))
    gone, new = G.difference(a, b)
    side = lambda d, v: d.select(F.lit(v).alias("side"), "s", "p", "o")
    return side(gone, "deleted").unionByName(side(new, "inserted"))


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "{ ?c c:c_nationkey ?n; c:c_acctbal ?b. ?n n:n_regionkey ?r. ?b math:greaterThan 9000 } => { ?c :richIn ?r }."
    out = R.explained(dataset(spark, sf_dir, text), R.rules_of(n3.parse(HEAD + text)))
    return out.select("s", "o", F.size("evidence").cast("bigint").alias("n_evidence"), F.size("checks").cast("bigint").alias("n_checks"))


def quad_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.ntriples(_nation_quads(spark, sf_dir)).select(F.col("value").alias("line"))


def quad_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as N-Triples lines and read back."""
    lines = writers.ntriples(unfold(table(spark, sf_dir, "part")))
    back = triples.parse_lines(lines).where(F.col("p") == "<table:part#p_name>")
    return back.select("s", terms.string_of(F.col("o")).alias("name"))


def strings_put_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{ ?n n:n_name ?m; n:n_nationkey ?k. ("nation " ?m) string:concatenation ?t } => { ?m log:outputString ?t }.'
    return writers.output_strings(R.apply_once(dataset(spark, sf_dir, text), R.rules_of(n3.parse(HEAD + text)))).select(F.col("value").alias("line"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/region.parquet").withColumnsRenamed({"r_regionkey": "Region Key", "r_name": "Region Name"})
    return _pairs(triples.table_to_quads(df, "urn:sheet#", "Region", id_column="Region Key"))


def meta_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that makes a rule: subproperties hold for their superproperties."""
    text = ":near :sub :linked. { ?a n:n_regionkey ?r; n:n_name ?x. ?b n:n_regionkey ?r; n:n_name ?y. ?x string:lessThan ?y } => { ?x :near ?y }. { ?p :sub ?q } => { { ?s ?p ?o } => { ?s ?q ?o } }."
    f = n3.parse(HEAD + text)
    ds = dataset(spark, sf_dir, text)
    ds.quads = constant_quads(spark, n3.rows(f))
    return facts_of(R.think(ds, R.rules_of(f)).quads, "linked", "string", "string")


def truth_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules inside a graph that is called true are active."""
    text = "{ { ?n n:n_regionkey ?r; n:n_name ?m. ?r r:r_name ?x } => { ?m :in ?x } } a log:Truth."
    return facts_of(R.apply_once(dataset(spark, sf_dir, text), R.rules_of(n3.parse(HEAD + text))), "in", "string", "string")


def one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One simultaneous pass: the second rule does not see what the first concludes."""
    text = "{ ?c c:c_nationkey ?n; c:c_mktsegment ?m. ?n n:n_name ?x } => { ?m :soldIn ?x }. { ?a :soldIn ?x } => { ?x :soldIn ?a }."
    return facts_of(R.apply_once(dataset(spark, sf_dir, text), R.rules_of(n3.parse(HEAD + text))), "soldIn", "string", "string")


def select_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ql:select with ql:where."""
    text = "[] ql:select { ?x :from ?m }; ql:where { ?s s:s_nationkey ?n; s:s_name ?x. ?n n:n_name ?m }."
    return facts_of(R.apply_once(dataset(spark, sf_dir, text), R.ql_rules(n3.parse(HEAD + text))), "from", "string", "string")


def skolem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank node for each distinct binding of a head: counted by object."""
    text = "{ ?c c:c_nationkey ?n; c:c_mktsegment ?m. ?n n:n_name ?x } => { [] :segment ?m; :nation ?x }."
    out = R.apply_once(dataset(spark, sf_dir, text), R.rules_of(n3.parse(HEAD + text)))
    return out.where(F.col("p") == "<urn:q#nation>").groupBy(terms.string_of(F.col("o")).alias("nation")).agg(F.count_distinct("s").alias("nodes"))


def data_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = constant_quads(spark, n3.rows(n3.parse(HEAD + ":a :says { :b :c :d }. { ?x :p ?y } => { ?y :p ?x }.")))
    return _pairs(G.data_only(_nation_quads(spark, sf_dir).unionByName(quoted)))


def list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as a list, unfolded to cells and folded back."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lists = df.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    quads = lists.select(F.lit("").alias("g"), terms.iri_key(F.concat(F.lit("urn:r/"), F.col("n_regionkey").cast("string"))).alias("s"), F.lit("<urn:q#nations>").alias("p"), terms.list_key(F.transform("names", lambda x: terms.literal_key(x))).alias("o"))
    back = fold_lists(unfold_lists(quads))
    return back.select("s", F.array_join(F.transform(terms.items_of(F.col("o")), terms.string_of), "|").alias("names"))


def renamed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as blank nodes named at random, renamed by signature: as many as there are nations, whatever the names."""
    quads = _nation_quads(spark, sf_dir)
    blank = quads.withColumn("s", F.concat(F.lit("_:x"), F.md5("s")))
    out = G.canonical_bnodes(blank).where(F.col("p") == "<table:nation#n_name>")
    return out.select(terms.string_of(F.col("o")).alias("name"), (F.count("*").over(_by("s")) == 1).alias("alone"))


def _by(c: str):
    from pyspark.sql import Window

    return Window.partitionBy(c)


def any_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable predicate, over unfolded tables."""
    ds = Dataset(spark, _nation_quads(spark, sf_dir))
    (r,) = R.rules_of(n3.parse(HEAD + '{ ?s n:n_name "NATION_3". ?s ?p ?o } => { ?s ?p ?o }.'))
    b = Matcher(ds).solve(r.body)
    return outputs(b, {"p": "?p", "o": "?o"}, native=False).distinct()


def in_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named graphs: each region's nations are a graph; GRAPH finds names across them."""
    q = _nation_quads(spark, sf_dir)
    region = q.where(F.col("p") == "<table:nation#n_regionkey>").select("s", F.col("o").alias("graph"))
    named_graphs = q.drop("g").join(region, "s").select(F.col("graph").alias("g"), "s", "p", "o")
    text = "SELECT ?g ?name WHERE { GRAPH ?g { ?n n:n_name ?name . ?n n:n_nationkey ?k } FILTER (?k > 5) }"
    return sparql.select(Dataset(spark, named_graphs), SPARQL_HEAD + text, native=False).select("g", terms.string_of(F.col("name")).alias("name"))


def includes_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs as terms: includes and notIncludes with the graph in a variable."""
    q = _nation_quads(spark, sf_dir)
    region = q.where(F.col("p") == "<table:nation#n_regionkey>").select("s", F.col("o").alias("r"))
    inner = q.drop("g").join(region, "s").select(F.concat(F.lit("{"), F.substring(F.md5("r"), 1, 32), F.lit("}")).alias("g"), "s", "p", "o", "r")
    says = inner.select(F.lit("").alias("g"), F.col("r").alias("s"), F.lit("<urn:q#says>").alias("p"), F.col("g").alias("o")).distinct()
    ds = Dataset(spark, inner.drop("r").unionByName(says))
    (r,) = R.rules_of(n3.parse(HEAD + '{ ?r :says ?f. ?f log:includes { ?n n:n_name ?m }. ?f log:notIncludes { ?x n:n_name "NATION_7" } } => { ?r :named ?m }.'))
    b = Matcher(ds).solve(r.body, needed=r.used)
    return outputs(b, {"r": "?r", "m": "?m"}, native=False).select("r", terms.string_of(F.col("m")).alias("m")).distinct()


def conclusion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of a quoted graph, matched inside a rule over a table."""
    text = '{ ?r r:r_regionkey ?k; r:r_name ?name. { 0 :next 1. 1 :next 2. 2 :next 3. { ?x :next ?y } => { ?x :before ?y }. { ?x :before ?y. ?y :before ?z } => { ?x :before ?z } } log:conclusion ?c. ?c log:includes { ?k :before ?j } } => { ?name :before ?j }.'
    return facts_of(R.apply_once(dataset(spark, sf_dir, text), R.rules_of(n3.parse(HEAD + text))), "before", "string", "long")


PARENTS = """{ ?c c:c_custkey ?k. ?k math:greaterThan 1. (?k 2) math:integerQuotient ?h } => { ?k :parent ?h }.
{ ?a :parent ?b } => { ?a :above ?b }. { ?a :above ?b. ?b :above ?c } => { ?a :above ?c }."""
EDGES = """{ ?c c:c_custkey ?k. (?k 10) math:remainder ?m. (?m 1) math:sum ?u. (?u 10) math:remainder ?v. (?k ?m) math:difference ?t. (?t ?v) math:sum ?n } => { ?k :to ?n }.
{ ?a :to ?b } => { ?a :reaches ?b }. { ?a :reaches ?b. ?b :to ?c } => { ?a :reaches ?c }."""
LAYERED = """{ ?c c:c_custkey ?k; c:c_acctbal ?b. ?b math:lessThan 0 } => { ?k :debtor "yes" }.
{ ?c c:c_custkey ?k. ?SCOPE log:notIncludes { ?k :debtor "yes" } } => { ?k :creditor "yes" }."""

XML_ROW = lambda row: Val.text(F.concat(F.lit('<n k="'), row["n_nationkey"].lex(), F.lit('"><m>'), row["n_name"].lex(), F.lit("</m><x/></n>")))
A, B_ = "l_quantity", "l_linenumber"
TS = lambda row: Val.text(F.date_format(row["ts"].col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _ts(name: str, *rest: Val) -> Callable:
    return lambda row: named(name).forward(Val.list_of([TS(row), *rest]) if rest else TS(row))


def _xml(name: str, then: str | None = None) -> Callable:
    def call(row):
        v = named(name).forward(XML_ROW(row))
        return named(then).forward(v) if then else v

    return call


def _keys(*vals: Val) -> Val:
    return Val.list_of(list(vals))


def _nums(row, *cs: str) -> Val:
    return Val.list_of([row[c] for c in cs])


SQL_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"

REGISTERED: dict[str, tuple[Query, str | None]] = {
    # patterns and joins
    "p01_lookup": (rule('{ ?c c:c_mktsegment "BUILDING"; c:c_custkey ?k; c:c_name ?n } => {}.', "k", "n"), "select distinct c_custkey as k, c_name as n from customer where c_mktsegment = 'BUILDING'"),
    "p02_repeated_variable": (rule("{ ?n n:n_nationkey ?k; n:n_regionkey ?r. ?r r:r_regionkey ?k } => {}.", "k"), "select n_nationkey::bigint as k from nation where n_nationkey = n_regionkey"),
    "p03_variable_predicate": (any_predicate, """select '<table:nation#n_name>' as p, '"NATION_3"' as o from nation where n_name = 'NATION_3' union all select '<table:nation#n_nationkey>', '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' from nation where n_name = 'NATION_3' union all select '<table:nation#n_regionkey>', '<table:region/' || n_regionkey || '>' from nation where n_name = 'NATION_3'"""),
    "p05_distinct": (rule("{ ?o o:o_orderpriority ?p; o:o_orderstatus ?s } => {}.", "p", "s"), "select distinct o_orderpriority as p, o_orderstatus as s from orders"),
    "p09_generator": (rule("{ ?v e:vec_id ?k; e:embedding ?l. ?l list:member ?x. ?x math:greaterThan 0.3 } => {}.", "k"), "select distinct vec_id as k from embeddings where list_max(embedding) > 0.3"),
    "j01_join_chain": (rule('{ ?l l:l_orderkey ?o; l:l_quantity ?q. ?o o:o_custkey ?c. ?c c:c_mktsegment "BUILDING"; c:c_custkey ?k; c:c_nationkey ?n. ?n n:n_name ?m; n:n_regionkey ?r. ?r r:r_name ?x } => {}.', "k", "m", "x", "q"), "select distinct c_custkey as k, n_name as m, r_name as x, l_quantity as q from lineitem, orders, customer, nation, region where l_orderkey = o_orderkey and o_custkey = c_custkey and c_mktsegment = 'BUILDING' and c_nationkey = n_nationkey and n_regionkey = r_regionkey"),
    "j02_cartesian": (rule("{ ?a r:r_name ?x. ?b n:n_name ?y } => {}.", "x", "y"), "select r_name as x, n_name as y from region, nation"),
    "j03_theta_join": (rule("{ ?a n:n_regionkey ?r; n:n_name ?x. ?b n:n_regionkey ?r; n:n_name ?y. ?x string:lessThan ?y } => {}.", "x", "y"), "select a.n_name as x, b.n_name as y from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_name < b.n_name"),
    "j04_semi_join": (rule('{ ?s s:s_suppkey ?k. ?l l:l_suppkey ?s; l:l_partkey ?p. ?p p:p_size 1 } => {}.', "k"), "select s_suppkey as k from supplier where exists (select 1 from lineitem, part where l_suppkey = s_suppkey and l_partkey = p_partkey and p_size = 1)"),
    "j05_anti_join": (rule('{ ?c c:c_custkey ?k. ?SCOPE log:notIncludes { ?o o:o_custkey ?c; o:o_orderpriority "1-URGENT" } } => {}.', "k"), "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')"),
    "j06_left_join": (ask('SELECT ?k ?o WHERE { ?c c:c_custkey ?k . OPTIONAL { ?x o:o_custkey ?c ; o:o_orderpriority "1-URGENT" ; o:o_orderkey ?o } }'), "select distinct c_custkey as k, o_orderkey as o from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT'"),
    "j07_graph_join": (in_graphs, "select '<table:region/' || n_regionkey || '>' as g, n_name as name from nation where n_nationkey > 5"),
    "j07_includes": (includes_graph, "select '<table:region/' || n_regionkey || '>' as r, n_name as m from nation where n_regionkey not in (select n_regionkey from nation where n_name = 'NATION_7')"),
    "j08_ancestors": (thought(PARENTS, "above", "long", "long"), "with recursive t(a, b) as (select c_custkey, c_custkey // 2 from customer where c_custkey > 1 union select t.a, t.b // 2 from t where t.b > 1) select a, b from t"),
    # rings of ten customers: as many cycles as the table has tens
    "j08_cyclic_reach": (thought(EDGES, "reaches", "long", "long"), "with recursive e as (select c_custkey as a, c_custkey - c_custkey % 10 + (c_custkey % 10 + 1) % 10 as b from customer), t(a, b) as (select a, b from e union select t.a, e.b from t join e on t.b = e.a) select a, b from t"),
    # rules
    "r01_strata": (thought(LAYERED, "creditor", "long", "string"), "select c_custkey as a, 'yes' as b from customer where c_acctbal >= 0"),
    "r03_one_pass": (one_pass, "select distinct c_mktsegment as a, n_name as b from customer join nation on c_nationkey = n_nationkey"),
    "r07_select_where": (select_where, "select s_name as a, n_name as b from supplier join nation on s_nationkey = n_nationkey"),
    "r09_patch": (patched, "select '<table:nation/' || n_nationkey || '>' as nation, case when n_regionkey = 1 then 'renamed' else n_name end as name from nation"),
    "r10_reasons": (reasons, "select '<table:customer/' || c_custkey || '>' as s, '<table:region/' || n_regionkey || '>' as o, 3::bigint as n_evidence, 1::bigint as n_checks from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000"),
    "r11_purge": (purged, "select '<table:customer#' || c || '>' as p, (select count(*) from customer where c_acctbal >= 0) as n from (values ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) v(c)"),
    "r12_data_only": (data_rows, """select '<table:nation/' || n_nationkey || '>' as s, '<table:nation#n_name>' as p, '"' || n_name || '"' as o from nation union all select '<table:nation/' || n_nationkey || '>', '<table:nation#n_nationkey>', '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' from nation union all select '<table:nation/' || n_nationkey || '>', '<table:nation#n_regionkey>', '<table:region/' || n_regionkey || '>' from nation"""),
    "r15_rule_making_rule": (meta_rule, "select a.n_name as a, b.n_name as b from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_name < b.n_name"),
    "r16_truth": (truth_rule, "select n_name as a, r_name as b from nation join region on n_regionkey = r_regionkey"),
    "r17_head_nodes": (skolem, "select n_name as nation, count(distinct c_mktsegment) as nodes from customer join nation on c_nationkey = n_nationkey group by 1"),
    "r18_equality": (smushed, "select '<table:supplier/' || min(s_suppkey::varchar) over (partition by s_nationkey) || '>' as s, s_name as name from supplier"),
    "r19_list_cells": (list_cells, "select '<urn:r/' || n_regionkey || '>' as s, string_agg(n_name, '|' order by n_name) as names from nation group by n_regionkey"),
    "r21_difference": (differing, """with q as (select n_regionkey as r, '<table:nation/' || n_nationkey || '>' as s, unnest([{'p': '<table:nation#n_name>', 'o': '"' || n_name || '"'}, {'p': '<table:nation#n_nationkey>', 'o': '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>'}, {'p': '<table:nation#n_regionkey>', 'o': '<table:region/' || n_regionkey || '>'}]) as c from nation) select 'deleted' as side, s, c.p as p, c.o as o from q where r = 0 union all select 'inserted', s, c.p, c.o from q where r = 3"""),
    "r23_canonical_names": (renamed_nodes, "select n_name as name, true as alone from nation"),
    "b017_conclusion": (conclusion_query, "select r_name as a, j.j::bigint as b from region join (values (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) j(k, j) on r_regionkey = j.k"),
    # sources and sinks
    "s10_ntriples": (quad_text, """select '<table:nation/' || n_nationkey || '> <table:nation#n_name> "' || n_name || '" .' as line from nation union all select '<table:nation/' || n_nationkey || '> <table:nation#n_nationkey> "' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer> .' from nation union all select '<table:nation/' || n_nationkey || '> <table:nation#n_regionkey> <table:region/' || n_regionkey || '> .' from nation"""),
    "s10_round_trip": (quad_round_trip, "select '<table:part/' || p_partkey || '>' as s, p_name as name from part"),
    "s14_output_strings": (strings_put_out, "select 'nation ' || n_name as line from nation"),
    "s23_sheet": (sheet, """select '<urn:sheet#' || r_regionkey || '>' as s, unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:sheet#regionKey>', '<urn:sheet#regionName>']) as p, unnest(['<urn:sheet#Region>', '"' || r_regionkey || '"', '"' || r_name || '"']) as o from region"""),
    # SPARQL
    "q06_patterns": (ask('SELECT DISTINCT ?n ?m WHERE { ?s s:s_name ?n ; s:s_nationkey [ n:n_name ?m ] }'), "select s_name as n, n_name as m from supplier join nation on s_nationkey = n_nationkey"),
    "q08_union": (ask("SELECT ?name WHERE { { ?x r:r_name ?name } UNION { ?y n:n_name ?name } }"), "select r_name as name from region union select n_name from nation"),
    "q09_filter": (ask("SELECT ?k WHERE { ?o o:o_orderkey ?k ; o:o_totalprice ?t FILTER (?t > 100000 && ?t < 120000 || ?k = 7) }"), "select o_orderkey as k from orders where o_totalprice > 100000 and o_totalprice < 120000 or o_orderkey = 7"),
    "q13_order_limit": (ask("SELECT ?k ?t WHERE { ?o o:o_orderkey ?k ; o:o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 10 OFFSET 5"), "select distinct o_orderkey as k, o_totalprice as t from orders order by t desc, k limit 10 offset 5"),
    "q15_arithmetic": (ask("SELECT ?k WHERE { ?p p:p_partkey ?k ; p:p_size ?z FILTER (?z * 3 - 5 - 2 = 20) }"), "select p_partkey as k from part where p_size * 3 - 5 - 2 = 20"),
    "q16_three_valued": (ask('SELECT ?k WHERE { ?c c:c_custkey ?k ; c:c_mktsegment ?m . OPTIONAL { ?o o:o_custkey ?c ; o:o_orderpriority "1-URGENT" ; o:o_orderstatus ?s } FILTER (!(?s = "F") || ?m = "BUILDING") }'), "select distinct c_custkey as k from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT' where not (o_orderstatus = 'F') or c_mktsegment = 'BUILDING'"),
    "q18_bound": (ask('SELECT ?k WHERE { ?c c:c_custkey ?k . OPTIONAL { ?o o:o_custkey ?c ; o:o_orderpriority "1-URGENT" ; o:o_orderstatus ?s } FILTER (!bound(?s)) }'), "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')"),
    "q19_kinds": (ask("SELECT ?k WHERE { ?c c:c_custkey ?k ; c:c_nationkey ?n ; c:c_name ?m FILTER (isURI(?n) && isLITERAL(?m) && !isBLANK(?n)) }"), "select c_custkey as k from customer"),
    "q23_regex_str": (ask('SELECT ?k WHERE { ?p p:p_partkey ?k ; p:p_name ?n FILTER (regex(str(?n), "(bolt|nut)$") && datatype(?k) = xsd:integer && lang(?n) = "") }'), "select p_partkey as k from part where regexp_matches(p_name, '(bolt|nut)$')"),
    "q24_cast": (ask('SELECT ?k WHERE { ?c c:c_custkey ?k ; c:c_acctbal ?b FILTER (xsd:integer(?b) = 100 || xsd:string(?k) = "7") }'), "select c_custkey as k from customer where trunc(c_acctbal) = 100 or c_custkey = 7"),
    "q03_construct": (lambda spark, d: facts_of(ask("CONSTRUCT { ?n :sells ?m } WHERE { ?s s:s_name ?n ; s:s_nationkey ?x . ?x n:n_name ?m }")(spark, d), "sells", "string", "string"), "select s_name as a, n_name as b from supplier join nation on s_nationkey = n_nationkey"),
    "q04_ask": (ask('ASK { ?n n:n_name "NATION_3" }'), "select count(*) > 0 as ask from nation where n_name = 'NATION_3'"),
    # built-ins, by family
    "b_math": (
        cells("lineitem", k=lambda r: r["l_orderkey"].col, ln=lambda r: r[B_].col, total=rounded(_f("math:sum", A, B_, num(0.5))), diff=rounded(_f("math:difference", A, B_)), prod=rounded(_f("math:product", A, B_, num(2))), quot=rounded(_f("math:quotient", A, B_)), iquot=_f("math:integerQuotient", "l_orderkey", num(-7)), rem=_f("math:remainder", "l_orderkey", num(-7)), power=as_text(_f("math:exponentiation", B_, num(3))), bit=_f("math:bit", "l_orderkey", num(2)), neg=rounded(_f("math:negation", A)), absolute=rounded(_f("math:absoluteValue", num(-2.5))), rnd=_f("math:rounded", "l_discount"), n=_f("math:memberCount", A, B_), gt=_t("math:greaterThan", A, num(20)), ngt=_t("math:notGreaterThan", A, num(20)), lt=_t("math:lessThan", A, num(20)), nlt=_t("math:notLessThan", A, num(20)), eq=_t("math:equalTo", A, B_), ne=_t("math:notEqualTo", A, txt("7"))),
        "select distinct l_orderkey as k, l_linenumber::bigint as ln, round(l_quantity + l_linenumber + 0.5::double, 6) as total, round(l_quantity - l_linenumber, 6) as diff, round(l_quantity * l_linenumber * 2, 6) as prod, round(l_quantity / l_linenumber, 6) as quot, floor(l_orderkey / -7.0)::bigint as iquot, (l_orderkey - (-7) * floor(l_orderkey / -7.0))::bigint as rem, (l_linenumber * l_linenumber * l_linenumber)::varchar as power, ((l_orderkey >> 2) & 1)::bigint as bit, round(-l_quantity, 6) as neg, 2.5::double as absolute, round(l_discount, 0)::double as rnd, 2::bigint as n, l_quantity > 20 as gt, l_quantity <= 20 as ngt, l_quantity < 20 as lt, l_quantity >= 20 as nlt, l_quantity = l_linenumber as eq, l_quantity <> 7 as ne from lineitem",
    ),
    "b_math_back": (
        cells("orders", k=lambda r: r["o_orderkey"].col, s=_r("math:sumOf", "o_orderkey", num(1)), d=_r("math:differenceOf", "o_orderkey", num(1)), f=_r("math:factors", "o_orderkey", num(3)), q=rounded(_r("math:quotientOf", "o_orderkey", num(4))), m=_r("math:remainderOf", "o_orderkey", num(5)), e=as_text(_r("math:exponentiationOf", num(2), num(10))), neg=_r("math:negation", "o_orderkey")),
        "select o_orderkey as k, o_orderkey + 1 as s, o_orderkey - 1 as d, o_orderkey * 3 as f, round(o_orderkey / 4, 6) as q, o_orderkey % 5 as m, '1024' as e, -o_orderkey as neg from orders",
    ),
    "b_trig": (
        cells("supplier", k=lambda r: r["s_suppkey"].col, c=rounded(_f("math:cos", "s_acctbal")), s=rounded(_f("math:sin", "s_acctbal")), t=rounded(_f("math:tan", "s_nationkey")), ch=rounded(_f("math:cosh", num(1.5))), sh=rounded(_f("math:sinh", num(1.5))), th=rounded(_f("math:tanh", "s_nationkey")), d=rounded(_f("math:degrees", "s_nationkey")), rad=rounded(_r("math:degrees", "s_nationkey")), acos=rounded(_r("math:cos", num(0.25))), asin=rounded(_r("math:sin", num(0.25))), atan=rounded(_r("math:tan", "s_nationkey")), none=rounded(_r("math:sin", num(2))), at2=rounded(_f("math:atan2", "s_nationkey", num(3)))),
        "select s_suppkey as k, round(cos(s_acctbal), 6) as c, round(sin(s_acctbal), 6) as s, round(tan(s_nationkey), 6) as t, round(cosh(1.5), 6) as ch, round(sinh(1.5), 6) as sh, round(tanh(s_nationkey), 6) as th, round(degrees(s_nationkey), 6) as d, round(radians(s_nationkey), 6) as rad, round(acos(0.25), 6) as acos, round(asin(0.25), 6) as asin, round(atan(s_nationkey), 6) as atan, null::double as none, round(atan2(s_nationkey, 3), 6) as at2 from supplier",
    ),
    "b_maths": (
        cells("part", k=lambda r: r["p_partkey"].col, s=_f("maths:sum", "p_size", num(1)), d=_f("maths:difference", "p_size", num(1)), p=_f("maths:product", "p_size", num(2)), q=_f("maths:quotient", num(9), num(2)), iq=_f("maths:integerQuotient", "p_size", num(4)), rm=_f("maths:remainder", "p_size", num(4)), e=_f("maths:exponentiation", "p_size", num(2)), so=_r("maths:sumOf", "p_size", num(1)), dof=_r("maths:differenceOf", "p_size", num(1)), fa=_r("maths:factors", "p_size", num(2)), qo=_r("maths:quotientOf", num(8), num(2)), ro=_r("maths:remainderOf", "p_size", num(4)), eo=_r("maths:exponentiationOf", "p_size", num(2)), ng=_f("maths:negation", "p_size"), ab=_f("maths:absoluteValue", num(-3)), rd=_f("maths:rounded", num(2.5)), gt=_t("maths:greaterThan", "p_size", txt("07")), ngt=_t("maths:notGreaterThan", "p_size", txt("07")), lt=_t("maths:lessThan", "p_size", txt("07")), nlt=_t("maths:notLessThan", "p_size", txt("07")), eq=_t("maths:equalTo", "p_size", txt("7.0")), ne=_t("maths:notEqualTo", "p_size", txt("7.0")), n=_f("maths:memberCount", "p_size", "p_name")),
        "select p_partkey as k, (p_size + 1)::varchar as s, (p_size - 1)::varchar as d, (p_size * 2)::varchar as p, '4.5' as q, (p_size // 4)::varchar as iq, (p_size % 4)::varchar as rm, (p_size * p_size)::varchar as e, (p_size + 1)::varchar as so, (p_size - 1)::varchar as dof, (p_size * 2)::varchar as fa, '4' as qo, (p_size % 4)::varchar as ro, (p_size * p_size)::varchar as eo, (-p_size)::varchar as ng, '3' as ab, '3' as rd, p_size > 7 as gt, p_size <= 7 as ngt, p_size < 7 as lt, p_size >= 7 as nlt, p_size = 7 as eq, p_size <> 7 as ne, '2' as n from part",
    ),
    "b_string_tests": (
        cells("part", k=lambda r: r["p_partkey"].col, gt=_t("string:greaterThan", "p_name", "p_type"), ngt=_t("string:notGreaterThan", "p_name", "p_type"), lt=_t("string:lessThan", "p_name", "p_type"), nlt=_t("string:notLessThan", "p_name", "p_type"), st=_t("string:startsWith", "p_name", txt("cold")), en=_t("string:endsWith", "p_name", txt("bolt")), co=_t("string:contains", "p_name", txt("ol")), ci=_t("string:containsIgnoringCase", "p_type", txt("eCoN")), cr=_t("string:containsRoughly", "p_type", txt("ECON")), ncr=_t("string:notContainsRoughly", "p_type", txt("ECON")), dnc=_t("string:doesNotContain", "p_name", txt("ol")), eqi=_t("string:equalIgnoringCase", "p_brand", txt("BRAND#11")), nei=_t("string:notEqualIgnoringCase", "p_brand", txt("BRAND#11")), ma=_t("string:matches", "p_name", txt("t$")), nma=_t("string:notMatches", "p_name", txt("t$"))),
        "select p_partkey as k, p_name > p_type as gt, p_name <= p_type as ngt, p_name < p_type as lt, p_name >= p_type as nlt, starts_with(p_name, 'cold') as st, ends_with(p_name, 'bolt') as en, contains(p_name, 'ol') as co, contains(lower(p_type), 'econ') as ci, contains(lower(p_type), 'econ') as cr, not contains(lower(p_type), 'econ') as ncr, not contains(p_name, 'ol') as dnc, lower(p_brand) = 'brand#11' as eqi, lower(p_brand) <> 'brand#11' as nei, regexp_matches(p_name, 't$') as ma, not regexp_matches(p_name, 't$') as nma from part",
    ),
    "b_string": (
        cells("part", k=lambda r: r["p_partkey"].col, cc=_r("string:concat", "p_name", "p_brand"), cn=_f("string:concatenation", "p_name", "p_size"), sc=_f("string:scrape", "p_name", txt("([a-z])[a-z]*$")), rp=_f("string:replace", "p_name", txt("a"), txt("<&>")), se=lambda r: _f("string:search", "p_brand", txt("(.)#(.)"))(r).items[1].col, sp=lambda r: F.array_join(_f("string:split", "p_brand", txt("#"), num(0))(r).col, "|"), tk=lambda r: F.size(_f("fn:tokenize", "p_name", txt("a"))(r).col), ns=_f("fn:normalize-space", lambda r: Val.text(F.concat(F.lit("  x \n"), F.col("p_name"), F.lit(" ")))), tl=lambda r: F.size(_f("string:stringToList", "p_brand")(r).col), fl=lambda r: named("string:stringToList").reverse(_f("string:stringToList", "p_brand")(r)), fm=_f("string:format", txt("%s has size %d"), "p_name", "p_size"), xd=_f("string:xmlEscapeData", lambda r: Val.text(F.concat(F.lit("<&>\""), F.col("p_name")))), xa=_f("string:xmlEscapeAttribute", lambda r: Val.text(F.concat(F.lit("<&>\""), F.col("p_brand")))), eu=_f("string:encodeForURI", lambda r: Val.text(F.concat(F.col("p_brand"), F.lit(" a/b~*")))), ef=_f("string:encodeForFragID", lambda r: Val.text(F.concat(F.col("p_brand"), F.lit(" a/b*")))), ru=lambda r: named("fn:resolve-uri").forward(_keys(Val.text(F.replace(r["p_brand"].col, F.lit("#"), F.lit("/"))), txt("http://ex.org/a/b")))),
        """select p_partkey as k, p_name || p_brand as cc, p_name || p_size as cn, nullif(regexp_extract(p_name, '([a-z])[a-z]*$', 1), '') as sc, replace(p_name, 'a', '<&>') as rp, regexp_extract(p_brand, '(.)#(.)', 2) as se, replace(p_brand, '#', '|') as sp, length(string_split(p_name, 'a'))::bigint as tk, 'x ' || p_name as ns, length(p_brand)::bigint as tl, p_brand as fl, p_name || ' has size ' || p_size as fm, '&#60;&#38;&#62;"' || p_name as xd, '&#60;&#38;&#62;&#34;' || p_brand as xa, p_brand || '%20a%2Fb~*' as eu, replace(p_brand, '#', '%23') || '%20a/b%2A' as ef, 'http://ex.org/a/' || replace(p_brand, '#', '/') as ru from part""",
    ),
    "b_time": (
        cells("events", k=lambda r: r["event_id"].col, s=lambda r: _ts("time:inSeconds")(r).double(), back=lambda r: named("time:inSeconds").reverse(_ts("time:inSeconds")(r)), y=_ts("time:year"), mo=_ts("time:month"), dd=_ts("time:day"), da=_ts("time:date"), h=_ts("time:hour"), mi=_ts("time:minute"), se=_ts("time:second"), wd=_ts("time:dayOfWeek"), fm=_ts("time:format", txt("%d/%m/%Y %H:%M")), eq=lambda r: named("time:equalTo").test(TS(r), Val.text(F.date_format(r["ts"].col, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))), tz=lambda r: named("time:timeZone").forward(Val.text(F.concat(F.date_format(r["ts"].col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))), fs=_f("time:formatSeconds", "event_id", txt("%Y-%m-%d")), ps=lambda r: named("time:parseToSeconds").forward(_keys(Val.text(F.date_format(r["ts"].col, "dd/MM/yyyy")), txt("%d/%m/%Y"))), pa=lambda r: named("time:parse").forward(_keys(Val.text(F.date_format(r["ts"].col, "dd/MM/yyyy")), txt("%d/%m/%Y")))),
        f"select event_id as k, epoch(date_trunc('second', ts))::double as s, {SQL_TS} as back, year(ts) as y, month(ts) as mo, day(ts) as dd, strftime(ts, '%Y-%m-%d') as da, hour(ts) as h, minute(ts) as mi, second(ts) as se, isodow(ts) - 1 as wd, strftime(ts, '%d/%m/%Y %H:%M') as fm, true as eq, '+05:30' as tz, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d') as fs, epoch(date_trunc('day', ts))::bigint as ps, strftime(ts, '%Y-%m-%dT00:00:00Z') as pa from events",
    ),
    "b_times": (
        cells("events", k=lambda r: r["event_id"].col, s=_ts("times:inSeconds"), back=lambda r: named("times:inSeconds").reverse(_ts("times:inSeconds")(r)), y=_ts("times:year"), mo=_ts("times:month"), dd=_ts("times:day"), da=_ts("times:date"), h=_ts("times:hour"), mi=_ts("times:minute"), se=_ts("times:second"), wd=_ts("times:dayOfWeek"), fm=_ts("times:format", txt("%Y.%j")), eq=lambda r: named("times:equalTo").test(TS(r), TS(r)), tz=lambda r: named("times:timeZone").forward(Val.text(F.concat(F.date_format(r["ts"].col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-08:00")))), fs=_f("times:formatSeconds", "event_id", txt("%H:%M:%S")), ps=lambda r: named("times:parseToSeconds").forward(_keys(Val.text(F.date_format(r["ts"].col, "yyyy-MM-dd")), txt("%Y-%m-%d")))),
        f"select event_id as k, epoch(date_trunc('second', ts))::bigint::varchar as s, {SQL_TS} as back, strftime(ts, '%Y') as y, strftime(ts, '%m') as mo, strftime(ts, '%d') as dd, strftime(ts, '%Y-%m-%d') as da, strftime(ts, '%H') as h, strftime(ts, '%M') as mi, strftime(ts, '%S') as se, (isodow(ts) - 1)::varchar as wd, strftime(ts, '%Y.%j') as fm, true as eq, '-08:00' as tz, strftime(make_timestamp(event_id * 1000000), '%H:%M:%S') as fs, epoch(date_trunc('day', ts))::bigint::varchar as ps from events",
    ),
    "b_crypto": (
        cells("documents", k=lambda r: r["doc_id"].col, m=_f("crypto:md5", "text"), s1=_f("crypto:sha", "text"), s256=_f("crypto:sha256", "text"), n224=lambda r: F.length(_f("crypto:sha224", "text")(r).col), n384=lambda r: F.length(_f("crypto:sha384", "text")(r).col), n512=lambda r: F.length(_f("crypto:sha512", "text")(r).col)),
        "select distinct doc_id as k, md5(text) as m, sha1(text) as s1, sha256(text) as s256, case when text is not null then 56::bigint end as n224, case when text is not null then 96::bigint end as n384, case when text is not null then 128::bigint end as n512 from documents",
    ),
    "b_list": (
        cells("nation", k=lambda r: r["n_nationkey"].col, first=key(_f("rdf:first", "n_name", "n_nationkey")), last=key(_f("list:last", "n_nationkey", "n_name")), rest=key(_f("rdf:rest", "n_nationkey", "n_name")), isin=lambda r: named("list:in").test(r["n_name"], _keys(txt("NATION_3"), txt("NATION_7"))), member=lambda r: named("list:member").test(_keys(txt("NATION_3"), txt("NATION_7")), r["n_name"]), app=key(lambda r: named("list:append").forward(_keys(_keys(r["n_name"]), _keys(txt("x"), txt("y"))))), members=key(_f("list:members", "n_name", txt("NATION_3"), "n_name"))),
        """select n_nationkey::bigint as k, '"' || n_name || '"' as first, '"' || n_name || '"' as last, '["\\"' || n_name || '\\""]' as rest, n_name in ('NATION_3', 'NATION_7') as isin, n_name in ('NATION_3', 'NATION_7') as member, '["\\"' || n_name || '\\"","\\"x\\"","\\"y\\""]' as app, case when n_name = 'NATION_3' then '$["\\"NATION_3\\""]' else '$["\\"' || least(n_name, 'NATION_3') || '\\"","\\"' || greatest(n_name, 'NATION_3') || '\\""]' end as members from nation""",
    ),
    "b_set": (
        cells("embeddings", k=lambda r: r["vec_id"].col, u=lambda r: F.size(named("set:union").forward(_keys(r["embedding"], r["embedding"])).element_keys()), i=lambda r: F.size(named("set:intersection").forward(_keys(r["embedding"], r["embedding"])).element_keys()), d=lambda r: F.size(named("set:difference").forward(_keys(r["embedding"], r["embedding"])).element_keys()), s=lambda r: F.size(named("set:symmetricDifference").forward(_keys(r["embedding"], _keys())).element_keys()), o=lambda r: F.size(named("set:oneOf").reverse(r["embedding"]).element_keys()), isin=lambda r: named("set:in").test(r["embedding"].member(3), r["embedding"]), member=lambda r: named("set:member").test(r["embedding"], num(7)), total=lambda r: F.round(named("math:sum").forward(r["embedding"]).double(), 4), n=_f("math:memberCount", "embedding")),
        "select vec_id as k, len(list_distinct(embedding))::bigint as u, len(list_distinct(embedding))::bigint as i, 0::bigint as d, len(list_distinct(embedding))::bigint as s, len(list_distinct(embedding))::bigint as o, true as isin, false as member, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total, len(embedding)::bigint as n from embeddings",
    ),
    "b_log": (
        cells("customer", k=lambda r: r["c_custkey"].col, eq=lambda r: named("log:equalTo").test(r["c_mktsegment"], txt("BUILDING")), ne=lambda r: named("log:notEqualTo").test(r["c_mktsegment"], txt("BUILDING")), uri=lambda r: named("log:uri").forward(Val("row", F.col("c_custkey"), table="customer")), back=key(lambda r: named("log:uri").reverse(Val.text(F.concat(F.lit("urn:x#"), r["c_name"].col)))), none=key(_r("log:uri", "c_mktsegment")), raw=lambda r: named("log:rawUri").forward(Val("row", F.col("c_custkey"), table="customer")), kind=key(_f("log:rawType", "c_name")), racine=key(lambda r: named("log:racine").forward(Val("key", terms.iri_key(F.concat(F.lit("urn:x#"), r["c_name"].col))))), dt=key(lambda r: named("log:dtlit").forward(_keys(r["c_name"], Val.constant(f"<{N.XSD}token>"))))),
        f"""select c_custkey as k, c_mktsegment = 'BUILDING' as eq, c_mktsegment <> 'BUILDING' as ne, 'table:customer/' || c_custkey as uri, '<urn:x#' || c_name || '>' as back, null::varchar as none, 'table:customer/' || c_custkey as raw, '<{N.LOG}Literal>' as kind, '<urn:x>' as racine, '"' || c_name || '"^^<http://www.w3.org/2001/XMLSchema#token>' as dt from customer""",
    ),
    "b_sparql": (
        cells("orders", k=lambda r: r["o_orderkey"].col, eq=_t("sparql:equals", "o_totalprice", num(1)), ne=_t("sparql:notEquals", "o_orderstatus", txt("F")), lt=_t("sparql:lessThan", "o_totalprice", num(100000)), gt=_t("sparql:greaterThan", "o_totalprice", num(100000)), ngt=_t("sparql:notGreaterThan", "o_orderpriority", txt("3")), nlt=_t("sparql:notLessThan", "o_orderpriority", txt("3")), mixed=_t("sparql:lessThan", "o_orderpriority", num(3)), tv=lambda r: named("sparql:truthValue").test(r["o_orderstatus"], Val("bool", F.lit(True))), te=lambda r: named("sparql:typeErrorIsTrue").test(Val("row", F.col("o_orderkey"), table="orders"), Val("bool", F.lit(True))), dt=key(lambda r: named("sparql:dtLit").reverse(r["o_orderkey"]).items[1]), lang=lambda r: named("sparql:langLit").reverse(r["o_orderstatus"]).items[1].col),
        "select o_orderkey as k, o_totalprice = 1 as eq, o_orderstatus <> 'F' as ne, o_totalprice < 100000 as lt, o_totalprice > 100000 as gt, o_orderpriority <= '3' as ngt, o_orderpriority >= '3' as nlt, null::boolean as mixed, o_orderstatus <> '' as tv, true as te, '<http://www.w3.org/2001/XMLSchema#integer>' as dt, '' as lang from orders",
    ),
    "b_uri": (
        cells("pages", k=lambda r: r["page_id"].col, scheme=_f("uri:scheme", "url"), host=_f("uri:host", "url"), canon=lambda r: named("uri:canon").forward(Val.text(F.concat(F.lit("HTTP://Ex.ORG/%7ea/"), r["page_id"].lex())))),
        "select page_id as k, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host, 'http://ex.org/~a/' || page_id as canon from pages",
    ),
    "b_xml": (
        cells("nation", k=lambda r: r["n_nationkey"].col, t=_xml("dom:nodeType"), name=_xml("dom:nodeName"), local=_xml("dom:localName"), value=_xml("dom:nodeValue"), att=lambda r: F.size(_xml("dom:attributes")(r).element_keys()), ha=_xml("dom:hasAttributes"), hc=_xml("dom:hasChildNodes"), first=_xml("dom:firstChild", "dom:nodeName"), last=_xml("dom:lastChild", "dom:nodeName"), kids=lambda r: F.size(_xml("dom:childNodes")(r).element_keys()), nxt=lambda r: named("dom:nodeName").forward(named("dom:nextSibling").forward(named("dom:firstChild").forward(XML_ROW(r)))), prv=lambda r: named("dom:nodeValue").forward(named("dom:previousSibling").forward(named("dom:lastChild").forward(XML_ROW(r)))), par=lambda r: named("dom:nodeName").forward(named("dom:parentNode").forward(named("dom:firstChild").forward(XML_ROW(r)))), xp=lambda r: F.get(named("dom:xpath").generate(_keys(XML_ROW(r), txt("/n/m/text()"))), F.lit(0)), fs=_xml("fn:string"), same=lambda r: named("dom:isSameNode").test(XML_ROW(r), XML_ROW(r))),
        """select n_nationkey::bigint as k, 1::bigint as t, 'n' as name, 'n' as local, n_name as value, 1::bigint as att, true as ha, true as hc, 'm' as first, 'x' as last, 2::bigint as kids, 'x' as nxt, n_name as prv, 'n' as par, '"' || n_name || '"' as xp, n_name as fs, true as same from nation""",
    ),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
