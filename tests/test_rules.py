"""Rules, graph built-ins and the planner over small graphs."""

import pytest

from quadrille import names as N
from quadrille import terms
from quadrille.plans import graphs  # noqa: F401
from quadrille.plans import rules as R
from quadrille.plans.data import Dataset
from quadrille.plans.match import Matcher, Unbound
from quadrille.sources import n3

HEAD = "@prefix : <urn:t#>. " + "".join(f"@prefix {k}: <{v}>. " for k, v in N.PREFIXES.items())


def run(spark, text, think=True, **how):
    f = n3.parse(HEAD + text, base="urn:t")
    ds = Dataset.of(spark, f)
    done = R.think(ds, R.rules_of(f), **how) if think else R.apply_rules(ds, R.rules_of(f))
    return {(r["s"], r["p"], r["o"]) for r in done.quads.where("g = ''").collect() if r["p"] != N.IMPLIES}


def t(x):
    return f"<urn:t#{x}>"


def facts(out, p):
    return {(terms.text(s).removeprefix("urn:t#"), terms.text(o).removeprefix("urn:t#")) for s, q, o in out if q == t(p)}


def test_closure_on_a_cycle(spark):
    out = run(spark, ":a :p :b. :b :p :c. :c :p :a. {?x :p ?y. ?y :p ?z} => {?x :p ?z}.")
    assert facts(out, "p") == {(a, b) for a in "abc" for b in "abc"}


def reached(links):
    """All pairs (a, b) where links lead from a to b."""
    found, ends = set(links), set(links)
    while ends:
        ends = {(a, d) for a, b in ends for c, d in links if b == c} - found
        found |= ends
    return found


FOREST = {(i, i // 2) for i in range(2, 60)} | {(i, i + 1) for i in range(100, 120)}
RINGS = {(i, i - i % 10 + (i + 1) % 10) for i in range(30)} | {(50, 3), (51, 50), (60, 60), (61, 60)}
FORKS = {(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)}


@pytest.mark.parametrize("links", [FOREST, {(b, a) for a, b in FOREST}, RINGS, {(b, a) for a, b in RINGS}, FORKS], ids=["forest", "downwards", "rings", "backwards", "forks"])
@pytest.mark.parametrize(
    "rule", ["{?x :q ?y. ?y :q ?z} => {?x :q ?z}", "{?y :q ?z. ?x :q ?y} => {?x :q ?z}"]
)
def test_closure_has_every_pair(spark, links, rule):
    text = " ".join(f":{a} :p :{b}." for a, b in links) + " {?x :p ?y} => {?x :q ?y}. " + rule + "."
    out = run(spark, text)
    assert facts(out, "q") == {(str(a), str(b)) for a, b in reached(links)} and facts(out, "p") == {(str(a), str(b)) for a, b in links}


def test_forest_closes_without_rounds_of_pairs(spark, monkeypatch):
    """Paths double, one row for each node: no table of derived pairs is written for the closing rule."""
    tables = []
    real = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name, *a: tables.append(name) or real(df, name, *a))
    text = " ".join(f":{a} :p :{b}." for a, b in FOREST) + " {?x :p ?y} => {?x :q ?y}. {?x :q ?y. ?y :q ?z} => {?x :q ?z}."
    assert facts(run(spark, text), "q") == {(str(a), str(b)) for a, b in reached(FOREST)}
    assert tables.count("derived") == 1


@pytest.mark.parametrize("rule", ["{?x :q ?y. ?y :p ?z} => {?x :q ?z}", "{?y :q ?z. ?x :p ?y} => {?x :q ?z}"])
def test_linear_rule_on_rings_needs_few_rounds(spark, rule):
    text = " ".join(f":{a} :p :{b}." for a, b in RINGS) + " {?x :p ?y} => {?x :q ?y}. " + rule + "."
    assert facts(run(spark, text, max_rounds=5), "q") == {(str(a), str(b)) for a, b in reached(RINGS)}


@pytest.mark.parametrize("rule", ["{?x :q ?y. ?y :p ?z} => {?x :q ?z}", "{?x :p ?y. ?y :q ?z} => {?x :q ?z}"])
def test_linear_rule_concludes_from_its_own_facts_only(spark, rule):
    """The closed predicate starts from fewer facts, or from more, than the steps."""
    for more, want in ((":2 :q :3.", {(2, 3), (2, 4)} if rule.index(":q") < rule.index(":p") else {(2, 3), (1, 3)}), (":9 :q :1. {?x :p ?y} => {?x :q ?y}.", None)):
        out = facts(run(spark, ":1 :p :2. :2 :p :3. :3 :p :4. " + more + " " + rule + "."), "q")
        if want is None:
            closed = reached({(1, 2), (2, 3), (3, 4)})
            want = closed | {(9, 1)} | ({(9, b) for b in (2, 3, 4)} if rule.index(":q") < rule.index(":p") else set())
        assert out == {(str(a), str(b)) for a, b in want}


def test_long_paths_are_left_to_rounds(spark, monkeypatch):
    monkeypatch.setattr("quadrille.operators.paths.all_next.__defaults__", (4,))
    text = " ".join(f":{i} :p :{i + 1}." for i in range(20)) + " {?x :p ?y. ?y :p ?z} => {?x :p ?z}."
    assert facts(run(spark, text), "p") == {(str(a), str(b)) for a in range(20) for b in range(a + 1, 21)}


def test_one_row_has_one_partition(spark):
    """Built-ins on constants alone do not start Python workers for empty partitions."""
    (r,) = R.rules_of(n3.parse(HEAD + '{ ?k crypto:keyLength 256. ("x" ?k) crypto:sign ?s } => { :a :b ?s }.'))
    b = Matcher(Dataset(spark)).solve(r.body)
    assert b.df.rdd.getNumPartitions() == 1 and b.df.count() == 1


def test_two_routes_give_one_fact(spark):
    out = run(spark, ":m :color :green; :sounds :soft. {?x :color :green} => {?x :is :relaxing}. {?x :sounds :soft} => {?x :is :relaxing}.")
    assert facts(out, "is") == {("m", "relaxing")}


def test_blank_nodes_in_bodies_and_heads(spark):
    out = run(spark, ":joe :father [:brother :bob]. {?a :father [:brother ?b]} => {?a :uncle ?b; :has [:name ?b]}.")
    assert facts(out, "uncle") == {("joe", "bob")}
    assert len(facts(out, "name")) == 1 and {o for _, o in facts(out, "has")} == {s for s, _ in facts(out, "name")}


def test_rule_in_head(spark):
    out = run(spark, ":anc a :Transitive. :g :anc :p. :p :anc :b. {?p a :Transitive} => {{?x ?p ?y. ?y ?p ?z} => {?x ?p ?z}}.")
    assert ("g", "b") in facts(out, "anc")


def test_one_pass_against_fixpoint(spark):
    text = ":a :p :b. {?x :p ?y} => {?y :q ?x}. {?x :q ?y} => {?x :r ?y}."
    assert facts(run(spark, text, think=False), "r") == set() and facts(run(spark, text), "r") == {("b", "a")}


def test_negation_in_layers(spark):
    text = ":a :p 1. :b :p 2. {?x :p ?v. ?v math:greaterThan 1} => {?x :big true}. {?x :p ?v. ?S log:notIncludes {?x :big true}} => {?x :small true}."
    assert facts(run(spark, text), "small") == {("a", "true")}
    with pytest.raises(ValueError, match="negation"):
        R.strata(R.rules_of(n3.parse(HEAD + "{?x :p ?y. ?S log:notIncludes {?x :q ?y}} => {?x :q ?y}.", "urn:t")))


def test_divergence_is_noticed(spark):
    with pytest.raises(RuntimeError):
        run(spark, ":a :n 1. {?x :n ?v. (?v 1) math:sum ?w} => {?x :n ?w}.", max_rounds=3)


def test_unbound_builtin(spark):
    with pytest.raises(Unbound):
        run(spark, "{?x math:greaterThan 1} => {?x :is :big}.")


def test_graph_builtins(spark):
    out = run(
        spark,
        """:a :says {:b :c :d. :b :c :e}.
        {?x :says ?f. ?f log:includes {:b :c ?y}. ?f log:notIncludes {?y :c ?z}} => {?x :heard ?y}.
        {?x :says ?f. ?f log:notIncludes {:b :c :d}} => {?x :never ?f}.
        {{:a :p :b. {?x :p ?y} => {?y :q ?x}} log:conclusion ?c. ?c log:includes {?u :q ?v}} => {?u :concluded ?v}.
        {({:a :b :c} {:d :e :f}) log:conjunction ?g. ?g log:includes {:a :b ?s. :d :e ?t}} => {?s :with ?t}.
        {({:k :l :m} {{?x :l ?y} => {?y :l ?x}}) log:filter ?h. ?h log:includes {?p :l ?q}} => {?p :filtered ?q}.
        {{:a :p :b. {?x :p ?y} => {?y :p ?x}} log:supports {:b :p :a}} => {:ok :supports :yes}.
        {"@prefix : <urn:t#>. :x :y :z." log:parsedAsN3 ?n. ?n log:includes {:x :y ?w}} => {:text :gives ?w}.
        {{:a :b "x"} log:n3String ?s. ?s string:contains "<urn:t#>"} => {:written :as :text}.""",
    )
    assert facts(out, "heard") == {("a", "d"), ("a", "e")} and facts(out, "never") == set()
    assert facts(out, "concluded") == {("b", "a")} and facts(out, "with") == {("c", "f")}
    assert facts(out, "filtered") == {("m", "k")} and facts(out, "supports") == {("ok", "yes")}
    assert facts(out, "gives") == {("text", "z")} and facts(out, "as") == {("written", "text")}


def test_documents_and_reification(spark, tmp_path):
    (tmp_path / "d.n3").write_text("@prefix : <urn:t#>. :in :the :file.")
    uri = (tmp_path / "d.n3").as_uri()
    out = run(
        spark,
        f"""{{<{uri}> log:semantics ?f. ?f log:includes {{:in :the ?x}}}} => {{:doc :has ?x}}.
        {{<{uri}> log:content ?t. ?t string:contains "file"}} => {{:doc :text true}}.
        {{<file:///no/such> log:semanticsOrError ?e. ?e log:rawType log:Literal}} => {{:doc :missing true}}.
        {{{{:a :b (1 "x")}} log:reification ?r. ?q log:reification ?r. ?q log:includes {{:a :b ?l}}. ?l list:last ?z}} => {{:back :is ?z}}.""",
    )
    assert facts(out, "has") == {("doc", "file")} and facts(out, "text") and facts(out, "missing") and facts(out, "is") == {("back", "x")}


def test_lists_and_sets(spark):
    out = run(
        spark,
        """:a :l (1 2 (3 4)); :s {$ :x, :y $}. :t :l (5 5).
        {?x :l (?a ?b ?c). ?c list:last ?d. ?e list:in ?c} => {?x :last ?d; :in ?e}.
        {?x :l (?a ?a)} => {?x :twice ?a}.
        {?x :s {$ :x, ?o $}} => {?x :other ?o}.
        {?x :l ?l. ?l math:memberCount ?n. ?l rdf:first ?f} => {?x :n ?n; :first ?f}.
        {({$ 1, 2 $} {$ 2, 3 $}) set:intersection ?i. ?i set:member ?m} => {:i :m ?m}.""",
    )
    assert facts(out, "last") == {("a", "4")} and facts(out, "in") == {("a", "3"), ("a", "4")}
    assert facts(out, "twice") == {("t", "5")} and facts(out, "other") == {("a", "y")}
    assert facts(out, "n") == {("a", "3"), ("t", "2")} and facts(out, "m") == {("i", "2")}


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ("(1 2.5) math:sum", '"3.5"^^<' + N.DECIMAL + ">"),
        ("() math:sum", terms.value(0)),
        ("() math:product", terms.value(1)),
        ("(-7 3) math:remainder", terms.value(2)),
        ("(-7 2) math:integerQuotient", terms.value(-4)),
        ("(2 100) math:exponentiation", terms.value(2**100)),
        ("(7 1) math:bit", terms.value(1)),
        ('("7" "2") maths:sum', '"9"'),
        ('("a" 1 :x) string:concatenation', '"a1urn:t#x"'),
        ('("abc" "b(.)") string:scrape', '"c"'),
        ('("a,b,c" "," 1) string:split', terms.make_list(['"a"', '"b,c"'])),
        ('"a<b>&\\"" string:xmlEscapeAttribute', '"a&#60;b&#62;&#38;&#34;"'),
        ('"a b/~é" string:encodeForURI', '"a%20b%2F~%C3%A9"'),
        ('("%5.2f|%s" 1.5 "x") string:format', '" 1.50|x"'),
        ('"2002-06-10T12:34:56+02:00" time:timeZone', '"+02:00"'),
        ('"2002-06-10" time:dayOfWeek', terms.value(0)),
        ('"1970-01-02T00:00:00+05:30" time:inSeconds', terms.value(66600.0)),
        ('("10/06/2002" "%d/%m/%Y") time:parse', '"2002-06-10T00:00:00Z"'),
        ("<urn:t#x> log:uri", '"urn:t#x"'),
        ("<urn:t#x> log:racine", "<urn:t>"),
        ("{:a :b :c} log:rawType", f"<{N.LOG}Formula>"),
        ('"x" crypto:md5', '"9dd4e461268c8034f5c8564e155c67a6"'),
        ("((1 2) (3)) list:append", terms.make_list([terms.value(i) for i in (1, 2, 3)])),
        ("(3 1 3) list:members", terms.make_set([terms.value(3), terms.value(1)])),
    ],
)
def test_builtin_values(spark, call, want):
    out = run(spark, f"{{{call} ?v}} => {{:r :v ?v}}.", think=False)
    assert {o for _, p, o in out if p == t("v")} == {want}


def test_signing(spark):
    out = run(spark, '{?k crypto:keyLength 256. ("hello" ?k) crypto:sign ?s. ?k crypto:publicKey ?p. ("hello" ?s ?p) crypto:verifyBoolean ?v. ?p crypto:keyLength ?n} => {:r :v ?v; :n ?n}.', think=False)
    assert facts(out, "v") == {("r", "True")} and facts(out, "n") == {("r", "256")}


def test_stated_builtins(spark):
    f = n3.parse(HEAD + ":x string:startsWith :y. {?a string:startsWith ?b} => {?a :s ?b}.", "urn:t")
    ds = Dataset.of(spark, f)
    (r,) = R.rules_of(f)
    assert Matcher(ds, builtins=False).solve(r.body).df.count() == 1


def test_reasons(spark):
    f = n3.parse(HEAD + ":a :n 3. :a :p :b. {?x :p ?y. ?x :n ?v. ?v math:greaterThan 1} => {?y :q ?v}.", "urn:t")
    ds = Dataset.of(spark, f)
    rows = R.explained(ds, R.rules_of(f))
    (r,) = rows.collect()
    assert set(r["evidence"]) == {f"{t('a')} {t('p')} {t('b')}", f"{t('a')} {t('n')} {terms.value(3)}"} and len(r["checks"]) == 1
    assert R.check_evidence(ds, rows).count() == 0


def test_shapes_of_plans(spark, sf_dir):
    """Filters and columns reach the scans, and patterns about one row are one scan."""
    from quadrille import queries

    df = queries.queries()["j01_join_chain"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 5 and "= BUILDING)" in plan and "l_tax" not in plan and "c_acctbal" not in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
