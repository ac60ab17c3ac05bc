"""SPARQL text to DataFrames.

Patterns compile to joins, OPTIONAL to a left join, UNION to a union, FILTER to
a boolean column in three-valued logic (null is a type error and drops the row).
Solutions are a set, so SELECT and SELECT DISTINCT agree.

Beyond the 2005 draft: ORDER BY, LIMIT, OFFSET, unary minus and plus, isBLANK,
isLITERAL, decimal numbers, DESCRIBE as the statements about the resources, and
arithmetic that groups to the left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille import terms
from quadrille.functions import maths
from quadrille.functions import sparql as values
from quadrille.functions.registry import lookup
from quadrille.plans.data import Dataset, union_all
from quadrille.plans.formula import Formula
from quadrille.plans.match import Bindings, Matcher, _name, one_row, outputs, union
from quadrille.plans.rules import Rule, conclusions
from quadrille.plans.values import Num, Val, null
from quadrille.sources.n3 import _IRI, Parser, join

_WORDS = re.compile(r"[A-Za-z]+")
_VAR = re.compile(r"[?$]([A-Za-z0-9_·À-￿]+)")
_OPS = ("=", "!=", "<=", ">=", "<", ">")
_CASTS = {N.INTEGER: "decimal(38,0)", N.DECIMAL: "decimal(38,18)", N.DOUBLE: "double", N.XSD + "float": "double"}


@dataclass
class Group:
    """A group graph pattern: triples, parts (kind, ...) in order, filters."""

    parts: list[tuple] = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Query:
    form: str = "select"
    variables: list[str] | None = None
    template: Formula | None = None
    resources: list = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)
    where: Group = field(default_factory=Group)
    order: list[tuple] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    prefixes: dict[str, str] = field(default_factory=dict)


class SparqlParser(Parser):
    """Recursive descent over the term syntax of the rule language."""

    def __init__(self, text: str, base: str = ""):
        super().__init__(text, base)
        self.depth = 1
        self.seen: list[str] = []
        self.keywords = {"a", "true", "false"}

    def keyword(self, *words: str) -> bool:
        """Case-insensitive words in a row."""
        self.skip()
        start = self.at
        for w in words:
            m = self.match(_WORDS)
            if not m or m[0].upper() != w or self.text[self.at : self.at + 1] == ":":
                self.at = start
                return False
        return True

    def path(self):
        return self.node()

    def node(self):
        if m := self.match(_VAR):
            v = "?" + m[1]
            if v not in self.seen:
                self.seen.append(v)
            return v
        return super().node()

    def symbol(self, raw: bool = False):
        self.skip()
        if self.text.startswith("<", self.at) and not _IRI.match(self.text, self.at):
            return None
        kept, self.keywords = self.keywords, None
        try:
            return super().symbol(raw)
        finally:
            self.keywords = kept

    def query(self) -> Query:
        q = Query(prefixes=self.prefixes)
        while True:
            if self.keyword("BASE"):
                ref = self.match(_IRI)
                if not ref:
                    self.fail("expected <uri> after BASE")
                self.base = join(self.base, ref[1])
            elif self.keyword("PREFIX"):
                self.on_prefix()
            else:
                break
        if self.keyword("SELECT"):
            self.keyword("DISTINCT")
            if not self.take("*"):
                q.variables = []
                while True:
                    self.take(",")
                    m = self.match(_VAR)
                    if not m:
                        break
                    q.variables.append("?" + m[1])
                if not q.variables:
                    self.fail("expected variables or *")
        elif self.keyword("CONSTRUCT"):
            q.form = "construct"
            if not self.take("{"):
                self.fail("expected a template")
            q.template = Formula(self.triples("}"))
            if not self.take("}"):
                self.fail("expected '}'")
        elif self.keyword("ASK"):
            q.form = "ask"
        elif self.keyword("DESCRIBE"):
            q.form = "describe"
            if not self.take("*"):
                while (r := self.node() if self.peek("?") or self.peek("$") else self.symbol()) is not None:
                    q.resources.append(r)
                    if self.peek("{"):
                        break
        else:
            self.fail("expected SELECT, CONSTRUCT, ASK or DESCRIBE")
        while self.keyword("FROM"):
            named = self.keyword("NAMED")
            (q.named if named else q.sources).append(self.symbol())
        has_where = self.keyword("WHERE")
        if has_where or self.peek("{"):
            q.where = self.group()
        elif q.form != "describe":
            self.fail("expected a pattern")
        if self.keyword("ORDER", "BY"):
            while True:
                if self.keyword("DESC"):
                    q.order.append((self.bracketed(), True))
                elif self.keyword("ASC"):
                    q.order.append((self.bracketed(), False))
                elif self.peek("?") or self.peek("$"):
                    q.order.append((("term", self.node()), False))
                elif self.peek("("):
                    q.order.append((self.bracketed(), False))
                else:
                    break
        for _ in range(2):
            if self.keyword("LIMIT"):
                q.limit = self.whole()
            elif self.keyword("OFFSET"):
                q.offset = self.whole()
        self.skip()
        if self.at < len(self.text):
            self.fail("unexpected text after the query")
        if q.form == "select" and q.variables is None:
            q.variables = list(self.seen)
        return q

    def whole(self) -> int:
        m = self.match(re.compile(r"\d+"))
        if not m:
            self.fail("expected a whole number")
        return int(m[0])

    def triples(self, close: str) -> list[tuple]:
        """Triples up to a part of another kind."""
        outer, self.here = self.here, Formula()
        while True:
            self.skip()
            if self.at >= len(self.text) or self.peek(close) or self.peek("{") or self._special():
                break
            before = self.at
            subject = self.node()
            if subject is None:
                self.fail("expected a pattern")
            self.properties(subject)
            if not self.take(".") and self.at == before:
                self.fail("expected '.'")
        out, self.here = self.here.statements, outer
        return out

    def _special(self) -> bool:
        start = self.at
        for w in ("OPTIONAL", "FILTER", "GRAPH", "UNION"):
            if self.keyword(w):
                self.at = start
                return True
        return False

    def group(self) -> Group:
        if not self.take("{"):
            self.fail("expected '{'")
        g = Group()
        while not self.take("}"):
            if self.at >= len(self.text):
                self.fail("expected '}'")
            if self.keyword("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.keyword("FILTER"):
                g.filters.append(self.constraint())
            elif self.keyword("GRAPH"):
                name = self.node()
                if name is None:
                    self.fail("expected a graph")
                g.parts.append(("graph", name, self.group()))
            elif self.peek("{"):
                options = [self.group()]
                while self.keyword("UNION"):
                    options.append(self.group())
                g.parts.append(("union", options))
            else:
                found = self.triples("}")
                if found:
                    g.parts.append(("triples", found))
                elif not self.take("."):
                    self.fail("expected a pattern")
            self.take(".")
        return g

    # expressions

    def constraint(self):
        return self.bracketed() if self.peek("(") else self.primary()

    def bracketed(self):
        if not self.take("("):
            self.fail("expected '('")
        e = self.expression()
        if not self.take(")"):
            self.fail("expected ')'")
        return e

    def expression(self):
        e = self.conjunction()
        while self.take("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.relation()
        while self.take("&&"):
            e = ("and", e, self.relation())
        return e

    def relation(self):
        e = self.sum()
        for op in ("!=", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                return (op, e, self.sum())
        return e

    def sum(self):
        e = self.product()
        while True:
            if self.take("+"):
                e = ("+", e, self.product())
            elif self.take("-"):
                e = ("-", e, self.product())
            else:
                return e

    def product(self):
        e = self.unary()
        while True:
            if self.take("*"):
                e = ("*", e, self.unary())
            elif self.take("/"):
                e = ("/", e, self.unary())
            else:
                return e

    def unary(self):
        if self.peek("!") and not self.peek("!="):
            self.take("!")
            return ("not", self.unary())
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("+"):
            return self.unary()
        return self.primary()

    def primary(self):
        if self.peek("("):
            return self.bracketed()
        start = self.at
        m = self.match(_WORDS)
        if m and self.text[self.at : self.at + 1] != ":" and self.peek("("):
            return ("call", m[0].upper(), self.arguments())
        self.at = start
        term = self.node()
        if term is None:
            self.fail("expected an expression")
        if isinstance(term, str) and term.startswith("<") and self.peek("("):
            return ("function", term, self.arguments())
        return ("term", term)

    def arguments(self) -> list:
        self.take("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out


def parse(text: str, base: str = "") -> Query:
    return SparqlParser(text, base).query()


# --- evaluation ------------------------------------------------------------------------------------------------------


class Evaluator:
    def __init__(self, ds: Dataset, graph: str = ""):
        self.ds, self.graph = ds, graph

    def matcher(self) -> Matcher:
        return Matcher(self.ds, self.graph, builtins=False)

    def group(self, g: Group, filters: bool = True) -> Bindings:
        state: Bindings | None = None
        m = self.matcher()
        for part in g.parts:
            kind = part[0]
            if kind == "triples":
                body = [tuple(_variable(t) for t in st) for st in part[1]]
                found = m.solve(body)
                state = found if state is None else m.join(state, found)
            elif kind == "optional":
                inner = part[1]
                right = self.group(inner, filters=False)
                test = None
                if inner.filters:
                    test = lambda vals, fs=inner.filters: _all([self.truth(f, vals, frozenset()) for f in fs])
                if state is None:
                    state = one_row(self.ds)
                state = m.left_join(state, right, test)
            elif kind == "union":
                found = union([self.group(x) for x in part[1]]) if len(part[1]) > 1 else self.group(part[1][0])
                state = found if state is None else m.join(state, found)
            else:
                name = _variable(part[1])
                inner = Evaluator(self.ds, name)
                found = inner.group(part[2])
                if name.startswith("?"):
                    found = found.where(found.vals[name].key() != "") if name in found.vals else found
                state = found if state is None else m.join(state, found)
        state = state or one_row(self.ds)
        if filters:
            for f in g.filters:
                state = state.where(F.coalesce(self.truth(f, state.vals, state.maybe), F.lit(False)))
        return state

    # expressions

    def truth(self, e, vals: dict[str, Val], maybe: frozenset[str]) -> Column:
        """Boolean column; null is a type error."""
        kind = e[0]
        if kind == "or":
            return self.truth(e[1], vals, maybe) | self.truth(e[2], vals, maybe)
        if kind == "and":
            return self.truth(e[1], vals, maybe) & self.truth(e[2], vals, maybe)
        if kind == "not":
            return ~self.truth(e[1], vals, maybe)
        if kind in _OPS:
            a, b = self.value(e[1], vals, maybe), self.value(e[2], vals, maybe)
            if kind in ("=", "!="):
                c = values.equals(_as_bool(a), _as_bool(b))
                return c if kind == "=" else ~c
            return {"<": values.less, ">": values.greater, "<=": values.at_most, ">=": values.at_least}[kind](a, b)
        if kind == "call":
            done = self.test_call(e[1], e[2], vals, maybe)
            if done is not None:
                return done
        return values.ebv(self.value(e, vals, maybe))

    def test_call(self, name: str, args: list, vals: dict[str, Val], maybe: frozenset[str]) -> Column | None:
        if name == "BOUND":
            v = vals.get(args[0][1])
            return F.lit(False) if v is None else v.key().isNotNull()
        if name == "REGEX":
            text, pattern = self.value(args[0], vals, maybe), self.value(args[1], vals, maybe)
            p = pattern.lex()
            if len(args) > 2:
                flags = self.value(args[2], vals, maybe).lex()
                p = F.concat(F.lit("(?"), flags, F.lit(")"), p)
            return F.regexp_like(text.lex(), p)
        tests = {"ISURI": "iri", "ISIRI": "iri", "ISBLANK": "bnode", "ISLITERAL": "literal"}
        if name in tests:
            return terms.kind_of(self.value(args[0], vals, maybe).key()) == tests[name]
        return None

    def value(self, e, vals: dict[str, Val], maybe: frozenset[str]) -> Val:
        kind = e[0]
        if kind == "term":
            t = e[1]
            if t.startswith("?"):
                return vals.get(t, Val("key", null()))
            return _plain(t)
        if kind in ("+", "-", "*", "/"):
            a, b = self.value(e[1], vals, maybe), self.value(e[2], vals, maybe)
            f = {"+": maths.total, "-": maths.difference, "*": maths.product, "/": maths.quotient}[kind]
            return f(Val.list_of([_number(a), _number(b)])).val()
        if kind == "neg":
            return maths.negation(_number(self.value(e[1], vals, maybe))).val()
        if kind == "call":
            return self.call(e[1], e[2], vals, maybe)
        if kind == "function":
            v = self.value(e[2][0], vals, maybe)
            uri = e[1][1:-1]
            if uri in _CASTS:
                n = v.num()
                if uri == N.INTEGER:
                    i = F.coalesce(n.i, n.d.try_cast("bigint").cast("decimal(38,0)"))
                    return Num(0, i.cast("double"), i.cast("decimal(38,18)"), i).val()
                return Num(1, n.d, n.d.cast("decimal(38,18)")).val() if uri == N.DECIMAL else Num(2, n.d).val()
            if uri == N.XSD + "string":
                return Val.text(F.coalesce(v.lex(), terms.lex_of(v.key())))
            if uri == N.BOOLEAN:
                return Val("bool", values.ebv(v))
            b = lookup(e[1])
            if b is not None and b.forward:
                args = [self.value(a, vals, maybe) for a in e[2]]
                return b.forward(args[0] if len(args) == 1 else Val.list_of(args))
            raise ValueError(f"unknown function {e[1]}")
        return Val("bool", self.truth(e, vals, maybe))

    def call(self, name: str, args: list, vals: dict[str, Val], maybe: frozenset[str]) -> Val:
        test = self.test_call(name, args, vals, maybe)
        if test is not None:
            return Val("bool", test)
        v = self.value(args[0], vals, maybe)
        if name == "STR":
            return Val.text(F.coalesce(v.lex(), terms.lex_of(v.key())))
        if name == "LANG":
            return Val.text(terms.lang_of(v.key()))
        if name == "DATATYPE":
            k = v.key()
            dt = terms.datatype_of(k)
            shown = F.when(dt != "", dt).when(terms.lang_of(k) == "", N.XSD + "string")
            return Val("key", terms.iri_key(shown))
        raise ValueError(f"unknown function {name}")


def _plain(key: str) -> Val:
    """A constant, native where its type allows."""
    if terms.kind(key) == "literal":
        lex, dt, lang = terms.parts(key)
        if dt is None and lang is None:
            return Val("string", F.lit(lex))
        if dt == N.INTEGER:
            return Val("int", F.lit(int(lex)))
        if dt in N.FLOAT_FAMILY:
            return Val("double", F.lit(float(lex)))
        if dt == N.BOOLEAN:
            return Val("bool", F.lit(lex in ("true", "1")))
    return Val.constant(key)


def _as_bool(v: Val) -> Val:
    return v


def _number(v: Val) -> Val:
    """Numbers only: text that looks like a number is a type error here."""
    if v.kind == "string":
        return Val("key", null())
    if v.kind == "key" and v.const is None:
        numeric = terms.datatype_of(v.col).isin(*N.INTEGER_FAMILY, N.DECIMAL, *N.FLOAT_FAMILY)
        return Val("key", F.when(numeric, v.col))
    return v


def _variable(t):
    """Blank nodes in patterns are variables."""
    if isinstance(t, str):
        return "?" + t[1:] if t.startswith("_:") else t
    return type(t)(tuple(_variable(x) for x in t.items))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _sources(ds: Dataset, q: Query) -> Dataset:
    """FROM and FROM NAMED: the default graph is the merge of the former, the named graphs are the latter (graphs of the data set, or documents)."""
    if not q.sources and not q.named:
        return ds
    from quadrille.sources.documents import load

    def graph(key: str, name: str) -> DataFrame:
        own = ds.quads.where(F.col("g") == key)
        if own.isEmpty():
            own = Dataset.of(ds.spark, load(key[1:-1])).quads.where("g = ''")
        return own.withColumn("g", F.lit(name))

    frames = [graph(key, "") for key in q.sources]
    frames += [graph(key, key) for key in q.named] if q.named else [ds.quads.where("g != ''")]
    out = ds.replace(union_all(frames).distinct())
    out.tables, out.predicates = {}, {}
    return out


def solutions(ds: Dataset, q: Query) -> Bindings:
    return Evaluator(_sources(ds, q)).group(q.where)


def select(ds: Dataset, text: str | Query, native: bool = True) -> DataFrame:
    """Solutions of a SELECT, one column for each variable; one boolean row for ASK.

    Columns hold native values where the data set knows their type, else term
    keys; with ``native=False`` always term keys.
    """
    q = parse(text) if isinstance(text, str) else text
    if q.form == "ask":
        found = solutions(ds, q).df.limit(1)
        return found.agg((F.count("*") > 0).alias("ask"))
    if q.form != "select":
        raise ValueError("not a SELECT or ASK query")
    b = solutions(ds, q)
    names = {v[1:]: v for v in q.variables}
    if not q.order and q.limit is None and q.offset is None:
        return outputs(b, names, native).distinct()
    keys = []
    ev = Evaluator(ds)
    for i, (e, down) in enumerate(q.order):
        v = ev.value(e, b.vals, b.maybe)
        parts = [v.col] if v.kind in ("string", "int", "double", "decimal", "time", "bool", "row") else [v.num().d, v.key()]
        for c in parts:
            keys.append((_name(), c, down))
    shown = outputs(Bindings(b.df, b.vals, b.maybe), names, native)
    rows = b.df.select(*[c.alias(n) for n, c, _ in keys], *_select_columns(b, names, native))
    firsts = [F.max(n).alias(n) if down else F.min(n).alias(n) for n, _, down in keys]
    rows = rows.groupBy(*shown.columns).agg(*firsts) if firsts else rows.distinct()
    order = [F.col(n).desc() if down else F.col(n).asc() for n, _, down in keys] + [F.col(c) for c in shown.columns]
    out = rows.orderBy(*order)
    if q.offset:
        out = out.offset(q.offset)
    if q.limit is not None:
        out = out.limit(q.limit)
    return out.select(*shown.columns)


def _select_columns(b: Bindings, names: dict[str, str], native: bool) -> list[Column]:
    out = []
    for name, var in names.items():
        v = b.vals.get(var)
        if v is None:
            out.append(F.lit(None).cast("string").alias(name))
        elif native and v.const is None and v.kind != "list":
            out.append(v.col.alias(name))
        else:
            out.append(v.key().alias(name))
    return out


def construct(ds: Dataset, text: str | Query) -> DataFrame:
    """Quads of a CONSTRUCT's template, or the statements about a DESCRIBE's resources."""
    q = parse(text) if isinstance(text, str) else text
    if q.form == "construct":
        b = solutions(ds, q)
        body = [tuple(_variable(t) for t in st) for p in q.where.parts if p[0] == "triples" for st in p[1]]
        rule = Rule(body, q.template)
        rule.used = {v for st in q.template.statements for t in st if isinstance(t, str) and t.startswith("?") for v in [t]} & set(b.vals)
        return conclusions(rule, b).distinct()
    if q.form == "describe":
        fixed = [r for r in q.resources if not r.startswith("?")]
        wanted = ds.spark.createDataFrame([(r,) for r in fixed], "s string")
        if q.where.parts:
            b = solutions(ds, q)
            for v in [r for r in q.resources if r.startswith("?")] or [x for x in b.vals if not x.startswith("?:")]:
                wanted = wanted.unionByName(b.df.select(b.vals[v].key().alias("s")))
        return ds.quads.where("g = ''").join(wanted.where("s is not null").distinct(), "s", "left_semi").select("g", "s", "p", "o").distinct()
    raise ValueError("not a CONSTRUCT or DESCRIBE query")


def run(ds: Dataset, text: str) -> DataFrame:
    """Any query: quads for CONSTRUCT and DESCRIBE, solutions for SELECT, one row for ASK."""
    q = parse(text)
    return construct(ds, q) if q.form in ("construct", "describe") else select(ds, q)
