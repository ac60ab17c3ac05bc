"""Graph patterns and built-ins to DataFrames.

A body is a list of (subject, predicate, object) statements. The planner places
each built-in as soon as its inputs are bound, collapses patterns about one row
of a table into one scan, joins connected patterns first, joins what binds
nothing needed later as a semi join, and leaves physical choices to Catalyst.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille import terms
from quadrille.functions.registry import Builtin, lookup
from quadrille.plans.data import Dataset, Table
from quadrille.plans.formula import Formula, ListTerm, SetTerm, key_of, substitute, variables
from quadrille.plans.values import Val, same

INCLUDES = f"<{N.LOG}includes>"
NOT_INCLUDES = f"<{N.LOG}notIncludes>"
UNIQUE_BINDING = f"<{N.LOG}enforceUniqueBinding>"
NOT_INCLUDES_BUILTINS = f"<{N.LOG}notIncludesWithBuiltins>"
SUPPORTS = f"<{N.LOG}supports>"
SCOPED = {INCLUDES, NOT_INCLUDES, NOT_INCLUDES_BUILTINS, SUPPORTS}
#: Most distinct inputs of a built-in that works on whole graphs on the driver.
MAX_GRAPHS = 10_000

_fresh = itertools.count()


class Unbound(ValueError):
    """Statements whose inputs nothing binds."""


@dataclass
class Bindings:
    """Solutions: a DataFrame, and how each variable is read from its columns."""

    df: DataFrame
    vals: dict[str, Val]
    maybe: frozenset[str] = frozenset()

    def with_val(self, var: str, val: Val) -> Bindings:
        df, kept = store(self.df, val)
        return Bindings(df, self.vals | {var: kept}, self.maybe)

    def where(self, condition: Column) -> Bindings:
        return Bindings(self.df.where(condition), self.vals, self.maybe)

    def project(self, wanted: Iterable[str]) -> Bindings:
        """Only some variables, without repeats."""
        vals, columns = {}, []
        for v in sorted(set(wanted) & set(self.vals)):
            kept, cols = _rename(self.vals[v])
            vals[v] = kept
            columns += cols
        if not columns:
            return Bindings(self.df.limit(1).select(F.lit(1).alias(_name())), vals)
        return Bindings(self.df.select(*columns).distinct(), vals, self.maybe & set(vals))


def _name() -> str:
    return f"_c{next(_fresh)}"


def store(df: DataFrame, val: Val) -> tuple[DataFrame, Val]:
    """Give a value columns of its own."""
    if val.kind == "list":
        items = []
        for v in val.items:
            df, kept = store(df, v)
            items.append(kept)
        return df, Val.list_of(items)
    if val.const is not None:
        return df, val
    if val.kind == "num":
        val = Val("key", val.key())
    name = _name()
    return df.withColumn(name, val.col), Val(val.kind, F.col(name), val.table)


def _rename(val: Val) -> tuple[Val, list[Column]]:
    if val.kind == "list":
        parts = [_rename(v) for v in val.items]
        return Val.list_of([v for v, _ in parts]), [c for _, cs in parts for c in cs]
    if val.const is not None:
        return val, []
    name = _name()
    return Val(val.kind, F.col(name), val.table), [val.col.alias(name)]


def one_row(ds: Dataset) -> Bindings:
    # one partition: each of several would start Python workers for the built-ins that follow, all but one for nothing
    return Bindings(ds.spark.range(0, 1, 1, 1).select(F.lit(1).alias(_name())), {})


def open_variables(term) -> set[str]:
    return variables(term)


def _outside(term) -> set[str]:
    """Variables of a term outside of the graphs that it quotes."""
    if isinstance(term, str):
        return {term} if term.startswith("?") else set()
    return set() if isinstance(term, Formula) else {v for t in term.items for v in _outside(t)}


def body_of(f: Formula) -> list[tuple]:
    """Statements of a formula in a rule's body: its blank nodes are variables."""
    names = {a for st in f.statements for t in st for a in _bnodes(t)}
    mapping = {b: "?" + b[1:] for b in names}
    return [tuple(substitute(t, mapping) for t in st) for st in f.statements]


def _bnodes(term) -> set[str]:
    from quadrille.plans.formula import bnodes

    return bnodes(term)


class Matcher:
    """Solves bodies over a data set.

    ``delta`` replaces the quads for one statement (by place), as semi-naive
    evaluation needs. ``graph`` restricts plain patterns to a graph: a key, or a
    variable bound to graphs. ``stored`` also looks up facts that state a
    built-in predicate outright.
    """

    def __init__(self, ds: Dataset, graph: str = "", builtins: bool = True, stored: bool = False):
        self.ds, self.graph, self.builtins, self.stored = ds, graph, builtins, stored
        #: Variables of the body outside of quoted graphs; others belong to the graphs that quote them.
        self.outer: set[str] = set()

    # terms

    def value(self, term, vals: dict[str, Val]) -> Val | None:
        """What a term stands for, or None while a variable in it is unbound."""
        if isinstance(term, str):
            return vals.get(term) if term.startswith("?") else Val.constant(term)
        if isinstance(term, Formula):
            if open_variables(term) & (self.outer | set(vals)):
                return None
            return Val.constant(self.ds.register(term))
        items = [self.value(t, vals) for t in term.items]
        if any(v is None for v in items):
            return None
        if isinstance(term, ListTerm):
            return Val.list_of(items)
        if all(v.const is not None for v in items):
            return Val.constant(terms.make_set([v.const for v in items]))
        return Val("key", terms.set_key(F.array(*[v.key() for v in items])))

    def unify(self, b: Bindings, term, val: Val) -> Bindings:
        """Make a term and a value the same: binds variables, filters the rest."""
        if isinstance(term, str):
            if term.startswith("?") and term not in b.vals:
                b = b.with_val(term, val)
                return b if val.const is not None else b.where(b.vals[term].present())
            return b.where(same(self.value(term, b.vals), val))
        if isinstance(term, ListTerm):
            known = val.elements()
            if known is not None:
                if len(known) != len(term.items):
                    return b.where(F.lit(False))
                parts = known
            else:
                keys = _name()
                b = Bindings(b.df.withColumn(keys, val.element_keys()), b.vals, b.maybe).where(F.size(keys) == len(term.items))
                if val.kind != "array":
                    b = b.where(val.key().startswith("["))
                parts = [Val("key", F.get(F.col(keys), F.lit(i))) for i in range(len(term.items))]
            for t, v in zip(term.items, parts, strict=True):
                b = self.unify(b, t, v)
            return b
        if isinstance(term, SetTerm):
            known = self.value(term, b.vals)
            if known is not None:
                return b.where(same(known, val))
            n = len(term.items)
            if n > 5:
                raise ValueError("a set pattern has at most 5 members")
            keys, order = _name(), _name()
            df = b.df.withColumn(keys, val.element_keys()).where((F.size(keys) == n) & val.key().startswith("$"))
            orders = F.array(*[F.array(*[F.lit(i) for i in p]) for p in itertools.permutations(range(n))])
            b = Bindings(df.withColumn(order, F.explode(orders)), b.vals, b.maybe)
            for k, t in enumerate(term.items):
                b = self.unify(b, t, Val("key", F.get(F.col(keys), F.get(F.col(order), F.lit(k)))))
            return b
        if self.value(term, b.vals) is not None:
            return b.where(val.key() == self.ds.register(term))
        # a quoted graph with variables: same statements both ways
        g = "?" + _name()
        b = b.with_val(g, Val("key", val.key()))
        b = Matcher(self.ds, g, builtins=False).solve(body_of(term), b)
        sizes = self.ds.quads.groupBy(F.col("g").alias("__g")).agg(F.count_distinct("s", "p", "o").alias("__n"))
        sizes = sizes.where(F.col("__n") == len(term.statements)).select("__g")
        return Bindings(b.df.join(sizes, b.vals[g].key() == F.col("__g"), "left_semi"), b.vals, b.maybe)

    # joins

    def join(self, a: Bindings, b: Bindings, needed: set[str] | None = None, how: str = "inner") -> Bindings:
        shared = sorted(set(a.vals) & set(b.vals))
        new = {v: x for v, x in b.vals.items() if v not in a.vals}
        condition = _all([self._meets(a, b, v) for v in shared])
        if how == "anti":
            if not shared:
                return a.where(F.lit(False)) if not b.df.isEmpty() else a
            return Bindings(a.df.join(b.df, condition, "left_anti"), a.vals, a.maybe)
        if needed is not None and shared and not set(new) & needed and not (a.maybe | b.maybe) & set(shared):
            return Bindings(a.df.join(b.df, condition, "left_semi"), a.vals, a.maybe)
        df = a.df.join(b.df, condition) if shared else a.df.crossJoin(b.df)
        out = Bindings(df, a.vals | new, (a.maybe - set(b.vals)) | (b.maybe - set(a.vals)) | (a.maybe & b.maybe))
        for v in set(shared) & a.maybe:
            out = out.with_val(v, Val("key", F.coalesce(a.vals[v].key(), b.vals[v].key())))
        return out

    @staticmethod
    def _meets(a: Bindings, b: Bindings, v: str) -> Column:
        c = same(a.vals[v], b.vals[v])
        for side in (a, b):
            if v in side.maybe:
                c = c | side.vals[v].key().isNull()
        return c

    def left_join(self, a: Bindings, b: Bindings, condition: Callable[[dict[str, Val]], Column] | None = None) -> Bindings:
        """All of a, with b where it fits."""
        shared = sorted(set(a.vals) & set(b.vals))
        new = {v: x for v, x in b.vals.items() if v not in a.vals}
        on = _all([self._meets(a, b, v) for v in shared])
        if condition is not None:
            on = on & condition(a.vals | new)
        out = Bindings(a.df.join(b.df, on, "left"), a.vals | new, a.maybe | frozenset(new))
        for v in set(shared) & a.maybe:
            out = out.with_val(v, Val("key", F.coalesce(a.vals[v].key(), b.vals[v].key())))
        return out

    # scans

    def scan_quads(self, st: tuple, quads: DataFrame, consts: dict[str, Val]) -> Bindings:
        """Solutions of one pattern over quads; constants are pushed into the scan."""
        df, columns = quads, []
        terms_at = list(zip(("s", "p", "o"), st, strict=True))
        graph_var = self.graph.startswith("?")
        if graph_var:
            terms_at.append(("g", self.graph))
        else:
            df = df.where(F.col("g") == self.graph)
        later = []
        for c, t in terms_at:
            if isinstance(t, str) and t.startswith("?") and t in consts and consts[t].const is not None:
                t = consts[t].const
            if isinstance(t, str) and not t.startswith("?"):
                df = df.where(F.col(c) == t)
                continue
            known = None if isinstance(t, str) else self.value(t, {})
            if known is not None and known.kind != "list":
                df = df.where(F.col(c) == known.key())
            elif known is not None:
                df = df.where(F.col(c) == key_of(t))
            else:
                name = _name()
                columns.append(F.col(c).alias(name))
                later.append((t, name))
        b = Bindings(df.select(*columns) if columns else df.select(F.lit(1).alias(_name())).limit(1), {})
        for t, name in later:
            if isinstance(t, str) and t not in b.vals:
                b = Bindings(b.df, b.vals | {t: Val("key", F.col(name))}, b.maybe)
            else:
                b = self.unify(b, t, Val("key", F.col(name)))
        return b

    def scan_table(self, group: list[tuple], table: Table, consts: dict[str, Val]) -> Bindings:
        """Solutions of patterns about one row of a table: one scan."""
        subject = group[0][0]
        df = table.df
        names: dict[str, str] = {}
        columns = [table.row().alias(row := _name())]
        for _, p, _ in group:
            c = self.ds.predicates[p][1]
            if c not in names:
                names[c] = _name()
                v = table.object(c)
                columns.append(v.col.alias(names[c]))
        df = df.where(_all([F.col(c).isNotNull() for c in names])).select(*columns)
        b = Bindings(df, {})
        row_val = Val("row", F.col(row), table=table.name)
        for t, v in [(subject, row_val), *[(o, self._cell(table, self.ds.predicates[p][1], names)) for _, p, o in group]]:
            if isinstance(t, str) and t.startswith("?") and t in consts and consts[t].const is not None:
                t = consts[t].const
            if isinstance(t, str) and t.startswith("?") and t not in b.vals:
                b = Bindings(b.df, b.vals | {t: v}, b.maybe)
            else:
                b = self.unify(b, t, v)
        return b

    @staticmethod
    def _cell(table: Table, column: str, names: dict[str, str]) -> Val:
        v = table.object(column)
        return Val(v.kind, F.col(names[column]), v.table)

    # bodies

    def solve(self, body: list[tuple], start: Bindings | None = None, needed: set[str] | None = None, delta: DataFrame | None = None, delta_at: int = -1) -> Bindings:
        """Solutions of a body. ``needed`` names the variables that matter afterwards (all, if not given)."""
        self.outer = {v for st in body for t in st for v in _outside(t)}
        state = start or one_row(self.ds)
        fresh_start = start is None
        pending = list(enumerate(body))
        while pending:
            step = self._next(pending, state)
            if step is None:
                left = [st for _, st in pending]
                raise Unbound("nothing binds the inputs of " + "; ".join(" ".join(_shown(t) for t in st) for st in left))
            used, action = step
            pending = [x for x in pending if x[0] not in used]
            after = None
            if needed is not None:
                after = set(needed) | {v for _, st in pending for t in st for v in open_variables(t)}
                if self.graph.startswith("?"):
                    after.add(self.graph)
            found = action(state, delta if delta_at in used else None)
            if isinstance(found, tuple):
                found = found[0]
                state = found if fresh_start and not state.vals else self.join(state, found, after)
            else:
                state = found
            fresh_start = False if state.vals else fresh_start
        return state

    def _next(self, pending: list[tuple[int, tuple]], state: Bindings):
        """(places of the statements done, action) of what to do next."""
        patterns = []
        for i, st in pending:
            s, p, o = st
            b = lookup(p) if self.builtins and isinstance(p, str) else None
            if b is not None and (action := self._builtin(b, s, o, state)):
                if self.stored:
                    action = self._with_stored(action, st)
                return {i}, action
            if b is None and self.builtins and isinstance(p, str) and (action := self._driver(p, s, o, state)):
                return {i}, action
        for i, st in pending:
            p = st[1]
            is_builtin = isinstance(p, str) and self.builtins and (lookup(p) is not None or p in SCOPED or p in DRIVER)
            if not is_builtin:
                patterns.append((i, st))
        if patterns:
            return self._pattern(patterns, state)
        for i, st in pending:
            if st[1] in SCOPED and (action := self._scoped(st, state, [x for x in pending if x[0] != i])):
                return {i}, action
        # a built-in that cannot run may still be stated outright: rdf:first of unfolded lists, say
        for i, st in pending:
            if st[1] not in SCOPED and st[1] not in DRIVER and (not self.builtins or lookup(st[1]) is None or self._may_be_stored(st[1])):
                return {i}, self._quad_action(st, state)
        return None

    @staticmethod
    def _may_be_stored(p: str) -> bool:
        return p.startswith(f"<{N.RDF}") or p == N.SAME_AS

    def _quad_action(self, st: tuple, state: Bindings):
        return lambda b, delta: (self.scan_quads(st, delta if delta is not None else self.ds.quads, b.vals),)

    def _with_stored(self, action, st: tuple):
        def both(b: Bindings, delta):
            computed = action(b, delta)
            looked_up = self.join(b, self.scan_quads(st, self.ds.quads, b.vals))
            return union([computed, looked_up])

        return both

    def _pattern(self, patterns: list[tuple[int, tuple]], state: Bindings):
        """The best pattern, or all patterns about the same row of a table."""
        groups: dict[object, list[tuple[int, tuple]]] = {}
        for i, st in patterns:
            hit = self.ds.table_of(st[1]) if not self.graph else None
            groups.setdefault((hit[0].name, st[0]) if hit else i, []).append((i, st))

        def cost(members: list[tuple[int, tuple]]) -> tuple:
            used = {v for _, st in members for t in st for v in open_variables(t)}
            constants = sum(not open_variables(t) for _, st in members for t in (st[0], st[2]))
            connected = bool(used & set(state.vals)) or not state.vals or not used
            variable_predicate = any(isinstance(st[1], str) and st[1].startswith("?") and st[1] not in state.vals for _, st in members)
            return (not connected, variable_predicate, -constants, members[0][0])

        best = min(groups.values(), key=cost)
        places, group = {i for i, _ in best}, [st for _, st in best]
        hit = self.ds.table_of(group[0][1]) if not self.graph else None
        if hit:
            return places, lambda b, delta: (self.scan_table(group, hit[0], b.vals),)
        return places, self._quad_action(group[0], state)

    def _builtin(self, b: Builtin, s, o, state: Bindings):
        sv, ov = self.value(s, state.vals), self.value(o, state.vals)
        if sv is not None and ov is not None:
            if b.test:
                return lambda x, _: x.where(b.test(sv, ov))
            if b.forward:
                return lambda x, _: x.where(same(b.forward(sv), ov))
            if b.reverse:
                return lambda x, _: x.where(same(b.reverse(ov), sv))
            if b.generate:
                return lambda x, _: x.where(F.array_contains(b.generate(sv), ov.key()))
            if b.generate_back:
                return lambda x, _: x.where(F.array_contains(b.generate_back(ov), sv.key()))
        if sv is not None and b.forward:
            return lambda x, _: self.unify(x, o, b.forward(sv))
        if sv is not None and b.generate:
            return lambda x, _: self._explode(x, o, b.generate(sv))
        if ov is not None and b.reverse:
            return lambda x, _: self.unify(x, s, b.reverse(ov))
        if ov is not None and b.generate_back:
            return lambda x, _: self._explode(x, s, b.generate_back(ov))
        return None

    def _explode(self, b: Bindings, term, keys: Column) -> Bindings:
        name = _name()
        return self.unify(Bindings(b.df.withColumn(name, F.explode(keys)), b.vals, b.maybe), term, Val("key", F.col(name)))

    def _driver(self, p: str, s, o, state: Bindings):
        """Built-ins on whole graphs and documents: run once for each distinct input."""
        call = DRIVER.get(p)
        if call is None:
            return None
        sv, ov = self.value(s, state.vals), self.value(o, state.vals)
        if p == UNIQUE_BINDING:
            return self._unique(sv, ov) if sv is not None and ov is not None else None
        backwards = call.backwards and sv is None and ov is not None
        given, target = (ov, s) if backwards else (sv, o)
        if given is None:
            return None
        run = call.backwards if backwards else call.run

        def action(b: Bindings, _):
            if given.const is not None or (given.kind == "list" and all(v.const is not None for v in given.items)):
                key = given.const or terms.make_list([v.const for v in given.items])
                found = run(self.ds, key)
                if len(found) == 1:
                    return self.unify(b, target, Val.constant(found[0]))
                pairs = [(key, x) for x in found]
            else:
                inputs = b.df.select(given.key().alias("k")).where("k is not null").distinct().limit(MAX_GRAPHS + 1).collect()
                if len(inputs) > MAX_GRAPHS:
                    raise ValueError(f"{p} has over {MAX_GRAPHS} distinct inputs")
                pairs = [(r["k"], x) for r in inputs for x in run(self.ds, r["k"])]
            k, v = _name(), _name()
            table = self.ds.spark.createDataFrame(pairs, f"{k} string, {v} string")
            joined = b.df.join(table, given.key() == F.col(k))
            return self.unify(Bindings(joined, b.vals, b.maybe), target, Val("key", F.col(v)))

        return action

    @staticmethod
    def _unique(graph: Val, name: Val):
        """Of the names bound together with one graph only the least holds; subjects that are no graphs have none."""

        def action(b: Bindings, _):
            k, v, least = _name(), _name(), _name()
            rows = b.df.withColumn(k, graph.key()).withColumn(v, name.key()).where(F.col(k).startswith("{"))
            chosen = rows.groupBy(k).agg(F.min(v).alias(least))
            return Bindings(rows.join(chosen, k).where(F.col(v) == F.col(least)).drop(k, v, least), b.vals, b.maybe)

        return action

    def _scoped(self, st: tuple, state: Bindings, others: list):
        """includes and its negations: joins with another graph, or with the store itself."""
        s, p, o = st
        sv = self.value(s, state.vals)
        graph_var = isinstance(s, str) and s.startswith("?") and s not in state.vals
        if not isinstance(o, Formula):
            ov = self.value(o, state.vals)
            if ov is None or ov.const is None:
                return None
            o = self.ds.formula(ov.const)
        body = body_of(o)
        builtins = p == NOT_INCLUDES_BUILTINS or graph_var

        def action(b: Bindings, _):
            ds, graph = self.ds, self.graph
            if not graph_var:
                if sv is None:
                    raise Unbound("includes needs a graph")
                if sv.const is not None:
                    key = sv.const
                    if p == SUPPORTS:
                        key = DRIVER[f"<{N.LOG}conclusion>"].run(ds, key)[0]
                    ds, graph = ds, key
                else:
                    graph = "?" + _name()
                    b = b.with_val(graph, Val("key", sv.key()))
            inner = Matcher(ds, graph, builtins=builtins)
            mentioned = {v for t in body for x in t for v in open_variables(x)} | ({graph} if graph.startswith("?") else set())
            shared = mentioned & set(b.vals)
            if p in (INCLUDES, SUPPORTS):
                return self.join(b, inner.solve(body)) if not shared else inner.solve(body, b)
            try:
                found = inner.solve(body, needed=shared)
            except Unbound:
                found = inner.solve(body, b.project(shared), needed=shared)
            if not body:
                return b.where(F.lit(False))
            return self.join(b, found, how="anti")

        return action


@dataclass(frozen=True)
class DriverCall:
    run: Callable[[Dataset, str], list[str]]
    backwards: Callable[[Dataset, str], list[str]] | None = None


DRIVER: dict[str, DriverCall] = {}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _shown(t) -> str:
    return t if isinstance(t, str) else "{...}" if isinstance(t, Formula) else "(" + " ".join(map(_shown, t.items)) + ")"


def union(parts: list[Bindings]) -> Bindings:
    """Solutions of any part; variables that a part does not bind are null there."""
    names = sorted({v for b in parts for v in b.vals})
    kinds = {}
    for v in names:
        found = {(b.vals[v].kind, b.vals[v].table) for b in parts if v in b.vals}
        one = next(iter(found))
        kinds[v] = one if len(found) == 1 and one[0] not in ("list", "key") and all(b.vals[v].const is None for b in parts if v in b.vals) else ("key", "")
    columns = {v: _name() for v in names}
    frames = []
    for b in parts:
        cells = []
        for v in names:
            if v not in b.vals:
                cells.append(F.lit(None).alias(columns[v]))
            else:
                cells.append((b.vals[v].key() if kinds[v][0] == "key" else b.vals[v].col).alias(columns[v]))
        frames.append(b.df.select(*(cells or [F.lit(1).alias("_one")])))
    df = reduce(DataFrame.unionByName, frames)
    maybe = {v for v in names if any(v not in b.vals or v in b.maybe for b in parts)}
    return Bindings(df, {v: Val(kinds[v][0], F.col(columns[v]), kinds[v][1]) for v in names}, frozenset(maybe))


def outputs(b: Bindings, select: dict[str, str], native: bool = True) -> DataFrame:
    """A DataFrame of variables: column name -> variable. Native types where known, else term keys."""
    columns = []
    for name, var in select.items():
        v = b.vals.get(var)
        if v is None:
            columns.append(F.lit(None).cast("string").alias(name))
        elif native and v.kind == "list":
            columns.append(v.element_keys().alias(name))
        elif native and v.const is None:
            columns.append(v.col.alias(name))
        else:
            columns.append(v.key().alias(name))
    return b.df.select(*columns)


