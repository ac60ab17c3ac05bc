"""If/then rules: one pass, and to a fixpoint.

The fixpoint is semi-naive: a round evaluates each rule once for every body
pattern that last round's facts can match, with that pattern reading only those
facts. New facts are kept apart from the old by an anti join and written to the
shared folder, which cuts the plan and survives lost executors. Rules that no
other rule waits for run first; a rule that closes a predicate whose facts never
fork (forests, chains, rings) is evaluated by doubling paths instead.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille import terms
from quadrille.functions.registry import lookup
from quadrille.operators.paths import all_next
from quadrille.plans.data import QUADS, Dataset, union_all
from quadrille.plans.formula import Formula, ListTerm, SetTerm, bnodes, key_of, substitute, variables
from quadrille.plans.match import DRIVER, NOT_INCLUDES, NOT_INCLUDES_BUILTINS, SCOPED, Bindings, Matcher, body_of
from quadrille.storage import materialize, remove, written

MAX_ROUNDS = 1000
#: Most rules that one rule with a rule in its head may make in a round.
MAX_META = 1000
#: Rounds after which the parts of the facts are rewritten as one table.
COMPACT = 8


@dataclass
class Rule:
    body: list[tuple]
    head: Formula
    name: str = ""
    used: set[str] = field(default_factory=set)

    def __post_init__(self):
        inner = {v for t in self.statements() for x in t for v in variables(x)}
        self.used = inner & ({v for st in self.body for t in st for v in variables(t)})
        if not self.name:
            text = repr([[_text(t) for t in st] for st in self.body + self.head.statements])
            self.name = "r" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:12]

    def statements(self) -> list[tuple]:
        return self.head.statements


def _text(term) -> str:
    return key_of(term)


def rules_of(f: Formula, _seen: frozenset[int] = frozenset()) -> list[Rule]:
    """Rules stated in a formula, and in graphs that it calls true."""
    out = []
    for s, p, o in f.statements:
        if p == N.IMPLIES and isinstance(s, (Formula, str)) and isinstance(o, Formula):
            if isinstance(s, Formula):
                out.append(Rule(body_of(s), o))
            elif s == terms.value(True):
                out.append(Rule([], o))
        elif p == N.TYPE and o == N.TRUTH and isinstance(s, Formula) and id(s) not in _seen:
            out += rules_of(s, _seen | {id(s)})
    return out


def ql_rules(f: Formula) -> list[Rule]:
    """Rules of ql:select / ql:where pairs on one subject."""
    where = {s: o for s, _, o in f.each(p=f"<{N.QL}where>")}
    return [Rule(body_of(where[s]), o) for s, _, o in f.each(p=f"<{N.QL}select>") if s in where]


# --- heads -----------------------------------------------------------------------------------------------------------


def _split_head(rule: Rule) -> tuple[list[tuple], list[tuple]]:
    """(plain statements, statements that are rules)."""
    plain, meta = [], []
    for st in rule.head.statements:
        is_rule = st[1] == N.IMPLIES and isinstance(st[0], Formula) and isinstance(st[2], Formula)
        (meta if is_rule else plain).append(st)
    return plain, meta


class _Head:
    """Head terms as columns over a rule's solutions."""

    def __init__(self, rule: Rule, b: Bindings):
        self.rule, self.b = rule, b
        names = sorted(v for v in rule.used if v in b.vals)
        self.ident = [F.coalesce(b.vals[v].key(), F.lit("")) for v in names]
        self.inner: list[tuple[Column, Formula, dict[str, Column]]] = []

    def skolem(self, label: str) -> Column:
        return F.concat(F.lit("_:s"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(self.rule.name), F.lit(label), *self.ident), 256), 1, 24))

    def key(self, term, local: dict[str, Column] | None = None) -> Column:
        if isinstance(term, str):
            if local and term in local:
                return local[term]
            if term.startswith("?"):
                return self.b.vals[term].key() if term in self.b.vals else F.lit(term)
            return self.skolem(term) if term.startswith("_:") else F.lit(term)
        if isinstance(term, ListTerm):
            return terms.list_key(F.array(*[self.key(t, local) for t in term.items])) if term.items else F.lit("[]")
        if isinstance(term, SetTerm):
            return terms.set_key(F.array(*[self.key(t, local) for t in term.items]))
        # a quoted graph: blank nodes inside are its own
        own = {x: F.lit(x) for x in bnodes(term)}
        bound = variables(term) & set(self.b.vals)
        ident = F.lit(term.key()) if not bound else terms.formula_key(
            F.substring(F.sha2(F.concat_ws("\u0001", F.lit(term.key()), *[self.b.vals[v].key() for v in sorted(bound)]), 256), 1, 32)
        )
        self.inner.append((ident, term, own))
        return ident

    def quads(self, statements: list[tuple], graph: Column) -> list[Column]:
        out = []
        todo = [(graph, statements, None)]
        while todo:
            g, sts, local = todo.pop()
            for s, p, o in sts:
                out.append(F.struct(g.alias("g"), self.key(s, local).alias("s"), self.key(p, local).alias("p"), self.key(o, local).alias("o")))
            todo += [(ident, f.statements, own) for ident, f, own in self.inner]
            self.inner = []
        return out


def conclusions(rule: Rule, b: Bindings, graph: str = "") -> DataFrame | None:
    """Quads of a rule's head, one pass over its solutions; None if it has only rules."""
    plain, _ = _split_head(rule)
    if not plain:
        return None
    cells = _Head(rule, b).quads(plain, F.lit(graph))
    rows = b.df.select(F.explode(F.array(*cells)).alias("q")).select("q.*")
    return rows.where("s is not null and p is not null and o is not null")


def made_rules(rule: Rule, b: Bindings) -> list[Rule]:
    """Rules that a rule's head states, for each distinct binding of their variables."""
    _, meta = _split_head(rule)
    out = []
    for s, _, o in meta:
        names = sorted(v for v in variables(s) | variables(o) if v in b.vals)
        if not names:
            found = [{}] if not b.df.isEmpty() else []
        else:
            rows = b.df.select(*[b.vals[v].key().alias(f"v{i}") for i, v in enumerate(names)]).distinct().limit(MAX_META + 1).collect()
            if len(rows) > MAX_META:
                raise ValueError(f"a rule makes over {MAX_META} rules")
            found = [dict(zip(names, r, strict=True)) for r in rows]
        out += [Rule(body_of(substitute(s, m)), substitute(o, m)) for m in found]
    return out


# --- one pass --------------------------------------------------------------------------------------------------------


def apply_once(ds: Dataset, rules: list[Rule], graph: str = "") -> DataFrame:
    """Conclusions of one simultaneous pass over the data, without repeats."""
    parts = []
    for r in rules:
        b = Matcher(ds, graph).solve(r.body, needed=r.used)
        c = conclusions(r, b)
        if c is not None:
            parts.append(c)
    if not parts:
        return ds.spark.createDataFrame([], QUADS)
    return union_all(parts).distinct()


def apply_rules(ds: Dataset, rules: list[Rule]) -> Dataset:
    """The data and the conclusions of one pass."""
    return ds.replace(ds.quads.unionByName(apply_once(ds, rules)).distinct())


def filter_rules(ds: Dataset, rules: list[Rule]) -> Dataset:
    """The conclusions of one pass instead of the data."""
    return ds.replace(apply_once(ds, rules))


# --- strata ----------------------------------------------------------------------------------------------------------


def _is_plain(p) -> bool:
    return not (isinstance(p, str) and (lookup(p) is not None or p in SCOPED or p in DRIVER))


def reads(rule: Rule) -> tuple[set, set]:
    """(predicates read, predicates read under negation); None among them stands for any."""
    positive, negative = set(), set()
    for s, p, o in rule.body:
        if p in (NOT_INCLUDES, NOT_INCLUDES_BUILTINS):
            if isinstance(s, str) and s.startswith("?") and isinstance(o, Formula):
                negative |= {None if isinstance(x[1], str) and x[1].startswith("?") else x[1] for x in o.statements}
        elif p in SCOPED:
            if isinstance(s, str) and s.startswith("?") and isinstance(o, Formula):
                positive |= {None if isinstance(x[1], str) and x[1].startswith("?") else x[1] for x in o.statements}
        elif _is_plain(p):
            positive.add(None if isinstance(p, str) and p.startswith("?") else p)
    return positive, negative


def writes(rule: Rule) -> set:
    plain, meta = _split_head(rule)
    return {None if not isinstance(p, str) or p.startswith("?") else p for _, p, _ in plain} | ({None} if meta else set())


def _meet(a: set, b: set) -> bool:
    return bool(a and b and (None in a or None in b or a & b))


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in layers such that what a rule negates is complete before its layer."""
    n = len(rules)
    level = [0] * n
    about = [(reads(r), writes(r)) for r in rules]
    for _ in range(n + 1):
        changed = False
        for i in range(n):
            for j in range(n):
                (positive, negative), _ = about[i]
                least = level[j] + 1 if _meet(negative, about[j][1]) else level[j] if _meet(positive, about[j][1]) else 0
                if least > level[i]:
                    level[i], changed = least, True
        if not changed:
            return [[r for r, k in zip(rules, level, strict=True) if k == x] for x in sorted(set(level))]
        if max(level) > n:
            break
    raise ValueError("a rule depends on its own negation")


def _in_order(layer: list[Rule]) -> list[list[Rule]]:
    """Rules of a layer in groups: none reads what a later group writes. A rule that reads what it writes is alone, or in the last group with all that wait for each other."""
    about = {id(r): (reads(r)[0], writes(r)) for r in layer}
    waits = lambda r, x: _meet(about[id(r)][0], about[id(x)][1])
    groups, rest = [], list(layer)
    while rest:
        first = [r for r in rest if not any(x is not r and waits(r, x) for x in rest)]
        if not first:
            return [*groups, rest]
        plain = [r for r in first if not waits(r, r)]
        groups += ([plain] if plain else []) + [[r] for r in first if waits(r, r)]
        done = {id(r) for r in first}
        rest = [r for r in rest if id(r) not in done]
    return groups


def _can_order(rules: list[Rule]) -> bool:
    """No rule makes rules or looks at a store as a whole."""
    return all(not _split_head(r)[1] and all(_is_plain(p) or lookup(p) is not None for _, p, _ in r.body) for r in rules)


# --- fixpoint --------------------------------------------------------------------------------------------------------


class Facts:
    """Quads in parts, written one by one and rewritten as one now and then."""

    def __init__(self, quads: DataFrame):
        self.parts = [quads]

    def all(self) -> DataFrame:
        return union_all(self.parts)

    def add(self, new: DataFrame) -> None:
        self.parts.append(new)
        if len(self.parts) > COMPACT:
            self.parts = [materialize(self.all(), "facts")]


def _new(found: list[DataFrame], known: DataFrame, heads: set) -> DataFrame:
    """What is not known yet; only facts of the predicates that rules write are read for it."""
    rows = union_all(found).distinct()
    if None not in heads:
        known = known.where(F.col("p").isin(*sorted(heads)))
    return materialize(rows.join(known, ["g", "s", "p", "o"], "left_anti"), "derived")


def _predicates(delta: DataFrame, limit: int = 1000) -> set | None:
    """Predicates of new facts (none: there are no new facts); None if there are too many to tell apart."""
    rows = delta.select("p").distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else {r["p"] for r in rows}


def _closes(layer: list[Rule]) -> tuple[str, str] | None:
    """(p, e) if the layer is one rule { ?x p ?y. ?y e ?z } => { ?x p ?z } or { ?x e ?y. ?y p ?z } => { ?x p ?z }; e may be p."""
    if len(layer) != 1 or len(layer[0].body) != 2 or len(layer[0].head.statements) != 1:
        return None
    ((x, p, z),) = layer[0].head.statements
    for (a, p1, b), (c, p2, d) in (layer[0].body, reversed(layer[0].body)):
        names = (x, b, z)
        if not all(isinstance(t, str) for t in (a, p1, b, c, p2, d, x, p, z)) or len(set(names)) < 3 or not all(t.startswith("?") for t in names):
            continue
        if (a, b, d) == (x, c, z) and p in (p1, p2) and all(q.startswith("<") and _is_plain(q) for q in (p1, p2)):
            return p, p2 if p == p1 else p1
    return None


def _closed(ds: Dataset, layer: list[Rule], facts: Facts, graph: str) -> bool:
    """Adds what a rule that closes a predicate concludes, if no fact has two next ones (or none has two before it) and no path is very long."""
    link = _closes(layer)
    if link is None or graph.startswith("?") or any(ds.table_of(q) for q in link):
        return False
    p, e = link
    known = facts.all()  # without repeats
    pairs = lambda q: known.where((F.col("g") == graph) & (F.col("p") == q)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    links, path = written(pairs(p), "links")
    try:
        n, starts, ends = links.agg(F.count("*"), F.count_distinct("a"), F.count_distinct("b")).first()
        if n not in (starts, ends):
            return False
        # the steps must be the facts to begin with: then the closure holds nothing that the rule does not conclude
        if e != p and (pairs(e).count() != n or not pairs(e).join(links, ["a", "b"], "left_anti").isEmpty()):
            return False
        ahead = n == starts
        found = all_next(links if ahead else links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    finally:
        remove(ds.spark, path)
    if found is None:
        return False
    # the nearest of a path is the fact it began with
    rows = found.select("a", F.explode(F.slice("path", 2, F.size("path"))).alias("b"))
    s, o = ("a", "b") if ahead else ("b", "a")
    facts.add(rows.select(F.lit(graph).alias("g"), F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o")))
    return True


def think(ds: Dataset, rules: list[Rule], max_rounds: int = MAX_ROUNDS, graph: str = "", since: DataFrame | None = None) -> Dataset:
    """All facts that follow, with the data. Rules that a head states take part.

    With ``since``, the facts other than these are closed under the rules
    already, so the first round too evaluates only what these can fire; rules
    that look at the store as a whole are evaluated whole.
    """
    facts = Facts(materialize(ds.quads.distinct(), "facts"))
    known = {r.name for r in rules}
    now = ds.replace(facts.all())
    fresh_facts = None if since is None else [materialize(since.select("g", "s", "p", "o").distinct(), "since")]
    layers = strata(rules)
    if since is None and _can_order(rules):
        layers = [group for layer in layers for group in _in_order(layer)]
    while layers:
        layer = layers.pop(0)
        if fresh_facts is None and _closed(ds, layer, facts, graph):
            now = _renewed(ds, now, facts)
            continue
        made: list[Rule] = []
        rounds = 0
        if fresh_facts is None:
            found = [x for r in layer for x in _whole(now, r, made, known, graph)]
        else:
            new = union_all(fresh_facts)
            changed = _predicates(new)
            found = []
            for r in layer:
                whole = not all(_is_plain(p) or lookup(p) is not None for _, p, _ in r.body)
                found += _whole(now, r, made, known, graph) if whole else _with_delta(now, r, new, changed, made, known, graph)
        delta, changed = _keep(found, facts, layer)
        while delta is not None or made:
            if delta is not None and fresh_facts is not None:
                fresh_facts.append(delta)
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"rules did not settle in {max_rounds} rounds")
            fresh, made = made, []
            layer = layer + fresh
            found = []
            now = _renewed(ds, now, facts)
            if delta is not None:
                for r in layer:
                    found += _with_delta(now, r, delta, changed, made, known, graph)
            for r in fresh:
                found += _whole(now, r, made, known, graph)
            delta, changed = _keep(found, facts, layer)
        now = _renewed(ds, now, facts)
    return now


def _renewed(ds: Dataset, now: Dataset, facts: Facts) -> Dataset:
    """The data set over the facts so far; graphs registered meanwhile stay."""
    out = ds.replace(facts.all())
    out.formulas = now.formulas
    return out


def _whole(now: Dataset, r: Rule, made: list[Rule], known: set[str], graph: str) -> list[DataFrame]:
    b = Matcher(now, graph).solve(r.body, needed=r.used)
    return _heads(r, b, made, known, graph)


def _heads(r: Rule, b: Bindings, made: list[Rule], known: set[str], graph: str) -> list[DataFrame]:
    for x in made_rules(r, b):
        if x.name not in known:
            known.add(x.name)
            made.append(x)
    c = conclusions(r, b, graph)
    return [c] if c is not None else []


def _with_delta(now: Dataset, r: Rule, delta: DataFrame, changed: set | None, made: list[Rule], known: set[str], graph: str) -> list[DataFrame]:
    found = []
    for i, (_, p, _) in enumerate(r.body):
        if not _is_plain(p) or now.table_of(p):
            continue
        if isinstance(p, str) and not p.startswith("?") and changed is not None and p not in changed:
            continue
        b = Matcher(now, graph).solve(r.body, needed=r.used, delta=delta, delta_at=i)
        found += _heads(r, b, made, known, graph)
    return found


def _keep(found: list[DataFrame], facts: Facts, layer: list[Rule]) -> tuple[DataFrame | None, set | None]:
    """New facts and their predicates, now among the facts; no facts if there are none."""
    if not found:
        return None, set()
    delta = _new(found, facts.all(), set().union(*(writes(r) for r in layer)))
    changed = _predicates(delta)
    if changed == set():
        return None, changed
    facts.add(delta)
    return delta, changed


# --- provenance ------------------------------------------------------------------------------------------------------


def _triple(head: _Head, st: tuple) -> Column:
    return F.concat_ws(" ", *[head.key(t) for t in st])


def explained(ds: Dataset, rules: list[Rule]) -> DataFrame:
    """One pass with reasons: s, p, o, rule, evidence (the facts used, as texts), checks (built-ins used)."""
    frames = []
    for r in rules:
        plain, _ = _split_head(r)
        if not plain:
            continue
        b = Matcher(ds).solve(r.body)
        head = _Head(r, b)
        cells = head.quads(plain, F.lit(""))
        evidence = [_triple(head, st) for st in r.body if _is_plain(st[1])]
        checks = [_triple(head, st) for st in r.body if not _is_plain(st[1])]
        rows = b.df.select(
            F.explode(F.array(*cells)).alias("q"),
            F.lit(r.name).alias("rule"),
            F.array(*evidence).cast("array<string>").alias("evidence"),
            F.array(*checks).cast("array<string>").alias("checks"),
        )
        frames.append(rows.select("q.s", "q.p", "q.o", "rule", "evidence", "checks").where("s is not null and p is not null and o is not null"))
    return union_all(frames).distinct()


def check_evidence(ds: Dataset, reasons: DataFrame) -> DataFrame:
    """Derived rows whose evidence is not all among the facts (given or derived)."""
    facts = ds.quads.where("g = ''").select(F.concat_ws(" ", "s", "p", "o").alias("fact"))
    facts = facts.unionByName(reasons.select(F.concat_ws(" ", "s", "p", "o").alias("fact"))).distinct()
    each = reasons.select("s", "p", "o", "rule", F.explode("evidence").alias("fact"))
    return each.join(facts, "fact", "left_anti")
