"""Value comparison with type errors: the predicates that filters are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille import terms
from quadrille.functions.registry import register
from quadrille.functions.times import instant
from quadrille.plans.values import Val, lexical_number, null

_ORDERED = (N.DATE, N.DATE_TIME)


def ebv(v: Val) -> Column:
    """Effective boolean value; null is a type error."""
    if v.kind == "bool":
        return v.col
    if v.kind == "string":
        return v.col != ""
    if v.kind in ("int", "decimal"):
        return v.col != 0
    if v.kind == "double":
        return (v.col != 0) & ~F.isnan(v.col)
    if v.kind == "num":
        return (v.number.d != 0) & ~F.isnan(v.number.d)
    if v.kind != "key":
        return null("boolean")
    lex, dt = terms.string_of(v.col), terms.datatype_of(v.col)
    n = lexical_number(lex, dt).d
    return (
        F.when(dt == N.BOOLEAN, lex.isin("true", "1"))
        .when(dt.isin("", N.XSD + "string"), lex != "")
        .when(dt.isin(*N.INTEGER_FAMILY, N.DECIMAL, *N.FLOAT_FAMILY), (n != 0) & ~F.isnan(n))
    )


class _Parts:
    """What comparisons look at: class, number, instant, text."""

    def __init__(self, v: Val):
        if v.kind in ("int", "decimal", "double"):
            self.group, self.number, self.moment, self.text = F.lit("n"), v.double(), null("double"), v.lex()
        elif v.kind == "num":
            self.group, self.number, self.moment, self.text = F.when(v.number.rank.isNotNull(), "n"), v.number.d, null("double"), null()
        elif v.kind == "string":
            self.group, self.number, self.moment, self.text = F.lit("s"), null("double"), null("double"), v.col
        elif v.kind == "bool":
            self.group, self.number, self.moment, self.text = F.lit("b"), v.col.cast("double"), null("double"), v.lex()
        elif v.kind == "time":
            self.group, self.number, self.moment, self.text = F.lit("t"), null("double"), F.unix_micros(v.col) / 1e6, v.lex()
        elif v.kind in ("row", "array", "list"):
            self.group, self.number, self.moment, self.text = F.lit("x"), null("double"), null("double"), v.key()
        else:
            k = v.col
            lex, dt, lang = terms.string_of(k), terms.datatype_of(k), terms.lang_of(k)
            num = dt.isin(*N.INTEGER_FAMILY, N.DECIMAL, *N.FLOAT_FAMILY)
            self.group = (
                F.when(~terms.is_literal(k), "x").when(num, "n").when((dt.isin("", N.XSD + "string")) & (lang == ""), "s")
                .when(dt == N.BOOLEAN, "b").when(dt.isin(*_ORDERED), "t").when(lang != "", "l").otherwise("u")
            )
            self.number = F.when(num, lex.try_cast("double")).when(dt == N.BOOLEAN, lex.isin("true", "1").cast("double"))
            self.moment = F.when(dt.isin(*_ORDERED), instant(lex))
            self.text = F.coalesce(lex, k)
        self.key = v.key() if v.kind != "num" else null()


def equals(a: Val, b: Val) -> Column:
    """Value equality; null where the types cannot be compared."""
    if a.kind == b.kind == "string":
        return a.col == b.col
    if {a.kind, b.kind} <= {"int", "decimal", "double"}:
        return a.double() == b.double() if a.kind != b.kind or a.kind == "double" else a.col == b.col
    x, y = _Parts(a), _Parts(b)
    if "num" in (a.kind, b.kind):  # text cannot tell more than the numbers do
        return F.when((x.group == "n") & (y.group == "n"), x.number == y.number).when(x.group.isNotNull() & y.group.isNotNull(), F.lit(False))
    known = F.when(x.key == y.key, True)
    alike = x.group == y.group
    return (
        known.when(alike & x.group.isin("n", "b"), x.number == y.number)
        .when(alike & (x.group == "t"), x.moment == y.moment)
        .when(alike & x.group.isin("s", "x", "l"), F.lit(False))
        .when((x.group == "u") | (y.group == "u"), null("boolean"))
        .when(x.key.isNotNull() & y.key.isNotNull(), F.lit(False))
    )


def _order(op):
    def f(a: Val, b: Val) -> Column:
        if a.kind == b.kind == "string":
            return op(a.col, b.col)
        if {a.kind, b.kind} <= {"int", "decimal", "double"}:
            return op(a.double(), b.double()) if a.kind != b.kind else op(a.col, b.col)
        if a.kind == b.kind == "time":
            return op(a.col, b.col)
        x, y = _Parts(a), _Parts(b)
        alike = x.group == y.group
        return (
            F.when(alike & x.group.isin("n", "b"), op(x.number, y.number))
            .when(alike & (x.group == "t"), op(x.moment, y.moment))
            .when(alike & (x.group == "s"), op(x.text, y.text))
        )

    return f


less = _order(lambda a, b: a < b)
greater = _order(lambda a, b: a > b)
at_most = _order(lambda a, b: a <= b)
at_least = _order(lambda a, b: a >= b)

register("sparql:equals", test=equals)
register("sparql:notEquals", test=lambda a, b: ~equals(a, b))
register("sparql:lessThan", test=less)
register("sparql:greaterThan", test=greater)
register("sparql:notGreaterThan", test=at_most)
register("sparql:notLessThan", test=at_least)
register("sparql:truthValue", test=lambda a, b: ebv(a) == ebv(b))
register("sparql:typeErrorIsTrue", test=lambda a, b: F.coalesce(ebv(a), F.lit(True)) == F.coalesce(ebv(b), F.lit(True)))
register("sparql:typeErrorReturner", forward=lambda s: s)


def _typed(s: Val) -> Val:
    """(lexical form, datatype) as a literal."""
    lex, dt = s.exact(2)
    return Val("key", F.concat(F.lit('"'), lex.lex(), F.lit('"^^'), dt.key()))


def _type_parts(o: Val) -> Val:
    k = o.key()
    dt = terms.datatype_of(k)
    shown = F.when((dt == "") & (terms.lang_of(k) == ""), N.XSD + "string").when(dt != "", dt)
    return Val.list_of([Val.text(terms.string_of(k)), Val("key", terms.iri_key(shown))])


def _tagged(s: Val) -> Val:
    lex, lang = s.exact(2)
    plain = F.concat(F.lit('"'), lex.lex(), F.lit('"'))
    return Val("key", F.when(lang.lex() == "", plain).otherwise(F.concat(plain, F.lit("@"), lang.lex())))


def _tag_parts(o: Val) -> Val:
    k = o.key()
    return Val.list_of([Val.text(terms.string_of(k)), Val.text(terms.lang_of(k))])


register("sparql:dtLit", forward=_typed, reverse=_type_parts)
register("sparql:langLit", forward=_tagged, reverse=_tag_parts)
register("sparql:lamePred", test=lambda a, b: F.lit(True))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
