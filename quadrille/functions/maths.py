"""Arithmetic, comparison and trigonometry: math: on typed numbers, maths: on strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.functions.registry import register
from quadrille.plans.values import Num, Val, lexical_number

D, I = "decimal(38,18)", "decimal(38,0)"  # noqa: E741


def _numbers(s: Val) -> list[Num] | None:
    known = s.elements()
    return None if known is None else [v.num() for v in known]


def _fold(s: Val, op: Callable, start: int) -> Num:
    """Fold a list of any length, known to the planner or not."""
    nums = _numbers(s)
    if nums is not None:
        return Num.fold(nums, op, start)
    if s.kind == "array" and s.table == "double":
        return Num(2, F.aggregate(s.col, F.lit(float(start)), op))
    keys = s.element_keys()
    at = lambda k: lexical_number(terms.string_of(k), terms.datatype_of(k))
    rank = F.when(F.forall(keys, lambda k: at(k).rank.isNotNull()), F.coalesce(F.array_max(F.transform(keys, lambda k: at(k).rank)), F.lit(0)))
    whole = lambda kind, pick: F.aggregate(
        F.transform(keys, pick), F.lit(start).cast(kind), lambda a, x: op(a, x).cast(kind)
    )
    return Num(rank, whole("double", lambda k: at(k).d), whole(D, lambda k: at(k).n), whole(I, lambda k: at(k).i))


def _add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def _mul(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def total(s: Val) -> Num:
    return _fold(s, _add, 0)


def product(s: Val) -> Num:
    return _fold(s, _mul, 1)


def _pair(s: Val) -> tuple[Num, Num]:
    a, b = s.exact(2)
    return a.num(), b.num()


def difference(s: Val) -> Num:
    return Num.fold(list(_pair(s)), F.try_subtract, 0)


def _exact(a: Num, b: Num) -> bool:
    return all(isinstance(r, int) and r == 0 for r in (a.rank, b.rank))


def quotient(s: Val) -> Num:
    """True division: a double, or a decimal between decimals."""
    a, b = _pair(s)
    d = F.try_divide(a.d, b.d)
    rank = Num.join([a, b])
    if isinstance(rank, int):
        return Num(2, d) if rank != 1 else Num(1, d, F.try_divide(a.n.cast("decimal(30,12)"), b.n.cast("decimal(30,12)")).cast(D))
    return Num(F.when(rank == 1, 1).when(rank.isNotNull(), 2), d, F.try_divide(a.n.cast("decimal(30,12)"), b.n.cast("decimal(30,12)")).cast(D))


def _floor_div(a: Column, b: Column) -> Column:
    """Rounds towards minus infinity, exactly for whole numbers."""
    q = F.try_divide(a, b)
    return F.floor(q)


def _exact_floor(a: Num, b: Num) -> Column:
    """Floor of a quotient of whole numbers without going through fractions."""
    ok = b.i != 0
    r = F.when(ok, a.i % F.when(ok, b.i))
    adjust = F.when((r != 0) & ((r < 0) != (b.i < 0)), 1).otherwise(0)
    trunc = F.when(ok, ((a.i - r) / F.when(ok, b.i)))
    return (trunc - adjust).cast(I)


def integer_quotient(s: Val) -> Num:
    a, b = _pair(s)
    i = _exact_floor(a, b)
    d = _floor_div(a.d, b.d).cast("double")
    if _exact(a, b):
        return Num(0, d, i.cast(D), i)
    whole = F.coalesce(i, d.try_cast(I))
    return Num(0, d, whole.cast(D), whole)


def remainder(s: Val) -> Num:
    """Sign of the divisor."""
    a, b = _pair(s)
    mod = lambda x, y: F.when(y != 0, x - y * F.floor(F.try_divide(x, y)))
    i = F.when(b.i != 0, ((a.i % F.when(b.i != 0, b.i)) + b.i) % F.when(b.i != 0, b.i)).cast(I)
    d = mod(a.d, b.d)
    n = F.when(b.n != 0, ((a.n % F.when(b.n != 0, b.n)) + b.n) % F.when(b.n != 0, b.n)).cast(D)
    return Num(Num.join([a, b]), d, n, i)


def power(s: Val) -> Num:
    """Whole numbers stay whole while they fit 38 digits; else a double."""
    a, b = _pair(s)
    d = F.pow(a.d, b.d)
    small = (b.i >= 0) & (b.i <= 127)
    exact = F.when(
        small, F.aggregate(F.sequence(F.lit(1), F.greatest(b.i.cast("int"), F.lit(1))), F.lit(1).cast(I), lambda acc, _: F.try_multiply(acc, a.i).cast(I))
    )
    exact = F.when(b.i == 0, F.lit(1).cast(I)).otherwise(exact)
    if _exact(a, b):
        return Num(F.when(exact.isNotNull(), 0).when(d.isNotNull(), 2), d, exact.cast(D), exact)
    rank = Num.join([a, b])
    if isinstance(rank, int) and rank == 2:
        return Num(2, d)
    rank = F.lit(rank) if isinstance(rank, int) else rank
    return Num(F.when((rank == 0) & exact.isNotNull(), 0).when(d.isNotNull(), 2), d, exact.cast(D), exact)


def bit(s: Val) -> Num:
    a, b = _pair(s)
    i = F.getbit(a.i.cast("bigint"), F.when((b.i >= 0) & (b.i < 64), b.i).cast("int")).cast(I)
    return Num(0, i.cast("double"), i.cast(D), i)


def negation(s: Val) -> Num:
    x = s.num()
    return Num(x.rank, -x.d, -x.n, -x.i)


def absolute(s: Val) -> Num:
    x = s.num()
    return Num(x.rank, F.abs(x.d), F.abs(x.n), F.abs(x.i))


def rounded(s: Val) -> Num:
    """Half away from zero; a double."""
    return Num(2, F.round(s.num().d, 0))


def count(s: Val) -> Num:
    known = s.elements()
    n = F.lit(len(known)) if known is not None else F.size(s.col) if s.kind == "array" else F.size(s.element_keys())
    i = F.when(n >= 0, n).cast(I)
    return Num(0, i.cast("double"), i.cast(D), i)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def atan2(s: Val) -> Num:
    a, b = _pair(s)
    return Num(2, F.atan2(a.d, b.d))


def _real(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda s: Num(2, _finite(f(s.num().d))).val()


FUNCTIONS = {
    "sum": total, "difference": difference, "product": product, "quotient": quotient, "integerQuotient": integer_quotient,
    "remainder": remainder, "exponentiation": power, "negation": negation, "absoluteValue": absolute, "rounded": rounded,
    "memberCount": count,
}
BACKWARDS = {
    "sumOf": total, "differenceOf": difference, "factors": product, "quotientOf": quotient, "remainderOf": remainder, "exponentiationOf": power,
}
TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "greaterThan": lambda a, b: a > b, "notGreaterThan": lambda a, b: a <= b, "lessThan": lambda a, b: a < b,
    "notLessThan": lambda a, b: a >= b, "equalTo": lambda a, b: a == b, "notEqualTo": lambda a, b: a != b,
}


def _typed(f: Callable[[Val], Num]) -> Callable[[Val], Val]:
    return lambda s: f(s).val()


def tidy(x: Num) -> Val:
    """A number as a string, without a fraction of zero."""
    text = x.val().lex() if isinstance(x.rank, int) else F.when(x.rank == 0, Val("int", x.i).lex()).when(x.rank == 1, Val("decimal", x.n).lex()).otherwise(x.d.cast("string"))
    return Val.text(F.regexp_replace(text, r"\.0$", ""))


def _strings_only(s: Val) -> Val:
    """A list with what is typed or no literal taken out, as its twin takes strings alone."""
    plain = lambda v: v if v.kind != "key" or v.const is not None else Val.text(F.when(terms.datatype_of(v.col) == "", terms.string_of(v.col)))
    known = s.elements()
    if known is not None:
        return Val.list_of([plain(v) for v in known])
    return s


def _tidied(f: Callable[[Val], Num]) -> Callable[[Val], Val]:
    return lambda s: tidy(f(_strings_only(s)))


def _compare(op: Callable[[Column, Column], Column]) -> Callable[[Val, Val], Column]:
    return lambda s, o: op(s.double(), o.double())


for _name, _f in FUNCTIONS.items():
    _modes = {"forward": _typed(_f)} | ({"reverse": _typed(_f)} if _name == "negation" else {})
    register(f"math:{_name}", **_modes)
    _modes = {"forward": _tidied(_f)} | ({"reverse": _tidied(_f)} if _name == "negation" else {})
    register(f"maths:{_name}", **_modes)
for _name, _f in BACKWARDS.items():
    register(f"math:{_name}", reverse=_typed(_f))
    register(f"maths:{_name}", reverse=_tidied(_f))
for _name, _op in TESTS.items():
    register(f"math:{_name}", test=_compare(_op))
    register(f"maths:{_name}", test=_compare(_op))
register("math:bit", forward=_typed(bit))
register("math:atan2", forward=_typed(atan2))
register("math:cos", forward=_real(F.cos), reverse=_real(F.acos))
register("math:sin", forward=_real(F.sin), reverse=_real(F.asin))
register("math:tan", forward=_real(F.tan), reverse=_real(F.atan))
register("math:cosh", forward=_real(F.cosh))
register("math:sinh", forward=_real(F.sinh))
register("math:tanh", forward=_real(F.tanh))
register("math:degrees", forward=_real(F.degrees), reverse=_real(F.radians))
