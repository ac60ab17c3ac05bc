"""Lists and sets: rdf:first/rest, list: and set:."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.functions.registry import register
from quadrille.plans.values import Val


def keys(v: Val) -> Column:
    return v.element_keys()


def _set(k: Column) -> Val:
    return Val("key", terms.set_key(k))


def first(s: Val) -> Val:
    return s.member(0)


def rest(s: Val) -> Val:
    k = keys(s)
    return Val("key", F.when(F.size(k) > 0, terms.list_key(F.slice(k, F.lit(2), F.greatest(F.size(k) - 1, F.lit(0))))))


def last(s: Val) -> Val:
    k = keys(s)
    return Val("key", F.when(F.size(k) > 0, F.element_at(k, -1)))


def contains(collection: Val, item: Val) -> Column:
    return F.array_contains(keys(collection), item.key())


def _each(s: Val) -> list[Column] | None:
    """Members' own members, where the outer list is known to the planner."""
    known = s.elements()
    return None if known is None else [keys(v) for v in known]


def append(s: Val) -> Val:
    inner = _each(s)
    if inner is not None:
        return Val("key", terms.list_key(F.concat(F.array().cast("array<string>"), *inner)))
    return Val("key", terms.list_key(F.flatten(F.transform(keys(s), terms.items_of))))


def union(s: Val) -> Val:
    inner = _each(s)
    if inner is not None:
        return _set(F.concat(F.array().cast("array<string>"), *inner))
    return _set(F.flatten(F.transform(keys(s), terms.items_of)))


def intersection(s: Val) -> Val:
    inner = _each(s)
    if inner is not None:
        return _set(reduce(F.array_intersect, inner)) if inner else Val("key", F.lit("$[]"))
    arrays = F.transform(keys(s), terms.items_of)
    rest_of = F.slice(arrays, F.lit(2), F.greatest(F.size(arrays) - 1, F.lit(0)))
    start = F.coalesce(F.get(arrays, F.lit(0)), F.array().cast("array<string>"))
    return _set(F.aggregate(rest_of, start, F.array_intersect))


def _two(s: Val) -> tuple[Column, Column]:
    a, b = s.exact(2)
    return keys(a), keys(b)


def difference(s: Val) -> Val:
    a, b = _two(s)
    return _set(F.array_except(a, b))


def symmetric_difference(s: Val) -> Val:
    a, b = _two(s)
    return _set(F.array_union(F.array_except(a, b), F.array_except(b, a)))


register("rdf:first", forward=first)
register("rdf:rest", forward=rest)
register("list:last", forward=last)
register("list:append", forward=append)
register("list:members", forward=lambda s: _set(keys(s)))
for _p in ("list", "set"):
    register(f"{_p}:in", test=lambda s, o: contains(o, s), generate_back=lambda o: F.array_distinct(keys(o)))
    register(f"{_p}:member", test=contains, generate=lambda s: F.array_distinct(keys(s)))
register("set:union", forward=union)
register("set:intersection", forward=intersection)
register("set:difference", forward=difference)
register("set:symmetricDifference", forward=symmetric_difference)
register("set:oneOf", reverse=lambda o: _set(keys(o)))
