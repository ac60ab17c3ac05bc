"""log: on terms. What needs a graph (includes, semantics, conclusion ...) is part of the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille import terms
from quadrille.functions.registry import register
from quadrille.plans.values import Val, same

register("log:equalTo", "owl:sameAs", test=same, forward=lambda s: s, reverse=lambda o: o)
register("log:notEqualTo", test=lambda s, o: ~same(s, o))


def uri(s: Val) -> Val:
    if s.kind == "row":
        return Val.text(F.substring(s.key(), F.lit(2), F.length(s.key()) - 2))
    return Val.text(terms.uri_of(s.key()))


def from_uri(o: Val) -> Val:
    """Texts without a colon are no absolute identifiers and match nothing."""
    return Val("key", F.when(o.lex().contains(":"), terms.iri_key(o.lex())))


def raw_uri(s: Val) -> Val:
    k = s.key()
    return Val.text(F.coalesce(terms.uri_of(k), F.when(k.startswith("_:") | k.startswith("{"), k)))


def from_raw_uri(o: Val) -> Val:
    t = o.lex()
    return Val("key", F.when(t.startswith("_:") | t.startswith("{"), t).when(t.contains(":"), terms.iri_key(t)))


_TYPES = {"literal": "Literal", "formula": "Formula", "list": "List", "set": "Set", "bnode": "Blank"}


def raw_type(s: Val) -> Val:
    kind = terms.kind_of(s.key())
    name = F.when(kind.isNotNull(), "Other")
    for k, n in _TYPES.items():
        name = F.when(kind == k, n).otherwise(name)
    from quadrille import names as N

    return Val("key", F.concat(F.lit("<" + N.LOG), name, F.lit(">")))


def racine(s: Val) -> Val:
    u = terms.uri_of(s.key())
    return Val("key", F.when(u.isNotNull(), terms.iri_key(F.substring_index(u, "#", 1))))


def typed_literal(s: Val) -> Val:
    lex, dt = s.exact(2)
    return Val("key", F.when(terms.is_iri(dt.key()), F.concat(F.lit('"'), lex.lex(), F.lit('"^^'), dt.key())))


register("log:uri", forward=uri, reverse=from_uri)
register("log:rawUri", forward=raw_uri, reverse=from_raw_uri)
register("log:rawType", forward=raw_type)
register("log:racine", forward=racine)
register("log:dtlit", forward=typed_literal)
