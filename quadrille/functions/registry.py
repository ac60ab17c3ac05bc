"""The table of built-in predicates.

A built-in has up to five modes, each a function from ``Val`` to columns:

    test(s, o) -> boolean column       both sides known
    forward(s) -> Val                  subject known, gives the object
    reverse(o) -> Val                  object known, gives the subject
    generate(s) -> array of keys       subject known, gives many objects
    generate_back(o) -> array of keys  object known, gives many subjects

Null means "no match" everywhere. Users add their own with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from quadrille import names as N
from quadrille.plans.values import Val


@dataclass(frozen=True)
class Builtin:
    name: str
    uri: str
    test: Callable[[Val, Val], Column] | None = None
    forward: Callable[[Val], Val] | None = None
    reverse: Callable[[Val], Val] | None = None
    generate: Callable[[Val], Column] | None = None
    generate_back: Callable[[Val], Column] | None = None
    #: Compares computed and bound terms; identity if not set.
    heavy: bool = False


BUILTINS: dict[str, Builtin] = {}


def register(name: str, *aliases: str, **modes) -> Builtin:
    """Register a built-in under prefix:name (or a full IRI) and its aliases."""
    first = None
    for n in (name, *aliases):
        uri = n if "://" in n or n.startswith("urn:") else N.expand(n)
        b = Builtin(n, uri, **modes)
        BUILTINS[f"<{uri}>"] = b
        first = first or b
    return first


def lookup(key: str) -> Builtin | None:
    load()
    return BUILTINS.get(key)


def named(name: str) -> Builtin:
    """By prefix:name."""
    load()
    return BUILTINS[f"<{N.expand(name)}>"]


_loaded = False


def load() -> None:
    """Import the families once."""
    global _loaded
    if not _loaded:
        _loaded = True
        from quadrille.functions import collections, crypto, logic, maths, sparql, strings, system, times, xml  # noqa: F401
