"""Graphs as Python values: what the parsers return and what rules are compiled from.

A term is a key (see ``quadrille.terms``), a ``ListTerm``, a ``SetTerm`` or a
``Formula``. These live on the driver and hold rules and small documents; large
data never passes through them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from quadrille import terms


@dataclass(frozen=True)
class ListTerm:
    items: tuple


@dataclass(frozen=True)
class SetTerm:
    items: tuple


@dataclass(eq=False)
class Formula:
    """Statements with the variables quantified around them."""

    statements: list[tuple] = field(default_factory=list)
    universals: set[str] = field(default_factory=set)
    existentials: set[str] = field(default_factory=set)
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str = ""

    def add(self, s, p, o) -> None:
        if (s, p, o) not in self.statements:
            self.statements.append((s, p, o))

    def key(self) -> str:
        """Key by content: equal up to the names of its blank nodes and variables declared inside."""
        return "{" + hashlib.sha256(canonical_text(self).encode("utf-8", "surrogatepass")).hexdigest()[:32] + "}"

    def each(self, s=None, p=None, o=None) -> Iterator[tuple]:
        for st in self.statements:
            if (s is None or st[0] == s) and (p is None or st[1] == p) and (o is None or st[2] == o):
                yield st

    def substitute(self, mapping: dict[str, object]) -> Formula:
        return Formula(
            [tuple(substitute(t, mapping) for t in st) for st in self.statements],
            {v for v in self.universals if v not in mapping},
            {v for v in self.existentials if v not in mapping},
            self.prefixes,
            self.base,
        )


def substitute(term, mapping: dict[str, object]):
    if isinstance(term, str):
        return mapping.get(term, term)
    if isinstance(term, Formula):
        return term.substitute(mapping)
    return type(term)(tuple(substitute(t, mapping) for t in term.items))


def atoms(term) -> Iterator[str]:
    """Every key inside a term, inner formulae included."""
    if isinstance(term, str):
        yield term
    elif isinstance(term, Formula):
        for st in term.statements:
            for t in st:
                yield from atoms(t)
    else:
        for t in term.items:
            yield from atoms(t)


def variables(term) -> set[str]:
    return {a for a in atoms(term) if a.startswith("?")}


def bnodes(term) -> set[str]:
    return {a for a in atoms(term) if a.startswith("_:")}


def is_ground(term) -> bool:
    return not any(a.startswith(("?", "_:")) for a in atoms(term))


def key_of(term) -> str:
    """Key of a term kept as data; variables stay as they are."""
    if isinstance(term, str):
        return term
    if isinstance(term, Formula):
        return term.key()
    keys = [key_of(t) for t in term.items]
    return terms.make_list(keys) if isinstance(term, ListTerm) else terms.make_set(keys)


# --- canonical form --------------------------------------------------------------------------------------------------


def _show(term, label: Callable[[str], str]) -> str:
    if isinstance(term, str):
        return label(term) if term.startswith(("_:", "?")) else term
    if isinstance(term, ListTerm):
        return "(" + " ".join(_show(t, label) for t in term.items) + ")"
    if isinstance(term, SetTerm):
        return "($" + " ".join(sorted(_show(t, label) for t in term.items)) + "$)"
    return "{" + "\n".join(sorted(" ".join(_show(t, label) for t in st) for st in term.statements)) + "}"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _refine(statements: Iterable[tuple], colour: dict[str, str]) -> dict[str, str]:
    """Colour nodes by the statements they stand in until no colour class splits."""
    n = len(set(colour.values()))
    while True:
        seen: dict[str, list[str]] = {x: [] for x in colour}
        for st in statements:
            for x in {a for t in st for a in atoms(t) if a in colour}:
                seen[x].append(" ".join(_show(t, lambda a, x=x: "*" if a == x else colour.get(a, a)) for t in st))
        colour = {x: _digest(colour[x] + "\n" + "\n".join(sorted(lines))) for x, lines in seen.items()}
        now = len(set(colour.values()))
        if now == n:
            return colour
        n = now


def canonical_labels(statements: list[tuple], nodes: Iterable[str]) -> dict[str, str]:
    """A label for each node, the same for isomorphic graphs.

    Ties that colouring leaves are broken by trying each node of the smallest
    tied class and keeping the numbering with the least text.
    """
    nodes = sorted(set(nodes))
    if not nodes:
        return {}

    def text(labels: dict[str, str]) -> str:
        return "\n".join(sorted(" ".join(_show(t, lambda a: labels.get(a, a)) for t in st) for st in statements))

    def search(colour: dict[str, str]) -> dict[str, str]:
        colour = _refine(statements, colour)
        classes: dict[str, list[str]] = {}
        for x, c in colour.items():
            classes.setdefault(c, []).append(x)
        tied = sorted(((len(v), c) for c, v in classes.items() if len(v) > 1))
        if not tied:
            return {x: f"c{i}" for i, (_, x) in enumerate(sorted((c, x) for x, c in colour.items()))}
        found = [search(colour | {x: _digest(colour[x] + "!")}) for x in classes[tied[0][1]]]
        return min(found, key=text)

    return search({x: x[0] for x in nodes})


def canonical_text(f: Formula) -> str:
    inner = {a for st in f.statements for t in st for a in atoms(t) if a.startswith("_:")} | (f.universals & variables(f))
    labels = canonical_labels(f.statements, inner)
    show = lambda a: (a[0] + labels[a]) if a in labels else a
    return "\n".join(sorted(" ".join(_show(t, show) for t in st) for st in f.statements))


def isomorphic(a: Formula, b: Formula) -> bool:
    """Equal up to the names of blank nodes and of variables declared inside."""
    return canonical_text(a) == canonical_text(b)


def canonical_triples(statements: Iterable[tuple[str, str, str]]) -> set[tuple[str, ...]]:
    """Triples of keys with blank nodes renamed canonically: for comparing graphs."""
    rows = list(statements)
    labels = canonical_labels(rows, {a for st in rows for t in st for a in atoms(t) if a.startswith("_:")})
    return {tuple(("_:" + labels[t]) if t in labels else t for t in st) for st in rows}
