"""Documents read on the driver: rules, queries and small graphs, by local path or data: address.

Large data goes through Spark's readers (see ``quadrille.sources.triples`` and
``quadrille.sources.tabular``); nothing here touches the network.
"""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import unquote_to_bytes, urlsplit

from quadrille.plans.formula import Formula
from quadrille.sources import n3


def read_text(address: str) -> str:
    """Text at a path, a file: or a data: address."""
    if address.startswith("data:"):
        head, _, body = address[5:].partition(",")
        data = unquote_to_bytes(body)
        if head.endswith(";base64"):
            import base64

            data = base64.b64decode(data)
        return data.decode("utf-8")
    parts = urlsplit(address)
    if parts.scheme in ("http", "https", "ftp"):
        raise ValueError(f"{address}: only local files and data: addresses are read")
    return Path(unquote_to_bytes(parts.path).decode() if parts.scheme == "file" else address).read_text(encoding="utf-8")


def guess(address: str, text: str) -> str:
    """n3, rdf, ntriples, sparql or json: by name, else by look."""
    for suffix, kind in ((".rdf", "rdf"), (".owl", "rdf"), (".xml", "rdf"), (".nt", "ntriples"), (".rq", "sparql"), (".sparql", "sparql"), (".n3", "n3"), (".ttl", "n3"), (".json", "json")):
        if address.split("#")[0].endswith(suffix):
            return kind
    start = text.lstrip()[:400]
    return "rdf" if start.startswith("<?xml") or "<rdf:RDF" in start else "n3"


def load(address: str, kind: str | None = None, prefix: str = "b") -> Formula:
    """The formula of a document; ``prefix`` keeps its blank nodes apart from others'."""
    text = read_text(address)
    base = address if "://" in address or address.startswith("data:") else Path(address).resolve().as_uri()
    kind = kind or guess(address, text)
    if kind == "rdf":
        from quadrille.sources.rdfxml import parse

        return parse(text, base, prefix)
    if kind == "json":
        return from_json(json.loads(text), base, prefix)
    return n3.parse(text, base.split("#")[0], prefix)


def load_many(addresses: list[str]) -> Formula:
    """The merge of documents: blank nodes stay apart."""
    out = Formula()
    for i, a in enumerate(addresses):
        f = load(a, prefix=f"d{i}_")
        for st in f.statements:
            out.add(*st)
        out.prefixes |= f.prefixes
        out.universals |= f.universals
        out.existentials |= f.existentials
    return out


def imports_closure(address: str) -> Formula:
    """A document and those it imports, directly or not."""
    from quadrille import names as N

    todo, seen, out, i = [address], set(), Formula(), 0
    while todo:
        a = todo.pop()
        if a in seen:
            continue
        seen.add(a)
        f = load(a, prefix=f"d{i}_")
        i += 1
        for st in f.statements:
            out.add(*st)
            if st[1] == f"<{N.OWL}imports>" and isinstance(st[2], str) and st[2].startswith("<"):
                todo.append(st[2][1:-1])
        out.prefixes |= f.prefixes
    return out


def from_json(data: object, base: str, prefix: str = "b") -> Formula:
    """JSON as triples: an object is a blank node, its keys are predicates, arrays are lists."""
    from quadrille import terms
    from quadrille.plans.formula import ListTerm

    f = Formula(base=base)
    count = 0

    def term(x):
        nonlocal count
        if isinstance(x, dict):
            count += 1
            node = f"_:{prefix}{count}"
            for k, v in x.items():
                if v is not None:
                    f.add(node, terms.iri(f"{base.split('#')[0]}#{k}"), term(v))
            return node
        if isinstance(x, list):
            return ListTerm(tuple(term(v) for v in x if v is not None))
        return terms.value(x)

    for x in data if isinstance(data, list) else [data]:
        term(x)
    return f
