"""RDF/XML to formulae: node and property elements, parseTypes, collections, containers, reification of ids."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from quadrille import names as N
from quadrille import terms
from quadrille.plans.formula import Formula, ListTerm
from quadrille.sources.n3 import join

XML = "http://www.w3.org/XML/1998/namespace"
_SYNTAX = {"RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype"}


def _r(name: str) -> str:
    return f"{{{N.RDF}}}{name}"


def _uri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Reader:
    def __init__(self, base: str, prefix: str):
        self.out, self.base, self.prefix, self.count = Formula(base=base), base, prefix, 0

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.prefix}{self.count}"

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        if (about := e.get(_r("about"))) is not None:
            subject = terms.iri(join(base, about))
        elif (ident := e.get(_r("ID"))) is not None:
            subject = terms.iri(join(base, "#" + ident))
        elif (label := e.get(_r("nodeID"))) is not None:
            subject = f"_:{self.prefix}n_{label}"
        else:
            subject = self.fresh()
        if e.tag != _r("Description"):
            self.out.add(subject, N.TYPE, terms.iri(_uri(e.tag)))
        self.attributes(e, subject, base, lang)
        item = 0
        for child in e:
            if child.tag == _r("li"):
                item += 1
            self.prop(child, subject, base, lang, item)
        return subject

    def attributes(self, e: ET.Element, subject: str, base: str, lang: str | None) -> None:
        for name, value in e.attrib.items():
            if name.startswith(f"{{{XML}}}") or (name.startswith(f"{{{N.RDF}}}") and name[len(N.RDF) + 2 :] in _SYNTAX) or not name.startswith("{"):
                continue
            if name == _r("type"):
                self.out.add(subject, N.TYPE, terms.iri(join(base, value)))
            else:
                self.out.add(subject, terms.iri(_uri(name)), terms.literal(value, lang=lang or None))

    def prop(self, e: ET.Element, subject: str, base: str, lang: str | None, item: int) -> None:
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        predicate = terms.iri(N.RDF + f"_{item}" if e.tag == _r("li") else _uri(e.tag))
        kind, children = e.get(_r("parseType")), list(e)
        if kind == "Resource":
            obj = self.fresh()
            for i, child in enumerate(children):
                self.prop(child, obj, base, lang, i + 1)
        elif kind == "Collection":
            obj = ListTerm(tuple(self.node(c, base, lang) for c in children))
        elif kind is not None:
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children)
            obj = terms.literal(inner, N.XML_LITERAL)
        elif (ref := e.get(_r("resource"))) is not None:
            obj = terms.iri(join(base, ref))
            self.attributes(e, obj, base, lang)
        elif (label := e.get(_r("nodeID"))) is not None:
            obj = f"_:{self.prefix}n_{label}"
            self.attributes(e, obj, base, lang)
        elif children:
            obj = self.node(children[0], base, lang)
        elif (dt := e.get(_r("datatype"))) is not None:
            obj = terms.literal(e.text or "", join(base, dt))
        elif any(k.startswith("{") and not k.startswith(f"{{{XML}}}") and k != _r("ID") for k in e.attrib):
            obj = self.fresh()
            self.attributes(e, obj, base, lang)
        else:
            obj = terms.literal(e.text or "", lang=lang or None)
        self.out.add(subject, predicate, obj)
        if (ident := e.get(_r("ID"))) is not None:
            st = terms.iri(join(base, "#" + ident))
            for name, t in (("subject", subject), ("predicate", predicate), ("object", obj)):
                self.out.add(st, f"<{N.RDF}{name}>", t)
            self.out.add(st, N.TYPE, f"<{N.RDF}Statement>")


def parse(text: str, base: str = "", bnode_prefix: str = "b") -> Formula:
    """The formula of an RDF/XML document."""
    root = ET.fromstring(text)
    r = _Reader(base, bnode_prefix)
    if root.tag == _r("RDF"):
        own, lang = root.get(f"{{{XML}}}base", base), root.get(f"{{{XML}}}lang")
        for e in root:
            r.node(e, own, lang)
    else:
        r.node(root, base, None)
    return r.out


def infoset(text: str, prefix: str = "x") -> Formula:
    """XML of any kind as triples: elements with name, attributes, text and children in a list."""
    ns = "urn:quadrille:infoset#"
    out, count = Formula(), 0

    def walk(e: ET.Element) -> str:
        nonlocal count
        count += 1
        node = f"_:{prefix}{count}"
        out.add(node, f"<{ns}name>", terms.literal(_uri(e.tag)))
        for k, v in e.attrib.items():
            out.add(node, f"<{ns}attribute>", ListTerm((terms.literal(_uri(k)), terms.literal(v))))
        items = [terms.literal(e.text)] if e.text and e.text.strip() else []
        for c in e:
            items.append(walk(c))
            if c.tail and c.tail.strip():
                items.append(terms.literal(c.tail))
        out.add(node, f"<{ns}children>", ListTerm(tuple(items)))
        return node

    walk(ET.fromstring(text))
    return out
