"""dom: navigation of XML values, and fn:doc.

A node is a literal of datatype XMLLiteral. So that parents and siblings can be
found, a node inside a document is written as the document with a mark on the
node: the processing instruction <?at PATH?> in front, PATH being child numbers
from the root. Questions about one node run in Arrow batches; xpath is built in.
"""

from __future__ import annotations

import re
from xml.dom import Node, minidom

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import names as N
from quadrille import terms
from quadrille.functions.registry import register
from quadrille.plans.values import Num, Val

_MARK = re.compile(r"<\?at ([0-9/@]*)\?>")


def parse(text: str) -> tuple[minidom.Document, Node]:
    """The document and the marked node (the root element if there is no mark)."""
    m = _MARK.match(text)
    doc = minidom.parseString(text[m.end() :].encode() if m else text.encode())
    node: Node = doc.documentElement
    if m and m[1] == "@":
        return doc, doc
    for step in (m[1].split("/") if m and m[1] else []):
        node = node.childNodes[int(step)]
    return doc, node


def show(doc: minidom.Document, node: Node | None) -> str | None:
    if node is None:
        return None
    body = doc.documentElement.toxml()
    if node is doc:
        return "<?at @?>" + body
    steps = []
    while node is not doc.documentElement:
        steps.append(str(list(node.parentNode.childNodes).index(node)))
        node = node.parentNode
    return f"<?at {'/'.join(reversed(steps))}?>{body}" if steps else body


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _ask(kind: str, question):
    """A batch function from XML text to ``question(document, node)``; null for null or malformed text."""

    @F.pandas_udf(_TYPES[kind])
    def f(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else question(*parse(t))
            except Exception:  # noqa: BLE001  a malformed value matches nothing
                return None

        return pd.Series([one(t) for t in texts], dtype="object")

    return f


def _node(text: Column) -> Val:
    return Val("key", terms.literal_key(text, N.XML_LITERAL))


def _int(c: Column) -> Val:
    i = c.cast("decimal(38,0)")
    return Num(0, i.cast("double"), i.cast("decimal(38,18)"), i).val()


def _nodes(name: str, question) -> None:
    f = _ask("string", lambda d, n: show(d, question(n)))
    register(f"dom:{name}", forward=lambda s: _node(f(s.lex())))


def _texts(name: str, question, *aliases: str) -> None:
    f = _ask("string", lambda d, n: question(n))
    register(f"dom:{name}", *aliases, forward=lambda s: Val.text(f(s.lex())))


_type = _ask("int", lambda d, n: n.nodeType)
register("dom:nodeType", forward=lambda s: _int(_type(s.lex())))
_nodes("parentNode", lambda n: n.parentNode)
_nodes("previousSibling", lambda n: n.previousSibling)
_nodes("nextSibling", lambda n: n.nextSibling)
_nodes("firstChild", lambda n: n.firstChild)
_nodes("lastChild", lambda n: n.lastChild)
_texts("localName", lambda n: n.localName)
_texts("prefix", lambda n: n.prefix)
_texts("namespaceURI", lambda n: n.namespaceURI)
_texts("nodeName", lambda n: n.nodeName)


def _content(n: Node) -> str:
    """Text of a node: of an element, all text inside."""
    if n.nodeType in (Node.TEXT_NODE, Node.CDATA_SECTION_NODE, Node.ATTRIBUTE_NODE, Node.COMMENT_NODE):
        return n.nodeValue
    return "".join(_content(c) for c in n.childNodes if c.nodeType != Node.COMMENT_NODE)


_texts("nodeValue", _content, "fn:string")
def _xml_key(text: str) -> str:
    return terms.literal(text, N.XML_LITERAL)


# lists are put together here: built-in array functions take no batch functions inside
_children = _ask("string", lambda d, n: terms.make_list([_xml_key(show(d, c)) for c in n.childNodes]))
_attributes = _ask("string", lambda d, n: terms.make_list([terms.make_list([terms.literal(k), terms.literal(v)]) for k, v in sorted((n.attributes or {}).items())]))
register("dom:childNodes", forward=lambda s: Val("key", _children(s.lex())))
#: Attributes as a list of (name, value) lists, by name.
register("dom:attributes", forward=lambda s: Val("key", _attributes(s.lex())))


def _bool(c: Column) -> Val:
    return Val("bool", c)


_has_attributes = _ask("boolean", lambda d, n: bool(n.attributes and n.attributes.length))
_has_children = _ask("boolean", lambda d, n: bool(n.childNodes))
register("dom:hasAttributes", forward=lambda s: _bool(_has_attributes(s.lex())))
register("dom:hasChildNodes", forward=lambda s: _bool(_has_children(s.lex())))
register("dom:isSameNode", test=lambda s, o: s.lex() == o.lex())


def xpath_keys(s: Val) -> Column:
    """(node, expression): what the expression selects, as strings; the expression is a constant."""
    node, expr = s.exact(2)
    if expr.const is None:
        raise ValueError("xpath takes a constant expression")
    body = F.regexp_replace(node.lex(), r"^<\?at [0-9/@]*\?>", "")
    return F.transform(F.xpath(body, F.lit(terms.parts(expr.const)[0])), lambda x: terms.literal_key(x))


register("dom:xpath", generate=xpath_keys)


def doc(s: Val) -> Val:
    """The document at a constant address, read once on the driver."""
    from quadrille.sources.documents import read_text

    if s.const is None:
        raise ValueError("fn:doc takes a constant address")
    return _node(F.lit(minidom.parseString(read_text(terms.text(s.const)).encode()).documentElement.toxml()))


register("fn:doc", forward=doc, heavy=True)
