"""Terms as string keys, in Python and as Spark columns.

Every term is one string, so every join compares one string:

    <iri>   _:label   "lexical"   "lexical"@lang   "lexical"^^<datatype>
    ["item","item"]   a list: a JSON array of its items' keys
    $["item","item"]  a set: sorted, without repeats
    {id}              a graph used as a term
    ?name             a variable, in rules kept as data

The lexical form is not escaped: a suffix never holds a quote, so the last quote
ends it. All parts can be taken apart and put together by built-in functions.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille import names as N

_LITERAL = re.compile(r'"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^">]*)>)?', re.DOTALL)
_CONTROL = re.compile(r"\\u00([0-9a-f]{2})")


# --- Python ----------------------------------------------------------------------------------------------------------


def iri(uri: str) -> str:
    return f"<{uri}>"


def literal(lex: str, dt: str | None = None, lang: str | None = None) -> str:
    return f'"{lex}"' + (f"@{lang}" if lang else f"^^<{dt}>" if dt else "")


def value(x: object) -> str:
    """Key of a Python value."""
    if isinstance(x, bool):
        return literal("true" if x else "false", N.BOOLEAN)
    if isinstance(x, int):
        return literal(str(x), N.INTEGER)
    if isinstance(x, float):
        return literal(repr(x), N.DOUBLE)
    return literal(str(x))


def _array(keys: list[str]) -> str:
    text = json.dumps(keys, ensure_ascii=False, separators=(",", ":"))
    return _CONTROL.sub(lambda m: "\\u00" + m[1].upper(), text)  # as Spark writes control characters


def make_list(keys: list[str]) -> str:
    return _array(list(keys))


def make_set(keys: list[str]) -> str:
    return "$" + _array(sorted(set(keys), key=lambda k: k.encode("utf-8", "surrogatepass")))


def kind(key: str) -> str:
    return {"<": "iri", "_": "bnode", '"': "literal", "[": "list", "$": "set", "{": "formula", "?": "var"}[key[0]]


def parts(key: str) -> tuple[str, str | None, str | None]:
    """(lexical form, datatype, language) of a literal."""
    m = _LITERAL.fullmatch(key)
    if not m:
        raise ValueError(f"no literal: {key}")
    return m[1], m[3], m[2]


def members(key: str) -> list[str]:
    return json.loads(key.lstrip("$"))


def text(key: str) -> str:
    """What the key stands for, without its marks."""
    k = kind(key)
    if k == "literal":
        return parts(key)[0]
    return key[1:-1] if k in ("iri", "formula") else key[2:] if k == "bnode" else key


# --- columns ---------------------------------------------------------------------------------------------------------


_SUFFIX = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^">]*)>)?$'


def is_literal(k: Column) -> Column:
    return k.startswith('"')


def is_iri(k: Column) -> Column:
    return k.startswith("<")


def kind_of(k: Column) -> Column:
    first = F.substring(k, 1, 1)
    out = F.when(first == "<", "iri").when(first == '"', "literal").when(first == "_", "bnode")
    return out.when(first == "[", "list").when(first == "$", "set").when(first == "{", "formula").when(first == "?", "var")


def lex_of(k: Column) -> Column:
    """Lexical form of a literal, URI of an IRI; null for others."""
    return F.when(is_literal(k), F.regexp_extract(k, _SUFFIX, 1)).when(is_iri(k), F.substring(k, F.lit(2), F.length(k) - 2))


def string_of(k: Column) -> Column:
    """Lexical form of a literal; null for others."""
    return F.when(is_literal(k), F.regexp_extract(k, _SUFFIX, 1))


def uri_of(k: Column) -> Column:
    return F.when(is_iri(k), F.substring(k, F.lit(2), F.length(k) - 2))


def lang_of(k: Column) -> Column:
    return F.when(is_literal(k), F.regexp_extract(k, _SUFFIX, 2))


def datatype_of(k: Column) -> Column:
    """Datatype URI; the empty string for a plain literal; null for other terms."""
    return F.when(is_literal(k), F.regexp_extract(k, _SUFFIX, 3))


def items_of(k: Column) -> Column:
    """Keys of the members of a list or set; null for others."""
    body = F.when(k.startswith("["), k).when(k.startswith("$"), F.substring(k, F.lit(2), F.length(k)))
    return F.from_json(body, "array<string>")


def iri_key(uri: Column) -> Column:
    return F.concat(F.lit("<"), uri, F.lit(">"))


def literal_key(lex: Column, dt: str | Column | None = None) -> Column:
    plain = F.concat(F.lit('"'), lex, F.lit('"'))
    if dt is None:
        return plain
    if isinstance(dt, str):
        return F.concat(F.lit('"'), lex, F.lit(f'"^^<{dt}>'))
    return F.when(dt == "", plain).otherwise(F.concat(plain, F.lit("^^<"), dt, F.lit(">")))


def list_key(keys: Column) -> Column:
    """List of an array of keys; null if the array or a member is."""
    return F.when(F.forall(keys, lambda x: x.isNotNull()), F.to_json(keys))


def set_key(keys: Column) -> Column:
    whole = F.forall(keys, lambda x: x.isNotNull())
    return F.when(whole, F.concat(F.lit("$"), F.to_json(F.array_sort(F.array_distinct(keys)))))


def formula_key(ident: Column) -> Column:
    return F.concat(F.lit("{"), ident, F.lit("}"))


def class_order(k: Column) -> Column:
    """Rank of a term's class in the total order on terms."""
    xml = k.endswith(f"^^<{N.XML_LITERAL}>")
    out = F.when(is_literal(k) & ~xml, 1.0).when(is_literal(k), 1.5).when(k == "[]", 2.0).when(k.startswith("["), 3.0)
    return out.when(k.startswith("$"), 10.0).when(k.startswith("{"), 11.0).otherwise(6.0)


def order_by(k: Column) -> list[Column]:
    """Sort columns for the total order: class, then datatype, text, language."""
    return [class_order(k), F.coalesce(datatype_of(k), F.lit("")), F.coalesce(lex_of(k), k), F.coalesce(lang_of(k), F.lit(""))]
