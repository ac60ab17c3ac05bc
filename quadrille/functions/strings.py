"""string: and the string functions of fn:."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import names as N
from quadrille import terms
from quadrille.functions.registry import register
from quadrille.plans.values import Val

_BLANKS = r"[ \t\r\n]+"


def _test(op):
    return lambda s, o: op(s.lex(), o.lex())


def roughly(c: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.regexp_replace(F.lower(c), _BLANKS, " ")


for _name, _op in {
    "greaterThan": lambda a, b: a > b,
    "notGreaterThan": lambda a, b: a <= b,
    "lessThan": lambda a, b: a < b,
    "notLessThan": lambda a, b: a >= b,
    "startsWith": lambda a, b: a.startswith(b),
    "endsWith": lambda a, b: a.endswith(b),
    "contains": lambda a, b: a.contains(b),
    "doesNotContain": lambda a, b: ~a.contains(b),
    "containsIgnoringCase": lambda a, b: F.lower(a).contains(F.lower(b)),
    "containsRoughly": lambda a, b: roughly(a).contains(roughly(b)),
    "notContainsRoughly": lambda a, b: ~roughly(a).contains(roughly(b)),
    "equalIgnoringCase": lambda a, b: F.lower(a) == F.lower(b),
    "notEqualIgnoringCase": lambda a, b: F.lower(a) != F.lower(b),
    "matches": lambda a, b: F.regexp_like(a, b),
    "notMatches": lambda a, b: ~F.regexp_like(a, b),
}.items():
    register(f"string:{_name}", test=_test(_op))


def _is_string(v: Val) -> Column:
    """True for plain literals and strings, false for numbers and other terms."""
    if v.kind == "string":
        return F.lit(True)
    if v.kind != "key":
        return F.lit(False)
    return F.coalesce(terms.datatype_of(v.col).isin("", N.XSD + "string"), F.lit(False))


def concat(o: Val) -> Val:
    """Joined strings; no match if a member is no string."""
    known = o.elements()
    if known is not None:
        fine = reduce(lambda a, b: a & b, [_is_string(v) for v in known], F.lit(True))
        return Val.text(F.when(fine, F.concat(F.lit(""), *[v.lex() for v in known])))
    keys = o.element_keys()
    fine = F.forall(keys, lambda k: F.coalesce(terms.datatype_of(k).isin("", N.XSD + "string"), F.lit(False)))
    return Val.text(F.when(fine, F.array_join(F.transform(keys, terms.string_of), "")))


def concatenation(s: Val) -> Val:
    """Joined strings; other literals by their lexical form, identifiers by their text."""
    known = s.elements()
    if known is not None:
        return Val.text(F.concat(F.lit(""), *[F.coalesce(v.lex(), terms.lex_of(v.key())) for v in known]))
    keys = s.element_keys()
    return Val.text(F.array_join(F.transform(keys, terms.lex_of), ""))


def _groups(s: Val) -> tuple[Column, Column]:
    text, pattern = s.exact(2)
    return text.lex(), pattern.lex()


def scrape(s: Val) -> Val:
    text, pattern = _groups(s)
    return Val.text(F.when(F.regexp_like(text, pattern), F.call_function("regexp_extract", text, pattern, F.lit(1))))


def search(s: Val) -> Val:
    """All groups of the first match. The number of groups is read from a constant pattern."""
    text, pattern = s.exact(2)
    if pattern.const is None:
        raise ValueError("string:search takes a constant pattern")
    n = re.compile(terms.parts(pattern.const)[0]).groups
    t, p = text.lex(), pattern.lex()
    found = F.regexp_like(t, p)
    return Val.list_of([Val.text(F.when(found, F.call_function("regexp_extract", t, p, F.lit(g)))) for g in range(1, n + 1)])


def replace(s: Val) -> Val:
    text, old, new = (v.lex() for v in s.exact(3))
    return Val.text(F.replace(text, old, new))


def _list(strings: Column) -> Val:
    return Val("array", strings, table="string")


def split(s: Val) -> Val:
    """(text, regex, most cuts); 0 cuts everywhere."""
    text, pattern, most = s.exact(3)
    n = most.num().i.cast("int")
    return _list(F.split(text.lex(), pattern.lex(), F.when(n > 0, n + 1).otherwise(-1)))


def tokenize(s: Val) -> Val:
    text, pattern = _groups(s)
    return _list(F.split(text, pattern, F.lit(-1)))


def normalize_space(s: Val) -> Val:
    return Val.text(F.trim(F.regexp_replace(s.lex(), r"\s+", " ")))


def to_characters(s: Val) -> Val:
    text = s.lex()
    return _list(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "", F.lit(-1))))


def from_characters(o: Val) -> Val:
    known = o.elements()
    if known is not None:
        return Val.text(F.concat(F.lit(""), *[v.lex() for v in known]))
    if o.kind == "array" and o.table == "string":
        return Val.text(F.array_join(o.col, ""))
    return Val.text(F.array_join(F.transform(o.element_keys(), terms.string_of), ""))


def python_format(s: Val) -> Val:
    """The % notation: the common codes of a constant format natively, others by an Arrow batch function."""
    known = s.elements()
    if known and known[0].const is not None:
        fmt = terms.parts(known[0].const)[0]
        codes = re.findall(r"%[-+ #0]*\d*(?:\.\d+)?([a-zA-Z%])", fmt)
        args = known[1:]
        needed = [c for c in codes if c != "%"]
        if len(needed) == len(args) and set(codes) <= set("sdifxXoeE%") and fmt.count("%") == len(codes) + codes.count("%"):
            cast = {"s": lambda v: v.lex(), "f": lambda v: v.num().d, "e": lambda v: v.num().d, "E": lambda v: v.num().d}
            columns = [cast.get(c, lambda v: v.num().i.cast("bigint"))(v) for c, v in zip(needed, args, strict=True)]
            java = re.sub(r"(%[-+ #0]*\d*)(?:\.\d+)?i", r"\1d", fmt)
            out = F.format_string(java, *columns) if columns else F.lit(fmt.replace("%%", "%"))
            missing = reduce(lambda a, b: a | b, [c.isNull() for c in columns], F.lit(False))
            return Val.text(F.when(~missing, out))
    keys = s.element_keys()
    return Val.text(_percent(F.transform(keys, terms.lex_of), F.transform(keys, lambda k: F.coalesce(terms.datatype_of(k), F.lit("")))))


@F.pandas_udf(T.StringType())
def _percent(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    def one(t, k):
        if t is None or not len(t):
            return None
        args = tuple(int(x) if d in N.INTEGER_FAMILY else float(x) if d in (N.DECIMAL, *N.FLOAT_FAMILY) else x for x, d in zip(t[1:], k[1:], strict=True))
        try:
            return t[0] % args
        except (TypeError, ValueError):
            return None

    return pd.Series([one(t, k) for t, k in zip(texts, kinds, strict=True)], dtype="object")


def _escape(c: Column, characters: str) -> Column:
    """Numeric character references; the ampersand first, as the others make some."""
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(f"&#{ord(x)};"))
    return c


def _encode(c: Column, safe: str) -> Column:
    """Percent-encoding that leaves letters, digits, _.- and ``safe``."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for x in "~*":
        shown = quote(x, safe="") if x != "~" else "%7E"
        shown = "%2A" if x == "*" else shown
        out = F.replace(out, F.lit(shown), F.lit(x)) if x in safe else F.replace(out, F.lit(x), F.lit(shown))
    for x in safe:
        if x not in "~*":
            out = F.replace(out, F.lit(f"%{ord(x):02X}"), F.lit(x))
    return out


@F.pandas_udf(T.StringType())
def join_uri(base: pd.Series, ref: pd.Series) -> pd.Series:
    from quadrille.sources.n3 import join

    def one(b, r):
        try:
            return None if b is None or r is None else join(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype="object")


def resolve_uri(s: Val) -> Val:
    there, base = s.exact(2)
    return Val.text(join_uri(base.lex(), there.lex()))


register("string:concat", reverse=concat)
register("string:concatenation", forward=concatenation)
register("string:scrape", forward=scrape)
register("string:search", forward=search)
register("string:replace", forward=replace)
register("string:split", forward=split)
register("fn:tokenize", forward=tokenize)
register("fn:normalize-space", forward=normalize_space)
register("string:stringToList", forward=to_characters, reverse=from_characters)
register("string:format", forward=python_format)
register("string:xmlEscapeData", forward=lambda s: Val.text(_escape(s.lex(), "&\r<>")))
register("string:xmlEscapeAttribute", forward=lambda s: Val.text(_escape(s.lex(), "&\r<>'\"\n")))
register("string:encodeForURI", forward=lambda s: Val.text(_encode(s.lex(), "#!~*'()")))
register("string:encodeForFragID", forward=lambda s: Val.text(_encode(s.lex(), "/")))
register("fn:resolve-uri", forward=resolve_uri)
