"""os: and uri:. Environment and arguments are read once, on the driver."""

from __future__ import annotations

import os
import re
from pathlib import Path
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import terms
from quadrille.functions.registry import register
from quadrille.functions.strings import join_uri
from quadrille.plans.values import Val, null

#: What os:argv counts from 1: set by the command line's --with.
ARGUMENTS: list[str] = []


def base_uri() -> str:
    return Path.cwd().as_uri() + "/"


def _const(s: Val) -> str:
    if s.const is None or terms.kind(s.const) != "literal":
        raise ValueError("this built-in takes a constant")
    return terms.parts(s.const)[0]


def environ(s: Val) -> Val:
    """An environment variable; no match where it is not set."""
    found = os.environ.get(_const(s))
    return Val.text(null() if found is None else F.lit(found))


def argv(s: Val) -> Val:
    n = int(_const(s))
    return Val.text(F.lit(ARGUMENTS[n - 1]) if 1 <= n <= len(ARGUMENTS) else null())


def relative(uri: str, base: str) -> str:
    """The shortest reference that resolves to ``uri`` from ``base``."""
    a, b = urlsplit(uri), urlsplit(base)
    if (a.scheme, a.netloc) != (b.scheme, b.netloc):
        return uri
    if uri.split("#")[0] == base.split("#")[0]:
        return uri[len(base.split("#")[0]) :]
    here, there = b.path.split("/")[:-1], a.path.split("/")
    same = 0
    while same < min(len(here), len(there) - 1) and here[same] == there[same]:
        same += 1
    path = "../" * (len(here) - same) + "/".join(there[same:])
    tail = uri[uri.index(a.path) + len(a.path) :] if a.path else ""
    return (path or "./") + tail


@F.pandas_udf(T.StringType())
def _relative(uri: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None or b is None else relative(u, b) for u, b in zip(uri, base, strict=True)], dtype="object")


def canonical(uri: str) -> str:
    """Lower-case scheme and host, upper-case escapes, unreserved characters plain."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?(.*)", uri, re.DOTALL)
    if not m:
        return uri
    rest = re.sub(r"%([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)) if re.match(r"[A-Za-z0-9._~-]", chr(int(x[1], 16))) else f"%{x[1].upper()}", m[3])
    rest = quote(rest, safe="/?#[]@!$&'()*+,;=:%-._~")
    return m[1].lower() + ":" + (f"//{m[2].lower()}" if m[2] is not None else "") + rest


@F.pandas_udf(T.StringType())
def _canonical(uri: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else canonical(u) for u in uri], dtype="object")


register("os:environ", forward=environ)
register("os:argv", forward=argv)
register("os:baseAbsolute", forward=lambda s: Val.text(join_uri(F.lit(base_uri()), s.lex())))
register(
    "os:baseRelative",
    forward=lambda s: Val.text(_relative(s.lex(), F.lit(base_uri()))),
    reverse=lambda o: Val.text(join_uri(F.lit(base_uri()), o.lex())),
)
register("uri:canon", forward=lambda s: Val.text(_canonical(s.lex())))
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
register("uri:scheme", forward=lambda s: Val.text(F.when(s.lex().rlike(_SCHEME), F.lower(F.regexp_extract(s.lex(), _SCHEME, 1)))))
register("uri:host", forward=lambda s: Val.text(F.when(s.lex().rlike(_HOST), F.lower(F.regexp_extract(s.lex(), _HOST, 1)))))
