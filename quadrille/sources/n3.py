"""N3 and Turtle text to formulae.

The whole language of rules: directives, verbs (a, =, =>, <=, :=, has, is ... of),
paths (x!p, x^p, x.p), blank nodes, lists, sets, quoted graphs, numbers, dates,
booleans and strings with language or datatype.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quadrille import names as N
from quadrille import terms
from quadrille.plans.formula import Formula, ListTerm, SetTerm

# characters that end a name: fixed values of the language
_END = "\t\r\n !\"#$%&'()*.,+/;<=>?@[\\]^`{|}~"
_NAME = f"[^{re.escape(_END)}:]"
_SPACE = re.compile(r"(?:[ \t\r\n\x0b\x0c]+|#[^\n]*)*")
_QNAME = re.compile(rf"({_NAME}*):({_NAME}*)")
_WORD = re.compile(rf"(?![0-9\-]){_NAME}+")
_IRI = re.compile(r"<([^>]*)>")
_VARIABLE = re.compile(rf"\?((?![0-9\-]){_NAME}+)")
_NUMBER = re.compile(r"[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]*)?)?)?(?:Z|[-+][0-9]{2}:[0-9]{2})?")
_LANG = re.compile(r"@([a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*)")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "a": "\a", "v": "\v", '"': '"', "'": "'", "\\": "\\", "\n": ""}
_KEYWORDS = {"a", "this", "bind", "has", "is", "of", "true", "false"}
_DIRECTIVES = ("prefix", "base", "keywords", "forAll", "forSome")


class SyntaxProblem(ValueError):
    """Text that is no N3, with the line it was noticed in."""

    def __init__(self, what: str, text: str, at: int):
        self.line = text.count("\n", 0, at) + 1
        super().__init__(f"line {self.line}: {what} at {text[at : at + 30]!r}")


def join(base: str, ref: str) -> str:
    """Absolute form of a reference."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref):
        return ref
    if not ref or ref.startswith("#"):
        return base.split("#")[0] + ref
    scheme, _, rest = base.partition(":")
    if scheme in ("http", "https", "file", "ftp", ""):
        return urljoin(base, ref)
    if not rest.startswith("/"):
        raise ValueError(f"base <{base}> has no path to resolve {ref!r} against")
    return scheme + ":" + urljoin("http:" + rest, ref).removeprefix("http:")


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        if m[3] is None:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _PLAIN:
            raise ValueError(f"unknown escape \\{m[3]}")
        return _PLAIN[m[3]]

    return _ESCAPE.sub(one, body) if "\\" in body else body


class Parser:
    def __init__(self, text: str, base: str = "", bnode_prefix: str = "b"):
        self.text, self.at, self.base = text, 0, base
        self.prefixes: dict[str, str] = {}
        self.keywords: set[str] | None = None
        self.prefix, self.count = bnode_prefix, 0
        self.root = self.here = Formula(prefixes=self.prefixes, base=base)
        self.depth = 0
        self.names: list[dict[str, str]] = [{}]  # blank node labels, by formula
        self.quantified: list[dict[str, str]] = [{}]  # declared symbols, by formula

    # scanning

    def fail(self, what: str):
        raise SyntaxProblem(what, self.text, self.at)

    def skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self, token: str) -> bool:
        self.skip()
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.peek(token):
            self.at += len(token)
            return True
        return False

    def match(self, pattern: re.Pattern) -> re.Match | None:
        self.skip()
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def word(self, w: str) -> bool:
        """A keyword: marked by @, or bare where keywords allow it."""
        self.skip()
        start = self.at
        marked = self.text.startswith("@", start)
        if not marked and w not in (_KEYWORDS if self.keywords is None else self.keywords):
            return False
        end = start + marked + len(w)
        if not self.text.startswith(w, start + marked):
            return False
        following = self.text[end : end + 1]
        if following == ":" or (following and following not in _END):
            return False
        self.at = end
        return True

    def fresh(self) -> str:
        self.count += 1
        return f"_:{self.prefix}{self.count}"

    # grammar

    def parse(self) -> Formula:
        while True:
            self.skip()
            if self.at >= len(self.text):
                return self.root
            self.statement_or_directive("")

    def statement_or_directive(self, close: str) -> None:
        if not self.directive():
            self.statement()
        if not self.take(".") and not (close and self.peek(close)) and self.at < len(self.text):
            self.fail("expected '.'")

    def directive(self) -> bool:
        for d in _DIRECTIVES:
            if self.word(d):
                getattr(self, f"on_{d}")()
                return True
        if self.word("bind"):
            self.fail("keyword bind is obsolete")
        return False

    def on_prefix(self) -> None:
        m = self.match(_QNAME)
        if not m or m[2]:
            self.fail("expected a prefix")
        ref = self.match(_IRI)
        if not ref:
            self.fail("expected <uri> after prefix")
        ns = join(self.base, unescape(ref[1]))
        if ":" not in ns:
            self.fail("relative namespace without base")
        self.prefixes[m[1]] = ns

    def on_base(self) -> None:
        ref = self.match(_IRI)
        if not ref:
            self.fail("expected <uri> after base")
        self.base = join(self.base, unescape(ref[1]))

    def on_keywords(self) -> None:
        self.keywords = set()
        while m := self.match(_WORD):
            self.keywords.add(m[0])
            if not self.take(","):
                break

    def on_forAll(self) -> None:  # noqa: N802
        self.declare("?_A", self.here.universals)

    def on_forSome(self) -> None:  # noqa: N802
        self.declare("_:some", self.here.existentials)

    def declare(self, mark: str, into: set[str]) -> None:
        while True:
            symbol = self.symbol(raw=True)
            if symbol is None:
                break
            self.count += 1
            local = re.sub(r"\W", "_", re.split(r"[#/:]", symbol.strip("<>"))[-1])
            key = f"{mark}{self.count}_{local}"
            self.quantified[-1][symbol] = key
            into.add(key)
            if not self.take(","):
                break

    def statement(self) -> None:
        subject = self.path()
        if subject is None:
            self.fail("expected a subject")
        self.properties(subject)

    def properties(self, subject) -> None:
        while True:
            if self.take(":-"):
                node = self.node()
                if node is None:
                    self.fail("expected a node after :-")
                self.here.add(subject, N.SAME_AS, node)
                continue
            verb = self.verb()
            if verb is None:
                return
            predicate, backwards = verb
            while True:
                obj = self.path()
                if obj is None:
                    self.fail("expected an object")
                self.here.add(*((obj, predicate, subject) if backwards else (subject, predicate, obj)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass

    def verb(self) -> tuple | None:
        if self.word("has"):
            return self.path(), False
        if self.word("is"):
            p = self.path()
            if not self.word("of"):
                self.fail("expected 'of'")
            return p, True
        if self.word("a"):
            return N.TYPE, False
        if self.take("=>"):
            return N.IMPLIES, False
        if self.take("<="):
            return N.IMPLIES, True
        if self.take(":="):
            return N.BECOMES, False
        if self.take("="):
            return N.SAME_AS, False
        p = self.path()
        return None if p is None else (p, False)

    def path(self):
        node = self.node()
        while node is not None:
            mark = self.text[self.at : self.at + 1]
            if mark == "." and not re.match(rf"{_NAME}|[:?<\[{{(]", self.text[self.at + 1 : self.at + 2]):
                break
            if mark not in ("!", "^", ".") or self.text.startswith("^^", self.at):
                break
            self.at += 1
            step, middle = self.node(), self.fresh()
            if step is None:
                self.fail("expected a path step")
            self.here.add(*((middle, step, node) if mark == "^" else (node, step, middle)))
            node = middle
        return node

    def node(self):
        self.skip()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            self.at += 1
            return self.blank()
        if self.take("{$"):
            return SetTerm(tuple(self.series("$}", ",")))
        if c == "{":
            self.at += 1
            return self.quoted()
        if self.take("($"):
            return SetTerm(tuple(self.series("$)")))
        if c == "(":
            self.at += 1
            return ListTerm(tuple(self.series(")")))
        if c in ('"', "'"):
            return self.string(c)
        if c and c in "+-0123456789":
            return self.number()
        if c == "?":
            m = self.match(_VARIABLE)
            if not m:
                self.fail("bad variable name")
            if not self.depth:
                self.fail("variable outside of any formula")
            key = "?" + m[1]
            return key
        if self.word("true"):
            return terms.value(True)
        if self.word("false"):
            return terms.value(False)
        return self.symbol()

    def blank(self) -> str:
        if self.take("="):
            subject = self.path()
            while self.take(","):
                self.here.add(subject, N.SAME_AS, self.path())
            self.take(";")
        else:
            subject = self.fresh()
        self.properties(subject)
        if not self.take("]"):
            self.fail("expected ']'")
        return subject

    def quoted(self) -> Formula:
        outer = self.here
        self.here = Formula(prefixes=self.prefixes, base=self.base)
        self.names.append({})
        self.quantified.append(dict(self.quantified[-1]))
        self.depth += 1
        while not self.take("}"):
            if self.at >= len(self.text):
                self.fail("expected '}'")
            self.statement_or_directive("}")
        self.depth -= 1
        self.names.pop()
        self.quantified.pop()
        inner, self.here = self.here, outer
        return inner

    def series(self, close: str, between: str = "") -> list:
        items = []
        while not self.take(close):
            if items and between and not self.take(between):
                self.fail(f"expected {between!r}")
            item = self.path()
            if item is None:
                self.fail(f"expected an item or {close!r}")
            items.append(item)
        return items

    def string(self, quote: str) -> str:
        delimiter = quote * 3 if self.text.startswith(quote * 3, self.at) else quote
        start = at = self.at + len(delimiter)
        while True:
            at = self.text.find(quote, at)
            if at < 0:
                self.fail("unterminated string")
            back = at
            while self.text[back - 1] == "\\" and back > start:
                back -= 1
            if (at - back) % 2 == 0 and self.text.startswith(delimiter, at):
                break
            at += 1
        if len(delimiter) == 3:  # quotes next to the closing ones belong to the text
            while self.text.startswith(quote, at + 3):
                at += 1
        body = self.text[start:at]
        if len(delimiter) == 1 and "\n" in body:
            self.fail("newline in string")
        self.at = at + len(delimiter)
        try:
            lex = unescape(body.replace("\r", ""))
        except ValueError as e:
            self.fail(str(e))
        if (m := _LANG.match(self.text, self.at)) is not None:
            self.at = m.end()
            return terms.literal(lex, lang=m[1])
        if self.text.startswith("^^", self.at):
            self.at += 2
            dt = self.symbol()
            if dt is None:
                self.fail("expected a datatype")
            return terms.literal(lex, dt[1:-1])
        return terms.literal(lex)

    def number(self) -> str:
        if m := self.match(_DATE):
            return terms.literal(m[0], N.DATE_TIME if m[1] else N.DATE)
        m = self.match(_NUMBER)
        if not m:
            self.fail("bad number")
        if m[2]:
            return terms.value(float(m[0]))
        return terms.literal(m[0], N.DECIMAL) if m[1] else terms.literal(str(int(m[0])), N.INTEGER)

    def symbol(self, raw: bool = False) -> str | None:
        """An IRI, a prefixed name or a bare word."""
        if m := self.match(_IRI):
            uri = join(self.base, unescape(m[1]))
            if ":" not in uri:
                self.fail(f"relative reference <{m[1]}> without base")
            key = terms.iri(uri)
        else:
            start = self.at
            m = self.match(_QNAME)
            if m and re.match(r"[0-9\-+]", m[0]):
                self.at = start
                return None
            if m:
                ns = self.prefixes.get(m[1])
                if ns is None and m[1] == "_":
                    known = self.names[-1]
                    return known.setdefault(m[2], self.fresh() if m[2] not in known else "")
                if ns is None:
                    self.at = start
                    self.fail(f"prefix {m[1]!r} is not bound")
                key = terms.iri(ns + m[2])
            elif self.keywords is not None and (m := self.match(_WORD)):
                if m[0] in self.keywords:
                    self.at = start
                    return None
                key = terms.iri(self.prefixes.get("", self.base + "#") + m[0])
            else:
                return None
        return key if raw else self.quantified[-1].get(key, key)


def parse(text: str, base: str = "", bnode_prefix: str = "b") -> Formula:
    """The formula of an N3 document. ``bnode_prefix`` keeps blank nodes of different documents apart."""
    return Parser(text, base, bnode_prefix).parse()


def rows(f: Formula, graph: str = "") -> list[tuple[str, str, str, str]]:
    """Quads (g, s, p, o) of a formula and of the formulae inside it."""
    from quadrille.plans.formula import key_of

    out: dict[tuple, None] = {}

    def inner(term) -> None:
        if isinstance(term, Formula):
            for r in rows(term, term.key()):
                out.setdefault(r)
        elif not isinstance(term, str):
            for t in term.items:
                inner(t)

    for st in f.statements:
        out.setdefault((graph, *(key_of(t) for t in st)))
        for t in st:
            inner(t)
    return list(out)


def quantifiers(f: Formula, graph: str = "") -> list[tuple[str, str, str]]:
    """(g, var, q) of a formula and of those inside it; q is A or E."""
    out = [(graph, v, "A") for v in sorted(f.universals)] + [(graph, v, "E") for v in sorted(f.existentials)]
    for st in f.statements:
        for t in st:
            for inner in [t] if isinstance(t, Formula) else []:
                out += quantifiers(inner, inner.key())
    return out
