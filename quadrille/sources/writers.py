"""Writers: N-Triples and N-Quads from executors; N3, RDF/XML, result XML and dot on the driver.

Distributed output is one line for each quad. The forms that need a whole graph
at hand are for small ones and refuse more than ``MAX_STATEMENTS``.
"""

from __future__ import annotations

import re
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille import terms
from quadrille.plans.formula import Formula, ListTerm, SetTerm

MAX_STATEMENTS = 1_000_000


# --- distributed -----------------------------------------------------------------------------------------------------


def escaped(lex: Column) -> Column:
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(plain), F.lit(shown))
    return lex


def nt_term(k: Column) -> Column:
    """A key in N-Triples notation; null for terms that it has no form for."""
    lex, lang, dt = terms.string_of(k), terms.lang_of(k), terms.datatype_of(k)
    body = F.concat(F.lit('"'), escaped(lex), F.lit('"'))
    lit = F.when(lang != "", F.concat(body, F.lit("@"), lang)).when(dt != "", F.concat(body, F.lit("^^<"), dt, F.lit(">"))).otherwise(body)
    return F.when(k == "[]", N.NIL).when(k.startswith('"'), lit).when(k.startswith("<") | k.startswith("_:"), k)


def ntriples(quads: DataFrame) -> DataFrame:
    """One line (column value) for each quad whose terms N-Triples can hold; lists are unfolded first."""
    from quadrille.operators.lists import unfold_lists

    rows = unfold_lists(quads)
    g = F.when(F.col("g") == "", "").otherwise(F.concat(F.lit(" "), F.when(F.col("g").startswith("{"), F.concat(F.lit("_:g"), F.substring("g", 2, 32))).otherwise(F.col("g"))))
    line = F.concat(nt_term(F.col("s")), F.lit(" "), nt_term(F.col("p")), F.lit(" "), nt_term(F.col("o")), g, F.lit(" ."))
    return rows.select(line.alias("value")).where("value is not null")


def write_ntriples(quads: DataFrame, path: str) -> None:
    ntriples(quads).write.text(path)


def output_strings(quads: DataFrame) -> DataFrame:
    """Texts to be put out, in the order of their subjects."""
    rows = quads.where((F.col("g") == "") & (F.col("p") == N.OUTPUT_STRING))
    return rows.orderBy(*terms.order_by(F.col("s")), *terms.order_by(F.col("o"))).select(terms.lex_of(F.col("o")).alias("value"))


def by_subject(quads: DataFrame) -> DataFrame:
    """One row for each subject with its statements sorted."""
    return quads.groupBy("g", "s").agg(F.array_sort(F.collect_set(F.struct("p", "o"))).alias("statements"))


# --- on the driver ---------------------------------------------------------------------------------------------------


def collected(quads: DataFrame) -> list[tuple[str, str, str]]:
    rows = quads.where("g = ''").select("s", "p", "o").distinct().limit(MAX_STATEMENTS + 1).collect()
    if len(rows) > MAX_STATEMENTS:
        raise ValueError(f"over {MAX_STATEMENTS} statements: write N-Triples instead")
    return sorted((r["s"], r["p"], r["o"]) for r in rows)


_LOCAL = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


class N3Writer:
    """N3 text. Flags: n no prefixes, s a statement for each line, t no 'a', v no nested blank nodes."""

    def __init__(self, prefixes: dict[str, str] | None = None, flags: str = ""):
        self.flags = flags
        self.prefixes = {} if "n" in flags else {v: k for k, v in (prefixes or {}).items()}
        self.used: set[str] = set()

    def term(self, t) -> str:
        if isinstance(t, ListTerm):
            return "( " + " ".join(self.term(x) for x in t.items) + " )"
        if isinstance(t, SetTerm):
            return "{$ " + ", ".join(self.term(x) for x in t.items) + " $}"
        if isinstance(t, Formula):
            return "{ " + " ".join(self.statements(t.statements).split("\n")) + "}"
        k = terms.kind(t)
        if k == "iri":
            for ns, p in self.prefixes.items():
                if t[1:-1].startswith(ns) and _LOCAL.fullmatch(t[1 + len(ns) : -1]):
                    self.used.add(ns)
                    return f"{p}:{t[1 + len(ns) : -1]}"
            return t
        if k == "literal":
            lex, dt, lang = terms.parts(t)
            if dt == N.INTEGER and re.fullmatch(r"[-+]?\d+", lex) or dt == N.DECIMAL and re.fullmatch(r"[-+]?\d+\.\d+", lex):
                return lex
            if dt == N.BOOLEAN and lex in ("true", "false"):
                return lex
            body = lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
            return f'"{body}"' + (f"@{lang}" if lang else f"^^{self.term(terms.iri(dt))}" if dt else "")
        if k == "list":
            return "( " + " ".join(self.term(x) for x in terms.members(t)) + " )"
        if k == "set":
            return "{$ " + ", ".join(self.term(x) for x in terms.members(t)) + " $}"
        return t

    def verb(self, p) -> str:
        if "t" not in self.flags:
            marks = {N.TYPE: "a", N.IMPLIES: "=>", N.SAME_AS: "="}
            if isinstance(p, str) and p in marks:
                return marks[p]
        return self.term(p)

    def statements(self, rows) -> str:
        if "s" in self.flags:
            return "".join(f"{self.term(s)} {self.verb(p)} {self.term(o)} .\n" for s, p, o in rows)
        groups: dict = {}
        for s, p, o in rows:
            groups.setdefault(s if isinstance(s, str) else id(s), (s, {}))[1].setdefault(self.verb(p), []).append(self.term(o))
        out = []
        for s, verbs in groups.values():
            body = ";\n    ".join(f"{v} {', '.join(os)}" for v, os in verbs.items())
            out.append(f"{self.term(s)} {body} .\n")
        return "".join(out)

    def document(self, rows) -> str:
        body = self.statements(rows)
        head = "".join(f"@prefix {p}: <{ns}> .\n" for ns, p in sorted(self.prefixes.items(), key=lambda x: x[1]) if ns in self.used)
        return head + body


def n3_text(f: Formula, flags: str = "") -> str:
    """A formula as N3."""
    return N3Writer(f.prefixes, flags).document(f.statements)


def n3_of(quads: DataFrame, prefixes: dict[str, str] | None = None, flags: str = "") -> str:
    return N3Writer(prefixes, flags).document(collected(quads))


def rdfxml_of(quads: DataFrame, prefixes: dict[str, str] | None = None) -> str:
    """RDF/XML: a Description for each subject."""
    rows = collected(quads)
    spaces = {N.RDF: "rdf"} | {v: k for k, v in (prefixes or {}).items() if k}
    groups: dict[str, list[tuple[str, str]]] = {}
    for s, p, o in rows:
        groups.setdefault(s, []).append((p, o))

    def tag(p: str) -> str:
        m = re.fullmatch(r"<(.*?)([A-Za-z_][A-Za-z0-9_.-]*)>", p)
        if not m:
            raise ValueError(f"{p} cannot be an XML element")
        return f"{spaces.setdefault(m[1], f'ns{len(spaces)}')}:{m[2]}"

    def node(o: str, name: str, pad: str) -> str:
        k = terms.kind(o)
        if k == "iri":
            return f"{pad}<{name} rdf:resource={quoteattr(o[1:-1])}/>\n"
        if k == "bnode":
            return f"{pad}<{name} rdf:nodeID={quoteattr(o[2:])}/>\n"
        if k == "literal":
            lex, dt, lang = terms.parts(o)
            if dt == N.XML_LITERAL:
                return f'{pad}<{name} rdf:parseType="Literal">{lex}</{name}>\n'
            about = f" rdf:datatype={quoteattr(dt)}" if dt else f" xml:lang={quoteattr(lang)}" if lang else ""
            return f"{pad}<{name}{about}>{escape(lex)}</{name}>\n"
        if k == "list":
            inner = "".join(item(x, pad + "  ") for x in terms.members(o))
            return f'{pad}<{name} rdf:parseType="Collection">\n{inner}{pad}</{name}>\n'
        raise ValueError(f"{o[:40]} has no RDF/XML form")

    def item(x: str, pad: str) -> str:
        if terms.kind(x) == "bnode":
            return f"{pad}<rdf:Description rdf:nodeID={quoteattr(x[2:])}/>\n"
        if terms.kind(x) == "iri":
            return f"{pad}<rdf:Description rdf:about={quoteattr(x[1:-1])}/>\n"
        return f"{pad}<rdf:Description>\n{node(x, 'rdf:value', pad + '  ')}{pad}</rdf:Description>\n"

    body = ""
    for s, pairs in groups.items():
        about = f"rdf:nodeID={quoteattr(s[2:])}" if s.startswith("_:") else f"rdf:about={quoteattr(s[1:-1])}"
        body += f"  <rdf:Description {about}>\n" + "".join(node(o, tag(p), "    ") for p, o in pairs) + "  </rdf:Description>\n"
    heads = "".join(f"\n    xmlns:{p}={quoteattr(ns)}" for ns, p in spaces.items())
    return f'<?xml version="1.0"?>\n<rdf:RDF{heads}>\n{body}</rdf:RDF>\n'


def results_xml(rows: DataFrame, query) -> str:
    """SPARQL results in XML; ``rows`` holds term keys."""
    head = f'<?xml version="1.0"?>\n<sparql xmlns="{N.RESULTS}">\n'
    if query.form == "ask":
        return head + f"  <head/>\n  <boolean>{str(rows.first()[0]).lower()}</boolean>\n</sparql>\n"
    names = [v[1:] for v in query.variables]
    out = head + "  <head>" + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head>\n  <results>\n"
    for r in sorted(rows.collect(), key=lambda r: [x or "" for x in r]):
        out += "    <result>"
        for n in names:
            k = r[n]
            if k is None:
                continue
            if k.startswith("<"):
                cell = f"<uri>{escape(k[1:-1])}</uri>"
            elif k.startswith('"'):
                lex, dt, lang = terms.parts(k)
                about = f" datatype={quoteattr(dt)}" if dt else f" xml:lang={quoteattr(lang)}" if lang else ""
                cell = f"<literal{about}>{escape(lex)}</literal>"
            else:
                cell = f"<bnode>{escape(k.removeprefix('_:'))}</bnode>"
            out += f"<binding name={quoteattr(n)}>{cell}</binding>"
        out += "</result>\n"
    return out + "  </results>\n</sparql>\n"


def dot_of(quads: DataFrame) -> str:
    """Graphviz text: a node for each term, an arrow for each statement."""
    label = lambda k: terms.text(k).replace("\\", "\\\\").replace('"', '\\"')
    lines = [f'  "{label(s)}" -> "{label(o)}" [label="{label(p)}"];' for s, p, o in collected(quads)]
    return "digraph g {\n" + "\n".join(lines) + "\n}\n"
