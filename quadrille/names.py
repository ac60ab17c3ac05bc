"""Namespaces and well-known terms of the rule language.

Fixed values: rules and data in circulation use exactly these identifiers.
"""

from __future__ import annotations

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
LOG = "http://www.w3.org/2000/10/swap/log#"
LIST = "http://www.w3.org/2000/10/swap/list#"
SET = "http://www.w3.org/2000/10/swap/set#"
MATH = "http://www.w3.org/2000/10/swap/math#"
MATHS = "http://www.w3.org/2000/10/swap/maths#"
STRING = "http://www.w3.org/2000/10/swap/string#"
TIME = "http://www.w3.org/2000/10/swap/time#"
TIMES = "http://www.w3.org/2000/10/swap/times#"
OS = "http://www.w3.org/2000/10/swap/os#"
URI = "http://www.w3.org/2000/10/swap/uri#"
CRYPTO = "http://www.w3.org/2000/10/swap/crypto#"
SPARQL = "urn:quadrille:sparql#"
DOM = "http://www.w3.org/2007/ont/xml#"
FN = "http://www.w3.org/2006/xpath-functions#"
QL = "http://www.w3.org/2004/ql#"
REIFY = "http://www.w3.org/2004/06/rei#"
DELTA = "http://www.w3.org/2004/delta#"
REASON = "http://www.w3.org/2000/10/swap/reason#"
RESULTS = "http://www.w3.org/2005/sparql-results#"

PREFIXES = {
    "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "log": LOG, "list": LIST, "set": SET, "math": MATH, "maths": MATHS,
    "string": STRING, "time": TIME, "times": TIMES, "os": OS, "uri": URI, "crypto": CRYPTO, "sparql": SPARQL, "dom": DOM,
    "fn": FN, "ql": QL, "rei": REIFY, "delta": DELTA, "reason": REASON,
}


def expand(curie: str) -> str:
    """Full identifier of prefix:name."""
    prefix, _, name = curie.partition(":")
    return PREFIXES[prefix] + name


TYPE = f"<{RDF}type>"
FIRST, REST, NIL = f"<{RDF}first>", f"<{RDF}rest>", f"<{RDF}nil>"
SAME_AS = f"<{OWL}sameAs>"
ONE_OF = f"<{OWL}oneOf>"
IMPLIES = f"<{LOG}implies>"
BECOMES = f"<{LOG}becomes>"
TRUTH = f"<{LOG}Truth>"
CHAFF = f"<{LOG}Chaff>"
OUTPUT_STRING = f"<{LOG}outputString>"
INTEGER, DECIMAL, DOUBLE, BOOLEAN = XSD + "integer", XSD + "decimal", XSD + "double", XSD + "boolean"
DATE, DATE_TIME, XML_LITERAL = XSD + "date", XSD + "dateTime", RDF + "XMLLiteral"
INTEGER_FAMILY = tuple(
    XSD + t
    for t in (
        "integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger",
        "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
    )
)
FLOAT_FAMILY = (XSD + "double", XSD + "float")
