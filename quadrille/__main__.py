"""Command line: inputs and steps from left to right, then the output.

    python -m quadrille data.n3 --think=rules.n3 --filter=report.n3 --strings

Inputs: a path or data: address (merged). Steps: --think[=FILE] --rules
--apply=FILE --filter=FILE --solve=FILE --query=FILE (ql:select) --sparql=FILE
--patch=FILE --diff=FILE --why[=FILE] --purge --data --reify --dereify --flatten
--unflatten --smush --fold. Output: --n3[=FLAGS] (default) --ntriples --rdf
--strings --sparqlResults --dot --size --no. --with ARGS: what os:argv gives.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quadrille.functions import system
from quadrille.graph import Graph
from quadrille.operators.reify import dereify, flatten, reify, unflatten
from quadrille.plans.data import Dataset
from quadrille.plans.formula import Formula
from quadrille.sources import writers
from quadrille.sources.documents import load, read_text


def as_formula(g: Graph) -> Formula:
    rows = writers.collected(g.quads)
    return Formula([tuple(g.ds.formula(t) if t.startswith("{") else t for t in st) for st in rows], prefixes=g.prefixes)


def from_formula(spark: SparkSession, f: Formula) -> Graph:
    return Graph(Dataset.of(spark, f), f.prefixes, f)


def run(spark: SparkSession, args: list[str]) -> str:
    """The output of a command line."""
    g = from_formula(spark, Formula())
    shown, result = "n3", None
    flags = ""
    i = 0
    while i < len(args):
        step, _, value = args[i].partition("=")
        i += 1
        if not step.startswith("--"):
            more = Graph.load(spark, args[i - 1])
            merged = Formula([*(g.formula.statements if g.formula else []), *more.formula.statements], prefixes=g.prefixes | more.prefixes)
            ds = g.ds.replace(g.quads.unionByName(more.quads).distinct())
            ds.formulas |= more.ds.formulas
            g = Graph(ds, merged.prefixes, merged)
        elif step == "--with":
            system.ARGUMENTS[:] = args[i:]
            break
        elif step in ("--think", "--rules", "--apply", "--filter", "--solve", "--why"):
            source = load(value) if value else None
            if step == "--think":
                g = g.think(source)
            elif step in ("--rules", "--apply"):
                g = g.apply(source)
            elif step == "--why":
                result = "\n".join(f"{r['s']} {r['p']} {r['o']} by {r['rule']} from {'; '.join(r['evidence'])}" for r in g.why(source).orderBy("s", "p", "o").collect())
            else:
                g = g.filter(source) if step == "--filter" else g.solve(source)
        elif step == "--query":
            g = g.select_where(load(value))
        elif step == "--sparql":
            text = read_text(value)
            from quadrille.plans import sparql

            if sparql.parse(text).form in ("construct", "describe"):
                g = Graph(g.ds.replace(g.sparql(text)), g.prefixes)
            else:
                result = g.sparql_xml(text)
        elif step == "--patch":
            g = g.patch(load(value))
        elif step == "--diff":
            other = Graph.load(spark, value)
            gone, new = g.diff(other)
            sides = [("-", r) for r in writers.collected(gone)] + [("+", r) for r in writers.collected(new)]
            result = "\n".join(f"{mark} {' '.join(r)}" for mark, r in sides)
        elif step in ("--purge", "--data", "--smush", "--fold"):
            g = getattr(g, step[2:])()
        elif step in ("--reify", "--dereify", "--flatten", "--unflatten"):
            f = as_formula(g)
            done = {"--reify": lambda: reify(f)[0], "--dereify": lambda: dereify(f)[0], "--flatten": lambda: flatten(f), "--unflatten": lambda: unflatten(f)}[step]()
            g = from_formula(spark, done)
        elif step in ("--n3", "--ntriples", "--rdf", "--strings", "--dot", "--size", "--no", "--sparqlResults"):
            shown, flags = step[2:], value
        else:
            raise SystemExit(f"unknown step {step}\n{__doc__}")
    if result is not None:
        return result
    if shown == "ntriples":
        return "".join(sorted(r["value"] + "\n" for r in g.ntriples().collect()))
    if shown == "size":
        return str(g.size())
    if shown in ("no", "sparqlResults"):
        return ""
    return {"n3": lambda: g.n3(flags), "rdf": g.rdfxml, "strings": g.strings, "dot": g.dot}[shown]()


def main() -> None:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.stdout.write(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
