"""A graph with the usual calls, over DataFrames.

    g = Graph.load(spark, "data.n3")
    g.any(s="<urn:a>", p="<urn:p>")
    g.think("rules.n3").query("select ...")
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.operators import graphs as operators
from quadrille.operators.lists import fold_lists
from quadrille.plans import graphs as _graph_builtins  # noqa: F401
from quadrille.plans import rules, sparql
from quadrille.plans.data import QUADS, Dataset
from quadrille.plans.formula import Formula
from quadrille.sources import n3, writers
from quadrille.sources.documents import load, load_many


class Namespace:
    """Names below a prefix: Namespace("urn:x#").name is a key."""

    def __init__(self, uri: str):
        self._uri = uri

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return terms.iri(self._uri + name)

    def __getitem__(self, name: str) -> str:
        return terms.iri(self._uri + name)


class Graph:
    def __init__(self, ds: Dataset, prefixes: dict[str, str] | None = None, formula: Formula | None = None):
        self.ds, self.prefixes, self.formula = ds, prefixes or {}, formula

    # making one

    @staticmethod
    def parse(spark: SparkSession, text: str, base: str = "") -> Graph:
        f = n3.parse(text, base)
        return Graph(Dataset.of(spark, f), f.prefixes, f)

    @staticmethod
    def load(spark: SparkSession, *addresses: str) -> Graph:
        f = load(addresses[0]) if len(addresses) == 1 else load_many(list(addresses))
        return Graph(Dataset.of(spark, f), f.prefixes, f)

    @staticmethod
    def of(quads: DataFrame) -> Graph:
        return Graph(Dataset(quads.sparkSession, quads))

    # reading

    @property
    def quads(self) -> DataFrame:
        return self.ds.quads

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str = "") -> DataFrame:
        """Statements with the given terms."""
        df = self.quads.where(F.col("g") == g)
        for c, k in (("s", s), ("p", p), ("o", o)):
            if k is not None:
                df = df.where(F.col(c) == k)
        return df.select("s", "p", "o")

    def contains(self, s: str | None = None, p: str | None = None, o: str | None = None) -> bool:
        return not self.match(s, p, o).isEmpty()

    def _open(self, s, p, o) -> str:
        free = [c for c, k in (("s", s), ("p", p), ("o", o)) if k is None]
        if len(free) != 1:
            raise ValueError("give two of the three terms")
        return free[0]

    def each(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """All values of the term that is not given."""
        return self.match(s, p, o).select(F.col(self._open(s, p, o)).alias("value")).distinct()

    def any(self, s: str | None = None, p: str | None = None, o: str | None = None) -> str | None:
        """One value of the term that is not given (the least), or None."""
        r = self.each(s, p, o).agg(F.min("value")).first()
        return r[0]

    def the(self, s: str | None = None, p: str | None = None, o: str | None = None) -> str | None:
        """The value of the term that is not given; more than one is an error."""
        found = self.each(s, p, o).limit(2).collect()
        if len(found) > 1:
            raise ValueError("more than one value")
        return found[0][0] if found else None

    def size(self) -> int:
        return self.quads.where("g = ''").distinct().count()

    # writing

    def _with(self, quads: DataFrame) -> Graph:
        return Graph(self.ds.replace(quads), self.prefixes, self.formula)

    def add(self, *statements: tuple[str, str, str]) -> Graph:
        rows = self.ds.spark.createDataFrame([("", *st) for st in statements], QUADS)
        return self._with(self.quads.unionByName(rows).distinct())

    def remove(self, *statements: tuple[str, str, str]) -> Graph:
        rows = self.ds.spark.createDataFrame([("", *st) for st in statements], QUADS)
        return self._with(self.quads.join(rows, ["g", "s", "p", "o"], "left_anti"))

    def substitute(self, mapping: dict[str, str]) -> Graph:
        df = self.quads
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        for c in ("s", "p", "o"):
            df = df.withColumn(c, F.coalesce(table[F.col(c)], F.col(c)))
        return self._with(df.distinct())

    def merge(self, other: Graph) -> Graph:
        return self._with(self.quads.unionByName(other.quads).distinct())

    # rules and queries

    def _rules(self, source: str | Formula | None) -> list[rules.Rule]:
        f = self.formula if source is None else n3.parse(source) if isinstance(source, str) else source
        self.ds.remember(f)
        return rules.rules_of(f)

    def think(self, source: str | Formula | None = None, **how) -> Graph:
        """Rules (the graph's own, if none are given) to a fixpoint."""
        return Graph(rules.think(self.ds, self._rules(source), **how), self.prefixes, self.formula)

    def apply(self, source: str | Formula | None = None) -> Graph:
        return Graph(rules.apply_rules(self.ds, self._rules(source)), self.prefixes, self.formula)

    def filter(self, source: str | Formula) -> Graph:
        return Graph(rules.filter_rules(self.ds, self._rules(source)), self.prefixes)

    def solve(self, source: str | Formula) -> Graph:
        """Its own rules to a fixpoint, then only what the given rules conclude."""
        return self.think().filter(source)

    def select_where(self, source: str | Formula) -> Graph:
        f = n3.parse(source) if isinstance(source, str) else source
        return Graph(rules.filter_rules(self.ds, rules.ql_rules(f)), self.prefixes)

    def sparql(self, text: str, native: bool = True) -> DataFrame:
        q = sparql.parse(text)
        return sparql.construct(self.ds, q) if q.form in ("construct", "describe") else sparql.select(self.ds, q, native)

    def sparql_xml(self, text: str) -> str:
        q = sparql.parse(text)
        return writers.results_xml(sparql.select(self.ds, q, native=False), q)

    def patch(self, source: str | Formula) -> Graph:
        f = n3.parse(source) if isinstance(source, str) else source
        return Graph(operators.patch(self.ds, f), self.prefixes)

    def diff(self, other: Graph) -> tuple[DataFrame, DataFrame]:
        return operators.difference(self.quads, other.quads)

    def why(self, source: str | Formula | None = None) -> DataFrame:
        return rules.explained(self.ds, self._rules(source))

    def smush(self) -> Graph:
        return self._with(operators.smush(self.quads))

    def purge(self) -> Graph:
        return self._with(operators.purge(self.quads))

    def data(self) -> Graph:
        return self._with(operators.data_only(self.quads))

    def fold(self) -> Graph:
        return self._with(fold_lists(self.quads))

    # output

    def n3(self, flags: str = "") -> str:
        rows = writers.collected(self.quads)
        inner = [tuple(self.ds.formula(t) if t.startswith("{") else t for t in st) for st in rows]
        return writers.N3Writer(self.prefixes, flags).document(inner)

    def ntriples(self) -> DataFrame:
        return writers.ntriples(self.quads)

    def rdfxml(self) -> str:
        return writers.rdfxml_of(self.quads, self.prefixes)

    def strings(self) -> str:
        return "".join(r["value"] for r in writers.output_strings(self.quads).collect())

    def dot(self) -> str:
        return writers.dot_of(self.quads)
