"""What rules and queries run over: quads, and relational tables seen as triples.

``quads`` has string columns g, s, p, o (term keys; g is "" for the default graph,
else the key of a graph used as a term, or a graph's name). A table is never
unfolded into triples: its rows are subjects ``<table:NAME/KEY>``, its columns
predicates ``<table:NAME#COLUMN>``, and a foreign key's object is the row that it
points at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import terms
from quadrille.plans.formula import Formula
from quadrille.plans.values import ROW_BASE, Val

QUADS = "g string, s string, p string, o string"


@dataclass
class Table:
    """A relational table. Without a key, a row is named by a hash of all its columns."""

    name: str
    df: DataFrame
    key: str | None = None
    points_at: dict[str, str] = field(default_factory=dict)

    def row(self, df: DataFrame | None = None) -> Column:
        if self.key:
            return F.col(self.key)
        columns = [F.col(c) for c in self.df.columns]
        return F.concat(F.hex(F.xxhash64(*columns)), F.hex(F.xxhash64(F.lit(1), *columns)))

    def predicate(self, column: str) -> str:
        return f"<{ROW_BASE}{self.name}#{column}>"

    def object(self, column: str) -> Val | None:
        if column in self.points_at:
            return Val("row", F.col(column), table=self.points_at[column])
        return Val.of_type(self.df.schema[column].dataType, F.col(column))


class Dataset:
    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, tables: dict[str, Table] | None = None):
        self.spark = spark
        self.quads = quads if quads is not None else spark.createDataFrame([], QUADS)
        self.tables = tables or {}
        self.formulas: dict[str, Formula] = {}
        self.predicates = {t.predicate(c): (t, c) for t in self.tables.values() for c in t.df.columns}

    @staticmethod
    def of(spark: SparkSession, formula: Formula, graph: str = "") -> Dataset:
        """From a parsed document."""
        from quadrille.sources.n3 import rows

        found = rows(formula, graph)
        ds = Dataset(spark, spark.createDataFrame(found or [], QUADS))
        ds.remember(formula)
        return ds

    def replace(self, quads: DataFrame) -> Dataset:
        out = Dataset(self.spark, quads, self.tables)
        out.formulas = self.formulas
        return out

    def remember(self, formula: Formula) -> None:
        """Keep the formulae inside a document at hand, by key."""

        def inner(term) -> None:
            if isinstance(term, Formula):
                self.formulas.setdefault(term.key(), term)
                self.remember(term)
            elif not isinstance(term, str):
                for t in term.items:
                    inner(t)

        for st in formula.statements:
            for t in st:
                inner(t)

    def register(self, formula: Formula) -> str:
        """Make a formula available as a graph; returns its key."""
        from quadrille.sources.n3 import rows

        key = formula.key()
        if key not in self.formulas:
            self.formulas[key] = formula
            self.remember(formula)
            found = rows(formula, key)
            if found:
                self.quads = self.quads.unionByName(self.spark.createDataFrame(found, QUADS))
        return key

    def formula(self, key: str, limit: int = 100_000) -> Formula:
        """The graph with a key, as a formula; read from the quads if need be."""
        if key not in self.formulas:
            rows = self.quads.where(F.col("g") == key).select("s", "p", "o").limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"graph {key} has over {limit} statements: too large to be used as a term")
            self.formulas[key] = Formula([self._inner(r) for r in rows])
        return self.formulas[key]

    def _inner(self, row) -> tuple:
        return tuple(self.formula(t) if t.startswith("{") else t for t in row)

    def table_of(self, predicate: object) -> tuple[Table, str] | None:
        return self.predicates.get(predicate) if isinstance(predicate, str) else None


def unfold(table: Table, graph: str = "") -> DataFrame:
    """A table's rows as quads: for exports and for queries with a variable predicate."""
    subject = F.concat(F.lit(f"<{ROW_BASE}{table.name}/"), table.row().cast("string"), F.lit(">"))
    cells = []
    for c in table.df.columns:
        v = table.object(c)
        if v is not None:
            cells.append(F.struct(F.lit(table.predicate(c)).alias("p"), v.key().alias("o")))
    rows = table.df.select(subject.alias("s"), F.explode(F.array(*cells)).alias("c"))
    return rows.select(F.lit(graph).alias("g"), "s", "c.p", "c.o").where("o is not null")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def constant_quads(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, QUADS)


def table_quads(ds: Dataset) -> DataFrame:
    """Quads of a data set with every table unfolded."""
    return union_all([ds.quads, *[unfold(t) for t in ds.tables.values()]])


def prefix(name: str) -> str:
    """The namespace of a table's columns."""
    return f"{ROW_BASE}{name}#"


__all__ = ["QUADS", "Dataset", "Table", "constant_quads", "prefix", "table_quads", "terms", "unfold", "union_all"]
