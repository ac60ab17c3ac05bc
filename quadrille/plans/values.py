"""Term-valued column expressions.

A ``Val`` is what a variable or constant is bound to: a column with a kind that
says how to read it. Table columns keep their native type until a term key is
needed, so joins and filters on them stay native and reach the scan.

Kinds: key (a term key), string, int, decimal, double, bool, time, array (of
doubles or strings), row (a table's row, named by its key column), num (a number
whose type differs by row; a term key once it is stored).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import names as N
from quadrille import terms

ROW_BASE = "table:"
_NUMBER = r"^\s*[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\s*$"


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


class Num:
    """A number whose type may differ by row: rank 0 integer, 1 decimal, 2 double."""

    def __init__(self, rank: int | Column, d: Column, n: Column | None = None, i: Column | None = None):
        self.rank, self.d = rank, d
        self.n = n if n is not None else null("decimal(38,18)")
        self.i = i if i is not None else null("decimal(38,0)")

    @staticmethod
    def join(nums: list[Num]) -> int | Column:
        ranks = [x.rank for x in nums]
        if all(isinstance(r, int) for r in ranks):
            return max(ranks)
        return F.greatest(*[F.lit(r) if isinstance(r, int) else r for r in ranks]) if len(ranks) > 1 else ranks[0]

    def val(self) -> Val:
        """The number as a term."""
        if isinstance(self.rank, int):
            return (Val("int", self.i), Val("decimal", self.n), Val("double", self.d))[self.rank]
        return Val("num", number=self)

    def key(self) -> Column:
        return F.when(self.rank == 0, int_key(self.i)).when(self.rank == 1, decimal_key(self.n)).when(self.rank == 2, double_key(self.d))

    @staticmethod
    def fold(nums: list[Num], op, start: int) -> Num:
        """Combine with a function of two columns, over every representation."""
        if not nums:
            return Num(0, F.lit(float(start)), F.lit(start).cast("decimal(38,18)"), F.lit(start).cast("decimal(38,0)"))
        return Num(Num.join(nums), reduce(op, [x.d for x in nums]), reduce(op, [x.n for x in nums]), reduce(op, [x.i for x in nums]))


def int_key(i: Column) -> Column:
    return terms.literal_key(i.cast("string"), N.INTEGER)


def decimal_text(n: Column) -> Column:
    """Without trailing zeros but with one digit behind the point."""
    s = F.regexp_replace(n.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def decimal_key(n: Column) -> Column:
    return terms.literal_key(decimal_text(n), N.DECIMAL)


def double_key(d: Column) -> Column:
    return F.when(~F.isnan(d), terms.literal_key(d.cast("string"), N.DOUBLE))


def time_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def lexical_number(lex: Column, dt: Column | None = None) -> Num:
    """A lexical form as a number: by its datatype if numeric, else by its look; null where it is none."""
    looks = F.when(~lex.rlike(_NUMBER), null("int")).when(lex.rlike("[eE]"), 2).when(lex.contains("."), 1).otherwise(0)
    rank = looks
    if dt is not None:
        typed = F.when(dt.isin(*N.INTEGER_FAMILY), 0).when(dt == N.DECIMAL, 1).when(dt.isin(*N.FLOAT_FAMILY), 2)
        rank = F.when(looks.isNotNull(), F.coalesce(typed, looks))
    text = F.trim(lex)
    return Num(
        rank,
        F.when(looks.isNotNull(), text.try_cast("double")),
        F.when(looks.isNotNull(), text.try_cast("decimal(38,18)")),
        F.when(looks == 0, text.try_cast("decimal(38,0)")),
    )


class Val:
    def __init__(self, kind: str, col: Column | None = None, table: str = "", items: list[Val] | None = None, const: str | None = None, number: Num | None = None):
        self.kind, self._col, self.table, self.items, self.const, self.number = kind, col, table, items, const, number

    @property
    def col(self) -> Column:
        """The column; a constant's is made when asked for, as columns need a session."""
        if self._col is None and self.const is not None:
            self._col = F.lit(self.const)
        if self._col is None and self.number is not None:
            self._col = self.number.key()
        return self._col

    # constructors

    @staticmethod
    def constant(key: str) -> Val:
        return Val("key", const=key)

    @staticmethod
    def of_type(kind: T.DataType, col: Column) -> Val | None:
        """A table column as a term; None for types that are no terms."""
        if isinstance(kind, T.StringType):
            return Val("string", col)
        if isinstance(kind, T.IntegralType):
            return Val("int", col)
        if isinstance(kind, T.FloatType):
            return Val("double", col.cast("double"))
        if isinstance(kind, T.DoubleType):
            return Val("double", col)
        if isinstance(kind, T.DecimalType):
            return Val("decimal", col)
        if isinstance(kind, T.BooleanType):
            return Val("bool", col)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return Val("time", col)
        if isinstance(kind, T.DateType):
            return Val("key", terms.literal_key(col.cast("string"), N.DATE))
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, T.NumericType):
                return Val("array", F.transform(col, lambda x: x.cast("double")), table="double")
            if isinstance(inner, T.StringType):
                return Val("array", col, table="string")
        return None

    @staticmethod
    def list_of(items: list[Val]) -> Val:
        return Val("list", items=items)

    @staticmethod
    def text(col: Column) -> Val:
        return Val("string", col)

    # views

    def key(self) -> Column:
        if self.kind == "list":
            return terms.list_key(F.array(*[v.key() for v in self.items])) if self.items else F.lit("[]")
        if self.kind == "string":
            return terms.literal_key(self.col)
        if self.kind == "int":
            return int_key(self.col)
        if self.kind == "decimal":
            return decimal_key(self.col)
        if self.kind == "double":
            return double_key(self.col)
        if self.kind == "bool":
            return terms.literal_key(self.col.cast("string"), N.BOOLEAN)
        if self.kind == "time":
            return terms.literal_key(time_text(self.col), N.DATE_TIME)
        if self.kind == "array":
            return terms.list_key(F.transform(self.col, lambda x: Val(self.table, x).key()))
        if self.kind == "row":
            return F.concat(F.lit(f"<{ROW_BASE}{self.table}/"), self.col.cast("string"), F.lit(">"))
        return self.col

    def lex(self) -> Column:
        """Lexical form of a literal; null for other terms."""
        if self.const is not None:
            return F.lit(terms.parts(self.const)[0]) if terms.kind(self.const) == "literal" else null()
        if self.kind == "string":
            return self.col
        if self.kind in ("int", "bool"):
            return self.col.cast("string")
        if self.kind == "double":
            return self.col.cast("string")
        if self.kind == "decimal":
            return decimal_text(self.col)
        if self.kind == "time":
            return time_text(self.col)
        if self.kind in ("row", "array", "list"):
            return null()
        if self.kind == "num":
            x = self.number
            return F.when(x.rank == 0, x.i.cast("string")).when(x.rank == 1, decimal_text(x.n)).when(x.rank == 2, x.d.cast("string"))
        return terms.string_of(self.col)

    def num(self) -> Num:
        """The number, or nulls."""
        if self.number is not None:
            return self.number
        if self.const is not None:
            if terms.kind(self.const) != "literal":
                return Num(0, null("double"))
            lex, dt, _ = terms.parts(self.const)
            rank = 0 if dt in N.INTEGER_FAMILY else 1 if dt == N.DECIMAL else 2 if dt in N.FLOAT_FAMILY else None
            try:
                d = float(lex)
            except ValueError:
                return Num(0, null("double"))
            if rank is None:
                rank = 2 if "e" in lex.lower() else 1 if "." in lex else 0
            exact = F.lit(lex.strip())
            return Num(
                rank,
                F.lit(d),
                exact.try_cast("decimal(38,18)") if rank < 2 else None,
                exact.try_cast("decimal(38,0)") if rank == 0 else None,
            )
        if self.kind == "int":
            return Num(0, self.col.cast("double"), self.col.cast("decimal(38,18)"), self.col.cast("decimal(38,0)"))
        if self.kind == "decimal":
            return Num(1, self.col.cast("double"), self.col.cast("decimal(38,18)"))
        if self.kind == "double":
            return Num(2, self.col)
        if self.kind == "key":
            return lexical_number(terms.string_of(self.col), terms.datatype_of(self.col))
        if self.kind == "string":
            return lexical_number(self.col)
        return Num(0, null("double"))

    def double(self) -> Column:
        """The value as a float, whatever its type; null for what is no number."""
        if self.kind in ("double", "int", "decimal"):
            return self.col.cast("double")
        if self.const is not None or self.number is not None:
            return self.num().d
        return F.trim(self.lex()).try_cast("double")

    def elements(self) -> list[Val] | None:
        """Members, where they are known when the plan is made."""
        if self.kind == "list":
            return self.items
        if self.const is not None and terms.kind(self.const) in ("list", "set"):
            return [Val.constant(k) for k in terms.members(self.const)]
        return None

    def element_keys(self) -> Column:
        """Members' keys as an array; null for what is no list or set."""
        known = self.elements()
        if known is not None:
            return F.array(*[v.key() for v in known]).cast("array<string>")
        if self.kind == "array":
            return F.transform(self.col, lambda x: Val(self.table, x).key())
        return terms.items_of(self.col) if self.kind == "key" else null("array<string>")

    def member(self, place: int) -> Val:
        known = self.elements()
        if known is not None:
            return known[place] if place < len(known) else Val("key", null())
        if self.kind == "array":
            return Val(self.table, F.get(self.col, F.lit(place)))
        return Val("key", F.get(self.element_keys(), F.lit(place)))

    def exact(self, n: int) -> list[Val]:
        """The members of a list of n; nulls where there are not n."""
        known = self.elements()
        if known is not None:
            return known if len(known) == n else [Val("key", null())] * n
        keys = self.element_keys()
        return [Val("key", F.when(F.size(keys) == n, F.get(keys, F.lit(i)))) for i in range(n)]

    def present(self) -> Column:
        if self.kind == "list":
            return reduce(lambda a, b: a & b, [v.present() for v in self.items], F.lit(True))
        return self.key().isNotNull() if self.kind in ("double",) else self.col.isNotNull()


def same(a: Val, b: Val) -> Column:
    """Term identity; native where both sides have the same kind."""
    if a.kind == b.kind and a.kind in ("string", "int", "bool", "time", "key"):
        return a.col == b.col
    if a.kind == b.kind == "double":
        return a.col == b.col
    if a.kind == b.kind == "row":
        return a.col == b.col if a.table == b.table else F.lit(False)
    for x, y in ((a, b), (b, a)):
        if x.const is not None and terms.kind(x.const) == "literal":
            lex, dt, lang = terms.parts(x.const)
            if y.kind == "string":
                return y.col == F.lit(lex) if dt is None and lang is None else F.lit(False)
            if y.kind == "int" and dt == N.INTEGER and lex.lstrip("-").isdigit() and len(lex) < 18:
                return y.col == F.lit(int(lex)) if str(int(lex)) == lex else F.lit(False)
    return a.key() == b.key()
