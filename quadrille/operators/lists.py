"""Lists and sets between their two forms: one term, or cells with rdf:first and rdf:rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille import terms
from quadrille.storage import materialize


def unfold_lists(quads: DataFrame) -> DataFrame:
    """Quads with every list written as cells (blank nodes named by the list's text); one pass per nesting level."""
    done, todo = None, quads.select("g", "s", "p", "o")
    while True:
        is_list = lambda c: F.col(c).startswith("[") & (F.col(c) != "[]")
        name = lambda k: F.when(k == "[]", F.lit(N.NIL)).otherwise(F.concat(F.lit("_:l"), F.substring(F.sha2(k, 256), 1, 24)))
        swap = lambda c: F.when(F.col(c).startswith("["), name(F.col(c))).otherwise(F.col(c))
        flat = todo.select("g", swap("s").alias("s"), "p", swap("o").alias("o"))
        done = flat if done is None else done.unionByName(flat)
        held = todo.select("g", F.explode(F.array("s", "o")).alias("k")).where(is_list("k")).distinct()
        held = materialize(held, "lists")
        if held.isEmpty():
            return done
        keys = terms.items_of(F.col("k"))
        cells = held.select("g", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.slice(keys, i, F.size(keys)))).alias("i", "tail"))
        cell = terms.list_key(F.col("tail"))
        rest = F.slice("tail", F.lit(2), F.size("tail"))
        rows = cells.select(
            "g",
            name(cell).alias("s"),
            F.explode(
                F.array(
                    F.struct(F.lit(N.FIRST).alias("p"), F.get("tail", F.lit(0)).alias("o")),
                    F.struct(F.lit(N.REST).alias("p"), name(terms.list_key(rest)).alias("o")),
                )
            ).alias("c"),
        )
        todo = materialize(rows.select("g", "s", "c.p", "c.o").distinct(), "cells")


def _positions(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """Cells (g, s, first, rest) with start, the cell their run begins at, and place, their distance from it.

    Each cell that is no start has one cell before it. Pointers back to it double
    each round, so rounds grow with the logarithm of a list's length. Cells on a
    ring without a start are left out.
    """
    marked = cells.join(starts.withColumn("begins", F.lit(True)), ["g", "s"], "left")
    before = cells.select("g", F.col("rest").alias("s"), F.col("s").alias("before"))
    back = marked.join(before, ["g", "s"], "left").select(
        "g", "s", F.when(F.col("begins"), F.col("s")).otherwise(F.col("before")).alias("start"),
        F.when(F.col("begins"), 0).otherwise(1).cast("long").alias("place"), F.coalesce("begins", F.lit(False)).alias("done"),
    ).dropDuplicates(["g", "s"])
    now = materialize(back, "runs")
    n = now.count()
    for _ in range(n.bit_length() + 1):
        if now.where("not done").isEmpty():
            break
        there = now.select("g", F.col("s").alias("start"), F.col("start").alias("next"), F.col("place").alias("more"), F.col("done").alias("end"))
        moved = now.where("not done").join(there, ["g", "start"]).select("g", "s", F.col("next").alias("start"), (F.col("place") + F.col("more")).alias("place"), F.col("end").alias("done"))
        now = materialize(now.where("done").unionByName(moved), "runs")
    return cells.join(now.where("done").select("g", "s", "start", "place"), ["g", "s"])


def fold_lists(quads: DataFrame) -> DataFrame:
    """Quads with chains of cells that end in nil replaced by list terms, and owl:oneOf lists by sets.

    A run of cells begins where anything but one rest points, or something else
    is said, and ends at nil or at the next run; places in runs come from pointer
    doubling. A round then folds every run whose inner lists and next run are
    folded, so rounds follow the depth of nesting, not the length of lists.
    Cells with more than one first or rest are left alone.
    """
    quads = materialize(quads.select("g", "s", "p", "o"), "quads")  # read several times
    first = quads.where(F.col("p") == N.FIRST).groupBy("g", "s").agg(F.min("o").alias("first"), F.count_distinct("o").alias("n1"))
    rest = quads.where(F.col("p") == N.REST).groupBy("g", "s").agg(F.min("o").alias("rest"), F.count_distinct("o").alias("n2"))
    nil = lambda c: F.when(F.col(c) == N.NIL, "[]").otherwise(F.col(c))
    cells = first.join(rest, ["g", "s"]).where("n1 = 1 and n2 = 1 and s like '\\_:%'").select("g", "s", nil("first").alias("first"), nil("rest").alias("rest"))
    cells = materialize(cells, "cells")
    if cells.isEmpty():
        return _sets(_nil(quads).select("g", "s", "p", "o"))
    names = cells.select("g", "s")
    follows = cells.groupBy("g", F.col("rest").alias("s")).agg(F.count("*").alias("n")).where("n = 1").select("g", "s")
    shown = quads.where(F.col("p") != N.REST).select("g", F.col("o").alias("s")).unionByName(quads.where(~F.col("p").isin(N.FIRST, N.REST)).select("g", "s"))
    starts = names.join(follows, ["g", "s"], "left_anti").unionByName(names.join(shown, ["g", "s"], "left_semi")).distinct()
    placed = materialize(_positions(cells, materialize(starts, "starts")), "placed")
    heads = starts.select("g", F.col("s").alias("first"), F.lit(True).alias("nested"))
    todo = materialize(placed.join(heads, ["g", "first"], "left").select("g", "s", "start", "place", "first", "rest", "nested"), "open-lists")
    known = None
    while True:
        rows = todo.withColumn("item", F.when(F.col("nested").isNull(), F.col("first")))
        if known is not None:
            rows = todo.join(known.select("g", F.col("start").alias("first"), F.col("list").alias("inner")), ["g", "first"], "left").withColumn("item", F.when(F.col("nested"), F.col("inner")).otherwise(F.col("first")))
        runs = rows.groupBy("g", "start").agg(
            F.count_if(F.col("item").isNull()).alias("open"), F.max_by("rest", "place").alias("end"), F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items")
        ).where("open = 0")
        items = F.transform("items", lambda x: x["item"])
        tail = F.when(F.col("end") == "[]", F.array().cast("array<string>"))
        if known is not None:
            runs = runs.join(known.select("g", F.col("start").alias("end"), F.col("list").alias("rest_list")), ["g", "end"], "left")
            tail = tail.otherwise(terms.items_of(F.col("rest_list")))
        ready = runs.select("g", "start", terms.list_key(F.concat(items, tail)).alias("list")).where("list is not null")
        ready = materialize(ready, "folded")
        if ready.isEmpty():
            break
        known = ready if known is None else materialize(known.unionByName(ready), "known-lists")
        todo = materialize(todo.join(ready.select("g", "start"), ["g", "start"], "left_anti"), "open-lists")
    if known is None:
        return _sets(_nil(quads).select("g", "s", "p", "o"))
    folded = materialize(placed.join(known.select("g", "start"), ["g", "start"], "left_semi").select("g", "s"), "folded-cells")
    left = quads.join(folded.withColumn("__cell", F.lit(True)), ["g", "s"], "left").where(F.col("__cell").isNull() | ~F.col("p").isin(N.FIRST, N.REST)).select("g", "s", "p", "o")
    used = known.select("g", F.col("start").alias("node"), "list")
    out = _renamed(_renamed(left, used, "s"), used, "o")
    return _sets(_nil(out).select("g", "s", "p", "o"))


def _renamed(rows: DataFrame, used: DataFrame, column: str) -> DataFrame:
    m = used.select(F.col("g").alias("__g"), F.col("node").alias("__node"), F.col("list").alias("__list"))
    joined = rows.join(m, (F.col("g") == F.col("__g")) & (F.col(column) == F.col("__node")), "left")
    return joined.withColumn(column, F.coalesce("__list", column)).drop("__g", "__node", "__list")


def _nil(rows: DataFrame) -> DataFrame:
    return rows.withColumn("s", F.when(F.col("s") == N.NIL, "[]").otherwise(F.col("s"))).withColumn("o", F.when(F.col("o") == N.NIL, "[]").otherwise(F.col("o")))


def _sets(rows: DataFrame) -> DataFrame:
    """A blank node that is owl:oneOf a list stands for the set of its members."""
    found = rows.where((F.col("p") == N.ONE_OF) & F.col("o").startswith("[") & F.col("s").startswith("_:"))
    sets = found.groupBy("g", F.col("s").alias("node")).agg(F.min(terms.set_key(terms.items_of(F.col("o")))).alias("list"))
    left = rows.join(sets.select("g", F.col("node").alias("s"), F.lit(N.ONE_OF).alias("p")), ["g", "s", "p"], "left_anti").select("g", "s", "p", "o")
    return _renamed(_renamed(left, sets, "s"), sets, "o").select("g", "s", "p", "o").distinct()
