"""Operators on whole data sets of quads: purge, equality merging, diff, patch, canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille import names as N
from quadrille.operators.components import connected_components
from quadrille.plans.data import Dataset
from quadrille.plans.formula import Formula, bnodes
from quadrille.plans.match import Matcher, body_of
from quadrille.plans.rules import Rule, conclusions
from quadrille.storage import materialize

INSERTION, DELETION = f"<{N.DELTA}insertion>", f"<{N.DELTA}deletion>"
KEY = ["g", "s", "p", "o"]


def purge(quads: DataFrame, chaff: str = N.CHAFF) -> DataFrame:
    """Without the statements that mention a member of the class, in any place."""
    bad = quads.where((F.col("p") == N.TYPE) & (F.col("o") == chaff)).select(F.col("s").alias("x")).distinct()
    for c in ("s", "p", "o"):
        quads = quads.join(bad.withColumnRenamed("x", c), c, "left_anti")
    return quads.where(F.col("o") != chaff).select(*KEY)


def data_only(quads: DataFrame) -> DataFrame:
    """Without the statements that hold a quoted graph or a variable: no rules."""
    clean = lambda c: ~F.col(c).startswith("{") & ~F.col(c).startswith("?")
    return quads.where(clean("s") & clean("p") & clean("o") & (F.col("g") == ""))


def smush(quads: DataFrame, same: str = N.SAME_AS) -> DataFrame:
    """One name for equal nodes: no blank node if there is another, then the smallest (IRIs compare without brackets)."""
    pairs = quads.where((F.col("p") == same) & (F.col("s") != F.col("o"))).select("s", "o")
    # the closing bracket is left out, as it sorts after digits: <a/1> comes before <a/10>
    ranked = lambda c: F.concat(F.when(F.col(c).startswith("_:"), "1").otherwise("0"), F.when(F.col(c).startswith("<"), F.expr(f"left({c}, length({c}) - 1)")).otherwise(F.col(c)))
    term = lambda c: F.concat(F.expr(f"substring({c}, 2)"), F.when(F.col(c).startswith("0<"), ">").otherwise(""))
    parts = connected_components(pairs.select(ranked("s").alias("src"), ranked("o").alias("dst")))
    names = materialize(parts.select(term("node").alias("x"), term("component").alias("y")).where("x != y"), "names")
    out = quads
    for c in ("s", "p", "o"):
        out = out.join(names.select(F.col("x").alias(c), F.col("y").alias("__y")), c, "left").withColumn(c, F.coalesce("__y", c)).drop("__y")
    return out.where(~((F.col("p") == same) & (F.col("s") == F.col("o")))).select(*KEY).distinct()


# --- canonical names -------------------------------------------------------------------------------------------------


def _is_blank(c: str) -> Column:
    return F.col(c).startswith("_:")


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, rows with names) of quads with a column side: colours refined until no class splits.

    Sides share no node and are refined together, so their colours compare.
    names has side, x, its name y, and whether it is tied with another node of its side.
    """
    nodes = rows.select("side", F.explode(F.array("s", "o")).alias("x")).where(_is_blank("x")).distinct()
    colour = nodes.select("side", "x", F.lit("_").alias("c"))
    kept = -1
    while True:
        colour = materialize(colour, "colours")
        n = colour.select("c").distinct().count()
        if n == kept:
            break
        kept = n
        shown = rows
        for k in ("s", "o"):
            m = colour.select("side", F.col("x").alias(k), F.col("c").alias(f"{k}c"))
            shown = shown.join(m, ["side", k], "left").withColumn(f"{k}c", F.coalesce(f"{k}c", k))
        out_side = shown.where(_is_blank("s")).select("side", F.col("s").alias("x"), F.sha2(F.concat_ws("\u0001", F.lit(">"), "g", "p", F.when(F.col("s") == F.col("o"), "*").otherwise(F.col("oc"))), 256).alias("h"))
        in_side = shown.where(_is_blank("o")).select("side", F.col("o").alias("x"), F.sha2(F.concat_ws("\u0001", F.lit("<"), "g", "p", F.when(F.col("s") == F.col("o"), "*").otherwise(F.col("sc"))), 256).alias("h"))
        # a sum of hashes does not depend on order and combines before the shuffle
        sums = out_side.unionByName(in_side).withColumn("n", F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)"))
        sums = sums.groupBy("side", "x").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
        colour = sums.join(colour, ["side", "x"]).select("side", "x", F.substring(F.sha2(F.concat_ws("|", "c", F.col("n").cast("string"), F.col("k").cast("string")), 256), 1, 24).alias("c"))
    place = F.row_number().over(Window.partitionBy("side", "c").orderBy("x"))
    tied = colour.groupBy("side", "c").agg((F.count("*") > 1).alias("tied"))
    names = colour.withColumn("place", place).join(tied, ["side", "c"])
    y = F.concat(F.lit("_:c"), "c", F.when(F.col("place") > 1, F.concat(F.lit("_"), "place")).otherwise(""))
    names = materialize(names.select("side", "x", y.alias("y"), "tied"), "names")
    out = rows
    for k in ("s", "o"):
        out = out.join(names.select("side", F.col("x").alias(k), F.col("y").alias("__y")), ["side", k], "left").withColumn(k, F.coalesce("__y", k)).drop("__y")
    return names, out


def canonical_bnodes(quads: DataFrame) -> DataFrame:
    """Quads with blank nodes renamed by signature: colours refined from their statements.

    Distributed colour refinement until no class splits; a chain of n blank
    nodes takes about n / 2 rounds. Nodes that stay equal are numbered inside
    their colour in the order of their old names, so none are merged; use
    ``quadrille.plans.formula.canonical_triples`` where symmetric nodes matter.
    """
    rows = materialize(quads.select(*KEY).distinct().withColumn("side", F.lit(0)), "canonical")
    return _named(rows)[1].select(*KEY)


# --- diff and patch --------------------------------------------------------------------------------------------------


def difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deleted, inserted): what only a has, and what only b has, up to blank node names.

    Copies of a node are counted. Nodes that colours cannot tell apart are
    refused if a statement links two of them, as their pairing is then open.
    """
    sides = [d.select(*KEY).distinct().withColumn("side", F.lit(i)) for i, d in enumerate((a, b))]
    rows = materialize(sides[0].unionByName(sides[1]), "canonical")
    names, out = _named(rows)
    tied = names.where("tied").select("side", "x")
    linked = rows.where(F.col("s") != F.col("o"))
    for k in ("s", "o"):
        linked = linked.join(tied.withColumnRenamed("x", k), ["side", k], "left_semi")
    if not linked.isEmpty():
        raise ValueError("blank nodes that are linked cannot be told apart: name them first")
    a, b = (out.where(F.col("side") == i).select(*KEY) for i in (0, 1))
    return a.join(b, KEY, "left_anti"), b.join(a, KEY, "left_anti")


def patch_formula(a: DataFrame, b: DataFrame, limit: int = 100_000) -> Formula:
    """A patch that turns a into b: ground statements as one deletion and one insertion."""
    out, empty = Formula(), Formula()
    for verb, rows in zip((DELETION, INSERTION), difference(a, b), strict=True):
        found = rows.select("s", "p", "o").limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"the graphs differ in over {limit} statements: use difference()")
        if any(bnodes(t) for r in found for t in r):
            raise ValueError("statements about blank nodes differ: name them first")
        if found:
            out.add(empty, verb, Formula(sorted(tuple(r) for r in found)))
    return out


class PatchFailed(ValueError):
    """A deletion that matches no statement."""


def patch(ds: Dataset, patches: Formula) -> Dataset:
    """Apply insertions and deletions: each left side is matched against the data as it was.

    Every statement to be deleted must be there; all deletions and insertions
    take effect together.
    """
    quads = materialize(ds.quads.distinct(), "patched")
    base = ds.replace(quads)
    adds, drops = [], []
    for s, p, o in patches.statements:
        if p not in (INSERTION, DELETION) or not isinstance(s, Formula) or not isinstance(o, Formula):
            continue
        rule = Rule(body_of(s), o)
        found = conclusions(rule, Matcher(base).solve(rule.body, needed=rule.used))
        if found is not None:
            (adds if p == INSERTION else drops).append(found.distinct())
    out = quads
    for d in drops:
        d = materialize(d, "deletions")
        if not d.join(quads, KEY, "left_anti").isEmpty():
            raise PatchFailed("a statement to be deleted is not in the data")
        out = out.join(d, KEY, "left_anti")
    for a in adds:
        out = out.unionByName(a)
    return base.replace(out.distinct())
