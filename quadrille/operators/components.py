"""Connected components by alternating star contraction, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.skew import SALTS
from quadrille.storage import remove, written


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v, m) for links (u, v), with m the smallest v of u.

    Links are dealt by (u, part of v). Minima are taken for each part, then over
    the parts of a node (``SALTS`` rows at most), and go back to the parts, so no
    task meets more than a part of a hub's links.
    """
    # dealt once: the minima and the join read the same exchange
    dealt = links.withColumn("salt", F.xxhash64("v").bitwiseAND(F.lit(SALTS - 1))).repartition("u", "salt")
    parts = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    whole = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return dealt.join(whole.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge; component = smallest node reachable.

    Each round is a large-star step (every node hands its larger neighbours to
    its smallest neighbour) and a small-star step (likewise for smaller ones);
    the number of rounds grows with the logarithm of a component's size. Minima
    are pre-aggregated before each shuffle, a hub's links are dealt to many
    tasks, and no neighbourhood is ever gathered in one place. A round's table is
    deleted once the next one is written. Self loops and null ends give no edge.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct()
    )
    now, path = written(e, "edges")
    mark = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        # large star: (u, v) both ways, m = min(neighbours of u and u); link every larger v to m
        both = now.select(F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))).alias("x")).select("x.*")
        # (as many rows as links; the round's end drops repeats)
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: u with its smaller neighbours; link them and u to the least of them
        small = _with_least(large)
        ends = F.explode(F.array("v", "u"))
        before, (now, path) = path, written(small.select(F.col("m").alias("lo"), ends.alias("hi")).where("lo != hi").distinct(), "edges")
        remove(spark, before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
