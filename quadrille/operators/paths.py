"""Closure of links that never fork: forests read towards their roots, chains and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.storage import remove, written

#: Longest path that is kept in one row.
MAX_PATH = 512


def all_next(links: DataFrame, longest: int = MAX_PATH) -> DataFrame | None:
    """Rows (a, path) for links (a, b) with one b for each a: path holds all that a reaches, nearest first, each once.

    Every round appends to a path the path of its last node, so paths double and
    the rounds grow with the logarithm of the longest. A path is whole once its
    last node has no link, a node comes again, or the appended path was whole.
    There is one row for each link, so rounds neither make nor drop repeated
    pairs. None if a path grows over ``longest`` nodes, as rows would get large.
    """
    spark = links.sparkSession
    now, path = written(links.select("a", F.array("b").alias("path"), F.lit(1).alias("n"), F.lit(False).alias("whole")), "paths")
    while True:
        n, whole = now.agg(F.max("n"), F.bool_and("whole")).first()
        if whole is None or whole:
            return now.select("a", "path")
        if n > longest:
            remove(spark, path)
            return None
        further = now.select(F.col("a").alias("last"), F.col("path").alias("rest"), F.col("whole").alias("ends"))
        longer = now.where(~F.col("whole")).withColumn("last", F.element_at("path", -1)).join(further, "last", "left")
        longer = longer.select("a", F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("long"), F.coalesce("ends", F.lit(True)).alias("ends"))
        longer = longer.withColumn("path", F.array_distinct("long"))
        longer = longer.select("a", "path", F.size("path").alias("n"), (F.col("ends") | (F.size("path") < F.size("long"))).alias("whole"))
        before, (now, path) = path, written(now.where("whole").unionByName(longer), "paths")
        remove(spark, before)
