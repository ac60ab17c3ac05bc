"""Rules over streams of statements (an extension: graphs arrive in batches).

A stream of quads is joined to the facts so far batch by batch: what came before
is closed under the rules, so a batch's fixpoint starts from its own statements
and only rules that they can fire are evaluated. The facts so far are read again
for each batch, to join with and to leave out what is known.
Facts live in a folder of Parquet parts named by batch, so a batch that is run
again after a failure overwrites its own part and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.plans.data import QUADS, Dataset
from quadrille.plans.rules import Rule, think
from quadrille.sources.triples import parse_lines


def read_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of quads from N-Triples files that appear in a folder."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)).where("s is not null")


def facts_before(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """Facts of all earlier batches."""
    try:
        parts = spark.read.option("basePath", folder).parquet(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], QUADS)
        raise
    return parts.where(F.col("batch") < batch).select("g", "s", "p", "o")


def reason_over(stream: DataFrame, rules: list[Rule], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``folder`` (partitioned by batch) closed under the rules as statements arrive."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = facts_before(spark, folder, number)
        came = batch.select("g", "s", "p", "o")
        since = came.join(old, ["g", "s", "p", "o"], "left_anti") if number else None
        done = think(Dataset(spark, old.unionByName(came)), rules, since=since).quads
        fresh = done.join(old, ["g", "s", "p", "o"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
