"""A corpus pipeline: clean, keep known languages, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; the table before it, and what
the stage itself wrote, are then deleted. All but the last return the columns of
documents; the last returns each document's token ids.

Results for odd input: documents without words go in the first stage, those
without letters in the second; null, repeated and clashing ids are no keys of
any stage (rows are told apart by content); of equal rows one stays; columns
beyond those of documents pass through to the last stage, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, langid, mixing, quality, simhash
from quadrille.storage import remove, scratch, written

STAGES = [
    ("quality rules", quality.stage),
    ("language ID", langid.stage),
    ("SimHash near-dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: Hashing, hyperdimensional vectors and BPE are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as written_here:
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
            written_here.remove(path)
        if last:
            remove(spark, last)
        last = path
    return docs
