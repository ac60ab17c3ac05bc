"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that
differ in at most three bits differ in at most one bit within one of them, so
each fingerprint looks up, per segment, the Hamming ball of radius one around
its own value; complete distances are then verified. Of the two ends of a
differing bit only the one that holds 0 flips it, so each ball is walked once.
Only distinct fingerprints are looked up: copies join their class by equality
and are never expanded into pairs. Keys shared by very many fingerprints are
split once more, by the same rule, on the other segment.

Results for odd input: null, empty and blank texts have fingerprint zero and
link like any other; a text under three words is one shingle; repeated rows each
return; a null id gets its class's smallest id (null if it has none); an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from quadrille.operators.components import connected_components
from quadrille.operators.skew import spread_join
from quadrille.storage import bounded_batches, materialize, row_key

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Fingerprints under one segment value from which the other segment is indexed too.
HOT_KEY = 256
_CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    stops = (ends - 1).tolist()
    last = min(shingle, len(words)) - 1
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        cut = zip(starts[a:b], stops[a + last : b + last], strict=False)
        h = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in cut), "<u8", b - a)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _append_fingerprint(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, out])

    return docs.mapInArrow(work, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a long."""
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return _append_fingerprint(picked, "text", "fp").select("doc_id", "fp")


def _half(value: Column, segment: int, bits: int) -> Column:
    shifted = F.shiftrightunsigned(value, bits * segment)
    return shifted.bitwiseAND(F.lit((1 << bits) - 1))


def _ball(key: Column, bits: int) -> Column:
    """The value and the values with one of its 0 bits set."""
    flips = F.filter(F.array(*[F.lit(1 << j) for j in range(bits)]), lambda m: key.bitwiseAND(m) == 0)
    return F.concat(F.array(key), F.transform(flips, lambda m: key.bitwiseOR(m)))


def _matches(probes: DataFrame, table: DataFrame, on: list[str], distance: int) -> DataFrame:
    p = probes.withColumnRenamed("fp", "a")
    t = table.withColumnRenamed("fp", "b")
    return (
        p.join(t, on)
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    )


def links(distinct: DataFrame, distance: int = MAX_DISTANCE, hot_key: int = HOT_KEY) -> DataFrame:
    """All pairs (src, dst) of distinct fingerprints within ``distance`` (at most 3), each once.

    ``distinct`` has one column, fp.
    """
    segments = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _half(F.col("fp"), s, 32).alias("key")) for s in (0, 1)]))
    table = materialize(distinct.select("fp", segments.alias("x")).select("fp", "x.seg", "x.key"), "segments")
    probes = table.withColumn("key", F.explode(_ball(F.col("key"), 32)))
    hot = table.groupBy("seg", "key").count().where(F.col("count") > hot_key).select("seg", "key")
    hot = materialize(hot, "hot-keys")
    if hot.isEmpty():
        return _matches(probes, table, ["seg", "key"], distance).distinct()
    cold = _matches(probes.join(hot, ["seg", "key"], "left_anti"), table.join(hot, ["seg", "key"], "left_anti"), ["seg", "key"], distance)
    # the other segment differs in at most three bits, so one of its halves in at most one: index those too
    other = F.when(F.col("seg") == 0, _half(F.col("fp"), 1, 32)).otherwise(_half(F.col("fp"), 0, 32))
    inner = F.explode(F.array(*[F.struct(F.lit(s).alias("sub"), _half(other, s, 16).alias("subkey")) for s in (0, 1)]))
    split = lambda d: d.join(hot, ["seg", "key"], "left_semi").select("*", inner.alias("y")).select("fp", "seg", "key", "y.sub", "y.subkey")
    # both ends may hold the 0 that differs in the inner ball, so the inner ball flips every bit
    key = F.col("subkey")
    full = F.concat(F.array(key), F.transform(F.array(*[F.lit(1 << j) for j in range(16)]), lambda m: key.bitwiseXOR(m)))
    warm = _matches(split(probes).withColumn("subkey", F.explode(full)), split(table), ["seg", "key", "sub", "subkey"], distance)
    return cold.unionByName(warm).distinct()


def _components(groups: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """``groups`` (one row for each fingerprint, fp) with component, the smallest fingerprint reachable."""
    parts = connected_components(links(groups.select("fp"), distance))
    return groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def classes(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint the smallest doc_id reachable from it."""
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    labelled = _components(groups, distance)
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return labelled.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return spread_join(prints, materialize(classes(prints), "classes"), "fp", ["doc_id"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the one with the smallest id (nulls last), then fingerprint and content; same columns."""
    key = ["__key1", "__key2"]
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(row_key(docs), key, strict=True)])
    rows = _append_fingerprint(keyed.select(keyed[id_col].alias("doc_id"), keyed[text_col].cast("string").alias("text"), *key), "text", "fp")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", *key)
    groups = materialize(rows.groupBy("fp").agg(F.min(order).alias("first")), "fingerprints")
    best = _components(groups).groupBy("component").agg(F.min("first").alias("first")).select("first.__key1", "first.__key2")
    return keyed.join(best, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
