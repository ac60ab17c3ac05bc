"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in ascending (id, checksum, size) order. A balanced
Feistel network permutes the smallest even-width bit domain that holds n, and
values outside 0..n-1 walk their cycle until they fall inside. With place p of
a row, shard = p mod shards and slot = p div shards: both can be computed for
any row number, and inverted, without reading data.

Results for odd input: a null text has size 16 and checksum 0; null ids are
numbered first; equal rows get places of their own; an empty table gives an
empty table; columns named row_number, shard or slot are refused by ``assign``
and not read by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.prefix import prefix_sums
from quadrille.storage import materialize

ROUNDS = 6


def _round(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixer (multiply, shift, multiply)."""
    z = x + np.uint64(key)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [((seed + 1) * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64 for r in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (_round(right, key) & mask)
    return (left << shift) | right


def _network_back(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in reversed(keys):
        left, right = right ^ (_round(left, key) & mask), left
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    half, keys = _half_bits(n), _keys(seed)
    out = step(x.astype(np.uint64), half, keys)
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = step(out[far], half, keys)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Place of each row number under the seeded permutation of 0..n-1."""
    return _walk(rows, n, seed, _network)


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Row number at each place."""
    return _walk(places, n, seed, _network_back)


def assign(rows: DataFrame, order_by: list[str], shards: int = 40, seed: int = 17) -> DataFrame:
    """Add row_number, shard and slot to ``rows``, which must not have columns of these names."""
    if taken := {"row_number", "shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns in the way: {sorted(taken)}")
    # written first: a range partitioning reads its input twice
    rows = materialize(rows, "rows")
    numbered = prefix_sums(rows, order_by, F.lit(1), out="row_number")
    n = rows.count()
    added = [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    schema = T.StructType([*numbered.schema.fields, *added])
    at = numbered.columns.index("row_number")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permute(batch.column(at).to_numpy(), n, seed)
            columns = [*batch.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shard", "slot"])

    return numbered.mapInArrow(work, schema)


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text").cast("binary")
    narrow = docs.select(
        "doc_id",
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    ).select("doc_id", (F.col("__bytes") + 16).alias("size"), "text_crc32")
    return assign(narrow, ["doc_id", "text_crc32", "size"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


#: CRC-32 byte by byte, and the Feistel network round by round.
ORACLE_SQL = r"""
with recursive bits as (select k, k::ubigint as c, 0 as step from range(0, 256) t(k)
  union all select k, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, step + 1 from bits where step < 8),
crc_table as (select list(c order by k) as t from bits where step = 8),
d as (select doc_id, coalesce(strlen(text), 0) + 16 as size, regexp_extract_all(hex(coalesce(text, '')), '..') as pairs from documents),
summed as (select doc_id, size,
    xor(list_reduce(list_transform(pairs, lambda p: ((instr('0123456789ABCDEF', p[1]) - 1) * 16 + instr('0123456789ABCDEF', p[2]) - 1)::ubigint),
      lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint]), 4294967295::ubigint), 4294967295::ubigint)::bigint as text_crc32 from d, crc_table),
numbered as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as row_number, count(*) over () as n from summed),
sized as (select *, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) as half from numbered),
-- one row for each Feistel round of each row number; a place that is no row number goes through the network again
walk as (select row_number, n, half, (row_number >> half)::ubigint as l, (row_number & ((1 << half) - 1))::ubigint as r, 0 as round, false as done from sized
  union all
  select row_number, n, half, r, xor(l, xor(z2, z2 >> 31) & ((1 << half) - 1)::ubigint), round + 1,
    (round + 1) % 6 = 0 and (r << half) | xor(l, xor(z2, z2 >> 31) & ((1 << half) - 1)::ubigint) < n
  from (select *, (xor(z1, z1 >> 27)::uhugeint * 10723151780598845931 % 18446744073709551616)::ubigint as z2
    from (select *, (xor(z0, z0 >> 30)::uhugeint * 13787848793156543929 % 18446744073709551616)::ubigint as z1
      from (select *, ((r::uhugeint + (18 * 11400714819323198485::uhugeint + (round % 6)::uhugeint * 15111065706836454659::uhugeint)) % 18446744073709551616)::ubigint as z0
        from walk where not done)))),
placed as (select row_number, ((l << half) | r)::bigint as place from walk where done)
select doc_id, size, text_crc32, 'rows' as law, (place % 40)::int as shard, place // 40 as slot, null::int as grown_shard, row_number
from sized join placed using (row_number)
"""
