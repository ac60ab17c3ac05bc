"""Length-delimited binary records of token ids, with a separate offset index.

A shard file is a sequence of frames::

    length   u64  bytes of the payload
    check    u32  masked CRC-32 of the length's 8 bytes
    payload       u8 flags, i64 document id, ids (u16 where the vocabulary allows, else u32)
    check    u32  masked CRC-32 of the payload

all little-endian. Beside it, ``.idx`` holds the u64 offset of every frame and
then the file's length, so a reader can fetch records in any order. Masking
rotates a checksum and adds a constant, so that checksums of data that holds
checksums stay strong.

Results for odd input: a null text counts as empty, so its sequence is the end
id alone; null document ids are flagged in the frame and come first; repeated
rows are all written, ordered by id and then text; an empty table gives an
empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.bpe import TOKENIZER, _resolve, encoder
from quadrille.storage import bounded_batches, fresh_path, materialize, n_partitions

HEAD = struct.Struct("<QI")
META = struct.Struct("<Bq")
TAIL = struct.Struct("<I")
NULL_ID, WIDE = 1, 2
_MASK = 0xA282EAD8


class CorruptRecord(ValueError):
    """A frame whose checksum or length does not hold."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked_crc(length)), payload, TAIL.pack(masked_crc(payload))))


def pack(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (doc_id is None) * NULL_ID + wide * WIDE
    return META.pack(flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = META.unpack_from(payload)
    return (None if flags & NULL_ID else doc_id), np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=META.size)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_frame(stream) -> bytes | None:
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise CorruptRecord("file ends inside a frame's head")
    length, check = HEAD.unpack(head)
    if masked_crc(head[:8]) != check:
        raise CorruptRecord("length checksum differs")
    payload, tail = stream.read(length), stream.read(TAIL.size)
    if len(payload) < length or len(tail) < TAIL.size or TAIL.unpack(tail)[0] != masked_crc(payload):
        raise CorruptRecord("payload checksum differs")
    return payload


def scan(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every record of a shard, in order, one in memory at a time."""
    system, path = file_system(uri)
    with system.open_input_stream(path, buffer_size=1 << 20) as stream:
        while (payload := read_frame(stream)) is not None:
            yield unpack(payload)


def fetch(uri: str, numbers: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records by number, in the order asked for, found through the offset index."""
    system, path = file_system(uri)
    with system.open_input_file(f"{path}.idx") as index, system.open_input_file(path) as data:
        for k in numbers:
            start, end = struct.unpack("<QQ", index.read_at(16, 8 * k))
            whole = data.read_at(end - start, start)
            length, check = HEAD.unpack_from(whole)
            payload = whole[HEAD.size : HEAD.size + length]
            if masked_crc(whole[:8]) != check or TAIL.unpack_from(whole, HEAD.size + length)[0] != masked_crc(payload):
                raise CorruptRecord(f"record {k} of {uri}")
            yield unpack(payload)


def write_records(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode texts and write shards in ascending id order; returns the manifest.

    One range partition gives one shard, written as it streams. A repeated or
    retried task writes the same bytes under a name of its own and then moves
    them to the shard's name, so readers only see whole files.
    Manifest: shard, path, n_records, n_ids.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 512)
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ordered = picked.repartitionByRange(n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        enc = encoder(_resolve(tokenizer))
        wide = max(enc.vocab_size - 1, end_id) >= 1 << 16
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/shard-{shard:06d}.rec"
        own = f"{root}/.{shard:06d}-{task.taskAttemptId()}"
        at, n_ids, offsets = 0, 0, []
        with system.open_output_stream(own, buffer_size=1 << 20) as out:
            for batch in batches:
                ids, starts = enc.encode_texts(batch.column(1))
                ends = starts.tolist()
                for k, doc_id in enumerate(batch.column(0).to_pylist()):
                    sequence = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id))
                    framed = frame(pack(doc_id, sequence, wide))
                    out.write(framed)
                    offsets.append(at)
                    at += len(framed)
                    n_ids += len(sequence)
        if not offsets:
            system.delete_file(own)
            return
        with system.open_output_stream(f"{own}.idx") as out:
            out.write(np.array([*offsets, at], "<u8").tobytes())
        system.move(f"{own}.idx", f"{path}.idx")
        system.move(own, path)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.rec"], "n_records": [len(offsets)], "n_ids": [n_ids]}
        )

    return materialize(ordered.mapInArrow(work, "shard long, path string, n_records long, n_ids long"), "manifest")


def read_digest(manifest: DataFrame) -> DataFrame:
    """Per record of the files: doc_id, start, n_tokens, ids_crc32, shard, record (its number in the shard)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = files.select("shard", "path", "first").repartition(n_partitions(manifest.sparkSession), "shard")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                start, rows = f["first"], []
                for number, (doc_id, ids) in enumerate(scan(f["path"])):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), f["shard"], number))
                    start += len(ids)
                    if len(rows) == 8192:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spread.mapInArrow(work, _DIGEST)


_DIGEST = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "record")]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, _DIGEST.names)


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_digest(write_records(docs, TOKENIZER, fresh_path(spark, "records")))
