"""Operator 10: length-delimited binary token records with an offset index.

File: a header ``CLREC1`` + width byte + pad, then frames.  Frame: payload length (8 bytes), masked CRC-32 of these
8 bytes (4), payload, masked CRC-32 of the payload (4).  Payload: record key (8 bytes, signed), then token ids of
`width` bytes each; all little-endian.  The mask rotates a checksum by 15 bits and adds a constant, so a
checksum over data that itself holds checksums stays meaningful.  Beside each file an index of (key, frame offset,
tokens), 24 bytes an entry, serves shuffled reads.

Each task writes one shard under a name of its own and reports it as its row, so a task that runs again after a lost
executor leaves at most a file that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .common import new_path, opened, written
from .tokens import Encoder

MAGIC = b"CLREC1"
#: Fixed value: the usual constant of masked record checksums.
MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("key", "<i8"), ("offset", "<i8"), ("tokens", "<i8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, position after the frame); ValueError on any damage."""
    head = data[at : at + 12]
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"damaged record length at byte {at}")
    end = at + 12 + struct.unpack("<Q", head[:8])[0]
    payload, check = data[at + 12 : end], data[end : end + 4]
    if len(check) < 4 or struct.unpack("<I", check)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, end + 4


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Write ids of all rows in ascending doc_id order; the manifest: (shard, path, records, tokens), one row a file.

    Null texts are empty and null doc_ids come first, kept as -1 << 63.  Rows that share a doc_id are ordered by text.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        at, tokens, index = 8, 0, []
        with store.open_output_stream(path + ".rec") as out:
            out.write(MAGIC + bytes([width, 0]))
            for batch in batches:
                keys = batch.column(0).fill_null(-1 << 63).to_numpy()
                data, offs = tx.string_column(batch, "text")
                for i, j, d, o in tx.blocks(data, offs):
                    ids, own = encoder.encode(d, o)
                    parts = []
                    for k in range(j - i):
                        part = np.append(ids[own[k] : own[k + 1]], end_id).astype(f"<u{width}")
                        parts.append(frame(struct.pack("<q", keys[i + k]) + part.tobytes()))
                        index.append((keys[i + k], at, len(part)))
                        at += len(parts[-1])
                        tokens += len(part)
                    out.write(b"".join(parts))
        with store.open_output_stream(path + ".idx") as out:
            out.write(np.array(index, INDEX).tobytes())
        yield pa.record_batch([pa.array([shard]), pa.array([path]), pa.array([len(index)]), pa.array([tokens])], names=["shard", "path", "records", "tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "shard long, path string, records long, tokens long"), "manifest", large=True).withColumn("folder", F.lit(folder))


def read_index(folder: str, path: str) -> np.ndarray:
    store, _ = opened(folder)
    with store.open_input_stream(path + ".idx") as f:
        return np.frombuffer(f.read(), INDEX)


def read_record(folder: str, path: str, offset: int) -> tuple[int, np.ndarray]:
    """(key, ids) of one record by its index entry: for shuffled reads."""
    store, _ = opened(folder)
    with store.open_input_file(path + ".rec") as f:
        width = f.read(8)[6]
        f.seek(offset)
        size = struct.unpack("<Q", f.read(8))[0]
        f.seek(offset)
        payload, _ = unframe(f.read(size + 16))
    return struct.unpack("<q", payload[:8])[0], np.frombuffer(payload[8:], f"<u{width}")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, checksums verified; `start` counts all tokens before it."""
    shards = sorted(manifest.collect())  # a row a file
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    base, rows = 0, []
    for x in shards:
        rows.append((x["folder"], x["path"], base))
        base += x["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = opened(row["folder"])
                index, start = read_index(row["folder"], row["path"]), row["base"]
                with store.open_input_stream(row["path"] + ".rec") as f:
                    head = f.read(8)
                    if head[:6] != MAGIC:
                        raise ValueError(f"{row['path']}: not a record file")
                    width = head[6]
                    for at in range(0, len(index), 1000):
                        part = index[at : at + 1000]
                        sizes = part["tokens"] * width + 24
                        data, out, pos = f.read(int(sizes.sum())), [], 0
                        for key, tokens in zip(part["key"].tolist(), part["tokens"].tolist(), strict=True):
                            payload, pos = unframe(data, pos)
                            ids = np.frombuffer(payload[8:], f"<u{width}").astype("<u4")
                            if struct.unpack("<q", payload[:8])[0] != key or len(ids) != tokens:
                                raise ValueError(f"{row['path']}: the index does not fit the records")
                            out.append((None if key == -1 << 63 else key, start, tokens, zlib.crc32(ids)))
                            start += tokens
                        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(rows, "folder string, path string, base long").repartition(len(rows))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
