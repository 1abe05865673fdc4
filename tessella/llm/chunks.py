"""Chunks of documents that ask the whole corpus about hashes.

Some operators need, for each of the many hashes in a document, one number that depends on all documents. A row for each
hash would cost far more than the hash. So documents are packed into chunks, compressed and written once; a chunk asks
with one binary row for each bucket of hashes, each hash once; a bucket answers with one binary row for each chunk, in
the order of the question; and the answers meet their chunk again. Every chunk counts a hash once, so a hash that many
documents have weighs no more than the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.row_id import partition_count
from ..scratch import materialise
from .texts import Slab, lower, mix, slabs

#: Bytes of text in a chunk. A longer document is a chunk of its own.
CHUNK = 4 << 20
#: Compressed bytes of chunks whose hashes go to a bucket.
BUCKET_BYTES = 8 << 20
ANSWER = "chunk long, bucket int, answer binary"


def pack(array: np.ndarray) -> bytes:
    """Size and compressed bytes."""
    raw = np.ascontiguousarray(array).view(np.uint8).reshape(-1)
    return len(raw).to_bytes(8, "little") + (pa.compress(pa.py_buffer(raw), codec="zstd", asbytes=True) if len(raw) else b"")


def unpack(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, kind)
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd"), kind)


#: Documents in a chunk at most, and bits of a document's place in its chunk.
MOST, PLACE_BITS = 1 << 15, 16
#: Bits of a chunk's number within its partition, and of the partition's.
CHUNK_BITS, PARTITION_BITS = 24, 23


def chunk_number(partition: int, k: int) -> int:
    """The number of the k-th chunk of a partition; the places in it still fit into 63 bits."""
    if partition >> PARTITION_BITS or k >> CHUNK_BITS:
        raise OverflowError("too many partitions or chunks to be numbered")
    return (partition << CHUNK_BITS) + k


def row_numbers(chunk: int, n: int) -> np.ndarray:
    """Numbers of the n documents of a chunk that no other document has."""
    return (np.int64(chunk) << PLACE_BITS) + np.arange(n)


def _packer(limit: int, sort_by: tuple[str, ...]):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        waiting: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            if sort_by:
                table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in sort_by]))
                table = table.combine_chunks()
            whole = table.column("text").chunk(0)
            slab = next(slabs(whole, limit=1 << 62))
            columns = [pa.array([chunk_number(partition, made)], pa.int64())]
            for name in table.column_names[:-1]:
                own = table.column(name).chunk(0)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
            columns += [pa.array([pack(slab.bounds)], pa.binary()), pa.array([pack(slab.data)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", *table.column_names[:-1], "bounds", "data"])

        for batch in batches:
            for slab in slabs(batch.column("text"), limit=limit):
                for first in range(slab.first, slab.last, MOST):
                    last = min(slab.last, first + MOST)
                    waiting.append(batch.slice(first, last - first))
                    size += int(slab.bounds[last - slab.first] - slab.bounds[first - slab.first])
                    if size >= limit // 2 or sum(map(len, waiting)) >= MOST:
                        yield chunk()
                        made, size = made + 1, 0
                        waiting.clear()
        if waiting:
            yield chunk()

    return packed


def chunk_table(docs: DataFrame, label: str, limit: int = CHUNK, sort_by: tuple[str, ...] = ()) -> DataFrame:
    """chunk, arrays of the columns of ``docs`` but text, bounds and data of the texts (null: empty); written once.

    ``sort_by``: columns by which the documents of a chunk are put in order.
    """
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    arrays = [f"`{f.name}` array<{f.dataType.simpleString()}>" for f in rows.select(*keep).schema]
    return materialise(rows.mapInArrow(_packer(limit, sort_by), ", ".join(["chunk long", *arrays, "bounds binary", "data binary"])), label)


def opened(batch: pa.RecordBatch | pa.Table, row: int, lower_case: bool = False) -> Slab:
    """The texts of a chunk."""
    bounds = unpack(batch.column("bounds")[row].as_py(), np.int64)
    data = unpack(batch.column("data")[row].as_py(), np.uint8)
    return Slab(0, len(bounds) - 1, lower(data) if lower_case else data, bounds)


def deal(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts sorted distinct hashes bucket by bucket, and where each bucket begins."""
    bucket = ((mix(hashes) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(buckets + 1))


def bucket_count(table: DataFrame) -> int:
    """From the bytes of a stored ``chunk_table``, and not below the session's number of shuffle partitions.

    A worker holds one bucket at a time, so its memory does not grow with the corpus.
    """
    return partition_count(table, BUCKET_BYTES)


def by_bucket(questions: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return questions.groupBy("bucket").applyInArrow(answer, schema)


def answered(table: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish`` gets each chunk with its answers, one chunk at a time."""
    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def in_order(answers: pa.Table, kind, name: str = "answer") -> np.ndarray:
    """The answers to a chunk in the order of its dealt hashes."""
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    blobs = answers.column(name).to_pylist()
    parts = [unpack(blobs[k], kind) for k in order]
    return np.concatenate(parts) if parts else np.zeros(0, kind)
