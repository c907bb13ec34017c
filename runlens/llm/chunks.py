"""Documents in chunks that ask buckets about the whole corpus and get their answers back.

A chunk holds some megabytes of text, chosen by a hash of the document. It sums up what it holds, once per distinct key, and sends
each bucket its keys as one packed row. A bucket counts the keys of all chunks and answers every chunk in the order of
its keys. The chunk works out its keys again and applies the answers. Hot keys are thus combined before they are
shuffled, no list of documents travels, and a lost executor costs only its own chunks and buckets.

A shuffle hands out the rows of a chunk in no fixed order, and a chunk is read twice, in different tasks. So both
readings put its rows in one order first (``in_order``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20  # text of a chunk
BUCKET_BYTES = 12 << 20  # what a bucket gets, unpacked


def in_chunks(docs: DataFrame, columns: list[str], chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``columns`` of the documents, the text as bytes, with a chunk number; and the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    picked = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),
        *[F.col(c).cast("binary").alias(c) if c == "text" else F.col(c) for c in columns],
    )
    return picked, total


def in_order(chunk: pa.Table) -> pa.Table:
    """The rows of a chunk by all their columns: whatever numbers them by appearance gives the same numbers in every task."""
    return chunk.sort_by([(name, "ascending") for name in chunk.column_names])


def steps(send: Callable, finish: Callable) -> tuple[Callable, Callable]:
    """Both readings of a chunk, each in the one order."""
    return (lambda chunk: send(in_order(chunk))), (lambda chunk, answers: finish(in_order(chunk), answers))


def ask(chunked: DataFrame, send: Callable, answer: Callable, finish: Callable, schema: str) -> DataFrame:
    """``send(chunk)`` and ``answer(bucket)`` give tables of (chunk, bucket, packed); ``finish(chunk, answers)`` the result."""
    send, finish = steps(send, finish)
    packed = "chunk long, bucket long, packed binary"
    sent = chunked.groupBy("chunk").applyInArrow(send, packed)
    answered = sent.groupBy("bucket").applyInArrow(answer, packed)
    return chunked.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(finish, schema)


def packed_table(chunk: list[int], bucket: list[int], packed: list[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "packed": pa.array(packed, pa.binary())})


def pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else data.tobytes(), 1)


def unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


def pack_hashes(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte planes apart: the leading planes are nearly all zero."""
    steps = np.diff(values, prepend=np.uint64(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def unpack_hashes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
