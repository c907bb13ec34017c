"""Words are runs of characters other than space and \\x09 to \\x0D. Column forms, and byte forms for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[ \t\n\x0B\f\r]+"
SLICE_BYTES = 4 << 20  # text handled at once in a task


def word_array(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def whole_row(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns as one struct, so that working columns cannot clash with them."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in columns or docs.columns])


def word_count(text: Column) -> Column:
    """How many words; splitting a text without outer white space gives one part a word."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, GAP))).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in slices of at most ``limit`` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class WordHash(dict):
    """64-bit hashes of words; forgets all when full, so its size stays bounded."""

    limit = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` numbers, in order."""
    total = max(0, len(ids) - n + 1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + ids[k : k + total]
    return mixed(out)


def count_words(docs: DataFrame) -> int:
    """The words of all texts: one number to the driver."""

    def count(batches):
        for part in slices(batches):
            n = sum(len(t.split()) for t in part.column("text").to_pylist() if t)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "n long")
    return counted.agg(F.sum("n")).first()[0] or 0
