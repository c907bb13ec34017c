"""One CSV file read by many tasks, line breaks inside quotes included.

A file is cut into byte ranges. Whether a range begins inside quotes depends on all quotes before it, so each range is first surveyed for
both cases: does it flip the state, how many records start in it, and would its quotes be in order. A running sum of the flips then gives the
state at each range's begin, and the range that holds a record's line break before it parses the record to its end.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.csv
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.sources.files import _open, n_tasks

RANGE_BYTES = 32 << 20
READ_ON = 1 << 16  # bytes read at a time beyond a range, up to the end of its last record
BATCH_ROWS = 10_000
BLOCK_ROWS = 1_000_000  # rows of a block where a file has to be read as one
QUOTE, COMMA, LINE, RETURN = (ord(c) for c in '",\n\r')
CELLS = "uri string, block long, line long, cells array<string>"
SURVEY = "uri string, begin long, stop long, length long, flips boolean, outside struct<records: long, odd: boolean>, inside struct<records: long, odd: boolean>"


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (uri, begin, stop, length) that cut the ``files`` (uri, length); an empty file has none."""
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    cut = files.where(F.col("length") > 0).select("uri", "length", begins.alias("begin"))
    return cut.select("uri", "begin", F.least(F.col("begin") + range_bytes, "length").alias("stop"), "length")


def scan(data: bytes, before: int, after: int) -> tuple[bool, list[tuple[int, bool]]]:
    """Whether the bytes flip the state, and for a begin outside and inside quotes: record starts, and whether a quote or a line end is odd.

    A quote that opens has a separator or a closing quote before it, one that closes has a separator, a line end or a
    quote behind it. ``before`` and ``after`` are the bytes around, or a line feed at the ends of the file.
    """
    raw = np.frombuffer(data, np.uint8)
    quote = np.flatnonzero(raw == QUOTE)
    upto = np.searchsorted(quote, np.flatnonzero(raw == LINE)) & 1  # quotes before each line feed
    opens = np.arange(len(quote)) % 2 == 0  # for a begin outside
    left, right = np.concatenate([[before], raw[:-1]])[quote], np.concatenate([raw[1:], [after]])[quote]
    starts = (left == COMMA) | (left == LINE) | (left == QUOTE)
    ends = (right == COMMA) | (right == LINE) | (right == RETURN) | (right == QUOTE)
    back = np.flatnonzero(raw == RETURN)
    alone = back[np.concatenate([raw[1:], [after]])[back] != LINE]
    lone = np.searchsorted(quote, alone) & 1
    found = []
    for entered in (False, True):
        opening = opens != entered
        odd = not (starts | ~opening).all() or not (ends | opening).all() or bool((lone == entered).any())
        found.append((int((upto == entered).sum()), odd))
    return bool(len(quote) % 2), found


def survey(ranges: DataFrame) -> DataFrame:
    """The ranges with what ``scan`` finds in each."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, begin, stop, length in batch[["uri", "begin", "stop", "length"]].itertuples(index=False):
                with _open(uri) as file:
                    first = max(begin - 1, 0)
                    data = file.read_at(min(stop + 1, length) - first, first)
                before = data[0] if begin else LINE
                own = data[begin - first : stop - first]
                after = data[stop - first] if stop < length else LINE
                mark = 3 * (begin == 0 and own.startswith(b"\xef\xbb\xbf"))
                flips, states = scan(own[mark:], before, after)
                row = [(uri, begin, stop, length, flips, *[{"records": n, "odd": odd} for n, odd in states])]
                yield pd.DataFrame(row, columns=["uri", "begin", "stop", "length", "flips", "outside", "inside"])

    return ranges.mapInPandas(look, SURVEY)


def entered(surveyed: DataFrame) -> DataFrame:
    """The ranges with their state at the begin; a file whose quotes are odd is one range, marked ``whole``.

    A file has a row per range here, so the window holds few rows.
    """
    before = Window.partitionBy("uri").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("flips").cast("long")).over(before), F.lit(0)) % 2 == 1
    state = surveyed.withColumn("quoted", inside)
    odd = F.max(F.when(F.col("quoted"), F.col("inside.odd")).otherwise(F.col("outside.odd"))).over(Window.partitionBy("uri"))
    marked = state.withColumn("whole", odd).where(~F.col("whole") | (F.col("begin") == 0))
    return marked.select("uri", "begin", F.when(F.col("whole"), F.col("length")).otherwise(F.col("stop")).alias("stop"), "length", "quoted", "whole")


def own_records(uri: str, begin: int, stop: int, length: int, quoted: bool) -> bytes:
    """The records whose line break before them lies in the range; of the first range also the first record."""
    with _open(uri) as file:
        data = file.read_at(stop - begin, begin)
        raw = np.frombuffer(data, np.uint8)
        quotes, lines = np.flatnonzero(raw == QUOTE), np.flatnonzero(raw == LINE)
        breaks = lines[(np.searchsorted(quotes, lines) & 1) == quoted]
        if begin and not len(breaks):
            return b""
        start = int(breaks[0]) + 1 if begin else 0
        inside = bool(len(quotes) % 2) != quoted
        parts, at = [data[start:]], stop
        while at < length:
            data = file.read_at(min(READ_ON, length - at), at)
            raw = np.frombuffer(data, np.uint8)
            quotes, lines = np.flatnonzero(raw == QUOTE), np.flatnonzero(raw == LINE)
            ends = lines[(np.searchsorted(quotes, lines) & 1) == inside]
            if len(ends):
                parts.append(data[: int(ends[0]) + 1])
                break
            parts.append(data)
            inside, at = inside != bool(len(quotes) % 2), at + len(data)
        whole = b"".join(parts)
        # As Spark's reader has it: where lines end with a carriage return and a line feed, so they do inside quotes, and one feed is kept.
        ended = len(breaks) and begin + int(breaks[0]) and file.read_at(1, begin + int(breaks[0]) - 1) == b"\r"
        return whole.replace(b"\r\n", b"\n") if ended else whole


def _rows_of(reader, width: int) -> Iterator[list[str | None]]:
    for row in reader:
        if row:
            cells = [c or None for c in row[:width]]
            yield cells + [None] * (width - len(cells))


def _plain(text: io.TextIOBase, width: int, header: bool) -> Iterator[pa.Array]:
    """Rows parsed one by one, some thousand at a time: whatever their quotes or their number of cells."""
    csv.field_size_limit(1 << 30)
    rows, batch = _rows_of(csv.reader(text), width), []
    if header:
        next(rows, None)
    for row in rows:
        batch.append(row)
        if len(batch) == BATCH_ROWS:
            yield pa.array(batch, pa.list_(pa.string()))
            batch = []
    if batch:
        yield pa.array(batch, pa.list_(pa.string()))


def cells_of(data: bytes, width: int, header: bool) -> Iterator[pa.Array]:
    """Records as lists of ``width`` texts; an empty cell is null, and so is one that a short record lacks. Blank lines are left out."""
    if not data.strip(b"\r\n"):
        return
    try:
        table = pa.csv.read_csv(
            pa.BufferReader(data),
            pa.csv.ReadOptions(use_threads=False, block_size=max(len(data), 1), skip_rows_after_names=0, autogenerate_column_names=True),
            pa.csv.ParseOptions(newlines_in_values=True),
            pa.csv.ConvertOptions(column_types={f"f{i}": pa.string() for i in range(max(width, data.count(b",", 0, READ_ON) + 1))}, strings_can_be_null=True, null_values=[""]),
        )
    except pa.ArrowInvalid:  # records of several lengths, or bytes that are no UTF-8
        yield from _plain(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig" if header else "utf-8", "replace", newline=""), width, header)
        return
    table = table.slice(1) if header else table
    n, columns = len(table), [c.combine_chunks() for c in table.columns[:width]]
    columns += [pa.nulls(n, pa.string())] * (width - len(columns))
    order = np.arange(n * width).reshape(width, n).T.ravel()
    yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.concat_arrays(columns).take(pa.array(order)))


def whole_records(data: bytes) -> bytes | None:
    """The records of a whole file in the form of ``own_records``; nothing where its quotes are odd or lines end in a carriage return alone."""
    if b'"' not in data and b"\r" not in data:
        return data
    own = data[3 * data.startswith(b"\xef\xbb\xbf") :]
    if scan(own, LINE, LINE)[1][0][1]:
        return None
    raw = np.frombuffer(own, np.uint8)
    quotes, lines = np.flatnonzero(raw == QUOTE), np.flatnonzero(raw == LINE)
    breaks = lines[(np.searchsorted(quotes, lines) & 1) == 0]
    ended = len(breaks) and breaks[0] and own[int(breaks[0]) - 1] == RETURN
    return own.replace(b"\r\n", b"\n") if ended else own


def _cells_frame(uri: str, block: int, line: int, cells: pa.Array) -> pa.RecordBatch:
    n = len(cells)
    return pa.RecordBatch.from_arrays(
        [pa.array([uri] * n, pa.string()), pa.array(np.full(n, block)), pa.array(np.arange(line, line + n)), cells], ["uri", "block", "line", "cells"]
    )


def read_small(files: DataFrame, width: int) -> DataFrame:
    """The rows of ``read_ranges`` for files (uri) that are read at once: a file is one block, and a task reads many.

    Spark's reader plans by files on the driver and lets each weigh 4 MB, so a tree of small files costs a task for every 32 of them.
    """

    def parts(uri: str) -> Iterator[pa.RecordBatch]:
        with _open(uri) as file:
            data = file.read()
        records, line = whole_records(data), 0
        if records is None:
            found = _plain(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", "replace", newline=""), width, True)
        else:
            found = cells_of(records, width, True)
        for cells in found:
            yield _cells_frame(uri, line // BLOCK_ROWS if records is None else 0, line, cells)
            line += len(cells)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                for part in parts(uri):
                    waiting.append(part)
                    n += len(part)
                    if n >= BATCH_ROWS:
                        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                        waiting, n = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    dealt = files.select("uri").repartition(n_tasks(files.sparkSession), "uri")
    return dealt.mapInArrow(parse, CELLS)


def read_ranges(files: DataFrame, width: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (uri, block, line, cells) of ``files`` (uri, length), in their order by (uri, block, line); the header is left out.

    A block is a range of ``range_bytes``, so it is bounded. A file with quotes in the middle of cells, or lines that end with a
    carriage return alone, can only be read from its start: one task reads it, row by row, in blocks of ``BLOCK_ROWS``. A null or
    empty file gives no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                line = 0
                if r["whole"]:
                    with _open(r["uri"]) as file:
                        text = io.TextIOWrapper(io.BufferedReader(file), "utf-8-sig", "replace", newline="")
                        for cells in _plain(text, width, True):
                            yield _cells_frame(r["uri"], line // BLOCK_ROWS, line, cells)
                            line += len(cells)
                    continue
                data = own_records(r["uri"], r["begin"], r["stop"], r["length"], r["quoted"])
                for cells in cells_of(data, width, r["begin"] == 0):
                    yield _cells_frame(r["uri"], r["begin"], line, cells)
                    line += len(cells)

    states = entered(survey(file_ranges(files, range_bytes).repartition("uri", "begin")))
    return states.repartition("uri", "begin").mapInArrow(parse, CELLS)
