"""Sharding by sampled splitters: shards of near-equal bytes in which equal texts stay together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.words import whole_row
from runlens.session import materialize

CELLS = 4096  # parts of a shard whose rows are numbered side by side
PIECE = 64  # a group above 1/PIECE of a shard is placed on its own


def _place(large: list, shards: int, room: float) -> tuple[list[tuple[int, list[int]]], list[float]]:
    """Largest first into the emptiest shard; a group that fits nowhere is cut into pieces.

    At most ``shards * PIECE`` groups can be this large, so the list is bounded.
    """
    load, homes = [0.0] * shards, []

    def put(size: float) -> int:
        at = min(range(shards), key=lambda s: (load[s], s))
        load[at] += size
        return at

    for row in sorted(large, key=lambda r: (-r.bytes, r.key)):
        n = 1 if min(load) + row.bytes <= room else int(row.bytes // (room / PIECE)) + 1
        homes.append((row.key, [put(row.bytes / n) for _ in range(n)]))
    return homes, load


def _splitters(groups: DataFrame, total: int, ranges: int, samples: int) -> list[int]:
    """Quantile boundaries of keys drawn with a chance in proportion to their bytes.

    The draw holds ``samples`` keys on average whatever the input; it is a hash of the key, so it repeats.
    """
    chance = F.least(F.lit(1.0), F.col("bytes") * F.lit(samples / max(total, 1)))
    draw = F.pmod(F.xxhash64("key", F.lit("splitter")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = groups.where(draw < chance).select("key", (F.col("bytes") / chance).alias("weight")).collect()
    drawn.sort()
    whole, seen, bounds = sum(r.weight for r in drawn), 0.0, []
    for row in drawn:
        if seen >= whole * (len(bounds) + 1) / ranges:
            bounds.append(row.key)
        seen += row.weight
    return bounds


def _range_of(bounds: list[int]) -> Column:
    """How many boundaries are at most ``key``: a binary search in an array of constants."""
    if not bounds:
        return F.lit(0)
    n, steps = len(bounds), [1]
    while steps[0] * 2 <= n:
        steps.insert(0, steps[0] * 2)
    table = F.array(*[F.lit(b) for b in bounds])

    def halve(at: Column, step: Column) -> Column:
        reached = F.element_at(table, F.least(at + step, F.lit(n))) <= F.col("key")
        return F.when((at + step <= n) & reached, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    *,
    carry: Sequence[str] | None = None,
    ranges: int = 1024,
    samples: int = 100_000,
) -> DataFrame:
    """``carry`` (default: all columns) plus size, text_crc32, law ('bytes'), shard, slot and grown_shard (null).

    Size is the UTF-8 bytes of the text plus 1. Shards have near-equal sums of sizes. Equal texts share a shard;
    only a group that no shard can take whole is subdivided, by id.

    Keys are text hashes. A size-weighted sample of keys gives the boundaries of ``ranges`` ranges, whose exact bytes
    are counted; overfull ranges are subdivided by a sample of their own; then ranges fill the shards in key order.
    Groups that are large beside a shard are placed first, each on its own. The driver gets sampled keys, range totals
    and large groups: bounded by ``samples``, ``ranges`` and ``shards``. Slots run from 0 without gaps in each shard:
    the cells of a shard are counted, then numbered side by side.

    Null texts form one group of rows of size 1. Null or repeated ids and repeated rows are rows like others (equal
    ids of a subdivided group stay together). An empty table gives no rows. Carried columns keep their names; one that
    clashes with an added name gives way to the added one.
    """
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in (carry or docs.columns) if c not in made]
    spark = docs.sparkSession
    rows = docs.select(
        whole_row(docs, kept).alias("row"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("key"),
        F.xxhash64(F.col("doc_id"), F.lit("id")).alias("id_hash"),
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    room = total / shards
    is_large = F.col("bytes") > F.lit(room / PIECE)
    homes, load = _place(groups.where(is_large).collect(), shards, room)
    small = groups.where(~is_large)

    def counted(bounds: list[int]) -> list:
        return sorted(small.groupBy(_range_of(bounds).alias("at")).agg(F.sum("bytes").alias("bytes")).collect())

    bounds = _splitters(small, total - int(sum(load)), ranges, samples)
    sums = counted(bounds)
    overfull = [r for r in sums if r.bytes > 2 * total / ranges]
    if overfull:
        inside = small.where(_range_of(bounds).isin([r.at for r in overfull]))
        bounds = sorted({*bounds, *_splitters(inside, sum(r.bytes for r in overfull), ranges, samples)})
        sums = counted(bounds)
    shard_of_range, at = [0] * (len(bounds) + 1), 0
    for row in sums:
        while at < shards - 1 and load[at] + row.bytes / 2 > room:
            at += 1
        shard_of_range[row.at] = at
        load[at] += row.bytes

    rows = rows.withColumn("shard", F.element_at(F.array(*[F.lit(s) for s in shard_of_range]), _range_of(bounds).cast("int") + 1))
    if homes:
        placed = ", ".join(f"({key}L, array({', '.join(map(str, spread))}))" if key > -(2**63) else f"(-9223372036854775807L - 1L, array({', '.join(map(str, spread))}))" for key, spread in homes)
        table = spark.sql(f"select * from values {placed} as t(key, spread)")  # at most shards * PIECE groups
        piece = F.element_at("spread", F.pmod("id_hash", F.size("spread").cast("long")).cast("int") + 1)
        rows = rows.join(F.broadcast(table), "key", "left").withColumn("shard", F.coalesce(piece, "shard"))

    rows = rows.withColumn("cell", F.pmod("id_hash", F.lit(CELLS)))
    in_shard = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "cell").count()
        .select("shard", "cell", F.coalesce(F.sum("count").over(in_shard), F.lit(0)).alias("start"))
    )
    in_cell = Window.partitionBy("shard", "cell").orderBy("id_hash", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(in_cell))
        .join(starts, ["shard", "cell"])
        .select(
            "row.*", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
