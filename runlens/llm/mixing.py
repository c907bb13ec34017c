"""Mixing sources to target weights: fixed-length blocks, drawn slots, permuted block indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.words import whole_row, word_array, word_count
from runlens.session import materialize

CELLS = 4096  # parts of a source whose documents are laid out side by side
MOST = 3  # how often a word may be taken
RUN = 4096  # slots made from one row
PRIMES = (94906249, 92821013, 89999999, 86028121, 67867967)  # multipliers of the index permutation


def source_targets(sized: DataFrame) -> DataFrame:
    """A row per source: sid, source, source_size, target.

    Weights 1, 2, 3, repeating, go to the sources by code point, null last. The level L at which
    sum(least(3 * size, L * weight)) reaches the total is the end of resharing the excess by weight. One pass over the
    sources, in the order in which they reach their limits, finds it. Sources are labels, few beside documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumns({"weight": F.col("sid") % 3 + 1, "limit": F.col("source_size") * MOST})
    ranked = ranked.withColumn("reach", F.col("limit") / F.col("weight"))
    order, everything = Window.orderBy("reach", "sid"), Window.partitionBy(F.lit(1))
    ranked = ranked.withColumns({
        "before": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    level = (F.col("total") - F.col("before")) / F.col("open")
    found = F.min(F.when(level <= F.col("reach"), F.struct("before", level.alias("level")))).over(everything)["level"]
    target = F.least(F.col("limit").cast("double"), found * F.col("weight"))
    return ranked.select("sid", "source", "source_size", target.alias("target"))


def _positions(rows: DataFrame, group: str, size: str, *order: Column | str) -> DataFrame:
    """Adds ``start``, the sum of ``size`` over earlier rows of the group. Cells are totalled, then run side by side."""
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*order, F.lit("cell")), F.lit(CELLS)))
    over_cells = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(group, "cell").agg(F.sum(size).alias("in_cell")).select(
        group, "cell", F.coalesce(F.sum("in_cell").over(over_cells), F.lit(0)).alias("cell_start")
    )
    earlier = Window.partitionBy(group, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    return rows.join(cells, [group, "cell"]).withColumn("start", F.col("start") + F.col("cell_start")).drop("cell", "cell_start")


def quotas(targets: DataFrame, block: int) -> DataFrame:
    """Adds n_blocks and quota: the slots a source fills. Whole rounds take every block; the rest takes some of them."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    n_blocks = F.ceil(F.col("source_size") / F.lit(block))
    rest = F.round((F.col("target") - rounds * F.col("source_size")) / F.least(F.lit(block), F.greatest("source_size", F.lit(1))))
    return targets.withColumns({"n_blocks": n_blocks, "quota": (rounds * n_blocks + F.least(rest, n_blocks)).cast("long")})


def draw_slots(sources: DataFrame, shard_slots: int) -> DataFrame:
    """(sid, shard, draws, start): how many slots of each output shard a source fills, and its slots in other shards before.

    Every slot of a source's quota draws a shard, so a shard's source counts are multinomial given the quotas.
    """
    shards = F.greatest(F.lit(1), F.ceil(F.sum("quota").over(Window.partitionBy(F.lit(1))) / F.lit(shard_slots)))
    runs = sources.withColumn("shards", shards).where("quota > 0").select(
        "sid", "quota", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / RUN))).alias("run")
    )
    slots = runs.repartition("sid", "run").select(
        "sid", "shards",
        F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("quota"), (F.col("run") + 1) * RUN) - 1)).alias("slot"),
    )
    shard = F.pmod(F.xxhash64("sid", "slot", F.lit("shard")), F.col("shards"))
    draws = slots.groupBy("sid", shard.alias("shard")).agg(F.count("*").alias("draws"))
    return _positions(draws, "sid", "draws", "shard")


def taken_blocks(sources: DataFrame, shard_slots: int) -> DataFrame:
    """(sid, block, rounds, in_rest): whole rounds and, in the last incomplete one, whether the block is taken.

    A slot number is mapped by the source's index permutation: slot -> multiplier * slot + offset, modulo its blocks.
    """
    blocks = F.greatest("n_blocks", F.lit(1).cast("long"))
    multiplier = F.coalesce(*[F.when(F.col("n_blocks") % p != 0, F.lit(p).cast("long")) for p in PRIMES])
    offset = F.pmod(F.xxhash64("sid", F.lit("offset")), blocks)
    slots = draw_slots(sources, shard_slots).select(
        "sid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("draws") - 1)).alias("slot")
    ).join(sources.select("sid", blocks.alias("n_blocks"), multiplier.alias("multiplier"), offset.alias("offset"),
                          F.floor(F.col("quota") / blocks).alias("rounds")), "sid")
    block = F.pmod(F.pmod("slot", "n_blocks") * F.col("multiplier") + F.col("offset"), F.col("n_blocks"))
    in_rest = F.floor(F.col("slot") / F.col("n_blocks")) >= F.col("rounds")
    return slots.groupBy("sid", block.alias("block")).agg(
        F.count_if(~in_rest).alias("rounds"), F.count_if(in_rest).alias("in_rest")
    )


def _laid_out(docs: DataFrame, carry: list[str], block: int, shard_slots: int, store: bool) -> tuple[DataFrame, DataFrame]:
    """Documents at their place in their source, and per place what the mix takes. ``store``: the carried columns are few."""
    rows = docs.select(
        whole_row(docs, carry).alias("row"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("id_hash"),
    )
    if store:
        rows = materialize(rows)
    sources = materialize(quotas(source_targets(rows), block))
    rows = rows.join(sources.select(F.col("source").alias("own"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("own"))).drop("own", "source")
    laid = _positions(rows, "sid", "size", "id_hash")
    laid = laid.withColumn("start", F.when(F.col("size") > 0, F.col("start")))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = laid.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")
    pieces = pieces.select("sid", "start", "block", begin.alias("begin"), (end - begin).alias("length"))
    hits = pieces.join(taken_blocks(sources, shard_slots), ["sid", "block"])
    spans = F.sort_array(F.collect_list(F.when(F.col("in_rest") > 0, F.struct("begin", "length"))))  # as many as the document has blocks
    takes = hits.groupBy("sid", "start").agg(
        F.sum(F.col("length") * (F.col("rounds") + F.col("in_rest"))).alias("taken"), F.max("rounds").alias("rounds"), spans.alias("spans")
    )
    return laid, takes


def mix_amounts(docs: DataFrame, *, block: int = 128, shard_slots: int = 1024) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document: how many of its words the mix takes, repeats counted.

    The words of a source, document after document in hash order, are cut into blocks of ``block`` words. A source
    fills a quota of slots, which gives its target but for at most one and a half blocks; each slot draws its output shard; a source's
    slots run through a pseudorandom permutation of its blocks, again from the start when all are used, so no word is taken more than 3 times.
    The documents of a block are found by a join on its index.

    A null text or one without words has size 0 and gives nothing; null is a source of its own; null or repeated ids and
    repeated rows are documents of their own; an empty table gives no rows.
    """
    laid, takes = _laid_out(docs, ["doc_id"], block, shard_slots, store=True)
    return laid.join(takes.select("sid", "start", "taken"), ["sid", "start"], "left").select(
        "row.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame, *, block: int = 128, shard_slots: int = 1024) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each whole round, and one with the words that the rest takes.

    A whole round keeps the text as it is. Where the last round takes only some blocks, their words are joined by one space, and
    ``n_chars``, where present, is theirs. A document of which nothing is taken leaves. Edge cases as in ``mix_amounts``.
    """
    laid, takes = _laid_out(docs, docs.columns, block, shard_slots, store=False)
    joined = laid.join(takes, ["sid", "start"])
    whole = joined.where("rounds > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("rounds").cast("int"))).alias("__round")).drop("__round")
    text = F.transform(
        F.array(word_array(F.col("row.text"))),
        lambda ws: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(ws, (s["begin"] + 1).cast("int"), s["length"].cast("int")))), " "),
    )[0]
    part = joined.where(F.size("spans") > 0).withColumn("mixed", text)
    changed = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    part = part.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return whole.unionByName(part)
