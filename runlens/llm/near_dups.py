"""MinHash near-dedup: banded hash minima propose links, whole signatures drop the hopeless ones, full shingle sets confirm the rest,
components join them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.words import WordHash, mixed, shingle_hashes, slices, whole_row
from runlens.session import materialize, stored

HELD = 1 << 18  # elements of differences that a task holds before it passes them on
BANDS, ROWS = 30, 5  # a link of 0.8 is missed with a chance of 9e-6, one of 0.85 with 3e-8
DEVIATIONS = 7  # a link has fewer equal minima than this many deviations below the mean with a chance below 1e-8
TOGETHER = 512  # members of a bucket that meet one copy of their hub's text
PAIRED = 8  # members of a group that meet each other at once
TURNS = 1  # pivots that the members of larger groups meet before those in different components meet each other


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20240501).integers(0, 2**63, (2, n), dtype=np.int64).astype(np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1]


def _document_shingles(words: list[bytes], hasher: WordHash, n: int) -> np.ndarray:
    """Hashes of the shingles of one document: its runs of ``n`` words, or all its words where they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    ids = hasher.of(words)
    return shingle_hashes(ids, min(n, len(words))) + np.uint64(0 if len(words) >= n else len(words))


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (a 128-bit hash of the set), one bucket number per band, and 16 bits of every minimum."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        hasher, (factors, terms) = WordHash(), _seeds(bands * rows)
        for part in slices(batches):
            sets = [_document_shingles(t.lower().split() if t else [], hasher, shingle) for t in part.column("text").to_pylist()]
            sets = [np.unique(s) for s in sets]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            buckets = np.zeros((len(full), bands), np.uint64)
            minima = np.zeros((len(full), bands * rows), np.uint16)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.cumsum(sizes[full]) - sizes[full]
                for band in range(bands):
                    key = np.full(len(full), band + 1, np.uint64)
                    for k in range(band * rows, band * rows + rows):
                        least = np.minimum.reduceat(flat * factors[k] + terms[k], starts)
                        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + least)
                        minima[:, k] = mixed(least) >> np.uint64(48)
                    buckets[:, band] = key
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lists, signed = [None] * len(sets), [None] * len(sets)
            for at, i in enumerate(full):
                lists[i], signed[i] = buckets[at].view(np.int64), minima[at].view(np.int16)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(sizes), pa.array(keys, pa.binary()),
                 pa.array(lists, pa.list_(pa.int64())), pa.array(signed, pa.list_(pa.int16()))],
                ["doc_id", "text_hash", "n_shingles", "set_key", "buckets", "minima"],
            )

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(sign, f"doc_id {id_type}, text_hash long, n_shingles long, set_key binary, buckets array<long>, minima array<short>")


def verified(pairs: DataFrame, minima: DataFrame, least_percent: int) -> DataFrame:
    """Without the pairs that are not ``wide`` and whose signatures (node, set_key, minima) agree in too few places for a link.

    The places of a link of share t that agree are at least n t in the mean; those ``DEVIATIONS`` standard deviations below leave.
    A wide pair stays: its difference tells how the members of its bucket stand to each other. Of a node with several
    signatures, the ones that agree most count.
    """
    narrow = pairs.where("not wide")
    wanted = narrow.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    minima = minima.join(wanted, "node", "left_semi").dropDuplicates(["node", "set_key"])
    first, second = (minima.select(F.col("node").alias(c), F.col("minima").alias(f"minima_{c}")) for c in "ab")
    n, t = F.size("minima_a"), least_percent / 100
    agree = F.size(F.filter(F.arrays_zip("minima_a", "minima_b"), lambda m: m["minima_a"] == m["minima_b"]))
    hopeless = agree < n * t - DEVIATIONS * F.sqrt(n * t * (1 - t))
    likely = narrow.join(first, "a").join(second, "b").where(~hopeless).select(*pairs.columns).distinct()
    return pairs.where("wide").unionByName(likely)


def confirm(pairs: DataFrame, docs: DataFrame, least_percent: int, shingle: int) -> DataFrame:
    """Pairs (a, b, wide, part) with linked, whether the full shingle sets have 100 * intersection >= percent * union.

    Where ``wide`` is set, a row also carries both set sizes and the hashed symmetric difference of the sets. Only documents in
    a pair are read for it; a pair gets its two texts by two joins. The pairs of one ``a`` meet a copy of its text per ``part``.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.where("text is not null").join(wanted, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").cast("binary").alias("text_a")).join(pairs.select("a", "part").distinct(), "a")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").cast("binary").alias("text_b"))
    both = pairs.join(right, "b").join(left, ["a", "part"])
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def shingles(text: bytes) -> set:
        words = text.lower().split()
        n = min(shingle, len(words))
        return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    def check(batches):
        last, last_set = None, set()
        for batch in batches:
            first, second, wide = batch.column("text_a"), batch.column("text_b"), batch.column("wide")
            start, held, rows = 0, 0, []
            for row in range(batch.num_rows):
                text = first[row].as_py()
                if text != last:
                    last, last_set = text, shingles(text)
                other = shingles(second[row].as_py())
                shared = len(last_set & other)
                linked = 100 * shared >= least_percent * (len(last_set) + len(other) - shared)
                differ = None
                if wide[row].as_py():
                    apart = last_set ^ other
                    differ = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in apart), np.uint64, len(apart)).view(np.int64)
                    held += len(apart)
                rows.append((linked, len(last_set), len(other), differ))
                if held >= HELD or row + 1 == batch.num_rows:
                    part = batch.slice(start, len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("a"), part.column("b"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))],
                        ["a", "b", "linked", "size_a", "size_b", "differ"],
                    )
                    start, held, rows = row + 1, 0, []

    types = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    schema = f"a {id_type}, b {id_type}, linked boolean, size_a long, size_b long, differ array<long>"
    return both.select("a", "b", "wide", "text_a", "text_b").mapInArrow(check, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of a link with the least node it reaches, by alternating large-star and small-star.

    All is done once no node has two links down, or links both up and down.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    while True:
        edges = materialize(_stars(_stars(edges)).distinct())  # two rounds to a checkpoint: fewer files, and few components need more
        if not _unsettled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> DataFrame:
    """One round. Large-star: neighbours above a node link to the least node around it. Small-star: neighbours below a node, and
    the node, link to the least of them. Each is one shuffle; a link may come out several times."""
    least = F.min("v").over(Window.partitionBy("u"))
    around = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    large = around.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.withColumn("m", least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v")


def _unsettled(edges: DataFrame) -> int:
    """Nodes that are not yet either a least node or linked to one only. ``edges`` are distinct."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(down).alias("down")) for c, down in (("u", 1), ("v", 0))])))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
    return nodes.where("down > 1 or (down = 1 and n > 1)").count()


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows of a join in a loop: Spark would broadcast them while they are few, and the driver would build a table for every join."""
    return rows.hint("merge")


def _bound(least_percent: int) -> float:
    """A link allows a symmetric difference of at most this many times both sizes."""
    return (1 - least_percent / 100) / (1 + least_percent / 100)


def _prefixes(starred: DataFrame, least_percent: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with their difference from their hub, and per (hub, node) the elements, with their places, that decide whom it meets.

    ``starred`` is what ``confirm`` gives of (hub, node). With D the difference of a node from its hub, x and y
    must share at least (|D_x| + |D_y| - k (|x| + |y|)) / 2 elements of D_x and D_y, which is above 0 unless both are linked to the
    hub. Hence, with the elements of a hub's nodes in one order, the first |D| - least + 1 elements of both have one in common,
    and at the first common one enough elements are left in both. The order is rare elements first: edits that a node has alone
    fill its prefix, and it meets nobody. The pairs that remain are decided by their whole differences.
    """
    t, k, d = least_percent / 100, _bound(least_percent), F.size("differ")
    # a linked node needs only partners that are not linked to the hub: |D_y| > k (|y| + |hub|)
    least_linked = (d + k * (F.col("size_a") - F.col("size_b"))) / 2
    least_other = d - k * (1 + 1 / t) * F.col("size_b")
    least = F.greatest(F.lit(1), F.ceil(F.when(F.col("linked"), least_linked).otherwise(least_other) - 1e-6))
    nodes = starred.where("differ is not null").select(
        F.col("a").alias("hub"), F.col("b").alias("node"), "linked", F.col("size_b").alias("size"), d.alias("d"), (d - least + 1).alias("prefix"), "differ"
    )
    elements = nodes.where("prefix > 0").select("hub", "node", F.explode("differ").alias("element"))
    common = elements.withColumn("n", F.count("*").over(Window.partitionBy("hub", "element")))
    ordered = common.groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("ordered"))
    first = F.transform(F.slice("ordered", F.lit(1), F.col("prefix").cast("int")), lambda e, i: F.struct(i.alias("place"), e["element"].alias("element"), e["n"].alias("n")))
    rows = nodes.join(ordered, ["hub", "node"]).select("hub", "node", "linked", "size", "d", F.filter(first, lambda e: e["n"] > 1).alias("first"))
    return nodes, rows.where(F.size("first") > 0)


def _apart(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """(hub, element, n, node, ...) of those groups (hub, element) whose n nodes are in more than one component, with their component."""
    placed = rows.join(_shuffled(joined), "node", "left").select(
        "hub", "node", "linked", "size", "d", F.coalesce("component", "node").alias("component"), F.explode("first").alias("e")
    ).select("hub", "e.element", "node", "linked", "size", "d", "e.place", "component")
    group = Window.partitionBy("hub", "element")
    grouped = placed.withColumns({"n": F.count("*").over(group), "low": F.min("component").over(group), "high": F.max("component").over(group)})
    return grouped.where("low != high").drop("low", "high")


def _may_link(least_percent: int) -> Column:
    """Whether the nodes x and y of one element are in different components and have enough elements left there."""
    left = F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place"))
    enough = 2 * left >= F.col("x.d") + F.col("y.d") - _bound(least_percent) * (F.col("x.size") + F.col("y.size")) - 1e-6
    return (F.col("x.component") != F.col("y.component")) & ~(F.col("x.linked") & F.col("y.linked")) & enough


SIDE = ("node", "linked", "size", "d", "place", "component")


def _pivot_pairs(apart: DataFrame, turn: int, least_percent: int) -> DataFrame:
    """(hub, node_x, node_y): one node of each group, another one each turn, and those it may be linked to. One comparison a row."""
    pivots = apart.groupBy("hub", "element").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), *SIDE)).alias("x"))
    pairs = apart.select("hub", "element", F.struct(*SIDE).alias("y")).join(pivots, ["hub", "element"]).where(_may_link(least_percent))
    return pairs.select("hub", F.col("x.node").alias("node_x"), F.col("y.node").alias("node_y"))


def _all_pairs(apart: DataFrame, least_percent: int) -> DataFrame:
    """(hub, node_x, node_y): all nodes of one group that may be linked."""
    x, y = (apart.select("hub", "element", F.struct(*SIDE).alias(side)) for side in "xy")
    pairs = x.join(y, ["hub", "element"]).where((F.col("x.node") < F.col("y.node")) & _may_link(least_percent))
    return pairs.select("hub", F.col("x.node").alias("node_x"), F.col("y.node").alias("node_y"))


def _links(pairs: DataFrame, nodes: DataFrame, least_percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their differences from their hub. Stored first: where they are few, the differences stay in place."""
    pairs = stored(pairs.groupBy("node_x", "node_y").agg(F.min("hub").alias("hub")), "pairs")
    sides = [nodes.select("hub", F.col("node").alias(f"node_{s}"), F.col("size").alias(f"size_{s}"), F.col("d").alias(f"d_{s}"), F.col("differ").alias(f"differ_{s}")) for s in "xy"]
    both = pairs.join(sides[0], ["hub", "node_x"]).join(sides[1], ["hub", "node_y"])
    apart_by = F.col("d_x") + F.col("d_y") - 2 * F.size(F.array_intersect("differ_x", "differ_y"))
    total = F.col("size_x") + F.col("size_y")
    return both.where(100 * (total - apart_by) >= least_percent * (total + apart_by)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """``joined`` after further links. Only the components that they touch are nodes of the graph that is searched."""
    ends = [_shuffled(joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))) for c in "ab"]
    touched = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    roots = stored(components(touched), "roots")
    moved = joined.join(_shuffled(roots.toDF("component", "root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return moved.union(roots.select("node", "component"))


def _join_left(starred: DataFrame, joined: DataFrame, least_percent: int) -> DataFrame:
    """``joined`` with the links between nodes of one hub that are in different components.

    Groups of one component have nothing to find, groups of up to ``PAIRED`` nodes are compared in pairs. In larger ones,
    near copies of each other that their hub is not linked to are joined by a pivot with one comparison each; only the groups
    that ``TURNS`` pivots, or one that finds no link at all, leave in several components compare these in pairs.
    """
    nodes, rows = _prefixes(starred, least_percent)
    rows, turn = materialize(rows), 0
    while True:
        apart = materialize(_apart(rows, joined) if turn == 0 else _apart(rows, joined).where(F.col("n") > PAIRED))
        if apart.isEmpty():
            return joined
        if turn == 0:
            pairs = _all_pairs(apart.where(F.col("n") <= PAIRED), least_percent)
            if TURNS:
                pairs = pairs.union(_pivot_pairs(apart.where(F.col("n") > PAIRED), turn, least_percent))
        elif turn < TURNS:
            pairs = _pivot_pairs(apart, turn, least_percent)
        else:
            pairs = _all_pairs(apart, least_percent)
        found = materialize(_links(pairs, nodes, least_percent))
        if not found.isEmpty():
            joined = _merged(joined, found)
        elif turn < TURNS:
            turn = TURNS - 1  # more pivots would hardly find any
        if turn >= max(TURNS, 1):
            return joined
        turn += 1


def link_components(
    docs: DataFrame, members: DataFrame, minima: DataFrame, links: DataFrame | None, least_percent: int, shingle: int
) -> DataFrame:
    """(node, component) for the nodes of confirmed links among ``members`` (bucket, node), and of the given links.

    Repeated members, and nodes alone in a bucket, change nothing.

    A bucket does not emit its pairs. Its least node, the hub, is compared with the others. Nodes of one bucket that are then in
    different components are compared only where their differences from the hub allow a link; no proposed link is lost.
    """
    bucket = Window.partitionBy("bucket")
    starry = members.withColumns({"hub": F.min("node").over(bucket), "n": F.count("*").over(bucket)}).where("node != hub")
    star = starry.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.max("n").alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / TOGETHER))
    star = stored(star.select("a", "b", (F.col("n") > 2).alias("wide"), part.alias("part")), "star")
    starred = materialize(confirm(verified(star, minima, least_percent), docs, least_percent, shingle))
    found = starred.where("linked").select("a", "b")
    joined = components(found if links is None else links.union(found))
    return _join_left(starred, joined, least_percent)


def _decided(docs: DataFrame, least_percent: int, shingle: int, bands: int, rows: int) -> DataFrame:
    """A row per document: doc_id, text_hash, n_shingles, set_key, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, shingle, bands, rows))
    with_words = signed.where("set_key is not null")
    classes = with_words.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"))
    members = classes.where("node is not null").select("node", F.explode("buckets").alias("bucket"))
    class_node = classes.select("set_key", "node")
    ids = with_words.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"))
    several = ids.where("doc_id is not null and low != high").select("doc_id")
    links = None
    if not several.isEmpty():  # ids that come with several texts join the classes of these
        links = with_words.join(several, "doc_id").join(class_node, "set_key").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    minima = with_words.where("doc_id is not null").select(F.col("doc_id").alias("node"), "set_key", "minima")
    near = link_components(docs, members, minima, links, least_percent, shingle)
    found = class_node.join(near, "node", "left").select("set_key", F.coalesce("component", "node").alias("of_class"))
    component = F.coalesce("of_class", "doc_id")
    kept = F.when(component.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return signed.join(found, "set_key", "left").select(
        "doc_id", "text_hash", "n_shingles", "set_key", component.alias("component_id"), kept.alias("kept")
    )


def near_duplicates(
    docs: DataFrame, *, least_percent: int = 80, shingle: int = 5, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id reachable over links) and kept (doc_id = component_id).

    A document's set holds the distinct runs of ``shingle`` words, A-Z in lower case; with fewer words, all of them as one.
    Documents are linked where 100 * intersection >= ``least_percent`` * union, confirmed on the full sets.

    Documents of one set form a class, for which its least id stands; classes share a bucket where all ``rows`` hash
    minima of one of ``bands`` bands agree. Class members are not paired with each other. Two classes alone in their bucket are
    compared in full where their signatures agree in enough places.

    A null text, an empty one or one of white space has no shingles and is linked with nothing. An id that comes with
    several texts is one node with the links of all of them. Rows without an id follow their class and are not kept; where
    no row of a class has an id, component_id is null and they are kept. Repeated rows are equal texts. An empty table gives no rows.
    """
    return _decided(docs, least_percent, shingle, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(
    docs: DataFrame, *, least_percent: int = 80, shingle: int = 5, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row of each component, with all its columns: the one of the least id; of repeated rows, one.

    Documents without words stay. Of a class without ids, one row stays. Otherwise as in ``near_duplicates``.
    """
    decided = _decided(docs, least_percent, shingle, bands, rows).where("kept")
    chosen = decided.where("set_key is not null").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("set_key"))).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("one")
    ).select(F.struct("one.doc_id").alias("id"), F.col("one.text_hash").alias("text_hash"))
    # Null ids are equal within a struct, so the join and the window ask for one and the same shuffle of whole rows.
    rows_ = docs.select(
        whole_row(docs).alias("row"), F.struct(docs["doc_id"].alias("doc_id")).alias("id"), F.xxhash64(docs["text"]).alias("text_hash"),
        (F.length(F.translate(F.coalesce(docs["text"], F.lit("")), " \t\n\x0b\f\r", "")) > 0).alias("has_words"),
    )
    once = Window.partitionBy("id", "text_hash").orderBy(F.lit(0))
    full = rows_.where("has_words").join(_shuffled(chosen), ["id", "text_hash"], "left_semi").withColumn("copy", F.row_number().over(once)).where("copy = 1")
    return full.select("row.*").unionByName(rows_.where("not has_words").select("row.*"))
