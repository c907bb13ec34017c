"""Benchmark decontamination: spaced seeds find shared word patterns, overlaps around them are verified with substitutions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.words import WordHash, mixed, slices, whole_row

MASKS = ("1101100101", "1110010011", "1011001011")  # 1: the word counts; 0: it may differ
PIECE = 3  # words of a piece; seeds of whole items are pairs of pieces
BLOCK_BYTES = 8 << 20  # benchmark text that one pass takes along
EDGES = b".,;:!?\"'()[]{}<>|*#$%&-_"
FILTER_BITS = 20


def tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z in lower case, without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w] if text else []


def _masked(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash per position of the words that the mask selects from there on."""
    total = max(0, len(ids) - len(mask) + 1)
    out = np.full(total, np.uint64(int("1" + mask, 2)))
    for k, bit in enumerate(mask):
        if bit == "1":
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + ids[k : k + total])
    return out


def enough_of_whole(words: int, min_words: int, percent: int) -> int:
    """How many equal words of an item make it a leak as a whole."""
    return max(-(-words * percent // 100), min(min_words, words))


def whole_item_seeds(words: int, changed: int) -> list[tuple[str, range]]:
    """Masks and their places in an item of so many words, one of which is untouched wherever at most ``changed`` words differ.

    Of p pieces, p - changed are untouched, and two of these are at most (p - 1) // (p - changed - 1) pieces apart. Where pieces of
    ``PIECE`` words are too few, changed + 2 pieces of any length leave two untouched.
    """
    pieces = words // PIECE
    if pieces - changed >= 2:
        apart = range(1, (pieces - 1) // (pieces - changed - 1) + 1)
        return [("1" * PIECE + "0" * PIECE * (d - 1) + "1" * PIECE, range(0, PIECE * (pieces - d), PIECE)) for d in apart]
    ends = np.linspace(0, words, min(changed + 2, words) + 1).astype(int).tolist()
    parts, out = list(zip(ends, ends[1:], strict=False)), []
    for k, (a, b) in enumerate(parts):
        out += [("1" * (b - a) + "0" * (c - b) + "1" * (d - c), range(a, a + 1)) for c, d in parts[k + 1 :]]
    return out or [("1" * words, range(1))]


class Seeds:
    """The hashed seeds of some benchmark items, and the words of the items.

    Items of at least a mask's length have the spaced seeds at every place; all items have those that find them as a whole.
    """

    def __init__(self, items: list[tuple[int, bytes]], min_words: int, percent: int):
        hasher, hashes, owners, places = WordHash(), [], [], []
        self.item_ids, self.words, self.masks = [], [], {}
        for item_id, text in items:
            words = tokens(text)
            if len(words) < min_words:
                continue
            ids = hasher.of(words)
            spaced = [(mask, range(len(words) - len(mask) + 1)) for mask in MASKS if len(words) >= len(mask)]
            for mask, at in spaced + whole_item_seeds(len(words), len(words) - enough_of_whole(len(words), min_words, percent)):
                self.masks.setdefault(mask, None)
                hashes.append(_masked(ids, mask)[at.start : at.stop : at.step])
                owners.append(np.full(len(at), len(self.words), np.int64))
                places.append(np.arange(at.start, at.stop, at.step))
            self.item_ids.append(item_id)
            self.words.append(ids)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners, self.places = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (owners, places))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(flat & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(self, ids: np.ndarray, doc: np.ndarray) -> set[tuple[int, int, int]]:
        """(document, item, shift): alignments with at least one common seed."""
        found = set()
        for mask in self.masks:
            hashes = _masked(ids, mask)
            at = np.flatnonzero(self.filter[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            first, last = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
            for here, a, b in zip(at[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
                found.update(zip([int(doc[here])] * (b - a), self.owners[a:b].tolist(), (here - self.places[a:b]).tolist(), strict=True))
        return found


def best_stretch(matches: np.ndarray, miss: int = 3) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum, where a match counts 1 and a substitution -``miss``."""
    sums = np.concatenate([[0], np.cumsum(np.where(matches, 1, -miss))])
    gains = sums - np.minimum.accumulate(sums)
    stop = int(np.argmax(gains))
    return int(np.argmin(sums[: stop + 1])), stop


def verified_overlap(matches: np.ndarray, enough: int, enough_of_all: int) -> tuple[int, int] | None:
    """(matching words, length) of an alignment that counts, else None.

    With ``enough_of_all`` matches it counts from the first to the last one. Otherwise every maximal stretch is judged, the best one,
    then those on both sides of it, and so on; the one with the most matches counts if it has ``enough``.
    """
    total = int(np.count_nonzero(matches))
    if total >= enough_of_all:
        at = np.flatnonzero(matches)
        return total, int(at[-1] - at[0]) + 1
    found, open_ = None, [matches]
    while open_:
        part = open_.pop()
        if np.count_nonzero(part) < enough:
            continue
        start, stop = best_stretch(part)
        n = int(np.count_nonzero(part[start:stop]))
        if n >= enough:
            found = max(found or (0, 0), (n, stop - start))
        open_ += [part[:start], part[stop:]]
    return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> int:
    return max(1, -(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, min_match: int = 12, min_words: int = 5, min_percent: int = 80, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_match, n_length): the best verified overlap of a document with each benchmark item it shares.

    An overlap is a stretch of aligned words, most of them equal: a word that differs costs three equal ones. It counts
    when it has ``min_match`` equal words, or all words of a shorter item. An item also counts as a whole, wherever its words differ:
    when ``min_percent`` of all its words are equal, ``min_words`` at least; no such alignment is missed. The benchmark goes through the corpus in blocks of
    bounded text, one pass each; within a pass the corpus is only scanned.
    """
    blocks = _blocks(benchmark, block_bytes)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    items = benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text"))

    def search(seeds: Seeds):
        def run(batches):
            hasher = WordHash()
            for part in slices(batches):
                lists = [tokens(t) for t in part.column("text").to_pylist()]
                ids = hasher.of([w for ws in lists for w in ws])
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                begin, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(lists)), sizes)
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for d, item, shift in seeds.hits(ids, doc):
                    words, low = seeds.words[item], max(shift, int(begin[d]))
                    high = min(shift + len(words), int(begin[d] + sizes[d]))
                    equal = ids[low:high] == words[low - shift : high - shift]
                    found = verified_overlap(equal, min(min_match, len(words)), enough_of_whole(len(words), min_words, min_percent))
                    if found:
                        best[d, item] = max(found, best.get((d, item), found))
                keys = sorted(best)
                rows = pa.array([d for d, _ in keys], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("text_hash").take(rows),
                     pa.array([seeds.item_ids[i] for _, i in keys], pa.int64()),
                     pa.array([best[k][0] for k in keys], pa.int64()), pa.array([best[k][1] for k in keys], pa.int64())],
                    ["doc_id", "text_hash", "item_id", "n_match", "n_length"],
                )

        return texts.mapInArrow(run, f"doc_id {id_type}, text_hash long, item_id long, n_match long, n_length long")

    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        seeds = Seeds(sorted(((r.item_id, bytes(r.text)) for r in own.collect()), key=lambda x: (x[0] is None, x)), min_words, min_percent)
        out = search(seeds) if out is None else out.union(search(seeds))
    return out


def _matches(hits: DataFrame, rows: DataFrame) -> Column:
    return hits["hit_id"].eqNullSafe(rows["doc_id"]) & (hits["hit_hash"] == rows["text_hash"])


def flag_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids (sorted) and max_match, the equal words of its longest overlap (0: none).

    Words are compared in lower case without punctuation at their ends. A benchmark item of under ``min_words`` words is no
    evidence; a null benchmark text neither. A null or empty document is clean. Repeated rows and ids are judged each
    by its text. An empty table gives no rows; an empty benchmark finds nothing.
    """
    hits = overlaps(docs, benchmark, **options).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_match").alias("max_match")
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    return rows.join(hits, _matches(hits, rows), "left").select(
        "doc_id", F.col("max_match").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("max_match", F.lit(0)).cast("long").alias("max_match"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without an overlap, with all their columns. Edge cases as in ``flag_documents``."""
    hits = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"))
    return rows.join(hits, _matches(hits, rows), "left_anti").select("row.*")
