"""Substring dedup by super-k-mers: windows that share a minimiser travel as one packed string to its bucket."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.chunks import BUCKET_BYTES, ask, in_chunks, pack, packed_table, unpack
from runlens.llm.words import WordHash, mixed, shingle_hashes, slices
from runlens.session import scratch_path

SEED_WORDS = 5  # a minimiser is the least hash among the runs of so many words in a window
HOT = 8192  # a run of words found more often is frequent
DRAWN = 200  # one in so many documents is looked at for frequent runs
FREQUENT = 1 << 20  # frequent runs that are told apart at most: 8 MB
COPIES = 1000  # rows of one id and text that are combined from there on
LATE = np.uint64(1 << 63)
FILTER_BITS = 20


def window_hashes(ids: np.ndarray, window: int) -> np.ndarray:
    """A hash per run of ``window`` numbers, by doubling the length of the runs."""
    total = len(ids) - window + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    done, length, out, at = ids, 1, None, 0
    for bit in range(window.bit_length()):
        if window >> bit & 1:
            part = done[at : at + total]
            out = part if out is None else mixed(out * np.uint64(0xD6E8FEB86659FD93) + part)
            at += length
        if window >> (bit + 1):
            done = mixed(done[: len(done) - length] * np.uint64(0xA24BAED4963EE407) + done[length:])
            length *= 2
    return out


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` numbers in a row."""
    out, length = values, 1
    while length * 2 <= span:
        out = np.minimum(out[: len(out) - length], out[length:])
        length *= 2
    rest = span - length
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Frequent:
    """Hashes of frequent runs of words."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.unique(np.array(hashes, np.int64).view(np.uint64))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._cell(self.hashes)] = True

    @staticmethod
    def _cell(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where they are frequent."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[self._cell(hashes)])
        near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        return at[self.hashes[near] == hashes[at]]


def frequent_runs(docs: DataFrame, window: int, hot: int = HOT, drawn: int = DRAWN) -> tuple[Frequent, Frequent]:
    """Seeds and whole windows that occur about ``hot`` times or more, by a count over one in ``drawn`` documents.

    They only say where windows are compared. At most ``FREQUENT`` runs, the most frequent ones, reach the driver.
    """
    seed = min(SEED_WORDS, window)

    def count(batches):
        words = WordHash()
        for part in slices(batches):
            lists = [t.split() if t else [] for t in part.column("text").to_pylist()]
            ids, sizes = words.of([w for ws in lists for w in ws]), np.fromiter(map(len, lists), np.int64, len(lists))
            owner = np.repeat(np.arange(len(lists)), sizes)
            for whole, span, found in ((False, seed, shingle_hashes(ids, seed)), (True, window, window_hashes(ids, window))):
                found = found[owner[: len(found)] == owner[span - 1 : span - 1 + len(found)]]
                values, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([whole] * len(values), pa.bool_()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["whole", "run", "n"]
                )

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("seeds")), F.lit(drawn)) == 0).select(F.col("text").cast("binary").alias("text"))
    counted = some.mapInArrow(count, "whole boolean, run long, n long").groupBy("whole", "run").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= max(2, hot // drawn))
    rows = often.orderBy(F.desc("n"), "whole", "run").limit(FREQUENT).select("whole", "run").collect()
    return Frequent([r.run for r in rows if not r.whole]), Frequent([r.run for r in rows if r.whole])


def combined_copies(docs: DataFrame, copies: int = COPIES) -> DataFrame:
    """doc_id, text and n: rows of one id and text are one row where there are ``copies`` or more, so that they share a chunk.

    Their keys are a stored table, so Spark knows its size when it plans the joins.
    """
    rows, key = docs.select("doc_id", "text"), F.xxhash64("doc_id", "text")
    path = scratch_path(docs.sparkSession, "copies")
    rows.groupBy(key.alias("key")).count().where(F.col("count") >= copies).select("key").write.parquet(path)
    many = docs.sparkSession.read.parquet(path)
    single = rows.join(many, key == F.col("key"), "left_anti").withColumn("n", F.lit(1).cast("long"))
    several = rows.join(many, key == F.col("key"), "left_semi")
    return single.unionByName(several.groupBy("doc_id", "text").agg(F.count("*").alias("n")))


class Slice:
    """The windows of some documents, cut into super-k-mers.

    The minimiser of a window is its least seed that is not frequent. A window of frequent seeds only has its own hash instead; if
    it is frequent itself, the least of its seeds. Equal windows thus have one minimiser, and no minimiser gets a share of all documents.
    """

    def __init__(self, texts: list[bytes | None], words: WordHash, window: int, frequent: tuple[Frequent, Frequent] | None = None):
        lists = [t.split() if t else [] for t in texts]
        flat = [w for ws in lists for w in ws]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.text = b" ".join(flat)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])  # where each word starts
        ends = np.cumsum(self.counts)
        n = len(flat) - window + 1
        if n <= 0:
            self.first = self.last = np.zeros(0, np.int64)
            self.least = np.zeros(0, np.uint64)
            self.owner = np.zeros(0, np.int64)
            return
        ids = words.of(flat)
        seed = min(SEED_WORDS, window)
        seeds = shingle_hashes(ids, seed)
        late = frequent[0].places(seeds) if frequent else np.zeros(0, np.int64)
        seeds = seeds >> np.uint64(1)
        seeds[late] |= LATE
        least = sliding_min(seeds, window - seed + 1)
        own = np.flatnonzero(least >= LATE)
        if len(own):
            hashes = window_hashes(ids, window)[own]
            rare = np.ones(len(own), bool)
            rare[frequent[1].places(hashes)] = False
            least[own[rare]] = hashes[rare] >> np.uint64(1)
        owner = np.repeat(np.arange(len(lists)), self.counts)
        inside = owner[:n] == owner[window - 1 :]
        cut = np.ones(n, bool)
        cut[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        self.first = np.flatnonzero(cut & inside)
        stop = np.ones(n, bool)
        stop[:-1] = cut[1:] | ~inside[1:]
        self.last = np.flatnonzero(stop & inside)
        self.least = least[self.first]
        self.owner = owner[self.first]
        self.ends = ends

    def strings(self, window: int) -> list[bytes]:
        stops = self.begin[self.last + window] - 1
        return [self.text[a:b] for a, b in zip(self.begin[self.first].tolist(), stops.tolist(), strict=True)]


class Distinct:
    """The distinct super-k-mers of a chunk, in order of appearance; the chunk's rows have a fixed order (``chunks.in_order``)."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.windows: list[int] = []  # windows of each
        self.buckets: list[int] = []
        self.twice: set[int] = set()  # those found more than once

    def add(self, part: Slice, window: int, buckets: int, copies: np.ndarray) -> list[int]:
        """``copies``: how many rows each document of the part stands for."""
        homes = (part.least % np.uint64(buckets)).astype(np.int64).tolist()
        sizes = (part.last - part.first + 1).tolist()
        more = (copies > 1)[part.owner].tolist()
        found = []
        for string, home, size, copied in zip(part.strings(window), homes, sizes, more, strict=True):
            at = self.index.setdefault(string, len(self.windows))
            if at == len(self.windows):
                self.windows.append(size)
                self.buckets.append(home)
                if copied:
                    self.twice.add(at)
            else:
                self.twice.add(at)
            found.append(at)
        return found


def repeated_windows(strings: list[bytes], twice: np.ndarray, window: int) -> list[np.ndarray]:
    """Per super-k-mer, which of its windows occur elsewhere in the bucket or stand in a super-k-mer found twice.

    Windows are sorted by a hash; neighbours of one hash are then compared word by word.
    """
    lists = pc.split_pattern(pa.array(strings, pa.binary()), b" ")
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)  # words numbered in order of appearance
    hashes = window_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), window)
    counts = lengths - window + 1
    begin = np.cumsum(lengths) - lengths
    offset = np.cumsum(counts) - counts
    starts = np.repeat(begin - offset, counts) + np.arange(int(counts.sum()))
    found = hashes[starts]
    order = np.argsort(found, kind="stable")
    same = np.flatnonzero(found[order][1:] == found[order][:-1])
    left, right = starts[order[same]], starts[order[same + 1]]
    equal = np.ones(len(same), bool)
    for k in range(window):
        equal &= ids[left + k] == ids[right + k]
    repeated = np.repeat(twice.astype(bool), counts)
    repeated[order[same[equal]]] = True
    repeated[order[same[equal] + 1]] = True
    if not equal.all():  # different windows of one hash: go through all windows of these hashes by their words
        groups: dict[tuple, list[int]] = {}
        for at in np.flatnonzero(np.isin(found, found[order[same[~equal]]])).tolist():
            groups.setdefault(tuple(ids[starts[at] : starts[at] + window].tolist()), []).append(at)
        for places in groups.values():
            if len(places) > 1:
                repeated[places] = True
    return np.split(repeated, offset[1:])


def _covered(starts: np.ndarray, window: int, words: int) -> np.ndarray:
    """Which words a window at one of the starts covers."""
    steps = np.zeros(words + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(
    docs: DataFrame, *, window: int = 35, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False,
    hot: int = HOT, drawn: int = DRAWN, copies: int = COPIES,
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and ``kept_text`` where asked for.

    Removed is every word covered by a window of ``window`` consecutive words whose word sequence also starts anywhere else, the same
    document included. All windows are judged on the input. Kept words are joined by one space.

    Consecutive windows with one minimiser form a super-k-mer. A chunk of documents sends each distinct one once, with the news
    whether it holds it twice, to the bucket of the minimiser. There windows are sorted and compared word by word.
    The chunk gets a bit per window back. A passage shared by very many documents costs a bucket only its distinct super-k-mers of
    each chunk. A short line shared by them, each time in other surroundings, is no minimiser: see ``frequent_runs`` and
    ``Slice``. ``copies`` or more rows of one id and text are handled as one row with a count.

    A null text, an empty one or one of white space has no words and nothing removed; its hash is that of the empty text. Repeated
    rows, null ids and repeated ids are documents of their own, so copies of at least ``window`` words remove each
    other. An empty table gives no rows.
    """
    chunked, total = in_chunks(combined_copies(docs, copies), ["doc_id", "text", "n"])
    frequent = frequent_runs(docs, window, hot, drawn)
    buckets = max(1, -(-3 * total // bucket_bytes))  # super-k-mers overlap: about three times the text

    def parts(table: pa.Table):
        words = WordHash()
        for batch in slices(table.combine_chunks().to_batches()):
            yield batch, Slice(batch.column("text").to_pylist(), words, window, frequent)

    def send(chunk: pa.Table) -> pa.Table:
        known = Distinct()
        for batch, part in parts(chunk):
            known.add(part, window, buckets, batch.column("n").to_numpy())
        homes = np.array(known.buckets, np.int64)
        order = np.argsort(homes, kind="stable")
        strings, split = list(known.index), np.flatnonzero(np.diff(homes[order])) + 1
        number, sent = chunk.column("chunk")[0].as_py(), ([], [], [])
        for members in np.split(order, split) if len(order) else []:
            flags = bytes(48 + (m in known.twice) for m in members.tolist())
            sent[0].append(number)
            sent[1].append(int(homes[members[0]]))
            sent[2].append(pack(b"\n".join([flags, *[strings[m] for m in members.tolist()]])))
        return packed_table(*sent)

    def answer(bucket: pa.Table) -> pa.Table:
        strings, twice, sizes = [], [], []
        for row in bucket.column("packed").to_pylist():
            flags, *own = unpack(row).split(b"\n")
            strings += own
            twice.append(np.frombuffer(flags, np.uint8) == 49)
            sizes.append(len(own))
        repeated = repeated_windows(strings, np.concatenate(twice), window)
        number, sent, at = bucket.column("bucket")[0].as_py(), ([], [], []), 0
        for chunk, size in zip(bucket.column("chunk").to_pylist(), sizes, strict=True):
            bits = np.concatenate(repeated[at : at + size])
            at += size
            if bits.any():
                sent[0].append(chunk)
                sent[1].append(number)
                sent[2].append(pack(np.packbits(bits)))
        return packed_table(*sent)

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        known = Distinct()
        cut = list(parts(chunk))
        runs = [known.add(part, window, buckets, batch.column("n").to_numpy()) for batch, part in cut]
        sizes, homes = np.array(known.windows, np.int64), np.array(known.buckets, np.int64)
        base = np.cumsum(sizes) - sizes
        bits = np.zeros(int(sizes.sum()), bool)
        order = np.argsort(homes, kind="stable")
        for home, packed in zip(answers.column("bucket").to_pylist(), answers.column("packed").to_pylist(), strict=True):
            members = order[np.searchsorted(homes, home, "left", sorter=order) : np.searchsorted(homes, home, "right", sorter=order)]
            own = np.unpackbits(np.frombuffer(unpack(packed), np.uint8), count=int(sizes[members].sum())).astype(bool)
            where = np.repeat(base[members] - (np.cumsum(sizes[members]) - sizes[members]), sizes[members]) + np.arange(len(own))
            bits[where] = own
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept_text": []} if with_text else {}) | {"n": []}
        for (batch, part), found in zip(cut, runs, strict=True):
            length = part.last - part.first + 1
            at = np.repeat(part.first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            found = np.array(found, np.int64)
            hit = bits[np.repeat(base[found] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] if len(found) else np.zeros(0, bool)
            gone = _covered(at[hit], window, int(part.counts.sum()))
            stops = np.cumsum(part.counts)
            for start, stop in zip((stops - part.counts).tolist(), stops.tolist(), strict=True):
                removed = int(gone[start:stop].sum())
                if not removed:
                    kept = part.text[part.begin[start] : part.begin[stop] - 1] if stop > start else b""
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone[start:stop], [True]])))
                    kept = b" ".join(part.text[part.begin[start + a] : part.begin[start + b] - 1] for a, b in edges.reshape(-1, 2).tolist())
                out["n_words"].append(stop - start)
                out["n_removed"].append(removed)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept_text"].append(kept.decode("utf-8", "replace"))
            out["doc_id"].append(batch.column("doc_id"))
            out["n"] += batch.column("n").to_pylist()
        out["doc_id"] = pa.concat_arrays([c for c in out["doc_id"]]) if out["doc_id"] else pa.array([], docs_type)
        return pa.table({k: v if k == "doc_id" else pa.array(v, pa.int64() if k.startswith("n") else pa.string()) for k, v in out.items()})

    id_type = docs.schema["doc_id"].dataType
    docs_type = pa.int64() if id_type.simpleString() == "bigint" else pa.string()
    schema = f"doc_id {id_type.simpleString()}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    rows = ask(chunked, send, answer, finish, schema + ", n long")
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
