"""Language-model scores by stupid backoff: hashed n-gram counts of the whole corpus, joined back and summed per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm.chunks import BUCKET_BYTES, ask, in_chunks, pack, pack_hashes, packed_table, unpack, unpack_hashes
from runlens.llm.words import WordHash, count_words, shingle_hashes, slices

BACKOFF = 0.4


class Grams:
    """The n-grams of a chunk's documents: per order the hashes by position, and which positions are within one document."""

    def __init__(self, chunk: pa.Table, order: int):
        hasher, ids, counts, self.doc_ids = WordHash(), [], [], []
        for part in slices(chunk.combine_chunks().to_batches()):
            lists = [t.split() if t else [] for t in part.column("text").to_pylist()]
            ids.append(hasher.of([w for ws in lists for w in ws]))
            counts += map(len, lists)
            self.doc_ids.append(part.column("doc_id"))
        self.counts = np.array(counts, np.int64)
        words = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hashes, self.inside = [], []
        for n in range(1, order + 1):
            self.hashes.append(shingle_hashes(words, n) ^ np.uint64(n))
            self.inside.append(owner[: max(0, len(words) - n + 1)] == owner[n - 1 :])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """All distinct n-grams, sorted, and how often each occurs."""
        return np.unique(np.concatenate([h[i] for h, i in zip(self.hashes, self.inside, strict=True)]), return_counts=True)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted keys pass from bucket to bucket; a bucket is an equal share of the number range."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def score_documents(
    docs: DataFrame, *, order: int = 2, min_count: int = 2, backoff: float = BACKOFF, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Per document: doc_id, n_words, n_backed_off (words scored by a shorter n-gram than their place allows), log_score (sum over
    its words) and mean_log_score.

    A word w after its context c, the words before it in the document, up to ``order`` - 1, scores
    count(c w) / count(c) where count(c w) >= ``min_count``; else ``backoff`` times its score after the context without its first
    word; at the end count(w) / all words. An n-gram below ``min_count`` says nothing but itself, as the scored documents are the
    corpus. Counts cover the whole table.

    Chunks of documents send their distinct n-grams with counts, as sorted hashes, to the bucket of the hash; a bucket
    adds the counts and returns them to each chunk, where scores are summed per document. A frequent n-gram is one entry per chunk.

    A null text or one without words has 0 words, log_score 0 and a null mean. Repeated rows, null ids and
    repeated ids are documents of their own, and all are counted. An empty table gives no rows.
    """
    chunked, total = in_chunks(docs, ["doc_id", "text"])
    buckets = max(1, -(-2 * order * total // bucket_bytes))

    def send(chunk: pa.Table) -> pa.Table:
        keys, counts = Grams(chunk, order).distinct()
        number, sent = chunk.column("chunk")[0].as_py(), ([], [], [])
        cuts = _cuts(keys, buckets)
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[bucket], cuts[bucket + 1])
            head, tail = pack_hashes(keys[own]), pack(counts[own].astype(np.int32))
            sent[0].append(number)
            sent[1].append(bucket)
            sent[2].append(len(head).to_bytes(4, "little") + head + tail)
        return packed_table(*sent)

    def answer(bucket: pa.Table) -> pa.Table:
        keys, counts = [], []
        for row in bucket.column("packed").to_pylist():
            length = int.from_bytes(row[:4], "little")
            keys.append(unpack_hashes(row[4 : 4 + length]))
            counts.append(np.frombuffer(unpack(row[4 + length :]), np.int32))
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)[place]
        ends = np.cumsum([len(k) for k in keys])
        return packed_table(
            bucket.column("chunk").to_pylist(), bucket.column("bucket").to_pylist(), [pack(t) for t in np.split(totals, ends[:-1])]
        )

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(chunk, order)
        keys, _ = grams.distinct()
        cuts, totals = _cuts(keys, buckets), np.zeros(len(keys), np.int64)
        for bucket, packed in zip(answers.column("bucket").to_pylist(), answers.column("packed").to_pylist(), strict=True):
            totals[cuts[bucket] : cuts[bucket + 1]] = np.frombuffer(unpack(packed), np.int64)
        n = len(grams.hashes[0])
        score = np.zeros(n)
        backed = np.ones(n, bool)
        known = np.zeros(n, bool)
        place = np.arange(n) - np.repeat(np.cumsum(grams.counts) - grams.counts, grams.counts)
        found = [np.where(i, totals[np.searchsorted(keys, np.where(i, h, keys[0]))], 0) if n else np.zeros(0) for h, i in zip(grams.hashes, grams.inside, strict=True)]
        for size in range(order, 1, -1):
            at = np.flatnonzero(grams.inside[size - 1])  # the n-gram starts here and ends size - 1 later
            whole, context = found[size - 1][at], found[size - 2][at]
            at, whole, context = (x[(whole >= min_count) & ~known[at + size - 1]] for x in (at, whole, context))
            steps = np.minimum(place[at + size - 1], order - 1) - (size - 1)
            score[at + size - 1] = np.log(whole / context) + steps * np.log(backoff)
            known[at + size - 1] = True
            backed[at + size - 1] = steps > 0
        rest = ~known
        steps = np.minimum(place[rest], order - 1)
        score[rest] = np.log(found[0][rest] / words_total) + steps * np.log(backoff)
        backed[rest] = steps > 0
        sums = np.add.reduceat(np.append(score, 0.0), np.cumsum(grams.counts) - grams.counts) if len(grams.counts) else np.zeros(0)
        misses = np.add.reduceat(np.append(backed, False).astype(np.int64), np.cumsum(grams.counts) - grams.counts) if len(grams.counts) else np.zeros(0, np.int64)
        empty = grams.counts == 0
        sums[empty], misses[empty] = 0.0, 0
        means = pa.array(sums / np.maximum(grams.counts, 1), mask=empty)
        ids = pa.chunked_array(grams.doc_ids) if grams.doc_ids else chunk.column("doc_id")
        return pa.table({"doc_id": ids, "n_words": grams.counts, "n_backed_off": misses, "log_score": sums, "mean_log_score": means})

    words_total = max(1, count_words(docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_backed_off long, log_score double, mean_log_score double"
    return ask(chunked, send, answer, finish, schema)
