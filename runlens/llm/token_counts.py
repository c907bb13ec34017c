"""Token counts of a unigram tokenizer without tokenizing: a Viterbi pass that carries best score and piece count only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.words import slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: how far an unknown character scores below the worst piece
CACHED = 1 << 18  # words whose counts a task remembers
CACHED_CHARS = 40


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``bytes_known``: unknown characters become one piece per byte."""

    pieces: Sequence[tuple[str, float]]
    bytes_known: bool

    @staticmethod
    def load(path: str) -> Vocabulary:
        """From a sentencepiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        names = {p for p, _ in pieces}
        return Vocabulary(pieces, all(f"<0x{b:02X}>" in names for b in range(256)))


class Counter:
    """Counts the pieces of words. A word begins with the space mark and holds no other."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_known = vocabulary.bytes_known
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path.

        Paths are compared at each end position in the order of the start of their last piece, and only a higher score replaces one that is
        there. Where no single-character piece fits, the character may be unknown, as the last choice. Unknown characters count their
        bytes, or, without byte pieces, a run of them counts once.
        """
        n = len(word)
        scores, counts, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(word):
            matches[end].append(found)
        for end in range(1, n + 1):
            best, single = None, False
            for length, score in sorted(matches[end - 1], reverse=True):
                total = scores[end - length] + score
                single |= length == 1
                if best is None or total > best:
                    best, counts[end] = total, counts[end - length] + 1
            if not single and (best is None or scores[end - 1] + self.unknown > best):
                best, unknown[end] = scores[end - 1] + self.unknown, True
                own = len(word[end - 1].encode()) if self.bytes_known else int(not unknown[end - 1])
                counts[end] = counts[end - 1] + own
            scores[end] = best
        return counts[n], scores[n]

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text. A space, and the space mark itself, start a word; the first word has one in any case."""
        if not text:
            return 0, 0.0
        pieces, score, cache = 0, 0.0, self.cache
        for word in text.removeprefix(text[0] if text[0] in (" ", SPACE) else "").replace(SPACE, " ").split(" "):
            found = cache.get(word)
            if found is None:
                found = self.word(SPACE + word)
                if len(word) <= CACHED_CHARS:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[word] = found
            pieces += found[0]
            score += found[1]
        return pieces, score


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document: doc_id, n_tokens and log_score, the sum of the pieces' scores.

    A null or empty text has no tokens. Null and repeated ids and repeated rows are rows like others. An empty table gives
    no rows. The work of a word grows with its length and the matches in it, so one very long word takes no more than its share.
    """

    def run(batches):
        counter = Counter(vocabulary)
        for part in slices(batches):
            found = [counter.text(t.decode("utf-8", "replace")) if t else (0, 0.0) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "n_tokens", "log_score"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {id_type}, n_tokens long, log_score double")
