"""Language ID by error-correcting output codes: binary n-gram classifiers predict the bits of language codewords."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.words import mixed, slices

GRAMS = (1, 2, 3, 4)  # bytes
SLOTS = 1 << 13  # hashed n-grams
LANGUAGES = 4096  # learned at most; a label set is small beside the corpus, and this is checked


def _letters_only() -> bytes:
    """Other ASCII characters than letters become a space; bytes of other characters stay."""
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


LETTERS = _letters_only()


def gram_counts(texts: list[bytes | None]) -> np.ndarray:
    """A row per text: how often its byte n-grams, in lower case and between single spaces, fall into each slot."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        plain = b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split()) + b" "
        codes = np.frombuffer(plain, np.uint8).astype(np.uint64)
        gram = np.zeros(len(codes), np.uint64)
        for n in GRAMS:
            if len(codes) < n:
                break
            gram = (gram[: len(codes) - n + 1] << np.uint64(8)) | codes[n - 1 :]
            slot = mixed(gram + (np.uint64(n) << np.uint64(40))) & np.uint64(SLOTS - 1)
            out[row] += np.bincount(slot.astype(np.int64), minlength=SLOTS)
    return out


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 per language, far from each other.

    With few languages all different splits into two sides are used; with more, about 10 log2(languages) bits, the best of some
    seeded draws by least distance.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = range(2 ** (languages - 1) - 1)
        return np.array([[1] * len(splits)] + [[1 if s >> k & 1 else -1 for s in splits] for k in range(languages - 1)], float)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, least = None, -1
    for seed in range(50):
        draw = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits))
        distance = min(int((draw[i] != draw[i + 1 :]).sum(1).min()) for i in range(languages - 1))
        if distance > least and (np.abs(draw.sum(0)) < languages).all():
            best, least = draw, distance
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    bias: np.ndarray  # bits
    trust: np.ndarray  # bits: weight of each in decoding

    def decide(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the runner-up is close, per text."""
        langs, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t.decode("utf-8", "replace")))]
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            counts = gram_counts([texts[i] for i in part])
            shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
            margins = shares @ self.weights + self.bias
            loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
            chance = np.exp(loss.min(1, keepdims=True) - loss)
            chance /= chance.sum(1, keepdims=True)
            order = np.argsort(-chance, 1, kind="stable")
            best = chance[np.arange(len(part)), order[:, 0]]
            second = chance[np.arange(len(part)), order[:, 1]] if len(self.languages) > 1 else np.zeros(len(part))
            scores[part], unsure[part] = best, second > best / 2
            for i, at in zip(part, order[:, 0].tolist(), strict=True):
                langs[i] = self.languages[at]
        return langs, scores, unsure


def fit(counts: dict[str, np.ndarray], smoothing: float = 1.0, sharpness: float = 40.0) -> Model:
    """Bit classifiers from the summed n-gram counts of each language.

    A bit compares the mean n-gram shares of the languages on its two sides: the weight of an n-gram is the log ratio of its
    shares there. Margins are scaled so that a language's mean text has odds of ``sharpness`` to 1 for its side; a bit's trust in the
    decoding is how far its sides are apart, relative to the best bit.
    """
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((SLOTS, 1)), np.zeros(1), np.ones(1))
    code = codewords(len(languages))
    shares = np.array([(counts[x] + smoothing) / (counts[x] + smoothing).sum() for x in languages])
    weights, bias, gap = np.zeros((SLOTS, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        plus, minus = code[:, bit] > 0, code[:, bit] < 0
        if plus.any() and minus.any():
            w = np.log(shares[plus].mean(0)) - np.log(shares[minus].mean(0))
            means = shares @ w
            middle = (means[plus].min() + means[minus].max()) / 2
            gap[bit] = max(1e-9, means[plus].min() - means[minus].max())
            weights[:, bit], bias[bit] = w, -middle
    scale = 2 * np.log(sharpness) / gap
    return Model(languages, code, weights * scale, bias * scale, gap / gap.max())


def sampled(rows: DataFrame, key: str, counts: dict[str, int], most: int, at_once: int = 16) -> DataFrame:
    """About ``most`` rows of each key, those whose hash of the text falls below the key's share, in a bounded number of parts.

    ``counts`` has the rows of each key, so the rows are filtered where they are read; only the sample is shuffled.
    """
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, most / n)])
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < F.element_at(shares, F.col(key))).repartition(at_once, F.xxhash64("text"))


def train(docs: DataFrame, per_language: int = 4000) -> Model:
    """Fits on ``text`` and ``lang`` of the given rows, about ``per_language`` rows of each language, drawn by a hash of the text.

    Each of a bounded number of tasks sums n-gram counts per language; the sums reach the driver. Rows without text or
    language are not used. More than ``LANGUAGES`` languages are refused.
    """
    rows = docs.where("lang is not null and text != ''").select("lang", F.col("text").cast("binary").alias("text"))
    found = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not found:
        return fit({})

    def add_up(batches):
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for start in range(0, len(texts), 256):
                counts = gram_counts(texts[start : start + 256])
                own = np.array(langs[start : start + 256], object)
                for lang in set(own.tolist()):
                    sums[lang] = sums.get(lang, 0) + counts[own == lang].sum(0, dtype=np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tobytes() for x in names], pa.binary())], ["lang", "counts"])

    totals: dict[str, np.ndarray] = {}
    for row in sampled(rows, "lang", found, per_language).mapInArrow(add_up, "lang string, counts binary").toLocalIterator():
        totals[row.lang] = totals.get(row.lang, 0) + np.frombuffer(bytes(row.counts), np.float64)
    return fit(totals)


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1) and ambiguous (the runner-up has more than half the best's score).

    Only the text is looked at. A text that is null or has no letter, and any text where nothing could be learned, is ``und``
    with score 0 and ambiguous. Null and repeated ids and repeated rows are rows like others; an empty table gives no rows.
    """

    def run(batches):
        for part in slices(batches):
            langs, scores, unsure = model.decide(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs), pa.array(scores), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, ambiguous boolean")


def learn_and_identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learns from the folds other than ``held`` and identifies all documents; adds held_out. A null id is not learned from."""
    model = train(docs.where(fold(folds) != held))
    return identify(docs, model).withColumn("held_out", F.coalesce(fold(folds) == held, F.lit(False)))
