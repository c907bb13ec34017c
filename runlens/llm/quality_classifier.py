"""Quality classifier learned from trusted positives and unlabelled text, by non-negative unbiased risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.language_id import fold
from runlens.llm.words import slices

KINDS = 8  # letters, capitals, digits, spaces, line breaks, stops, other marks, control characters


def _kinds() -> bytes:
    def kind(b: int) -> int:
        char = chr(b)
        if b >= 128 or char.islower():
            return 0
        if char.isupper():
            return 1
        if char.isdigit():
            return 2
        if char in " \t":
            return 3
        if char in "\n\r":
            return 4
        if char in ".,;:'":
            return 5
        return 6 if 32 < b < 127 else 7

    return bytes(map(kind, range(256)))


KIND_OF = _kinds()
SHAPES = KINDS**3


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row per text: roots of the shares of each run of three kinds of characters, and measures of length and repetition.

    A null text is an empty one.
    """
    out = np.zeros((len(texts), SHAPES + 8), np.float32)
    for row, text in enumerate(texts):
        text = text or b""
        kinds = np.frombuffer(text.translate(KIND_OF), np.uint8).astype(np.int64)
        if len(kinds) > 2:
            runs = np.bincount((kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:], minlength=SHAPES)
            out[row, :SHAPES] = np.sqrt(runs / (len(kinds) - 2))
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        n = max(1, len(words))
        out[row, SHAPES:] = (
            np.log1p(len(words)), np.log1p(len(text) / n), len(words) < 10, len(words) < 25,
            len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / n,
            len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) / n, len(set(lines)) / max(1, len(lines)),
        )
    return out


@dataclass(frozen=True)
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the bias
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_scaled(rows, self.middle, self.spread) @ self.weights, -40, 40)))


def _scaled(rows: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((rows - middle) / spread, -6, 6), np.ones((len(rows), 1))])


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam with a fixed number of full steps."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, decay: float, steps: int) -> float:
    """The share of positives among the unlabelled.

    A classifier of positive against unlabelled rows orders both. Above any cut, the share of unlabelled rows is at least prior
    times the share of positives, and equal where no negatives are left: the prior is the least ratio of the two over a
    grid of cuts, among rows that the classifier has not seen. The share of the unlabelled is taken two standard errors
    low: too high a prior leaves no risk for negatives, one a little low hardly matters.
    """
    def fitted(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        def gradient(w):
            a, b = 1 / (1 + np.exp(p @ w)), 1 / (1 + np.exp(-(u @ w)))
            return -(a @ p) / len(p) + (b @ u) / len(u) + decay * w

        return _descend(gradient, p.shape[1], steps)

    w = fitted(positive[::2], unlabelled[::2])
    seen, rest = positive[1::2] @ w, unlabelled[1::2] @ w
    if not len(seen) or not len(rest):
        return 0.5
    cuts = np.quantile(seen, np.linspace(0.05, 0.7, 14))[:, None]
    of_rest, of_seen = (rest > cuts).mean(1), np.maximum((seen > cuts).mean(1), 1e-9)
    low = of_rest - 2 * np.sqrt(of_rest * (1 - of_rest) / len(rest))
    return float(np.clip((low / of_seen).min(), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, prior: float | None = None, decay: float = 1e-3, steps: int = 400) -> Model:
    """Minimises prior * E+[loss(f)] + max(0, E_u[loss(-f)] - prior * E+[loss(-f)]) with logistic loss.

    Where the second part is negative, its gradient is climbed back instead. Without positives or without unlabelled rows the
    score is 0.5 throughout.
    """
    width = (unlabelled if len(unlabelled) else positive).shape[1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
    middle, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = _scaled(positive, middle, spread), _scaled(unlabelled, middle, spread)
    if prior is None:
        prior = estimate_prior(p, u, 0.01, steps // 2)

    def gradient(w):
        fp, fu = p @ w, u @ w
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up = -(1 / (1 + np.exp(fp))) @ p / len(p) * prior
        down = (1 / (1 + np.exp(-fu))) @ u / len(u) - prior * (1 / (1 + np.exp(-fp))) @ p / len(p)
        return (up + down if rest >= 0 else -down) + decay * w

    return Model(middle, spread, _descend(gradient, p.shape[1], steps), prior)


def train(docs: DataFrame, positive_ids: DataFrame, most: int = 8000) -> Model:
    """Fits on at most about ``most`` trusted positives and ``most`` of all rows, drawn by a hash of the text.

    Only their features reach the driver: 2 * ``most`` rows of a fixed width.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def drawn(rows: DataFrame) -> np.ndarray:
        n = rows.count()
        draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

        def run(batches):
            for part in slices(batches):
                values = features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in values], pa.binary())], ["features"])

        picked = rows.where(draw < most / max(n, 1)).select("text").mapInArrow(run, "features binary").collect()
        packed = sorted(bytes(r.features) for r in picked)
        return np.frombuffer(b"".join(packed), np.float32).reshape(-1, SHAPES + 8).astype(np.float64)

    positive = drawn(texts.join(positive_ids.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi"))
    return fit(positive, drawn(texts))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher: good quality likelier) and predicted (1 from the threshold on).

    Only the text is looked at; a null text scores as an empty one. Null and repeated ids and repeated rows are rows like others.
    An empty table gives no rows.
    """

    def run(batches):
        for part in slices(batches):
            scores = model.score(features(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(scores >= threshold).cast(pa.int32())], ["doc_id", "score", "predicted"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from documents and labels of the folds other than ``held``, scores all documents, and adds held_out."""
    model = train(docs.where(fold(folds) != held), labels.where(fold(folds) != held).where("quality = 1"))
    return score_quality(docs, model).withColumn("held_out", F.coalesce(fold(folds) == held, F.lit(False)))
