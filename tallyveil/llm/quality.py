"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features of a text, hashed to one weight table: word uni- and bigrams, n-grams of word shapes (case, digits,
closing sign, same as the word before) and how much of the text repeats its own five-word runs. Each group is
weighted by its share of the text, so a score is a sparse dot product that long texts do not saturate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import small_batches, spread
from .sampling import bounded_sample, collected, fold
from .words import lower_ascii, mix, span_hashes, spans, text_chunks, tidy, window_hashes

BITS = 18
TRAIN_DOCS = 4000  # bound of the labelled sample
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3  # of the follow-the-regularised-leader updates
THRESHOLD = 0.3
SCALE = 4.0  # of a group of n-grams in the dot product

_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _slots(hashes: np.ndarray, group: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(group * 0x9E3779B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group of features: slots of all texts, and where each text's begin; a slot counts SCALE / group size."""
    starts, ends, first = spans(data, offsets)
    last = data[np.maximum(ends, 1) - 1] if len(ends) else np.zeros(0, np.uint8)
    words = span_hashes(lower_ascii(data), starts, ends)
    count = lambda flags: np.concatenate([[0], np.cumsum(flags[data])])
    uppers, digits = count(_UPPER), count(_DIGIT)
    n_upper, n_digit = uppers[ends] - uppers[starts], digits[ends] - digits[starts]
    length = ends - starts
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][np.diff(first) > 0]] = False
    shape = np.minimum(n_upper, 2) + 3 * (n_digit > 0) + 6 * same + 12 * np.where(_SIGN[last], last.astype(np.int64), 0) + 4096 * np.minimum(length, 12)
    bare = shape % 4096
    yield _slots(words, 1), first
    for values, width, group in ((words, 2, 2), (mix(bare.astype(np.uint64)), 1, 3), (mix(bare.astype(np.uint64)), 2, 4), (mix(shape.astype(np.uint64)), 3, 5)):
        h, document, _ = window_hashes(values, first, width)
        yield _slots(h, group), np.searchsorted(document, np.arange(len(offsets)))
    # the share of five-word runs that the text has more than once, in tenths
    h, document, _ = window_hashes(words, first, 5)
    key = np.sort(mix(h) ^ mix(document.astype(np.uint64) + np.uint64(1)))
    owner = document[np.argsort(mix(h) ^ mix(document.astype(np.uint64) + np.uint64(1)), kind="stable")]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    n = len(offsets) - 1
    share = np.bincount(owner[again], minlength=n)[:n] * 10 // np.maximum(np.bincount(document, minlength=n)[:n], 1)
    yield _slots(share.astype(np.uint64), 6), np.arange(n + 1)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.full(len(offsets) - 1, self.bias)
        for slots, at in features(data, offsets):
            full = np.flatnonzero(np.diff(at))
            if len(full):
                total[full] += SCALE * np.add.reduceat(self.weights[slots], at[full]) / np.diff(at)[full]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(samples: list[tuple[str, int]], seed: int = 7) -> QualityModel:
    """Fit on (text, 0 or 1) pairs; without samples every score is one half."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    rows = []
    for _, _, data, offsets in text_chunks(pa.array([t for t, _ in samples], pa.string())):
        groups = list(features(data, offsets))
        for i in range(len(offsets) - 1):
            slots = [s[at[i] : at[i + 1]] for s, at in groups]
            ids, where = np.unique(np.concatenate([*slots, [bias]]), return_inverse=True)
            rows.append((ids, np.bincount(where, np.concatenate([*(np.full(len(s), SCALE / max(len(s), 1)) for s in slots), [1.0]]))))
    labels = [y for _, y in samples]

    def weights(ids: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[ids]) <= L1, 0.0, -(z[ids] - np.sign(z[ids]) * L1) / ((BETA + np.sqrt(n[ids])) / ALPHA + L2))

    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            ids, x = rows[i]
            w = weights(ids)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - sigma * w
            n[ids] += g * g
    every = weights(np.arange(bias + 1))
    return QualityModel(every[:-1].astype(np.float32), float(every[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> QualityModel:
    """A model from at most ``train_docs`` labelled documents; rows with a null id, text or label are not learned from.

    Labels share 48 MB of text evenly (``sampling.collected``). Repeated rows and ids count as often as they stand there;
    without labels all texts score the same.
    """
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    some, classes = bounded_sample(marked, "key", "label", train_docs)  # at most train_docs rows
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    return train(collected(texts.join(F.broadcast(some), "key"), classes))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, score (0 to 1) and predicted (1 from THRESHOLD on) for each row; null text counts as empty.

    A text without words has the score of the bias and the repetition slot alone.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch["text"]):
                s = shared.value.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, end - row), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(tidy(scored), "doc_id long, score double, predicted int")


def predict_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of documents whose checksum modulo 5 is not 0 and score all: adds ``held_out`` (it is 0)."""
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    out = score(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    return out.select("doc_id", "held_out", "score", "predicted")
