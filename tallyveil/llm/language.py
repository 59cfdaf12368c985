"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of three and four bytes of the lower-cased text (other signs count as one space), hashed to
rows of an embedding table; a text is the mean of its rows. Table and softmax are trained by stochastic
gradient descent in numpy on a bounded sample. A temperature and a rejection threshold are fitted on a part
of the sample that training leaves out. For scoring, embeddings times class weights is one small table, which
is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import small_batches, spread
from .sampling import bounded_sample, collected, fold
from .words import text_chunks, tidy, trimmed

ROWS_BITS, WIDTH = 17, 16
SIZES = (3, 4)
TRAIN_DOCS = 2400  # bound of the training sample, all languages together
EPOCHS, RATE = 4, 0.5
ACCEPTED_ACCURACY = 0.98
LEAST_CONFIDENCE = 0.4
MAX_REJECTED = 0.02  # share of the held-back labelled texts that the threshold may reject
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each subword size: table rows of all texts, and where each text's begin (one more entry than texts).

    Runs without a letter, and runs that cross from one text to the next, are left out.
    """
    letters = _LETTER[data]
    for size in SIZES:
        n = len(letters) - size + 1
        if n <= 0:
            yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
            continue
        code, keep = np.zeros(n, np.uint32), np.zeros(n, bool)
        for k in range(size):
            part = letters[k : k + n]
            code = code * np.uint32(0x01000193) + part
            keep |= part != 32
        for k in range(1, size):
            inner = offsets[1:-1] - k
            keep[inner[(inner >= 0) & (inner < n)]] = False
        keep = np.flatnonzero(keep)
        code = code[keep]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield (code >> np.uint32(32 - ROWS_BITS)).astype(np.int32), np.searchsorted(keep, offsets)


@dataclass
class LanguageModel:
    """``languages`` in order, ``table`` (subword rows x languages, embeddings times weights), bias, temperature, threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums, count = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for rows, at in subwords(data, offsets):
            full = np.flatnonzero(np.diff(at))
            if len(full):
                sums[full] += np.add.reduceat(self.table[rows], at[full], axis=0)
            count += np.diff(at)
        logits = sums / np.maximum(count, 1)[:, None] + self.bias
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, offsets in text_chunks(pc.utf8_lower(pa.array(texts, pa.string()))):
        parts = list(subwords(data, offsets))
        for i in range(len(offsets) - 1):
            ids, counts = np.unique(np.concatenate([rows[at[i] : at[i + 1]] for rows, at in parts]), return_counts=True)
            yield ids, counts / max(counts.sum(), 1)


def train(samples: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Fit on (text, language) pairs; every fifth is kept back to calibrate temperature and rejection."""
    languages = sorted({label for _, label in samples})
    index = {x: i for i, x in enumerate(languages)}
    random = np.random.default_rng(seed)
    bags = list(_bags([t for t, _ in samples]))
    labels = np.array([index[x] for _, x in samples])
    held = random.random(len(samples)) < 0.2
    table = random.normal(0, 0.1, (1 << ROWS_BITS, WIDTH)).astype(np.float32)
    weights, bias = random.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    rows = np.flatnonzero(~held) if (~held).any() else np.arange(len(samples))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(rows):
            ids, share = bags[i]
            if not len(ids):
                continue
            mean = share @ table[ids]
            error = _softmax(mean @ weights + bias)
            error[labels[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # a text's many rows share its step: the mean moves by about one rate
            table[ids] -= (rate * share[:, None] / max((share**2).sum(), 1e-9) * back).astype(np.float32)
    model = LanguageModel(languages, (table @ weights).astype(np.float32), bias)
    return _calibrated(model, [b for b, h in zip(bags, held, strict=True) if h], labels[held])


def _calibrated(model: LanguageModel, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> LanguageModel:
    """Temperature of least log loss against smoothed labels (Platt's, so that no error is not certainty); then the least threshold whose accepted texts are right often enough.

    Labels may be noisy and languages close: whatever their errors, the threshold rejects at most MAX_REJECTED of
    the held-back texts (none of fewer than 1 / MAX_REJECTED of them).
    """
    kept = [(share @ model.table[ids] + model.bias, y) for (ids, share), y in zip(bags, labels, strict=True) if len(ids)]
    if not kept:
        return model
    logits, y = np.array([x for x, _ in kept]), np.array([k for _, k in kept])
    if len(y) < 20:
        model.threshold = min(LEAST_CONFIDENCE, float(_softmax(logits).max(axis=1).min()))
        return model
    target = np.full(logits.shape, 1 / (len(y) + 2) / max(logits.shape[1] - 1, 1))
    target[np.arange(len(y)), y] = (len(y) + 1) / (len(y) + 2)
    loss = lambda t: -(target * np.log(_softmax(logits / t) + 1e-12)).sum(axis=1).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = _softmax(logits / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    highest = float(np.sort(top)[int(MAX_REJECTED * len(top))])
    model.threshold = min(LEAST_CONFIDENCE, highest)
    for threshold in np.concatenate([[LEAST_CONFIDENCE], np.sort(top)]):
        if LEAST_CONFIDENCE <= threshold <= highest:
            model.threshold = float(threshold)
            if right[top >= threshold].mean() >= ACCEPTED_ACCURACY:
                break
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """A model from at most ``train_docs`` rows with text and language, about as many of each of the ``MAX_CLASSES`` (256)
    most frequent languages; rarer ones are not learned and so never predicted. Languages share 48 MB of text evenly
    (``sampling.collected``): a text that does not fit its language's share is left out, whatever stands before it.
    Null texts, ids and languages are not learned from; no rows give a model without languages."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).filter("key IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL")
    model = train(collected(*bounded_sample(rows, "key", "label", train_docs)))
    trimmed()
    return model


def _judged(column: pa.Array, m: LanguageModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, language index or -1, probability, rejected) of runs of texts."""
    for row, end, data, offsets in text_chunks(pc.utf8_lower(column)):
        p = m.probabilities(data, offsets) if m.languages else np.zeros((end - row, 1))
        best, top = p.argmax(axis=1), p.max(axis=1)
        plain = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        mute = np.zeros(end - row, bool)
        for i in np.flatnonzero(np.diff(plain[offsets]) == 0):  # no ASCII letter: look for others
            mute[i] = not any(map(str.isalpha, bytes(data[offsets[i] : offsets[i + 1]]).decode()))
        best[mute], top[mute] = -1, 0.0
        if not m.languages:
            best[:] = -1
        yield row, end, best, np.clip(top, 0, 1).astype(float), mute | (top < m.threshold if m.languages else False)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, lang_pred, score, rejected for each row of ``docs``.

    ``und``, score 0 and rejected: null text or no letter in the text. A model without languages says ``und`` and
    rejects no other text. Else the likeliest language and its calibrated probability, rejected below the
    model's threshold. Repeated rows each get a row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            for row, end, best, top, rejected in _judged(batch["text"], shared.value):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, end - row), pa.array(names[best], pa.string()), pa.array(top), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(tidy(score), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``identify`` does not reject; the text column must be a string."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [~rejected for _, _, _, _, rejected in _judged(batch[text_col], shared.value)]
            if flags:
                yield batch.filter(pa.array(np.concatenate(flags)))

    return spread(docs).mapInArrow(tidy(keep), docs.schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose checksum modulo 4 is not 2 and predict all: adds ``held_out`` (it is 2)."""
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    out = identify(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
