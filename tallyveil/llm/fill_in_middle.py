"""Fill-in-middle transformation by displacement scatter.

A run of texts is one array of bytes. Prefix sums over code-point starts give the byte places of the cuts; a
difference array holds, where a segment starts, by how much its bytes move, and its cumulative sum is every byte's
shift. One numpy scatter then builds all outputs of the run, and one gather brings the texts back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import small_batches, spread, unused
from .words import text_chunks, tidy

PLAIN_FROM, SUFFIX_FIRST = 90, 20  # in hundredths
FORMS = np.array(["plain", "psm", "spm"], object)
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_WIDTH = 3
_LETTER = np.zeros(256, bool)
_LETTER[list(b"PSM")] = True
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: str = "1:") -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of eight hex digits of sha256 of ``seed`` and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def marks(data: np.ndarray) -> np.ndarray:
    """Where a mark starts."""
    if len(data) < _WIDTH:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-2] == ord("<")) & _LETTER[data[1:-1]] & (data[2:] == ord(">")))


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts from their bytes and offsets; the bytes are whole code points."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _moved(starts: np.ndarray, targets: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` bytes goes, if segments that start at ``starts`` (ascending, from 0) go to ``targets``."""
    difference = np.zeros(n + 1, np.int64)
    shift = targets - starts
    np.add.at(difference, starts, np.diff(shift, prepend=0))
    at = np.cumsum(difference[:n])
    at += np.arange(n)
    return at


def scattered(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(outputs, their offsets, code points, form, prefix and middle length) of texts; ``h``: four draws a text."""
    first, last, docs = offsets[:-1], offsets[1:], len(offsets) - 1
    starts = (data & 0xC0) != 0x80
    number = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts, out=number[1:])
    places = np.append(np.flatnonzero(starts), len(data))
    n = number[last] - number[first]
    ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cut = places[number[first][:, None] + ends]  # bytes where prefix and middle end

    found = marks(data)
    owner = np.searchsorted(last, found, "right")
    marked = np.zeros(docs, bool)
    marked[owner[found + _WIDTH <= last[np.minimum(owner, docs - 1)]]] = True
    form = np.where((n == 0) | marked | (h[:, 2] % 100 >= PLAIN_FROM), 0, np.where(h[:, 3] % 100 < SUFFIX_FIRST, 2, 1))

    prefix, suffix = cut[:, 0] - first, last - cut[:, 1]
    split, late = form > 0, form == 2
    sizes = last - first + 3 * _WIDTH * split
    out_offsets = np.append(0, np.cumsum(sizes))
    base = out_offsets[:-1]
    # The middle comes last; before it, the prefix, or in the other order the suffix, comes first.
    to_prefix = base + np.where(late, 2 * _WIDTH + suffix, _WIDTH * split)
    to_suffix = base + np.where(late, _WIDTH, 2 * _WIDTH + prefix)
    to_middle = base + 3 * _WIDTH + prefix + suffix
    plain = ~split
    to_middle[plain], to_suffix[plain] = (base + prefix)[plain], (base + cut[:, 1] - first)[plain]

    out = np.empty(out_offsets[-1], np.uint8)
    out[_moved(np.stack([first, cut[:, 0], cut[:, 1]], 1).reshape(-1), np.stack([to_prefix, to_middle, to_suffix], 1).reshape(-1), len(data))] = data
    for mark, to in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k, byte in enumerate(mark):
            out[to[split] - _WIDTH + k] = byte
    return out, out_offsets, n, form, ends[:, 0], ends[:, 1] - ends[:, 0]


def gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that outputs were made of, with their offsets; only outputs and forms are read."""
    first, last = offsets[:-1], offsets[1:]
    split = form > 0
    found = marks(data)
    owner = np.searchsorted(last, found, "right")
    inside = found + _WIDTH <= last[np.minimum(owner, max(len(last) - 1, 0))] if len(found) else np.zeros(0, bool)
    found = found[inside & split[np.minimum(owner, max(len(last) - 1, 0))]]
    owner = np.searchsorted(last, found, "right")
    if (np.bincount(owner, minlength=len(form)) != 3 * split).any():
        raise ValueError("an output does not have one mark each for prefix, suffix and middle")
    one, two, three = found.reshape(-1, 3).T if len(found) else np.zeros((3, 0), np.int64)
    sizes = last - first - 3 * _WIDTH * split
    text_offsets = np.append(0, np.cumsum(sizes))
    base = text_offsets[:-1]
    late = form[split] == 2
    head = (one + _WIDTH, two - one - _WIDTH)  # start and length of what comes first, next and last
    next_ = (two + _WIDTH, three - two - _WIDTH)
    prefix = [np.where(late, b, a) for a, b in zip(head, next_, strict=True)]
    suffix = [np.where(late, a, b) for a, b in zip(head, next_, strict=True)]
    middle = (three + _WIDTH, last[split] - three - _WIDTH)
    # Segments of the restored text in its order, and where their bytes stand in the output.
    starts = np.repeat(base[:, None], 3, axis=1)
    sources = np.repeat(first[:, None], 3, axis=1)
    starts[split] = np.stack([base[split], base[split] + prefix[1], base[split] + prefix[1] + middle[1]], 1)
    sources[split] = np.stack([prefix[0], middle[0], suffix[0]], 1)
    return data[_moved(starts.reshape(-1), sources.reshape(-1), int(text_offsets[-1]))], text_offsets


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:") -> DataFrame:
    """Every whole text cut in three at two places drawn from its id: doc_id, n (code points), form, prefix_chars,
    middle_chars (null if plain) and output.

    ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.
    ``plain``, the text itself, is what empty texts are, those that hold a mark already, and a tenth of all others.
    Null text is empty; a null id is drawn as one without digits; repeated rows are formed alike; an empty table gives
    no rows; other columns are ignored. Long texts are cut as wholes; a task holds a run of about half a megabyte, or
    one longer text.
    """
    small_batches(docs.sparkSession)

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch[f"h{k}"].to_numpy() for k in range(4)], 1)
            for row, end, data, offsets in text_chunks(batch["text"]):
                out, places, n, form, prefix, middle = scattered(data, offsets, h[row:end])
                cut = [pa.array(x, pa.int64(), mask=form == 0) for x in (prefix, middle)]
                columns = [batch["doc_id"].slice(row, end - row), pa.array(n), pa.array(FORMS[form], pa.string()), *cut, _texts(out, places).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    ids = F.col(id_col).cast("long")
    rows = docs.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(ids, seed))))
    return spread(rows).mapInArrow(tidy(formed), _SCHEMA)


def restored(formed: DataFrame, output_col: str = "output", form_col: str = "form", into: str = "text") -> DataFrame:
    """``formed`` plus the column ``into``: the exact text rebuilt from output and form alone.

    Null outputs are empty. An output whose marks are not those of its form fails. ``into`` gets another name if it is
    taken (a ``_`` in front); the other columns stay as they are.
    """
    small_batches(formed.sparkSession)
    into, names = unused(formed, into), formed.columns

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = np.array([0 if f is None or f == "plain" else 1 if f == "psm" else 2 for f in batch[form_col].to_pylist()], np.int64)
            for row, end, data, offsets in text_chunks(batch[output_col]):
                text, places = gathered(data, offsets, form[row:end])
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), _texts(text, places).cast(pa.string())], [*names, into])

    return formed.mapInArrow(tidy(texts), T.StructType([*formed.schema.fields, T.StructField(into, T.StringType())]))
