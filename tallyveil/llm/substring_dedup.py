"""Substring dedup: remove words covered by a window that an earlier document also holds.

1. Texts are dealt to parts; the count-min sketch, merged by hash range, overestimates every window's count and
   tells each part which of its windows may be repeated.
2. A second pass keeps only windows estimated repeated. Inside a part a window's later documents are settled at
   once, so one document for each part and window goes on, however hot it is; those windows are grouped exactly
   by 96 bits of hash and the smallest document wins.
3. Removed runs of words return to their parts, and the kept words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import small_batches
from .words import mix, pressed, span_hashes, spans, text_chunks, tidy_group, unpressed, window_hashes

WINDOW = 13
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others
BUCKETS_A_BLOCK = 2  # as a power of two: windows estimated repeated are grouped in finer ranges than blocks
_WINDOW_KINDS = {"h": np.uint64, "g": np.uint32, "doc": np.int64, "row": np.uint32, "pos": np.uint32}
_RUN_KINDS = {"row": np.uint32, "pos": np.uint32, "length": np.uint32}
_SCHEMA = "bucket int, part int, kind int, n int, " + ", ".join(f"{k} binary" for k in dict.fromkeys([*_WINDOW_KINDS, *_RUN_KINDS]))
_NAMES = list(dict.fromkeys([*_WINDOW_KINDS, *_RUN_KINDS]))


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


def _texts(rows: pa.Table) -> pa.Array:
    return rows["text"].combine_chunks()


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with fields that may be null at every level, as Spark expects results to be."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    return pa.list_(_nullable(kind.value_type)) if pa.types.is_list(kind) else kind


def _in_order(rows: pa.Table) -> np.ndarray:
    """The order of a part's rows: by id, then by a hash of the text."""
    tags = [span_hashes(data, offsets[:-1], offsets[1:]) for _, _, data, offsets in text_chunks(_texts(rows))]
    return np.lexsort((np.concatenate(tags), _ids(rows["doc_id"])))


def _windows(rows: pa.Table, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, second hash, row and start word of the windows of runs of texts."""
    for row, _, data, offsets in text_chunks(_texts(rows)):
        starts, ends, first = spans(data, offsets)
        words = span_hashes(data, starts, ends)
        h, document, pos = window_hashes(words, first, window)
        g, _, _ = window_hashes(mix(words + np.uint64(7)), first, window, 2)
        yield h, (g >> np.uint64(32)).astype(np.uint32), (document + row).astype(np.uint32), pos.astype(np.uint32)


def _settled(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The windows by hash and document, and which of them a smaller document also holds."""
    order = np.lexsort((c["doc"], c["g"], c["h"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["h"][1:] != c["h"][:-1]) | (c["g"][1:] != c["g"][:-1])
    return c, c["doc"] > c["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]


def _encoded(bucket: int, part: int, kind: int, c: dict[str, np.ndarray]) -> dict:
    return {"bucket": bucket, "part": part, "kind": kind, "n": len(c["row"])} | {k: pressed(v) for k, v in c.items()}


def _decoded(x: dict, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {k: unpressed(x[k], x["n"], t) for k, t in kinds.items()}


def _table(rows: list[dict]) -> pa.Table:
    columns = {k: pa.array([x[k] for x in rows], pa.int32()) for k in ("bucket", "part", "kind", "n")}
    return pa.table(columns | {k: pa.array([x.get(k) for x in rows], pa.binary()) for k in _NAMES})


def _runs(bucket: int, part: int, row: np.ndarray, pos: np.ndarray) -> dict:
    """Removed windows of a part as runs of consecutive starts."""
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + np.uint32(1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return _encoded(bucket, part, 1, {"row": row[first], "pos": pos[first], "length": pos[last] - pos[first]})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of ``docs``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (kept words joined by a space).

    A window is ``window`` consecutive words of one row. A word goes if a window over it also starts in a row
    with a smaller id; windows are judged on the input. Null text: no words, kept is ''. Texts with fewer words
    than a window: nothing goes. ``carry`` names further columns to keep. Null id: counts as larger than all others.
    Rows that share an id are separate texts and do not remove from each other. Columns not named are ignored; an
    empty table gives no rows. A task holds one part of some MB, or a text that is longer.
    """
    small_batches(docs.sparkSession)
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("boolean")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried"))
    layout = sketch.Layout.of(sketch.text_bytes(docs, "text"))
    parts = sketch.dealt(docs, layout)
    bucket_bits = layout.block_bits + BUCKETS_A_BLOCK

    def hashes(rows: pa.Table) -> Iterator[np.ndarray]:
        for h, _, _, _ in _windows(rows, window):
            yield h

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([])
        part, docs_ = left["part"][0].as_py(), sketch.opened(left, _in_order)
        h, g, row, pos = (np.concatenate(x) for x in zip(*_windows(docs_, window), strict=True))
        keep = np.flatnonzero(sketch.repeated(h, right, layout)) if len(h) else []
        if not len(keep):
            return _table([])
        c, late = _settled({"h": h[keep], "g": g[keep], "doc": _ids(docs_["doc_id"])[row[keep]], "row": row[keep], "pos": pos[keep]})
        out = [_runs(part % (1 << bucket_bits), part, c["row"][late], c["pos"][late])] if late.any() else []
        on = {k: v[~late] for k, v in c.items()}
        bucket = (on["h"] >> np.uint64(64 - bucket_bits)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        return _table(out + [_encoded(int(bucket[a]), part, 0, {k: v[a:b] for k, v in on.items()}) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def grouped(bucket: pa.Table) -> pa.Table:
        rows = bucket.to_pylist()
        here = [x for x in rows if not x["kind"]]
        out = [x for x in rows if x["kind"]]
        if len(here) > 1:  # a part has settled its own windows
            pieces = [_decoded(x, _WINDOW_KINDS) | {"part": np.full(x["n"], x["part"], np.int32)} for x in here]
            c, late = _settled({k: np.concatenate([x[k] for x in pieces]) for k in pieces[0]})
            order = np.argsort(c["part"][late], kind="stable")
            part, row, pos = (c[k][late][order] for k in ("part", "row", "pos"))
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            out += [_runs(0, int(part[a]), row[a:b], pos[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        return _table(out)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        docs_ = sketch.opened(left, _in_order)
        runs = [_decoded(x, _RUN_KINDS) for x in right.to_pylist()]
        row, pos, length = (np.concatenate([x[k] for x in runs]) if runs else np.zeros(0, np.uint32) for k in _RUN_KINDS)
        order = np.argsort(row, kind="stable")
        row, pos, length = row[order], pos[order], length[order]
        at = np.searchsorted(row, np.arange(len(docs_) + 1))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(_texts(docs_)):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            if at[i] < at[i + 1]:
                begin = pos[at[i] : at[i + 1]].astype(np.int64)
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, begin, 1)
                np.add.at(cover, np.minimum(begin + length[at[i] : at[i + 1]] + window, n), -1)
                words = [w for w, c in zip(words, np.cumsum(cover)[:n].tolist(), strict=True) if not c]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words))
        return pa.table({"doc_id": docs_["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "carried": docs_["carried"].cast(_nullable(docs_["carried"].type))})

    replies = sketch.answers(parts, hashes, layout)
    windows = parts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(tidy_group(candidates), _SCHEMA)
    removed = windows.repartition(min(1 << bucket_bits, sketch.MAX_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(tidy_group(grouped), _SCHEMA)
    kind = docs.schema["carried"].dataType.simpleString()
    out = parts.groupBy("part").cogroup(removed.groupBy("part")).applyInArrow(tidy_group(joined), f"doc_id long, n_words long, n_removed long, kept string, carried {kind}")
    return out.select("doc_id", "n_words", "n_removed", "kept", *(F.col("carried").getField(c).alias(c) for c in carry))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs``, same columns, with the repeated words cut from the texts and the lengths set anew.

    Texts that lose nothing stay as they are; rows that lose all their words go.
    """
    rest = tuple(c for c in docs.columns if c != id_col)
    out = substring_dedup(docs, id_col, text_col, window, carry=rest).filter("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {id_col: F.col("doc_id"), text_col: F.when(cut, F.col("kept")).otherwise(F.col("_" + text_col))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(cut, F.char_length("kept").cast(docs.schema[chars_col].dataType)).otherwise(F.col("_" + chars_col))
    out = out.toDF("doc_id", "n_words", "n_removed", "kept", *("_" + c for c in rest))
    return out.select(*(new.get(c, F.col("_" + c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
