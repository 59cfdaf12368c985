"""Best-fit packing with certified bounds.

Documents are tokenised and cut at the sequence length. Pieces are dealt to partitions of bounded size; each
is packed by best-fit decreasing and certified against a lower bound from dual feasible functions. Partitions
above their bound give up their loosest bins, certified ones only the loosest one (their bound is rounded up);
the documents in them are dealt anew and packed again, until one partition is left or ``ROUNDS`` rounds are over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import saved, small_batches, spread
from .tokens import WORD_BPE, forget, word_tokens
from .words import tidy

LENGTH = 4096
END_ID = 1
PARTITION_PIECES = 20_000
ROUNDS = 6
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` tokens of every text plus ``end_id``; only longer documents are cut.

    Null text is empty (one piece, the end id alone); null ids and repeated rows stay as they are. With
    ``with_ids`` the column ``ids`` holds little-endian unsigned 32-bit ids.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = tokens.encode(text.as_py()) + end
                for k in range(0, len(ids), 4 * length):
                    part = ids[k : k + 4 * length]
                    rows.append((doc_id, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
        forget()

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(docs).mapInArrow(tidy(cut), _PIECE + ", ids binary" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of the dual feasible functions f_a: over capacity - a counts whole, under a not at all.

    One pass over a histogram of lengths gives the bounds for all a up to half of the capacity.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    number, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    a = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - a]
    middle = tokens[capacity - a] - tokens[a - 1]
    return int(max(-(-(whole * capacity + middle) // capacity), default=0)) if len(lengths) else 0


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins; each item goes to the fullest bin with room for it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r: a bin with room r is there
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        by_room[room - size].append(b)
        mask |= 1 << (room - size)
    return bins, offsets, n


def _packed(group: pd.DataFrame, capacity: int, number: int) -> pd.DataFrame:
    """The partition's rows with bin, offset and whether their bin is given up."""
    lengths = group["length"].to_numpy(np.int64)
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    room = capacity - np.bincount(bins, lengths, n).astype(np.int64)
    gap = n - lower_bound(lengths, capacity)
    # Over its bound, a partition gives up the loosest bins: enough to fill the gap's bins several times over.
    loose = np.argsort(-room, kind="stable")[: 1 if gap <= 0 else 16 * gap + 16]
    given = np.zeros(n, bool)
    given[loose[room[loose] > 0]] = True
    part = int(group["part"].iloc[0])
    return group.assign(sequence_id=(number << 56) + (part << 24) + bins, offset=offsets, open=given[bins])


def _packer(capacity: int, number: int):
    return lambda group: _packed(group, capacity, number)


def pack(pieces: DataFrame, length: int = LENGTH, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; sequences are gapless from offset 0.

    Pieces are dealt by hash, so a partition holds about ``partition_pieces`` rows whatever the ids; repeated
    rows are packed each. An empty table gives no rows.
    """
    names = pieces.columns
    left, done = saved(pieces, "pieces"), None
    schema = ", ".join(f"{n} {t}" for n, t in left.dtypes) + ", part int, sequence_id long, offset long, open boolean"
    for number in range(rounds):
        parts = max(1, -(-left.count() // partition_pieces))
        dealt = left.withColumn("part", F.pmod(F.xxhash64(*[n for n in ("doc_id", "piece", "ids_crc32") if n in names], F.lit(number)), F.lit(parts)).cast("int"))
        out = saved(dealt.groupBy("part").applyInPandas(_packer(length, number), schema), "packed")
        last = parts == 1 or number == rounds - 1
        closed = (out if last else out.filter("NOT open")).select(*names, "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        left = out.filter("open").select(*names)
    return done


def packed_sequences(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """One row a sequence: ``sequence_id``, ``n_tokens`` and ``ids`` (array<long>), for training."""
    rows = pack(token_pieces(docs, length=length, with_ids=True, **options), length)
    parts = rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int64) for x in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], batch["n_tokens"], pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "n_tokens", "ids"])

    return parts.mapInArrow(joined, "sequence_id long, n_tokens long, ids array<long>")
