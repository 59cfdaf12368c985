"""Count-min sketches of 64-bit hashes, split by hash range, whatever the size of the input.

Texts are dealt to parts of a few MB (``dealt``). A part sends each block, a range of hashes, the distinct hashes
that it holds there as sorted codes: its partial sketch, in sparse form. A block merges the parts' codes into a
count-min table of two rows and answers each part with one bit a code: counted twice or more. Counts are
overestimates, so a hash whose bit is not set occurs once at most: no repeated hash is lost.

A block covers a bounded number of hashes, so tables, tasks and the share of wrong answers do not grow with the
input; the number of blocks does. Nothing is broadcast and nothing reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, pressed, tidy, tidy_group, unpressed

PART_BYTES = 6 << 20  # text of a part; a task holds one part at a time
BLOCK_HASHES = 1 << 21  # hashes of a block
CODE_BITS = 27  # of a hash inside its block
CELLS = 4  # of a hash in each row of the table
MAX_PARTITIONS = 8192  # shuffle partitions that parts or blocks are dealt to; each then holds many, one after another
HELD_BYTES = 8 << 20
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Layout:
    """Numbers of parts and of blocks (a power of two) for texts of ``n_bytes``.

    Parts and blocks keep their size up to some TB; beyond, both grow with the square root of the input, so that
    the pieces that parts send to blocks stay in proportion to it.
    """

    parts: int
    block_bits: int
    code_bits: int

    @classmethod
    def of(cls, n_bytes: int, bytes_an_item: int = 6) -> Layout:
        parts = max(8, n_bytes // max(PART_BYTES, 8 * math.isqrt(n_bytes)) + 1)
        blocks = n_bytes // bytes_an_item / max(BLOCK_HASHES, 2 * math.isqrt(n_bytes))
        return cls(parts, max(0, math.ceil(math.log2(max(blocks, 1)))), CODE_BITS)

    @property
    def partitions(self) -> int:
        return min(self.parts, MAX_PARTITIONS)

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        """Block and code of each hash, in one number."""
        return hashes >> np.uint64(64 - self.block_bits - self.code_bits)


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, from which the layout follows."""
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def dealt(docs: DataFrame, layout: Layout) -> DataFrame:
    """``docs`` (doc_id, text and more) dealt to parts by id and text: part, blob. Used several times in a plan, it is
    shuffled once; a blob holds the rows that a task has for a part, compressed."""
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.parts)).cast("int").alias("part"), *docs.columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))

        def flushed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            part = table["part"].to_numpy()
            order = np.argsort(part, kind="stable")
            table = table.drop_columns("part").take(pa.array(order)).combine_chunks()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
            blobs = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                    out.write_table(table.slice(a, b - a))
                blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(part[order][edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            held.append(batch)
            n += batch.nbytes
            if n >= HELD_BYTES:
                yield flushed()
                held, n = [], 0
        if any(map(len, held)):
            yield flushed()

    return rows.mapInArrow(tidy(packed), "part int, blob binary").repartition(layout.partitions, "part")


def opened(part: pa.Table, order: Callable[[pa.Table], np.ndarray] | None = None) -> pa.Table:
    """The rows of a part of ``dealt``; in ``order``, if given, as blobs come in any order."""
    rows = pa.concat_tables([pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in part["blob"]]).combine_chunks()
    return rows if order is None else rows.take(pa.array(order(rows)))


def answers(parts: DataFrame, hashes: Callable[[pa.Table], Iterator[np.ndarray]], layout: Layout) -> DataFrame:
    """part, block, flags: a bit for each code that the part sent to the block, in ascending order; blocks without a
    repeated code of the part give no row. ``hashes`` finds the hashes of the rows of a part."""

    def partial(part: pa.Table) -> pa.Table:
        found = list(hashes(opened(part)))
        codes = np.unique(layout.coded(np.concatenate(found))) if found else np.zeros(0, np.uint64)
        block = (codes >> np.uint64(layout.code_bits)).astype(np.int32)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
        codes = (codes & np.uint64((1 << layout.code_bits) - 1)).astype(np.uint32)
        pieces = [codes[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        gaps = [pressed(np.diff(x, prepend=np.uint32(0))) for x in pieces]
        return pa.table({"part": pa.array([part["part"][0].as_py()] * len(pieces), pa.int32()), "block": pa.array(block[edges[:-1]], pa.int32()), "n": pa.array([len(x) for x in pieces], pa.int32()), "gaps": pa.array(gaps, pa.binary())})

    def merged(block: pa.Table) -> pa.Table:
        pieces = [np.cumsum(unpressed(gaps.as_buffer(), n, np.uint32), dtype=np.uint32) for n, gaps in zip(block["n"].to_pylist(), block["gaps"], strict=True)]
        n_codes = sum(map(len, pieces))
        flags = np.ones(n_codes, bool)
        bits = max(1, math.ceil(math.log2(CELLS * n_codes)))
        for seed in _SEEDS:  # a row of the table: how often each cell is met, once or more than once
            cells = np.concatenate([(mix(x ^ np.uint64(seed)) >> np.uint64(64 - bits)).astype(np.uint32) for x in pieces])
            ordered = np.sort(cells)
            twice = np.zeros(1 << bits, bool)
            twice[ordered[1:][ordered[1:] == ordered[:-1]]] = True
            del ordered
            flags &= twice[cells]
        out = []
        for part, piece in zip(block["part"].to_pylist(), np.split(flags, np.cumsum([len(x) for x in pieces])[:-1]), strict=True):
            if piece.any():
                out.append((part, pressed(np.packbits(piece))))
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([block["block"][0].as_py()] * len(out), pa.int32()), "flags": pa.array([x[1] for x in out], pa.binary())})

    pieces = parts.groupBy("part").applyInArrow(tidy_group(partial), "part int, block int, n int, gaps binary")
    blocks = pieces.repartition(max(1, min(1 << layout.block_bits, MAX_PARTITIONS)), "block")
    return blocks.groupBy("block").applyInArrow(tidy_group(merged), "part int, block int, flags binary")


def repeated(hashes: np.ndarray, replies: pa.Table, layout: Layout) -> np.ndarray:
    """Which of all hashes of a part are estimated to occur twice or more, by the part's rows of ``answers``."""
    codes, place, count = np.unique(layout.coded(hashes), return_inverse=True, return_counts=True)
    yes = count > 1
    block = codes >> np.uint64(layout.code_bits)
    for at, flags in zip(replies["block"].to_pylist(), replies["flags"], strict=True):
        a, b = np.searchsorted(block, at), np.searchsorted(block, at, "right")
        yes[a:b] |= np.unpackbits(unpressed(flags.as_buffer(), (b - a + 7) // 8, np.uint8))[: b - a].astype(bool)
    return yes[place]
