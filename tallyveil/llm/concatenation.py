"""Concatenate-and-cut packing by two passes of prefix sums.

The first pass tokenises: each partition writes its documents' ids with their offsets inside the partition. The
partitions' totals, summed up in blocks and then over the blocks, give every partition its place in one long row of
tokens, so the second pass cuts fixed windows anywhere without knowing other partitions. A window that a run of rows
does not fill alone leaves boundary records, two a run at most beside the run's whole windows, which are put together
by window.

What is left over after the last whole window is cut into powers of two, so that no sequence needs padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bounded_broadcast
from .components import saved, small_batches, spread
from .tokens import vocabulary_path
from .words import tidy

LENGTH = 2048
END_ID = 1
BYTE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
LONG_WORD = 1000  # characters without white space, or white space beyond one character a word
BLOCK = 4096
_TOKENS = "part int, local long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteTokens:
    """Ids of whole texts by a byte-level vocabulary: those of its ``tokenizers`` file.

    The same vocabulary as ranks gives the same ids faster (a test compares them for every code point); texts with very
    long words or runs of white space, where the ranks would take long, go through the tokenizer itself.
    """

    def __init__(self, vocabulary: str = BYTE_BPE, ranks: str | None = BYTE_RANKS):
        from tokenizers import Tokenizer

        place = lambda name: name if "/" in name else vocabulary_path(name)
        self.tokenizer, self.fast = Tokenizer.from_file(place(vocabulary)), None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(place(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {SPECIAL: i for i in [self.tokenizer.token_to_id(SPECIAL)] if i is not None}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is not None:
            sizes = list(map(len, text.split()))
            if max(sizes, default=0) < LONG_WORD and len(text) - sum(sizes) - len(sizes) < LONG_WORD:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def tail_edges(total: int, length: int) -> np.ndarray:
    """Where the sequences after the last whole window end: the rest as powers of two, largest first."""
    at, rest, edges = total - total % length, total % length, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        at, rest = at + size, rest - size
        edges.append(at)
    return np.array(edges, np.int64)


def cuts(begin: int, end: int, length: int, tail: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, sequence, offset) of the pieces that windows cut the tokens ``begin`` to ``end`` of all into.

    ``tail``: the ends of the sequences after the last of the windows.
    """
    whole = total - total % length
    first = begin - begin % length + length
    edges = np.concatenate([np.arange(first, min(end, whole) + 1, length), tail[(tail > begin) & (tail < end)]])
    at = np.concatenate([[begin], edges[(edges > begin) & (edges < end)]]).astype(np.int64)
    late = np.searchsorted(tail, at, "right")
    starts = np.append(whole, tail)[late]
    sequence = np.where(at < whole, at // length, whole // length + late)
    return at - begin, np.diff(at, append=end), sequence, at - np.where(at < whole, at // length * length, starts)


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, ranks: str | None = BYTE_RANKS, end_id: int = END_ID) -> DataFrame:
    """Pass one, written: each text's ids with ``end_id``, its partition and the tokens before it in the partition."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, local, end = ByteTokens(vocabulary, ranks), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4")
        for batch in batches:
            ids = [np.concatenate([tokens.encode(t.as_py()), end]) for t in batch["text"]]
            sizes = np.array([len(x) for x in ids], np.int64)
            places = local + np.cumsum(sizes) - sizes
            local += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(places), batch["doc_id"], pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "local", "doc_id", "n", "ids"])

    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return saved(rows.mapInArrow(tidy(counted), _TOKENS), "token-rows", "zstd")


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` plus ``place``, the tokens before each document of all, and the total.

    Totals of partitions are summed up inside blocks of BLOCK partitions, and the blocks' totals over all blocks (a row
    for BLOCK partitions), so no task sees more.
    """
    totals = rows.groupBy("part").agg(F.sum("n").alias("total")).withColumn("block", F.floor(F.col("part") / BLOCK).cast("int"))
    totals = saved(totals, "totals")
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total")).withColumn("block_place", before(Window.orderBy("block"))).drop("total")
    parts = totals.withColumn("in_block", before(Window.partitionBy("block").orderBy("part"))).join(F.broadcast(blocks), "block")
    parts = parts.select("part", (F.col("block_place") + F.col("in_block")).alias("part_place"))
    whole = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return rows.join(bounded_broadcast(parts), "part").withColumn("place", F.col("part_place") + F.col("local")).drop("part_place"), whole


def pieces(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """The pieces that all documents are cut into: doc_id, start (the document's ids before it), length, ids_crc32,
    doc_tokens, sequence_id and offset; ``options`` are those of ``token_rows``.

    Each id lies in one piece; sequences are gapless from offset 0, ``length`` long, and after the last whole one powers
    of two. Null text is empty (the end id alone); null ids and repeated rows are packed like all others; an empty table
    gives no rows; other columns are ignored. Long texts are tokenised and cut as wholes.
    """
    rows, total = placed(token_rows(docs, **options))
    tail = tail_edges(total, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, out = batch["doc_id"].to_pylist(), []
            for doc_id, place, n, ids in zip(doc_ids, batch["place"].to_pylist(), batch["n"].to_pylist(), batch["ids"], strict=True):
                data = ids.as_buffer()
                for start, size, sequence, offset in zip(*(x.tolist() for x in cuts(place, place + n, length, tail, total)), strict=True):
                    out.append((doc_id, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, sequence, offset))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

    return rows.select("doc_id", "place", "n", "ids").mapInArrow(tidy(cut), _PIECES)


def sequences(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens and ids (array<long>).

    A task joins the rows that it reads where their tokens follow each other, and gives out whole windows at once; what
    it has of others are boundary records, the only rows that are shuffled. A document over many windows is one row.
    """
    rows, total = placed(token_rows(docs, **options))
    tail = tail_edges(total, length)
    whole = total - total % length
    ends = np.append(whole, tail)

    def size_of(sequence: int) -> int:
        late = sequence - whole // length
        return length if late < 0 else int(ends[late + 1] - ends[late])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int, bytearray] | None = None  # sequence, offset and bytes of the window at hand
        out: list[tuple[int, int, bytes]] = []

        def given() -> pa.RecordBatch:
            done = [len(data) == 4 * size_of(s) for s, _, data in out]
            columns = [pa.array([s for s, *_ in out], pa.int64()), pa.array([o for _, o, _ in out], pa.int64()), pa.array([d for *_, d in out], pa.binary()), pa.array(done, pa.bool_())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["sequence_id", "offset", "ids", "done"])

        for batch in batches:
            for place, n, ids in zip(batch["place"].to_pylist(), batch["n"].to_pylist(), batch["ids"], strict=True):
                data = ids.as_buffer()
                for start, size, sequence, offset in zip(*(x.tolist() for x in cuts(place, place + n, length, tail, total)), strict=True):
                    part = data[4 * start : 4 * (start + size)]
                    if now and (now[0], now[1] + len(now[2]) // 4) == (sequence, offset):
                        now[2].extend(part)
                    else:
                        if now:
                            out.append((now[0], now[1], bytes(now[2])))
                        now = (sequence, offset, bytearray(part))
            if out:
                yield given()
        if now:
            out.append((now[0], now[1], bytes(now[2])))
            yield given()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), "<u4").astype(np.int64) for x in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "n_tokens", "ids"])

    windows = saved(rows.select("place", "n", "ids").mapInArrow(tidy(joined), "sequence_id long, offset long, ids binary, done boolean"), "windows", "zstd")
    inner = windows.filter("done").select("sequence_id", F.array(F.struct("offset", "ids")).alias("parts"))
    boundary = windows.filter("NOT done").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # a window's records: LENGTH at most
    return inner.unionByName(boundary).mapInArrow(tidy(numbers), "sequence_id long, n_tokens long, ids array<long>")
