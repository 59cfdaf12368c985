"""Conversation structure repair by Knuth's lightest-derivation algorithm.

A repaired conversation is an optional system turn and pairs of a user and an assistant turn. Items are spans
(first row, last row, state before, state after) of a conversation; edits of single rows and insertions are the axioms,
and two spans that meet in a row and state derive their union. A derivation weighs (cost, audit): costs add up and
audits are put together, so the weight is superior and monotone, and an agenda that pops the least weight has an item's
lightest derivation when it pops it first.

Rows are range-partitioned by conversation and turn, so a hot conversation is spread over many tasks. A task runs the
agenda over short chunks and joins their spans pairwise. Only the spans of a conversation's parts meet in one task, a
letter a row. The chosen edits then go back to the rows by a join.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import saved, small_batches
from .words import tidy

CHUNK = 32
CACHE = 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3  # faults of a row; 0 is none
# Edits as letters that also say the role: D delete, I and J insert user and assistant, K keep, R and S rerole to user
# and assistant. Their order is that of the audit's letters, as a state allows one role for an insertion or new role.
AUDIT = ("JS", "IR")
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_ILLEGAL = frozenset(("su", "ua", "au"))
GOALS = (_START, _ASSISTANT)
_SPACE = r"[\x20\x09-\x0D]"

Span = dict[tuple[int, int], tuple[int, str]]  # (state before, after) -> (cost, edits)


def _next(state: int) -> tuple[int, str, str]:
    """State, insertion and new role that may follow."""
    return (_ASSISTANT, "J", "S") if state == _USER else (_USER, "I", "R")


def lightest(rows: tuple[tuple[str, int], ...], state: int) -> Span:
    """The lightest derivations of all spans over ``rows`` (initial, fault) from a state before, by Knuth's agenda."""
    agenda, final, out = [(0, "", 0, state)], set(), {}
    while agenda:
        cost, edits, at, now = heapq.heappop(agenda)
        if (at, now) in final:
            continue
        final.add((at, now))
        if at == len(rows):
            out[state, now] = (cost, edits)
            if len(out) == 4:  # every goal item is final
                break
        after, insert, rerole = _next(now)
        if (at, after) not in final:
            heapq.heappush(agenda, (cost + INSERT, edits + insert, at, after))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(agenda, (cost + DELETE, edits + "D", at + 1, now))
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT_SHORT else 0
                kept = _KEPT.get((now, initial))
                if kept is not None:
                    heapq.heappush(agenda, (cost + KEEP + more, edits + "K", at + 1, kept))
                heapq.heappush(agenda, (cost + REROLE + more, edits + rerole, at + 1, after))
    return out


def joined(left: Span, right: Span) -> Span:
    """The lightest unions of two spans that meet."""
    out: Span = {}
    for (before, between), (cost, edits) in left.items():
        for after in range(4):
            other = right.get((between, after))
            if other is not None:
                weight = (cost + other[0], edits + other[1])
                if (before, after) not in out or weight < out[before, after]:
                    out[before, after] = weight
    return out


class Spans:
    """Spans of a run of rows, joined pairwise as they come: a stack of spans over ever fewer chunks."""

    def __init__(self):
        self.stack: list[tuple[int, Span]] = []

    def add(self, span: Span) -> None:
        level = 0
        while self.stack and self.stack[-1][0] == level:
            span, level = joined(self.stack.pop()[1], span), level + 1
        self.stack.append((level, span))

    def whole(self) -> Span:
        span = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            span = joined(left, span)
        return span


def _chunk_spans(rows: tuple[tuple[str, int], ...], cache: dict, first: bool) -> Span:
    """Spans from every state before, or from the start alone; equal chunks are derived once."""
    span = cache.get((rows, first))
    if span is None:
        span = {k: v for state in ((_START,) if first else range(4)) for k, v in lightest(rows, state).items()}
        if len(cache) >= CACHE:
            cache.clear()
        cache[rows, first] = span
    return span


_SPANS = "array<struct<before:int,after:int,cost:bigint,edits:string>>"
_RUN = f"run struct<head:string,last:string,illegal:bigint,n:bigint,spans:{_SPANS}>"


class _Run:
    """The rows of one conversation that a task has seen in a row."""

    def __init__(self, key, first: bool):
        self.key, self.first, self.n, self.illegal, self.head, self.last = key, first, 0, 0, None, None
        self.spans, self.chunk = Spans(), []

    def add(self, initial: str, fault: int, cache: dict) -> None:
        if self.n:
            self.illegal += self.last + initial not in _ILLEGAL
        else:
            self.head = initial
        self.last, self.n = initial, self.n + 1
        self.chunk.append((initial, fault))
        if len(self.chunk) == CHUNK:
            self.close(cache)

    def close(self, cache: dict) -> None:
        if self.chunk:
            self.spans.add(_chunk_spans(tuple(self.chunk), cache, self.first and not self.spans.stack))
            self.chunk = []

    def row(self, cache: dict) -> dict:
        self.close(cache)
        spans = [{"before": b, "after": a, "cost": c, "edits": e} for (b, a), (c, e) in self.spans.whole().items()]
        return {"head": self.head, "last": self.last, "illegal": self.illegal, "n": self.n, "spans": spans}


def faults(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, copy and fault of every row, copies of a row numbered from 1.

    A blank row has no character but white space; a duplicate's role and text are seen earlier in its conversation; a
    truncated row's last such character is none of ``.!?``. Copies after the first have no text here: they are always
    blank or duplicates.
    """
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), null(role_col).alias("role"), null(text_col).alias("text"))
    rows = saved(rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")), "turns", "zstd")
    # Where role and text stand at several turns, all but the first are duplicates; a null turn is the first.
    key = ("conv", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    seen = rows.groupBy(*key).agg(F.count("*").alias("turns"), F.bool_or(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("least")).filter("turns > 1")
    seen = seen.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), "digest", "no_turn", "least")
    rows = rows.withColumn("text_digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("text_digest") == F.col("digest")), "left")
    earlier = F.col("least").isNotNull() & F.when(F.col("no_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") != F.col("least"))
    ending = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){_SPACE}*\z", 1)
    first = F.when(ending == "", BLANK).when(F.coalesce(earlier, F.lit(False)), DUPLICATE).when(~ending.isin(".", "!", "?"), CUT_SHORT).otherwise(0)
    rows = rows.withColumn("first", first).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    fault = F.when((F.col("copy") == 1) | (F.col("first") == BLANK), F.col("first")).otherwise(DUPLICATE)
    return rows.select("conv", "turn", "role", F.when(F.col("copy") == 1, F.col("text")).alias("text"), "copy", fault.cast("int").alias("fault"), F.when(F.col("copy") > 1, F.col("text_digest")).alias("same"))


def _runs(rows: DataFrame) -> DataFrame:
    """``rows`` in order by conversation, written with ``part`` and ``at``, their place in a run; the run's last row has
    its spans."""
    rows = rows.withColumn("order", F.coalesce(F.col("same"), F.sha2(F.col("text").cast("binary"), 256))).drop("same")
    key = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("order"), F.col("copy")]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("order", "copy")
    names = ordered.columns

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cache, now, held = TaskContext.get().partitionId(), {}, None, None

        def columns(batch: pa.RecordBatch, at: list[int], runs: list[dict | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(runs, run_type)], [*names, "part", "at", "run"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at, runs = [], [None] * batch.num_rows
            convs, roles, found = batch["conv"].to_pylist(), batch["role"].to_pylist(), batch["fault"].to_pylist()
            for k, (conv, role, fault) in enumerate(zip(convs, roles, found, strict=True)):
                if now is None or now.key != conv:
                    if now is not None:  # the run ends with the row before, which may be the last of the batch before
                        if k:
                            runs[k - 1] = now.row(cache)
                        else:
                            held[2][-1] = now.row(cache)
                    now = _Run(conv, now is not None)  # a run in a task's middle begins its conversation
                at.append(now.n)
                now.add(role[:1], fault, cache)
            if held is not None:
                yield columns(*held)
            held = (batch, at, runs)
        if held is not None:
            held[2][-1] = now.row(cache)
            yield columns(*held)

    run_type = pa.struct([("head", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("n", pa.int64()), ("spans", pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))])
    schema = T.StructType([*ordered.schema.fields, *T.DataType.fromDDL(f"part int, at long, {_RUN}").fields])
    return saved(ordered.mapInArrow(tidy(derived), schema), "runs", "zstd")


def _chosen(runs: DataFrame) -> DataFrame:
    """For every part of every conversation: conv, part, the edits of its rows; its last part also has cost, illegal and
    the whole ``edits``."""
    spans = runs.filter("run IS NOT NULL").select("conv", "part", "run.*")
    # Null conversations go to one task with others; a conversation's parts follow each other in a task.
    spans = spans.repartition("conv").sortWithinPartitions("conv", "part")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # conversation, spans, illegal, last initial, parts and their rows

        def given() -> pa.RecordBatch:
            conv, spans, illegal, _, parts = now
            whole = spans.whole()
            cost, edits = min(whole[_START, goal] for goal in GOALS if (_START, goal) in whole)
            slices, begin = [], 0
            for _, n in parts:  # an edit a row, with the insertions before it; those at the end go with the last row
                end = begin
                while n:
                    n -= edits[end] in "DKRS"
                    end += 1
                slices.append(edits[begin:end])
                begin = end
            slices[-1] += edits[begin:]
            none = [None] * (len(parts) - 1)
            columns = [pa.array([conv] * len(parts), conv_type), pa.array([p for p, _ in parts], pa.int32()), pa.array(slices, pa.string()), pa.array([*none, cost], pa.int64()), pa.array([*none, illegal], pa.int64()), pa.array([*none, edits], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["conv", "part", "slice", "cost", "illegal", "edits"])

        for batch in batches:
            conv_type, done = batch.schema.field("conv").type, []
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv"]:
                    if now is not None:
                        done.append(given())
                    now = (row["conv"], Spans(), 0, None, [])
                conv, spans, illegal, last, parts = now
                spans.add({(s["before"], s["after"]): (s["cost"], s["edits"]) for s in row["spans"]})
                parts.append((row["part"], row["n"]))
                illegal += row["illegal"] + (last is not None and last + row["head"] not in _ILLEGAL)
                now = (conv, spans, illegal, row["last"], parts)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now is not None:
            yield given()

    kind = runs.schema["conv"].dataType.simpleString()
    return saved(spans.mapInArrow(tidy(folded), f"conv {kind}, part int, slice string, cost long, illegal long, edits string"), "edits", "zstd")


class Repair:
    """A repaired table of conversations: ``rows``, ``conversations`` and ``digests``, lazily, over written tables.

    Rows are taken by turn (nulls first), then by role and digest of the text; a null role or text is one space, and a
    null conversation is one of its own. Repeated rows are duplicates. An empty table gives no rows; columns of other
    names are ignored. Very long texts stay whole. A conversation's parts meet in one task with a letter a row for each
    pair of states; texts never do.
    """

    def __init__(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        small_batches(turns.sparkSession)
        self.conv_col = conv_col
        self.runs = _runs(faults(turns, conv_col, turn_col, role_col, text_col))
        self.edits = _chosen(self.runs)

    def rows(self) -> DataFrame:
        """The repaired rows: conversation, part, at and k (their order), edit, role and text. Kept, reroled and
        inserted turns alone; an inserted one's text is empty."""
        ops = self.edits.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), F.posexplode(F.regexp_extract_all("slice", F.lit(r"([IJ]*[DKRS](?:[IJ]+\z)?)"), 1)).alias("_at", "ops"))
        both = self.runs.select("conv", "part", "at", "role", "text").join(ops, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("at") == F.col("_at")))
        each = both.select("conv", "part", "at", "role", "text", F.posexplode(F.split("ops", "")).alias("k", "edit")).filter("edit NOT IN ('D', '')")
        role = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("J", "S"), "assistant").otherwise(F.col("role"))
        text = F.when(F.col("edit").isin("I", "J"), "").otherwise(F.col("text"))
        return each.select(F.col("conv").alias(self.conv_col), "part", "at", "k", F.translate("edit", *AUDIT).alias("edit"), role.alias("role"), text.alias("text"))

    def conversations(self) -> DataFrame:
        """A row a conversation that has rows: gaps, blank, duplicate, truncated, illegal, cost and audit."""
        count = lambda fault, name: F.count_if(F.col("fault") == fault).alias(name)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
        counted = self.runs.groupBy("conv").agg(gaps.alias("gaps"), count(BLANK, "blank"), count(DUPLICATE, "duplicate"), count(CUT_SHORT, "truncated"))
        chosen = self.edits.filter("edits IS NOT NULL").select(F.col("conv").alias("_conv"), "illegal", "cost", F.translate("edits", *AUDIT).alias("audit"))
        return counted.join(chosen, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv").withColumnRenamed("conv", self.conv_col)

    def digests(self) -> DataFrame:
        """The sha256 of each conversation's repaired ``role:text``, joined by line feeds. A digest reads one row after
        the other, so a conversation streams through one task, which holds a batch of it."""
        conv = self.conv_col
        ordered = self.rows().repartition(conv).sortWithinPartitions(conv, "part", "at", "k").select(conv, "role", "text")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, digest, begun = None, None, False

            for batch in batches:
                done = []
                for key, role, text in zip(batch[conv].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    if begun and key == now:
                        digest.update(b"\n")
                    else:
                        if begun:
                            done.append((now, digest.hexdigest()))
                        now, digest, begun = key, hashlib.sha256(), True
                    digest.update(f"{role}:{text}".encode())
                kind = batch.schema.field(conv).type
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done], pa.string())], [conv, "repaired_sha256"])
            if begun:
                yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], [conv, "repaired_sha256"])

        return ordered.mapInArrow(tidy(hashed), T.StructType([ordered.schema[conv], T.StructField("repaired_sha256", T.StringType())]))
