"""Cleartext payloads: CBOR maps ``{operation, data: [{bucket, value, id}]}`` with byte-string members.

Payloads of one client program differ in little more than the bytes of their members. So one payload of each length is
parsed, and all others of that length whose remaining bytes are the same have their members at the same places: numpy
takes them from all these payloads at once. Payloads that are like no parsed one are parsed themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import unused

PARSING_ERROR = "REPORT_PARSING_ERROR"
FACTS_TYPE = T.ArrayType(T.StructType([T.StructField("bucket", T.BinaryType()), T.StructField("value", T.LongType()), T.StructField("id", T.DecimalType(20, 0))]))
_LIMITS = {"bucket": 16, "value": 4, "id": 8}
_FACT = pa.struct([("bucket", pa.binary()), ("value", pa.int64()), ("id", pa.decimal128(20, 0))])
LAYOUTS = 16  # parsed for one length; payloads of still other ones are parsed one by one


class _Blob(bytes):
    """A byte string of a payload that knows where it stands."""

    at: int


def _item(data: bytes, at: int) -> tuple[object, int]:
    """The CBOR item of definite length at ``at``, and where it ends."""
    kind, size = data[at] >> 5, data[at] & 31
    at += 1
    if 24 <= size <= 27:
        width = 1 << (size - 24)
        if at + width > len(data):
            raise ValueError("cut short")
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
    elif size > 27:
        raise ValueError("indefinite length")
    if kind in (2, 3):
        if at + size > len(data):
            raise ValueError("cut short")
        part = data[at : at + size]
        if kind == 3:
            return part.decode(), at + size
        blob = _Blob(part)
        blob.at = at
        return blob, at + size
    if kind == 4:
        items = []
        for _ in range(size):
            value, at = _item(data, at)
            items.append(value)
        return items, at
    if kind == 5:
        pairs = {}
        for _ in range(size):
            key, at = _item(data, at)
            pairs[key], at = _item(data, at)
        return pairs, at
    if kind == 6:
        return _item(data, at)
    return (size if kind == 0 else -1 - size if kind == 1 else None), at


def _facts(payload: bytes | None) -> tuple[str, list[tuple[_Blob, _Blob, _Blob | None]]] | None:
    """(operation, facts as bucket, value and id), or None for anything that is no such payload."""
    try:
        top, end = _item(payload or b"", 0)
        facts = []
        for fact in top["data"]:
            values = {k: fact.get(k) for k in _LIMITS}
            if not isinstance(values["bucket"], bytes) or not isinstance(values["value"], bytes) or any(v is not None and len(v) > _LIMITS[k] for k, v in values.items()):
                raise ValueError("not a fact")
            if values["id"] is not None and not isinstance(values["id"], bytes):
                raise ValueError("not a fact")
            facts.append((values["bucket"], values["value"], values["id"]))
        if end != len(payload) or not isinstance(top["operation"], str):
            raise ValueError("not a payload")
        return top["operation"], facts
    except (IndexError, KeyError, TypeError, ValueError, AttributeError, RecursionError):
        return None


def _number(digits: np.ndarray) -> np.ndarray:
    """Big-endian bytes along the last axis as unsigned numbers."""
    out = np.zeros(digits.shape[:-1], np.uint64)
    for k in range(digits.shape[-1]):
        out = (out << np.uint64(8)) | digits[..., k]
    return out


class _Facts:
    """Facts of the rows of a batch, put in place layout by layout."""

    def __init__(self, n: int):
        self.operation = np.full(n, None, object)
        self.counts = np.zeros(n, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, payloads: np.ndarray, operation: str, facts: list) -> None:
        """``payloads``: the rows' bytes, all of one layout; ``facts``: where it has its members."""
        n, shape = len(facts), (len(rows), len(facts))
        self.operation[rows], self.counts[rows] = operation, n
        buckets, values, ids = np.zeros((*shape, 16), np.uint8), np.zeros(shape, np.int64), np.zeros(shape, np.uint64)
        known = np.array([i is not None for *_, i in facts], bool)
        for k, (bucket, value, number) in enumerate(facts):
            if bucket:
                buckets[:, k, 16 - len(bucket) :] = payloads[:, bucket.at : bucket.at + len(bucket)]
            if value:
                values[:, k] = _number(payloads[:, value.at : value.at + len(value)])
            if number:
                ids[:, k] = _number(payloads[:, number.at : number.at + len(number)])
        self.parts.append((rows, buckets, values, ids, np.broadcast_to(known, shape)))

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        """Operation and facts, null for rows that were never added."""
        offsets = np.append(0, np.cumsum(self.counts))
        total = int(offsets[-1])
        buckets, values, ids, known = np.zeros((total, 16), np.uint8), np.zeros(total, np.int64), np.zeros((total, 2), np.uint64), np.zeros(total, bool)
        for rows, b, v, i, k in self.parts:
            at = (offsets[rows][:, None] + np.arange(b.shape[1])).reshape(-1)
            buckets[at], values[at], ids[at, 0], known[at] = b.reshape(-1, 16), v.reshape(-1), i.reshape(-1), k.reshape(-1)
        bucket = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(np.arange(0, 16 * total + 1, 16, dtype=np.int32)), pa.py_buffer(buckets)])
        validity = pa.array(known).buffers()[1] if total else None
        number = pa.Array.from_buffers(pa.decimal128(20, 0), total, [validity, pa.py_buffer(ids)])
        facts = pa.StructArray.from_arrays([bucket, pa.array(values), number], fields=list(_FACT))
        missing = np.array([o is None for o in self.operation], bool)
        return pa.array(self.operation, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), facts, mask=pa.array(missing))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, start and length of each value of a binary column; null is empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)


def decoded(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(operation, facts) of a column of payloads; both are null where a payload is not readable."""
    data, starts, sizes = _bytes_of(column)
    out = _Facts(len(column))
    order = np.argsort(sizes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
        size = int(sizes[rows[0]])
        payloads = data[starts[rows][:, None] + np.arange(size)]
        for _ in range(LAYOUTS):
            if not len(rows):
                break
            parsed, like = _facts(payloads[0].tobytes()), np.zeros(len(rows), bool)
            like[0] = True
            if parsed:
                fixed = np.ones(size, bool)
                for blob in (b for fact in parsed[1] for b in fact if b is not None):
                    fixed[blob.at : blob.at + len(blob)] = False
                like = (payloads[:, fixed] == payloads[0, fixed]).all(axis=1)
                out.add(rows[like], payloads[like], *parsed)
            rows, payloads = rows[~like], payloads[~like]
        for k in range(len(rows)):
            parsed = _facts(payloads[k].tobytes())
            if parsed:
                out.add(rows[k : k + 1], payloads[k : k + 1], *parsed)
    return out.arrays()


def decode_payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """``column`` (binary) becomes ``operation`` and ``data``; ``payload_errors`` holds REPORT_PARSING_ERROR where it is not readable.

    Only the payloads go through Python.
    """
    names = [c for c in df.columns if c != column]

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for payloads in batches:
            operation, facts = decoded(payloads)
            bad = np.append(0, np.cumsum(np.asarray(operation.is_null()))).astype(np.int32)
            errors = pa.ListArray.from_arrays(pa.array(bad), pa.array([PARSING_ERROR] * int(bad[-1]), pa.string()))
            yield pa.StructArray.from_arrays([operation, facts, errors], ["operation", "data", "payload_errors"])

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    schema = T.StructType().add("operation", T.StringType()).add("data", FACTS_TYPE).add("payload_errors", T.ArrayType(T.StringType()))
    part = unused(df, "decoded")
    return df.withColumn(part, F.arrow_udf(read, schema)(F.col(column))).select(*names, *(F.col(part)[n].alias(n) for n in schema.names))


def _head(kind: int, size: int) -> bytes:
    for width, code in ((0, None), (1, 24), (2, 25), (4, 26), (8, 27)):
        if code is None and size < 24:
            return bytes([kind << 5 | size])
        if code is not None and size < 1 << (8 * width):
            return bytes([kind << 5 | code]) + size.to_bytes(width, "big")
    raise ValueError("too large")


def _encoded(operation: str | None, data: list | None) -> bytes:
    text = lambda s: _head(3, len(s.encode())) + s.encode()
    blob = lambda b: _head(2, len(b)) + b
    facts = []
    for fact in data or []:
        pairs = [("bucket", bytes(fact["bucket"])), ("value", fact["value"].to_bytes(4, "big"))]
        if fact["id"] is not None:
            pairs.append(("id", int(fact["id"]).to_bytes(8, "big")))
        facts.append(_head(5, len(pairs)) + b"".join(text(k) + blob(v) for k, v in pairs))
    return _head(5, 2) + text("operation") + text(operation or "") + text("data") + _head(4, len(facts)) + b"".join(facts)


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers as ``width`` big-endian bytes along a new last axis."""
    return np.ascontiguousarray(numbers.astype(">u8")).view(np.uint8).reshape(*numbers.shape, 8)[..., 8 - width :]


def encoded(operation: pa.Array, data: pa.Array) -> pa.Array:
    """Payloads of rows of facts: a payload of each layout is written, and the others of that layout are its copies with
    their own members."""
    facts, ends = data.flatten(), np.append(0, np.cumsum(np.asarray(data.value_lengths().fill_null(0), np.int64)))
    counts, n = np.diff(ends), len(data)
    bucket_data, at, size = _bytes_of(facts.field("bucket"))
    values, ids = np.asarray(facts.field("value").fill_null(0), np.int64), facts.field("id").fill_null(0).cast(pa.decimal128(20, 0))
    low = np.frombuffer(ids.buffers()[1], np.uint64)[2 * ids.offset : 2 * (ids.offset + len(ids))].reshape(-1, 2) if len(ids) else np.zeros((0, 2), np.uint64)
    known = np.asarray(facts.field("id").is_valid())
    plain = (size == 16) & (values >= 0) & (values < 1 << 32) & (low[:, 1] == 0) & np.asarray(facts.field("value").is_valid()) & np.asarray(facts.field("bucket").is_valid())
    each = lambda x: np.add.reduceat(np.append(x, 0).astype(np.int64), np.minimum(ends[:-1], len(x))) * (counts > 0) if n else np.zeros(0, np.int64)
    with_id = each(known)
    regular = (each(plain) == counts) & ((with_id == 0) | (with_id == counts))
    others = np.flatnonzero(~regular)
    parts, order = [pa.array([_encoded(operation[r].as_py(), data[r].as_py()) for r in others.tolist()], pa.binary())], [others]
    codes = np.asarray(operation.dictionary_encode().indices.fill_null(-1), np.int64)
    like = np.flatnonzero(regular)
    layouts, which = np.unique(np.stack([codes, counts, with_id > 0], axis=1)[like], axis=0, return_inverse=True)
    for layout, (_, count, _) in enumerate(layouts.tolist()):
        rows = like[which.reshape(-1) == layout]
        first = _encoded(operation[rows[0]].as_py(), data[rows[0]].as_py())
        members = _facts(first)[1]
        all_rows = np.frombuffer(first, np.uint8)[None, :].repeat(len(rows), axis=0)
        place = ends[:-1][rows][:, None] + np.arange(count)
        for k, (bucket, value, number) in enumerate(members):
            of = place[:, k]
            all_rows[:, bucket.at : bucket.at + 16] = bucket_data[at[of][:, None] + np.arange(16)]
            all_rows[:, value.at : value.at + 4] = _digits(values[of].astype(np.uint64), 4)
            if number is not None:
                all_rows[:, number.at : number.at + 8] = _digits(low[of, 0], 8)
        ends_of = np.arange(0, (len(rows) + 1) * len(first), len(first), dtype=np.int32)
        parts.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends_of), pa.py_buffer(all_rows)]))
        order.append(rows)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


def encode_payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """``operation`` and ``data`` become ``column`` (binary)."""
    names = [c for c in df.columns if c not in ("operation", "data")]

    def write(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for operation, data in batches:
            yield encoded(operation, data)

    write.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return df.select(*names, F.arrow_udf(write, T.BinaryType())("operation", "data").alias(column))
