"""128-bit buckets, unsigned integers and text keys as columns.

Inside the library a bucket is 16 big-endian bytes, so that ``80`` and ``0080`` are one group; results drop the
leading zero bytes, and bucket 0 is then the empty byte string.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO = "0" * 32


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_bucket(bucket) -> Column:
    """16 bytes, zero-padded at the left; null for more than 16 bytes."""
    b = _col(bucket)
    return F.when(F.octet_length(b) <= 16, F.unhex(F.lpad(F.hex(b), 32, "0")))


def strip_bucket(bucket) -> Column:
    """Without leading zero bytes."""
    return F.unhex(F.regexp_replace(F.hex(_col(bucket)), "^(00)+", ""))


def bucket_hex(bucket) -> Column:
    """32 upper-case hex digits."""
    return F.lpad(F.hex(_col(bucket)), 32, "0")


def u64(data) -> Column:
    """Big-endian bytes as decimal(20,0), no bytes as 0; null for more than 8 bytes."""
    b = _col(data)
    return F.when(F.octet_length(b) <= 8, F.coalesce(F.conv(F.hex(b), 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))


def u32(data) -> Column:
    """Big-endian bytes as bigint, no bytes as 0; null for more than 4 bytes."""
    b = _col(data)
    return F.when(F.octet_length(b) <= 4, F.coalesce(F.conv(F.hex(b), 16, 10).cast("bigint"), F.lit(0).cast("bigint")))


def bucket_from_string(text) -> Column:
    """The ISO-8859-1 bytes of a text key; null for more than 16."""
    encoded = F.encode(_col(text), "ISO-8859-1")
    return F.when(F.octet_length(encoded) <= 16, encoded)


def bucket_from_int(number) -> Column:
    """An integer key is the text of its decimal digits, not its binary value."""
    return bucket_from_string(_col(number).cast("string"))


def bucket_to_string(bucket) -> Column:
    return F.decode(_col(bucket), "ISO-8859-1")


@F.pandas_udf(T.StringType())
def bucket_decimal(bucket: pd.Series) -> pd.Series:
    """The bucket as a decimal number; 2**128 - 1 is beyond Spark's decimal(38)."""
    return bucket.map(lambda b: None if b is None else str(int.from_bytes(b, "big")))


def percentage(text: str) -> float:
    """``"10"`` or ``"10%"`` as a number from 0 to 100."""
    value = float(text.strip().removesuffix("%"))
    if not 0 <= value <= 100:
        raise ValueError(f"not a percentage from 0 to 100: {text!r}")
    return value


def id_list(text: str | None) -> list[int]:
    """A comma list of unsigned 64-bit ids as a sorted set; blanks are dropped, nothing means {0}."""
    ids = sorted({int(x) for x in (text or "").split(",") if x.strip()})
    if any(not 0 <= i < 1 << 64 for i in ids):
        raise ValueError(f"not a list of unsigned 64-bit integers: {text!r}")
    return ids or [0]
