"""Folds by checksum of the id, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 48 << 20
MAX_CLASSES = 256  # most frequent classes that a model learns; bounds the models that are broadcast


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, key: str, class_col: str, size: int) -> tuple[DataFrame, int]:
    """About ``size`` rows of (key, class, ...), as many of each class where there are enough; by hash of the key. And
    the number of classes.

    The counts it starts from cover all rows; the result is never above ``size`` rows.
    """
    counts = dict(rows.groupBy(class_col).agg(F.count("*")).orderBy(F.desc("count(1)"), class_col).limit(MAX_CLASSES).collect())
    if not counts:
        return rows.limit(0), 0
    each = size * 0.9 / len(counts)
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))]), F.col(class_col))
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * float(1 << 20)).limit(size), len(counts)


def collected(rows: DataFrame, classes: int, limit_bytes: int = SAMPLE_BYTES) -> list[tuple[str, object]]:
    """(text, class) pairs of a bounded sample (columns ``text`` and ``label``), whole texts, in order of text.

    Each of ``classes`` classes has its share of ``limit_bytes``; a text that no longer fits its class's share is left
    out, and shorter ones after it are still taken.
    """
    share, used, got = limit_bytes // max(classes, 1), {}, []
    for text, label in rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= share).select("text", "label").toLocalIterator():
        size = used.get(label, 0) + len((text or "").encode())
        if size <= share:
            used[label] = size
            got.append((text or "", label))
    return sorted(got, key=lambda x: (x[0], str(x[1])))
