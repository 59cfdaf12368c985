"""Delta-maintained token counts: additive totals by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) becomes signed rows against what earlier batches hold.
Rows are written under a folder of their own and count only once the batch's commit is written, so a batch that
is applied again, or whose writer died half way, changes nothing. Totals are sums of signed rows, each batch
pre-aggregated; ``compact`` folds committed batches into one. Rows lie in buckets by document: a batch reads the
buckets that it touches, and of them aggregates its own documents only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizes import bounded_broadcast
from .components import saved, small_batches, spread
from .tokens import WORD_BPE, forget, word_tokens
from .words import tidy

_KEYS = ["doc_id", "version"]
_GROUP = ["source", "lang", "version"]
TASK_ROWS = 250_000  # rows of a batch that a task writes
_ROWS = "doc_id long, version string, source string, lang string, d_docs long, d_tokens long"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class TokenCounts:
    """Totals kept in ``path``; one writer at a time.

    Changes have doc_id, version, source, lang, op (``insert``, ``delete``, ``revise``) and n_tokens. One change a
    document and version counts in a batch: a delete before others, then the largest count. Inserting a document
    that is there, or revising, replaces its count (and source and language, unless null in a revision); deleting
    or revising one that is not there does nothing. Null ids are one document; null source or lang are groups of
    their own; a null count is 0. Other columns are ignored. ``buckets`` is fixed when the ledger is begun.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def committed(self) -> list[tuple[str, str]]:
        """(batch, folder) of each committed batch that no compaction has replaced."""
        if not _exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema("batch string, folder string, replaces array<string>").parquet(f"{self.path}/commits")
        gone = rows.select(F.explode("replaces").alias("folder")).distinct()
        return [(r.batch, r.folder) for r in rows.join(gone, "folder", "left_anti").collect()]  # a row a batch since compaction

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        folders = [f"{self.path}/rows/folder={folder}" for _, folder in self.committed()]
        schema = f"{_ROWS}, folder string, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """doc_id, version, source, lang, n_tokens of the documents that are there; of those in ``keys`` alone, if given."""
        rows = self._rows()
        if keys is not None:
            touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # a row a bucket
            known = bounded_broadcast(keys.select(*(F.col(k).alias(f"key_{k}") for k in _KEYS)))
            rows = rows.filter(F.col("bucket").isin(touched)).join(known, F.col("doc_id").eqNullSafe(F.col("key_doc_id")) & F.col("version").eqNullSafe(F.col("key_version")), "left_semi")
        return rows.groupBy("doc_id", *_GROUP).agg(F.sum("d_docs").alias("n"), F.sum("d_tokens").alias("n_tokens")).filter("n > 0").drop("n")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the batch; False, and nothing done, if it already is."""
        if self._known(batch):
            return False
        changes = self._ranked(changes)
        return self._commit(batch, self._signed(changes), [], changes.count())

    def _known(self, batch: str) -> bool:
        return _exists(self.spark, f"{self.path}/commits") and bool(self.spark.read.schema("batch string").parquet(f"{self.path}/commits").filter(F.col("batch") == batch).take(1))

    def _ranked(self, changes: DataFrame) -> DataFrame:
        """The change that counts of each document and version, as a table."""
        rank = Window.partitionBy(*_KEYS).orderBy(F.when(F.col("op") == "delete", 0).otherwise(1), F.desc("n_tokens"), "op", "source", "lang")
        changes = changes.select(F.col("doc_id").cast("long"), F.col("version"), F.col("source"), F.col("lang"), "op", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        return saved(changes.withColumn("rank", F.row_number().over(rank)).filter("rank = 1"), "changes")

    def _signed(self, changes: DataFrame) -> DataFrame:
        old = self.current(changes).select(F.col("doc_id").alias("o_id"), F.col("version").alias("o_version"), F.struct("source", "lang", "n_tokens").alias("old"))
        both = changes.join(old, F.col("doc_id").eqNullSafe(F.col("o_id")) & F.col("version").eqNullSafe(F.col("o_version")), "left")
        there, revise = F.col("old").isNotNull(), F.col("op") == "revise"
        minus = F.when(there & F.col("op").isin("insert", "delete", "revise"), F.struct("doc_id", "version", F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), F.lit(-1).cast("long").alias("d_docs"), (-F.col("old.n_tokens")).alias("d_tokens")))
        kept = lambda c: F.when(revise, F.coalesce(F.col(c), F.col(f"old.{c}"))).otherwise(F.col(c)).alias(c)
        plus = F.when((F.col("op") == "insert") | (revise & there), F.struct("doc_id", "version", kept("source"), kept("lang"), F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens")))
        signed = both.select(F.explode(F.array_compact(F.array(minus, plus))).alias("x")).select("x.*")
        return signed.groupBy("doc_id", *_GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).filter("d_docs != 0 OR d_tokens != 0")

    def _commit(self, batch: str, rows: DataFrame, replaces: list[str], n_rows: int) -> bool:
        folder = uuid.uuid4().hex
        where = f"{self.path}/rows/folder={folder}"
        rows = rows.select("doc_id", "version", "source", "lang", "d_docs", "d_tokens", self._bucket().alias("bucket"))
        spread = max(1, math.ceil(n_rows / TASK_ROWS / self.buckets))  # tasks that write a bucket
        rows.repartition(spread * self.buckets, "bucket", F.pmod(F.xxhash64("doc_id", "version"), F.lit(spread))).write.partitionBy("bucket").parquet(where)
        rows = self.spark.read.schema(f"{_ROWS}, bucket int").parquet(where)
        rows.groupBy(*_GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(f"{self.path}/sums/{folder}")
        entry = self.spark.createDataFrame([(batch, folder, replaces)], "batch string, folder string, replaces array<string>")
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")  # one small file: the batch counts from here on
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens: sums of the committed batches' sums."""
        folders = [f"{self.path}/sums/{folder}" for _, folder in self.committed()]
        schema = "source string, lang string, version string, d_docs long, d_tokens long"
        sums = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return sums.groupBy(*_GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).filter("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> bool:
        """Fold all committed batches into one; batches stay known, so applying one again still does nothing."""
        live = [folder for _, folder in self.committed()]
        if len(live) < 2:
            return False
        every = self._rows()
        rows = every.groupBy("doc_id", *_GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).filter("d_docs != 0 OR d_tokens != 0")
        return self._commit(f"compacted-{uuid.uuid4().hex}", rows, live, every.count())


def count_tokens(docs: DataFrame, counters: dict[str, Callable[[str | None], int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, a row a document and version: columns doc_id, source, lang, version, n_tokens.

    ``counters`` maps a version to a function of a whole text, null included; long texts are counted whole. Null ids,
    sources and languages stay null, repeated rows are counted each, an empty table gives no rows, other columns are left.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for version, count in counters.items():
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["lang"], pa.array([version] * len(batch), pa.string()), pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "source", "lang", "version", "n_tokens"])
        forget()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(tidy(counted), "doc_id long, source string, lang string, version string, n_tokens long")


def bpe_count(vocabulary: str = WORD_BPE) -> Callable[[str | None], int]:
    return lambda text: len(word_tokens(vocabulary).encode(text)) // 4


def word_count(text: str | None) -> int:
    """Words between ASCII white space."""
    return len(text.encode().split()) if text else 0


def lettered_word_count(text: str | None) -> int:
    """Those of ``word_count`` that hold a letter or digit of any script: the revised count of ``words``."""
    return sum(w.isalnum() or any(map(str.isalnum, w.decode())) for w in text.encode().split()) if text else 0
