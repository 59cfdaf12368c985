"""Jobs that stop while they run, as soon as more reports have errors than an announced count allows."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import InheritableThread, TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unused
from .errors import DESCRIPTIONS, TOTAL

POLL_SECONDS = 0.2


class _ByPartition(AccumulatorParam):
    """Counts by partition: a partition that is computed again replaces its own counts."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:  # noqa: N802
        value1.update(value2)
        return value1


class ErrorWatch:
    """Reports with errors by category, known to the driver as tasks end.

    The driver holds one count a category for each partition with errors. Only the column ``errors`` goes through
    Python; the reports themselves stay in the JVM.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.parts = spark.sparkContext.accumulator({}, _ByPartition())

    def watched(self, reports: DataFrame) -> tuple[DataFrame, str]:
        """``reports`` with a column that counts errors as it is computed, and the column's name.

        The column must be computed for every row exactly once a task: write the result with it, and read that.
        """
        parts = self.parts

        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            seen = Counter()
            for batch in batches:
                n = pc.fill_null(pc.list_value_length(batch), 0)
                seen[TOTAL] += pc.sum(pc.greater(n, 0)).as_py() or 0
                for pair in pc.value_counts(pc.list_flatten(batch)).to_pylist():
                    seen[pair["values"]] += pair["counts"]
                yield n.cast(pa.int32())
            if seen[TOTAL]:
                parts.add({TaskContext.get().partitionId(): dict(seen)})

        counted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        name = unused(reports, "n_errors")
        return reports.withColumn(name, F.arrow_udf(counted, "int")(F.array_distinct("errors"))), name

    def counts(self) -> Counter:
        """Reports by category over the tasks that have ended; the total under its own category."""
        out = Counter()
        for part in list(self.parts.value.values()):
            out.update(part)
        return out

    def summary(self) -> DataFrame:
        """``errors.error_summary`` of the tasks that have ended."""
        rows = sorted(self.counts().items(), key=lambda x: (x[0] == TOTAL, x[0]))
        return self.spark.createDataFrame([(c, n, DESCRIPTIONS.get(c)) for c, n in rows], "category string, count long, description string")

    def run(self, work: Callable[[], object], limit: int) -> object | None:
        """What ``work`` returns, or None if its jobs were cancelled because more than ``limit`` reports have errors.

        ``work`` runs in a thread under a tag of its own, so no other job of the session is touched.
        """
        context, tag, done, stopped = self.spark.sparkContext, f"watched-{uuid.uuid4().hex}", [], False

        def tagged() -> None:
            context.addJobTag(tag)
            try:
                done.append((work(), None))
            except BaseException as e:  # handed to the caller below
                done.append((None, e))
            finally:
                context.removeJobTag(tag)

        thread = InheritableThread(target=tagged, session=self.spark)
        thread.start()
        while thread.is_alive():
            thread.join(POLL_SECONDS)
            if thread.is_alive() and self.counts()[TOTAL] > limit:
                stopped = True
                context.cancelJobsWithTag(tag)  # again at each turn: a job may begin after the last one was cancelled
        value, error = done[0]
        if error is not None and not stopped:
            raise error
        return value
