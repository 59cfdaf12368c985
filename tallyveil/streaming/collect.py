"""Collecting reports: hourly batches, late reports, streaming deduplication, running sums, ledger upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import AggregationError
from ..functions.shared_info import report_hour
from ..operators import budget
from ..operators.histogram import canonical_uuid, is_uuid

DESTINATION_APIS = ["attribution-reporting", "attribution-reporting-debug"]


def batch_by_hour(reports: DataFrame, time: str = "scheduled_report_time", by: Iterable[str] = ()) -> DataFrame:
    """Adds ``batch_hour``, and ``batch_key`` from the hour and the columns ``by`` (as the destination): works on streams."""
    hour = report_hour(F.col(time))
    key = F.concat_ws("|", F.date_format(hour, "yyyy-MM-dd'T'HH"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    return reports.withColumn("batch_hour", hour).withColumn("batch_key", key)


def batch_by_destination(reports: DataFrame, api: str = "api", destination: str = "destination", time: str = "scheduled_report_time") -> tuple[DataFrame, DataFrame]:
    """(batched by hour and destination, batched by hour alone): works on streams.

    Only the budget keys of attribution apis hold the destination. Reports of other apis, and those without a destination,
    would have one budget unit in several batches, all but the first of which would fail; they are batched by hour.
    """
    own = F.coalesce(F.col(api).isin(DESTINATION_APIS) & (F.col(destination) != ""), F.lit(False))
    return batch_by_hour(reports.filter(own), time, [destination]), batch_by_hour(reports.filter(~own), time)


def write_hourly(stream: DataFrame, path: str, checkpoint: str, by: Iterable[str] = (), **trigger) -> StreamingQuery:
    """Batched reports into folders by hour (and by the columns ``by``)."""
    return stream.writeStream.partitionBy("batch_hour", *by).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def close_hours(stream: DataFrame, wait: str, time: str = "scheduled_report_time") -> DataFrame:
    """``hour`` and ``n_reports`` of each hour, emitted once when event time has passed it by ``wait`` (append mode)."""
    return stream.withWatermark(time, wait).groupBy(F.window(time, "1 hour")).agg(F.count("*").alias("n_reports")).select(F.col("window.start").alias("hour"), "n_reports")


def dedupe_stream(stream: DataFrame, wait: str, report_id: str = "report_id", time: str = "scheduled_report_time") -> DataFrame:
    """The first report of each id within ``wait``; reports without an id all stay. Run it after validation, or an
    invalid copy may hide a valid one."""
    key = F.when(is_uuid(F.col(report_id)), canonical_uuid(F.col(report_id))).otherwise(F.coalesce(F.col(report_id), F.concat(F.lit("none-"), F.uuid())))
    return stream.withColumn("_key", key).withWatermark(time, wait).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def split_late(reports: DataFrame, closed_hours: DataFrame, time: str = "scheduled_report_time") -> tuple[DataFrame, DataFrame]:
    """(on time, late): a report is late when its hour is in ``closed_hours`` (column ``hour``)."""
    marked = reports.withColumn("_hour", report_hour(F.col(time)))
    closed = closed_hours.select(F.col("hour").alias("_hour")).distinct()
    return marked.join(closed, "_hour", "left_anti").drop("_hour"), marked.join(closed, "_hour", "left_semi").drop("_hour")


def route_late(stream: DataFrame, closed_hours: Callable[[], DataFrame], on_time: str, late: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Reports of closed hours go to a table of their own: batching them again would use up budget.

    Each micro-batch writes a folder named by its id, so a repeated one overwrites itself.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good, bad = split_late(batch, closed_hours())
        good.write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_histogram(contributions: DataFrame, wait: str, time: str = "scheduled_report_time", complete: bool = False) -> DataFrame:
    """Exact sums by hour and bucket as reports arrive. Noise is for the release of a closed hour, once."""
    rows = contributions if complete else contributions.withWatermark(time, wait)
    return rows.groupBy(F.window(time, "1 hour"), "bucket").agg(F.sum("value").alias("unnoised_metric")).select(F.col("window.start").alias("hour"), "bucket", "unnoised_metric")


def consume_in_batch(path: str, ids: list[int], stream: str, on_lacking: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: consumes the budget of a micro-batch, all or nothing.

    ``stream`` names the stream together with its checkpoint: ids of micro-batches begin anew with each checkpoint,
    so a stream that is begun again needs a name of its own. A repeated micro-batch of one stream consumes nothing
    more. ``on_lacking`` gets the units that lack budget; without it, a micro-batch that lacks budget fails.
    """
    if not stream:
        raise ValueError("the stream needs a name")

    def consume(batch: DataFrame, batch_id: int) -> None:
        lacking = budget.consume_budget(budget.budget_units(batch, ids), path, f"stream-{stream}-{batch_id}")
        if lacking.take(1):
            if on_lacking is None:
                raise AggregationError("PRIVACY_BUDGET_EXHAUSTED", f"micro-batch {batch_id} of {stream} lacks privacy budget")
            on_lacking(lacking, batch_id)

    return consume
