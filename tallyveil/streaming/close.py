"""Closing hours of a stream: each hour is released once, what comes later goes to a side table.

A micro-batch is one step of a log. It writes its late rows, the sums and budget units of the others, and the release of
the hours that end with it, all under its own number; the log's entry for the number comes last and makes it count. A
micro-batch that is run again after a failure starts over, one that has its entry does nothing. So no row counts twice
and no hour is released twice, however often the stream restarts.

Spark drops rows behind a watermark before any state sees them; here the clock is part of the log, so late rows can be
told from others, and none is lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import UTC, datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AggregationError
from ..functions import files
from ..functions.names import unused
from ..functions.shared_info import report_hour
from ..functions.sizes import bounded_broadcast
from ..operators import budget, histogram, release
from ..operators.ledger import Ledger

_LOG = "batch long, clock timestamp, closed array<timestamp>, exhausted array<timestamp>, release string"


def _text(t: datetime) -> str:
    """An instant as the driver's Python has it, with its offset."""
    return t.astimezone(UTC).isoformat()


class SeenReports:
    """Report ids seen so far, by day of their scheduled time: duplicates are found however late they come.

    A client that sends a report again keeps its scheduled time, so a duplicate lies in the same day, and a batch is
    compared with the days of its own reports alone. Days that validation refuses as too old can be deleted.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def fresh(self, batch: DataFrame, number: int, report_id: str = "report_id", time: str = "scheduled_report_time") -> DataFrame:
        """The reports of ``batch`` whose id no earlier batch had, one of each; their ids are written as seen.

        Reports without an id all stay. A number that is run again gives the same reports. Of equal ids of one day any
        one stays; equal ids of other days are other reports. The reports are written once, so that all who read them
        see the same choice; ``forget`` deletes them when they are used.
        """
        spark, id_key, day = batch.sparkSession, unused(batch, "id_key"), unused(batch, "id_day")
        known = F.when(histogram.is_uuid(F.col(report_id)), histogram.canonical_uuid(F.col(report_id))).otherwise(F.col(report_id))
        rows = batch.withColumn(id_key, known).withColumn(day, F.to_date(time))
        with_id, without = rows.filter(F.col(id_key).isNotNull()), rows.filter(F.col(id_key).isNull())
        days = [r[0] for r in with_id.select(day).distinct().collect()]  # 92 at most where validation goes before
        paths = [f"{self.path}/{d}" for d in files.names(spark, self.path) if d in {f"day={x}" for x in days}]
        first = with_id.dropDuplicates([id_key, day])
        if paths:
            seen = spark.read.schema("id string, day date, batch long").option("basePath", self.path).parquet(*paths).filter(F.col("batch") < number)
            first = first.join(seen.select(F.col("id").alias(id_key), F.col("day").alias(day)), [id_key, day], "left_anti").select(*rows.columns)
        kept = self._fresh(number)
        files.delete(spark, kept)
        first.write.parquet(kept)
        first = spark.read.schema(first.schema).parquet(kept)
        ids = first.select(F.col(id_key).alias("id"), F.col(day).alias("day"))
        staging = f"{self.path}/_staging/{number}"
        files.delete(spark, staging)
        ids.repartition("day").write.partitionBy("day").parquet(staging)
        for name in files.names(spark, staging):
            if name.startswith("day="):
                target = f"{self.path}/{name}/batch={number}"
                files.delete(spark, target)
                files.move_once(spark, f"{staging}/{name}", target)
        return first.unionByName(without).drop(id_key, day)

    def _fresh(self, number: int) -> str:
        return f"{self.path}/_fresh/{number}"

    def forget(self, spark: SparkSession, number: int) -> None:
        """Delete the fresh reports of a number; their ids stay."""
        files.delete(spark, self._fresh(number))


class HourlyRelease:
    """For ``foreachBatch``: sums by hour (and the columns ``by``) of a stream of parsed reports, released hour by hour.

    ``path`` belongs to one stream with its checkpoint. An hour is closed once ``clock``, the largest value so far of a
    column such as the time of receipt, is past its end by ``wait``; reports for closed hours go to ``path/late``.
    ``domain`` (bucket and the columns ``by``): the buckets of each hour's result; without one, its reports' buckets whose
    noisy sum reaches the threshold (all of them with ``skip_threshold``). With a ``ledger``, hours use budget when they
    are released; an hour that lacks budget is closed without a release. ``dedupe``: reports are taken once by their id.
    """

    def __init__(
        self, path: str, wait: timedelta, params: release.PrivacyParams, domain: DataFrame | None = None, by: Iterable[str] = (), ids: list[int] | None = None, time: str = "scheduled_report_time",
        clock: str = "received", noise: str | Callable = "secure", skip_threshold: bool = False, ledger: str | None = None, dedupe: bool = True,
    ):
        self.path, self.wait, self.params, self.domain, self.by = path.rstrip("/"), wait, params, domain, list(by)
        self.ids, self.time, self.clock, self.noise, self.skip_threshold, self.ledger, self.dedupe = ids or [0], time, clock, noise, skip_threshold, ledger, dedupe

    # the log

    def _log(self, spark: SparkSession) -> DataFrame:
        if not files.exists(spark, f"{self.path}/log"):
            return spark.createDataFrame([], _LOG)
        return spark.read.schema(_LOG).option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(f"{self.path}/log")

    def closed_hours(self, spark: SparkSession) -> DataFrame:
        """hour and release (null where budget was lacking) of each closed hour."""
        rows = self._log(spark)
        given = rows.select(F.explode("closed").alias("hour"), "release")
        return given.unionByName(rows.select(F.explode("exhausted").alias("hour"), F.lit(None).cast("string").alias("release")))

    def released(self, spark: SparkSession) -> DataFrame | None:
        """The releases of all closed hours: hour, the columns ``by``, bucket, metric; None before the first."""
        paths = [r.release for r in self._log(spark).filter("release IS NOT NULL").select("release").distinct().toLocalIterator()]  # one a closing batch
        return spark.read.parquet(*paths).drop("unnoised_metric") if paths else None

    def late(self, spark: SparkSession, schema) -> DataFrame:
        """Reports that came for hours already closed, in micro-batches that count."""
        if not files.exists(spark, f"{self.path}/late"):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(f"{self.path}/late").withColumn("batch", F.col("_metadata.file_path"))
        number = F.regexp_extract("batch", r"/late/batch=(\d+)/", 1).cast("long")
        return rows.withColumn("batch", number).join(bounded_broadcast(self._log(spark).select("batch")), "batch", "left_semi").drop("batch")

    # a step

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entry = f"{self.path}/log/{number:020d}.json"
        if files.exists(spark, entry):
            return
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            before = self._log(spark).agg(F.max("clock")).first()[0]
            now = max((x for x in (before, batch.agg(F.max(self.clock)).first()[0]) if x is not None), default=None)
            seen = SeenReports(f"{self.path}/seen")
            rows = seen.fresh(batch, number, time=self.time) if self.dedupe else batch
            hour = unused(batch, "hour")
            rows = rows.withColumn(hour, report_hour(F.col(self.time)))
            closed = bounded_broadcast(self.closed_hours(spark).select(F.col("hour").alias(hour)).distinct())
            rows.join(closed, hour, "left_semi").select(*batch.columns).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
            self._stage(rows.join(closed, hour, "left_anti"), hour, number)
            seen.forget(spark, number)
            hours, exhausted, path = self._close(spark, now, number)
        finally:
            batch.unpersist()
        step = {"batch": number, "clock": _text(now) if now else None, "closed": [_text(h) for h in hours], "exhausted": [_text(h) for h in exhausted], "release": path}
        files.create_once(spark, entry, json.dumps(step) + "\n")

    def _stage(self, rows: DataFrame, hour: str, number: int) -> None:
        """Sums (and units) of one micro-batch by hour, so that closing an hour reads a row a bucket and micro-batch."""
        sums = histogram.histogram(histogram.explode_contributions(rows, self.ids, keep=(hour, *self.by)), (hour, *self.by, "bucket"))
        sums.withColumnRenamed(hour, "hour").repartition("hour").write.mode("overwrite").partitionBy("hour").parquet(f"{self.path}/sums/batch={number}")
        if self.ledger:
            units = budget.budget_units(rows, self.ids).withColumn("hour", F.col("reporting_window"))
            units.repartition("hour").write.mode("overwrite").partitionBy("hour").parquet(f"{self.path}/units/batch={number}")

    def _staged(self, spark: SparkSession, kind: str, schema: str, number: int) -> DataFrame:
        rows = spark.read.schema(f"{schema}, batch long, hour timestamp").parquet(f"{self.path}/{kind}")
        counted = self._log(spark).select("batch").unionByName(spark.createDataFrame([(number,)], "batch long"))
        return rows.join(bounded_broadcast(counted), "batch", "left_semi")

    def _close(self, spark: SparkSession, now: datetime | None, number: int) -> tuple[list[datetime], list[datetime], str | None]:
        """(released hours, hours without budget, release) of the hours that the clock has passed."""
        kinds = "".join(f"{c} {t}, " for c, t in self._by_types(spark))
        sums = self._staged(spark, "sums", f"{kinds}bucket binary, unnoised_metric long", number)
        due = F.col("hour") + F.make_interval(hours=F.lit(1)) + F.make_dt_interval(secs=F.lit(self.wait.total_seconds())) <= F.lit(now)
        open_hours = sums.select("hour").distinct().join(bounded_broadcast(self.closed_hours(spark).select("hour").distinct()), "hour", "left_anti")
        hours = sorted(r.hour for r in open_hours.filter(due).collect()) if now else []  # hours that end, 90 days of them at most
        exhausted: list[datetime] = []
        name, path = f"{self.path}/hours-{number}", f"{self.path}/releases/{number}"
        text = lambda chosen: json.dumps([_text(h) for h in chosen])
        if self.ledger and hours:
            known = Ledger(spark, self.ledger).find(name)
            if known:  # committed by a run of this step that failed later
                given = [h for h in hours if _text(h) in json.loads(known.request)]
                return given, [h for h in hours if h not in given], known.release
        while hours:
            # Without a ledger a failed step's release is written again, as its entry never counted.
            noised = lambda p, h=tuple(hours): self._noised(sums.filter(F.col("hour").isin(list(h))), h).write.mode("overwrite").parquet(p)
            if not self.ledger:
                noised(path)
                return hours, exhausted, path
            units = self._staged(spark, "units", "privacy_budget_key string, reporting_window timestamp, reporting_origin string", number).filter(F.col("hour").isin(hours))
            receipt = Ledger(spark, self.ledger).consume(budget.written_units(units), name, release=noised, request=text(hours))
            if receipt.lacking is None:
                return hours, exhausted, receipt.release
            lacking = {r[0] for r in receipt.lacking.select("reporting_window").distinct().collect()}
            if not lacking & set(hours):
                raise AggregationError("PRIVACY_BUDGET_ERROR", "units that lack budget lie in no hour at hand")
            exhausted, hours = sorted([*exhausted, *lacking]), [h for h in hours if h not in lacking]
        return [], exhausted, None

    def _by_types(self, spark: SparkSession) -> list[tuple[str, str]]:
        if not self.by:
            return []
        written = dict(spark.read.parquet(f"{self.path}/sums").dtypes)
        return [(c, written[c]) for c in self.by]

    def _noised(self, sums: DataFrame, hours: tuple[datetime, ...]) -> DataFrame:
        keys = ("hour", *self.by, "bucket")
        total = sums.groupBy(*keys).agg(F.sum("unnoised_metric").alias("unnoised_metric"))
        if self.domain is not None:
            wanted = self.domain.select(*self.by, "bucket").distinct().withColumn("hour", F.explode(F.array(*(F.lit(h) for h in hours))))
            total = wanted.join(total, list(keys), "left").select(*keys, F.coalesce("unnoised_metric", F.lit(0).cast("bigint")).alias("unnoised_metric"))
        noised = release.add_noise(total, self.params, self.noise)
        return noised if self.domain is not None or self.skip_threshold else release.apply_threshold(noised, self.params.threshold())
