"""Hours of a stream are released once; late reports, repeated steps, failures and lacking budget."""

from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_jobs import FACTS, INFO, b

from tallyveil.functions import files
from tallyveil.operators import budget
from tallyveil.operators.release import PrivacyParams
from tallyveil.streaming import close

T0 = datetime(2021, 3, 1, tzinfo=UTC)
PARAMS = PrivacyParams(epsilon=1.0, l1=10)


def at(hours):
    return T0 + timedelta(hours=hours)


def reports(spark, *rows):
    """(id, hour of schedule, hour of receipt, bucket, value, destination)"""
    made = []
    for rid, scheduled, received, bucket, value, destination in rows:
        full = None if rid is None else f"00000000-0000-0000-0000-{rid:012x}"
        info = ("1.0", "shared-storage", at(scheduled), "https://a.com", destination, None, full, None)
        made.append((full, at(scheduled), at(received), destination, info, [(b(bucket), value, Decimal(0)), (b(0), 0, None)]))
    return spark.createDataFrame(made, f"report_id string, scheduled_report_time timestamp, received timestamp, destination string, shared_info {INFO}, data {FACTS}")


def result(hours, spark, *by):
    out = hours.released(spark)
    return {} if out is None else {(r.hour.hour, *(r[c] for c in by), int.from_bytes(r.bucket, "big")): r.metric for r in out.collect()}


def test_hours_close_once_and_late_reports_go_aside(spark, tmp_path):
    hours = close.HourlyRelease(str(tmp_path / "out"), timedelta(hours=2), PARAMS, noise="none", skip_threshold=True)
    first = reports(spark, (1, 0.1, 0.5, 7, 3, "d"), (2, 0.9, 1.0, 7, 4, "d"), (3, 1.2, 1.3, 8, 5, "d"), (None, 0.2, 0.3, 9, 1, "d"), (None, 0.2, 0.3, 9, 1, "d"))
    hours(first, 0)
    assert result(hours, spark) == {} and hours.late(spark, first.schema).count() == 0
    hours(reports(spark, (1, 0.1, 3.1, 7, 3, "d"), (4, 0.5, 3.0, 7, 10, "d"), (4, 0.5, 3.0, 7, 10, "d")), 1)  # the clock passes hour 0 by two
    want = {(0, 7): 17, (0, 9): 2}
    assert result(hours, spark) == want
    for _ in range(2):  # a step that is run again does nothing
        hours(reports(spark, (5, 0.5, 3.2, 7, 100, "d"), (6, 1.5, 3.2, 8, 1, "d"), (2, 0.9, 3.2, 7, 4, "d")), 2)
    assert result(hours, spark) == want
    assert [r.report_id[-1] for r in hours.late(spark, first.schema).collect()] == ["5"]  # a duplicate is not late but gone
    hours(reports(spark, (7, 9, 9, 1, 1, "d")), 3)
    assert result(hours, spark) == want | {(1, 8): 6}
    hours(first.limit(0), 4)
    assert result(hours, spark) == want | {(1, 8): 6} and hours.closed_hours(spark).count() == 2


def test_a_failed_step_starts_over(spark, tmp_path, monkeypatch):
    """It fails after everything is written but its entry: noise may be drawn anew, as nothing of it was to be seen."""
    hours = close.HourlyRelease(str(tmp_path / "out"), timedelta(hours=0), PARAMS, noise="secure", skip_threshold=True)
    hours(reports(spark, (1, 0, 0, 7, 3, "d")), 0)
    batch = reports(spark, (2, 0, 5, 7, 4, "d"), (3, 5, 5, 7, 1, "d"))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(close.files, "create_once", fails)
        with pytest.raises(OSError):
            hours(batch, 1)
    assert hours.released(spark) is None and hours.late(spark, batch.schema).count() == 0
    hours(batch, 1)
    once = result(hours, spark)
    assert set(once) == {(0, 7)} and result(hours, spark) == once
    assert {r.unnoised_metric for r in spark.read.parquet(str(tmp_path / "out" / "releases" / "1")).collect()} == {7}


def test_budget_is_used_when_hours_are_released(spark, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    used = reports(spark, (90, 1, 1, 1, 1, "d"))
    budget.consume_budget(budget.budget_units(used, [0]), ledger, "before")
    hours = close.HourlyRelease(str(tmp_path / "out"), timedelta(hours=0), PARAMS, noise="secure", skip_threshold=True, ledger=ledger)
    batch = reports(spark, (1, 0, 0, 7, 3, "d"), (2, 1, 1, 7, 4, "d"), (3, 2, 2, 7, 1, "d"), (4, 3, 3.5, 7, 1, "d"))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # after the commit: the step that is run again publishes the same draw
        real = close.files.create_once
        m.setattr(close.files, "create_once", lambda s, p, t: fails() if "/log/" in p else real(s, p, t))
        with pytest.raises(OSError):
            hours(batch, 0)
    kept = {r.token for r in budget.Ledger(spark, ledger).commits().filter("has_release").collect()}
    assert budget.read_ledger(spark, ledger).count() == 3 and len(kept) == 1  # hours 0 and 2, and hour 1 of before
    hours(batch, 0)
    assert set(result(hours, spark)) == {(0, 7), (2, 7)} and budget.read_ledger(spark, ledger).count() == 3
    assert {r.release.rpartition("/")[2] for r in hours.closed_hours(spark).filter("release IS NOT NULL").collect()} == kept
    assert {(r.hour.hour, r.release is None) for r in hours.closed_hours(spark).collect()} == {(0, False), (1, True), (2, False)}


def test_domains_by_destination(spark, tmp_path):
    domain = spark.createDataFrame([("d", b(7)), ("d", b(8)), ("e", b(7))], "destination string, bucket binary")
    hours = close.HourlyRelease(str(tmp_path / "out"), timedelta(hours=0), PARAMS, domain=domain, by=["destination"], noise="none")
    hours(reports(spark, (1, 0, 0, 7, 3, "d"), (2, 0, 0, 9, 4, "d"), (3, 1, 1, 7, 5, "e"), (4, 5, 5, 1, 1, "d")), 0)
    assert result(hours, spark, "destination") == {(0, "d", 7): 3, (0, "d", 8): 0, (0, "e", 7): 0, (1, "d", 7): 0, (1, "d", 8): 0, (1, "e", 7): 5}


def test_duplicates_are_found_however_late(spark, tmp_path):
    seen = close.SeenReports(str(tmp_path / "seen"))
    ids = lambda df: sorted(int(r.report_id[-3:], 16) if r.report_id else 0 for r in df.collect())
    first = reports(spark, (1, 0, 0, 1, 1, "d"), (1, 0.5, 0, 1, 1, "d"), (2, 30, 30, 1, 1, "d"), (None, 0, 0, 1, 1, "d")).withColumn("id_key", F.lit("the caller's"))
    assert ids(seen.fresh(first, 0)) == [0, 1, 2] and seen.fresh(first, 0).columns == first.columns
    later = reports(spark, (1, 0.5, 2000, 1, 1, "d"), (3, 30, 2000, 1, 1, "d"), (2, 30, 2000, 1, 1, "d"), (2, 60, 60, 1, 1, "d"))
    assert ids(seen.fresh(later, 7)) == [2, 3]  # id 2 of another day is another report
    assert ids(seen.fresh(first, 0)) == [0, 1, 2] and ids(seen.fresh(later, 7)) == [2, 3] and ids(seen.fresh(later, 8)) == []


def test_fresh_reports_are_chosen_once_and_forgotten(spark, tmp_path):
    """Of equal ids one report stays, the same for all who read them; nothing of a step is left after it."""
    rows = spark.range(400).select((F.col("id") % 100).cast("string").alias("report_id"), F.lit(datetime(2024, 1, 1, tzinfo=UTC)).alias("scheduled_report_time"), F.rand().alias("x"))
    seen = close.SeenReports(f"{tmp_path}/seen")
    fresh = seen.fresh(rows, 0)
    assert "Aggregate" not in fresh._jdf.queryExecution().executedPlan().toString() and fresh.count() == 100
    assert sorted(fresh.collect()) == sorted(fresh.collect())
    seen.forget(spark, 0)
    assert files.names(spark, f"{tmp_path}/seen/_fresh") == []
    assert seen.fresh(rows, 1).count() == 0
