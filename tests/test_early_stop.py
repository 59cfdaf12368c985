"""Jobs that stop while they run."""

import time

import pytest
from pyspark.sql import functions as F
from test_jobs import FACTS, INFO, NOW, job, report

from tallyveil.operators import errors, validate
from tallyveil.operators.early_stop import ErrorWatch
from tallyveil.plans import job as jobs

PARTS = 48


def slow_reports(spark, bad):
    """A report a partition, each read slowly; the accumulator counts tasks that ended."""
    tasks = spark.sparkContext.accumulator(0)
    rows = [report(i, [(1, 1, 0)], operation="sum" if bad(i) else "histogram") for i in range(PARTS)]

    def slowly(batches):
        for batch in batches:
            time.sleep(0.2 if batch.num_rows else 0)
            yield batch
        tasks.add(1)

    df = spark.createDataFrame(rows, f"report_id string, shared_info {INFO}, operation string, data {FACTS}").withColumn("n", F.monotonically_increasing_id())
    parts = df.drop("n").rdd.repartition(PARTS).toDF(df.drop("n").schema)
    return parts.mapInArrow(slowly, parts.schema), tasks


@pytest.mark.parametrize("more", [{"input_report_count": str(PARTS)}, {"report_error_threshold_percentage": "0"}])
def test_a_bad_batch_stops_before_its_last_task(spark, more):
    reports, tasks = slow_reports(spark, lambda i: True)
    domain = spark.createDataFrame([(bytes(16),)], "bucket binary")
    out = jobs.run_aggregation(spark, job(**more), reports, domain)
    row = out.result_info.first()
    seen = {r.category: r["count"] for r in out.errors.collect()}
    assert row.return_code == "REPORTS_WITH_ERRORS_EXCEEDED_THRESHOLD" and out.summary is None
    assert errors.allowed(job(**more).percent, job(**more).announced) < seen["NUM_REPORTS_WITH_ERRORS"] == seen["UNSUPPORTED_OPERATION"] <= row.n_errors
    assert tasks.value < PARTS
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert spark.range(10).count() == 10  # other jobs of the session run on


def test_a_batch_within_its_limit_counts_all(spark):
    reports, _ = slow_reports(spark, lambda i: i % 16 == 0)
    domain = spark.createDataFrame([(bytes(15) + b"\1",)], "bucket binary")
    out = jobs.run_aggregation(spark, job(input_report_count=str(PARTS)), reports, domain)
    assert (out.result_info.first().return_code, out.result_info.first().n_errors) == ("SUCCESS_WITH_ERRORS", 3)
    assert out.summary.first().metric == PARTS - 3


def test_counts_are_those_of_the_summary(spark):
    """A report with several errors, none, or one twice counts once under the total; a partition computed twice once."""
    watch = ErrorWatch(spark)
    rows = spark.createDataFrame([(["A", "B"],), (["A", "A"],), ([],), (["B"],)], "errors array<string>").repartition(3)
    marked, name = watch.watched(rows.withColumn("n_errors", F.lit("caller's")))
    assert name != "n_errors" and sorted(r[name] for r in marked.collect()) == [0, 1, 1, 2]
    marked.collect()
    want = {r.category: r["count"] for r in errors.error_summary(rows).collect()}
    assert watch.counts() == want == {"A": 2, "B": 2, "NUM_REPORTS_WITH_ERRORS": 3}
    assert [(r.category, r["count"]) for r in watch.summary().collect()] == [("A", 2), ("B", 2), ("NUM_REPORTS_WITH_ERRORS", 3)]
    with pytest.raises(ZeroDivisionError):
        ErrorWatch(spark).run(lambda: 1 / 0, 0)
    assert validate.descriptions(spark).count() and NOW
