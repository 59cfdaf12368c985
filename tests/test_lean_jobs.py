"""What a job keeps of validated reports, and how events are dealt before they become reports."""

from conftest import DATA
from pyspark.sql import functions as F

from tallyveil.functions import files
from tallyveil.functions.folders import shared_folder
from tallyveil.operators import errors, validate
from tallyveil.plans import job as jobs
from tallyveil.plans import queries
from tallyveil.plans.derived import reports


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _left(spark) -> list[str]:
    return [n for n in files.names(spark, shared_folder(spark)) if n.startswith(("checked-", "unique-"))]


def test_reports_with_errors_are_kept_as_errors_alone(spark, tmp_path, monkeypatch):
    seen = []

    def counts(df, fatal=None):
        bad = F.size("errors") > 0
        whole = F.col("shared_info").isNotNull() & F.col("data").isNotNull() & F.col("report_id").isNotNull()
        empty = F.col("shared_info").isNull() & F.col("data").isNull() & F.col("report_id").isNull()
        seen.append(tuple(df.agg(F.count_if(bad), F.count_if(bad & empty), F.count_if(~bad), F.count_if(~bad & whole)).first()))
        assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
        return errors_counts(df, fatal)

    errors_counts = errors.counts
    monkeypatch.setattr(jobs.errors, "counts", counts)
    job = queries._written_job(spark, DATA, str(tmp_path), budget="unlimited")
    for more in ({}, {"input_report_count": "1000"}):  # the second one is watched while it runs
        jobs.run_aggregation(spark, queries.replace(job, output=f"{tmp_path}/{len(more)}", **more))
    n_bad, n_empty, n_good, n_whole = seen[0]
    assert n_bad == n_empty > 0 and n_good == n_whole > 0 and seen[1] == seen[0]
    assert not _left(spark)


def test_a_version_fails_the_job_though_its_report_has_other_errors(spark):
    info = F.col("shared_info").withField("version", F.lit("2.0")).withField("report_id", F.lit("no id"))
    rows = jobs.lean(validate.validate(reports(spark, DATA).withColumn("shared_info", F.when(F.col("event_id") == 7, info).otherwise(F.col("shared_info"))), queries._job()), [])
    total, bad, fatal = errors.counts(rows, F.col(jobs.FATAL))
    assert fatal and 0 < bad < total == reports(spark, DATA).count()
    assert not errors.counts(jobs.lean(validate.validate(reports(spark, DATA), queries._job()), []), F.col(jobs.FATAL))[2]


def test_events_are_dealt_before_they_become_reports(spark):
    plan = _plan(reports(spark, DATA, dealt=True))
    assert "hashpartitioning(event_id" in plan and "md5" not in plan.partition("hashpartitioning(event_id")[2]
    assert reports(spark, DATA, dealt=True).exceptAll(reports(spark, DATA)).isEmpty()
