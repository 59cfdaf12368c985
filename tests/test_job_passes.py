"""What a job does once a report, and how its later passes read the deduplicated reports."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyveil.functions import files, payload, shared_info
from tallyveil.functions.folders import shared_folder
from tallyveil.operators import budget, validate
from tallyveil.plans import job as jobs
from tallyveil.plans import queries
from tallyveil.plans.derived import reports


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_are_parsed_once_a_report_and_only_payloads_go_through_python(spark):
    checked = validate.validate(reports(spark, DATA), queries._job())
    assert _plan(checked.select("errors")).count("^\\d+\\.\\d+$") == 1 and "filter(" not in _plan(checked)
    assert _plan(budget.unit_rows(reports(spark, DATA), [0, 1])).count("^\\d+\\.\\d+$") == 1
    raw = payload.encode_payload(reports(spark, DATA).select("event_id", "operation", "data"))
    for df in (raw, payload.decode_payload(raw.withColumn("more", F.lit(1)))):
        assert "ArrowEvalPython" in _plan(df) and "MapInArrow" not in _plan(df)


@pytest.mark.parametrize("text,want", [("1.0", (1, 0)), ("0.10", (0, 10)), ("01.002", (1, 2)), ("1", None), ("1.0.0", None), ("a.b", None), (".1", None), ("1.", None), ("99999999999.0", None), (None, None)])
def test_version_struct(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(shared_info.version_struct(F.col("v"))).first()[0] == want


def test_later_passes_read_few_partitions_and_leave_nothing(spark, tmp_path, monkeypatch):
    seen = []
    units = budget.budget_units
    monkeypatch.setattr(jobs.budget, "budget_units", lambda df, ids: seen.append(df.rdd.getNumPartitions()) or units(df, ids))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = jobs.run_aggregation(spark, queries._written_job(spark, DATA, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out.result_info.first().return_code == "SUCCESS_WITH_ERRORS" and 1 <= seen[0] < 64
    assert not [n for n in files.names(spark, shared_folder(spark)) if n.startswith("unique-")]
