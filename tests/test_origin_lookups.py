"""How the sites of reports are looked up."""

from conftest import DATA
from pyspark.sql import functions as F

from tallyveil.functions import origins
from tallyveil.operators import validate
from tallyveil.plans import queries
from tallyveil.plans.derived import reports


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sites_are_looked_up_without_a_shuffle_of_the_reports(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size Spark cannot tell
    try:
        job = queries.replace(queries._job(), attribution_report_to=None, reporting_site="https://origin2.com")
        plans = [_plan(validate.validate(reports(spark, DATA), job)), _plan(origins.with_domain_flag(reports(spark, DATA).withColumn("o", F.col("shared_info.reporting_origin")), origins.suffix_table(spark), "o"))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans:
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert "parse_url" not in plan  # hosts are taken from the distinct origins, not from each report
