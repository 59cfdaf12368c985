"""Domains that are laid out by key once."""

import re

import pytest

from tallyveil.errors import AggregationError
from tallyveil.functions.buckets import norm_bucket
from tallyveil.operators import release
from tallyveil.plans.job import AggregationJob
from tallyveil.sources.readers import domain_buckets, read_bucketed_domain
from tallyveil.sources.writers import BUCKETS, write_bucketed_domain


def keys(spark, numbers):
    return spark.createDataFrame([(bytes([n % 256, n // 256]),) for n in numbers], "bucket binary")


@pytest.fixture
def laid_out(spark, tmp_path):
    path = f"{tmp_path}/keys"
    write_bucketed_domain(keys(spark, [*range(2000), *range(500)]), path, 6)
    return path


def exchanges_over_domain(df):
    """Number of exchanges between the join and the domain's scan, in the plan as it is before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "Bucketed: " in x)
    depth = lambda x: len(re.match(r"[\s:|+\-*()\d]*", x).group())
    n, low = 0, depth(lines[scan])
    for x in reversed(lines[:scan]):
        if depth(x) < low:
            low = depth(x)
            n += "Exchange" in x
            if "Join" in x:
                return n
    raise AssertionError(plan)


def test_keys_are_distinct_and_in_one_file_a_bucket(spark, laid_out):
    assert domain_buckets(spark, laid_out) == 6
    domain = read_bucketed_domain(spark, laid_out)
    want = {bytes(r.bucket) for r in keys(spark, range(2000)).select(norm_bucket("bucket").alias("bucket")).collect()}
    got = [bytes(r.bucket) for r in domain.collect()]
    assert len(got) == 2000 and set(got) == want
    assert len(set(domain.inputFiles())) == 6


@pytest.mark.parametrize("join", [release.join_domain, release.debug_report])
def test_domain_is_joined_without_exchange(spark, laid_out, join):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = keys(spark, [*range(0, 3000, 3)] * 2).select(norm_bucket("bucket").alias("bucket")).groupBy("bucket").count().withColumnRenamed("count", "unnoised_metric")
        out = join(facts.repartition(6, "bucket"), read_bucketed_domain(spark, laid_out))
        assert exchanges_over_domain(out) == 0
        plain = join(facts, read_bucketed_domain(spark, laid_out))
        assert exchanges_over_domain(join(facts.repartition(5, "bucket"), read_bucketed_domain(spark, laid_out).repartition(5, "bucket"))) == 1
        assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
        assert out.count() == (2000 if join is release.join_domain else 2000 + len(range(2001, 3000, 3)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unfinished_and_taken_folders_are_refused(spark, laid_out, tmp_path):
    with pytest.raises(FileExistsError):
        write_bucketed_domain(keys(spark, range(3)), laid_out, 2)
    (tmp_path / "keys" / BUCKETS).unlink()
    with pytest.raises(AggregationError) as unfinished:
        read_bucketed_domain(spark, laid_out)
    assert unfinished.value.code == "INPUT_DATA_READ_FAILED"
    with pytest.raises(AggregationError, match="one folder"):
        AggregationJob(attribution_report_to="https://a.com", reports="r", domain=["a", "b"], domain_format="bucketed").validate()


def test_empty_domain(spark, tmp_path):
    write_bucketed_domain(keys(spark, range(1)).limit(0), f"{tmp_path}/none", 3)
    assert read_bucketed_domain(spark, f"{tmp_path}/none").count() == 0
