import hashlib
import json
import math
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyveil.errors import AggregationError
from tallyveil.functions import exact_noise, payload
from tallyveil.operators import budget, histogram, release, tools, validate
from tallyveil.plans import job as jobs
from tallyveil.sources import readers, writers
from tallyveil.streaming import collect

NOW = datetime(2021, 2, 1, tzinfo=UTC)
FACTS = "array<struct<bucket:binary,value:bigint,id:decimal(20,0)>>"
INFO = "struct<version:string,api:string,scheduled_report_time:timestamp,reporting_origin:string,attribution_destination:string,source_registration_time:timestamp,report_id:string,debug_mode:string>"


def b(n):
    return n.to_bytes(16, "big")


def report(n, facts, version="1.0", api="shared-storage", origin="https://a.foo.com", time=NOW, debug=None, report_id=None, operation="histogram", destination=None):
    rid = report_id if report_id is not None else f"00000000-0000-0000-0000-{n:012x}"
    return (rid, (version, api, time, origin, destination, None, rid, debug), operation, [(b(k), v, None if i is None else Decimal(i)) for k, v, i in facts])


def frame(spark, rows):
    return spark.createDataFrame(rows, f"report_id string, shared_info {INFO}, operation string, data {FACTS}")


def job(**more):
    return jobs.AggregationJob(**({"attribution_report_to": "https://a.foo.com", "as_of": NOW, "noise": "none", "domain": "-", "budget": "unlimited"} | more))


def summary(df):
    return {int.from_bytes(r.bucket, "big"): r.metric for r in df.collect()}


def test_smoke_histogram(spark):
    want = {0: 345, 2**120: 2, 1234: 505, 4567890: 123, 2**128 - 1: 345}
    rows = [report(i, [(k, v // 3, None), (0, 0, None)]) for i, (k, v) in enumerate(want.items())] + [report(i + 9, [(k, v - v // 3, 0)]) for i, (k, v) in enumerate(want.items())]
    out = jobs.run_aggregation(spark, job(), frame(spark, rows), spark.createDataFrame([(bytes([0]),), *((b(k),) for k in want), (b(7),), (b(7),)], "bucket binary"))
    assert summary(out.summary) == want | {7: 0}
    assert out.result_info.first().return_code == "SUCCESS"


def test_histogram_does_not_depend_on_sharding_order_or_copies(spark):
    rows = [report(i, [(i % 5, i, i % 2), (3, 1, 0)]) for i in range(60)]
    total = lambda df: summary(histogram.histogram(histogram.explode_contributions(histogram.dedupe_reports(df))).withColumnRenamed("unnoised_metric", "metric"))
    once = total(frame(spark, rows))
    assert once == total(frame(spark, rows[::-1] + rows[:20]).repartition(7))
    assert sum(once.values()) == sum(range(60)) + 60


def test_upper_and_lower_case_ids_are_one(spark):
    rows = [report(1, [(1, 1, 0)], report_id="0000000A-0000-0000-0000-000000000001"), report(1, [(1, 1, 0)], report_id="a-0-0-0-1")]
    assert histogram.dedupe_reports(frame(spark, rows)).count() == 1


def test_validators_and_overlaps(spark):
    old, edge = datetime(2020, 11, 3, tzinfo=UTC), datetime(2020, 11, 3, 0, 0, 1, tzinfo=UTC)
    cases = [
        (report(1, []), []), (report(2, [], api="other"), ["UNSUPPORTED_REPORT_API_TYPE", "REQUIRED_SHAREDINFO_FIELD_INVALID"]), (report(3, [], api=None), ["REQUIRED_SHAREDINFO_FIELD_INVALID"]),
        (report(4, [], api=""), ["UNSUPPORTED_REPORT_API_TYPE", "REQUIRED_SHAREDINFO_FIELD_INVALID"]), (report(5, [], version="abc"), ["REQUIRED_SHAREDINFO_FIELD_INVALID", "UNSUPPORTED_SHAREDINFO_VERSION"]),
        (report(6, [], version="0.0"), ["REQUIRED_SHAREDINFO_FIELD_INVALID", "UNSUPPORTED_SHAREDINFO_VERSION"]), (report(7, [], time=old), ["ORIGINAL_REPORT_TIME_TOO_OLD"]), (report(8, [], time=edge), []),
        (report(9, [], operation="sum"), ["UNSUPPORTED_OPERATION"]), (report(10, [], report_id=""), ["INVALID_REPORT_ID"]), (report(11, [], origin="https://b.foo.com"), ["ATTRIBUTION_REPORT_TO_MISMATCH"]),
        (report(12, [], api="attribution-reporting"), ["REQUIRED_SHAREDINFO_FIELD_INVALID"]), (report(13, [], api="attribution-reporting", destination="https://d.com"), []),
    ]
    out = validate.validate(frame(spark, [c[0] for c in cases]).coalesce(1), job())
    got = {r.shared_info.report_id: r.errors for r in out.collect()}
    assert got == {c[0][0]: c[1] for c in cases}
    debug = validate.validate(frame(spark, [report(1, []), report(2, [], debug="enabled"), report(3, [], debug="on")]), job(debug_run=True), validate.OFFLINE)
    assert sorted(len(r.errors) for r in debug.collect()) == [0, 1, 1]
    site = validate.validate(frame(spark, [report(1, []), report(2, [], origin="https://x.bar.com"), report(3, [], origin="foo")]), job(attribution_report_to=None, reporting_site="https://foo.com"))
    assert {r.shared_info.report_id[-1]: r.errors for r in site.collect()} == {"1": [], "2": ["REPORTING_SITE_MISMATCH"], "3": ["ATTRIBUTION_REPORT_TO_MALFORMED"]}


def test_own_validator(spark):
    validate.register_validator("empty", lambda _: F.when(F.size("data") == 0, "INTERNAL_ERROR"))
    try:
        assert validate.validate(frame(spark, [report(1, [])]), job()).first().errors == ["INTERNAL_ERROR"]
    finally:
        del validate.VALIDATORS["empty"]


def test_job_failures(spark):
    bad = frame(spark, [report(1, [(1, 1, 0)]), report(2, [(1, 1, 0)], operation="sum")])
    domain = spark.createDataFrame([(b(1),)], "bucket binary")
    out = jobs.run_aggregation(spark, job(), bad, domain)
    assert out.summary is None and out.result_info.first().return_code == "REPORTS_WITH_ERRORS_EXCEEDED_THRESHOLD"
    out = jobs.run_aggregation(spark, job(report_error_threshold_percentage="50"), bad, domain)
    assert out.result_info.first().return_code == "SUCCESS_WITH_ERRORS" and summary(out.summary) == {1: 1}
    assert [(r.category, r["count"]) for r in out.errors.collect()] == [("UNSUPPORTED_OPERATION", 1), ("NUM_REPORTS_WITH_ERRORS", 1)]
    with pytest.raises(AggregationError) as e:
        jobs.run_aggregation(spark, job(), frame(spark, [report(1, [], version="2.0")]), domain)
    assert e.value.code == "UNSUPPORTED_REPORT_VERSION"
    for more in ({"reporting_site": "https://foo.com"}, {"attribution_report_to": None}, {"attribution_report_to": " "}, {"domain": None}, {"report_error_threshold_percentage": "101"}, {"input_report_count": "-1"}, {"filtering_ids_text": "x"}, {"debug_privacy_epsilon": "99"}):
        with pytest.raises(AggregationError) as e:
            job(**more).validate()
        assert e.value.code == "INVALID_JOB"
    with pytest.raises(AggregationError) as e:
        readers.read_reports(spark, "/tmp/no-such-folder-of-reports").count()
    assert e.value.code == "INPUT_DATA_READ_FAILED"


def test_budget_is_all_or_nothing_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a, more = frame(spark, [report(1, [(0, 0, 0)]), report(2, [])]), frame(spark, [report(3, [], origin="https://b.foo.com"), report(1, [])])
    units = budget.budget_units(a, [0, 1])
    assert units.count() == 2  # null facts use budget too
    assert budget.consume_budget(units, path, "one").count() == 0
    assert budget.consume_budget(units, path, "one").count() == 0 and budget.read_ledger(spark, path).count() == 2
    lacking = budget.consume_budget(budget.budget_units(more, [0, 1]), path, "two")
    assert lacking.count() == 2 and budget.read_ledger(spark, path).count() == 2
    info = budget.exhausted_info(lacking, budget.unit_inputs(more, [0, 1])).collect()
    assert {int(r.filtering_id) for r in info} == {0, 1} and {r.reporting_origin for r in info} == {"https://a.foo.com"}
    out = jobs.run_aggregation(spark, job(ledger=path, budget="ledger", filtering_ids_text="0"), a, spark.createDataFrame([(b(1),)], "bucket binary"))
    assert out.result_info.first().return_code == "PRIVACY_BUDGET_EXHAUSTED" and out.summary is None


def test_debug_report_and_files(spark, tmp_path):
    rows = frame(spark, [report(1, [(1, 5, 0), (2, 6, 0)], debug="enabled")])
    out = jobs.run_aggregation(spark, job(debug_run=True, noise=lambda m: m + 1, output=str(tmp_path / "out")), rows, spark.createDataFrame([(b(1),), (b(3),)], "bucket binary"))
    assert {int.from_bytes(r.bucket, "big"): (r.unnoised_metric, r.metric, tuple(r.annotations)) for r in out.debug.collect()} == {1: (5, 6, ("in_domain", "in_reports")), 2: (6, 7, ("in_reports",)), 3: (0, 1, ("in_domain",))}
    assert summary(readers.read_summary(spark, str(tmp_path / "out"))) == {1: 6, 3: 1}
    debug = readers.read_debug(spark, str(tmp_path / "debug" / "out")).collect()
    assert {(int.from_bytes(r.bucket, "big"), r.noise, r.metric) for r in debug} == {(1, 1, 6), (2, 1, 7), (3, 1, 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(b(2**128 - 1), 1), (b(0), 2), (b(0xE9), 3)], "bucket binary, metric long")
    writers.write_summary(df, str(tmp_path / "csv"), "csv")
    assert {r.bucket for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {str(2**128 - 1), "0", "233"}
    writers.write_summary(df, str(tmp_path / "hex"), "csv", hex_buckets=True)
    assert {r.bucket for r in spark.read.option("header", True).csv(str(tmp_path / "hex")).collect()} == {"0x" + "F" * 32, "0x0", "0xE9"}
    writers.write_summary(df.filter("metric = 3"), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).first().bucket == "é"
    writers.write_sharded(df.coalesce(1), str(tmp_path / "shards"), 355)
    assert sorted(x.name for x in (tmp_path / "shards").glob("*.parquet")) == [f"shards-{i}-of-3.parquet" for i in (1, 2, 3)]
    assert readers.read_summary(spark, str(tmp_path / "shards")).count() == 3 and not list((tmp_path / "shards").glob("_staging*"))
    writers.write_summary(df.repartition(2), str(tmp_path / "array"), "json_array")
    arrays = [json.loads(x.read_text()) for x in (tmp_path / "array").glob("part-*.txt")]
    assert sorted(r["metric"] for a in arrays for r in a) == [1, 2, 3]
    tools.shard_table(spark.range(100), 7, str(tmp_path / "seven"))
    assert len(list((tmp_path / "seven").glob("part-*.parquet"))) == 7
    units = spark.createDataFrame([("k", "o", "s3/a.parquet"), ("k", "o", "s3/b.parquet")], "privacy_budget_key string, reporting_origin string, source_file string")
    writers.export_budget_units(units, str(tmp_path / "units"), per_file=True)
    assert {p.name for p in (tmp_path / "units").glob("source_file=*")} == {"source_file=a.parquet", "source_file=b.parquet"}
    writers.export_budget_units(units, str(tmp_path / "all"))
    assert [r for x in (tmp_path / "all").glob("part-*.txt") for r in json.loads(x.read_text())] == [{"privacy_budget_key": "k", "reporting_origin": "o"}]
    writers.export_budget_units(units, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    info = spark.createDataFrame([("x", NOW)], "version string, scheduled_report_time timestamp")
    writers.write_exhausted_info(info, str(tmp_path / "info"))
    assert spark.read.text(str(tmp_path / "info")).first().value == '{"scheduled_report_time":1.6121376E9,"version":"x"}'


def test_sources(spark, tmp_path):
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys" / "a.txt").write_bytes(b"abc\n\"q\"\ncaf\xe9\n\nabc\n")
    got = {bytes(r.bucket).lstrip(b"\0") for r in readers.read_domain(spark, str(tmp_path / "keys"), "text").collect()}
    assert got == {b"abc", b'"q"', b"caf\xe9"}
    (tmp_path / "keys" / "b.txt").write_bytes(b"0123456789abcdefg\n")
    with pytest.raises(Exception, match="longer than 16"):
        readers.read_domain(spark, str(tmp_path / "keys"), "text").count()
    raw = spark.createDataFrame([(b"x", "k", "{}")], "payload binary, key_id string, shared_info string")
    writers.write_reports(raw, str(tmp_path / "r1"))
    writers.write_reports(raw, str(tmp_path / "r2"))
    (tmp_path / "r2" / "part-empty.parquet").touch()
    assert readers.read_reports(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")]).count() == 2


def test_exact_quantiles_by_rank(spark):
    """Nulls, ties, one value, repeated keys, keys that are null; spread over many partitions."""
    import random

    import numpy as np

    r = random.Random(3)
    rows = [(k, None if r.random() < 0.1 else float(r.choice([r.randrange(50), r.random()]))) for k in (None, "a", "b") for _ in range(400)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "key0 string, x double").repartition(6)
    qs = (0.0, 0.1, 0.5, 0.77, 1.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {(x.key0, x.quantile): x.x for x in tools.exact_quantiles(df, "x", qs, ("key0",)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = {k: [v for key, v in rows if key == k and v is not None] for k in (None, "a", "b", "one")}
    assert set(got) == {(k, q) for k in known for q in qs}
    assert all(abs(got[k, q] - np.quantile(v, q)) < 1e-9 for k, v in known.items() for q in qs)
    assert tools.exact_quantiles(df.limit(0), "x", qs).count() == 0
    assert {x.quantile: x.x for x in tools.exact_quantiles(df.filter("key0 = 'one'"), "x", qs).collect()} == dict.fromkeys(qs, 5.0)


def test_columnar_payloads_are_those_of_the_parser():
    """Payloads of several layouts, cut, changed and random ones: each is what it is when it is parsed alone."""
    import random

    import pyarrow as pa

    r = random.Random(11)
    fact = lambda with_id: {"bucket": r.randbytes(16), "value": r.randrange(1 << 32), "id": Decimal(r.randrange(1 << 64)) if with_id else None}
    rows = [("histogram" if k % 7 else r.choice(["sum", "", None, "é"]), [fact(k % 3 == 0 or j == 4) for j in range(r.choice([0, 1, 1, 2, 5, 30]))]) for k in range(300)] + [("histogram", None)]
    kind = pa.list_(payload._FACT)
    made = payload.encoded(pa.array([o for o, _ in rows], pa.string()), pa.array([d for _, d in rows], kind)).to_pylist()
    assert made == [payload._encoded(o, d) for o, d in rows]
    reordered = [b"\xa2\x64data\x81\xa3\x62id\x41" + r.randbytes(1) + b"\x65value\x42" + r.randbytes(2) + b"\x66bucket\x43" + r.randbytes(3) + b"\x69operation\x69histogram" for _ in range(40)]
    odd = [b"\xa2\x64data\x80\x69operation\x61x", b"\xa3\x64data\x80\x69operation\x61x\x61y\xf6", b"\xa2\x64data\x81\xa2\x65value\x40\x66bucket\x40\x69operation\x61x", b"\xa2\x64data\x81\xa3\x62id\x05\x65value\x40\x66bucket\x40\x69operation\x61x", None, b""]
    every = made + reordered + odd
    for p in r.sample(made, 120) + reordered:
        p = bytearray(p)
        for _ in range(r.randint(1, 3)):
            p[r.randrange(len(p))] = r.randrange(256)
        every += [bytes(p), bytes(p[: r.randrange(len(p))])]
    r.shuffle(every)
    operation, facts = payload.decoded(pa.array([b"first", *every], pa.binary()).slice(1))
    for p, o, d in zip(every, operation.to_pylist(), facts.to_pylist(), strict=True):
        want = payload._facts(p)
        assert o == (want and want[0])
        number = lambda x: int.from_bytes(x, "big")
        assert d == (want and [{"bucket": x.rjust(16, b"\0"), "value": number(v), "id": None if i is None else Decimal(number(i))} for x, v, i in want[1]])


def test_payloads(spark):
    good = frame(spark, [report(1, [(2**128 - 1, 2**32 - 1, 2**64 - 1), (0, 0, None)] * 60), report(2, [])]).select("report_id", "operation", "data")
    assert sorted(payload.decode_payload(payload.encode_payload(good)).drop("payload_errors").collect()) == sorted(good.collect())
    bad = spark.createDataFrame([(None,), (b"",), (b"\xa1",), (b"\xa2\x69operation\x69histogram\x64data\x81\xa1\x66bucket\x51" + b"\1" * 17,), (b"\xff" * 40,)], "payload binary")
    assert [r.payload_errors for r in payload.decode_payload(bad).collect()] == [["REPORT_PARSING_ERROR"]] * 5


def test_union_needs_equal_parameters(spark):
    a = spark.range(1)
    with pytest.raises(ValueError):
        release.union_results(a, a, release.PrivacyParams(1), release.PrivacyParams(2))


def test_diff_refuses_duplicates(spark):
    a = spark.createDataFrame([(b(1), 1), (b(1), 2)], "bucket binary, metric long")
    with pytest.raises(Exception, match="duplicate bucket"):
        tools.diff_results(a, a).collect()


def test_streams(spark, tmp_path):
    rows = [(f"00000000-0000-0000-0000-{i // 2:012x}", datetime(2024, 1, 1, i // 4, tzinfo=UTC), b(i % 3), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "report_id string, scheduled_report_time timestamp, bucket binary, value long")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    collect.write_hourly(collect.batch_by_hour(collect.dedupe_stream(stream(), "2 days")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20 == histogram.dedupe_reports(df).count()
    closed = spark.createDataFrame([(datetime(2024, 1, 1, 0, tzinfo=UTC),)], "hour timestamp")
    collect.route_late(stream(), lambda: closed, str(tmp_path / "ok"), str(tmp_path / "late"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "late")).count() == 4 and spark.read.parquet(str(tmp_path / "ok")).count() == 36
    q = collect.close_hours(stream(), "1 hour").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    hours = {r.hour.hour: r.n_reports for r in spark.table("closed").collect()}
    assert all(n == 4 for n in hours.values()) and max(hours) < 9
    q = collect.running_histogram(stream(), "1 hour", complete=True).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r.hour, bytes(r.bucket), r.unnoised_metric) for r in collect.running_histogram(df, "1 hour", complete=True).collect()}
    assert {(r.hour, bytes(r.bucket), r.unnoised_metric) for r in spark.table("running").collect()} == batch


def test_streams_keep_reports_without_an_id(spark, tmp_path):
    hour = datetime(2024, 1, 1, tzinfo=UTC)
    spark.createDataFrame([(None, hour), (None, hour), ("x", hour), ("x", hour)], "report_id string, scheduled_report_time timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("report_id string, scheduled_report_time timestamp").parquet(str(tmp_path / "in"))
    collect.write_hourly(collect.batch_by_hour(collect.dedupe_stream(stream, "1 hour")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(str(r.report_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["None", "None", "x"]


def test_streams_of_one_ledger_have_names(spark, tmp_path):
    ledger, lacking = str(tmp_path / "ledger"), []
    a, other = frame(spark, [report(1, []), report(2, [])]), frame(spark, [report(3, [], origin="https://b.foo.com")])
    first = collect.consume_in_batch(ledger, [0], "first", lambda units, batch_id: lacking.append((batch_id, units.count())))
    first(a, 0)
    first(a, 0)  # the same micro-batch, after a restart
    assert budget.read_ledger(spark, ledger).count() == 1 and lacking == []
    second = collect.consume_in_batch(ledger, [0], "second", lambda units, batch_id: lacking.append((batch_id, units.count())))
    second(other, 0)
    assert budget.read_ledger(spark, ledger).count() == 2 and lacking == []
    second(a, 1)
    assert budget.read_ledger(spark, ledger).count() == 2 and lacking == [(1, 1)]
    with pytest.raises(AggregationError) as e:
        collect.consume_in_batch(ledger, [0], "third")(a, 0)
    assert e.value.code == "PRIVACY_BUDGET_EXHAUSTED"
    with pytest.raises(ValueError):
        collect.consume_in_batch(ledger, [0], "")


def test_debug_runs_may_check_budget_and_never_use_it(spark, tmp_path):
    ledger, domain = str(tmp_path / "ledger"), spark.createDataFrame([(b(1),)], "bucket binary")
    rows = frame(spark, [report(1, [(1, 5, 0)], debug="enabled")])
    code = lambda out: out.result_info.first().return_code
    debug = {"debug_run": True, "ledger": ledger, "budget": "ledger", "noise": "none"}
    assert code(jobs.run_aggregation(spark, job(**debug, check_budget_in_debug_run=True), rows, domain)) == "SUCCESS"
    assert budget.read_ledger(spark, ledger).count() == 0
    budget.consume_budget(budget.budget_units(rows, [0]), ledger, "real")
    out = jobs.run_aggregation(spark, job(**debug, check_budget_in_debug_run=True), rows, domain)
    assert code(out) == "DEBUG_SUCCESS_WITH_PRIVACY_BUDGET_EXHAUSTED" and out.result_info.first().return_message.endswith("due to privacy budget exhaustion") and summary(out.summary) == {1: 5}
    assert code(jobs.run_aggregation(spark, job(**debug), rows, domain)) == "SUCCESS" and budget.read_ledger(spark, ledger).count() == 1
    (tmp_path / "broken" / "commits").mkdir(parents=True)
    (tmp_path / "broken" / "units").mkdir()
    (tmp_path / "broken" / "commits" / "00000000000000000001.json").write_text("no json")
    broken = {"ledger": str(tmp_path / "broken"), "budget": "ledger", "noise": "none"}
    assert code(jobs.run_aggregation(spark, job(**broken), rows, domain)) == "PRIVACY_BUDGET_ERROR"
    assert code(jobs.run_aggregation(spark, job(**broken, debug_run=True, check_budget_in_debug_run=True), rows, domain)) == "DEBUG_SUCCESS_WITH_PRIVACY_BUDGET_ERROR"


def test_sites_need_their_suffixes(spark, tmp_path):
    rows, domain = frame(spark, [report(1, [(1, 5, 0)], origin="https://a.shop.example")]), spark.createDataFrame([(b(1),)], "bucket binary")
    given = {"attribution_report_to": None, "reporting_site": "https://shop.example", "noise": "none", "report_error_threshold_percentage": "100"}
    assert summary(jobs.run_aggregation(spark, job(**given), rows, domain).summary) == {1: 0}
    (tmp_path / "suffixes.txt").write_text("// comment\nexample\n*.ck\n")
    assert summary(jobs.run_aggregation(spark, job(**given, suffixes=str(tmp_path / "suffixes.txt")), rows, domain).summary) == {1: 5}


def test_key_fields_by_version(spark):
    try:
        budget.register_api("test-api", ["reporting_origin"], since=(0, 1), before=(1, 0))
        budget.register_api("test-api", ["attribution_destination"], since=(1, 0))
        with pytest.raises(ValueError):
            budget.register_api("test-api", ["reporting_origin"], since=(0, 5), before=(2, 0))
        info = "struct<version:string,api:string,reporting_origin:string,attribution_destination:string,source_registration_time:timestamp>"
        df = spark.createDataFrame([((v, "test-api", "o", "d", None),) for v in ("0.1", "1.0", "0.0")], f"shared_info {info}")
        keys = [r[0] for r in df.select(budget.budget_key(F.lit(0).cast("decimal(20,0)"))).collect()]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert keys == [sha("test-api-0.1-o"), sha("test-api-1.0-d-0"), None]
    finally:
        budget.APIS.pop("test-api", None)


def test_exact_noise_has_its_distribution():
    n, epsilon, l1 = 200_000, 2.0, 3
    draws = exact_noise.discrete_laplace(n, epsilon, l1)
    ratio = math.exp(-epsilon / l1)
    p = lambda x: (1 - ratio) / (1 + ratio) * ratio ** abs(x)
    for x in range(-8, 9):
        assert abs((draws == x).mean() - p(x)) < 5 * math.sqrt(p(x) / n)
    tail = 2 * sum(p(x) for x in range(12, 200))
    assert abs((abs(draws) >= 12).mean() - tail) < 5 * math.sqrt(tail / n)
    for x in range(4):  # the ratio that privacy rests on
        assert abs((draws == x + 1).sum() / (draws == x).sum() - ratio) < 0.03
    wide = exact_noise.discrete_laplace(50_000, 0.1, 65536)
    assert abs(wide.mean()) < 5 * wide.std() / math.sqrt(50_000) and abs(wide.std() / (math.sqrt(2) * 655360) - 1) < 0.05
    assert len(exact_noise.discrete_laplace(0, 1.0, 1)) == 0
    with pytest.raises(ValueError):
        exact_noise.discrete_laplace(1, 1e-9, 1)
