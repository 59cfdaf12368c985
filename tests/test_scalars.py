import math

import pytest
from pyspark.sql import functions as F

from tallyveil.functions import buckets, origins, shared_info
from tallyveil.operators import budget, errors, histogram, release
from tallyveil.sources import writers

KEYS = [  # golden keys
    ("protected-audience", "0.1", None, None, 0, "2ba6169867645673b16783915d6eb47bcfd8a056f27d50f09f7cdc56fec513b0"),
    ("shared-storage", "0.1", None, None, 0, "a5f0260eaa89fb0984127e70e396d0d744ac8509db2e92a22e9f5ba8d8360d6b"),
    ("attribution-reporting-debug", "0.1", "https://www.destination.com", "2021-01-01 00:00:00", 0, "56f9dee8fe909ddc293084429e614cc272b8a79090577a7d566aea140ff087a4"),
    ("attribution-reporting-debug", "1.0", "https://www.destination.com", "2021-01-01 00:00:00", 123, "768bf2420536f93b4cf25ea907711eff43e12e600aa9c7099a7d3aa095b4152f"),
]


@pytest.mark.parametrize("api,version,destination,time,fid,want", KEYS)
def test_budget_keys(spark, api, version, destination, time, fid, want):
    row = spark.createDataFrame([(api, version, "https://www.origin.com", destination, time, fid)], "api string, version string, reporting_origin string, attribution_destination string, source_registration_time string, fid long")
    row = row.withColumn("source_registration_time", F.to_timestamp("source_registration_time"))
    assert row.select(budget.budget_key(F.col("fid"), info="")).first()[0] == want


@pytest.mark.parametrize("l1,epsilon,want", [(1, 1, 12.512925464970229), (65536, 1, 820047.0832722889), (65536, 64, 77325.23567612951)])
def test_thresholds(l1, epsilon, want):
    assert release.PrivacyParams(epsilon, l1, 1e-5).threshold() == want


def test_threshold_needs_delta():
    for delta in (0, 1):
        with pytest.raises(ValueError):
            release.PrivacyParams(1, 1, delta).threshold()


def test_debug_epsilon():
    p = release.PrivacyParams()
    assert p.with_debug_epsilon(None) == p == p.with_debug_epsilon("much")
    assert p.with_debug_epsilon("0.5").epsilon == 0.5
    for bad in ("0", "-1", "64.1"):
        with pytest.raises(ValueError):
            p.with_debug_epsilon(bad)


@pytest.mark.parametrize("version,fid,want", [("0.0", 0, None), ("0.1", 0, 1), ("0.679999", 0, 1), ("0.999999", 0, 1), ("0.1", 5, 2), ("1.0", 0, 2), ("1.9999", 0, 2), ("abc", 3, None), ("", 0, None), ("0.0", 7, 2)])
def test_key_scheme(spark, version, fid, want):
    assert spark.range(1).select(budget.key_scheme(F.lit(version), F.lit(fid))).first()[0] == want


def test_buckets(spark):
    rows = [(bytes(),), (b"\0",), (b"\x80",), (b"\0\x80",), (b"\x01" + b"\0" * 15,), (b"\xff" * 16,), (b"\xff" * 17,), (None,)]
    df = spark.createDataFrame(rows, "b binary").select(buckets.norm_bucket("b").alias("n"))
    got = [r.n for r in df.collect()]
    assert [None if b is None else int.from_bytes(b, "big") for b in got] == [0, 0, 128, 128, 2**120, 2**128 - 1, None, None]
    stripped = df.select(buckets.strip_bucket("n").alias("s"), buckets.bucket_decimal("n").alias("d")).collect()
    assert bytes(stripped[0].s) == b"" and bytes(stripped[2].s) == b"\x80"
    assert stripped[5].d == str(2**128 - 1) and stripped[7].d is None


def test_integers(spark):
    df = spark.createDataFrame([(b"",), (b"\xff" * 4,), (b"\xff" * 8,), (b"\1" * 9,)], "b binary").select(buckets.u32("b").alias("a"), buckets.u64("b").alias("c"))
    assert [(r.a, None if r.c is None else int(r.c)) for r in df.collect()] == [(0, 0), (2**32 - 1, 2**32 - 1), (None, 2**64 - 1), (None, None)]


def test_driver_parsers():
    assert buckets.id_list(None) == [0] == buckets.id_list(" , ") and buckets.id_list(" 3,1,,3 ") == [1, 3]
    assert buckets.percentage("10%") == 10 == buckets.percentage("10")
    for bad in ("101", "-1", "x"):
        with pytest.raises(ValueError):
            buckets.percentage(bad)
    for bad in ("a", "-1", str(2**64)):
        with pytest.raises(ValueError):
            buckets.id_list(bad)


SITES = [
    ("https://dummyOrigin.foo.com", "https://foo.com"), ("https://dummyOrigin.foo.co.uk", "https://foo.co.uk"), ("https://foo.co.uk", "https://foo.co.uk"), ("http://about.foo.blogspot.com", "https://foo.blogspot.com"),
    ("http://about.foo.blogspot.com/", "https://foo.blogspot.com"), ("http://about.foo.blogspot.com:8443/bar", "https://foo.blogspot.com"), ("https://blogspot.com", None), ("https://dummyOrigin.coordinator.test", None),
    ("dummyOrigin.coordinator.test", None), ("some invalid URL", None), ("", None), (None, None),
]
DOMAINS = {"foo.com": True, "foo.co.uk": True, "foo.io": True, "www.foo.com": True, "http://www.foo.com": False, "foo.tldthatdoesntexist": False, "http://foo": False, "foo.com/api/bar": False, "123.456.789.012": False, "2002:0ab3:7a45:3fa3:d025:a8f5:0b6e:5080": False}


#: Wildcard and exception rules, other scripts, closing dots, and what is no host.
RULED = [
    ("https://a.b.kawasaki.jp", "https://a.b.kawasaki.jp"), ("https://x.a.b.kawasaki.jp", "https://a.b.kawasaki.jp"), ("https://b.kawasaki.jp", None), ("https://kawasaki.jp", "https://kawasaki.jp"),
    ("https://city.kawasaki.jp", "https://city.kawasaki.jp"), ("https://x.city.kawasaki.jp", "https://city.kawasaki.jp"), ("https://foo.bar.ck", "https://foo.bar.ck"), ("https://bar.ck", None), ("https://ck", None),
    ("https://www.ck", "https://www.ck"), ("https://a.www.ck", "https://www.ck"), ("https://x.bücher.公司.cn", "https://bücher.公司.cn"), ("https://公司.cn", None), ("https://xn--bcher-kva.xn--55qx5d.cn:443/", "https://xn--bcher-kva.xn--55qx5d.cn"),
    ("https://user@a.BÜCHER.com:8443/x?y", "https://bücher.com"), ("https://a。foo。com", "https://foo.com"), ("https://a.foo.com.", "https://foo.com"), ("https://[::1]/", None), ("https://a..com", None), ("https://é é.com", None), ("https://1.2.3.4", None),
]


def test_sites_by_wildcards_exceptions_and_other_scripts(spark):
    df = spark.createDataFrame(RULED, "reporting_origin string, want string").withColumn("origin_key", F.lit("the caller's"))
    out = origins.with_site(df, origins.suffix_table(spark)).collect()
    assert [(r.reporting_origin, r.site) for r in out if r.site != r.want] == [] and len(out) == len(RULED)
    assert {r.origin_key for r in out} == {"the caller's"}
    hosts = spark.createDataFrame([("www.ck", True), ("bar.ck", True), ("ck", False), ("a.公司.cn", True), ("foo.com.", True), ("-a.com", False)], "reporting_origin string, want boolean")
    flags = origins.with_domain_flag(hosts.withColumn("origin_good", F.lit(1)), origins.suffix_table(spark)).collect()
    assert all(r.is_domain == r.want and r.origin_good == 1 for r in flags) and len(flags) == 6


def test_sites(spark):
    df = spark.createDataFrame([(o, s) for o, s in SITES], "reporting_origin string, want string")
    assert all(r.site == r.want for r in origins.with_site(df, origins.suffix_table(spark)).collect())


def test_domains(spark):
    df = spark.createDataFrame(list(DOMAINS.items()), "reporting_origin string, want boolean")
    assert all(r.is_domain == r.want for r in origins.with_domain_flag(df, origins.suffix_table(spark)).collect())


def test_shared_info(spark):
    rows = [
        '{"version":"0.1","api":"shared-storage","scheduled_report_time":1609459200.5,"reporting_origin":"https://a.com","report_id":"x","more":1}',
        '{"version":"0.1","scheduled_report_time":"1609459200","reporting_origin":"https://a.com","source_registration_time":"-900"}',
        '{"version":"0.1","scheduled_report_time":"soon","reporting_origin":"https://a.com"}', '{"api":"x"}', "", "no json", None,
    ]
    out = shared_info.parse_shared_info(spark.createDataFrame([(r,) for r in rows], "shared_info string"))
    got = out.select("parse_errors", shared_info.iso_instant(F.col("shared_info.scheduled_report_time")).alias("t"), shared_info.iso_instant(F.col("shared_info.source_registration_time")).alias("s")).collect()
    assert [len(r.parse_errors) for r in got] == [0, 0, 1, 1, 1, 1, 1]
    assert got[0].t == "2021-01-01T00:00:00.500Z" and got[1].t == "2021-01-01T00:00:00Z" and got[1].s == "1969-12-31T23:45:00Z"


@pytest.mark.parametrize("text,ok", [("1-1-1-1-1", True), ("21abd97f-73e8-4b88-9389-a9fee6abda5e", True), ("", False), ("abc", False), (None, False)])
def test_uuid(spark, text, ok):
    assert spark.range(1).select(histogram.is_uuid(F.lit(text).cast("string"))).first()[0] is ok


def test_error_threshold():
    assert errors.over_threshold(6, 3, 10) and not errors.over_threshold(6, 3, 50)
    assert errors.over_threshold(10, 1, 0) and not errors.over_threshold(10, 0, 0)
    assert not errors.over_threshold(99, 1, 10, input_report_count=5) and errors.over_threshold(99, 2, 10, input_report_count=14)


def test_shards():
    assert writers.records_per_shard(355) == 1 and writers.records_per_shard() == 4_999_983
    assert writers.shard_count(5, 3) == 1 and writers.shard_count(100, 2) == 50 and writers.shard_count(0, 7) == 1
    assert writers.shard_names("out", 10)[0] == "out-01-of-10" and writers.debug_path("a/b/out") == "a/b/debug/out"
    for bad in (354, 5_000_000_000):
        with pytest.raises(ValueError):
            writers.records_per_shard(bad)


def test_noise_distribution(spark):
    params = release.PrivacyParams(epsilon=1.0, l1=20)
    p = math.exp(-params.epsilon / params.l1)
    want = 2 * p / (1 - p) ** 2
    for noise in ("prng", "secure"):
        df = release.add_noise(spark.range(120_000).select(F.lit(0).cast("bigint").alias("unnoised_metric")), params, noise, seed=5)
        mean, variance, positive, zero = df.agg(F.avg("metric"), F.var_pop("metric"), F.avg((F.col("metric") > 0).cast("int")), F.avg((F.col("metric") == 0).cast("int"))).first()
        assert abs(mean) < 6 * math.sqrt(want / 120_000) and abs(variance / want - 1) < 0.05
        assert abs(positive - (1 - zero) / 2) < 0.01
