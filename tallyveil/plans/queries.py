"""The library's operators as queries over the given tables, with the same results as SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AggregationError
from ..functions import buckets, origins, payload, shared_info
from ..functions.folders import new_folder
from ..operators import budget, errors, histogram, release, tools, validate
from ..operators.ledger import Ledger
from ..schemas import FACTS, UNIT
from ..sources.readers import read_debug, read_domain, read_summary
from ..sources.writers import damaged_shards, export_budget_units, records_per_shard, write_bucketed_domain, write_domain, write_reports, write_sharded, write_summary
from ..streaming import collect
from ..streaming.close import HourlyRelease
from .derived import domain, key_sql, reports, table, with_sql
from .job import AggregationJob, run_aggregation

QUERIES, ORACLES = {}, {}
IDS = [0, 1, 2]
PARAMS = release.PrivacyParams(epsilon=1.0, l1=100)
AS_OF = datetime(2024, 4, 10, tzinfo=UTC)  # reports up to 11 January are too old then


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _hour(column="reporting_window") -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH").alias("hour")


_HOUR_SQL = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour"


def _job(**more) -> AggregationJob:
    return AggregationJob(attribution_report_to="https://www.origin1.com", as_of=AS_OF, domain="-", noise="none", **more)


def _sums(spark: SparkSession, sf_dir: str, ids: list[int] = IDS) -> DataFrame:
    first = histogram.dedupe_reports(reports(spark, sf_dir), order=["event_id"])
    return histogram.histogram(histogram.explode_contributions(first, ids))


_SUMS_SQL = "SELECT bucket, sum(value)::BIGINT AS metric FROM first WHERE id IN (0, 1, 2) AND NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY bucket"


def _hex(df: DataFrame, *more: str, metric: str = "metric") -> DataFrame:
    return df.select(buckets.bucket_hex("bucket").alias("bucket"), F.col(metric).alias("metric"), *more)


@query("histogram_summary", with_sql(f"SELECT bucket, coalesce(metric, 0)::BIGINT AS metric FROM domain LEFT JOIN ({_SUMS_SQL}) USING (bucket)"))
def histogram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(release.add_noise(release.join_domain(_sums(spark, sf_dir), domain(spark, sf_dir)), PARAMS, "none"))


@query(
    "histogram_debug",
    with_sql(f"SELECT coalesce(d.bucket, s.bucket) AS bucket, coalesce(metric, 0)::BIGINT AS metric, concat_ws(',', CASE WHEN d.bucket IS NOT NULL THEN 'in_domain' END, CASE WHEN s.bucket IS NOT NULL THEN 'in_reports' END) AS annotations FROM domain d FULL JOIN ({_SUMS_SQL}) s ON d.bucket = s.bucket"),
)
def histogram_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = release.debug_report(_sums(spark, sf_dir), domain(spark, sf_dir)).withColumn("annotations", F.concat_ws(",", "annotations"))
    return _hex(out, "annotations", metric="unnoised_metric")


@query("report_only_keys", with_sql(f"SELECT bucket, metric FROM ({_SUMS_SQL}) ANTI JOIN domain USING (bucket)"))
def report_only_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(release.report_only(_sums(spark, sf_dir), domain(spark, sf_dir)), metric="unnoised_metric")


@query("key_membership", with_sql(f"SELECT bucket, metric FROM ({_SUMS_SQL}) SEMI JOIN domain USING (bucket)"))
def key_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(release.keys_in(_sums(spark, sf_dir), domain(spark, sf_dir)), metric="unnoised_metric")


@query("dedupe_reports", with_sql("SELECT report_id, event_id FROM first"))
def dedupe_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.dedupe_reports(reports(spark, sf_dir), order=["event_id"]).select("report_id", "event_id")


@query("explode_contributions", with_sql("SELECT event_id, bucket, value, id FROM reports WHERE NOT (bucket = repeat('0', 32) AND value = 0)"))
def explode_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram.explode_contributions(reports(spark, sf_dir), keep=["event_id"])
    return out.select("event_id", buckets.bucket_hex("bucket").alias("bucket"), "value", F.col("id").cast("bigint").alias("id"))


@query("filter_ids", with_sql("SELECT id, count(*) AS n, sum(value)::BIGINT AS total FROM reports WHERE id IN (1, 3) GROUP BY id"))
def filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histogram.explode_contributions(reports(spark, sf_dir))
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    return histogram.filter_ids(rows, ids).groupBy(F.col("id").cast("bigint").alias("id")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("null_facts", "SELECT event_id, bucket, value FROM (SELECT event_id, lpad(hex(user_id % 3), 32, '0') AS bucket, floor(value)::BIGINT % 2 AS value FROM events) WHERE NOT (bucket = repeat('0', 32) AND value = 0)")
def null_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.unhex(F.lpad(F.hex(F.col("user_id") % 3), 32, "0")).alias("bucket"), (F.floor("value") % 2).cast("bigint").alias("value"))
    return histogram.drop_null_facts(rows).select("event_id", buckets.bucket_hex("bucket").alias("bucket"), "value")


@query(
    "lineitem_histogram",
    """SELECT lpad(hex(l_partkey), 32, '0') AS bucket, sum(l_quantity)::BIGINT AS metric
    FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1) GROUP BY 1""",
)
def lineitem_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("report_id", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    first = histogram.dedupe_reports(rows, order=["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    facts = first.select(F.unhex(F.lpad(F.hex("l_partkey"), 32, "0")).alias("bucket"), F.col("l_quantity").cast("bigint").alias("value"))
    return _hex(histogram.histogram(facts), metric="unnoised_metric")


_UNITS_SQL = f"SELECT DISTINCT {key_sql()} AS privacy_budget_key, {_HOUR_SQL}, origin AS reporting_origin FROM first, (VALUES (0), (1)) f(fid) WHERE api <> 'unknown-api'"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.dedupe_reports(reports(spark, sf_dir), order=["event_id"]).filter(F.col("shared_info.api") != "unknown-api")


@query("budget_units", with_sql(_UNITS_SQL))
def budget_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.budget_units(_known(spark, sf_dir), [0, 1]).select("privacy_budget_key", _hour(), "reporting_origin")


@query("budget_key_v1", with_sql(f"SELECT event_id, {key_sql(fid='0')} AS privacy_budget_key FROM reports WHERE version = '0.1'"))
def budget_key_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).filter("shared_info.version = '0.1'").select("event_id", budget.budget_key(F.lit(0).cast("decimal(20,0)")).alias("privacy_budget_key"))


@query("budget_key_v2", with_sql(f"SELECT event_id, {key_sql(fid='id')} AS privacy_budget_key FROM reports WHERE version = '1.0' OR id <> 0"))
def budget_key_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = F.get("data", 0)["id"]
    return reports(spark, sf_dir).filter((F.col("shared_info.version") == "1.0") | (fact != 0)).select("event_id", budget.budget_key(fact).alias("privacy_budget_key"))


_LEDGER_SQL = f"SELECT DISTINCT {key_sql(fid='0')} AS privacy_budget_key, {_HOUR_SQL}, origin AS reporting_origin FROM first WHERE api <> 'unknown-api' AND event_id % 4 = 0"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget that a quarter of the reports has used before."""
    return budget.budget_units(_known(spark, sf_dir).filter("event_id % 4 = 0"), [0]).withColumn("used", F.lit(1))


@query("budget_exhausted", with_sql(f"SELECT * FROM ({_UNITS_SQL}) INTERSECT SELECT * FROM ({_LEDGER_SQL})"))
def budget_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.lacking_budget(budget.budget_units(_known(spark, sf_dir), [0, 1]), _ledger(spark, sf_dir)).select("privacy_budget_key", _hour(), "reporting_origin")


@query("first_exhausted", with_sql(f"SELECT * FROM (SELECT * FROM ({_UNITS_SQL}) INTERSECT SELECT * FROM ({_LEDGER_SQL})) ORDER BY ALL LIMIT 10"))
def first_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.lacking_budget(budget.budget_units(_known(spark, sf_dir), [0, 1]), _ledger(spark, sf_dir), limit=10).select("privacy_budget_key", _hour(), "reporting_origin")


@query(
    "exhausted_inputs",
    with_sql(f"""SELECT DISTINCT api, version, origin AS reporting_origin, CASE WHEN api LIKE 'attribution%' THEN destination ELSE '' END AS attribution_destination,
        strftime(arg_min(ts, report_id), '%Y-%m-%d %H:%M:%S.%f') AS scheduled_report_time, fid AS filtering_id
    FROM (SELECT *, {key_sql()} AS privacy_budget_key, {_HOUR_SQL} FROM first, (VALUES (0), (1)) f(fid) WHERE api <> 'unknown-api') SEMI JOIN ({_LEDGER_SQL}) USING (privacy_budget_key, hour)
    GROUP BY privacy_budget_key, hour, api, version, origin, 4, fid"""),
)
def exhausted_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir).withColumn("shared_info", F.when(F.col("shared_info.api").startswith("attribution"), F.col("shared_info")).otherwise(F.col("shared_info").withField("attribution_destination", F.lit(""))))
    units = budget.lacking_budget(budget.budget_units(known, [0, 1]), _ledger(spark, sf_dir))
    out = budget.exhausted_info(units, budget.unit_inputs(known, [0, 1]))
    return out.select("api", "version", "reporting_origin", "attribution_destination", F.date_format("scheduled_report_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("scheduled_report_time"), F.col("filtering_id").cast("bigint").alias("filtering_id"))


@query("units_by_origin", with_sql(f"SELECT reporting_origin, count(*) AS n_units, min(privacy_budget_key || hour) AS first_unit FROM ({_UNITS_SQL}) GROUP BY reporting_origin"))
def units_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = budget.units_by_origin(budget.budget_units(_known(spark, sf_dir), [0, 1]))
    first = F.col("first_unit")
    return out.select("reporting_origin", "n_units", F.concat(first["privacy_budget_key"], F.date_format(first["reporting_window"], "yyyy-MM-dd HH")).alias("first_unit"))


@query("extracted_units", with_sql(f"SELECT DISTINCT {key_sql(fid='0')} AS privacy_budget_key, {_HOUR_SQL}, origin AS reporting_origin FROM reports WHERE {key_sql(fid='0')} IS NOT NULL", edges=True))
def extracted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.extract_budget_units(reports(spark, sf_dir, edges=True), [0])[0].select("privacy_budget_key", _hour(), "reporting_origin")


_CHECKS_SQL = """
    SELECT event_id, concat_ws(',',
        CASE WHEN ts <= TIMESTAMP '2024-01-11' THEN 'ORIGINAL_REPORT_TIME_TOO_OLD' END, CASE WHEN NOT debug THEN 'DEBUG_NOT_ENABLED' END,
        CASE WHEN api = 'unknown-api' THEN 'UNSUPPORTED_REPORT_API_TYPE' END,
        CASE WHEN api = 'unknown-api' OR version IN ('0.0', 'abc') THEN 'REQUIRED_SHAREDINFO_FIELD_INVALID' END,
        CASE WHEN report_id IS NULL OR report_id IN ('', 'not-a-uuid') THEN 'INVALID_REPORT_ID' END,
        CASE WHEN version IN ('0.0', 'abc') THEN 'UNSUPPORTED_SHAREDINFO_VERSION' END) AS errors
    FROM reports
"""
_NAMES = ["age", "operation", "debug", "api", "key_fields", "report_id", "version"]


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(reports(spark, sf_dir, edges=True), _job(debug_run=True), _NAMES)


@query("validation_flags", with_sql(_CHECKS_SQL, edges=True))
def validation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("event_id", F.concat_ws(",", "errors").alias("errors"))


@query("valid_reports", with_sql(f"SELECT count(*) AS n_valid FROM ({_CHECKS_SQL}) WHERE errors = ''", edges=True))
def valid_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.split_valid(_checked(spark, sf_dir))[0].agg(F.count("*").alias("n_valid"))


@query("error_summary", with_sql(f"SELECT category, count(*) AS n FROM (SELECT unnest(string_split(errors || ',NUM_REPORTS_WITH_ERRORS', ',')) AS category FROM ({_CHECKS_SQL}) WHERE errors <> '') GROUP BY category", edges=True))
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_summary(_checked(spark, sf_dir)).select("category", F.col("count").alias("n"))


@query("error_threshold", with_sql(f"SELECT pct, count(*) AS total, count(*) FILTER (errors <> '') AS bad, count(*) FILTER (errors <> '') > count(*) * pct / 100 AS is_over FROM ({_CHECKS_SQL}), (VALUES (10), (99)) p(pct) GROUP BY pct", edges=True))
def error_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, bad, _ = errors.counts(_checked(spark, sf_dir))
    return spark.createDataFrame([(p, total, bad, errors.over_threshold(total, bad, p)) for p in (10, 99)], "pct int, total long, bad long, is_over boolean")


@query("own_validator", with_sql("SELECT event_id, concat_ws(',', CASE WHEN api = 'unknown-api' THEN 'UNSUPPORTED_REPORT_API_TYPE' END, CASE WHEN value > 10000 THEN 'VALUE_TOO_LARGE' END) AS errors FROM reports WHERE api = 'unknown-api' OR value > 10000"))
def own_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validator of the caller's beside one of the library's."""
    validate.register_validator("value", lambda job: F.when(F.exists("data", lambda f: f["value"] > 10_000), "VALUE_TOO_LARGE"))
    try:
        checked = validate.validate(reports(spark, sf_dir), _job(), ["api", "value"])
    finally:
        del validate.VALIDATORS["value"]
    return validate.split_valid(checked)[1].select("event_id", F.concat_ws(",", "errors").alias("errors"))


@query("own_key_fields", with_sql("SELECT sha256('unknown-api-' || version || '-' || destination || CASE version WHEN '1.0' THEN '-' || origin || '-7' ELSE '-7' END) AS privacy_budget_key, count(*) AS n FROM reports WHERE api = 'unknown-api' GROUP BY 1"))
def own_key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget keys of an api that the caller registers, with other fields from version 1.0 on."""
    budget.register_api("unknown-api", ["attribution_destination"], before=(1, 0))
    budget.register_api("unknown-api", ["attribution_destination", "reporting_origin"], since=(1, 0))
    try:
        units = budget.unit_rows(reports(spark, sf_dir).filter("shared_info.api = 'unknown-api'"), [7])
    finally:
        del budget.APIS["unknown-api"]
    return units.groupBy("privacy_budget_key").agg(F.count("*").alias("n"))


@query("origin_sites", "SELECT DISTINCT 'https://a' || user_id || '.b' || (user_id % 5) || '.co.uk:8443/x' AS origin, 'https://b' || (user_id % 5) || '.co.uk' AS site FROM events UNION ALL SELECT DISTINCT 'https://site' || (user_id % 9) || '.unknown', NULL FROM events")
def origin_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    good = e.select(F.concat(F.lit("https://a"), "user_id", F.lit(".b"), F.col("user_id") % 5, F.lit(".co.uk:8443/x")).alias("origin")).distinct()
    bad = e.select(F.concat(F.lit("https://site"), F.col("user_id") % 9, F.lit(".unknown")).alias("origin")).distinct()
    return origins.with_site(good.unionByName(bad), origins.suffix_table(spark), "origin").select("origin", "site")


# Rules of all three kinds; those of other scripts are given to SQL in both their forms.
_RULES = {"plain": ["com", "jp", "co.jp", "uk", "co.uk", "cn", "公司.cn"], "wildcard": ["ck", "kawasaki.jp"], "exception": ["www.ck", "city.kawasaki.jp"]}
_RULES_SQL = ", ".join(f"('{r}', '{kind}')" for kind, rules in _RULES.items() for r in rules) + ", ('xn--55qx5d.cn', 'plain')"
_TAILS = ["a.b.kawasaki.jp", "b.kawasaki.jp", "kawasaki.jp", "x.city.kawasaki.jp", "city.kawasaki.jp", "foo.bar.ck", "bar.ck", "www.ck", "a.www.ck", "a.co.uk", "co.uk", "a.b.com", "a.unknown", "bücher.公司.cn", "xn--bcher-kva.xn--55qx5d.cn"]
_HOSTS_SQL = f"""SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN '' ELSE 'u' || (user_id % 50) || '.' END || tail AS host
    FROM events JOIN (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_TAILS))}) t(i, tail) ON event_id % {len(_TAILS)} = i"""
_SUFFIX_SQL = f"""WITH hosts AS ({_HOSTS_SQL}), rules(rule, kind) AS (VALUES {_RULES_SQL}),
    found AS (SELECT host, kind = 'exception' AS wins, len(string_split(rule, '.')) + CASE kind WHEN 'wildcard' THEN 1 WHEN 'exception' THEN -1 ELSE 0 END AS n
        FROM hosts JOIN rules ON ends_with(host, '.' || rule) OR (host = rule AND kind <> 'wildcard')),
    best AS (SELECT host, (arg_max(n, (wins::INT, n))) AS n FROM found GROUP BY host)"""


def _suffix_hosts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hosts that ask for every kind of rule, and the rules, read from a file."""
    path = new_folder(spark, "rules")
    marks = {"plain": "", "wildcard": "*.", "exception": "!"}
    lines = [f"{marks[kind]}{r}" for kind, rules in _RULES.items() for r in rules]
    spark.createDataFrame([(x,) for x in ["// rules", *lines, "", "  // more"]], "value string").coalesce(1).write.text(path)
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("event_id") % len(_TAILS) + 1).cast("int"))
    host = F.concat(F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id") % 50, F.lit("."))), tail)
    return table(spark, sf_dir, "events").select(host.alias("host")).distinct(), origins.public_suffixes(spark, path)


@query("suffix_rules", f"{_SUFFIX_SQL} SELECT 'https://' || host || ':8443/x' AS origin, CASE WHEN len(string_split(host, '.')) > n THEN 'https://' || array_to_string(string_split(host, '.')[-n - 1:], '.') END AS site FROM hosts LEFT JOIN best USING (host)")
def suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by plain, wildcard and exception rules, of hosts in Latin and in other letters."""
    hosts, rules = _suffix_hosts(spark, sf_dir)
    return origins.with_site(hosts.select(F.concat(F.lit("https://"), "host", F.lit(":8443/x")).alias("origin")), rules, "origin").select("origin", "site")


@query("bare_domains", f"{_SUFFIX_SQL} SELECT host, n IS NOT NULL AS is_domain FROM hosts LEFT JOIN best USING (host) UNION ALL SELECT 'https://' || host, false FROM hosts")
def bare_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are bare domain names that end in a public suffix."""
    hosts, rules = _suffix_hosts(spark, sf_dir)
    return origins.with_domain_flag(hosts.unionByName(hosts.select(F.concat(F.lit("https://"), "host").alias("host"))), rules, "host")


_NOISELESS_THRESHOLD = PARAMS.threshold()


@query("threshold_filter", with_sql(f"SELECT bucket, metric FROM ({_SUMS_SQL}) WHERE metric >= {_NOISELESS_THRESHOLD!r} - 1e-4"))
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(release.optional_domain(_sums(spark, sf_dir), None, PARAMS, "none"))


@query("optional_domain", with_sql(f"SELECT bucket, coalesce(metric, 0)::BIGINT AS metric FROM domain LEFT JOIN ({_SUMS_SQL}) USING (bucket) UNION ALL SELECT bucket, metric FROM ({_SUMS_SQL}) ANTI JOIN domain USING (bucket) WHERE metric >= {_NOISELESS_THRESHOLD!r} - 1e-4"))
def optional_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hex(release.optional_domain(_sums(spark, sf_dir), domain(spark, sf_dir), PARAMS, "none"))


@query(
    "result_diff",
    with_sql("""SELECT coalesce(a.bucket, b.bucket) AS bucket, l, r, CASE WHEN r IS NULL THEN 'only_left' WHEN l IS NULL THEN 'only_right' ELSE 'differs' END AS status
    FROM (SELECT bucket, sum(value)::BIGINT AS l FROM first WHERE id = 0 AND NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY bucket) a
    FULL JOIN (SELECT bucket, sum(value)::BIGINT AS r FROM reports WHERE id IN (0, 1) AND NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY bucket) b ON a.bucket = b.bucket WHERE l IS DISTINCT FROM r"""),
)
def result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = histogram.histogram(histogram.explode_contributions(reports(spark, sf_dir), [0, 1]))
    out = tools.diff_results(_sums(spark, sf_dir, [0]), right, "unnoised_metric")
    return out.select(buckets.bucket_hex("bucket").alias("bucket"), F.col("left").alias("l"), F.col("right").alias("r"), "status")


@query("delay_profile", with_sql("SELECT q::DOUBLE AS quantile, delay_hours::DOUBLE AS delay_hours FROM (SELECT unnest([0.9, 0.95, 0.99]) AS q, unnest(quantile_cont(date_diff('microsecond', ts, received) / 3.6e9, [0.9, 0.95, 0.99])) AS delay_hours FROM reports)"))
def delay_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).select("received", F.col("shared_info.scheduled_report_time").alias("scheduled"))
    return tools.delay_profile(rows, "received", "scheduled", exact=True)


@query(
    "delay_by_destination",
    with_sql("SELECT api, destination, unnest([0.5, 0.9, 0.99])::DOUBLE AS quantile, unnest(quantile_cont(date_diff('microsecond', ts, received) / 3.6e9, [0.5, 0.9, 0.99]))::DOUBLE AS delay_hours FROM reports GROUP BY api, destination"),
)
def delay_by_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the delay by api and destination."""
    rows = reports(spark, sf_dir).select("received", "shared_info.api", F.col("shared_info.scheduled_report_time").alias("scheduled"), F.col("shared_info.attribution_destination").alias("destination"))
    return tools.delay_profile(rows, "received", "scheduled", (0.5, 0.9, 0.99), exact=True, by=("api", "destination"))


@query("price_quantiles", "SELECT l_returnflag, unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS quantile, unnest(quantile_cont(l_extendedprice::DOUBLE, [0.0, 0.25, 0.5, 0.75, 1.0]))::DOUBLE AS price FROM lineitem GROUP BY l_returnflag")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of a column of mostly distinct values."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return tools.exact_quantiles(rows, "price", (0.0, 0.25, 0.5, 0.75, 1.0), ("l_returnflag",))


@query("batch_conflicts", with_sql(f"SELECT {key_sql(fid='0')} AS privacy_budget_key, {_HOUR_SQL}, origin AS reporting_origin, count(DISTINCT event_id % 3) AS n_batches FROM reports WHERE api <> 'unknown-api' GROUP BY ALL HAVING n_batches > 1"))
def batch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).filter("shared_info.api != 'unknown-api'").withColumn("batch", F.col("event_id") % 3)
    return tools.batch_conflicts(rows, [0]).select("privacy_budget_key", _hour(), "reporting_origin", "n_batches")


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("event_id", "report_id", "received", "data", F.col("shared_info.scheduled_report_time").alias("scheduled_report_time"), F.col("shared_info.attribution_destination").alias("destination"))


@query("hourly_batches", with_sql("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') || '|' || destination AS batch_key, count(*) AS n FROM reports GROUP BY 1"))
def hourly_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.batch_by_hour(_flat(spark, sf_dir), by=["destination"]).groupBy("batch_key").agg(F.count("*").alias("n"))


_BY_HOUR_SQL = "strftime(date_trunc('hour', ts), '%Y-%m-%dT%H')"


@query("destination_batches", with_sql(f"SELECT api, {_BY_HOUR_SQL} || CASE WHEN api LIKE 'attribution%' THEN '|' || destination ELSE '' END AS batch_key, count(*) AS n FROM reports GROUP BY ALL"))
def destination_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution reports by hour and destination, reports of other apis by hour alone."""
    rows = reports(spark, sf_dir).select("shared_info.*").withColumnRenamed("attribution_destination", "destination")
    batched, others = collect.batch_by_destination(rows)
    return batched.unionByName(others).groupBy("api", "batch_key").agg(F.count("*").alias("n"))


@query("late_reports", with_sql(f"SELECT {_HOUR_SQL}, count(*) AS n_late FROM reports SEMI JOIN (SELECT DISTINCT date_trunc('hour', ts) AS h FROM reports WHERE event_id % 50 = 0) c ON date_trunc('hour', ts) = h GROUP BY 1"))
def late_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flat(spark, sf_dir)
    closed = rows.filter("event_id % 50 = 0").select(F.date_trunc("HOUR", "scheduled_report_time").alias("hour"))
    late = collect.split_late(rows, closed)[1]
    return late.groupBy(_hour("scheduled_report_time")).agg(F.count("*").alias("n_late"))


@query("running_histogram", with_sql(f"SELECT {_HOUR_SQL}, bucket, sum(value)::BIGINT AS metric FROM reports WHERE NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY 1, 2"))
def running_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histogram.explode_contributions(_flat(spark, sf_dir), keep=["scheduled_report_time"])
    out = collect.running_histogram(rows, "0 hours", complete=True)
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), buckets.bucket_hex("bucket").alias("bucket"), F.col("unnoised_metric").alias("metric"))


@query("version_parse", "SELECT event_id, CASE WHEN regexp_full_match(v, '\\d+\\.\\d+') THEN split_part(v, '.', 1)::INT END AS major, CASE WHEN regexp_full_match(v, '\\d+\\.\\d+') THEN split_part(v, '.', 2)::INT END AS minor FROM (SELECT event_id, (event_id % 3) || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '.' END || (user_id % 100) AS v FROM events)")
def version_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("event_id") % 3, F.when(F.col("event_id") % 7 == 0, "x").otherwise("."), F.col("user_id") % 100)
    v = shared_info.version_struct(text)
    return table(spark, sf_dir, "events").select("event_id", v["major"].alias("major"), v["minor"].alias("minor"))


@query("bucket_normalise", "SELECT event_id, lpad(hex(user_id), 32, '0') AS full_bucket, CASE WHEN user_id = 0 THEN '' WHEN length(hex(user_id)) % 2 = 1 THEN '0' || hex(user_id) ELSE hex(user_id) END AS stripped FROM events")
def bucket_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.lpad(F.hex("user_id"), 8, "0"))
    return table(spark, sf_dir, "events").select("event_id", F.hex(buckets.norm_bucket(raw)).alias("full_bucket"), F.hex(buckets.strip_bucket(buckets.norm_bucket(raw))).alias("stripped"))


@query("text_keys", "SELECT event_id, upper(hex(encode(event_type || (user_id % 10)))) AS from_text, upper(hex(encode(user_id::VARCHAR))) AS from_int, user_id AS number FROM events")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = buckets.u64(F.unhex(F.lpad(F.hex("user_id"), 16, "0"))).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.hex(buckets.bucket_from_string(F.concat("event_type", F.col("user_id") % 10))).alias("from_text"), F.hex(buckets.bucket_from_int("user_id")).alias("from_int"), number.alias("number"))


@query("iso_instants", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || strftime(ts, '%g') ELSE '.' || strftime(ts, '%f') END || 'Z' AS t FROM events")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", shared_info.iso_instant(F.col("ts").cast("timestamp")).alias("t"))


@query("parsed_reports", with_sql("SELECT event_id, api, version, origin AS reporting_origin, epoch_us(ts) AS micros, bucket, value, id FROM reports"))
def parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as raw rows (CBOR payload, JSON metadata) and parsed again."""
    raw = payload.encode_payload(reports(spark, sf_dir).select("event_id", "operation", "data", shared_info.shared_info_json().alias("shared_info")))
    back = payload.decode_payload(shared_info.parse_shared_info(raw))
    f = F.get("data", 0)
    return back.select("event_id", "shared_info.api", "shared_info.version", "shared_info.reporting_origin", F.unix_micros("shared_info.scheduled_report_time").alias("micros"), F.hex(f["bucket"]).alias("bucket"), f["value"].alias("value"), f["id"].cast("bigint").alias("id"))


@query("union_results", with_sql(f"SELECT bucket, metric FROM ({_SUMS_SQL}) SEMI JOIN domain USING (bucket) UNION ALL SELECT bucket, metric FROM ({_SUMS_SQL}) ANTI JOIN domain USING (bucket)"))
def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums, keys = _sums(spark, sf_dir), domain(spark, sf_dir)
    return _hex(release.union_results(release.keys_in(sums, keys), release.report_only(sums, keys), PARAMS, PARAMS), metric="unnoised_metric")


_N_SHARDS = f"greatest(count(*) // {records_per_shard(20_335)}, 1)::BIGINT"


@query("sharded_files", f"SELECT count(*) AS n_rows, sum(l_partkey)::BIGINT AS total, {_N_SHARDS} AS n_shards, 'parts-' || lpad('1', length({_N_SHARDS}::VARCHAR)::INT, '0') || '-of-' || {_N_SHARDS} || '.parquet' AS first_name FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def sharded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written in shards and read back: rows, shards and their names."""
    path = f"{new_folder(spark, 'shards')}/parts"
    rows = table(spark, sf_dir, "lineitem").select(F.unhex(F.lpad(F.hex("l_partkey"), 32, "0")).alias("bucket"), F.col("l_partkey").cast("bigint").alias("metric")).distinct()
    write_sharded(rows, path, 20_335)
    back = read_summary(spark, path).select("metric", F.col("_metadata.file_name").alias("name"))
    return back.agg(F.count("*").alias("n_rows"), F.sum("metric").alias("total"), F.count_distinct("name").alias("n_shards"), F.min("name").alias("first_name"))


@query("published_union", with_sql("SELECT count(*) AS n_rows, (count(*) * 2)::BIGINT AS n_union, true AS unlike_refused, 0::BIGINT AS n_damaged FROM domain"))
def published_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results published in shards and read again: those of equal noise are joined, unlike ones refused by what they say
    of themselves; all shards are those of their manifests."""
    path = new_folder(spark, "published")
    sums = release.join_domain(_sums(spark, sf_dir), domain(spark, sf_dir))
    for name, params in (("a", PARAMS), ("b", PARAMS), ("c", replace(PARAMS, epsilon=2.0))):
        write_sharded(release.released(release.add_noise(sums, params)), f"{path}/{name}", 20_335)
    a, b, c = (read_summary(spark, f"{path}/{name}") for name in "abc")
    try:
        release.union_results(a, c)
        refused = False
    except ValueError:
        refused = True
    damaged = sum(len(damaged_shards(spark, f"{path}/{name}")) for name in "abc")
    counts = a.agg(F.count("*").alias("n_rows")).crossJoin(release.union_results(a, b).agg(F.count("*").alias("n_union")))  # a row each
    return counts.select("*", F.lit(refused).alias("unlike_refused"), F.lit(damaged).cast("long").alias("n_damaged"))


@query("noised_summary")
def noised_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real release: noise is drawn once and written before it is used."""
    noised = release.add_noise(release.join_domain(_sums(spark, sf_dir), domain(spark, sf_dir)), PARAMS, "secure")
    return _hex(release.released(noised))


@query("streamed_batches", with_sql("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n_reports FROM first GROUP BY 1"))
def streamed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports deduplicated as a stream that reads what there is, then counted by hour."""
    path = new_folder(spark, "stream")
    _flat(spark, sf_dir).select("report_id", "scheduled_report_time").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("report_id string, scheduled_report_time timestamp").parquet(f"{path}/in")
    once = collect.batch_by_hour(collect.dedupe_stream(stream, "40 days"))
    collect.write_hourly(once, f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.schema("report_id string, scheduled_report_time timestamp").parquet(f"{path}/out")
    return out.groupBy(_hour("scheduled_report_time")).agg(F.count("*").alias("n_reports"))


@query(
    "aggregation_job",
    with_sql("""SELECT bucket, coalesce(metric, 0)::BIGINT AS metric FROM domain LEFT JOIN (
        SELECT bucket, sum(value)::BIGINT AS metric FROM reports WHERE origin = 'https://www.origin1.com' AND api <> 'unknown-api' AND ts > TIMESTAMP '2024-01-11' AND id IN (0, 1)
        AND NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY bucket) USING (bucket)"""),
)
def aggregation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole job from raw files to a released summary; ids are made unique, as SQL has no order for repeats."""
    path = new_folder(spark, "job")
    run_aggregation(spark, _written_job(spark, sf_dir, path))
    return _hex(read_summary(spark, f"{path}/out").withColumn("bucket", buckets.norm_bucket("bucket")))


def _written_job(spark: SparkSession, sf_dir: str, path: str, **more) -> AggregationJob:
    """A job over raw reports and a domain that it writes first; ids are made unique, as SQL has no order for repeats."""
    n = F.md5(F.concat(F.lit("u"), "event_id").cast("binary"))
    uid = F.concat_ws("-", *(F.substring(n, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    rows = reports(spark, sf_dir, dealt=True).withColumn("shared_info", F.col("shared_info").withField("report_id", uid))
    raw = payload.encode_payload(rows.select("operation", "data", shared_info.shared_info_json().alias("shared_info"), F.lit("key").alias("key_id")))
    write_reports(raw, f"{path}/reports")
    write_domain(domain(spark, sf_dir), f"{path}/domain")
    given = {"reports": f"{path}/reports", "domain": f"{path}/domain", "ledger": f"{path}/ledger", "output": f"{path}/out", "report_error_threshold_percentage": "100", "filtering_ids_text": "0,1", "as_of": AS_OF, "noise": "none"}
    origin = {} if "reporting_site" in more else {"attribution_report_to": "https://www.origin1.com"}
    return AggregationJob(**(given | origin | more))


@query("bucketed_domain_job", ORACLES["aggregation_job"])
def bucketed_domain_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose domain was laid out by key once: its keys are joined as they lie."""
    path = new_folder(spark, "bucketed")
    job = _written_job(spark, sf_dir, path, domain=f"{path}/keys", domain_format="bucketed")
    write_bucketed_domain(read_domain(spark, f"{path}/domain"), f"{path}/keys", 16)
    run_aggregation(spark, job)
    return _hex(read_summary(spark, f"{path}/out").withColumn("bucket", buckets.norm_bucket("bucket")))


_JOB_SQL = "FROM reports WHERE {origin} AND api <> 'unknown-api' AND ts > TIMESTAMP '2024-01-11' AND id IN (0, 1) AND NOT (bucket = repeat('0', 32) AND value = 0)"


@query("site_job", with_sql(f"SELECT bucket, coalesce(metric, 0)::BIGINT AS metric FROM domain LEFT JOIN (SELECT bucket, sum(value)::BIGINT AS metric {_JOB_SQL.format(origin="origin = 'https://www.origin2.com'")} GROUP BY bucket) USING (bucket)"))
def site_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job by reporting site, with the public suffixes read from a file."""
    path = new_folder(spark, "site")
    spark.createDataFrame([("// a comment",), ("com",), ("*.ck",), ("",)], "value string").coalesce(1).write.text(f"{path}/suffixes")
    run_aggregation(spark, _written_job(spark, sf_dir, path, reporting_site="https://origin2.com", suffixes=f"{path}/suffixes"))
    return _hex(read_summary(spark, f"{path}/out").withColumn("bucket", buckets.norm_bucket("bucket")))


@query(
    "debug_job",
    with_sql(f"""SELECT coalesce(d.bucket, s.bucket) AS bucket, coalesce(metric, 0)::BIGINT AS metric, concat_ws(',', CASE WHEN d.bucket IS NOT NULL THEN 'in_domain' END, CASE WHEN s.bucket IS NOT NULL THEN 'in_reports' END) AS annotations,
        d.bucket IS NOT NULL OR metric >= {_NOISELESS_THRESHOLD!r} - 1e-4 AS in_summary
    FROM domain d FULL JOIN (SELECT bucket, sum(value)::BIGINT AS metric {_JOB_SQL.format(origin="origin = 'https://www.origin1.com' AND debug")} GROUP BY bucket) s ON d.bucket = s.bucket"""),
)
def debug_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A debug run with an optional domain: the debug report, and which of its buckets the summary has."""
    path = new_folder(spark, "debug")
    run_aggregation(spark, _written_job(spark, sf_dir, path, debug_run=True, domain_optional=True, params=PARAMS))
    full = lambda df: df.withColumn("bucket", buckets.norm_bucket("bucket"))
    shown = full(read_summary(spark, f"{path}/out")).select("bucket", F.lit(True).alias("in_summary"))
    out = full(read_debug(spark, f"{path}/debug/out")).join(shown, "bucket", "left")
    return _hex(out.withColumns({"annotations": F.concat_ws(",", "annotations"), "in_summary": F.coalesce("in_summary", F.lit(False))}), "annotations", "in_summary")


@query(
    "exhausted_job",
    with_sql(f"""SELECT DISTINCT api, version, origin AS reporting_origin, destination AS attribution_destination, fid AS filtering_id, {_HOUR_SQL}
    FROM (SELECT *, row_number() OVER (PARTITION BY privacy_budget_key, date_trunc('hour', ts) ORDER BY uid) AS k FROM (
        SELECT *, {key_sql()} AS privacy_budget_key, md5('u' || event_id) AS uid FROM reports, (VALUES (0), (1)) f(fid) WHERE origin = 'https://www.origin1.com' AND api <> 'unknown-api' AND ts > TIMESTAMP '2024-01-11')) WHERE k = 1"""),
)
def exhausted_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose budget another batch has used up: it fails and writes the inputs behind the exhausted units."""
    path = new_folder(spark, "exhausted")
    job = _written_job(spark, sf_dir, path, batch="first")
    run_aggregation(spark, job)
    again = run_aggregation(spark, replace(job, batch="second", output=f"{path}/again"))
    if again.result_info.first().return_code != "PRIVACY_BUDGET_EXHAUSTED":
        raise AssertionError("the second batch found budget")
    info = spark.read.schema("api string, version string, reporting_origin string, attribution_destination string, filtering_id long, scheduled_report_time double").json(f"{path}/again-privacy-budget-exhausted")
    return info.select("api", "version", "reporting_origin", "attribution_destination", "filtering_id", _hour(F.timestamp_seconds("scheduled_report_time"))).distinct()


_REAL_SQL = "origin = 'https://www.origin1.com' AND api <> 'unknown-api' AND ts > TIMESTAMP '2024-01-11'"
_JOB_UNITS_SQL = f"SELECT DISTINCT {key_sql()} AS k, date_trunc('hour', ts) AS h FROM reports, (VALUES (0), (1)) f(fid) WHERE {_REAL_SQL}"


@query("rerun_job", with_sql(f"SELECT (SELECT count(*) FROM domain) AS n_buckets, 0::BIGINT AS n_differ, true AS is_noised, count(*) AS n_units, 1::BIGINT AS most_used, 'SUCCESS_WITH_ERRORS' AS return_code FROM ({_JOB_UNITS_SQL})"))
def rerun_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch run twice with secure noise: the second run publishes the first one's result and uses no more budget."""
    path = new_folder(spark, "rerun")
    job = _written_job(spark, sf_dir, path, batch="day", noise="secure")
    first = run_aggregation(spark, job)
    again = run_aggregation(spark, replace(job, output=f"{path}/again"))
    diff = tools.diff_results(read_summary(spark, f"{path}/out"), read_summary(spark, f"{path}/again")).agg(F.count("*").alias("n_differ"))
    rows = first.summary.agg(F.count("*").alias("n_buckets"), F.coalesce(F.bool_or(F.col("metric") != F.col("unnoised_metric")), F.lit(False)).alias("is_noised"))
    used = budget.read_ledger(spark, f"{path}/ledger").groupBy(*UNIT).agg(F.sum("used").alias("n")).agg(F.count("*").alias("n_units"), F.max("n").alias("most_used"))
    return rows.crossJoin(diff).crossJoin(used).crossJoin(again.result_info.select("return_code"))  # a row each


@query("shared_batch_name", with_sql(f"SELECT 'PRIVACY_BUDGET_ERROR' AS return_code, count(*) AS n_units FROM ({_JOB_UNITS_SQL})"))
def shared_batch_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another origin's job under a batch name that is taken: refused, and the ledger stays as it was."""
    path = new_folder(spark, "shared")
    job = _written_job(spark, sf_dir, path, batch="day")
    run_aggregation(spark, job)
    other = run_aggregation(spark, replace(job, attribution_report_to="https://www.origin2.com", output=f"{path}/other"))
    return other.result_info.select("return_code").crossJoin(budget.read_ledger(spark, f"{path}/ledger").agg(F.count("*").alias("n_units")))


@query("folded_ledger", with_sql(f"""SELECT privacy_budget_key, hour, reporting_origin, is_lacking FROM (
        SELECT DISTINCT {key_sql(fid='0')} AS privacy_budget_key, {_HOUR_SQL}, origin AS reporting_origin, event_id % 4 = 0 AS is_lacking, date_trunc('hour', ts) AS h
        FROM reports WHERE api <> 'unknown-api' AND event_id % 4 < 2 AND ts >= TIMESTAMP '2024-01-05') WHERE is_lacking
    UNION ALL SELECT DISTINCT {key_sql(fid='0')}, {_HOUR_SQL}, origin, false FROM reports
        WHERE api <> 'unknown-api' AND event_id % 4 < 2 AND ts >= TIMESTAMP '2024-01-05'"""))
def folded_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of two batches folded into a snapshot that ends days before 5 January: its units (not lacking), and those
    of the first batch that are asked for again."""
    path = new_folder(spark, "folded")
    rows = reports(spark, sf_dir).filter("shared_info.api != 'unknown-api'")
    first = budget.written_units(budget.budget_units(rows.filter("event_id % 4 = 0"), [0]))
    second = budget.budget_units(rows.filter("event_id % 4 = 1"), [0]).join(first, UNIT, "left_anti")
    ledger = Ledger(spark, path)
    ledger.consume(first, "first")
    ledger.consume(budget.written_units(second), "second")
    ledger.compact(datetime(2024, 4, 6, tzinfo=UTC))
    ledger.vacuum()
    kept = first.filter(F.col("reporting_window") >= F.lit(datetime(2024, 1, 5, tzinfo=UTC)))
    out = ledger.lacking(kept).withColumn("is_lacking", F.lit(True)).unionByName(ledger.used().select(*UNIT, F.lit(False).alias("is_lacking")))
    return out.select("privacy_budget_key", _hour(), "reporting_origin", "is_lacking")


@query("streamed_budget", with_sql(f"SELECT DISTINCT {key_sql(fid='0')} AS privacy_budget_key, {_HOUR_SQL}, origin AS reporting_origin, 1::BIGINT AS used FROM reports WHERE api <> 'unknown-api' AND event_id % 4 < 2"))
def streamed_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams use up budget of one ledger: what the second lacks is not used twice, and what neither has before
    counts once. The second stream's micro-batch has the id that the first one's had."""
    path = new_folder(spark, "ledger")
    rows = reports(spark, sf_dir).filter("shared_info.api != 'unknown-api'").select("event_id", "report_id", "shared_info", "data")
    first, second = rows.filter("event_id % 4 = 0"), rows.filter("event_id % 4 = 1")
    used = budget.budget_units(first, [0])
    second = second.withColumns(_unit_columns()).join(used, UNIT, "left_anti").drop(*UNIT)
    for name, part in (("a", first), ("b", second)):
        part.write.parquet(f"{path}/{name}")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/{name}")
        consume = collect.consume_in_batch(f"{path}/ledger", [0], name)
        stream.writeStream.foreachBatch(consume).option("checkpointLocation", f"{path}/state-{name}").trigger(availableNow=True).start().awaitTermination()
    out = budget.read_ledger(spark, f"{path}/ledger").groupBy(*UNIT).agg(F.sum("used").alias("used"))
    return out.select("privacy_budget_key", _hour(), "reporting_origin", "used")


def _unit_columns() -> dict[str, F.Column]:
    zero = F.lit(0).cast("decimal(20,0)")
    return dict(zip(UNIT, (budget.budget_key(zero), shared_info.report_hour(F.col("shared_info.scheduled_report_time")), F.col("shared_info.reporting_origin")), strict=True))


@query("csv_results", with_sql(f"SELECT (('0x' || right(bucket, 15))::BIGINT)::VARCHAR AS bucket, metric FROM ({_SUMS_SQL})"))
def csv_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV with decimal buckets, and read back."""
    path = new_folder(spark, "csv")
    write_summary(_sums(spark, sf_dir).withColumnRenamed("unnoised_metric", "metric"), path, "csv")
    return spark.read.option("header", True).schema("bucket string, metric long").csv(path)


@query("text_domain", "SELECT upper(hex(encode(k))) AS bucket, coalesce(n, 0)::BIGINT AS metric FROM (SELECT DISTINCT event_type || (user_id % 7) AS k FROM events) LEFT JOIN (SELECT event_type || (user_id % 10) AS k, count(*) AS n FROM events GROUP BY 1) USING (k)")
def text_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain of text keys, one a line, joined with sums by text key."""
    path, e = new_folder(spark, "keys"), table(spark, sf_dir, "events")
    e.select(F.concat("event_type", F.col("user_id") % 7).alias("value")).distinct().write.text(path)
    keys = e.select(buckets.norm_bucket(buckets.bucket_from_string(F.concat("event_type", F.col("user_id") % 10))).alias("bucket"), F.lit(1).cast("bigint").alias("value"))
    out = release.join_domain(histogram.histogram(keys), read_domain(spark, path, "text"))
    return out.select(F.hex(buckets.strip_bucket("bucket")).alias("bucket"), F.col("unnoised_metric").alias("metric"))


@query("json_results", with_sql(_SUMS_SQL))
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON arrays, buckets as Latin-1 text, and read back."""
    path = new_folder(spark, "json")
    write_summary(_sums(spark, sf_dir).withColumnRenamed("unnoised_metric", "metric"), path, "json_array")
    back = spark.read.option("multiLine", True).schema("bucket string, metric long").json(path)
    return _hex(back.withColumn("bucket", buckets.norm_bucket(F.encode("bucket", "ISO-8859-1"))))


@query("resharded_files", "SELECT count(*) AS n_rows, sum(l_partkey)::BIGINT AS total, 5::BIGINT AS n_files FROM lineitem")
def resharded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written again as five files."""
    path = new_folder(spark, "resharded")
    tools.shard_table(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), 5, path)
    back = spark.read.parquet(path).select("l_partkey", F.col("_metadata.file_name").alias("name"))
    return back.agg(F.count("*").alias("n_rows"), F.sum("l_partkey").cast("bigint").alias("total"), F.count_distinct("name").alias("n_files"))


@query("exported_units", with_sql(_UNITS_SQL))
def exported_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget units exported as JSON arrays and read back."""
    path = new_folder(spark, "units")
    export_budget_units(budget.budget_units(_known(spark, sf_dir), [0, 1]), path)
    back = spark.read.option("multiLine", True).schema("privacy_budget_key string, reporting_window timestamp, reporting_origin string").json(path)
    return back.select("privacy_budget_key", _hour(), "reporting_origin")


@query("default_ids", with_sql("SELECT CASE WHEN event_id % 2 = 0 THEN 0 ELSE id END AS id, count(*) AS n, sum(value)::BIGINT AS total FROM reports WHERE NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY 1"))
def default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions without a filtering id have id 0."""
    absent = F.transform("data", lambda f: f.withField("id", F.when(F.col("event_id") % 2 != 0, f["id"])))
    rows = histogram.explode_contributions(reports(spark, sf_dir).withColumn("data", absent))
    return rows.groupBy(F.col("id").cast("int").alias("id")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("sums_by_keys", with_sql(f"SELECT api, {_HOUR_SQL}, sum(value)::BIGINT AS metric FROM reports WHERE id IN (0, 1, 2) AND NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY 1, 2"))
def sums_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by api and hour in place of buckets."""
    rows = reports(spark, sf_dir).withColumns({"api": F.col("shared_info.api"), "hour": _hour("shared_info.scheduled_report_time")})
    sums = histogram.histogram(histogram.explode_contributions(rows, IDS, keep=("api", "hour")), ("api", "hour"))
    return sums.withColumnRenamed("unnoised_metric", "metric")


@query(
    "own_noise",
    with_sql(f"SELECT coalesce(d.bucket, s.bucket) AS bucket, coalesce(metric, 0)::BIGINT AS unnoised_metric, coalesce(metric, 0)::BIGINT % 7 - 3 AS noise, concat_ws(',', CASE WHEN d.bucket IS NOT NULL THEN 'in_domain' END, CASE WHEN s.bucket IS NOT NULL THEN 'in_reports' END) AS annotations FROM domain d FULL JOIN ({_SUMS_SQL}) s ON d.bucket = s.bucket"),
)
def own_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A debug report with a noise function of the caller's."""
    noised = release.add_noise(release.debug_report(_sums(spark, sf_dir), domain(spark, sf_dir)), PARAMS, lambda m: m + m % 7 - 3)
    return _hex(release.debug_columns(noised), "noise", F.concat_ws(",", "annotations").alias("annotations"), metric="unnoised_metric").withColumnRenamed("metric", "unnoised_metric")


@query("closed_hours", with_sql("SELECT strftime(h, '%Y-%m-%d %H') AS hour, n_reports FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n_reports FROM reports GROUP BY 1) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM reports) - INTERVAL 48 HOUR"))
def closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a stream that its watermark has passed, each given out once."""
    path = new_folder(spark, "closed")
    _flat(spark, sf_dir).select("scheduled_report_time").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("scheduled_report_time timestamp").parquet(f"{path}/in")
    closed = collect.close_hours(stream, "48 hours").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    closed.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("hour timestamp, n_reports long").parquet(f"{path}/out").select(_hour("hour"), "n_reports")


_STEPS, _WAIT_HOURS = 4, 24
_CLOSING_SQL = f"""WITH r AS (SELECT *, date_trunc('hour', ts) AS h, least(floor({_STEPS} * epoch_us(received - lo) / epoch_us(hi - lo + INTERVAL 1 SECOND)), {_STEPS - 1})::INT AS step
        FROM reports, (SELECT min(received) AS lo, max(received) AS hi FROM reports)),
    f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY report_id, ts::DATE ORDER BY step, event_id) = 1),
    clocks AS (SELECT s AS step, max(received) AS clock FROM r, range({_STEPS}) t(s) WHERE r.step <= s GROUP BY s),
    closing AS (SELECT h, greatest(first_step, min(step)) AS close_step FROM (SELECT h, min(step) AS first_step FROM f GROUP BY h) JOIN clocks ON h + INTERVAL {_WAIT_HOURS + 1} HOUR <= clock GROUP BY h, first_step)"""


@query(
    "released_hours",
    f"{with_sql('').rstrip()}, {_CLOSING_SQL.removeprefix('WITH ')}" + """
    SELECT strftime(h, '%Y-%m-%d %H') AS hour, bucket, sum(value)::BIGINT AS metric FROM f JOIN closing USING (h) WHERE step <= close_step AND id IN (0, 1, 2) AND NOT (bucket = repeat('0', 32) AND value = 0) GROUP BY 1, 2
    UNION ALL SELECT strftime(h, '%Y-%m-%d %H'), 'late', count(*) FROM f JOIN closing USING (h) WHERE step > close_step GROUP BY 1""",
)
def released_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of reports in order of receipt, in steps: each hour's sums are released once, 24 hours after its end, and
    the reports that come later are counted. The stream stops after each step and starts again."""
    path = new_folder(spark, "hours")
    rows = reports(spark, sf_dir).select("event_id", "report_id", "received", "data", F.col("shared_info.scheduled_report_time").alias("scheduled_report_time"))
    lo, hi = rows.agg(F.min("received"), F.max("received")).first()
    step = F.least(F.floor(_STEPS * (F.unix_micros("received") - F.unix_micros(F.lit(lo))) / (F.unix_micros(F.lit(hi)) - F.unix_micros(F.lit(lo)) + 1_000_000)), F.lit(_STEPS - 1))
    steps = rows.withColumn("step", step)
    hours = HourlyRelease(f"{path}/out", timedelta(hours=_WAIT_HOURS), PARAMS, ids=IDS, noise="none", skip_threshold=True)
    for k in range(_STEPS):
        # Of equal reports of a step the first by number stays, as in SQL; the class takes any one.
        first = steps.filter(F.col("step") == k).groupBy("report_id", F.to_date("scheduled_report_time")).agg(F.min_by(F.struct("scheduled_report_time", "data"), "event_id").alias("x"), F.max("received").alias("latest"))
        first.select("report_id", "x.*", F.col("latest").alias("received")).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema("report_id string, scheduled_report_time timestamp, data " + FACTS + ", received timestamp").parquet(f"{path}/in")
        source.writeStream.foreachBatch(hours).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = hours.released(spark).select(_hour("hour"), buckets.bucket_hex("bucket").alias("bucket"), "metric")
    late = hours.late(spark, source.schema).groupBy(_hour("scheduled_report_time")).agg(F.lit("late").alias("bucket"), F.count("*").alias("metric"))
    return out.unionByName(late)


_BAD_SQL = "(origin <> 'https://www.origin1.com' OR api = 'unknown-api' OR ts <= TIMESTAMP '2024-01-11')"


@query("job_result", with_sql(f"""SELECT run, CASE run WHEN 'strict' THEN 'REPORTS_WITH_ERRORS_EXCEEDED_THRESHOLD' ELSE 'SUCCESS_WITH_ERRORS' END AS return_code, count(*) FILTER {_BAD_SQL.replace("(", "(WHERE ", 1)} AS n_errors
    FROM reports, (VALUES ('first'), ('again'), ('strict')) r(run) GROUP BY run"""))
def job_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What jobs return: two runs of one batch with unlimited budget succeed, one that allows 1 % of errors stops."""
    path = new_folder(spark, "results")
    job, out = _written_job(spark, sf_dir, path, budget="unlimited"), None
    for name, more in (("first", {}), ("again", {}), ("strict", {"report_error_threshold_percentage": "1"})):
        info = run_aggregation(spark, replace(job, output=f"{path}/{name}", **more)).result_info
        row = info.select(F.lit(name).alias("run"), "return_code", "n_errors")
        out = row if out is None else out.unionByName(row)
    return out


@query("early_stop", with_sql(f"""SELECT run, CASE run WHEN 'all allowed' THEN 'SUCCESS_WITH_ERRORS' ELSE 'REPORTS_WITH_ERRORS_EXCEEDED_THRESHOLD' END AS return_code,
    CASE run WHEN 'all allowed' THEN count(*) FILTER (WHERE {_BAD_SQL}) END AS n_errors, run <> 'all allowed' AS is_over FROM reports, (VALUES ('all allowed'), ('one in 100'), ('none allowed')) r(run) GROUP BY run"""))
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with an announced count, and one that allows no error: two stop while they run, so that their numbers of
    errors are above what is allowed but open; the third counts all."""
    path = new_folder(spark, "early")
    job = _written_job(spark, sf_dir, path, budget="unlimited", input_report_count=str(table(spark, sf_dir, "events").count()))
    out = None
    for name, more in (("all allowed", {}), ("one in 100", {"report_error_threshold_percentage": "1"}), ("none allowed", {"report_error_threshold_percentage": "0", "input_report_count": None})):
        one = replace(job, output=f"{path}/{name.replace(' ', '-')}", **more)
        over = F.col("n_errors") > errors.allowed(one.percent, one.announced)
        n_errors = F.col("n_errors") if name == "all allowed" else F.lit(None).cast("bigint")
        row = run_aggregation(spark, one).result_info.select(F.lit(name).alias("run"), "return_code", n_errors.alias("n_errors"), over.alias("is_over"))
        out = row if out is None else out.unionByName(row)
    return out


@query("failed_jobs", with_sql("""SELECT run, CASE run WHEN 'new version' THEN 'UNSUPPORTED_REPORT_VERSION' WHEN 'no reports' THEN 'INPUT_DATA_READ_FAILED' WHEN 'no domain' THEN 'INPUT_DATA_READ_FAILED' WHEN 'epsilon' THEN 'INVALID_JOB' WHEN 'two parties' THEN 'INVALID_JOB' ELSE 'SUCCESS' END AS code,
    CASE run WHEN 'good' THEN (SELECT count(*) FROM domain) ELSE 0 END AS n_rows FROM (VALUES ('good'), ('new version'), ('no reports'), ('no domain'), ('epsilon'), ('two parties')) r(run)"""))
def failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How jobs over the reports of one origin fail: by a version above the supported ones, by missing files, by what was asked for."""
    path = new_folder(spark, "failed")
    given = _written_job(spark, sf_dir, path, budget="unlimited")
    late = reports(spark, sf_dir, dealt=True)
    late = late.withColumn("shared_info", F.col("shared_info").withField("version", F.when(F.col("event_id") % 2 == 0, "2.0").otherwise("1.0")))
    rows = []
    for name, more, own in (("good", {}, None), ("new version", {}, late), ("no reports", {"reports": f"{path}/none"}, None), ("no domain", {"domain": f"{path}/none"}, None), ("epsilon", {"debug_privacy_epsilon": "65"}, None), ("two parties", {"reporting_site": "https://origin1.com"}, None)):
        try:
            out = run_aggregation(spark, replace(given, output=f"{path}/{name.replace(' ', '-')}", **more), own)
            rows.append((name, out.result_info.first().return_code.replace("_WITH_ERRORS", ""), out.summary.count()))
        except AggregationError as e:
            rows.append((name, e.code, 0))
    return spark.createDataFrame(rows, "run string, code string, n_rows long")


@query("job_epsilons", with_sql("SELECT epsilon, bucket, coalesce(metric, 0)::BIGINT + scale::BIGINT AS metric FROM domain LEFT JOIN (" + _SUMS_SQL + ") USING (bucket), (VALUES ('2', 50), ('x', 100), ('none', 100)) e(epsilon, scale)"))
def job_epsilons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results under a job's own epsilon, under a text that is no number, and without one: the scale of the noise is added in place of a draw."""
    sums, wanted, out = _sums(spark, sf_dir), domain(spark, sf_dir), None
    for text in ("2", "x", None):
        params = PARAMS.with_debug_epsilon(text)
        noised = release.add_noise(release.join_domain(sums, wanted), params, lambda m, p=params: m + int(p.l1 / p.epsilon))
        if release.params_of(noised) != params:
            raise ValueError("the result does not say what it was noised with")
        rows = _hex(noised, F.lit(text or "none").alias("epsilon"))
        out = rows if out is None else out.unionByName(rows)
    return out
