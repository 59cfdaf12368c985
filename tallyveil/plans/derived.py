"""Report batches derived from the ``events`` table, and the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APIS = {"click": "attribution-reporting", "view": "protected-audience", "purchase": "shared-storage", "signup": "attribution-reporting-debug"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uuid(number) -> F.Column:
    h = F.md5(number.cast("string").cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def reports(spark: SparkSession, sf_dir: str, edges: bool = False, dealt: bool = False) -> DataFrame:
    """Parsed reports, one an event; each id occurs twice. With ``edges``, odd versions and ids occur as well. ``dealt``:
    the events are dealt evenly before they become reports, as a table of few row groups is read by few tasks."""
    e = table(spark, sf_dir, "events")
    e = e.repartition("event_id") if dealt else e
    n, user = F.col("event_id"), F.col("user_id")
    api = F.lit("unknown-api")
    for kind, name in APIS.items():
        api = F.when(F.col("event_type") == kind, name).otherwise(api)
    version = F.when(n % 3 == 0, "0.1").otherwise("1.0")
    report_id = _uuid(n - n % 2)
    if edges:
        version = F.when(n % 9 == 0, "0.0").when(n % 9 == 1, "abc").when(n % 9 == 2, "0.999").otherwise(version)
        report_id = F.when(n % 13 == 0, "").when(n % 13 == 1, "not-a-uuid").when(n % 13 == 2, "1-1-1-1-1").when(n % 13 == 3, F.lit(None)).otherwise(report_id)
    info = F.struct(
        version.alias("version"), api.alias("api"), F.col("ts").cast("timestamp").alias("scheduled_report_time"), F.concat(F.lit("https://www.origin"), user % 5, F.lit(".com")).alias("reporting_origin"),
        F.concat(F.lit("https://dest"), user % 7, F.lit(".com")).alias("attribution_destination"), F.lit(None).cast("timestamp").alias("source_registration_time"),
        report_id.alias("report_id"), F.when(n % 2 == 0, "enabled").alias("debug_mode"),
    )
    fact = F.struct(F.unhex(F.lpad(F.hex(user), 32, "0")).alias("bucket"), F.floor(F.col("value") * 100).cast("bigint").alias("value"), (n % 4).cast("decimal(20,0)").alias("id"))
    return e.select("event_id", report_id.alias("report_id"), info.alias("shared_info"), F.lit("histogram").alias("operation"), F.array(fact).alias("data"), F.timestamp_add("HOUR", (n % 72).cast("int"), F.col("ts").cast("timestamp")).alias("received"))


def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with even ids, and three ids above the largest."""
    e = table(spark, sf_dir, "events")
    even = e.filter("user_id % 2 = 0").select("user_id")
    above = e.agg(F.max("user_id").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + 3)).alias("user_id"))
    return even.unionByName(above).select(F.unhex(F.lpad(F.hex("user_id"), 32, "0")).alias("bucket")).distinct()


_UUID_SQL = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


def reports_sql(edges: bool = False) -> str:
    """CTE body ``reports`` with flat columns."""
    version = "CASE WHEN event_id % 3 = 0 THEN '0.1' ELSE '1.0' END"
    report_id = _UUID_SQL
    if edges:
        version = f"CASE event_id % 9 WHEN 0 THEN '0.0' WHEN 1 THEN 'abc' WHEN 2 THEN '0.999' ELSE {version} END"
        report_id = f"CASE event_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'not-a-uuid' WHEN 2 THEN '1-1-1-1-1' WHEN 3 THEN NULL ELSE {report_id} END"
    return f"""
    SELECT event_id, {report_id} AS report_id, {version} AS version, ts, ts + to_hours(event_id % 72) AS received,
        CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in APIS.items())} ELSE 'unknown-api' END AS api,
        'https://www.origin' || (user_id % 5) || '.com' AS origin, 'https://dest' || (user_id % 7) || '.com' AS destination,
        lpad(hex(user_id), 32, '0') AS bucket, floor(value * 100)::BIGINT AS value, event_id % 4 AS id, event_id % 2 = 0 AS debug
    FROM (SELECT *, md5((event_id - event_id % 2)::VARCHAR) AS h FROM events)
    """


DOMAIN_SQL = """
    SELECT DISTINCT lpad(hex(u), 32, '0') AS bucket
    FROM (SELECT user_id AS u FROM events WHERE user_id % 2 = 0 UNION ALL SELECT m + i FROM (SELECT max(user_id) AS m FROM events), range(1, 4) t(i))
"""
FIRST_SQL = "SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY event_id) = 1"


def with_sql(body: str, edges: bool = False) -> str:
    return f"WITH reports AS ({reports_sql(edges)}), first AS ({FIRST_SQL}), domain AS ({DOMAIN_SQL}) {body}"


def key_sql(version: str = "version", fid: str = "fid") -> str:
    """The budget key of the row's api for filtering id ``fid``."""
    fields = "api || '-' || {v} || '-' || origin || CASE WHEN api LIKE 'attribution%' THEN '-' || destination ELSE '' END"
    scheme_1 = f"({version} IN ('0.1', '0.999') AND {fid} = 0)"
    scheme_2 = f"({version} = '1.0' OR ({version} <> 'abc' AND {fid} <> 0))"
    text = fields.format(v=version)
    return f"CASE WHEN api = 'unknown-api' THEN NULL WHEN {scheme_1} THEN sha256({text}) WHEN {scheme_2} THEN sha256({text} || '-' || {fid}) END"
