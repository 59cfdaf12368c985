"""The plaintext metadata of a report: parsing, versions, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SHARED_INFO_JSON

DECRYPTION_ERROR = "DECRYPTION_ERROR"


def _instant(text: Column) -> Column:
    return F.timestamp_seconds(text.try_cast("decimal(20,6)"))


def parse_shared_info(df: DataFrame, column: str = "shared_info") -> DataFrame:
    """``column`` from JSON text to a struct with timestamps, plus ``parse_errors`` (array of categories).

    Unknown fields are ignored. Empty or malformed text, a missing version, origin or scheduled time, or a time
    that is no number make the row a DECRYPTION_ERROR.
    """
    raw = F.from_json(F.col(column), SHARED_INFO_JSON)
    df = df.withColumn("_raw", raw)
    get = lambda name: F.col(f"_raw.{name}")
    struct = F.struct(
        get("version").alias("version"), get("api").alias("api"), _instant(get("scheduled_report_time")).alias("scheduled_report_time"), get("reporting_origin").alias("reporting_origin"),
        get("attribution_destination").alias("attribution_destination"), _instant(get("source_registration_time")).alias("source_registration_time"), get("report_id").alias("report_id"), get("debug_mode").alias("debug_mode"),
    )
    bad = F.col("_raw").isNull() | get("version").isNull() | get("reporting_origin").isNull() | F.col(f"{column}.scheduled_report_time").isNull()
    bad = bad | (get("source_registration_time").isNotNull() & F.col(f"{column}.source_registration_time").isNull())
    df = df.withColumn(column, struct)
    return df.withColumn("parse_errors", F.when(bad, F.array(F.lit(DECRYPTION_ERROR))).otherwise(F.array().cast("array<string>"))).drop("_raw")


def shared_info_json(column: str = "shared_info") -> Column:
    """Back to JSON text with times as epoch seconds; nulls are left out."""
    seconds = lambda name: (F.unix_micros(F.col(f"{column}.{name}")) / 1_000_000).cast("decimal(20,6)").cast("string")
    trim = lambda c: F.rtrim(F.rtrim(c, F.lit("0")), F.lit("."))
    names = ["version", "api", "reporting_origin", "attribution_destination", "report_id", "debug_mode"]
    times = [trim(seconds(n)).alias(n) for n in ("scheduled_report_time", "source_registration_time")]
    return F.to_json(F.struct(*(F.col(f"{column}.{n}").alias(n) for n in names), *times))


def version_struct(version: Column) -> Column:
    """``major.minor`` as a struct that compares as versions do; null if malformed.

    Where several conditions need it, make it a column first: inside them, it would be parsed for each.
    """
    major, minor = (F.substring_index(version, ".", k).try_cast("int") for k in (1, -1))
    return F.when(version.rlike(r"^\d+\.\d+$") & major.isNotNull() & minor.isNotNull(), F.struct(major.alias("major"), minor.alias("minor")))


def version_at(major: int, minor: int) -> Column:
    return F.struct(F.lit(major).alias("major"), F.lit(minor).alias("minor"))


def is_debug(mode: Column) -> Column:
    return F.coalesce(mode == "enabled", F.lit(False))


def iso_instant(time: Column) -> Column:
    """``2021-01-01T00:00:00Z``; three or six digits of a fraction only where it is not zero."""
    micros = F.pmod(F.unix_micros(time), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(time, ".SSS")).otherwise(F.date_format(time, ".SSSSSS"))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def report_hour(time: Column) -> Column:
    return F.date_trunc("HOUR", time)
