"""Validators: each gives a category where a report fails; a report keeps all its failures in ``errors``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.origins import suffix_table, with_domain_flag, with_site
from ..functions.shared_info import is_debug, version_struct
from .budget import key_fields_ok
from .histogram import is_uuid

MAX_AGE_DAYS = 90
OPERATIONS = ["histogram"]
SUPPORTED_APIS = ["attribution-reporting", "attribution-reporting-debug", "protected-audience", "shared-storage"]
MAJOR_VERSIONS = [0, 1]
VERSION = "_version"  # the parsed version, a column that ``validate`` adds

# The categories and their descriptions.
DESCRIPTIONS = {
    "ATTRIBUTION_REPORT_TO_MALFORMED": "Report's shared_info.reporting_origin domain is malformed. Domain must be syntactically valid and have an Effective Top Level Domain (eTLD).",
    "ATTRIBUTION_REPORT_TO_MISMATCH": "Report's shared_info.reporting_origin value does not match attribution_report_to value set in the Aggregation job parameters. Aggregation request job parameters must have attribution_report_to set to report's shared_info.reporting_origin value.",
    "DECRYPTION_ERROR": "Unable to decrypt the report. This may be caused by: tampered aggregatable report shared info, corrupt encrypted report, or other such issues.",
    "DEBUG_NOT_ENABLED": "Reports without shared_info.debug_mode enabled cannot be processed in a debug run.",
    "DECRYPTION_KEY_NOT_FOUND": "Could not find decryption key on private key endpoint.",
    "DECRYPTION_KEY_FETCH_ERROR": "Fetching the decryption key for report decryption failed. This can happen using an unapproved aggregation service binary, running the aggregation service binary in debug mode, key corruption or service availability issues.",
    "NUM_REPORTS_WITH_ERRORS": "Total number of reports that had an error. These reports were not considered in aggregation. See additional error messages for details on specific reasons.",
    "ORIGINAL_REPORT_TIME_TOO_OLD": "Report's shared_info.scheduled_report_time is too old, reports cannot be older than 90 days.",
    "INTERNAL_ERROR": "Internal error occurred during operation.",
    "REPORTING_SITE_MISMATCH": "Report's shared_info.reporting_origin value does not belong to the reporting_site value set in the Aggregation job parameters. Aggregation request job parameters must have reporting_site set to the site which corresponds to the shared_info.reporting_origin value.",
    "UNSUPPORTED_OPERATION": "Report's operation is unsupported. Supported operations are [histogram].",
    "UNSUPPORTED_REPORT_API_TYPE": "The report's API type is not supported for aggregation. Supported APIs are [attribution-reporting, attribution-reporting-debug, protected-audience, shared-storage]",
    "REQUIRED_SHAREDINFO_FIELD_INVALID": "One or more required SharedInfo fields are empty or invalid.",
    "INVALID_REPORT_ID": "Report ID missing or invalid in SharedInfo.",
    "REPORT_PARSING_ERROR": "Parsing report data failed. This occurs when the report's binary data cannot be converted to a valid format.",
    "UNSUPPORTED_SHAREDINFO_VERSION": "Report has an unsupported version value in its shared_info. Supported values for report shared_info major version(s) are: [0, 1]",
}


def descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DESCRIPTIONS.items()), "category string, description string")


def _unless(ok: Column, category: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), category)


def bad_origin(job) -> Column:
    if job.reporting_site:
        return F.when(F.col("site").isNull(), "ATTRIBUTION_REPORT_TO_MALFORMED").when(F.col("site") != job.reporting_site, "REPORTING_SITE_MISMATCH")
    return _unless(F.col("shared_info.reporting_origin") == job.attribution_report_to, "ATTRIBUTION_REPORT_TO_MISMATCH")


def bad_age(job) -> Column:
    return _unless(F.col("shared_info.scheduled_report_time") > F.lit(job.as_of) - F.expr(f"interval {MAX_AGE_DAYS} days"), "ORIGINAL_REPORT_TIME_TOO_OLD")


def bad_operation(job) -> Column:
    return _unless(F.col("operation").isin(OPERATIONS), "UNSUPPORTED_OPERATION")


def bad_debug(job) -> Column:
    return _unless(is_debug(F.col("shared_info.debug_mode")), "DEBUG_NOT_ENABLED") if job.debug_run else F.lit(None).cast("string")


def bad_api(job) -> Column:
    api = F.col("shared_info.api")
    return _unless(api.isNull() | api.isin(SUPPORTED_APIS), "UNSUPPORTED_REPORT_API_TYPE")


def bad_key_fields(job) -> Column:
    ok = F.lit(True)
    for i in job.filtering_ids:
        ok = ok & F.coalesce(key_fields_ok(F.lit(i).cast("decimal(20,0)"), parsed=F.col(VERSION)), F.lit(False))
    return _unless(ok, "REQUIRED_SHAREDINFO_FIELD_INVALID")


def bad_report_id(job) -> Column:
    return _unless(is_uuid(F.col("shared_info.report_id")), "INVALID_REPORT_ID")


def bad_version(job) -> Column:
    v = F.col(VERSION)
    return _unless(v["major"].isin(MAJOR_VERSIONS) & ~((v["major"] == 0) & (v["minor"] == 0)), "UNSUPPORTED_SHAREDINFO_VERSION")


def fatal_version() -> Column:
    """A major version above the supported ones fails the whole job."""
    return F.coalesce(version_struct(F.col("shared_info.version"))["major"] > max(MAJOR_VERSIONS), F.lit(False))


def bad_domain(job) -> Column:
    """Opt-in: needs the column that ``with_domain_flag`` adds."""
    return _unless(F.col("is_domain"), "ATTRIBUTION_REPORT_TO_MALFORMED")


#: name -> function of the job; what production runs, and what the offline tool runs.
VALIDATORS: dict[str, Callable] = {"origin": bad_origin, "age": bad_age, "operation": bad_operation, "debug": bad_debug, "api": bad_api, "key_fields": bad_key_fields, "report_id": bad_report_id, "version": bad_version}
OFFLINE = ["debug", "api", "key_fields", "report_id", "version"]


def register_validator(name: str, validator: Callable) -> None:
    """``validator(job)`` gives a column: a category where the report fails, else null."""
    VALIDATORS[name] = validator


def validate(reports: DataFrame, job, names: list[str] | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``errors``: all categories that a report fails, earlier parse errors included.

    A report that could not be parsed has its parse errors alone.
    """
    names = list(VALIDATORS) if names is None else names
    added = []
    if "origin" in names and job.reporting_site or "domain" in names:
        suffixes = suffix_table(reports.sparkSession) if suffixes is None else suffixes
        reports = reports.withColumn("_reporting_origin", F.col("shared_info.reporting_origin"))
        added.append("_reporting_origin")
        if "origin" in names and job.reporting_site:
            reports = with_site(reports, suffixes, "_reporting_origin")
            added.append("site")
        if "domain" in names:
            reports = with_domain_flag(reports, suffixes, "_reporting_origin")
            added.append("is_domain")
    if {"key_fields", "version"} & set(names):  # parsed once a report
        reports = reports.withColumn(VERSION, version_struct(F.col("shared_info.version")))
        added.append(VERSION)
    # Nulls are taken out by an expression that Spark compiles together with the validators.
    found = F.array_except(F.array(*(({"domain": bad_domain} | VALIDATORS)[n](job).cast("string") for n in names)), F.array(F.lit(None).cast("string")))
    parse = [F.col(c) for c in ("parse_errors", "payload_errors") if c in reports.columns]
    if parse:
        earlier = F.flatten(F.array(*parse))
        found = F.when(F.size(earlier) > 0, earlier).otherwise(found)
    return reports.withColumn("errors", F.array_distinct(found)).drop(*added)


def split_valid(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    return reports.filter(F.size("errors") == 0), reports.filter(F.size("errors") > 0)
