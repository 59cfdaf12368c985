"""A whole aggregation job: checks, one lazy plan, two driver decisions, one release."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AggregationError
from ..functions import files
from ..functions.buckets import id_list, percentage
from ..functions.folders import new_folder
from ..functions.origins import public_suffixes
from ..functions.payload import decode_payload
from ..functions.shared_info import parse_shared_info
from ..operators import budget, errors, histogram, release, validate
from ..operators.early_stop import ErrorWatch
from ..operators.ledger import Ledger
from ..sources.readers import domain_buckets, read_bucketed_domain, read_domain, read_reports
from ..sources.writers import write_exhausted_info, write_sharded

SPARK_ERRORS = (PySparkException, Py4JError)
MESSAGES = {  # fixed values: return codes and their messages
    "SUCCESS": "Aggregation job successfully processed",
    "SUCCESS_WITH_ERRORS": "Aggregation job successfully processed but some reports have errors.",
    "DEBUG_SUCCESS_WITH_PRIVACY_BUDGET_ERROR": "Aggregation would have failed in non-debug mode due to a privacy budget error.",
    "DEBUG_SUCCESS_WITH_PRIVACY_BUDGET_EXHAUSTED": "Aggregation would have failed in non-debug mode due to privacy budget exhaustion",
    "REPORTS_WITH_ERRORS_EXCEEDED_THRESHOLD": "Aggregation job failed early because the number of reports excluded from aggregation exceeded threshold.",
}
# What a debug run that goes on in spite of a budget failure returns.
DEBUG_EQUIVALENT = {c: f"DEBUG_SUCCESS_WITH_{c}" for c in ("PRIVACY_BUDGET_ERROR", "PRIVACY_BUDGET_EXHAUSTED")}


@dataclass
class AggregationJob:
    """What to aggregate, for whom, and where. Text parameters are as a job request has them."""

    reports: str | list[str] | None = None
    domain: str | list[str] | None = None
    output: str | None = None
    attribution_report_to: str | None = None
    reporting_site: str | None = None
    debug_run: bool = False
    report_error_threshold_percentage: str | None = None
    input_report_count: str | None = None
    filtering_ids_text: str | None = None
    debug_privacy_epsilon: str | None = None
    as_of: datetime = field(default_factory=lambda: datetime.now(UTC))
    params: release.PrivacyParams = field(default_factory=release.PrivacyParams)
    noise: str | Callable = "secure"
    domain_optional: bool = False
    skip_threshold: bool = False
    report_format: str = "parquet"
    domain_format: str = "parquet"  # or text, json, or "bucketed": one folder of write_bucketed_domain
    ledger: str | None = None
    budget: str = "ledger"  # or "unlimited"
    batch: str | None = None
    shard_bytes: int = 100_000_000
    seed: int | None = None
    suffixes: str | DataFrame | None = None  # public suffixes: a text file, one a line, or a table; else a short list
    check_budget_in_debug_run: bool = False  # the ledger is read, never written

    @property
    def filtering_ids(self) -> list[int]:
        return id_list(self.filtering_ids_text)

    @property
    def percent(self) -> float:
        return errors.DEFAULT_PERCENT if self.report_error_threshold_percentage is None else percentage(self.report_error_threshold_percentage)

    @property
    def announced(self) -> int | None:
        text = (self.input_report_count or "").strip()
        return int(text) if text else None

    def validate(self) -> AggregationJob:
        """The job itself, or INVALID_JOB."""
        try:
            if (self.attribution_report_to is None) == (self.reporting_site is None):
                raise ValueError("exactly one of attribution_report_to and reporting_site must be given")
            if not (self.attribution_report_to if self.reporting_site is None else self.reporting_site).strip():
                raise ValueError("attribution_report_to or reporting_site is blank")
            if not self.domain_optional and not self.domain:
                raise ValueError("the output domain's location is missing")
            if self.announced is not None and self.announced < 0:
                raise ValueError("input_report_count is negative")
            if self.domain_format == "bucketed" and self.domain is not None and not isinstance(self.domain, str):
                raise ValueError("a bucketed domain is one folder")
            _ = self.filtering_ids, self.percent, self.params.with_debug_epsilon(self.debug_privacy_epsilon)
        except ValueError as e:
            raise AggregationError("INVALID_JOB", str(e)) from e
        return self


@dataclass
class Outcome:
    summary: DataFrame | None
    debug: DataFrame | None
    errors: DataFrame
    units: DataFrame | None
    lacking: DataFrame | None
    result_info: DataFrame


def result_info(spark: SparkSession, code: str, bad: int = 0, message: str | None = None, finished_at: datetime | None = None) -> DataFrame:
    """One row: return_code, return_message, n_errors, finished_at. SUCCESS with errors becomes SUCCESS_WITH_ERRORS."""
    if code == "SUCCESS" and bad:
        code = "SUCCESS_WITH_ERRORS"
    row = (code, message or MESSAGES.get(code, MESSAGES["SUCCESS"]), bad, finished_at or datetime.now(UTC))
    return spark.createDataFrame([row], "return_code string, return_message string, n_errors long, finished_at timestamp")


def parse_reports(raw: DataFrame) -> DataFrame:
    """report_id, shared_info, operation, data and parse errors of raw reports."""
    return decode_payload(parse_shared_info(raw)).withColumn("report_id", F.col("shared_info.report_id"))


FATAL = "fatal_version"


def lean(checked: DataFrame, helpers: list[str]) -> DataFrame:
    """What a job's later passes need of validated reports: of those with errors the errors alone, of the others what is
    deduplicated and summed; and whether a report's version fails the job."""
    good = F.size("errors") == 0
    later = [c for c in ("report_id", "shared_info", "data", "source_file") if c in checked.columns]
    return checked.select("errors", validate.fatal_version().alias(FATAL), *helpers, *(F.when(good, F.col(c)).alias(c) for c in later))


BUDGET_MESSAGES = {"PRIVACY_BUDGET_ERROR": "the privacy budget's ledger cannot be read or written", "PRIVACY_BUDGET_EXHAUSTED": "the privacy budget of some units is used up"}


def _suffixes(spark: SparkSession, job: AggregationJob) -> DataFrame | None:
    return public_suffixes(spark, job.suffixes) if isinstance(job.suffixes, str) else job.suffixes


def _request(job: AggregationJob, params: release.PrivacyParams) -> str:
    """What a batch's release was asked for, as a digest."""
    parts = [job.attribution_report_to, job.reporting_site, job.filtering_ids, job.domain, job.domain_optional, job.skip_threshold, params.epsilon, params.l1, params.delta]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


@dataclass
class _Settled:
    """The release and its budget: what is published, or why it may not be."""

    noised: DataFrame | None
    code: str = "SUCCESS"
    units: DataFrame | None = None
    lacking: DataFrame | None = None
    message: str | None = None


def _settle(spark: SparkSession, job: AggregationJob, reports: DataFrame, noised: DataFrame, batch: str, request: str) -> _Settled:
    """Write the noised table once and use up its budget, unless it is a debug run.

    A ledger's commit points to the noised table. A batch that is committed already is answered with the table of that
    time: nothing is drawn anew, so a rerun reveals nothing more and needs no further budget.
    """
    if job.debug_run and not job.check_budget_in_debug_run:
        return _Settled(release.released(noised))
    units = budget.written_units(budget.budget_units(reports, job.filtering_ids))
    if job.budget != "ledger" or not job.ledger:
        return _Settled(release.released(noised), units=units)
    failed: list[Exception] = []

    def write(path: str) -> None:
        try:
            release.released(noised, path)
        except SPARK_ERRORS as e:
            failed.append(e)
            raise

    ledger = Ledger(spark, job.ledger)
    try:
        if job.debug_run:
            known = ledger.committed(units, batch, request)  # a real run would publish it again
            lacking = units.limit(0) if known else ledger.lacking(units)
            code = "PRIVACY_BUDGET_EXHAUSTED" if lacking.take(1) else "SUCCESS"
            return _Settled(release.released(noised), code, units, lacking)
        receipt = ledger.consume(units, batch, release=write, request=request)
    except AggregationError as e:
        return _Settled(release.released(noised) if job.debug_run else None, e.code, units, message=str(e))
    except SPARK_ERRORS:
        if failed:
            raise
        return _Settled(release.released(noised) if job.debug_run else None, "PRIVACY_BUDGET_ERROR", units)
    if receipt.lacking is not None:
        return _Settled(None, "PRIVACY_BUDGET_EXHAUSTED", units, receipt.lacking)
    return _Settled(spark.read.parquet(receipt.release), units=units, lacking=units.limit(0))


def run_aggregation(spark: SparkSession, job: AggregationJob, reports: DataFrame | None = None, domain: DataFrame | None = None) -> Outcome:
    """Run the job; parsed ``reports`` and a ``domain`` may be given in place of paths.

    Validated reports are written once to the shared folder for the time of the job, those with errors as errors alone:
    passes that count read only these columns. Deduplicated ones are written there too: several consumers read them by
    size, where a persisted table would keep all partitions of the shuffle, and each of these would write a file for
    each partition of the next one. If it is known beforehand how many reports may have errors (an announced
    count, or 0 percent), the run stops as soon as more have: errors are then those of the tasks that had ended, and a
    report of an unsupported major version fails the job only if it is met before. The noised result is written once and both outputs derive from it. Budget
    is used up by a commit that points to the written result, before that is published; if it is lacking, the inputs
    behind it are written in place of results. A batch that was committed before is published again from the result of
    that time; its name is refused to other units and requests. A debug run uses no budget, and checks it only if asked to.
    """
    job.validate()
    params = job.params.with_debug_epsilon(job.debug_privacy_epsilon)
    if reports is None:
        reports = parse_reports(read_reports(spark, job.reports, job.report_format))
    n_buckets = None
    if domain is None and job.domain and job.domain_format == "bucketed":
        domain, n_buckets = read_bucketed_domain(spark, job.domain), domain_buckets(spark, job.domain)
    elif domain is None and job.domain:
        domain = read_domain(spark, job.domain, job.domain_format)
    elif domain is not None:
        domain = release.read_domain_keys(domain)
    checked = validate.validate(reports, job, suffixes=_suffixes(spark, job))
    limit, watch, helpers = errors.allowed(job.percent, job.announced), None, []
    if limit is not None:
        watch = ErrorWatch(spark)
        checked, *helpers = watch.watched(checked)
    rows, checked_path, unique_path = lean(checked, helpers), new_folder(spark, "checked"), new_folder(spark, "unique")
    checked = None

    def written_and_counted() -> tuple[int, int, bool]:
        nonlocal checked
        rows.write.parquet(checked_path)
        checked = spark.read.schema(rows.schema).parquet(checked_path)
        return errors.counts(checked, F.col(FATAL))

    try:
        counted = written_and_counted() if watch is None else watch.run(written_and_counted, limit)
        if counted is None:  # too many errors already: the rest is not read
            return Outcome(None, None, watch.summary(), None, None, result_info(spark, "REPORTS_WITH_ERRORS_EXCEEDED_THRESHOLD", watch.counts()[errors.TOTAL]))
        total, bad, fatal = counted
        summary_of_errors = errors.error_summary(checked)
        if fatal:
            raise AggregationError("UNSUPPORTED_REPORT_VERSION", "a report's major version is above the supported ones")
        if errors.over_threshold(total, bad, job.percent, job.announced):
            over = spark.createDataFrame(summary_of_errors.collect(), summary_of_errors.schema)
            return Outcome(None, None, over, None, None, result_info(spark, "REPORTS_WITH_ERRORS_EXCEEDED_THRESHOLD", bad))
        valid, _ = validate.split_valid(checked)
        order = [c for c in ("source_file",) if c in valid.columns]
        first = histogram.dedupe_reports(valid, order=[*order, F.to_json("shared_info"), F.xxhash64("data")])
        first.select("report_id", "shared_info", "data").write.parquet(unique_path)
        unique = spark.read.schema(first.select("report_id", "shared_info", "data").schema).parquet(unique_path)
        sums = histogram.histogram(histogram.explode_contributions(unique, job.filtering_ids))
        if n_buckets:  # the sums go to the domain's keys, which stay where they lie
            sums = sums.repartition(n_buckets, "bucket")
        if job.domain_optional:
            noised = release.optional_domain(sums, domain, params, job.noise, job.skip_threshold, job.seed, job.debug_run)
        elif job.debug_run:
            noised = release.add_noise(release.debug_report(sums, domain), params, job.noise, job.seed)
        else:
            noised = release.add_noise(release.join_domain(sums, domain), params, job.noise, job.seed)
        errors_now = spark.createDataFrame(summary_of_errors.collect(), summary_of_errors.schema)  # a row a category
        batch = job.batch or uuid.uuid4().hex
        settled = _settle(spark, job, unique, noised, batch, _request(job, params))
        units, lacking, code = settled.units, settled.lacking, settled.code
        if code != "SUCCESS" and not job.debug_run:
            if lacking is not None and job.output:
                write_exhausted_info(budget.exhausted_info(lacking, budget.unit_inputs(unique, job.filtering_ids)), f"{job.output.rstrip('/')}-privacy-budget-exhausted")
            return Outcome(None, None, errors_now, units, lacking, result_info(spark, code, bad, settled.message or BUDGET_MESSAGES[code]))
        noised, code = settled.noised, DEBUG_EQUIVALENT.get(code, code)
    finally:
        files.delete(spark, checked_path)
        files.delete(spark, unique_path)
    debug = noised.drop("in_output") if job.debug_run else None
    shown = F.col("in_output") if "in_output" in noised.columns else F.array_contains("annotations", "in_domain")
    summary = noised.filter(shown) if job.debug_run else noised
    if job.output:
        try:
            write_sharded(summary, job.output, job.shard_bytes)
            if debug is not None:
                write_sharded(debug, job.output, job.shard_bytes, debug=True)
        except (*SPARK_ERRORS, FileExistsError) as e:
            raise AggregationError("RESULT_WRITE_ERROR", f"batch {batch} is not published; run it again under this name: {e}") from e
    return Outcome(summary.select("bucket", "metric", "unnoised_metric"), debug, errors_now, units, lacking, result_info(spark, code, bad))
