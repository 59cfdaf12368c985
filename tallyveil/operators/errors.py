"""Error summaries and the error threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import DESCRIPTIONS, fatal_version

TOTAL = "NUM_REPORTS_WITH_ERRORS"
DEFAULT_PERCENT = 10.0


def error_summary(reports: DataFrame) -> DataFrame:
    """category, count, description; the total of reports with an error comes last, if there is one.

    One pass: each bad report also counts under the total.
    """
    each = reports.filter(F.size("errors") > 0).select(F.explode(F.concat(F.array_distinct("errors"), F.array(F.lit(TOTAL)))).alias("category"))
    known = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    counts = each.groupBy("category").agg(F.count("*").alias("count")).withColumn("description", F.try_element_at(known, F.col("category")))
    return counts.orderBy(F.col("category") == TOTAL, "category")


def counts(reports: DataFrame, fatal: Column | None = None) -> tuple[int, int, bool]:
    """(reports, reports with errors, whether a version fails the job), in one aggregate. ``fatal``: whether a report's
    version does, if a column says so already."""
    fatal = fatal_version() if fatal is None else fatal
    r = reports.agg(F.count("*"), F.count_if(F.size("errors") > 0), F.coalesce(F.bool_or(fatal), F.lit(False))).first()
    return r[0], r[1], r[2]


def allowed(percent: float = DEFAULT_PERCENT, input_report_count: int | None = None) -> int | None:
    """How many reports may have errors, if that is known before they are counted: an announced count's share, rounded
    half up, or none at 0 percent."""
    if input_report_count is not None:
        return math.floor(input_report_count * percent / 100 + 0.5)
    return 0 if percent == 0 else None


def over_threshold(total: int, bad: int, percent: float = DEFAULT_PERCENT, input_report_count: int | None = None) -> bool:
    """Whether too many reports have errors: more than are ``allowed``, or than their share of all reports."""
    most = allowed(percent, input_report_count)
    return bad > (total * percent / 100 if most is None else most)
