"""Privacy-budget keys and units."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folders import new_folder
from ..functions.names import unused
from ..functions.shared_info import iso_instant, report_hour, version_at, version_struct
from ..schemas import UNIT
from .ledger import LIMIT, Ledger, distinct_units


@dataclass(frozen=True)
class KeyFields:
    """Fields of a budget key, in order, after api and version, for versions from ``since`` to below ``before``."""

    fields: tuple[str, ...]
    since: tuple[int, int] = (0, 0)
    before: tuple[int, int] | None = None

    def applies(self, version: Column) -> Column:
        """``version``: parsed, as ``version_struct`` gives it."""
        on = version >= version_at(*self.since)
        return F.coalesce(on if self.before is None else on & (version < version_at(*self.before)), F.lit(False))

    def overlaps(self, other: KeyFields) -> bool:
        ends = [x.before or (1 << 30, 0) for x in (self, other)]
        return self.since < ends[1] and other.since < ends[0]


_ATTRIBUTION = KeyFields(("reporting_origin", "attribution_destination", "source_registration_time"))
#: api -> its keys' fields by version; more are added by ``register_api``. For a version, one applies at most.
APIS: dict[str, list[KeyFields]] = {
    "attribution-reporting": [_ATTRIBUTION],
    "attribution-reporting-debug": [_ATTRIBUTION],
    "protected-audience": [KeyFields(("reporting_origin",))],
    "shared-storage": [KeyFields(("reporting_origin",))],
}
OPTIONAL = {"source_registration_time"}


def register_api(name: str, fields: list[str], since: tuple[int, int] = (0, 0), before: tuple[int, int] | None = None) -> None:
    """Key fields of an api for a range of versions; refused if a version already has some."""
    new = KeyFields(tuple(fields), since, before)
    if any(new.overlaps(x) for x in APIS.get(name, [])):
        raise ValueError(f"versions of {name} from {since} on already have key fields")
    APIS.setdefault(name, []).append(new)


def key_scheme(version: Column, filtering_id: Column) -> Column:
    """1 for versions in [0.1, 1.0) with id 0 or none; 2 from 1.0 on or with another id; else null."""
    return _scheme(version_struct(version), filtering_id)


def _scheme(v: Column, filtering_id: Column) -> Column:
    zero = F.coalesce(filtering_id == 0, F.lit(True))
    return F.when((v >= version_at(0, 1)) & (v < version_at(1, 0)) & zero, 1).when((v >= version_at(1, 0)) | (v.isNotNull() & ~zero), 2)


def _field(name: str, info: str) -> Column:
    column = F.col(f"{info}.{name}" if info else name)
    return iso_instant(column) if name == "source_registration_time" else column


def key_fields_ok(filtering_id: Column, info: str = "shared_info", parsed: Column | None = None) -> Column:
    """Whether a key can be made: a known api, a key scheme, and all its required fields non-empty. ``parsed``: the
    version, if a column has it parsed already."""
    col = lambda n: F.col(f"{info}.{n}" if info else n)
    parsed = version_struct(col("version")) if parsed is None else parsed
    ok = F.lit(False)
    for api, keys in APIS.items():
        for key in keys:
            full = F.lit(True)
            for name in key.fields:
                if name not in OPTIONAL:
                    full = full & (F.coalesce(col(name), F.lit("")) != "")
            ok = F.when((col("api") == api) & key.applies(parsed), full).otherwise(ok)
    return ok & _scheme(parsed, filtering_id).isNotNull()


def budget_key(filtering_id: Column, info: str = "shared_info", parsed: Column | None = None) -> Column:
    """Lower-hex SHA-256 of the key's fields joined by ``-``; scheme 2 appends the filtering id. Null without a scheme.
    ``parsed``: the version, if a column has it parsed already."""
    col = lambda n: F.col(f"{info}.{n}" if info else n)
    parsed = version_struct(col("version")) if parsed is None else parsed
    scheme = _scheme(parsed, filtering_id)
    tail = F.when(scheme == 2, filtering_id.cast("decimal(20,0)").cast("string"))
    key = F.lit(None).cast("string")
    for api, keys in APIS.items():
        for known in keys:
            text = F.concat_ws("-", col("api"), col("version"), *(_field(n, info) for n in known.fields), tail)
            key = F.when((col("api") == api) & known.applies(parsed), F.sha2(text, 256)).otherwise(key)
    return F.when(scheme.isNotNull(), key)


def unit_rows(reports: DataFrame, ids: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a report and filtering id: privacy_budget_key, reporting_window, reporting_origin, filtering_id.

    A report counts even if all its contributions are null or of other ids.
    """
    parsed = unused(reports, "version_parts")
    each = reports.withColumn(parsed, version_struct(F.col("shared_info.version"))).withColumn("filtering_id", F.explode(F.array(*(F.lit(i).cast("decimal(20,0)") for i in ids))))
    return each.select(
        budget_key(F.col("filtering_id"), parsed=F.col(parsed)).alias("privacy_budget_key"), report_hour(F.col("shared_info.scheduled_report_time")).alias("reporting_window"),
        F.col("shared_info.reporting_origin").alias("reporting_origin"), "filtering_id", *keep,
    )


def budget_units(reports: DataFrame, ids: list[int]) -> DataFrame:
    return unit_rows(reports, ids).select(*UNIT).distinct()


def unit_inputs(reports: DataFrame, ids: list[int]) -> DataFrame:
    """One input (accounting fields and filtering id) kept for each unit: that of the smallest report id."""
    rows = unit_rows(reports, ids, ("shared_info", "report_id"))
    return rows.groupBy(*UNIT).agg(F.min_by(F.struct("shared_info", "filtering_id"), F.struct("report_id", "filtering_id")).alias("input"))


def units_by_origin(units: DataFrame) -> DataFrame:
    """reporting_origin, n_units and first_unit (key, hour) of its distinct units; the units themselves stay rows, as an
    origin may have any number of them."""
    unit = F.struct("privacy_budget_key", "reporting_window")
    return units.select(*UNIT).distinct().groupBy("reporting_origin").agg(F.count("*").alias("n_units"), F.min(unit).alias("first_unit"))


def extract_budget_units(reports: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(units, skipped) of parsed but unvalidated reports, times cut to whole seconds.

    Reports that lack a field their api needs, or have no key scheme for an id, give no unit and are counted by
    api in ``skipped``; payloads are never read.
    """
    info = F.col("shared_info")
    whole = info.withField("scheduled_report_time", F.date_trunc("SECOND", "shared_info.scheduled_report_time")).withField("source_registration_time", F.date_trunc("SECOND", "shared_info.source_registration_time"))
    parsed = unused(reports, "version_parts")
    each = reports.withColumn("shared_info", whole).withColumn(parsed, version_struct(F.col("shared_info.version"))).withColumn("filtering_id", F.explode(F.array(*(F.lit(i).cast("decimal(20,0)") for i in ids))))
    good = F.coalesce(key_fields_ok(F.col("filtering_id"), parsed=F.col(parsed)), F.lit(False))
    units = each.filter(good).select(budget_key(F.col("filtering_id"), parsed=F.col(parsed)).alias(UNIT[0]), report_hour(F.col("shared_info.scheduled_report_time")).alias(UNIT[1]), F.col("shared_info.reporting_origin").alias(UNIT[2])).distinct()
    return units, each.filter(~good).groupBy("shared_info.api").agg(F.count("*").alias("skipped"))


def lacking_budget(units: DataFrame, ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Units whose budget is used up; with ``limit``, the first few by key."""
    used = ledger.groupBy(*UNIT).agg(F.sum("used").alias("used")).filter(F.col("used") >= LIMIT).select(*UNIT)
    out = units.join(used, UNIT, "left_semi")
    return out if limit is None else out.orderBy(*UNIT).limit(limit)


def read_ledger(spark, path: str) -> DataFrame:
    """Budget used so far. Only committed batches count; a path without any is an empty ledger."""
    return Ledger(spark, path).used()


def written_units(units: DataFrame) -> DataFrame:
    """Distinct units, written once for the several passes that a ledger makes over them."""
    path = new_folder(units.sparkSession, "units")
    distinct_units(units).write.parquet(path)
    return units.sparkSession.read.schema(units.select(*UNIT).schema).parquet(path)


def consume_budget(units: DataFrame, path: str, batch: str | None = None, limit: int | None = None) -> DataFrame:
    """All or nothing: if any unit lacks budget it returns those and writes nothing; else all units are used up.

    A batch that is consumed again for the same units, as a retried micro-batch, has no further effect; for other units
    it is refused. Any number of writers may use one ledger.
    """
    receipt = Ledger(units.sparkSession, path).consume(written_units(units), batch or uuid.uuid4().hex, limit)
    return units.select(*UNIT).limit(0) if receipt.lacking is None else receipt.lacking


def inputs_of(units: DataFrame, inputs: DataFrame) -> DataFrame:
    """The inputs behind exhausted units; which side is broadcast, if any, Spark decides by measured size."""
    return inputs.join(units.select(*UNIT), UNIT)


ACCOUNTING = ["api", "attribution_destination", "reporting_origin", "scheduled_report_time", "source_registration_time", "version"]


def exhausted_info(units: DataFrame, inputs: DataFrame) -> DataFrame:
    """Accounting fields and filtering id of the inputs behind exhausted units; report ids and debug mode play no part."""
    return inputs_of(units, inputs).select(*(F.col(f"input.shared_info.{n}").alias(n) for n in ACCOUNTING), F.col("input.filtering_id").alias("filtering_id")).distinct()
