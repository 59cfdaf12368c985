"""Contributions of valid reports, and their sums by bucket."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import norm_bucket
from ..functions.names import unused
from ..functions.sizes import bounded_broadcast

_UUID = r"^[0-9A-Fa-f]{1,8}-[0-9A-Fa-f]{1,4}-[0-9A-Fa-f]{1,4}-[0-9A-Fa-f]{1,4}-[0-9A-Fa-f]{1,12}$"


def is_uuid(text: Column) -> Column:
    """Five hex groups, each at most as long as in a full UUID (a lenient parser's rule)."""
    return F.coalesce(text.rlike(_UUID), F.lit(False))


def canonical_uuid(text: Column) -> Column:
    """The lower-case full form, so that ``1-1-1-1-1`` and its padded form are one id."""
    parts = F.split(F.lower(text), "-")
    return F.concat_ws("-", *(F.lpad(F.get(parts, i), n, "0") for i, n in enumerate((8, 4, 4, 4, 12))))


def dedupe_reports(reports: DataFrame, report_id: str = "report_id", order: Iterable[str] = ()) -> DataFrame:
    """The first report of each id in ``order``; reports without an id all stay.

    Ids are compared as UUIDs. With no order any one of equal ids stays (a plain hash aggregate).
    """
    key = F.when(is_uuid(F.col(report_id)), canonical_uuid(F.col(report_id))).otherwise(F.col(report_id))
    one, rank = unused(reports, "report_key"), unused(reports, "report_rank")
    known = reports.filter(F.col(report_id).isNotNull()).withColumn(one, key)
    order = list(order)
    if order:
        first = known.withColumn(rank, F.row_number().over(Window.partitionBy(one).orderBy(*order))).filter(F.col(rank) == 1).drop(rank, one)
    else:
        first = known.dropDuplicates([one]).drop(one)
    return first.unionByName(reports.filter(F.col(report_id).isNull()))


def _kept(fact: Column, ids: list[int] | None) -> Column:
    zero = F.lit(0).cast("decimal(20,0)")
    not_null = ~((F.hex(fact["bucket"]).rlike("^0*$")) & (fact["value"] == 0))
    return not_null if ids is None else not_null & F.coalesce(fact["id"], zero).isin([F.lit(i).cast("decimal(20,0)") for i in ids])


def explode_contributions(reports: DataFrame, ids: list[int] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """A row a contribution: bucket (16 bytes), value, id (0 if absent) and the columns in ``keep``.

    Null facts (bucket 0 with value 0) and other filtering ids are dropped inside the array, before the explode.
    """
    facts = reports.select(*keep, F.explode(F.filter("data", lambda f: _kept(f, ids))).alias("f"))
    return facts.select(*keep, norm_bucket(F.col("f.bucket")).alias("bucket"), F.col("f.value").alias("value"), F.coalesce("f.id", F.lit(0).cast("decimal(20,0)")).alias("id"))


def drop_null_facts(contributions: DataFrame) -> DataFrame:
    return contributions.filter(~(F.hex("bucket").rlike("^0*$") & (F.col("value") == 0)))


def filter_ids(contributions: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Contributions with one of ``ids``: a list, or for long lists a DataFrame with a column ``id``."""
    if isinstance(ids, DataFrame):
        return contributions.join(bounded_broadcast(ids.select(F.col("id").cast("decimal(20,0)").alias("id")).distinct()), "id", "left_semi")
    return contributions.filter(F.col("id").isin([F.lit(i).cast("decimal(20,0)") for i in ids]))


def histogram(contributions: DataFrame, keys: Iterable[str] = ("bucket",)) -> DataFrame:
    """``unnoised_metric``: the sum of values by ``keys``. Sums past 2**63 - 1 raise instead of wrapping."""
    return contributions.groupBy(*keys).agg(F.sum("value").alias("unnoised_metric"))
