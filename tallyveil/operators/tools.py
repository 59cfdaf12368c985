"""Comparing results, re-sharding, delays and batch conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import norm_bucket
from ..functions.folders import written
from ..functions.sizes import bounded_broadcast
from .budget import unit_rows

UNIT = ["privacy_budget_key", "reporting_window", "reporting_origin"]


def diff_results(a: DataFrame, b: DataFrame, value: str = "metric") -> DataFrame:
    """bucket, left, right, status (``only_left``, ``only_right``, ``differs``) of buckets that are not the same.

    A bucket that a side holds twice is an error.
    """
    key = lambda df, name: df.groupBy(norm_bucket("bucket").alias("bucket")).agg(F.first(value).alias(name), F.count("*").alias("_n")).withColumn(name, F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate bucket")).cast("bigint")).otherwise(F.col(name))).drop("_n").withColumn(f"_{name}", F.lit(True))
    both = key(a, "left").join(key(b, "right"), "bucket", "full_outer")
    status = F.when(F.col("_right").isNull(), "only_left").when(F.col("_left").isNull(), "only_right").when(~F.col("left").eqNullSafe(F.col("right")), "differs")
    return both.select("bucket", "left", "right", status.alias("status")).filter("status IS NOT NULL")


def shard_table(df: DataFrame, n: int, path: str, fmt: str = "parquet") -> None:
    """Exactly ``n`` files of nearly equal size."""
    df.repartition(n).write.format(fmt).save(path)


def exact_quantiles(values: DataFrame, value: str, qs: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Interpolated quantiles of ``value`` by the columns ``by``: quantile and ``value`` for each; null values are left
    out, groups without any have no row.

    Distinct values are counted and sorted over all tasks; counts inside a partition and the totals of the partitions
    before it give each value its ranks, and the values at the two ranks of a quantile are picked. No task has more than
    its partition of distinct values, and a row a partition and group.
    """
    by, spark = list(by), values.sparkSession
    keys = [f"key{i}" for i in range(len(by))]
    counts = values.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).alias("v")).filter("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    order = [F.col(c).asc_nulls_first() for c in (*keys, "v")]
    ranked = written(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranks")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranked.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("part").alias("_part"), before(Window.partitionBy(*keys).orderBy("part")).alias("earlier"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    same = F.col("part") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    at = ranked.withColumn("inner", before(Window.partitionBy(*keys, "part").orderBy("v"))).join(bounded_broadcast(parts), same)
    begin = F.col("earlier") + F.col("inner")
    each = at.select(*keys, "v", begin.alias("begin"), (begin + F.col("n")).alias("end"), F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), (F.lit(q) * (F.col("total") - 1)).alias("rank")) for q in qs))).alias("q"))
    holds = lambda rank: (rank >= F.col("begin")) & (rank < F.col("end"))
    low, high, rank = F.floor("q.rank"), F.ceil("q.rank"), F.col("q.rank")
    picked = each.filter(holds(low) | holds(high)).groupBy(*keys, "q").agg(F.max(F.when(holds(low), F.col("v"))).alias("low"), F.max(F.when(holds(high), F.col("v"))).alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (rank - low))
    return picked.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), F.col("q.quantile").alias("quantile"), between.alias(value))


def delay_profile(reports: DataFrame, received: str, scheduled: str, qs: tuple[float, ...] = (0.9, 0.95, 0.99), exact: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles of the delay in hours between schedule and receipt, to choose how long to wait: the columns ``by``,
    quantile, delay_hours. ``exact`` ones are found by rank, others from a sketch."""
    hours = (F.unix_micros(F.col(received)) - F.unix_micros(F.col(scheduled))) / F.lit(3.6e9)
    rows = reports.select(*by, hours.alias("delay_hours"))
    if exact:
        return exact_quantiles(rows, "delay_hours", qs, by)
    row = rows.groupBy(*by).agg(F.percentile_approx("delay_hours", list(qs)).alias("q"))
    return row.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("quantile"), F.col("q").alias("delay_hours"))).alias("x")).select(*by, "x.quantile", "x.delay_hours")


def batch_conflicts(reports: DataFrame, ids: list[int], batch: str = "batch") -> DataFrame:
    """Budget units that more than one batch holds, with the number of batches."""
    rows = unit_rows(reports, ids, (batch,))
    return rows.groupBy(*UNIT).agg(F.countDistinct(batch).alias("n_batches")).filter("n_batches > 1")
