"""Connected components by alternating large-star and small-star steps, and saved intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folders import new_folder

HUB, HUBS = 1 << 20, 100_000


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark, limit: str = "4m") -> None:
    """Arrow batches of about 4 MB from here on in this session, unless their size has been set to something else.

    Rows of long texts then need little memory in a task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's own default
        spark.conf.set(name, limit)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer partitions, as from one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(0x7FFFFFFF))).first())


def _met(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (u, v) with the ``m`` of their u: hubs by a broadcast of bounded size, others by a shuffled join.

    A graph of HUB edges at most has no node that is too much for a task.
    """
    if n_edges <= HUB:
        return edges.join(least.select("u", "m"), "u")
    hub = F.col("degree") > max(HUB, 2 * n_edges // HUBS)  # each edge is seen from two ends
    some = edges.join(F.broadcast(least.filter(hub).select("u", "m")), "u", "left")
    rest = some.filter("m IS NULL").drop("m").join(least.filter(~hub).select("u", "m"), "u")
    return some.filter("m IS NOT NULL").unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id`` and ``component`` (its smallest id) of all ids in ``edges`` (a, b); ids without edges are absent.

    Each round is two joins with pre-aggregated minima. The minima of hubs, nodes with more than HUB edges and more
    than a HUBS-th of all, are broadcast (HUBS rows at most), so a hub's edges are never gathered in one task. The
    number of rounds grows with the logarithm of the longest path.
    """
    now = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(now)
    for _ in range(max_rounds):
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = _met(both.filter("v > u"), least, before[0]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u and u itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        moved = _met(large, least, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        moved = saved(moved, "edges")
        now, mark = moved, _mark(moved)
        if mark == before:  # stars of smallest ids stay as they are
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    centres = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres.select("id", F.col("id").alias("component")))
