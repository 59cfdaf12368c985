"""Reading report batches, domains and earlier results."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AggregationError
from ..functions import files
from ..functions.buckets import norm_bucket
from ..operators.release import PrivacyParams, params_of, with_params
from ..schemas import DEBUG, DOMAIN, REPORT, SUMMARY
from .writers import BUCKETS, MANIFEST, STAGING


def _load(spark: SparkSession, paths: str | list[str], fmt: str, schema) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        df = spark.read.schema(schema).format(fmt).load(paths)
        if not paths or not df.inputFiles():
            raise AggregationError("INPUT_DATA_READ_FAILED", f"no shards under {paths}")
        return df
    except AnalysisException as e:
        raise AggregationError("INPUT_DATA_READ_FAILED", str(e)) from e


def read_reports(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Raw reports of one or many prefixes, with ``source_file``; empty shards give no rows, no shards at all fail.

    ``fmt``: parquet, json (binary as base64) or any format that Spark has, as avro where its package is installed.
    """
    if fmt == "json":
        text = _load(spark, paths, fmt, "payload string, key_id string, shared_info string")
        return text.select(F.unbase64("payload").alias("payload"), "key_id", "shared_info", F.col("_metadata.file_path").alias("source_file"))
    return _load(spark, paths, fmt, REPORT).select("*", F.col("_metadata.file_path").alias("source_file"))


def read_domain(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Distinct 16-byte buckets. ``text``: one key a line, ISO-8859-1, at most 16 bytes; longer keys fail the read."""
    if fmt == "text":
        _load(spark, paths, "text", "value string")  # no shards at all fail
        lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "\x02").option("escape", "\x02").option("mode", "PERMISSIVE").schema("key string").csv([paths] if isinstance(paths, str) else list(paths))
        raw = lines.filter(F.col("key").isNotNull() & (F.col("key") != "")).select(F.encode("key", "ISO-8859-1").alias("bucket"))
    else:
        raw = _load(spark, paths, fmt, DOMAIN)
    checked = F.when(F.octet_length("bucket") > 16, F.raise_error(F.lit("a domain key is longer than 16 bytes")).cast("binary")).otherwise(norm_bucket("bucket"))
    return raw.select(checked.alias("bucket")).distinct()


def domain_buckets(spark: SparkSession, path: str) -> int:
    """Number of buckets of a bucketed domain."""
    try:
        return int(files.read_text(spark, f"{path.rstrip('/')}/{BUCKETS}"))
    except (AnalysisException, OSError) as e:
        raise AggregationError("INPUT_DATA_READ_FAILED", f"{path} is not a bucketed domain, or not written to its end") from e


def read_bucketed_domain(spark: SparkSession, path: str) -> DataFrame:
    """Keys of ``write_bucketed_domain``, distinct already. Joined by ``bucket`` with rows that are dealt to as many
    partitions (``domain_buckets``), they are read by their hash and not shuffled."""
    path = path.rstrip("/")
    name = f"domain_{hashlib.sha256(path.encode()).hexdigest()[:32]}_{domain_buckets(spark, path)}"
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (bucket BINARY) USING parquet CLUSTERED BY (bucket) SORTED BY (bucket) INTO {domain_buckets(spark, path)} BUCKETS LOCATION '{where}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _published(spark: SparkSession, paths: str | list[str], fmt: str, schema: str) -> DataFrame:
    """Results of one or many folders. Where a folder has a manifest, its files alone; one whose publication was cut off
    fails. The column ``metric`` keeps what Parquet files or manifests say of its noise; unlike noise is refused."""
    chosen, said = [], []
    for path in [paths] if isinstance(paths, str) else list(paths):
        names = files.names(spark, path) if not any(c in path for c in "*?{[") else []
        if MANIFEST in names:
            manifest = json.loads(files.read_text(spark, f"{path}/{MANIFEST}"))
            chosen += [f"{path}/{f['name']}" for f in manifest["files"]]
            if manifest["params"]:
                said.append(PrivacyParams(**manifest["params"]))
        elif any(n.startswith(STAGING) for n in names):
            raise AggregationError("INPUT_DATA_READ_FAILED", f"{path} is not published yet")
        else:
            chosen.append(path)
            if fmt == "parquet" and names:
                try:
                    found = params_of(spark.read.parquet(path))
                except AnalysisException:  # no shards: told below
                    found = None
                said += [found] if found else []
    df = _load(spark, chosen, fmt, schema)
    if len(set(said)) > 1:
        raise ValueError("results with different privacy parameters cannot be joined")
    return with_params(df, said[0]) if said and "metric" in df.columns else df


def read_summary(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Buckets and noisy metrics of published results; the parameters of their noise stay with the column."""
    return _published(spark, paths, fmt, SUMMARY)


def read_debug(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Debug rows with ``metric``, the unnoised metric plus noise."""
    return _published(spark, paths, fmt, DEBUG).withColumn("metric", F.col("unnoised_metric") + F.col("noise"))
