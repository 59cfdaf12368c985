"""Writing results, shards, batches and budget files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files
from ..functions.buckets import bucket_decimal, bucket_hex, bucket_to_string, norm_bucket, strip_bucket
from ..operators.release import debug_columns, params_of

MANIFEST, STAGING = "_manifest.json", "_staging-"
ROW_BYTES, HEADER_BYTES = 20, 335
DEFAULT_SHARD_BYTES, MIN_SHARD_BYTES, MAX_SHARD_BYTES = 100_000_000, 355, 5_000_000_000


def json_arrays(df: DataFrame) -> DataFrame:
    """Rows as JSON text, a line each, so that each partition is one JSON array."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            rows = batch["value"].to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([f"{lead if i == 0 else ','}{row}" for i, row in enumerate(rows)], pa.string())], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"], pa.string())], ["value"])

    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string")


def _written(df: DataFrame, path: str, fmt: str, hex_buckets: bool = False) -> None:
    if fmt == "json":
        df.withColumn("bucket", bucket_to_string("bucket")).write.json(path)
    elif fmt == "json_array":
        json_arrays(df.withColumn("bucket", bucket_to_string("bucket"))).write.text(path)
    elif fmt == "csv":
        text = F.concat(F.lit("0x"), F.regexp_replace(bucket_hex("bucket"), "^0+(?=.)", "")) if hex_buckets else bucket_decimal("bucket")
        df.withColumn("bucket", text).write.option("header", True).csv(path)
    else:
        df.write.format(fmt).save(path)


def write_summary(results: DataFrame, path: str, fmt: str = "parquet", hex_buckets: bool = False) -> None:
    """bucket and metric; buckets without leading zero bytes. ``json``: Latin-1 text, a row a line;
    ``json_array``: each file is one array; ``csv``: decimal, or hex."""
    _written(results.select(strip_bucket("bucket").alias("bucket"), "metric"), path, fmt, hex_buckets)


def debug_path(path: str) -> str:
    """The debug report has the summary's name in a folder ``debug`` beside it."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/debug/{name}" if head else f"debug/{name}"


def write_debug(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """bucket, unnoised_metric, noise, annotations to ``debug_path(path)``."""
    _written(debug_columns(results).withColumn("bucket", strip_bucket("bucket")), debug_path(path), fmt)


def records_per_shard(shard_bytes: int = DEFAULT_SHARD_BYTES) -> int:
    if not MIN_SHARD_BYTES <= shard_bytes < MAX_SHARD_BYTES:
        raise ValueError(f"shard size must be from {MIN_SHARD_BYTES} to below {MAX_SHARD_BYTES} bytes")
    return max((shard_bytes - HEADER_BYTES) // ROW_BYTES, 1)


def shard_count(rows: int, per_shard: int) -> int:
    """Shards that ``rows`` need: at least one; a remainder below a shard's rows joins the others."""
    return max(rows // per_shard, 1)


def shard_names(base: str, n: int) -> list[str]:
    width = len(str(n))
    return [f"{base}-{i:0{width}d}-of-{n}" for i in range(1, n + 1)]


def write_sharded(results: DataFrame, path: str, shard_bytes: int = DEFAULT_SHARD_BYTES, fmt: str = "parquet", debug: bool = False) -> list[str]:
    """The summary (with ``debug`` the debug report, in its own folder) in files named ``<name>-<i>-of-<n>``.

    Their number follows from the fixed size of a row and the number of rows. ``_manifest.json`` is written last and
    lists them with rows and digests; until then readers see nothing, and another run starts the publication anew. A
    path that is published already is an error. ``results`` should be a written table; one writer has a path at a time.
    """
    spark = results.sparkSession
    out = debug_columns(results) if debug else results.select("bucket", "metric")
    said = params_of(results)
    out = out.withColumn("bucket", strip_bucket("bucket"))
    path = (debug_path(path) if debug else path).rstrip("/")
    if files.exists(spark, f"{path}/{MANIFEST}"):
        raise FileExistsError(f"{path} is published")
    left = [n for n in files.names(spark, path) if n.startswith(STAGING)]
    taken = files.names(spark, path)
    if taken and not left:
        raise FileExistsError(f"{path} holds other files")
    base = path.rpartition("/")[2]
    for name in [n for n in taken if n.startswith(f"{base}-")] + left:  # of a run that was cut off; its mark goes last
        files.delete(spark, f"{path}/{name}")
    n = shard_count(out.count(), records_per_shard(shard_bytes))
    staging = f"{path}/{STAGING}{uuid.uuid4().hex}"
    out.repartition(n).write.format(fmt).save(staging)
    parts = [x for x in files.names(spark, staging) if x.startswith("part-")]
    names = [f"{name}.{fmt}" for name in shard_names(base, len(parts))]
    sums = {}
    if fmt == "parquet":
        rows = spark.read.schema(out.schema).parquet(staging).groupBy(F.col("_metadata.file_name").alias("file"))
        sums = {r.file: (r.n, f"{r.digest:x}") for r in rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*out.columns)).alias("digest")).collect()}  # a row a shard
    listed = []
    for part, name in zip(parts, names, strict=True):
        if not files.move_once(spark, f"{staging}/{part}", f"{path}/{name}"):
            raise FileExistsError(f"{path}/{name}")
        listed.append({"name": name, "rows": sums.get(part, (0, "0"))[0], "digest": sums.get(part, (0, "0"))[1]} if sums or fmt == "parquet" else {"name": name})
    manifest = {"files": listed, "params": None if said is None else asdict(said)}
    if not files.create_once(spark, f"{path}/{MANIFEST}", json.dumps(manifest) + "\n"):
        raise FileExistsError(f"{path} is published")
    files.delete(spark, staging)
    return names


def damaged_shards(spark: SparkSession, path: str) -> list[str]:
    """Names of shards of a publication (Parquet) that are gone, or whose rows are not those that its manifest lists."""
    path = path.rstrip("/")
    listed = {f["name"]: (f["rows"], f["digest"]) for f in json.loads(files.read_text(spark, f"{path}/{MANIFEST}"))["files"]}
    there = [n for n in files.names(spark, path) if n in listed]
    found = {}
    if there:
        df = spark.read.parquet(*(f"{path}/{n}" for n in there))
        rows = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest")).collect()
        found = dict.fromkeys(there, (0, "0")) | {r.file: (r.n, f"{r.digest:x}") for r in rows}
    return sorted(n for n, want in listed.items() if found.get(n) != want)


def write_exhausted_info(info: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """JSON lines in files of some ``per_file`` rows, mostly one: fields in alphabetical order, times as epoch numbers."""
    seconds = lambda c: (F.unix_micros(c) / 1_000_000).cast("double")
    fields = [seconds(F.col(c)).alias(c) if c.endswith("_time") else F.col(c) for c in sorted(info.columns)]
    lines = info.select(F.to_json(F.struct(*fields)).alias("value")).persist(StorageLevel.DISK_ONLY)
    try:
        lines.repartition(shard_count(lines.count(), per_file)).write.text(path)
    finally:
        lines.unpersist()


def export_budget_units(units: DataFrame, path: str, per_file: bool = False, dry_run: bool = False) -> None:
    """Budget units as JSON: a folder for each ``source_file``, a unit a line, or all together as arrays, one a file; a
    dry run writes nothing."""
    if dry_run:
        return
    if per_file:
        units.withColumn("source_file", F.element_at(F.split("source_file", "/"), -1)).distinct().repartition("source_file").write.partitionBy("source_file").json(path)
    else:
        json_arrays(units.drop("source_file").distinct()).write.text(path)


def write_reports(reports: DataFrame, path: str, fmt: str = "parquet") -> None:
    reports.select("payload", "key_id", "shared_info").write.format(fmt).save(path)


def write_domain(domain: DataFrame, path: str, fmt: str = "parquet") -> None:
    domain.select("bucket").write.format(fmt).save(path)


BUCKETS = "_buckets"  # a bucketed domain's number of buckets, written last


def write_bucketed_domain(domain: DataFrame, path: str, n_buckets: int) -> None:
    """A domain's distinct 16-byte buckets, laid out once by hash of the key in ``n_buckets`` files of sorted keys.

    Jobs join it as it lies (``read_bucketed_domain``): however many keys there are, none is shuffled or made distinct
    again. ``n_buckets``: about a file for each 128 MB of keys. The domain counts from its mark on, which is written last.
    """
    spark, path = domain.sparkSession, path.rstrip("/")
    if files.exists(spark, path) and files.names(spark, path):
        raise FileExistsError(f"{path} holds other files")
    keys = domain.select(norm_bucket("bucket").alias("bucket")).repartition(n_buckets, "bucket").distinct()
    name = f"domain_{uuid.uuid4().hex}"
    keys.write.format("parquet").bucketBy(n_buckets, "bucket").sortBy("bucket").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, they are not the catalog's
    files.create_once(spark, f"{path}/{BUCKETS}", f"{n_buckets}\n")
