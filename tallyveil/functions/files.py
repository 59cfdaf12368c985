"""Small files on a shared file system: written whole, and under a name that only one writer gets."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    where, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def move_once(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file, or a folder, the name ``target``; False, and nothing changes, if that name is taken.

    Hadoop file systems refuse a rename onto a file in one step; local ones replace it, so there a file gets its new name
    by a hard link, which does not. Stores whose rename is a copy need a file system that commits conditionally.
    """
    here, fs = _at(spark, source)
    there, _ = _at(spark, target)
    fs.mkdirs(there.getParent())
    if fs.getScheme() == "file" and fs.getFileStatus(here).isFile():
        try:
            os.link(here.toUri().getPath(), there.toUri().getPath())
        except FileExistsError:
            return False
        fs.delete(here, False)
        return True
    return not fs.exists(there) and bool(fs.rename(here, there))


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under ``path``, seen whole or not at all; False if another writer was first."""
    staging = f"{path.rpartition('/')[0]}/_staging-{uuid.uuid4().hex}"
    write_text(spark, staging, text)
    if move_once(spark, staging, path):
        return True
    delete(spark, staging)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    if fs.getScheme() == "file":
        with open(where.toUri().getPath(), encoding="utf-8") as f:
            return f.read()
    return "\n".join(r.value for r in spark.read.text(path).collect())
