"""Small files beside the data, through the cluster's file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    s = fs.open(p)
    try:
        return bytes(s.readAllBytes()).decode()
    finally:
        s.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that is there as a whole or not at all; False if one of that name is there already.

    Written beside it under a name of its own and renamed without overwriting, so of two writers one
    wins and the other is told. A crash leaves a name that begins with an underscore and is never read.
    """
    fs, p = _at(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}.new")
    s = fs.create(new, False)
    try:
        s.write(text.encode())
    finally:
        s.close()
    try:
        return not fs.exists(p) and _rename(spark, fs, new, p)
    finally:
        if fs.exists(new):
            fs.delete(new, False)


def _rename(spark: SparkSession, fs, old, new) -> bool:
    from py4j.protocol import Py4JJavaError

    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(old, new, none)
        return True
    except Py4JJavaError as x:
        kind = x.java_exception.getClass().getSimpleName()
        if kind == "FileAlreadyExistsException":
            return False
        if kind == "UnsupportedFileSystemException":  # no file context for this scheme
            return bool(fs.rename(old, new))
        raise


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
