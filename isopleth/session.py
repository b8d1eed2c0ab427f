"""Spark session for local runs, and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "isopleth") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ISOPLETH_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        # Call-site capture costs a round trip per expression and only serves error messages.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under a path; none if there is no such path."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    return [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more; nothing happens if there is none."""
    files, place = _at(spark, path)
    files.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None if there is none."""
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if exists(spark, path) else None


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in place of another at once, by a rename that overwrites."""
    jvm, (files, place) = spark._jvm, _at(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, overwrite)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Every executor must see the folder. Where a session names none, as in tests, the
    folder is in the session's warehouse, which all executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{root.rstrip('/')}/isopleth/{label}-{uuid.uuid4().hex}"
