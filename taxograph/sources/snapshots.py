"""Versioned graph snapshots: a folder for each version, and a pointer that is replaced when a version is complete."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from taxograph.operators.graph import CategoryGraph, check_graph

TABLES = ("subcats", "files", "categories")


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside the target and rename it over it: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    fresh = f"{path}.{uuid.uuid4().hex}"
    _put(spark, fresh, text)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files.rename(jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path), options)


def _get(spark: SparkSession, path: str) -> str | None:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    return spark.sparkContext.wholeTextFiles(path).first()[1]


def write_snapshot(graph: CategoryGraph, folder: str, buckets: int | None = None, check: bool = True) -> str:
    """Write a version and make it the current one; its name. Edge tables are clustered and sorted by parent.

    An unsound graph (a file that is a category) is refused before anything is written, unless ``check`` is false.
    """
    spark = graph.spark
    if check:
        check_graph(graph)
    version = f"v{time.time_ns():020d}"
    for name in TABLES:
        df = getattr(graph, name)
        key = "cat" if name == "categories" else "parent"
        df = df.repartition(buckets, key) if buckets else df.repartition(key)
        order = {"subcats": ["parent", "pos"], "files": ["parent", "file"], "categories": ["cat"]}[name]
        df.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    _put(spark, f"{folder}/{version}/meta.json", json.dumps({"built_at": time.time(), "limit": graph.limit}))
    publish(spark, folder, version)
    return version


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Point readers to a complete version; one without its meta file is refused."""
    if _get(spark, f"{folder}/{version}/meta.json") is None:
        raise ValueError(f"{version} is not complete")
    _replace(spark, f"{folder}/current.json", json.dumps({"version": version}))


def current_version(spark: SparkSession, folder: str) -> str | None:
    text = _get(spark, f"{folder}/current.json")
    return json.loads(text)["version"] if text else None


def read_snapshot(spark: SparkSession, folder: str, version: str | None = None) -> tuple[CategoryGraph, dict]:
    """The graph of a version (the current one if none is named) and its meta data."""
    version = version or current_version(spark, folder)
    if version is None:
        raise ValueError(f"no snapshot in {folder}")
    meta = json.loads(_get(spark, f"{folder}/{version}/meta.json") or "null")
    if meta is None:
        raise ValueError(f"{version} is not complete")
    tables = [spark.read.parquet(f"{folder}/{version}/{name}") for name in TABLES]
    return CategoryGraph(*tables, meta["limit"]), meta | {"version": version}
